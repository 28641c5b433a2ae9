import math
import random

import numpy as np
import pytest
from pyspark.ml import PipelineModel

from panelwright.operators import boosting


class Row:
    def __init__(self, *values):
        self.node, self.input, self.bin, self.g, self.h, self.n = values


def test_split_worked_out_by_hand(monkeypatch):
    monkeypatch.setattr(boosting, "SHRINK", 1.0)
    # Three bins: gradients -3, 1, 4, curvatures 2, 1, 2. Cutting after the first: values -3/3 and 5/4.
    sums = {0: np.array([[-3.0, 1.0, 4.0], [2.0, 1.0, 2.0]])}
    gain, column, cut, left, right, _, _ = boosting.best_split(sums, [0], -np.inf, np.inf, 1.0)
    assert (column, cut, left, right) == (0, 0, (-3.0, 2.0), (5.0, 3.0))
    assert gain == pytest.approx(9 / 6 + 25 / 8 - 4 / 12)
    # Falling is asked for: neither cut has a left value above the right one.
    assert boosting.best_split(sums, [-1], -np.inf, np.inf, 1.0) is None
    # A rising split hands the middle of its values down as a bound to both sides.
    _, _, _, _, _, of_left, of_right = boosting.best_split(sums, [1], -np.inf, np.inf, 1.0)
    assert of_left == (-np.inf, 0.125) and of_right == (0.125, np.inf)
    # Inside bounds the values are clipped, and the gain is that of the clipped values.
    gain, *_ = boosting.best_split(sums, [1], -0.5, 0.5, 1.0)
    won = lambda g, h, v: g * v - 0.5 * (h + 1) * v * v
    assert gain == pytest.approx(won(-3, 2, -0.5) + won(5, 3, 0.5) - won(2, 5, 1 / 3))


def test_bounds_hold_below_the_next_level(monkeypatch):
    """Input 0 must rise. Its right side has a bin of input 1 that wants a value below the left side's."""
    monkeypatch.setattr(boosting, "SHRINK", 1.0)
    first = [Row(0, 0, 0, -2.0, 3.0, 9), Row(0, 0, 1, 4.0, 7.0, 9), Row(0, 1, 0, 1.0, 5.0, 9), Row(0, 1, 1, 1.0, 5.0, 9)]
    second = [Row(2, 1, 0, 9.0, 3.0, 9), Row(2, 1, 1, -5.0, 3.0, 9), Row(1, 1, 0, -1.0, 1.5, 9), Row(1, 1, 1, -1.0, 1.5, 9)]
    tree, _ = boosting.grow(lambda tree, nodes, is_first: first if is_first else second, 2, {0, 1}, [1, 0], 1.0, 1.0)
    assert tree[0][:2] == [0, 0] and tree[1][0] == -1 and tree[2][:2] == [1, 0]
    middle = (-2 / 4 + 4 / 8) / 2
    assert [node[4] for node in tree if node[0] < 0] == pytest.approx([-0.5, 9 / 4, middle])


def logistic_rows(spark, count, seed):
    draw, rows = random.Random(seed), []
    for _ in range(count):
        a, b, c = draw.gauss(0, 1), draw.gauss(0, 1), float(draw.randrange(5))
        p = 1 / (1 + math.exp(-(1.5 * a - b * b + 1 + 0.6 * (c == 2))))
        rows.append((a, b, c, float(draw.random() < p)))
    return spark.createDataFrame(rows, "a double, b double, c double, y double").repartition(3).persist()


def probabilities(model, frame):
    return np.array([[row.y, row.probability[1]] for row in model.transform(frame).select("y", "probability").collect()])


def loss(found):
    return -np.log(np.where(found[:, 0] == 1, found[:, 1], 1 - found[:, 1])).mean()


@pytest.fixture(scope="module")
def frames(spark):
    return logistic_rows(spark, 3000, 1), logistic_rows(spark, 1500, 2)


def test_one_fit_learns_and_keeps_the_trees_up_to_the_lowest_loss(frames, monkeypatch):
    training, evaluation = frames
    monkeypatch.setattr(boosting, "CUT", 5)  # margins are stored anew inside the run
    model = boosting.fit_boosted(training, ["a", "b", "c"], "y", {"a": 1}, 60, 3, 0.5, 5, evaluation, patience=6)
    trees = model.model()["trees"]
    assert 3 < len(trees) < 54
    best, share = loss(probabilities(model, evaluation)), 0.5
    found = probabilities(model, evaluation)
    share = found[:, 0].mean()
    assert best < 0.85 * -(share * math.log(share) + (1 - share) * math.log(1 - share))
    for kept in (len(trees) - 3, len(trees) - 1):
        shorter = boosting.BoostedTrees(inputs=["a", "b", "c"], fitted=boosting.json.dumps(model.model() | {"trees": trees[:kept]}))
        assert loss(probabilities(shorter, evaluation)) > best


def test_probabilities_react_to_a_trend_inside_the_trees_and_only_its_way(spark, frames):
    training, _ = frames
    model = boosting.fit_boosted(training, ["a", "b", "c"], "y", {"a": -1, "b": 1}, 8, 3, 0.3, 5)
    points = [(a / 4, b / 2, float(c), 0.0) for a in range(-12, 13) for b in range(-4, 5) for c in range(5)]
    scored = model.transform(spark.createDataFrame(points, "a double, b double, c double, y double")).collect()
    p = {(r.a, r.b, r.c): r.probability[1] for r in scored}
    # The data rise along a, so trees that may only fall leave it alone; b is allowed to rise and does in places.
    assert all(p[a, b, c] >= p[a + 0.25, b, c] for a, b, c in p if (a + 0.25, b, c) in p)
    assert all(p[a, b, c] <= p[a, b + 0.5, c] for a, b, c in p if (a, b + 0.5, c) in p)
    assert any(p[a, b, c] < p[a, b + 0.5, c] - 0.01 for a, b, c in p if (a, b + 0.5, c) in p)
    rising = boosting.fit_boosted(training, ["a", "b", "c"], "y", {"a": 1}, 8, 3, 0.3, 5)
    scored = rising.transform(spark.createDataFrame(points, "a double, b double, c double, y double")).collect()
    p = {(r.a, r.b, r.c): r.probability[1] for r in scored}
    assert all(p[a, b, c] <= p[a + 0.25, b, c] for a, b, c in p if (a + 0.25, b, c) in p)
    assert p[2.0, 0.0, 0.0] > p[-2.0, 0.0, 0.0] + 0.3


def test_partitions_do_not_matter_and_saved_trees_load(spark, frames, tmp_path, monkeypatch):
    training, evaluation = frames
    cuts = boosting.cut_points(training, ["a", "b", "c"])  # approximate, so taken once
    monkeypatch.setattr(boosting, "cut_points", lambda *_: cuts)
    fit = lambda rows: boosting.fit_boosted(rows, ["a", "b", "c"], "y", {"a": 1}, 3, 3, 0.3, 5)
    one, many = fit(training.coalesce(1)), fit(training.repartition(7))
    shape = lambda model: [[node[:4] for node in tree] for tree in model.model()["trees"]]
    assert shape(one) == shape(many)
    PipelineModel(stages=[one]).write().overwrite().save(str(tmp_path / "model"))
    loaded = PipelineModel.load(str(tmp_path / "model"))
    assert np.array_equal(np.sort(probabilities(loaded, evaluation), axis=0), np.sort(probabilities(one, evaluation), axis=0))


def test_a_single_class_is_refused(spark):
    rows = spark.createDataFrame([(1.0, 1.0), (2.0, 1.0)], "a double, y double")
    for frame in (rows, rows.limit(0)):
        with pytest.raises(ValueError, match="single class"):
            boosting.fit_boosted(frame, ["a"], "y", {}, 2, 2, 0.1)
