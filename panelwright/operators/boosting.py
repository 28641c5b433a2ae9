"""Boosted trees with monotone inputs, grown on histograms that Spark aggregates.

Rows are binned once into a stored table. For each level of a tree one job sums gradients, curvatures and rows
per (node, input, bin): tasks add up their rows with numpy, Spark adds up the tasks, and the driver sees at most
nodes x inputs x bins sums, whatever the number of rows. There it picks every node's split.

Directions hold inside the trees: a split on a monotone input is allowed only if its two values are ordered as
the direction asks, and both sides inherit the middle of the two as a bound for all values below them. So each
tree, and their sum, moves one way along that input, whatever the other inputs are.

Rows of a second frame are scored along, so one fit tells the number of trees after which their loss
stops falling, and keeps the trees up to there."""

import json
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Transformer
from pyspark.ml.functions import array_to_vector
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.session import cut_lineage

BINS = 64  # bins of an input; cuts are quantiles
CUT = 16  # trees after which the rows' margins are stored anew
SHRINK = 10.0  # fixed value: penalty on a leaf's squared value
WEIGHT = 20.0  # fixed value: least curvature of a leaf
ROWS, INPUTS = 0.8, 0.8  # fixed values: share of rows and inputs that a tree sees

# A tree is a list of nodes: [input, bin, left, right, value]; input -1 is a leaf. A row goes left if its bin is at most `bin`.


def _mixed(values: np.ndarray, turn: int) -> np.ndarray:
    """Numbers in [0, 1) that differ from turn to turn."""
    x = values.view(np.uint64) + np.uint64((turn + 1) * 0x9E3779B97F4A7C15 % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) / 2.0**53


def places(tree: list[list], bins: np.ndarray) -> np.ndarray:
    """The node each row of bins ends in."""
    at = np.zeros(len(bins), dtype=np.int64)
    for number, (column, cut, left, right, _) in enumerate(tree):  # children follow their parents
        if column >= 0:
            here = at == number
            at[here] = np.where(bins[here, column] <= cut, left, right)
    return at


def margins(trees: Sequence[list], bins: np.ndarray, start) -> np.ndarray:
    total = np.zeros(len(bins)) + start
    for tree in trees:
        total += np.array([node[4] for node in tree])[places(tree, bins)]
    return total


def cut_points(rows: DataFrame, inputs: Sequence[str], bins: int = BINS) -> list[list[float]]:
    """Distinct approximate quantiles of each input; a value belongs to the first bin whose cut is not below it."""
    shares = [i / bins for i in range(1, bins)]
    return [sorted(set(cuts)) for cuts in rows.approxQuantile(list(inputs), shares, 0.25 / bins)]


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(-1, width)


def binned(values: np.ndarray, cuts: list[list[float]]) -> np.ndarray:
    return np.stack([np.searchsorted(cut, values[:, i], side="left") for i, cut in enumerate(cuts)], axis=1).astype(np.uint8)


def _binned_rows(frame: DataFrame, inputs: Sequence[str], label: str, cuts: list[list[float]], base: float, held_out: bool) -> DataFrame:
    values = F.array(*[F.col(name).cast("double") for name in inputs])
    rows = frame.select(F.xxhash64(*inputs, label).alias("key"), F.col(label).cast("double").alias("label"), values.alias("x"))

    def run(batches):
        for batch in batches:
            bins = binned(_matrix(batch["x"], len(cuts)), cuts)
            packed = pa.array([row.tobytes() for row in bins], pa.binary())
            yield pa.RecordBatch.from_arrays([batch["key"], batch["label"], packed, pa.array(np.full(len(bins), base))], names=["key", "label", "bins", "margin"])

    made = rows.mapInArrow(run, "key long, label double, bins binary, margin double")
    return made.withColumn("held_out", F.lit(held_out))


def _unpacked(batch: pa.RecordBatch, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(batch["bins"].to_pylist()), dtype=np.uint8).reshape(-1, width)


def _level(rows: DataFrame, trees: list, tree: list, open_nodes: list[int], turn: int, width: int, with_loss: bool) -> list:
    """Sums (node, input, bin, gradient, curvature, rows) of the open nodes, and the held-out loss as node -1."""
    held = rows.sparkSession.sparkContext.broadcast((trees, tree, open_nodes, turn, width, with_loss))

    def run(batches):
        trees, tree, open_nodes, turn, width, with_loss = held.value
        slot = np.full(len(tree), -1)
        slot[open_nodes] = np.arange(len(open_nodes))
        size = len(open_nodes) * width * 256
        sums, loss, seen = np.zeros((3, size)), 0.0, 0
        for batch in batches:
            bins, label = _unpacked(batch, width), batch["label"].to_numpy()
            p = 1 / (1 + np.exp(-margins(trees, bins, batch["margin"].to_numpy())))
            out = batch["held_out"].to_numpy(zero_copy_only=False)
            if with_loss and out.any():
                q = np.clip(np.where(label[out] == 1, p[out], 1 - p[out]), 1e-7, 1)
                loss, seen = loss - float(np.log(q).sum()), seen + int(out.sum())
            used = ~out & (_mixed(batch["key"].to_numpy(), turn) < ROWS)
            node = slot[places(tree, bins[used])]
            inside = node >= 0
            cell = (((node[inside, None] * width + np.arange(width)) * 256) + bins[used][inside]).ravel()
            g, h = (label - p)[used][inside], (p * (1 - p))[used][inside]
            for i, weights in enumerate((g, h, np.ones(len(g)))):
                sums[i] += np.bincount(cell, np.repeat(weights, width), size)
        found = np.flatnonzero(sums[2])
        columns = [np.array(open_nodes)[found // (width * 256)], found // 256 % width, found % 256, *sums[:, found]]
        if seen:
            columns = [np.append(c, v) for c, v in zip(columns, (-1, -1, -1, loss, 0.0, seen), strict=True)]
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.float64())
        names = ["node", "input", "bin", "g", "h", "n"]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    parts = rows.mapInArrow(run, "node int, input int, bin int, g double, h double, n double")
    return parts.groupBy("node", "input", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.sum("n").alias("n")).collect()


def leaf_value(g: float, h: float, low: float, high: float) -> float:
    return float(np.clip(g / (h + SHRINK), low, high))


def _won(g: float, h: float, value: float) -> float:
    """How much the loss falls by giving `value` to rows with these sums."""
    return g * value - 0.5 * (h + SHRINK) * value * value


def best_split(sums: dict[int, np.ndarray], signs: Sequence[int], low: float, high: float, least: float = WEIGHT) -> tuple | None:
    """(gain, input, bin, left sums, right sums, left bounds, right bounds) of the best allowed split of a node.
    `sums` gives gradient and curvature per bin of each input that may be used."""
    best = None
    for column, (g, h) in sorted(sums.items()):
        total_g, total_h = float(g.sum()), float(h.sum())
        before = _won(total_g, total_h, leaf_value(total_g, total_h, low, high))
        left_g, left_h = g.cumsum(), h.cumsum()
        for cut in np.flatnonzero((left_h >= least) & (total_h - left_h >= least)).tolist():
            a, b = (float(left_g[cut]), float(left_h[cut])), (total_g - float(left_g[cut]), total_h - float(left_h[cut]))
            left, right = leaf_value(*a, low, high), leaf_value(*b, low, high)
            sign = signs[column]
            if sign * (right - left) < 0:
                continue
            gain = _won(*a, left) + _won(*b, right) - before
            if gain > 1e-9 and (best is None or gain > best[0]):
                middle = (left + right) / 2
                of_left = (low, middle) if sign > 0 else (middle, high) if sign < 0 else (low, high)
                of_right = (middle, high) if sign > 0 else (low, middle) if sign < 0 else (low, high)
                best = (gain, column, cut, a, b, of_left, of_right)
    return best


def grow(level, depth: int, inputs: Sequence[int], signs: Sequence[int], rate: float, least: float = WEIGHT) -> tuple[list[list], float | None]:
    """One tree, level by level. `level(tree, open nodes, first)` gives the sums; also returns the held-out loss
    that the first level reports."""
    tree: list[list] = [[-1, 0, 0, 0, 0.0]]
    bounds = {0: (-np.inf, np.inf)}
    open_nodes, loss = [0], None
    for at in range(depth):
        sums: dict[int, dict[int, np.ndarray]] = {}
        for row in level(tree, open_nodes, at == 0):
            if row.node < 0:
                loss = row.g / row.n
            elif row.input in inputs:
                cells = sums.setdefault(row.node, {}).setdefault(row.input, np.zeros((2, 256)))
                cells[:, row.bin] += row.g, row.h
        following = []
        for node in open_nodes:
            low, high = bounds[node]
            if at == 0 and node in sums:
                g, h = (float(part.sum()) for part in next(iter(sums[node].values())))
                tree[node][4] = rate * leaf_value(g, h, low, high)
            split = best_split(sums.get(node, {}), signs, low, high, least)
            if split is None:
                continue
            _, column, cut, a, b, of_left, of_right = split
            left = len(tree)
            tree[node][:4] = [column, cut, left, left + 1]
            for number, part, limits in ((left, a, of_left), (left + 1, b, of_right)):
                tree.append([-1, 0, 0, 0, rate * leaf_value(*part, *limits)])
                bounds[number] = limits
                following.append(number)
        open_nodes = following
        if not open_nodes:
            break
    return tree, loss


class BoostedTrees(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """A fitted sum of trees; adds `probability`, a vector of both classes."""

    inputs = Param(Params._dummy(), "inputs", "input columns", typeConverter=TypeConverters.toListString)
    fitted = Param(Params._dummy(), "fitted", "base, cuts and trees as JSON", typeConverter=TypeConverters.toString)

    @keyword_only
    def __init__(self, inputs=None, fitted=None):
        super().__init__()
        self._set(**{name: value for name, value in self._input_kwargs.items() if value is not None})

    def model(self) -> dict:
        return json.loads(self.getOrDefault(self.fitted))

    def _transform(self, dataset: DataFrame) -> DataFrame:
        inputs, held = self.getOrDefault(self.inputs), dataset.sparkSession.sparkContext.broadcast(self.model())

        @F.pandas_udf("double")
        def score(values: pd.Series) -> pd.Series:
            model = held.value
            bins = binned(np.stack(values.to_numpy()), model["cuts"])
            return pd.Series(1 / (1 + np.exp(-margins(model["trees"], bins, model["base"]))))

        p = score(F.array(*[F.col(name).cast("double") for name in inputs]))
        scored = dataset.withColumn("_p", p)
        return scored.withColumn("probability", array_to_vector(F.array(1 - F.col("_p"), F.col("_p")))).drop("_p")


def kept_trees(losses: Sequence[float], patience: int) -> int:
    """Trees to keep: the best loss so far once ``patience`` further trees bring no better one. ``losses[i]`` is
    the loss with i + 1 trees."""
    best = 0
    for at, loss in enumerate(losses):
        if loss < losses[best]:
            best = at
        elif at - best >= patience:
            break
    return best + 1


def fit_boosted(
    training: DataFrame, inputs: Sequence[str], label: str, signs: dict[str, int], trees: int, depth: int, rate: float,
    least: float = WEIGHT, evaluation: DataFrame | None = None, patience: int = 40, seed: int = 42,
) -> BoostedTrees:
    """Trees on `training`; with `evaluation` growing ends once its loss has not fallen for `patience` trees, and
    the trees up to the lowest loss are kept. Labels of a single class, or none, raise."""
    counts = training.agg(F.avg(F.col(label).cast("double")).alias("share")).first()["share"]
    if counts is None or not 0 < counts < 1:
        raise ValueError("Outcomes have a single class; there is nothing to learn")
    base, cuts = float(np.log(counts / (1 - counts))), cut_points(training, inputs)
    rows = _binned_rows(training, inputs, label, cuts, base, False)
    if evaluation is not None:
        rows = rows.union(_binned_rows(evaluation, inputs, label, cuts, base, True))
    rows, width, directions = cut_lineage(rows), len(inputs), [signs.get(name, 0) for name in inputs]
    draw, grown, recent, losses = np.random.default_rng(seed), [], [], []
    for turn in range(trees):
        chosen = set(draw.permutation(width)[: max(1, round(INPUTS * width))].tolist())

        def level(tree, open_nodes, first, rows=rows, turn=turn):
            return _level(rows, recent, tree, open_nodes, turn, width, first and evaluation is not None)

        tree, loss = grow(level, depth, chosen, directions, rate, least)
        if loss is not None and turn:
            losses.append(loss)  # of the trees before this one
            if len(losses) - kept_trees(losses, patience) >= patience:
                break
        grown.append(tree)
        recent = [*recent, tree]
        if len(recent) == CUT and turn + 1 < trees:
            rows, recent = _advanced(rows, recent, width), []
    else:
        if evaluation is not None and grown:
            last = [row for row in _level(rows, recent, [[-1, 0, 0, 0, 0.0]], [], 0, width, True) if row.node < 0]
            losses += [row.g / row.n for row in last]
    if losses:
        grown = grown[: kept_trees(losses, patience)]
    return BoostedTrees(inputs=list(inputs), fitted=json.dumps({"base": base, "cuts": cuts, "trees": grown}))


def _advanced(rows: DataFrame, trees: list, width: int) -> DataFrame:
    """The rows with the trees added to their margins, stored anew."""
    held = rows.sparkSession.sparkContext.broadcast(trees)

    def run(batches):
        for batch in batches:
            moved = margins(held.value, _unpacked(batch, width), batch["margin"].to_numpy())
            yield pa.RecordBatch.from_arrays([batch["key"], batch["label"], batch["bins"], pa.array(moved), batch["held_out"]], names=batch.schema.names)

    return cut_lineage(rows.mapInArrow(run, rows.schema))
