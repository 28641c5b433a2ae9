"""Quality classifier: a generalised additive model with pairwise interactions.

Each text gives a dozen surface features. Every feature has a lookup table over quantile bins, learned by
boosting shallow trees on one feature after the other, in turns and with a low rate, so that correlated
features share their effect. Then the pairs of features that explain most of what is left get tables of
their own. A score is the sum of the looked-up values. Learning sees a bounded sample of labelled rows
(`labelled.SAMPLE`) on the driver; scoring covers every row, in Arrow batches, in one pass.

Defined cases: null text is empty and is scored like any other; without labelled rows of both classes
the score is the labelled share of good texts, or one half; rows that repeat are scored one by one;
labels, lang, source and doc_id are never inputs of a score; extra columns are not read.
"""

from itertools import combinations
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.llm.labelled import held_out, training_rows
from panelwright.llm.words import encoded, map_rows, releasing

MODULUS, HELD = 3, 1
BINS, PAIR_BINS, PAIRS = 32, 8, 6
PART = 256  # texts whose features are computed at a time
TURNS, PAIR_TURNS, RATE, SHRINK = 200, 60, 0.1, 5.0
FEATURES = (
    "log_words", "mean_word", "capitals", "signs", "stops", "digits", "not_ascii", "breaks",
    "distinct_words", "echoes", "distinct_lines", "short_words", "signed_words",
)

_CLASSES = np.zeros((256, 7), dtype=np.int64)  # capitals, small letters, signs, stops, digits, not ASCII, breaks
_CLASSES[65:91, 0] = _CLASSES[97:123, 1] = _CLASSES[48:58, 4] = _CLASSES[128:, 5] = _CLASSES[10, 6] = 1
_CLASSES[list(b"#$%&*|!<>{}[]\\^~=+_@"), 2] = 1
_CLASSES[list(b".,;:?"), 3] = 1
_SIGNS = b"#$%&*|!<>{}[]\\^~=+_@"


def features(text: bytes) -> list[float]:
    count = np.bincount(np.frombuffer(text, dtype=np.uint8), minlength=256) @ _CLASSES
    capitals, small, signs, stops, digits, foreign, breaks = count.tolist()
    words, size = text.split(), max(len(text), 1)
    lines, total = text.split(b"\n"), max(len(words), 1)
    return [
        float(np.log1p(len(words))), len(text) / total, capitals / max(capitals + small, 1), signs / size, stops / total,
        digits / size, foreign / size, breaks / total, len(set(words)) / total, sum(map(eq, words, words[1:])) / total,
        len(set(lines)) / len(lines), sum(len(word) <= 3 for word in words) / total,
        sum(word[-1] in _SIGNS for word in words) / total,
    ]


def _best_cut(gradient: np.ndarray, weight: np.ndarray, low: int, high: int) -> tuple[float, int]:
    """Gain and place of the best cut between bins low..high-1."""
    if high - low < 2:
        return 0.0, low
    g, h = np.cumsum(gradient[low:high]), np.cumsum(weight[low:high])
    left, right = g[:-1] ** 2 / (h[:-1] + SHRINK), (g[-1] - g[:-1]) ** 2 / (h[-1] - h[:-1] + SHRINK)
    gains = left + right - g[-1] ** 2 / (h[-1] + SHRINK)
    best = int(gains.argmax())
    return float(gains[best]), low + best + 1


def shallow_tree(gradient: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Value per bin of a tree of depth two over one feature's bins."""
    size = len(gradient)
    _, middle = _best_cut(gradient, weight, 0, size)
    cuts = {0, middle, size}
    for low, high in ((0, middle), (middle, size)):
        gain, cut = _best_cut(gradient, weight, low, high)
        if gain > 0:
            cuts.add(cut)
    values = np.zeros(size)
    edges = sorted(cuts)
    for low, high in zip(edges, edges[1:], strict=False):
        values[low:high] = gradient[low:high].sum() / (weight[low:high].sum() + SHRINK)
    return values


def pair_tree(gradient: np.ndarray, weight: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and values of a tree that cuts the first feature once and each side by the second."""
    g, h = gradient.cumsum(axis=0), weight.cumsum(axis=0)
    best = (-1.0, np.zeros_like(gradient))
    whole = gradient.sum() ** 2 / (weight.sum() + SHRINK)
    for cut in range(1, len(gradient)):
        values, gain = np.zeros_like(gradient), -whole
        for rows, gs, hs in ((slice(0, cut), g[cut - 1], h[cut - 1]), (slice(cut, None), g[-1] - g[cut - 1], h[-1] - h[cut - 1])):
            _, middle = _best_cut(gs, hs, 0, len(gs))
            for columns in (slice(0, middle), slice(middle, None)):
                total, mass = gs[columns].sum(), hs[columns].sum()
                values[rows, columns] = total / (mass + SHRINK)
                gain += total**2 / (mass + SHRINK)
        if gain > best[0]:
            best = (gain, values)
    return best


class Gam:
    def __init__(self):
        self.base, self.cuts, self.coarse, self.tables, self.pairs = 0.0, [], [], [], {}

    def _bins(self, x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
        return np.stack([np.searchsorted(cut, column, side="right") for cut, column in zip(cuts, x.T, strict=True)], axis=1)

    def fit(self, x: np.ndarray, y: np.ndarray) -> "Gam":
        share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.base = float(np.log(share / (1 - share)))
        quantiles = lambda bins: [np.unique(np.quantile(column, np.arange(1, bins) / bins)) for column in x.T]
        self.cuts, self.coarse = quantiles(BINS), quantiles(PAIR_BINS)
        self.tables = [np.zeros(len(cut) + 1) for cut in self.cuts]
        bins, coarse = self._bins(x, self.cuts), self._bins(x, self.coarse)
        logit = np.full(len(y), self.base)
        for _ in range(TURNS):
            for j, table in enumerate(self.tables):
                p = 1 / (1 + np.exp(-logit))
                values = RATE * shallow_tree(
                    np.bincount(bins[:, j], y - p, len(table)), np.bincount(bins[:, j], p * (1 - p), len(table))
                )
                table += values
                logit += values[bins[:, j]]
        cells = lambda i, j: coarse[:, i] * PAIR_BINS + coarse[:, j]

        def tree(i, j):
            p = 1 / (1 + np.exp(-logit))
            shape = (PAIR_BINS, PAIR_BINS)
            sums = [np.bincount(cells(i, j), v, PAIR_BINS**2).reshape(shape) for v in (y - p, p * (1 - p))]
            return pair_tree(*sums)

        ranked = sorted(combinations(range(x.shape[1]), 2), key=lambda pair: -tree(*pair)[0])
        self.pairs = {pair: np.zeros(PAIR_BINS**2) for pair in ranked[:PAIRS]}
        for _ in range(PAIR_TURNS):
            for (i, j), table in self.pairs.items():
                values = RATE * tree(i, j)[1].ravel()
                table += values
                logit += values[cells(i, j)]
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        logit = np.full(len(x), self.base)
        if self.tables:
            bins, coarse = self._bins(x, self.cuts), self._bins(x, self.coarse)
            for j, table in enumerate(self.tables):
                logit += table[bins[:, j]]
            for (i, j), table in self.pairs.items():
                logit += table[coarse[:, i] * PAIR_BINS + coarse[:, j]]
        return 1 / (1 + np.exp(-logit))


def train(docs: DataFrame, labels: DataFrame) -> Gam:
    sample = training_rows(docs, labels, "quality", MODULUS, HELD)

    def run(batch: pa.RecordBatch):
        yield {"doc_id": batch["doc_id"], "label": batch["label"], "x": [features(text) for text in encoded(batch["text"])]}

    rows = sorted(map_rows(sample, run, "doc_id long, label int, x array<double>").collect())
    model = Gam()
    if rows:
        y = np.array([row.label for row in rows], dtype=float)
        if 0 < y.mean() < 1:
            return model.fit(np.array([row.x for row in rows]), y)
        model.base = 7.0 if y.mean() == 1 else -7.0
    return model


def _scores(column: pa.Array, model: Gam) -> np.ndarray:
    """Scores of a batch's texts, PART of which are Python objects at a time."""
    parts = [[features(text) for text in encoded(column.slice(at, PART))] for at in range(0, len(column), PART)]
    return model.score(np.array([x for part in parts for x in part])) if parts else np.zeros(0)


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of `docs`."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels))  # some hundred numbers

    def run(batch: pa.RecordBatch):
        yield {"doc_id": batch["doc_id"], "held_out": batch["held_out"], "score": _scores(batch["text"], model.value)}

    rows = docs.select("doc_id", held_out("doc_id", MODULUS, HELD).alias("held_out"), "text")
    scored = map_rows(rows, run, "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of `docs` that the classifier predicts to be good, with all their columns."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels))

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(_scores(batch["text"], model.value) >= 0.5))

    return docs.mapInArrow(releasing(run), docs.schema)
