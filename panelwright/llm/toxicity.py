"""Toxicity by a weighted lexicon.

Texts are folded first: letters that look like Latin ones and digits that stand for letters become those
letters, and everything between words becomes a space. The lexicon is learned from labelled rows: words
whose presence marks toxic texts, weighted by their log-odds less one standard error. Phrases around such words that occur in
harmless texts only are exceptions. An Aho-Corasick automaton over words finds terms and exceptions in one
pass; terms inside an exception do not count. The summed weight and its share of the length give the score
through a logistic curve.

Learning sees a bounded sample of labelled rows (`labelled.SAMPLE`); word counts are Spark aggregates, the
lexicon holds every word and phrase that passes the tests. Scoring covers every row in one pass.

Defined cases: null text is empty and is scored like any other; without toxic and harmless labels the
score is 0; rows that repeat are scored one by one; labels, lang, source and doc_id are never inputs of a
score; extra columns are not read.
"""

import re
from bisect import bisect_right
from collections import deque
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.llm.labelled import held_out, training_rows
from panelwright.llm.words import map_rows
from panelwright.session import cut_lineage

MODULUS, HELD = 5, 0
CERTAINTY, LEAST_ODDS = 3.0, 2.5  # a term's log-odds, at least and in standard errors
LEAST_TEXTS = 3

# Letters that look like a Latin one, and digits that stand for a letter.
LOOKALIKES = {
    "а": "a", "α": "a", "в": "b", "β": "b", "с": "c", "ϲ": "c", "ԁ": "d", "е": "e", "ε": "e", "ё": "e",
    "һ": "h", "і": "i", "ι": "i", "ј": "j", "к": "k", "κ": "k", "м": "m", "п": "n", "ո": "n", "о": "o",
    "ο": "o", "σ": "o", "р": "p", "ρ": "p", "ԛ": "q", "г": "r", "ѕ": "s", "т": "t", "τ": "t", "υ": "u",
    "ν": "v", "ѵ": "v", "ԝ": "w", "ω": "w", "х": "x", "χ": "x", "у": "y", "γ": "y",
}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b"}

_FOLD = {ord(a): b for a, b in LOOKALIKES.items()} | {0xFEE0 + c: chr(c).lower() for c in range(0x21, 0x7F)}
_FOREIGN = re.compile(f"[{''.join(map(chr, _FOLD))}]")
_ASCII = bytes(
    ord(DIGITS[chr(b)]) if chr(b) in DIGITS else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32
    for b in range(256)
)


def fold(text: str) -> list[str]:
    """Folded words of a text."""
    if not text.isascii():
        text = text.lower()
        if _FOREIGN.search(text):
            text = text.translate(_FOLD)
    return text.encode("utf-8", "replace").translate(_ASCII).decode().split()


class Automaton:
    """Aho-Corasick over words: all occurrences of phrases in one pass over a text."""

    def __init__(self, phrases: dict[tuple[str, ...], float | None]):
        self.moves: list[dict[str, int]] = [{}]
        self.found: list[list[tuple[int, float | None]]] = [[]]
        for phrase, weight in phrases.items():
            state = 0
            for word in phrase:
                if word not in self.moves[state]:
                    self.moves[state][word] = len(self.moves)
                    self.moves.append({})
                    self.found.append([])
                state = self.moves[state][word]
            self.found[state].append((len(phrase), weight))
        self.fail = [0] * len(self.moves)
        queue = deque(self.moves[0].values())
        while queue:
            state = queue.popleft()
            for word, after in self.moves[state].items():
                queue.append(after)
                back = self.fail[state]
                while back and word not in self.moves[back]:
                    back = self.fail[back]
                self.fail[after] = self.moves[back].get(word, 0)
                self.found[after] = self.found[after] + self.found[self.fail[after]]
        self.alphabet = frozenset(word for phrase in phrases for word in phrase)

    def occurrences(self, words: list[str]):
        """(start, end, weight) of every phrase; weight is None for an exception."""
        if self.alphabet.isdisjoint(words):
            return
        state = 0
        for at, word in enumerate(words):
            while state and word not in self.moves[state]:
                state = self.fail[state]
            state = self.moves[state].get(word, 0)
            for length, weight in self.found[state]:
                yield at + 1 - length, at + 1, weight


def measures(automaton: Automaton, text: str) -> tuple[float, float, float]:
    """Logarithms of the summed weight, of its share of the length, and of the distinct terms."""
    words = fold(text)
    spans = list(automaton.occurrences(words))
    excused = sorted((a, b) for a, b, weight in spans if weight is None)
    begins, furthest = [a for a, _ in excused], [0, *accumulate((b for _, b in excused), max)]
    total, seen = 0.0, set()
    for a, b, weight in spans:
        if weight is not None and furthest[bisect_right(begins, a)] < b:
            total += weight
            seen.add(words[a])
    return float(np.log1p(total)), float(np.log1p(1000 * total / max(len(words), 20))), float(np.log1p(len(seen)))


def _word_rows(batch: pa.RecordBatch):
    yield {"label": batch["label"], "words": [sorted(set(fold(text.as_py()))) for text in batch["text"]]}


def learn_lexicon(sample: DataFrame) -> dict[tuple[str, ...], float | None]:
    """Terms with weights and exception phrases (None) from rows (text, label)."""
    toxic, harmless = (sample.where(F.col("label") == label).count() for label in (1, 0))
    if not toxic or not harmless:
        return {}
    odds = lambda hits, total: F.log((hits + 0.5) / (total - hits + 0.5))
    texts = map_rows(sample.select("text", "label"), _word_rows, "label int, words array<string>")
    counts = texts.select("label", F.explode("words").alias("word")).groupBy("word").agg(
        F.sum("label").cast("double").alias("bad"), F.sum(1 - F.col("label")).cast("double").alias("good")
    )
    weight = odds(F.col("bad"), toxic) - odds(F.col("good"), harmless)
    error = F.sqrt(1 / (F.col("bad") + 0.5) + 1 / (F.col("good") + 0.5))
    terms = (
        counts.withColumn("weight", weight)
        .where((F.col("bad") >= LEAST_TEXTS) & (F.col("weight") > LEAST_ODDS) & (F.col("weight") > CERTAINTY * error))
        .withColumn("weight", F.col("weight") - error).orderBy(F.desc("weight"), "word").collect()
    )
    lexicon: dict[tuple[str, ...], float | None] = {(row.word,): row.weight for row in terms}

    def phrases(batch: pa.RecordBatch):
        found = []
        for text in batch["text"]:
            words, near = fold(text.as_py()), set()
            for at, word in enumerate(words):
                if (word,) in lexicon:
                    near.update(" ".join(words[a : a + 2]) for a in (at - 1, at) if 0 <= a and a + 2 <= len(words))
            found.append(sorted(near))
        yield {"label": batch["label"], "words": found}

    around = map_rows(sample.select("text", "label"), phrases, "label int, words array<string>")
    harmless_only = (
        around.select("label", F.explode("words").alias("phrase")).groupBy("phrase")
        .agg(F.sum("label").alias("bad"), F.count("*").alias("texts"))
        .where((F.col("bad") == 0) & (F.col("texts") >= LEAST_TEXTS)).orderBy(F.desc("texts"), "phrase").collect()
    )
    return lexicon | {tuple(row.phrase.split(" ")): None for row in harmless_only}


def logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Coefficients, the constant last, by Newton steps with a small penalty."""
    x = np.column_stack([x, np.ones(len(x))])
    beta = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(len(beta))
        beta += np.clip(np.linalg.solve(hessian, x.T @ (y - p) - 1e-2 * beta), -3, 3)
    return beta


def train(docs: DataFrame, labels: DataFrame) -> tuple[Automaton, np.ndarray] | None:
    sample = cut_lineage(training_rows(docs, labels, "toxic", MODULUS, HELD))
    lexicon = learn_lexicon(sample)
    if not lexicon:
        return None
    automaton = Automaton(lexicon)

    def run(batch: pa.RecordBatch):
        yield {"label": batch["label"], "x": [measures(automaton, text.as_py()) for text in batch["text"]]}

    rows = sorted(map_rows(sample, run, "label int, x array<double>").collect())  # the bounded sample
    return automaton, logistic(np.array([row.x for row in rows]), np.array([row.label for row in rows], dtype=float))


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of `docs`."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels))  # learned from the bounded sample

    def run(batch: pa.RecordBatch):
        if model.value is None:
            scores = [0.0] * batch.num_rows
        else:
            automaton, beta = model.value
            x = np.array([measures(automaton, text.as_py()) for text in batch["text"]])
            scores = 1 / (1 + np.exp(-np.clip(x @ beta[:-1] + beta[-1], -30, 30)))
        yield {"doc_id": batch["doc_id"], "held_out": batch["held_out"], "score": scores}

    rows = docs.select("doc_id", held_out("doc_id", MODULUS, HELD).alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))
    scored = map_rows(rows, run, "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
