"""Quality and toxicity: held-out accuracy, what they learn from, awkward rows."""

import zlib

import numpy as np
import pytest

from panelwright.llm import labelled, quality, toxicity
from tests.llm import corpus

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tables(spark):
    return [spark.read.parquet(f"{FOLDER}/{name}.parquet") for name in ("documents", "labels")]


def accuracy(scored, labels, target):
    truth = {r.doc_id: r[target] for r in labels.collect()}
    rows = [(r.predicted, truth[r.doc_id], r.held_out) for r in scored.collect() if r.doc_id in truth]
    held = [p == t for p, t, h in rows if h]
    return np.mean(held), len(held)


@pytest.mark.parametrize(("operator", "target", "least"), [(quality, "quality", 0.95), (toxicity, "toxic", 0.93)])
def test_held_out_accuracy(tables, operator, target, least):
    docs, labels = tables
    scored = operator.score(docs, labels).cache()
    assert scored.count() == docs.count()
    assert scored.where("score < 0 or score > 1 or predicted <> cast(score >= 0.5 as int)").count() == 0
    for row in scored.select("doc_id", "held_out").limit(200).collect():
        assert row.held_out == (zlib.crc32(str(row.doc_id).encode()) % operator.MODULUS == operator.HELD)
    share, rows = accuracy(scored, labels, target)
    assert rows > 50 and share >= least


@pytest.mark.parametrize(("operator", "target"), [(quality, "quality"), (toxicity, "toxic")])
def test_held_out_labels_are_never_seen(tables, operator, target):
    docs, labels = tables
    sample = labelled.training_rows(docs, labels, target, operator.MODULUS, operator.HELD).collect()
    assert sample and all(zlib.crc32(str(r.doc_id).encode()) % operator.MODULUS != operator.HELD for r in sample)
    few = labelled.training_rows(docs, labels.union(labels), target, operator.MODULUS, operator.HELD, size=7)
    assert len({r.doc_id for r in few.collect()}) == 7


@pytest.mark.parametrize("operator", [quality, toxicity])
def test_awkward_rows_and_missing_labels(spark, operator):
    docs = corpus.documents(spark)
    schema = "doc_id long, quality int, toxic int"
    for rows in ([], [(None, 1, 1), (1, None, None)], [(0, 1, 0), (1, 1, 0), (4, 1, 0)], [(i, i % 2, i % 2) for i in range(100, 160)] * 2):
        scored = operator.score(docs, spark.createDataFrame(rows, schema)).collect()
        assert len(scored) == len(corpus.texts())
        assert all(0 <= r.score <= 1 and r.held_out is not None for r in scored)
    assert operator.score(corpus.documents(spark, []), spark.createDataFrame([], schema)).count() == 0


def test_rejected_documents_go(spark, tables):
    docs, labels = tables
    kept = quality.keep_good(docs, labels)
    good = quality.score(docs, labels).where("predicted = 1")
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in good.collect())


def test_tables_of_features_add_up():
    draw = np.random.default_rng(2)
    x = draw.normal(size=(3000, 4))
    logit = np.where(x[:, 0] > 0, 2.0, -1.0) + 3.0 * np.where((x[:, 1] > 0) & (x[:, 2] > 0), 1, -0.3)
    y = (draw.random(3000) < 1 / (1 + np.exp(-logit))).astype(float)
    model = quality.Gam().fit(x, y)
    assert (1, 2) in model.pairs
    best = ((logit > 0) == y).mean()
    assert ((model.score(x) >= 0.5) == y).mean() > best - 0.02
    assert np.ptp(model.tables[3]) < np.ptp(model.tables[0]) / 2


def test_folding_and_exceptions():
    assert toxicity.fold("Idiοt 1D10T! ｉｄｉｏｔ іdіоt") == ["idiot", "idiot", "idiot", "idiot"]
    machine = toxicity.Automaton({("bad",): 2.0, ("bad", "apple"): None, ("so", "bad"): None, ("apple", "pie"): 1.0})
    words = "so bad a bad apple pie and bad".split()
    assert sorted(machine.occurrences(words), key=str) == sorted(
        [(1, 2, 2.0), (0, 2, None), (3, 4, 2.0), (3, 5, None), (4, 6, 1.0), (7, 8, 2.0)], key=str
    )
    total, _, terms = toxicity.measures(machine, "so bad a bad apple pie and bad")
    assert total == pytest.approx(np.log1p(3.0)) and terms == pytest.approx(np.log1p(2))


def test_exceptions_are_learned(spark):
    rows = [(f"{corpus.prose(8, i)} scum {corpus.prose(8, i + 400)}", 1) for i in range(60)]
    rows += [(f"{corpus.prose(8, i)} pond scum {corpus.prose(8, i + 400)}", 0) for i in range(5)]
    rows += [(corpus.prose(16, i + 900), 0) for i in range(300)]
    lexicon = toxicity.learn_lexicon(spark.createDataFrame(rows, "text string, label int"))
    assert lexicon[("scum",)] > 2 and lexicon[("pond", "scum")] is None


def test_every_term_and_exception_that_passes_is_kept(spark):
    name = lambda i: "q" + chr(103 + i // 20) + chr(103 + i % 20)
    rows = [(" ".join(f"{corpus.prose(2, 700 * k + i)} {name(i)}" for i in range(k, 300, 15)), 1) for k in range(15) for _ in range(30)]
    rows += [(" ".join(f"pond {name(i)}" for i in range(k, 300, 15)), 0) for k in range(15) for _ in range(3)]
    rows += [(corpus.prose(16, i + 20_000), 0) for i in range(900)]
    lexicon = toxicity.learn_lexicon(spark.createDataFrame(rows, "text string, label int"))
    for i in range(300):
        assert lexicon[(name(i),)] > 0 and lexicon[("pond", name(i))] is None
