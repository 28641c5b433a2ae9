"""The pipeline and the registered queries."""

import public_tokenizers
import pytest
import tiktoken

import __spark_entry__ as entry
import corpus_pipeline
from panelwright.llm import bpe, decontaminate, exact_dedup, near_dup, quality
from panelwright.llm import queries as llm
from tests.check_queries import connect, difference

FOLDER = "/root/testdata/sf0.001"


def test_every_operator_has_its_query():
    names = sorted(llm.REGISTRY)
    assert [n for n in names if n.startswith("op")] == sorted(n for n in names if n != "pipeline")
    assert {int(n[2:].split("_")[0]) for n in names if n != "pipeline"} == set(range(1, 11))
    assert set(llm.REGISTRY) <= set(entry.queries()) and set(llm.ORACLE) <= set(llm.REGISTRY)


@pytest.mark.parametrize("name", sorted(llm.ORACLE))
def test_query_equals_its_sql(spark, name):
    assert difference(llm.REGISTRY[name](spark, FOLDER), connect(FOLDER), name) == ""


def test_stages_follow_each_other(spark):
    """Each stage over the rows its predecessor kept, worked out from the operators' own digests."""
    assert corpus_pipeline.ORACLE_SQL is None and len(corpus_pipeline.STAGES) == 5
    table = lambda name: spark.read.parquet(f"{FOLDER}/{name}.parquet")
    docs, labels, benchmark = table("documents"), table("labels"), table("benchmark")
    ids = lambda rows: [r.doc_id for r in rows.collect()]
    only = lambda kept: docs.where(docs.doc_id.isin(kept))
    good = only(ids(quality.score(docs, labels).where("predicted = 1")))
    single = only(ids(exact_dedup.exact_groups(good).where("kept")))
    apart = only(ids(near_dup.near_duplicates(single).where("kept")))
    clean = only(ids(decontaminate.contamination(apart, benchmark).where("not contaminated")))
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as file:
        known = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(file.read()), special_tokens={})
    expected = {r.doc_id: known.encode_ordinary(r.text) for r in clean.collect()}
    assert 0 < len(expected) < apart.count() <= single.count() < good.count() < docs.count()
    found = corpus_pipeline.run(spark, FOLDER).collect()
    assert {r.doc_id: r.ids for r in found} == expected and len(found) == len(expected)
    assert all(r.round_trip and r.n_tokens == len(r.ids) for r in found)
    stage = docs
    for _, function in corpus_pipeline.STAGES[:-1]:
        stage = function(spark, stage, FOLDER)
        assert stage.columns == docs.columns
