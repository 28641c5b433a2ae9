"""A training corpus from the documents table: five stages, each over all its predecessor kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again
as the next stage's documents. The first four return the columns of documents; the last one returns
doc_id, the token ids and whether decoding them gives the text back."""

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

from panelwright.llm import bpe, decontaminate, exact_dedup, near_dup, quality
from panelwright.session import scratch_dir

# SQL cannot express the classifier, the signatures or the encoder.
ORACLE_SQL = None


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def keep_good(spark, docs, sf_dir):
    return quality.keep_good(docs, _table(spark, sf_dir, "labels"))


def drop_exact_copies(spark, docs, sf_dir):
    return exact_dedup.keep_one(docs)


def drop_near_copies(spark, docs, sf_dir):
    return near_dup.keep_one(docs)


def drop_contaminated(spark, docs, sf_dir):
    return decontaminate.clean(docs, _table(spark, sf_dir, "benchmark"))


def encode(spark, docs, sf_dir):
    return bpe.encode_checked(docs)


STAGES = [
    ("quality_classifier", keep_good),
    ("exact_dedup", drop_exact_copies),
    ("minhash_near_dedup", drop_near_copies),
    ("benchmark_decontamination", drop_contaminated),
    ("byte_level_bpe", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    folder = f"{scratch_dir(spark)}/pipeline-{uuid4().hex}"
    for name, stage in STAGES:
        path = f"{folder}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
