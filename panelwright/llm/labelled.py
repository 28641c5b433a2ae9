"""Rows that a classifier may learn from."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLE = 20_000  # labelled documents a classifier learns from, chosen by a hash of doc_id


def held_out(doc_id, modulus: int, remainder: int) -> Column:
    """Rows kept away from learning: crc32 of doc_id as text; a null doc_id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % modulus == remainder, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, target: str, modulus: int, remainder: int, size: int = SAMPLE) -> DataFrame:
    """(doc_id, text, label) of at most `size` labelled documents outside the held-out part. A document
    with contradicting labels counts by its larger one; a repeated doc_id gives one row."""
    usable = labels.where(F.col(target).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out("doc_id", modulus, remainder))
    chosen = (
        usable.groupBy("doc_id").agg(F.max(target).alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(size).withColumnRenamed("doc_id", "_labelled")
    )
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    joined = texts.join(F.broadcast(chosen), F.col("doc_id") == F.col("_labelled"))  # at most `size` rows
    return joined.groupBy("doc_id").agg(F.min(F.struct("text", "label")).alias("row")).select("doc_id", "row.text", "row.label")
