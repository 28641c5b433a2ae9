"""Exact deduplication by a tree merge of sorted digest runs.

Every partition turns its rows into runs (one for each 200,000 rows): digests in order, each with the identifier
that stays and the rows it stands for. Runs then move in binomial rounds: in a round, partitions whose numbers differ in
one digit exchange the parts of their runs whose digests carry the other's digit, and each merges what
it receives. After the last round every digest lies in one partition. A text with a third of all rows is
one entry of each run at every level, so no partition meets its copies.

Digests are verified by the byte length and a second, independent hash of the text at every level;
entries that differ in either are different texts.

Defined cases: null text is empty; the row with the largest doc_id stays, a null doc_id only if the
group has no other; rows that repeat both doc_id and text share their fate in `exact_groups`, and one of
them stays in `keep_one`; extra columns are not read.
"""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.llm.words import releasing, struct_of
from panelwright.session import cut_lineage

FAN_IN = 8  # runs merged at a time
RUN = "place int, digest binary, n_bytes long, second long, keep_id long, ties long, size long"
KEYS = ["digest", "n_bytes", "second"]
RUN_ROWS = 200_000  # rows of a run as it is built, and rows merged at a time later


def _merged(table: pa.Table) -> pa.Table:
    """Sorted by digest, one entry for each verified text: largest identifier, rows that bear it, rows."""
    table = table.sort_by([(key, "ascending") for key in KEYS] + [("keep_id", "descending")])
    rows = table.num_rows
    same = np.ones(rows - 1, dtype=bool)
    for key in KEYS:
        column = table[key].combine_chunks()
        same &= pc.equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False)
    first = np.concatenate(([0], np.flatnonzero(~same) + 1))
    group = np.cumsum(np.concatenate(([0], ~same)))
    ids = table["keep_id"].combine_chunks()
    kept = ids.take(pa.array(first))
    best = kept.take(pa.array(group))
    equal = pc.or_(pc.fill_null(pc.equal(ids, best), False), pc.and_(ids.is_null(), best.is_null()))
    ties = np.where(equal.to_numpy(zero_copy_only=False), table["ties"].to_numpy(), 0)
    columns = {name: table[name].combine_chunks().take(pa.array(first)) for name in ("place", *KEYS)}
    return pa.table(columns | {
        "keep_id": kept,
        "ties": np.add.reduceat(ties, first),
        "size": np.add.reduceat(table["size"].to_numpy(), first),
    })


def _as_table(batch: pa.RecordBatch) -> pa.Table:
    """By names alone: Spark marks columns that are never null, Arrow joins tables of one schema only, and merged ones have no marks."""
    return pa.Table.from_arrays(batch.columns, names=batch.schema.names)


def _build_runs(batches):
    """One task's rows as runs of RUN_ROWS at most and a batch, so that its memory does not follow the partition's size."""
    held: list[pa.Table] = []
    rows = 0
    for batch in batches:
        held.append(_as_table(batch))
        rows += batch.num_rows
        if rows >= RUN_ROWS:
            yield from _by_place(held).to_batches(max_chunksize=10_000)
            held, rows = [], 0
    if rows:
        yield from _by_place(held).to_batches(max_chunksize=10_000)


def _merge_runs(batches):
    """One task's runs, merged by partition number and digest."""
    held: list[pa.Table] = []
    rows = 0
    for batch in batches:
        held.append(_as_table(batch))
        rows += batch.num_rows
        if len(held) > 1 and rows > 2 * held[0].num_rows + RUN_ROWS:
            held = [_by_place(held)]
            rows = held[0].num_rows
    if rows:
        yield from _by_place(held).to_batches(max_chunksize=10_000)


def _by_place(tables: list[pa.Table]) -> pa.Table:
    table = pa.concat_tables(tables)
    places = table["place"].unique().to_pylist()
    return pa.concat_tables([_merged(table.filter(pc.equal(table["place"], place))) for place in sorted(places)])


def digests(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id with digest, length and second hash of each whole text, as a stored table."""
    text = F.coalesce(F.col(text_column), F.lit(""))
    return cut_lineage(docs.select(
        F.col(id_column).cast("long").alias("doc_id"), F.unhex(F.sha2(text, 256)).alias("digest"),
        F.octet_length(text).cast("long").alias("n_bytes"), F.xxhash64(text).alias("second"),
    ))


def merge_tree(rows: DataFrame) -> DataFrame:
    """One entry per distinct text of `rows` (as `digests` gives them), with keep_id, ties and size."""
    # The digest's first bytes, as digits, name the partition that holds it after the last round.
    wanted, rounds = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1
    while FAN_IN**rounds < wanted:
        rounds += 1
    places = F.lit(FAN_IN**rounds)
    target = F.pmod(F.conv(F.hex(F.substring("digest", 1, 4)), 16, 10).cast("long"), places).cast("int")
    runs = rows.select(
        F.pmod(F.spark_partition_id(), places).alias("place"), *KEYS,
        F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("ties"), F.lit(1).cast("long").alias("size"),
    ).mapInArrow(releasing(_build_runs), struct_of(RUN))
    for round_number in range(rounds):
        unit = FAN_IN**round_number
        digit = lambda value, unit=unit: F.floor(value / unit) % FAN_IN
        moved = (F.col("place") + (digit(target) - digit(F.col("place"))) * unit).cast("int")
        runs = runs.withColumn("place", moved).repartition("place").mapInArrow(releasing(_merge_runs), struct_of(RUN))
    return cut_lineage(runs.drop("place"))


def exact_groups(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 for every row, and `ties`: the rows of the
    group that bear keep_id."""
    rows = digests(docs, id_column, text_column)
    return rows.join(merge_tree(rows), KEYS).select(
        "doc_id", "keep_id", F.col("size").alias("group_size"),
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"), "ties",
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each group of equal texts; the columns of `docs`, whatever their names."""
    kept = exact_groups(docs).where("kept").groupBy(F.col("doc_id").alias("kept_id"), F.col("text_sha256").alias("kept_sha")).agg((F.max("ties") > 1).alias("tied"))
    rows = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), F.sha2(F.coalesce(docs["text"], F.lit("")), 256).alias("sha"))
    rows = rows.join(kept, F.col("row.doc_id").eqNullSafe(F.col("kept_id")) & (F.col("sha") == F.col("kept_sha")))
    tied = rows.where("tied").dropDuplicates(["kept_id", "kept_sha"])
    return rows.where("not tied").union(tied).select("row.*")
