"""Running totals over an ordered value without one task seeing all values, and what rests on them:
exact quantiles here, ranking metrics in ``evaluate``."""

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwright.session import cut_lineage

CHUNKS = 256
# The reported points of a distribution.
QUANTILES = {"min": 0.0, "median": 0.5, "p90": 0.9, "p99": 0.99, "max": 1.0}


def value_chunks(df: DataFrame, value: str, chunks: int = CHUNKS) -> DataFrame:
    """Add ``chunk``: near-equal consecutive ranges of ``value``, split at approximate quantiles.

    The at most ``chunks`` split points are fitted once and become constants, so every later use of
    the column sees the same ranges. Without values there is one empty range."""
    points = df.approxQuantile(value, [i / chunks for i in range(1, chunks)], 0.25 / chunks)
    if not points:
        return df.withColumn("chunk", F.lit(0.0))
    splits = [float("-inf"), *sorted(set(points)), float("inf")]
    return Bucketizer(splits=splits, inputCol=value, outputCol="chunk").transform(df)


def running_totals(df: DataFrame, by: Sequence[str], value: str, sums: Sequence[str], descending: bool = False) -> DataFrame:
    """Add ``running_<name>`` for each of ``sums``: the total up to and including ``value``.

    ``df`` holds one row per (by, value) and a ``chunk`` from ``value_chunks``. Each chunk is summed
    in its own task; the chunk totals, at most ``CHUNKS`` per group, carry the offsets across."""

    def along(name: str) -> Column:
        return F.col(name).desc() if descending else F.col(name)

    inside = Window.partitionBy(*by, "chunk").orderBy(along(value)).rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(*by).orderBy(along("chunk")).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        df.groupBy(*by, "chunk")
        .agg(*[F.sum(name).alias(name) for name in sums])
        .select(*by, "chunk", *[F.coalesce(F.sum(name).over(earlier), F.lit(0)).alias(f"before_{name}") for name in sums])
    )
    summed = df.withColumns({f"within_{name}": F.sum(name).over(inside) for name in sums})
    joined = summed.join(offsets, [*by, "chunk"])
    return joined.select(
        *df.columns,
        *[(F.col(f"within_{name}") + F.col(f"before_{name}")).alias(f"running_{name}") for name in sums],
    )


def distribution(df: DataFrame, value: str) -> DataFrame:
    """Exact mean, min, median, p90, p99 and max (linear interpolation) of a numeric column."""
    counts = df.where(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("value")).agg(
        F.count("*").alias("rows")
    )
    # Distinct values only; read several times below.
    counts = cut_lineage(counts)
    running = running_totals(value_chunks(counts, "value"), [], "value", ["rows"])
    weight = F.sum(F.col("value") * F.col("rows"))
    totals = counts.agg(F.struct(F.sum("rows").alias("rows"), weight.alias("weight"))).scalar()
    ranked = running.withColumns({"total": totals["rows"], "weight": totals["weight"]})

    def at_rank(rank: Column) -> Column:
        return F.min(F.when(F.col("running_rows") > rank, F.col("value")))

    picks = [F.max(F.col("weight") / F.col("total")).alias("mean")]
    for name, q in QUANTILES.items():
        place = (F.col("total") - 1) * F.lit(q)
        picks += [
            at_rank(F.floor(place)).alias(f"{name}_low"),
            at_rank(F.ceil(place)).alias(f"{name}_high"),
            F.max(place - F.floor(place)).alias(f"{name}_part"),
        ]
    row = ranked.agg(*picks)
    return row.select(
        "mean",
        *[
            (F.col(f"{name}_low") + (F.col(f"{name}_high") - F.col(f"{name}_low")) * F.col(f"{name}_part")).alias(name)
            for name in QUANTILES
        ],
    )
