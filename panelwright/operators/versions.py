"""Versioned records: the newest or first row of a key, revisions between versions, overlaps.

A key may repeat without limit, so nothing here brings a key's rows together in one task: picks are
map-side aggregates, and revisions are compared inside chunks of a key and then across chunk edges."""

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwright.functions.calendar import date_of, fiscal_quarter_index, quarter_number
from panelwright.functions.text import case_key, has_text, strip, text_differs

ORDER = ("SOURCE_RELEASE", "SOURCE_ROW_NUMBER")
SALTS = 8  # shares of a key's rows that are looked up apart
# The compared fields of a case, in landed order.
COMPARED = (
    "VISA_CLASS", "EMPLOYER_NAME", "CASE_STATUS", "DECISION_DATE", "RECEIVED_DATE",
    "TOTAL_WORKER_POSITIONS",
)


def canonical_cases(raw: DataFrame) -> DataFrame:
    """Clean keys, classes and statuses; rows without a case number are left out."""
    cleaned = {
        "CASE_NUMBER": case_key(F.col("CASE_NUMBER")),
        "VISA_CLASS": case_key(F.col("VISA_CLASS")),
        "CASE_STATUS": strip(F.col("CASE_STATUS")),
    }
    return drop_missing_keys(raw).withColumns(
        {name: value for name, value in cleaned.items() if name in raw.columns}
    )


def drop_missing_keys(df: DataFrame, key: str = "CASE_NUMBER") -> DataFrame:
    return df.where(has_text(F.col(key)))


def missing_keys(df: DataFrame, key: str = "CASE_NUMBER") -> DataFrame:
    return df.agg(F.count_if(~has_text(F.col(key))).alias("rows_without_case_number"))


def _pick(df: DataFrame, keys: Sequence[str], order_by: Sequence[str], pick: Callable) -> DataFrame:
    """One row per key by the smallest or largest order. The order leads the compared struct, so it
    travels once, and rows tied on it are told apart by their other columns: same pick on every run."""
    rest = [name for name in df.columns if name not in keys and name not in order_by]
    picked = df.groupBy(*keys).agg(pick(F.struct(*order_by, *rest)).alias("picked"))
    return picked.select(*keys, "picked.*").select(*df.columns)


def latest_version(df: DataFrame, keys: Sequence[str] = ("CASE_NUMBER",), order_by: Sequence[str] = ORDER) -> DataFrame:
    """The last row of each key; it replaces every field, so filter by class afterwards."""
    return _pick(df, keys, order_by, F.max)


def first_version(df: DataFrame, keys: Sequence[str] = ("CASE_NUMBER",), order_by: Sequence[str] = ORDER) -> DataFrame:
    return _pick(df, keys, order_by, F.min)


def source_chunk(rows: int = 1_000_000) -> list[Column]:
    """Chunk columns for landed tables: a release's row numbers are unique, so no chunk of a key
    holds more than ``rows`` rows."""
    return [F.col("SOURCE_RELEASE"), F.floor(F.col("SOURCE_ROW_NUMBER") / rows)]


def _of_repeated_keys(df: DataFrame, key: str, keys: DataFrame, order_by: Sequence[str]) -> DataFrame:
    """Rows whose key occurs more than once in ``keys``. The salt spreads a hot key's rows over tasks,
    and what follows is not bound to the join's partitions, so that adaptive splitting may cut them too."""
    counted = keys.groupBy(F.col(key).alias("repeated")).agg(F.count("*").alias("versions")).where("versions > 1")
    salted = counted.select("repeated", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("part"))
    part = F.pmod(F.xxhash64(*order_by), F.lit(SALTS)).cast("int")
    return df.join(salted, F.col(key).eqNullSafe(F.col("repeated")) & (part == F.col("part")), "left_semi")


def revision_counts(
    df: DataFrame,
    chunk: Sequence[Column],
    key: str = "CASE_NUMBER",
    order_by: Sequence[str] = ORDER,
    fields: Sequence[str] = COMPARED,
    class_column: str = "VISA_CLASS",
    class_value: str = "H-1B",
    date_column: str = "DECISION_DATE",
    unique_order: bool = True,
    levels: Sequence[int] = (),
    keys: DataFrame | None = None,
) -> DataFrame:
    """How often a key's next version differs from the one before, in total and per field.

    ``chunk`` must follow ``order_by``: its columns split a key's rows into consecutive runs that
    each fit a task. Runs then meet at their edges: first inside each shorter prefix of the chunk
    columns named by ``levels``, at last inside the key, so that no step sees too many of them.
    Where the order may tie, exact copies are counted before anything is sorted.

    A key with one row has no revision, so only rows of repeated keys are compared. ``keys`` may name
    a narrower source of the same keys to count them in."""
    df = _of_repeated_keys(df, key, df if keys is None else keys, order_by)
    compared = [name for name in fields if name in df.columns]
    rows = df.withColumn("copies", F.lit(1))
    if not unique_order:
        kept = dict.fromkeys([key, *order_by, *compared, date_column])
        rows = df.groupBy(*kept).agg(F.count("*").alias("copies"))
    quarter = fiscal_quarter_index(date_of(df, date_column))
    rows = rows.select(
        F.col(key).alias("key"),
        *[part.alias(f"chunk{i}") for i, part in enumerate(chunk)],
        F.struct(*order_by).alias("order"),
        F.struct(*[F.col(name) for name in compared], quarter.alias("quarter")).alias("now"),
        "copies",
    )

    def differences(now: Column, before: Column) -> dict[str, Column]:
        known = before.isNotNull()
        changed = {name: known & text_differs(now[name], before[name]) for name in compared}
        any_change = F.lit(False)
        for flag in changed.values():
            any_change = any_change | flag
        return {
            "changed_rows": any_change,
            "h1b_changed_rows": any_change & F.coalesce(now[class_column] == class_value, F.lit(False)),
            "decision_quarter_changed_rows": known & ~now["quarter"].eqNullSafe(before["quarter"]),
            **{f"{name.lower()}_changed_rows": flag for name, flag in changed.items()},
        }

    def totals(now: Column, before: Column) -> dict[str, Column]:
        return {name: F.sum(flag.cast("long")) for name, flag in differences(now, before).items()}

    def runs_of(edges: DataFrame, parts: Sequence[str], order: Column, head: str, tail: str) -> DataFrame:
        """One row per (key, parts): its ends and what changed inside."""
        changes = totals(F.col(head), F.col("before"))
        inner = {name: F.sum(name) + total if name in edges.columns else total for name, total in changes.items()}
        return edges.groupBy("key", *parts).agg(
            F.sum("copies").alias("copies"),
            F.min_by(head, order).alias("head"),
            F.max_by(tail, order).alias("tail"),
            *[total.alias(name) for name, total in inner.items()],
        )

    parts = [f"chunk{i}" for i in range(len(chunk))]
    inside = Window.partitionBy("key", *parts).orderBy("order")
    runs = runs_of(rows.withColumn("before", F.lag("now").over(inside)), parts, F.col("order"), "now", "now")
    for width in levels:
        kept, order = parts[:width], F.struct(*parts[width:])
        along = Window.partitionBy("key", *kept).orderBy(*parts[width:])
        runs = runs_of(runs.withColumn("before", F.lag("tail").over(along)), kept, order, "head", "tail")
        parts = kept
    across = Window.partitionBy("key").orderBy(*parts)
    edges = runs.withColumns(
        {"before": F.lag("tail").over(across), "starts": F.row_number().over(across)}
    )
    at_edge = totals(F.col("head"), F.col("before"))
    repeats = F.sum(F.col("copies") - (F.col("starts") == 1).cast("long"))
    return edges.agg(
        F.coalesce(repeats, F.lit(0)).alias("repeated_rows"),
        *[
            F.coalesce(F.sum(name) + total, F.lit(0)).alias(name)
            for name, total in at_edge.items()
        ],
    )


def cross_release_duplicates(df: DataFrame, key: str = "CASE_NUMBER", release: str = "SOURCE_RELEASE") -> DataFrame:
    """Keys found in several releases and their extra occurrences."""
    per_key = df.where(F.col(key).isNotNull() & (F.col(key) != "")).groupBy(key).agg(
        F.count_distinct(release).alias("releases")
    )
    return per_key.where("releases > 1").agg(
        F.count("*").alias("case_numbers_in_multiple_releases"),
        F.coalesce(F.sum(F.col("releases") - 1), F.lit(0)).alias("extra_case_occurrences_across_releases"),
    )


def release_overlaps(df: DataFrame, release: str = "SOURCE_RELEASE", key: str = "CASE_NUMBER") -> DataFrame:
    """Shared keys of each pair of releases, non-zero pairs only.

    Keys are first counted by the set of releases they occur in; only the distinct sets, which are
    as wide as the number of releases at most, are unfolded into pairs."""
    sets = (
        df.where(F.col(key).isNotNull())
        .groupBy(key)
        .agg(F.array_sort(F.collect_set(release)).alias("releases"))
        .where(F.size("releases") > 1)
        .groupBy("releases")
        .agg(F.count("*").alias("keys"))
    )
    left = sets.select("releases", "keys", F.posexplode("releases").alias("at", "left"))
    pairs = left.select("keys", "left", F.explode(F.expr("slice(releases, at + 2, size(releases))")).alias("right"))
    return pairs.groupBy("left", "right").agg(F.sum("keys").alias("shared_case_numbers"))


def release_offsets(df: DataFrame, date_column: str, class_value: str, key: str = "CASE_NUMBER", order_by: Sequence[str] = ORDER) -> DataFrame:
    """Quarters between a first version's release and its case date."""
    needed = df.select(key, *order_by, "VISA_CLASS", date_column)
    first = first_version(needed, [key], order_by).where(F.col("VISA_CLASS") == class_value)
    offset = quarter_number(F.col("SOURCE_RELEASE")) - fiscal_quarter_index(date_of(first, date_column))
    offsets = first.select(offset.cast("long").alias("quarter_offset")).where("quarter_offset is not null")
    return offsets.groupBy("quarter_offset").agg(F.count("*").alias("cases"))
