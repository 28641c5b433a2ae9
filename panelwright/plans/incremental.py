"""Newest cases and the panel, brought up to date from what changed instead of from every release.

The newest row of every case is a stored table. A new release is merged into it without a look at the releases that
are in it already. A release that was replaced or withdrawn leaves tombstones: the cases whose newest row
was its own; only their rows are looked for in the releases that remain.

The panel is carried over for companies none of whose newest cases changed. The others, on both sides of a case that
moved from one company to another, are rolled up and filled again. Where the last quarter moved on, carried
companies get its rows from their last one."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.functions.calendar import quarter_number
from panelwright.functions.text import has_text, name_table
from panelwright.operators import panel, quality, versions
from panelwright.operators.versions import ORDER
from panelwright.session import cut_lineage
from panelwright.sources import ledger as store

FIELDS = ("CASE_NUMBER", *ORDER, "VISA_CLASS", "CASE_STATUS", "EMPLOYER_NAME", "TOTAL_WORKER_POSITIONS", "DECISION_DATE", "RECEIVED_DATE")
KEYS = ["EMPLOYER_ID", "FISCAL_QUARTER"]


def narrow(raw: DataFrame) -> DataFrame:
    """The fields of a case that panels are made of, keys cleaned; rows without a key are left out."""
    return versions.canonical_cases(raw).select(*FIELDS)


def merge_newest(state: DataFrame | None, fresh: DataFrame | None, gone: list[str], remaining: DataFrame | None) -> DataFrame:
    """Newest row per case of `state` without the releases `gone`, of the rows `fresh`, and of those rows of
    `remaining` whose case lost its newest row. `remaining` is read only if a release is gone."""
    parts = [] if fresh is None else [fresh]
    if state is not None:
        lost = F.col("SOURCE_RELEASE").isin(gone)
        parts.append(state.where(~lost) if gone else state)
        if gone and remaining is not None:
            parts.append(remaining.join(state.where(lost).select("CASE_NUMBER"), "CASE_NUMBER", "left_semi").select(*FIELDS))
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.unionByName(part)
    return versions.latest_version(merged)


def _known(spark: SparkSession, root: str, name: str, beside: str) -> tuple[DataFrame | None, DataFrame | None]:
    """Two outputs that were published together, or nothing if one is missing or of another version."""
    found = {row["name"]: row for row in store.output_ledger(spark, root).where(F.col("name").isin(name, beside)).collect()}
    if len(found) < 2 or found[name]["version"] != found[beside]["version"]:
        return None, None
    return spark.read.parquet(found[name]["path"]), spark.read.parquet(found[beside]["path"])


def newest_cases(spark: SparkSession, root: str, class_value: str) -> DataFrame:
    """The stored newest cases of the current releases, merged from what changed since they were stored.

    Rows of new releases must be as many as the ledger recorded, and their position counts numbers."""
    version = store.input_version(spark, root)
    if store.is_current(spark, root, "newest_cases", version):
        return store.read_output(spark, root, "newest_cases")
    entries = store.release_ledger(spark, root).where("kind = 'main'").select("release", "path", "rows").collect()
    if not entries:
        raise ValueError(f"No main releases stored in {root}")
    state, sources = _known(spark, root, "newest_cases", "newest_sources")
    merged_already = {} if sources is None else {(row.release, row.path): row.unkeyed for row in sources.collect()}
    current = {(row.release, row.path) for row in entries}
    added = [row for row in entries if (row.release, row.path) not in merged_already]
    gone = sorted({release for release, path in merged_already if (release, path) not in current})
    kept = [row.path for row in entries if (row.release, row.path) in merged_already]

    fresh, unkeyed = None, {}
    if added:
        raw = spark.read.parquet(*[row.path for row in added])
        counts = raw.groupBy(F.col("SOURCE_RELEASE").alias("release")).agg(
            F.count("*").alias("rows"), F.count_if(~F.coalesce(has_text(F.col("CASE_NUMBER")), F.lit(False))).alias("unkeyed")
        ).persist()
        recorded = spark.createDataFrame([(row.release, row.rows) for row in added if row.rows], "release string, rows long")
        quality.enforce(quality.count_mismatches(counts.select("release", "rows"), recorded))
        quality.enforce(panel.invalid_values(raw, class_value))
        unkeyed = {row.release: row.unkeyed for row in counts.collect()}  # a row per release
        counts.unpersist()
        fresh = narrow(raw)
    remaining = narrow(spark.read.parquet(*kept)) if gone and kept else None
    parts = [(row.release, row.path, unkeyed.get(row.release, 0)) for row in added]
    parts += [(row.release, row.path, merged_already[row.release, row.path]) for row in entries if (row.release, row.path) in merged_already]
    store.write_output(spark.createDataFrame(parts, "release string, path string, unkeyed long").coalesce(1), root, "newest_sources", version)
    return store.write_output(merge_newest(state, fresh, gone, remaining), root, "newest_cases", version)


def unkeyed_violations(spark: SparkSession, root: str) -> DataFrame:
    """Releases with rows that have no case number."""
    rows = store.read_output(spark, root, "newest_sources").where("unkeyed > 0")
    return rows.select(F.lit("missing_case_number").alias("check"), F.col("release").alias("key"), F.lit("row without case number").alias("detail"))


def changed_names(before: DataFrame, after: DataFrame) -> DataFrame:
    """Company spellings on either side of every case whose newest row is not the same any more. One aggregate
    over both tables, with at most two rows per case."""
    rest = [name for name in FIELDS if name not in ("CASE_NUMBER", *ORDER)]
    both = before.select(*FIELDS, F.lit(0).alias("side")).unionByName(after.select(*FIELDS, F.lit(1).alias("side")))
    content = F.sha2(F.to_json(F.struct(*rest), {"ignoreNullFields": "false"}), 256)
    per_case = both.groupBy("CASE_NUMBER").agg(
        F.min(content).alias("low"), F.max(content).alias("high"), F.count("*").alias("sides"), F.collect_set("EMPLOYER_NAME").alias("names")
    )
    changed = per_case.where("sides = 1 or low <> high")
    return changed.select(F.explode("names").alias("EMPLOYER_NAME")).distinct()


def carry_panel(stored: DataFrame, cases: DataFrame, names: DataFrame, last_before: int, last: int) -> DataFrame:
    """The published panel up to `last`: companies of the spellings `names` are made again from `cases` (all that
    count), all others keep their rows of `stored`, which ends at `last_before`."""
    touched = cut_lineage(name_table(names, "EMPLOYER_NAME").select(F.col("entity_id").alias("EMPLOYER_ID")).distinct())
    spellings = name_table(cases.select("EMPLOYER_NAME"), "EMPLOYER_NAME").select("EMPLOYER_NAME", F.col("entity_id").alias("EMPLOYER_ID"))
    spellings = spellings.join(touched, "EMPLOYER_ID", "left_semi").select("EMPLOYER_NAME")
    counts = cut_lineage(panel.rollup_cases(cases.join(spellings, "EMPLOYER_NAME", "left_semi")))
    made = panel.company_quarters(panel.dense_panel(counts, last=last))
    kept = stored.join(touched, "EMPLOYER_ID", "left_anti")
    if last > last_before:
        ends = kept.withColumn("quarter", quarter_number(F.col("FISCAL_QUARTER"))).where(F.col("quarter") == last_before)
        tail = panel.dense_panel(ends.select("EMPLOYER_ID", "EMPLOYER_NAME", "quarter", *panel.METRICS), last=last)
        kept = kept.unionByName(panel.company_quarters(tail).where(quarter_number(F.col("FISCAL_QUARTER")) > last_before))
    return kept.unionByName(made)


def receipt_panel(spark: SparkSession, root: str, version: str, cases: DataFrame, newest: DataFrame, window: tuple[int, int], eligible) -> DataFrame:
    """The published panel of `cases` (those inside the window), made from the last one where that can be. What the last
    one was made of is published beside it; `eligible` gives the cases that count, before the window."""
    first, last = window
    stored, basis = _known(spark, root, "receipt_panel", "receipt_panel_basis")
    row = None if basis is None else basis.first()
    if row is None or row["first"] != first or row["last"] > last:
        built = panel.company_quarters(panel.dense_panel(cut_lineage(panel.rollup_cases(cases)), last=last))
    else:
        names = changed_names(spark.read.parquet(row["cases_path"]), newest)
        grown = panel.in_window(eligible(newest), row["last"] + 1, last).select("EMPLOYER_NAME") if last > row["last"] else None
        names = names if grown is None else names.union(grown.distinct())
        built = carry_panel(stored, cases, names, row["last"], last)
    return built


def publish_basis(spark: SparkSession, root: str, version: str, window: tuple[int, int]) -> None:
    path = store.output_path(spark, root, "newest_cases")[0]
    basis = spark.createDataFrame([(path, *window)], "cases_path string, first int, last int")
    store.write_output(basis.coalesce(1), root, "receipt_panel_basis", version)
