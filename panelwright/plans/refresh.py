"""Landed releases to panel, examples and models; each step is skipped while its inputs stand."""

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.functions.calendar import label_number, number_label, quarter_label, quarter_number
from panelwright.operators import backtest, cumulative, evaluate, features, links, model, panel, profile, quality, versions
from panelwright.plans import incremental
from panelwright.session import clear_scratch, cut_lineage
from panelwright.sources import ledger as store
from panelwright.sources import releases as landed

CLASS = "H-1B"
MIN_QUARTERS = 5
MAIN_AUDIT = ("release_quality", "release_values", "cross_release_duplicates", "release_overlaps")
LINK_AUDIT = (
    "worksite_links", "worksite_orphans", "worksite_other_year", "worksite_locations", "multi_worksite_cases", "case_links_by_year",
    "global_case_links",
)


def ingest(spark: SparkSession, landing: str, root: str, force: bool = False, with_worksites: bool = False) -> list[str]:
    """Store new and changed releases of the kinds asked for; returns their labels. What is pending is
    decided by name, size and time; gates run before anything is written."""
    files = landed.landed_files(spark, landing)
    catalog = landed.release_catalog(files, with_worksites).persist()
    quality.enforce(landed.catalog_violations(files, catalog))
    known = store.release_ledger(spark, root).where(F.col("kind").isin(landed.kinds(with_worksites))).persist()
    if not catalog.take(1):
        raise FileNotFoundError(f"No releases landed in {landing}")
    # One row per release: metadata, never the releases' data.
    pending = catalog if force else store.pending_releases(catalog, known)
    entries = [row.asDict() for row in pending.orderBy("release", "kind").collect()]
    frames = []
    for entry in entries:
        path = f"{landing.rstrip('/')}/{entry['name']}"
        frames.append(landed.read_release(spark, path, entry["release"], entry["kind"]))
        quality.enforce(landed.surplus_cells(spark, path))
    for entry, frame in zip(entries, frames):
        store.store_release(frame, root, entry)
    for row in store.withdrawn_releases(catalog, known).collect():
        store.withdraw_release(spark, root, row["release"], row["kind"])
    catalog.unpersist()
    known.unpersist()
    return [entry["release"] for entry in entries]


def audit(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """Quality of the stored releases and, where worksites are stored, their links; read back where the
    stored releases are those of the last audit."""
    version = store.input_version(spark, root, "main", "worksites")
    known = {row["name"]: row["path"] for row in store.output_ledger(spark, root).where(F.col("version") == version).collect()}
    if set(MAIN_AUDIT) <= set(known):
        return {name: spark.read.parquet(known[name]) for name in (*MAIN_AUDIT, *LINK_AUDIT) if name in known}
    main = store.read_releases(spark, root)
    tables = {
        "release_quality": profile.release_quality(main),
        "release_values": profile.release_value_maps(main),
        "cross_release_duplicates": versions.cross_release_duplicates(main),
        "release_overlaps": versions.release_overlaps(main),
    }
    if store.release_ledger(spark, root).where("kind = 'worksites'").take(1):
        sites = store.read_releases(spark, root, "worksites")
        tables |= {
            "worksite_links": links.same_year_links(sites, main),
            "worksite_orphans": links.orphans(sites, main),
            "worksite_other_year": links.linked_elsewhere(sites, main),
            "worksite_locations": links.location_match(links.link_children(sites, main)),
            "multi_worksite_cases": links.multi_child_keys(sites),
            "case_links_by_year": links.case_links_by_year(sites, main),
            "global_case_links": links.global_case_links(sites, main),
        }
    # Links first: the tables of the main releases tell that the audit is complete.
    tables = dict(sorted(tables.items(), key=lambda item: item[0] in MAIN_AUDIT))
    return {name: store.write_output(table, root, name, version) for name, table in tables.items()}


def remove_expired(spark: SparkSession, root: str, older_than: float = 7 * 24 * 3600.0) -> list[str]:
    """Remove what was replaced ``older_than`` seconds ago or more; the cases that the current panel was made of stay."""
    basis = store.output_ledger(spark, root).where("name = 'receipt_panel_basis'").first()
    keep = [] if basis is None else [row["cases_path"] for row in spark.read.parquet(basis["path"]).collect()]
    return store.remove_expired(spark, root, older_than, keep)


def stored_cases(spark: SparkSession, root: str) -> DataFrame:
    """All stored main rows, once their counts agree with the ledger and every position is a number."""
    raw = store.read_releases(spark, root)
    counts = raw.groupBy(F.col("SOURCE_RELEASE").alias("release")).agg(F.count("*").alias("rows"))
    recorded = store.release_ledger(spark, root).where("kind = 'main' and rows > 0").select("release", "rows")
    quality.enforce(quality.count_mismatches(counts, recorded))
    quality.enforce(panel.invalid_values(raw, CLASS))
    return raw


def release_window(spark: SparkSession, root: str) -> tuple[int, int]:
    """First and last stored release as quarter indices."""
    row = store.release_ledger(spark, root).where("kind = 'main'").agg(F.min("release"), F.max("release")).first()
    if row[0] is None:
        raise ValueError(f"No main releases stored in {root}")
    return label_number(row[0]), label_number(row[1])


def with_quarter(labeled: DataFrame) -> DataFrame:
    return labeled.withColumn("quarter", quarter_number(F.col("FISCAL_QUARTER")))


def decision_panel(spark: SparkSession, root: str) -> DataFrame:
    """Company activity by decision date, up to the last quarter any case was decided in."""
    version = store.input_version(spark, root)
    if store.is_current(spark, root, "company_activity", version):
        return store.read_output(spark, root, "company_activity")
    raw = stored_cases(spark, root)
    cases = panel.eligible_cases(cut_lineage(panel.latest_cases(raw, "DECISION_DATE")), CLASS)
    built = panel.company_quarters(panel.dense_panel(cut_lineage(panel.rollup_cases(cases))))

    def publish_quality(stored: DataFrame) -> None:
        # A company's first quarter is the one without a change.
        totals = {
            "companies": F.count_if(F.col("CHANGE_FROM_PREVIOUS_QUARTER").isNull()), "company_quarter_rows": F.count("*"),
            "latest_quarter": F.max("FISCAL_QUARTER"),
        }
        found = profile.case_quality(raw, CLASS).withColumns({name: stored.agg(total).scalar() for name, total in totals.items()})
        store.write_output(found, root, "company_activity_quality", version)

    return store.write_output(built, root, "company_activity", version, incremental.KEYS, publish_quality)


def receipt_panel(spark: SparkSession, root: str) -> DataFrame:
    """The modelling panel by receipt date over the stored releases' quarters, gates included."""
    version = store.input_version(spark, root)
    if store.is_current(spark, root, "receipt_panel", version):
        return with_quarter(store.read_output(spark, root, "receipt_panel"))
    first, last = release_window(spark, root)
    if last - first + 1 < MIN_QUARTERS:
        raise ValueError(f"Need at least {MIN_QUARTERS} quarters of releases")
    newest = incremental.newest_cases(spark, root, CLASS)
    quality.enforce(incremental.unkeyed_violations(spark, root))

    def typed(rows: DataFrame) -> DataFrame:
        return panel.typed_cases(panel.with_case_date(rows, "RECEIVED_DATE"))

    def eligible(rows: DataFrame) -> DataFrame:
        return panel.eligible_cases(typed(rows), CLASS)

    quality.enforce(quality.undated_cases(typed(newest), CLASS))
    cases = panel.in_window(eligible(newest), first, last)
    totals = profile.period_totals(cases)
    quality.enforce(profile.empty_period_violations(totals, first, last))
    built = incremental.receipt_panel(spark, root, version, cases, newest, (first, last), eligible)

    def matches_source(stored: DataFrame) -> None:
        quality.enforce(profile.check_totals(with_quarter(stored), totals))

    outside = panel.outside_window(eligible(newest), first, last)
    store.write_output(outside, root, "excluded_cases", version)
    stored = store.write_output(built, root, "receipt_panel", version, incremental.KEYS, matches_source)
    incremental.publish_basis(spark, root, version, (first, last))
    return with_quarter(stored)


def model_version(spark: SparkSession, root: str) -> str:
    """Version of examples and models: the stored releases and the list of features."""
    return f"{store.input_version(spark, root)}-{hashlib.sha256(','.join(features.FEATURES).encode()).hexdigest()[:12]}"


def examples(spark: SparkSession, root: str) -> DataFrame:
    version = model_version(spark, root)
    if store.is_current(spark, root, "examples", version):
        return store.read_output(spark, root, "examples")
    built = receipt_panel(spark, root)
    quality.enforce(quality.panel_violations(built))
    return store.write_output(features.build_examples(built), root, "examples", version, ["EMPLOYER_ID", "origin"])


def source_profile(spark: SparkSession, root: str, date_column: str = "RECEIVED_DATE") -> dict[str, DataFrame]:
    """Revisions, coverage, dates and distributions of the stored source, window totals included."""
    raw = store.read_releases(spark, root)
    first, last = release_window(spark, root)
    cases = versions.canonical_cases(raw)
    columns = ["CASE_STATUS", "DECISION_DATE", "RECEIVED_DATE", "EMPLOYER_NAME", "TOTAL_WORKER_POSITIONS"]
    latest = cut_lineage(profile.latest_class_rows(raw, columns, CLASS))
    positions = latest.withColumn("positions", F.col("TOTAL_WORKER_POSITIONS").try_cast("long"))
    dated = panel.with_case_date(positions, date_column)
    counted = panel.in_window(panel.eligible_cases(dated, CLASS), first, last)
    return {
        "missing_keys": versions.missing_keys(raw),
        "revisions": versions.revision_counts(cases, versions.source_chunk()),
        "coverage": profile.coverage(panel.with_case_date(cases, date_column), CLASS),
        "offsets": versions.release_offsets(cases, date_column, CLASS),
        "statuses": profile.value_counts(latest, "CASE_STATUS", empty_is_missing=False),
        "dates": profile.date_checks(latest),
        "elapsed": cumulative.distribution(profile.with_elapsed(latest), "elapsed_days"),
        "positions": cumulative.distribution(positions, "positions"),
        "totals": profile.period_totals(counted),
    }


def company_profile(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    rows = receipt_panel(spark, root)
    return {
        "summary": profile.panel_summary(rows),
        "quarters": profile.quarter_table(rows),
        "first_four": profile.first_n_activity(rows),
        "outcomes": profile.next_quarter_outcomes(rows),
    }


def write_profile(spark: SparkSession, root: str, folder: str) -> None:
    """The profile as files: quarters and coverage as CSV, everything else as JSON."""
    companies, source = company_profile(spark, root), source_profile(spark, root)
    labeled = {"quarter": quarter_label(F.col("quarter"))}
    quarters = companies.pop("quarters").withColumns(labeled).orderBy("quarter")
    store.write_csv(quarters, f"{folder}/quarters", digits=2)
    covered = source.pop("coverage").withColumns(labeled).orderBy("SOURCE_RELEASE", "quarter")
    store.write_csv(covered, f"{folder}/source_coverage")
    for name, table in (companies | source).items():
        store.write_json(table, f"{folder}/{name}")


def train(spark: SparkSession, root: str, candidates: dict | None = None) -> model.Selection:
    """Models for the stored inputs, published with the version they were trained on."""
    version = model_version(spark, root)
    if store.is_current(spark, root, "models", version):
        return model.load(spark, store.output_path(spark, root, "models")[0])[0]
    _, last = release_window(spark, root)
    selection, fitted = model.train(examples(spark, root), last, candidates, version)
    path, seq = store.publish_path(spark, root, "models")
    model.save(selection, fitted, path, spark)
    store.publish(spark, root, "models", version, path, seq)
    return selection


def _current_models(spark: SparkSession, root: str):
    path, version = store.output_path(spark, root, "models")
    current = model_version(spark, root)
    if version != current or not store.is_current(spark, root, "examples", current):
        raise ValueError("Stored data changed since training; rebuild inputs and retrain")
    return model.load(spark, path)


def backtest_models(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """The backtest of the current models, published with their version: predictions, metrics, reliability, and
    the audit of the saved trends, which raises if one moves a probability the wrong way."""
    selection, fitted = _current_models(spark, root)
    rows, version = store.read_output(spark, root, "examples"), selection.version
    methods = [*selection.parameters, *evaluate.BASELINES]
    found = store.write_output(backtest.backtest(rows, selection), root, "backtest_predictions", version)
    long = evaluate.by_model(found.select("target_active", *methods), methods)

    def holds(audit: DataFrame) -> None:
        wrong = audit.where("violations > 0 or comparisons = 0")
        quality.enforce(wrong.select(F.lit("trend_violated").alias("check"), F.col("feature").alias("key"), F.col("violations").cast("string").alias("detail")))

    audit = backtest.monotonicity_audit(fitted["boosted"], rows.where(F.col("origin") == selection.trained_through).where("horizon = 1"), selection)
    return {
        "predictions": found,
        "metrics": store.write_output(backtest.backtest_metrics(found, methods), root, "backtest_metrics", version),
        "reliability": store.write_output(evaluate.reliability(long, by=["model"]), root, "backtest_reliability", version),
        "trends": store.write_output(audit, root, "trend_audit", version, check=holds),
    }


def predictions(spark: SparkSession, root: str, method: str = "boosted") -> DataFrame:
    """Next-quarter probabilities of all companies with enough history."""
    selection, fitted = _current_models(spark, root)
    return model.predict(store.read_output(spark, root, "examples"), selection, fitted[method], method)


def predict_company(spark: SparkSession, root: str, company: str, method: str = "boosted") -> tuple[DataFrame, DataFrame]:
    """One company's history and next-quarter probability; errors say what is missing."""
    history = panel.lookup(receipt_panel(spark, root), company)
    if not history.take(1):
        raise ValueError(f"No {CLASS} records found for {company}")
    found = panel.lookup_id(predictions(spark, root, method), company)
    if not found.take(1):
        raise ValueError(f"{company} has fewer than four quarters of history")
    labeled = {name: quarter_label(F.col(name)) for name in ("origin", "target_quarter")}
    return history, found.withColumns(labeled)


def refresh(
    spark: SparkSession, landing: str, root: str, candidates: dict | None = None, with_worksites: bool = False
) -> dict[str, str]:
    """Ingest what landed, report its quality and links, rebuild what depends on it, retrain."""
    ingest(spark, landing, root, with_worksites=with_worksites)
    audit(spark, root)
    train(spark, root, candidates)
    last = release_window(spark, root)[1]
    clear_scratch(spark)  # everything that stays is published
    return {"trained_through": number_label(last), "target_quarter": number_label(last + 1)}
