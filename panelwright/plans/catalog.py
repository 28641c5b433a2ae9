"""Registered queries: every operator over the whole order tables."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.functions.calendar import (
    fiscal_quarter_index, iso_date, label_number, quarter_label, quarter_number,
)
from panelwright.functions.numeric import log_odds
from panelwright.functions.text import location, name_table
from panelwright.operators import cumulative, evaluate, features, links, panel, profile, quality, versions
from panelwright.session import cut_lineage
from panelwright.sources import orders as src
from panelwright.sources.releases import standardize
from panelwright.sources.schema import TableSpec, validate_headers

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}

# An inner window of the calendar of the order tables; the filters by it are the features.
INNER_FIRST, INNER_LAST = label_number("FY1996_Q1"), label_number("FY2000_Q4")
# Quarters before the last one at which the rolling splits stand, and the one that is evaluated.
SPLITS_BACK, EVALUATED_BACK = (10, 8, 6, 4, 2), 2
SINCE = "1998-01-01"
COMPANY = "  customer#000000007 "


def query(function: Query) -> Query:
    REGISTRY[function.__name__] = function
    return function


# Calendar, text, landing ---------------------------------------------------------------------


@query
def fiscal_quarter(spark, folder):
    day = src.table(spark, folder, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("day"))
    index = fiscal_quarter_index(F.col("day"))
    labeled = day.select("o_orderkey", "day", index.alias("quarter"), quarter_label(index).alias("label"))
    return labeled.withColumn("from_label", quarter_number(F.col("label")))


@query
def normalized_names(spark, folder):
    return name_table(src.table(spark, folder, "customer"), "c_name")


@query
def standardize_release(spark, folder):
    spec = TableSpec(
        ("CASE_NUMBER", "CASE_STATUS", "RECEIVED_DATE", "DECISION_DATE", "JOB_TITLE", "H_1B_DEPENDENT"),
        frozenset({"CASE_NUMBER", "CASE_STATUS"}),
        {"H-1B_DEPENDENT": "H_1B_DEPENDENT"},
    )
    day = F.col("o_orderdate").cast("date")
    landed = src.table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("case number"),
        F.col("o_orderstatus").alias("Case-Status"),
        day.alias("received__date"),
        F.col("o_orderpriority").alias("H-1B_Dependent"),
        F.col("o_orderkey").alias("row"),
        src.release_of(day).alias("release"),
    )
    headers = validate_headers([c for c in landed.columns if c not in ("row", "release")], spec)
    return standardize(landed, spec, F.col("release"), F.lit("orders.parquet"), F.col("row") + 2, headers)


# Versions ------------------------------------------------------------------------------------

VERSION_COLUMNS = ["CASE_NUMBER", "SOURCE_RELEASE", "VISA_CLASS", "CASE_STATUS", "DECISION_DATE", "TOTAL_WORKER_POSITIONS"]


@query
def latest_version(spark, folder):
    return versions.latest_version(versions.canonical_cases(src.line_cases(spark, folder))).select(*VERSION_COLUMNS)


@query
def first_version(spark, folder):
    return versions.first_version(versions.canonical_cases(src.line_cases(spark, folder))).select(*VERSION_COLUMNS)


@query
def revision_counts(spark, folder):
    cases = versions.canonical_cases(src.line_cases(spark, folder, names=True, received=True))
    return versions.revision_counts(
        cases, src.line_chunk(), class_value=src.CLASS, unique_order=False, levels=src.LINE_LEVELS,
        keys=versions.canonical_cases(src.line_cases(spark, folder)),
    )


@query
def cross_release_duplicates(spark, folder):
    return versions.cross_release_duplicates(src.line_cases(spark, folder))


@query
def release_overlaps(spark, folder):
    return versions.release_overlaps(src.line_cases(spark, folder))


@query
def release_offset_histogram(spark, folder):
    cases = versions.canonical_cases(src.line_cases(spark, folder, received=True))
    return versions.release_offsets(cases, "RECEIVED_DATE", src.CLASS)


# Source profile ------------------------------------------------------------------------------


@query
def source_profile(spark, folder):
    return profile.case_quality(src.line_cases(spark, folder, names=True), src.CLASS)


@query
def release_quality(spark, folder):
    lines = src.line_cases(spark, folder, names=True)
    return profile.release_quality(lines, src.CLASS, SINCE, rows=src.table(spark, folder, "lineitem").count())


@query
def status_counts(spark, folder):
    latest = profile.latest_class_rows(src.line_cases(spark, folder), ["CASE_STATUS"], src.CLASS)
    return profile.value_counts(latest, "CASE_STATUS", empty_is_missing=False)


@query
def release_value_counts(spark, folder):
    return profile.value_counts(src.line_cases(spark, folder), "VISA_CLASS", ["SOURCE_RELEASE"])


@query
def coverage(spark, folder):
    cases = versions.canonical_cases(src.line_cases(spark, folder, received=True))
    return profile.coverage(panel.with_case_date(cases, "RECEIVED_DATE"), src.CLASS)


@query
def date_checks(spark, folder):
    raw = src.line_cases(spark, folder, received=True)
    return profile.date_checks(profile.latest_class_rows(raw, ["DECISION_DATE", "RECEIVED_DATE"], src.CLASS))


@query
def elapsed_distribution(spark, folder):
    raw = src.line_cases(spark, folder, received=True)
    latest = profile.latest_class_rows(raw, ["DECISION_DATE", "RECEIVED_DATE"], src.CLASS)
    return cumulative.distribution(profile.with_elapsed(latest), "elapsed_days")


@query
def positions_distribution(spark, folder):
    latest = profile.latest_class_rows(src.line_cases(spark, folder), ["TOTAL_WORKER_POSITIONS"], src.CLASS)
    return cumulative.distribution(
        latest.select(F.col("TOTAL_WORKER_POSITIONS").cast("long").alias("positions")), "positions"
    )


def _line_class_cases(spark, folder, date_column):
    raw = src.line_cases(spark, folder, names=True, received=True)
    return panel.eligible_cases(panel.latest_cases(raw, date_column), src.CLASS)


@query
def quarter_totals(spark, folder):
    cases = _line_class_cases(spark, folder, "RECEIVED_DATE")
    return profile.period_totals(panel.in_window(cases, INNER_FIRST, INNER_LAST))


@query
def quarter_counts_by_decision(spark, folder):
    return panel.rollup_cases(_line_class_cases(spark, folder, "DECISION_DATE"), src.CERTIFIED)


@query
def quarter_counts_by_received(spark, folder):
    return panel.rollup_cases(_line_class_cases(spark, folder, "RECEIVED_DATE"), src.CERTIFIED)


@query
def invalid_positions(spark, folder):
    """Lines taxed at zero percent stand in for cases without a positive number of positions."""
    raw = src.line_cases(spark, folder)
    percent = F.floor(F.col("SOURCE_ROW_NUMBER.l_tax") * 100 + 0.5).cast("string")
    return panel.invalid_values(raw.withColumn("TOTAL_WORKER_POSITIONS", percent), src.CLASS)


# Links ---------------------------------------------------------------------------------------


@query
def worksite_link_same_year(spark, folder):
    parents, children = src.keys_only(spark, folder)
    return links.same_year_links(children, parents)


@query
def worksite_location_match(spark, folder):
    return links.location_match(links.link_children(src.line_children(spark, folder), src.order_parents(spark, folder)))


@query
def worksite_orphans(spark, folder):
    parents, children = src.keys_only(spark, folder)
    return links.orphans(children, parents)


@query
def worksite_other_year(spark, folder):
    parents, children = src.keys_only(spark, folder)
    return links.linked_elsewhere(children, parents)


@query
def multi_worksite_cases(spark, folder):
    return links.multi_child_keys(src.keys_only(spark, folder)[1])


@query
def case_links_by_year(spark, folder):
    parents, children = src.keys_only(spark, folder)
    return links.case_links_by_year(children, parents)


@query
def global_case_links(spark, folder):
    parents, children = src.keys_only(spark, folder)
    return links.global_case_links(children, parents)


# Panel ---------------------------------------------------------------------------------------


def _order_counts(spark, folder, positions=True):
    raw = src.order_cases(spark, folder, positions)
    cases = panel.eligible_cases(panel.latest_cases(raw, "RECEIVED_DATE"), src.CLASS)
    return panel.rollup_cases(cases, src.CERTIFIED)


def _order_panel(spark, folder, positions=False):
    """The panel over a stored rollup, which its last quarter is read from too."""
    return panel.dense_panel(cut_lineage(_order_counts(spark, folder, positions)))


def _examples(spark, folder):
    """Examples over the panel as a stored table, which companies and market both read."""
    columns = ["EMPLOYER_ID", "EMPLOYER_NAME", "quarter", "LCA_CASES"]
    return features.build_examples(cut_lineage(_order_panel(spark, folder).select(*columns)))


def _dated_examples(spark, folder) -> tuple[DataFrame, int]:
    """Examples over the stored panel, of which a query computes the columns it reads, and the panel's last
    quarter (one row)."""
    examples = _examples(spark, folder)
    return examples, examples.agg(F.coalesce(F.max("origin"), F.lit(0))).first()[0]


@query
def company_quarter_counts(spark, folder):
    return _order_counts(spark, folder)


@query
def dense_panel(spark, folder):
    return _order_panel(spark, folder, positions=True)


@query
def panel_window(spark, folder):
    raw = src.order_cases(spark, folder, positions=False)
    windowed = panel.activity_panel(raw, src.CLASS, "RECEIVED_DATE", src.CERTIFIED, window=(INNER_FIRST, INNER_LAST))
    return windowed.select("EMPLOYER_ID", "quarter", "LCA_CASES", "CERTIFIED_CASES")


@query
def excluded_cases(spark, folder):
    raw = src.order_cases(spark, folder, positions=False)
    cases = panel.eligible_cases(panel.latest_cases(raw, "RECEIVED_DATE"), src.CLASS)
    return panel.outside_window(cases, INNER_FIRST, INNER_LAST)


@query
def quarterly_change(spark, folder):
    return panel.company_quarters(_order_panel(spark, folder, positions=True))


@query
def company_lookup(spark, folder):
    return panel.lookup(quarterly_change(spark, folder), COMPANY)


@query
def reconcile_totals(spark, folder):
    latest = panel.latest_cases(src.order_cases(spark, folder), "RECEIVED_DATE")
    cases = cut_lineage(panel.eligible_cases(latest, src.CLASS))
    built = panel.dense_panel(cut_lineage(panel.rollup_cases(cases, src.CERTIFIED)))
    metrics = ["LCA_CASES", "REQUESTED_POSITIONS"]
    by_quarter = built.groupBy("quarter").agg(*[F.sum(name).alias(name) for name in metrics])
    return profile.reconcile(by_quarter, profile.period_totals(cases), "quarter", metrics, only_differing=False)


@query
def panel_violations(spark, folder):
    """The gates over a panel without zero filling, so that gaps show."""
    counts = cut_lineage(_order_counts(spark, folder, positions=False))
    labeled = counts.withColumn("FISCAL_QUARTER", quarter_label(F.col("quarter")))
    return quality.count_by_check(quality.panel_violations(labeled), quality.PANEL_CHECKS)


@query
def empty_quarters(spark, folder):
    """The line cases' receipt quarters against the quarters of all orders, two more on both sides."""
    totals = profile.period_totals(_line_class_cases(spark, folder, "RECEIVED_DATE"))
    index = fiscal_quarter_index(F.col("o_orderdate").cast("date"))
    bounds = src.table(spark, folder, "orders").agg(F.min(index), F.max(index)).first()  # one row
    if bounds[0] is None:
        bounds = (0, -5)
    return profile.empty_period_violations(totals, bounds[0] - 2, bounds[1] + 2)


# Panel profile -------------------------------------------------------------------------------


@query
def quarter_overview(spark, folder):
    return profile.period_overview(_order_panel(spark, folder, positions=True))


@query
def panel_summary(spark, folder):
    return profile.panel_summary(_order_panel(spark, folder, positions=True))


@query
def first_four_activity(spark, folder):
    return profile.first_n_activity(_order_panel(spark, folder))


@query
def transition_rates(spark, folder):
    return profile.transition_rates(cut_lineage(_order_panel(spark, folder)))


@query
def next_quarter_outcomes(spark, folder):
    return profile.next_quarter_outcomes(_order_panel(spark, folder))


# Features ------------------------------------------------------------------------------------


@query
def company_features(spark, folder):
    return features.company_features(_order_panel(spark, folder)).drop("CERTIFIED_CASES", "REQUESTED_POSITIONS")


@query
def season_features(spark, folder):
    rows = features.season_features(_order_panel(spark, folder).select("EMPLOYER_ID", "quarter", "LCA_CASES"))
    return rows.where(F.col("same_quarter_observations").isNotNull())


@query
def market_features(spark, folder):
    return features.market_features(features.market_totals(_order_panel(spark, folder)))


@query
def labeled_examples(spark, folder):
    return _examples(spark, folder)


# Evaluation ----------------------------------------------------------------------------------


@query
def rolling_split_sizes(spark, folder):
    examples, last = _dated_examples(spark, folder)
    return evaluate.split_sizes(examples, [last - back for back in SPLITS_BACK])


@query
def split_checks(spark, folder):
    """The evaluation split, and one so late that its second outcome quarter is unknown."""
    examples, last = _dated_examples(spark, folder)
    return quality.split_violations(examples, [last - EVALUATED_BACK, last - 1], features.FEATURES)


def _baseline_predictions(spark, folder):
    examples, last = _dated_examples(spark, folder)
    training, evaluation = evaluate.rolling_split(cut_lineage(examples), last - EVALUATED_BACK)
    return evaluate.with_baselines(evaluation, training)


@query
def baseline_scores(spark, folder):
    long = evaluate.by_model(
        evaluate.with_periods(_baseline_predictions(spark, folder)).select("period", "target_active", *evaluate.BASELINES),
        evaluate.BASELINES,
    )
    scored = evaluate.scores(long)
    return scored.select(
        "period", "model", "rows",
        *[F.round(name, 9).alias(name) for name in scored.columns if name not in ("period", "model", "rows")],
    )


@query
def reliability_bands(spark, folder):
    long = evaluate.by_model(
        _baseline_predictions(spark, folder).select("target_active", *evaluate.BASELINES), evaluate.BASELINES
    )
    table = evaluate.reliability(long, by=["model"])
    return table.withColumns({name: F.round(name, 9) for name in ("mean_probability", "actual_rate")})


# Landings with faults, and gates ---------------------------------------------------------------


@query
def dirty_names(spark, folder):
    return name_table(src.dirty_lines(spark, folder), "EMPLOYER_NAME")


@query
def dirty_dates(spark, folder):
    """Text dates of every landed form, by the text itself."""
    day = F.col("DECISION_DATE")
    landed = src.dirty_lines(spark, folder).groupBy(day).agg(F.count("*").alias("rows"))
    return landed.withColumn("day", iso_date(day)).withColumn("label", quarter_label(fiscal_quarter_index(F.col("day"))))


@query
def dirty_locations(spark, folder):
    placed = src.dirty_places(spark, folder)
    return placed.select("c_custkey", location(F.col("city"), F.col("state"), F.col("postal")).alias("p")).select("c_custkey", "p.*")


@query
def dirty_source_profile(spark, folder):
    return profile.case_quality(src.dirty_lines(spark, folder), src.CLASS)


@query
def dirty_release_quality(spark, folder):
    lines = src.dirty_lines(spark, folder)
    return profile.release_quality(lines, src.CLASS, SINCE, rows=src.table(spark, folder, "lineitem").count())


@query
def dirty_missing_keys(spark, folder):
    return versions.missing_keys(src.dirty_lines(spark, folder))


@query
def dirty_date_checks(spark, folder):
    raw = src.dirty_lines(spark, folder)
    return profile.date_checks(profile.latest_class_rows(raw, ["DECISION_DATE", "RECEIVED_DATE"], src.CLASS))


@query
def dirty_case_violations(spark, folder):
    raw = src.dirty_lines(spark, folder)
    found = quality.case_violations(raw, panel.latest_cases(raw, "DECISION_DATE"), src.CLASS)
    return found.groupBy("check").agg(F.count("*").alias("violations"))


@query
def dirty_value_maps(spark, folder):
    """The count maps of each release as rows."""
    maps = profile.release_value_maps(src.dirty_lines(spark, folder), src.CLASS)
    views = [name for name in maps.columns if name != "SOURCE_RELEASE"]
    rows = [maps.select("SOURCE_RELEASE", F.lit(view).alias("view"), F.explode(view).alias("value", "rows")) for view in views]
    return rows[0].union(rows[1]).union(rows[2])


@query
def count_mismatches(spark, folder):
    """Stored rows of each release against a ledger that is wrong for every second quarter and lacks the fourth."""
    lines = src.table(spark, folder, "lineitem").select(src.release_of(F.col("l_shipdate").cast("date")).alias("release"))
    counts = lines.groupBy("release").agg(F.count("*").alias("rows"))
    wrong = F.when(F.col("release").endswith("_Q2"), F.col("rows") + 1).otherwise(F.col("rows"))
    ledger = counts.withColumn("rows", wrong).where(~F.col("release").endswith("_Q4"))
    return quality.count_mismatches(counts, ledger)


@query
def discount_log_odds(spark, folder):
    rate = F.col("l_discount")
    odds = F.round(log_odds(rate), 9).alias("log_odds")
    return src.table(spark, folder, "lineitem").groupBy(rate).agg(F.count("*").alias("rows")).select("l_discount", "rows", odds)
