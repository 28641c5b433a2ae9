"""Profiles of the landed source and of the finished panel."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwright.functions.calendar import date_of, elapsed_days, quarter_label
from panelwright.functions.text import case_key, has_text, strip
from panelwright.operators.versions import ORDER, canonical_cases, latest_version

MISSING = "<missing>"
TASK_ROWS = 500_000  # rows whose cases one task counts
SHARES = 64  # parts that a release's rows without a key are counted in


def case_quality(raw: DataFrame, class_value: str, date_column: str = "DECISION_DATE", order_by: Sequence[str] = ORDER) -> DataFrame:
    """One row: landed rows, rows without a key, distinct and repeated cases, and the newest
    versions of the class with the part that has a company and a date."""
    keyed = raw.withColumn("key", F.when(has_text(F.col("CASE_NUMBER")), case_key(F.col("CASE_NUMBER"))))
    newest = F.struct(
        case_key(F.col("VISA_CLASS")).alias("visa"),
        has_text(F.col("EMPLOYER_NAME")).alias("named"),
        date_of(raw, date_column).alias("day"),
        strip(F.col("TOTAL_WORKER_POSITIONS")).alias("positions"),
    )
    per_key = keyed.groupBy("key").agg(
        F.count("*").alias("rows"), F.max_by(newest, F.struct(*order_by)).alias("v")
    )
    known = F.col("key").isNotNull()
    in_class = known & F.coalesce(F.col("v.visa") == class_value, F.lit(False))
    counted = in_class & F.col("v.named") & F.col("v.day").isNotNull()
    return per_key.agg(
        F.sum("rows").alias("source_rows"),
        F.coalesce(F.sum(F.when(~known, F.col("rows"))), F.lit(0)).alias("missing_case_numbers"),
        F.count_if(known).alias("unique_cases"),
        F.coalesce(F.sum(F.when(known, F.col("rows") - 1)), F.lit(0)).alias("repeated_case_rows"),
        F.count_if(in_class).alias("h1b_cases"),
        F.count_if(counted).alias("h1b_cases_with_company_and_date"),
        F.coalesce(F.sum(F.when(counted, F.col("v.positions").try_cast("long"))), F.lit(0)).alias("requested_positions"),
    )


def value_counts(df: DataFrame, column: str, by: Sequence[str] = (), empty_is_missing: bool = True) -> DataFrame:
    """Rows per value, absent text (and by default empty text) under ``<missing>``."""
    value = F.coalesce(column, F.lit(MISSING))
    if empty_is_missing:
        value = F.when(F.col(column) != "", F.col(column)).otherwise(F.lit(MISSING))
    return df.groupBy(*by, value.alias(column)).agg(F.count("*").alias("rows"))


def count_since(date: Column, since: str) -> Column:
    return F.count_if(date >= F.lit(since).cast("date"))


def _is_empty(name: str) -> Column:
    return F.col(name).isNull() | (F.col(name).cast("string") == "")


def release_quality(
    df: DataFrame,
    class_value: str = "H-1B",
    since: str = "2022-01-01",
    release: str = "SOURCE_RELEASE",
    key: str = "CASE_NUMBER",
    rows: int | None = None,
) -> DataFrame:
    """Counters of each release on raw keys: rows, missing and invalid fields, repeats, dates.

    Counting first by (release, case) keeps the distinct count exact without holding a release's
    keys anywhere. Cases are dealt over as many tasks as there are TASK_ROWS among ``rows`` (counted
    if not given), so a task's table of cases does not grow with the input; a case repeated very often is
    one entry of it, and rows without a key, which are no case, are spread."""
    decided = date_of(df, "DECISION_DATE")
    in_class = F.coalesce(case_key(F.col("VISA_CLASS")) == class_value, F.lit(False))

    def absent(name: str) -> Column:
        return in_class & _is_empty(name) if name in df.columns else F.lit(False)

    no_key = F.col(key).isNull() | (F.col(key) == "")
    flagged = df.select(
        release,
        F.col(key).alias("key"),
        F.when(no_key, F.pmod(F.monotonically_increasing_id(), F.lit(SHARES)).cast("int")).alias("share"),
        in_class.alias("in_class"),
        _is_empty("DECISION_DATE").alias("no_date"),
        decided.alias("decided"),
        absent("EMPLOYER_NAME").alias("no_name"),
        absent("SOC_CODE").alias("no_code"),
    )
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, -(-(df.count() if rows is None else rows) // TASK_ROWS))
    in_class, no_date, decided = F.col("in_class"), F.col("no_date"), F.col("decided")
    per_key = flagged.repartition(tasks, release, "key", "share").groupBy(release, "key", "share").agg(
        F.count("*").alias("source_rows"),
        F.count_if(in_class).alias("h1b_rows"),
        F.count_if(in_class & (decided >= F.lit(since).cast("date"))).alias("h1b_rows_since_start"),
        F.count_if(no_date).alias("missing_decision_date"),
        F.count_if(~no_date & decided.isNull()).alias("invalid_decision_date"),
        F.count_if(in_class & no_date).alias("h1b_missing_decision_date"),
        F.count_if("no_name").alias("h1b_missing_employer_name"),
        F.count_if("no_code").alias("h1b_missing_soc_code"),
        F.min(decided).alias("first_date"),
        F.max(decided).alias("last_date"),
    )
    missing = F.col("key").isNull() | (F.col("key") == "")
    summed = [name for name in per_key.columns if name not in (release, "key", "share", "first_date", "last_date")]
    counted = F.col("source_rows")
    return per_key.groupBy(release).agg(
        *[F.sum(name).alias(name) for name in summed],
        F.coalesce(F.sum(F.when(missing, counted)), F.lit(0)).alias("missing_case_number"),
        F.coalesce(F.sum(F.when(~missing, counted - 1)), F.lit(0)).alias("duplicate_case_number_rows"),
        F.count_if(~missing).alias("unique_case_numbers"),
        F.min("first_date").alias("decision_date_min"),
        F.max("last_date").alias("decision_date_max"),
    )


def release_value_maps(df: DataFrame, class_value: str = "H-1B", release: str = "SOURCE_RELEASE") -> DataFrame:
    """Per release, counts by class, by status, and by status inside the class, as maps."""
    in_class = F.coalesce(case_key(F.col("VISA_CLASS")) == class_value, F.lit(False))

    def named(column: str) -> Column:
        return F.when(F.col(column) != "", F.col(column)).otherwise(F.lit(MISSING))

    counted = df.groupBy(release, named("VISA_CLASS").alias("visa"), named("CASE_STATUS").alias("status")).agg(
        F.count("*").alias("rows"), F.count_if(in_class).alias("h1b")
    )
    views = F.array(
        F.struct(F.lit("visa_class_counts").alias("view"), F.col("visa").alias("value"), F.col("rows").alias("rows")),
        F.struct(F.lit("case_status_counts").alias("view"), F.col("status").alias("value"), F.col("rows").alias("rows")),
        F.struct(F.lit("h1b_case_status_counts").alias("view"), F.col("status").alias("value"), F.col("h1b").alias("rows")),
    )
    long = counted.select(release, F.explode(views).alias("v")).groupBy(release, "v.view", "v.value").agg(
        F.sum("v.rows").alias("rows")
    )
    # Distinct classes and statuses only, so each map stays as small as the vocabulary.
    maps = long.where("rows > 0").groupBy(release, "view").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("value", "rows")))).alias("counts")
    )
    return maps.groupBy(release).pivot(
        "view", ["visa_class_counts", "case_status_counts", "h1b_case_status_counts"]
    ).agg(F.first("counts"))


def coverage(df: DataFrame, class_value: str = "H-1B", period: str = "quarter", release: str = "SOURCE_RELEASE") -> DataFrame:
    """Rows of the class by release and case quarter, repeats and unknown quarters included."""
    rows = df.where(F.col("VISA_CLASS") == class_value)
    return rows.groupBy(release, period).agg(F.count("*").alias("rows"))


def period_totals(cases: DataFrame, period: str = "quarter") -> DataFrame:
    return cases.groupBy(period).agg(
        F.count("*").alias("LCA_CASES"), F.sum("positions").alias("REQUESTED_POSITIONS")
    )


def empty_period_violations(totals: DataFrame, first: int, last: int, period: str = "quarter") -> DataFrame:
    """Quarters of the window in which no case was found."""
    spark = totals.sparkSession
    axis = spark.range(first, last + 1).select(F.col("id").cast("int").alias(period))
    return axis.join(totals, period, "left_anti").select(
        F.lit("empty_quarter").alias("check"),
        quarter_label(F.col(period)).alias("key"),
        F.lit("no case in this quarter").alias("detail"),
    )


def date_checks(latest: DataFrame) -> DataFrame:
    """Range of decision dates, unusable dates, and decisions earlier than their receipt."""
    decided, received = date_of(latest, "DECISION_DATE"), date_of(latest, "RECEIVED_DATE")
    return latest.agg(
        F.count("*").alias("h1b_unique_cases"),
        F.min(decided).alias("decision_date_min"),
        F.max(decided).alias("decision_date_max"),
        F.count_if(decided.isNull()).alias("missing_or_invalid_decision_dates"),
        F.count_if(received.isNull()).alias("missing_or_invalid_received_dates"),
        F.count_if(elapsed_days(decided, received) < 0).alias("decision_before_received"),
    )


def with_elapsed(latest: DataFrame) -> DataFrame:
    return latest.withColumn(
        "elapsed_days", elapsed_days(date_of(latest, "DECISION_DATE"), date_of(latest, "RECEIVED_DATE"))
    )


def latest_class_rows(raw: DataFrame, columns: Sequence[str], class_value: str, order_by: Sequence[str] = ORDER) -> DataFrame:
    """Newest versions of the class with only the wanted columns carried through the shuffle."""
    needed = dict.fromkeys(["CASE_NUMBER", *order_by, "VISA_CLASS", *columns])
    latest = latest_version(canonical_cases(raw).select(*needed), ["CASE_NUMBER"], order_by)
    return latest.where(F.col("VISA_CLASS") == class_value)


def period_overview(panel: DataFrame, entity: str = "EMPLOYER_ID", period: str = "quarter") -> DataFrame:
    return panel.groupBy(period).agg(
        F.sum("LCA_CASES").alias("LCA_CASES"),
        F.sum("CERTIFIED_CASES").alias("CERTIFIED_CASES"),
        F.sum("REQUESTED_POSITIONS").alias("REQUESTED_POSITIONS"),
        F.count(entity).alias("KNOWN_COMPANIES"),
        F.count_if(F.col("LCA_CASES") > 0).alias("ACTIVE_COMPANIES"),
    )


def next_pairs(panel: DataFrame, min_history: int = 4, entity: str = "EMPLOYER_ID", period: str = "quarter") -> DataFrame:
    """Each company quarter with enough history and its outcome in the quarter right after."""
    w = Window.partitionBy(entity).orderBy(period)
    pairs = panel.select(
        entity,
        (F.col("LCA_CASES") > 0).alias("active"),
        F.row_number().over(w).alias("history"),
        F.lead(period).over(w).alias("next_period"),
        (F.lead("LCA_CASES").over(w) > 0).alias("next_active"),
        F.col(period).alias("this_period"),
    )
    return pairs.where(
        (F.col("next_period") == F.col("this_period") + 1)
        & F.col("next_active").isNotNull()
        & (F.col("history") >= min_history)
    )


def transition_rates(panel: DataFrame, min_history: int = 4, entity: str = "EMPLOYER_ID", period: str = "quarter") -> DataFrame:
    """Filing rate after an active and after an inactive quarter, for every panel quarter.

    Quarters without such pairs keep zero counts and null rates."""
    sides = {"PREVIOUSLY_ACTIVE": F.col("active"), "PREVIOUSLY_INACTIVE": ~F.col("active")}
    counts = []
    for prefix, side in sides.items():
        counts += [
            F.count_if(side).alias(f"{prefix}_COMPANIES"),
            F.count_if(side & F.col("next_active")).alias(f"{prefix}_NEXT_ACTIVE"),
        ]
    outcomes = next_pairs(panel, min_history, entity, period).groupBy(F.col("next_period").alias(period)).agg(*counts)
    joined = panel.select(period).distinct().join(outcomes, period, "left").na.fill(0)
    for prefix in sides:
        companies, active = F.col(f"{prefix}_COMPANIES"), F.col(f"{prefix}_NEXT_ACTIVE")
        joined = joined.withColumn(f"{prefix}_RATE_PERCENT", F.try_divide((100 * active).cast("double"), companies.cast("double")))
    return joined


def quarter_table(panel: DataFrame, entity: str = "EMPLOYER_ID", period: str = "quarter") -> DataFrame:
    """The quarters table of the panel profile: overview and transition rates side by side."""
    return period_overview(panel, entity, period).join(transition_rates(panel, 4, entity, period), period)


def next_quarter_outcomes(panel: DataFrame, min_history: int = 4, entity: str = "EMPLOYER_ID", period: str = "quarter") -> DataFrame:
    return next_pairs(panel, min_history, entity, period).agg(
        F.lit(min_history).alias("minimum_history_quarters"),
        F.count("*").alias("pairs"),
        F.count_distinct(entity).alias("companies"),
        F.count_if(~F.col("next_active")).alias("no_record"),
        F.count_if("next_active").alias("record"),
    )


def first_n_activity(panel: DataFrame, n: int = 4, entity: str = "EMPLOYER_ID", period: str = "quarter") -> DataFrame:
    """Companies by their number of active quarters among the first ``n``, with the headline shares."""
    w = Window.partitionBy(entity).orderBy(period)
    first = panel.select(entity, (F.col("LCA_CASES") > 0).alias("active"), F.row_number().over(w).alias("at")).where(
        F.col("at") <= n
    )
    per_company = first.groupBy(entity).agg(F.count("*").alias("seen"), F.count_if("active").alias("active_quarters"))
    histogram = per_company.where(F.col("seen") == n).groupBy("active_quarters").agg(F.count("*").alias("companies"))
    # At most n rows here, so the shares are windows over a handful of rows.
    everyone = Window.partitionBy(F.lit(0))
    total = F.sum("companies").over(everyone)
    zero = F.sum(F.col("companies") * (n - F.col("active_quarters"))).over(everyone)
    single = F.sum(F.when(F.col("active_quarters") == 1, F.col("companies")).otherwise(0)).over(everyone)
    return histogram.select(
        "active_quarters",
        "companies",
        total.alias("first_four_quarter_companies"),
        (100 * (zero / (n * total))).alias("zero_case_percent"),
        (100 * (single / total)).alias("single_active_quarter_company_percent"),
    )


def panel_summary(panel: DataFrame, entity: str = "EMPLOYER_ID", period: str = "quarter") -> DataFrame:
    return panel.agg(
        F.min(period).alias("first_quarter"),
        F.max(period).alias("last_quarter"),
        F.count_distinct(period).alias("quarters"),
        F.count_distinct(entity).alias("companies"),
        F.count("*").alias("company_quarter_rows"),
        F.sum("LCA_CASES").alias("lca_cases"),
        F.sum("REQUESTED_POSITIONS").alias("requested_positions"),
    )


def reconcile(left: DataFrame, right: DataFrame, key: str, metrics: Sequence[str], only_differing: bool = True) -> DataFrame:
    """Keys whose totals differ between two tables, or that only one of them has."""
    a, b = left.alias("a"), right.alias("b")
    joined = a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full_outer")
    same = F.lit(True)
    for name in metrics:
        same = same & F.col(f"a.{name}").eqNullSafe(F.col(f"b.{name}"))
    kept = joined.where(~same) if only_differing else joined
    return kept.select(
        F.coalesce(f"a.{key}", f"b.{key}").alias(key),
        (~same).alias("differs"),
        *[F.col(f"a.{name}").alias(f"panel_{name}") for name in metrics],
        *[F.col(f"b.{name}").alias(f"source_{name}") for name in metrics],
    )


def check_totals(panel: DataFrame, totals: DataFrame, period: str = "quarter", metrics: Sequence[str] = ("LCA_CASES", "REQUESTED_POSITIONS")) -> DataFrame:
    """Violations of the independent count: panel quarters against source quarters, both ways."""
    metrics = list(metrics)
    by_quarter = panel.groupBy(period).agg(*[F.sum(name).alias(name) for name in metrics])
    differing = reconcile(by_quarter, totals, period, metrics)
    missing = F.col(f"source_{metrics[0]}").isNull()
    return differing.select(
        F.when(missing, "no_source_records").otherwise("totals_differ").alias("check"),
        F.col(period).cast("string").alias("key"),
        F.to_json(F.struct(*[name for name in differing.columns if name not in (period, "differs")])).alias("detail"),
    )
