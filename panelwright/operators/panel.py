"""Cases rolled up to a dense entity x fiscal-quarter panel, with period-over-period change."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwright.functions.calendar import date_of, fiscal_quarter_index, quarter_label
from panelwright.functions.numeric import round_binary
from panelwright.functions.text import case_key, company_id, entity_id, has_text, strip, with_normalized_name
from panelwright.operators.versions import ORDER, canonical_cases, latest_version
from panelwright.session import cut_lineage

CASE_DATES = ("DECISION_DATE", "RECEIVED_DATE")
# A positive number of at most 18 digits, so that every accepted one fits a long.
POSITIONS_PATTERN = r"^[1-9][0-9]{0,17}\z"
METRICS = ("LCA_CASES", "CERTIFIED_CASES", "REQUESTED_POSITIONS")


def with_case_date(df: DataFrame, date_column: str) -> DataFrame:
    """Add ``quarter``, the fiscal quarter index of the chosen case date."""
    if date_column not in CASE_DATES:
        raise ValueError(f"Unsupported case date: {date_column}")
    return df.withColumn("quarter", fiscal_quarter_index(date_of(df, date_column)))


def invalid_values(
    df: DataFrame,
    class_value: str,
    column: str = "TOTAL_WORKER_POSITIONS",
    key: str = "CASE_NUMBER",
    class_column: str = "VISA_CLASS",
    pattern: str = POSITIONS_PATTERN,
) -> DataFrame:
    """Rows of the class whose value is not a positive whole number; looks at every version."""
    in_class = case_key(F.col(class_column)) == class_value
    valid = F.coalesce(strip(F.col(column)).rlike(pattern), F.lit(False))
    bad = df.where(has_text(F.col(key)) & in_class & ~valid)
    return bad.select(
        F.lit("invalid_positions").alias("check"),
        F.col(key).alias("key"),
        F.col(column).alias("detail"),
    )


def latest_cases(raw: DataFrame, date_column: str, order_by: Sequence[str] = ORDER) -> DataFrame:
    """Newest version of every case with its quarter and position count, all classes."""
    needed = ["CASE_NUMBER", *order_by, "VISA_CLASS", "CASE_STATUS", "EMPLOYER_NAME", "TOTAL_WORKER_POSITIONS"]
    dated = with_case_date(canonical_cases(raw), date_column).select(*needed, "quarter")
    return typed_cases(latest_version(dated, ["CASE_NUMBER"], order_by))


def typed_cases(latest: DataFrame) -> DataFrame:
    """Newest cases with their position count as a number."""
    positions = F.when(
        strip(F.col("TOTAL_WORKER_POSITIONS")).rlike(POSITIONS_PATTERN),
        strip(F.col("TOTAL_WORKER_POSITIONS")).try_cast("long"),
    )
    return latest.withColumn("positions", positions)


def eligible_cases(latest: DataFrame, class_value: str) -> DataFrame:
    """Cases of the class that have a company and a quarter."""
    return latest.where(
        (F.col("VISA_CLASS") == class_value) & has_text(F.col("EMPLOYER_NAME")) & F.col("quarter").isNotNull()
    )


def in_window(df: DataFrame, first: int, last: int, period: str = "quarter") -> DataFrame:
    return df.where(F.col(period).between(first, last))


def outside_window(df: DataFrame, first: int, last: int, period: str = "quarter") -> DataFrame:
    return df.agg(F.count_if(~F.col(period).between(first, last)).alias("excluded_cases"))


def rollup_cases(cases: DataFrame, certified: str = "Certified") -> DataFrame:
    """Cases, certified cases and positions per company and quarter.

    Counts are taken per landed spelling first, so that names are normalised once per spelling and
    quarter and a company with very many cases leaves each map task as a handful of rows."""
    spelled = cases.groupBy("EMPLOYER_NAME", "quarter").agg(
        F.count("*").alias("cases"),
        F.count_if(F.col("CASE_STATUS") == certified).alias("certified"),
        F.sum("positions").alias("positions"),
    )
    named = with_normalized_name(spelled.withColumnRenamed("EMPLOYER_NAME", "spelling"), "spelling", "EMPLOYER_NAME")
    return named.groupBy(entity_id(F.col("EMPLOYER_NAME")).alias("EMPLOYER_ID"), "EMPLOYER_NAME", "quarter").agg(
        F.sum("cases").alias("LCA_CASES"),
        F.sum("certified").alias("CERTIFIED_CASES"),
        F.sum("positions").alias("REQUESTED_POSITIONS"),
    )


def dense_panel(
    counts: DataFrame,
    entity: str = "EMPLOYER_ID",
    period: str = "quarter",
    metrics: Sequence[str] = METRICS,
    last: int | None = None,
) -> DataFrame:
    """Zero-filled rows from each entity's first period to ``last``, by default the last of all.

    Each row stretches to the period before its entity's next one, so the spine costs one window
    and no join, and no entity's rows are gathered. ``counts`` is read twice to find the last period;
    pass a stored table."""
    if last is None:
        end = counts.agg(F.max(period)).scalar()
    else:
        end = F.lit(last)
        counts = counts.where(F.col(period) <= last)
    w = Window.partitionBy(entity).orderBy(period)
    until = F.coalesce(F.lead(period).over(w) - 1, end)
    held = counts.withColumn("until", until)
    spread = held.withColumn("at", F.explode(F.sequence(F.col(period), F.col("until"))))
    filled = {name: F.when(F.col("at") == F.col(period), F.col(name)).otherwise(F.lit(0)) for name in metrics}
    return spread.withColumns(filled).withColumn(period, F.col("at")).drop("until", "at")


def with_change(panel: DataFrame, metric: str, change: str, percent: str, entity: str = "EMPLOYER_ID", period: str = "quarter") -> DataFrame:
    """Difference and percentage against the previous period; null on the first one, and the
    percentage also after a zero."""
    w = Window.partitionBy(entity).orderBy(period)
    before = F.lag(metric).over(w)
    difference = F.col(metric) - before
    ratio = F.when(before != 0, (100 * difference).cast("double") / before.cast("double"))
    return panel.withColumns({change: difference, percent: ratio}).withColumn(percent, round_binary(F.col(percent)))


def company_quarters(panel: DataFrame) -> DataFrame:
    """The published panel: ten columns, quarters as labels."""
    changed = with_change(panel, "LCA_CASES", "CHANGE_FROM_PREVIOUS_QUARTER", "CHANGE_PERCENT")
    changed = with_change(
        changed, "REQUESTED_POSITIONS", "POSITION_CHANGE_FROM_PREVIOUS_QUARTER", "POSITION_CHANGE_PERCENT"
    )
    return changed.select(
        "EMPLOYER_ID",
        "EMPLOYER_NAME",
        quarter_label(F.col("quarter")).alias("FISCAL_QUARTER"),
        "LCA_CASES",
        "CERTIFIED_CASES",
        "CHANGE_FROM_PREVIOUS_QUARTER",
        "CHANGE_PERCENT",
        "REQUESTED_POSITIONS",
        "POSITION_CHANGE_FROM_PREVIOUS_QUARTER",
        "POSITION_CHANGE_PERCENT",
    )


def activity_panel(
    raw: DataFrame,
    class_value: str = "H-1B",
    date_column: str = "DECISION_DATE",
    certified: str = "Certified",
    order_by: Sequence[str] = ORDER,
    window: tuple[int, int] | None = None,
) -> DataFrame:
    """Raw versioned cases to the dense panel: newest versions, class, window, rollup, spine."""
    cases = eligible_cases(latest_cases(raw, date_column, order_by), class_value)
    if window is not None:
        cases = in_window(cases, *window)
    return dense_panel(cut_lineage(rollup_cases(cases, certified)))


def lookup_id(df: DataFrame, company: str) -> DataFrame:
    """Rows of one company, found by the id of its normalised name."""
    return df.where(F.col("EMPLOYER_ID") == company_id(company))


def lookup(panel: DataFrame, company: str) -> DataFrame:
    """One company's history, ordered by quarter."""
    return lookup_id(panel, company).orderBy("FISCAL_QUARTER")
