"""Gates: each returns its violations as rows (check, key, detail); ``enforce`` raises on any."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwright.functions.calendar import LABEL_PATTERN, quarter_number
from panelwright.functions.text import has_text


def violation(check: str, key: Column, detail: Column) -> list[Column]:
    return [F.lit(check).alias("check"), key.cast("string").alias("key"), detail.cast("string").alias("detail")]


def enforce(violations: DataFrame, shown: int = 5) -> None:
    """Raise with the first few violations; only those few rows come to the driver."""
    rows = violations.take(shown)
    if rows:
        raise ValueError("; ".join(f"{r['check']} {r['key']}: {r['detail']}" for r in rows))


def count_by_check(violations: DataFrame, checks: Sequence[str]) -> DataFrame:
    """Violations per check, zero rows included, so a clean table still reports."""
    spark = violations.sparkSession
    every = spark.createDataFrame([(name,) for name in checks], "check string")
    counted = violations.groupBy("check").agg(F.count("*").alias("violations"))
    return every.join(counted, "check", "left").na.fill(0, ["violations"])


def key_violations(panel: DataFrame, entity: str, period: str, required: Sequence[str]) -> DataFrame:
    """Missing values in required columns and repeated (entity, period) keys."""
    absent = F.lit(False)
    for name in required:
        absent = absent | F.col(name).isNull()
    missing = panel.where(absent).select(*violation("missing_value", F.col(entity), F.col(period)))
    repeated = panel.groupBy(entity, period).agg(F.count("*").alias("n")).where("n > 1")
    return missing.unionByName(repeated.select(*violation("duplicate_key", F.col(entity), F.col(period))))


def value_violations(panel: DataFrame, entity: str, label: str, metric: str) -> DataFrame:
    """Labels that are not fiscal quarters; counts that are not finite whole numbers from zero."""
    value = F.col(metric).cast("double")
    finite = ~F.isnan(value) & (F.abs(value) != float("inf"))
    whole = finite & (value >= 0) & (value % 1 == 0)
    labels = panel.where(~F.coalesce(F.col(label).rlike(LABEL_PATTERN), F.lit(False)))
    counts = panel.where(~F.coalesce(whole, F.lit(False)))
    return labels.select(*violation("invalid_quarter", F.col(entity), F.col(label))).unionByName(
        counts.select(*violation("invalid_count", F.col(entity), F.col(metric)))
    )


def name_conflicts(panel: DataFrame, entity: str, name: str) -> DataFrame:
    per_entity = panel.groupBy(entity).agg(F.min(name).alias("one"), F.max(name).alias("other"))
    return per_entity.where(F.col("one") != F.col("other")).select(
        *violation("name_conflict", F.col(entity), F.concat_ws(" / ", "one", "other"))
    )


def gap_violations(panel: DataFrame, entity: str, period: str, metric: str) -> DataFrame:
    """A market quarter nobody has; company histories with gaps, an early end or an empty start."""
    axis = panel.select(period).distinct()
    # One row per quarter: an unpartitioned window over the calendar axis only.
    gap = F.col(period) - F.lag(period).over(Window.orderBy(period))
    market = axis.withColumn("gap", gap).where("gap > 1").select(
        *violation("missing_market_quarter", F.col(period), F.col("gap"))
    )
    last = panel.agg(F.max(period)).scalar()
    per_entity = panel.groupBy(entity).agg(
        F.min(period).alias("first"),
        F.max(period).alias("last"),
        F.count_distinct(period).alias("quarters"),
        F.min_by(metric, period).alias("first_value"),
    )
    broken = (F.col("last") - F.col("first") + 1 != F.col("quarters")) | (F.col("last") != last)
    gaps = per_entity.where(broken).select(*violation("history_gap", F.col(entity), F.col("quarters")))
    starts = per_entity.where(~F.coalesce(F.col("first_value") > 0, F.lit(False))).select(
        *violation("history_without_start", F.col(entity), F.col("first"))
    )
    return market.unionByName(gaps).unionByName(starts)


PANEL_CHECKS = (
    "missing_value", "duplicate_key", "invalid_quarter", "invalid_count", "name_conflict",
    "missing_market_quarter", "history_gap", "history_without_start",
)


def panel_violations(
    panel: DataFrame,
    entity: str = "EMPLOYER_ID",
    name: str = "EMPLOYER_NAME",
    label: str = "FISCAL_QUARTER",
    metric: str = "LCA_CASES",
) -> DataFrame:
    """All panel gates over a labelled panel."""
    indexed = panel.withColumn("period", quarter_number(F.col(label)))
    return (
        key_violations(panel, entity, label, [entity, name, label, metric])
        .unionByName(value_violations(panel, entity, label, metric))
        .unionByName(name_conflicts(panel, entity, name))
        .unionByName(gap_violations(indexed, entity, "period", metric))
    )


def case_violations(raw: DataFrame, latest: DataFrame, class_value: str) -> DataFrame:
    """Rows without a case number; newest cases of the class without company or quarter."""
    unkeyed = raw.where(~has_text(F.col("CASE_NUMBER"))).select(
        *violation("missing_case_number", F.col("SOURCE_RELEASE"), F.lit("row without case number"))
    )
    return unkeyed.unionByName(undated_cases(latest, class_value))


def undated_cases(latest: DataFrame, class_value: str) -> DataFrame:
    """Newest cases of the class without company or quarter."""
    undated = (F.col("VISA_CLASS") == class_value) & (F.col("quarter").isNull() | ~has_text(F.col("EMPLOYER_NAME")))
    return latest.where(undated).select(*violation("case_without_company_or_date", F.col("CASE_NUMBER"), F.col("quarter")))


def count_mismatches(counts: DataFrame, ledger: DataFrame) -> DataFrame:
    """Releases whose stored rows differ from the rows the ledger recorded."""
    a, b = counts.alias("a"), ledger.alias("b")
    joined = a.join(b, F.col("a.release") == F.col("b.release"), "full_outer")
    return joined.where(~F.col("a.rows").eqNullSafe(F.col("b.rows"))).select(
        *violation(
            "row_count_changed",
            F.coalesce("a.release", "b.release"),
            F.concat_ws(" vs ", F.col("a.rows").cast("string"), F.col("b.rows").cast("string")),
        )
    )


SPLIT_CHECKS = (
    "training_overlaps_origin", "missing_training_rows", "missing_evaluation_rows",
    "single_training_class", "missing_outcome_quarter", "invalid_label", "horizon_mismatch",
    "nonfinite_feature",
)


def split_violations(examples: DataFrame, origins: Sequence[int], features: Sequence[str]) -> DataFrame:
    """What makes a rolling split at each origin unusable.

    Examples are counted once by all that the checks ask of them, quarters and label, which leaves as
    many rows as there are pairs of quarters; every check at every origin reads those."""
    # Zero times a value that is null, infinite or no number is not zero.
    zero = F.lit(0.0)
    for name in features:
        zero = zero + F.col(name).cast("double") * F.lit(0.0)
    by = ("origin", "target_quarter", "horizon", "target_active")
    kinds = examples.select(*by, (zero.isNull() | F.isnan(zero)).alias("unusable")).groupBy(*by).agg(
        F.count("*").alias("rows"), F.count_if("unusable").alias("unusable")
    )
    label, target = F.col("target_active"), F.col("target_quarter")

    def count(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, F.col("rows"))), F.lit(0))

    def absent(rows: Column) -> Column:
        return F.when(F.count_if(rows) == 0, 1).otherwise(0)

    def found(origin: int) -> list[Column]:
        training = label.isNotNull() & (target <= origin)
        evaluation = label.isNotNull() & (F.col("origin") == origin)
        one_class = (F.count_if(training & (label == 1)) == 0) | (F.count_if(training & (label == 0)) == 0)
        return [
            count(training & (F.col("origin") >= origin)),
            absent(training),
            absent(evaluation),
            F.when(one_class, 1).otherwise(0),
            absent(evaluation & (target == origin + 1)) + absent(evaluation & (target == origin + 2)),
            count(label.isNotNull() & ~label.isin(0, 1)),
            count(target != F.col("origin") + F.col("horizon")),
            F.coalesce(F.sum("unusable"), F.lit(0)),
        ]

    reports = [
        F.struct(F.lit(check).alias("check"), value.cast("long").alias("violations"), F.lit(origin).alias("split_origin"))
        for origin in origins
        for check, value in zip(SPLIT_CHECKS, found(origin))
    ]
    return kinds.agg(F.array(*reports).alias("reports")).select(F.inline("reports"))


def enforce_splits(examples: DataFrame, origins: Sequence[int], features: Sequence[str]) -> None:
    found = split_violations(examples, origins, features).where("violations > 0")
    enforce(found.select("check", F.col("split_origin").cast("string").alias("key"), F.col("violations").cast("string").alias("detail")))
