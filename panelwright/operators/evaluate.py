"""Probability metrics, reliability bands and the closed-form baselines."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.functions.calendar import quarter_label
from panelwright.functions.numeric import clip, smoothed_rate
from panelwright.operators.cumulative import running_totals, value_chunks
from panelwright.operators.quality import violation
from panelwright.session import cut_lineage

LOSS_EPS = 1e-7
# Open-ended reliability thresholds, in percent.
THRESHOLDS = (95, 99)


def rolling_split(examples: DataFrame, origin: int) -> tuple[DataFrame, DataFrame]:
    """Training rows whose outcome was known at ``origin``; evaluation rows that start there."""
    known = examples.where(F.col("target_active").isNotNull())
    return known.where(F.col("target_quarter") <= origin), known.where(F.col("origin") == origin)


def split_sizes(examples: DataFrame, origins: Sequence[int]) -> DataFrame:
    """Rows and active rows of training and evaluation at each origin, in one pass."""
    known = examples.where(F.col("target_active").isNotNull())
    at = known.withColumn("split_origin", F.explode(F.array(*[F.lit(o) for o in origins])))
    training, evaluation = F.col("target_quarter") <= F.col("split_origin"), F.col("origin") == F.col("split_origin")
    active = F.col("target_active") == 1
    return at.groupBy("split_origin").agg(
        F.count_if(training).alias("training_rows"),
        F.count_if(training & active).alias("training_active"),
        F.count_if(evaluation).alias("evaluation_rows"),
        F.count_if(evaluation & active).alias("evaluation_active"),
    )


def log_loss(label: Column, probability: Column) -> Column:
    p = clip(probability, LOSS_EPS)
    return -(label * F.log(p) + (1 - label) * F.log(1 - p))


def score_violations(df: DataFrame, label: str, probability: str) -> DataFrame:
    y, p = F.col(label).cast("double"), F.col(probability).cast("double")
    valid = y.isin(0.0, 1.0) & ~F.isnan(p) & p.between(0.0, 1.0)
    return df.where(~F.coalesce(valid, F.lit(False))).select(*violation("invalid_score", y, p))


def with_periods(df: DataFrame, period: str = "target_quarter") -> DataFrame:
    """Each row once under its own period and once under ``all``."""
    return df.withColumn("period", F.explode(F.array(F.lit("all"), quarter_label(F.col(period)))))


def by_model(predictions: DataFrame, models: Sequence[str]) -> DataFrame:
    """Long form: one row per prediction and model."""
    choices = F.array(*[F.struct(F.lit(m).alias("model"), F.col(m).cast("double").alias("probability")) for m in models])
    return predictions.withColumn("m", F.explode(choices)).select("*", "m.model", "m.probability").drop("m", *models)


def scores(df: DataFrame, label: str = "target_active", probability: str = "probability", by: Sequence[str] = ("period", "model")) -> DataFrame:
    """Rows, rates, log loss, Brier, average precision and ROC AUC per group.

    Rows collapse to one per (group, distinct score) first. Ranking metrics then need running totals
    along the score, taken chunk by chunk, so no task sees a group's whole ranking."""
    by = list(by)
    y = F.col(label).cast("double")
    points = df.groupBy(*by, F.col(probability).cast("double").alias("p")).agg(
        F.count("*").alias("rows"), F.sum(y).cast("long").alias("hits")
    )
    points = cut_lineage(points.withColumn("misses", F.col("rows") - F.col("hits")))
    ranked = running_totals(value_chunks(points, "p"), by, "p", ["rows", "hits"], descending=True)
    p, hits, misses = F.col("p"), F.col("hits"), F.col("misses")
    misses_above = F.col("running_rows") - F.col("running_hits") - misses
    clipped = clip(p, LOSS_EPS)
    total = ranked.groupBy(*by).agg(
        F.sum("rows").alias("rows"),
        F.sum("hits").alias("hits"),
        F.sum(p * F.col("rows")).alias("p_sum"),
        F.sum(-(hits * F.log(clipped) + misses * F.log(1 - clipped))).alias("loss"),
        F.sum(hits * (1 - p) * (1 - p) + misses * p * p).alias("brier"),
        F.sum(hits * (F.col("running_hits") / F.col("running_rows"))).alias("precision"),
        # Pairs won by the hit: misses ranked below it, and half of those tied with it.
        F.sum(hits * (F.lit(-1.0) * misses_above - misses / 2)).alias("lost"),
    )
    n, positives = F.col("rows"), F.col("hits")
    negatives = n - positives
    both = (positives > 0) & (negatives > 0)
    return total.select(
        *by,
        n,
        (positives / n).alias("actual_rate"),
        (F.col("p_sum") / n).alias("mean_probability"),
        (F.col("loss") / n).alias("log_loss"),
        (F.col("brier") / n).alias("brier"),
        F.when(both, F.col("precision") / positives).alias("average_precision"),
        F.when(both, 1 + F.col("lost") / (positives * negatives)).alias("roc_auc"),
    )


def reliability(df: DataFrame, label: str = "target_active", probability: str = "probability", by: Sequence[str] = ()) -> DataFrame:
    """Ten-percent bands (the last one closed) and the rows at or above each threshold."""
    p = F.col(probability).cast("double")
    bands = [(f"{lo}–{lo + 10}%", (p >= lo / 100) & (p < (lo + 10) / 100)) for lo in range(0, 90, 10)]
    bands.append(("90–100%", (p >= 0.9) & (p <= 1)))
    bands += [(f">={t}%", p >= t / 100) for t in THRESHOLDS]
    matched = F.filter(F.array(*[F.when(inside, F.lit(text)) for text, inside in bands]), lambda b: b.isNotNull())
    return (
        df.withColumn("probability_band", F.explode(matched))
        .groupBy(*by, "probability_band")
        .agg(
            F.count("*").alias("rows"),
            (F.sum(p) / F.count("*")).alias("mean_probability"),
            (F.sum(F.col(label).cast("double")) / F.count("*")).alias("actual_rate"),
        )
    )


BASELINES = ("global_rate", "company_rate", "recent_rate")


def with_baselines(evaluation: DataFrame, training: DataFrame) -> DataFrame:
    """Global training rate, smoothed own rate, smoothed rate of the last four quarters."""
    rate = training.agg((F.sum("target_active") / F.count("*")).alias("rate")).scalar()
    n = F.col("history_quarters").cast("double")
    # Features are single precision, and so are the rates made of them.
    hits = (F.col("history_active_rate") * n).cast("float").cast("double")
    return evaluation.withColumns(
        {
            "global_rate": rate,
            "company_rate": smoothed_rate(hits, n).cast("float").cast("double"),
            "recent_rate": ((F.col("active_last4").cast("double") + 1) / 6).cast("float").cast("double"),
        }
    )
