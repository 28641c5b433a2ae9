"""Checks of trained models: a refit before the last two quarters, and the directions of trends."""

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelwright.operators import evaluate
from panelwright.operators.features import FEATURES
from panelwright.operators.model import TRENDS, Selection, calibrated, fit, predict_with
from panelwright.operators.quality import enforce, enforce_splits

SAMPLE = 512
TOLERANCE = 1e-7
# The values each trend input is moved through.
GRIDS = {
    "recent_change": [-1000, -100, -10, -1, 0, 1, 10, 100, 1000],
    "recent_slope": [-500, -50, -5, -1, 0, 1, 5, 50, 500],
    "annual_change": [-4000, -400, -40, -4, 0, 4, 40, 400, 4000],
    "annual_growth": [-1, -0.5, -0.1, 0, 0.1, 0.5, 1, 2, 5],
    "active_last4": [0, 1, 2, 3, 4],
    "inactive_quarters": [0, 1, 2, 3, 4, 8, 12, 16],
}


def backtest(examples: DataFrame, selection: Selection) -> DataFrame:
    """Predictions of every method and baseline for the two quarters after the evaluation origin,
    by models refitted on what was known there."""
    origin = selection.plan["evaluation_origin"]
    if selection.plan["selection_origin"] + 2 > origin:
        raise ValueError("Model selection overlaps evaluation outcomes")
    enforce_splits(examples, [origin], FEATURES)
    training, evaluation = evaluate.rolling_split(examples, origin)
    scored = evaluate.with_baselines(evaluation, training)
    for method, settings in selection.parameters.items():
        refitted = fit(method, settings, training)
        scored = calibrated(predict_with(refitted, scored, method), selection, method, method)
    identity = [name for name in examples.columns if name not in FEATURES]
    return scored.select(*identity, *selection.parameters, *evaluate.BASELINES)


def backtest_metrics(predictions: DataFrame, methods: Sequence[str]) -> DataFrame:
    """Scores of each method over both quarters together and each alone."""
    long = evaluate.by_model(evaluate.with_periods(predictions), methods)
    enforce(evaluate.score_violations(long, "target_active", "probability"))
    return evaluate.scores(long)


def sample_rows(df: DataFrame, keys: Sequence[str], n: int = SAMPLE, seed: int = 42) -> DataFrame:
    """The same ``n`` rows on every run: those with the smallest seeded hash of their key."""
    return df.orderBy(F.xxhash64(*keys, F.lit(seed)), *keys).limit(n)


def grid_rows(sample: DataFrame, row: str, grids: dict[str, list[float]] = GRIDS) -> DataFrame:
    """Every sampled row once per trend and grid value, with that input replaced."""
    changes = F.array(
        *[
            F.struct(F.lit(feature).alias("feature"), F.lit(float(value)).alias("value"))
            for feature, values in grids.items()
            for value in values
        ]
    )
    moved = sample.withColumn("change", F.explode(changes)).select(row, *FEATURES, "change.feature", "change.value")
    return moved.withColumns(
        {name: F.when(F.col("feature") == name, F.col("value").cast("float")).otherwise(F.col(name)) for name in grids}
    )


def grid_differences(scored: DataFrame, row: str, signs: dict[str, int] = TRENDS) -> DataFrame:
    """Signed change of the probability from each grid value to the next."""
    w = Window.partitionBy("feature", row).orderBy("value")
    sign = F.create_map(*[F.lit(x) for pair in signs.items() for x in pair])[F.col("feature")]
    step = (F.col("probability") - F.lag("probability").over(w)) * sign
    return scored.select("feature", row, sign.alias("direction"), step.alias("difference"))


def monotonicity_audit(model: PipelineModel, rows: DataFrame, selection: Selection | None = None, method: str = "boosted", key: str = "EMPLOYER_ID") -> DataFrame:
    """Per trend: comparisons, violations of its direction, and rows it moves at all."""
    sample = sample_rows(rows, [key]).withColumnRenamed(key, "row_key")
    scored = predict_with(model, grid_rows(sample, "row_key"))
    if selection is not None:
        scored = calibrated(scored, selection, method)
    steps = grid_differences(scored, "row_key").where("difference is not null")
    per_row = steps.groupBy("feature", "direction", "row_key").agg(
        F.count("*").alias("comparisons"),
        F.count_if(F.col("difference") < -TOLERANCE).alias("violations"),
        F.max(F.col("difference") > TOLERANCE).alias("moved"),
    )
    return per_row.groupBy("feature", "direction").agg(
        F.count("*").alias("rows"),
        F.sum("comparisons").alias("comparisons"),
        F.sum("violations").alias("violations"),
        F.count_if("moved").alias("rows_with_change"),
    )
