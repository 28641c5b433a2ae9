"""Next-quarter activity models on MLlib: forest, boosted trees with monotone trends, calibration.

Every fit at an origin sees only examples whose outcome was known then. Data stays in DataFrames;
the driver holds losses, coefficients and fitted models."""

import json
from collections.abc import Sequence
from dataclasses import dataclass, field
from statistics import median

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.functions.calendar import number_label
from panelwright.functions.numeric import log_odds
from panelwright.operators.boosting import WEIGHT, fit_boosted
from panelwright.operators.evaluate import log_loss, rolling_split
from panelwright.operators.features import FEATURES
from panelwright.operators.quality import enforce_splits

SEED = 42
LABEL = "target_active"
PATIENCE = 40

# Trend inputs and the direction in which each may move the probability.
TRENDS = {
    "recent_change": 1,
    "recent_slope": 1,
    "annual_change": 1,
    "annual_growth": 1,
    "active_last4": 1,
    "inactive_quarters": -1,
}
# Searched settings.
CANDIDATES = {
    "random_forest": [
        {"trees": 160, "depth": 8, "leaf": 50},
        {"trees": 160, "depth": 12, "leaf": 30},
        {"trees": 160, "depth": 16, "leaf": 50},
    ],
    "boosted": [
        {"trees": 700, "depth": 3, "rate": 0.05},
        {"trees": 700, "depth": 3, "rate": 0.1},
        {"trees": 700, "depth": 5, "rate": 0.05},
        {"trees": 700, "depth": 5, "rate": 0.1},
    ],
}
# How many quarters before the last one each step of the time plan starts.
TUNING, CALIBRATION, SELECTION, EVALUATION = (10, 8), 6, 4, 2


@dataclass
class Selection:
    """What a training run decided: settings, calibration lines and their use, per method."""

    parameters: dict[str, dict]
    calibration: dict[str, tuple[float, float]]
    use_calibration: dict[str, bool]
    plan: dict
    trained_through: int
    training_rows: int = 0
    version: str = ""
    losses: list[dict] = field(default_factory=list)

    def to_json(self) -> str:
        return json.dumps(self.__dict__, sort_keys=True)

    @staticmethod
    def from_json(text: str) -> "Selection":
        values = json.loads(text)
        values["calibration"] = {name: tuple(line) for name, line in values["calibration"].items()}
        return Selection(**values)


def time_plan(last: int) -> dict:
    """Origins of each training step, so that no step sees the outcomes of a later one."""
    return {
        "tuning_origins": [last - back for back in TUNING],
        "calibration_origin": last - CALIBRATION,
        "selection_origin": last - SELECTION,
        "evaluation_origin": last - EVALUATION,
    }


def _assembler(columns: Sequence[str], output: str) -> VectorAssembler:
    return VectorAssembler(inputCols=list(columns), outputCol=output)


def forest(settings: dict) -> Pipeline:
    trees = RandomForestClassifier(
        featuresCol="features", labelCol=LABEL, numTrees=settings["trees"], maxDepth=settings["depth"],
        minInstancesPerNode=settings["leaf"], featureSubsetStrategy="0.7", maxBins=256, seed=SEED,
    )
    return Pipeline(stages=[_assembler(FEATURES, "features"), trees])


def fit_monotone(training: DataFrame, settings: dict, evaluation: DataFrame | None = None) -> PipelineModel:
    """Boosted trees that hold every trend's direction; with `evaluation` they stop once its loss does not fall."""
    trees = fit_boosted(
        training, FEATURES, LABEL, TRENDS, settings["trees"], settings["depth"], settings["rate"],
        settings.get("leaf", WEIGHT), evaluation, PATIENCE, SEED,
    )
    return PipelineModel(stages=[trees])


def fit(method: str, settings: dict, training: DataFrame, evaluation: DataFrame | None = None) -> PipelineModel:
    if method == "random_forest":
        return forest(settings).fit(training)
    if method == "boosted":
        return fit_monotone(training, settings, evaluation)
    raise ValueError(f"Unknown model: {method}")


def predict_with(model: PipelineModel, rows: DataFrame, output: str = "probability") -> DataFrame:
    """Add the probability of activity and drop the model's working columns."""
    probability = vector_to_array(F.col("probability"))[1]
    return model.transform(rows).withColumn("p_active", probability).select(*rows.columns, F.col("p_active").alias(output))


def mean_loss(scored: DataFrame, probability: str = "probability") -> float:
    return scored.agg(F.avg(log_loss(F.col(LABEL), F.col(probability)))).first()[0]


def search(examples: DataFrame, candidates: dict[str, list[dict]], origins: Sequence[int]) -> tuple[dict, list[dict]]:
    """Best settings of each method by mean log loss over the tuning origins."""
    losses = []
    for origin in origins:
        training, evaluation = (side.persist() for side in rolling_split(examples, origin))
        for method, options in candidates.items():
            for index, settings in enumerate(options):
                fitted = fit(method, settings, training, evaluation)
                trees = len(fitted.stages[0].model()["trees"]) if method == "boosted" else settings["trees"]
                loss = mean_loss(predict_with(fitted, evaluation))
                losses.append({"method": method, "candidate": index, "origin": origin, "trees": trees, "log_loss": loss})
        training.unpersist()
        evaluation.unpersist()
    return {name: best_candidate(losses, name, options) for name, options in candidates.items()}, losses


def best_candidate(losses: Sequence[dict], method: str, options: Sequence[dict]) -> dict:
    """Settings with the lowest mean loss; boosting keeps the median of its stopped tree counts."""
    own = [row for row in losses if row["method"] == method]

    def mean(index: int) -> float:
        found = [row["log_loss"] for row in own if row["candidate"] == index]
        return sum(found) / len(found)

    best = min(range(len(options)), key=mean)
    trees = [row["trees"] for row in own if row["candidate"] == best]
    return {**options[best], "trees": int(median(trees))}


def fit_calibration(scored: DataFrame, probability: str = "probability") -> tuple[float, float]:
    """Slope and intercept of a logistic line over log-odds, with the unit penalty on the slope."""
    points = scored.select(F.col(LABEL), array_to_vector(F.array(log_odds(F.col(probability)))).alias("features"))
    penalty = 1.0 / points.count()
    line = LogisticRegression(labelCol=LABEL, regParam=penalty, standardization=False, maxIter=200).fit(points)
    return float(line.coefficients[0]), float(line.intercept)


def calibrate(probability: Column, line: tuple[float, float]) -> Column:
    slope, intercept = line
    return 1 / (1 + F.exp(-(F.lit(slope) * log_odds(probability) + F.lit(intercept))))


def calibrated(scored: DataFrame, selection: Selection, method: str, probability: str = "probability") -> DataFrame:
    if not selection.use_calibration[method]:
        return scored
    return scored.withColumn(probability, calibrate(F.col(probability), selection.calibration[method]))


def choose_calibration(examples: DataFrame, parameters: dict[str, dict], plan: dict) -> tuple[dict, dict]:
    """Fit each line at the calibration origin; use it if it lowers the selection origin's loss.

    A line over the monotone model must also rise, or it would turn the directions around."""
    lines, used = {}, {}
    for method, settings in parameters.items():
        training, rows = rolling_split(examples, plan["calibration_origin"])
        lines[method] = fit_calibration(predict_with(fit(method, settings, training), rows))
        training, rows = rolling_split(examples, plan["selection_origin"])
        raw = predict_with(fit(method, settings, training), rows).persist()
        adjusted = raw.withColumn("probability", calibrate(F.col("probability"), lines[method]))
        allowed = method != "boosted" or lines[method][0] > 0
        used[method] = bool(allowed and mean_loss(adjusted) < mean_loss(raw))
        raw.unpersist()
    return lines, used


def train(examples: DataFrame, last: int, candidates: dict[str, list[dict]] | None = None, version: str = "") -> tuple[Selection, dict[str, PipelineModel]]:
    """Search, calibrate and fit through the last quarter; pass a stored examples table."""
    candidates = candidates or CANDIDATES
    plan = time_plan(last)
    origins = [*plan["tuning_origins"], plan["calibration_origin"], plan["selection_origin"]]
    enforce_splits(examples, origins, FEATURES)
    parameters, losses = search(examples, candidates, plan["tuning_origins"])
    lines, used = choose_calibration(examples, parameters, plan)
    training = examples.where(F.col(LABEL).isNotNull() & (F.col("target_quarter") <= last)).persist()
    models = {method: fit(method, settings, training) for method, settings in parameters.items()}
    selection = Selection(parameters, lines, used, plan, last, training.count(), version, losses)
    training.unpersist()
    return selection, models


def save(selection: Selection, models: dict[str, PipelineModel], path: str, spark) -> None:
    for method, model in models.items():
        model.write().overwrite().save(f"{path}/{method}")
    row = [(selection.to_json(), selection.version, selection.trained_through)]
    table = spark.createDataFrame(row, "selection string, version string, trained_through int")
    table.coalesce(1).write.mode("overwrite").parquet(f"{path}/selection")


def load(spark, path: str) -> tuple[Selection, dict[str, PipelineModel]]:
    selection = Selection.from_json(spark.read.parquet(f"{path}/selection").first()["selection"])
    return selection, {method: PipelineModel.load(f"{path}/{method}") for method in selection.parameters}


def predict(examples: DataFrame, selection: Selection, model: PipelineModel, method: str = "boosted", horizon: int = 1) -> DataFrame:
    """Probability of activity in the next quarter, for every company with enough history."""
    rows = examples.where((F.col("origin") == selection.trained_through) & (F.col("horizon") == horizon))
    scored = calibrated(predict_with(model, rows), selection, method)
    return scored.select("EMPLOYER_ID", "EMPLOYER_NAME", "origin", "target_quarter", "probability")


def describe_plan(plan: dict) -> dict:
    """The time plan with quarter labels."""
    return {
        name: [number_label(q) for q in value] if isinstance(value, list) else number_label(value)
        for name, value in plan.items()
    }

