import random

import pytest
from pyspark.sql import functions as F

from panelwright.functions.calendar import label_number, number_label
from panelwright.operators import backtest, boosting, model
from panelwright.operators.features import FEATURES
from panelwright.plans import refresh
from panelwright.sources import ledger as store
from tests import data
from tests.test_ingest import HEADERS, land

SMALL = {
    "random_forest": [{"trees": 8, "depth": 3, "leaf": 2}],
    "boosted": [{"trees": 4, "depth": 2, "rate": 0.1, "leaf": 2}],
}


def test_early_stopping_waits_for_its_patience():
    assert boosting.kept_trees([3.0, 2.0, 2.5, 1.9, 2.0], 40) == 4
    falling_late = [1.0, 0.5] + [0.6] * 45 + [0.1]
    assert boosting.kept_trees(falling_late, 40) == 2
    assert boosting.kept_trees(falling_late, 60) == len(falling_late)
    losses = [
        {"method": "boosted", "candidate": c, "trees": t, "log_loss": x}
        for c, t, x in ((0, 10, 0.5), (0, 30, 0.7), (1, 20, 0.55), (1, 41, 0.5))
    ]
    assert model.best_candidate(losses, "boosted", [{"rate": 1}, {"rate": 2}]) == {"rate": 2, "trees": 30}


def test_time_plan_keeps_every_step_behind_the_next():
    plan = model.time_plan(label_number("FY2026_Q3"))
    assert model.describe_plan(plan) == {
        "tuning_origins": ["FY2024_Q1", "FY2024_Q3"], "calibration_origin": "FY2025_Q1",
        "selection_origin": "FY2025_Q3", "evaluation_origin": "FY2026_Q1",
    }


def test_trends_only_move_the_probability_their_way(spark):
    draw, rows = random.Random(9), []
    for i in range(1500):
        values = {name: draw.gauss(0, 1) for name in FEATURES} | {"inactive_quarters": draw.randrange(8)}
        score = 2 * values["recent_slope"] - 0.8 * values["inactive_quarters"] + 2
        label = float(draw.random() < 1 / (1 + 2.718281828 ** -score))
        rows.append((f"r{i}", 10 + i % 4, label, *[float(values[n]) for n in FEATURES]))
    schema = "EMPLOYER_ID string, target_quarter int, target_active double, " + ", ".join(f"{n} float" for n in FEATURES)
    frame = spark.createDataFrame(rows, schema).persist()
    fitted = model.fit("boosted", {"trees": 30, "depth": 3, "rate": 0.2}, frame)
    report = {r["feature"]: r for r in backtest.monotonicity_audit(fitted, frame).collect()}
    assert set(report) == set(model.TRENDS) and sum(r["violations"] for r in report.values()) == 0
    assert report["recent_slope"]["rows"] == 512 and report["recent_slope"]["comparisons"] == 512 * 8
    assert report["recent_slope"]["rows_with_change"] > 0 and report["inactive_quarters"]["rows_with_change"] > 0
    spread = model.predict_with(fitted, frame).agg(F.max("probability") - F.min("probability")).first()[0]
    assert spread > 0.2


def test_calibration_is_a_penalised_line_over_log_odds(spark):
    import numpy as np

    draw = random.Random(4)
    p = [draw.uniform(0.01, 0.99) for _ in range(400)]
    y = [float(draw.random() < v**2) for v in p]
    slope, intercept = model.fit_calibration(spark.createDataFrame(list(zip(y, p)), "target_active double, probability double"))
    x, t, w = np.log(np.array(p) / (1 - np.array(p))), np.array(y), np.zeros(2)
    for _ in range(50):  # Newton steps of the same penalised likelihood
        q = 1 / (1 + np.exp(-(w[0] * x + w[1])))
        gradient = np.array([((q - t) * x).sum() + w[0], (q - t).sum()])
        hessian = np.array([[(q * (1 - q) * x * x).sum() + 1, (q * (1 - q) * x).sum()], [(q * (1 - q) * x).sum(), (q * (1 - q)).sum()]])
        w -= np.linalg.solve(hessian, gradient)
    assert (slope, intercept) == pytest.approx(tuple(w), abs=1e-4)


def test_landed_quarters_to_models_and_forecast(spark, tmp_path):
    raw, root = tmp_path / "raw", str(tmp_path / "stored")
    headers = (*HEADERS, "TOTAL_WORKER_POSITIONS")
    rows = [(e, n, q, int(c)) for e, n, q, c in data.activity_rows(19, 12)]
    last = max(r[2] for r in rows)
    for quarter in sorted({r[2] for r in rows}):
        label = number_label(quarter)
        year, part = int(label[2:6]), int(label[-1])
        day = f"{year - (part == 1)}-{(10, 1, 4, 7)[part - 1]:02d}-05"
        cases = [
            (f"{label}-{e}", "Certified", day, day, "", "H-1B", n, "15-2051", "X", "NY", "1", 1)
            for e, n, q, c in rows if q == quarter and c
        ]
        land(raw, label, cases, headers)
    result = refresh.refresh(spark, str(raw), root, SMALL)
    assert result == {"trained_through": number_label(last), "target_quarter": number_label(last + 1)}

    examples = store.read_output(spark, root, "examples")
    selection = refresh.train(spark, root, SMALL)  # current, so loaded and not fitted again
    assert selection.trained_through == last and selection.version == refresh.model_version(spark, root)
    assert selection.training_rows == examples.where("target_active is not null").count()
    assert store.output_ledger(spark, root).where("name = 'models'").first()["seq"] < 99

    forecasts = refresh.predictions(spark, root).collect()
    assert len(forecasts) == 12 and all(0 <= r["probability"] <= 1 for r in forecasts)
    history, one = refresh.predict_company(spark, root, "firm 0")
    assert history.count() == 19 and one.first()["target_quarter"] == number_label(last + 1)
    with pytest.raises(ValueError, match="No H-1B"):
        refresh.predict_company(spark, root, "missing")

    tested = refresh.backtest_models(spark, root)
    found = tested["predictions"].collect()
    assert len(found) == 24 and {r["target_quarter"] for r in found} == {last - 1, last}
    assert tested["metrics"].count() == 15 and tested["reliability"].select("model").distinct().count() == 5
    assert {r["feature"] for r in tested["trends"].collect()} == set(model.TRENDS)
    assert store.is_current(spark, root, "trend_audit", selection.version)

    profiles = refresh.company_profile(spark, root) | refresh.source_profile(spark, root)
    assert profiles["summary"].first()["companies"] == 12
    assert profiles["missing_keys"].first()[0] == 0 and profiles["totals"].count() == 19
    refresh.write_profile(spark, root, str(tmp_path / "profile"))
    written = spark.read.option("header", "true").csv(str(tmp_path / "profile" / "quarters"))
    assert written.count() == 19 and written.where("quarter = 'FY2013_Q3'").first()["PREVIOUSLY_ACTIVE_RATE_PERCENT"] is None
    assert refresh.decision_panel(spark, root).where("LCA_CASES > 0").count() == sum(r[3] > 0 for r in rows)

    revised = [("X1", "Certified", "2018-01-09", "2018-01-09", "", "H-1B", "FIRM 1", "15-2051", "X", "NY", "1", 1)]
    land(raw, number_label(last), revised, headers)
    refresh.ingest(spark, str(raw), root)
    with pytest.raises(ValueError, match="retrain"):
        refresh.predictions(spark, root)
    with pytest.raises(ValueError, match="empty_quarter"):
        refresh.receipt_panel(spark, root)
