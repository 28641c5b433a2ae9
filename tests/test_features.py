import math

import pytest
from pyspark.sql import functions as F

from panelwright.functions.calendar import label_number, number_label
from panelwright.operators import evaluate, features, quality
from panelwright.plans import catalog
from tests import data

ORIGIN = label_number("FY2017_Q2")


def table(df):
    return {(r["EMPLOYER_ID"], r["origin"], r["horizon"]): r.asDict() for r in df.collect()}


def by_hand(rows, entity, t, h):
    """The feature definitions, one company quarter at a time."""
    own = {q: c for e, _, q, c in rows if e == entity}
    quarters = sorted({q for _, _, q, _ in rows})
    m = {q: sum(c for _, _, x, c in rows if x == q) for q in quarters}
    k = {q: sum(c > 0 for _, _, x, c in rows if x == q) for q in quarters}
    past = [own[q] for q in sorted(own) if q <= t]
    market = [m[q] for q in quarters if q <= t]
    n, target = len(past), t + h
    year, market_year = n >= 8, len(market) >= 8
    last4, prev4 = sum(past[-4:]), sum(past[-8:-4])
    m4, p4 = sum(market[-4:]), sum(market[-8:-4])
    same = [c for q, c in own.items() if q <= t and q % 4 == target % 4]
    season = [m[q] for q in quarters if q <= t and q % 4 == target % 4]
    return {
        "history_quarters": n, "history_mean": sum(past) / n, "history_max": max(past),
        "history_active_rate": sum(c > 0 for c in past) / n,
        "cases_recent1": past[-1], "cases_recent2": past[-2], "cases_recent3": past[-3], "cases_recent4": past[-4],
        "cases_last4": last4, "active_last4": sum(c > 0 for c in past[-4:]), "recent_change": past[-1] - past[-2],
        "recent_slope": (1.5 * (past[-1] - past[-4]) + 0.5 * (past[-2] - past[-3])) / 5,
        "cases_previous4": prev4 if year else -1, "has_previous_year": int(year),
        "annual_change": last4 - prev4 if year else 0, "annual_growth": (last4 - prev4) / (prev4 + 1) if year else 0,
        "inactive_quarters": t - max(q for q, c in own.items() if q <= t and c > 0),
        "same_quarter_last_year": own[target - 4], "same_quarter_mean": sum(same) / len(same),
        "same_quarter_active_rate": sum(c > 0 for c in same) / len(same), "same_quarter_observations": len(same),
        "market_recent_cases": m[t], "market_last4_cases": m4,
        "market_quarter_change": (m[t] - m[t - 1]) / (m[t - 1] + 1),
        "market_annual_growth": (m4 - p4) / (p4 + 1) if market_year else 0,
        "market_has_previous_year": int(market_year), "market_active_companies": k[t],
        "market_company_change": (k[t] - k[t - 1]) / (k[t - 1] + 1), "market_season_mean": sum(season) / len(season),
        "company_market_share": last4 / max(m4, 1), "horizon": h,
        **{f"target_q{i + 1}": int(target % 4 == i) for i in range(4)},
    }


def test_features_follow_their_definitions(spark):
    rows = [(e, n, q, int(c)) for e, n, q, c in data.activity_rows(14, 9)]
    start = rows[0][2]
    late = [("firm_late", "LATE", start + t, 2 * (t % 3 == 2)) for t in range(5, 14)]
    rows += late
    found = table(features.build_examples(data.activity(spark, rows)))
    last = max(q for _, _, q, _ in rows)
    lengths = {e: min(q for x, _, q, _ in rows if x == e) for e, *_ in rows}
    expected = {(e, t, h) for e, first in lengths.items() for t in range(first + 3, last + 1) for h in (1, 2)}
    assert set(found) == expected
    outcome = {(e, q): c for e, _, q, c in rows}
    for (entity, t, h), row in found.items():
        hand = by_hand(rows, entity, t, h)
        assert set(hand) == set(features.FEATURES)
        for name, value in hand.items():
            assert row[name] == pytest.approx(value, rel=1e-6, abs=1e-9), (entity, t, h, name)
        ahead = outcome.get((entity, t + h))
        assert row["target_cases"] == ahead
        assert row["target_active"] == (None if ahead is None else float(ahead > 0))


def test_the_future_changes_labels_only(spark):
    rows = [(e, n, q, int(c)) for e, n, q, c in data.activity_rows()]
    before = table(features.build_examples(data.activity(spark, rows), [ORIGIN]))
    edited = [(e, n, q, 999 if q > ORIGIN else c) for e, n, q, c in rows]
    after = table(features.build_examples(data.activity(spark, edited).repartition(3), [ORIGIN]))
    live = table(features.build_examples(data.activity(spark, [r for r in rows if r[2] <= ORIGIN]), [ORIGIN]))
    assert set(before) == set(after) == set(live) and len(before) == 60
    for key, row in before.items():
        for name in features.FEATURES:
            assert row[name] == after[key][name] == live[key][name], name
    assert all(r["target_active"] == 1 for r in after.values())
    assert all(r["target_active"] is None for r in live.values())


def test_short_histories_are_left_out_and_gaps_found(spark):
    rows = [(e, n, q, int(c)) for e, n, q, c in data.activity_rows(18, 5)]
    late = [("firm_late", "LATE", q, 1) for q in (label_number("FY2017_Q3"), label_number("FY2017_Q4"))]
    found = features.build_examples(data.activity(spark, rows + late))
    assert found.where("EMPLOYER_ID = 'firm_late'").count() == 0
    assert found.agg(F.min("history_quarters")).first()[0] == 4
    labels = [(e, n, number_label(q), c) for e, n, q, c in rows if (e, q) != ("firm_01", label_number("FY2014_Q3"))]
    holed = spark.createDataFrame(labels, "EMPLOYER_ID string, EMPLOYER_NAME string, FISCAL_QUARTER string, LCA_CASES long")
    with pytest.raises(ValueError, match="history_gap firm_01"):
        quality.enforce(quality.panel_violations(holed))


def test_splits_never_reach_past_the_origin(spark):
    rows = [(e, n, q, int(c)) for e, n, q, c in data.activity_rows(18, 6)]
    examples = features.build_examples(data.activity(spark, rows)).persist()
    training, evaluation = evaluate.rolling_split(examples, ORIGIN)
    assert training.agg(F.max("target_quarter")).first()[0] == ORIGIN
    assert evaluation.agg(F.min("target_quarter")).first()[0] == ORIGIN + 1
    quality.enforce_splits(examples, [ORIGIN], features.FEATURES)
    last = max(q for _, _, q, _ in rows)
    with pytest.raises(ValueError, match="missing_outcome_quarter"):
        quality.enforce_splits(examples, [last - 1], features.FEATURES)
    broken = examples.withColumn("recent_slope", F.lit(float("nan")).cast("float"))
    with pytest.raises(ValueError, match="nonfinite_feature"):
        quality.enforce_splits(broken, [ORIGIN], features.FEATURES)


def scored(spark, labels, probabilities):
    rows = [("all", "m", float(y), float(p)) for y, p in zip(labels, probabilities)]
    return spark.createDataFrame(rows, "period string, model string, target_active double, probability double")


def test_scores_and_bands(spark):
    row = evaluate.scores(scored(spark, [0, 1], [0.25, 0.75])).first()
    assert row["brier"] == pytest.approx(0.0625) and row["log_loss"] == pytest.approx(-math.log(0.75))
    assert row["roc_auc"] == 1.0 and row["average_precision"] == 1.0
    assert evaluate.scores(scored(spark, [0, 0], [0.1, 0.2])).first()["roc_auc"] is None
    table_ = {r["probability_band"]: r for r in evaluate.reliability(scored(spark, [0, 0, 1, 1], [0, 0.9, 0.99, 1])).collect()}
    assert table_["0–10%"]["rows"] == 1 and table_["90–100%"]["rows"] == 3 and table_[">=99%"]["rows"] == 2
    assert table_["90–100%"]["actual_rate"] == pytest.approx(2 / 3)
    for label, p in ((0.5, 0.2), (1, float("nan")), (0, 1.1)):
        with pytest.raises(ValueError, match="invalid_score"):
            quality.enforce(evaluate.score_violations(scored(spark, [label], [p]), "target_active", "probability"))


def test_ranking_metrics_count_ties_by_brute_force(spark):
    import random

    draw = random.Random(11)
    p = [round(draw.random(), draw.choice([1, 2, 6])) for _ in range(1500)]
    y = [int(draw.random() < 0.2 + v / 2) for v in p]
    row = evaluate.scores(scored(spark, y, p)).first()
    hits, misses = [v for v, t in zip(p, y) if t], [v for v, t in zip(p, y) if not t]
    won = sum((h > m) + 0.5 * (h == m) for h in hits for m in misses)
    assert row["roc_auc"] == pytest.approx(won / (len(hits) * len(misses)))
    precision = sum(hits.count(v) * sum(h >= v for h in hits) / sum(x >= v for x in p) for v in set(hits))
    assert row["average_precision"] == pytest.approx(precision / len(hits))


def test_split_checks_count_examples_that_are_not_stored(spark, monkeypatch):
    stored = []
    keep = catalog.cut_lineage
    monkeypatch.setattr(catalog, "cut_lineage", lambda df: stored.append(df.columns) or keep(df))
    found = {(r["check"], r["split_origin"]): r["violations"] for r in catalog.split_checks(spark, "/root/testdata/sf0.001").collect()}
    assert stored and not any("history_mean" in columns for columns in stored)
    assert len(found) == 16 and sum(violations > 0 for violations in found.values()) == 1  # an unknown outcome quarter


def test_split_violations_of_odd_examples(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, 2, 1.0, 1.0, 0.5), (1, 3, 2.0, 0.0, -3.0), (2, 3, 1.0, 1.0, nan), (2, 4, 2.0, None, inf), (2, 5, 2.0, 7.0, None),
        (None, None, 1.0, 0.0, 1.0), (3, 4, 1.0, 0.0, -inf), (2, 3, 1.0, 1.0, 1e308),
    ]
    df = spark.createDataFrame(rows, "origin int, target_quarter int, horizon double, target_active double, f double")
    found = {r["check"]: r["violations"] for r in quality.split_violations(df, [2], ["f", "horizon"]).collect()}
    assert found == {
        "training_overlaps_origin": 0, "missing_training_rows": 0, "missing_evaluation_rows": 0, "single_training_class": 1,
        "missing_outcome_quarter": 1, "invalid_label": 1, "horizon_mismatch": 1, "nonfinite_feature": 4,
    }
    none = {r["check"]: r["violations"] for r in quality.split_violations(df.where("false"), [2], ["f"]).collect()}
    assert none["missing_training_rows"] == 1 and none["missing_outcome_quarter"] == 2 and none["nonfinite_feature"] == 0
