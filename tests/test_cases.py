import random

import pytest
from pyspark.sql import functions as F

from panelwright.functions.calendar import label_number, quarter_label
from panelwright.operators import cumulative, panel, profile, quality, versions
from tests import data

BOTH = ["repeated_rows", "changed_rows", "h1b_changed_rows", "decision_quarter_changed_rows"]


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_panel_uses_names_and_newest_versions(spark):
    raw = data.versioned(spark)
    quality_row = profile.case_quality(raw, "H-1B").first().asDict()
    assert quality_row == {
        "source_rows": 9, "missing_case_numbers": 0, "unique_cases": 8, "repeated_case_rows": 1,
        "h1b_cases": 7, "h1b_cases_with_company_and_date": 6, "requested_positions": 24,
    }
    built = panel.company_quarters(panel.activity_panel(raw))
    birch = panel.lookup(built, "birch works, inc").select(*built.columns[2:])
    assert rows(birch) == [
        ("FY2019_Q2", 1, 1, None, None, 4, None, None),
        ("FY2019_Q3", 2, 2, 1, 100.0, 5, 1, 25.0),
        ("FY2019_Q4", 0, 0, -2, -100.0, 0, -5, -100.0),
        ("FY2020_Q1", 1, 1, 1, None, 6, 6, None),
    ]
    delta = panel.lookup(built, "Delta Foods")
    assert [r["LCA_CASES"] for r in delta.collect()] == [1, 0, 0, 1]


def test_a_case_revised_out_of_the_class_disappears(spark):
    raw = data.versioned(spark)
    moved = raw.where("CASE_NUMBER = 'P8'").withColumns(
        {"CASE_NUMBER": F.lit(" p1"), "VISA_CLASS": F.lit("H-1B1"), "SOURCE_RELEASE": F.lit("FY2019_Q4")}
    )
    latest = panel.eligible_cases(panel.latest_cases(raw.unionByName(moved), "DECISION_DATE"), "H-1B")
    assert {r["CASE_NUMBER"] for r in latest.collect()} == {"P2", "P3", "P5", "P7", "P8"}


def test_results_do_not_depend_on_row_order(spark):
    raw = data.versioned(spark)
    built = panel.company_quarters(panel.activity_panel(raw))
    again = panel.company_quarters(panel.activity_panel(raw.orderBy(F.rand(7)).repartition(3)))
    assert sorted(map(str, rows(built))) == sorted(map(str, rows(again)))


def test_bad_positions_name_their_case(spark):
    raw = data.versioned(spark).withColumn(
        "TOTAL_WORKER_POSITIONS", F.when(F.col("SOURCE_RELEASE") == "FY2019_Q2", "bad").otherwise("1")
    )
    found = panel.invalid_values(raw, "H-1B")
    assert sorted(r["key"] for r in found.collect()) == ["P1", "P2", "P3"]
    with pytest.raises(ValueError, match="invalid_positions P[123]: bad"):
        quality.enforce(found)
    long = data.versioned(spark).withColumn("TOTAL_WORKER_POSITIONS", F.lit("9" * 19))
    assert panel.invalid_values(long, "H-1B").count() == 8
    with pytest.raises(ValueError, match="Unsupported"):
        panel.with_case_date(raw, "BEGIN_DATE")


def test_source_profile(spark):
    raw = data.profiled(spark)
    cases = versions.canonical_cases(raw)
    counts = versions.revision_counts(cases, versions.source_chunk()).first()
    assert [counts[name] for name in BOTH] == [1, 1, 1, 1]
    assert counts["employer_name_changed_rows"] == 1 and counts["visa_class_changed_rows"] == 0
    latest = profile.latest_class_rows(
        raw, ["CASE_STATUS", "DECISION_DATE", "RECEIVED_DATE", "EMPLOYER_NAME", "TOTAL_WORKER_POSITIONS"], "H-1B"
    )
    assert dict(rows(profile.value_counts(latest, "CASE_STATUS"))) == {"Certified": 2, "Denied": 1, "Withdrawn": 1}
    dates = profile.date_checks(latest).first()
    assert (dates["h1b_unique_cases"], dates["missing_or_invalid_decision_dates"]) == (4, 1)
    assert dict(rows(versions.release_offsets(cases, "DECISION_DATE", "H-1B"))) == {0: 2, 1: 1}
    covered = profile.coverage(panel.with_case_date(cases, "RECEIVED_DATE"), "H-1B")
    assert sum(r["rows"] for r in covered.collect()) == 5
    eligible = panel.eligible_cases(panel.latest_cases(raw, "DECISION_DATE"), "H-1B")
    totals = profile.period_totals(eligible).withColumn("quarter", quarter_label(F.col("quarter")))
    assert sorted(rows(totals)) == [("FY2019_Q2", 2, 4), ("FY2019_Q3", 1, 4)]
    received = panel.eligible_cases(panel.latest_cases(raw, "RECEIVED_DATE"), "H-1B")
    only = label_number("FY2019_Q2")
    assert rows(profile.period_totals(panel.in_window(received, only, only))) == [(only, 3, 10)]


def test_revisions_across_chunks_match_a_plain_scan(spark):
    """A hot case over many chunks, exact copies, ties of null and empty, against a plain loop."""
    draw = random.Random(3)
    landed = []
    for at in range(600):
        case = "HOT" if at % 3 == 0 else f"K{draw.randrange(60)}"
        landed.append((
            case, draw.choice(["x", "", None]), draw.choice(["H-1B", "E-3"]),
            draw.choice(["2023-12-31", "2024-01-01", "bad", None]), "2023-10-01", "N", "1",
            f"FY2024_Q{1 + at // 200}", at + 2,
        ))
    df = spark.createDataFrame(landed, data.LANDED).repartition(5)
    order = lambda r: (r[7], r[8])
    before, expected = {}, dict.fromkeys(BOTH + ["visa_class_changed_rows"], 0)
    season = {"2023-12-31": 1, "2024-01-01": 2}
    for row in sorted(landed, key=order):
        last = before.get(row[0])
        before[row[0]] = row
        if last is None:
            continue
        changed = any((row[i] or "") != (last[i] or "") for i in (1, 2, 3))
        expected["repeated_rows"] += 1
        expected["changed_rows"] += changed
        expected["h1b_changed_rows"] += changed and row[2] == "H-1B"
        expected["decision_quarter_changed_rows"] += season.get(row[3]) != season.get(last[3])
        expected["visa_class_changed_rows"] += row[2] != last[2]
    blocks = [F.col("SOURCE_RELEASE"), F.floor(F.col("SOURCE_ROW_NUMBER") / 50), F.floor(F.col("SOURCE_ROW_NUMBER") / 5)]
    for chunk, unique, levels in (
        (versions.source_chunk(7), True, ()), (versions.source_chunk(100), False, ()), (blocks, True, (2, 1)),
    ):
        cases = versions.canonical_cases(df)
        found = versions.revision_counts(cases, chunk, unique_order=unique, levels=levels).first().asDict()
        assert {name: found[name] for name in expected} == expected


def test_company_profile_pairs_never_jump(spark):
    built = data.quarters(spark)
    summary = profile.panel_summary(built).first()
    assert (summary["company_quarter_rows"], summary["lca_cases"], summary["requested_positions"]) == (7, 12, 21)
    overview = profile.period_overview(built).orderBy("quarter").collect()
    assert [r["KNOWN_COMPANIES"] for r in overview] == [1, 1, 1, 2, 2]
    first = profile.first_n_activity(built).collect()
    assert [(r["active_quarters"], r["companies"], r["zero_case_percent"], r["single_active_quarter_company_percent"]) for r in first] == [(3, 1, 25.0, 0.0)]
    assert rows(profile.next_quarter_outcomes(built)) == [(4, 1, 1, 1, 0)]
    jumped = data.quarters(spark, ("X", "FY2021_Q1", 1, 1, 1))
    assert rows(profile.next_quarter_outcomes(jumped)) == [(4, 1, 1, 1, 0)]
    rates = {r["quarter"]: r for r in profile.transition_rates(jumped).collect()}
    late = rates[label_number("FY2021_Q1")]
    assert late["PREVIOUSLY_ACTIVE_COMPANIES"] == 0 and late["PREVIOUSLY_ACTIVE_RATE_PERCENT"] is None


def test_transition_rates_are_null_without_pairs(spark):
    built = data.quarters(spark, ("X", "FY2020_Q4", 4, 4, 4))
    assert rows(profile.next_quarter_outcomes(built)) == [(4, 2, 1, 1, 1)]
    rates = {r["quarter"]: r for r in profile.quarter_table(built).collect()}
    q3, q4 = rates[label_number("FY2020_Q3")], rates[label_number("FY2020_Q4")]
    assert (q3["PREVIOUSLY_ACTIVE_RATE_PERCENT"], q3["PREVIOUSLY_INACTIVE_RATE_PERCENT"]) == (0.0, None)
    assert (q4["PREVIOUSLY_ACTIVE_RATE_PERCENT"], q4["PREVIOUSLY_INACTIVE_RATE_PERCENT"]) == (None, 100.0)
    assert len(rates) == 6


def test_totals_must_match_the_source_both_ways(spark):
    built = data.quarters(spark)
    totals = built.groupBy("quarter").agg(F.sum("LCA_CASES").alias("LCA_CASES"), F.sum("REQUESTED_POSITIONS").alias("REQUESTED_POSITIONS"))
    assert not profile.check_totals(built, totals).take(1)
    gone = totals.where(F.col("quarter") != label_number("FY2020_Q1"))
    with pytest.raises(ValueError, match="no_source_records"):
        quality.enforce(profile.check_totals(built, gone))
    off = totals.withColumn("REQUESTED_POSITIONS", F.col("REQUESTED_POSITIONS") + 1)
    with pytest.raises(ValueError, match="totals_differ"):
        quality.enforce(profile.check_totals(built, off))
    extra = totals.unionByName(totals.limit(1).withColumn("quarter", F.lit(1)))
    assert profile.check_totals(built, extra).count() == 1


def test_distribution_is_the_linear_quantile(spark):
    import pandas as pd

    draw = random.Random(5)
    for values in ([7.0], [1.0, 2.0], [draw.choice([3, 3, 3, draw.randrange(-500, 9000)]) * 1.0 for _ in range(3000)]):
        df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double")
        found = cumulative.distribution(df, "v").first()
        series = pd.Series(values)
        assert found["mean"] == pytest.approx(series.mean())
        for name, q in cumulative.QUANTILES.items():
            assert found[name] == pytest.approx(series.quantile(q)), name


def test_no_values_have_no_distribution(spark):
    for content in ([], [(None,)]):
        found = cumulative.distribution(spark.createDataFrame(content, "v double"), "v").collect()
        assert len(found) == 1 and set(found[0]) == {None}


def test_panel_gates(spark):
    labeled = "EMPLOYER_ID string, EMPLOYER_NAME string, FISCAL_QUARTER string, LCA_CASES double"
    good = [("a", "A", "FY2024_Q1", 1.0), ("a", "A", "FY2024_Q2", 0.0), ("b", "B", "FY2024_Q2", 2.0)]
    assert not quality.panel_violations(spark.createDataFrame(good, labeled)).take(1)
    bad = {
        "duplicate_key": [*good, good[0]],
        "missing_value": [*good, ("c", None, "FY2024_Q2", 1.0)],
        "invalid_quarter": [*good, ("c", "C", "2024Q1", 1.0)],
        "invalid_count": [*good, ("c", "C", "FY2024_Q2", 1.5)],
        "name_conflict": [("a", "A", "FY2024_Q1", 1.0), ("a", "Z", "FY2024_Q2", 1.0)],
        "missing_market_quarter": [("a", "A", "FY2024_Q1", 1.0), ("a", "A", "FY2024_Q3", 1.0)],
        "history_gap": [*good, ("c", "C", "FY2024_Q1", 1.0)],
        "history_without_start": [*good, ("c", "C", "FY2024_Q2", 0.0)],
    }
    for check, content in bad.items():
        with pytest.raises(ValueError, match=check):
            quality.enforce(quality.panel_violations(spark.createDataFrame(content, labeled)), shown=50)
