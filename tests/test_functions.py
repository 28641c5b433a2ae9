import unicodedata

import pytest
from pyspark.sql import functions as F

from panelwright.functions.calendar import fiscal_quarter_index, iso_date, label_number, quarter_label, quarter_number
from panelwright.functions.numeric import log_odds, pct, round_binary
from panelwright.functions.text import (
    case_key, company_id, has_text, location, name_table, text_differs,
)


def column(spark, values, expression, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in rows.orderBy("i").select(expression(F.col("v"))).collect()]


def test_fiscal_quarters_change_in_october(spark):
    days = ["2023-09-30", "2023-10-01", "2024-01-01", "2024-06-30T00:00:00", "2023-1-5", "2023", "bad", "", None]
    labels = column(spark, days, lambda v: quarter_label(fiscal_quarter_index(iso_date(v))))
    assert labels == ["FY2023_Q4", "FY2024_Q1", "FY2024_Q2", "FY2024_Q3", None, None, None, None, None]
    assert column(spark, ["FY2024_Q1", "FY2024_Q5", "x"], quarter_number) == [label_number("FY2024_Q1"), None, None]


def test_keys_lose_every_kind_of_blank(spark):
    values = [" a1 ", " b\t\n", "　\x1c", "", None, "c d"]
    assert column(spark, values, case_key) == ["A1", "B", "", "", None, "C D"]
    assert column(spark, values, has_text) == [True, True, False, False, False, True]


def test_names_are_composed_collapsed_and_undotted(spark):
    values = [
        "Acme, LLC", "ACME  LLC", "acme l.l.c.", "Other Inc", "Other, Inc.", "Ａcme　Corp.", "Café Ltd.",
        "Incorporated", "Straße L.L.P", " ", "x\ty",
    ]
    table = name_table(spark.createDataFrame([(v,) for v in values], "v string"), "v")
    found = {r["v"]: r["normalized_name"] for r in table.collect()}
    assert [found[v] for v in values] == [
        "ACME LLC", "ACME LLC", "ACME LLC", "OTHER INC", "OTHER INC", "ACME CORP",
        unicodedata.normalize("NFKC", "CAFÉ") + " LTD", "INCORPORATED", "STRASSE LLP", None, "X Y",
    ]
    ids = {r["normalized_name"]: r["entity_id"] for r in table.collect()}
    assert ids["ACME LLC"] == spark.range(1).select(company_id(" acme, l.l.c. ")).first()[0]
    assert len(ids["ACME LLC"]) == 28
    with pytest.raises(ValueError, match="empty"):
        company_id(" 　")


def test_locations_compare_state_names_and_short_postals(spark):
    rows = [("New York ", "new york", "501"), (None, "CA", " 9410A "), ("Ur", "ELSEWHERE", "12345-1")]
    df = spark.createDataFrame(rows, "c string, s string, p string")
    found = [tuple(r[0]) for r in df.select(location(F.col("c"), F.col("s"), F.col("p"))).collect()]
    assert found == [("NEW YORK", "NY", "00501"), ("", "CA", "9410A"), ("UR", "ELSEWHERE", "12345-1")]


def test_text_differs_treats_null_as_empty(spark):
    rows = spark.createDataFrame([(None, ""), ("a", None), ("a", "a")], "a string, b string")
    assert [r[0] for r in rows.select(text_differs(F.col("a"), F.col("b"))).collect()] == [False, True, False]


def test_rounding_follows_the_stored_value(spark):
    values = [2.675, 0.025, 3.125, -2.675, -33.335, 0.005, 233.3333333, 12.345, 1234567.125, 0.125, 0.375, 1e-9, 0.0, 99.995]
    values += [(-1) ** i * (i * 7919 % 100003) / (i % 977 + 1) for i in range(2000)]
    values += [i / 1000 for i in range(5, 4000, 10)]
    assert column(spark, values, round_binary, "double") == [round(v, 2) for v in values]
    pairs = spark.createDataFrame([(2, 3), (1, 0), (1, 4000)], "a int, b int")
    assert [r[0] for r in pairs.select(pct(F.col("a"), F.col("b"))).collect()] == [66.67, None, round(0.025, 2)]


def test_log_odds_are_clipped(spark):
    odds = column(spark, [0.0, 0.5, 1.0], log_odds, "double")
    assert odds[1] == 0 and odds[0] == pytest.approx(-13.8155, abs=1e-3) and odds[2] == pytest.approx(13.8155, abs=1e-3)
