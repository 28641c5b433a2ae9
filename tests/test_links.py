from pyspark.sql import functions as F

from panelwright.operators import links, profile, versions

MAIN = (
    "CASE_NUMBER string, CASE_STATUS string, DECISION_DATE string, VISA_CLASS string, EMPLOYER_NAME string, "
    "SOC_CODE string, WORKSITE_CITY string, WORKSITE_STATE string, WORKSITE_POSTAL_CODE string, "
    "SOURCE_RELEASE string, SOURCE_ROW_NUMBER long"
)
MAINS = [
    ("K1", "Certified", "2018-07-11", "H-1B", "Ash", "11-1021", "Austin", "TX", "73301", "FY2018_Q4", 2),
    ("K2", "Denied", None, "H-1B", "Beech", None, "Salem", "OR", "97301", "FY2018_Q4", 3),
    ("K3", "Certified", "2018-08-20", "H-1B1", "Ash", "13-2011", "Reno", "NV", "89501", "FY2018_Q4", 4),
    ("K3", "Certified", "2018-08-20", "H-1B1", "Ash", "13-2011", "Reno", "NV", "89501", "FY2018_Q4", 5),
    ("K2", "Certified", "2018-11-06", "H-1B", "Beech", "11-1021", "Salem", "OR", "97301", "FY2019_Q1", 2),
    ("K4", "Certified", "2018-12-12", "H-1B", "Cork", "15-1132", "Boise", "ID", "83701", "FY2019_Q1", 3),
    ("K5", "Withdrawn", "2019-02-05", "H-1B", "Ash", "15-1132", "Austin", "TX", "73301", "FY2019_Q2", 2),
]
# K2 twice and K4 belong to a main row of the year, K1 to one of the year before, K9 to none.
SITES = [
    ("K2", "Salem", "OREGON", "97301", "FY2019_Q1"),
    ("K2", "Portland", "OREGON", "97201", "FY2019_Q1"),
    ("K4", "Nampa", "IDAHO", "83651", "FY2019_Q1"),
    ("K1", "Austin", "TEXAS", "73301", "FY2019_Q1"),
    ("K9", "Boise", "IDAHO", "83701", "FY2019_Q1"),
]


def tables(spark, more=()):
    sites = "CASE_NUMBER string, WORKSITE_CITY string, WORKSITE_STATE string, WORKSITE_POSTAL_CODE string, SOURCE_RELEASE string"
    return spark.createDataFrame(MAINS, MAIN), spark.createDataFrame([*SITES, *more], sites)


def test_release_quality(spark):
    main, _ = tables(spark)
    found = {r["SOURCE_RELEASE"]: r for r in profile.release_quality(main, "H-1B", "2018-07-01").collect()}
    first, second = found["FY2018_Q4"], found["FY2019_Q1"]
    assert (first["source_rows"], first["duplicate_case_number_rows"], first["unique_case_numbers"]) == (4, 1, 3)
    assert (first["h1b_rows"], first["h1b_rows_since_start"]) == (2, 1)
    assert (first["h1b_missing_decision_date"], first["h1b_missing_soc_code"]) == (1, 1)
    assert str(first["decision_date_max"]) == "2018-08-20" and str(second["decision_date_min"]) == "2018-11-06"
    maps = {r["SOURCE_RELEASE"]: r for r in profile.release_value_maps(main).collect()}
    assert maps["FY2018_Q4"]["visa_class_counts"] == {"H-1B": 2, "H-1B1": 2}
    assert maps["FY2018_Q4"]["h1b_case_status_counts"] == {"Certified": 1, "Denied": 1}


def test_release_quality_deals_cases_by_their_number(spark, monkeypatch, capsys):
    monkeypatch.setattr(profile, "TASK_ROWS", 10)
    keys = [None, "", *[f"K{i % 150}" for i in range(200)], *["HOT"] * 98]
    rows = [(key, "2020-01-01" if i % 3 else "", "H-1B", "Ash" if i % 5 else None, "R1" if i % 2 else "R2") for i, key in enumerate(keys * 2)]
    df = spark.createDataFrame(rows, "CASE_NUMBER string, DECISION_DATE string, VISA_CLASS string, EMPLOYER_NAME string, SOURCE_RELEASE string")
    quality = profile.release_quality(df, rows=len(rows))
    quality.explain()
    assert ", 60), REPARTITION_BY_NUM" in capsys.readouterr().out  # ten rows a task
    for name in ("R1", "R2"):
        inside = [r for r in rows if r[4] == name]
        known = [r[0] for r in inside if r[0]]
        found = quality.where(F.col("SOURCE_RELEASE") == name).first()
        assert found["source_rows"] == found["h1b_rows"] == len(inside)
        assert found["missing_case_number"] == len(inside) - len(known) and found["unique_case_numbers"] == len(set(known))
        assert found["duplicate_case_number_rows"] == len(known) - len(set(known))
        assert found["missing_decision_date"] == sum(not r[1] for r in inside)
        assert found["h1b_missing_employer_name"] == sum(r[3] is None for r in inside) and found["h1b_missing_soc_code"] == 0


def test_repeats_across_releases(spark):
    main, _ = tables(spark)
    assert tuple(versions.cross_release_duplicates(main).first()) == (1, 1)
    assert [tuple(r) for r in versions.release_overlaps(main).collect()] == [("FY2018_Q4", "FY2019_Q1", 1)]


def test_worksite_links(spark):
    main, sites = tables(spark)
    same = links.same_year_links(sites, main).first()
    assert same["source_rows"] == 5 and same["worksite_rows_without_same_year_main"] == 2
    assert same["unique_main_case_numbers"] == 3 and same["main_cases_with_same_year_worksite_row"] == 2
    assert same["same_year_main_to_worksite_match_pct"] == 66.67
    assert same["same_year_worksite_to_main_match_pct"] == 60.0
    assert tuple(links.multi_child_keys(sites).first()) == ("FY2019_Q1", 4, 1)
    assert tuple(links.location_match(links.link_children(sites, main)).first()) == ("FY2019_Q1", 2, 1, 50.0)
    assert tuple(links.linked_elsewhere(sites, main).first()) == ("FY2019_Q1", 1)
    assert tuple(links.orphans(sites, main).first()) == ("FY2019_Q1", 2, 1, 1)
    total = links.global_case_links(sites, main).first()
    assert total["main_cases_without_any_worksite_row"] == 2
    assert total["worksite_cases_without_any_selected_main"] == 1
    by_year = {r["fiscal_year"]: tuple(r)[1:] for r in links.case_links_by_year(sites, main).collect()}
    assert by_year == {"FY2018": (3, 2, 1, 66.67), "FY2019": (3, 2, 1, 66.67)}


def test_rows_without_a_case_leave_the_shares_alone(spark):
    release = "FY2019_Q1"
    main, sites = tables(spark, [("", "X", "Y", "Z", release), (None, "X", "Y", "Z", release), ("Z", "X", "Y", "Z", release)])
    same = links.same_year_links(sites, main).first()
    assert (same["source_rows"], same["missing_case_number"]) == (8, 2)
    assert same["same_year_worksite_to_main_match_pct"] == 50.0
    assert tuple(links.orphans(sites, main).first()) == (release, 3, 3, 3)


def test_a_case_holding_a_third_of_the_rows_counts_like_any_other(spark):
    """Hot and missing keys against plain sets."""
    import random
    from collections import Counter

    draw = random.Random(8)

    def case():
        return draw.choice(["HOT", None, "", f"K{draw.randrange(80)}", f"K{draw.randrange(80)}"])

    releases = ["FY2022_Q1", "FY2022_Q3", "FY2023_Q2"]
    main = [(case(), draw.choice(releases)) for _ in range(300)]
    sites = [("HOT" if i % 3 else case(), draw.choice(releases)) for i in range(1200)]
    schema = "CASE_NUMBER string, SOURCE_RELEASE string"
    parents, children = spark.createDataFrame(main, schema), spark.createDataFrame(sites, schema).repartition(4)

    years = {}
    for c, r in main:
        if c is not None:
            years.setdefault(c, set()).add(r[:6])
    same = {r["SOURCE_RELEASE"]: r for r in links.same_year_links(children, parents).collect()}
    lost = {r["SOURCE_RELEASE"]: r for r in links.orphans(children, parents).collect()}
    moved = {r["SOURCE_RELEASE"]: r[1] for r in links.linked_elsewhere(children, parents).collect()}
    for release in releases:
        rows = [c for c, r in sites if r == release]
        counts = Counter(c for c in rows if c)
        here = {c for c in counts if release[:6] in years.get(c, ())}
        mains = sum(release[:6] in y for c, y in years.items() if c)
        found = same[release]
        assert found["source_rows"] == len(rows) and found["missing_case_number"] == sum(not c for c in rows)
        assert found["main_cases_with_same_year_worksite_row"] == len(here)
        assert found["worksite_rows_matching_main"] == sum(counts[c] for c in here)
        assert found["unique_main_case_numbers"] == mains
        audited = Counter(c for c in rows if c is not None)
        gone = {c for c in audited if c not in years}
        assert tuple(lost[release])[1:] == (
            sum(n for c, n in counts.items() if c not in here), len(gone), sum(audited[c] for c in gone)
        )
        assert moved.get(release, 0) == sum(c in years and release[:6] not in years[c] for c in audited)
    overlaps = {(r["left"], r["right"]): r["shared_case_numbers"] for r in versions.release_overlaps(parents).collect()}
    held = {r: {c for c, x in main if x == r and c is not None} for r in releases}
    assert overlaps == {(a, b): len(held[a] & held[b]) for a in releases for b in releases if a < b}
