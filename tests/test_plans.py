"""What the planner makes of the operators: shuffles, pruning, pushdown."""

import re

from pyspark.sql import functions as F

from panelwright.functions.calendar import label_number
from panelwright.operators import features, links, panel, versions
from panelwright.session import cut_lineage
from panelwright.sources import orders as src
from tests import data

SMALL = "/root/testdata/sf0.001"


def plan(df, final=False):
    """The physical plan; the adaptive one after a run if ``final``."""
    execution = df._jdf.queryExecution()
    if final:
        df.collect()
    text = execution.executedPlan().toString()
    return text.split("== Initial Plan ==")[0] if final else text


def exchanges(text):
    return re.findall(r"(?<!Reused)Exchange hashpartitioning\(([^)]*)\)", text)


def test_company_windows_share_one_shuffle(spark):
    rows = cut_lineage(data.activity(spark, [(e, n, q, int(c)) for e, n, q, c in data.activity_rows(10, 4)]))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(features.season_features(features.company_features(features.with_outcomes(rows))))
        assert len(exchanges(text)) == 1 and text.count("Sort [") == 1
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_cases_reach_the_panel_in_map_side_combined_shuffles(spark):
    raw = cut_lineage(data.versioned(spark))
    cases = panel.eligible_cases(panel.latest_cases(raw, "DECISION_DATE"), "H-1B")
    main = plan(panel.dense_panel(panel.rollup_cases(cases), last=label_number("FY2020_Q1")))
    # Case, spelling and quarter, company and quarter, company.
    assert len(exchanges(main)) == 4
    assert main.count("partial_max(struct") >= 1 and main.count("partial_count") >= 1 and main.count("partial_sum") >= 1
    assert main.count("ArrowEvalPython") == 1


def test_the_last_quarter_does_not_run_the_cases_again(spark):
    raw = cut_lineage(data.versioned(spark))
    text = plan(panel.activity_panel(raw))
    assert len(exchanges(text)) == 1 and "ArrowEvalPython" not in text


def test_scans_read_only_their_columns_and_filters_reach_them(spark, tmp_path):
    text = plan(versions.cross_release_duplicates(src.line_cases(spark, SMALL)))
    assert set(re.search(r"ReadSchema: struct<([^>]*)>", text)[1].split(",")) == {
        "l_orderkey:bigint", "l_linenumber:int", "l_shipdate:timestamp_ntz"
    }
    stored = str(tmp_path / "panel")
    built = panel.company_quarters(panel.activity_panel(data.versioned(spark)))
    built.sortWithinPartitions("EMPLOYER_ID").write.parquet(stored)
    text = plan(panel.lookup(spark.read.parquet(stored), "Birch Works Inc"))
    assert re.search(r"PushedFilters: \[.*EqualTo\(EMPLOYER_ID,emp_[0-9a-f]{24}\)", text)


def test_a_hot_case_leaves_each_map_task_as_one_row(spark):
    rows = spark.range(20000).select(
        F.when(F.col("id") % 3 == 0, "HOT").otherwise(F.col("id").cast("string")).alias("CASE_NUMBER"),
        F.lit("FY2024_Q1").alias("SOURCE_RELEASE"),
        F.col("id").alias("SOURCE_ROW_NUMBER"),
    )
    picked = versions.latest_version(rows)
    assert "partial_max(struct" in plan(picked)
    hot = picked.where("CASE_NUMBER = 'HOT'").first()
    assert hot["SOURCE_ROW_NUMBER"] == 19998 and picked.count() == 13334


def test_links_meet_in_one_grouping_by_case(spark):
    parents, children = src.keys_only(spark, SMALL)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for build in (links.orphans, links.linked_elsewhere):
            text = plan(build(children, parents))
            # Worksite rows of a release and case, all rows of a case, figures of a release.
            assert len(exchanges(text)) == 3 and "Join" not in text
            assert sum("SOURCE_RELEASE" not in keys and "CASE_NUMBER" in keys for keys in exchanges(text)) == 1
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_single_versions_leave_before_rows_are_compared(spark):
    raw = spark.range(30000).select(
        F.when(F.col("id") % 3 == 0, "HOT").otherwise(F.col("id").cast("string")).alias("CASE_NUMBER"),
        F.lit("FY2024_Q1").alias("SOURCE_RELEASE"),
        F.col("id").alias("SOURCE_ROW_NUMBER"),
        F.lit("A").alias("VISA_CLASS"),
        F.lit("2023-11-01").alias("DECISION_DATE"),
    )
    keys = raw.select("CASE_NUMBER")
    kept = versions._of_repeated_keys(raw, "CASE_NUMBER", keys, versions.ORDER)
    assert kept.columns == raw.columns and kept.count() == 10000
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        held = kept.groupBy(F.spark_partition_id()).count().collect()
        assert len(held) > 1 and max(r["count"] for r in held) < 10000
        counts = versions.revision_counts(raw, versions.source_chunk(500), keys=keys)
        text = plan(counts)
        # The count of the keys, both sides of the lookup, chunks of a key, the key itself.
        assert len(exchanges(text)) == 5 and "LeftSemi" in text
        assert counts.first()["repeated_rows"] == 9999
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_null_keys_are_compared_as_one_key(spark):
    raw = spark.createDataFrame(
        [(None, "FY2024_Q1", 2, "A"), (None, "FY2024_Q1", 3, "B"), ("K", "FY2024_Q1", 4, "A")],
        "CASE_NUMBER string, SOURCE_RELEASE string, SOURCE_ROW_NUMBER long, VISA_CLASS string",
    ).withColumn("DECISION_DATE", F.lit("2023-11-01"))
    found = versions.revision_counts(raw, versions.source_chunk()).first()
    assert (found["repeated_rows"], found["visa_class_changed_rows"]) == (1, 1)
