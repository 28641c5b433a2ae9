"""Every registered query against its SQL at the smallest scale."""

import warnings
from pathlib import Path

import pyarrow.parquet as pq
import pytest

from pyspark.sql import functions as F

import __spark_entry__ as entry
from panelwright.plans import catalog, oracle
from tests.check_queries import connect, difference

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    warnings.simplefilter("ignore")
    return connect(FOLDER)


@pytest.fixture(scope="module")
def shifted(spark, tmp_path_factory):
    """The same tables with a tenth of the orders moved two years later."""
    folder = tmp_path_factory.mktemp("shifted")
    for path in Path(FOLDER).glob("*.parquet"):
        if path.stem in ("lineitem", "customer", "supplier", "nation", "region"):
            (folder / path.name).symlink_to(path)
    orders = spark.read.parquet(f"{FOLDER}/orders.parquet")
    later = F.when(F.col("o_orderkey") % 10 == 0, F.col("o_orderdate") + F.expr("INTERVAL 2 YEARS")).otherwise(F.col("o_orderdate"))
    moved = orders.withColumn("o_orderdate", later.cast(orders.schema["o_orderdate"].dataType))
    pq.write_table(moved.toArrow(), str(folder / "orders.parquet"))
    return str(folder)


# Queries whose result reaches to the last quarter that the orders have.
TO_THE_END = (
    "reconcile_totals", "quarter_overview", "panel_summary", "first_four_activity", "transition_rates", "next_quarter_outcomes",
    "company_features", "season_features", "market_features", "labeled_examples", "rolling_split_sizes", "split_checks",
    "baseline_scores", "reliability_bands", "empty_quarters", "dense_panel", "quarterly_change",
)


@pytest.mark.parametrize("name", TO_THE_END)
def test_later_quarters_are_kept(spark, shifted, name):
    warnings.simplefilter("ignore")
    assert difference(catalog.REGISTRY[name](spark, shifted), connect(shifted), name) == ""


def test_every_query_has_its_sql():
    assert set(catalog.REGISTRY) == set(oracle.statements())
    assert set(catalog.REGISTRY) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(catalog.REGISTRY))
def test_query_equals_its_sql(spark, con, name):
    built = entry.queries()[name](spark, FOLDER)
    plan = built._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert difference(built, con, name) == ""


def test_entry_has_rows(spark):
    assert entry.entry(spark).take(1)
