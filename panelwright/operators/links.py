"""Links between main cases (parents) and worksite rows (children), per release and overall.

Both sides are reduced to distinct keys before they meet, so a key with very many rows is one row on
each side of every join."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.functions.calendar import fiscal_year
from panelwright.functions.numeric import pct
from panelwright.functions.text import is_full_location, location
from panelwright.operators.versions import first_version

PLACE = ("WORKSITE_CITY", "WORKSITE_STATE", "WORKSITE_POSTAL_CODE")


def _with_year(df: DataFrame) -> DataFrame:
    return df.withColumn("fiscal_year", fiscal_year(F.col("SOURCE_RELEASE")))


def _keyed(df: DataFrame, empty: bool = False) -> DataFrame:
    """Rows with a case number. The release counters take empty text for missing; the audit over
    all releases does not (``empty=True``)."""
    known = F.col("CASE_NUMBER").isNotNull()
    return _with_year(df.where(known if empty else known & (F.col("CASE_NUMBER") != "")))


def release_locations(parents: DataFrame, order_by: str = "SOURCE_ROW_NUMBER") -> DataFrame:
    """First located row of each (release, case)."""
    placed = _keyed(parents).select(
        "SOURCE_RELEASE", "fiscal_year", "CASE_NUMBER", order_by, location(*map(F.col, PLACE)).alias("place")
    )
    return first_version(placed, ["SOURCE_RELEASE", "fiscal_year", "CASE_NUMBER"], [order_by])


def link_children(children: DataFrame, parents: DataFrame) -> DataFrame:
    """Worksite rows, counted by (release, case, place), with their same-year main locations.

    A year's main locations of a case are a set with at most one entry per release."""
    mains = release_locations(parents).groupBy("fiscal_year", "CASE_NUMBER").agg(
        F.collect_set("place").alias("main_places")
    )
    rows = _keyed(children).groupBy(
        "SOURCE_RELEASE", "fiscal_year", "CASE_NUMBER", location(*map(F.col, PLACE)).alias("place")
    ).agg(F.count("*").alias("rows"))
    return rows.join(mains, ["fiscal_year", "CASE_NUMBER"], "left")


def location_match(linked: DataFrame) -> DataFrame:
    """Per release: cases that could be compared by location and cases that match."""
    places = F.col("main_places")
    per_case = linked.where(places.isNotNull()).groupBy("SOURCE_RELEASE", "CASE_NUMBER").agg(
        F.max(F.exists(places, is_full_location)).alias("comparable"),
        F.max(is_full_location(F.col("place")) & F.array_contains(places, F.col("place"))).alias("matching"),
    )
    counted = per_case.groupBy("SOURCE_RELEASE").agg(
        F.count_if("comparable").alias("comparable_cases"), F.count_if("matching").alias("matching_cases")
    )
    return counted.withColumn("match_pct", pct(F.col("matching_cases"), F.col("comparable_cases")))


def child_cases(children: DataFrame, empty: bool = False) -> DataFrame:
    return _keyed(children, empty).groupBy("SOURCE_RELEASE", "fiscal_year", "CASE_NUMBER").agg(F.count("*").alias("rows"))


def parent_years(parents: DataFrame, empty: bool = False) -> DataFrame:
    return _keyed(parents, empty).select("fiscal_year", "CASE_NUMBER").distinct()


def multi_child_keys(children: DataFrame) -> DataFrame:
    """Per release: cases with several worksite rows."""
    return child_cases(children).groupBy("SOURCE_RELEASE").agg(
        F.count("*").alias("unique_worksite_case_numbers"),
        F.count_if(F.col("rows") > 1).alias("cases_with_multiple_worksite_rows"),
    )


def linked_children(children: DataFrame, parents: DataFrame) -> DataFrame:
    """Distinct (release, case) of the children with flags: a main in the same year, a main at all.

    Both sides meet in one grouping by case, in which a case has one entry per release and year at most."""
    none = F.lit(None)
    sites = child_cases(children, empty=True)
    site = F.struct("SOURCE_RELEASE", "fiscal_year", "rows")
    rows = sites.select("CASE_NUMBER", site.alias("site"), none.cast("string").alias("year"), F.lit(False).alias("main"))
    mains = _keyed(parents, empty=True).select(
        "CASE_NUMBER", none.cast(rows.schema["site"].dataType).alias("site"), F.col("fiscal_year").alias("year"), F.lit(True).alias("main")
    )
    per_case = rows.unionByName(mains).groupBy("CASE_NUMBER").agg(
        F.collect_list("site").alias("sites"), F.collect_set("year").alias("years"), F.max("main").alias("any_year")
    )
    unfolded = per_case.select("CASE_NUMBER", "years", "any_year", F.inline("sites"))
    same = F.coalesce(F.array_contains("years", F.col("fiscal_year")), F.lit(False))
    return unfolded.withColumn("same_year", same).drop("years")


def orphans(children: DataFrame, parents: DataFrame) -> DataFrame:
    """Per release: worksite rows without a same-year main, and cases and rows without any."""
    alone, nowhere = ~F.col("same_year") & (F.col("CASE_NUMBER") != ""), ~F.col("any_year")

    def rows(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, F.col("rows"))), F.lit(0))

    return linked_children(children, parents).groupBy("SOURCE_RELEASE").agg(
        rows(alone).alias("worksite_rows_without_same_year_main"),
        F.count_if(nowhere).alias("worksite_cases_without_any_selected_main"),
        rows(nowhere).alias("worksite_rows_without_any_selected_main"),
    )


def linked_elsewhere(children: DataFrame, parents: DataFrame) -> DataFrame:
    """Per release: worksite cases whose main is only found in another year."""
    elsewhere = linked_children(children, parents).where("any_year AND NOT same_year")
    return elsewhere.groupBy("SOURCE_RELEASE").agg(F.count("*").alias("worksite_cases_with_main_in_other_year"))


def same_year_links(children: DataFrame, parents: DataFrame) -> DataFrame:
    """Per worksite release: its rows and cases that meet a main of the same year, with shares."""
    years = parent_years(parents)
    per_year = years.groupBy("fiscal_year").agg(F.count("*").alias("unique_main_case_numbers"))
    # Rows without a case are one group per release here and meet no main.
    counted = _with_year(children).groupBy("SOURCE_RELEASE", "fiscal_year", "CASE_NUMBER").agg(F.count("*").alias("rows"))
    flagged = counted.join(years.withColumn("same_year", F.lit(True)), ["fiscal_year", "CASE_NUMBER"], "left")
    found = F.col("same_year").isNotNull()
    keyed_rows = F.coalesce(F.col("CASE_NUMBER") != "", F.lit(False))

    def rows(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, F.col("rows"))), F.lit(0))

    per_release = flagged.groupBy("SOURCE_RELEASE", "fiscal_year").agg(
        F.sum("rows").alias("source_rows"),
        rows(~keyed_rows).alias("missing_case_number"),
        rows(keyed_rows).alias("keyed_rows"),
        rows(found).alias("worksite_rows_matching_main"),
        F.count_if(found).alias("main_cases_with_same_year_worksite_row"),
    )
    joined = per_release.join(per_year, "fiscal_year", "left").na.fill(0)
    mains, linked = F.col("unique_main_case_numbers"), F.col("main_cases_with_same_year_worksite_row")
    matched, keyed = F.col("worksite_rows_matching_main"), F.col("keyed_rows")
    return joined.select(
        "SOURCE_RELEASE",
        "source_rows",
        "missing_case_number",
        matched,
        (keyed - matched).alias("worksite_rows_without_same_year_main"),
        mains,
        linked,
        (mains - linked).alias("main_cases_without_same_year_worksite_row"),
        pct(linked, mains).alias("same_year_main_to_worksite_match_pct"),
        pct(matched, keyed).alias("same_year_worksite_to_main_match_pct"),
    )


def _flagged_cases(children: DataFrame, parents: DataFrame) -> DataFrame:
    """Every distinct case with its main years and whether any worksite row names it.

    Null keys are missing here, empty ones are not. One grouping replaces the set operations; the
    years of a case are at most the fiscal years of the catalog."""
    mains = _with_year(parents.where(F.col("CASE_NUMBER").isNotNull())).select(
        "CASE_NUMBER", "fiscal_year", F.lit(False).alias("child")
    )
    rows = children.where(F.col("CASE_NUMBER").isNotNull()).select(
        "CASE_NUMBER", F.lit(None).cast("string").alias("fiscal_year"), F.lit(True).alias("child")
    )
    return mains.unionByName(rows).groupBy("CASE_NUMBER").agg(
        F.collect_set("fiscal_year").alias("years"), F.max("child").alias("child")
    )


def case_links_by_year(children: DataFrame, parents: DataFrame) -> DataFrame:
    """Per fiscal year: main cases with a worksite row in any year."""
    per_case = _flagged_cases(children, parents).select(F.explode("years").alias("fiscal_year"), "child")
    counted = per_case.groupBy("fiscal_year").agg(
        F.count("*").alias("unique_main_case_numbers"),
        F.count_if("child").alias("main_cases_with_any_worksite_row"),
    )
    mains, linked = F.col("unique_main_case_numbers"), F.col("main_cases_with_any_worksite_row")
    return counted.select(
        "fiscal_year", mains, linked,
        (mains - linked).alias("main_cases_without_any_worksite_row"),
        pct(linked, mains).alias("main_to_worksite_match_pct"),
    )


def global_case_links(children: DataFrame, parents: DataFrame) -> DataFrame:
    main = F.size("years") > 0
    counted = _flagged_cases(children, parents).agg(
        F.count_if(main).alias("unique_main_case_numbers"),
        F.count_if("child").alias("unique_worksite_case_numbers"),
        F.count_if(main & F.col("child")).alias("main_cases_with_any_worksite_row"),
        F.count_if(main & ~F.col("child")).alias("main_cases_without_any_worksite_row"),
        F.count_if(~main).alias("worksite_cases_without_any_selected_main"),
    )
    linked, mains = F.col("main_cases_with_any_worksite_row"), F.col("unique_main_case_numbers")
    return counted.withColumn("main_to_worksite_match_pct", pct(linked, mains))

