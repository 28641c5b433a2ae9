"""Order tables read as versioned cases, so that every operator runs on them.

Dates stay dates and the row order inside a release is a struct of the line's own columns, which is
the same on every run whatever the file layout."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.functions.calendar import fiscal_quarter_index, quarter_label

CERTIFIED = "F"
CLASS = "R"
ORDER = ["SOURCE_RELEASE", "SOURCE_ROW_NUMBER"]
# Everything that can tell two lines of one case and release apart, in sort order.
LINE_ORDER = [
    "l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount",
    "l_tax", "l_returnflag", "l_linestatus",
]


# Stated so that planning a query needs no job to read footers.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey long, s_name string, s_nationkey int, s_acctbal double",
    "orders": "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
    "l_shipdate timestamp_ntz",
}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{folder}/{name}.parquet")


def release_of(day: Column) -> Column:
    return quarter_label(fiscal_quarter_index(day))


def order_cases(spark: SparkSession, folder: str, positions: bool = True) -> DataFrame:
    """One case per order: released in its order quarter, filed by its customer."""
    day = F.col("o_orderdate").cast("date")
    orders = table(spark, folder, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", day.alias("RECEIVED_DATE")
    )
    names = table(spark, folder, "customer").select("c_custkey", "c_name")
    cases = orders.join(names, F.col("o_custkey") == F.col("c_custkey"))
    size = F.lit("1")
    if positions:
        lines = table(spark, folder, "lineitem").groupBy("l_orderkey").agg(
            F.sum("l_quantity").cast("long").alias("quantity")
        )
        cases = cases.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
        size = F.coalesce(F.col("quantity"), F.lit(1)).cast("string")
    return cases.select(
        F.col("o_orderkey").cast("string").alias("CASE_NUMBER"),
        release_of(F.col("RECEIVED_DATE")).alias("SOURCE_RELEASE"),
        F.col("o_orderkey").alias("SOURCE_ROW_NUMBER"),
        F.lit(CLASS).alias("VISA_CLASS"),
        F.col("o_orderstatus").alias("CASE_STATUS"),
        "RECEIVED_DATE",
        F.col("RECEIVED_DATE").alias("DECISION_DATE"),
        F.col("c_name").alias("EMPLOYER_NAME"),
        size.alias("TOTAL_WORKER_POSITIONS"),
    )


def line_cases(spark: SparkSession, folder: str, names: bool = False, received: bool = False) -> DataFrame:
    """Versioned cases: an order line that ships again is a newer version of the same case.

    ``received`` joins the order date, ``names`` the customer; both leave out their join if unset."""
    lines = table(spark, folder, "lineitem").withColumn("l_shipdate", F.col("l_shipdate").cast("date"))
    columns = [
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("CASE_NUMBER"),
        release_of(F.col("l_shipdate")).alias("SOURCE_RELEASE"),
        F.struct(*LINE_ORDER).alias("SOURCE_ROW_NUMBER"),
        F.col("l_returnflag").alias("VISA_CLASS"),
        F.col("l_linestatus").alias("CASE_STATUS"),
        F.col("l_shipdate").alias("DECISION_DATE"),
        F.col("l_quantity").cast("long").cast("string").alias("TOTAL_WORKER_POSITIONS"),
    ]
    if received or names:
        orders = table(spark, folder, "orders").select(
            "o_orderkey", "o_custkey", F.col("o_orderdate").cast("date").alias("RECEIVED_DATE")
        )
        if names:
            customers = table(spark, folder, "customer").select("c_custkey", "c_name")
            orders = orders.join(customers, F.col("o_custkey") == F.col("c_custkey"))
            columns.append(F.col("c_name").alias("EMPLOYER_NAME"))
        lines = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        columns.append(F.col("RECEIVED_DATE"))
    return lines.select(*columns)


# Chunks of a line case meet inside their ship date first: at most one per date is left of a case.
LINE_LEVELS = (2,)


def line_chunk() -> list[Column]:
    """Consecutive runs of a line case's versions, for operators that must not see it whole."""
    block = F.shiftright(F.col("SOURCE_ROW_NUMBER.l_partkey"), 20)
    return [F.col("SOURCE_RELEASE"), F.col("SOURCE_ROW_NUMBER.l_shipdate"), block]


def _places(spark: SparkSession, folder: str) -> DataFrame:
    nation, region = table(spark, folder, "nation"), table(spark, folder, "region")
    return nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("n_nationkey").alias("nation"),
        F.col("n_name").alias("WORKSITE_CITY"),
        F.col("r_name").alias("WORKSITE_STATE"),
        F.col("n_nationkey").cast("string").alias("WORKSITE_POSTAL_CODE"),
    )


def order_parents(spark: SparkSession, folder: str) -> DataFrame:
    """Main cases for the link audit: orders, located at their customer's nation."""
    customers = table(spark, folder, "customer").select("c_custkey", "c_nationkey")
    placed = customers.join(_places(spark, folder), F.col("c_nationkey") == F.col("nation"))
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    return orders.join(placed, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").cast("string").alias("CASE_NUMBER"),
        release_of(F.col("o_orderdate").cast("date")).alias("SOURCE_RELEASE"),
        F.col("o_orderkey").alias("SOURCE_ROW_NUMBER"),
        "WORKSITE_CITY", "WORKSITE_STATE", "WORKSITE_POSTAL_CODE",
    )


def line_children(spark: SparkSession, folder: str) -> DataFrame:
    """Worksite rows for the link audit: order lines, located at their supplier's nation."""
    suppliers = table(spark, folder, "supplier").select("s_suppkey", "s_nationkey")
    placed = suppliers.join(_places(spark, folder), F.col("s_nationkey") == F.col("nation"))
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_suppkey", "l_shipdate")
    return lines.join(placed, F.col("l_suppkey") == F.col("s_suppkey")).select(
        F.col("l_orderkey").cast("string").alias("CASE_NUMBER"),
        release_of(F.col("l_shipdate").cast("date")).alias("SOURCE_RELEASE"),
        "WORKSITE_CITY", "WORKSITE_STATE", "WORKSITE_POSTAL_CODE",
    )


def keys_only(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Parents and children of the link audit without their locations: no location joins."""
    orders, lines = table(spark, folder, "orders"), table(spark, folder, "lineitem")
    return (
        orders.select(
            F.col("o_orderkey").cast("string").alias("CASE_NUMBER"),
            release_of(F.col("o_orderdate").cast("date")).alias("SOURCE_RELEASE"),
        ),
        lines.select(
            F.col("l_orderkey").cast("string").alias("CASE_NUMBER"),
            release_of(F.col("l_shipdate").cast("date")).alias("SOURCE_RELEASE"),
        ),
    )


def dirty_lines(spark: SparkSession, folder: str) -> DataFrame:
    """The line cases as landed text with the faults that real landings have, spread by part key: blank and
    padded case numbers, dates that are empty, wrong or have a time, names with legal suffixes, accents
    and doubled blanks, missing codes."""
    part = F.col("SOURCE_ROW_NUMBER.l_partkey")

    def pick(modulus: int, choices: dict[int, Column], otherwise: Column) -> Column:
        chosen = otherwise
        for remainder, value in reversed(choices.items()):
            chosen = F.when(part % modulus == remainder, value).otherwise(chosen)
        return chosen

    key, name, none = F.col("CASE_NUMBER"), F.col("EMPLOYER_NAME"), F.lit(None).cast("string")
    day = F.col("DECISION_DATE").cast("string")
    return line_cases(spark, folder, names=True, received=True).withColumns(
        {
            "CASE_NUMBER": pick(11, {0: F.lit(""), 1: none, 2: F.lit("  "), 3: F.concat(F.lit(" "), key, F.lit("\t"))}, key),
            "DECISION_DATE": pick(
                9, {0: F.lit("no date"), 1: F.lit(""), 2: none, 3: F.concat(day, F.lit("T08:30:00")), 4: F.lit("2023-02-30")}, day
            ),
            "RECEIVED_DATE": F.col("RECEIVED_DATE").cast("string"),
            "EMPLOYER_NAME": pick(
                8,
                {
                    0: F.lit(""), 1: F.concat(name, F.lit(", Inc.")), 2: F.concat(name, F.lit("  l.l.c. ")),
                    3: F.concat(name, F.lit(" Cafe\u0301")), 4: F.concat(name, F.lit(",Ltd")), 5: none,
                },
                name,
            ),
            "SOC_CODE": pick(7, {0: none, 1: F.lit("")}, F.concat(F.lit("15-"), part.cast("string"))),
            "VISA_CLASS": pick(10, {0: F.concat(F.lit(" "), F.lower("VISA_CLASS")), 1: F.lit("")}, F.col("VISA_CLASS")),
        }
    )


def dirty_places(spark: SparkSession, folder: str) -> DataFrame:
    """Customers at places written the way people write them: state names, codes, blanks, short postals."""
    nation = table(spark, folder, "nation").select("n_nationkey", "n_name")
    key = F.col("c_custkey")
    states = F.array(*[F.lit(text) for text in (" new york", "Texas ", "ca", "Guam", "Elsewhere", "")])
    return table(spark, folder, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        "c_custkey",
        F.when(key % 5 > 0, F.concat(F.lit(" "), F.lower("n_name"))).alias("city"),
        F.get(states, (key % 7).cast("int")).alias("state"),
        F.when(key % 4 > 0, F.concat((key % 3000).cast("string"), F.when(key % 6 == 0, F.lit("a")).otherwise(F.lit(" ")))).alias("postal"),
    )
