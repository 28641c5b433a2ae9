"""Landed releases: discovery, fingerprints, and the scan to the fixed schema.

A release is one file, or one folder of part files, named after it. Only paths, sizes and times are
read to discover releases; the binary content column is pruned from the scan. A release's fingerprint is
taken from its standardised rows, once, when it is stored."""

import csv
import io

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from panelwright.session import cut_lineage
from panelwright.sources.schema import PROVENANCE, SPECS, TableSpec, validate_headers

# Names of landed releases.
MAIN_NAME = r"(?i)^LCA_Disclosure_Data_(FY20\d{2}_Q[1-4])(\.(csv|json|parquet))?$"
WORKSITE_NAME = r"(?i)^LCA_Worksites_FY_?(20\d{2}_Q[1-4])(\.(csv|json|parquet))?$"


# Quotes inside quoted cells are doubled; blanks belong to the cell.
CSV = {"header": "true", "quote": '"', "escape": '"'}


def landed_files(spark: SparkSession, landing: str) -> DataFrame:
    """Every landed file with the name of its release: its own, or its folder's under ``landing``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(landing)
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(landing)
    system = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    root = system.makeQualified(place).toString()
    return files.select("path", "length", "modificationTime").transform(lambda df: with_release(df, root))


def with_release(files: DataFrame, root: str) -> DataFrame:
    """Add release name, label and kind; temporary office files are left out."""
    below = F.substring("path", len(root.rstrip("/")) + 2, 1 << 16)
    name = F.split_part(below, F.lit("/"), F.lit(1))
    worksite = F.concat(F.lit("FY"), F.regexp_extract("name", WORKSITE_NAME, 1))
    named = files.withColumn("name", name).where(~F.col("name").startswith("~$"))
    is_main, is_worksite = F.col("name").rlike(MAIN_NAME), F.col("name").rlike(WORKSITE_NAME)
    return named.withColumns(
        {
            "kind": F.when(is_main, F.lit("main")).when(is_worksite, F.lit("worksites")),
            "release": F.upper(F.when(is_main, F.regexp_extract("name", MAIN_NAME, 1)).when(is_worksite, worksite)),
        }
    )


def content_fingerprint(rows: DataFrame) -> DataFrame:
    """One row: the number of rows and a digest of them that does not depend on their order. The file
    name is left out."""
    value = F.xxhash64(*[name for name in rows.columns if name != PROVENANCE[1]])
    sums = rows.agg(
        F.count("*").alias("rows"), F.sum(value.cast("decimal(38,0)")).alias("total"), F.bit_xor(value).alias("mixed")
    )
    return sums.select("rows", F.sha2(F.concat_ws("|", "rows", "total", "mixed"), 256).alias("sha256"))


def release_catalog(files: DataFrame, with_worksites: bool = False) -> DataFrame:
    """One row per release and kind: name, size, newest time. Bounded by releases."""
    return files.where(F.col("kind").isin(kinds(with_worksites))).groupBy("release", "kind", "name").agg(
        F.sum("length").alias("size_bytes"), F.max("modificationTime").alias("modified_at"), F.count("*").alias("files")
    )


def kinds(with_worksites: bool) -> list[str]:
    return ["main", "worksites"] if with_worksites else ["main"]


def catalog_violations(files: DataFrame, catalog: DataFrame) -> DataFrame:
    """Unrecognised names, and releases landed under more than one name."""
    unknown = files.where(F.col("kind").isNull()).select(
        F.lit("unrecognized_name").alias("check"), F.col("name").alias("key"), F.col("path").alias("detail")
    )
    twice = catalog.groupBy("release", "kind").agg(F.count("*").alias("n"), F.max("name").alias("name")).where("n > 1")
    return unknown.unionByName(
        twice.select(
            F.lit("duplicate_release").alias("check"), F.concat_ws(" ", "release", "kind").alias("key"),
            F.col("name").alias("detail"),
        )
    )


def header_names(spark: SparkSession, path: str) -> list[str | None]:
    """The landed headers of a release, over all its parts; for CSV the first line of every part, which
    must be the same."""
    if path.rstrip("/").lower().endswith(".parquet"):
        return spark.read.option("mergeSchema", "true").parquet(path).columns
    if path.rstrip("/").lower().endswith(".json"):
        return spark.read.option("primitivesAsString", "true").json(path).columns
    lines = spark.read.text(path).where(F.col("_metadata.file_block_start") == 0)
    lines = lines.select("value", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("at"))
    first = lines.where(F.trim("value") != "").groupBy("file").agg(F.min_by("value", "at").alias("line"))
    found = first.groupBy("line").agg(F.min("file").alias("file")).orderBy("file").limit(2).collect()
    if not found:
        return []
    if len(found) > 1:
        raise ValueError(f"Headers of {found[1].file} differ from those of {found[0].file}")
    return [name or None for name in next(csv.reader([found[0].line]))]


def spans_lines(spark: SparkSession, path: str) -> bool:
    """Whether a quoted cell holds a line break: only then does a line have an odd number of quotes."""
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    return bool(spark.read.text(path).where(quotes % 2 == 1).take(1))


def _landed_csv(spark: SparkSession, path: str, headers: list[str]):
    reader = spark.read.options(**CSV).option("enforceSchema", "true")
    # Files with line breaks inside cells cannot be split; all others can.
    return reader.option("multiLine", str(spans_lines(spark, path)).lower())


@F.pandas_udf(IntegerType())
def cells_with_content(records: pd.Series) -> pd.Series:
    """Place of a record's last cell that is not empty."""

    def last(record: str) -> int:
        cells = next(csv.reader(io.StringIO(record)), [])
        return max((at for at, cell in enumerate(cells, 1) if cell != ""), default=0)

    return records.map(last)


def surplus_cells(spark: SparkSession, path: str) -> DataFrame:
    """Records with something beyond the last header, by file and row."""
    if path.rstrip("/").lower().endswith((".json", ".parquet")):
        return spark.createDataFrame([], "check string, key string, detail string")
    headers = header_names(spark, path)
    schema = ", ".join(f"`c{at}` string" for at in range(len(headers))) + ", `_record` string"
    reader = _landed_csv(spark, path, headers).option("columnNameOfCorruptRecord", "_record")
    numbered = _numbered(reader.schema(schema).csv(path), F.col("_metadata.file_block_start"), None)
    # All cells are read, since the parser counts only those that a query needs.
    cells = F.concat_ws("", *[f"c{at}" for at in range(len(headers))])
    odd = numbered.where(F.col("_record").isNotNull() & (cells != "\0")).select("_file", "SOURCE_ROW_NUMBER", "_record")
    return odd.where(cells_with_content("_record") > len(headers)).select(
        F.lit("cells_beyond_headers").alias("check"),
        F.concat_ws(" row ", "_file", F.col("SOURCE_ROW_NUMBER").cast("string")).alias("key"),
        F.substring("_record", 1, 200).alias("detail"),
    )


def _numbered(df: DataFrame, per: Column, index: Column | None) -> DataFrame:
    """Add SOURCE_ROW_NUMBER across a release's parts in path and file order, header row first.

    The scan is counted once per split; the split table carries the running offsets."""
    placed = df.withColumns({"_file": F.col("_metadata.file_path"), "_at": per})
    placed = placed.withColumn("_id", index if index is not None else F.monotonically_increasing_id())
    splits = placed.groupBy("_file", "_at").agg(F.count("*").alias("_rows"), F.min("_id").alias("_first"))
    ahead = Window.partitionBy(F.lit(0)).orderBy("_file", "_at").rowsBetween(Window.unboundedPreceding, -1)
    # One row per input split of a single release; stored, so that the join knows its size and
    # sends it to the rows rather than the rows through a shuffle.
    before = F.coalesce(F.sum("_rows").over(ahead), F.lit(0)).alias("_before")
    offsets = cut_lineage(splits.select("_file", "_at", "_first", before))
    joined = placed.join(offsets, ["_file", "_at"])
    return joined.withColumn("SOURCE_ROW_NUMBER", F.col("_id") - F.col("_first") + F.col("_before") + 2).drop(
        "_at", "_id", "_first", "_before"
    )


def scan_release(spark: SparkSession, path: str, headers: list[str]) -> DataFrame:
    """Landed rows as text with their file and physical row number (the header is row 1)."""
    lower = path.rstrip("/").lower()
    if lower.endswith(".parquet"):
        rows = spark.read.option("mergeSchema", "true").parquet(path)
        return _numbered(rows, F.lit(0), F.col("_metadata.row_index"))
    schema = ", ".join(f"`{name}` string" for name in headers)
    if lower.endswith(".json"):
        rows = spark.read.schema(schema).json(path)
    else:
        rows = _landed_csv(spark, path, headers).schema(schema).csv(path)
    return _numbered(rows, F.col("_metadata.file_block_start"), None)


def standardize(landed: DataFrame, spec: TableSpec, release: Column, file: Column, row_number: Column, headers: dict[str, str]) -> DataFrame:
    """Fixed schema: mapped columns as text, absent ones null, rows without any value dropped."""
    by_column = {column: header for header, column in headers.items()}
    filled = [F.col(f"`{header}`") for header in headers]
    rows = landed.where(F.coalesce(*[value.cast("string") for value in filled]).isNotNull())
    return rows.select(
        *[
            (F.col(f"`{by_column[name]}`") if name in by_column else F.lit(None)).cast("string").alias(name)
            for name in spec.columns
        ],
        *[value.alias(name) for name, value in zip(PROVENANCE, (release, file, row_number))],
    )


def read_release(spark: SparkSession, path: str, release: str, kind: str = "main") -> DataFrame:
    """One landed release in the fixed schema of its kind; bad headers fail before any row is read."""
    headers = header_names(spark, path)
    mapping = validate_headers(headers, SPECS[kind], path)
    name = path.rstrip("/").rsplit("/", 1)[-1]
    landed = scan_release(spark, path, headers)
    return standardize(landed, SPECS[kind], F.lit(release), F.lit(name), F.col("SOURCE_ROW_NUMBER"), mapping)
