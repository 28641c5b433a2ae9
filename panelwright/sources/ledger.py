"""Stored releases and outputs. Data goes to a new folder each time; a numbered commit file points
readers to it, so a failed or repeated write is never seen half done.

A commit file appears whole and only if its number is free. Of two writers that want the same number one
takes the next, so every commit is kept and all readers agree on the newest one. Folders that no reader can need
any more are removed by ``remove_expired``."""

import json
import os
import time
from collections.abc import Callable, Sequence
from datetime import datetime, timezone
from uuid import uuid4

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelwright.functions.numeric import round_binary
from panelwright.session import file_system
from panelwright.sources.releases import content_fingerprint

RELEASES = "release string, kind string, name string, size_bytes long, modified_at timestamp, sha256 string, path string, rows long, seq long"
OUTPUTS = "name string, version string, path string, rows long, seq long"


def _entries(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All commits, numbered by their file, with the time (epoch seconds) they were made at."""
    stored = schema.removesuffix(", seq long")
    try:
        commits = spark.read.schema(stored).json(path)
    except AnalysisException:
        return spark.createDataFrame([], f"{schema}, made_at double")
    number = F.regexp_extract("_metadata.file_name", r"^(\d+)\.json$", 1).cast("long")
    return commits.select(
        "*", number.alias("seq"), F.unix_millis("_metadata.file_modification_time").cast("double").alias("made_at")
    ).withColumn("made_at", F.col("made_at") / 1000)


def _current(entries: DataFrame, keys: Sequence[str]) -> DataFrame:
    rest = [name for name in entries.columns if name not in keys]
    newest = entries.groupBy(*keys).agg(F.max_by(F.struct(*rest), "seq").alias("e")).select(*keys, "e.*").drop("made_at")
    return newest.where(F.col("path").isNotNull())


def release_ledger(spark: SparkSession, root: str) -> DataFrame:
    """Current entry of each stored release; a handful of rows per year."""
    return _current(_entries(spark, f"{root}/ledger/releases", RELEASES), ["release", "kind"])


def output_ledger(spark: SparkSession, root: str) -> DataFrame:
    return _current(_entries(spark, f"{root}/ledger/outputs", OUTPUTS), ["name"])


def _next_seq(spark: SparkSession, path: str, schema: str) -> int:
    return (_entries(spark, path, schema).agg(F.max("seq")).first()[0] or 0) + 1


def _text(value):
    """JSON for what JSON has no type for; a collected timestamp is in the driver's time zone."""
    return value.astimezone(timezone.utc).isoformat() if isinstance(value, datetime) else value


def _create(spark: SparkSession, path: str, name: str, text: str) -> bool:
    """Make a small file with all its text, unless one of that name is there already; False if it is."""
    folder, system = file_system(spark, path)
    system.mkdirs(folder)
    jvm, draft = spark.sparkContext._jvm, f".{name}.{uuid4().hex}"
    if system.getUri().getScheme() == "file":  # its rename replaces files, a link never does
        local = folder.toUri().getPath()
        with open(f"{local}/{draft}", "w", encoding="utf-8") as out:
            out.write(text)
        try:
            os.link(f"{local}/{draft}", f"{local}/{name}")
            return True
        except FileExistsError:
            return False
        finally:
            os.unlink(f"{local}/{draft}")
    target, source = (jvm.org.apache.hadoop.fs.Path(folder, part) for part in (name, draft))
    out = system.create(source, False)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()
    made = not system.exists(target) and system.rename(source, target)  # a rename fails where the target exists
    if not made:
        system.delete(source, False)
    return made


def _append(spark: SparkSession, path: str, schema: str, rows: list[tuple]) -> int:
    """Commit rows whose last field is the first number to try; returns the number taken."""
    names = [field.split()[0] for field in schema.split(", ")][:-1]
    text = "".join(json.dumps({n: _text(v) for n, v in zip(names, row, strict=False)}) + "\n" for row in rows)
    seq = min(row[-1] for row in rows)
    while not _create(spark, path, f"{seq:012d}.json", text):
        seq += 1
    return seq


def pending_releases(catalog: DataFrame, ledger: DataFrame) -> DataFrame:
    """Landed releases whose stored version has another name, size or time, or is absent."""
    return catalog.join(ledger, ["release", "kind", "name", "size_bytes", "modified_at"], "left_anti")


def withdrawn_releases(catalog: DataFrame, ledger: DataFrame) -> DataFrame:
    return ledger.join(catalog, ["release", "kind"], "left_anti")


def write_table(df: DataFrame, path: str, sort_by: Sequence[str] = ()) -> None:
    """Zstd Parquet in a folder of its own; sorting inside files lets row groups prune."""
    ordered = df.sortWithinPartitions(*sort_by) if sort_by else df
    ordered.write.option("compression", "zstd").mode("errorifexists").parquet(path)


def write_csv(df: DataFrame, path: str, digits: int | None = None) -> None:
    """CSV with a header; fractional columns with a fixed number of digits if asked."""
    if digits is not None:
        for name, kind in df.dtypes:
            if kind in ("double", "float"):
                text = F.format_string(f"%.{digits}f", round_binary(F.col(name).cast("double"), digits))
                df = df.withColumn(name, F.when(F.col(name).isNotNull(), text))
    df.write.option("header", "true").mode("overwrite").csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.option("ignoreNullFields", "false").mode("overwrite").json(path)


def store_release(df: DataFrame, root: str, entry: dict) -> int:
    """Write one standardised release and publish it; returns its stored rows."""
    spark = df.sparkSession
    ledger = f"{root}/ledger/releases"
    seq = _next_seq(spark, ledger, RELEASES)
    path = f"{root}/{entry['kind']}/{entry['release']}/v{seq:08d}-{uuid4().hex[:8]}"
    write_table(df, path)
    rows, sha256 = content_fingerprint(spark.read.parquet(path)).first()
    fields = [entry[name] for name in ("release", "kind", "name", "size_bytes", "modified_at")]
    _append(spark, ledger, RELEASES, [(*fields, sha256, path, rows, seq)])
    return rows


def withdraw_release(spark: SparkSession, root: str, release: str, kind: str) -> None:
    ledger = f"{root}/ledger/releases"
    row = (release, kind, None, None, None, None, None, None, _next_seq(spark, ledger, RELEASES))
    _append(spark, ledger, RELEASES, [row])


def read_releases(spark: SparkSession, root: str, kind: str = "main", columns: Sequence[str] | None = None) -> DataFrame:
    """All current releases of a kind as one table; the release is a column, order is not implied."""
    paths = [row["path"] for row in release_ledger(spark, root).where(F.col("kind") == kind).select("path").collect()]
    if not paths:
        raise ValueError(f"No {kind} releases stored in {root}")
    table = spark.read.parquet(*paths)
    return table.select(*columns) if columns else table


def input_version(spark: SparkSession, root: str, *kinds: str) -> str:
    """One hash over the (kind, release, fingerprint) of every stored release of the kinds (main, if none
    is named) that an output depends on."""
    pairs = F.sort_array(F.collect_list(F.concat_ws(":", "kind", "release", "sha256")))
    known = release_ledger(spark, root).where(F.col("kind").isin(*(kinds or ("main",))))
    return known.agg(F.sha2(F.concat_ws("|", pairs), 256).alias("v")).first()["v"]


def is_current(spark: SparkSession, root: str, name: str, version: str) -> bool:
    found = output_ledger(spark, root).where((F.col("name") == name) & (F.col("version") == version))
    return bool(found.take(1))


def write_output(
    df: DataFrame,
    root: str,
    name: str,
    version: str,
    sort_by: Sequence[str] = (),
    check: Callable[[DataFrame], None] | None = None,
) -> DataFrame:
    """Write an output beside its predecessors and read it back; it is published under ``version``
    once ``check`` lets it pass."""
    spark = df.sparkSession
    path, seq = publish_path(spark, root, name)
    write_table(df, path, sort_by)
    stored = spark.read.parquet(path)
    if check is not None:
        check(stored)
    publish(spark, root, name, version, path, seq, stored.count())
    return stored


def publish_path(spark: SparkSession, root: str, name: str) -> tuple[str, int]:
    """A fresh folder for an output, and the sequence to publish it under."""
    seq = _next_seq(spark, f"{root}/ledger/outputs", OUTPUTS)
    return f"{root}/outputs/{name}/v{seq:08d}-{uuid4().hex[:8]}", seq


def publish(spark: SparkSession, root: str, name: str, version: str, path: str, seq: int, rows: int = 0) -> None:
    _append(spark, f"{root}/ledger/outputs", OUTPUTS, [(name, version, path, rows, seq)])


def output_path(spark: SparkSession, root: str, name: str) -> tuple[str, str]:
    """Path and version of an output's current folder."""
    row = output_ledger(spark, root).where(F.col("name") == name).first()
    if row is None:
        raise ValueError(f"Nothing published as {name} in {root}")
    return row["path"], row["version"]


def read_output(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(output_path(spark, root, name)[0])


def remove_expired(spark: SparkSession, root: str, older_than: float, keep: Sequence[str] = ()) -> list[str]:
    """Delete version folders that stopped being current ``older_than`` seconds ago or more, and those of that age that
    were never published; returns their paths. Folders named in ``keep`` stay, as do all that are current.

    ``older_than`` must exceed the longest job that reads or writes the store."""
    limit = time.time() - older_than
    live = {_plain(spark, path) for path in keep}
    replaced = {}
    for ledger, schema, keys in (("releases", RELEASES, ["release", "kind"]), ("outputs", OUTPUTS, ["name"])):
        entries = _entries(spark, f"{root}/ledger/{ledger}", schema)
        after = F.lead("made_at").over(Window.partitionBy(*keys).orderBy("seq"))
        for row in entries.withColumn("until", after).where("path is not null").select("path", "until").collect():  # metadata only
            path = _plain(spark, row.path)
            if row.until is None or row.until > limit:
                live.add(path)
            replaced[path] = row.until
    folder, system = file_system(spark, f"{root}/*/*/v*")
    removed = []
    for status in system.globStatus(folder) or ():
        path = _plain(spark, status.getPath().toString())
        if path not in live and (path in replaced or status.getModificationTime() / 1000 <= limit):
            system.delete(status.getPath(), True)
            removed.append(path)
    return sorted(removed)


def _plain(spark: SparkSession, path: str) -> str:
    """A path without scheme and host, however it was written."""
    return file_system(spark, path)[0].toUri().getPath()
