"""Session helpers. On a cluster the session is given; these only fill what is unset."""

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


def local_session(cores: int = 8, partitions: int | None = None, memory: str = "12g") -> SparkSession:
    builder = SparkSession.builder.master(f"local[{cores}]").appName("panelwright")
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    spark = (
        builder.config("spark.sql.shuffle.partitions", str(partitions or cores))
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder for cut lineage: ``spark.checkpoint.dir``, else the folder set on the
    context, else one in the warehouse, which every executor reaches too."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        folder = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder


_scratch: dict[str, str] = {}


def file_system(spark: SparkSession, folder: str):
    """A path and its file system, both of the JVM."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def scratch_dir(spark: SparkSession) -> str:
    """This application's own folder for intermediate tables, deleted when the application's JVM ends."""
    app = spark.sparkContext.applicationId
    if app not in _scratch:
        folder = f"{shared_dir(spark).rstrip('/')}/tables/{app}"
        path, system = file_system(spark, folder)
        system.mkdirs(path)
        system.deleteOnExit(path)
        _scratch[app] = folder
    return _scratch[app]


def clear_scratch(spark: SparkSession) -> None:
    """Delete the intermediate tables written so far; frames read from them must not be used afterwards."""
    folder = _scratch.pop(spark.sparkContext.applicationId, None)
    if folder is not None:
        path, system = file_system(spark, folder)
        system.delete(path, True)


def cut_lineage(df: DataFrame) -> DataFrame:
    """The same rows as a table written once to the shared folder: later plans start from its files,
    which survive lost executors, and nothing upstream runs again."""
    path = f"{scratch_dir(df.sparkSession)}/{uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
