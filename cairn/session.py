"""Session defaults, table loading and the shared scratch area."""

from __future__ import annotations

import tempfile
import uuid

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

from cairn.functions.arrow import filesystem


def build(app: str = "cairn", **conf: str) -> SparkSession:
    """A session with UTC time and adaptive execution; `conf` overrides."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Rows of a table in fewer partitions than there are cores, dealt over them before costly work on each row; larger tables stay where they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def by_key(df: DataFrame) -> DataFrame:
    """A side of a join that may be large: both sides are dealt by key and sorted.

    Tables of short, regular columns are files of a byte or two a row. Judged by these, millions of rows would be handed whole to every task.
    """
    return df.hint("shuffle_merge")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share (spark.checkpoint.dir).

    Only a session in local mode without that setting, as in tests, gets a local folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not (master := spark.conf.get("spark.master", "")).startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new, unused path below the application's part of the shared folder."""
    return f"{_own(spark)}/{name}-{uuid.uuid4().hex}"


def _own(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/{spark.conf.get('spark.app.id')}"


def clear(spark: SparkSession) -> None:
    """Removes all that this application has written down, once its results are no longer read."""
    system, path = filesystem(_own(spark))
    if system.get_file_info(path).type == fs.FileType.Directory:
        system.delete_dir(path)


def block_files(df: DataFrame, rows: int, name: str) -> list[str]:
    """Writes `df` to the shared folder in as few files as `rows` a file allow; their URIs.

    So tasks can read a table of any size block by block (functions.arrow.read_block), without it passing the driver.
    """
    whole, path = materialise(df, name), scratch(df.sparkSession, f"{name}-blocks")
    if not (n := whole.count()):
        return []
    whole.coalesce(-(-n // rows)).write.option("maxRecordsPerFile", rows).parquet(path)
    return sorted(df.sparkSession.read.schema(df.schema).parquet(path).inputFiles())


def materialise(df: DataFrame, name: str, per_file: int = 0) -> DataFrame:
    """Write `df` once to the shared folder and go on from there.

    This cuts the lineage without tying rows to the executors that made them. Files of `per_file` rows at most keep a task that reads several of them
    to a few million, as each counts as 4 MB or more; short, regular rows would otherwise be tens of millions in a task.
    """
    path = scratch(df.sparkSession, name)
    df.write.option("maxRecordsPerFile", per_file).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
