"""Session helpers: configuration, shared folder, cutting of lineage."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str = "local[*]", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A local session with the settings the engine expects (UTC, AQE, Arrow)."""
    builder = (
        SparkSession.builder.master(master)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir of the session.

    Only where it is unset in a local run (tests) a folder of this machine is
    chosen and set; a cluster without it is refused, since no folder of the
    driver's machine is one that executors can read.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='orderloom-')}"
        spark.conf.set("spark.checkpoint.dir", found)
        atexit.register(_forget, found)
    return found.rstrip("/")


def _forget(url: str) -> None:
    import shutil

    shutil.rmtree(url.removeprefix("file://"), ignore_errors=True)


_FOLDERS: dict[str, str] = {}


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder, below a folder of this application that goes when the process ends."""
    app = spark.sparkContext.applicationId
    if app not in _FOLDERS:
        _FOLDERS[app] = f"{shared_dir(spark)}/orderloom/{app}-{uuid.uuid4().hex[:8]}"
        folder = spark._jvm.org.apache.hadoop.fs.Path(_FOLDERS[app])
        atexit.register(_drop, folder.getFileSystem(spark._jsc.hadoopConfiguration()), folder)
    return f"{_FOLDERS[app]}/{label}-{uuid.uuid4().hex[:12]}"


def _drop(files, folder) -> None:
    try:
        files.delete(folder, True)
    except Exception:  # noqa: BLE001 - the JVM may be gone; the files are then left to the cluster's own cleaning
        pass


def cut(df: DataFrame, label: str = "cut", partition_by: list[str] | None = None, rebalance: bool = False) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back.

    It replaces a checkpoint: lineage ends at files every executor can read, so
    a lost executor costs only its running tasks; unlike a checkpoint the files
    are compressed, columnar and carry sizes the planner can trust. With
    rebalance, rows are gathered by ``partition_by`` first, so that a partition
    has few files; one that is large is spread over tasks.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    writer = (df.hint("rebalance", *partition_by) if rebalance and partition_by else df).write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
