"""Session factory and the shared folder for cut lineage and stream state."""

from __future__ import annotations

import atexit
import gc
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "canopy", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A session with adaptive execution; a cluster passes its own master and sizes."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
    )
    if master:
        builder = builder.master(master)
        if master.startswith("local"):  # one process does all the work
            builder = builder.config("spark.driver.memory", os.environ.get("CANOPY_LOCAL_MEMORY", "16g"))
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    ship_package(spark)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Sends this package to the Python workers, wherever the driver was started; a session made elsewhere calls it once, or the
    job is submitted with the package in --py-files."""
    name = os.path.basename(os.path.dirname(os.path.abspath(__file__)))
    folder = tempfile.mkdtemp(prefix="canopy-package-")   # read by the driver alone, which serves it to the workers
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    spark.sparkContext.addPyFile(shutil.make_archive(os.path.join(folder, name), "zip", os.path.dirname(os.path.dirname(os.path.abspath(__file__))), name))


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: spark.checkpoint.dir. Where it is unset, a local session gets a temporary folder
    that goes when the process ends; a cluster is refused, as its executors would each write to their own disk."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="canopy-")
        atexit.register(shutil.rmtree, named, ignore_errors=True)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(named)
    return named


def run_dir(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the shared folder for one stream or one staged table."""
    return os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")


def cut(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write df to the shared folder and continue from that table: ends the lineage of a loop, survives lost
    executors, and gives the planner the true size of what follows (so it only broadcasts what is small)."""
    path = run_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fan_out(df: DataFrame, *keys: str) -> DataFrame:
    """Spread a scan with fewer splits than cores over all cores before per-row work; a large scan already
    has more splits than cores and stays as it is. Only the plan depends on the number of splits, never the rows."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, *keys) if df.rdd.getNumPartitions() < cores else df


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt by keys over as many tasks as shuffles have: for few small rows whose work is dear, which adaptive
    execution, looking at bytes, would put into one task."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def discard(*tables: DataFrame) -> None:
    """Delete tables that cut wrote and nothing reads any more, and let the driver collect its garbage, upon which Spark
    removes the shuffle files of finished jobs: long chains of staged tables hold less disk."""
    for df in tables:
        spark = df.sparkSession
        for folder in {os.path.dirname(f) for f in df.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    if tables:
        gc.collect()
        tables[0].sparkSession._jvm.System.gc()
