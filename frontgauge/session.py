"""Session defaults, size limits and the shared folder for intermediate tables."""

from __future__ import annotations

import atexit
import gc
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Limits are session settings, so a cluster can raise them and a test can lower
# them until even a tiny table takes the large-data route.
LIMITS = {
    # rows of one group that one task may sort for a window
    "frontgauge.window.rows": 2_000_000,
    # rows of one group that one Python call may compare with each other
    "frontgauge.compare.rows": 8_192,
    # rows of a table that may be broadcast
    "frontgauge.broadcast.rows": 500_000,
    # and the bytes it may hold, written out as text
    "frontgauge.broadcast.bytes": 64_000_000,
    # points of one front that one Python call may sweep for a volume
    "frontgauge.sweep.rows": 200_000,
    # partners in one block of the nearest-point search
    "frontgauge.site.rows": 1_024,
}


def limit(spark: SparkSession, name: str) -> int:
    key = f"frontgauge.{name}"
    return int(spark.conf.get(key, str(LIMITS[key])))


def build_session(cores: int | str = "*", app: str = "frontgauge") -> SparkSession:
    """A local session for tests and the benchmark; clusters bring their own."""
    width = os.cpu_count() if cores == "*" else int(cores)
    shared = os.environ.get("FRONTGAUGE_SHARED") or _own_folder()
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(width))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("FRONTGAUGE_DRIVER_MEMORY", "8g"))
        .config("spark.checkpoint.dir", shared)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def _own_folder() -> str:
    """A folder on this machine, for local sessions only; gone when the program ends."""
    folder = tempfile.mkdtemp(prefix="frontgauge-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def use_checkpoint_dir(spark: SparkSession) -> str:
    """The folder for intermediate tables, named by spark.checkpoint.dir.

    Only a session on this one machine that names none gets a folder of its own.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", "") or sc.getCheckpointDir()
    if named:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(named)
        return named
    if not sc.master.startswith("local"):
        raise ValueError(
            "spark.checkpoint.dir is not set; a cluster needs a folder shared by all executors"
        )
    folder = _own_folder()
    sc.setCheckpointDir(folder)
    return folder


def clean(spark: SparkSession) -> None:
    """Delete the intermediate tables of this application; results that read them end here."""
    sc = spark.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(
        f"{use_checkpoint_dir(spark).rstrip('/')}/frontgauge-{sc.applicationId}"
    )
    path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def settle(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and go on from there.

    Used where a result feeds several later steps, or where its row placement
    must not change if a task is run again. A Parquet table, unlike
    DataFrame.checkpoint(), is counted from its footers, read by column, and
    carries no claim on how its rows are partitioned.
    """
    spark = df.sparkSession
    folder = use_checkpoint_dir(spark).rstrip("/")
    path = f"{folder}/frontgauge-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    kept = spark.read.schema(df.schema).parquet(path)
    kept.settled_in = path
    return kept


def discard(*tables: DataFrame) -> None:
    """Delete settled tables that nothing reads any more, and shuffle files of finished jobs.

    For operators whose steps each write much: what a step has settled is all that later
    steps need. Spark deletes the shuffle files of a finished job once the driver's garbage
    collector finds its plan, which may otherwise be much later.
    """
    for table in tables:
        sc = table.sparkSession.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(table.settled_in)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)
        gc.collect()
        sc._jvm.System.gc()
