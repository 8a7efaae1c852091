"""The same tables read as streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import uniform
from ..session import use_checkpoint_dir
from ..sources.tables import TABLES, load
from ..streaming.archive import FrontArchive, FrontState
from ..streaming.monitor import WindowLog, error_monitor
from . import inputs as I
from .registry import query

BATCHES = 4


def _stream(spark, folder, name):
    schema = T._parse_datatype_string(TABLES[name])
    # a stream reads a pattern; this one matches the table alone
    return spark.readStream.schema(schema).parquet(f"{folder.rstrip('/')}/{name}[.]parquet")


def _work(spark, name):
    return f"{use_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


_WINDOWS = """WITH e AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type,
    (('0x' || substr(md5('e:' || event_id), 1, 8))::BIGINT / 4294967296.0) - 0.5 AS e, ts FROM events)
  SELECT window_start, event_type, count(*) AS n, avg(e) AS mean_error, sqrt(avg(e * e)) AS rmse FROM e
  GROUP BY window_start, event_type"""


def _errors(df):
    return df.withColumn("e", uniform(F.lit("e"), F.col("event_id")) - 0.5)


@query(f"SELECT * REPLACE (window_start::TIMESTAMP AS window_start) FROM ({_WINDOWS})", ["mean_error", "rmse"])
def window_errors(spark, folder):
    """The monitor over the table at once."""
    df = _errors(spark.read.parquet(f"{folder}/events.parquet"))
    got = error_monitor(df, ["event_type"], "ts", "e")
    return got.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query(f"SELECT * REPLACE (window_start::TIMESTAMP AS window_start) FROM ({_WINDOWS})", ["mean_error", "rmse"])
def window_errors_stream(spark, folder):
    """The monitor over a stream: every window as its last update left it."""
    got = error_monitor(_errors(_stream(spark, folder, "events")), ["event_type"], "ts", "e")
    work = _work(spark, "windows")

    def keep(batch, batch_id):
        batch.withColumn("batch", F.lit(batch_id)).write.mode("overwrite").parquet(f"{work}/rows/batch-{batch_id}")

    run = (
        got.writeStream.foreachBatch(keep)
        .option("checkpointLocation", f"{work}/state")
        .outputMode("update")
        .trigger(availableNow=True)
        .start()
    )
    run.awaitTermination()
    updates = spark.read.parquet(f"{work}/rows/*")
    last = F.max_by(F.struct("n", "mean_error", "rmse"), "batch").alias("_l")
    done = updates.groupBy("window_start", "event_type").agg(last).select("window_start", "event_type", "_l.*")
    return done.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


def _arrivals(spark, folder, work):
    rows = load(spark, folder, "part").select(
        F.col("p_brand").alias("problem"),
        F.col("p_partkey").alias("id"),
        F.col("p_retailprice").alias("f1"),
        (-F.col("p_size").cast("double")).alias("f2"),
    )
    rows.repartition(BATCHES, "id").write.parquet(f"{work}/arrivals")
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{work}/arrivals")


@query(f"WITH {I.PARTS}, {I.FRONT2} SELECT * FROM front2")
def front_archive_stream(spark, folder):
    """Candidates arrive in several micro-batches; the archive must end as the front of all."""
    work = _work(spark, "archive")
    stream = _arrivals(spark, folder, work)
    archive = FrontArchive(f"{work}/front", ["problem"], ["f1", "f2"])
    archive.attach(stream, f"{work}/state").trigger(availableNow=True).start().awaitTermination()
    return archive.read(spark)


@query(f"WITH {I.PARTS}, {I.FRONT2} SELECT * FROM front2")
def front_state_stream(spark, folder):
    """As front_archive_stream, with the front in the stream's state; read from there at the end."""
    work = _work(spark, "front")
    stream = _arrivals(spark, folder, work)
    front = FrontState(["problem"], ["f1", "f2"], stream.schema)
    log = front.changes(stream).writeStream.format("parquet").option("path", f"{work}/changes")
    log.option("checkpointLocation", f"{work}/state").trigger(availableNow=True).start().awaitTermination()
    return front.read(spark, f"{work}/state")


@query(
    """SELECT time_bucket(INTERVAL 1 HOUR, ts)::TIMESTAMP AS window_start, event_type, count(*) AS n
    FROM events GROUP BY ALL"""
)
def window_errors_with_late_rows(spark, folder):
    """Events arrive out of order: those in windows and those that came too late are all events."""
    work = _work(spark, "late")
    rows = _errors(load(spark, folder, "events")).select("event_id", "ts", "event_type", "e")
    rows.repartition(BATCHES, "event_id").write.parquet(f"{work}/arrivals")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{work}/arrivals")
    log = WindowLog(f"{work}/log", ["event_type"], "ts", "e")
    log.attach(stream, f"{work}/state").trigger(availableNow=True).start().awaitTermination()
    start = F.window(F.col("ts").cast("timestamp"), "1 hour")["start"].alias("window_start")
    late = log.late_rows(spark).groupBy(start, "event_type").agg(F.count(F.lit(1)).alias("n"))
    both = log.windows(spark).select("window_start", "event_type", "n").unionByName(late)
    done = both.groupBy("window_start", "event_type").agg(F.sum("n").alias("n"))
    return done.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))
