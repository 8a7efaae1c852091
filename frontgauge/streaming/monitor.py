"""Error of a model while predictions arrive.

`error_monitor` is a windowed aggregate; as a stream it drops rows that come after their
window has closed. `WindowLog` drops none: it takes the stream batch by batch and writes
late rows to an output of their own, so windows and late rows together are all rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..functions.columns import ratio


def error_monitor(
    stream: DataFrame,
    keys: Sequence[str],
    ts: str,
    error: str,
    width: str = "1 hour",
    late: str = "10 minutes",
) -> DataFrame:
    """Count, mean error and RMSE per tumbling window; works on streams and on tables.

    Rows later than the watermark are dropped by the stream. `ts` without a time
    zone is taken as UTC (set the session time zone accordingly).
    """
    timed = stream.withColumn("_ts", F.col(ts).cast("timestamp"))
    if stream.isStreaming:
        timed = timed.withWatermark("_ts", late)
    e = F.col(error)
    return (
        timed.groupBy(F.window("_ts", width).alias("_w"), *keys)
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.avg(e).alias("mean_error"),
            F.sqrt(F.avg(e * e)).alias("rmse"),
        )
        .select(F.col("_w.start").alias("window_start"), *keys, "n", "mean_error", "rmse")
    )


class WindowLog:
    """Window sums per micro-batch, the rows that came too late, and how far time has come.

    Time stands at the latest `ts` of all earlier batches, less `late`. A row is late if its
    window has ended by then; late rows are kept whole, in the folder of their batch. Other
    rows are summed up by window and key. A row without a time belongs to no window, and is
    kept with the late ones. A batch run again (after a failure) sees the same earlier
    batches and overwrites its own folders, so nothing counts twice.
    """

    def __init__(
        self, path: str, keys: Sequence[str], ts: str, error: str, width: str = "1 hour", late: str = "10 minutes"
    ):
        self.path, self.keys, self.ts, self.error = path.rstrip("/"), list(keys), ts, error
        self.width, self.late = width, late

    def _earlier(self, spark: SparkSession, batch_id: int) -> DataFrame:
        """(_batch, _top): the latest time in each batch before this one."""
        tops = spark.read.schema("_batch long, _top timestamp").option("recursiveFileLookup", "true")
        return tops.parquet(f"{self.path}/time").where(F.col("_batch") < batch_id)

    def _exists(self, spark: SparkSession, folder: str) -> bool:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{folder}")
        return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)

    def merge(self, batch: DataFrame, batch_id: int) -> None:
        spark, name = batch.sparkSession, f"batch-{batch_id}"
        top = None
        if self._exists(spark, "time"):
            top = self._earlier(spark, batch_id).agg(F.max("_top")).first()[0]
        e, columns = F.col(self.error), batch.columns
        # a window drops rows without a time, so they get one until they are set aside
        some = F.coalesce("_ts", F.timestamp_seconds(F.lit(0)))
        rows = batch.withColumn("_ts", F.col(self.ts).cast("timestamp")).withColumn("_any", some)
        rows = rows.withColumn("_w", F.window("_any", self.width))
        closed = F.col("_w.end") <= F.lit(top).cast("timestamp") - F.expr(f"INTERVAL {self.late}")
        rows = rows.withColumn("_late", F.col("_ts").isNull() | F.coalesce(closed, F.lit(False)))
        rows.where("_late").select(*columns).write.mode("overwrite").parquet(f"{self.path}/late/{name}")
        rows.where("not _late").groupBy(F.col("_w.start").alias("window_start"), *self.keys).agg(
            F.count(F.lit(1)).alias("n"), F.count(e).alias("_m"), F.sum(e).alias("_s"), F.sum(e * e).alias("_ss")
        ).write.mode("overwrite").parquet(f"{self.path}/windows/{name}")
        # time goes on only with the batch, when all else of it is written
        rows.agg(F.max("_ts").alias("_top")).select(F.lit(batch_id).cast("long").alias("_batch"), "_top").write.mode(
            "overwrite"
        ).parquet(f"{self.path}/time/{name}")

    def attach(self, stream: DataFrame, checkpoint: str) -> DataStreamWriter:
        return stream.writeStream.foreachBatch(self.merge).option("checkpointLocation", checkpoint)

    def windows(self, spark: SparkSession) -> DataFrame:
        """As `error_monitor`: window_start, keys, n, mean_error, rmse."""
        m = F.sum("_m")
        parts = spark.read.parquet(f"{self.path}/windows/*")
        return parts.groupBy("window_start", *self.keys).agg(
            F.sum("n").alias("n"),
            ratio(F.sum("_s"), m).alias("mean_error"),
            F.sqrt(ratio(F.sum("_ss"), m)).alias("rmse"),
        )

    def late_rows(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.path}/late/*")
