"""Streams end where batches do."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from frontgauge.operators import fronts
from frontgauge.streaming.archive import FrontArchive, FrontState
from frontgauge.streaming.monitor import WindowLog, error_monitor

T0 = datetime(2024, 1, 1)
SCHEMA = "ts timestamp_ntz, model string, e double"


def put(spark, folder, name, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{folder}/{name}")


def drain(stream, folder, schema):
    q = (
        stream.writeStream.format("parquet").option("path", f"{folder}/out")
        .option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    )
    q.awaitTermination()


def test_late_rows_and_restart(spark, tmp_path):
    src = f"{tmp_path}/in"
    at = lambda m: T0 + timedelta(minutes=m)
    put(spark, src, "a", [(at(m), "m1", float(m)) for m in range(0, 150, 10)])

    def run():
        rows = spark.readStream.schema(SCHEMA).parquet(f"{src}/*")
        drain(error_monitor(rows, ["model"], "ts", "e"), str(tmp_path), None)

    run()
    # the first hour is closed by now: this row comes too late
    put(spark, src, "b", [(at(5), "m1", 1000.0), (at(400), "m1", 1.0)])
    run()  # a new query going on from the stored state
    got = {r.window_start: (r.n, r.mean_error) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {at(0): (6, 25.0), at(60): (6, 85.0), at(120): (3, 130.0)}


def test_archive_equals_batch_front(spark, tmp_path):
    df = spark.range(600).selectExpr(
        "if(id % 3 = 0, 'a', 'b') as g", "id",
        "cast(id * 37 % 101 as double) as f1", "cast(id * 53 % 97 as double) as f2",
    )
    df.repartition(4).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    archive = FrontArchive(f"{tmp_path}/front", ["g"], ["f1", "f2"])
    archive.attach(stream, f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    want = sorted(tuple(r) for r in fronts.front2(df, ["g"], "f1", "f2").collect())
    got = sorted((r.g, r.id, r.f1, r.f2) for r in archive.read(spark).collect())
    assert got == want
    assert archive.versions(spark) <= 2


def test_front_in_state_equals_batch_front(spark, tmp_path):
    """Several batches, a restart from the checkpoint, copies, NULLs and a group without a name."""
    df = spark.range(600).selectExpr(
        "nullif(if(id % 3 = 0, 'a', if(id % 3 = 1, 'b', 'none')), 'none') as g", "nullif(id % 200, 7) as id",
        "nullif(cast(id * 37 % 101 as double), 50) as f1", "cast(id * 53 % 97 + (599 - id) as double) as f2",
        "timestamp_micros(id % 200) as ts",
    )
    df = df.union(df.where("id % 5 = 0"))
    front = FrontState(["g"], ["f1", "f2"], df.schema, parts=3)

    def run():
        stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
        out = front.changes(stream).writeStream.format("parquet").option("path", f"{tmp_path}/changes")
        out.option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()

    def rows(got):
        return sorted(map(tuple, got.select("g", "id", "f1", "f2", "ts").collect()), key=str)

    early, late = df.where("f2 > 300"), df.where("f2 <= 300")
    early.repartition(2).write.parquet(f"{tmp_path}/in/a")
    run()
    assert rows(front.read(spark, f"{tmp_path}/state")) == rows(fronts.front2(early, ["g"], "f1", "f2"))
    late.repartition(2).write.parquet(f"{tmp_path}/in/b")
    run()  # a new query, from the stored state
    want = rows(fronts.front2(df, ["g"], "f1", "f2"))
    assert rows(front.read(spark, f"{tmp_path}/state")) == want
    # what entered less what left is what is held
    log = spark.read.parquet(f"{tmp_path}/changes")
    assert log.where("not entered").count() > 0
    signed = F.sum(F.when(F.col("entered"), F.col("n")).otherwise(-F.col("n"))).cast("int")
    net = log.groupBy("g", "id", "f1", "f2", "ts").agg(signed.alias("n")).where("n <> 0")
    left = net.select("g", "id", "f1", "f2", "ts", F.explode(F.sequence(F.lit(1), "n")))
    assert rows(fronts.front2(left, ["g"], "f1", "f2")) == want


def test_archive_batch_run_again(spark, tmp_path):
    archive = FrontArchive(f"{tmp_path}/front", [], ["f1", "f2"])
    one = spark.createDataFrame([(1.0, 3.0), (3.0, 1.0)], "f1 double, f2 double")
    two = spark.createDataFrame([(2.0, 2.0), (1.0, 9.0)], "f1 double, f2 double")
    archive.merge(one, 0)
    archive.merge(two, 1)
    archive.merge(two, 1)
    assert sorted(tuple(r) for r in archive.read(spark).collect()) == [(1.0, 3.0), (2.0, 2.0), (3.0, 1.0)]


def test_late_rows_are_kept(spark, tmp_path):
    src = f"{tmp_path}/in"
    at = lambda m: T0 + timedelta(minutes=m)
    log = WindowLog(f"{tmp_path}/log", ["model"], "ts", "e")

    def run():
        rows = spark.readStream.schema(SCHEMA).parquet(f"{src}/*")
        log.attach(rows, f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()

    put(spark, src, "a", [(at(m), "m1", float(m)) for m in range(0, 150, 10)])
    run()
    put(spark, src, "b", [(at(5), "m1", 1000.0), (at(61), "m1", 1.0), (at(400), "m1", 1.0), (None, "m2", 5.0),
                          (at(130), "m2", None)])
    run()  # a new query, from the stored state
    got = {(r.window_start, r.model): (r.n, r.mean_error) for r in log.windows(spark).collect()}
    # time stood at 130 minutes: the first two hours had closed
    assert got == {(at(0), "m1"): (6, 25.0), (at(60), "m1"): (6, 85.0), (at(120), "m1"): (3, 130.0),
                   (at(360), "m1"): (1, 1.0), (at(120), "m2"): (1, None)}
    late = {(r.ts, r.model, r.e) for r in log.late_rows(spark).collect()}
    assert late == {(at(5), "m1", 1000.0), (at(61), "m1", 1.0), (None, "m2", 5.0)}
    # a batch that is run again counts once
    again = spark.read.schema(SCHEMA).parquet(f"{src}/b")
    log.merge(again, 1)
    assert log.windows(spark).agg(F.sum("n")).first()[0] + log.late_rows(spark).count() == 20
