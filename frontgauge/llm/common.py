"""Steps that several training-data operators share."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from frontgauge.session import settle

# Words are runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
# Rows that one bucket of a distributed running sum holds on average.
BUCKET_ROWS = 4_096
# Rows of a lookup table that may be broadcast; its rows hold a few numbers each.
LOOKUP_ROWS = 50_000
# Rows and bytes of an Arrow batch that holds whole texts (one text may be longer).
TEXT_ROWS = 1_000
TEXT_BYTES = 8 << 20
# Edges of a graph that one task joins to components (16 bytes each).
LOCAL_EDGES = 500_000


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Ask for Arrow batches of TEXT_ROWS rows and TEXT_BYTES at most, where the session allows more.

    Both a task and its Python worker hold whole batches; ten thousand long texts, the
    default, take hundreds of megabytes on either side.
    """
    prefix = "spark.sql.execution.arrow."
    if not 0 < int(spark.conf.get(prefix + "maxRecordsPerBatch", "10000")) <= TEXT_ROWS:
        spark.conf.set(prefix + "maxRecordsPerBatch", str(TEXT_ROWS))
    in_bytes = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes
    if in_bytes(spark.conf.get(prefix + "maxBytesPerBatch", "64m")) > TEXT_BYTES:
        spark.conf.set(prefix + "maxBytesPerBatch", str(TEXT_BYTES))


def n_words(text: Column) -> Column:
    """Number of words of a text; NULL has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def fold_of(doc_id: Column, folds: int) -> Column:
    """crc32 of the id written as text, modulo the number of folds."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def unit_hash(*columns: Column) -> Column:
    """A hash in [0, 1) that depends on the values only."""
    return F.shiftrightunsigned(F.xxhash64(*columns), 11) / F.lit(float(1 << 53))


def small_lookup(df: DataFrame) -> DataFrame:
    """Settle a lookup table, and mark it for broadcast only if its counted rows are few."""
    kept = settle(df)
    return F.broadcast(kept) if kept.count() <= LOOKUP_ROWS else kept


def running_total(
    df: DataFrame, group: list[str], place: str, ties: list[str], size: str, rows: int, out: str
) -> DataFrame:
    """Add `out`: the sum of `size` over the rows of the group that come earlier.

    The order is by `place` (a double in [0, 1), spread evenly) and then `ties`. The
    unit interval is cut into buckets of about BUCKET_ROWS of the `rows` rows, so a
    group of any size is summed by many tasks: totals per bucket, their running sum,
    then a window inside each bucket. Group columns must not be NULL.
    """
    buckets = max(1, -(-rows // BUCKET_ROWS))
    cut = df.withColumn(
        "_bucket", F.least(F.floor(F.col(place) * buckets), F.lit(buckets - 1)).cast("long")
    )
    keys = [*group, "_bucket"]
    before = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = cut.groupBy(*keys).agg(F.sum(size).alias("_sum")).select(
        *keys, F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base")
    )
    inside = (
        Window.partitionBy(*keys).orderBy(place, *ties).rowsBetween(Window.unboundedPreceding, -1)
    )
    return (
        cut.join(base, keys)
        .withColumn(out, F.col("_base") + F.coalesce(F.sum(size).over(inside), F.lit(0)))
        .drop("_bucket", "_base")
    )


class Forest:
    """Union-find over any numbers; the root of a tree is its smallest member."""

    def __init__(self):
        self._up: dict[int, int] = {}

    def find(self, x: int) -> int:
        up = self._up
        root = x
        while (above := up.get(root, root)) != root:
            root = above
        while x != root:
            up[x], x = root, up.get(x, x)
        return root

    def union(self, a: int, b: int) -> bool:
        """Whether a and b were apart."""
        a, b = self.find(a), self.find(b)
        if a != b:
            self._up[max(a, b)] = min(a, b)
            self._up.setdefault(min(a, b), min(a, b))
        return a != b

    def pairs(self) -> list[tuple[int, int]]:
        return [(x, self.find(x)) for x in list(self._up)]


def components(edges: DataFrame, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """Settled (node, component): the smallest node that each node of `edges` (a, b) reaches.

    Up to `local_edges` different edges are joined by one task. More are joined by
    alternating large-star and small-star steps until nothing changes; each step is a few
    shuffles over what is left of the edges, and is settled, so lineage stays short and
    only a row of sums reaches the driver. Both ways give the same table. Nodes without
    an edge to another node are absent.
    """
    def stats(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.hash("a", "b").cast("long"))).first())

    current = settle(
        edges.where("a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )
    seen = stats(current)
    if seen[0] <= local_edges:
        return settle(current.coalesce(1).mapInArrow(_join_all, "node long, component long"))
    while True:
        both = current.union(current.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(
            "a", F.least("a", "m").alias("m")
        )
        large = (
            both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        ).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(least, "a")
            .select(
                F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"),
                F.col("m").alias("b"),
            )
            .where("a <> b")
            .distinct()
        )
        current = settle(small)
        now = stats(current)
        if now == seen:
            break
        seen = now
    return settle(
        current.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
            current.select("b", "b").distinct()
        )
    )


def _join_all(batches):
    forest = Forest()
    for batch in batches:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()):
            forest.union(a, b)
    pairs = forest.pairs()
    yield pa.RecordBatch.from_arrays(
        [pa.array([p[i] for p in pairs], pa.int64()) for i in (0, 1)], names=["node", "component"]
    )
