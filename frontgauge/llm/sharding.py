"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

The key of a document is its text, so equal texts share a place on the ring. Every
shard may take floor or ceil of rows / shards; keys that find it full go on clockwise
to the next shard with room. So counts differ by one at most, and a document leaves
its first shard only where that is full. Many virtual nodes keep the shards' natural
loads close, so that few rows overflow, and few old rows move when a shard is added.

DataFrame functions only. The ring has shards * virtual nodes arcs, a parameter and
not data, so the counts per arc are the only rows that reach the driver; where the
rows of an arc go is worked out from those counts. A row then needs its rank within
its arc. The rows of an arc follow one another text by text, so each place where an arc
is cut between two shards parts one text at most. The copies of a text are ranked in
parts by hash of the id, since one text may hold a third of all rows.
"""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from frontgauge.llm import common
from frontgauge.llm.common import running_total, settle, unit_hash

SHARDS = 8
VIRTUAL_NODES = 512
# Places on the ring.
RING = 1 << 16


def ring(shards: int, nodes: int) -> tuple[list[int], list[int]]:
    """Positions of the virtual nodes, ascending, and the shard of each."""
    points = sorted(
        (zlib.crc32(f"{s}/{v}".encode()) % RING, s) for s in range(shards) for v in range(nodes)
    )
    return [p for p, _ in points], [s for _, s in points]


def clockwise(owners: list[int]) -> list[list[int]]:
    """For each arc, all shards in the order in which one meets them from there on."""
    order = list(dict.fromkeys(owners))
    orders = []
    for owner in reversed(owners):
        order = [owner, *(s for s in order if s != owner)]
        orders.append(order)
    return orders[::-1]


def place_counts(counts: list[int], owners: list[int], room: list[int]) -> list[list[tuple[int, int]]]:
    """For each arc, how many of its rows go to which shard, in the order they are dealt.

    Round r offers what is left of an arc to the r-th distinct shard clockwise; a shard
    takes from the arcs in ring order until it is full.
    """
    shards, left, room = len(room), list(counts), list(room)
    orders = clockwise(owners)
    dealt: list[list[tuple[int, int]]] = [[] for _ in owners]
    for r in range(shards):
        for i, order in enumerate(orders):
            if left[i] and r < len(order):
                took = min(left[i], room[order[r]])
                if took:
                    dealt[i].append((order[r], took))
                    room[order[r]] -= took
                    left[i] -= took
    return dealt


def arcs_of(spark: SparkSession, shards: int, virtual_nodes: int) -> DataFrame:
    """(_at, _arc) for each of the RING places: its first virtual node at or after it, or node 0."""
    nodes = shards * virtual_nodes
    name = F.format_string("%d/%d", F.floor(F.col("id") / virtual_nodes), F.col("id") % virtual_nodes)
    at = F.pmod(F.crc32(name.cast("binary")), F.lit(RING)).alias("_at")
    taken = spark.range(nodes).groupBy(at).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    places = spark.range(RING).withColumnRenamed("id", "_at").join(F.broadcast(taken), "_at", "left")
    passed = F.coalesce(F.sum("_n").over(before), F.lit(0))
    return places.select("_at", F.pmod(passed, F.lit(nodes)).cast("int").alias("_arc"))


def shard(
    docs: DataFrame,
    shards: int = SHARDS,
    virtual_nodes: int = VIRTUAL_NODES,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for every row.

    size: UTF-8 bytes + 1. NULL text counts as empty text (size 1, crc 0). NULL ids and
    repeated rows are placed like any other; rows alike in id and text are
    interchangeable. slot: 0, 1, 2 ... within the shard. Long texts are only hashed. No
    rows give no rows. Other columns of `docs` are not read.
    """
    _, owners = ring(shards, virtual_nodes)
    text = F.coalesce(F.col(text_col), F.lit(""))
    spark = docs.sparkSession
    keyed = settle(
        docs.select(
            F.col(id_col).alias("doc_id"),
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.xxhash64(text).alias("_text"),
        )
    )
    total = keyed.count()
    # copies of a text are ranked in parts of about common.BUCKET_ROWS of all rows
    parts = max(1, -(-total // common.BUCKET_ROWS))
    part = F.least(F.floor(unit_hash("doc_id") * parts), F.lit(parts - 1)).cast("long")
    arcs = F.broadcast(arcs_of(spark, shards, virtual_nodes))  # RING rows whatever the input
    unit = ["_text", "text_crc32", "size", "_part"]
    units = keyed.withColumn("_part", part).groupBy(*unit).agg(F.count(F.lit(1)).alias("_n"))
    units = settle(
        units.withColumn("_at", F.pmod("_text", F.lit(RING))).join(arcs, "_at").drop("_at")
    )
    counts = [0] * len(owners)
    for arc, n in units.groupBy("_arc").agg(F.sum("_n")).collect():
        counts[arc] = n
    room = [total // shards + (s < total % shards) for s in range(shards)]
    dealt = place_counts(counts, owners, room)

    # per arc: upper ranks of its pieces, their shards, and slot minus rank for each
    used = [0] * shards
    plan = []
    for arc, pieces in enumerate(dealt):
        rank, tops, takers, shifts = 0, [], [], []
        for s, took in pieces:
            shifts.append(used[s] - rank)
            rank += took
            used[s] += took
            tops.append(rank)
            takers.append(s)
        plan.append((arc, tops, takers, shifts))
    plan = F.broadcast(  # one row an arc, shards * virtual nodes rows whatever the input
        spark.createDataFrame(plan, "_arc int, _tops array<bigint>, _shards array<int>, _shifts array<bigint>")
    )
    first = running_total(
        units.withColumn("_place", unit_hash("_text")), ["_arc"], "_place", unit, "_n", units.count(), "_first"
    ).select(*unit, "_arc", "_first")
    inside = Window.partitionBy(*unit).orderBy("doc_id")
    placed = keyed.withColumn("_part", part).join(first, unit).join(plan, "_arc")
    placed = placed.withColumn("_rank", F.col("_first") + F.row_number().over(inside) - 1)
    piece = F.size(F.filter("_tops", lambda top: top <= F.col("_rank")))
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        F.get("_shards", piece).alias("shard"),
        (F.col("_rank") + F.get("_shifts", piece)).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def movement(docs: DataFrame, shards: int = SHARDS, virtual_nodes: int = VIRTUAL_NODES) -> DataFrame:
    """One row (n_rows, to_new, between_old): what one more shard moves.

    `to_new` rows go to the new shard, `between_old` ones from an old shard to another;
    rows alike in id and text are told apart by number only. No rows: zeros.
    """
    row = ["doc_id", "size", "text_crc32", "shard"]
    before, after = (
        shard(docs, n, virtual_nodes).groupBy(*row).agg(F.count(F.lit(1)).alias("n")) for n in (shards, shards + 1)
    )
    both = before.withColumn("_was", F.col("n")).unionByName(
        after.withColumn("_was", -F.col("n"))
    )
    left = both.groupBy(*row).agg(F.sum("_was").alias("_left"), F.sum(F.greatest("_was", F.lit(0))).alias("n"))
    def total(c):
        return F.coalesce(F.sum(c), F.lit(0)).cast("long")

    to_new = total(F.when(F.col("shard") == shards, -F.col("_left")))
    moved = total(F.greatest("_left", F.lit(0)))
    return left.agg(total("n").alias("n_rows"), to_new.alias("to_new"), (moved - to_new).alias("between_old"))
