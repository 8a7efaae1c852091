"""Mixing sources to target weights by a low-discrepancy schedule.

The mix is a row of slots of equal token count. Slot i belongs to the source whose
stretch of the cumulative target weights holds the i-th golden-ratio point, so every
stretch of the schedule is close to the target mix, not just the whole. Within its
source a slot has a rank, and draws the block of that rank from the source's
documents, laid out in hashed order as one stream of words that starts again when it
is used up.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from frontgauge.llm.common import WORD, n_words, running_total, settle, unit_hash

BLOCK_WORDS = 4_096
SHARE = 1.5
MOST = 2.0
WEIGHTS = (3.0, 1.0, 2.0)
# Sources are the mix's settings and are weighed on the driver; more than this is refused.
MOST_SOURCES = 1_000_000
GOLDEN = 0.6180339887498949
# What lies between words.
SPACE = r"[\x20\x09-\x0D]"


def targets(sizes: list[int], weights: list[float], share: float, most: float) -> list[float]:
    """Words per source: `share` of all by weight, none above `most` times its size.

    What a source cannot take is shared again by weight among those with room.
    """
    goal, free = share * sum(sizes), list(range(len(sizes)))
    out = [0.0] * len(sizes)
    while free:
        rest = goal - sum(out)
        heavy = sum(weights[i] for i in free)
        over = [i for i in free if rest * weights[i] / heavy > most * sizes[i]]
        for i in over or free:
            out[i] = most * sizes[i] if over else rest * weights[i] / heavy
        free = [i for i in free if i not in set(over)] if over else []
    return out


def golden_points(i: np.ndarray) -> np.ndarray:
    """frac((i + 1/2) * golden ratio), in 64-bit fixed point so that large i stay exact."""
    step = np.uint64(round(GOLDEN * 2**64) & (2**64 - 1))
    with np.errstate(over="ignore"):
        return (i.astype(np.uint64) * step + (step >> np.uint64(1))) / 2.0**64


def schedule(spark, goals: list[int], block: int) -> DataFrame:
    """(slot, source_no, block_no): slots in mixing order, each a block of its source.

    Blocks that the low-discrepancy draw leaves out (a few per source at most) are
    appended, and slots past a source's goal are left out, so every source's blocks
    0 .. ceil(goal / block) - 1 are scheduled exactly once.
    """
    total = sum(goals)
    slots = -(-total // block)
    bounds = np.cumsum(np.array(goals, dtype=float)) / max(total, 1)
    last = max((i for i, g in enumerate(goals) if g), default=0)

    def owners(batches):
        for b in batches:
            no = np.searchsorted(bounds, golden_points(b["slot"].to_numpy()), side="right")
            yield pd.DataFrame({"slot": b["slot"], "source_no": np.minimum(no, last)})

    drawn = spark.range(slots).withColumnRenamed("id", "slot").mapInPandas(
        owners, "slot long, source_no int"
    )
    ranked = settle(
        running_total(
            drawn.withColumn("_one", F.lit(1)).withColumn("_place", F.col("slot") / F.lit(float(max(slots, 1)))),
            ["source_no"], "_place", ["slot"], "_one", slots, "block_no",
        ).select("slot", "source_no", "block_no")
    )
    got = dict(ranked.groupBy("source_no").count().collect())
    needed = [-(-g // block) for g in goals]
    frame = spark.createDataFrame(
        [(i, n, got.get(i, 0)) for i, n in enumerate(needed)],
        "source_no int, _needed long, _got long",
    )
    late = frame.where("_needed > _got").select(
        "source_no", F.explode(F.sequence("_got", F.col("_needed") - 1)).alias("block_no")
    )
    limits = frame.select("source_no", "_needed")
    kept = ranked.join(limits, "source_no").where("block_no < _needed").select(
        "slot", "source_no", "block_no"
    )
    late = late.select(
        (F.lit(slots) + F.col("block_no") * len(goals) + F.col("source_no")).alias("slot"),
        "source_no",
        "block_no",
    )
    return kept.union(late)


def copies_numbered(sized: DataFrame) -> DataFrame:
    """Settled rows (row, key, ...) with `copy`: 0, 1, 2 ... among the rows of one key.

    Which of them has which number does not matter, as they are alike; the numbers are the
    same however the rows were read. Keys of one row, nearly all, take no part in the work.
    A key's rows are counted part by part of the read, so a key may hold any share of them.
    """
    again = settle(sized.groupBy("key").agg(F.count("*").alias("_n")).where("_n > 1").select("key"))
    if again.isEmpty():
        return sized.withColumn("copy", F.lit(0).cast("long"))
    part = F.shiftright("row", 33)  # the partition that numbered the row
    some = sized.join(again, "key").withColumn("_part", part)
    earlier = Window.partitionBy("key").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = some.groupBy("key", "_part").agg(F.count("*").alias("_n")).select(
        "key", "_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before")
    )
    inside = Window.partitionBy("key", "_part").orderBy("row")
    numbered = (
        some.withColumn("copy", F.row_number().over(inside) - 1)
        .join(before, ["key", "_part"])
        .withColumn("copy", F.col("copy") + F.col("_before"))
        .select(*sized.columns, "copy")
    )
    return settle(
        sized.join(again, "key", "left_anti").select(*sized.columns, F.lit(0).cast("long").alias("copy"))
        .union(numbered)
    )


def mix(
    docs: DataFrame,
    share: float = SHARE,
    most: float = MOST,
    weights: tuple[float, ...] = WEIGHTS,
    block: int = BLOCK_WORDS,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    row_col: str | None = None,
) -> DataFrame:
    """Pieces of documents in mixing order, one row per document and slot it meets.

    Columns: row (one per input row), doc_id, size, source, source_size, target, pass,
    slot, start, length. Documents that the mix takes no words of have one row with
    NULL pass, slot and start and length 0. A document's words start .. start + length
    go to the slot; pass 0 is the first use of its source, pass 1 the second.

    Sources are taken by code point with NULL last, and weighed by `weights` in turn.
    A source's documents are laid out by a hash of id, source and text, so the mix depends on
    the rows alone and not on how they are read. A NULL id is an id like any other; repeated
    rows are mixed each on its own; NULL or empty text has size 0 and is never taken. An empty table, or one without a word,
    gives targets of 0. Other columns are not read. `row_col` names a column of
    monotonically_increasing_id() that already numbers the rows; without it they are
    numbered here.
    """
    spark = docs.sparkSession
    sized = settle(
        docs.select(
            F.col(id_col).alias("doc_id"),
            F.col(source_col).alias("source"),
            n_words(F.col(text_col)).alias("size"),
            F.xxhash64(F.col(id_col), F.col(source_col), F.col(text_col)).alias("key"),
            (F.col(row_col) if row_col else F.monotonically_increasing_id()).alias("row"),
        )
    )
    by_source = sized.groupBy("source").agg(F.sum("size"), F.count("*"))
    found = by_source.limit(MOST_SOURCES + 1).collect()
    if len(found) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    found.sort(key=lambda r: (r[0] is None, (r[0] or "").encode()))
    sizes = [r[1] for r in found]
    goals = targets(sizes, [weights[i % len(weights)] for i in range(len(found))], share, most)
    whole = [min(round(g), int(most * s)) for g, s in zip(goals, sizes)]

    plan = spark.createDataFrame(
        [(i, r[0], s, g, w) for i, (r, s, g, w) in enumerate(zip(found, sizes, goals, whole))],
        "source_no int, source string, source_size long, target double, _goal long",
    )
    numbered = copies_numbered(sized)
    known = numbered.join(
        plan, numbered["source"].eqNullSafe(plan["source"])
    ).drop(plan["source"])
    laid = running_total(
        known.withColumn("_place", unit_hash("key", "copy")),
        ["source_no"], "_place", ["key", "copy"], "size", sum(r[2] for r in found), "_at",
    )
    # every use of a source lays its stream out once more, behind the last
    uses = F.when(
        (F.col("size") > 0) & (F.col("_goal") > 0),
        F.sequence(F.lit(0), F.floor((F.col("_goal") - 1) / F.col("source_size")).cast("int")),
    ).otherwise(F.array(F.lit(None).cast("int")))
    first = F.col("_at") + F.col("pass") * F.col("source_size")
    spread = laid.withColumn("pass", F.explode(uses)).withColumn("_first", first).withColumn(
        "_end", F.least(F.col("_first") + F.col("size"), F.col("_goal"))
    )
    blocks = F.when(
        F.col("_end") > F.col("_first"),
        F.sequence(
            F.floor(F.col("_first") / block), F.floor((F.col("_end") - 1) / block)
        ),
    ).otherwise(F.array(F.lit(None).cast("long")))
    pieces = spread.withColumn("block_no", F.explode(blocks))
    low = F.greatest(F.col("_first"), F.col("block_no") * block)
    high = F.least(F.col("_end"), (F.col("block_no") + 1) * block)
    return pieces.join(
        schedule(spark, whole, block), ["source_no", "block_no"], "left"
    ).select(
        "row",
        "doc_id",
        "size",
        "source",
        "source_size",
        "target",
        "pass",
        "slot",
        (low - F.col("_first")).alias("start"),
        F.when(F.col("slot").isNotNull(), high - low).otherwise(F.lit(0)).cast("long").alias("length"),
    )


def taken(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, size, source_size, target, taken): the mix summed up per input row."""
    return (
        mix(docs, **options)
        .groupBy("row", "doc_id", "size", "source_size", "target")
        .agg(F.sum("length").alias("taken"))
        .drop("row")
    )


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """Rows of `docs`, each as often as the mix uses its document.

    The document at a source's goal is cut: that use has the words that the mix takes,
    which are its first ones, so every source has its goal to the word. Columns are those
    of `docs`; in a cut row a column n_chars is the length of the text that is left.
    """
    text = options.get("text_col", "text")
    row, words, size = "_row", "_words", "_size"
    while {row, words, size} & set(docs.columns):
        row, words, size = row + "_", words + "_", size + "_"
    kept = settle(docs.withColumn(row, F.monotonically_increasing_id()))
    uses = (
        mix(kept, row_col=row, **options)
        .groupBy("row", "pass", "size")
        .agg(F.sum("length").alias(words))
        .where(F.col(words) > 0)
        .select(F.col("row").alias(row), words, F.col("size").alias(size))
    )
    cut = F.col(words) < F.col(size)
    # words with the white space before them, so what is left is as it was
    pieces = F.regexp_extract_all(text, F.lit(rf"{SPACE}*{WORD}"), F.lit(0))
    left = F.array_join(F.slice(pieces, F.lit(1), F.col(words).cast("int")), "")
    out = kept.join(uses, row).withColumn(text, F.when(cut, left).otherwise(F.col(text)))
    if "n_chars" in docs.columns:
        n_chars = F.length(text).cast(docs.schema["n_chars"].dataType)
        out = out.withColumn("n_chars", F.when(cut, n_chars).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)
