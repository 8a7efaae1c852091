"""Packing documents into token sequences along a space-filling curve.

Every document becomes token ids (byte-level BPE, then id 0) and a point: its ids are
hashed to DIMENSIONS coordinates, and the point's place on a Hilbert curve orders the
documents, so neighbours on the curve have like vocabulary and share sequences.
Documents are range-partitioned by that place into buckets of bounded size (ties, such
as copies, are split by a hash of the id), and every bucket is a stretch of one stream
of tokens that is cut every SEQUENCE ids. The end of the stream is cut at powers of
two, so no sequence needs padding.

Token ids are settled once, as 16-bit numbers, and read again for the cut; texts are
tokenised once. Offsets of the buckets come from their token totals, one small row each.
"""

from __future__ import annotations

import base64
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from frontgauge.llm.common import settle, small_batches

SEQUENCE = 1_024
END = 0
DIMENSIONS = 3
LEVELS = 10
# Tokens of one bucket aimed at.
BUCKET_TOKENS = 4_000_000
# Buckets whose token totals one task sums.
STRETCH = 1_024
RANKS = "byte_bpe_50k.tiktoken"


class Tokenizer:
    """Ids of byte_bpe_50k, equal to those of byte_bpe_50k.json (a test compares them).

    The vocabulary has the same ranks in both files. A text goes through in one call:
    remembering the ids of its words costs more than it saves where many words are rare.
    """

    def __init__(self, ranks: str | None = None):
        import public_tokenizers
        import tiktoken

        with open(ranks or public_tokenizers.path(RANKS), "rb") as lines:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self._encoding = tiktoken.Encoding(
            "byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={}
        )

    def __call__(self, text: str) -> np.ndarray:
        """Ids of a text as 16-bit numbers, with END behind them."""
        ids = self._encoding.encode_ordinary(text)
        ids.append(END)
        return np.array(ids, dtype="<u2")


def directions(dimensions: int = DIMENSIONS) -> np.ndarray:
    """A sign per id and dimension, from a hash of both."""
    ids = np.arange(1 << 16, dtype=np.uint64)
    with np.errstate(over="ignore"):
        x = (ids + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(32)
    return np.stack(
        [((x >> np.uint64(7 * k)) & np.uint64(1)).astype(np.int64) * 2 - 1 for k in range(dimensions)]
    )


def hilbert(cells: np.ndarray, levels: int = LEVELS) -> np.ndarray:
    """Place on the Hilbert curve of integer points (n, dimensions), each 0 .. 2^levels - 1.

    Skilling's transform: exchange and invert the lower bits level by level, then take
    the Gray code across the coordinates.
    """
    x = cells.astype(np.int64).copy()
    n = x.shape[1]
    bit = 1 << (levels - 1)
    while bit > 1:
        low = bit - 1
        for i in range(n):
            high = (x[:, i] & bit) != 0
            swap = (x[:, 0] ^ x[:, i]) & low
            x[:, 0] = np.where(high, x[:, 0] ^ low, x[:, 0] ^ swap)
            x[:, i] = np.where(high, x[:, i], x[:, i] ^ swap)
        bit >>= 1
    for i in range(1, n):
        x[:, i] ^= x[:, i - 1]
    flip = np.zeros(len(x), dtype=np.int64)
    bit = 1 << (levels - 1)
    while bit > 1:
        flip = np.where(x[:, n - 1] & bit, flip ^ (bit - 1), flip)
        bit >>= 1
    x ^= flip[:, None]
    place = np.zeros(len(x), dtype=np.int64)
    for level in range(levels - 1, -1, -1):
        for i in range(n):
            place = (place << 1) | ((x[:, i] >> level) & 1)
    return place


def place_of(ids: list[np.ndarray], signs: np.ndarray, levels: int = LEVELS) -> np.ndarray:
    """Hilbert places of documents, from the mean direction of their ids."""
    lengths = np.array([len(x) for x in ids])
    flat = np.concatenate(ids)
    starts = np.cumsum(lengths) - lengths
    cells = []
    for row in signs:
        sums = np.add.reduceat(row[flat], starts)
        # the sum of n signs spreads by sqrt(n); through the middle of a bell, evenly spread
        spread = 1.0 / (1.0 + np.exp(-1.7 * sums / np.sqrt(lengths)))
        cells.append(np.minimum((spread * (1 << levels)).astype(np.int64), (1 << levels) - 1))
    return hilbert(np.stack(cells, axis=1), levels)


def cuts(total: int, start: int, end: int, sequence: int = SEQUENCE) -> list[int]:
    """Places in (start, end) where a stream of `total` ids is cut, ascending.

    Every `sequence` ids, and behind the last whole sequence at falling powers of two.
    """
    whole = total - total % sequence
    first = (start // sequence + 1) * sequence
    out = list(range(first, min(end, whole + 1), sequence))
    at, left = whole, total - whole
    while left:
        at += 1 << (left.bit_length() - 1)
        left = total - at
        if start < at < end:
            out.append(at)
    return out


def sequence_at(total: int, at: int, sequence: int = SEQUENCE) -> tuple[int, int]:
    """(number, first place) of the sequence that holds place `at` of the stream."""
    whole = total - total % sequence
    if at < whole:
        return at // sequence, at - at % sequence
    number, low, left = whole // sequence, whole, total - whole
    while True:
        high = low + (1 << (left.bit_length() - 1))
        if at < high:
            return number, low
        number, low, left = number + 1, high, total - high


def tokenised(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Settled (doc_id, n_tokens, place, tokens); place orders documents along the curve."""

    def encode(batches):
        tokenizer, signs = Tokenizer(), directions()
        for batch in batches:
            for i in range(0, batch.num_rows, 128):
                part = batch.slice(i, 128)
                ids = [tokenizer(t or "") for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        pa.array([len(x) for x in ids], pa.int64()),
                        pa.array(place_of(ids, signs)),
                        pa.array([x.tobytes() for x in ids], pa.binary()),
                    ],
                    names=["doc_id", "n_tokens", "place", "tokens"],
                )

    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    rows = source.mapInArrow(encode, f"doc_id {kind}, n_tokens long, place long, tokens binary")
    # 30 bits of the curve, then 32 of a hash, so copies spread over buckets as well
    spread = F.shiftrightunsigned(F.xxhash64("doc_id", "n_tokens"), 32)
    return settle(
        rows.withColumn("place", F.shiftleft("place", 32).bitwiseOR(spread))
    )


def pack(
    docs: DataFrame, sequence: int = SEQUENCE, bucket_tokens: int = BUCKET_TOKENS,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Pieces: (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset).

    Every id of every row lies in one piece. Sequences hold `sequence` ids; those at the
    end hold a power of two each, so none is padded. NULL text counts as empty: its one
    id is END. NULL ids and repeated rows are packed like any other, each row on its
    own. No rows give no pieces. Other columns are not read.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = tokenised(docs, id_col, text_col)
    total = rows.agg(F.sum("n_tokens")).first()[0] or 0
    buckets = max(1, -(-total // bucket_tokens))
    # bounds of the buckets: one number each, from a mergeable sketch
    bounds = []
    if buckets > 1:
        shares = [i / buckets for i in range(1, buckets)]
        bounds = rows.agg(F.percentile_approx("place", shares, 20 * buckets)).first()[0]
    shared = spark.sparkContext.broadcast(np.array(bounds, dtype=np.int64))

    def to_bucket(places: pa.Array) -> pa.Array:
        at = np.searchsorted(shared.value, np.asarray(places), side="right")
        return pa.array(at.astype(np.int32))

    dealt = rows.withColumn("bucket", F.arrow_udf(to_bucket, "int")("place"))
    # where each bucket starts in the stream: running sums within stretches of buckets, and of
    # the stretches' totals
    sums = settle(
        dealt.groupBy("bucket").agg(F.sum("n_tokens").alias("_sum")).withColumn(
            "_stretch", F.expr(f"bucket div {STRETCH}")
        )
    )
    earlier = (Window.unboundedPreceding, -1)
    stretches = sums.groupBy("_stretch").agg(F.sum("_sum").alias("_sum")).select(
        "_stretch",
        F.coalesce(F.sum("_sum").over(Window.orderBy("_stretch").rowsBetween(*earlier)), F.lit(0)).alias("_from"),
    )
    inside = Window.partitionBy("_stretch").orderBy("bucket").rowsBetween(*earlier)
    bases = sums.withColumn("_in", F.coalesce(F.sum("_sum").over(inside), F.lit(0))).join(
        stretches, "_stretch"
    ).select("bucket", (F.col("_from") + F.col("_in")).alias("base"))

    def cut(batches):
        at = 0
        for batch in batches:
            out = []
            for base, doc, data in zip(
                batch.column("base").to_pylist(),
                batch.column("doc_id").to_pylist(),
                batch.column("tokens").to_pylist(),
            ):
                if base is not None:
                    at = base
                    continue
                ids = np.frombuffer(data, "<u2").astype("<u4")
                end = at + len(ids)
                edges = [at, *cuts(total, at, end, sequence), end]
                for low, high in zip(edges, edges[1:]):
                    number, first = sequence_at(total, low, sequence)
                    out.append((
                        doc, low - at, high - low, zlib.crc32(ids[low - at : high - at].tobytes()),
                        len(ids), number, low - first,
                    ))
                at = end
            columns = list(zip(*out)) or [()] * 7
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[0], batch.schema.field("doc_id").type)]
                + [pa.array(c, pa.int64()) for c in columns[1:]],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
            )

    kind = rows.schema["doc_id"].dataType.simpleString()
    # the row with a bucket's start sorts before the bucket's documents; one shuffle, a task a bucket
    marked = dealt.select("bucket", F.lit(None).cast("long").alias("base"), "place", "doc_id", "tokens")
    starts = bases.select(
        "bucket", "base", F.lit(-1).cast("long").alias("place"),
        F.lit(None).cast(kind).alias("doc_id"), F.lit(None).cast("binary").alias("tokens"),
    )
    return (
        marked.unionByName(starts)
        .repartitionById(buckets, "bucket")
        .sortWithinPartitions("bucket", "place", "doc_id", "tokens")
        .select("base", "doc_id", "tokens")
        .mapInArrow(
            cut,
            f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, "
            "sequence_id long, offset long",
        )
    )


def sequences(pieces: list[tuple]) -> dict[int, int]:
    """Ids per sequence of some pieces (sequence_id, offset, length), for checks."""
    sizes: dict[int, int] = {}
    for number, offset, length in chain(pieces):
        sizes[number] = max(sizes.get(number, 0), offset + length)
    return sizes
