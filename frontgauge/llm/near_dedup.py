"""Near-duplicate documents by BagMinHash over multisets of word 5-grams.

A text is a bag of shingles with counts. BagMinHash draws, for every shingle, the
points of a Poisson process over (time, weight) and keeps in each slot of a signature
the earliest point that lies under the shingle's count; two bags agree in a slot with
probability equal to their weighted Jaccard similarity. The weight axis is cut into
[0, 1), [1, 2), [2, 4), [4, 8) ... with a process of its own for each range: ranges
wholly under the count take every point, the one that the count cuts takes points by
their weight. So a count of c costs log2(c) processes, and a process stops at the time
that fills all slots.

Signatures are cut into bands; texts that agree in a band meet in a bucket. A bucket
never emits its pairs. In each round its members are paired with one pivot only, the
pairs are verified exactly on the texts (multiset overlap), and links join classes; only
members of other classes than their next pivot's are paired again. Buckets that still
hold several classes are then searched in full: their members meet in blocks of bounded
size, where pairs of different classes are compared by signature and verified on the
texts, and only links leave the task. So no linked pair of a bucket is lost.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frontgauge.llm.common import Forest, components, settle, small_batches

SHINGLE = 5
SIMILARITY = 0.8
BANDS = 32
BAND_SLOTS = 6
SLOTS = BANDS * BAND_SLOTS
# Pairs whose signatures agree in fewer slots are not verified. A pair at 0.8 falls below
# it with a chance of 1 in 20,000 (binomial, 192 slots), as it is to share no band at all.
LEAST_AGREEING = 132
ROUNDS = 3
# Shingles whose signatures are worked out together.
CHUNK_SHINGLES = 100_000
# Members of a bucket that a task compares with as many others.
BLOCK_ROWS = 512

_A = np.uint64(0xBF58476D1CE4E5B9)
_B = np.uint64(0x94D049BB133111EB)
_C = np.uint64(0x9E3779B97F4A7C15)
_EMPTY = np.zeros(0, dtype=np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = x + _C
        x = (x ^ (x >> np.uint64(30))) * _A
        x = (x ^ (x >> np.uint64(27))) * _B
    return x ^ (x >> np.uint64(31))


def shingles(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, counts) of a text's word 5-grams, ascending by hash.

    A text of one to four words has a single shingle, all its words; one without words
    has none.
    """
    words = data.split()
    if not words:
        return _EMPTY, np.zeros(0, dtype=np.int64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
    width = min(SHINGLE, len(words))
    joined = np.full(len(words) - width + 1, width, dtype=np.uint64)
    for k in range(width):
        joined = _mix(joined ^ h[k : len(h) - width + 1 + k])
    return np.unique(joined, return_counts=True)


def signatures(bags: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """One row of SLOTS 16-bit fingerprints per bag; a bag without shingles has zeros."""
    n = len(bags)
    sizes = np.array([len(h) for h, _ in bags])
    bag = np.repeat(np.arange(n), sizes)
    item = np.concatenate([h for h, _ in bags]) if n else _EMPTY
    count = np.concatenate([c for _, c in bags]) if n else np.zeros(0, dtype=np.int64)
    # processes: range 0 is [0, 1); range k >= 1 is [2^(k-1), 2^k)
    parts = [(bag, item, np.ones(len(bag)), np.ones(len(bag)))]
    k, many = 1, np.flatnonzero(count > 1)
    while len(many):
        low = 1 << (k - 1)
        share = np.minimum(1.0, (count[many] - low) / low)
        parts.append((bag[many], _mix(item[many] ^ np.uint64(k)), np.full(len(many), float(low)), share))
        k += 1
        many = many[count[many] > (low << 1)]
    bag = np.concatenate([p[0] for p in parts])
    seed = _mix(np.concatenate([p[1] for p in parts]))
    rate = np.concatenate([p[2] for p in parts])
    share = np.concatenate([p[3] for p in parts])
    processes = np.bincount(bag, minlength=n)

    first = np.full(n * SLOTS, np.inf)
    mark = np.zeros(n * SLOTS, dtype=np.uint16)
    time = np.zeros(len(bag))
    drawn = np.zeros(len(bag), dtype=np.uint64)
    while len(bag):
        # bags of few shingles need many points from each to fill their slots
        burst = np.clip(2 * SLOTS // np.maximum(1, processes[bag]), 1, 512)
        at = np.repeat(np.arange(len(bag)), burst)
        start = np.cumsum(burst) - burst
        step = (np.arange(len(at)) - start[at]).astype(np.uint64)
        with np.errstate(over="ignore"):
            point = _mix(seed[at] + (drawn[at] + step) * _A)
        wait = -np.log1p(-((point >> np.uint64(11)) / float(1 << 53))) / rate[at]
        if len(at) == len(bag):
            when = time + wait
        else:
            run = np.cumsum(wait)
            when = run - (run[start] - wait[start])[at] + time[at]
        place = _mix(point)
        slot = bag[at] * SLOTS + ((place >> np.uint64(32)) * np.uint64(SLOTS) >> np.uint64(32)).astype(np.int64)
        under = (place & np.uint64(0xFFFF)) / 65536.0 < share[at]
        keep = np.flatnonzero(under & (when < first[slot]))
        when_kept, slot_kept = when[keep], slot[keep]
        np.minimum.at(first, slot_kept, when_kept)
        won = when_kept == first[slot_kept]
        mark[slot_kept[won]] = (_mix(place[keep[won]]) >> np.uint64(48)).astype(np.uint16)
        time = when[start + burst - 1]
        drawn = drawn + burst.astype(np.uint64)
        alive = time < first.reshape(n, SLOTS).max(axis=1)[bag]
        bag, seed, rate, share, time, drawn = (
            x[alive] for x in (bag, seed, rate, share, time, drawn)
        )
    return mark.reshape(n, SLOTS)


def band_keys(marks: np.ndarray) -> np.ndarray:
    """One 64-bit key per row and band."""
    cut = marks.reshape(len(marks), BANDS, BAND_SLOTS).astype(np.uint64)
    key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), cut.shape[:2])
    for k in range(BAND_SLOTS):
        key = _mix(key ^ cut[:, :, k])
    return key.view(np.int64)


def overlap(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[int, int]:
    """Sizes of the multiset intersection and union."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = int(np.minimum(a[1][i], b[1][j]).sum())
    return both, int(a[1].sum()) + int(b[1].sum()) - both


def _sign(texts: pa.Array) -> pa.Array:
    sizes, marks, keys, bags, held = [], [], [], [], 0
    for i in range(len(texts)):
        bags.append(shingles(texts[i].as_buffer().to_pybytes() if texts[i].is_valid else b""))
        held += len(bags[-1][0])
        if held < CHUNK_SHINGLES and len(bags) < 256 and i + 1 < len(texts):
            continue
        rows = signatures(bags)
        sizes += [int(c.sum()) for _, c in bags]
        marks += [r.tobytes() for r in rows]
        keys.append(band_keys(rows))
        bags, held = [], 0
    flat = np.concatenate(keys).reshape(-1) if keys else np.zeros(0, dtype=np.int64)
    return pa.StructArray.from_arrays(
        [
            pa.array(sizes, pa.int64()),
            pa.array(marks, pa.binary()),
            pa.ListArray.from_arrays(np.arange(0, len(flat) + 1, BANDS, dtype=np.int32), pa.array(flat)),
        ],
        names=["n", "marks", "bands"],
    )


def similar(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> bool:
    both, either = overlap(a, b)
    return 10 * both >= round(10 * SIMILARITY) * either


def _linked(a: pa.Array, marks_a: pa.Array, b: pa.Array, marks_b: pa.Array) -> pa.Array:
    out, last, bag = [], None, None
    columns = (a.cast(pa.binary()), marks_a, b.cast(pa.binary()), marks_b)
    for x, mx, y, my in zip(*(c.to_pylist() for c in columns)):
        agree = (np.frombuffer(mx, np.uint16) == np.frombuffer(my, np.uint16)).sum()
        if agree < LEAST_AGREEING:
            out.append(False)
            continue
        if x != last:
            last, bag = x, shingles(x)
        out.append(similar(bag, shingles(y)))
    return pa.array(out, pa.bool_())


def search_block(block: pa.Table) -> pa.Table:
    """Links (a, b) between classes that one bucket's block pair holds: a spanning set.

    Rows: key, i, j (the block pair), at (the row's block), class, marks and text. A pair
    is looked at in the first band its members share, nearest pairs first, and only if
    its classes are still apart.
    """
    key, i, j = (block.column(c)[0].as_py() for c in ("key", "i", "j"))
    at = np.asarray(block.column("at"))
    classes = np.asarray(block.column("class"))
    marks = np.stack([np.frombuffer(m, np.uint16) for m in block.column("marks").to_pylist()])
    texts = block.column("text").cast(pa.binary()).to_pylist()
    bands = band_keys(marks)
    left, right = np.flatnonzero(at == i), np.flatnonzero(at == j)
    found = []
    for x in left:
        others = right[right > x] if i == j else right
        others = others[classes[others] != classes[x]]
        if not len(others):
            continue
        agree = (marks[others] == marks[x]).sum(axis=1)
        others, agree = others[agree >= LEAST_AGREEING], agree[agree >= LEAST_AGREEING]
        same = bands[others] == bands[x]
        first = bands[x][same.argmax(axis=1)] == key
        found += [(-int(n), int(x), int(y)) for n, y in zip(agree[first], others[first])]
    forest, bags, out = Forest(), {}, []
    for _, x, y in sorted(found):
        a, b = int(classes[x]), int(classes[y])
        if forest.find(a) == forest.find(b):
            continue
        for one in (x, y):
            if one not in bags:
                bags[one] = shingles(texts[one])
        if similar(bags[x], bags[y]):
            forest.union(a, b)
            out.append((a, b))
    return pa.table({
        "a": pa.array([p[0] for p in out], pa.int64()), "b": pa.array([p[1] for p in out], pa.int64())
    })


def _text_keys() -> list:
    return [F.xxhash64("text").alias("k1"), F.xxhash64(F.lit(7), "text").alias("k2")]


def _contents(docs: DataFrame, reps: DataFrame, buckets: DataFrame) -> DataFrame:
    """Settled (node, marks, text) of the texts that share a bucket with another."""
    wanted = reps.join(buckets.select("node").distinct(), "node").select(
        "k1", "k2", "doc_id", "node", "marks"
    )
    rows = docs.select("doc_id", "text", *_text_keys())
    same = (
        (rows["k1"] == wanted["k1"]) & (rows["k2"] == wanted["k2"])
        & rows["doc_id"].eqNullSafe(wanted["doc_id"])
    )
    found = rows.join(wanted, same).select("node", "marks", "text")
    return settle(found.dropDuplicates(["node"]))  # rows alike in id and text


def _relabelled(current: DataFrame, links: DataFrame) -> DataFrame:
    """`current` with classes joined by links (a, b) between them."""
    joined = components(links).withColumnRenamed("node", "class")
    return settle(
        current.join(joined, "class", "left").select(
            "key", "node", F.coalesce("component", "class").alias("class")
        )
    )


def _pivot_links(current: DataFrame, contents: DataFrame, salt: int) -> DataFrame:
    """Settled links (a, b) between the classes of members and of their bucket's pivot."""
    order = F.struct(F.xxhash64("node", F.lit(salt)), F.col("node"), F.col("class"))
    pivots = current.groupBy("key").agg(F.min(order).alias("_p")).select(
        "key", F.col("_p.node").alias("pivot"), F.col("_p.class").alias("pivot_class")
    )
    pairs = (
        current.join(pivots, "key")
        .where("class <> pivot_class")
        .select("node", "class", "pivot", "pivot_class")
        .distinct()
    )
    of_node = contents.select("node", F.col("text").alias("_a"), F.col("marks").alias("_ma"))
    of_pivot = contents.select(F.col("node").alias("pivot"), F.col("text").alias("_b"), F.col("marks").alias("_mb"))
    linked = F.arrow_udf(_linked, "boolean")
    return settle(
        pairs.join(of_node, "node").join(of_pivot, "pivot")
        .where(linked("_b", "_mb", "_a", "_ma"))
        .select(F.col("class").alias("a"), F.col("pivot_class").alias("b"))
        .distinct()
    )


def _block_links(current: DataFrame, contents: DataFrame, block_rows: int) -> DataFrame:
    """Settled links (a, b) between classes that share a bucket, from all their pairs."""
    mixed = (
        current.groupBy("key")
        .agg(F.min("class").alias("_low"), F.max("class").alias("_high"), F.count("*").alias("_n"))
        .where("_low < _high")
        .select("key", F.ceil(F.col("_n") / block_rows).cast("int").alias("blocks"))
    )
    at = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    rows = current.join(mixed, "key").withColumn("at", at).withColumn(
        "_other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    )
    return settle(
        rows.select(
            "node", "key", "class", "at",
            F.least("at", "_other").alias("i"),
            F.greatest("at", "_other").alias("j"),
        )
        .join(contents, "node")
        .groupBy("key", "i", "j")
        .applyInArrow(search_block, "a long, b long")  # 2 * block_rows texts or so
    )


def classes(docs: DataFrame, rounds: int = ROUNDS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(doc_id, n_shingles, class_id, kept, k1, k2) for every row of `docs`.

    Reads doc_id and text. class_id is the smallest doc_id among the documents reached
    by links (equal texts, or similarity 0.8 and more); kept marks that document. A NULL
    text is alone in its class; empty texts equal each other, and texts without a word
    link with equal texts only. Rows with NULL doc_id belong to classes too; a class of
    such rows only has class_id NULL, and kept is true for those. Repeated rows share
    class and kept. k1, k2: a 128-bit key of the text.
    """
    small_batches(docs.sparkSession)
    sign = F.arrow_udf(_sign, "n long, marks binary, bands array<long>")
    signed = settle(
        docs.where("text is not null")
        .select("doc_id", "text", *_text_keys())
        .withColumn("s", sign("text"))
        .select("doc_id", "k1", "k2", "s.*")
    )
    least = signed.groupBy("k1", "k2").agg(F.min("doc_id").alias("doc_id"))
    l_id = F.col("l.doc_id")
    reps = settle(
        signed.alias("s")
        .join(
            least.alias("l"),
            (F.col("s.k1") == F.col("l.k1")) & (F.col("s.k2") == F.col("l.k2"))
            & F.col("s.doc_id").eqNullSafe(l_id),
        )
        .select("s.*")
        .dropDuplicates(["k1", "k2"])
        .withColumn("node", F.monotonically_increasing_id())
    )
    every = reps.where("n > 0").select("node", F.explode("bands").alias("key"))
    shared = every.groupBy("key").agg(F.count("*").alias("_n")).where("_n > 1").select("key")
    buckets = settle(every.join(shared, "key"))
    contents = _contents(docs, reps, buckets)

    current = buckets.withColumn("class", F.col("node"))
    for salt in range(rounds):
        links = _pivot_links(current, contents, salt)
        if links.isEmpty():
            break
        current = _relabelled(current, links)
    links = _block_links(current, contents, block_rows)
    if not links.isEmpty():
        current = _relabelled(current, links)
    joined = current.select("node", F.col("class").alias("component")).distinct()
    named = reps.select("k1", "k2", "doc_id", "n", "node").join(joined, "node", "left")
    named = settle(named.withColumn("component", F.coalesce("component", "node")))
    heads = named.groupBy("component").agg(F.min("doc_id").alias("class_id"))
    told = named.join(heads, "component").select("k1", "k2", "n", "class_id")

    rows = docs.select(
        "doc_id", *[F.when(F.col("text").isNotNull(), k).alias(n) for k, n in zip(_text_keys(), ("k1", "k2"))]
    )
    class_id = F.when(F.col("k1").isNull(), F.col("doc_id")).otherwise(F.col("class_id"))
    return rows.join(told, ["k1", "k2"], "left").select(
        "doc_id",
        F.coalesce("n", F.lit(0)).alias("n_shingles"),
        class_id.alias("class_id"),
        class_id.eqNullSafe(F.col("doc_id")).alias("kept"),
        "k1",
        "k2",
    )


def dedup(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """`docs` without near copies: of each class one row stays, the kept document's.

    All columns of `docs` are kept. Rows with NULL text are left as they are.
    """
    told = settle(classes(docs, rounds).where("k1 is not null"))
    key = [F.col("k1").alias("_k1"), F.col("k2").alias("_k2"), F.col("doc_id").alias("_id")]
    keyed = docs.withColumns({"_near_k1": _text_keys()[0], "_near_k2": _text_keys()[1]})
    same = (
        (F.col("_near_k1") == F.col("_k1")) & (F.col("_near_k2") == F.col("_k2"))
        & F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("text").isNotNull()
    )
    left = keyed.join(told.where("not kept").select(*key).distinct(), same, "left_anti")
    # rows alike in id and text are all the kept document; where there are any, one stays
    again = settle(
        told.where("kept").groupBy(*key).agg(F.count("*").alias("_n")).where("_n > 1").drop("_n")
    )
    if not again.isEmpty():
        one = left.join(again, same, "left_semi").dropDuplicates(["_near_k1", "_near_k2", "doc_id"])
        left = left.join(again, same, "left_anti").union(one)
    return left.select(*docs.columns)
