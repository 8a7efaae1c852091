"""Quality classifier: hashed word n-gram logistic regression, trained with FTRL.

Features are word 1- and 2-grams, and 1- and 2-grams of word shapes (case, digits and
marks without the letters), hashed into 2^BITS places; a word that repeats the one
before it is a feature of its own. Each place counts by the root of its frequency, and
a document's vector has length 1, so long texts and short ones compare.

Training follows the regularised leader (FTRL-proximal, per-coordinate rates, L1 and
L2) on a bounded sample of the labelled documents. The sample is dealt to shards that
train in parallel; their weights are averaged. Scoring is one sparse dot product per
document over all of them, in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frontgauge.llm.common import settle, small_batches, unit_hash

BITS = 18
BIAS = 1 << BITS
# Labelled documents to learn from, on average: rows whose id hashes below the share
# that gives this many. Labels beyond it are not used for fitting.
SAMPLE = 16_000
# Shards that train in parallel, each on this many documents at least, and the steps that
# each takes at least: few documents are gone through more often.
SHARDS = 8
SHARD_ROWS = 1_000
STEPS = 10_000
ALPHA, BETA, L1, L2 = 0.5, 1.0, 2e-3, 1e-3

_REPEAT = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)
_LOW = np.uint64(0xFFFFFFFF)
_PLAIN = xxhash.xxh32_intdigest(b"a")


@lru_cache(maxsize=100_000)
def _word(word: bytes) -> int:
    """Hash of the word in its upper 32 bits, of its shape in the lower."""
    text = word.decode("utf-8", "replace")
    core = text.strip(".,;:!?\"'()")
    if text.isalpha() and text.islower():
        return xxhash.xxh32_intdigest(word) << 32 | _PLAIN
    shape, last = [], ""
    for ch in text:
        kind = "A" if ch.isupper() else "a" if ch.isalpha() else "0" if ch.isdigit() else ch
        if kind != last:
            shape.append(kind)
        last = kind
    low = core.lower().encode("utf-8", "replace")
    return xxhash.xxh32_intdigest(low) << 32 | xxhash.xxh32_intdigest("".join(shape).encode("utf-8", "replace"))


def _scatter(x: np.ndarray, salt: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x + np.uint64(salt)) * _MIX
        x ^= x >> np.uint64(32)
        x *= _MIX
    return (x >> np.uint64(64 - BITS)).astype(np.int64)


def features(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(places, values) of a text, given as UTF-8; the last place is the bias."""
    words = data.split()
    packed = np.fromiter(map(_word, words), dtype=np.uint64, count=len(words))
    word, shape = packed >> np.uint64(32), packed & _LOW
    parts = [_scatter(word, 1), _scatter(shape, 2)]
    if len(words) > 1:
        with np.errstate(over="ignore"):
            parts.append(_scatter(word[:-1] * _REPEAT + word[1:], 3))
            parts.append(_scatter(shape[:-1] * _REPEAT + shape[1:], 4))
        same = int((word[1:] == word[:-1]).sum())
        if same:
            parts.append(np.repeat(_scatter(np.array([_REPEAT]), 5), same))
    places, counts = np.unique(np.concatenate(parts), return_counts=True)
    values = np.sqrt(counts / max(1, counts.sum()))
    return np.append(places, BIAS), np.append(values, 1.0)


def _probability(z: float) -> float:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -35.0, 35.0)))


class Ftrl:
    """Follow-the-regularised-leader (proximal) state of one shard."""

    def __init__(self, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z = np.zeros(BIAS + 1)
        self.n = np.zeros(BIAS + 1)

    def weights(self, places: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[places], self.n[places]
        rate = (self.beta + np.sqrt(n)) / self.alpha + self.l2
        return np.where(np.abs(z) <= self.l1, 0.0, (np.sign(z) * self.l1 - z) / rate)

    def learn(self, places: np.ndarray, values: np.ndarray, good: int) -> None:
        w = self.weights(places)
        g = (_probability(float(w @ values)) - good) * values
        n = self.n[places]
        self.z[places] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[places] = n + g * g


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label: str, learn: Column, bound: int
) -> DataFrame:
    """(text, label): about `bound` labelled documents at most, chosen by hash of their id.

    The chosen labels are at most a few times `bound` rows of two numbers, so they are
    broadcast; documents are neither shuffled nor sorted. Ids with NULL or disagreeing
    labels are left out. `learn` says which ids may be used, over a column doc_id.
    """
    told = settle(
        labels.select("doc_id", F.col(label).alias("label"))
        .where(F.col("doc_id").isNotNull() & F.col("label").isNotNull() & learn)
        .groupBy("doc_id")
        .agg(F.min("label").alias("label"), F.max("label").alias("_top"))
        .where("label = _top")
        .drop("_top")
    )
    share = bound / max(1, told.count())
    picked = told.where(unit_hash("doc_id") < share)
    return (
        docs.select("doc_id", "text")
        .join(F.broadcast(picked), "doc_id")
        .select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "label")
    )


def train(
    docs: DataFrame, labels: DataFrame, learn: Column, sample: int = SAMPLE, shards: int = SHARDS,
    steps: int = STEPS,
) -> np.ndarray:
    """2^BITS + 1 weights. No labels give weights of 0, so every score is 0.5."""

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for b in batches:
            for data, good, key in zip(
                b.column("text").cast(pa.binary()).to_pylist(),
                b.column("label").to_pylist(),
                b.column("doc_id").to_pylist(),
            ):
                rows.append((xxhash.xxh64_intdigest(str(key)), key, data, good))
        if not rows:
            return
        rows.sort(key=lambda r: r[:2])
        vectors = [(*features(r[2]), r[3]) for r in rows]
        model, order = Ftrl(), np.arange(len(vectors))
        for epoch in range(-(-steps // len(vectors))):
            np.random.default_rng(epoch).shuffle(order)
            for i in order:
                model.learn(*vectors[i])
        w = model.weights()
        # the bias goes out always: its row stands for the shard, once
        used = np.union1d(np.flatnonzero(w), [BIAS])
        yield pa.RecordBatch.from_arrays(
            [pa.array(used), pa.array(w[used]), pa.array(np.full(len(used), len(rows)))],
            names=["place", "weight", "rows"],
        )

    small_batches(docs.sparkSession)
    # `sample` bounds what the shards hold together
    part = settle(labelled_sample(docs, labels, "quality", learn, sample))
    shards = max(1, min(shards, part.count() // SHARD_ROWS))
    parts = settle(
        part.repartition(shards, "doc_id").mapInArrow(shard, "place long, weight double, rows long")
    )
    total = parts.groupBy("place").agg(
        F.sum(F.col("weight") * F.col("rows")).alias("sum")
    )
    n = parts.where(F.col("place") == BIAS).agg(F.sum("rows")).first()[0] or 1
    weights = np.zeros(BIAS + 1)
    for place, s in total.collect():  # at most 2^BITS + 1 rows
        weights[place] = s / n
    return weights


def scorer(docs: DataFrame, weights: np.ndarray):
    """A column function: text -> probability of label 1."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def score(texts: pa.Array) -> pa.Array:
        w, out = shared.value, []
        for i in range(0, len(texts), 256):
            for data in texts.slice(i, 256).cast(pa.binary()).to_pylist():
                places, values = features(data or b"")
                out.append(_probability(float(w[places] @ values)))
        return pa.array(out, pa.float64())

    return F.arrow_udf(score, "double")


def score(docs: DataFrame, labels: DataFrame, learn: Column, **options) -> DataFrame:
    """(doc_id, score) for every row of `docs`, over its whole text.

    Scores lie in (0, 1), higher where label 1 is likelier. NULL text counts as empty;
    an empty text has the bias alone. Rows are scored each on its own, whatever their
    id; doc_id serves to find labels only, and other columns are not read.
    """
    weights = train(docs, labels, learn, **options)
    return docs.select("doc_id", scorer(docs, weights)("text").alias("score"))


def keep(
    docs: DataFrame, labels: DataFrame, learn: Column, cutoff: float, **options
) -> DataFrame:
    """The rows of `docs` that score `cutoff` or more, with all their columns."""
    weights = train(docs, labels, learn, **options)
    return docs.where(scorer(docs, weights)("text") >= cutoff)
