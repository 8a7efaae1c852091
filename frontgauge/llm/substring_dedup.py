"""Removing passages that an earlier document holds: seed with anchors, extend, cut.

A window is LEAST consecutive words. Its anchor is the smallest hash of the SEED-word runs
in it (winnowing), so documents that share a window share its anchor, and neighbouring
windows mostly share one anchor: a document has far fewer anchors than words.

1. Seed: documents are joined on their anchors; an anchor that one document only (by id)
   holds is dropped, which is most of them.
2. Extend: in the documents that are left, every seed is extended both ways, as far as the
   windows reach whose anchor it is: a segment. Segments are joined as a whole (their hash
   and the anchor's, 128 bits), and those with a holder of a smaller id are repeats; that
   settles the inside of all copies. Where an anchor has different segments (the ends of a
   copied passage), the first document of each is joined with the others window by window.
3. Keep maximal repeats: overlapping windows of a document merge into maximal spans, and
   their words are cut out of its text.

No pair of documents is ever written: a match needs only the smallest id that holds it, so
a passage of any number of holders costs each of them a row per segment, and groups are
aggregated before they are shuffled. Tables are deleted as soon as the next step is settled. Rows with NULL ids have no place in the order: nothing is taken
from them, and they take nothing from others.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frontgauge.llm.common import small_batches
from frontgauge.session import discard, settle

LEAST = 13
SEED = 5

_ROLL = np.uint64(0x9E3779B97F4A7C15)
_A = np.uint64(0xBF58476D1CE4E5B9)
_B = np.uint64(0x94D049BB133111EB)


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))


def runs(hashes: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of each run of `width` words, by its first word."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    x = hashes[:n].copy()
    for k in range(1, width):
        x *= _ROLL
        x += hashes[k : k + n]
    x ^= x >> np.uint64(30)
    x *= _A
    x ^= x >> np.uint64(27)
    x *= _B
    return x ^ (x >> np.uint64(31))


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Least of each `width` consecutive values, by doubling."""
    done = 1
    while done < width:
        step = min(done, width - done)
        x = np.minimum(x[:-step], x[step:])
        done += step
    return x


def window_anchors(hashes: np.ndarray, least: int, seed: int) -> np.ndarray:
    """The anchor of each window, by the window's first word."""
    if len(hashes) < least:
        return np.zeros(0, dtype=np.uint64)
    return sliding_min(runs(hashes, seed), least - seed + 1)


def covered(repeated: np.ndarray, least: int) -> np.ndarray:
    """Which words lie in a repeated window; `repeated` tells it for each window."""
    edge = np.zeros(len(repeated) + least, dtype=np.int64)
    edge[: len(repeated)] += repeated
    edge[least:] -= repeated
    return np.cumsum(edge[:-1]) > 0


def spans_of(cut: np.ndarray) -> list[tuple[int, int]]:
    """(start, length) of the maximal runs of True."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], cut, [False]]).astype(np.int8)))
    return [(int(a), int(b - a)) for a, b in zip(edge[::2], edge[1::2])]


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))


def segments(window: np.ndarray, anchor: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(starts, hashes) of the stretches of up to `most` windows that share an anchor."""
    at = np.arange(len(anchor))
    turns = np.append(True, anchor[1:] != anchor[:-1])
    run = np.maximum.accumulate(np.where(turns, at, 0))
    starts = np.flatnonzero((at - run) % most == 0)
    place = at - np.repeat(starts, np.diff(np.append(starts, len(at))))
    power = np.full(most, _ROLL, dtype=np.uint64).cumprod(dtype=np.uint64)
    sums = np.add.reduceat(window * power[place], starts)
    lengths = np.diff(np.append(starts, len(at))).astype(np.uint64)
    return starts, (sums ^ (sums >> np.uint64(29))) * _A + lengths


class Passages:
    """The windows of a text, their anchors and segments."""

    def __init__(self, data: bytes, least: int, seed: int):
        hashes = word_hashes(data.split())
        self.window = runs(hashes, least)
        self.anchor = window_anchors(hashes, least, seed)
        if len(self.window):
            self.starts, self.segment = segments(self.window, self.anchor, least - seed + 1)
        else:
            self.starts, self.segment = np.zeros(0, dtype=np.int64), self.window
        self.lengths = np.diff(np.append(self.starts, len(self.window)))


def repeated_windows(
    docs: DataFrame, least: int = LEAST, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Settled (doc_id, segments, windows): what of an id's text a smaller id holds too.

    segments: hashes of whole segments, windows: of single windows. Ids without either are
    absent. Rows that share an id are one document here.
    """
    source = _texts(docs, id_col, text_col).where("doc_id is not null and text is not null")
    kind = source.schema["doc_id"].dataType.simpleString()

    def anchors(batches):
        for batch in batches:
            found = []
            for data in batch.column("text").cast(pa.binary()).to_pylist():
                each = window_anchors(word_hashes(data.split()), least, seed)
                found.append(np.unique(each).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), _lists(found)], names=["doc_id", "anchors"]
            )

    def extended(batches):
        for batch in batches:
            at, anchor, segment, windows = [], [], [], []
            seeds = batch.column("seeds")
            for i, data in enumerate(batch.column("text").cast(pa.binary()).to_pylist()):
                p = Passages(data, least, seed)
                own = np.asarray(seeds[i].values).view(np.uint64)
                _, first = np.unique(p.segment, return_index=True)  # one row per different segment
                first = first[np.isin(p.anchor[p.starts[first]], own)]
                for k in first:
                    windows.append(p.window[p.starts[k] : p.starts[k] + p.lengths[k]].view(np.int64))
                at += [i] * len(first)
                anchor.append(p.anchor[p.starts[first]].view(np.int64))
                segment.append(p.segment[first].view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(at, pa.int32())), pa.array(np.concatenate(anchor)),
                 pa.array(np.concatenate(segment)), _lists(windows)],
                names=["doc_id", "anchor", "segment", "windows"],
            )

    # seed: anchors that more than one id holds, then those of each document
    signed = settle(source.mapInArrow(anchors, f"doc_id {kind}, anchors array<long>"))
    each = signed.select("doc_id", F.explode("anchors").alias("anchor"))
    shared = settle(
        each.groupBy("anchor")
        .agg(F.min("doc_id").alias("_first"), F.max("doc_id").alias("_last"))
        .where("_first < _last")
        .select("anchor")
    )
    seeds = settle(
        each.join(shared, "anchor")
        .groupBy("doc_id")
        .agg(F.collect_set("anchor").alias("seeds"))  # no more than the document's own
    )
    discard(signed, shared)

    # extend: whole segments first
    matches = settle(
        source.join(seeds, "doc_id").mapInArrow(
            extended, f"doc_id {kind}, anchor long, segment long, windows array<long>"
        )
    )
    discard(seeds)
    different = settle(
        matches.groupBy("anchor", "segment").agg(
            F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.first("windows").alias("windows")
        )
    )
    repeated = different.where("first < last").select("anchor", "segment", "first")
    whole = (
        matches.select("doc_id", "anchor", "segment")
        .join(repeated, ["anchor", "segment"])
        .where("doc_id > first")
        .select("doc_id", "segment", F.lit(None).cast("long").alias("window"))
    )
    # then the windows of anchors that have different segments, once for each of them
    contested = settle(
        different.groupBy("anchor").agg(F.count("*").alias("_n")).where("_n > 1").select("anchor")
    )
    windows = settle(
        different.join(contested, "anchor").select("anchor", "first", F.explode("windows").alias("window"))
    )
    earliest = settle(
        windows.groupBy("anchor", "window")
        .agg(F.min("first").alias("_first"), F.max("first").alias("_last"))
        .where("_first < _last")
        .select("anchor", "window", "_first")
    )
    single = (
        windows.join(earliest, ["anchor", "window"])
        .where("first > _first")
        .select(F.col("first").alias("doc_id"), F.lit(None).cast("long").alias("segment"), "window")
    )
    found = settle(
        whole.union(single)
        .groupBy("doc_id")
        .agg(F.collect_set("segment").alias("segments"), F.collect_set("window").alias("windows"))
    )
    discard(matches, different, contested, windows, earliest)
    return found


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    flat = np.concatenate(arrays) if arrays else np.zeros(0, dtype=np.int64)
    return pa.ListArray.from_arrays(ends, pa.array(flat, pa.int64()))


def strip(
    docs: DataFrame, least: int = LEAST, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, n_words, n_removed, spans, kept), one row per row of `docs`.

    A word is removed if a window of `least` words that covers it also starts in a row with
    a smaller id; windows are judged on the input, not on what is left. spans: the maximal
    stretches removed, as (start, length) in words; kept: the other words, unchanged, joined
    by one space. Whole texts are read, however long.

    NULL or empty text has no words; so has white space alone. Texts of fewer than `least`
    words keep all. Rows with one id take nothing from each other, alike or not; those alike
    get the same result. Rows with NULL id keep everything. No rows give no rows. Other
    columns are not read.
    """
    small_batches(docs.sparkSession)
    source = _texts(docs, id_col, text_col)
    found = repeated_windows(docs, least, seed, id_col, text_col)

    def cut(batches):
        for batch in batches:
            n, left, spans = [], [], []
            windows, segments = batch.column("windows"), batch.column("segments")
            for i, data in enumerate(batch.column("text").cast(pa.binary()).to_pylist()):
                words, out = (data or b"").split(), []
                n.append(len(words))
                if windows[i].is_valid and len(words) >= least:
                    p = Passages(data, least, seed)
                    repeated = np.isin(p.window, np.asarray(windows[i].values).view(np.uint64))
                    whole = np.isin(p.segment, np.asarray(segments[i].values).view(np.uint64))
                    gone = covered(repeated | np.repeat(whole, p.lengths), least)
                    out = spans_of(gone)
                    words = [w for w, g in zip(words, gone) if not g]
                spans.append([{"start": a, "length": b} for a, b in out])
                left.append(b" ".join(words))
            kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))
            gone = [sum(s["length"] for s in x) for x in spans]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()),
                 pa.array(spans, kind), pa.array(left, pa.binary()).cast(pa.string())],
                names=["doc_id", "n_words", "n_removed", "spans", "kept"],
            )

    kind = source.schema["doc_id"].dataType.simpleString()
    return source.join(found, "doc_id", "left").select("doc_id", "text", "segments", "windows").mapInArrow(
        cut,
        f"doc_id {kind}, n_words long, n_removed long, spans array<struct<start:long,length:long>>, kept string",
    )


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r,
    coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), CAST([] AS VARCHAR[])) AS words
  FROM documents
),
w AS (
  SELECT r, doc_id, i, array_to_string(words[i : i + 12], ' ') AS win
  FROM (SELECT r, doc_id, words, unnest(range(1, len(words) - 11)) AS i FROM d)
),
f AS (SELECT win, min(doc_id) AS first FROM w GROUP BY win),
gone AS (
  SELECT DISTINCT r, pos
  FROM (SELECT w.r, unnest(range(w.i, w.i + 13)) AS pos FROM w JOIN f USING (win) WHERE f.first < w.doc_id)
),
kept AS (
  SELECT e.r, string_agg(e.word, ' ' ORDER BY e.pos) AS kept, count(*) AS n
  FROM (SELECT r, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS pos FROM d) e
  ANTI JOIN gone USING (r, pos)
  GROUP BY e.r
)
SELECT d.doc_id, CAST(len(words) AS BIGINT) AS n_words,
  CAST(len(words) - coalesce(kept.n, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(kept.kept, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (r)
"""
