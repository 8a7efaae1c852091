"""Aligning the tokens of two tokenizers, and which ids stand for each other.

A is byte-level BPE (read as space + text), B a sentencepiece model (which adds the space
itself). Both cut the same bytes, each its own way. All tokens of both, sorted by start,
are coalesced as intervals: a group breaks where a start reaches the running maximum of
the ends so far, which is where tokens of both sides end. Within a group every token of A
is linked with every token of B.

The corpus tells which links are good: an id pair counts once for each document that holds
it linked, and a pair is best if no other pair of its A id has more. Documents give their
different pairs with multiplicities, so no occurrence pair is written; counts come from one
aggregation by pair, and go back to the documents by a join.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frontgauge.llm.common import settle, small_batches

A_RANKS = "byte_bpe_50k.tiktoken"
B_MODEL = "piece_bpe_32k.model"
# Ids of B fit in this many bits, so a pair is a * 2^B_BITS + b.
B_BITS = 15
# Parts of texts whose ids one worker remembers.
REMEMBERED = 150_000
# Tokens of both sides that are aligned together, in whole documents.
CHUNK_TOKENS = 200_000
# A group of more links is expanded over its different ids.
DENSE_LINKS = 4_096
# Pairs (three numbers each) that are broadcast at most; more are joined by shuffling.
PAIR_ROWS = 2_000_000


class TwoTokenizers:
    """Ids of a text in A and B, and the bytes of their tokens.

    A's ranks are the vocabulary of byte_bpe_50k.json; a test compares them. Where no two
    white-space characters meet, A always splits before a space. No piece of B has the mark
    of a space behind another character (checked), so B does as well: a text is then its
    space-separated parts, which recur and are remembered.
    """

    def __init__(self, ranks: str | None = None, model: str | None = None):
        import public_tokenizers
        import regex
        import sentencepiece
        import tiktoken

        with open(ranks or public_tokenizers.path(A_RANKS), "rb") as lines:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self._a = tiktoken.Encoding(
            "a", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={}
        )
        self._b = sentencepiece.SentencePieceProcessor(
            model_file=model or public_tokenizers.path(B_MODEL)
        )
        self.bytes_a = [b""] * (max(table.values()) + 1)
        for data, i in table.items():
            self.bytes_a[i] = data
        self.bytes_b = [self._piece(i) for i in range(self._b.get_piece_size())]
        if len(self.bytes_b) > 1 << B_BITS:
            raise ValueError(f"B has more than {1 << B_BITS} ids")
        self.size_a = np.array([len(x) for x in self.bytes_a], dtype=np.int64)
        self.size_b = np.array([len(x) for x in self.bytes_b], dtype=np.int64)
        pieces = [self._b.id_to_piece(i).lstrip("▁") for i in range(len(self.bytes_b))]
        self._apart = not any("▁" in p for p in pieces)
        self._double = regex.compile(r"\s\s|\s\Z").search
        self._known: dict[str, tuple[bytes, bytes]] = {}

    def _piece(self, i: int) -> bytes:
        piece = self._b.id_to_piece(i)
        if self._b.is_byte(i):
            return bytes([int(piece[3:-1], 16)])
        return piece.replace("▁", " ").encode()

    def _encode(self, text: str) -> tuple[bytes, bytes] | None:
        """Ids of both as 16-bit numbers; None if their bytes are not those of space + text."""
        a, b = self._a.encode_ordinary(" " + text), self._b.encode(text)
        want = (" " + text).encode()
        if b"".join(map(self.bytes_a.__getitem__, a)) != want:
            return None
        if b"".join(map(self.bytes_b.__getitem__, b)) != want:
            return None
        return np.array(a, dtype="<u2").tobytes(), np.array(b, dtype="<u2").tobytes()

    def __call__(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        ids = None
        if text and self._apart and not self._double(" " + text):
            known, parts = self._known, text.split(" ")
            if len(known) > REMEMBERED:
                known.clear()
            for part in parts:
                if part not in known:
                    known[part] = self._encode(part)
            found = [known[p] for p in parts]
            if None not in found:
                ids = b"".join([f[0] for f in found]), b"".join([f[1] for f in found])
        if text and ids is None:
            ids = self._encode(text)
        return ids and (np.frombuffer(ids[0], "<u2"), np.frombuffer(ids[1], "<u2"))


_COMMA, _BAR, _SEMI = (np.array([f"{i}{c}" for i in range(1 << 16)], dtype=object) for c in ",|;")


def coalesce(
    a_size: np.ndarray, b_size: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Group numbers of A's and of B's tokens, from their sizes in bytes; both cover the same."""
    a_end, b_end = np.cumsum(a_size), np.cumsum(b_size)
    start = np.concatenate([a_end - a_size, b_end - b_size])
    end = np.concatenate([a_end, b_end])
    side = np.repeat([False, True], [len(a_size), len(b_size)])
    order = np.lexsort((side, start))
    reach = np.maximum.accumulate(end[order])
    breaks = start[order][1:] >= reach[:-1]
    group = np.concatenate([[0], np.cumsum(breaks)])
    of_b = side[order]
    return group[~of_b], group[of_b]


def _expanded(
    a: np.ndarray, b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray,
    n_a: np.ndarray, n_b: np.ndarray, doc: np.ndarray,
) -> tuple[np.ndarray, np.ndarray]:
    """(keys, counts): document and id pair of every link, and how often it occurs.

    A key is the document's number, then a, then b. `doc` tells a group's document.
    """
    first_a, first_b = np.cumsum(n_a) - n_a, np.cumsum(n_b) - n_b
    dense = n_a * n_b > DENSE_LINKS
    times = np.where(dense, 0, n_b)[group_a]
    left = np.repeat(np.arange(len(a)), times)
    step = np.arange(len(left)) - np.repeat(np.cumsum(times) - times, times)
    right = first_b[group_a[left]] + step
    key = (doc[group_a[left]] << 16 | a[left]) << B_BITS | b[right]
    keys, counts = np.unique(key, return_counts=True)
    if not dense.any():
        return keys, counts
    parts = [(keys, counts)]
    for g in np.flatnonzero(dense):
        x, x_n = np.unique(a[first_a[g] : first_a[g] + n_a[g]], return_counts=True)
        y, y_n = np.unique(b[first_b[g] : first_b[g] + n_b[g]], return_counts=True)
        both = ((doc[g] << 16 | x) << B_BITS)[:, None] | y[None, :]
        parts.append((both.reshape(-1), (x_n[:, None] * y_n[None, :]).reshape(-1)))
    keys, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    sums = np.zeros(len(keys), dtype=np.int64)
    np.add.at(sums, at, np.concatenate([p[1] for p in parts]))
    return keys, sums


def align_chunk(ids: list[tuple[np.ndarray, np.ndarray]], size_a: np.ndarray, size_b: np.ndarray) -> list[tuple]:
    """Per document (n_a, n_b, n_groups, n_links, groups as text, pairs, counts of the pairs)."""
    if not ids:
        return []
    a = np.concatenate([x for x, _ in ids]).astype(np.int64)
    b = np.concatenate([y for _, y in ids]).astype(np.int64)
    group_a, group_b = coalesce(size_a[a], size_b[b])
    groups = int(group_a[-1]) + 1
    n_a, n_b = np.bincount(group_a, minlength=groups), np.bincount(group_b, minlength=groups)
    # documents end where both sides do, so every group lies in one
    ends_a = np.cumsum([len(x) for x, _ in ids])
    ends = group_a[ends_a - 1] + 1
    starts = np.concatenate([[0], ends[:-1]])
    doc = np.repeat(np.arange(len(ids)), ends - starts)
    links = np.add.reduceat(n_a * n_b, starts)

    # the text of the groups: A's ids of a group, then B's
    texts = np.empty(len(a) + len(b), dtype=object)
    through_a, through_b = np.cumsum(n_a), np.cumsum(n_b)
    last_a = np.append(np.diff(group_a) > 0, True)
    last_b = np.append(np.diff(group_b) > 0, True)
    texts[np.arange(len(a)) + (through_b - n_b)[group_a]] = np.where(last_a, _BAR[a], _COMMA[a])
    texts[np.arange(len(b)) + through_a[group_b]] = np.where(last_b, _SEMI[b], _COMMA[b])
    cut = through_a[ends - 1] + through_b[ends - 1]

    keys, counts = _expanded(a, b, group_a, group_b, n_a, n_b, doc)
    bounds = np.searchsorted(keys, np.arange(len(ids) + 1) << (16 + B_BITS))
    pairs = (keys & ((1 << (16 + B_BITS)) - 1)).astype(np.int32)
    out, low = [], 0
    for i, (x, y) in enumerate(ids):
        s = slice(bounds[i], bounds[i + 1])
        text = "".join(texts[low : cut[i]].tolist())[:-1]
        out.append((len(x), len(y), int(ends[i] - starts[i]), int(links[i]), text, pairs[s], counts[s]))
        low = cut[i]
    return out


def linked(
    docs: DataFrame, ranks: str | None = None, model: str | None = None,
    id_col: str = "doc_id", text_col: str = "text", with_groups: bool = False,
) -> DataFrame:
    """Settled (row, doc_id, n_a, n_b, n_groups, n_links, groups_sha256, pairs[, groups]).

    One row per row of `docs`; pairs holds the different id pairs that it links, as
    (pair, times), with pair = a * 2^B_BITS + b. groups is the alignment as text,
    `a1,a2|b1;a3|b2,b3`, if asked for.
    """
    small_batches(docs.sparkSession)
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    none = (0, 0, 0, 0, "", np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.int64))

    def told(doc_ids: pa.Array, rows: list[tuple]) -> pa.RecordBatch:
        ends = np.cumsum([0, *(len(r[5]) for r in rows)]).astype(np.int32)
        pairs = pa.StructArray.from_arrays(
            [pa.array(np.concatenate([r[5] for r in rows])), pa.array(np.concatenate([r[6] for r in rows]))],
            names=["pair", "times"],
        )
        sha = [hashlib.sha256(r[4].encode()).hexdigest() if r[0] else "" for r in rows]
        columns = [doc_ids, *(pa.array([r[i] for r in rows], pa.int64()) for i in range(4)), pa.array(sha, pa.string())]
        names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
        columns.append(pa.ListArray.from_arrays(ends, pairs))
        names.append("pairs")
        if with_groups:
            columns.append(pa.array([r[4] for r in rows], pa.string()))
            names.append("groups")
        return pa.RecordBatch.from_arrays(columns, names=names)

    def align(batches):
        two = TwoTokenizers(ranks, model)
        for batch in batches:
            texts = batch.column("text")
            at, some, ids, held = 0, [], [], 0
            for i in range(batch.num_rows):
                found = two(texts[i].as_py() or "")
                some.append(found is not None)
                if found is not None:
                    ids.append(found)
                    held += len(found[0]) + len(found[1])
                if held >= CHUNK_TOKENS or i + 1 == batch.num_rows:
                    rows = iter(align_chunk(ids, two.size_a, two.size_b))
                    part = [next(rows) if s else none for s in some]
                    yield told(batch.column("doc_id").slice(at, len(some)), part)
                    at, some, ids, held = i + 1, [], [], 0

    schema = (
        f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
        "pairs array<struct<pair:int,times:long>>" + ", groups string" * with_groups
    )
    return settle(source.mapInArrow(align, schema).withColumn("row", F.monotonically_increasing_id()))


def _pairs(rows: DataFrame) -> DataFrame:
    return rows.select("row", F.explode("pairs").alias("p")).select("row", "p.pair", "p.times")


def id_pairs(rows: DataFrame) -> DataFrame:
    """Settled (pair, a, b, count, best) of all documents, from the table of `linked`."""
    counts = settle(
        _pairs(rows).groupBy("pair").agg(F.count("*").alias("count")).select(
            "pair",
            F.shiftright("pair", B_BITS).alias("a"),
            F.col("pair").bitwiseAND((1 << B_BITS) - 1).alias("b"),
            "count",
        )
    )
    # one row per id of A at most
    top = F.broadcast(counts.groupBy("a").agg(F.max("count").alias("_top")))
    return settle(
        counts.join(top, "a").select("pair", "a", "b", "count", (F.col("count") == F.col("_top")).alias("best"))
    )


def align(
    docs: DataFrame, ranks: str | None = None, model: str | None = None,
    id_col: str = "doc_id", text_col: str = "text", pair_rows: int = PAIR_ROWS,
) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) per row of `docs`.

    n_links: token pairs that share a group; n_best: those whose id pair has the highest
    count of its A id over all documents, ties included; count_sum: the counts of all of
    them. groups_sha256: of the alignment as text.

    Whole texts are read, however long. A text that is NULL or empty, or whose bytes either
    tokenizer does not give back (a literal U+2581, say), has no tokens: zeros, and ''.
    Strings of special tokens are plain text. Every row is a document of its own: repeated
    rows count each, NULL ids are ids like any other. No rows give no rows. Other columns
    are not read.
    """
    rows = linked(docs, ranks, model, id_col, text_col)
    known = id_pairs(rows).select("pair", "count", "best")
    if known.count() <= pair_rows:
        known = F.broadcast(known)
    sums = (
        _pairs(rows).join(known, "pair").groupBy("row").agg(
            F.sum(F.when(F.col("best"), F.col("times")).otherwise(F.lit(0))).alias("n_best"),
            F.sum(F.col("times") * F.col("count")).alias("count_sum"),
        )
    )
    zero = F.lit(0).cast("long")
    return rows.drop("pairs").join(sums, "row", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links",
        F.coalesce("n_best", zero).alias("n_best"),
        F.coalesce("count_sum", zero).alias("count_sum"),
        "groups_sha256",
    )
