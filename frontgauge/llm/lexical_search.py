"""Ranked lexical search: Block-Max MaxScore over sharded inverted lists, heaps merged.

Documents are cut into shards of bounded size. A shard holds one list per term: the
documents that hold it, ascending by id, each with its integer impact, in compressed
blocks of BLOCK postings; beside the blocks lie their last document and largest impact.

A shard answers a query range by range of its documents. The bounds of whole lists split
the query's lists: those whose bounds together stay below the threshold (the score of the
shard's k-th best so far) are non-essential, as a document that they alone hold cannot
rank. Candidates come from the essential lists only. A candidate goes on only while its
score so far, with the block maxima of the non-essential lists at its place, reaches the
threshold; so blocks whose candidates are all rejected are never decompressed. The k best
of every shard are merged.

A first pass counts what scores need over all documents (documents with a term, all terms,
documents per term of the queries) and keeps only the postings of the queries' terms. The
queries are worked off in blocks of bounded size, each against all documents.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections import Counter
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from frontgauge.llm.common import running_total, settle, small_batches, unit_hash

BEST = 10
# Postings of a compressed block, and documents that a query looks through at a time.
BLOCK = 128
RANGE = 4_096
# A shard ends at this many documents or postings, whichever comes first.
SHARD_DOCS = 65_536
SHARD_POSTINGS = 2_000_000
# Different terms of the queries that are worked off together; a longer query is alone.
QUERY_TERMS = 200_000

# Bytes that terms are made of stay (A-Z as a-z); the others separate.
_FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32
    for b in range(256)
)


def terms_of(data: bytes) -> list[bytes]:
    """Terms of a text given as UTF-8: runs of ASCII letters, digits and all beyond ASCII."""
    return data.translate(_FOLD).split()


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def impacts(tf: np.ndarray, n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """What a posting gives per unit of its term's weight."""
    m = 10 + (90 * n * n_docs) // n_terms
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


def compress(docs: np.ndarray, impact: np.ndarray) -> bytes:
    """One block: ascending document numbers as gaps of 1, 2 or 4 bytes, then impacts in 4."""
    gaps = np.diff(docs, prepend=0)
    width = 1 if gaps.max() < 1 << 8 else 2 if gaps.max() < 1 << 16 else 4
    return bytes([width]) + gaps.astype(f"<u{width}").tobytes() + impact.astype("<u4").tobytes()


def decompress(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = (len(data) - 1) // (data[0] + 4)
    gaps = np.frombuffer(data, f"<u{data[0]}", n, 1)
    return np.cumsum(gaps.astype(np.int64)), np.frombuffer(data, "<u4", n, 1 + n * data[0]).astype(np.int64)


class Postings:
    """A term's list in one shard; blocks are decompressed when first looked into."""

    def __init__(self, last: np.ndarray, top: np.ndarray, blocks: list[bytes]):
        self.last, self.top, self.blocks = last, top, blocks
        self.bound = int(top.max())
        self.open: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def block(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        if i not in self.open:
            self.open[i] = decompress(self.blocks[i])
        return self.open[i]

    def between(self, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
        """Postings of documents low .. high - 1."""
        first = bisect_left(self.last, low)
        parts, i = [], first
        while i < len(self.last):
            parts.append(self.block(i))
            if self.last[i] >= high - 1:
                break
            i += 1
        if not parts:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        docs = np.concatenate([p[0] for p in parts])
        a, b = np.searchsorted(docs, (low, high))
        return docs[a:b], np.concatenate([p[1] for p in parts])[a:b]

    def maxima(self, docs: np.ndarray) -> np.ndarray:
        """Largest impact in the blocks where `docs` would lie; 0 behind the last block."""
        at = np.searchsorted(self.last, docs)
        return np.append(self.top, 0)[at]

    def at(self, docs: np.ndarray) -> np.ndarray:
        """Impacts of `docs` (ascending), 0 where a document lacks the term."""
        out = np.zeros(len(docs), dtype=np.int64)
        block = np.searchsorted(self.last, docs)
        for i in np.unique(block[block < len(self.last)]):
            held, impact = self.block(int(i))
            mine = np.flatnonzero(block == i)
            place = np.minimum(np.searchsorted(held, docs[mine]), len(held) - 1)
            out[mine] = np.where(held[place] == docs[mine], impact[place], 0)
        return out


def search_shard(
    lists: list[tuple[int, Postings]], n_docs: int, best: int = BEST, width: int = RANGE
) -> list[tuple[int, int]]:
    """The `best` (score, document) of a shard for one query, best first.

    lists: (weight, postings) of the query's terms. Equal scores go by document number.
    """
    lists = sorted(((w, p) for w, p in lists if w > 0), key=lambda x: x[0] * x[1].bound)
    bounds = np.cumsum([w * p.bound for w, p in lists])
    scores, docs, threshold = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), 1
    for low in range(0, n_docs, width):
        split = int(np.searchsorted(bounds, threshold))  # lists before it stay below, together
        if split == len(lists):
            break
        high = min(n_docs, low + width)
        sums = np.zeros(high - low, dtype=np.int64)
        for w, p in lists[split:]:
            found, impact = p.between(low, high)
            sums[found - low] += w * impact
        here = np.flatnonzero(sums)
        score, here = sums[here], here + low
        if split:
            alive = score + bounds[split - 1] >= threshold
            score, here = score[alive], here[alive]
            most = [w * p.maxima(here) for w, p in lists[:split]]
            hope = score + sum(most)
            for i in range(split - 1, -1, -1):
                alive = hope >= threshold
                score, here, hope = score[alive], here[alive], hope[alive]
                most = [m[alive] for m in most[:i + 1]]
                if not len(here):
                    break
                w, p = lists[i]
                sure = w * p.at(here)
                score, hope = score + sure, hope - most[i] + sure
        scores, docs = np.concatenate([scores, score]), np.concatenate([docs, here])
        order = np.lexsort((docs, -scores))[:best]
        order = order[scores[order] >= 1]
        scores, docs = scores[order], docs[order]
        if len(scores) == best:
            threshold = int(scores[-1])
    return list(zip(scores.tolist(), docs.tolist()))


def _query_blocks(queries: DataFrame, id_col: str, text_col: str, most: int) -> list[DataFrame]:
    """Settled (query, item, terms), cut into blocks of about `most` terms."""

    def split(texts: pa.Array) -> pa.Array:
        return pa.array(
            [sorted(set(terms_of(t or b""))) for t in texts.cast(pa.binary()).to_pylist()],
            pa.list_(pa.binary()),
        )

    rows = settle(
        queries.select(
            F.col(id_col).alias("item"), F.arrow_udf(split, "array<binary>")(text_col).alias("terms")
        ).withColumn("query", F.monotonically_increasing_id())
    ).where(F.size("terms") > 0).withColumn("n", F.size("terms"))
    total, count = rows.agg(F.sum("n"), F.count("*")).first()
    if not count:
        return []
    if total <= most:
        return [rows]
    laid = running_total(
        rows.withColumns({"_all": F.lit(0), "_place": unit_hash("query")}),
        ["_all"], "_place", ["query"], "n", count, "_before",
    )
    laid = settle(laid.withColumn("block", F.floor(F.col("_before") / most)))
    blocks = sorted(r[0] for r in laid.select("block").distinct().collect())
    return [laid.where(F.col("block") == b) for b in blocks]


def _held(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """Settled (doc_id, n, terms, tfs): terms of a document, and those of the vocabulary."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def count(batches):
        known = shared.value
        for batch in batches:
            n, terms, tfs = [], [], []
            for data in batch.column("text").cast(pa.binary()).to_pylist():
                words = terms_of(data or b"")
                found = Counter(map(known.get, words))
                found.pop(None, None)
                n.append(len(words))
                terms.append(list(found.keys()))
                tfs.append(list(found.values()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()),
                 pa.array(terms, pa.list_(pa.int32())), pa.array(tfs, pa.list_(pa.int64()))],
                names=["doc_id", "n", "terms", "tfs"],
            )

    return settle(docs.mapInArrow(count, f"doc_id {kind}, n long, terms array<int>, tfs array<long>"))


def index(held: DataFrame, n_docs: int, n_terms: int, shard_docs: int, shard_postings: int) -> DataFrame:
    """Settled (shard, term, ids, last, top, blocks): a shard's lists, and its ids as term -1.

    Shards are stretches of the settled rows, so a task run again makes the same ones.
    """
    kind = held.schema["doc_id"].dataType.simpleString()

    def shard_rows(no: int, rows: list[pa.Table]) -> pa.RecordBatch:
        table = pa.concat_tables(rows).sort_by([("doc_id", "ascending")])  # NULL ids come last
        lengths = table.column("terms").combine_chunks().value_lengths().to_numpy()
        doc = np.repeat(np.arange(table.num_rows), lengths)
        term = table.column("terms").combine_chunks().flatten().to_numpy()
        tf = table.column("tfs").combine_chunks().flatten().to_numpy()
        impact = impacts(tf, table.column("n").to_numpy()[doc], n_docs, n_terms)
        order = np.argsort(term, kind="stable")
        doc, term, impact = doc[order], term[order], impact[order]
        starts = np.flatnonzero(np.diff(term, prepend=-1))
        ends = np.append(starts[1:], len(term))
        last, top, blocks = [None], [None], [None]
        for a, b in zip(starts, ends):
            cut = [slice(i, min(i + BLOCK, b)) for i in range(a, b, BLOCK)]
            last.append([int(doc[c][-1]) for c in cut])
            top.append([int(impact[c].max()) for c in cut])
            blocks.append([compress(doc[c], impact[c]) for c in cut])
        ids = table.column("doc_id").combine_chunks()
        ids = pa.ListArray.from_arrays(
            pa.array([0] + [len(ids)] * (len(starts) + 1), pa.int32()), ids
        )
        return pa.RecordBatch.from_arrays(
            [pa.array([no] * len(ids), pa.int64()),
             pa.array(np.concatenate([[-1], term[starts]]), pa.int32()), ids,
             pa.array(last, pa.list_(pa.int32())), pa.array(top, pa.list_(pa.int64())),
             pa.array(blocks, pa.list_(pa.binary()))],
            names=["shard", "term", "ids", "last", "top", "blocks"],
        )

    def build(batches):
        no, rows, docs, postings = TaskContext.get().partitionId() << 32, [], 0, 0
        for batch in batches:
            rows.append(pa.Table.from_batches([batch]))
            docs += batch.num_rows
            postings += len(batch.column("terms").flatten())
            if docs >= shard_docs or postings >= shard_postings:
                yield shard_rows(no, rows)
                no, rows, docs, postings = no + 1, [], 0, 0
        if docs:
            yield shard_rows(no, rows)

    return settle(
        held.where(F.size("terms") > 0).mapInArrow(
            build,
            f"shard long, term int, ids array<{kind}>, last array<int>, top array<long>, blocks array<binary>",
        )
    )


def search(
    docs: DataFrame, queries: DataFrame, best: int = BEST, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", query_col: str = "text", query_terms: int = QUERY_TERMS,
    shard_docs: int = SHARD_DOCS, shard_postings: int = SHARD_POSTINGS, width: int = RANGE,
) -> DataFrame:
    """(item_id, rank, doc_id, score): per row of `queries`, its `best` documents scoring above 0.

    Equal scores go by ascending doc_id, NULL ids last. Terms count once a query. Whole
    texts are read. A NULL text, of a document or a query, has no terms; documents without
    terms count for nothing, and queries without terms, or whose terms no document holds,
    give no rows. Repeated rows of `docs` are documents each, and rank side by side; repeated
    rows of `queries` are answered each. Empty tables give no rows. Other columns are not read.
    """
    spark = docs.sparkSession
    small_batches(spark)
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    item = queries.schema[item_col].dataType.simpleString()
    answers = [
        _answer(source, block, kind, best, shard_docs, shard_postings, width)
        for block in _query_blocks(queries, item_col, query_col, query_terms)
    ]
    answers = [a for a in answers if a is not None]
    if not answers:
        return spark.createDataFrame([], f"item_id {item}, rank int, doc_id {kind}, score long")
    return reduce(DataFrame.union, answers)


def _answer(
    source: DataFrame, block: DataFrame, kind: str, best: int, shard_docs: int, shard_postings: int, width: int
) -> DataFrame | None:
    """The answers to one block of queries, None if the documents hold none of their terms."""
    spark = source.sparkSession
    asked = block.select("query", "terms").collect()  # about QUERY_TERMS terms, or one query
    vocabulary = {t: i for i, t in enumerate(sorted({bytes(t) for r in asked for t in r.terms}))}
    held = _held(source, vocabulary)
    n_docs, n_terms = held.agg(F.count(F.when(F.col("n") > 0, 1)), F.sum("n")).first()
    df = dict(held.select(F.explode("terms").alias("t")).groupBy("t").count().collect())
    if not df:
        return None
    weights = {t: weight(n_docs, n) for t, n in df.items()}
    lists = index(held, n_docs, n_terms, shard_docs, shard_postings)
    plan = spark.sparkContext.broadcast((
        weights,
        [(r["query"], [t for t in (vocabulary[bytes(x)] for x in r.terms) if t in weights]) for r in asked],
    ))

    def look(shard: pa.Table) -> pa.Table:
        weights, asked = plan.value
        postings, ids = {}, None
        for i, term in enumerate(shard.column("term").to_pylist()):
            if term < 0:
                ids = shard.column("ids")[i].values
                continue
            last, top = (np.asarray(shard.column(c)[i].values).astype(np.int64) for c in ("last", "top"))
            postings[term] = Postings(last, top, shard.column("blocks")[i].as_py())
        found = []
        for query, terms in asked:
            lists = [(weights[t], postings[t]) for t in terms if t in postings]
            found += [(query, s, d) for s, d in search_shard(lists, len(ids), best, width)]
        return pa.table({
            "query": pa.array([f[0] for f in found], pa.int64()),
            "doc_id": ids.take(pa.array([f[2] for f in found], pa.int64())),
            "score": pa.array([f[1] for f in found], pa.int64()),
        })

    heaps = lists.groupBy("shard").applyInArrow(look, f"query long, doc_id {kind}, score long")
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = heaps.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best)
    return ranked.join(block.select("query", "item"), "query").select(
        F.col("item").alias("item_id"), F.col("rank").cast("int").alias("rank"), "doc_id", "score"
    )


ORACLE_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents
),
s AS (SELECT count(*) FILTER (WHERE len(terms) > 0) AS n, sum(len(terms))::BIGINT AS l FROM d),
t AS (
  SELECT r, doc_id, term, count(*) AS tf
  FROM (SELECT r, doc_id, unnest(terms) AS term FROM d) GROUP BY r, doc_id, term
),
w AS (SELECT term, floor(1000 * ln((2 * s.n + 2) / (2 * df + 1)))::BIGINT AS w
  FROM (SELECT term, count(*) AS df FROM t GROUP BY term), s),
q AS (
  SELECT DISTINCT b, item_id, term
  FROM (SELECT row_number() OVER () AS b, item_id, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark)
),
scored AS (
  SELECT q.b, q.item_id, t.r, t.doc_id, sum(w.w * ((1000000000 * t.tf)
    // (1000 * t.tf + 8 * (10 + (90 * len(d.terms) * s.n) // s.l))))::BIGINT AS score
  FROM q JOIN t USING (term) JOIN w USING (term) JOIN d ON d.r = t.r, s
  GROUP BY q.b, q.item_id, t.r, t.doc_id
)
SELECT item_id, rank, doc_id, score FROM (
  SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY b ORDER BY score DESC, doc_id)::INTEGER AS rank
  FROM scored WHERE score > 0
) WHERE rank <= 10
"""
