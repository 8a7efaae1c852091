"""Near-duplicate embeddings: an exact metric range join.

On unit vectors, cosine >= s is distance <= theta = sqrt(2 - 2 s). Pivots drawn from
the data part the space: every vector is owned by the cell of its nearest pivot, and
visits the other cells that may own a partner. A partner u of v in cell j, with
d(u, v) <= theta, gives by the triangle inequality

    d(v, p_j) <= radius_j + theta    and    d(v, p_j) <= d(v, p_own) + 2 theta,

and lies beyond the plane midway between the pivots, from which v is then at most
theta away. All three are needed for a visit, with a margin for rounding. Cells join on
their own: each vector that is in a cell is compared with the vectors the cell owns, so
every linked pair is seen from both ends exactly once.

Equal vectors are joined as one with a count. A crowded cell is cut into blocks of
owners and blocks of seekers, so a task holds a bounded number of vectors.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frontgauge.llm.common import components, settle, unit_hash

COSINE = 0.9
# Vectors per pivot aimed at, and pivots at most (their table is sent to every task).
CELL_ROWS = 4_096
MOST_PIVOTS = 1_024
# Owners, and seekers, that one task compares.
BLOCK_ROWS = 8_192
# Rows of a block compared at once.
STRIPE = 512
_SLACK = 1e-6
# Products of unit vectors in single precision are off by less than this for up to a few
# thousand dimensions; pairs that close to the bound are settled in double precision.
_SINGLE = 1e-4


def _matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    values = np.asarray(column.flatten(), dtype=np.float64).reshape(-1, width)
    return values / np.sqrt((values * values).sum(axis=1))[:, None]


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (a @ b.T)))


def _by_width(batch: pa.RecordBatch):
    """(width, rows of that width) of a batch's vectors."""
    widths = np.asarray(batch.column("embedding").value_lengths())
    for width in np.unique(widths):
        yield int(width), batch.take(pa.array(np.flatnonzero(widths == width)))


def find_links(table: pa.Table, cosine: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of one block: seeker nodes, their link counts, and edges that span its links.

    `table` has node, copies, owner (bool) and embedding of one width.
    """
    owner = np.asarray(table.column("owner"))
    width = len(table.column("embedding")[0])
    vectors = _matrix(table.column("embedding"), width)
    node = np.asarray(table.column("node"))
    copies = np.asarray(table.column("copies"))
    at, to = np.flatnonzero(~owner), np.flatnonzero(owner)
    links = np.zeros(len(at), dtype=np.int64)
    # parents over positions: seekers first, then owners that no seeker stands for
    names, back = np.unique(node, return_inverse=True)
    parent = np.arange(len(names))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    edges_a, edges_b = [], []
    single, columns = vectors.astype(np.float32), np.ascontiguousarray(vectors[to].T, dtype=np.float32)
    for start in range(0, len(at), STRIPE):
        rows = at[start : start + STRIPE]
        product = single[rows] @ columns
        i, j = np.nonzero(product >= cosine - _SINGLE)
        apart = node[rows[i]] != node[to[j]]
        i, j = i[apart], j[apart]
        near = product[i, j] >= cosine + _SINGLE
        for k in np.flatnonzero(~near):
            near[k] = vectors[rows[i[k]]] @ vectors[to[j[k]]] >= cosine
        i, j = i[near], j[near]
        links[start : start + len(rows)] = np.bincount(i, copies[to[j]], len(rows)).astype(np.int64)
        ends = np.searchsorted(i, np.arange(len(rows) + 1))
        for r in np.unique(i):
            me = back[rows[r]]
            others = {find(x) for x in set(back[to[j[ends[r] : ends[r + 1]]]].tolist())}
            root = find(me)
            for other in sorted(others):
                other = find(other)
                if other != root:
                    edges_a.append(names[me])
                    edges_b.append(names[other])
                    parent[other] = root
    return node[at], links, np.array(edges_a, dtype=np.int64), np.array(edges_b, dtype=np.int64)


def join(
    vectors: DataFrame, cosine: float = COSINE, cell_rows: int = CELL_ROWS,
    block_rows: int = BLOCK_ROWS, most_pivots: int = MOST_PIVOTS,
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of `vectors`.

    Reads vec_id and embedding. A vector that is NULL, empty or zero, or holds NULL or
    non-finite components, links with nothing; nor do vectors of unequal width link. A
    row with NULL vec_id links with nothing and has NULL component and kept false.
    Repeated rows are vectors of their own, linked with each other. No rows give none.
    """
    theta = math.sqrt(2.0 - 2.0 * cosine)
    spark = vectors.sparkSession
    sane = F.coalesce(
        F.col("vec_id").isNotNull()
        & F.exists("embedding", lambda x: x != 0)
        & F.forall(
            "embedding",
            lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))),
        ),
        F.lit(False),
    )
    rows = vectors.select(
        "vec_id",
        "embedding",
        sane.alias("sane"),
        F.xxhash64("embedding").alias("k1"),
        F.xxhash64(F.lit(7), "embedding").alias("k2"),
    )
    # one row per different vector: the row of its smallest id, with the number of copies
    good = rows.where("sane")
    least = good.groupBy("k1", "k2").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("copies"))
    reps = settle(
        good.join(least, ["k1", "k2", "vec_id"])
        .dropDuplicates(["k1", "k2", "vec_id"])
        .select("k1", "k2", "vec_id", "copies", "embedding")
        .withColumn("node", F.monotonically_increasing_id())
    )
    n = reps.count()
    wanted = min(most_pivots, max(1, n // cell_rows))
    picked = [
        np.array(r[0], dtype=np.float64)
        for r in reps.select("embedding", unit_hash("k1", "k2").alias("_h"))
        .orderBy("_h").limit(wanted).select("embedding").collect()
    ]
    # vectors of a width that no pivot has all go to one cell of their own, block by block
    pivots: dict[int, np.ndarray] = {}
    for p in picked:
        one = (p / np.sqrt(p @ p))[None, :]
        own = pivots.get(len(p))
        # pivots closer than theta would copy nearly all of their cells to each other
        if own is None:
            pivots[len(p)] = one
        elif _distances(one, own).min() > theta:
            pivots[len(p)] = np.vstack([own, one])
    shared = spark.sparkContext.broadcast(pivots)

    def assign(batches):
        for batch in batches:
            for width, part in _by_width(batch):
                p = shared.value.get(width)
                if p is None:
                    cell, far = np.zeros(part.num_rows, int), np.full(part.num_rows, 2.0)
                else:
                    d = _distances(_matrix(part.column("embedding"), width), p)
                    cell = d.argmin(axis=1)
                    far = d[np.arange(len(d)), cell]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(part.num_rows, width, np.int32)),
                     pa.array(cell.astype(np.int32)), pa.array(far)],
                    names=["width", "cell", "far"],
                )

    # one row per pivot
    radii = {
        (r[0], r[1]): r[2]
        for r in reps.select("embedding").mapInArrow(assign, "width int, cell int, far double")
        .groupBy("width", "cell").agg(F.max("far")).collect()
    }
    reach = {
        w: np.array([radii.get((w, j), -1.0) for j in range(len(p))]) for w, p in pivots.items()
    }
    reach_shared = spark.sparkContext.broadcast(reach)

    def visit(batches):
        for batch in batches:
            for width, part in _by_width(batch):
                p = shared.value.get(width)
                if p is None:
                    at = np.arange(part.num_rows)
                    cells, owner = np.zeros(len(at), int), np.ones(len(at), bool)
                else:
                    radius = reach_shared.value[width]
                    d = _distances(_matrix(part.column("embedding"), width), p)
                    own = d.argmin(axis=1)
                    near = d[np.arange(len(d)), own][:, None]
                    gap = _distances(p, p)[own]
                    plane = (d * d - near * near) / np.maximum(2.0 * gap, 1e-12)
                    go = (
                        (radius[None, :] >= 0)
                        & (d <= radius[None, :] + theta + _SLACK)
                        & (d <= near + 2.0 * theta + _SLACK)
                        & (plane <= theta + _SLACK)
                    )
                    go[np.arange(len(d)), own] = True
                    at, cells = np.nonzero(go)
                    owner = cells == own[at]
                rows_ = part.take(pa.array(at))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(at), width, np.int32)), pa.array(cells.astype(np.int32)),
                     pa.array(owner), rows_.column("node"), rows_.column("copies"),
                     rows_.column("embedding")],
                    names=["width", "cell", "owner", "node", "copies", "embedding"],
                )

    kind = reps.schema["embedding"].dataType.simpleString()
    visits = settle(
        reps.select("node", "copies", "embedding").mapInArrow(
            visit,
            f"width int, cell int, owner boolean, node long, copies long, embedding {kind}",
        )
    )
    # one row per pivot again: how many blocks of owners and of seekers its cell needs
    blocks = F.broadcast(
        settle(
            visits.groupBy("width", "cell").agg(
                F.ceil(F.sum(F.col("owner").cast("int")) / block_rows).cast("int").alias("owner_blocks"),
                F.ceil(F.count("*") / block_rows).cast("int").alias("seeker_blocks"),
            )
        )
    )
    sized = visits.join(blocks, ["width", "cell"])
    own_block = F.pmod(F.xxhash64("node"), F.col("owner_blocks")).cast("int")
    seek_block = F.pmod(F.xxhash64("node"), F.col("seeker_blocks")).cast("int")
    owners = sized.where("owner").select(
        "width", "cell", "owner", "node", "copies", "embedding",
        own_block.alias("i"),
        F.explode(F.sequence(F.lit(0), F.col("seeker_blocks") - 1)).alias("j"),
    )
    seekers = sized.where("owner_blocks > 0").select(
        "width", "cell", F.lit(False).alias("owner"), "node", "copies", "embedding",
        F.explode(F.sequence(F.lit(0), F.col("owner_blocks") - 1)).alias("i"),
        seek_block.alias("j"),
    )

    def compare(block: pa.Table) -> pa.Table:
        node, links, a, b = find_links(block, cosine)
        some = links > 0
        none_a, none_b = np.zeros(some.sum(), np.int64), np.zeros(len(a), np.int64)
        return pa.table({
            "node": np.concatenate([node[some], a]),
            "links": np.concatenate([links[some], none_b]),
            "other": pa.concat_arrays([
                pa.array(none_a, mask=np.ones(len(none_a), bool)), pa.array(b)
            ]),
        })

    # at most 2 * block_rows vectors a group
    found = settle(
        owners.union(seekers)
        .groupBy("width", "cell", "i", "j")
        .applyInArrow(compare, "node long, links long, other long")
    )
    links = found.where("other is null").groupBy("node").agg(F.sum("links").alias("links"))
    joined = components(found.where("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b")))
    names = reps.select("node", "vec_id").join(joined, "node")
    least_id = names.groupBy("component").agg(F.min("vec_id").alias("component_id"))
    classes = names.join(least_id, "component").select("node", "component_id")
    told = (
        reps.select("k1", "k2", "node", "copies", F.col("vec_id").alias("first_id"))
        .join(links, "node", "left")
        .join(classes, "node", "left")
        .select(
            "k1",
            "k2",
            (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
            F.coalesce("component_id", "first_id").alias("component_id"),
        )
    )
    key = [F.when(F.col("sane"), F.col(k)).alias(k) for k in ("k1", "k2")]
    out = rows.select("vec_id", *key).join(told, ["k1", "k2"], "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.cast("long").alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"),
    )


ORACLE_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b
  ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.9
), reach(a, b) AS (
  SELECT vec_id, vec_id FROM v UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
), least AS (SELECT a, min(b) AS c FROM reach GROUP BY a)
SELECT m.vec_id, (SELECT count(*) FROM links l WHERE l.a = m.vec_id) AS n_links,
  coalesce(least.c, m.vec_id) AS component_id, m.vec_id = coalesce(least.c, m.vec_id) AS kept
FROM embeddings m LEFT JOIN least ON least.a = m.vec_id
"""
