"""Does the surrogate lead to the same optimisation result as the true objectives?"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import ColumnOrNumber, known, ratio
from ..plans.dominance import front_rows
from ..plans.halving import HALVED, equal_pairs_of, pairs_below, row_codes
from ..plans.ordered import BLOCK, in_blocks, match, running
from ..plans.segments import by_size, pair_counts
from ..session import limit
from .errors import equal_pairs, pairs_no_worse, sum_parts
from .fronts import top_n
from .indicators import hv2, hv3


def front_agreement(
    true: DataFrame, pred: DataFrame, keys: Sequence[str], id: Sequence[str]
) -> DataFrame:
    """Precision, recall and Jaccard of predicted against true front membership.

    One row per group in either front; a share of nothing is NULL.
    """
    key = [*keys, *id]
    tagged = true.select(*key, F.lit(1).alias("_t"), F.lit(0).alias("_p")).unionByName(
        pred.select(*key, F.lit(0).alias("_t"), F.lit(1).alias("_p"))
    )
    # Both sides meet in one shuffle on the full key, which no single group can clog.
    member = tagged.groupBy(*key).agg(F.max("_t").alias("_t"), F.max("_p").alias("_p"))
    both, t, p = F.sum(F.col("_t") * F.col("_p")), F.sum("_t"), F.sum("_p")
    return member.groupBy(*keys).agg(
        t.alias("n_true"),
        p.alias("n_pred"),
        both.alias("n_both"),
        ratio(both, p).alias("precision"),
        ratio(both, t).alias("recall"),
        ratio(both, F.count(F.lit(1))).alias("jaccard"),
    )


def hv_retained(
    df: DataFrame,
    keys: Sequence[str],
    true: Sequence[str],
    pred: Sequence[str],
    ref: Sequence[ColumnOrNumber],
) -> DataFrame:
    """True hypervolume of the rows the surrogate would pick, over the best possible."""
    keys = list(keys)
    volume = hv2 if len(true) == 2 else hv3
    got = volume(front_rows(df, keys, pred), keys, true, ref, "hv_pred")
    best = volume(df, keys, true, ref, "hv_true")
    return match(best, got, keys).withColumn("retained", ratio(F.col("hv_pred"), F.col("hv_true")))


def topk(
    df: DataFrame,
    keys: Sequence[str],
    id: Sequence[str],
    k: int,
    y: str = "y",
    yhat: str = "yhat",
) -> DataFrame:
    """Share of the true best k among the predicted best k, and the regret of the predicted best.

    Smaller is better; ties by id. Rows without a true or a predicted value do not count;
    a group of such rows stays, with k 0.
    """
    keys, id = list(keys), list(id)
    nothing = _without_rows(df, keys, [y, yhat])
    df = df.where(known(y, yhat))
    true = top_n(df, keys, [y, *id], k).select(*keys, *id, F.lit(1).alias("_t"), F.lit(0).alias("_p"))
    pred = top_n(df, keys, [yhat, *id], k).select(*keys, *id, F.lit(0).alias("_t"), F.lit(1).alias("_p"))
    both = true.unionByName(pred).groupBy(*keys, *id).agg(F.sum("_t").alias("_t"), F.sum("_p").alias("_p"))
    recall = both.groupBy(*keys).agg(
        F.sum("_t").alias("k"),
        ratio(F.sum(F.col("_t") * F.col("_p")), F.sum("_t")).alias("topk_recall"),
    )
    regret = df.groupBy(*keys).agg(
        (F.min_by(y, F.struct(yhat, *id)) - F.min(y)).alias("regret")
    )
    return match(recall, regret, keys).unionByName(
        nothing.select(
            *keys,
            F.lit(0).cast("long").alias("k"),
            F.lit(None).cast("double").alias("topk_recall"),
            F.lit(None).cast(regret.schema["regret"].dataType).alias("regret"),
        )
    )


def _without_rows(df: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    """Groups that hold no row with all of these values."""
    whole = df.groupBy(*keys).agg(F.count_if(known(*cols)).alias("_n"))
    return whole.where("_n = 0").select(*keys)


def anytime(
    evals: DataFrame, run: Sequence[str], order: Sequence[str], value: str = "value"
) -> DataFrame:
    """Add `step` (from 1) and `best`, the least value so far, along each run."""
    laid = in_blocks(evals, run, order)
    outs = {"step": ("sum", F.lit(1).cast("long")), "best": ("min", F.col(value))}
    return running(laid, run, order, outs).drop(BLOCK)


def to_target(curve: DataFrame, run: Sequence[str], target: float) -> DataFrame:
    """First step at or below the target (NULL if never), and the mean of best-so-far."""
    return curve.groupBy(*run).agg(
        F.count(F.lit(1)).alias("steps"),
        F.min(F.when(F.col("best") <= F.lit(float(target)), F.col("step"))).alias("first_step"),
        F.avg("best").alias("mean_best"),
    )


def _relation(some: np.ndarray, all_: np.ndarray) -> np.ndarray:
    """1 where a row of `some` dominates one of `all_`, -1 the other way, else 0."""
    le = np.ones((len(some), len(all_)), dtype=bool)
    ge = np.ones_like(le)
    for a, b in zip(some.T, np.ascontiguousarray(all_.T)):
        le &= a[:, None] <= b[None, :]
        ge &= a[:, None] >= b[None, :]
    return le.view(np.int8) - ge.view(np.int8)


def pair_order(
    df: DataFrame, keys: Sequence[str], true: Sequence[str], pred: Sequence[str]
) -> DataFrame:
    """Share of row pairs whose relation (which dominates, or neither) is unchanged.

    Small groups are counted directly, others from counts of pairs in joint order: in an
    array by halving, over blocks where a group is too big for one; no pair is listed. Rows with a NULL objective, true or predicted, do
    not count; a group of such rows stays, with 0 pairs.
    """
    keys, t, p = list(keys), list(true), list(pred)
    nothing = _without_rows(df, keys, [*t, *p])
    df = df.where(known(*t, *p))
    n = F.col("n")
    pairs = (n * (n - 1) / 2).cast("long")
    finish = [*keys, pairs.alias("pairs"), "unchanged", ratio(F.col("unchanged"), pairs).alias("share")]
    d = len(t)
    halved = len(t) + len(p) <= HALVED

    def same(some: np.ndarray, all_: np.ndarray) -> list[int]:
        alike = _relation(some[:, :d], all_[:, :d]) == _relation(some[:, d:], all_[:, d:])
        return [int(alike.sum()) - len(some)]  # without each row's pair with itself

    def small(rows: DataFrame, size: int) -> DataFrame:
        whole = (lambda v: [2 * _unchanged_in(v[:, :d], v[:, d:])]) if halved else None
        got = pair_counts(rows, keys, [*t, *p], ["_same"], same, size, whole=whole)
        return got.withColumn("unchanged", (F.col("_same") / 2).cast("long")).select(*finish)

    def big(rows: DataFrame) -> DataFrame:
        return _unchanged_pairs(rows, keys, t, p).select(*finish)

    # a call holds the numbers of a group several times over, which a window's sort does not
    most = limit(df.sparkSession, "window.rows") // 4 if halved else None
    zero = F.lit(0).cast("long")
    return by_size(df, keys, small, big, most).unionByName(
        nothing.select(
            *keys, zero.alias("pairs"), zero.alias("unchanged"), F.lit(None).cast("double").alias("share")
        )
    )


def _unchanged_in(t: np.ndarray, p: np.ndarray) -> int:
    """Pairs of rows in unchanged relation; the counts are those of `_unchanged_pairs`."""
    n, both, other = len(t), np.hstack([t, p]), np.hstack([t, -p])
    ties = equal_pairs_of(both)
    # a row with an undefined number on one side is in no order there
    dom_t, dom_p = (pairs_below(v) - equal_pairs_of(v) for v in (t, p))
    told = ~np.isnan(both).any(axis=1)
    ts = pairs_below(p[told], row_codes(t[told]))
    ps = pairs_below(t[told], row_codes(p[told]))
    same, opposite = (pairs_below(v) - ts - ps + ties for v in (both, other))
    return n * (n - 1) // 2 - dom_t - dom_p + 2 * same + opposite


def _unchanged_pairs(df: DataFrame, keys: list[str], t: list[str], p: list[str]) -> DataFrame:
    flip = [f"_f{c}" for c in p]
    df = df.withColumns({f: -F.col(c) for f, c in zip(flip, p)})

    def grouped(by, cols):
        pairs = pairs_no_worse(df, [*keys, *by], cols)
        return pairs.groupBy(*keys).agg(F.sum("_pairs").alias("_pairs"))

    got = sum_parts(
        keys,
        {
            "n": df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_pairs")),
            "_t": pairs_no_worse(df, keys, t),
            "_p": pairs_no_worse(df, keys, p),
            "_et": equal_pairs(df, keys, t),
            "_ep": equal_pairs(df, keys, p),
            "_etp": equal_pairs(df, keys, [*t, *p]),
            # no worse in both, and in both the other way round for the prediction
            "_s": pairs_no_worse(df, keys, [*t, *p]),
            "_o": pairs_no_worse(df, keys, [*t, *flip]),
            # of these, pairs tied on one side
            "_ts": grouped(t, p),
            "_ps": grouped(p, t),
        },
    )
    n, c = F.col("n"), F.col
    pairs = (n * (n - 1) / 2).cast("long")
    dom_t, dom_p = c("_t") - c("_et"), c("_p") - c("_ep")
    same = c("_s") - c("_ts") - c("_ps") + c("_etp")
    # Tied on one side, pairs in opposite order are as many as in the same order.
    opposite = c("_o") - c("_ts") - c("_ps") + c("_etp")
    neither = pairs - dom_t - dom_p + same + opposite
    return got.select(*keys, "n", (same + neither).alias("unchanged"))
