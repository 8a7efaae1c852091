"""URL filter: host and path rules, and gradient-boosted trees for the rest.

The trees read lexical features of the address (lengths, depth, digit share, entropy,
parameters, statistics of its suffix and of the head of its path) and learn from the URLs
that a rule labels. Every HELD_OF-th host, by hash, is held out: its labels take no part in
statistics and trees, they set the threshold.
Everything is DataFrame functions: features are cut into fixed bins, labelled rows are
summed up to one row per combination of bins, and every level of every tree is one
aggregate of gradients per node, feature and bin. The driver sees those sums (nodes x
features x bins, whatever the input) and picks splits; the model is a column expression.
"""

from __future__ import annotations

import math
import string
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frontgauge.llm.common import settle

# Rules as host/path; the longest that fits wins.
RULES = (
    ("org/", "allow"),
    ("example.org/es/", "block"),
    ("example.org/en/1", "block"),
    ("com/fr/", "allow"),
    ("com/de/", "block"),
)
BINS = 32
TREES = 16
DEPTH = 3
RATE = 0.3
RIDGE = 1.0
# A suffix or path head with few labelled URLs is drawn to the overall rate by this many.
PRIOR_ROWS = 5.0
# Values of a statistic are hashed to so many places, which bounds its table.
PLACES = 1 << 16
# One host in so many is held out.
HELD_OF = 5
# Thresholds lie at 1/STEPS, 2/STEPS ...
STEPS = 100


def host_of(url: Column) -> Column:
    rest = _after_scheme(url)
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    return F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1)


def _after_scheme(url: Column) -> Column:
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    return F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, as a struct (rule, verdict); NULL if none does."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule, verdict in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        name, _, rest = rule.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(
            path, F.lit("/" + rest)
        )
        found = F.when(
            fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))
        ).otherwise(found)
    return found


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def entropy(text: Column) -> Column:
    """Entropy of a text's characters, in bits."""
    n = F.length(text)
    total = F.aggregate(
        F.array_distinct(F.split(text, "")),
        F.lit(0.0),
        lambda sum_, c: sum_ + _n_log_n(n - F.length(F.replace(text, c, F.lit("")))),
    )
    return F.when(n > 0, F.log2(n.cast("double")) - total / n).otherwise(F.lit(0.0))


def _n_log_n(n: Column) -> Column:
    return F.when(n > 0, n * F.log2(n.cast("double"))).otherwise(F.lit(0.0))


def _lexical(url: Column, host: Column, path: Column) -> dict[str, Column]:
    """Features by name, each as a number that is cut at 0 and BINS - 1."""
    long = F.greatest(F.length(url), F.lit(1))
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    return {
        "length": F.length(url) / 8,
        "host_length": F.length(host) / 2,
        "path_length": F.length(path) / 4,
        "labels": _count(host, r"[^.]+"),
        "depth": _count(path, "/[^/]"),
        "digit_ratio": _count(url, "[0-9]") / long * BINS,
        "hyphens": _count(host, "-"),
        "entropy": entropy(url) * 5,
        "parameters": F.when(query == "", 0).otherwise(_count(query, "&") + 1),
        "query_length": F.length(query) / 4,
        "fragment": F.when(F.contains(url, F.lit("#")), 1).otherwise(0),
        "extension": F.length(F.regexp_extract(path, r"\.([^./]*)$", 1)),
        "last_slash": F.when(F.endswith(path, F.lit("/")), 1).otherwise(0),
    }


def _learnt(host: Column, path: Column) -> dict[str, Column]:
    """Parts of an address by name, of which the share of blocked URLs is a feature.

    The suffix, the first segment of the path, and the latter with the first character of
    the next segment, alone and with the suffix.
    """
    suffix = F.substring_index(host, ".", -1)
    segment = F.regexp_extract(path, r"^/([^/]*)", 1)
    head = F.regexp_extract(path, r"^/([^/]*/[^/]?)", 1)
    return {
        "suffix": suffix,
        "segment": segment,
        "head": head,
        "suffix_segment": F.concat_ws("/", suffix, segment),
        "suffix_head": F.concat_ws("/", suffix, head),
    }


def _binned(value: Column) -> Column:
    return F.least(F.greatest(F.floor(value), F.lit(0)), F.lit(BINS - 1)).cast("int")


def with_features(pages: DataFrame, rules=RULES) -> tuple[DataFrame, list[str]]:
    """Settled (page_id, host, path, rule, told, label, held, a bin per feature) of every row."""
    url = F.coalesce("url", F.lit(""))
    cut = pages.select("page_id", url.alias("url")).select(
        "page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")
    )
    lexical = _lexical(F.col("url"), F.col("host"), F.col("path"))
    learnt = _learnt(F.col("host"), F.col("path"))
    rows = settle(
        cut.withColumn("_rule", rule_of(F.col("host"), F.col("path"), rules)).select(
            "page_id",
            "host",
            "path",
            F.col("_rule.rule").alias("rule"),
            F.col("_rule.verdict").alias("told"),
            F.when(F.col("_rule.verdict") == "block", 1)
            .when(F.col("_rule.verdict") == "allow", 0)
            .alias("label"),
            (F.pmod(F.xxhash64("host"), F.lit(HELD_OF)) == 0).alias("held"),
            *[_binned(c).alias(name) for name, c in lexical.items()],
            *[F.pmod(F.xxhash64(c), F.lit(PLACES)).cast("int").alias(f"_{n}") for n, c in learnt.items()],
        )
    )
    # per place: share of blocked among URLs learnt from, drawn to the overall share, and size
    taught = F.when(~F.col("held"), F.col("label"))
    overall = rows.agg(F.avg(taught)).first()[0] or 0.0
    wide, features = rows, list(lexical)
    for name in learnt:
        counts = rows.groupBy(f"_{name}").agg(
            F.count(taught).alias("_told"),
            F.coalesce(F.sum(taught), F.lit(0)).alias("_blocked"),
            F.count("*").alias("_all"),
        )
        rate = (F.col("_blocked") + PRIOR_ROWS * overall) / (F.col("_told") + PRIOR_ROWS)
        stats = counts.select(
            f"_{name}",
            _binned(rate * BINS).alias(f"{name}_rate"),
            _binned(F.log2(F.col("_all") + 1)).alias(f"{name}_rows"),
        )
        wide = wide.join(F.broadcast(settle(stats)), f"_{name}")  # at most PLACES rows of 3 numbers
        features += [f"{name}_rate", f"{name}_rows"]
    return wide.drop(*[f"_{name}" for name in learnt]), features


@dataclass
class Node:
    """A leaf with its value, or a split: bins up to `cut` of `feature` go to `low`."""

    value: float = 0.0
    feature: str | None = None
    cut: int = 0
    low: Node | None = None
    high: Node | None = None

    def column(self) -> Column:
        if self.feature is None:
            return F.lit(self.value)
        return F.when(F.col(self.feature) <= self.cut, self.low.column()).otherwise(
            self.high.column()
        )


def _leaves(root: Node) -> list[Node]:
    return [root] if root.feature is None else _leaves(root.low) + _leaves(root.high)


def _number(node: Node, ids: dict[int, int]) -> Column:
    if node.feature is None:
        return F.lit(ids[id(node)])
    return F.when(F.col(node.feature) <= node.cut, _number(node.low, ids)).otherwise(
        _number(node.high, ids)
    )


def boost(
    cells: DataFrame, features: list[str], trees: int = TREES, depth: int = DEPTH,
    rate: float = RATE, ridge: float = RIDGE,
) -> tuple[float, list[Node]]:
    """Logistic boosting over `cells`: rows of bins with `n` URLs, `blocked` of them to block.

    One aggregate per tree level. Equal gains go to the first feature and lowest cut, so
    the trees depend on the counts only.
    """
    n, blocked = cells.agg(F.sum("n"), F.sum("blocked")).first()
    if not n:
        return 0.0, []
    start = math.log((blocked + 1.0) / (n - blocked + 1.0))
    model: list[Node] = []
    for _ in range(trees):
        p = 1 / (1 + F.exp(-margin(start, model)))
        graded = cells.withColumn("_p", p).select(
            *features,
            (F.col("n") * F.col("_p") - F.col("blocked")).alias("_g"),
            (F.col("n") * F.col("_p") * (1 - F.col("_p"))).alias("_h"),
        )
        root = Node()
        for _ in range(depth):
            open_ = {id(leaf): i for i, leaf in enumerate(_leaves(root))}
            pairs = F.array(*[
                F.struct(F.lit(i).alias("f"), F.col(name).alias("b")) for i, name in enumerate(features)
            ])
            sums = (
                graded.select(_number(root, open_).alias("leaf"), F.explode(pairs).alias("x"), "_g", "_h")
                .groupBy("leaf", "x.f", "x.b")
                .agg(F.sum("_g").alias("g"), F.sum("_h").alias("h"))
                .collect()  # at most 2^depth * features * BINS rows
            )
            for leaf in _leaves(root):
                _split(leaf, [r for r in sums if r[0] == open_[id(leaf)]], features, rate, ridge)
        model.append(root)
    return start, model


def _split(leaf: Node, sums: list, features: list[str], rate: float, ridge: float) -> None:
    """Split a leaf where the loss falls most, rounded so that sums may come in any order.

    The cut lies midway between the bins that have rows on either side: values that no
    labelled URL has go to the nearer side.
    """
    best = (1e-6, None)
    for i, name in enumerate(features):
        bins = sorted((b, g, h) for _, f, b, g, h in sums if f == i)
        all_g, all_h = math.fsum(x[1] for x in bins), math.fsum(x[2] for x in bins)
        g = h = 0.0
        for (b, bin_g, bin_h), (after, _, _) in zip(bins, bins[1:]):
            g, h = g + bin_g, h + bin_h
            gain = round(
                g * g / (h + ridge) + (all_g - g) ** 2 / (all_h - h + ridge) - all_g**2 / (all_h + ridge), 6
            )
            if gain > best[0]:
                best = (gain, (name, (b + after) // 2, -rate * g / (h + ridge), -rate * (all_g - g) / (all_h - h + ridge)))
        if leaf.value == 0.0 and bins:
            leaf.value = -rate * all_g / (all_h + ridge)
    if best[1]:
        name, cut, low, high = best[1]
        leaf.feature, leaf.cut, leaf.low, leaf.high = name, cut, Node(low), Node(high)


def margin(start: float, model: list[Node]) -> Column:
    return reduce(lambda total, tree: total + tree.column(), model, F.lit(start))


def threshold(held: DataFrame) -> float:
    """The cut of `score` with most right verdicts on rows (label, score); ties: nearest 0.5."""
    sums = held.groupBy(F.floor(F.col("score") * STEPS).cast("int").alias("bin")).agg(
        F.count("*").alias("n"), F.sum("label").alias("blocked")
    ).collect()  # at most STEPS + 1 rows
    cuts = sorted(range(1, STEPS), key=lambda c: (abs(2 * c - STEPS), c))
    right = {c: sum(r.blocked if r.bin >= c else r.n - r.blocked for r in sums) for c in cuts}
    return max(cuts, key=right.__getitem__) / STEPS


def scored(pages: DataFrame, rules=RULES, **options) -> DataFrame:
    """(page_id, host, path, rule, told, label, held, score); score is 0.5 at the threshold.

    `held` rows with a label took no part in learning: held-out figures come from them.
    With no labelled URL to learn from every score is NULL.
    """
    rows, features = with_features(pages, rules)
    labelled = rows.where("label is not null and not held").groupBy(*features).agg(
        F.count("*").alias("n"), F.sum("label").alias("blocked")
    )
    start, model = boost(settle(labelled), features, **options)
    raw = rows.withColumn("_margin", margin(start, model))
    score = 1 / (1 + F.exp(-F.col("_margin")))
    cut = threshold(raw.where("label is not null and held").select("label", score.alias("score")))
    moved = 1 / (1 + F.exp(math.log(cut / (1 - cut)) - F.col("_margin")))
    return raw.select(
        "page_id", "host", "path", "rule", "told", "label", "held",
        F.when(F.lit(bool(model)), moved).alias("score"),
    )


def judge(pages: DataFrame, rules=RULES, **options) -> DataFrame:
    """(page_id, host, path, rule, verdict, score) for every row of `pages`.

    The verdict is the rule's where one fits, else block from a score of 0.5 on. A NULL
    URL or one without :// has empty host and path, and is scored like any other. With
    no labelled URL every score is 0.5 - too little to know - and the verdict is allow.
    Repeated rows are judged each on its own; other columns are not read.
    """
    by_model = F.when(F.col("score") >= 0.5, "block").otherwise("allow")
    return scored(pages, rules, **options).select(
        "page_id", "host", "path", "rule", F.coalesce("told", by_model).alias("verdict"),
        F.coalesce("score", F.lit(0.5)).alias("score"),
    )
