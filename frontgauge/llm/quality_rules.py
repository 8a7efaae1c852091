"""Quality rules whose cutoffs carry a guarantee on clean documents.

Every rule compares one share of a document with a cutoff. Cutoffs are not chosen by
hand. In each stratum (language) the labelled documents are parted by a hash of their
text: on the smaller part each rule's best cutoff is picked, on the larger one, which
had no say in that, the rules are tested together. All cutoffs move in LADDER steps from
"rejects nothing" to the picked ones. A step is certified when the exact binomial tail
shows, at the error level left after Bonferroni over the strata, that all rules together
reject at most `risk` of the stratum's clean documents; testing stops at the first step
that fails (a fixed sequence needs no further correction). The last certified step holds.
Where none is, or no rule parts junk from clean documents, the rules reject nothing in
that stratum.
"""

from __future__ import annotations

import math
from collections import Counter
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frontgauge.llm.common import settle, small_batches, small_lookup

MIN_WORDS = 50
MOST_REPEAT_PERCENT = 50
# Share of a stratum's clean documents that the rules together may reject, and the chance
# that the guarantee fails in any stratum.
RISK = 0.02
ERROR = 0.05
# Cutoffs lie at 1/STEPS, 2/STEPS ... of a rule's range.
STEPS = 100
# Steps from no rejection to the picked cutoffs.
LADDER = 8
# One labelled text in so many serves for picking, the others for certifying.
PICKED_OF = 4
# A clean document rejected counts as much as this many junk documents kept.
CLEAN_WEIGHT = 10

COUNTS = (
    "n_words",
    "word_chars",
    "n_symbols",
    "n_dup_lines",
    "n_repeat_words",
    "n_lines",
    "n_upper",
    "n_letters",
    "n_marks",
)
# name, numerator, denominator: a document is rejected from a cutoff of their quotient on
RULES = (
    ("symbols", "n_symbols", "word_chars"),
    ("dup_lines", "n_dup_lines", "n_lines"),
    ("repeats", "n_repeat_words", "n_words"),
    ("upper", "n_upper", "n_letters"),
    ("marks", "n_marks", "word_chars"),
)

_SYMBOLS = np.frombuffer(b"#*$%&|<>", dtype=np.uint8)
_MARKS = np.frombuffer(b"!?:;=~^_+/\\", dtype=np.uint8)
_SPACE = np.frombuffer(b"\x20\x09\x0a\x0b\x0c\x0d", dtype=np.uint8)


def repeated_words(words: list[bytes]) -> int:
    """Words in some three-word window that the text holds at least twice."""
    if len(words) < 4:
        return 0
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    seen = Counter(windows)
    often = np.fromiter((seen[w] > 1 for w in windows), dtype=bool, count=len(windows))
    covered = np.zeros(len(words), dtype=bool)
    for k in range(3):
        covered[k : k + len(often)] |= often
    return int(covered.sum())


def counts_of(data: bytes) -> tuple[int, ...]:
    """COUNTS of one text, given as UTF-8."""
    words = data.split()
    per_byte = np.bincount(np.frombuffer(data, dtype=np.uint8), minlength=256)
    points = len(data) - int(per_byte[0x80:0xC0].sum())
    lines = [line for line in data.split(b"\n") if line and not line.isspace()]
    upper = int(per_byte[65:91].sum())
    return (
        len(words),
        points - int(per_byte[_SPACE].sum()),
        int(per_byte[_SYMBOLS].sum()),
        len(lines) - len(set(lines)),
        repeated_words(words),
        len(lines),
        upper,
        upper + int(per_byte[97:123].sum()),
        int(per_byte[_MARKS].sum()),
    )


def _measure(texts: pa.Array) -> pa.Array:
    rows = []
    for i in range(0, len(texts), 256):
        for data in texts.slice(i, 256).cast(pa.binary()).to_pylist():
            rows.append(counts_of(data or b""))
    table = np.array(rows, dtype=np.int64).reshape(len(rows), len(COUNTS))
    return pa.StructArray.from_arrays(
        [pa.array(table[:, i]) for i in range(len(COUNTS))], names=list(COUNTS)
    )


def measure(text: Column) -> Column:
    """A struct of COUNTS over the whole text; NULL and empty texts count 0 throughout."""
    kernel = F.arrow_udf(_measure, ", ".join(f"{c} long" for c in COUNTS))
    return kernel(text)


def base_failed(n_words: Column, n_repeat_words: Column) -> Column:
    return (n_words < MIN_WORDS) | (100 * n_repeat_words > MOST_REPEAT_PERCENT * n_words)


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X <= k) for X ~ Binomial(n, p)."""
    if n == 0:
        return 1.0
    logs = [
        math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1)
        + i * math.log(p) + (n - i) * math.log1p(-p)
        for i in range(k + 1)
    ]
    top = max(logs)
    return min(1.0, math.exp(top) * math.fsum(math.exp(x - top) for x in logs))


def choose_cutoff(clean: np.ndarray, junk: np.ndarray, risk: float, level: float) -> int | None:
    """The cutoff (1 .. STEPS) from the label counts per bin 0 .. STEPS; None: no cutoff.

    Of equally good cutoffs the middle one, farthest from either kind, is taken.
    """
    n, best, ties = int(clean.sum()), 0, []
    for cutoff in range(STEPS, 0, -1):
        wrong = int(clean[cutoff:].sum())
        if wrong > risk * n or binomial_tail(wrong, n, risk) > level:
            break
        gain = int(junk[cutoff:].sum()) - CLEAN_WEIGHT * wrong
        if gain > best:
            best, ties = gain, [cutoff]
        elif gain == best and best:
            ties.append(cutoff)
    return ties[len(ties) // 2] if ties else None


def certified_step(wrong: list[int], n: int, risk: float, level: float) -> int:
    """The last step before the first that fails; 0: none holds.

    `wrong[j - 1]` of the `n` clean documents are rejected at step j, which never falls.
    """
    for step, k in enumerate(wrong, 1):
        if binomial_tail(int(k), int(n), risk) > level:
            return step - 1
    return len(wrong)


def _at_step(picked: Column, step: int | Column) -> Column:
    """A rule's cutoff at a step of the ladder: STEPS + 1, beyond any bin, falls to `picked`."""
    return picked + F.ceil((STEPS + 1 - picked) * (LADDER - step) / F.lit(float(LADDER))).cast("int")


def _bin(numerator: str, denominator: str, prefix: str) -> Column:
    share = F.col(prefix + numerator) / F.greatest(F.col(prefix + denominator), F.lit(1))
    return F.least(F.floor(share * STEPS), F.lit(STEPS)).cast("int")


def fit(
    measured: DataFrame, labels: DataFrame, risk: float = RISK, error: float = ERROR,
    id_col: str = "doc_id", stratum_col: str = "lang", text_key: str = "text_key",
    prefix: str = "",
) -> DataFrame:
    """(stratum, and a cutoff per rule) from all labelled documents.

    `measured` holds COUNTS under `prefix`, the id, the stratum and `text_key`, a hash of
    the text: copies of a text count once, as they are no independent draws. A NULL
    stratum is a stratum of its own. Ids with labels that disagree, or NULL labels, are
    left out. No labels give no rows, so nothing is rejected by these rules.
    """
    told = (
        labels.select(F.col("doc_id").alias("_id"), F.col("quality").alias("_good"))
        .where("_id is not null and _good is not null")
        .groupBy("_id")
        .agg(F.min("_good").alias("_good"), F.max("_good").alias("_top"))
        .where("_good = _top")
        .drop("_top")
    )
    names = [name for name, _, _ in RULES]
    rows = (
        measured.where(~base_failed(F.col(prefix + "n_words"), F.col(prefix + "n_repeat_words")))
        .select(
            F.col(id_col).alias("_id"),
            F.col(stratum_col).alias("stratum"),
            F.col(text_key).alias("_key"),
            *[_bin(a, b, prefix).alias(name) for name, a, b in RULES],
        )
        .join(told, "_id")
        .dropDuplicates(["stratum", "_key", "_good"])
        .withColumn("_picks", F.pmod("_key", F.lit(PICKED_OF)) == 0)
        .drop("_id", "_key")
    )
    rows = settle(rows)
    kind = rows.schema["stratum"].dataType.simpleString()
    level = error / max(1, rows.select(F.struct("stratum")).distinct().count())
    bins = F.explode(F.array(*[
        F.struct(F.lit(i).alias("rule"), F.col(name).alias("bin")) for i, name in enumerate(names)
    ]))
    shape = (
        rows.where("_picks").select("stratum", "_good", bins.alias("_b"))
        .groupBy("stratum", F.col("_b.rule").alias("rule"), F.col("_b.bin").alias("bin"))
        .agg(F.sum("_good").alias("clean"), F.sum(1 - F.col("_good")).alias("junk"))
    )

    def pick(own: pd.DataFrame) -> pd.DataFrame:
        out = {"stratum": [own["stratum"].iloc[0]]}
        for i, name in enumerate(names):
            part = own[own["rule"] == i]
            clean, junk = np.zeros(STEPS + 1), np.zeros(STEPS + 1)
            clean[part["bin"]] = part["clean"]
            junk[part["bin"]] = part["junk"]
            out[name] = [choose_cutoff(clean, junk, risk, 1.0)]
        return pd.DataFrame(out).astype({name: "Int32" for name in names})

    # at most len(RULES) * (STEPS + 1) rows a stratum
    schema = f"stratum {kind}, " + ", ".join(f"{name} int" for name in names)
    picked = small_lookup(
        shape.groupBy("stratum").applyInPandas(pick, schema)
        .select(F.col("stratum").alias("_of"), *[F.col(name).alias(f"_at_{name}") for name in names])
    )

    def rejected(step: int) -> Column:
        over = [F.col(name) >= _at_step(F.col(f"_at_{name}"), step) for name in names]
        return reduce(lambda a, b: a | b, [F.coalesce(o, F.lit(False)) for o in over])

    first = F.coalesce(*[F.when(rejected(j), j) for j in range(1, LADDER + 1)], F.lit(LADDER + 1))
    on = F.col("stratum").eqNullSafe(F.col("_of"))
    steps = (
        rows.where("not _picks and _good = 1").join(picked, on)
        .groupBy("stratum", first.alias("step")).agg(F.count("*").alias("n"))
    )

    def certify(own: pd.DataFrame) -> pd.DataFrame:
        by_step = np.zeros(LADDER + 2, dtype=np.int64)
        by_step[own["step"]] = own["n"]
        wrong = np.cumsum(by_step[1 : LADDER + 1])
        step = certified_step(list(wrong), int(by_step.sum()), risk, level)
        return pd.DataFrame({"stratum": [own["stratum"].iloc[0]], "step": [step]})

    # at most LADDER + 1 rows a stratum
    certified = steps.groupBy("stratum").applyInPandas(certify, f"stratum {kind}, step int").where("step > 0")
    return certified.join(picked, on).select(
        "stratum", *[_at_step(F.col(f"_at_{name}"), F.col("step")).alias(name) for name in names]
    )


def verdict(
    measured: DataFrame, cutoffs: DataFrame, stratum_col: str = "lang", prefix: str = ""
) -> DataFrame:
    """`measured` with `_kept`: false if the base rules or a rule at its certified cutoff reject."""
    named = small_lookup(
        cutoffs.select(
            F.col("stratum").alias("_stratum"),
            *[F.col(n).alias(f"_cut_{n}") for n, _, _ in RULES],
        )
    )
    rejected = base_failed(F.col(prefix + "n_words"), F.col(prefix + "n_repeat_words"))
    for name, a, b in RULES:
        over = _bin(a, b, prefix) >= F.col(f"_cut_{name}")
        rejected = rejected | F.coalesce(over, F.lit(False))
    return (
        measured.join(named, measured[stratum_col].eqNullSafe(named["_stratum"]), "left")
        .withColumn("_kept", ~rejected)
        .drop("_stratum", *[f"_cut_{n}" for n, _, _ in RULES])
    )


def judge(docs: DataFrame, labels: DataFrame, risk: float = RISK, error: float = ERROR) -> DataFrame:
    """(doc_id, n_words, ..., base_failed, kept) for every row of `docs`.

    Reads doc_id, text and lang; other columns are not read. Repeated rows are judged
    each on its own. NULL and empty texts have no words and fail the base rules.
    """
    small_batches(docs.sparkSession)
    measured = settle(
        docs.select("doc_id", "lang", "text")
        .withColumn("_m", measure(F.col("text")))
        .select("doc_id", "lang", F.xxhash64("text").alias("text_key"), "_m.*")
    )
    cutoffs = fit(measured, labels, risk, error)
    return verdict(measured, cutoffs).select(
        "doc_id",
        *COUNTS[:5],
        base_failed(F.col("n_words"), F.col("n_repeat_words")).alias("base_failed"),
        F.col("_kept").alias("kept"),
    )


def keep(docs: DataFrame, labels: DataFrame, risk: float = RISK, error: float = ERROR) -> DataFrame:
    """The rows of `docs` that the rules keep, with all their columns.

    Texts are measured twice, once for the cutoffs and once for the verdict, rather than
    shuffled or written in between.
    """
    small_batches(docs.sparkSession)
    measured = settle(
        docs.select("doc_id", "lang", "text")
        .withColumn("_m", measure(F.col("text")))
        .select("doc_id", "lang", F.xxhash64("text").alias("text_key"), "_m.*")
    )
    cutoffs = fit(measured, labels, risk, error)
    prefix = "_rule"
    while any(c.startswith(prefix) for c in docs.columns):
        prefix += "_"
    wide = docs.withColumn(prefix, measure(F.col("text"))).select(
        *docs.columns, *[F.col(f"{prefix}.{c}").alias(prefix + c) for c in COUNTS]
    )
    return verdict(wide, cutoffs, prefix=prefix).where("_kept").select(*docs.columns)
