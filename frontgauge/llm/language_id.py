"""Language identification of web pages by fusing evidence the Bayesian way.

For each page the posterior over languages is the product of
  * the likelihood of its visible text under byte-trigram models, one per language,
    counted over all labelled documents;
  * the likelihood of the language that its markup declares, P(declared | language),
    counted over the pages, with the text's verdict standing in for the truth;
  * a prior of its host, smoothed in levels: all pages, the address suffix, the host.
    Each level is a grouped sum of text posteriors, drawn to the level above it.
"""

from __future__ import annotations

import re
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frontgauge.llm.common import settle, small_batches, small_lookup

PLACES = 1 << 14
# Trigrams of a text count as this many independent ones at most.
MOST_EVIDENCE = 60.0
# Pages that a level's prior weighs against the pages of its own.
SUFFIX_PRIOR, HOST_PRIOR, DECLARED_PRIOR = 50.0, 10.0, 5.0
# The models are one table per language in every task; more languages are refused.
MOST_LANGUAGES = 500

# Every pattern below reads a page once: runs are possessive, and searches go on where
# the last one ended.
_HIDDEN = re.compile(r"(?i)<(script|style|nav|noscript|template)\b")
_CLOSE = {n: re.compile(rf"(?i)</{n}\s*+>") for n in ("script", "style", "nav", "noscript", "template")}
_HTML = re.compile(r"(?i)<html\b[^>]*+")
_META = re.compile(r"(?i)<meta\b[^>]*+")
_LANG = re.compile(r"""(?i)\blang\s*+=\s*+["']?+\s*+([a-z]{2,3})\b""")
_NAMED = re.compile(r"""(?i)content-language["']""")
_CONTENT = re.compile(r"""(?i)content\s*+=\s*+["']?+\s*+([a-z]{2,3})\b""")


class _Next:
    """The next place from which something matches, found by a single pass over the page."""

    def __init__(self, find):
        self.find, self.span = find, (-1, -1)

    def after(self, at: int) -> int:
        """End of the first match that starts at `at` or later, -1 without one; `at` ascends."""
        if self.span[0] < at and self.span != (0, -1):
            self.span = self.find(at) or (0, -1)
        return self.span[1]


def _without_markup(html: str) -> str:
    """The page with a space for each hidden element, comment and tag."""

    def found(match):
        return match.span() if match else None

    def comment_end(at):
        i = html.find("-->", at)
        return None if i < 0 else (i, i + 3)

    closes = {n: _Next(lambda at, c=c: found(c.search(html, at))) for n, c in _CLOSE.items()}
    comments = _Next(comment_end)
    out, at = [], 0
    while (i := html.find("<", at)) >= 0:
        out.append(html[at:i])
        end, opened = -1, _HIDDEN.match(html, i)
        if opened:
            end = closes[opened[1].lower()].after(opened.end())
        if end < 0 and html.startswith("<!--", i):
            end = comments.after(i + 4)
        if end < 0:
            end = html.find(">", i) + 1
        if end <= 0:  # no tag ends any more
            at = i
            break
        out.append(" ")
        at = end
    return "".join(out) + html[at:]


def visible_text(html: str) -> str:
    return unescape(_without_markup(html))


def declared_language(html: str) -> str | None:
    for tag in _HTML.finditer(html):
        if found := _LANG.search(html, tag.start() + 5, tag.end()):
            return found[1].lower()
    for tag in _META.finditer(html):
        named = _NAMED.search(html, tag.start(), tag.end())
        if named and (found := _CONTENT.search(html, named.end(), tag.end())):
            return found[1].lower()
    return None


def trigrams(text: str) -> np.ndarray:
    """Hashed places of a text's lower-case byte trigrams, white space as one blank."""
    b = np.frombuffer(b" " + b" ".join(text.lower().encode("utf-8", "replace").split()) + b" ", np.uint8)
    b = b.astype(np.int64)
    code = (b[:-2] * 65_599 + b[1:-1]) * 65_599 + b[2:]
    return ((code * 0x9E3779B1) >> 15) & (PLACES - 1)


def count_models(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """(languages, log P(place | language)) from the whole texts of all documents.

    Every document weighs by its trigrams. Rows with NULL text or language are left out.
    A task sends at most PLACES rows per language it meets.
    """
    def count(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist()):
                own = sums.setdefault(lang, np.zeros(PLACES, dtype=np.int64))
                own += np.bincount(trigrams(text), minlength=PLACES)
        for lang, own in sums.items():
            met = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(met), pa.string()), pa.array(met), pa.array(own[met])],
                names=["lang", "place", "n"],
            )

    rows = settle(
        docs.select("text", "lang").where("text is not null and lang is not null")
        .mapInArrow(count, "lang string, place long, n long")
        .groupBy("lang", "place").agg(F.sum("n").alias("n"))
    )
    names = sorted(r[0] for r in rows.select("lang").distinct().limit(MOST_LANGUAGES + 1).collect())
    if len(names) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    table = np.zeros((len(names), PLACES))
    at = {name: i for i, name in enumerate(names)}
    for lang, place, n in rows.toLocalIterator():  # at most languages * PLACES rows
        table[at[lang], place] = n
    share = (table + 0.5) / (table.sum(axis=1, keepdims=True) + 0.5 * PLACES)
    return names, np.log(share)


def read_pages(pages: DataFrame, names: list[str], model: np.ndarray) -> DataFrame:
    """Settled (page_id, host, suffix, declared, loglik, text_lang) of every page."""
    shared = pages.sparkSession.sparkContext.broadcast(model)

    def read(pages_: pa.Array) -> pa.Array:
        said, liks = [], []
        for i in range(0, len(pages_), 256):
            for html in pages_.slice(i, 256).to_pylist():
                html = html or ""
                said.append(declared_language(html))
                t = trigrams(visible_text(html)) if html else np.zeros(0, dtype=np.int64)
                mean = shared.value[:, t].mean(axis=1) if len(t) else np.zeros(len(names))
                liks.append((mean * min(MOST_EVIDENCE, float(len(t)))).tolist())
        return pa.StructArray.from_arrays(
            [pa.array(said, pa.string()), pa.array(liks, pa.list_(pa.float64()))],
            names=["declared", "loglik"],
        )

    after = F.when(F.instr("url", "://") > 0, F.substr("url", F.instr("url", "://") + 3)).otherwise("")
    host = F.lower(F.regexp_extract(F.coalesce(after, F.lit("")), r"^([^/?#:]*)", 1))
    reader = F.arrow_udf(read, "declared string, loglik array<double>")
    return settle(
        pages.select("page_id", host.alias("host"), reader("html").alias("r")).select(
            "page_id",
            "host",
            F.substring_index("host", ".", -1).alias("suffix"),
            "r.declared",
            "r.loglik",
        )
    )


def _array(names: list[str], value) -> Column:
    return F.array(*[value(i).cast("double") for i in range(len(names))])


def posterior(log_scores: Column) -> Column:
    """An array of log scores as probabilities."""
    top = F.array_max(log_scores)
    grown = F.transform(log_scores, lambda x: F.exp(x - top))
    total = F.aggregate(grown, F.lit(0.0), lambda a, x: a + x)
    return F.transform(grown, lambda x: x / total)


def identify(pages: DataFrame, docs: DataFrame) -> DataFrame:
    """(page_id, host, suffix, declared, text_lang, lang, probability) of every page.

    Reads page_id, url and html of pages, and text and lang of docs. A page without html
    is judged by its host alone, one without a host by text and markup with the prior of
    the empty host; a declared language that no document has is no evidence. Equal
    probabilities go to the first language by code. Repeated rows are judged each on its
    own. Without labelled documents lang and probability are NULL.
    """
    small_batches(docs.sparkSession)
    names, model = count_models(docs)
    rows = read_pages(pages, names, model) if names else None
    if rows is None:
        none = read_pages(pages, [""], np.zeros((1, PLACES)))
        return none.select(
            "page_id", "host", "suffix", "declared", F.lit(None).cast("string").alias("text_lang"),
            F.lit(None).cast("string").alias("lang"), F.lit(None).cast("double").alias("probability"),
        )
    k = len(names)
    languages = F.array(*[F.lit(n) for n in names])
    scored = rows.withColumn("p", posterior(F.col("loglik")))
    sums = [F.sum(F.col("p")[i]).alias(f"s{i}") for i in range(k)]

    # all pages: one row
    whole = scored.agg(F.count("*"), *sums).first()
    n = whole[0] or 0
    overall = [((whole[i + 1] or 0.0) + 1.0) / (n + k) for i in range(k)]
    # the level of suffixes, drawn to all pages; then hosts, drawn to their suffix
    hosts = settle(scored.groupBy("suffix", "host").agg(F.count("*").alias("n"), *sums))
    suffixes = small_lookup(
        hosts.groupBy("suffix").agg(F.sum("n").alias("n"), *[F.sum(f"s{i}").alias(f"s{i}") for i in range(k)])
        .select(
            "suffix",
            _array(names, lambda i: (F.col(f"s{i}") + SUFFIX_PRIOR * overall[i]) / (F.col("n") + SUFFIX_PRIOR)).alias("above"),
        )
    )
    priors = small_lookup(
        hosts.join(suffixes, "suffix").select(
            "host",
            _array(names, lambda i: (F.col(f"s{i}") + HOST_PRIOR * F.col("above")[i]) / (F.col("n") + HOST_PRIOR)).alias("prior"),
        )
    )
    # P(declared | language): pages by declared language, drawn to an even spread over those met
    told = scored.where(F.col("declared").isin(names)).groupBy("declared").agg(*sums).collect()
    seen = {r[0]: np.array(r[1:], dtype=float) for r in told}  # at most k rows
    table = np.array([seen.get(name, np.zeros(k)) for name in names]) + DECLARED_PRIOR / k
    confusion = np.log(table / table.sum(axis=0, keepdims=True))
    by_declared = F.create_map(*[
        x for i, name in enumerate(names)
        for x in (F.lit(name), F.array(*[F.lit(float(v)) for v in confusion[i]]))
    ])
    nothing = F.array(*[F.lit(0.0)] * k)
    fused = scored.join(priors, "host").withColumn(
        "evidence", F.coalesce(F.try_element_at(by_declared, F.col("declared")), nothing)
    ).withColumn(
        "post",
        posterior(_array(names, lambda i: F.col("loglik")[i] + F.col("evidence")[i] + F.log(F.col("prior")[i]))),
    )
    best = F.array_position("post", F.array_max("post")).cast("int")
    text_best = F.array_position("p", F.array_max("p")).cast("int")
    return fused.select(
        "page_id",
        "host",
        "suffix",
        "declared",
        F.element_at(languages, text_best).alias("text_lang"),
        F.element_at(languages, best).alias("lang"),
        F.array_max("post").alias("probability"),
    )
