"""Every operator on odd input: NULLs, empty and long texts, ties, copies, no rows, extra columns."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from frontgauge.llm import (
    language_id, mixing, near_dedup, packing, quality_classifier, quality_rules, sharding, toxicity,
    url_filter, vector_join,
)

LONG = " ".join(f"word{i % 997}x{i}" for i in range(30_000))
WORDS = "the cat sat on a mat and looked at birds outside while rain fell over town all day"
CLASHES = ("score", "kept", "size", "k1", "node", "n", "row", "slot", "n_words", "place", "_row", "_m", "stratum",
           "bucket", "tokens", "label", "component", "shard", "target", "url_", "p")


@pytest.fixture(scope="module")
def docs(spark):
    rows = [
        (0, WORDS * 4, "en", "s1"), (1, WORDS * 4, "en", "s1"), (2, None, None, None), (3, "", "en", None),
        (4, LONG, "en", "s2"), (None, "no id here " * 30, "fr", "s2"), (6, " \n\t ", "de", "s0"),
        (7, "short", None, "s0"), (7, "short", None, "s0"), (8, "ééé ß ü " * 60, "fr", "s3"),
        (9, "a a a a a a a a", "en", "s3"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    df = df.withColumn("n_chars", F.length("text").cast("long"))
    return df.withColumns({c: F.lit(1) for c in CLASHES if c not in df.columns})


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(0, 1, 0), (1, 1, 0), (4, 1, 0), (8, 0, 1), (9, 0, 1), (9, 1, 1), (None, 1, 1), (6, None, None)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")



OPERATORS = {
    "score": lambda d, l: quality_classifier.score(d, l, F.lit(True)),
    "shard": lambda d, l: sharding.shard(d),
    "mix": lambda d, l: mixing.taken(d),
    "classes": lambda d, l: near_dedup.classes(d),
    "rules": lambda d, l: quality_rules.judge(d, l),
    "toxic": lambda d, l: toxicity.score(d, l, F.lit(True)),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_one_row_per_document(name, docs, labels):
    got = OPERATORS[name](docs, labels).collect()
    assert sorted(map(str, (r.doc_id for r in got))) == sorted(map(str, (r.doc_id for r in docs.collect())))


@pytest.mark.parametrize("name", OPERATORS)
def test_no_documents(name, docs, labels):
    assert OPERATORS[name](docs.limit(0), labels).count() == 0


@pytest.mark.parametrize("name", ["score", "rules", "toxic"])
def test_no_labels(name, docs, labels):
    got = OPERATORS[name](docs, labels.limit(0)).collect()
    assert len(got) == docs.count()
    if name != "rules":
        assert {r.score for r in got} == {0.5}


def test_pieces_cover_every_id(docs):
    rows = packing.pack(docs).collect()
    by_doc = {}
    for r in rows:
        by_doc.setdefault((r.doc_id, r.doc_tokens), []).append((r.start, r.length))
    assert sum(r.length for r in rows if r.doc_id == 2) == 1
    for (_, tokens), pieces in by_doc.items():
        assert sum(n for _, n in pieces) % tokens == 0
    assert packing.pack(docs.limit(0)).count() == 0


def test_pages(spark, docs):
    rows = [(1, None, None), (2, "", ""), (3, "http://A.Example.ORG/es/x?y=1#z", "<html lang=FR><body>le la de"),
            (4, "no scheme", "<p>" + LONG), (None, "http://org/", "x"), (3, "http://A.Example.ORG/es/x?y=1#z", "z")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    pages = pages.withColumns({c: F.lit(1) for c in ("host", "path", "score", "rule", "lang", "n", "label", "p")})
    got = url_filter.judge(pages).collect()
    assert len(got) == 6
    third = next(r for r in got if r.page_id == 3)
    assert (third.host, third.path, third.rule, third.verdict) == ("a.example.org", "/es/x", "example.org/es/", "block")
    assert all((r.host, r.path) == ("", "") for r in got if r.page_id in (1, 2, 4))
    told = language_id.identify(pages, docs).collect()
    assert len(told) == 6 and all(r.lang is not None for r in told)
    assert url_filter.judge(pages.limit(0)).count() == 0
    assert language_id.identify(pages.limit(0), docs).count() == 0
    assert {r.lang for r in language_id.identify(pages, docs.limit(0)).collect()} == {None}


def test_vectors(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [2.0, 0.1]), (3, None), (4, []), (5, [0.0, 0.0]),
            (6, [1.0, None]), (7, [nan, 1.0]), (8, [inf, 1.0]), (None, [1.0, 0.0]), (9, [1.0, 0.0, 0.0]), (10, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("node", F.lit(1))
    got = sorted((r.vec_id is None, r.vec_id or 0, r.n_links, r.component_id, r.kept) for r in vector_join.join(df).collect())
    assert got[:4] == [(False, 0, 3, 0, True), (False, 1, 3, 0, False), (False, 1, 3, 0, False), (False, 2, 3, 0, False)]
    assert all(g[2:] == (0, g[1], True) for g in got[4:-1])
    assert got[-1][2:] == (0, None, False)
    assert vector_join.join(df.limit(0)).count() == 0


def test_filters_keep_columns_and_rows(docs, labels):
    kept = quality_rules.keep(docs, labels)
    assert kept.columns == docs.columns
    judged = [str(r.doc_id) for r in quality_rules.judge(docs, labels).collect() if r.kept]
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(judged) and judged
    scored = quality_classifier.keep(docs, labels, F.lit(True), 0.0)
    assert scored.columns == docs.columns and scored.count() == docs.count()
    one = near_dedup.dedup(docs)
    assert one.columns == docs.columns
    ids = sorted(str(r.doc_id) for r in one.collect())
    assert ids == sorted(["0", "2", "3", "4", "None", "6", "7", "8", "9"])
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    assert {r.doc_id for r in mixed.collect()} <= {r.doc_id for r in docs.collect()}


def test_stages_are_the_dealt_ones():
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "quality_rules", "quality_classifier", "near_dedup", "source_mixing", "curve_packing"
    ]
