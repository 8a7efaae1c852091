"""Whole texts, whole samples: cases in which a part of the input used to be left out."""

import numpy as np
from pyspark.sql import functions as F

from frontgauge.llm import mixing, quality_classifier, toxicity


def test_weights_do_not_depend_on_read_partitions(spark):
    """Eight shards, read back as one partition, two (as on two cores) and eight."""
    ids = spark.range(9_000).withColumnRenamed("id", "doc_id")
    docs = ids.withColumn(
        "text", F.concat(F.when(F.col("doc_id") % 3 == 0, "junk line ").otherwise("plain prose "), F.col("doc_id") % 50)
    )
    labels = ids.withColumn("quality", (F.col("doc_id") % 3 != 0).cast("int"))
    key, got = "spark.sql.files.minPartitionNum", []
    try:
        for parts in (1, 2, 8):
            spark.conf.set(key, str(parts))
            got.append(quality_classifier.train(docs, labels, F.lit(True), sample=10**6, steps=1))
    finally:
        spark.conf.unset(key)
    assert np.abs(got[2]).max() > 0
    assert np.allclose(got[0], got[2], rtol=1e-9) and np.allclose(got[1], got[2], rtol=1e-9)


def test_shapes_read_whole_words():
    lead = "x" * 64
    shapes = {quality_classifier._word((lead + tail).encode()) & 0xFFFFFFFF for tail in ("", "-", "-0", "-0-A")}
    assert len(shapes) == 4


def prose_decoder():
    prose = "the cat sat on a mat and an idiot looked at it while rain fell over town all day so stupid "
    return toxicity.Decoder(toxicity.log_model(toxicity.trigram_counts([prose.encode() * 200])))


def test_long_runs_are_decoded_to_their_end():
    decoder, lead = prose_decoder(), "the cat sat on a mat and rain town all day while".split() * 6
    plain = "".join(lead)
    assert len(plain) > 200
    for mark in (" ", ".", "-", "_"):
        assert "idiot" in decoder.words(mark.join(plain + "idiot")), mark
    for n in range(len(lead)):  # no place in the run is a cut
        assert "idiot" in decoder.words(" ".join("".join(lead[:n]) + "idiot")), n
    assert decoder.decode(" ".join("x" * 50_000)).startswith("x")


def test_small_disguises_reach_the_decoder():
    decoder = prose_decoder()
    for text in ("an iddiot here", "i  d  i  o  t", "i d  i\t\to t", "so\ni \n d i\t o  t"):
        assert "idiot" in decoder.words(text), text
    assert "stupid" in decoder.words("so stuupid!")
    assert {"all", "looked"} <= decoder.words("all looked")  # the plain word stays beside the restored one
    # a wider gap still parts words
    assert {"idiot", "stupid"} <= decoder.words("i d i o t   s t u p i d")
    weights = {"idiot": 5.0}
    for text in ("an iddiot here", "i  d  i  o  t"):
        assert toxicity.hits(decoder, {}, weights, text) == {(5.0, "idiot")}, text
    both = {"iddiot": 4.0, "idiot": 5.0}
    assert toxicity.hits(decoder, {}, both, "iddiot!") == {(4.0, "iddiot")}  # one word, counted once


def test_mixed_documents_reach_their_goals_to_the_word(spark):
    """One very long document is all of source b; its goal is below half of it."""
    long = "\n\n lead " + "  ".join(f"w{i}" for i in range(9_999))
    rows = [(i, f"some words of document {i} ", "a", 0) for i in range(40)] + [(99, long, "b", len(long))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars int")
    options = {"share": 0.04, "weights": (1.0, 2.0), "block": 64}
    out = mixing.mixed_documents(docs, **options)
    assert out.schema == docs.schema
    got = out.collect()
    goals = {r.source: r.target for r in mixing.mix(docs, **options).select("source", "target").distinct().collect()}
    assert 0 < goals["b"] < 5_000
    for source, goal in goals.items():
        assert sum(len(r.text.split()) for r in got if r.source == source) == round(goal)
    cut = [r for r in got if r.source == "b"]
    assert len(cut) == 1 and long.startswith(cut[0].text) and cut[0].n_chars == len(cut[0].text)
