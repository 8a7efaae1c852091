"""Passage removal, ranked search and token alignment against brute force and hand cases."""

import hashlib
import math
import re
from collections import Counter, defaultdict
from functools import lru_cache

import numpy as np
import pytest
from pyspark.sql import functions as F

from frontgauge.llm import lexical_search, substring_dedup, token_alignment

DATA = "/root/testdata/sf0.001"


@lru_cache(maxsize=1)
def _given(spark):
    return [tuple(r) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]


def odd_rows():
    passage = " ".join(f"p{i}" for i in range(40))
    return [
        (10, f"start {passage} end"), (11, f"other {passage}"), (12, f"{passage} x {passage}"),
        (None, passage), (13, None), (14, ""), (15, " \n\t "), (16, passage), (16, passage),
        (17, "w " * 300), (18, "w " * 15), (19, "w " * 12), (20, passage.replace(" ", "\n ")),
        (20, "another text under the id that the row before has"), (21, "p5 p6 p7 " * 9),
        (22, " ".join(f"p{i}" for i in range(12))), (23, " ".join(f"p{i}" for i in range(13))),
        (24, "naïve café ▁ mark <s> </s> <unk> <|endoftext|> <0x41> done"),
        (25, "two  blanks\n\nand tabs\t\there "), (26, " lead"), (27, "日本語のテキスト🙂🙂 été"),
        (28, "x" * 5000 + " " + "ab" * 3000), (29, "It's 12345 items, isn't it? Über-cool!!"),
    ]


def frame(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    clashes = ("anchor", "window", "seeds", "windows", "_first", "n", "row", "terms", "pair", "kept", "shard", "rank")
    return df.withColumns({c: F.lit(1) for c in clashes})


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def stripped(rows, least):
    first = {}
    for i, text in rows:
        if i is None:
            continue
        w = words_of(text)
        for k in range(len(w) - least + 1):
            key = tuple(w[k : k + least])
            first[key] = min(i, first.get(key, i))
    out = []
    for i, text in rows:
        w = words_of(text)
        gone = [False] * len(w)
        if i is not None:
            for k in range(len(w) - least + 1):
                if first[tuple(w[k : k + least])] < i:
                    gone[k : k + least] = [True] * least
        out.append((i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    return sorted(out, key=str)


@pytest.mark.parametrize("least, seed", [(13, 5), (4, 2), (2, 1), (6, 6)])
def test_removed_passages(spark, least, seed):
    rows = odd_rows() + _given(spark)
    got = substring_dedup.strip(frame(spark, rows), least, seed).collect()
    assert sorted([(r.doc_id, r.n_words, r.n_removed, r.kept) for r in got], key=str) == stripped(rows, least)
    for r in got:
        assert sum(s.length for s in r.spans) == r.n_removed
        assert all(a.start + a.length < b.start for a, b in zip(r.spans, r.spans[1:]))  # maximal


def test_a_very_common_passage(spark):
    line = " ".join(f"c{i}" for i in range(20))
    rows = [(i, f"a{i} b{i} {line} d{i}" if i % 3 else f"u{i} v{i}") for i in range(400)]
    got = substring_dedup.strip(frame(spark, rows)).where("n_removed > 0")
    assert got.agg(F.count("*"), F.sum("n_removed"), F.min("doc_id")).first() == (265, 265 * 20, 2)


def test_anchors_are_few_and_shared():
    rng = np.random.default_rng(1)
    words = rng.integers(0, 1 << 62, 20_000).astype(np.uint64)
    anchors = substring_dedup.window_anchors(words, 13, 5)
    assert len(np.unique(anchors)) < 0.25 * len(words)
    other = np.concatenate([words[::-1][:500], words[700:713], words[:40]])
    assert set(anchors[700:701]) <= set(substring_dedup.window_anchors(other, 13, 5))


def ranked(rows, queries, best=10):
    def terms(t):
        folded = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", folded)

    held = [(i, terms(t)) for i, t in rows]
    n_docs, n_all = sum(bool(w) for _, w in held), sum(len(w) for _, w in held)
    df = Counter(t for _, w in held for t in set(w))
    out = []
    for item, text in queries:
        scores = []
        for i, w in held:
            tf, total = Counter(w), 0
            for t in set(terms(text)):
                if tf[t]:
                    weight = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    m = 10 + 90 * len(w) * n_docs // n_all
                    total += weight * (1_000_000_000 * tf[t] // (1000 * tf[t] + 8 * m))
            if total > 0:
                scores.append((-total, i is None, i or 0, i))
        for rank, (s, _, _, i) in enumerate(sorted(scores, key=lambda x: x[:3])[:best], 1):
            out.append((item, rank, i, -s))
    return sorted(out, key=str)


def query_rows(spark):
    given = [tuple(r) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").select("item_id", "text").collect()]
    return given + [(900, None), (901, ""), (902, "W w w P5 p6"), (903, "nowhere-to-be-found zzzzqq"),
                    (904, "café naïve 日本語のテキスト"), (None, "p7 p8"), (902, "W w w P5 p6")]


@pytest.mark.parametrize("shard_docs, width, query_terms", [(65_536, 4_096, 200_000), (16, 4, 40), (50, 7, 200_000)])
def test_ranked_search(spark, shard_docs, width, query_terms):
    rows, queries = odd_rows() + _given(spark), query_rows(spark)
    asked = spark.createDataFrame(queries, "item_id long, text string").withColumn("query", F.lit(1))
    got = lexical_search.search(
        frame(spark, rows), asked, shard_docs=shard_docs, width=width, query_terms=query_terms
    ).collect()
    assert sorted([tuple(r) for r in got], key=str) == ranked(rows, queries)


def test_blocks_come_back():
    rng = np.random.default_rng(2)
    for high in (200, 60_000, 3_000_000):
        docs = np.unique(rng.integers(0, high, 128))
        impact = rng.integers(0, 1_000_000, len(docs))
        got = lexical_search.decompress(lexical_search.compress(docs, impact))
        assert (got[0] == docs).all() and (got[1] == impact).all()


def test_rejected_blocks_stay_closed():
    """A frequent term's blocks are opened only where a candidate may still rank."""
    n, block = 40_000, lexical_search.BLOCK
    rng = np.random.default_rng(3)

    def listed(docs, impact):
        cut = [slice(i, i + block) for i in range(0, len(docs), block)]
        return lexical_search.Postings(
            np.array([docs[c][-1] for c in cut]), np.array([impact[c].max() for c in cut]),
            [lexical_search.compress(docs[c], impact[c]) for c in cut],
        )

    common, rare = np.arange(n), np.unique(rng.integers(0, n, 300))
    common_impact = rng.integers(1, 100_000, n)
    rare_impact = rng.integers(800_000, 900_000, len(rare))
    lists = [(10, listed(common, common_impact)), (5_000, listed(rare, rare_impact))]
    got = lexical_search.search_shard(lists, n, width=1_000)
    score = 10 * common_impact
    score[rare] += 5_000 * rare_impact
    best = np.lexsort((common, -score))[:10]
    assert got == [(int(score[i]), int(i)) for i in best]
    assert len(lists[0][1].open) < 0.3 * len(lists[0][1].blocks)


@pytest.fixture(scope="module")
def encoders():
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    return a, b


def byte_of():
    """The byte that a character of a byte-level vocabulary stands for."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def aligned(rows, encoders):
    a_coder, b_coder = encoders
    chars = byte_of()
    groups_of, pairs_of = [], []
    for _, text in rows:
        groups = []
        if text:
            a = a_coder.encode(" " + text, add_special_tokens=False).ids
            b = b_coder.encode(text)
            a_bytes = [bytes(chars[c] for c in a_coder.id_to_token(i)) for i in a]
            b_bytes = [
                bytes([int(b_coder.id_to_piece(i)[3:-1], 16)]) if b_coder.is_byte(i)
                else b_coder.id_to_piece(i).replace("▁", " ").encode()
                for i in b
            ]
            if b"".join(a_bytes) == b"".join(b_bytes) == (" " + text).encode():
                ends_a = np.cumsum([len(x) for x in a_bytes]).tolist()
                ends_b = np.cumsum([len(x) for x in b_bytes]).tolist()
                low_a = low_b = 0
                for cut in sorted(set(ends_a) & set(ends_b)):
                    high_a, high_b = ends_a.index(cut) + 1, ends_b.index(cut) + 1
                    groups.append((a[low_a:high_a], b[low_b:high_b]))
                    low_a, low_b = high_a, high_b
        groups_of.append(groups)
        pairs_of.append(Counter((x, y) for p, q in groups for x in p for y in q))
    count = Counter(k for pairs in pairs_of for k in pairs)
    top = defaultdict(int)
    for (x, _), n in count.items():
        top[x] = max(top[x], n)
    out = []
    for (i, _), groups, pairs in zip(rows, groups_of, pairs_of):
        text = ";".join(",".join(map(str, p)) + "|" + ",".join(map(str, q)) for p, q in groups)
        out.append((
            i, sum(len(p) for p, _ in groups), sum(len(q) for _, q in groups), len(groups), sum(pairs.values()),
            sum(n for k, n in pairs.items() if count[k] == top[k[0]]), sum(n * count[k] for k, n in pairs.items()),
            hashlib.sha256(text.encode()).hexdigest() if groups else "",
        ))
    return sorted(out, key=str)


@pytest.mark.parametrize("pair_rows", [token_alignment.PAIR_ROWS, 0])
def test_token_alignment(spark, encoders, pair_rows):
    rows = odd_rows() + _given(spark)
    got = token_alignment.align(frame(spark, rows), pair_rows=pair_rows).collect()
    assert sorted([tuple(r) for r in got], key=str) == aligned(rows, encoders)


def test_dense_groups_count_alike(monkeypatch, spark, encoders):
    two = token_alignment.TwoTokenizers()
    ids = [two(t) for _, t in odd_rows() if t and two(t)]
    whole = token_alignment.align_chunk(ids, two.size_a, two.size_b)
    monkeypatch.setattr(token_alignment, "DENSE_LINKS", 2)
    for x, y in zip(whole, token_alignment.align_chunk(ids, two.size_a, two.size_b)):
        assert x[:5] == y[:5] and (x[5] == y[5]).all() and (x[6] == y[6]).all()


@pytest.mark.parametrize("run", [
    lambda d, q: substring_dedup.strip(d), lambda d, q: lexical_search.search(d, q), lambda d, q: token_alignment.align(d),
])
def test_empty_tables(run, spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    queries = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert run(docs, queries).count() == 0
    nulls = spark.createDataFrame([(None, None), (1, None)], "doc_id long, text string")
    run(nulls, queries.limit(0)).collect()
