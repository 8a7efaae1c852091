"""Operators against plain Python on small fixtures, and held-out accuracy."""

import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from frontgauge.llm import (
    catalog, common, language_id, mixing, near_dedup, packing, quality_rules, sharding, toxicity, url_filter,
    vector_join,
)

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


# -- shared steps ---------------------------------------------------------------


def test_running_total_over_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(common, "BUCKET_ROWS", 7)
    df = spark.range(500).select(
        (F.col("id") % 10 == 0).cast("int").alias("g"), "id", (F.col("id") % 5).alias("s"),
        common.unit_hash("id").alias("u"),
    )
    got = common.running_total(df, ["g"], "u", ["id"], "s", 500, "before").collect()
    seen = Counter()
    for r in sorted(got, key=lambda r: (r.g, r.u, r.id)):
        assert r.before == seen[r.g]
        seen[r.g] += r.s


@pytest.mark.parametrize("local_edges", [10**6, 0])
def test_components(spark, local_edges):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(0, 60)] + [(rng.randrange(100, 200), rng.randrange(100, 200)) for _ in range(70)]
    got = dict(common.components(spark.createDataFrame(edges, "a long, b long"), local_edges).collect())
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    assert all(got.get(x, x) == find(x) for x in parent)
    assert all(got[a] == got[b] for a, b in edges if a != b)


# -- 2 language id, 9 toxicity, 1 classifier: accuracy ---------------------------


def test_languages(spark):
    got = catalog.op2_language_id(spark, SF).toPandas()
    urls = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url").toPandas()
    truth = urls.merge(got)
    said = truth["url"].str.extract(r"://[^/]*/(\w\w)")[0]
    assert (truth["lang"] == said).mean() > 0.97
    assert np.allclose(truth["probability"].clip(0, 1), truth["probability"])


def test_markup_and_host_decide_without_text(spark, documents):
    rows = [(i, "http://de.example.net/a", f"<html lang=de><p>{t}") for i, t in enumerate(["der die und ist nicht das"] * 20)]
    rows += [(100, "http://de.example.net/b", "<html><p>"), (101, "http://x.test/", '<html lang="fr"><p>')]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.lang for r in language_id.identify(pages, documents).collect()}
    assert got[100] == "de"


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.01"
    got = catalog.op1_quality_classifier(spark, sf).toPandas()
    told = spark.read.parquet(f"{sf}/labels.parquet").toPandas().merge(got)
    held = told[told["held_out"]]
    assert set(held["doc_id"] % 1) == {0}
    assert all(zlib.crc32(str(i).encode()) % 5 == 0 for i in held["doc_id"])
    assert (held["predicted"] == held["quality"]).mean() > 0.93
    assert held["score"].between(0, 1).all()


def test_toxic_held_out_and_disguises(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    plain = "the cat sat on a mat and then it was of the "
    rows = [(10**6 + i, plain * 5 + t) for i, t in enumerate(
        ["", "you idiot and loser", "you 1d10t and l0ser", "you i d i o t and l.o.s.e.r", "you iddiioot and looooser"])]
    extra = spark.createDataFrame(rows, "doc_id long, text string")
    both = docs.select("doc_id", "text").union(extra)
    got = {r.doc_id: r.score for r in toxicity.score(both, labels, common.fold_of(F.col("doc_id"), 3) != 1).collect()}
    clean, open_, leet, spaced, repeated = (got[10**6 + i] for i in range(5))
    assert clean < 0.3 < 0.7 < open_
    assert leet > 0.7 and spaced > 0.7 and repeated > 0.7
    told = {r.doc_id: r.toxic for r in labels.collect()}
    clean_ids = [i for i, t in told.items() if t == 0]
    assert sum(got[i] >= 0.7 for i in clean_ids) <= 0.01 * len(clean_ids)


def test_decoder_leaves_plain_text(spark, documents):
    model = toxicity.log_model(toxicity.count_trigrams(documents))
    decoder = toxicity.Decoder(model)
    assert decoder.restore("the an that of it") == "the an that of it"
    assert decoder.decode("th4t") == "that"
    counts = toxicity.count_trigrams(documents)
    assert counts.sum() == sum(len((r.text or "").encode()) for r in documents.collect())


# -- 3 near duplicates -----------------------------------------------------------


def jaccard(a, b):
    def bag(t):
        w = words(t)
        if not w:
            return Counter()
        k = min(5, len(w))
        return Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1))

    a, b = bag(a), bag(b)
    either = sum((a | b).values())
    return sum((a & b).values()) / either if either else 0.0


def near_fixture():
    rng = random.Random(1)
    vocabulary = [f"w{i}" for i in range(3000)]
    texts = []
    for _ in range(12):
        base = [rng.choice(vocabulary) for _ in range(rng.randrange(60, 300))]
        texts.append(base)
        for _ in range(8):
            copy = list(base)
            for _ in range(rng.randrange(0, 8)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            texts.append(copy)
    rows = [" ".join(t) for t in texts] + ["a b a b a b a b a b a b a b"] * 2 + ["one two", "one two", "one three", ""]
    rows += [rows[0], rows[5]]
    return list(enumerate(rows))


@pytest.mark.parametrize("limits", [{}, {"rounds": 0, "block_rows": 4}])
def test_near_classes(spark, limits):
    rows = near_fixture()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.class_id, r.kept) for r in near_dedup.classes(df, **limits).collect()}
    parent = {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in rows:
        for j, b in rows[:i]:
            if a == b or jaccard(a, b) >= 0.8:
                low, high = sorted((find(i), find(j)))
                parent[high] = low
    assert got == {i: (find(i), find(i) == i) for i, _ in rows}
    left = sorted(r.doc_id for r in near_dedup.dedup(df).collect())
    assert left == sorted(i for i, _ in rows if find(i) == i)


def test_signatures_estimate_weighted_jaccard():
    rng = np.random.default_rng(0)
    errors = []
    for _ in range(30):
        items = rng.integers(1, 2**62, 40, dtype=np.uint64)
        items.sort()
        a, b = rng.integers(1, 12, 40), rng.integers(1, 12, 40)
        true = np.minimum(a, b).sum() / np.maximum(a, b).sum()
        marks = near_dedup.signatures([(items, a), (items, b)])
        errors.append((marks[0] == marks[1]).mean() - true)
    assert abs(np.mean(errors)) < 0.02
    assert np.std(errors) < 0.06


def test_signatures_do_not_depend_on_the_batch():
    bags = [near_dedup.shingles(f"a b c d e f {i} g h".encode()) for i in range(5)] + [near_dedup.shingles(b"x")]
    together = near_dedup.signatures(bags)
    assert all((near_dedup.signatures([b]) == t).all() for b, t in zip(bags, together))


# -- 4 vectors ---------------------------------------------------------------------


@pytest.mark.parametrize("limits", [{}, {"cell_rows": 20, "block_rows": 16}])
def test_vector_links(spark, limits):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(8, 16))
    v = np.concatenate([c + 0.17 * rng.normal(size=(25, 16)) * np.linalg.norm(c) / 4 for c in centres])
    v = np.concatenate([v, v[:5], np.repeat(v[30][None], 40, axis=0)]).astype(np.float32)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<float>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in vector_join.join(df, **limits).collect()}
    d = v.astype(np.float64)
    u = d / np.linalg.norm(d, axis=1)[:, None]
    near = u @ u.T >= 0.9
    np.fill_diagonal(near, False)
    assert 0 < near.sum() < near.size
    for i in range(len(v)):
        seen, todo = {i}, [i]
        while todo:
            for j in np.flatnonzero(near[todo.pop()]):
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        assert got[i] == (near[i].sum(), min(seen))


# -- 5 mixing ------------------------------------------------------------------------


def test_mix_keeps_to_targets(spark, documents):
    got = mixing.taken(documents).toPandas()
    rows = documents.collect()
    sizes = defaultdict(int)
    for r in rows:
        sizes[r.source] += len(words(r.text))
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    want = mixing.targets([sizes[s] for s in names], [(3.0, 1.0, 2.0)[i % 3] for i in range(len(names))], 1.5, 2.0)
    assert math.isclose(sum(want), 1.5 * sum(sizes.values()))
    assert all(t <= 2 * sizes[s] + 1e-9 for s, t in zip(names, want))
    by_id = {r.doc_id: r for r in rows}
    got["source"] = [by_id[i].source for i in got["doc_id"]]
    assert all(n == len(words(by_id[i].text)) for i, n in zip(got["doc_id"], got["size"]))
    assert (got["taken"] <= 2 * got["size"]).all()
    for s, t in zip(names, want):
        own = got[got["source"] == s]
        assert abs(own["taken"].sum() - t) <= 1
        assert np.allclose(own["target"], t)


def test_mix_schedules_every_block_once(spark):
    rows = mixing.schedule(spark, [1000, 0, 300, 7], 10).collect()
    got = defaultdict(list)
    for r in rows:
        got[r.source_no].append(r.block_no)
    assert {s: sorted(b) for s, b in got.items()} == {0: list(range(100)), 2: list(range(30)), 3: [0]}
    assert len({r.slot for r in rows}) == len(rows)
    # every stretch of the schedule is close to the target mix
    first = [r.source_no for r in sorted(rows, key=lambda r: r.slot)[:40]]
    assert abs(first.count(0) / 40 - 1000 / 1307) < 0.06


# -- 6 packing -------------------------------------------------------------------------


def test_packing_round_trip(spark, documents):
    from tokenizers import Tokenizer
    import public_tokenizers

    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    extra = spark.createDataFrame(
        [(10**6, "two  blanks \n and\ttabs  "), (10**6 + 1, None), (10**6 + 2, ""), (10**6 + 3, " it's 3rd,\n\nok'll "),
         (10**6 + 4, "a  b 　c"), (10**6 + 5, "x " * 5000)], "doc_id long, text string")
    docs = documents.select("doc_id", "text").union(extra)
    ids = {r.doc_id: [*own.encode(r.text or "", add_special_tokens=False).ids, 0] for r in docs.collect()}
    rows = packing.pack(docs, bucket_tokens=5_000).collect()
    seen, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        piece = np.array(ids[r.doc_id][r.start : r.start + r.length], dtype="<u4")
        assert len(piece) == r.length and zlib.crc32(piece.tobytes()) == r.ids_crc32
        assert r.doc_tokens == len(ids[r.doc_id])
        seen[r.doc_id].append((r.start, r.length))
        sequences[r.sequence_id].append((r.offset, r.length))
    for doc, pieces in seen.items():
        at = 0
        for start, length in sorted(pieces):
            assert start == at
            at += length
        assert at == len(ids[doc])
    assert set(seen) == set(ids)
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at == 1024 or (at < 1024 and at & (at - 1) == 0)


def test_hilbert_neighbours_touch():
    levels = 3
    points = np.array([(x, y, z) for x in range(8) for y in range(8) for z in range(8)])
    order = points[np.argsort(packing.hilbert(points, levels))]
    assert sorted(packing.hilbert(points, levels)) == list(range(512))
    assert (np.abs(np.diff(order, axis=0)).sum(axis=1) == 1).all()


# -- 7 sharding ----------------------------------------------------------------------------


def test_ring(spark, documents):
    hot = documents.limit(1).select("text").crossJoin(spark.range(10**6, 10**6 + 150)).select("id", "text")
    docs = documents.select(F.col("doc_id").alias("id"), "text").union(hot).withColumnRenamed("id", "doc_id")
    got = sharding.shard(docs).collect()
    text = {r.doc_id: r.text or "" for r in docs.collect()}
    slots = defaultdict(list)
    for r in got:
        assert r.size == len(text[r.doc_id].encode()) + 1
        assert r.text_crc32 == zlib.crc32(text[r.doc_id].encode())
        slots[r.shard].append(r.slot)
    assert sorted(slots) == list(range(8))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    again = {r.doc_id: (r.shard, r.slot) for r in sharding.shard(docs.repartition(5)).collect()}
    assert again == {r.doc_id: (r.shard, r.slot) for r in got}


def test_ring_against_keys_walked_one_by_one(spark, documents, monkeypatch):
    """Every key walks clockwise to the first shard with room; one text is parted per cut at most."""
    monkeypatch.setattr(common, "BUCKET_ROWS", 50)
    hot = documents.limit(1).select(F.lit(-1).cast("long").alias("doc_id"), "text")
    hot = hot.withColumn("doc_id", F.explode(F.sequence(F.lit(10**6), F.lit(10**6 + 300))))
    docs = documents.select("doc_id", "text").unionByName(hot)
    got = {r.doc_id: r.shard for r in sharding.shard(docs, 5, 16).collect()}
    text = F.coalesce("text", F.lit(""))
    keys = docs.select(
        "doc_id", F.xxhash64(text).alias("h"), common.unit_hash("h").alias("u"), common.unit_hash("doc_id").alias("d"),
    ).collect()
    positions, owners = sharding.ring(5, 16)
    room = [len(keys) // 5 + (s < len(keys) % 5) for s in range(5)]
    arcs = defaultdict(list)
    parts = -(-len(keys) // 50)
    for r in sorted(keys, key=lambda r: (r.u, r.h, int(r.d * parts), r.doc_id)):
        at = r.h % sharding.RING
        arcs[next((i for i, p in enumerate(positions) if p >= at), 0)].append(r.doc_id)
    want, left = {}, dict(arcs)
    for step in range(5):
        for i in sorted(left):
            walk = list(dict.fromkeys(owners[i:] + owners[:i]))
            while left[i] and room[walk[step]]:
                want[left[i].pop(0)] = walk[step]
                room[walk[step]] -= 1
    assert got == want


def test_movement_is_bounded(spark, documents):
    one = sharding.movement(documents).first()
    rows = documents.count()
    assert one.n_rows == rows and one.to_new == rows // 9 + (rows % 9 > 8)
    a = {r.doc_id: r.shard for r in sharding.shard(documents).collect()}
    b = {r.doc_id: r.shard for r in sharding.shard(documents, 9).collect()}
    moved = [d for d in a if a[d] != b[d]]
    assert one.between_old == sum(b[d] != 8 for d in moved)
    assert one.between_old < 0.1 * rows  # 5 % of so few rows; 2.5 % of 10,000
    assert sharding.movement(documents.limit(0)).first() == (0, 0, 0)


def test_overflow_goes_clockwise_in_full():
    owners = [0, 1, 2, 0, 1, 2]
    dealt = sharding.place_counts([10, 0, 0, 2, 1, 2], owners, [5, 5, 5])
    assert [sum(n for _, n in d) for d in dealt] == [10, 0, 0, 2, 1, 2]
    assert dealt[0][0] == (0, 5)
    assert Counter({s: sum(n for d in dealt for t, n in d if t == s) for s in range(3)}) == {0: 5, 1: 5, 2: 5}


# -- 8 rules ----------------------------------------------------------------------------------


def test_rule_counts(spark, documents):
    rows = [r.text or "" for r in documents.collect()] + ["x y z x y z", "a\n a\na\na\n\n\n", "#$ | <é> &", "one two\n" * 30]
    for text in rows:
        w = words(text)
        windows = Counter(zip(w, w[1:], w[2:]))
        covered = set()
        for i, t in enumerate(zip(w, w[1:], w[2:])):
            if windows[t] > 1:
                covered |= {i, i + 1, i + 2}
        seen, again = set(), 0
        for line in text.split("\n"):
            if words(line):
                again += line in seen
                seen.add(line)
        got = quality_rules.counts_of(text.encode())
        assert got[:5] == (len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), again, len(covered))


def test_binomial_tail():
    for n, k, p in ((10, 0, 0.1), (30, 3, 0.2), (500, 4, 0.02)):
        want = sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
        assert math.isclose(quality_rules.binomial_tail(k, n, p), want, rel_tol=1e-9)


def test_cutoffs_hold_their_risk():
    clean, junk = np.zeros(101), np.zeros(101)
    clean[[0, 1, 2]] = [900, 90, 10]
    junk[[40, 50]] = [60, 40]
    cutoff = quality_rules.choose_cutoff(clean, junk, 0.02, 0.0025)
    assert 3 <= cutoff <= 40
    # too few clean documents to be sure of anything
    assert quality_rules.choose_cutoff(clean // 10, junk, 0.02, 0.0025) is None
    # clean and junk alike: nothing is worth rejecting
    assert quality_rules.choose_cutoff(clean, clean // 10, 0.02, 0.0025) is None


def test_certified_steps_hold_their_risk():
    # all rules together reject 3 % of clean documents from step 3 on: certifying that is the error
    rng, level, trials = np.random.default_rng(1), 0.05, 2000
    for n in (100, 400, 1000):
        wrong = rng.binomial(n, [0.0, 0.005, 0.0201, 0.03], size=(trials, 4))
        got = [quality_rules.certified_step(sorted(w), n, 0.02, level) for w in wrong]
        assert np.mean(np.array(got) >= 3) <= level + 0.02
    assert quality_rules.certified_step([0] * 8, 217, 0.02, 0.0125) == 8
    assert quality_rules.certified_step([0] * 8, 216, 0.02, 0.0125) == 0
    assert quality_rules.certified_step([0, 0, 9], 300, 0.02, 0.0125) == 2
    assert quality_rules.certified_step([0] * 8, 0, 0.02, 0.0125) == 0


def test_rules_keep_clean_and_drop_junk(spark):
    rng = random.Random(3)
    rows, labels = [], []
    for i in range(1200):
        w = [rng.choice("alpha beta gamma delta epsilon zeta eta theta".split()) + str(rng.randrange(500)) for _ in range(80)]
        junk = i % 6 == 0
        rows.append((i, " ".join(x + "###" if junk else x for x in w), "en" if i % 2 else None))
        labels.append((i, 0 if junk else 1))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    told = spark.createDataFrame(labels, "doc_id long, quality int")
    got = {r.doc_id: r.kept for r in quality_rules.judge(docs, told).collect()}
    assert all(got[i] == bool(q) for i, q in labels)
    assert {r.doc_id for r in quality_rules.keep(docs, told).collect()} == {i for i, q in labels if q}


# -- 10 addresses -----------------------------------------------------------------------------


def test_addresses(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r.page_id: r for r in url_filter.judge(pages).collect()}
    for r in pages.collect():
        rest = r.url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host):])[0]
        host = host.lower()
        fits = [
            (len(rule), rule, verdict) for rule, verdict in url_filter.RULES
            if (host == rule.split("/")[0] or host.endswith("." + rule.split("/")[0]))
            and path.startswith("/" + rule.split("/", 1)[1])
        ]
        want = max(fits) if fits else None
        mine = got[r.page_id]
        assert (mine.host, mine.path, mine.rule) == (host, path, want and want[1])
        assert mine.verdict == (want[2] if want else ("block" if mine.score >= 0.5 else "allow"))


def test_entropy(spark):
    texts = ["", "a", "aab", "http://x.y/z?q=1"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", url_filter.entropy(F.col("t")).alias("e"))
    for t, e in df.collect():
        n = len(t)
        assert math.isclose(e, -sum(c / n * math.log2(c / n) for c in Counter(t).values()), abs_tol=1e-9)


def test_trees_learn(spark):
    rows = [(x, y, 10, 10 if (x > 5) != (y > 3) else 0) for x in range(10) for y in range(8)]
    cells = spark.createDataFrame(rows, "x int, y int, n long, blocked long")
    start, model = url_filter.boost(cells, ["x", "y"], trees=6, depth=2, rate=0.5)
    got = cells.withColumn("m", url_filter.margin(start, model)).collect()
    assert all((r.m > 0) == (r.blocked > 0) for r in got)


def _plain_margins(rows, features, trees, depth, rate, ridge):
    """Margins by boosting over the rows one by one, splits by trying every cut."""
    n, blocked = sum(r["n"] for r in rows), sum(r["blocked"] for r in rows)
    margins = [math.log((blocked + 1) / (n - blocked + 1))] * len(rows)

    def grow(at, left):
        g = sum(rows[i]["n"] * p[i] - rows[i]["blocked"] for i in at)
        h = sum(rows[i]["n"] * p[i] * (1 - p[i]) for i in at)
        best = (1e-6, None)
        for name in features if left else ():
            values = sorted({rows[i][name] for i in at})
            for low, high in zip(values, values[1:]):
                one = [i for i in at if rows[i][name] <= low]
                a = sum(rows[i]["n"] * p[i] - rows[i]["blocked"] for i in one)
                b = sum(rows[i]["n"] * p[i] * (1 - p[i]) for i in one)
                gain = round(a * a / (b + ridge) + (g - a) ** 2 / (h - b + ridge) - g * g / (h + ridge), 6)
                if gain > best[0]:
                    best = (gain, (one, [i for i in at if rows[i][name] > low]))
        if best[1] is None:
            for i in at:
                margins[i] -= rate * g / (h + ridge)
        else:
            grow(best[1][0], left - 1)
            grow(best[1][1], left - 1)

    for _ in range(trees):
        p = [1 / (1 + math.exp(-m)) for m in margins]
        grow(list(range(len(rows))), depth)
    return margins


def test_trees_equal_plain_boosting(spark):
    rng = random.Random(5)
    rows = [
        {"x": x, "y": y, "z": rng.randrange(6), "n": (n := rng.randint(1, 9)), "blocked": rng.randint(0, n)}
        for x in (0, 1, 4, 9, 30) for y in (2, 3, 11)
    ]
    cells = spark.createDataFrame(
        [(i, r["x"], r["y"], r["z"], r["n"], r["blocked"]) for i, r in enumerate(rows)],
        "i int, x int, y int, z int, n long, blocked long",
    )
    start, model = url_filter.boost(cells, ["x", "y", "z"], trees=4, depth=2, rate=0.4, ridge=1.0)
    got = {r.i: r.m for r in cells.select("i", url_filter.margin(start, model).alias("m")).collect()}
    want = _plain_margins(rows, ["x", "y", "z"], 4, 2, 0.4, 1.0)
    assert all(math.isclose(got[i], want[i], abs_tol=1e-9) for i in range(len(rows)))


def test_values_never_seen_go_to_the_nearer_side(spark):
    cells = spark.createDataFrame([(0, 20, 0), (20, 20, 20)], "x int, n long, blocked long")
    start, model = url_filter.boost(cells, ["x"], trees=2, depth=1, rate=0.5)
    seen = spark.createDataFrame([(9,), (12,)], "x int").select("x", url_filter.margin(start, model).alias("m"))
    assert {r.x: r.m > 0 for r in seen.collect()} == {9: False, 12: True}


def test_held_out_hosts(spark):
    pages = spark.createDataFrame(
        [(i, f"http://h{i % 40}.example.{'com' if i % 3 else 'org'}/{('fr', 'de', 'es')[i % 5 % 3]}/{i}") for i in range(900)],
        "page_id long, url string",
    )
    held = [r for r in url_filter.scored(pages).collect() if r.label is not None and r.held]
    right = sum((r.score >= 0.5) == bool(r.label) for r in held)
    most = max(sum(r.label == k for r in held) for k in (0, 1))
    assert len(held) > 50 and right == len(held) > most


# -- pipeline ------------------------------------------------------------------------------------


def test_pipeline(spark, documents):
    stages = dict(corpus_pipeline.STAGES)
    rules = stages["quality_rules"](spark, documents, SF)
    judged = {r.doc_id: r.kept for r in quality_rules.judge(documents, spark.read.parquet(f"{SF}/labels.parquet")).collect()}
    assert sorted(r.doc_id for r in rules.collect()) == sorted(i for i, k in judged.items() if k)
    pieces = corpus_pipeline.run(spark, SF).collect()
    assert pieces and {r.doc_id for r in pieces} <= {r.doc_id for r in documents.collect()}
    sizes = packing.sequences([(r.sequence_id, r.offset, r.length) for r in pieces])
    assert sum(sizes.values()) == sum(r.length for r in pieces)


def test_the_mix_does_not_depend_on_read_partitions(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "source")
    some = rows.where("doc_id < 40")
    whole = rows.union(some).union(some).union(rows.where("doc_id = 7").withColumn("doc_id", F.lit(None)))

    def mixed(parts, run):
        dealt = whole.repartition(parts) if parts > 1 else whole.coalesce(1)
        return sorted(map(str, run(dealt).collect()))

    assert len({str(mixed(n, mixing.taken)) for n in (1, 5, 30)}) == 1
    assert len({str(mixed(n, mixing.mixed_documents)) for n in (1, 7)}) == 1


# The same by patterns that backtrack, for short pages.
_DROPPED = re.compile(r"(?is)<(script|style|nav|noscript|template)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>")
_TOLD = re.compile(r"""(?is)<html\b[^>]*?\blang\s*=\s*["']?\s*([a-z]{2,3})\b""")
_TOLD_META = re.compile(
    r"""(?is)<meta\b[^>]*?content-language["'][^>]*?content\s*=\s*["']?\s*([a-z]{2,3})\b"""
)


def test_markup_is_read_as_by_plain_patterns(spark):
    pieces = ["<", ">", "<script>", "</script >", "<SCRIPT x", "</script", "<!--", "-->", "<!-->", "<nav>", "</nav>",
              "<navy>", "text ", "a b", "<html lang=en>", "<html x='1' LANG = 'fr'", " lang=de", "<p>", "</style>",
              "<style>", "<meta http-equiv='content-language' content='es'>", "<meta content-language\" content= it"]
    rng = random.Random(4)
    pages = ["".join(rng.choices(pieces, k=rng.randint(0, 25))) for _ in range(3000)]
    pages += [r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect() if r.html]
    for page in pages:
        assert language_id._without_markup(page) == _DROPPED.sub(" ", page)
        told = _TOLD.search(page) or _TOLD_META.search(page)
        assert language_id.declared_language(page) == (told and told[1].lower())


@pytest.mark.parametrize("piece", ["<", "<script ", "<!--", "<html ", "<meta content-language' ", "<html lang=", "</nav ",
                                   "<script><!--", "lang= ", "< >"])
def test_long_pages_take_time_in_proportion(piece):
    page = piece * (5_000_000 // len(piece)) + "<html lang=" + " " * 1_000_000 + "1"
    began = time.process_time()
    language_id.visible_text(page)
    language_id.declared_language(page)
    assert time.process_time() - began < 4
