"""Toxicity behind disguise: a noisy-channel decoder, then a lexicon score.

Someone who writes "1d10t", "i.d.i.o.t" or "iddiioot" sent a word through a noisy
channel. Each suspicious run of characters becomes a lattice: a character may stand for
itself or for letters it resembles, a mark between letters may be padding, a repeated
letter may be one letter. Viterbi decoding picks the path that is likeliest under a
character trigram model (counted over all documents) and the costs of the channel. Runs
of plain letters have one path, themselves, and are not decoded.

The score reads the restored words. Words that stand out in toxic documents of a bounded
labelled sample get a weight, their shrunk log-odds; evidence must pass a likelihood-ratio
test corrected for the number of words, on texts of which near copies count once. A
document's score is a logistic function of the weights of the different words it holds.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frontgauge.llm.common import settle, small_batches
from frontgauge.llm.quality_classifier import labelled_sample

# Letters a character may stand for.
LOOKALIKES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t",
    "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c",
    "£": "e", "€": "e", "¡": "i",
}
# Marks that may pad a word between its letters.
PADDING = " .-_*~'/\\,:;^#"
# Costs of the channel, in nats.
LOOKALIKE_COST = 1.0
PAD_COST = 0.3
REPEAT_COST = 0.3
KEEP_MARK_COST = 4.0
# Character classes of the model: a-z, a break between words, anything else.
LETTERS = "abcdefghijklmnopqrstuvwxyz"
BREAK, OTHER, CLASSES = 26, 27, 28
# Labelled documents to learn words from, on average.
SAMPLE = 40_000
# Log-odds that a word needs for a weight, and the expected number of words that pass
# the test by chance.
LEAST_ODDS = 3.0
CHANCE = 0.5

_CLASS = np.full(256, OTHER, dtype=np.int64)
for _i, _c in enumerate(LETTERS):
    _CLASS[ord(_c)] = _CLASS[ord(_c.upper())] = _i
for _c in "\t\n\x0b\x0c\r !\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~":
    _CLASS[ord(_c)] = BREAK


def trigram_counts(texts: list[bytes]) -> np.ndarray:
    """Counts of class trigrams; every text starts and ends with a break."""
    total = np.zeros(CLASSES**3, dtype=np.int64)
    for data in texts:
        c = _CLASS[np.frombuffer(b" " + data + b" ", dtype=np.uint8)]
        if len(c) > 2:
            code = (c[:-2] * CLASSES + c[1:-1]) * CLASSES + c[2:]
            total += np.bincount(code, minlength=CLASSES**3)
    return total


def count_trigrams(docs: DataFrame) -> np.ndarray:
    """Trigram counts over the whole texts of all documents.

    Each task sends one row per trigram it met, CLASSES^3 at most.
    """
    def count(batches):
        total = np.zeros(CLASSES**3, dtype=np.int64)
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                texts = batch.column("text").slice(i, 256).cast(pa.binary()).to_pylist()
                total += trigram_counts([t for t in texts if t is not None])
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(total[met])], names=["code", "n"])

    out = np.zeros(CLASSES**3, dtype=np.int64)
    rows = docs.select("text").mapInArrow(count, "code long, n long").groupBy("code").agg(F.sum("n"))
    for code, n in rows.collect():  # at most CLASSES^3 rows
        out[code] = n
    return out


def log_model(counts: np.ndarray) -> np.ndarray:
    """log P(c | a, b) as [a, b, c], interpolated with P(c | b) and P(c)."""
    n3 = counts.reshape(CLASSES, CLASSES, CLASSES).astype(float)
    n2, n1 = n3.sum(axis=0), n3.sum(axis=(0, 1)) + 1.0
    p1 = n1 / n1.sum()
    p2 = (n2 + 5.0 * p1) / (n2.sum(axis=1, keepdims=True) + 5.0)
    p3 = (n3 + 5.0 * p2[None]) / (n3.sum(axis=2, keepdims=True) + 5.0)
    return np.log(p3)


class Decoder:
    """Viterbi decoding of disguised runs under a character model."""

    def __init__(self, model: np.ndarray):
        # plain lists: the search reads single entries
        self._model = model.tolist()
        self.decode = lru_cache(maxsize=100_000)(self._decode)

    def _decode(self, run: str) -> str:
        model = self._model
        # state: last two classes -> (cost, restored letters as a chain of (rest, letter),
        # so that a run of any length costs a step a character); starts behind a break
        states = {(BREAK, BREAK): (0.0, None)}
        for ch in run.lower():
            own = LETTERS.find(ch)
            options = []  # (class, letter, cost)
            if own >= 0:
                options.append((own, ch, 0.0))
            else:
                for letter in LOOKALIKES.get(ch, ""):
                    options.append((LETTERS.index(letter), letter, LOOKALIKE_COST))
                kind = BREAK if ord(ch) < 128 and not ch.isalnum() else OTHER
                options.append((kind, ch, KEEP_MARK_COST if kind == BREAK and ch != " " else 0.0))
            pad = PAD_COST if ch in PADDING else None
            grown: dict[tuple[int, int], tuple[float, tuple | None]] = {}
            for (a, b), (cost, text) in states.items():
                row = model[a][b]
                for kind, letter, price in options:
                    total = cost + price - row[kind]
                    key = (b, kind)
                    if key not in grown or total < grown[key][0]:
                        grown[key] = (total, (text, letter))
                    if kind == b and kind < BREAK:
                        total = cost + price + REPEAT_COST
                        if (a, b) not in grown or total < grown[a, b][0]:
                            grown[a, b] = (total, text)
                if pad is not None and text is not None:
                    total = cost + pad
                    if (a, b) not in grown or total < grown[a, b][0]:
                        grown[a, b] = (total, text)
            states = grown
        ends = [(cost - model[a][b][BREAK], text) for (a, b), (cost, text) in states.items()]
        least = min(cost for cost, _ in ends)
        return min(_spelled(text) for cost, text in ends if cost == least)

    def words(self, text: str) -> set[str]:
        """Different restored words of a text, in lower case."""
        low = text.lower()
        out: set[str] = set()
        for token in set(low.split()):
            out.update(self.token(token))
        out.update(self.spaced(low))
        return out

    def spaced(self, low: str) -> set[str]:
        """Words of the runs of letters set apart by white space.

        A run is read as one, and where its gaps differ also as the parts between the
        wider ones, which may be the breaks between words.
        """
        out: set[str] = set()
        for run in _SPACED.findall(low):
            letters = run.split()
            out.update(_WORDS(self.decode(" ".join(letters))))
            gaps = [len(g) for g in _GAPS(run)]
            cuts = [i + 1 for i, g in enumerate(gaps) if g > min(gaps)]
            if cuts:
                for i, j in zip([0, *cuts], [*cuts, len(letters)]):
                    if j - i > 2:
                        out.update(_WORDS(self.decode(" ".join(letters[i:j]))))
        return out

    @staticmethod
    def suspicious(token: str) -> bool:
        return bool(_MIXED.search(token) or _DOUBLED.search(token))

    def token(self, token: str) -> tuple[str, ...]:
        """Words of one white-space separated token; disguised ones also as decoded.

        A doubled letter may be a disguise or not, so such a word counts in both forms.
        """
        plain = token.strip(_EDGE)
        if plain.isalpha() and not _DOUBLED.search(plain):
            return (plain,)
        words = tuple(_WORDS(token))
        if len(token) < 3 or not self.suspicious(token):
            return words
        return words + tuple(_WORDS(self.decode(token))) + tuple(_WORDS(self.decode(plain)))

    def restore(self, text: str) -> str:
        """The text with disguised runs replaced by what they decode to.

        A text has room for one form only: plain words keep a single doubled letter.
        """
        def disguised(token: str) -> bool:
            return bool(_MIXED.search(token) or _TRIPLE.search(token))

        joined = _SPACED.sub(lambda m: m[0].replace(m[1], self.decode(" ".join(m[1].split()))), text)
        return re.sub(
            r"\S+",
            lambda m: self.decode(m[0]) if len(m[0]) > 2 and disguised(m[0].lower()) else m[0],
            joined,
        )


def _spelled(chain: tuple | None) -> str:
    out = []
    while chain is not None:
        chain, letter = chain
        out.append(letter)
    return "".join(reversed(out))


def sketch(text: str, salt: int) -> int:
    """A min-hash of the text's words in threes; near copies mostly share it."""
    w = text.split()
    if len(w) < 3:
        return xxhash.xxh64_intdigest(text, salt) >> 1
    threes = zip(w, w[1:], w[2:])
    return min(xxhash.xxh64_intdigest(" ".join(t), salt) for t in threes) >> 1


_WORDS = re.compile(r"[^\W\d_]+").findall
_EDGE = ".,;:!?\"'()"
# a letter next to, or parted from another by, a lookalike or a mark
_MIXED = re.compile(r"[a-z][^a-z\sª-￿]+[a-z]|[0-9@$!|+£€¡][a-z]|[a-z][0-9@$|+£€¡]")
_DOUBLED = re.compile(r"([a-z])\1")
# more than one doubled letter needs: three alike, or two pairs
_TRIPLE = re.compile(r"([a-z])\1\1|([a-z])\2.*([a-z])\3")
# three or more single characters, each set apart by any white space
_SPACED = re.compile(r"(?:^|(?<=\s))(\S(?:\s+\S){2,})(?=\s|$)")
_GAPS = re.compile(r"\s+").findall


def fit(
    docs: DataFrame, labels: DataFrame, learn: Column, model: np.ndarray, sample: int = SAMPLE
) -> tuple[dict[str, float], float]:
    """(weight per word, log-odds of a text without any of them) from labelled documents.

    Words of every sampled document are counted once; only those that pass the tests
    reach the driver. Without labels of both kinds: no words, odds of one to one.
    """
    part = labelled_sample(docs, labels, "toxic", learn, sample)
    for salt in (1, 2):
        sketched = F.arrow_udf(_sketcher(salt), "long")
        part = part.withColumn("_s", sketched("text")).dropDuplicates(["_s", "label"]).drop("_s")
    part = settle(part)
    n, bad = part.agg(F.count("*"), F.sum("label")).first()
    bad = bad or 0
    if not bad or bad == n:
        return {}, 0.0
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def count(batches):
        decoder = Decoder(shared.value)
        for batch in batches:
            for i in range(0, batch.num_rows, 200):
                counts: Counter = Counter()
                few = batch.slice(i, 200)
                for text, toxic in zip(few.column("text").to_pylist(), few.column("label").to_pylist()):
                    counts.update((w, toxic) for w in decoder.words(text))
                keys = list(counts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k[0] for k in keys], pa.string()),
                     pa.array([k[1] for k in keys], pa.int32()),
                     pa.array([counts[k] for k in keys], pa.int64())],
                    names=["word", "toxic", "n"],
                )

    def side(toxic: int) -> Column:
        return F.coalesce(F.sum(F.when(F.col("toxic") == toxic, F.col("n"))), F.lit(0))

    base, t, c = bad / n, F.col("t"), F.col("c")

    def part_of(k: Column, share: float) -> Column:
        return F.when(k > 0, k * F.log(k / ((t + c) * share))).otherwise(0.0)

    odds = F.log(((t + 0.5) / (bad + 1.0)) / ((c + 0.5) / (n - bad + 1.0)))
    counted = settle(
        part.repartition("doc_id").mapInArrow(count, "word string, toxic int, n long")
        .groupBy("word").agg(side(1).alias("t"), side(0).alias("c"))
    )
    # a likelihood ratio G has a tail of about exp(-G / 2)
    least = 2.0 * math.log(max(1.0, counted.where("t + c > 1").count() / CHANCE))
    found = (
        counted.withColumns({"odds": odds, "g": 2 * (part_of(t, base) + part_of(c, 1 - base))})
        .where((F.col("odds") >= LEAST_ODDS) & (F.col("g") >= least))
        .select("word", F.round("odds", 6))
        .collect()
    )
    weights = dict(tuple(r) for r in found)
    listed = docs.sparkSession.sparkContext.broadcast(weights)

    def clear(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        decoder, known = Decoder(shared.value), {}
        for batch in texts:
            yield pa.array([not hits(decoder, known, listed.value, t) for t in batch.to_pylist()], pa.bool_())

    none = part.where(F.arrow_udf(clear, "boolean")("text")).agg(F.count("*"), F.sum("label")).first()
    return weights, math.log(((none[1] or 0) + 0.5) / (none[0] - (none[1] or 0) + 0.5))


def _sketcher(salt: int):
    def sketches(texts: pa.Array) -> pa.Array:
        return pa.array([sketch(t, salt) for t in texts.to_pylist()], pa.int64())

    return sketches


def score(docs: DataFrame, labels: DataFrame, learn: Column, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, score) for every row of `docs`, over its whole text.

    Scores lie in (0, 1), higher where toxic is likelier. NULL and empty texts have no
    words, so the score of a text without toxic words. doc_id serves to find labels only;
    repeated rows are scored each on their own; other columns are not read.
    """
    small_batches(docs.sparkSession)
    model = log_model(count_trigrams(docs))
    weights, odds = fit(docs, labels, learn, model, sample)
    shared = docs.sparkSession.sparkContext.broadcast((model, weights))

    def judge(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model, weights = shared.value
        decoder, known = Decoder(model), {}
        for texts in batches:
            out = []
            for i in range(0, len(texts), 256):
                for text in texts.slice(i, 256).to_pylist():
                    out.append(_probability(odds, hits(decoder, known, weights, text or "")))
            yield pa.array(out, pa.float64())

    return docs.select("doc_id", F.arrow_udf(judge, "double")(F.coalesce("text", F.lit(""))).alias("score"))


def hits(decoder: Decoder, known: dict, weights: dict[str, float], text: str) -> set[tuple[float, str]]:
    """(weight, word) of the weighted words of a restored text; `known` remembers tokens."""
    if len(known) > 300_000:
        known.clear()
    low, found = text.lower(), set()
    for token in set(low.split()):
        held = known.get(token)
        if held is None:
            # a word with a weight is not counted once more in its restored form
            plain = token.strip(_EDGE)
            read = (plain,) if plain in weights else decoder.token(token)
            held = known[token] = tuple((weights[w], w) for w in read if w in weights)
        if held:
            found.update(held)
    found.update((weights[w], w) for w in decoder.spaced(low) if w in weights)
    return found


def _probability(odds: float, found: set[tuple[float, str]]) -> float:
    z = odds + sum(sorted(w for w, _ in found))
    return 1.0 / (1.0 + math.exp(-max(-35.0, min(35.0, z))))
