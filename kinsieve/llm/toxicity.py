"""Toxicity by a weighted lexicon (operator 1).

Texts are folded (compatibility forms, homoglyphs, accents, digits and signs used as
letters, invisible characters); an Aho-Corasick automaton finds the lexicon's stems in
the folded text; hits at word starts that no exception phrase covers add the stem's
weight; the sum, plain and normalised by length, goes through a logistic curve.

The lexicon, its exceptions and the curve are fitted on a bounded sample of labelled
rows (SAMPLE of each class, by a hash of the id; near copies count once).  The exceptions are words
and phrases of up to three words around a stem that clean texts of the sample have.  All documents
are scored, whole; a worker holds Spark's batch of texts (64 MB by its own bound, or one longer text) once, and half a mebibyte of it, or
one longer text, at about 6 times its bytes.

Defined results: null and empty texts score as a text without hits; repeated rows get
equal scores; rows without or with null labels are not learnt from; with no labelled
rows of both classes the lexicon is empty and every score is 0; an empty table gives an
empty result; only id and text are read from the documents.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, flat_batches, map_batches, on_texts, table, text_or_empty

SAMPLE, STEMS, PHRASE = 15_000, (4, 5, 6, 7, 8), 3
MIN_SUPPORT, MIN_ODDS, CHANCE, MIN_CLEAN = 5, 3.5, 0.5, 3

# Letters of other scripts that look like Latin ones, and signs read as letters.
_LOOK_ALIKE = {
    "а": "a", "в": "b", "с": "c", "е": "e", "ё": "e", "һ": "h", "і": "i", "ї": "i", "ј": "j", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x", "ԁ": "d", "ԝ": "w",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ω": "w",
    "ı": "i", "ɑ": "a", "ɡ": "g", "ł": "l", "ø": "o", "đ": "d",
    "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "l": "i",
}
_INVISIBLE = [0x00AD, 0x034F, *range(0x200B, 0x2010), *range(0x2060, 0x2065), *range(0xFE00, 0xFE10), 0xFEFF, *range(0x300, 0x370)]


def _folding() -> dict[int, str | None]:
    """One character at a time: compatibility form, lower case, without accent, then by look."""
    out: dict[int, str | None] = {}
    for c in [*range(0x250), *range(0x370, 0x530), *range(0x1E00, 0x2000), *range(0x2100, 0x2190), *range(0xFF01, 0xFF5F)]:
        base = "".join(x for x in unicodedata.normalize("NFKD", chr(c)).lower() if not unicodedata.combining(x))
        folded = "".join(_LOOK_ALIKE.get(x, x) for x in base)
        if folded != chr(c):
            out[c] = folded
    return out | dict.fromkeys(_INVISIBLE)


_FOLD = _folding()
_ASCII = {k: v for k, v in _FOLD.items() if k < 128}
_WORDS = re.compile(r"[^\W_]+")


def fold(text: str) -> str:
    return text.translate(_ASCII if text.isascii() else _FOLD)


@dataclass
class Lexicon:
    """stems: weight of each stem (folded); exceptions: folded phrases in which hits don't count; curve: bias and slopes."""

    stems: dict[str, float] = field(default_factory=dict)
    exceptions: list[str] = field(default_factory=list)
    curve: tuple[float, float, float] = (-20.0, 0.0, 0.0)

    def automaton(self):
        import ahocorasick

        if not self.stems:
            return None
        a, spared = ahocorasick.Automaton(), set(self.exceptions)
        for e in sorted(spared | set(self.stems)):  # one entry may be both
            a.add_word(e, (len(e), self.stems.get(e), e in spared))
        a.make_automaton()
        return a


def hits(automaton, folded: str) -> float:
    """Weight of the hits: the heaviest stem at each word start, unless an exception phrase covers it."""
    found: dict[int, float] = {}
    covered: list[tuple[int, int]] = []
    n = len(folded)
    for end, (size, weight, spared) in automaton.iter(folded):
        start = end + 1 - size
        if start and folded[start - 1].isalnum():
            continue
        if spared and (end + 1 == n or not folded[end + 1].isalnum()):
            covered.append((start, end))
        if weight is not None and weight > found.get(start, 0.0):
            found[start] = weight
    if covered:
        found = {p: w for p, w in found.items() if not any(a <= p <= b for a, b in covered)}
    return sum(found.values())


def measures(automaton, text: str) -> tuple[float, float]:
    """log of 1 + the sum of hits, and log of 1 + that sum in a thousand words."""
    total = hits(automaton, fold(text)) if automaton is not None and text else 0.0
    words = text.count(" ") + text.count("\n") + 1
    return math.log1p(total), math.log1p(1000 * total / words)


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """(term, whole, y, n): documents of the partition with each folded word, and with each stem of words."""
    found: tuple[Counter, Counter] = (Counter(), Counter())

    def told() -> Iterator[dict]:
        for y, c in enumerate(found):
            if c:
                yield {"term": [k[0] for k in c], "whole": [k[1] for k in c], "y": [y] * len(c), "n": list(c.values())}
                c.clear()

    for batch in batches:
        for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            words = {w for w in _WORDS.findall(fold(text)) if 3 < len(w) < 40}
            found[y].update((w, True) for w in words)
            found[y].update({(w[:k], False) for w in words for k in STEMS if len(w) >= k})
        if len(found[0]) + len(found[1]) > 120_000:  # bounds the task's memory; sums are the same
            yield from told()
    yield from told()


def _copy_key(batch: pa.RecordBatch) -> dict:
    """Texts with the same six least word hashes count as copies."""
    keys = []
    for text in batch.column(2).to_pylist():
        least = sorted({xxhash.xxh3_64_intdigest(w) for w in _WORDS.findall(text.lower())})[:6]
        keys.append(xxhash.xxh3_64_intdigest(str(least)) - (1 << 63))
    return {"y": batch.column(1), "text": batch.column(2), "t": [xxhash.xxh3_64_intdigest(x) - (1 << 63) for x in batch.column(2).to_pylist()], "k": keys}


def sampled(docs: DataFrame, labels: DataFrame, allowed: Column, sample: int) -> tuple[DataFrame, list[float]]:
    """Texts of at most about ``sample`` labelled rows of each class, copies once, and the share of each class taken."""
    own = labels.where(allowed & F.col("toxic").isin(0, 1)).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("y"))
    n = {r["y"]: r["count"] for r in own.groupBy("y").count().collect()}
    share = [min(1.0, sample / max(1, n.get(y, 0))) for y in (0, 1)]
    draw = F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(1 << 20)) / F.lit(1 << 20)
    ids = own.where(draw < F.when(F.col("y") == 1, F.lit(share[1])).otherwise(F.lit(share[0])))
    some = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).join(F.broadcast(ids), "doc_id")  # at most about 2 * sample rows
    keyed = map_batches(some.select("doc_id", "y", "text"), _copy_key, "y int, text string, t long, k long")
    # of copies the one of least label and digest, so that reruns agree
    return keyed.groupBy("k").agg(F.min(F.struct("y", "t", "text")).alias("x")).select("x.text", "x.y"), share


def choose(rows: list[tuple[str, bool, int, int]], totals: list[int], terms: int) -> dict[str, float]:
    """Stems with their weights: the shortest that toxic texts have and clean ones don't.

    A stem needs so many toxic texts that fewer than CHANCE of all terms would have as many by chance.
    """
    odds = {}
    for term, whole, clean, toxic in rows:
        odds[term, whole] = math.log((toxic + 0.5) / (totals[1] + 1)) - math.log((clean + 0.5) / (totals[0] + 1))
    need = max(MIN_SUPPORT, math.log(max(1, terms) / CHANCE) / math.log((totals[0] + totals[1]) / totals[1]))
    able = sorted(((len(t), t, whole) for t, whole, clean, toxic in rows if toxic >= need and odds[t, whole] >= MIN_ODDS and toxic >= 10 * clean), key=lambda x: (x[0], x[1]))
    stems: dict[str, float] = {}
    for size, term, _ in able:
        if not any(term[:k] in stems for k in range(STEMS[0], size)):
            stems[term] = max(odds.get((term, False), -9.0), odds.get((term, True), -9.0))
    return stems


def _logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[float, float, float]:
    """Weighted logistic regression by Newton steps with a small ridge."""
    a, b = np.c_[np.ones(len(x)), x], np.zeros(3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ b, -30, 30)))
        h = (a * (w * p * (1 - p))[:, None]).T @ a + np.eye(3) * 0.05
        step = np.linalg.solve(h, a.T @ (w * (y - p)) - 0.05 * b)
        b = b + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return tuple(map(float, b))


def _stem_of(word: str, stems: frozenset[str]) -> bool:
    return any(word[:k] in stems for k in range(STEMS[0], len(word) + 1))


def phrases(text: str, stems: frozenset[str]) -> set[str]:
    """Folded phrases of a text, of one to PHRASE words in a row, that hold a word with a stem: as they stand in the text, with what is between the words."""
    folded = fold(text)
    words = [(m.start(), m.end()) for m in _WORDS.finditer(folded)]
    hit = [i for i, (a, b) in enumerate(words) if _stem_of(folded[a:b], stems)]
    return {folded[words[i][0] : words[j][1]] for k in hit for n in range(PHRASE) for i in range(max(0, k - n), k + 1) if (j := i + n) < len(words) and words[j][1] - words[i][0] < 80}


def _exceptions(some: DataFrame, stems: frozenset[str]) -> list[str]:
    """Phrases in which a stem is harmless: those that more clean texts of the sample have than toxic ones; of longer ones only those that hold no shorter one.

    A single word must be as frequent as that alone; a longer phrase is clean context around a stem, so it needs MIN_CLEAN clean texts and no toxic one.
    """
    if not stems:
        return []

    def found(batch: pa.RecordBatch) -> dict:
        rows = [(p, y) for t, y in zip(*(c.to_pylist() for c in batch.columns), strict=True) for p in sorted(phrases(t, stems))]
        return {"p": [r[0] for r in rows], "y": [r[1] for r in rows]}

    count = lambda y: F.count_if(F.col("y") == y)
    counted = map_batches(some.select("text", "y"), found, "p string, y int").groupBy("p").agg(count(0).alias("clean"), count(1).alias("toxic")).where("clean > toxic").collect()
    out: set[str] = set()
    for size in range(1, PHRASE + 1):
        for r in counted:
            words = _WORDS.findall(r["p"])
            inner = {r["p"][m.start() : e.end()] for i, m in enumerate(list(_WORDS.finditer(r["p"]))) for e in list(_WORDS.finditer(r["p"]))[i:]} - {r["p"]}
            if len(words) == size and (size == 1 or r["clean"] >= MIN_CLEAN and not r["toxic"]) and not inner & out:
                out.add(r["p"])
    return sorted(out)


def fit(docs: DataFrame, labels: DataFrame, allowed: Column | None = None, sample: int = SAMPLE) -> Lexicon:
    """Lexicon, exceptions and curve from the labelled rows where ``allowed`` holds (a column of labels)."""
    some, share = sampled(docs, labels, F.lit(True) if allowed is None else allowed, sample)
    some = cut(some)
    totals = {r["y"]: r["count"] for r in some.groupBy("y").count().collect()}
    if not totals.get(0) or not totals.get(1):
        return Lexicon()
    counted = flat_batches(some, _terms, "term string, whole boolean, y int, n long").groupBy("term", "whole").agg(F.sum(F.when(F.col("y") == 0, F.col("n")).otherwise(0)).alias("clean"), F.sum(F.when(F.col("y") == 1, F.col("n")).otherwise(0)).alias("toxic"))
    counted = cut(counted.where("toxic >= 1"))
    likely = counted.where((F.col("toxic") >= MIN_SUPPORT) & (F.col("toxic") >= 10 * F.col("clean")))
    rows = [tuple(r) for r in likely.collect()]  # terms of the bounded sample
    stems = choose(rows, [totals[0], totals[1]], counted.count())
    lexicon = Lexicon(stems, _exceptions(some, frozenset(stems)))

    def measured(batch: pa.RecordBatch) -> dict:
        a = lexicon.automaton()
        m = [measures(a, t) for t in batch.column(0).to_pylist()]
        return {"a": [x[0] for x in m], "b": [x[1] for x in m], "y": batch.column(1)}

    got = np.array([tuple(r) for r in map_batches(some, measured, "a double, b double, y int").collect()])
    weight = np.where(got[:, 2] == 1, 1 / share[1], 1 / share[0])
    lexicon.curve = _logistic(got[:, :2], got[:, 2], weight / weight.mean())
    return lexicon


def score(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """docs (whole rows) with ``score`` and ``predicted``."""

    held: list = []

    def scores(texts: list[str]) -> np.ndarray:
        if not held:
            held.append(lexicon.automaton())
        b0, b1, b2 = lexicon.curve
        m = np.array([measures(held[0], t) for t in texts]).reshape(-1, 2)
        return 1 / (1 + np.exp(-np.clip(b0 + m @ [b1, b2], -30, 30)))

    return docs.withColumn("score", on_texts(scores, pa.float64(), text_or_empty())).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def held_out(column: str = "doc_id", parts: int = 5) -> Column:
    return F.coalesce(F.crc32(F.col(column).cast("string")) % parts == 0, F.lit(False))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    lexicon = fit(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"), ~held_out())
    return score(docs, lexicon).select("doc_id", held_out().alias("held_out"), "score", "predicted")
