"""Hidden Markov language model (operator 3).

Words fall into classes: each of the OWN most frequent has its own, the others share
one by their ending, and the end of a text is one more.  A hidden Markov model generates
the classes; within a class words follow their smoothed unigram shares, and a shared
class keeps a part for unknown words by the share of words seen once.  Training is
Baum-Welch by passes over the training documents, each of which adds up expected counts in every
partition, which Spark sums by class; texts are coded as classes once for all passes: WARM passes over one document in WARM_SHARE (by a hash of
the id), as a starting point, then passes over all documents until a pass gains at most
SETTLED (natural logarithm) a token, PASSES at most.  Whole texts go through the forward and backward recursion; the
forward messages are kept at block ends only and computed again block by block, so a
worker's memory doesn't grow with the square or the states times the length of a text.
Scoring is the scaled forward recursion over whole texts, so the probability is exact.

Unigram counts cover all training documents.  The HEAD most frequent words, the hot keys
of the corpus, are broadcast (a fixed number of rows); all other words of a document are
joined with the counts by a shuffle.  Words are named by 64-bit hashes: among a thousand
million different words 0.03 pairs are expected to share one.

Defined results: null text counts as empty (one token, the end); repeated rows give
repeated results; without training documents every count is 0 and score equals base_score;
an empty table gives an empty result; only id and text are read.  A worker holds TOKENS tokens,
or those of one longer text, at about 40 bytes each, and the messages of CELLS.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Words, cut, flat_batches, map_batches, mix, table, text_or_empty, tight

HEAD, OWN, ENDINGS, STATES = 1 << 18, 4096, 1024, 8
WARM, WARM_SHARE, PASSES, SETTLED = 8, 16, 12, 0.01
#: Documents to a task of a warm pass.
WARM_TASK = 4_000
#: Steps times sequences of which a worker keeps the messages at once, tokens that it takes up together, and cells of which it adds up emissions together.
CELLS, TOKENS, EMIT_CELLS = 2_000_000, 3_000_000, 100_000
END_HASH = np.uint64(0x0E4D0E4D0E4D0E4D)
SMOOTH, PRIOR = 0.1, 50.0


def endings(w: Words) -> np.ndarray:
    """Bucket of each word's last three bytes."""
    a = np.frombuffer(w.data, np.uint8)
    key = np.zeros(len(w.start), np.uint64)
    for back in (1, 2, 3):
        at = w.end - back
        key = key << np.uint64(8) | np.where(at >= w.start, a[np.maximum(at, 0)], 0).astype(np.uint64)
    return (mix(key) % np.uint64(ENDINGS)).astype(np.int32)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """(h, ending, n) of the words of a partition, summed while they fit in memory."""
    kept: list[tuple] = []
    size = 0

    def told() -> Iterator[dict]:
        h, e, n = (np.concatenate(x) for x in zip(*kept, strict=True))
        u, first, inverse = np.unique(h, return_index=True, return_inverse=True)
        total = np.bincount(inverse, n).astype(np.int64)
        for at in range(0, len(u), 200_000):
            part = slice(at, at + 200_000)
            yield {"h": u[part].view(np.int64), "ending": e[first[part]], "n": total[part]}

    for batch in batches:
        texts = batch.column(0).to_pylist()
        w = Words(texts)
        u, first, n = np.unique(w.hash, return_index=True, return_counts=True)
        kept.append((u, endings(w)[first], n))
        kept.append((np.array([END_HASH]), np.array([-1], np.int32), np.array([len(texts)])))
        size += len(u)
        if size > 2_000_000:
            yield from told()
            kept, size = [], 0
    if kept:
        yield from told()


@dataclass
class Counts:
    """What scoring needs of the counts: totals, the head (hashes in order, counts, class), and class masses."""

    tokens: int
    kinds: int
    hashes: np.ndarray
    counts: np.ndarray
    rank: np.ndarray
    mass: np.ndarray
    unknown: float

    @property
    def norm(self) -> float:
        return self.tokens + SMOOTH * (self.kinds + 1)


def vocabulary(training: DataFrame) -> DataFrame:
    """(h, ending, c): every word of the training texts with its count, and the end."""
    return cut(flat_batches(training.select(text_or_empty().alias("text")), _counted, "h long, ending int, n long").groupBy("h").agg(F.first("ending").alias("ending"), F.sum("n").alias("c")))


def counts_of(words: DataFrame) -> Counts:
    total = words.agg(F.sum("c"), F.count("*"), F.sum(F.when((F.col("c") == 1) & (F.col("ending") >= 0), 1))).first()
    tokens, kinds, once = (int(x or 0) for x in total)
    # all words as frequent as the HEAD-th at most; a histogram of the counts tells how frequent that is
    by_count = np.array([tuple(r) for r in words.groupBy("c").count().collect()] or [(0, 0)], np.int64)
    by_count = by_count[np.argsort(-by_count[:, 0])]
    fits = by_count[np.cumsum(by_count[:, 1]) <= HEAD, 0]
    top = words.where(F.col("c") >= int(fits[-1] if len(fits) else 1 << 62)).select("h", "c", "ending").toArrow()
    h, c, e = top["h"].to_numpy().astype(np.int64).view(np.uint64), top["c"].to_numpy().astype(np.int64), top["ending"].to_numpy().astype(np.int64)
    order = np.lexsort((h, -c))
    h, c, e = h[order], c[order], e[order]
    order = np.argsort(h)
    norm = tokens + SMOOTH * (kinds + 1)
    mass = np.zeros(OWN + ENDINGS)
    mass[: min(OWN, len(c))] = (c[:OWN] + SMOOTH) / norm
    by_ending = words.where("ending >= 0").groupBy("ending").agg(F.sum(F.col("c") + SMOOTH).alias("s")).collect()
    for r in by_ending:
        mass[OWN + r["ending"]] = r["s"] / norm
    # words with a class of their own don't count for their ending
    ends = e[:OWN] >= 0
    np.subtract.at(mass, OWN + e[:OWN][ends], (c[:OWN][ends] + SMOOTH) / norm)
    mass = np.maximum(mass, SMOOTH / norm / 10)
    shared = max(1, tokens - int(c[:OWN].sum()))
    return Counts(tokens, kinds, h[order], c[order], order.astype(np.int64), mass, min(0.5, max(1e-6, (once + 0.5) / (shared + 1))))


class Reader:
    """Texts as classes, with the parts of their probability that need no hidden states."""

    def __init__(self, k: Counts):
        self.k = k

    def __call__(self, texts: list[str]) -> dict:
        """classes with the end of each text, bounds, base (head words only), shared and known counts, and the tail."""
        k, w = self.k, Words(texts)
        at = np.minimum(np.searchsorted(k.hashes, w.hash), max(0, len(k.hashes) - 1))
        inside = k.hashes[at] == w.hash if len(k.hashes) else np.zeros(len(w.hash), bool)
        rank = np.where(inside, k.rank[at], len(k.hashes) + OWN) if len(k.hashes) else np.full(len(w.hash), OWN)
        cls = np.where(rank < OWN, rank, OWN + endings(w)).astype(np.int32)
        end_at = int(np.searchsorted(k.hashes, END_HASH)) if len(k.hashes) else 0
        known_end = end_at < len(k.hashes) and k.hashes[end_at] == END_HASH
        end_count = int(k.counts[end_at]) if known_end else 0
        end_class = int(k.rank[end_at]) if known_end and k.rank[end_at] < OWN else OWN
        n = len(texts)
        log = np.where(inside, np.log10((k.counts[at] if len(k.hashes) else 0) + SMOOTH), 0.0) - math.log10(k.norm)
        base = np.bincount(w.doc, np.where(inside, log, 0.0), n) + math.log10((end_count + SMOOTH) / k.norm)
        known = np.bincount(w.doc, inside, n).astype(np.int64) + (end_count > 0)
        shared = np.bincount(w.doc, inside & (cls >= OWN), n) + (end_class >= OWN and end_count > 0)
        full = np.insert(cls, w.bounds[1:], end_class) if n else cls
        tail = np.flatnonzero(~inside)
        return {"cls": full, "bounds": w.bounds + np.arange(n + 1), "base": base, "known": known, "shared": shared, "tail": (w.doc[tail], w.hash[tail], cls[tail])}


@dataclass
class Model:
    """Start, transitions and emissions; ratio is each state's emission over the class's mass."""

    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray
    ratio: np.ndarray

    @classmethod
    def of(cls, start: np.ndarray, move: np.ndarray, emit: np.ndarray, mass: np.ndarray, share: float = 1.0) -> Model:
        """From expected counts (states first) of a share of the documents, smoothed in proportion."""
        e = emit + PRIOR * share * mass / mass.sum()
        e /= e.sum(1, keepdims=True)
        m = move + share
        s = start + share
        return cls(s / s.sum(), m / m.sum(1, keepdims=True), e, np.ascontiguousarray((e / mass).T))


def _grid(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows by falling length, and how many are as long as each step needs."""
    order = np.argsort(-lengths, kind="stable")
    return order, np.searchsorted(-lengths[order], -np.arange(1, int(lengths.max(initial=0)) + 1), side="right")


def likelihood(model: Model, cls: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """log10 probability of each sequence, over the product of its classes' masses, by the scaled forward recursion."""
    lengths = np.diff(bounds)
    order, active = _grid(lengths)
    first, out = bounds[:-1][order], np.zeros(len(lengths))
    a, m = None, model.move.astype(np.float64)
    for t, n in enumerate(active):
        r = model.ratio[cls[first[:n] + t]]
        a = (np.broadcast_to(model.start, (n, len(model.start))) if t == 0 else a[:n] @ m) * r
        s = a.sum(1)
        out[:n] += np.log10(s)
        a = a / s[:, None]
    back = np.empty_like(out)
    back[order] = out
    return back


def _blocks(active: np.ndarray) -> list[tuple[int, int]]:
    """Runs of steps with about CELLS sequences times steps."""
    out, at, ends = [], 0, np.cumsum(active)
    while at < len(active):
        before = int(ends[at - 1]) if at else 0
        end = max(at + 1, int(np.searchsorted(ends, before + CELLS, side="right")))
        out.append((at, min(end, len(active))))
        at = end
    return out


def expected(model: Model, cls: np.ndarray, bounds: np.ndarray, classes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Baum-Welch counts (start, move, emit) of whole sequences, and their log likelihood over the product of the classes' masses.

    The forward messages are kept where blocks begin; going back, each block's are computed once more.
    """
    k = len(model.start)
    order, active = _grid(np.diff(bounds))
    first = bounds[:-1][order]
    start, move, emit, total = np.zeros(k), np.zeros((k, k)), np.zeros((k, classes)), 0.0
    blocks = _blocks(active)

    def ratio(t: int) -> np.ndarray:
        return model.ratio[cls[first[: active[t]] + t]]

    def forward(a: np.ndarray | None, block: tuple[int, int]) -> tuple[list[np.ndarray], np.ndarray, float]:
        alphas, scales = [], []
        for t in range(*block):
            a = (model.start if t == 0 else a[: active[t]] @ model.move) * ratio(t)
            s = a.sum(1)
            scales.append(s)
            a /= s[:, None]
            alphas.append(a.astype(np.float32))  # half the memory; the recursion itself goes on in double
        return alphas, a, float(np.log(np.concatenate(scales)).sum())

    entry: list[np.ndarray | None] = [None]
    for block in blocks:
        alphas, last, logs = forward(entry[-1], block)
        total += logs
        entry.append(last)
    b, names, shares, cells = np.ones((len(first), k)), [], [], 0
    for at in range(len(blocks) - 1, -1, -1):
        if at < len(blocks) - 1:
            alphas, *_ = forward(entry[at], blocks[at])
        for t in range(blocks[at][1] - 1, blocks[at][0] - 1, -1):
            n, own = active[t], t - blocks[at][0]
            g = alphas[own] * b[:n]
            g /= g.sum(1, keepdims=True)
            names.append(cls[first[:n] + t]), shares.append(g)
            cells += n
            if cells > EMIT_CELLS or t == 0:
                name, share = np.concatenate(names), np.concatenate(shares)
                for j in range(k):
                    emit[j] += np.bincount(name, share[:, j], classes)
                names, shares, cells = [], [], 0
            if t == 0:
                start += g.sum(0)
                continue
            y = ratio(t) * b[:n]
            x = (alphas[own - 1] if own else entry[at])[:n]
            back = y @ model.move.T
            move += (x / (x * back).sum(1)[:, None]).T @ y * model.move
            back /= back.sum(1, keepdims=True)
            b[:n] = back
    return start, move, emit, total


def _random_model(mass: np.ndarray) -> Model:
    r = np.random.default_rng(1)
    emit = mass / mass.sum() * r.gamma(0.5, 2.0, (STATES, len(mass))) * 1000
    return Model.of(np.ones(STATES), np.eye(STATES) * 20 + 1, emit, mass)


def coded(training: DataFrame, counts: Counts) -> DataFrame:
    """(part, cls): each text as 16-bit class numbers with its end, read once for all passes; part, a hash of the id, tells shares apart."""

    def run(batch: pa.RecordBatch) -> dict:
        got = Reader(counts)(batch.column(1).to_pylist())
        cls, bounds = got["cls"].astype("<u2"), got["bounds"]
        return {"part": batch.column(0), "cls": [cls[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]}

    part = F.pmod(F.xxhash64("doc_id", F.lit(2)), F.lit(WARM_SHARE)).cast("int")
    return map_batches(training.select(part.alias("part"), text_or_empty().alias("text")), run, "part int, cls binary")


def one_pass(texts: DataFrame, model: Model, counts: Counts, share: float = 1.0) -> tuple[Model, float]:
    """The next model, from expected counts over all coded texts, and the log likelihood under the present one."""
    classes = OWN + ENDINGS

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        total, held, size = None, [], 0

        def add(total, held):
            cls = np.frombuffer(b"".join(held), "<u2").astype(np.int32)
            new = expected(model, cls, np.cumsum([0, *(len(x) // 2 for x in held)]), classes)
            return new if total is None else tuple(a + b for a, b in zip(total, new, strict=True))

        for batch in batches:
            held += batch.column(0).to_pylist()
            size += sum(map(len, held[-batch.num_rows :])) // 2
            if size > TOKENS:
                total, held, size = add(total, held), [], 0
        if held:
            total = add(total, held)
        if total is not None:
            start, move, emit, logs = total
            some = np.flatnonzero(emit.sum(0) > 0)
            yield {"cls": [-1, -2, *range(-3, -3 - STATES, -1), *some.tolist()], "c": [[logs] + [0.0] * (STATES - 1), start.tolist(), *move.tolist(), *emit.T[some].tolist()]}

    sums = flat_batches(texts.select("cls"), gather, "cls int, c array<double>")
    rows = sums.groupBy("cls").agg(*(F.sum(F.element_at("c", j + 1)).alias(f"c{j}") for j in range(STATES))).collect()  # a row for each class at most
    start, move, emit, logs = np.zeros(STATES), np.zeros((STATES, STATES)), np.zeros((STATES, classes)), 0.0
    for r in rows:
        c = np.array(r[1:])
        if r["cls"] == -1:
            logs = float(c[0])
        elif r["cls"] == -2:
            start = c
        elif r["cls"] < -2:
            move[-3 - r["cls"]] = c
        else:
            emit[:, r["cls"]] = c
    return (Model.of(start, move, emit, counts.mass, share), logs) if rows else (model, 0.0)


def train(training: DataFrame, counts: Counts, passes: int = PASSES, warm: int = WARM, said: list[float] | None = None) -> Model:
    """Baum-Welch: warm passes over a share of the documents, then over all of them until the likelihood settles.

    The log likelihoods of the passes over all documents are appended to ``said``.
    """
    model, before = _random_model(counts.mass), None
    if not counts.tokens:
        return model
    texts = cut(coded(training, counts))
    some = cut(texts.where("part = 0"))
    some = tight(some, some.count(), WARM_TASK)
    for _ in range(warm):
        model, _ = one_pass(some, model, counts, 1 / WARM_SHARE)
    for _ in range(passes):
        model, now = one_pass(texts, model, counts)
        if said is not None:
            said.append(now)
        if before is not None and now - before <= SETTLED * counts.tokens:
            break
        before = now
    return model


ROW = "doc_id long, t long, n_tokens long, known long, base double, score double, tail array<long>, times array<int>, mass array<double>"


def _scored(model: Model, counts: Counts):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        read, held, size = Reader(counts), [], 0

        def told(held: list) -> dict:
            cls = np.concatenate([g["cls"] for *_, g in held])
            sizes = np.concatenate([np.diff(g["bounds"]) for *_, g in held])
            forward = likelihood(model, cls, np.concatenate([[0], np.cumsum(sizes)]))
            out: dict = {x.split()[0]: [] for x in ROW.split(", ")}
            at = 0
            for ids, names, g in held:
                n = len(ids)
                doc, h, c = g["tail"]
                order = np.lexsort((h, doc))
                doc, h, c = doc[order], h[order], c[order]
                new = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])])) if len(h) else np.zeros(0, int)
                times = np.diff(np.append(new, len(h)))
                ends = np.searchsorted(doc[new], np.arange(n + 1))
                lists = lambda v, kind: pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(v, kind)).to_pylist()  # noqa: B023, E731
                out["doc_id"] += ids
                out["t"] += names
                out["n_tokens"] += np.diff(g["bounds"]).tolist()
                out["known"] += g["known"].tolist()
                out["base"] += g["base"].tolist()
                out["score"] += (g["base"] + forward[at : at + n] + g["shared"] * math.log10(1 - counts.unknown)).tolist()
                out["tail"] += lists(h[new].view(np.int64), pa.int64())
                out["times"] += lists(times, pa.int32())
                out["mass"] += lists(np.log10(counts.mass[c[new]]), pa.float64())
                at += n
            return out

        for batch in batches:
            texts = batch.column(1).to_pylist()
            got = read(texts)
            held.append((batch.column(0).to_pylist(), [xxhash.xxh3_64_intdigest(t) - (1 << 63) for t in texts], got))
            size += len(got["cls"])
            if size > TOKENS:
                yield told(held)
                held, size = [], 0
        if held:
            yield told(held)

    return run


def scores(docs: DataFrame, model: Model, counts: Counts, words: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) for each document."""
    rows = cut(flat_batches(docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text")), _scored(model, counts), ROW))
    tail = rows.select("doc_id", "t", F.explode(F.arrays_zip("tail", "times", "mass")).alias("x")).select("doc_id", "t", F.col("x.tail").alias("h"), F.col("x.times").alias("n"), F.col("x.mass").alias("mass"))
    found = tail.join(words.select("h", "c"), "h", "left")
    norm, u = math.log10(counts.norm), counts.unknown
    base = F.log10(F.coalesce("c", F.lit(0)) + F.lit(SMOOTH)) - norm
    model_part = F.when(F.col("c").isNull(), F.col("mass") + math.log10(u)).otherwise(base + math.log10(1 - u))
    sums = found.groupBy("doc_id", "t").agg(F.sum(F.col("n") * base).alias("b"), F.sum(F.col("n") * model_part).alias("s"), F.sum(F.when(F.col("c").isNotNull(), F.col("n")).otherwise(0)).alias("k"))
    sums = sums.select(F.col("doc_id").alias("d2"), F.col("t").alias("t2"), "b", "s", "k")
    # rows that repeat id and text have their tails summed together
    alike = rows.groupBy("doc_id", "t").agg(F.count("*").alias("m")).where("m > 1").select(F.col("doc_id").alias("d3"), F.col("t").alias("t3"), "m")
    out = rows.drop("tail", "times", "mass")
    out = out.join(sums, out["doc_id"].eqNullSafe(sums["d2"]) & (out["t"] == sums["t2"]), "left").join(alike, F.col("doc_id").eqNullSafe(F.col("d3")) & (F.col("t") == F.col("t3")), "left")
    part = lambda c: F.coalesce(F.col(c) / F.coalesce("m", F.lit(1)), F.lit(0.0))
    return out.select(
        "doc_id", "n_tokens", (F.col("known") + part("k").cast("long")).alias("n_known"), F.lit(counts.tokens).cast("long").alias("train_tokens"), (F.col("base") + part("b")).alias("base_score"), (F.col("score") + part("s")).alias("score")
    )


def held_out(column: str = "doc_id", parts: int = 10) -> Column:
    return F.coalesce(F.crc32(F.col(column).cast("string")) % parts == 0, F.lit(False))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    training = docs.where(~held_out())
    words = vocabulary(training)
    counts = counts_of(words)
    return scores(docs, train(training, counts), counts, words).select("doc_id", held_out().alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
