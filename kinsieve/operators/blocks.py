"""Exact set-similarity join of long sequences, with k-mers as 64-bit hashes in packed blocks.

A sequence's k-mers are extracted by array operations.  Sets of Jaccard similarity t or more share
at least l of the first n - ceil(t n) + l k-mers of each in any common order (prefix filter; with l > 1 chance
pairs drop out).  The order is by rising frequency in a sample, then by hash: it decides the cost, not the result.
Prefixes travel as blocks of 32-bit hashes, where a collision can only add a candidate; candidates are confirmed on
full sets.  Near copies are linked through band pivots first and don't meet again, so no group is expanded into all pairs.
Blocks meet in ROUNDS, each with a share of the buckets, so no more than that share of the prefixes is on disk at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinsieve.operators import graph

#: Sequences, of which k-mer frequencies are counted in SLOTS slots for the order; bands of the pivots and hashes in each.
SAMPLE, SLOTS, BANDS, ROWS = 4_000, 1 << 24, 8, 3
#: Of the smaller set, the share of k-mers that both prefixes must have in common; hashes in a block; length from which runs of a hash are paired one by one.
SHARE, BLOCK, LONG_RUN = 1 / 16, 1 << 20, 64
#: Rounds of the prefix join; bytes up to which a table of keys is broadcast, so that the sequences aren't shuffled to it.
ROUNDS, SMALL = 2, 32 << 20
#: Pieces of a bucket's rows whose pairs are counted one after the other.
PIECES = 32
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"

_RNG = np.random.default_rng(9)
_M = _RNG.integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STARTS = np.arange(BANDS * ROWS, dtype=np.uint64) * np.uint64((1 << 64) // (BANDS * ROWS))


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def kmer_set(seq: str, k: int) -> np.ndarray:
    """The sorted hashes of a sequence's distinct k-mers, by code points."""
    a = np.frombuffer(seq.encode("utf-32-le"), "<u4").astype(np.uint64)
    if len(a) < k:
        return np.zeros(0, np.uint64)
    h, w = a, 1  # h: hashes of w code points, doubled or lengthened by one until w = k
    for bit in bin(k)[3:]:
        h, w = h[:-w] * np.uint64(pow(int(_M[0]), w, 1 << 64)) + h[w:], 2 * w
        if bit == "1":
            h, w = h[:-1] * _M[0] + a[w:], w + 1
    h = np.sort(_mix(h))  # np.unique of integers goes through a hash table, several times slower
    return h[np.concatenate([[True], h[1:] != h[:-1]])]


def _mapped(df: DataFrame, fn, schema: str) -> DataFrame:
    """mapInArrow of a function over the stream of row slices to dicts of columns."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    fields = _parse_datatype_string(schema)
    arrow = to_arrow_schema(fields)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                yield batch.slice(at, 64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in fn(rows(batches)):
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, fields)


def _slots(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(40)).astype(np.int64)


def frequencies(records: DataFrame, total: int, k: int) -> np.ndarray:
    """Counts (up to 255) of the k-mers of a sample, by slot of the hash."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        own = np.zeros(SLOTS, np.uint8)
        for batch in batches:
            for seq in batch.column(0).to_pylist():
                at = np.unique(_slots(kmer_set(seq, k)))
                own[at] += own[at] < 255
        yield {"c": [own.tobytes()]}

    some = records.where(F.pmod(F.xxhash64("rid", F.lit(7)), F.lit(1 << 20)) < (SAMPLE << 20) // max(1, total)).select("seq").coalesce(4)
    out = np.zeros(SLOTS, np.uint16)
    for r in _mapped(some, count, "c binary").toLocalIterator():
        out += np.frombuffer(r["c"], np.uint8)
    return np.minimum(out, 255).astype(np.uint8)


def _small(keys: DataFrame, width: int = 24) -> DataFrame:
    """A materialised table of keys of so many bytes a row, marked for a broadcast if it is small."""
    return F.broadcast(keys) if keys.count() * width <= SMALL else keys


def confirmed(records: DataFrame, pairs: DataFrame, k: int, threshold: float) -> DataFrame:
    """(a, b, score) of distinct pairs (a, b) at or over the threshold, on full sets."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        last, y = None, None
        for batch in batches:
            a, b, sa, sb = (c.to_pylist() for c in batch.columns)
            scores = []
            for i in range(len(a)):
                x = kmer_set(sa[i], k)
                if last != b[i]:
                    last, y = b[i], kmer_set(sb[i], k)
                c = len(np.intersect1d(x, y, assume_unique=True))
                scores.append(c / (len(x) + len(y) - c) if c else 0.0)
            yield {"a": a, "b": b, "score": scores}

    asked = graph.cut(pairs.select(F.explode(F.array("a", "b")).alias("rid")).distinct())
    seqs = records.select("rid", "seq").join(_small(asked), "rid", "left_semi")
    both = pairs.join(seqs.toDF("a", "sa"), "a").join(seqs.toDF("b", "sb"), "b").select("a", "b", "sa", "sb")
    return graph.cut(_mapped(both, score, "a long, b long, score double").where(F.col("score") >= threshold))


def pivot_pairs(records: DataFrame, k: int) -> DataFrame:
    """(a, b), a < b: each record with the least record of each of its bands.

    A band is of ROWS minima, each the least hash from a start of its own on (around the end, if there is none).
    """

    def bands(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            ids, keys = [], []
            for rid, seq in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                h = kmer_set(seq, k)
                if not len(h):
                    continue
                least = h[np.searchsorted(h, _STARTS) % len(h)].reshape(ROWS, BANDS).T
                key = np.arange(1, BANDS + 1, dtype=np.uint64)
                for j in range(ROWS):
                    key = _mix(key ^ least[:, j] * _M[j])
                ids.append(rid), keys.append(key.view(np.int64).tolist())
            yield {"rid": ids, "keys": keys}

    rows = graph.cut(_mapped(records.select("rid", "seq"), bands, "rid long, keys array<long>")).select("rid", F.explode("keys").alias("key"))
    pivots = rows.groupBy("key").agg(F.min("rid").alias("a"), F.count("*").alias("c")).where("c > 1").drop("c")
    return graph.cut(rows.join(pivots, "key").where("a < rid").select("a", F.col("rid").alias("b")).distinct())


def _prefix(h: np.ndarray, counts: np.ndarray, threshold: float) -> np.ndarray:
    n = len(h)
    size = n - int(np.ceil(n * threshold - 1e-9)) + max(1, int(n * SHARE))
    return h[np.argsort(counts[_slots(h)], kind="stable")[:size]]


def _meet(root: np.ndarray, n: np.ndarray, both: np.ndarray, low: int, threshold: float, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows (root, n; by rising n) of a bucket that share enough of its tokens.

    both: sorted; of each token 32 bits, its row, and in the low bits its place in the row's order as a fraction of n,
    rounded down.  At the threshold a pair has c k-mers in common at least, so the first l of those lie before place
    n - c + l of either; tokens further on needn't be counted.
    """
    same = (both[1:] ^ both[:-1]) < np.uint64(1 << 32)
    both = both[np.concatenate([same, [False]]) | np.concatenate([[False], same])]
    token, own = (both >> np.uint64(32)).astype(np.uint32), ((both & np.uint64(0xFFFFFFFF)) >> np.uint64(low)).astype(np.int32)
    place = (both & np.uint64((1 << low) - 1)).astype(np.uint8)
    new = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]])[: len(token)])
    size = np.diff(np.append(new, len(token)))
    end = np.repeat((new + size).astype(np.int32), size)

    def kept(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Codes of the rows of tokens x and y, x before y."""
        r, s = own[x], own[y]
        nr, ns = n[r], n[s]
        room = np.maximum(1, (nr * SHARE).astype(np.int64)) - np.ceil((nr + ns) * (threshold / (1 + threshold)) - 1e-6).astype(np.int64)
        ok = (root[r] != root[s]) & (nr >= ns * threshold - 1e-9) & (place[x] * nr >> low < nr + room) & (place[y] * ns >> low < ns + room)
        return r[ok] * np.int64(len(n)) + s[ok]

    hot = [np.zeros(0, np.int64)]
    for at, m in zip(new[size > LONG_RUN].tolist(), size[size > LONG_RUN].tolist(), strict=True):
        _, inverse, each = np.unique(root[own[at : at + m]], return_inverse=True, return_counts=True)
        if 2 * each.max() > m:  # mostly of one root, which doesn't meet itself
            end[at : at + m] = 0
            top = inverse == each.argmax()
            rest, most = at + np.flatnonzero(~top), at + np.flatnonzero(top)
            for i, x in enumerate(rest):
                other = np.concatenate([rest[i + 1 :], most])
                hot.append(kept(np.minimum(x, other), np.maximum(x, other)))
    hot, out = np.concatenate(hot), []
    before = np.cumsum(np.bincount(own, minlength=len(n)))
    cuts = np.append(np.searchsorted(before, np.arange(PIECES) * (len(own) / PIECES), side="right"), len(n)) if len(own) else [0, len(n)]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):  # all pairs of a smaller row in [a, b)
        found = [hot[(hot >= a * len(n)) & (hot < b * len(n))]]
        x, d = np.flatnonzero((own >= a) & (own < b)), 0
        while len(x):
            d += 1
            x = x[x + d < end[x]]
            x = x[n[own[x]] >= n[own[x + d]] * threshold - 1e-9]  # what follows in the run is larger still
            found.append(kept(x, x + d))
        codes, c = np.unique(np.concatenate(found), return_counts=True)
        # prefixes that share l in all share at least l / buckets in one bucket
        out.append(codes[c * buckets >= np.maximum(1, (n[codes // len(n)] * SHARE).astype(np.int64))])
    codes = np.concatenate(out)
    return codes // len(n), codes % len(n)


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h >> np.uint64(32)) % np.uint64(buckets)).astype(np.int32)


def prefix_pairs(records: DataFrame, k: int, threshold: float, counts: np.ndarray, buckets: int, part: int = 0, parts: int = 1) -> DataFrame:
    """(a, b), a < b, of records (rid, seq, root) of different roots whose prefixes share enough in a bucket (of every parts-th, from part on)."""
    held = records.sparkSession.sparkContext.broadcast(counts)
    schema = "bucket int, rid array<long>, root array<long>, n array<int>, m array<int>, token binary, place binary"

    def split(rows: list[tuple[int, int, int, np.ndarray, np.ndarray]]) -> dict:
        out: dict[str, list] = {x.split()[0]: [] for x in schema.split(", ")}
        h, place = (np.concatenate([r[i] for r in rows]) for i in (3, 4))
        own = np.repeat(np.arange(len(rows)), [len(r[3]) for r in rows])
        bucket = _bucket(h, buckets)
        order = np.argsort(bucket.astype(np.uint16) if buckets < 1 << 16 else bucket, kind="stable")  # of 16 bits it is a radix sort
        h, own, place = h[order].astype("<u4"), own[order], place[order]
        cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
        rid, root, n = (np.array([r[i] for r in rows], np.int64) for i in range(3))
        for b in range(part, buckets, parts):
            some, m = np.unique(own[cuts[b] : cuts[b + 1]], return_counts=True)
            if len(some):
                for name, x in zip(out, (b, rid[some], root[some], n[some], m, *(x[cuts[b] : cuts[b + 1]].tobytes() for x in (h, place))), strict=True):
                    out[name].append(x)
        return out

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        rows, held_tokens = [], 0
        for batch in batches:
            for rid, root, seq in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                h = kmer_set(seq, k)
                if len(h):
                    prefix = _prefix(h, held.value, threshold)
                    place = (np.arange(len(prefix)) * 256 // len(h)).astype(np.uint8)
                    mine = _bucket(prefix, buckets) % parts == part
                    rows.append((rid, root, len(h), prefix[mine], place[mine]))
                    held_tokens += len(rows[-1][3])
                if held_tokens >= BLOCK:
                    yield split(rows)
                    rows, held_tokens = [], 0
        if rows:
            yield split(rows)

    def joined(parts: list[tuple]) -> dict:
        rid, root, n, m = (np.concatenate([p[i] for p in parts]) for i in range(4))
        order = np.argsort(n, kind="stable")
        rank = np.empty(len(n), np.uint64)
        rank[order] = np.arange(len(n), dtype=np.uint64)
        low = max(0, min(8, 32 - len(n).bit_length()))
        both, row, at = np.empty(m.sum(), np.uint64), 0, 0
        while parts:  # each part's bytes are given up when they are taken over
            _, _, _, m, token, place = parts.pop(0)
            here = both[at : at + m.sum()]
            here[:] = np.frombuffer(token, "<u4")
            here <<= np.uint64(32)
            here |= np.repeat(rank[row : row + len(m)] << np.uint64(low), m)
            here |= np.frombuffer(place, np.uint8) >> np.uint8(8 - low)
            row, at = row + len(m), at + len(here)
        both.sort()
        rid = rid[order]
        x, y = _meet(root[order], n[order].astype(np.int64), both, low, threshold, buckets)
        return {"a": np.minimum(rid[x], rid[y]), "b": np.maximum(rid[x], rid[y])}

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        at, parts = None, []
        for batch in batches:
            for i in range(batch.num_rows):
                if batch.column(0)[i].as_py() != at and parts:
                    yield joined(parts)
                    parts = []
                at = batch.column(0)[i].as_py()
                parts.append((*(np.array(batch.column(c)[i].values) for c in range(1, 5)), *(batch.column(c)[i].as_py() for c in (5, 6))))
        if parts:
            yield joined(parts)

    packed = _mapped(records.select("rid", "root", "seq"), blocks, schema).repartition(buckets, "bucket").sortWithinPartitions("bucket")
    return _mapped(packed, meet, "a long, b long").where("a < b").distinct()


def linked_roots(records: DataFrame, k: int, threshold: float) -> DataFrame:
    """(rid, root) of records (rid, seq): components under equality, and under Jaccard similarity of k-mers at or over the threshold.

    The sequences are read by every step, so they are written once, as Parquet beside the checkpoints, and deleted at the
    end.  Steps join short tables to them and shuffle no more than the sequences of candidates.
    """
    spark = records.sparkSession
    buckets = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    path, batch = graph.shared_path(spark), spark.conf.get(BATCH)
    try:
        spark.conf.set(BATCH, 64)  # rows, as many as are taken up at a time: a block has about 0.1 MB
        records.select("rid", "seq", F.unhex(F.sha2("seq", 256)).alias("key")).repartition(buckets, "rid").write.option("compression", "zstd").parquet(path)
        graph.release(spark)
        own = spark.read.parquet(path)
        first = graph.cut(own.groupBy("key").agg(F.min("rid").alias("first")))
        copies = graph.cut(own.select("rid", "key").join(first, "key").where("rid <> first").select("rid", "key"))
        held = own.join(_small(copies, 100), ["rid", "key"], "left_anti").select("rid", "seq")
        links = confirmed(held, pivot_pairs(held, k), k, threshold)
        moved = _small(graph.cut(graph.component_labels(held, links).where("root <> rid")))
        rooted = held.join(moved, "rid", "left").select("rid", F.coalesce("root", "rid").alias("root"), "seq")
        counts, found = frequencies(held, first.count(), k), None
        graph.release(spark)
        for part in range(min(ROUNDS, buckets)):
            some = graph.cut(prefix_pairs(rooted, k, threshold, counts, buckets, part, min(ROUNDS, buckets)))
            graph.release(spark)
            found = some if found is None else found.unionByName(some)
        links = links.unionByName(confirmed(held, found.distinct(), k, threshold))
        roots = graph.component_labels(first.select(F.col("first").alias("rid")), links)
        return graph.cut(own.select("rid", "key").join(first.join(roots.toDF("first", "root"), "first"), "key").select("rid", "root"))
    finally:
        spark.conf.set(BATCH, batch)
        graph.remove(spark, path)
