"""Packing along a space-filling curve (operator 2).

Each document is tokenised once.  Its token counts, hashed into a vector and projected by
random signs to four dimensions, give a point; points are ranked on each axis against
fixed normal quantiles and numbered along a Hilbert curve.  Documents are dealt to tasks
by ranges of (curve key, hash of the id), even in documents and tokens, sorted, and packed one after another into
sequences of 2048 tokens; documents are cut where a sequence is full, so only the last
sequence of a range is padded.

A worker holds half a mebibyte of text, or one longer text, at about 25 times its bytes, and CACHE_BYTES of ids.

Defined results: null text counts as empty (its one token is the end id); repeated rows
are packed each; equal keys are ordered by hash, id and text digest; an empty table gives
an empty result; other columns are not carried.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import HELD, flat_batches, map_batches, table, text_or_empty

SEQUENCE, END, AXES, BITS, FEATURES = 2048, 1, 4, 7, 1024
#: Documents to a range, and ranges at most: beyond that the ranges grow, and Spark sorts them with spilling.
RANGE_DOCS, MOST_RANGES = 8_192, 100_000
#: Documents from which the bounds of the ranges are taken (a sample by a hash of the id): at least so many, and so many
#: for each range, hence 4 million at most.  Every document is packed.
SAMPLE, SAMPLE_RANGE = 5_000, 40
CACHE_BYTES = 144 << 20


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Tokens:
    """Ids of the byte-level BPE, by pieces between spaces.

    A space before a non-space always begins a new piece of the pre-tokeniser, so such
    pieces are encoded alone and kept in a bounded cache; texts with other white space
    next to a space, or with the text of a special token, are encoded whole.
    """

    def __init__(self, path: str):
        import tiktoken
        from public_tokenizers import PATTERN

        self.path, self._whole = path, None
        ranks = path.removesuffix(".json") + ".tiktoken"
        pairs = map(bytes.split, open(ranks, "rb"))  # noqa: SIM115
        self.encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in pairs}, special_tokens={})
        self.uneven = re.compile(r" (?:\s|$)")
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}  # what was known before the cache was last full; words met again move over
        self.room = CACHE_BYTES // 2

    @property
    def whole(self):
        """The tokenizer itself, loaded where a text first needs it."""
        if self._whole is None:
            from tokenizers import Tokenizer

            self._whole = Tokenizer.from_file(self.path)
        return self._whole

    def encode(self, text: str) -> bytes:
        """Ids as little-endian 16-bit numbers (the vocabulary has 50,257)."""
        if "<|" in text:
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u2").tobytes()
        if self.uneven.search(text):
            return np.array(self.encoding.encode_ordinary(text), "<u2").tobytes()
        first, *words = text.split(" ")
        cache, parts = self.cache, [np.array(self.encoding.encode_ordinary(first), "<u2").tobytes()]
        for w in words:
            if (ids := cache.get(w)) is None:
                if (ids := self.older.get(w)) is None:
                    ids = np.array(self.encoding.encode_ordinary(" " + w), "<u2").tobytes()
                if len(w) < 32:
                    self.room -= 200 + 2 * len(w) + len(ids)
                    if self.room < 0:
                        self.older, cache, self.room = cache, {}, CACHE_BYTES // 2
                        self.cache = cache
                    cache[w] = ids
            parts.append(ids)
        return b"".join(parts)


def tokens(path: str) -> Tokens:
    """One tokenizer for each worker process, until the process does something else."""
    if path not in HELD:
        HELD[path] = Tokens(path)
    return HELD[path]


_SIGNS = np.random.default_rng(3).choice([-1.0, 1.0], (FEATURES, AXES))


def point(ids: np.ndarray) -> np.ndarray:
    """Hashed counts of the ids, projected to AXES dimensions and scaled to unit variance."""
    slot = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(54)).astype(np.int64)
    counts = np.sqrt(np.bincount(slot, minlength=FEATURES))
    norm = np.linalg.norm(counts)
    return counts @ _SIGNS / norm if norm else np.zeros(AXES)


def hilbert(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Index along the Hilbert curve of integer points (rows of cells), by Skilling's transposition (2004)."""
    x = cells.astype(np.int64).T.copy()
    n, q = len(x), 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            high = (x[i] & q) != 0
            swap = (x[0] ^ x[i]) & p
            x[0] = np.where(high, x[0] ^ p, x[0] ^ swap)
            if i:
                x[i] = np.where(high, x[i], x[i] ^ swap)
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t, q = np.zeros_like(x[0]), 1 << (bits - 1)
    while q > 1:
        t = np.where((x[n - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = key << 1 | (x[i] >> b & 1)
    return key


def keys(points: np.ndarray) -> np.ndarray:
    """Curve keys of points; each axis is cut at equal steps of a squashed scale, so that cells fill evenly."""
    squashed = 1 / (1 + np.exp(-1.7 * np.nan_to_num(points)))
    return hilbert(np.minimum((squashed * (1 << BITS)).astype(np.int64), (1 << BITS) - 1))


def _tokenised(docs: DataFrame, path: str, bounds: list[int] | None) -> DataFrame:
    """(doc_id, place, bucket, ids, n): place is the curve key, then 32 bits of a hash of the id; without bounds, ids are left out."""

    def run(batch: pa.RecordBatch) -> dict:
        t = tokens(path)
        raw = [t.encode(x) + b"\x01\x00" for x in batch.column(1).to_pylist()]
        key = keys(np.array([point(np.frombuffer(r, "<u2")) for r in raw]))
        tail = np.array([xxhash.xxh32_intdigest(str(i)) for i in batch.column(0).to_pylist()], np.int64)
        place = key << 32 | tail
        bucket = np.searchsorted(np.array(bounds or [], np.int64), place, side="right")
        ids = [b""] * len(raw) if bounds is None else raw
        return {"doc_id": batch.column(0), "place": place, "bucket": bucket, "ids": ids, "n": [len(r) // 2 for r in raw]}

    return map_batches(docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text")), run, "doc_id long, place long, bucket int, ids binary, n long", keep=True)


def _bounds(place: np.ndarray, n: np.ndarray, ranges: int) -> list[int]:
    """Bounds between ranges that are even in documents and tokens together, so none has over twice its share of either.

    Documents of much text lie close to each other on the curve, so ranges of as many documents differ in tokens.
    """
    if not len(place):
        return []
    order = np.argsort(place, kind="stable")
    load = np.cumsum(1 / len(n) + n[order] / n.sum())
    return np.unique(place[order][np.searchsorted(load, load[-1] * np.arange(1, ranges) / ranges)]).tolist()


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _packed(size: int):
    names = [x.split()[0] for x in PIECES.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        bucket, filled = None, 0
        for batch in batches:
            out = []
            for doc_id, b, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if b != bucket:
                    bucket, filled = b, 0
                ids = np.frombuffer(raw, "<u2").astype("<u4")
                start = 0
                while start < len(ids):
                    n = min(size - filled % size, len(ids) - start)
                    out.append((doc_id, start, n, zlib.crc32(ids[start : start + n].tobytes()), len(ids), (b << 40) + filled // size, filled % size))
                    start, filled = start + n, filled + n
            if out:
                yield dict(zip(names, zip(*out, strict=True), strict=True))

    return run


def pack(docs: DataFrame, path: str | None = None, size: int = SEQUENCE) -> DataFrame:
    """One row for each piece of a document in a sequence.

    Only the sample that places the range bounds is tokenised twice.  The bounds come from
    a hash-chosen sample, so reruns agree; hot keys (copies) are spread by the id's hash.
    """
    path = path or vocabulary()
    n = docs.count()
    ranges = min(MOST_RANGES, max(1, -(-n // RANGE_DOCS)))
    bounds: list[int] = []
    if ranges > 1:
        share = max(1, n // max(SAMPLE, SAMPLE_RANGE * ranges))
        some = docs.where(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(share)) == 0)
        seen = _tokenised(some, path, None).select("place", "n").toArrow()
        bounds = _bounds(seen["place"].to_numpy(), seen["n"].to_numpy(), ranges)
    # each range is a partition of its own, by its number: a hash of the number would leave some empty and fill others twice
    dealt = _tokenised(docs, path, bounds).drop("n").repartitionById(len(bounds) + 1, F.col("bucket"))
    ordered = dealt.sortWithinPartitions("bucket", "place", "doc_id", F.xxhash64("ids")).select("doc_id", "bucket", "ids")
    return flat_batches(ordered, _packed(size), PIECES)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
