"""Content-defined chunking of media columns (operator 10).

A payload is stored as 8-bit PCM in a WAV container.  Its bytes are cut where a
rolling gear hash (32-byte window) has zero top bits; chunks are named by digest,
deduplicated by a Spark aggregation into a chunk store, and each distinct medium is an
ordered list of digests.  Reading back joins the lists with the store, puts the chunks
together, checks the digest and parses the container again; features come from the
samples read back.

Defined results: null text counts as empty (one block of spaces); repeated rows give
repeated results; an empty table gives an empty result; a missing or damaged chunk
raises an error instead of a wrong result.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, flat_batches, map_batches, table, text_or_empty

BLOCK, RATE = 192, 8000
MIN_CHUNK, MAX_CHUNK, CUT_BITS = 2048, 32768, 12
#: Chunks travel compressed by zstd with a dictionary of so many bytes, trained on so many documents (by a hash of the id); it changes no result.
DICTIONARY, DICTIONARY_DOCS, LEVEL = 1 << 16, 1_500, 19
_GEAR = np.random.default_rng(7).integers(0, 1 << 32, 256, dtype=np.uint32)


def payload_of(text: str) -> bytes:
    data = text.encode()
    return data.ljust(max(BLOCK, -(-len(data) // BLOCK) * BLOCK))


def encode(payload: bytes) -> bytes:
    """WAV container, one channel of unsigned 8-bit samples."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1), w.setsampwidth(1), w.setframerate(RATE)
        w.writeframes(payload)
    return out.getvalue()


def decode(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as r:
        return r.readframes(r.getnframes())


def cuts(data: bytes) -> list[int]:
    """Ends of the chunks.  The gear hash of every position is summed up by doubling the window."""
    n = len(data)
    if n <= MIN_CHUNK:
        return [n]
    h = _GEAR[np.frombuffer(data, np.uint8)]
    for width in (1, 2, 4, 8, 16):
        h[width:] += h[:-width] << np.uint32(width)
    out, last = [], 0
    for p in (np.flatnonzero(h >> np.uint32(32 - CUT_BITS) == 0) + 1).tolist():
        while p - last > MAX_CHUNK:
            last += MAX_CHUNK
            out.append(last)
        if p - last >= MIN_CHUNK and p < n:
            out.append(last := p)
    while n - last > MAX_CHUNK:
        last += MAX_CHUNK
        out.append(last)
    return [*out, n]


def chunks(data: bytes) -> list[bytes]:
    ends = cuts(data)
    return [data[a:b] for a, b in zip([0, *ends], ends)]  # noqa: B905


def feature(samples: bytes) -> str:
    """Mean, deviation, mean step, zero crossings, and a 16-step envelope of the samples."""
    x = np.frombuffer(samples, np.uint8).astype(np.int64)
    centred = x - 128
    crossings = int(np.count_nonzero(np.diff(centred >= 0)))
    envelope = np.add.reduceat(np.abs(centred), np.linspace(0, len(x), 17)[:-1].astype(int)) // max(1, len(x) // 16)
    return f"{x.mean():.4f},{x.std():.4f},{np.abs(np.diff(x)).mean():.4f},{crossings}," + bytes(np.minimum(envelope, 255).astype(np.uint8)).hex()


def manifests(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, medium, parts): for each document the digest of its stored form and its ordered chunk list."""

    def listed(batch: pa.RecordBatch) -> dict:
        out: dict = {"doc_id": batch.column(0), "n_bytes": [], "medium": [], "parts": []}
        for text in batch.column(1).to_pylist():
            media = encode(payload_of(text))
            out["n_bytes"].append(len(text.encode()))
            out["medium"].append(hashlib.sha256(media).digest())
            out["parts"].append([xxhash.xxh3_128_digest(c) for c in chunks(media)])
        return out

    return map_batches(docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text")), listed, "doc_id long, n_bytes long, medium binary, parts array<binary>")


def dictionary(docs: DataFrame) -> bytes:
    """Compression dictionary from a bounded sample of the documents; empty where there are too few."""
    share = max(1, docs.count() // DICTIONARY_DOCS)
    some = docs.where(F.pmod(F.xxhash64("doc_id", F.lit(6)), F.lit(share)) == 0).orderBy(F.xxhash64("doc_id"), "doc_id").limit(DICTIONARY_DOCS)
    samples = [r[0].encode() for r in some.select(F.substring(text_or_empty(), 1, 16_384)).collect()]
    try:
        return zstandard.train_dictionary(DICTIONARY, samples).as_bytes()
    except zstandard.ZstdError:
        return b""


def chunk_store(docs: DataFrame, words: bytes = b"") -> DataFrame:
    """(part, chunk): each distinct chunk once, compressed.  A task passes each chunk on once, so copies don't gather."""

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        known = zstandard.ZstdCompressionDict(words) if words else None
        if known:
            known.precompute_compress(level=LEVEL)
        pack, seen = zstandard.ZstdCompressor(level=LEVEL, dict_data=known), set()
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                found: dict[bytes, bytes] = {}
                for text in batch.column(0).slice(at, 200).to_pylist():
                    for c in chunks(encode(payload_of(text))):
                        if (name := xxhash.xxh3_128_digest(c)) not in seen:
                            seen.add(name)
                            found[name] = pack.compress(c)
                if len(seen) > 2_000_000:  # forgetting only lets a chunk pass again
                    seen.clear()
                if found:
                    yield {"part": list(found), "chunk": list(found.values())}

    return flat_batches(docs.select(text_or_empty().alias("text")), cut_up, "part binary, chunk binary").dropDuplicates(["part"])


MEDIA = "medium binary, payload_bytes long, payload binary, tail_crc32 long, media_bytes long, feature string"


def read_back(lists: DataFrame, store: DataFrame, words: bytes = b"") -> DataFrame:
    """One row of MEDIA for each distinct medium of lists (medium, parts), from the chunks of the store."""
    single = lists.groupBy("medium").agg(F.first("parts").alias("parts"))
    wanted = single.select("medium", F.size("parts").alias("n"), F.posexplode("parts").alias("seq", "part"))
    found = wanted.join(store, "part", "left").select("medium", "n", "seq", "chunk")
    n = int(lists.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = found.repartition(n, "medium").sortWithinPartitions("medium", "seq")
    names = [x.split()[0] for x in MEDIA.split(", ")]

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        unpack, now, parts = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(words) if words else None), None, []
        for batch in batches:
            rows = []
            for medium, n_parts, seq, chunk in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if medium != now:
                    now, parts = medium, []
                if chunk is None or seq != len(parts):
                    raise ValueError(f"chunk {seq} of medium {medium.hex()} is missing from the store")
                parts.append(unpack.decompress(chunk))
                if len(parts) == n_parts:
                    media = b"".join(parts)
                    if hashlib.sha256(media).digest() != medium:
                        raise ValueError(f"medium {medium.hex()} is damaged")
                    payload = decode(media)
                    rows.append((medium, len(payload), hashlib.sha256(payload).digest(), zlib.crc32(payload[-16:]), len(media), feature(payload)))
            if rows:
                yield dict(zip(names, zip(*rows, strict=True), strict=True))

    return flat_batches(ordered, joined, MEDIA)


def media_columns(docs: DataFrame) -> DataFrame:
    lists = cut(manifests(docs))
    words = dictionary(docs)
    read = read_back(lists.select("medium", "parts"), chunk_store(docs, words), words)
    names = [F.lower(F.hex(c)).alias(n) for c, n in (("payload", "payload_sha256"), ("medium", "media_sha256"))]
    return lists.select("doc_id", "n_bytes", "medium").join(read, "medium").select("doc_id", "n_bytes", "payload_bytes", names[0], "tail_crc32", "media_bytes", names[1], "feature")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_columns(table(spark, sf_dir, "documents"))
