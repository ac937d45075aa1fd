"""Canonical exact digests (operator 9).

A text is normalised (NFKC, case folding, white space folded to single spaces) and
digested by 128-bit xxhash.  Documents of equal digest form a bucket; within buckets
of several documents the canonical bytes themselves are compared, and where two
different texts shared a digest (never seen, but possible) the digest is extended by
a SHA-256 so that equal fingerprints mean equal canonical bytes.

Defined results: null text counts as empty; repeated rows and repeated ids are kept,
one output row for each input row; the order of equal ids is that of their texts;
null ids come first; an empty table gives an empty result; further columns of the
input are not carried (join on the id for them).
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, flat_batches, map_batches, maybe_broadcast, table, text_or_empty


def canonical(text: str) -> bytes:
    """NFKC, case folding and single spaces; the second NFKC composes what folding expanded."""
    if text.isascii():
        return " ".join(text.lower().split()).encode()
    folded = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())
    return " ".join(folded.split()).encode()


def digest(data: bytes) -> str:
    return xxhash.xxh3_128_hexdigest(data)


def collisions(docs: DataFrame, digests: DataFrame, text_col: str) -> DataFrame:
    """Digests (column fp) shared by different canonical texts, by comparing the bytes inside buckets.

    Only buckets of two or more documents are compared; grouping by (digest, bytes) combines
    copies before the shuffle, so a bucket of any size costs each task one row of it.
    """
    buckets = cut(digests.groupBy("fp").count().where("count > 1").select("fp"))

    def keyed(batch: pa.RecordBatch) -> dict:
        forms = [canonical(t) for t in batch.column(0).to_pylist()]
        return {"fp": [digest(c) for c in forms], "form": forms}

    forms = map_batches(docs.select(text_or_empty(text_col).alias("t")), keyed, "fp string, form binary")
    inside = forms.join(maybe_broadcast(buckets), "fp", "left_semi")
    return inside.groupBy("fp", "form").agg(F.lit(1).alias("one")).groupBy("fp").count().where("count > 1").select("fp")


def fingerprints(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with a column ``fingerprint``: equal exactly where canonical texts are equal."""

    def keyed(batch: pa.RecordBatch) -> dict:
        forms = [canonical(t) for t in batch.column(0).to_pylist()]
        return {"t": batch.column(0), "fp": [digest(c) for c in forms], "long": [hashlib.sha256(c).hexdigest() for c in forms]}

    shared = maybe_broadcast(cut(collisions(docs, map_batches(docs.select(text_or_empty(text_col).alias("t")), keyed, "t string, fp string, long string").select("fp"), text_col)))

    @F.pandas_udf("fp string, long string")
    def parts(texts):
        import pandas as pd

        forms = [canonical(t) for t in texts]
        return pd.DataFrame({"fp": [digest(c) for c in forms], "long": [hashlib.sha256(c).hexdigest() for c in forms]})

    out = docs.withColumn("_kinsieve_p", parts(text_or_empty(text_col)))
    out = out.join(shared.select(F.col("fp").alias("_kinsieve_fp")), F.col("_kinsieve_p.fp") == F.col("_kinsieve_fp"), "left")
    full = F.when(F.col("_kinsieve_fp").isNull(), F.col("_kinsieve_p.fp")).otherwise(F.concat("_kinsieve_p.fp", F.lit("-"), "_kinsieve_p.long"))
    return out.withColumn("fingerprint", full).drop("_kinsieve_p", "_kinsieve_fp")


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fp string, fp_long string, efp string, efp_long string, near_edited double, near_next double, edge string, text string, part int"


class _Row:
    """A document with its canonical form."""

    def __init__(self, doc_id: int | None, text: str):
        self.doc_id, self.text, self.form = doc_id, text, canonical(text)

    def against(self, after: _Row) -> list:
        """Its result given the next document."""
        cut_at = len(self.text) // 4
        edited = self.text[: len(self.text) - cut_at] + after.text[:cut_at]
        form = canonical(edited)
        same = lambda other: float(self.form == other)
        long = lambda f: hashlib.sha256(f).hexdigest()
        return [self.doc_id, len(self.text), hashlib.sha256(edited.encode()).hexdigest(), digest(self.form), long(self.form), digest(form), long(form), same(form), same(after.form)]


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Results for a sorted partition; its first and last row come out as edges, to be paired across partitions."""
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    before: _Row | None = None
    first: _Row | None = None
    for batch in batches:
        rows = []
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            now = _Row(doc_id, text)
            if before is None:
                first = now
            else:
                rows.append([*before.against(now), None, None, None])
            before = now
        if rows:
            yield dict(zip(names, zip(*rows, strict=True), strict=True))
    if first is not None and before is not None:
        ends = [[x.doc_id, *[None] * 8, edge, x.text, TaskContext.get().partitionId()] for edge, x in (("first", first), ("last", before))]
        yield dict(zip(names, zip(*ends, strict=True), strict=True))


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Pairs the last row of a partition with the first of the next one that has rows; they come one after the other."""
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    last: _Row | None = None
    for batch in batches:
        out = []
        for edge, doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if edge == "last":
                last = _Row(doc_id, text)
            else:
                out.append([*last.against(_Row(doc_id, text)), None, None, None])
        if out:
            yield dict(zip(names, zip(*out, strict=True), strict=True))


def edited_fingerprints(docs: DataFrame, partitions: int | None = None) -> DataFrame:
    """For each document its fingerprint, that of its edited text, and how they compare.

    The text is moved once: by ranges of the id.  Rows are then paired with their successor
    inside the sorted partition; a partition's last row is paired with the first of the next
    by their numbers, spread over the tasks.  Only the numbers of the partitions that have rows come to the driver.
    """
    n = partitions or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text")).repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    done = cut(flat_batches(ordered, _pairs, SCHEMA))
    used = sorted(r["part"] for r in done.where("edge = 'first'").select("part").collect())
    before = docs.sparkSession.createDataFrame([(p, used[k - 1]) for k, p in enumerate(used)], "part int, pair int")
    edges = done.where("edge is not null").join(F.broadcast(before), "part").withColumn("pair", F.when(F.col("edge") == "last", F.col("part")).otherwise(F.col("pair")))
    edges = edges.repartition(n, "pair").sortWithinPartitions("pair", F.col("edge").desc()).select("edge", "doc_id", "text")
    # the rows inside partitions are in done's checkpoint already; only those across partitions are added to it
    full = done.where("edge is null").unionByName(cut(flat_batches(edges, _edges, SCHEMA))).drop("part", "edge", "text")
    both = full.select("fp", "fp_long").unionByName(full.select(F.col("efp").alias("fp"), F.col("efp_long").alias("fp_long")))
    # edited texts are compared with all others by their second digest, documents with each other byte by byte
    differ = both.distinct().groupBy("fp").count().where("count > 1").select("fp")
    shared = maybe_broadcast(cut(collisions(docs, both.select("fp"), "text").unionByName(differ).distinct()))
    for name in ("fp", "efp"):
        full = full.join(shared.select(F.col("fp").alias(f"shared_{name}")), F.col(name) == F.col(f"shared_{name}"), "left")
        full = full.withColumn(name, F.when(F.col(f"shared_{name}").isNull(), F.col(name)).otherwise(F.concat(name, F.lit("-"), f"{name}_long")))
    return full.select("doc_id", "n_chars", "edited_sha256", F.col("fp").alias("fingerprint"), F.col("efp").alias("edited_fingerprint"), "near_edited", "near_next")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(table(spark, sf_dir, "documents"))
