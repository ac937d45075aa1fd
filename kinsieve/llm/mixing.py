"""Mixing sources to target weights (operator 8).

Documents are counted by exact length for each source.  A source takes whole copies of
all its documents as far as its target allows.  Of the remaining budget each length gets its
proportional share of documents, and what a length leaves over is passed on to the next
shorter one, down to a reserve of twice the longest document; a bounded knapsack over the
lengths (binary splitting of the counts) then brings the rest as near to the budget as sums
of lengths can.  Which documents of a length are taken is decided by a seeded hash.

The knapsack's table has one number for each word of the rest, so its memory is 24 bytes a
word of the longest document; a plan sees one row for each length of its source.

Defined results: null text has size 0; documents of size 0 take 0 words; a null source is
a source of its own, last in order; repeated rows count each; equal hashes are ordered by
id and text; an empty table gives an empty result; other columns are kept by ``mix``.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ROW, cut, join_counted, maybe_broadcast, on_texts, packed, table, text_or_empty, unpacked

WEIGHTS, MOST_COPIES, SEED, HASH_BUCKETS = (5, 2, 1), 3, 20240601, 256


def size_of(column: str = "text") -> Column:
    """Words of a text; bytes are split at exactly the six separators, many times faster than by a pattern."""

    return on_texts(lambda texts: [len(t.encode().split()) for t in texts], pa.int64(), text_or_empty(column))


def targets(sources: DataFrame, most: float = MOST_COPIES) -> DataFrame:
    """sources (words, weight, ...) with ``target``: shares of all words by weight, none above ``most`` times its own, the excess shared again by weight.

    A source is full once the level, words a unit of weight, reaches its most.  The level only
    rises, so each round is one aggregation, and there are few rounds.
    """
    level = -1.0
    full = lambda at: F.col("words") * most <= F.col("weight") * F.lit(at)
    while True:
        open_ = ~full(level) & (F.col("words") > 0)
        row = sources.agg(F.sum("words").cast("double"), F.sum(F.when(open_, 0.0).otherwise(F.col("words") * most)), F.sum(F.when(open_, F.col("weight")))).first()
        if not row[0] or not row[2]:
            break
        before, level = level, (row[0] - row[1]) / row[2]
        if level <= before:
            break
    return sources.withColumn("target", F.least(F.col("words") * float(most), F.col("weight") * F.lit(max(level, 0.0))))


def knapsack(lengths: list[int], counts: list[int], budget: int) -> list[int]:
    """How many of each length to take so that the sum is as near to budget as possible without passing it, by bounded dynamic programming.

    For each reachable sum the table keeps the item that first reached it; an item is a binary part of a count.
    """
    out = [0] * len(lengths)
    if budget <= 0 or not lengths:
        return out
    by = np.full(budget + 1, -1, np.int32)  # item that reached the sum; the empty sum needs none
    by[0], items = 0, [(0, 0)]
    for k, (length, count) in enumerate(zip(lengths, counts, strict=True)):
        count, part = min(count, budget // length), 1
        while count > 0:
            part = min(part, count)
            step = part * length
            new = np.flatnonzero((by[step:] < 0) & (by[:-step] >= 0)) + step
            by[new] = len(items)
            items.append((k, part))
            count, part = count - part, part * 2
        if by[budget] >= 0:
            break
    at = int(np.flatnonzero(by >= 0)[-1])
    while at:
        k, part = items[by[at]]
        out[k] += part
        at -= part * lengths[k]
    return out


def plan(lengths: np.ndarray, counts: np.ndarray, target: float) -> tuple[int, np.ndarray]:
    """(copies of every document, further documents of each length) for one source."""
    order = np.argsort(-lengths, kind="stable")
    lengths, counts = lengths[order].astype(np.int64), counts[order].astype(np.int64)
    all_words = int((lengths * counts).sum())
    extra = np.zeros(len(lengths), np.int64)
    if all_words == 0:
        return 0, extra
    copies = min(MOST_COPIES, int(target // all_words))
    budget = round(target) - copies * all_words
    if copies < MOST_COPIES and budget > 0:
        rest = min(budget, 2 * int(lengths[0]))  # for the knapsack
        share, over = (budget - rest) / all_words, 0.0
        for k in np.flatnonzero(lengths > 0):
            own = counts[k] * share + over / lengths[k]
            extra[k] = min(int(counts[k]), int(own + 1e-9))
            over = max(0.0, (own - extra[k]) * lengths[k])
        rest = budget - int((extra * lengths).sum())
        use = [k for k in range(len(lengths)) if 0 < lengths[k] <= rest and counts[k] > extra[k]]
        for k, n in zip(use, knapsack([int(lengths[k]) for k in use], [int(counts[k] - extra[k]) for k in use], rest), strict=True):
            extra[k] += n
    out = np.zeros(len(lengths), np.int64)
    out[order] = extra
    return copies, out


def _numbered(sources: DataFrame) -> DataFrame:
    """sources with ``no``, their place by code point, null last: ranges are numbered apart and shifted by the counts before them."""
    n = int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = cut(sources.repartitionByRange(n, F.col("source").asc_nulls_last()).withColumn("p", F.spark_partition_id()))
    ranges = placed.groupBy("p").agg(F.count("*").alias("c"))
    base = ranges.select("p", (F.sum("c").over(Window.orderBy("p")) - F.col("c")).alias("base"))  # one row for each range
    own = F.row_number().over(Window.partitionBy("p").orderBy(F.col("source").asc_nulls_last())) - 1
    return placed.withColumn("no", own).join(F.broadcast(base), "p").withColumn("no", (F.col("no") + F.col("base")).cast("long")).drop("p", "base")


PLAN = "no long, size long, copies long, extra long, m long"


def _plan_source(pdf: pd.DataFrame) -> pd.DataFrame:
    copies, extra = plan(pdf["size"].to_numpy(), pdf["m"].to_numpy(), float(pdf["target"].iloc[0]))
    return pdf[["no", "size", "m"]].assign(copies=copies, extra=extra)


def sized(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """docs (doc_id, source, text, ...) without the text, with size, its hash _h for the draw, the hash's bucket _b, and a digest _x."""
    own = docs.withColumns({"size": size_of(), "_h": F.xxhash64(F.col("doc_id"), F.lit(seed)), "_x": F.xxhash64("text")}).drop("text")
    return own.withColumn("_b", F.pmod("_h", F.lit(HASH_BUCKETS)))


def takes(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """sized documents with source_size, target, copies (times the mix takes the document) and taken.

    Everything stays distributed: sources are numbered by ranges, targets found by a few aggregations,
    length counts pre-aggregated; a source's plan sees one row for each of its lengths.  Of a length that is taken in
    part, whole hash buckets are taken by their number and only the documents of one bucket are ranked, so copies
    of one document in a third of all rows don't meet in one task.  docs is read several times: pass a cheap frame.
    """
    counts = cut(docs.groupBy("source", "size", "_b").agg(F.count("*").alias("n")))
    sources = counts.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("words"), F.sum("n").alias("docs"))
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("no") % len(weights) + 1).cast("int"))
    known = cut(targets(cut(_numbered(sources).withColumn("weight", weight))))
    total = known.agg(F.coalesce(F.sum("docs"), F.lit(0))).first()[0]
    named = known.select(F.col("source").alias("s_"), "no", F.col("words").alias("source_size"), "target")
    numbered = counts.join(maybe_broadcast(named), F.col("source").eqNullSafe(F.col("s_"))).select("no", "size", "_b", "n", "target")
    numbered = cut(numbered)
    lengths = numbered.groupBy("no", "size", "target").agg(F.sum("n").alias("m"))
    planned = cut(lengths.groupBy("no").applyInPandas(_plan_source, PLAN))
    # the bucket on the edge of what a length gives, and how many of it are taken
    partly = planned.where("extra > 0 and extra < m").select("no", "size", "extra")
    own = numbered.join(maybe_broadcast(partly), ["no", "size"])
    before = F.coalesce(F.sum("n").over(Window.partitionBy("no", "size").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    edge = own.withColumn("open", F.col("extra") - before).where("open > 0 and open <= n").select("no", "size", F.col("_b").alias("edge"), "open")
    level = cut(planned.join(edge, ["no", "size"], "left").select("no", "size", "copies", (F.col("extra") > 0).alias("more"), F.coalesce("edge", F.lit(HASH_BUCKETS)).alias("edge"), F.coalesce("open", F.lit(0)).alias("open"), "m"))
    name = F.coalesce(F.concat(F.lit("s"), "source"), F.lit("none"))
    rows = join_counted(docs.withColumn("_s", name), known.select(name.alias("_s"), "no", F.col("words").alias("source_size"), "target", "docs"), ["_s"], "docs", total).drop("_s")
    joined = join_counted(rows, level, ["no", "size"], "m", total)
    # only documents in a bucket on the edge need ranks
    rank = F.row_number().over(Window.partitionBy("no", "size").orderBy("_h", "doc_id", "_x"))
    on = (F.col("_b") == F.col("edge")) & F.col("more")
    whole = joined.where(~on).withColumn("copies", F.col("copies") + (F.col("more") & (F.col("_b") < F.col("edge"))).cast("long"))
    ranked = joined.where(on).withColumn("copies", F.col("copies") + (rank <= F.col("open")).cast("long"))
    return whole.unionByName(ranked).withColumn("taken", F.col("copies") * F.col("size")).drop("_h", "_x", "_b", "open", "edge", "more", "no")


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, seed: int = SEED) -> DataFrame:
    """The mix itself: each document as many times as it is taken, with the columns of docs.  Documents without words stay once."""
    times = F.when(F.col("size") == 0, F.lit(1)).otherwise(F.col("copies")).cast("int")
    taken = takes(cut(sized(packed(docs, "doc_id", "source", "text"), seed)), weights)
    return unpacked(taken.where(times > 0).select(ROW, F.explode(F.sequence(F.lit(1), times)).alias("copy")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = cut(sized(table(spark, sf_dir, "documents").select("doc_id", "source", "text")))
    return takes(docs).select("doc_id", "size", "source_size", "target", "taken")
