"""Distribution distances, leakage and size diagnostics of splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def distances(long: DataFrame, reference: str, other: str) -> DataFrame:
    """(feature, ks, wasserstein) between the values of two groups.  long: (feature, grp, v).

    Counts by distinct value come first (map-side), cumulative shares by windows over distinct
    values.  An empty group gives 0.
    """
    own = long.where(F.col("grp").isin(reference, other) & F.col("v").isNotNull())
    at = own.groupBy("feature", "v").agg(F.sum((F.col("grp") == reference).cast("long")).alias("ca"), F.sum((F.col("grp") == other).cast("long")).alias("cb"))
    totals = at.groupBy("feature").agg(F.sum("ca").alias("na"), F.sum("cb").alias("nb"))
    w = Window.partitionBy("feature").orderBy("v")
    gap = F.when((F.col("na") > 0) & (F.col("nb") > 0), F.abs(F.sum("ca").over(w) / F.when(F.col("na") > 0, F.col("na")) - F.sum("cb").over(w) / F.when(F.col("nb") > 0, F.col("nb")))).otherwise(F.lit(0.0))
    steps = at.join(F.broadcast(totals), "feature").select("feature", gap.alias("gap"), (F.lead("v").over(w) - F.col("v")).alias("dv"))
    return steps.groupBy("feature").agg(F.max("gap").alias("ks"), F.coalesce(F.sum(F.col("gap") * F.col("dv")), F.lit(0.0)).alias("wasserstein"))


def size_intervals(sizes: DataFrame, expected: dict[str, float]) -> DataFrame:
    """(split, n, expected, low, high): normal 95 % intervals of the shares, clipped to 0 and 1.  sizes: (split, n)."""
    total = F.sum("n").over(Window.partitionBy(F.lit(1)))  # one row for each split
    p = F.col("n") / F.greatest(total, F.lit(1))
    half = 1.96 * F.sqrt(p * (1 - p) / F.greatest(total, F.lit(1)))
    want = F.element_at(F.create_map(*(x for k, v in expected.items() for x in (F.lit(k), F.lit(float(v))))), F.col("split"))
    return sizes.select("split", "n", (want * total).alias("expected"), F.greatest(p - half, F.lit(0.0)).alias("low"), F.least(p + half, F.lit(1.0)).alias("high"))


def otsu(scores: DataFrame, fallback: float) -> float:
    """Threshold between two classes of scores in [0, 1]: 64 bins, the first largest between-class variance, bin centre."""
    n, low, high = scores.agg(F.count("score"), F.min("score"), F.max("score")).first()
    if n < 8 or high - low < 1e-12:
        return fallback
    binned = scores.where("score between 0 and 1").groupBy(F.least(F.floor(F.col("score") * 64), F.lit(63)).alias("bin")).agg(F.count("*").alias("c"))
    c = [0] * 64
    for r in binned.collect():
        c[r["bin"]] = r["c"]
    total, weighted, best, at, w, s = sum(c), sum(k * (i + 0.5) / 64 for i, k in enumerate(c)), -1.0, 0, 0, 0.0
    for i, k in enumerate(c):
        w, s = w + k, s + k * (i + 0.5) / 64
        if 0 < w < total:
            v = w * (total - w) * (s / w - (weighted - s) / (total - w)) ** 2
            if v > best:
                best, at = v, i
    return (at + 0.5) / 64


def cluster_quality(points: DataFrame, names: list[str]) -> DataFrame:
    """One row (n, clusters, davies_bouldin, calinski_harabasz) of points (cluster_id, names...), singletons dropped; null with fewer than 3 rows or 2 clusters."""
    size = F.count("*").over(Window.partitionBy("cluster_id"))
    own = points.withColumn("m", size).where("m > 1")
    centre = own.groupBy("cluster_id").agg(F.count("*").alias("k"), F.array(*(F.avg(n) for n in names)).alias("c"))
    overall = own.agg(F.count("*").alias("n"), F.array(*(F.avg(n) for n in names)).alias("o"))
    dist = lambda a, b: F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
    row = own.select("cluster_id", F.array(*names).alias("x")).join(centre, "cluster_id")
    scatter = row.groupBy("cluster_id", "k", "c").agg(F.avg(dist("x", "c")).alias("s"), F.sum(F.pow(dist("x", "c"), 2)).alias("within"))
    a = scatter.select(F.col("cluster_id").alias("i"), F.col("s").alias("si"), F.col("c").alias("ci"))
    b = scatter.select(F.col("cluster_id").alias("j"), F.col("s").alias("sj"), F.col("c").alias("cj"))
    worst = a.join(b, F.col("i") != F.col("j")).groupBy("i").agg(F.max((F.col("si") + F.col("sj")) / F.when(dist("ci", "cj") > 0, dist("ci", "cj"))).alias("r"))
    db = worst.agg(F.avg("r").alias("davies_bouldin"), F.count("*").alias("clusters"))
    spread = scatter.join(F.broadcast(overall)).agg(F.sum(F.col("k") * F.pow(dist("c", "o"), 2)).alias("between"), F.sum("within").alias("within"), F.sum("k").alias("n"))
    k = F.col("clusters")
    ch = F.when((k > 1) & (F.col("n") > k) & (F.col("within") > 0), (F.col("between") / (k - 1)) / (F.col("within") / F.when(F.col("n") > k, F.col("n") - k)))
    return spread.join(F.broadcast(db)).select("n", "clusters", "davies_bouldin", ch.alias("calinski_harabasz"))
