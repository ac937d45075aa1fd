"""Splits: apportionment, seeded random splits, greedy assignment of whole clusters, folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SPLITS = ("train", "val", "test")


def seeded(seed: int, rid: str = "rid") -> list[Column]:
    """A seeded order that any engine can repeat: md5 of seed:rid, then rid."""
    return [F.md5(F.concat(F.lit(f"{seed}:"), F.col(rid).cast("string"))), F.col(rid)]


def target_sizes(n: int, shares: tuple[float, ...]) -> list[int]:
    """Largest remainder: floors, then one more for the largest fractions; ties keep the order."""
    exact = [n * s for s in shares]
    out = [int(x) for x in exact]
    for i in sorted(range(len(shares)), key=lambda i: -(exact[i] - out[i]))[: n - sum(out)]:
        out[i] += 1
    return out


def apportioned(counts: DataFrame, shares: tuple[float, ...]) -> DataFrame:
    """(key, n, train, val, test) of counts (key, n)."""
    exact = [F.col("n") * F.lit(float(s)) for s in shares]
    parts = F.array(*(F.struct((-(x - F.floor(x))).alias("f"), F.lit(i).alias("i"), F.floor(x).alias("w")) for i, x in enumerate(exact)))
    out = counts.withColumn("o", F.array_sort(parts)).withColumn("left", F.col("n") - sum((F.floor(x) for x in exact), F.lit(0)))
    ranked = F.transform("o", lambda x, p: F.struct(x["i"].alias("i"), (x["w"] + (p < F.col("left")).cast("int")).alias("w")))
    out = out.withColumn("o", F.array_sort(ranked))
    return out.select("key", "n", *(F.element_at("o", i + 1)["w"].cast("long").alias(s) for i, s in enumerate(SPLITS)))


def random_split(records: DataFrame, shares: tuple[float, ...] = (0.8, 0.1, 0.1), seed: int = 42, stratify: bool = True) -> DataFrame:
    """records with split.  Stratified by label only if every record has one.

    Ranks in a stratum are counted in 256 buckets of the hash order first, so a stratum of any size is split over tasks.
    """
    all_labelled = stratify and not records.where("label is null").limit(1).count()
    key = F.col("label") if all_labelled else F.lit(0)
    own = records.withColumn("key", key).withColumn("h", seeded(seed)[0]).withColumn("b", F.substring("h", 1, 2))
    counts = own.groupBy("key", "b").agg(F.count("*").alias("c"))
    before = F.sum("c").over(Window.partitionBy("key").orderBy("b")) - F.col("c")
    shifted = counts.select("key", "b", before.alias("before"))
    goal = apportioned(counts.groupBy("key").agg(F.sum("c").alias("n")), shares)
    w = Window.partitionBy("key", "b").orderBy("h", "rid")
    ranked = own.join(F.broadcast(shifted.join(goal, "key")), ["key", "b"]).withColumn("r", F.row_number().over(w) + F.col("before"))
    split = F.when(F.col("r") <= F.col("train"), "train").when(F.col("r") <= F.col("train") + F.col("val"), "val").otherwise("test")
    return ranked.select(*records.columns, split.alias("split"))


def greedy_split(sizes: DataFrame, shares: tuple[float, ...] = (0.8, 0.1, 0.1), seed: int = 42) -> DataFrame:
    """(cluster_id, size, split): clusters, largest first (ties in seeded order), each to the split that its size brings nearest to its target.

    The greedy choice is sequential by nature, so it runs over (size, clusters of that size):
    equal sizes are dealt in runs by arithmetic, and only the runs are a sequence.
    """
    hist = [(r["size"], r["c"]) for r in sizes.groupBy("size").agg(F.count("*").alias("c")).orderBy(F.desc("size")).collect()]
    n = sum(s * c for s, c in hist)
    goal, have, runs = [n * s for s in shares], [0] * len(shares), []
    for size, c in hist:
        rank = 1
        while c:
            cost = [abs(h + size - g) - abs(h - g) for h, g in zip(have, goal, strict=True)]
            i = min(range(len(shares)), key=lambda i: (cost[i], i))
            # while a split stays below its target its cost stays the least possible, -size
            k = max(1, min(c, int((goal[i] - have[i]) // size))) if cost[i] == -size else 1
            if runs and runs[-1][0] == size and runs[-1][3] == i:
                runs[-1][2] += k
            else:
                runs.append([size, rank, rank + k - 1, i])
            have[i] += k * size
            c, rank = c - k, rank + k
    spark = sizes.sparkSession
    plan = spark.createDataFrame([(s, a, b, SPLITS[i]) for s, a, b, i in runs], "size long, first long, last long, split string")
    ranked = sizes.withColumn("r", F.row_number().over(Window.partitionBy("size").orderBy(*seeded(seed, "cluster_id"))))
    near = ranked["size"] == plan["size"]
    return ranked.join(F.broadcast(plan), near & F.col("r").between(F.col("first"), F.col("last"))).select("cluster_id", ranked["size"], "split")


def folds(sizes: DataFrame, k: int, seed: int = 42) -> DataFrame:
    """(cluster_id, size, fold): each cluster, largest first, to the fold that comes nearest to an even share; ties to the lowest."""
    if isinstance(k, bool) or not isinstance(k, int) or k < 2:
        raise ValueError("folds must be an integer of 2 or more")
    hist = [(r["size"], r["c"]) for r in sizes.groupBy("size").agg(F.count("*").alias("c")).orderBy(F.desc("size")).collect()]
    even, have, runs = sum(s * c for s, c in hist) / k, [0] * k, []
    for size, c in hist:
        rank = 1
        while c:
            i = min(range(k), key=lambda i: (abs(have[i] + size - even), i))
            # the fold nearest to its share keeps taking while it gets nearer still
            m = max(1, min(c, int((even - have[i]) // size)))
            runs.append((size, rank, rank + m - 1, i))
            have[i] += m * size
            c, rank = c - m, rank + m
    plan = sizes.sparkSession.createDataFrame(runs or [(0, 0, 0, 0)], "size long, first long, last long, fold int")
    ranked = sizes.withColumn("r", F.row_number().over(Window.partitionBy("size").orderBy(*seeded(seed, "cluster_id"))))
    return ranked.join(F.broadcast(plan), (ranked["size"] == plan["size"]) & F.col("r").between(F.col("first"), F.col("last"))).select("cluster_id", ranked["size"], "fold")
