"""What a finished split is measured by: feature distances, balance, leakage, similarity, cluster quality, and the summary of all.

Every measure is a small table of a fixed number of rows (splits, pairs of splits, features), computed over all
records; only the similarity of sampled records and the silhouette take a bounded sample, as their feature.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinsieve.config import SplitConfig
from kinsieve.functions import sequence as S
from kinsieve.operators import diagnostics, graph, pairs
from kinsieve.operators.assign import SPLITS, seeded

#: Limits of the warnings.
KS_LIMIT, DIVERGENCE_LIMIT, TEST_LIMIT, VAL_LIMIT, SPARSE_LIMIT = 0.20, 0.10, 0.75, 0.85, 0.05
SAMPLE = 200
PAIRS = [(a, b) for i, a in enumerate(SPLITS) for b in SPLITS[i + 1 :]]


def feature_values(splits: DataFrame, digits: int | None = None) -> DataFrame:
    """(feature, split, v) of all records with a sequence, rounded to digits if given.  splits (rid, seq, split)."""
    feats = {n: c if digits is None else F.round(c, digits) for n, c in S.features(F.col("seq")).items()}
    cells = F.array(*(F.struct(F.lit(n).alias("feature"), c.alias("v")) for n, c in feats.items()))
    return splits.where(F.length("seq") > 0).select("split", F.explode(cells).alias("x")).select("x.feature", "split", "x.v")


def feature_ks(splits: DataFrame, digits: int | None = None) -> DataFrame:
    """(a, b, feature, ks, wasserstein) of the 32 features for each pair of splits, one job for all; 0 where a split is empty.

    Counts by distinct value come first, so a value that a third of all records have is one row.
    """
    return _by_value(feature_values(splits, digits), [(a, b, F.col(f"c_{a}"), F.col(f"c_{b}")) for a, b in PAIRS])


def feature_balance(splits: DataFrame, digits: int | None = None) -> DataFrame:
    """(a, b, feature, ks, wasserstein) of each split (a) against the whole (b = 'overall')."""
    whole = sum((F.col(f"c_{s}") for s in SPLITS[1:]), F.col(f"c_{SPLITS[0]}"))
    return _by_value(feature_values(splits, digits), [(s, "overall", F.col(f"c_{s}"), whole) for s in SPLITS])


def _by_value(values: DataFrame, compared: list[tuple[str, str, Column, Column]]) -> DataFrame:
    at = values.groupBy("feature", "v").agg(*(F.count_if(F.col("split") == s).alias(f"c_{s}") for s in SPLITS))
    cells = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), x.alias("x"), y.alias("y")) for a, b, x, y in compared))
    rows = at.select("feature", "v", F.explode(cells).alias("c")).select("c.a", "c.b", "feature", "v", "c.x", "c.y")
    w = Window.partitionBy("a", "b", "feature")
    run = w.orderBy("v")
    rows = rows.where("x + y > 0").withColumns({"nx": F.sum("x").over(w), "ny": F.sum("y").over(w), "sx": F.sum("x").over(run), "sy": F.sum("y").over(run), "next": F.lead("v").over(run)})
    gap = F.when((F.col("nx") > 0) & (F.col("ny") > 0), F.abs(F.try_divide("sx", "nx") - F.try_divide("sy", "ny"))).otherwise(F.lit(0.0))
    rows = rows.withColumn("gap", gap)
    return rows.groupBy("a", "b", "feature").agg(F.max("gap").alias("ks"), F.coalesce(F.sum(F.col("gap") * (F.col("next") - F.col("v"))), F.lit(0.0)).alias("wasserstein"))


def ood_warnings(distances: DataFrame, limit: float = KS_LIMIT) -> DataFrame:
    """Rows of feature_ks with a KS distance over the limit."""
    return distances.where(F.col("ks") > limit)


def normalized_balance(splits: DataFrame, digits: int | None = None) -> DataFrame:
    """(split, feature, normalized): Wasserstein distance from the whole over the feature's range; the distance itself where the range is 0."""
    spread = feature_values(splits, digits).groupBy("feature").agg((F.max("v") - F.min("v")).alias("spread"))
    own = feature_balance(splits, digits).join(F.broadcast(spread), "feature")  # 32 rows
    return own.select(F.col("a").alias("split"), "feature", (F.col("wasserstein") / F.when(F.col("spread") > 1e-12, F.col("spread")).otherwise(F.lit(1.0))).alias("normalized"))


def balance_verdict(normalized: DataFrame, limit: float = DIVERGENCE_LIMIT) -> DataFrame:
    """One row (status, max_normalized_divergence, threshold)."""
    worst = F.greatest(F.coalesce(F.max("normalized"), F.lit(0.0)), F.lit(0.0))
    return normalized.agg(worst.alias("max_normalized_divergence")).select(F.when(F.col("max_normalized_divergence") <= limit, "PASS").otherwise("FAIL").alias("status"), "max_normalized_divergence", F.lit(limit).alias("threshold"))


def sampled(splits: DataFrame, cap: int = SAMPLE, seed: int = 42) -> DataFrame:
    """At most cap records of each split, the first in seeded order; the order is cut in 256 buckets first, so a split isn't ranked in one task."""
    if isinstance(cap, bool) or not isinstance(cap, int) or cap < 1:
        raise ValueError("cap must be an integer of 1 or more")
    own = splits.withColumn("h", seeded(seed)[0]).withColumn("b", F.substring("h", 1, 2))
    first = own.withColumn("r", F.row_number().over(Window.partitionBy("split", "b").orderBy("h", "rid"))).where(F.col("r") <= cap)
    ranked = first.withColumn("r", F.row_number().over(Window.partitionBy("split").orderBy("h", "rid")))  # of at most 256 * cap rows
    return ranked.where(F.col("r") <= cap).drop("h", "b", "r")


def pairwise_similarity(splits: DataFrame, k: int = 3, cap: int = SAMPLE, seed: int = 42) -> DataFrame:
    """(s1, s2, mean, std, n_pairs) of the k-mer similarity within and between splits, over a bounded sample of each."""
    return similarity_scores(splits, k, cap, seed).groupBy("s1", "s2").agg(F.avg("s").alias("mean"), F.stddev_pop("s").alias("std"), F.count("*").alias("n_pairs"))


def similarity_scores(splits: DataFrame, k: int = 3, cap: int = SAMPLE, seed: int = 42) -> DataFrame:
    """(s1, s2, s): similarity of each pair of sampled records, splits in the order of their names' places."""
    own = sampled(splits, cap, seed).select("rid", "split", S.kmers(F.col("seq"), k).alias("k"))
    place = F.array_position(F.array(*map(F.lit, SPLITS)), F.col("split"))
    own = own.withColumn("p", place)
    a, b = own.toDF("a", "s1", "ka", "pa"), own.toDF("b", "s2", "kb", "pb")
    both = a.join(b, F.expr("(pa = pb and a < b) or pa < pb"))  # of at most 3 * cap rows a side
    c = F.size(F.array_intersect("ka", "kb"))
    return both.select("s1", "s2", S.jaccard(c, F.size("ka"), F.size("kb")).alias("s"))


def homology_warnings(similarity: DataFrame) -> DataFrame:
    """(pair, mean, train_mean): test-train and val-train similarities that come near that within train."""
    m = similarity.groupBy(F.lit(1).alias("one")).agg(*(F.max(F.when((F.col("s1") == "train") & (F.col("s2") == s), F.col("mean"))).alias(s) for s in SPLITS))
    each = m.select(F.explode(F.array(*(F.struct(F.lit(f"train-{s}").alias("pair"), F.col(s).alias("mean"), F.col("train").alias("train_mean"), F.lit(limit).alias("limit")) for s, limit in (("test", TEST_LIMIT), ("val", VAL_LIMIT))))).alias("x")).select("x.*")
    return each.where(F.col("mean") >= F.col("limit") * F.col("train_mean")).select("pair", "mean", "train_mean")


def nearest_summary(splits: DataFrame, k: int = 3) -> DataFrame:
    """(query, n_queries, mean, max, p95): each test and val record's similarity to its nearest train record."""
    near = pairs.nearest(splits.where("split in ('test', 'val')"), splits.where("split = 'train'"), k, ("split",))
    rows = near.groupBy("split").agg(F.count("*").alias("n_queries"), F.avg("score").alias("mean"), F.max("score").alias("max"), F.percentile("score", F.lit(0.95)).alias("p95"))
    both = splits.sparkSession.createDataFrame([("test",), ("val",)], "query string")
    return both.join(rows, F.col("query") == F.col("split"), "left").select("query", F.coalesce("n_queries", F.lit(0)).alias("n_queries"), "mean", "max", "p95")


def boundary_records(splits: DataFrame, k: int, threshold: float = 0.7, width: float = 0.10) -> DataFrame:
    """(rid, split, ref, score): test and val records whose nearest train record is within ``width`` of the threshold.

    Without a train record there are none; a record that shares no k-mer with train has score 0 and no ref.
    """
    near = pairs.nearest(splits.where("split <> 'train'"), splits.where("split = 'train'"), k, ("split",))
    some = splits.where("split = 'train'").limit(1).count() > 0
    return near.where(F.lit(some) & (F.abs(F.col("score") - threshold) <= width)).select("rid", "split", "ref", "score")


def leakage_gate(splits: DataFrame, k: int, threshold: float) -> float | None:
    """Largest similarity of a test record to train; ValueError over the threshold.  To be asked before anything is written."""
    row = nearest_summary(splits, k).where("query = 'test'").first()
    worst = row["max"] if row["n_queries"] and splits.where("split = 'train'").limit(1).count() else None
    if worst is not None and worst > threshold:
        raise ValueError(f"leakage: a test record has similarity {worst:.3f} to train, over the threshold {threshold:.3f}")
    return worst


def silhouette(points: DataFrame, names: list[str], most: int = 1000) -> DataFrame:
    """One row (n, silhouette) of points (rid, cluster_id, names...) of clusters of two or more.

    Over ``most`` points a sample is taken, evenly spaced in the order of rid.  With fewer than 3 points or 2 clusters it is null.
    """
    size = points.groupBy("cluster_id").agg(F.count("*").alias("m")).where("m > 1")
    own = graph.cut(points.join(size, "cluster_id").select("rid", "cluster_id", F.array(*(F.col(n).cast("double") for n in names)).alias("x")))
    n, clusters = own.agg(F.count("*"), F.count_distinct("cluster_id")).first()
    if n < 3 or clusters < 2:
        return points.sparkSession.createDataFrame([(n, None)], "n long, silhouette double")
    own = graph.cut(spaced(own, n, most)) if n > most else own
    a, b = own.toDF("a", "ca", "xa"), own.toDF("b", "cb", "xb")
    distance = F.sqrt(F.aggregate(F.zip_with("xa", "xb", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
    by = a.crossJoin(F.broadcast(b)).groupBy("a", "ca", "cb").agg(F.sum(distance).alias("d"), F.count("*").alias("m"))  # most * most pairs of the bounded sample
    inner = F.max(F.when(F.col("ca") == F.col("cb"), F.col("d") / F.greatest(F.col("m") - 1, F.lit(1))))
    outer = F.coalesce(F.min(F.when(F.col("ca") != F.col("cb"), F.col("d") / F.col("m"))), F.lit(0.0))
    each = by.groupBy("a").agg(inner.alias("i"), outer.alias("o"))
    return each.agg(F.count("*").alias("n"), F.avg((F.col("o") - F.col("i")) / F.greatest("i", "o", F.lit(1e-12))).alias("silhouette"))


def spaced(rows: DataFrame, n: int, most: int) -> DataFrame:
    """``most`` of the n rows at even steps in the order of rid.  Ranges of rid are numbered apart and shifted, so no task sees all rows."""
    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    placed = graph.cut(rows.repartitionByRange(parts, "rid").withColumn("p", F.spark_partition_id()))
    sizes = placed.groupBy("p").agg(F.count("*").alias("c"))
    base = sizes.select("p", (F.sum("c").over(Window.orderBy("p")) - F.col("c")).alias("base"))  # one row for each range
    at = F.row_number().over(Window.partitionBy("p").orderBy("rid")) - 1 + F.col("base")
    numbered = placed.join(F.broadcast(base), "p").withColumn("at", at.cast("long"))
    # the j-th of them stands at floor(j * (n - 1) / (most - 1))
    step = (n - 1) / max(1, most - 1)
    wanted = rows.sparkSession.range(most).select(F.floor(F.col("id") * F.lit(float(step)) + F.lit(1e-9)).alias("at"))
    return numbered.join(F.broadcast(wanted), "at", "left_semi").drop("at", "p", "base")


def redundancy(records: DataFrame, k: int, pairs_asked: int = 256, seed: int = 42) -> dict:
    """sampled_pairs, mean_similarity and fraction_nonzero of about ``pairs_asked`` pairs of records drawn by a seeded hash: a look before clustering."""
    some = records.select("rid", "seq", seeded(seed)[0].alias("h")).orderBy("h", "rid").limit(2 * pairs_asked)
    drawn = some.withColumn("r", F.row_number().over(Window.orderBy("h", "rid")) - 1).select((F.col("r") / 2).cast("int").alias("p"), (F.col("r") % 2).alias("side"), S.kmers(F.col("seq"), k).alias("k"))  # of a bounded sample
    a, b = drawn.where("side = 0").select("p", F.col("k").alias("ka")), drawn.where("side = 1").select("p", F.col("k").alias("kb"))
    score = S.jaccard(F.size(F.array_intersect("ka", "kb")), F.size("ka"), F.size("kb"))
    n, mean, some = a.join(b, "p").select(score.alias("s")).agg(F.count("*"), F.avg("s"), F.avg((F.col("s") > 0).cast("int"))).first()
    return {"sampled_pairs": n, "mean_similarity": mean or 0.0, "fraction_nonzero": some or 0.0}


def recall_probe(records: DataFrame, proposed: DataFrame, k: int, threshold: float, queries: int = 256, seed: int = 42) -> dict:
    """Recall of the proposed pairs (a, b) against brute force: ``queries`` records by a seeded hash against all records.

    queries, true_pairs, found_pairs, and recall (None without a true pair).
    """
    asked = records.select("rid", "seq", seeded(seed)[0].alias("h")).orderBy("h", "rid").limit(queries).select("rid", "seq")
    q = pairs.kmer_rows(asked, k).select(F.col("rid").alias("q"), F.col("n").alias("nq"), "kmer")
    c = F.broadcast(q).join(pairs.kmer_rows(records, k), "kmer").where("q <> rid").groupBy("q", "rid", "nq", "n").agg(F.count("*").alias("c"))
    true = graph.cut(c.where(S.jaccard(F.col("c"), F.col("nq"), F.col("n")) >= threshold).select(F.least("q", "rid").alias("a"), F.greatest("q", "rid").alias("b")).distinct())
    n = true.count()
    found = true.join(proposed.select("a", "b").distinct(), ["a", "b"], "left_semi").count() if n else 0
    return {"queries": queries, "true_pairs": n, "found_pairs": found, "recall": found / n if n else None}


def split_tables(splits: DataFrame) -> tuple[dict, dict, dict, dict]:
    """sizes, label_counts (empty without a label), length and feature_means by split, from one aggregation."""
    feats = S.features(F.col("seq"))
    n = F.length("seq")
    row = {r["split"]: r for r in splits.groupBy("split").agg(F.count("*").alias("n"), *(F.count_if(F.col("label") == y).alias(f"y{y}") for y in (0, 1)), F.count_if(F.col("label").isNull()).alias("y"), F.avg(n).alias("mean"), F.stddev_pop(n).alias("std"), F.min(n).alias("low"), F.max(n).alias("high"), *(F.avg(c).alias(f"f_{k}") for k, c in feats.items())).collect()}
    got = lambda s, k: row[s][k] if s in row else None
    labelled = any(got(s, "y0") or got(s, "y1") for s in SPLITS)
    return (
        {s: got(s, "n") or 0 for s in SPLITS},
        {s: {"0": got(s, "y0") or 0, "1": got(s, "y1") or 0, "unlabeled": got(s, "y") or 0} for s in SPLITS} if labelled else {},
        {s: {"mean": got(s, "mean"), "std": got(s, "std"), "min": got(s, "low"), "max": got(s, "high")} for s in SPLITS},
        {s: {k: got(s, f"f_{k}") for k in feats} if got(s, "n") else {} for s in SPLITS},
    )


def summarize(splits: DataFrame, config: SplitConfig, labels: DataFrame | None = None, assignment: dict | None = None, clustering: dict | None = None, k: int | None = None, cap: int = SAMPLE) -> dict:
    """All measures of splits (rid, label, seq, split) as one dict that JSON can hold.

    labels (rid, cluster_id) add cluster quality; assignment and clustering are statistics of those steps.  Its parts are
    tables of at most 96 rows each, which is all that comes to the driver.
    """
    k = config.kmer_sizes[0] if k is None else k
    splits = graph.cut(splits.select("rid", "label", "seq", "split"))
    sizes, label_counts, length, means = split_tables(splits)
    similar = graph.cut(pairwise_similarity(splits, k, cap, config.seed))
    mean = {f"{r['s1']}-{r['s2']}": {"mean_jaccard": r["mean"], "std": r["std"], "n_pairs": r["n_pairs"]} for r in similar.collect()}
    none = {"mean_jaccard": None, "std": None, "n_pairs": 0}
    ks = {(r["a"], r["b"], r["feature"]): (r["ks"], r["wasserstein"]) for r in feature_ks(splits).collect()}
    own = {(r["a"], r["feature"]): (r["ks"], r["wasserstein"]) for r in feature_balance(splits).collect()}
    norm = {(r["split"], r["feature"]): r["normalized"] for r in normalized_balance(splits).collect()}
    worst = max([x for x in norm.values() if x is not None], default=0.0)
    near = {r["query"]: r for r in nearest_summary(splits, k).collect()}
    names, total = S.FEATURE_NAMES, sum(sizes.values())
    both = lambda s: sizes[s] and sizes["train"]
    out = {
        "clustering_mode": config.as_dict(), "sizes": sizes, "label_counts": label_counts, "length": length, "feature_means": means,
        "similarity": {f"{a}-{b}": mean.get(f"{a}-{b}", none) for i, a in enumerate(SPLITS) for b in SPLITS[i:]},
        "homology_warnings": [f"{r['pair']}: mean similarity {r['mean']:.3f} comes near that within train, {r['train_mean']:.3f}" for r in homology_warnings(similar).collect()],
        "ood_warnings": [f"{a}-vs-{b}: KS distance {ks[a, b, f][0]:.2f} of {f}" for a, b in PAIRS for f in names if ks.get((a, b, f), (0.0,))[0] > KS_LIMIT],
        "feature_names": list(names),
        "ks": {"method": "two-sample empirical Kolmogorov-Smirnov D statistic", "pairs": [f"{a}-vs-{b}" for a, b in PAIRS], "features": list(names), "values": [[ks.get((a, b, f), (0.0, 0.0))[0] for a, b in PAIRS] for f in names], "wasserstein": [[ks.get((a, b, f), (0.0, 0.0))[1] for a, b in PAIRS] for f in names]},
        "feature_balance": {
            "reference": "overall_dataset", "features": list(names), "splits": {s: {m: [own[s, f][i] if sizes[s] and (s, f) in own else None for f in names] for i, m in enumerate(("ks", "wasserstein"))} for s in SPLITS},
            "normalized_wasserstein": {s: {f: norm.get((s, f)) if sizes[s] else None for f in names} for s in SPLITS}, "summary": {"status": "PASS" if worst <= DIVERGENCE_LIMIT else "FAIL", "max_normalized_divergence": worst, "threshold": DIVERGENCE_LIMIT},
        },
        "nearest_neighbor_similarity": {"metric": f"maximum exact {k}-mer Jaccard to reference split"} | {f"{s}_to_train": {"n_queries": sizes[s]} | {m: near[s][m] if both(s) else None for m in ("mean", "max", "p95")} for s in ("test", "val")},
        "size_confidence_intervals": {s: {"observed": sizes[s], "target_proportion": p, "expected": p * total, "random_assignment_95ci_proportion": [max(0.0, p - 1.96 * (p * (1 - p) / max(1, total)) ** 0.5), min(1.0, p + 1.96 * (p * (1 - p) / max(1, total)) ** 0.5)]} for s, p in zip(SPLITS, (config.train_pct, config.val_pct, config.test_pct), strict=True)},
        "cluster_quality": {"silhouette": None, "davies_bouldin": None, "calinski_harabasz": None},
    }
    if labels is not None:
        feats = S.features(F.col("seq"))
        points = graph.cut(splits.where("seq <> ''").select("rid", *(c.alias(n) for n, c in feats.items())).join(labels.select("rid", "cluster_id"), "rid"))
        q = diagnostics.cluster_quality(points, list(feats)).first()
        s = silhouette(points, list(feats), config.diagnostics_sample_size if config.diagnostics_sample_size < 2000 else 2000).first()
        if s["silhouette"] is not None:
            out["cluster_quality"] = {"silhouette": s["silhouette"], "davies_bouldin": q["davies_bouldin"], "calinski_harabasz": q["calinski_harabasz"]}
    if clustering:
        fraction = clustering.get("non_singleton_fraction", 0.0)
        out["cluster_quality_meta"] = {"non_singleton_fraction": fraction, "warning": "few records are in clusters of two or more, so quality says little" if fraction < SPARSE_LIMIT else None}
    if assignment:
        out["assignment"] = dict(assignment)
    if clustering:
        out["clustering"] = dict(clustering)
    return out
