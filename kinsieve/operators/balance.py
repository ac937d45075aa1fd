"""Assignment of whole clusters with size bounds, composition and label costs; local search, Pareto frontier, statistics.

The choice is sequential by nature: a cluster's cost depends on all that were placed before it.
What it needs of a cluster is one fixed-width row (size, feature sums, positives), so records
are aggregated by Spark and only the cluster table is walked through, in its order, in blocks
streamed to the driver; the placements go back as a table.  For the costs by distribution
(Wasserstein, KS) a cluster's row holds a histogram of each feature over BINS quantiles of the
whole, and for data with fewer distinct values than BINS the result is exact on those values.

Memory of the driver: one row of 32 sums for each cluster while local search runs, else the
placements.  Tables of more than MOST_CLUSTERS clusters are refused: greedy_split takes them by size alone.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinsieve.config import SplitConfig
from kinsieve.functions import sequence as S
from kinsieve.operators import graph
from kinsieve.operators.assign import SPLITS, seeded, target_sizes

BINS, MOST_CLUSTERS = 64, 5_000_000


@dataclass
class Assignment:
    """placed: (cluster_id, size, split); stats: what the run reports."""

    placed: DataFrame
    stats: dict = field(default_factory=dict)


@dataclass
class _Clusters:
    """The cluster table in order: ids, sizes, feature sums, positives, and histograms (clusters, features, BINS)."""

    ids: np.ndarray
    sizes: np.ndarray
    sums: np.ndarray
    positives: np.ndarray
    bins: np.ndarray | None


def check_partition(labels: DataFrame, records: DataFrame) -> None:
    """labels (rid, cluster_id) must name every record of records (rid) exactly once; else ValueError."""
    got = labels.agg(F.count("*"), F.count_distinct("rid"), F.count("cluster_id")).first()
    n = records.count()
    if tuple(got) != (n, n, n) or records.select("rid").join(labels, "rid", "left_anti").limit(1).count():
        raise ValueError("clusters must partition all records exactly once")


def cluster_features(records: DataFrame, labels: DataFrame) -> DataFrame:
    """(cluster_id, size, positives, s_<feature>...): one row of sums for each cluster.  records (rid, label, seq), labels (rid, cluster_id)."""
    feats = S.features(F.col("seq"))
    own = records.join(labels.select("rid", "cluster_id"), "rid")
    sums = [F.coalesce(F.sum(c), F.lit(0.0)).alias(f"s_{n}") for n, c in feats.items()]
    return own.groupBy("cluster_id").agg(F.count("*").alias("size"), F.count_if(F.col("label") == 1).alias("positives"), *sums)


def _scales(records: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Mean and deviation (1 where it is 0) of each feature over all records."""
    feats = S.features(F.col("seq"))
    row = records.agg(*(F.avg(c) for c in feats.values()), *(F.stddev_pop(c) for c in feats.values())).first()
    both = np.array([x or 0.0 for x in row])
    mean, scale = both[: len(feats)], both[len(feats) :]
    return mean, np.where(scale > 1e-12, scale, 1.0)


def _histograms(records: DataFrame, labels: DataFrame) -> tuple[DataFrame, np.ndarray]:
    """((cluster_id, bins): counts by feature and bin in one array), and the bins' upper values (features, BINS)."""
    feats = S.features(F.col("seq"))
    at = [i / BINS for i in range(1, BINS + 1)]
    row = records.agg(*(F.percentile_approx(c, at, 10_000) for c in feats.values())).first()
    edges = np.array([x or [0.0] * BINS for x in row], float)
    own = records.join(labels.select("rid", "cluster_id"), "rid")
    bins = [F.expr("0")] * 0
    for j, c in enumerate(feats.values()):
        inner = F.array(*(F.lit(float(x)) for x in edges[j]))
        bins.append((F.lit(j * BINS) + F.least(F.lit(BINS - 1), F.size(F.filter(inner, lambda e, c=c: e < c)))).cast("int"))
    cells = own.select("cluster_id", F.explode(F.array(*bins)).alias("bin")).groupBy("cluster_id", "bin").agg(F.count("*").alias("n"))
    return cells.groupBy("cluster_id").agg(F.collect_list(F.struct("bin", "n")).alias("bins")), edges


def _read(table: DataFrame, seed: int, features: int, bins: bool) -> _Clusters:
    """The ordered cluster table: largest first, ties in seeded order."""
    ordered = table.orderBy(F.desc("size"), *seeded(seed, "cluster_id"))
    ids, sizes, positives, sums, cells = [], [], [], [], []
    for r in ordered.toLocalIterator():
        ids.append(r["cluster_id"])
        sizes.append(r["size"])
        positives.append(r["positives"] if "positives" in table.columns else 0)
        if features:
            sums.append([r[f"s_{n}"] for n in S.FEATURE_NAMES])
        if bins:
            own = np.zeros(features * BINS, np.int32)
            for x in r["bins"]:
                own[x["bin"]] = x["n"]
            cells.append(own.reshape(features, BINS))
    return _Clusters(np.array(ids, np.int64), np.array(sizes, np.int64), np.array(sums, float).reshape(len(ids), features), np.array(positives, float), np.array(cells) if bins else None)


def bounds_of(n: int, shares: tuple[float, ...], clusters: int) -> tuple[list[int], list[int]]:
    """Least and greatest size of each split: 5 per cent around its target; at least 1 where the target has a record and there are three clusters."""
    goal = [n * s for s in shares]
    whole = target_sizes(n, shares)
    low = [max(1, int(np.floor(g * 0.95))) if w > 0 and clusters >= len(shares) else int(np.floor(g * 0.95)) for g, w in zip(goal, whole, strict=True)]
    return low, [int(np.ceil(g * 1.05)) for g in goal]


def _distance(metric: str, have: np.ndarray, all_: np.ndarray, edges: np.ndarray, scale: np.ndarray) -> float:
    """Mean over features of the distance between histograms, each over the feature's scale (1 at least)."""
    n, total = have[0].sum(), all_[0].sum()
    if not n or not total:
        return 0.0
    gap = np.abs(np.cumsum(have, 1) / n - np.cumsum(all_, 1) / total)
    d = gap.max(1) if metric == "ks" else (gap[:, :-1] * np.diff(edges, axis=1)).sum(1)
    return float((d / np.maximum(scale, 1.0)).mean())


def _place(c: _Clusters, config: SplitConfig, mean: np.ndarray, scale: np.ndarray, edges: np.ndarray | None) -> tuple[np.ndarray, float, bool]:
    """(split of each cluster, sum of the costs chosen, whether a cluster fitted nowhere within the bounds)."""
    shares = (config.train_pct, config.val_pct, config.test_pct)
    n, k = int(c.sizes.sum()), len(shares)
    goal = np.array([n * s for s in shares])
    low, high = bounds_of(n, shares, len(c.ids))
    have, sums, positives = np.zeros(k), np.zeros((k, len(mean))), np.zeros(k)
    held = np.zeros((k, *c.bins.shape[1:])) if c.bins is not None else None
    whole = c.bins.sum(0) if c.bins is not None else None
    all_positive = c.positives.sum() if config.stratify_labels else 0.0
    out, objective, fallback = np.zeros(len(c.ids), int), 0.0, False
    for at, size in enumerate(c.sizes):
        left_clusters, left = len(c.ids) - at - 1, n - have.sum() - size
        empty = [i for i in range(k) if have[i] == 0 and low[i] > 0]
        reserved = set(empty) if left_clusters < len(empty) else set()
        costs = {}
        for i in range(k):
            new = have[i] + size
            if config.balance and (new > high[i] or i in reserved or left < sum(max(0, low[j] - (new if j == i else have[j])) for j in range(k))):
                continue
            cost = (abs(new - goal[i]) - abs(have[i] - goal[i])) / max(1, n)
            if config.balance and len(mean):
                if held is None:
                    cost += config.balance_weight * float(np.mean((((sums[i] + c.sums[at]) / new - mean) / scale) ** 2))
                else:
                    cost += config.balance_weight * _distance(config.balance_metric, held[i] + c.bins[at], whole, edges, scale)
            if all_positive:
                cost += abs(positives[i] + c.positives[at] - shares[i] * all_positive) / max(1, n)
            costs[i] = cost
        if not costs:
            fallback, costs = True, {i: abs(have[i] + size - goal[i]) for i in range(k)}
        best = min(costs, key=lambda i: (costs[i], i))
        out[at], have[best], objective = best, have[best] + size, objective + costs[best]
        sums[best] += c.sums[at] if len(mean) else 0.0
        positives[best] += c.positives[at]
        if held is not None:
            held[best] += c.bins[at]
    return out, objective, fallback


def _objective(have: np.ndarray, sums: np.ndarray, goal: np.ndarray, n: int, mean: np.ndarray, scale: np.ndarray, weight: float) -> float:
    value = np.abs(have - goal).sum() / max(1, n)
    for i in np.flatnonzero(have):
        if len(mean):
            value += weight * float(np.mean(((sums[i] / have[i] - mean) / scale) ** 2))
    return float(value)


def _search(c: _Clusters, split: np.ndarray, config: SplitConfig, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Swaps of two clusters of different splits, by cluster id, each taken where it lowers the objective; sums are kept up, so a trial costs no pass over the clusters."""
    shares = (config.train_pct, config.val_pct, config.test_pct)
    n, k = int(c.sizes.sum()), len(shares)
    goal, (low, high) = np.array([n * s for s in shares]), bounds_of(n, shares, len(c.ids))
    split, order = split.copy(), np.argsort(c.ids)
    have = np.bincount(split, c.sizes, k)
    sums = np.stack([c.sums[split == i].sum(0) for i in range(k)])
    now = _objective(have, sums, goal, n, mean, scale, config.balance_weight)
    for _ in range(config.local_search_iterations):
        improved = False
        for x, left in enumerate(order):
            for right in order[x + 1 :]:
                a, b = split[left], split[right]
                if a == b:
                    continue
                more, shift = c.sizes[right] - c.sizes[left], c.sums[right] - c.sums[left]
                trial, moved = have.copy(), sums.copy()
                trial[a] += more
                trial[b] -= more
                moved[a] += shift
                moved[b] -= shift
                if config.balance and any(trial[i] < low[i] or trial[i] > high[i] for i in range(k)):
                    continue
                after = _objective(trial, moved, goal, n, mean, scale, config.balance_weight)
                if after + 1e-12 < now:
                    split[left], split[right], have, sums, now, improved = b, a, trial, moved, after, True
        if not improved:
            break
    return split


def _stats(c: _Clusters, split: np.ndarray, config: SplitConfig, mean: np.ndarray, scale: np.ndarray, objective: float, fallback: bool) -> dict:
    shares = (config.train_pct, config.val_pct, config.test_pct)
    n = int(c.sizes.sum())
    have = np.bincount(split, c.sizes, len(SPLITS))
    low, high = bounds_of(n, shares, len(c.ids))
    by = lambda values: dict(zip(SPLITS, values, strict=True))
    out = {
        "method": "balanced-greedy" if config.balance else "size-greedy", "target_sizes": by([n * s for s in shares]), "observed_sizes": by(map(int, have)), "size_errors": by([float(h - n * s) for h, s in zip(have, shares, strict=True)]),
        "balance_weight": config.balance_weight if config.balance else 0.0, "feature_names": list(S.FEATURE_NAMES) if len(mean) else [], "objective": float(objective), "local_search_iterations": config.local_search_iterations, "stratify_labels": config.stratify_labels,
        "hard_size_bounds": by({"min": a, "max": b} for a, b in zip(low, high, strict=True)), "size_constraint_fallback": fallback,
    }
    if len(mean):
        out["feature_mean_abs_error"] = by([float(np.mean(np.abs((c.sums[split == i].sum(0) / have[i] - mean) / scale))) if have[i] else None for i in range(len(SPLITS))])
    return out


def frontier(points: list[dict]) -> list[dict]:
    """Points (size_error, composition_error, ...) that no other is at least as good as in both and better in one."""
    better = lambda a, b: a["size_error"] <= b["size_error"] and a["composition_error"] <= b["composition_error"] and (a["size_error"] < b["size_error"] or a["composition_error"] < b["composition_error"])
    return [p for p in points if not any(better(q, p) for q in points)]


def assign_clusters(records: DataFrame, labels: DataFrame, config: SplitConfig) -> Assignment:
    """Whole clusters to splits.  records (rid, label, seq), labels (rid, cluster_id), a partition of the records.

    Largest first (ties in seeded order), each cluster goes where it costs least: size error, with ``balance`` also the
    distance of the split's composition from the whole within the size bounds, with ``stratify_labels`` the error of the
    positives; then local search and the Pareto frontier as asked for.  Defined results: no records give an empty
    assignment; with ties train comes before val before test; null and empty sequences count 0 for every feature.
    """
    check_partition(labels, records)
    composed = config.balance
    if composed:
        table = cluster_features(records, labels)
    else:
        table = records.join(labels.select("rid", "cluster_id"), "rid").groupBy("cluster_id").agg(F.count("*").alias("size"), F.count_if(F.col("label") == 1).alias("positives"))
    mean, scale = _scales(records) if composed else (np.zeros(0), np.ones(0))
    edges = None
    if composed and config.balance_metric != "mean":
        bins, edges = _histograms(records, labels)
        table = table.join(bins, "cluster_id")
    table = graph.cut(table)
    if table.count() > MOST_CLUSTERS:
        raise ValueError(f"more than {MOST_CLUSTERS} clusters: use greedy_split, which needs their sizes only")
    c = _read(table, config.seed, len(mean), edges is not None)
    split, objective, fallback = _place(c, config, mean, scale, edges)
    if config.local_search_iterations and len(c.ids) > 1:
        split = _search(c, split, config, mean, scale)
    stats = _stats(c, split, config, mean, scale, objective, fallback)
    if config.pareto_points > 1:
        points = []
        for i in range(config.pareto_points):
            weight = i / (config.pareto_points - 1)
            other = config.with_(balance_weight=weight, pareto_points=0)
            own, cost, fell = _place(c, other, mean, scale, edges)
            if config.local_search_iterations and len(c.ids) > 1:
                own = _search(c, own, other, mean, scale)
            s = _stats(c, own, other, mean, scale, cost, fell)
            errors = [x for x in s.get("feature_mean_abs_error", {}).values() if x is not None]
            points.append({"balance_weight": round(weight, 6), "size_error": float(sum(map(abs, s["size_errors"].values()))), "composition_error": float(sum(errors)), "observed_sizes": s["observed_sizes"]})
        stats["pareto_frontier"] = frontier(points)
    spark = records.sparkSession
    import pandas as pd

    rows = pd.DataFrame({"cluster_id": c.ids, "size": c.sizes, "split": [SPLITS[i] for i in split]})
    placed = spark.createDataFrame(rows, "cluster_id long, size long, split string") if len(rows) else spark.createDataFrame([], "cluster_id long, size long, split string")
    return Assignment(placed, stats)


def fold_splits(labels: DataFrame, folded: DataFrame, k: int) -> DataFrame:
    """(fold, rid, split): for each of the k folds, its clusters' records are test and all others train.  labels (rid, cluster_id), folded (cluster_id, fold)."""
    own = labels.select("rid", "cluster_id").join(folded.select("cluster_id", F.col("fold").alias("own")), "cluster_id")
    each = F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("fold")
    return own.select("rid", "own", each).select("fold", "rid", F.when(F.col("fold") == F.col("own"), "test").otherwise("train").alias("split"))
