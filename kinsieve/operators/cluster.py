"""Clustering of records by set similarity, and what the run reports."""

from __future__ import annotations

import sys
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinsieve.config import SplitConfig
from kinsieve.functions import sequence as S
from kinsieve.operators import assign, audit, balance, diagnostics, graph, pairs
from kinsieve.sources import records as R


@dataclass(frozen=True)
class Clustering:
    """labels: (rid, root, cluster_id); scored: (a, b, score) of compared pairs; edges: those accepted."""

    labels: DataFrame
    scored: DataFrame
    edges: DataFrame
    threshold: float
    kmer_sizes: tuple[int, ...]
    stats: dict


def effective(records: DataFrame, config: SplitConfig) -> tuple[tuple[int, ...], str, int]:
    """k-mer sizes, alphabet and the number of records too short, after the policy for short sequences."""
    ks, alphabet = config.kmer_sizes, config.reduced_alphabet
    short = records.where(F.length("seq") < min(ks)).count()
    if config.short_peptide_mode == "warn" and short:
        print(f"[kinsieve] {short} sequences are shorter than {min(ks)} and can't be compared", file=sys.stderr)
    if config.short_peptide_mode == "auto" and short:
        ks = (*ks, 2) if min(ks) > 2 else ks
        alphabet = "groups5" if alphabet == "none" else alphabet
    return ks, alphabet, short


def cluster(records: DataFrame, config: SplitConfig) -> Clustering:
    """Clusters of records (rid, seq): duplicates always together, others by accepted pairs of representatives."""
    total = records.count()
    if config.no_clustering or total < 2:
        spark = records.sparkSession
        none = spark.createDataFrame([], "a long, b long, score double")
        labels = records.select("rid", F.col("rid").alias("root"))
        return Clustering(graph.number_clusters(labels), none, none, config.similarity_threshold, config.kmer_sizes, unclustered_stats(total, config))
    ks, alphabet, short = effective(records, config)
    able = records.where(F.length("seq") >= min(ks))
    unique = graph.cut(pairs.unique_records(able))
    n_able, n_unique = able.count(), unique.count()
    shown = unique.withColumn("raw", F.col("seq")).withColumn("seq", S.reduce_alphabet(F.col("seq"), alphabet))
    exact = config.exact_mode
    if exact and n_unique > config.exact_mode_max_sequences:
        raise ValueError("exact mode has more sequences than exact_mode_max_sequences")
    if exact and n_unique * (n_unique - 1) // 2 > config.max_candidate_pairs:
        raise ValueError("max_candidate_pairs is below what exact mode needs")
    scored, dense, proposed = None, {}, 0
    for k in ks:
        if exact:
            found = pairs.common_kmers(shown, k).select("a", "b", S.jaccard(F.col("common"), F.col("na"), F.col("nb")).alias("score"))
        else:
            sk = graph.cut(pairs.sketches(shown, k, config.num_hashes, config.seed))
            near = hot = None
            for i, rows in enumerate(config.lsh_rows):
                own = pairs.band_pairs(sk, config.num_hashes, rows, seed=(config.seed + k * 1009 + i) % 2**32, by_band=True)
                near = own if near is None else near.unionByName(own)
                members = pairs.dense_members(sk, config.num_hashes, rows)
                hot = members if hot is None else hot.unionByName(members)
            hot = graph.cut(hot.distinct())
            if hot.limit(1).count():
                dense[k] = hot
            sets = shown.select("rid", S.kmers(F.col("seq"), k).alias("ks"))
            both = near.distinct().join(sets.select(F.col("rid").alias("a"), F.col("ks").alias("ka")), "a").join(sets.select(F.col("rid").alias("b"), F.col("ks").alias("kb")), "b")
            c = F.size(F.array_intersect("ka", "kb"))
            found = both.select("a", "b", S.jaccard(c, F.size("ka"), F.size("kb")).alias("score"))
        scored = found if scored is None else scored.unionByName(found)
    scored = scored.groupBy("a", "b").agg(F.max("score").alias("score"))
    if config.verify_with != "none":
        scored = scored.where(F.col("score") >= config.prefilter_threshold)
        scored = verified(scored, shown, ks, config)
    scored = graph.cut(scored)
    threshold = diagnostics.otsu(scored, config.similarity_threshold) if config.adaptive_threshold else config.similarity_threshold
    edges = scored.where(F.col("score") >= threshold)
    if dense:
        scored = graph.cut(scored.unionByName(dense_pairs(dense, shown, unique, edges, threshold, ks, config)).groupBy("a", "b").agg(F.max("score").alias("score")))
        edges = scored.where(F.col("score") >= threshold)
    finder = graph.component_labels if config.cluster_method == "components" else lambda n, e: graph.propagate_labels(n, e, config.seed)
    roots = finder(unique, edges)
    again = records.join(unique.join(roots, "rid").select("seq", "root"), "seq", "left").select("rid", F.coalesce("root", "rid").alias("root"))
    labels = graph.cut(graph.number_clusters(again))
    sizes = graph.cut(labels.groupBy("cluster_id").agg(F.count("*").alias("size")))
    considered, components = scored.count(), roots.select("root").distinct().count()
    verified_pairs = considered if config.verify_with != "none" else 0
    joined = n_unique - components  # accepted edges that join two components
    hot_records = sum(h.count() for h in dense.values())
    stats = {
        "input_sequences": total, "unique_sequences_with_kmers": n_unique, "duplicate_sequences_collapsed": n_able - n_unique, "short_sequences": short, "short_peptide_mode": config.short_peptide_mode,
        "candidate_pairs_considered": considered, "candidate_pairs_verified": max(verified_pairs, joined), "accepted_candidate_edges": joined, "accepted_edges": joined + n_able - n_unique, "dense_bucket_records": hot_records,
        "candidate_pair_limit": config.max_candidate_pairs, "candidate_limit_reached": considered > config.max_candidate_pairs, "lsh_rows_per_band": [0] if exact else list(config.lsh_rows), "exact_mode": exact,
        "adaptive_threshold": config.adaptive_threshold, "effective_similarity_threshold": threshold, "effective_kmer_sizes": list(ks), "verification_metrics": list(config.verification_metrics), "metric_aggregation": config.metric_aggregation,
        "accepted_score_histogram": histogram(scored), "rejected_score_histogram": histogram(scored.where(F.col("score") < threshold)), "cluster_method": config.cluster_method, "backend_requested": config.backend, "backend_used": "numpy",
    } | size_stats(sizes, total)
    stats["preflight_redundancy"] = audit.redundancy(shown, ks[0], seed=config.seed)
    probe = None if exact or config.verify_with != "none" else audit.recall_probe(shown, scored, ks[0], threshold, seed=config.seed)
    stats["candidate_recall_benchmark"] = probe["recall"] if probe else None
    if stats["candidate_limit_reached"]:
        print(f"[kinsieve] {considered} candidate pairs, more than max_candidate_pairs; all were compared", file=sys.stderr)
    if probe and probe["recall"] is not None and probe["recall"] < 0.95:
        print(f"[kinsieve] the bands find {probe['recall']:.3f} of the similar pairs of a sample; exact_mode finds all", file=sys.stderr)
    if config.strict_clustering and (stats["accepted_edges"] == 0 or stats["non_singleton_fraction"] < config.min_non_singleton_fraction):
        raise ValueError("strict clustering: no similarity was found, or too little")
    return Clustering(labels, scored, edges, threshold, ks, stats)


def size_stats(sizes: DataFrame, total: int) -> dict:
    """cluster_count, singleton_count, non_singleton_fraction and cluster_size_distribution of (cluster_id, size)."""
    by = {int(r["size"]): r["n"] for r in sizes.groupBy("size").agg(F.count("*").alias("n")).collect()}  # a row for each size
    return {"cluster_count": sum(by.values()), "singleton_count": by.get(1, 0), "non_singleton_fraction": sum(k * n for k, n in by.items() if k > 1) / max(1, total), "cluster_size_distribution": {str(k): by[k] for k in sorted(by)}}


def unclustered_stats(total: int, config: SplitConfig) -> dict:
    """Statistics where every record is a cluster of its own."""
    return {
        "input_sequences": total, "accepted_edges": 0, "accepted_candidate_edges": 0, "candidate_pairs_considered": 0, "candidate_pairs_verified": 0, "candidate_pair_limit": config.max_candidate_pairs, "candidate_limit_reached": False,
        "cluster_count": total, "singleton_count": total, "non_singleton_fraction": 0.0, "cluster_size_distribution": {"1": total} if total else {},
    }


def histogram(scored: DataFrame, bins: int = 20) -> list[int]:
    """Scores in even bins of [0, 1]; a score on an inner edge belongs to the bin that begins there, 1 to the last."""
    import numpy as np

    edges = np.linspace(0, 1, bins + 1).tolist()
    at = sum(((F.col("score") >= F.lit(e)).cast("int") for e in edges[1:-1]), F.lit(0))
    out = [0] * bins
    for r in scored.where("score between 0 and 1").groupBy(at.alias("bin")).count().collect():
        out[r["bin"]] = r["count"]
    return out


def dense_pairs(dense: dict[int, DataFrame], shown: DataFrame, unique: DataFrame, edges: DataFrame, threshold: float, ks: tuple[int, ...], config: SplitConfig) -> DataFrame:
    """(a, b, score) of the pairs among members of dense buckets, by k, that the ring left out, from an exact join.

    Components need only those that the edges leave apart; label propagation counts every edge.
    """
    roots = graph.cut(graph.component_labels(unique, edges)) if config.cluster_method == "components" else None
    least, found = threshold if config.verify_with == "none" else config.prefilter_threshold, None
    for k, hot in dense.items():
        own = pairs.jaccard_pairs(shown.join(hot, "rid"), k, least, roots)
        found = own if found is None else found.unionByName(own)
    found = found.groupBy("a", "b").agg(F.max("score").alias("score"))
    return found if config.verify_with == "none" else verified(found, shown, ks, config)


def verified(scored: DataFrame, shown: DataFrame, ks: tuple[int, ...], config: SplitConfig) -> DataFrame:
    """Candidates scored again by the verification metrics: sets on the reduced sequences, edit distance on the raw ones."""
    seqs = shown.select("rid", "seq", "raw")
    both = scored.select("a", "b").join(seqs.toDF("a", "sa", "ra"), "a").join(seqs.toDF("b", "sb", "rb"), "b")
    for m in config.verification_metrics:
        if m == "levenshtein":
            both = both.withColumn(m, S.edit_identity(F.col("ra"), F.col("rb"), S.edit_bound(F.col("ra"), F.col("rb"), config.similarity_threshold)))
            continue
        each = []
        for k in ks:
            ka, kb = S.kmers(F.col("sa"), k), S.kmers(F.col("sb"), k)
            measure = {"kmer-exact": S.jaccard, "containment": S.containment, "cosine": S.cosine}[m]
            each.append(measure(F.size(F.array_intersect(ka, kb)), F.size(ka), F.size(kb)))
        both = both.withColumn(m, F.greatest(*each) if len(each) > 1 else each[0])
    how = pairs.aggregate_metrics([f"`{m}`" for m in config.verification_metrics], config.metric_aggregation, config.similarity_threshold, list(config.metric_weights))
    return both.select("a", "b", how.alias("score"))


def hierarchical(scored: DataFrame, nodes: DataFrame, thresholds: list[float], least: float | None = None) -> DataFrame:
    """(threshold, rid, root): pairs are scored once, then cut at each threshold, highest first.  least: the prefilter of verified scores."""
    out = None
    if least is not None and any(t < least for t in thresholds):
        raise ValueError("a threshold is below the prefilter threshold, where pairs were not verified")
    for t in sorted(set(map(float, thresholds)), reverse=True):
        own = graph.component_labels(nodes, scored.where(F.col("score") >= t)).select(F.lit(t).alias("threshold"), "rid", "root")
        out = own if out is None else out.unionByName(own)
    return out


@dataclass(frozen=True)
class SplitRun:
    """splits: the records with cluster_id and split; labels: (rid, cluster_id); scored pairs where clusters were inferred; statistics of both steps."""

    splits: DataFrame
    labels: DataFrame
    threshold: float
    scored: DataFrame | None = None
    assignment: dict = field(default_factory=dict)
    clustering: dict = field(default_factory=dict)


def split_run(records: DataFrame, config: SplitConfig, external: DataFrame | None = None) -> SplitRun:
    """Splits of records (rid, label, seq, ...), in which clusters stay whole.

    Clusters are given (external (rid, cluster_id), or the file config.external_clusters, by place of the record), or
    each record is one (no_clustering: a random split, stratified by label where all have one), or they are inferred.
    By size alone the clusters' sizes are all that is read; with balance, label or search options the cluster table is walked through.
    """
    spark, shares = records.sparkSession, (config.train_pct, config.val_pct, config.test_pct)
    if external is None and config.external_clusters:
        external = R.read_clusters(spark, config.external_clusters, records.count())
    if external is None and config.no_clustering:
        if config.strict_clustering:
            raise ValueError("strict clustering needs clustering")
        out = graph.cut(assign.random_split(records, shares, config.seed).withColumn("cluster_id", F.col("rid")).select(*records.columns, "cluster_id", "split"))
        observed = dict.fromkeys(assign.SPLITS, 0) | {r["split"]: r["count"] for r in out.groupBy("split").count().collect()}
        return SplitRun(out, out.select("rid", "cluster_id"), config.similarity_threshold, None, {"method": "stratified-random", "observed_sizes": observed}, unclustered_stats(sum(observed.values()), config))
    scored, threshold = None, config.similarity_threshold
    if external is not None:
        labels = graph.cut(external.select("rid", "cluster_id"))
        balance.check_partition(labels, records)
        total = labels.count()
        stats = {"input_sequences": total, "source": config.external_clusters or "table", "external": True} | size_stats(labels.groupBy("cluster_id").agg(F.count("*").alias("size")), total)
        stats["accepted_edges"] = total - stats["cluster_count"]
    else:
        found = cluster(records, config)
        labels, scored, threshold, stats = found.labels.select("rid", "cluster_id"), found.scored, found.threshold, found.stats
    if config.balance or config.stratify_labels or config.local_search_iterations or config.pareto_points:
        done = balance.assign_clusters(records, labels, config)
        placed, assignment = done.placed, done.stats
    else:
        placed = graph.cut(assign.greedy_split(labels.groupBy("cluster_id").agg(F.count("*").alias("size")), shares, config.seed))
        n = labels.count()
        observed = dict.fromkeys(assign.SPLITS, 0) | {r["split"]: r["n"] for r in placed.groupBy("split").agg(F.sum("size").alias("n")).collect()}
        goal = dict(zip(assign.SPLITS, (n * s for s in shares), strict=True))
        assignment = {"method": "size-greedy", "target_sizes": goal, "observed_sizes": observed, "size_errors": {s: observed[s] - goal[s] for s in assign.SPLITS}}
    out = records.join(labels, "rid").join(placed.select("cluster_id", "split"), "cluster_id").select(*records.columns, "cluster_id", "split")
    return SplitRun(out, labels, threshold, scored, assignment, stats)


def split_records(records: DataFrame, config: SplitConfig, external: DataFrame | None = None) -> DataFrame:
    """records with cluster_id and split, see split_run."""
    return split_run(records, config, external).splits
