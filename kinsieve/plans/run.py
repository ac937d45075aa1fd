"""Whole runs: split a FASTA file or audit finished splits, with statistics, reports and plots in a folder.

Records go through Spark; the folder gets one FASTA file for each split, streamed through the driver,
and small files: stats.json, report.txt, report.html, config.json and, where matplotlib is installed, plots.
"""

from __future__ import annotations

import html
import json
import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinsieve.config import SplitConfig
from kinsieve.operators import audit, cluster, graph, plots
from kinsieve.operators.assign import SPLITS
from kinsieve.sources import records as R


def _say(words: str) -> None:
    print(f"[kinsieve] {words}", file=sys.stderr)


def _number(value: float | None, digits: int) -> str:
    return "n/a" if value is None else f"{value:.{digits}f}"


def text_report(stats: dict, mode: str) -> str:
    """The statistics as plain text."""
    c = stats["clustering_mode"]
    out = [f"Split diagnostics ({mode})", "", "Options"]
    out += [f"  {name}: {c.get(name)}" for name in ("reduced_alphabet", "verify_with", "prefilter_threshold", "similarity_threshold", "kmer_sizes", "num_hashes", "max_candidate_pairs", "seed")]
    warned = False
    if found := stats.get("candidate_generation"):
        out += ["", "Candidate pairs", f"  considered: {found.get('candidate_pairs_considered', 0)}", f"  verified: {found.get('candidate_pairs_verified', 0)}", f"  records in dense buckets: {found.get('dense_bucket_records', 0)}"]
        if found.get("candidate_limit_reached"):
            warned = True
            out.append("  WARNING: more candidate pairs than max_candidate_pairs; all of them were compared.")
    out += ["", "Sizes", *(f"  {s}: {n}" for s, n in stats["sizes"].items())]
    if k := stats.get("clustering"):
        out += ["", "Clusters", f"  accepted edges: {k.get('accepted_edges', 0)}", f"  clusters: {k.get('cluster_count', 'n/a')}", f"  singletons: {k.get('singleton_count', 'n/a')}", f"  records in clusters of two or more: {_number(k.get('non_singleton_fraction'), 3)}", f"  sizes: {k.get('cluster_size_distribution', {})}"]
        if look := k.get("preflight_redundancy"):
            out.append(f"  redundancy of a sample: mean {_number(look['mean_similarity'], 3)}, share above 0 {_number(look['fraction_nonzero'], 3)}")
            if look["fraction_nonzero"] == 0:
                out.append("  WARNING: the sample shares no k-mer; look at the k-mer sizes and the alphabet.")
        if k.get("candidate_recall_benchmark") is not None:
            out.append(f"  recall against brute force: {k['candidate_recall_benchmark']:.3f}")
        out.append(f"  scores accepted and rejected: {k.get('accepted_score_histogram', [])} / {k.get('rejected_score_histogram', [])}")
    balance = stats["feature_balance"]["summary"]
    out += ["", f"Balance of composition: {balance['status']} (largest normalised distance {balance['max_normalized_divergence']:.3f}, limit {balance['threshold']:.3f})"]
    if note := stats.get("cluster_quality_meta", {}).get("warning"):
        out.append(f"WARNING: {note}.")
    if a := stats.get("assignment"):
        out += ["", "Assignment", f"  method: {a.get('method', 'n/a')}", f"  targets: {a.get('target_sizes', {})}", f"  observed: {a.get('observed_sizes', {})}"]
    if stats["label_counts"]:
        out += ["", "Labels", *(f"  {s}: 0: {v['0']}, 1: {v['1']}, none: {v['unlabeled']}" for s, v in stats["label_counts"].items())]
    out += ["", "Lengths", *(f"  {s}: mean {_number(v['mean'], 2)}, deviation {_number(v['std'], 2)}, from {v['min']} to {v['max']}" for s, v in stats["length"].items())]
    out += ["", "Similarity of sampled pairs", *(f"  {p}: mean {_number(v['mean_jaccard'], 3)}, deviation {_number(v['std'], 3)}, pairs {v['n_pairs']}" for p, v in stats["similarity"].items())]
    near = stats["nearest_neighbor_similarity"]
    out += ["", "Nearest train record", *(f"  {p}: mean {_number(near[p].get('mean'), 3)}, 95 % {_number(near[p].get('p95'), 3)}, most {_number(near[p].get('max'), 3)}" for p in ("test_to_train", "val_to_train"))]
    q = stats["cluster_quality"]
    out += ["", "Cluster quality", f"  silhouette: {_number(q['silhouette'], 3)}", f"  Davies-Bouldin: {_number(q['davies_bouldin'], 3)}", f"  Calinski-Harabasz: {_number(q['calinski_harabasz'], 3)}"]
    for title, name, most in (("Similarity warnings", "homology_warnings", 10), ("Distance warnings", "ood_warnings", 20)):
        if found := stats[name]:
            out += ["", title, *(f"  ! {w}" for w in found[:most]), *([f"  and {len(found) - most} more"] if len(found) > most else [])]
    if not stats["homology_warnings"] and not stats["ood_warnings"] and not warned:
        out += ["", "No warning.  That is no proof that the splits are free of leakage."]
    return "\n".join([*out, "", "These figures describe the splits; they don't replace a validation for the purpose at hand."])


def html_report(stats: dict, mode: str) -> str:
    """The text report and the statistics as one page without outside parts."""
    raw = html.escape(json.dumps(stats, indent=2, allow_nan=False))
    return f"<!doctype html><html><head><meta charset='utf-8'><title>Split diagnostics</title></head><body><h1>Split diagnostics ({html.escape(mode)})</h1><pre>{html.escape(text_report(stats, mode))}</pre><details><summary>stats.json</summary><pre>{raw}</pre></details></body></html>"


def draw(splits: DataFrame, folder: str, k: int, scored: DataFrame | None = None, threshold: float = 0.5) -> list[str]:
    """PNG files of the plot data; none without matplotlib."""
    try:
        import matplotlib
    except ImportError:
        _say("no plots: matplotlib is not installed")
        return []
    matplotlib.use("Agg")
    import matplotlib.pyplot as plt

    out = []

    def picture(name: str, paint) -> None:
        fig, ax = plt.subplots(figsize=(8, 5))
        paint(ax)
        fig.tight_layout()
        fig.savefig(f"{folder}/{name}.png", dpi=120)
        plt.close(fig)
        out.append(f"{folder}/{name}.png")

    def by(rows, key):
        kept: dict = {}
        for r in rows:
            kept.setdefault(tuple(r[x] for x in key), []).append(r)
        return kept

    sizes = {r["split"]: r["count"] for r in splits.groupBy("split").count().collect()}
    picture("split_sizes", lambda ax: ax.bar(SPLITS, [sizes.get(s, 0) for s in SPLITS]))
    lengths = by(plots.length_density(splits).orderBy("split", "bin").collect(), ["split"])
    picture("lengths", lambda ax: ([ax.step([r["low"] for r in v], [r["density"] for r in v], label=key[0]) for key, v in lengths.items()], ax.legend()))
    boxes = plots.boxes(splits).orderBy("feature", "split").collect()
    picture("features", lambda ax: ax.bxp([{"label": f"{r['feature']}\n{r['split']}", "q1": r["q1"], "med": r["q2"], "q3": r["q3"], "whislo": r["low"], "whishi": r["high"]} for r in boxes], showfliers=False))
    points = by(plots.kmer_pca(splits, k).collect(), ["split"])
    picture("kmer_pca", lambda ax: ([ax.scatter([r["pc1"] for r in v], [r["pc2"] for r in v], s=8, label=key[0]) for key, v in points.items()], ax.legend()))
    similar = by(plots.similarity_histogram(splits, k).orderBy("bin").collect(), ["s1", "s2"])
    picture("similarity", lambda ax: ([ax.step([r["bin"] / 30 for r in v], [r["n"] for r in v], label="-".join(key)) for key, v in similar.items()], ax.legend()))
    quantiles = by(plots.qq(splits).orderBy("p").collect(), ["feature", "split"])
    picture("qq", lambda ax: ([ax.plot([r["whole"] for r in v], [r["own"] for r in v], label=" ".join(key)) for key, v in quantiles.items()], ax.legend()))
    if scored is not None:
        stairs = by(plots.score_stairs(scored, threshold).orderBy("bin").collect(), ["accepted"])
        picture("scores", lambda ax: ([ax.step([r["bin"] / 20 for r in v], [r["n"] for r in v], label="accepted" if key[0] else "rejected") for key, v in stairs.items()], ax.legend()))
    if (bars := plots.label_bars(splits)) is not None:
        rows = bars.orderBy("split", "label").collect()
        picture("labels", lambda ax: ax.bar([f"{r['split']} {r['label']}" for r in rows], [r["n"] for r in rows]))
    return out


def _write(splits: DataFrame, folder: str, config: SplitConfig, mode: str, fasta: bool, stats: dict, scored: DataFrame | None, threshold: float) -> dict:
    os.makedirs(folder, exist_ok=True)
    if fasta:
        for s in SPLITS:
            R.write_fasta_file(splits.where(F.col("split") == s), f"{folder}/{s}.fasta")
            _say(f"{stats['sizes'][s]} records to {folder}/{s}.fasta")
    for name, words in (("stats.json", json.dumps(stats, indent=2, allow_nan=False) + "\n"), ("config.json", json.dumps(config.as_dict(), indent=2) + "\n"), ("report.txt", text_report(stats, mode)), ("report.html", html_report(stats, mode))):
        with open(f"{folder}/{name}", "w", encoding="utf-8") as out:
            out.write(words)
    draw(splits, folder, config.kmer_sizes[0], scored, threshold)
    print(text_report(stats, mode))
    return stats


def run_split(spark: SparkSession, path: str, folder: str, config: SplitConfig) -> dict:
    """Split a FASTA file into train, val and test; the statistics that were written.

    With strict clustering a test record too similar to train is an error before anything is written; dry_run writes no FASTA files.
    """
    records = graph.cut(R.read_fasta(spark, path))
    n = records.count()
    if not n:
        raise ValueError(f"no sequences in {path}")
    _say(f"{n} records read from {path}")
    done = cluster.split_run(records, config)
    splits = graph.cut(done.splits)
    if config.strict_clustering:
        audit.leakage_gate(splits, config.kmer_sizes[0], config.similarity_threshold)
    stats = audit.summarize(splits, config, done.labels, done.assignment, done.clustering)
    if done.clustering:
        stats["candidate_generation"] = dict(done.clustering)
    return _write(splits, folder, config, "split", not config.dry_run, stats, done.scored, done.threshold)


def run_audit(spark: SparkSession, source: str, folder: str, config: SplitConfig) -> dict:
    """Audit a folder of train, val and test FASTA files."""
    splits = graph.cut(R.read_splits(spark, source))
    return _write(splits, folder, config, "audit", False, audit.summarize(splits, config), None, config.similarity_threshold)
