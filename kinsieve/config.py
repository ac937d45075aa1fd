"""Options of a run: validated once, never changed.

backend chooses how sketches are computed: numpy (an Arrow function, also for auto); asking for
native is an error.  balance_report asks for the summary of the balance, which every run writes.
"""

from __future__ import annotations

import math
from dataclasses import asdict, dataclass, field, replace

CHOICES = {
    "reduced_alphabet": ("none", "groups5", "groups7"), "verify_with": ("none", "kmer-exact", "levenshtein", "containment", "cosine"), "metric_aggregation": ("max", "mean", "vote", "weighted"),
    "balance_metric": ("mean", "wasserstein", "ks"), "backend": ("auto", "numpy", "native"), "cluster_method": ("components", "label-propagation"), "short_peptide_mode": ("ignore", "warn", "auto"),
}
_UNIT = ("similarity_threshold", "prefilter_threshold", "min_non_singleton_fraction", "balance_weight")
_LEAST = {"num_hashes": 4, "max_candidate_pairs": 1, "exact_mode_max_sequences": 2, "local_search_iterations": 0, "pareto_points": 0, "diagnostics_sample_size": 1}
FLAGS = ("no_clustering", "strict_clustering", "balance", "balance_report", "stratify_labels", "dry_run", "exact_mode", "adaptive_threshold")


@dataclass(frozen=True)
class SplitConfig:
    train_pct: float = 0.8
    val_pct: float = 0.1
    test_pct: float = 0.1
    kmer_sizes: tuple[int, ...] = (3,)
    num_hashes: int = 128
    similarity_threshold: float = 0.5
    prefilter_threshold: float = 0.3
    min_non_singleton_fraction: float = 0.05
    balance_weight: float = 1.0
    reduced_alphabet: str = "none"
    verify_with: str = "none"
    verification_metrics: tuple[str, ...] = ()
    metric_aggregation: str = "max"
    metric_weights: tuple[float, ...] = ()
    balance_metric: str = "wasserstein"
    backend: str = "auto"
    cluster_method: str = "components"
    short_peptide_mode: str = "warn"
    seed: int = 42
    no_clustering: bool = False
    strict_clustering: bool = False
    balance: bool = False
    balance_report: bool = False
    stratify_labels: bool = False
    dry_run: bool = False
    exact_mode: bool = False
    adaptive_threshold: bool = False
    max_candidate_pairs: int = 250_000
    exact_mode_max_sequences: int = 50_000
    local_search_iterations: int = 0
    pareto_points: int = 0
    diagnostics_sample_size: int = 10_000
    lsh_rows: tuple[int, ...] = (2, 4, 8)
    external_clusters: str | None = field(default=None)

    def __post_init__(self) -> None:
        put = lambda name, value: object.__setattr__(self, name, value)
        parts = [self.train_pct, self.val_pct, self.test_pct]
        if any(isinstance(p, bool) or not math.isfinite(p) or p < 0 for p in parts) or sum(parts) <= 0:
            raise ValueError("percentages must be finite, not negative, and not all 0")
        for name, p in zip(("train_pct", "val_pct", "test_pct"), parts, strict=True):
            put(name, p / sum(parts))
        for name, among in CHOICES.items():
            if getattr(self, name) not in among:
                raise ValueError(f"{name} must be one of {', '.join(among)}")
        for name in ("kmer_sizes", "lsh_rows"):
            value = tuple(getattr(self, name))
            if not value or any(isinstance(v, bool) or not isinstance(v, int) or v < 1 for v in value):
                raise ValueError(f"{name} must be integers of 1 or more")
            put(name, value)
        for name in _UNIT:
            v = getattr(self, name)
            if isinstance(v, bool) or not math.isfinite(v) or not 0 <= v <= 1:
                raise ValueError(f"{name} must be from 0 to 1")
        for name, least in _LEAST.items():
            v = getattr(self, name)
            if isinstance(v, bool) or not isinstance(v, int) or v < least:
                raise ValueError(f"{name} must be an integer of {least} or more")
        for name in FLAGS:
            if not isinstance(getattr(self, name), bool):
                raise ValueError(f"{name} must be true or false")
        if self.backend == "native":
            raise ValueError("backend: sketches are made by array operations; there is no native device backend")
        if isinstance(self.seed, bool) or not isinstance(self.seed, int) or not 0 <= self.seed < 2**32:
            raise ValueError("seed must be from 0 to 2**32 - 1")
        metrics = tuple(dict.fromkeys(self.verification_metrics)) or ((self.verify_with,) if self.verify_with != "none" else ())
        if any(m not in CHOICES["verify_with"][1:] for m in metrics):
            raise ValueError("unknown verification metric")
        put("verification_metrics", metrics)
        if metrics and self.verify_with == "none":
            put("verify_with", metrics[0])
        if metrics and self.prefilter_threshold > self.similarity_threshold:
            raise ValueError("prefilter_threshold must not be over similarity_threshold")
        if self.metric_aggregation == "weighted" and (len(self.metric_weights) != len(metrics) or sum(self.metric_weights) <= 0 or min(self.metric_weights) < 0):
            raise ValueError("weighted needs a weight for each metric, with a positive sum")

    def as_dict(self) -> dict:
        out = asdict(self)
        if not self.verification_metrics:
            out["prefilter_threshold"] = None
        return out

    def with_(self, **changes) -> SplitConfig:
        return replace(self, **changes)
