"""Plot data as tables; kinsieve.plans.run draws them where matplotlib is installed.

Splits have the columns rid, label, seq and split.  Histograms, quartiles and counts cover all records; the k-mer
matrix and the similarity histograms take a bounded sample, as their feature.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinsieve.functions import sequence as S
from kinsieve.operators import audit, pairs

BOX_FEATURES = ("aromaticity", "charge", "hydrophobicity", "length", "mw", "unknown_fraction")
QQ_FEATURES = ("length", "hydrophobicity", "charge")


def length_density(splits: DataFrame, bins: int = 30) -> DataFrame:
    """(split, bin, low, high, n, density): lengths of each split in bins over its own range; a split of one length has one bin of width 1."""
    own = splits.select("split", F.length("seq").cast("double").alias("v"))
    ends = own.groupBy("split").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("*").alias("total"))  # a row for each split
    width = F.when(F.col("hi") > F.col("lo"), (F.col("hi") - F.col("lo")) / bins).otherwise(F.lit(1.0))
    at = F.least(F.lit(bins - 1), F.floor((F.col("v") - F.col("lo")) / width)).cast("int")
    counted = own.join(F.broadcast(ends), "split").groupBy("split", "lo", "total", width.alias("width"), at.alias("bin")).agg(F.count("*").alias("n"))
    low = F.col("lo") + F.col("bin") * F.col("width")
    return counted.select("split", "bin", low.alias("low"), (low + F.col("width")).alias("high"), "n", (F.col("n") / (F.col("total") * F.col("width"))).alias("density"))


def boxes(splits: DataFrame, features: tuple[str, ...] = BOX_FEATURES, digits: int | None = None) -> DataFrame:
    """(feature, split, q1, q2, q3, low, high): quartiles, and whiskers at the outermost values within 1.5 times their distance."""
    own = audit.feature_values(splits, digits).where(F.col("feature").isin(*features))
    q = [F.percentile("v", F.lit(p)).alias(n) for p, n in ((0.25, "q1"), (0.5, "q2"), (0.75, "q3"))]
    quartiles = own.groupBy("feature", "split").agg(*q)  # features times splits rows
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    near = own.join(F.broadcast(quartiles), ["feature", "split"]).where((F.col("v") >= F.col("q1") - reach) & (F.col("v") <= F.col("q3") + reach))
    return near.groupBy("feature", "split", "q1", "q2", "q3").agg(F.min("v").alias("low"), F.max("v").alias("high"))


def vocabulary(records: DataFrame, k: int, top: int = 512) -> DataFrame:
    """(kmer, df): the ``top`` k-mers by document frequency, ties by k-mer."""
    return pairs.kmer_rows(records, k).groupBy("kmer").agg(F.count("*").alias("df")).orderBy(F.desc("df"), "kmer").limit(top)


def kmer_matrix(splits: DataFrame, k: int, most: int = 1000, top: int = 512, seed: int = 42) -> tuple[list[tuple], list[str], np.ndarray]:
    """((rid, split) rows, k-mers, 0/1 matrix) of at most ``most`` records, in seeded order, and the ``top`` k-mers of them."""
    own = splits.orderBy(*audit.seeded(seed)).limit(most)
    words = [r["kmer"] for r in vocabulary(own, k, top).collect()]
    place = {w: j for j, w in enumerate(words)}
    rows, cells = [], []
    for r in own.select("rid", "split", S.kmers(F.col("seq"), k).alias("ks")).collect():  # at most ``most`` rows
        cells += [(len(rows), place[x]) for x in r["ks"] if x in place]
        rows.append((r["rid"], r["split"]))
    out = np.zeros((len(rows), len(words)))
    if cells:
        out[tuple(np.array(cells).T)] = 1.0
    return rows, words, out


def kmer_pca(splits: DataFrame, k: int, most: int = 1000, top: int = 512, seed: int = 42) -> DataFrame:
    """(rid, split, pc1, pc2) of the sampled records: the matrix is centred and projected on its two first principal axes.

    An axis points so that its largest weight (the first of equal ones) is positive.  With fewer than two axes the rest is 0.
    """
    rows, _, m = kmer_matrix(splits, k, most, top, seed)
    xy = np.zeros((len(rows), 2))
    if m.size:
        centred = m - m.mean(0)
        u, s, v = np.linalg.svd(centred, full_matrices=False)
        for j in range(min(2, len(s))):
            if s[j] > 1e-12:
                xy[:, j] = u[:, j] * s[j] * (1.0 if v[j][np.abs(v[j]).argmax()] >= 0 else -1.0)
    spark = splits.sparkSession
    return spark.createDataFrame([(*r, float(x), float(y)) for r, (x, y) in zip(rows, xy, strict=True)], "rid long, split string, pc1 double, pc2 double")


def umap_points(splits: DataFrame, k: int, most: int = 1000, top: int = 512, seed: int = 42) -> DataFrame:
    """As kmer_pca, by UMAP; needs the package umap-learn, else an ImportError tells so."""
    try:
        from umap import UMAP
    except ImportError as e:
        raise ImportError("umap_points needs the package umap-learn") from e
    rows, _, m = kmer_matrix(splits, k, most, top, seed)
    xy = UMAP(random_state=seed, metric="jaccard").fit_transform(m.astype(bool))
    return splits.sparkSession.createDataFrame([(*r, float(x), float(y)) for r, (x, y) in zip(rows, xy, strict=True)], "rid long, split string, x double, y double")


def similarity_histogram(splits: DataFrame, k: int = 3, cap: int = 300, bins: int = 30, seed: int = 42) -> DataFrame:
    """(s1, s2, bin, n): similarities within and between splits of a bounded sample, in even bins from 0 to 1."""
    at = F.least(F.lit(bins - 1), F.floor(F.col("s") * bins)).cast("int")
    return audit.similarity_scores(splits, k, cap, seed).groupBy("s1", "s2", at.alias("bin")).agg(F.count("*").alias("n"))


def qq(splits: DataFrame, features: tuple[str, ...] = QQ_FEATURES, points: int = 100) -> DataFrame:
    """(feature, split, p, whole, own): quantiles of each split against those of all records, at even steps from 0 to 1."""
    at = [i / (points - 1) for i in range(points)]
    own = audit.feature_values(splits).where(F.col("feature").isin(*features))
    q = lambda df, *keys: df.groupBy(*keys).agg(F.percentile("v", F.array(*map(F.lit, at))).alias("q"))
    both = q(own, "feature", "split").withColumnRenamed("q", "o").join(F.broadcast(q(own, "feature").withColumnRenamed("q", "w")), "feature")
    rows = both.select("feature", "split", F.posexplode(F.arrays_zip("w", "o")).alias("i", "x"))
    return rows.select("feature", "split", (F.col("i") / (points - 1)).alias("p"), F.col("x.w").alias("whole"), F.col("x.o").alias("own"))


def score_stairs(scored: DataFrame, threshold: float, bins: int = 20) -> DataFrame:
    """(accepted, bin, n): scores of compared pairs, apart for those at or over the threshold."""
    at = F.least(F.lit(bins - 1), F.floor(F.col("score") * bins)).cast("int")
    return scored.groupBy((F.col("score") >= threshold).alias("accepted"), at.alias("bin")).agg(F.count("*").alias("n"))


def label_bars(splits: DataFrame) -> DataFrame | None:
    """(split, label, n) of labelled records; None where no record has a label."""
    own = splits.where("label is not null")
    return own.groupBy("split", "label").agg(F.count("*").alias("n")) if own.limit(1).count() else None
