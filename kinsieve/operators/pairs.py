"""Similarity joins: exact set similarity by an inverted index, MinHash bands, edit distance, nearest neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinsieve.functions import sequence as S


def representatives(records: DataFrame) -> DataFrame:
    """records with rep, the least rid of equal sequences."""
    return records.withColumn("rep", F.min("rid").over(Window.partitionBy("seq")))


def unique_records(records: DataFrame) -> DataFrame:
    """One record for each distinct sequence; aggregated map-side, so hot sequences don't gather."""
    return records.groupBy("seq").agg(F.min("rid").alias("rid"))


def kmer_rows(records: DataFrame, k: int) -> DataFrame:
    """(rid, n, kmer): an inverted index with each set's size."""
    sets = records.select("rid", S.kmers(F.col("seq"), k).alias("kmers")).where(F.size("kmers") > 0)
    return sets.select("rid", F.size("kmers").alias("n"), F.explode("kmers").alias("kmer"))


def common_kmers(records: DataFrame, k: int, least: float = 0.0, roots: DataFrame | None = None) -> DataFrame:
    """(a, b, na, nb, common) of pairs a < b that share a k-mer.

    With least > 0, only pairs of Jaccard similarity of at least that are kept whole: lengths
    are filtered in the join, and only each set's prefix by rising document frequency is indexed
    (pairs that similar must share a k-mer of both prefixes), so frequent k-mers don't join.
    With roots (rid, root), only pairs of different roots; a k-mer's largest root isn't joined with itself.
    """
    rows = kmer_rows(records, k)
    if least > 0:
        df = rows.groupBy("kmer").agg(F.count("*").alias("df"))
        order = Window.partitionBy("rid").orderBy("df", "kmer")
        ranked = rows.join(df, "kmer").withColumn("r", F.row_number().over(order))
        prefix = ranked.where(F.col("r") <= F.col("n") - F.ceil(F.col("n") * F.lit(float(least)) - 1e-9) + 1).select("rid", "n", "kmer")
        sets = rows.groupBy("rid").agg(F.collect_list("kmer").alias("ks"))
    else:
        prefix = rows
    a = prefix.select(F.col("rid").alias("a"), F.col("n").alias("na"), "kmer")
    b = prefix.select(F.col("rid").alias("b"), F.col("n").alias("nb"), "kmer")
    joined = a.join(b, "kmer").where("a < b") if roots is None else apart(prefix, roots)
    if least <= 0:
        return joined.groupBy("a", "b", "na", "nb").agg(F.count("*").alias("common"))
    near = joined.where(F.least("na", "nb") >= F.greatest("na", "nb") * F.lit(float(least)) - 1e-9).select("a", "b", "na", "nb").distinct()
    full = near.join(sets.select(F.col("rid").alias("a"), F.col("ks").alias("ka")), "a").join(sets.select(F.col("rid").alias("b"), F.col("ks").alias("kb")), "b")
    return full.select("a", "b", "na", "nb", F.size(F.array_intersect("ka", "kb")).cast("long").alias("common"))


def apart(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """(a, na, b, nb, kmer), a < b, of rows (rid, n, kmer) that share a k-mer but not a root (rid, root)."""
    posted = rows.join(roots.select("rid", "root"), "rid")
    each = posted.groupBy("kmer", "root").agg(F.count("*").alias("c"))
    tops = each.groupBy("kmer").agg(F.max(F.struct("c", "root"))["root"].alias("top"), F.count("*").alias("own")).where("own > 1").drop("own")
    mixed = posted.join(tops, "kmer")
    x = mixed.where("root <> top").select("kmer", F.struct("rid", "n").alias("x"), F.col("root").alias("rx"))
    y = mixed.select("kmer", F.struct("rid", "n").alias("y"), F.col("root").alias("ry"), "top")
    both = x.join(y, "kmer").where("rx <> ry and (ry = top or x.rid < y.rid)").select("kmer", F.least("x", "y").alias("l"), F.greatest("x", "y").alias("g"))
    return both.select(F.col("l.rid").alias("a"), F.col("l.n").alias("na"), F.col("g.rid").alias("b"), F.col("g.n").alias("nb"), "kmer")


def jaccard_pairs(records: DataFrame, k: int, threshold: float, roots: DataFrame | None = None) -> DataFrame:
    """(a, b, score) of pairs at or over the threshold; with roots (rid, root), of different roots."""
    score = S.jaccard(F.col("common"), F.col("na"), F.col("nb"))
    return common_kmers(records, k, threshold, roots).select("a", "b", score.alias("score")).where(F.col("score") >= threshold)


def metric_pairs(records: DataFrame, k: int) -> DataFrame:
    """(a, b, jaccard, containment, cosine, edit) of pairs that share a k-mer; sequences are joined in last."""
    seqs = records.select("rid", "seq")
    c = (F.col("common"), F.col("na"), F.col("nb"))
    pairs = common_kmers(records, k).join(seqs.select(F.col("rid").alias("a"), F.col("seq").alias("sa")), "a").join(seqs.select(F.col("rid").alias("b"), F.col("seq").alias("sb")), "b")
    return pairs.select("a", "b", S.jaccard(*c).alias("jaccard"), S.containment(*c).alias("containment"), S.cosine(*c).alias("cosine"), S.edit_identity(F.col("sa"), F.col("sb")).alias("edit"))


def aggregate_metrics(names: list[str], how: str, threshold: float, weights: list[float] | None = None):
    """One score of several metric columns: max, mean, vote (share at or over the threshold) or weighted."""
    cols = [F.col(n) for n in names]
    if how == "max":
        return F.greatest(*cols) if len(cols) > 1 else cols[0]
    if how == "mean":
        return sum(cols[1:], cols[0]) / len(cols)
    if how == "vote":
        return sum(((c >= threshold).cast("int") for c in cols), F.lit(0)) / len(cols)
    if how == "weighted":
        if not weights or len(weights) != len(cols) or sum(weights) <= 0 or min(weights) < 0:
            raise ValueError("weighted needs a weight for each metric, with a positive sum")
        return sum((c * F.lit(float(w)) for c, w in zip(cols, weights, strict=True)), F.lit(0.0)) / float(sum(weights))
    raise ValueError(f"unknown aggregation: {how}")


def edit_pairs(records: DataFrame, k: int, threshold: float) -> DataFrame:
    """(a, b, score) of candidates that share a k-mer and are near by edit distance, bounded by the threshold."""
    seqs = records.select("rid", "seq")
    pairs = common_kmers(records, k).join(seqs.select(F.col("rid").alias("a"), F.col("seq").alias("sa")), "a").join(seqs.select(F.col("rid").alias("b"), F.col("seq").alias("sb")), "b")
    bound = S.edit_bound(F.col("sa"), F.col("sb"), threshold)
    near = pairs.where(F.abs(F.length("sa") - F.length("sb")) <= bound)
    return near.select("a", "b", S.edit_identity(F.col("sa"), F.col("sb"), bound).alias("score")).where(F.col("score") >= threshold)


def sketches(records: DataFrame, k: int, hashes: int, seed: int) -> DataFrame:
    """(rid, sketch); k is added to the seed."""
    return records.select("rid", S.minhash(S.kmers(F.col("seq"), k), hashes, (seed + k) % 2**32).alias("sketch"))


def bands(sketched: DataFrame, hashes: int, rows: int) -> DataFrame:
    """(band, key, rid): slices of the sketches; the last may be short."""
    n = -(-hashes // rows)
    return sketched.select("rid", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.slice("sketch", i * rows + 1, F.lit(rows)))).alias("band", "key"))


def band_pairs(sketched: DataFrame, hashes: int, rows: int, dense: int = 128, neighbours: int = 8, seed: int = 42, by_band: bool = False) -> DataFrame:
    """(a, b) of records that share a band.

    Buckets of more than ``dense`` members are not expanded: their members, in a seeded order
    (of each band its own with by_band), are linked around a ring to their next neighbours, at
    linear cost.  Other pairs of such a bucket are not proposed, and once pairs below a threshold
    are dropped the ring may fall apart: cluster() takes dense_members through an exact join.
    """
    rows_ = bands(sketched, hashes, rows).where(F.element_at("key", 1) < S.PRIME)
    sized = rows_.groupBy("band", "key").agg(F.count("*").alias("m")).where("m > 1")
    own = rows_.join(sized, ["band", "key"])
    small = own.where(F.col("m") <= dense)
    pairs = small.select("band", "key", F.col("rid").alias("a")).join(small.select("band", "key", F.col("rid").alias("b")), ["band", "key"]).where("a < b").select("a", "b")
    salt = [F.col("band").cast("string"), F.lit(":")] if by_band else []
    order = Window.partitionBy("band", "key").orderBy(F.md5(F.concat(F.lit(f"{seed}:"), *salt, F.col("rid").cast("string"))), "rid")
    ring = own.where(F.col("m") > dense).withColumn("p", F.row_number().over(order) - 1)
    step = ring.select("band", "key", F.col("rid").alias("x"), "m", F.explode(F.expr(f"sequence(1, int(least({neighbours}, (m - 1) div 2)))")).alias("o"), "p").withColumn("q", (F.col("p") + F.col("o")) % F.col("m"))
    around = step.join(ring.select("band", "key", F.col("rid").alias("y"), F.col("p").alias("q")), ["band", "key", "q"]).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    return pairs.unionByName(around).distinct()


def dense_members(sketched: DataFrame, hashes: int, rows: int, dense: int = 128) -> DataFrame:
    """(rid) of the records in buckets of more than ``dense`` members, which band_pairs does not expand."""
    rows_ = bands(sketched, hashes, rows).where(F.element_at("key", 1) < S.PRIME)
    return rows_.join(rows_.groupBy("band", "key").agg(F.count("*").alias("m")).where(F.col("m") > dense), ["band", "key"]).select("rid").distinct()


def nearest(query: DataFrame, reference: DataFrame, k: int, also: tuple[str, ...] = ()) -> DataFrame:
    """(rid, also..., score, ref): each query record's most similar reference record; ties take the largest rid; 0 and null without a shared k-mer.

    Equal sequences have equal scores, so only distinct ones meet on their k-mers, a reference sequence under its largest rid.
    """
    q = kmer_rows(unique_records(query), k).select(F.col("rid").alias("q"), F.col("n").alias("nq"), "kmer")
    r = kmer_rows(reference.groupBy("seq").agg(F.max("rid").alias("rid")), k).select(F.col("rid").alias("r"), F.col("n").alias("nr"), "kmer")
    c = q.join(r, "kmer").groupBy("q", "r", "nq", "nr").agg(F.count("*").alias("c"))
    best = c.groupBy("q").agg(F.max(F.struct(S.jaccard(F.col("c"), F.col("nq"), F.col("nr")).alias("score"), F.col("r").alias("ref"))).alias("x"))
    found = unique_records(query).join(best, F.col("rid") == F.col("q")).select("seq", "x")
    return query.select("rid", "seq", *also).join(found, "seq", "left").select("rid", *also, F.coalesce("x.score", F.lit(0.0)).alias("score"), F.col("x.ref").alias("ref"))
