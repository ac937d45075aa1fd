"""Registered queries of the library with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinsieve.config import SplitConfig
from kinsieve.functions import sequence as S
from kinsieve.operators import assign, audit, balance, blocks, cluster, diagnostics, graph, pairs, plots
from kinsieve.sources import records as R

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def _query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _parts(spark: SparkSession, d: str) -> DataFrame:
    return R.from_table(_t(spark, d, "part"), "p_partkey", F.col("p_name"), F.col("p_size") % 2)


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return R.from_table(_t(spark, d, "documents"), "doc_id", F.replace("text", F.lit("ß"), F.lit("ss")))


def _r(c, name: str):
    return F.round(c, 9).alias(name)


REC = "rec AS (SELECT p_partkey AS rid, CAST(p_size % 2 AS INTEGER) AS label, upper(regexp_replace(p_name, '\\s+', '', 'g')) AS seq FROM part)"
DOC = "rec AS (SELECT doc_id AS rid, upper(regexp_replace(replace(coalesce(text, ''), 'ß', 'ss'), '\\s+', '', 'g')) AS seq FROM documents)"
UNI = "uni AS (SELECT seq, min(rid) AS rid FROM rec GROUP BY seq)"


def _km(k: int, table: str = "uni", name: str = "km") -> str:
    return f"{name} AS (SELECT rid, len(ks) AS n, unnest(ks) AS kmer FROM (SELECT rid, list_distinct(list_transform(range(1, len(seq) - {k} + 2), lambda i: substring(seq, i, {k}))) AS ks FROM {table} WHERE len(seq) >= {k}))"


COMMON = "com AS (SELECT x.rid AS a, y.rid AS b, x.n AS na, y.n AS nb, count(*) AS c FROM km x JOIN km y ON x.kmer = y.kmer AND x.rid < y.rid GROUP BY ALL)"
JACCARD = "c / CAST(na + nb - c AS DOUBLE)"


def _components(edges: str, nodes: str = "uni") -> str:
    """CTEs up to roots (rid, root): label of each node by a recursive walk."""
    return f"edge AS ({edges}), sym AS (SELECT a, b FROM edge UNION SELECT b, a FROM edge), walk(rid, seen) AS (SELECT rid, rid FROM {nodes} UNION SELECT s.b, w.seen FROM walk w JOIN sym s ON s.a = w.rid), roots AS (SELECT rid, min(seen) AS root FROM walk GROUP BY rid)"


def _greedy(sizes: str, key: str) -> str:
    """CTEs up to placed (key, size, split): the sequential greedy choice over clusters in order."""
    return (
        f"ord AS (SELECT {key} AS cid, size, row_number() OVER (ORDER BY size DESC, md5('42:' || CAST({key} AS VARCHAR)), {key}) AS r, CAST(sum(size) OVER () AS DOUBLE) AS n FROM {sizes}), "
        "g(r, a, b, c, split) AS (SELECT CAST(0 AS BIGINT), CAST(0 AS DOUBLE), CAST(0 AS DOUBLE), CAST(0 AS DOUBLE), '' UNION ALL "
        "SELECT r, a + CASE WHEN split = 'train' THEN size ELSE 0 END, b + CASE WHEN split = 'val' THEN size ELSE 0 END, c + CASE WHEN split = 'test' THEN size ELSE 0 END, split FROM ("
        "SELECT o.r, o.size, g.a, g.b, g.c, CASE WHEN da <= db AND da <= dc THEN 'train' WHEN db <= dc THEN 'val' ELSE 'test' END AS split FROM g JOIN ord o ON o.r = g.r + 1, "
        "LATERAL (SELECT abs(g.a + o.size - o.n * 0.8::DOUBLE) - abs(g.a - o.n * 0.8::DOUBLE) AS da, abs(g.b + o.size - o.n * 0.1::DOUBLE) - abs(g.b - o.n * 0.1::DOUBLE) AS db, abs(g.c + o.size - o.n * 0.1::DOUBLE) - abs(g.c - o.n * 0.1::DOUBLE) AS dc))), "
        "placed AS (SELECT cid, size, split FROM g JOIN ord USING (r))"
    )


# --- records, projections, scalar functions ------------------------------------------------------
@_query("dedup_representatives", f"WITH {REC} SELECT rid, seq, min(rid) OVER (PARTITION BY seq) AS rep FROM rec")
def dedup_representatives(spark, d):
    return pairs.representatives(_parts(spark, d)).select("rid", "seq", "rep")


def _reduced(name: str) -> str:
    return f"translate(regexp_replace(seq, '[^{S.RESIDUES}]', 'X', 'g'), '{S.RESIDUES}', '{S.ALPHABETS[name]}')"


@_query("reduced_alphabet", f"WITH {REC} SELECT rid, {_reduced('groups5')} AS groups5, {_reduced('groups7')} AS groups7 FROM rec")
def reduced_alphabet(spark, d):
    seq = F.col("seq")
    return _parts(spark, d).select("rid", S.reduce_alphabet(seq, "groups5").alias("groups5"), S.reduce_alphabet(seq, "groups7").alias("groups7"))


@_query("kmer_profile", f"WITH {REC}, {_km(3, 'rec')} SELECT kmer, count(*) AS df, min(rid) AS first_rid FROM km GROUP BY kmer")
def kmer_profile(spark, d):
    return pairs.kmer_rows(_parts(spark, d), 3).groupBy("kmer").agg(F.count("*").alias("df"), F.min("rid").alias("first_rid"))


_BYTES = "list_transform(range(1, len(kmer) + 1), lambda i: CAST(ascii(substring(kmer, i, 1)) AS BIGINT))"
CRC = f"xor(CAST(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {_BYTES}), lambda c, b: list_reduce(list_prepend(xor(c, b), CAST(range(8) AS BIGINT[])), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))) AS BIGINT), CAST(4294967295 AS BIGINT))"


@_query("kmer_crc", f"WITH {REC}, {_km(3, 'rec')} SELECT kmer, {CRC} AS crc FROM (SELECT DISTINCT kmer FROM km)")
def kmer_crc(spark, d):
    return pairs.kmer_rows(_parts(spark, d), 3).select("kmer").distinct().select("kmer", S.kmer_hash(F.col("kmer")).alias("crc"))


_A, _B = S.coefficients(8, 45)
SKETCH = f"crc AS (SELECT kmer, {CRC} % {S.PRIME} AS h FROM (SELECT DISTINCT kmer FROM km)), sk AS (SELECT rid, {', '.join(f'min((h * {a} + {b}) % {S.PRIME}) AS h{i}' for i, (a, b) in enumerate(zip(_A, _B, strict=True)))} FROM km JOIN crc USING (kmer) GROUP BY rid)"


@_query("minhash_sketch", f"WITH {REC}, {UNI}, {_km(3)}, {SKETCH} SELECT u.rid, {', '.join(f'coalesce(h{i}, {S.PRIME}) AS h{i}' for i in range(8))} FROM uni u LEFT JOIN sk USING (rid)")
def minhash_sketch(spark, d):
    sk = pairs.sketches(pairs.unique_records(_parts(spark, d)), 3, 8, 42)
    return sk.select("rid", *(F.element_at("sketch", i + 1).alias(f"h{i}") for i in range(8)))


_BANDS = {r: " UNION ".join(f"SELECT x.rid AS a, y.rid AS b FROM sk x JOIN sk y ON x.rid < y.rid AND {' AND '.join(f'x.h{j} = y.h{j}' for j in range(i, min(8, i + r)))}" for i in range(0, 8, r)) for r in (2, 4)}


def _candidates(rows: tuple[int, ...]) -> Query:
    def run(spark, d):
        sk = graph.cut(pairs.sketches(pairs.unique_records(_parts(spark, d)), 3, 8, 42))
        out = pairs.band_pairs(sk, 8, rows[0])
        for r in rows[1:]:
            out = out.unionByName(pairs.band_pairs(sk, 8, r))
        return out.distinct()

    return run


_query("lsh_candidates_rows2", f"WITH {REC}, {UNI}, {_km(3)}, {SKETCH} {_BANDS[2]}")(_candidates((2,)))
_query("lsh_candidates_rows4", f"WITH {REC}, {UNI}, {_km(3)}, {SKETCH} {_BANDS[4]}")(_candidates((4,)))
_query("lsh_union", f"WITH {REC}, {UNI}, {_km(3)}, {SKETCH} {_BANDS[2]} UNION {_BANDS[4]}")(_candidates((2, 4)))


@_query("sketch_estimate", f"WITH {REC}, {UNI}, {_km(3)}, {SKETCH}, cand AS ({_BANDS[2]}) SELECT a, b, ({' + '.join(f'CAST(x.h{i} = y.h{i} AS INTEGER)' for i in range(8))}) / 8.0::DOUBLE AS estimate FROM cand JOIN sk x ON x.rid = a JOIN sk y ON y.rid = b")
def sketch_estimate(spark, d):
    sk = graph.cut(pairs.sketches(pairs.unique_records(_parts(spark, d)), 3, 8, 42))
    near = pairs.band_pairs(sk, 8, 2)
    both = near.join(sk.toDF("a", "sa"), "a").join(sk.toDF("b", "sb"), "b")
    return both.select("a", "b", S.estimated_jaccard(F.col("sa"), F.col("sb"), 8).alias("estimate"))


@_query("dense_bucket_ring")
def dense_bucket_ring(spark, d):
    """Dense buckets linked around a ring instead of expanded: sketches of all parts, duplicates included."""
    sk = graph.cut(pairs.sketches(_parts(spark, d), 3, 8, 42))
    return pairs.band_pairs(sk, 8, 4, dense=16, neighbours=4)


# --- similarity joins ------------------------------------------------------------------------------
@_query("exact_jaccard_pairs", f"WITH {REC}, {UNI}, {_km(3)}, {COMMON} SELECT a, b, round({JACCARD}, 9) AS score FROM com WHERE {JACCARD} >= 0.5")
def exact_jaccard_pairs(spark, d):
    return pairs.jaccard_pairs(pairs.unique_records(_parts(spark, d)), 3, 0.5).select("a", "b", _r("score", "score"))


@_query("set_metric_pairs", f"WITH {REC}, {UNI}, {_km(3)}, {COMMON} SELECT a, b, round({JACCARD}, 9) AS jaccard, round(c / CAST(least(na, nb) AS DOUBLE), 9) AS containment, round(c / sqrt(CAST(na AS DOUBLE) * nb), 9) AS cosine FROM com")
def set_metric_pairs(spark, d):
    return pairs.metric_pairs(pairs.unique_records(_parts(spark, d)), 3).select("a", "b", _r("jaccard", "jaccard"), _r("containment", "containment"), _r("cosine", "cosine"))


_SEQS = "JOIN uni x ON x.rid = a JOIN uni y ON y.rid = b"
_EDIT = "1.0::DOUBLE - levenshtein(x.seq, y.seq) / CAST(greatest(len(x.seq), len(y.seq)) AS DOUBLE)"


@_query("levenshtein_pairs", f"WITH {REC}, {UNI}, {_km(3)}, {COMMON}, s AS (SELECT a, b, {_EDIT} AS score, levenshtein(x.seq, y.seq) AS d, CAST(trunc((1.0::DOUBLE - 0.6::DOUBLE) * greatest(len(x.seq), len(y.seq))) AS INTEGER) AS bound FROM com {_SEQS}) SELECT a, b, round(score, 9) AS score FROM s WHERE d <= bound AND score >= 0.6::DOUBLE")
def levenshtein_pairs(spark, d):
    return pairs.edit_pairs(pairs.unique_records(_parts(spark, d)), 3, 0.6).select("a", "b", _r("score", "score"))


_MET = f"met AS (SELECT a, b, {JACCARD} AS j, c / CAST(least(na, nb) AS DOUBLE) AS n, c / sqrt(CAST(na AS DOUBLE) * nb) AS o FROM com)"


@_query("multi_metric", f"WITH {REC}, {UNI}, {_km(3)}, {COMMON}, {_MET} SELECT a, b, round(greatest(j, n, o), 9) AS m_max, round((j + n + o) / 3, 9) AS m_mean, round((CAST(j >= 0.5 AS INTEGER) + CAST(n >= 0.5 AS INTEGER) + CAST(o >= 0.5 AS INTEGER)) / 3.0::DOUBLE, 9) AS m_vote, round((j * 2 + n + o) / 4, 9) AS m_weighted FROM met")
def multi_metric(spark, d):
    names = ["jaccard", "containment", "cosine"]
    how = lambda h, w=None: pairs.aggregate_metrics(names, h, 0.5, w)
    return pairs.metric_pairs(pairs.unique_records(_parts(spark, d)), 3).select("a", "b", _r(how("max"), "m_max"), _r(how("mean"), "m_mean"), _r(how("vote"), "m_vote"), _r(how("weighted", [2, 1, 1]), "m_weighted"))


NEAR = f"{REC}, {_km(3, 'rec')}, com AS (SELECT q.rid AS q, r.rid AS r, q.n AS na, r.n AS nb, count(*) AS c FROM km q JOIN km r ON q.kmer = r.kmer WHERE q.rid % 10 = 0 AND r.rid % 10 <> 0 GROUP BY ALL), sc AS (SELECT q, r, {JACCARD} AS s FROM com), best AS (SELECT q, max(s) AS score, arg_max(r, struct_pack(s := s, r := r)) AS ref FROM sc GROUP BY q)"


@_query("nearest_neighbor", f"WITH {NEAR} SELECT rid, round(coalesce(score, 0), 9) AS score, ref FROM rec LEFT JOIN best ON q = rid WHERE rid % 10 = 0")
def nearest_neighbor(spark, d):
    own = _parts(spark, d)
    return pairs.nearest(own.where("rid % 10 = 0"), own.where("rid % 10 <> 0"), 3).select("rid", _r("score", "score"), "ref")


@_query("boundary_records", f"WITH {NEAR} SELECT rid, round(score, 9) AS score, ref FROM rec JOIN best ON q = rid WHERE rid % 10 = 0 AND abs(score - 0.95::DOUBLE) <= 0.10::DOUBLE")
def boundary_records(spark, d):
    own = _parts(spark, d).withColumn("split", F.when(F.col("rid") % 10 == 0, "test").otherwise("train"))
    return audit.boundary_records(own, 3, 0.95).select("rid", _r("score", "score"), "ref")


# --- clusters ---------------------------------------------------------------------------------------
_EDGES = f"SELECT a, b FROM com WHERE {JACCARD} >= 0.5"
CLUSTERS = f"{REC}, {UNI}, {_km(3)}, {COMMON}, {_components(_EDGES)}, lab AS (SELECT rec.rid, root, dense_rank() OVER (ORDER BY root) - 1 AS cluster_id FROM rec JOIN uni USING (seq) JOIN roots ON roots.rid = uni.rid)"


def _part_labels(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    own = _parts(spark, d)
    unique = graph.cut(pairs.unique_records(own))
    roots = graph.component_labels(unique, pairs.jaccard_pairs(unique, 3, 0.5))
    return own, graph.number_clusters(own.join(unique.join(roots, "rid").select("seq", "root"), "seq").select("rid", "root"))


@_query("components", f"WITH RECURSIVE {CLUSTERS} SELECT rid, root, cluster_id FROM lab")
def components(spark, d):
    return _part_labels(spark, d)[1]


@_query("cluster_size_distribution", f"WITH RECURSIVE {CLUSTERS} SELECT size, count(*) AS clusters FROM (SELECT cluster_id, count(*) AS size FROM lab GROUP BY cluster_id) GROUP BY size")
def cluster_size_distribution(spark, d):
    sizes = _part_labels(spark, d)[1].groupBy("cluster_id").agg(F.count("*").alias("size"))
    return sizes.groupBy("size").agg(F.count("*").alias("clusters"))


@_query("cluster_stats", f"WITH RECURSIVE {CLUSTERS}, s AS (SELECT cluster_id, count(*) AS size FROM lab GROUP BY cluster_id) SELECT count(*) AS clusters, count(*) FILTER (size = 1) AS singletons, CAST(max(size) AS BIGINT) AS largest, round(sum(CASE WHEN size > 1 THEN size ELSE 0 END) / CAST(sum(size) AS DOUBLE), 9) AS non_singleton_fraction FROM s")
def cluster_stats(spark, d):
    s = _part_labels(spark, d)[1].groupBy("cluster_id").agg(F.count("*").alias("size"))
    big = F.sum(F.when(F.col("size") > 1, F.col("size")).otherwise(0))
    return s.agg(F.count("*").alias("clusters"), F.count_if(F.col("size") == 1).alias("singletons"), F.max("size").alias("largest"), _r(big / F.sum("size"), "non_singleton_fraction"))


@_query("hierarchical_views", f"WITH RECURSIVE {REC}, {UNI}, {_km(3)}, {COMMON}, " + ", ".join(_components(f"SELECT a, b FROM com WHERE {JACCARD} >= {t}").replace("edge", f"edge{i}").replace("sym", f"sym{i}").replace("walk", f"walk{i}").replace("roots", f"roots{i}") for i, t in enumerate((0.9, 0.7, 0.5))) + " " + " UNION ALL ".join(f"SELECT {t}::DOUBLE AS threshold, rid, root FROM roots{i}" for i, t in enumerate((0.9, 0.7, 0.5))))
def hierarchical_views(spark, d):
    unique = graph.cut(pairs.unique_records(_parts(spark, d)))
    return cluster.hierarchical(graph.cut(pairs.jaccard_pairs(unique, 3, 0.5)), unique, [0.5, 0.7, 0.9])


@_query("score_histogram", f"WITH {REC}, {UNI}, {_km(3)}, {COMMON} SELECT CAST(least(19, floor({JACCARD} * 20)) AS BIGINT) AS bin, count(*) AS n FROM com GROUP BY bin")
def score_histogram(spark, d):
    c = pairs.common_kmers(pairs.unique_records(_parts(spark, d)), 3)
    score = S.jaccard(F.col("common"), F.col("na"), F.col("nb"))
    return c.groupBy(F.least(F.lit(19), F.floor(score * 20)).cast("long").alias("bin")).agg(F.count("*").alias("n"))


@_query("otsu_threshold", f"WITH {REC}, {UNI}, {_km(3)}, {COMMON}, b AS (SELECT least(63, floor({JACCARD} * 64)) AS bin, count(*) AS c FROM com GROUP BY bin), f AS (SELECT i AS bin, coalesce(c, 0) AS c FROM range(64) r(i) LEFT JOIN b ON b.bin = i), w AS (SELECT bin, sum(c) OVER o AS w, sum(c * (bin + 0.5::DOUBLE) / 64) OVER o AS s, sum(c) OVER () AS t, sum(c * (bin + 0.5::DOUBLE) / 64) OVER () AS ws FROM f WINDOW o AS (ORDER BY bin)), v AS (SELECT bin, w * (t - w) * pow(s / w - (ws - s) / (t - w), 2) AS v FROM w WHERE w > 0 AND w < t) SELECT (bin + 0.5::DOUBLE) / 64 AS threshold FROM v ORDER BY round(v, 6) DESC, bin LIMIT 1")
def otsu_threshold(spark, d):
    c = pairs.common_kmers(pairs.unique_records(_parts(spark, d)), 3)
    scored = graph.cut(c.select(S.jaccard(F.col("common"), F.col("na"), F.col("nb")).alias("score")))
    return spark.createDataFrame([(diagnostics.otsu(scored, 0.5),)], "threshold double")


# --- splits ------------------------------------------------------------------------------------------
_DOCS = f"{DOC}, {UNI}, {_km(9)}, {COMMON}, {_components(_EDGES, '(SELECT rid FROM uni)')}, lab AS (SELECT rec.rid, root AS cluster_id FROM rec JOIN uni USING (seq) JOIN roots ON roots.rid = uni.rid), sz AS (SELECT cluster_id, count(*) AS size FROM lab GROUP BY cluster_id)"


@_query("cluster_split_documents", f"WITH RECURSIVE {_DOCS}, {_greedy('sz', 'cluster_id')} SELECT rid, cluster_id, split FROM lab JOIN placed ON cid = cluster_id")
def cluster_split_documents(spark, d):
    """Flagship: near-duplicate documents (9-mers, Jaccard 0.5 or more) stay in one split; a cluster is named by its least id."""
    labels = blocks.linked_roots(_documents(spark, d), 9, 0.5).withColumnRenamed("root", "cluster_id")
    placed = assign.greedy_split(labels.groupBy("cluster_id").agg(F.count("*").alias("size")))
    return labels.join(placed.select("cluster_id", "split"), "cluster_id").select("rid", "cluster_id", "split")


@_query("order_group_split", f"WITH RECURSIVE sz AS (SELECT o_custkey AS cluster_id, count(*) AS size FROM orders GROUP BY o_custkey), {_greedy('sz', 'cluster_id')} SELECT cid AS cluster_id, size, split FROM placed")
def order_group_split(spark, d):
    sizes = _t(spark, d, "orders").groupBy(F.col("o_custkey").alias("cluster_id")).agg(F.count("*").alias("size"))
    return assign.greedy_split(sizes)


def _orders(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Orders as records, finished ones positive, and their customers as clusters from outside."""
    orders = _t(spark, d, "orders")
    records = R.from_table(orders, "o_orderkey", F.regexp_replace("o_orderpriority", "[^A-Z]", ""), (F.col("o_orderstatus") == "F").cast("int"))
    return records, orders.select(F.col("o_orderkey").alias("rid"), F.col("o_custkey").alias("cluster_id"))


@_query("external_clusters", f"WITH RECURSIVE sz AS (SELECT o_custkey AS cluster_id, count(*) AS size FROM orders GROUP BY o_custkey), {_greedy('sz', 'cluster_id')} SELECT o_orderkey AS rid, o_custkey AS cluster_id, split FROM orders JOIN placed ON cid = o_custkey")
def external_clusters(spark, d):
    """A split by clusters given from outside: orders by customer."""
    records, labels = _orders(spark, d)
    return cluster.split_records(records, SplitConfig(), labels).select("rid", "cluster_id", "split")


_SZ = "sz AS (SELECT o_custkey AS cluster_id, count(*) AS size, count(*) FILTER (o_orderstatus = 'F') AS pos FROM orders GROUP BY o_custkey), ord AS (SELECT cluster_id AS cid, size, pos, row_number() OVER (ORDER BY size DESC, md5('42:' || CAST(cluster_id AS VARCHAR)), cluster_id) AS r, CAST(sum(size) OVER () AS DOUBLE) AS n, CAST(sum(pos) OVER () AS DOUBLE) AS p, count(*) OVER () AS m FROM sz)"
_BEST = "CASE WHEN da <= db AND da <= dc THEN 'train' WHEN db <= dc THEN 'val' ELSE 'test' END"
_SHARES = {"a": 0.8, "b": 0.1, "c": 0.1}


def _label_sql() -> str:
    cost = ", ".join(f"(abs(g.{x} + o.size - o.n * {s}::DOUBLE) - abs(g.{x} - o.n * {s}::DOUBLE)) / o.n + abs(g.p{x} + o.pos - {s}::DOUBLE * o.p) / o.n AS d{x}" for x, s in _SHARES.items())
    add = ", ".join(f"{x} + CASE WHEN split = '{n}' THEN size ELSE 0 END, p{x} + CASE WHEN split = '{n}' THEN pos ELSE 0 END" for x, n in zip("abc", assign.SPLITS, strict=True))
    zero = ", ".join(["CAST(0 AS DOUBLE)"] * 6)
    return f"WITH RECURSIVE {_SZ}, g(r, a, pa, b, pb, c, pc, split) AS (SELECT CAST(0 AS BIGINT), {zero}, '' UNION ALL SELECT r, {add}, split FROM (SELECT o.r, o.size, o.pos, g.a, g.pa, g.b, g.pb, g.c, g.pc, {_BEST} AS split FROM g JOIN ord o ON o.r = g.r + 1, LATERAL (SELECT {cost}))) SELECT cid AS cluster_id, size, split FROM g JOIN ord USING (r)"


@_query("label_balanced_split", _label_sql())
def label_balanced_split(spark, d):
    """Customers' orders stay together; sizes and shares of finished orders come near their targets."""
    return balance.assign_clusters(*_orders(spark, d), SplitConfig(stratify_labels=True)).placed


def _bounded_sql() -> str:
    low = {x: f"greatest(CASE WHEN o.m >= 3 THEN 1 ELSE 0 END, floor(o.n * {s}::DOUBLE * 0.95::DOUBLE))" for x, s in _SHARES.items()}
    high = {x: f"ceil(o.n * {s}::DOUBLE * 1.05::DOUBLE)" for x, s in _SHARES.items()}
    empty = " + ".join(f"CASE WHEN g.{x} = 0 AND {low[x]} > 0 THEN 1 ELSE 0 END" for x in "abc")

    def cost(x: str) -> str:
        need = " + ".join(f"greatest(0, {low[y]} - g.{y}{' - o.size' if x == y else ''})" for y in "abc")
        fits = f"g.{x} + o.size <= {high[x]} AND NOT (o.m - o.r < ({empty}) AND g.{x} = 0 AND {low[x]} > 0) AND o.n - g.a - g.b - g.c - o.size >= {need}"
        s = _SHARES[x]
        return f"CASE WHEN {fits} THEN (abs(g.{x} + o.size - o.n * {s}::DOUBLE) - abs(g.{x} - o.n * {s}::DOUBLE)) / o.n ELSE 1e9::DOUBLE + abs(g.{x} + o.size - o.n * {s}::DOUBLE) END AS d{x}"

    add = ", ".join(f"{x} + CASE WHEN split = '{n}' THEN size ELSE 0 END" for x, n in zip("abc", assign.SPLITS, strict=True))
    return f"WITH RECURSIVE {_SZ}, g(r, a, b, c, split) AS (SELECT CAST(0 AS BIGINT), CAST(0 AS DOUBLE), CAST(0 AS DOUBLE), CAST(0 AS DOUBLE), '' UNION ALL SELECT r, {add}, split FROM (SELECT o.r, o.size, g.a, g.b, g.c, {_BEST} AS split FROM g JOIN ord o ON o.r = g.r + 1, LATERAL (SELECT {', '.join(map(cost, 'abc'))}))) SELECT cid AS cluster_id, size, split FROM g JOIN ord USING (r)"


@_query("bounded_split", _bounded_sql())
def bounded_split(spark, d):
    """As order_group_split, with each split's size within 5 per cent of its target."""
    return balance.assign_clusters(*_orders(spark, d), SplitConfig(balance=True, balance_weight=0.0, balance_metric="mean")).placed


def _customers(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Customers as records, their names' letters as sequences, and their nations as clusters."""
    c = _t(spark, d, "customer")
    records = R.from_table(c, "c_custkey", F.concat("c_mktsegment", F.col("c_name")), (F.col("c_acctbal") > 0).cast("int"))
    return records, c.select(F.col("c_custkey").alias("rid"), F.col("c_nationkey").alias("cluster_id"))


@_query("balanced_split")
def balanced_split(spark, d):
    return balance.assign_clusters(*_customers(spark, d), SplitConfig(balance=True)).placed


@_query("local_search_split")
def local_search_split(spark, d):
    return balance.assign_clusters(*_customers(spark, d), SplitConfig(balance=True, balance_metric="mean", local_search_iterations=3)).placed


@_query("pareto_frontier")
def pareto_frontier(spark, d):
    points = balance.assign_clusters(*_customers(spark, d), SplitConfig(balance=True, balance_metric="mean", pareto_points=5)).stats["pareto_frontier"]
    rows = [(p["balance_weight"], p["size_error"], round(p["composition_error"], 9), *(p["observed_sizes"][s] for s in assign.SPLITS)) for p in points]
    return spark.createDataFrame(rows, "balance_weight double, size_error double, composition_error double, train long, val long, test long")


def _apportion(counts: str) -> str:
    return (
        f"cnt AS ({counts}), par AS (SELECT key, n, i, floor(x) AS w, row_number() OVER (PARTITION BY key ORDER BY -(x - floor(x)), i) AS r, n - sum(floor(x)) OVER (PARTITION BY key) AS lft FROM (SELECT key, n, i, n * share AS x FROM cnt, (VALUES (0, 0.8::DOUBLE), (1, 0.1::DOUBLE), (2, 0.1::DOUBLE)) s(i, share))), "
        "app AS (SELECT key, n, CAST(sum(CASE WHEN i = 0 THEN w + CASE WHEN r <= lft THEN 1 ELSE 0 END END) AS BIGINT) AS train, CAST(sum(CASE WHEN i = 1 THEN w + CASE WHEN r <= lft THEN 1 ELSE 0 END END) AS BIGINT) AS val, CAST(sum(CASE WHEN i = 2 THEN w + CASE WHEN r <= lft THEN 1 ELSE 0 END END) AS BIGINT) AS test FROM par GROUP BY key, n)"
    )


@_query("target_sizes", f"WITH {_apportion('SELECT c_mktsegment AS key, count(*) AS n FROM customer GROUP BY 1')} SELECT key, n, train, val, test FROM app")
def target_sizes(spark, d):
    counts = _t(spark, d, "customer").groupBy(F.col("c_mktsegment").alias("key")).agg(F.count("*").alias("n"))
    return assign.apportioned(counts, (0.8, 0.1, 0.1))


def _random_sql(key: str) -> str:
    return f"WITH {REC}, {_apportion(f'SELECT {key} AS key, count(*) AS n FROM rec GROUP BY 1')}, rk AS (SELECT rid, label, row_number() OVER (PARTITION BY {key} ORDER BY md5('42:' || CAST(rid AS VARCHAR)), rid) AS r, {key} AS key FROM rec) SELECT rid, label, CASE WHEN r <= train THEN 'train' WHEN r <= train + val THEN 'val' ELSE 'test' END AS split FROM rk JOIN app USING (key)"


@_query("stratified_split", _random_sql("label"))
def stratified_split(spark, d):
    return assign.random_split(_parts(spark, d)).select("rid", "label", "split")


@_query("random_split", _random_sql("0"))
def random_split(spark, d):
    return assign.random_split(_parts(spark, d), stratify=False).select("rid", "label", "split")


_FOLD = "WITH RECURSIVE sz AS (SELECT o_custkey AS cluster_id, count(*) AS size FROM orders GROUP BY o_custkey), ord AS (SELECT cluster_id AS cid, size, row_number() OVER (ORDER BY size DESC, md5('42:' || CAST(cluster_id AS VARCHAR)), cluster_id) AS r, sum(size) OVER () / 3.0::DOUBLE AS e FROM sz), g(r, a, b, c, fold) AS (SELECT CAST(0 AS BIGINT), CAST(0 AS DOUBLE), CAST(0 AS DOUBLE), CAST(0 AS DOUBLE), -1 UNION ALL SELECT r, a + CASE WHEN fold = 0 THEN size ELSE 0 END, b + CASE WHEN fold = 1 THEN size ELSE 0 END, c + CASE WHEN fold = 2 THEN size ELSE 0 END, fold FROM (SELECT o.r, o.size, a, b, c, CASE WHEN abs(a + size - e) <= abs(b + size - e) AND abs(a + size - e) <= abs(c + size - e) THEN 0 WHEN abs(b + size - e) <= abs(c + size - e) THEN 1 ELSE 2 END AS fold FROM g JOIN ord o ON o.r = g.r + 1)) SELECT cid AS cluster_id, size, fold FROM g JOIN ord USING (r)"


@_query("cv_folds", _FOLD)
def cv_folds(spark, d):
    sizes = _t(spark, d, "orders").groupBy(F.col("o_custkey").alias("cluster_id")).agg(F.count("*").alias("size"))
    return assign.folds(sizes, 3)


@_query("fold_splits", _FOLD.replace("SELECT cid AS cluster_id, size, fold FROM g JOIN ord USING (r)", "SELECT f.i AS fold, o_orderkey AS rid, CASE WHEN g.fold = f.i THEN 'test' ELSE 'train' END AS split FROM g JOIN ord USING (r) JOIN orders ON o_custkey = cid, (VALUES (0), (1), (2)) f(i)"))
def fold_splits(spark, d):
    labels = _orders(spark, d)[1]
    return balance.fold_splits(labels, assign.folds(labels.groupBy("cluster_id").agg(F.count("*").alias("size")), 3), 3)


# --- features and distributions -----------------------------------------------------------------------
def _cnt(r: str) -> str:
    return f"(len(seq) - len(replace(seq, '{r}', '')))"


def _feature_sql(digits: int | None = 6) -> str:
    n, known = "CAST(len(seq) AS DOUBLE)", "(" + " + ".join(map(_cnt, S.RESIDUES)) + ")"
    total = lambda rs: "(" + " + ".join(map(_cnt, rs)) + ")"
    at = lambda pka: 1 / (1 + 10 ** (7.0 - pka))
    charge = f"{at(S.N_TERM) + at(S.C_TERM) - 1!r}::DOUBLE" + "".join(f" + {_cnt(r)} * ({at(p) - 1!r}::DOUBLE)" for r, p in S.ACIDS.items()) + "".join(f" + {_cnt(r)} * ({at(p)!r}::DOUBLE)" for r, p in S.BASES.items())
    mass = " + ".join(f"{_cnt(r)} * {m}::DOUBLE" for r, m in S.MASS.items()) + f" + ({n} - {known}) * 110.0::DOUBLE - ({n} - 1) * {S.WATER}::DOUBLE"
    water = " + ".join(f"{_cnt(r)} * ({h}::DOUBLE)" for r, h in S.HYDROPATHY.items())
    cols = {f"freq_{r}": f"{_cnt(r)} / {n}" for r in S.RESIDUES} | {f"grp_{g}": f"{total(rs)} / {n}" for g, rs in S.GROUPS.items()}
    cols |= {"aromaticity": f"{total('FWY')} / {n}", "charge": charge, "hydrophobicity": f"CASE WHEN {known} > 0 THEN ({water}) / {known} ELSE 0 END", "length": n, "mw": mass, "unknown_fraction": f"({n} - {known}) / {n}"}
    return ", ".join(f"{e} AS {c}" if digits is None else f"round({e}, {digits}) AS {c}" for c, e in sorted(cols.items()))


@_query("biochem_features", f"WITH {REC} SELECT rid, {_feature_sql()} FROM rec WHERE len(seq) > 0")
def biochem_features(spark, d):
    return _parts(spark, d).where("seq <> ''").select("rid", *(F.round(c, 6).alias(n) for n, c in S.features(F.col("seq")).items()))


@_query("feature_means", f"WITH {REC} SELECT label, {', '.join(f'round(avg({n}), 5) AS {n}' for n in S.FEATURE_NAMES)} FROM (SELECT label, {_feature_sql()} FROM rec WHERE len(seq) > 0) GROUP BY label")
def feature_means(spark, d):
    own = _parts(spark, d).where("seq <> ''").select("label", *(F.round(c, 6).alias(n) for n, c in S.features(F.col("seq")).items()))
    return own.groupBy("label").agg(*(F.round(F.avg(n), 5).alias(n) for n in S.FEATURE_NAMES))


_LINE = "lng AS (SELECT 'quantity' AS feature, l_returnflag AS grp, l_quantity AS v FROM lineitem UNION ALL SELECT 'price', l_returnflag, l_extendedprice FROM lineitem UNION ALL SELECT 'discount', l_returnflag, l_discount FROM lineitem)"
_DIST = "agg AS (SELECT feature, v, count(*) FILTER (grp = 'A') AS ca, count(*) FILTER (grp = 'R') AS cb FROM lng WHERE grp IN ('A', 'R') GROUP BY feature, v), cum AS (SELECT feature, v, abs(sum(ca) OVER w / CAST(sum(ca) OVER p AS DOUBLE) - sum(cb) OVER w / CAST(sum(cb) OVER p AS DOUBLE)) AS gap, lead(v) OVER w - v AS dv FROM agg WINDOW w AS (PARTITION BY feature ORDER BY v), p AS (PARTITION BY feature))"


@_query("ks_wasserstein_features", f"WITH {_LINE}, {_DIST} SELECT feature, round(max(gap), 9) AS ks, round(coalesce(sum(gap * dv), 0), 6) AS wasserstein FROM cum GROUP BY feature")
def ks_wasserstein_features(spark, d):
    one = _t(spark, d, "lineitem").select(F.col("l_returnflag").alias("grp"), F.expr("stack(3, 'quantity', l_quantity, 'price', l_extendedprice, 'discount', l_discount) as (feature, v)"))
    out = diagnostics.distances(one, "A", "R")
    return out.select("feature", _r("ks", "ks"), F.round("wasserstein", 6).alias("wasserstein"))


_SKEW = "skw AS (SELECT rid, seq, CASE len(seq) % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'val' ELSE 'test' END AS split FROM rec WHERE len(seq) > 0)"


def _skewed_split(spark: SparkSession, d: str) -> DataFrame:
    """Parts split by the length of their names, so that features differ."""
    n = F.length("seq") % 3
    return _parts(spark, d).where("seq <> ''").withColumn("split", F.when(n == 0, "train").when(n == 1, "val").otherwise("test"))


def _values_sql() -> str:
    return f"fts AS (SELECT split, {_feature_sql()} FROM skw), val AS (SELECT split, feature, v FROM fts UNPIVOT (v FOR feature IN ({', '.join(S.FEATURE_NAMES)})))"


def _ks_sql(pairs_: list[tuple[str, str]]) -> str:
    """CTEs up to ks (a, b, feature, ks, wasserstein)."""
    among = ", ".join(f"('{a}', '{b}')" for a, b in pairs_)
    return f"pr(a, b) AS (VALUES {among}), vat AS (SELECT a, b, feature, v, count(*) FILTER (split = a) AS x, count(*) FILTER (split = b OR b = 'overall') AS y FROM val, pr GROUP BY ALL), cum AS (SELECT a, b, feature, v, abs(sum(x) OVER w / CAST(sum(x) OVER p AS DOUBLE) - sum(y) OVER w / CAST(sum(y) OVER p AS DOUBLE)) AS gap, lead(v) OVER w - v AS dv FROM vat WHERE x + y > 0 WINDOW p AS (PARTITION BY a, b, feature), w AS (PARTITION BY a, b, feature ORDER BY v)), ks AS (SELECT a, b, feature, max(gap) AS ks, coalesce(sum(gap * dv), 0) AS wasserstein FROM cum GROUP BY a, b, feature)"


_WHOLE = [(x, "overall") for x in assign.SPLITS]
_SPL = "spl AS (SELECT rid, label, seq, CASE WHEN rid % 10 < 8 THEN 'train' WHEN rid % 10 = 8 THEN 'val' ELSE 'test' END AS split FROM rec)"


def _fixed_split(spark: SparkSession, d: str) -> DataFrame:
    return _parts(spark, d).withColumn("split", F.when(F.col("rid") % 10 < 8, "train").when(F.col("rid") % 10 == 8, "val").otherwise("test"))


@_query("split_sizes_labels", f"WITH {REC}, {_SPL} SELECT split, count(*) AS n, count(*) FILTER (label = 0) AS n_0, count(*) FILTER (label = 1) AS n_1, count(*) FILTER (label IS NULL) AS n_unlabeled FROM spl GROUP BY split")
def split_sizes_labels(spark, d):
    c = F.count_if
    return _fixed_split(spark, d).groupBy("split").agg(F.count("*").alias("n"), c(F.col("label") == 0).alias("n_0"), c(F.col("label") == 1).alias("n_1"), c(F.col("label").isNull()).alias("n_unlabeled"))


@_query("length_summary", f"WITH {REC}, {_SPL} SELECT split, round(avg(len(seq)), 9) AS mean, round(stddev_pop(len(seq)), 9) AS std, CAST(min(len(seq)) AS BIGINT) AS shortest, CAST(max(len(seq)) AS BIGINT) AS longest FROM spl GROUP BY split")
def length_summary(spark, d):
    n = F.length("seq")
    return _fixed_split(spark, d).groupBy("split").agg(_r(F.avg(n), "mean"), _r(F.stddev_pop(n), "std"), F.min(n).cast("long").alias("shortest"), F.max(n).cast("long").alias("longest"))


@_query("size_ci", f"WITH {REC}, {_SPL}, s AS (SELECT split, count(*) AS n FROM spl GROUP BY split), p AS (SELECT split, n, n / CAST(sum(n) OVER () AS DOUBLE) AS p, CAST(sum(n) OVER () AS DOUBLE) AS t FROM s) SELECT split, n, round(t * CASE split WHEN 'train' THEN 0.8 ELSE 0.1 END, 6) AS expected, round(greatest(p - 1.96 * sqrt(p * (1 - p) / t), 0), 9) AS low, round(least(p + 1.96 * sqrt(p * (1 - p) / t), 1), 9) AS high FROM p")
def size_ci(spark, d):
    sizes = _fixed_split(spark, d).groupBy("split").agg(F.count("*").alias("n"))
    out = diagnostics.size_intervals(sizes, {"train": 0.8, "val": 0.1, "test": 0.1})
    return out.select("split", "n", F.round("expected", 6).alias("expected"), _r("low", "low"), _r("high", "high"))


@_query("topk_kmers", f"WITH {REC}, {_km(3, 'rec')} SELECT kmer, count(*) AS df FROM km GROUP BY kmer ORDER BY df DESC, kmer LIMIT 512")
def topk_kmers(spark, d):
    return pairs.kmer_rows(_parts(spark, d), 3).groupBy("kmer").agg(F.count("*").alias("df")).orderBy(F.desc("df"), "kmer").limit(512)


@_query("box_quantiles", "SELECT l_returnflag AS grp, round(quantile_cont(l_extendedprice, 0.25), 6) AS q1, round(quantile_cont(l_extendedprice, 0.5), 6) AS q2, round(quantile_cont(l_extendedprice, 0.75), 6) AS q3 FROM lineitem GROUP BY 1")
def box_quantiles(spark, d):
    q = [F.round(F.percentile("l_extendedprice", F.lit(p)), 6).alias(n) for p, n in ((0.25, "q1"), (0.5, "q2"), (0.75, "q3"))]
    return _t(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("grp")).agg(*q)


@_query("length_histogram", f"WITH {REC}, {_SPL}, m AS (SELECT split, len(seq) AS n, min(len(seq)) OVER (PARTITION BY split) AS lo, max(len(seq)) OVER (PARTITION BY split) AS hi FROM spl) SELECT split, CAST(CASE WHEN hi = lo THEN 0 ELSE least(29, floor((n - lo) * 30 / CAST(hi - lo AS DOUBLE))) END AS BIGINT) AS bin, count(*) AS n FROM m GROUP BY 1, 2")
def length_histogram(spark, d):
    own = _fixed_split(spark, d).select("split", F.length("seq").alias("l"))
    ends = own.groupBy("split").agg(F.min("l").alias("lo"), F.max("l").alias("hi"))
    at = F.when(F.col("hi") == F.col("lo"), F.lit(0)).otherwise(F.least(F.lit(29), F.floor((F.col("l") - F.col("lo")) * 30 / F.nullif(F.col("hi") - F.col("lo"), F.lit(0)))))
    return own.join(F.broadcast(ends), "split").groupBy("split", at.cast("long").alias("bin")).agg(F.count("*").alias("n"))


@_query("label_balance", "SELECT source, quality, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY ALL")
def label_balance(spark, d):
    return _t(spark, d, "documents").select("doc_id", "source").join(_t(spark, d, "labels"), "doc_id").groupBy("source", "quality").agg(F.count("*").alias("n"))


def _sampled_sql(cap: int) -> str:
    return f"{REC}, {_SPL}, smp AS (SELECT rid, split, seq FROM (SELECT *, row_number() OVER (PARTITION BY split ORDER BY md5('42:' || CAST(rid AS VARCHAR)), rid) AS r FROM spl) WHERE r <= {cap}), ks AS (SELECT rid, split, list_distinct(list_transform(range(1, len(seq) - 1), lambda i: substring(seq, i, 3))) AS k FROM smp)"


_PAIRWISE = "pl AS (SELECT *, CASE split WHEN 'train' THEN 0 WHEN 'val' THEN 1 ELSE 2 END AS o FROM ks), p AS (SELECT x.split AS s1, y.split AS s2, CASE WHEN len(x.k) = 0 OR len(y.k) = 0 THEN 0 ELSE len(list_intersect(x.k, y.k)) / CAST(len(x.k) + len(y.k) - len(list_intersect(x.k, y.k)) AS DOUBLE) END AS s FROM pl x JOIN pl y ON (x.o = y.o AND x.rid < y.rid) OR x.o < y.o)"


@_query("pairwise_similarity", f"WITH {_sampled_sql(200)}, {_PAIRWISE} SELECT s1, s2, round(avg(s), 9) AS mean, round(stddev_pop(s), 9) AS std, count(*) AS n_pairs FROM p GROUP BY 1, 2")
def pairwise_similarity(spark, d):
    """Mean similarity within and between splits over a bounded sample of each, 200 records by a seeded hash, which is the operator's default."""
    return audit.pairwise_similarity(_fixed_split(spark, d)).select("s1", "s2", _r("mean", "mean"), _r("std", "std"), "n_pairs")


def _quality_sql() -> str:
    names = S.FEATURE_NAMES
    centre = ", ".join(f"avg({n}) AS {n}" for n in names)
    far = lambda x, y: "(" + " + ".join(f"pow({x}.{n} - {y}.{n}, 2)" for n in names) + ")"
    return f"""WITH RECURSIVE {CLUSTERS}, pts AS (SELECT cluster_id, f.* FROM (SELECT rid, {_feature_sql(None)} FROM rec WHERE len(seq) > 0) f JOIN lab USING (rid)),
    own AS (SELECT * FROM pts WHERE cluster_id IN (SELECT cluster_id FROM pts GROUP BY cluster_id HAVING count(*) > 1)),
    cen AS (SELECT cluster_id, count(*) AS k, {centre} FROM own GROUP BY cluster_id), ovr AS (SELECT {centre} FROM own),
    sca AS (SELECT o.cluster_id, avg(sqrt({far('o', 'c')})) AS s, sum({far('o', 'c')}) AS w FROM own o JOIN cen c USING (cluster_id) GROUP BY o.cluster_id),
    wor AS (SELECT x.cluster_id, max((sx.s + sy.s) / CASE WHEN {far('x', 'y')} > 0 THEN sqrt({far('x', 'y')}) END) AS r FROM cen x JOIN cen y ON x.cluster_id <> y.cluster_id JOIN sca sx ON sx.cluster_id = x.cluster_id JOIN sca sy ON sy.cluster_id = y.cluster_id GROUP BY x.cluster_id),
    tot AS (SELECT (SELECT count(*) FROM own) AS n, (SELECT count(*) FROM cen) AS k, (SELECT sum(c.k * {far('c', 'ovr')}) FROM cen c, ovr) AS b, (SELECT sum(w) FROM sca) AS w)
    SELECT n, k AS clusters, round((SELECT avg(r) FROM wor), 6) AS davies_bouldin, round(CASE WHEN k > 1 AND n > k AND w > 0 THEN (b / (k - 1)) / (w / (n - k)) END, 4) AS calinski_harabasz FROM tot"""


@_query("cluster_quality", _quality_sql())
def cluster_quality(spark, d):
    own, labels = _part_labels(spark, d)
    feats = S.features(F.col("seq"))
    points = own.where("seq <> ''").select("rid", *(c.alias(n) for n, c in feats.items())).join(labels, "rid")
    out = diagnostics.cluster_quality(points, list(feats))
    return out.select("n", "clusters", F.round("davies_bouldin", 6).alias("davies_bouldin"), F.round("calinski_harabasz", 4).alias("calinski_harabasz"))


@_query("label_propagation")
def label_propagation(spark, d):
    unique = graph.cut(pairs.unique_records(_parts(spark, d)))
    return graph.propagate_labels(unique, pairs.jaccard_pairs(unique, 3, 0.5).select("a", "b"), 42)


# --- audits -------------------------------------------------------------------------------------------
@_query("feature_ks", f"WITH {REC}, {_SKEW}, {_values_sql()}, {_ks_sql(audit.PAIRS)} SELECT a, b, feature, round(ks, 9) AS ks, round(wasserstein, 5) AS wasserstein FROM ks")
def feature_ks(spark, d):
    """32 features for each of three pairs of splits."""
    return audit.feature_ks(_skewed_split(spark, d), 6).select("a", "b", "feature", _r("ks", "ks"), F.round("wasserstein", 5).alias("wasserstein"))


@_query("feature_balance", f"WITH {REC}, {_SKEW}, {_values_sql()}, {_ks_sql(_WHOLE)} SELECT a, b, feature, round(ks, 9) AS ks, round(wasserstein, 5) AS wasserstein FROM ks")
def feature_balance(spark, d):
    return audit.feature_balance(_skewed_split(spark, d), 6).select("a", "b", "feature", _r("ks", "ks"), F.round("wasserstein", 5).alias("wasserstein"))


@_query("ood_warnings", f"WITH {REC}, {_SKEW}, {_values_sql()}, {_ks_sql(audit.PAIRS)} SELECT a, b, feature, round(ks, 9) AS ks FROM ks WHERE ks > 0.2::DOUBLE")
def ood_warnings(spark, d):
    return audit.ood_warnings(audit.feature_ks(_skewed_split(spark, d), 6)).select("a", "b", "feature", _r("ks", "ks"))


_NORM = f"{REC}, {_SKEW}, {_values_sql()}, {_ks_sql(_WHOLE)}, rng AS (SELECT feature, max(v) - min(v) AS s FROM val GROUP BY feature), nrm AS (SELECT a AS split, feature, wasserstein / CASE WHEN s > 1e-12 THEN s ELSE 1 END AS normalized FROM ks JOIN rng USING (feature))"


@_query("normalized_balance", f"WITH {_NORM} SELECT split, feature, round(normalized, 6) AS normalized FROM nrm")
def normalized_balance(spark, d):
    return audit.normalized_balance(_skewed_split(spark, d), 6).select("split", "feature", F.round("normalized", 6).alias("normalized"))


@_query("balance_verdict", f"WITH {_NORM} SELECT CASE WHEN max(normalized) <= 0.1::DOUBLE THEN 'PASS' ELSE 'FAIL' END AS status, round(max(normalized), 6) AS max_normalized_divergence, 0.1::DOUBLE AS threshold FROM nrm")
def balance_verdict(spark, d):
    own = audit.balance_verdict(audit.normalized_balance(_skewed_split(spark, d), 6))
    return own.select("status", F.round("max_normalized_divergence", 6).alias("max_normalized_divergence"), "threshold")


@_query("homology_warnings", f"WITH {_sampled_sql(200)}, {_PAIRWISE}, mn AS (SELECT max(CASE WHEN s1 = 'train' AND s2 = 'train' THEN m END) AS tt, max(CASE WHEN s1 = 'train' AND s2 = 'test' THEN m END) AS ts, max(CASE WHEN s1 = 'train' AND s2 = 'val' THEN m END) AS tv FROM (SELECT s1, s2, avg(s) AS m FROM p GROUP BY ALL)) SELECT 'train-test' AS pair, round(ts, 9) AS mean, round(tt, 9) AS train_mean FROM mn WHERE ts >= 0.75::DOUBLE * tt UNION ALL SELECT 'train-val', round(tv, 9), round(tt, 9) FROM mn WHERE tv >= 0.85::DOUBLE * tt")
def homology_warnings(spark, d):
    return audit.homology_warnings(audit.pairwise_similarity(_fixed_split(spark, d))).select("pair", _r("mean", "mean"), _r("train_mean", "train_mean"))


@_query("similarity_histogram", f"WITH {_sampled_sql(300)}, {_PAIRWISE} SELECT s1, s2, CAST(least(29, floor(s * 30)) AS INTEGER) AS bin, count(*) AS n FROM p GROUP BY ALL")
def similarity_histogram(spark, d):
    return plots.similarity_histogram(_fixed_split(spark, d))


_NEAREST = f"{REC}, {_SPL}, {_km(3, 'spl')}, com AS (SELECT q.rid AS q, r.rid AS r, q.n AS na, r.n AS nb, count(*) AS c FROM km q JOIN spl x ON x.rid = q.rid AND x.split <> 'train' JOIN km r ON q.kmer = r.kmer JOIN spl y ON y.rid = r.rid AND y.split = 'train' GROUP BY ALL), best AS (SELECT q, max({JACCARD}) AS s FROM com GROUP BY q)"


@_query("nearest_summary", f"WITH {_NEAREST} SELECT split AS query, count(*) AS n_queries, round(avg(coalesce(s, 0)), 9) AS mean, round(max(coalesce(s, 0)), 9) AS max, round(quantile_cont(coalesce(s, 0), 0.95), 9) AS p95 FROM spl LEFT JOIN best ON q = rid WHERE split <> 'train' GROUP BY split")
def nearest_summary(spark, d):
    """What the leakage gate looks at: each test and val record's nearest train record."""
    return audit.nearest_summary(_fixed_split(spark, d)).select("query", "n_queries", _r("mean", "mean"), _r("max", "max"), _r("p95", "p95"))


@_query("cluster_features", f"WITH {REC} SELECT p_size AS cluster_id, count(*) AS size, count(*) FILTER (label = 1) AS positives, {', '.join(f'round(sum({n}), 4) AS s_{n}' for n in S.FEATURE_NAMES)} FROM (SELECT rid, label, {_feature_sql(None)} FROM rec WHERE len(seq) > 0) JOIN part ON p_partkey = rid GROUP BY p_size")
def cluster_features(spark, d):
    labels = _t(spark, d, "part").select(F.col("p_partkey").alias("rid"), F.col("p_size").alias("cluster_id"))
    out = balance.cluster_features(_parts(spark, d).where("seq <> ''"), labels)
    return out.select("cluster_id", "size", "positives", *(F.round(f"s_{n}", 4).alias(f"s_{n}") for n in S.FEATURE_NAMES))


@_query("length_density", f"WITH {REC}, {_SPL}, m AS (SELECT split, len(seq) AS n, min(len(seq)) OVER s AS lo, max(len(seq)) OVER s AS hi, count(*) OVER s AS t FROM spl WINDOW s AS (PARTITION BY split)), w AS (SELECT *, CASE WHEN hi > lo THEN (hi - lo) / 30.0::DOUBLE ELSE 1.0::DOUBLE END AS wd FROM m) SELECT split, CAST(least(29, floor((n - lo) / wd)) AS INTEGER) AS bin, count(*) AS n, round(count(*) / (t * wd), 9) AS density FROM w GROUP BY split, bin, t, wd")
def length_density(spark, d):
    return plots.length_density(_fixed_split(spark, d)).select("split", "bin", "n", _r("density", "density"))


@_query("feature_boxes", f"WITH {REC}, {_SKEW}, {_values_sql()}, own AS (SELECT * FROM val WHERE feature IN ({', '.join(repr(x) for x in plots.BOX_FEATURES)})), q AS (SELECT feature, split, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS q2, quantile_cont(v, 0.75) AS q3 FROM own GROUP BY ALL) SELECT feature, split, round(q1, 5) AS q1, round(q2, 5) AS q2, round(q3, 5) AS q3, round(min(v), 5) AS low, round(max(v), 5) AS high FROM own JOIN q USING (feature, split) WHERE v BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) GROUP BY ALL")
def feature_boxes(spark, d):
    return plots.boxes(_skewed_split(spark, d), digits=6).select("feature", "split", *(F.round(c, 5).alias(c) for c in ("q1", "q2", "q3", "low", "high")))


@_query("score_stairs", f"WITH {REC}, {UNI}, {_km(3)}, {COMMON}, s AS (SELECT {JACCARD} AS score FROM com) SELECT score >= 0.5::DOUBLE AS accepted, CAST(least(19, floor(score * 20)) AS INTEGER) AS bin, count(*) AS n FROM s GROUP BY ALL")
def score_stairs(spark, d):
    c = pairs.common_kmers(pairs.unique_records(_parts(spark, d)), 3)
    return plots.score_stairs(c.select(S.jaccard(F.col("common"), F.col("na"), F.col("nb")).alias("score")), 0.5)


@_query("kmer_pca")
def kmer_pca(spark, d):
    return plots.kmer_pca(_fixed_split(spark, d), 3)


@_query("feature_qq")
def feature_qq(spark, d):
    return plots.qq(_skewed_split(spark, d))


_POINTS = f"pts AS (SELECT rid, p_size AS cl, length AS x, charge AS y FROM (SELECT rid, {_feature_sql()} FROM rec WHERE len(seq) > 0) JOIN part ON p_partkey = rid)"


@_query("silhouette", f"WITH {REC}, {_POINTS}, big AS (SELECT * FROM pts WHERE cl IN (SELECT cl FROM pts GROUP BY cl HAVING count(*) > 1)), num AS (SELECT *, row_number() OVER (ORDER BY rid) - 1 AS pos, count(*) OVER () AS n FROM big), smp AS (SELECT * FROM num WHERE n <= 1000 OR pos IN (SELECT CAST(floor(i * ((SELECT max(n) FROM num) - 1) / 999.0::DOUBLE + 1e-9) AS BIGINT) FROM range(1000) r(i))), dst AS (SELECT a.rid, a.cl AS ca, b.cl AS cb, sum(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))) AS d, count(*) AS m FROM smp a, smp b GROUP BY ALL), sil AS (SELECT rid, max(CASE WHEN ca = cb THEN d / greatest(m - 1, 1) END) AS i, min(CASE WHEN ca <> cb THEN d / m END) AS o FROM dst GROUP BY rid) SELECT count(*) AS n, round(avg((o - i) / greatest(i, o, 1e-12)), 6) AS silhouette FROM sil")
def silhouette(spark, d):
    """Of parts grouped by size, over length and charge; 1000 points evenly spaced, which is the operator's sample."""
    feats = S.features(F.col("seq"))
    own = _parts(spark, d).where("seq <> ''").select("rid", F.round(feats["length"], 6).alias("length"), F.round(feats["charge"], 6).alias("charge"))
    own = own.join(_t(spark, d, "part").select(F.col("p_partkey").alias("rid"), F.col("p_size").alias("cluster_id")), "rid")
    return audit.silhouette(own, ["length", "charge"]).select("n", F.round("silhouette", 6).alias("silhouette"))


@_query("set_jaccard", "WITH w AS (SELECT doc_id, quality, toxic FROM labels), s AS (SELECT o_custkey AS k, list(DISTINCT o_orderpriority) FILTER (o_orderstatus = 'F') AS a, list(DISTINCT o_orderpriority) FILTER (o_orderstatus = 'P') AS b FROM orders GROUP BY 1), t AS (SELECT k, coalesce(a, []) AS a, coalesce(b, []) AS b FROM s) SELECT k, round(CASE WHEN len(a) + len(b) = 0 THEN 1 ELSE len(list_intersect(a, b)) / CAST(len(list_distinct(list_concat(a, b))) AS DOUBLE) END, 9) AS jaccard FROM t")
def set_jaccard(spark, d):
    """Of each customer's priorities of finished and of pending orders; two empty sets are the same."""
    of = lambda x: F.collect_set(F.when(F.col("o_orderstatus") == x, F.col("o_orderpriority")))
    own = _t(spark, d, "orders").groupBy(F.col("o_custkey").alias("k")).agg(of("F").alias("a"), of("P").alias("b"))
    return own.select("k", _r(S.set_jaccard(F.col("a"), F.col("b")), "jaccard"))


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
