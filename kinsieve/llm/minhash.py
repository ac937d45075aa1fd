"""MinHash near-duplicate removal (operator 6).

Shingles are hashed to 64 bits; equal shingle sets are one node.  A node's signature is the
minima of universal hashes (a*x + b mod 2**64, a odd); its bands give bucket keys.  Every
node is first compared with the least pivot of its buckets, then, for some rounds, members
outside their bucket's largest component with members drawn from that; at last members
still in different components meet by an exact prefix-filtered join of their full sets,
so that no link between components is lost while no group is expanded into all its pairs.  A comparison takes lengths,
parity bitmaps (which bound the symmetric difference from below, so they lose nothing) and signatures first and confirms
on full sets.
Components come from alternating large-star and small-star.

Hot keys (a bucket, a pivot, a component or a set of copies that holds a large share of all rows)
are broadcast apart from the others, see join_counted.  A worker takes up half a mebibyte of text, or
one longer text, at about 15 times its bytes.

Defined results: null, empty and wordless texts have an empty set, link with nothing and are
kept; with fewer words than a shingle the whole sequence is the one shingle; a repeated row
shares its component, and the rows of the smallest id are all kept; null ids are ignored as
component ids unless alone; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Words, cut, join_counted, map_batches, maybe_broadcast, mix, packed, release, table, text_or_empty, tight, unpacked
from .components import components

HASHES, ROWS, TURNS, DRAWS, PARITY, FEW = 160, 5, 1, 12, 512, 16
_RNG = np.random.default_rng(2024)
_A = _RNG.integers(0, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RNG.integers(0, 1 << 63, HASHES, dtype=np.uint64)
_C = _RNG.integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(texts: list[str | None], k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, bounds): the sorted distinct shingle hashes of each text, joined, and where each text's begin."""
    w = Words(texts)
    n = len(w.hash)
    h = np.zeros(max(0, n - k + 1), np.uint64)
    for j in range(k):
        h += w.hash[j : n - k + 1 + j] * _C[j % 64]
    inside = w.doc[: n - k + 1] == w.doc[k - 1 :] if n >= k else np.zeros(0, bool)
    doc, h = w.doc[: max(0, n - k + 1)][inside], mix(h[inside])
    short = np.flatnonzero((w.counts > 0) & (w.counts < k))
    if len(short):
        whole = [np.uint64(0)] * len(short)
        for i, d in enumerate(short):
            own = w.hash[w.bounds[d] : w.bounds[d + 1]]
            whole[i] = (own * _C[32 : 32 + len(own)]).sum(dtype=np.uint64) + np.uint64(len(own))
        doc, h = np.concatenate([doc, short]), np.concatenate([h, mix(np.array(whole, np.uint64))])
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    if len(h):
        new = np.concatenate([[True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])])
        doc, h = doc[new], h[new]
    return h, np.searchsorted(doc, np.arange(len(texts) + 1))


def signatures(h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Minima of each universal hash over each text's set; texts without shingles keep the largest value."""
    out = np.full((len(bounds) - 1, HASHES), np.iinfo(np.uint64).max, np.uint64)
    some = np.flatnonzero(np.diff(bounds))
    step, block = 8192, np.empty(0, np.uint64)
    # texts in runs of about step shingles, so that a run stays in the processor's cache
    at = 0
    while at < len(some):
        last = max(at + 1, int(np.searchsorted(bounds[some + 1], bounds[some[at]] + step, side="right")))
        rows = some[at:last]
        x = h[bounds[rows[0]] : bounds[rows[-1] + 1]]
        cuts = bounds[rows] - bounds[rows[0]]
        if len(block) < len(x):
            block = np.empty(len(x), np.uint64)
        y = block[: len(x)]
        for j in range(HASHES):
            np.multiply(x, _A[j], out=y)
            np.add(y, _B[j], out=y)
            out[rows, j] = np.minimum.reduceat(y, cuts)
        at = last
    return out


def _set_ids(h: np.ndarray, bounds: np.ndarray) -> list[bytes]:
    """128-bit names of the sets: two sums of mixed hashes, and the size folded in."""
    out = np.zeros((len(bounds) - 1, 2), np.uint64)
    some = np.flatnonzero(np.diff(bounds))
    if len(some):
        out[some, 0] = np.add.reduceat(mix(h ^ np.uint64(0x51ED270B)), bounds[some])
        out[some, 1] = np.add.reduceat(mix(h + np.uint64(0x2545F4914F6CDD1D)), bounds[some])
    out[:, 1] ^= mix(np.diff(bounds).astype(np.uint64))
    return [r.tobytes() for r in out]


def parities(h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """PARITY bits for each set: bit j is the parity of the number of its shingles that hash to j."""
    n = len(bounds) - 1
    slot = (mix(h ^ np.uint64(0x6A09E667F3BCC909)) % np.uint64(PARITY)).astype(np.int64)
    odd = np.bincount(np.repeat(np.arange(n), np.diff(bounds)) * PARITY + slot, minlength=n * PARITY) & 1
    return np.packbits(odd.astype(np.uint8).reshape(n, PARITY), axis=1, bitorder="little").view("<i8")


def not_too_far(percent: int) -> Column:
    """False only for sets (sizes nu, nv; parities pu, pv) that can't be similar enough.

    Every bit that differs needs a shingle of the symmetric difference (bitmap filter, Sandes et al., 2017),
    and similar sets have a difference of at most (100 - percent) / (100 + percent) of both sizes.
    """
    differ = " + ".join(f"bit_count(pu[{j}] ^ pv[{j}])" for j in range(PARITY // 64))
    return F.expr(f"least(nu, nv) * 100 >= greatest(nu, nv) * {percent} and ({differ}) * {100 + percent} <= (nu + nv) * {100 - percent}")


def profiles(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, t, n_shingles, sid, bands, sig, parity) of each document; t digests its text, sid names its shingle set."""

    def run(batch: pa.RecordBatch) -> dict:
        h, bounds = shingles(batch.column(1).to_pylist(), k)
        minima = signatures(h, bounds)
        n, bands = len(minima), HASHES // ROWS
        m = minima.reshape(n, bands, ROWS)
        key = np.zeros((n, bands), np.uint64) + np.arange(1, bands + 1, dtype=np.uint64) * _C[50]
        for j in range(ROWS):
            key = mix(key ^ m[:, :, j] * _C[j])
        flat = pa.ListArray.from_arrays(pa.array(np.arange(0, n * bands + 1, bands), pa.int32()), pa.array(key.reshape(-1).view(np.int64)))
        sig = (minima >> np.uint64(48)).astype("<u2")
        odd = parities(h, bounds)
        parity = pa.ListArray.from_arrays(pa.array(np.arange(0, odd.size + 1, PARITY // 64), pa.int32()), pa.array(odd.reshape(-1)))
        return {"doc_id": batch.column(0), "t": batch.column(2), "n_shingles": np.diff(bounds), "sid": _set_ids(h, bounds), "bands": flat, "sig": [s.tobytes() for s in sig], "parity": parity}

    return map_batches(docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text"), F.xxhash64(text_or_empty()).alias("t")), run, "doc_id long, t long, n_shingles long, sid binary, bands array<long>, sig binary, parity array<long>")


def _sets(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """(sid, own): full shingle sets of the wanted sids (distinct sid, and rep, a document that has it), computed again from whole texts."""

    def run(batch: pa.RecordBatch) -> dict:
        h, bounds = shingles(batch.column(0).to_pylist(), k)
        return {"sid": _set_ids(h, bounds), "own": pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(h.view(np.int64)))}

    some = docs.select(F.col("doc_id").cast("long").alias("id"), text_or_empty().alias("text"))
    some = some.join(maybe_broadcast(wanted.select("rep")), F.col("id").eqNullSafe(F.col("rep")), "left_semi")
    found = map_batches(some.select("text"), run, "sid binary, own array<long>")
    return found.join(maybe_broadcast(wanted.select("sid")), "sid", "left_semi").dropDuplicates(["sid"])


def confirmed(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, k: int, percent: int) -> DataFrame:
    """Links (u, v) among distinct pairs (u, v) of nodes: lengths and parities, then signatures, then full sets."""
    least = percent / 100 - 6 * (percent / 100 * (1 - percent / 100) / HASHES) ** 0.5

    def near(batch: pa.RecordBatch) -> dict:
        a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), "<u2").reshape(-1, HASHES) for i in (2, 3))
        keep = pa.array((a == b).mean(axis=1) >= least)
        return {n: batch.column(i).filter(keep) for i, n in ((0, "u"), (1, "v"), (4, "su"), (5, "sv"))}

    a = nodes.select(F.col("node").alias("u"), F.col("n").alias("nu"), F.col("sig").alias("gu"), F.col("sid").alias("su"), F.col("parity").alias("pu"))
    b = nodes.select(F.col("node").alias("v"), F.col("n").alias("nv"), F.col("sig").alias("gv"), F.col("sid").alias("sv"), F.col("parity").alias("pv"))
    pairs = cut(pairs)
    n = pairs.count()
    if not n:
        return pairs.select("u", "v")
    pairs = tight(pairs, n)
    asked = cut(pairs.groupBy("v").agg(F.count("*").alias("c")))  # one node may be asked by many
    asked = cut(b.join(maybe_broadcast(tight(asked, n)), "v"))
    both = join_counted(a.join(maybe_broadcast(pairs), "u"), asked, ["v"], "c", n).where(not_too_far(percent))
    likely = cut(map_batches(both.select("u", "v", "gu", "gv", "su", "sv"), near, "u long, v long, su binary, sv binary"))
    n = likely.count()
    if not n:
        return likely.select("u", "v")
    likely = tight(likely, n)
    sids = cut(likely.select(F.col("su").alias("sid")).unionByName(likely.select(F.col("sv").alias("sid"))).distinct())
    wanted = cut(nodes.select("sid", "rep").join(maybe_broadcast(tight(sids, 2 * n)), "sid"))
    own = cut(_sets(docs, wanted, k))
    full = own.select(F.col("sid").alias("su"), F.col("own").alias("a")).join(maybe_broadcast(likely), "su").join(own.select(F.col("sid").alias("sv"), F.col("own").alias("b")), "sv")
    shared = F.size(F.array_intersect("a", "b"))
    return cut(full.where(shared * 100 >= (F.size("a") + F.size("b") - shared) * percent).select("u", "v"))


def _apart(members: DataFrame, root: DataFrame, turn: int, total: int) -> DataFrame:
    """(key, node, root, largest, drawn): members of buckets with several components, the largest of these, and one of its members drawn by a hash."""
    own = members.select("key", "node").join(maybe_broadcast(root), "node", "left").withColumn("root", F.coalesce("root", "node"))
    parts = own.groupBy("key", "root").agg(F.count("*").alias("c"), F.min(F.struct(F.xxhash64("node", F.lit(turn)).alias("h"), "node")).alias("d"))
    split = parts.groupBy("key").agg(F.max(F.struct("c", "root", "d")).alias("most"), F.count("*").alias("parts"), F.sum("c").alias("m")).where("parts > 1")
    split = cut(split.select("key", F.col("most.root").alias("largest"), F.col("most.d.node").alias("drawn"), "m"))
    return join_counted(own, split, ["key"], "m", total)


def _prefix_pairs(docs: DataFrame, apart: DataFrame, k: int, percent: int) -> DataFrame:
    """(u, v): all pairs of nodes of different components that can be similar enough, by prefix filtering (Chaudhuri et al., 2006).

    Two sets that similar share one of the rarest n - ceil(percent% of n) + 1 shingles of each.
    Edits make shingles that few texts have, so copies of one text don't all meet.
    """
    if not apart.limit(1).count():
        return apart.select(F.col("node").alias("u"), F.col("node").alias("v"))
    own = _sets(docs, apart.select("sid", "rep").distinct(), k).join(apart, "sid")
    rows = cut(own.select("node", "root", "n", F.explode("own").alias("s")))
    frequency = rows.groupBy("s").agg(F.count("*").alias("df"))
    rarest = F.row_number().over(Window.partitionBy("node").orderBy("df", "s"))
    prefix = rows.join(frequency, "s").withColumn("r", rarest).where(F.expr(f"r <= n - (n * {percent} + 99) div 100 + 1 and df > 1"))
    # a pair meets at one shared shingle only where the least FEW of both prefixes have one in common
    whole = prefix.groupBy("node").agg(F.array_sort(F.collect_list("s")).alias("all"))  # of one document
    whole = whole.join(apart.select("node", "root", "n", "parity"), "node")
    each = whole.select("node", "root", "n", "parity", F.slice("all", 1, FEW).alias("few"), F.explode("all").alias("s"))
    u = each.select("s", F.col("node").alias("u"), F.col("root").alias("ru"), F.col("n").alias("nu"), F.col("parity").alias("pu"), F.col("few").alias("fu"))
    v = each.select("s", F.col("node").alias("v"), F.col("root").alias("rv"), F.col("n").alias("nv"), F.col("parity").alias("pv"), F.col("few").alias("fv"))
    once = F.expr("s_ = coalesce(array_min(array_intersect(fu, fv)), s_)")
    return u.withColumnRenamed("s", "s_").join(v, (F.col("s_") == v["s"]) & F.expr("ru <> rv and u > v") & not_too_far(percent) & once).select("u", "v").distinct()


def _nodes(rows: DataFrame) -> tuple[DataFrame, int]:
    """((sid, rep, c, n, bands, sig, parity, node), rows): one row for each set that isn't empty; c rows of documents have it."""
    own = rows.where("n_shingles > 0").groupBy("sid").agg(F.min("doc_id").alias("rep"), F.count("*").alias("c"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"), F.first("sig").alias("sig"), F.first("parity").alias("parity"))
    own = cut(own).withColumn("node", F.monotonically_increasing_id())  # over a checkpoint, so always the same
    n = own.count()
    return tight(own, n), n


def _members(nodes: DataFrame, n: int) -> tuple[DataFrame, int]:
    """((key, node, pivot), rows): the buckets of several nodes; pivot is the least of them."""
    keyed = nodes.select(F.explode("bands").alias("key"), "node")
    buckets = cut(keyed.groupBy("key").agg(F.min("node").alias("pivot"), F.count("*").alias("m")).where("m > 1"))
    found, total = buckets.agg(F.count("*"), F.coalesce(F.sum("m"), F.lit(0))).first()
    return tight(cut(join_counted(keyed, tight(buckets, found), ["key"], "m", n * (HASHES // ROWS))), total, 100_000), total


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept, t, part) for each row of docs; links where 100 * intersection >= percent * union.

    t digests the text; part names the component also where ids repeat, and is null for texts without words.
    """
    rows = cut(profiles(docs, k))
    nodes, n_nodes = _nodes(rows)
    members, n_members = _members(nodes, n_nodes)
    release(docs.sparkSession)
    # each node against the least pivot of its buckets
    first = members.where("node <> pivot").groupBy("node").agg(F.min("pivot").alias("v")).select(F.col("node").alias("u"), "v")
    links = confirmed(docs, nodes, first, k, percent)
    root = cut(components(links))
    release(docs.sparkSession)
    # then those outside a bucket's largest component against members of it, drawn anew each round
    for turn in range(TURNS):
        apart = _apart(members, root, turn, n_members)
        asked = apart.where("root <> largest").groupBy("node").agg(F.slice(F.sort_array(F.collect_set("drawn")), 1, DRAWS).alias("vs"))
        new = confirmed(docs, nodes, asked.select(F.col("node").alias("u"), F.explode("vs").alias("v")), k, percent)
        if not new.limit(1).count():
            break
        links = cut(links.unionByName(new).distinct())
        root = cut(components(links))
        release(docs.sparkSession)
    # at last, whatever is still apart in a bucket: an exact join on the rarest shingles
    apart = cut(_apart(members, root, TURNS, n_members).select("node", "root").distinct().join(nodes.select("node", "n", "sid", "rep", "parity"), "node"))
    left = cut(_prefix_pairs(docs, apart, k, percent))
    release(docs.sparkSession)
    more = confirmed(docs, nodes, left, k, percent)
    if more.limit(1).count():
        links = links.unionByName(more)
        root = cut(components(links))

    placed = cut(nodes.select("sid", "node", "rep", "c").join(maybe_broadcast(root), "node", "left").withColumn("root", F.coalesce("root", "node")))
    least = cut(placed.groupBy("root").agg(F.min("rep").alias("component"), F.count("*").alias("m")))
    named = cut(join_counted(placed, least, ["root"], "m", n_nodes).select("sid", "component", "c", F.col("root").alias("part")))
    own = rows.select("doc_id", "t", "n_shingles", "sid")
    out = join_counted(own.where("n_shingles > 0"), named, ["sid"], "c", rows.count()).unionByName(own.where("n_shingles = 0").withColumns({"component": F.lit(None).cast("long"), "part": F.lit(None).cast("long")}))
    out = out.withColumn("component_id", F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), "t", "part")


def one_of_each(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """docs, whole rows, without near duplicates: of each component the row of least id, and of that id of least text digest.

    Rows that repeat that id and text are copies too, of which one stays.  Rows without words all stay.
    """
    found = cut(near_duplicates(docs.select("doc_id", "text"), k, percent))
    least = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "t")).alias("x")
    best = found.where("part is not null").groupBy("part").agg(least).select("x.doc_id", "x.t")
    repeated = found.where("part is not null").groupBy("doc_id", "t").agg(F.count("*").alias("times")).where("times > 1").withColumnRenamed("doc_id", "id").withColumnRenamed("t", "t2")
    stay = best.join(repeated, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("t") == F.col("t2")), "left").select("doc_id", "t", F.col("times").isNotNull().alias("once"))
    stay = stay.unionByName(found.where("part is null").select("doc_id", "t").distinct().withColumn("once", F.lit(False)))
    stay = cut(stay.select(F.col("doc_id").alias("_kinsieve_id"), F.col("t").alias("_kinsieve_t"), "once"))
    repeats = stay.where("once").limit(1).count()
    stay = maybe_broadcast(stay)
    digest = F.xxhash64(text_or_empty())
    own = packed(docs, F.col("doc_id").cast("long").alias("doc_id"), digest.alias("t")).join(stay, F.col("doc_id").eqNullSafe(F.col("_kinsieve_id")) & (F.col("t") == F.col("_kinsieve_t")))
    if not repeats:
        return unpacked(own)
    return unpacked(own.where("not once").unionByName(own.where("once").dropDuplicates(["doc_id", "t"])))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), 3, 85).drop("t", "part")
