import json
import math

import pytest
from pyspark.sql import functions as F

from kinsieve.config import SplitConfig
from kinsieve.functions import sequence as S
from kinsieve.operators import assign, audit, balance, blocks, cluster, diagnostics, graph, pairs, plots
from kinsieve.plans import run
from kinsieve.sources import records as R


def frame(spark, seqs, labels=None):
    return spark.createDataFrame([(i, f"p{i}", None if labels is None else labels[i], s) for i, s in enumerate(seqs)], "rid long, id string, label int, seq string")


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_alphabets(spark):
    assert one(spark, S.reduce_alphabet(F.lit("ACDEF"), "groups5")) == "HS--H"
    assert one(spark, S.reduce_alphabet(F.lit("AVF"), "groups7")) == "AAR"
    assert one(spark, S.reduce_alphabet(F.lit("ABZ-a"), "groups5")) == "HXXXX"
    with pytest.raises(ValueError):
        S.alphabet_mapping("groups9")


def test_kmers_and_edit(spark):
    assert sorted(one(spark, S.kmers(F.lit("ABAB"), 2))) == ["AB", "BA"]
    assert one(spark, S.kmers(F.lit("AA"), 3)) == []
    assert one(spark, S.edit_identity(F.lit("ACDEF"), F.lit("ACDDF"))) == pytest.approx(0.8)
    assert one(spark, S.edit_identity(F.lit(""), F.lit(""))) == 1.0
    assert one(spark, S.edit_bound(F.lit("A" * 10), F.lit("A" * 10), 0.9)) == 0
    with pytest.raises(ValueError):
        S.kmers(F.lit("A"), True)


def test_empty_sketch(spark):
    assert one(spark, S.minhash(S.kmers(F.lit("A"), 3), 4, 1)) == [S.PRIME] * 4


def test_features(spark):
    row = spark.range(1).select(*(c.alias(n) for n, c in S.features(F.lit("AA")).items())).first()
    assert row["mw"] == pytest.approx(178.2 - 18.01528)
    assert spark.range(1).select(S.features(F.lit("IXI"))["unknown_fraction"].alias("x")).first()["x"] == pytest.approx(1 / 3)
    assert list(S.features(F.lit("A"))) == S.FEATURE_NAMES and len(S.FEATURE_NAMES) == 32


def test_fasta(spark, tmp_path):
    p = tmp_path / "a.fasta"
    p.write_bytes(b"\xef\xbb\xbf>p1|1\r\nacd\r\n ef\r\n\r\n>p2|x\nGG\n>empty\n>p3|0\nKK\n")
    got = [tuple(r) for r in R.read_fasta(spark, str(p)).orderBy("rid").collect()]
    assert got == [(0, "p1", 1, "ACDEF"), (1, "p2|x", None, "GG"), (2, "p3", 0, "KK")]
    out = tmp_path / "b.fasta"
    R.write_fasta_file(R.read_fasta(spark, str(p)), str(out), wrap=2)
    assert out.read_text() == ">p1|1\nAC\nDE\nF\n>p2|x\nGG\n>p3|0\nKK\n"
    for bad, words in ((b"AC\n>p\nA\n", "before first"), (b">\nA\n", "empty header"), (b">|0\nA\n", "empty identifier")):
        p.write_bytes(bad)
        with pytest.raises(ValueError, match=words):
            R.read_fasta(spark, str(p))


def test_external_clusters(spark, tmp_path):
    p = tmp_path / "c.json"
    p.write_text(json.dumps({"0": 0, "1": 0, "2": 5}))
    assert R.read_clusters(spark, str(p), 3).count() == 3
    with pytest.raises(ValueError):
        R.read_clusters(spark, str(p), 4)


def test_components_of_a_chain(spark):
    n = 40
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)], "a long, b long")
    nodes = spark.range(n + 3).select(F.col("id").alias("rid"))
    got = {r["rid"]: r["root"] for r in graph.component_labels(nodes, edges).collect()}
    assert got == {i: 0 if i <= n else i for i in range(n + 3)}


def test_dense_bucket_is_linear(spark):
    sk = spark.range(256).select(F.col("id").alias("rid"), F.array_repeat(F.lit(0).cast("long"), 16).alias("sketch"))
    assert pairs.band_pairs(sk, 16, 4).count() <= 256 * 8


def test_prefix_filter_loses_nothing(spark):
    import random

    r = random.Random(5)
    seqs = ["".join(r.choice("AC") for _ in range(r.randrange(3, 12))) for _ in range(40)]
    sets = [{s[i : i + 3] for i in range(len(s) - 2)} for s in seqs]
    first = {s: i for i, s in reversed(list(enumerate(seqs)))}
    ids = sorted(first.values())
    want = {(a, b) for a in ids for b in ids if a < b and sets[a] and sets[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.6}
    got = {(x["a"], x["b"]) for x in pairs.jaccard_pairs(pairs.unique_records(frame(spark, seqs)), 3, 0.6).collect()}
    assert got == want


def test_clusters_keep_duplicates(spark):
    c = cluster.cluster(frame(spark, ["ACDEFGHIKLMNPQ"] * 30 + ["WWWYYYVVVTTT"]), SplitConfig(kmer_sizes=(3,), num_hashes=16))
    assert c.stats["duplicate_sequences_collapsed"] == 29 and c.stats["candidate_pairs_considered"] == 0 and c.stats["cluster_count"] == 2
    with pytest.raises(ValueError):
        cluster.cluster(frame(spark, ["ACDEFG", "WWYYVV"]), SplitConfig(num_hashes=16, strict_clustering=True))


def test_families_in_a_dense_bucket_stay_whole(spark):
    import random

    r = random.Random(3)
    word = lambda n: "".join(r.choice("ACDEFGHIKLMNPQRSTVWY") for _ in range(n))
    motif = word(40)
    first = [motif + word(12) for _ in range(300)]
    seqs = [s for own in first for s in (own, own + word(1))]
    config = SplitConfig(num_hashes=4, lsh_rows=(4,), similarity_threshold=0.9)
    sk = pairs.sketches(frame(spark, seqs), 3, 4, config.seed)
    hot = {x["rid"] for x in pairs.dense_members(sk, 4, 4).collect()}
    twins = [i for i in range(0, len(seqs), 2) if {i, i + 1} <= hot]
    assert len(twins) > 60
    for c in (config, config.with_(verify_with="levenshtein", prefilter_threshold=0.8), config.with_(cluster_method="label-propagation")):
        got = {x["rid"]: x["cluster_id"] for x in cluster.cluster(frame(spark, seqs), c).labels.collect()}
        assert all(got[i] == got[i + 1] for i in twins) and len(set(got.values())) >= 300


def test_apart_pairs_are_those_of_different_roots(spark):
    import random

    r = random.Random(4)
    seqs = sorted({"".join(r.choice("AC") for _ in range(r.randrange(3, 12))) for _ in range(60)})
    roots = spark.createDataFrame([(i, r.choice([0, 0, 0, 1, 2])) for i in range(len(seqs))], "rid long, root long")
    root = {x["rid"]: x["root"] for x in roots.collect()}
    for least in (0.0, 0.5):
        whole = {tuple(x) for x in pairs.jaccard_pairs(frame(spark, seqs), 3, least).collect() if root[x["a"]] != root[x["b"]]}
        got = [tuple(x) for x in pairs.jaccard_pairs(frame(spark, seqs), 3, least, roots).collect()]
        assert len(got) == len(set(got)) and set(got) == whole and whole


def test_exact_mode_does_not_fall_back(spark):
    with pytest.raises(ValueError, match="exact"):
        cluster.cluster(frame(spark, ["ACDEFG", "WWYYVV", "ACDEFH"]), SplitConfig(exact_mode=True, exact_mode_max_sequences=2))


def test_splits(spark):
    assert assign.target_sizes(11, (0.8, 0.1, 0.1)) == [9, 1, 1]
    recs = frame(spark, ["AC"] * 100, [i % 2 for i in range(100)])
    got = {(r["label"], r["split"]): r["count"] for r in assign.random_split(recs).groupBy("label", "split").count().collect()}
    assert got == {(y, s): n for y in (0, 1) for s, n in (("train", 40), ("val", 5), ("test", 5))}
    sizes = spark.createDataFrame([(i, 1) for i in range(100)], "cluster_id long, size long")
    n = {r["split"]: r["count"] for r in assign.greedy_split(sizes).groupBy("split").count().collect()}
    assert n == {"train": 80, "val": 10, "test": 10}
    have = [0] * 4
    for _ in range(100):
        i = min(range(4), key=lambda i: (abs(have[i] + 1 - 25), i))
        have[i] += 1
    assert {r["fold"]: r["count"] for r in assign.folds(sizes, 4).groupBy("fold").count().collect()} == {i: n for i, n in enumerate(have) if n}


def test_distances(spark):
    long = spark.createDataFrame([("f", "a", 0.0), ("f", "a", 0.0), ("f", "b", 1.0), ("f", "b", 1.0)], "feature string, grp string, v double")
    r = diagnostics.distances(long, "a", "b").first()
    assert (r["ks"], r["wasserstein"]) == (1.0, 1.0)


@pytest.mark.parametrize("bad", [{"train_pct": -1}, {"kmer_sizes": ()}, {"num_hashes": 3}, {"seed": True}, {"reduced_alphabet": "x"}, {"verify_with": "cosine", "prefilter_threshold": 0.9}])
def test_config(bad):
    with pytest.raises(ValueError):
        SplitConfig(**bad)


def test_config_normalises():
    c = SplitConfig(train_pct=80, val_pct=10, test_pct=10)
    assert math.isclose(c.train_pct, 0.8) and c.as_dict()["prefilter_threshold"] is None


def test_entry_without_llm(spark):
    import __spark_entry__ as e

    assert {"components", "cluster_split_documents"} <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())


def test_config_has_no_dead_option():
    """Every option is read somewhere outside config.py, or refused."""
    import dataclasses
    import pathlib

    root = pathlib.Path(cluster.__file__).parent.parent
    code = "".join(p.read_text() for p in root.rglob("*.py") if p.name != "config.py" and "llm" not in p.parts)
    for f in dataclasses.fields(SplitConfig):
        assert f"config.{f.name}" in code or f.name in ("balance_report",), f.name
    with pytest.raises(ValueError, match="backend"):
        SplitConfig(backend="native")


def clusters_of(spark, sizes, seed=1):
    """Records and labels: clusters of the given sizes, each with letters of its own."""
    import random

    r, rows, labels = random.Random(seed), [], []
    for c, n in enumerate(sizes):
        letters = r.sample("ACDEFGHIKLMNPQRSTVWY", 4)
        for _ in range(n):
            rows.append((len(rows), f"p{len(rows)}", r.randrange(2), "".join(r.choice(letters) for _ in range(r.randrange(5, 30)))))
            labels.append((len(labels), c))
    return spark.createDataFrame(rows, "rid long, id string, label int, seq string"), spark.createDataFrame(labels, "rid long, cluster_id long")


def brute_balanced(spark, records, labels, config):
    """The greedy choice from its definition, over whole feature matrices."""
    import hashlib

    import numpy as np

    feats = records.select("rid", "label", *(c.alias(n) for n, c in S.features(F.col("seq")).items())).orderBy("rid").collect()
    x, y = np.array([r[2:] for r in feats], float), np.array([r["label"] for r in feats])
    members: dict = {}
    for r in labels.collect():
        members.setdefault(r["cluster_id"], []).append(r["rid"])
    n, shares = len(x), (config.train_pct, config.val_pct, config.test_pct)
    goal, mean, scale = [n * s for s in shares], x.mean(0), x.std(0)
    scale = np.where(scale > 1e-12, scale, 1)
    order = sorted(members, key=lambda c: (-len(members[c]), hashlib.md5(f"{config.seed}:{c}".encode()).hexdigest(), c))
    low, high = balance.bounds_of(n, shares, len(order))
    have, out = [[], [], []], {}
    for at, c in enumerate(order):
        size, costs = len(members[c]), {}
        empty = [i for i in range(3) if not have[i] and low[i] > 0]
        for i in range(3):
            new = have[i] + members[c]
            if config.balance:
                need = sum(max(0, low[j] - len(new if j == i else have[j])) for j in range(3))
                if len(new) > high[i] or (len(order) - at - 1 < len(empty) and i in empty) or n - sum(map(len, have)) - size < need:
                    continue
            cost = (abs(len(new) - goal[i]) - abs(len(have[i]) - goal[i])) / n
            if config.balance:
                cost += config.balance_weight * (((x[new].mean(0) - mean) / scale) ** 2).mean()
            if config.stratify_labels:
                cost += abs(y[new].sum() - shares[i] * y.sum()) / n
            costs[i] = cost
        costs = costs or {i: abs(len(have[i]) + size - goal[i]) for i in range(3)}
        best = min(costs, key=lambda i: (round(costs[i], 12), i))
        have[best] = have[best] + members[c]
        out[c] = assign.SPLITS[best]
    return out


@pytest.mark.parametrize("options", [{}, {"balance": True, "balance_metric": "mean"}, {"stratify_labels": True}, {"balance": True, "balance_metric": "mean", "stratify_labels": True, "balance_weight": 0.3}])
def test_balanced_assignment_brute_force(spark, options):
    records, labels = clusters_of(spark, [9, 7, 5, 4, 4, 3, 3, 2, 2, 2, 1, 1, 1, 1, 1, 1, 1, 1, 1, 1])
    config = SplitConfig(**options)
    got = {r["cluster_id"]: r["split"] for r in balance.assign_clusters(records, labels, config).placed.collect()}
    assert got == brute_balanced(spark, records, labels, config)


def test_balance_by_distribution_bounds_search_and_frontier(spark):
    records, labels = clusters_of(spark, [6, 5, 5, 4, 4, 3, 3, 3, 2, 2, 2, 2, 1, 1, 1, 1, 1, 1, 1, 1, 1])
    for metric in ("wasserstein", "ks", "mean"):
        a = balance.assign_clusters(records, labels, SplitConfig(balance=True, balance_metric=metric))
        s = a.stats
        assert s["method"] == "balanced-greedy" and sum(s["observed_sizes"].values()) == 50
        if not s["size_constraint_fallback"]:
            assert all(s["hard_size_bounds"][x]["min"] <= s["observed_sizes"][x] <= s["hard_size_bounds"][x]["max"] for x in assign.SPLITS)
    error = lambda c: sum(x for x in balance.assign_clusters(records, labels, c).stats["feature_mean_abs_error"].values())
    c = SplitConfig(balance=True, balance_metric="mean")
    searched = balance.assign_clusters(records, labels, c.with_(local_search_iterations=4))
    assert sum(searched.stats["observed_sizes"].values()) == 50 and error(c.with_(local_search_iterations=4)) > 0
    points = balance.assign_clusters(records, labels, c.with_(pareto_points=4)).stats["pareto_frontier"]
    assert points and all(not (q["size_error"] <= p["size_error"] and q["composition_error"] < p["composition_error"]) for p in points for q in points)


def test_search_lowers_the_objective(spark):
    import numpy as np

    records, labels = clusters_of(spark, [4, 4, 3, 3, 2, 2, 2, 1, 1, 1, 1])
    config = SplitConfig(local_search_iterations=5)
    table = balance.cluster_features(records, labels)
    c = balance._read(table, 42, 32, False)
    mean, scale = balance._scales(records)
    value = lambda s: balance._objective(np.bincount(s, c.sizes, 3), np.stack([c.sums[s == i].sum(0) for i in range(3)]), 24 * np.array([0.8, 0.1, 0.1]), 24, mean, scale, 1.0)
    before = np.arange(11) % 3
    after = balance._search(c, before, config, mean, scale)
    assert value(after) < value(before)
    for i in range(11):
        for j in range(i):
            if after[i] != after[j]:
                swapped = after.copy()
                swapped[[i, j]] = after[[j, i]]
                assert value(swapped) >= value(after) - 1e-9


def test_partition_check(spark):
    records, labels = clusters_of(spark, [2, 1])
    for bad in (labels.limit(2), labels.unionByName(labels.limit(1)), labels.withColumn("rid", F.col("rid") + 1)):
        with pytest.raises(ValueError, match="exactly once"):
            balance.check_partition(bad, records)


def test_audit_known_values(spark):
    rows = [(0, "AAAA", "train"), (1, "AAAAAA", "train"), (2, "AAAAAA", "val"), (3, "WWWW", "test")]
    splits = spark.createDataFrame([(i, None, s, x) for i, s, x in rows], "rid long, label int, seq string, split string")
    ks = {(r["a"], r["b"], r["feature"]): (r["ks"], r["wasserstein"]) for r in audit.feature_ks(splits).collect()}
    assert len(ks) == 96 and ks["train", "test", "freq_W"] == (1.0, 1.0) and ks["train", "val", "length"] == (0.5, 1.0)
    assert audit.balance_verdict(audit.normalized_balance(splits)).first()["status"] == "FAIL"
    near = {r["query"]: r["max"] for r in audit.nearest_summary(splits, 3).collect()}
    assert near == {"test": 0.0, "val": 1.0}
    assert audit.leakage_gate(splits, 3, 0.5) == 0.0
    with pytest.raises(ValueError, match="leakage"):
        audit.leakage_gate(splits.replace({"val": "test"}, subset="split"), 3, 0.5)


@pytest.fixture
def met(monkeypatch):
    """Records that the k-mer joins take in, a number for each call."""
    taken, plain = [], pairs.kmer_rows
    monkeypatch.setattr(pairs, "kmer_rows", lambda records, k: taken.append(records.count()) or plain(records, k))
    return taken


def test_nearest_of_copies(spark, met):
    query = spark.createDataFrame([(10 * i, "AAAA" if i % 2 else "WWWWA") for i in range(40)] + [(5000, "AC"), (5010, None)], "rid long, seq string")
    reference = spark.createDataFrame([(10 * i + 1, ("AAAAC", "AAAA", "WWWWC")[i % 3]) for i in range(60)], "rid long, seq string")
    found = {r["rid"]: (r["score"], r["ref"]) for r in pairs.nearest(query, reference, 3).collect()}
    assert len(found) == 42 and found[5000] == found[5010] == (0.0, None)
    assert {found[10 * i] for i in range(1, 40, 2)} == {(1.0, 581)} and {found[10 * i] for i in range(0, 40, 2)} == {(1 / 3, 591)}
    assert sorted(met) == [3, 4]  # distinct sequences, not copies


def test_boundary_records_of_copies(spark, met):
    rows = [(i, ("AAAA", "AAAAC", "WWWW")[i % 3], "train") for i in range(30)] + [(100 + i, ("AAAAC", "AAAAD")[i % 2], ("test", "val")[i % 2]) for i in range(20)]
    splits = spark.createDataFrame(rows, "rid long, seq string, split string")
    found = audit.boundary_records(splits, 3, 0.95).collect()
    assert {tuple(r) for r in found} == {(100 + i, "test", 28, 1.0) for i in range(0, 20, 2)} and len(found) == 10
    assert sorted(met) == [2, 3]
    assert audit.boundary_records(splits.where("split <> 'train'"), 3, 0.0).count() == 0


def test_nearest_summary_of_copies(spark, met):
    rows = [(i, ("AAAA", "WWWW")[i % 2], "train") for i in range(30)] + [(100 + i, ("AAAA", "AAAAD")[i % 2], "test") for i in range(20)]
    found = {r["query"]: tuple(r)[1:] for r in audit.nearest_summary(spark.createDataFrame(rows, "rid long, seq string, split string")).collect()}
    assert found == {"test": (20, 0.75, 1.0, 1.0), "val": (0, None, None, None)}
    assert sorted(met) == [2, 2]  # train is taken once for both splits, without copies


def test_linked_roots_brute_force(spark, monkeypatch):
    import random

    r, rows = random.Random(3), ["", "Éa", "ABCDEFGH", "ABCDEFGHI", "ABCDEFGHIJ", "É" * 30]
    for n in (12, 40, 300):
        base = ["".join(r.choice("ABCDé\U0001f600") for _ in range(n)) for _ in range(6)]
        for b in base:
            rows += [b, b[: n * 2 // 3], b[: n // 2] + r.choice(base)[n // 2 :]] + [b[:i] + "Z" + b[i + 1 :] for i in r.sample(range(n), 3)]
    rows = sorted(set(rows))
    sets = [{s[i : i + 9] for i in range(len(s) - 8)} for s in rows]
    root = list(range(len(rows)))
    edges = [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] and sets[j] and 2 * len(sets[i] & sets[j]) >= len(sets[i] | sets[j])]
    for _ in rows:
        for i, j in edges:
            root[i] = root[j] = min(root[i], root[j])
    records = spark.createDataFrame(list(enumerate(rows)), "rid long, seq string")
    assert {tuple(x) for x in blocks.linked_roots(records, 9, 0.5).collect()} == set(enumerate(root))
    # without pivots and in any order of k-mers the join alone finds all
    monkeypatch.setattr(blocks, "LONG_RUN", 2)
    monkeypatch.setattr(blocks, "pivot_pairs", lambda records, k: spark.createDataFrame([], "a long, b long"))
    monkeypatch.setattr(blocks, "frequencies", lambda records, total, k: blocks.np.zeros(blocks.SLOTS, "u1"))
    assert {tuple(x) for x in blocks.linked_roots(records, 9, 0.5).collect()} == set(enumerate(root))


def test_copies_do_not_meet_again(spark):
    text = "".join(chr(65 + i * i % 23) + chr(65 + i * 7 % 19) + chr(97 + i % 26) for i in range(100))
    records = spark.createDataFrame([(i, text[:i] + "#" + text[i:], 0) for i in range(100)], "rid long, seq string, root long")
    counts = blocks.frequencies(records, 100, 9)
    assert blocks.prefix_pairs(records, 9, 0.5, counts, 3).count() == 0
    assert blocks.prefix_pairs(records.withColumn("root", (F.col("rid") == 50).cast("long")), 9, 0.5, counts, 3).count() == 99


def test_rounds_and_copies_of_linked_roots(spark, monkeypatch):
    import random

    r = random.Random(5)
    base = ["".join(r.choice("ABCDEFGH") for _ in range(400)) for _ in range(20)]
    rows = [(i, x[:200] + "ZZ" + x[200:] if i >= 20 else x, i) for i, x in enumerate(base * 2)]
    records = spark.createDataFrame(rows, "rid long, seq string, root long")
    counts, made, pairs_of = blocks.frequencies(records, 40, 9), [], blocks.prefix_pairs
    each = [{tuple(x) for x in pairs_of(records, 9, 0.5, counts, 4, part, 2).collect()} for part in range(2)]
    assert each[0] | each[1] == {tuple(x) for x in pairs_of(records, 9, 0.5, counts, 4).collect()} >= {(i, i + 20) for i in range(20)}
    # a round has about half of the prefixes, and equal sequences don't come into the join
    monkeypatch.setattr(blocks, "prefix_pairs", lambda records, *a: made.append((records.count(), a[4:])) or pairs_of(records, *a))
    again = spark.createDataFrame([(i, s) for i, s, _ in rows] + [(100 + i, s) for i, s, _ in rows], "rid long, seq string")
    assert {tuple(x) for x in blocks.linked_roots(again, 9, 0.5).collect()} == {(100 * c + i, i % 20) for i in range(40) for c in (0, 1)}
    assert made == [(40, (0, 2)), (40, (1, 2))]


def test_silhouette_brute_force(spark):
    import random

    import numpy as np

    r = random.Random(2)
    pts = [(i, i % 3, r.random() + i % 3, r.random()) for i in range(30)] + [(30, 9, 5.0, 5.0)]
    df = spark.createDataFrame(pts, "rid long, cluster_id long, x double, y double")
    own = [p for p in pts if p[1] != 9]
    d = np.array([[math.dist(a[2:], b[2:]) for b in own] for a in own])
    c = np.array([p[1] for p in own])
    want = []
    for i in range(len(own)):
        a = d[i, c == c[i]].sum() / ((c == c[i]).sum() - 1)
        b = min(d[i, c == o].mean() for o in set(c) - {c[i]})
        want.append((b - a) / max(a, b))
    assert audit.silhouette(df, ["x", "y"]).first()["silhouette"] == pytest.approx(np.mean(want))
    assert audit.silhouette(df, ["x", "y"], 10).first()["n"] == 10
    assert audit.silhouette(df.limit(2), ["x", "y"]).first()["silhouette"] is None


def test_set_jaccard_of_empty_sets(spark):
    a = lambda *x: F.array(*map(F.lit, x)) if x else F.array().cast("array<string>")
    assert one(spark, S.set_jaccard(a(), a())) == 1.0 and one(spark, S.set_jaccard(a("x"), a())) == 0.0 and one(spark, S.set_jaccard(a("x", "y"), a("y"))) == 0.5


def test_kmer_pca(spark):
    import numpy as np

    records, _ = clusters_of(spark, [6, 6])
    splits = records.withColumn("split", F.when(F.col("rid") < 6, "train").otherwise("test"))
    rows, words, m = plots.kmer_matrix(splits, 2)
    got = {r["rid"]: (r["pc1"], r["pc2"]) for r in plots.kmer_pca(splits, 2).collect()}
    centred = m - m.mean(0)
    value, vector = np.linalg.eigh(centred.T @ centred)
    first = centred @ vector[:, -1]
    assert np.allclose(np.abs([got[i][0] for i, _ in rows]), np.abs(first)) and len(words) == m.shape[1]


FASTA = "".join(f">p{i}|{i % 2}\n{x}\n" for i, x in enumerate(["ACDEFGHIKLMNP", "ACDEFGHIKLMNQ", "WWYYVVTTSSRRQ", "WWYYVVTTSSRRP", "GGGHHHIIIKKKL", "MNPQRSTVWYACD", "FFFFGGGGHHHHI", "KLKLMNMNPQPQR", "STSTVWVWYAYAC", "DEDEFGFGHIHIK"]))


def test_command_line(spark, tmp_path):
    from kinsieve.cli import main

    (tmp_path / "in.fasta").write_text(FASTA)
    assert main(["split", "--input", str(tmp_path / "in.fasta"), "--output-dir", str(tmp_path / "out"), "--kmer-sizes", "3", "--num-hashes", "16", "--balance", "--balance-metric", "mean"]) == 0
    stats = json.loads((tmp_path / "out" / "stats.json").read_text())
    assert sum(stats["sizes"].values()) == 10 and stats["clustering"]["cluster_count"] == 8 and stats["assignment"]["method"] == "balanced-greedy"
    assert {"stats.json", "config.json", "report.txt", "report.html", "train.fasta", "val.fasta", "test.fasta"} <= {p.name for p in (tmp_path / "out").iterdir()}
    assert main(["audit", "--dir", str(tmp_path / "out"), "--output-dir", str(tmp_path / "audit")]) == 0
    again = json.loads((tmp_path / "audit" / "stats.json").read_text())
    assert again["sizes"] == stats["sizes"] and again["ks"] == stats["ks"] and "clustering" not in again
    assert "Cluster quality" in (tmp_path / "audit" / "report.txt").read_text() and "<pre>" in (tmp_path / "audit" / "report.html").read_text()
    for wrong in (["split", "--input", str(tmp_path / "none.fasta")], ["split", "--input", "x", "--kmer-sizes", "0"], ["audit", "--dir", str(tmp_path)]):
        with pytest.raises(SystemExit):
            main(wrong)


def test_dry_run_and_strict_gate(spark, tmp_path):
    (tmp_path / "in.fasta").write_text(FASTA)
    run.run_split(spark, str(tmp_path / "in.fasta"), str(tmp_path / "dry"), SplitConfig(num_hashes=16, dry_run=True, no_clustering=True))
    assert not (tmp_path / "dry" / "train.fasta").exists() and (tmp_path / "dry" / "stats.json").exists()
    (tmp_path / "c.json").write_text(json.dumps({str(i): i for i in range(10)}))
    config = SplitConfig(external_clusters=str(tmp_path / "c.json"), strict_clustering=True, similarity_threshold=0.5, train_pct=0.4, val_pct=0.1, test_pct=0.5)
    splits = cluster.split_records(R.read_fasta(spark, str(tmp_path / "in.fasta")), config)
    worst = audit.nearest_summary(splits, 3).where("query = 'test'").first()["max"]
    if worst > 0.5:
        with pytest.raises(ValueError, match="leakage"):
            run.run_split(spark, str(tmp_path / "in.fasta"), str(tmp_path / "strict"), config)
        assert not (tmp_path / "strict").exists()


def test_library_without_the_training_data_folders(tmp_path):
    """A copy without both folders and the pipeline still imports and offers the other queries."""
    import os
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    copy = tmp_path / "copy"
    shutil.copytree(root, copy, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert 'components' in q and not any(x.startswith('op1_') for x in q) and set(o) <= set(q)"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", code], cwd=copy, check=True, env=env)
