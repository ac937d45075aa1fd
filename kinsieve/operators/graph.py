"""Clusters as connected components or by label propagation."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or in local mode one of our own where it is unset."""
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        named = context.getConf().get("spark.checkpoint.dir")
        if not named and not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="kinsieve-"))
    return context._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Materialise in the shared checkpoint folder (spark.checkpoint.dir; a cluster must name it) and cut the lineage."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_path(spark: SparkSession) -> str:
    """A new path in the shared checkpoint folder."""
    return f"{checkpoint_folder(spark)}/kinsieve-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Delete what Spark wrote to a path, by the file system that it names."""
    own = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    own.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(own, True)


def release(spark: SparkSession) -> None:
    """Have Spark delete the shuffle files that nothing refers to any more; it learns of them from the driver's garbage collection."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def component_labels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(rid, root): the least rid of each node's component.  nodes (rid), edges (a, b).

    Each round takes the least label of the neighbours and then the label of the label (pointer
    jumping), so long chains need few rounds; all steps are joins and map-side minima.
    """
    both = cut(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut(both.select(F.col("a").alias("rid")).distinct().select("rid", F.col("rid").alias("root")))
    while True:
        near = both.join(labels, F.col("b") == F.col("rid")).groupBy("a").agg(F.min("root").alias("m"))
        hooked = labels.join(near, F.col("rid") == F.col("a")).select("rid", "root", F.least("root", "m").alias("new"))
        jump = hooked.select(F.col("rid").alias("x"), F.col("new").alias("y"))
        after = cut(hooked.join(jump, F.col("new") == F.col("x")).select("rid", F.col("root").alias("old"), "y"))
        labels = after.select("rid", F.col("y").alias("root"))
        if not after.where("old <> y").limit(1).count():
            break
    return nodes.select("rid").join(labels, "rid", "left").select("rid", F.coalesce("root", "rid").alias("root"))


def number_clusters(labels: DataFrame) -> DataFrame:
    """(rid, root, cluster_id): ids count up in the order of the least rid.

    Ranges of the root are numbered apart and shifted, so no single task sees all roots.
    """
    roots = labels.select("root").distinct()
    n = max(1, int(labels.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    placed = cut(roots.repartitionByRange(n, "root").withColumn("p", F.spark_partition_id()))
    sizes = placed.groupBy("p").agg(F.count("*").alias("c"))
    base = sizes.select("p", (F.sum("c").over(Window.orderBy("p")) - F.col("c")).alias("base"))
    ids = placed.join(F.broadcast(base), "p").select("root", (F.row_number().over(Window.partitionBy("p").orderBy("root")) - 1 + F.col("base")).cast("long").alias("cluster_id"))
    return labels.join(ids, "root").select("rid", "root", "cluster_id")


def propagate_labels(nodes: DataFrame, edges: DataFrame, seed: int, sweeps: int = 12) -> DataFrame:
    """(rid, root) by asynchronous label propagation in a seeded order, ties to the least label.

    Components can't influence each other, so each is swept alone, in the global order.
    """
    labels = component_labels(nodes, edges)
    members = edges.join(labels.withColumnRenamed("rid", "a"), "a").select("root", "a", "b")

    def sweep(pdf: pd.DataFrame) -> pd.DataFrame:
        import hashlib

        near: dict[int, list[int]] = {}
        for a, b in zip(pdf["a"].tolist(), pdf["b"].tolist(), strict=True):
            near.setdefault(a, []).append(b)
            near.setdefault(b, []).append(a)
        label = {v: v for v in near}
        order = sorted(near, key=lambda v: (hashlib.md5(f"{seed}:{v}".encode()).hexdigest(), v))
        for _ in range(sweeps):
            moved = False
            for v in order:
                votes: dict[int, int] = {}
                for u in near[v]:
                    votes[label[u]] = votes.get(label[u], 0) + 1
                best = min(votes, key=lambda x: (-votes[x], x))
                moved |= best != label[v]
                label[v] = best
            if not moved:
                break
        least: dict[int, int] = {}
        for v, x in label.items():
            least[x] = min(least.get(x, v), v)
        return pd.DataFrame({"rid": list(label), "root": [least[x] for x in label.values()]})

    found = members.groupBy("root").applyInPandas(sweep, "rid long, root long")
    return nodes.select("rid").join(found, "rid", "left").select("rid", F.coalesce("root", "rid").alias("root"))
