"""Connected components by alternating large-star and small-star (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Edges to a task where a round reads them; few edges in many partitions would be mostly overhead.
EDGES_PER_TASK = 4_000


def _mins(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Links every larger neighbour of a node to the least of its neighbourhood; one row for each edge, so repeats may stay."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    near = both.join(_mins(both), "u").where("v > u")
    return near.select(F.col("v").alias("u"), F.least("u", "m").alias("v")).where("u <> v")


def _small_star(edges: DataFrame) -> DataFrame:
    """Links every smaller neighbour of a node, and the node, to the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v")
    mins = _mins(down)
    out = down.join(mins, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return out.unionByName(mins.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of links (u long, v long); root is the least node of its component.

    Both steps group by a node with map-side minima and join back, so no neighbour list is ever
    collected.  Each round is checkpointed.  It ends when a round changes nothing: then every
    edge leads from a node to its root.  No links give an empty result; self-links are ignored.
    """
    edges = cut(links.select("u", "v").where("u <> v"))

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    now = state(edges)
    while now[0]:
        edges = cut(_small_star(_large_star(edges.coalesce(max(1, -(-now[0] // EDGES_PER_TASK))))))
        before, now = now, state(edges)
        if now == before:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
