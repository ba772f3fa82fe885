"""Connected components by DataFrame operations alone, used by operators 6 and 9."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import passing, written

#: Rounds after which a run is given up; their number grows with the logarithm of a component's width.
MAX_ROUNDS = 60


def connected_components(edges: DataFrame) -> DataFrame:
    """edges (src, dst) of any ordered type -> (node, component): component is the smallest node reachable.

    Alternating large and small stars: every node hands its larger, then its smaller neighbours to
    the smallest node it sees, until all edges point at the smallest node of their component. Stars
    keep as many edges as nodes, so a giant component stays linear; minima are pre-aggregated, and
    both sides of each join are tables, so that a hub's rows are split (or the small side broadcast).
    Nodes without an edge do not appear; null ends and loops are left out. The result is a table.
    """
    with passing(edges.sparkSession):
        return _components(edges)


def _components(edges: DataFrame) -> DataFrame:
    now = _kept(edges.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).where("src is not null and dst is not null and src <> dst"))
    for _ in range(MAX_ROUNDS):
        if _settled(now):
            break
        least = written(now.select("u", "v").union(now.select("v", "u")).groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("v"), F.least("u", "m").alias("m")), "least")
        # an edge gives one edge: what repeats is dropped once, at the end of the round
        large = written(now.join(least, "v").select("u", F.col("m").alias("v")).where("u <> v"), "large-star")
        least = written(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        now = _kept(large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", "m")))
    else:
        raise RuntimeError(f"components are not settled after {MAX_ROUNDS} rounds")
    return written(now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select("v", "v").distinct()), "components", outlive=True)


def _kept(edges: DataFrame) -> DataFrame:
    return written(edges.distinct(), "edges")


def _settled(edges: DataFrame) -> bool:
    """Whether the edges (u > v) are stars around their smallest nodes: every u has one v, and no v has any."""
    n, ends = edges.groupBy("u").agg(F.count("*").alias("n")).agg(F.sum("n"), F.count("*")).first()
    return (n or 0) == ends and edges.join(edges.select(F.col("u").alias("v")), "v", "left_semi").isEmpty()
