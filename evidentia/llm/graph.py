"""Connected components by alternating large-star and small-star steps."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Scratch, look_up

#: Large-star and small-star rounds need few more than the logarithm of a component's diameter.
ROUNDS = 1000


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component) of every node that has an edge; component is the smallest node reachable.

    ``edges`` has two columns of long, a and b, in either direction; nulls and loops
    count for nothing. Each round joins the edges with the least neighbour of their end;
    ends with a large share of all edges are looked up apart, so that the hub of a large component
    is no task's alone. Each half of a round is written to the shared folder: plans and lineage stay short and a lost
    executor costs half a round. Only a count and a checksum of the edges reach the driver.
    """
    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct()
    edges, name = scratch.keep(edges, "edges-0"), "edges-0"
    mark = _mark(edges)
    for k in range(1, ROUNDS):
        if not mark[0]:
            break
        ways = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = ways.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")).select("a", F.least("a", "m").alias("m"), "n")
        met = look_up(ways, least, ["a"], "n", 2 * mark[0], "b")
        large = scratch.keep(met.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), f"large-{k}")
        least = large.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n"))
        met = look_up(large, least, ["a"], "n", 2 * mark[0], "b")
        small = met.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(met.select("a", F.col("m").alias("b")))
        edges = scratch.keep(small.where("a > b").distinct(), f"edges-{k}")
        scratch.drop(name)
        scratch.drop(f"large-{k}")
        name, before, mark = f"edges-{k}", mark, _mark(edges)
        if mark == before:
            break
    else:
        raise RuntimeError(f"components are not found after {ROUNDS} rounds")
    ends = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return ends.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
