"""Connected components of an undirected graph, held in DataFrames only.

Alternates two steps (Kiveris et al., "Connected Components in MapReduce and Beyond", 2014): in the
large star every node links its larger neighbours to its smallest, in the small star its smaller
ones. Minima are combined before they are dealt out, so a hub's neighbours are never gathered in a
task; each round's links are a written table, so lineage stays short and a lost executor costs a read.
The rounds end when the links no longer change: then every node links to its smallest. Their number
grows with the logarithm of the longest path."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliograph.llm.common import written


def _star(links: DataFrame, larger: bool) -> DataFrame:
    """links: (u, v) with u > v. Every node tells its chosen neighbours of its smallest one."""
    around = links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v"))) if larger else links
    least = around.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
    near = around.join(least, "u")
    if larger:
        told = near.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        told = near.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("x")).select("x.u", "x.v")
    return told.where("u <> v").distinct()


def components(edges: DataFrame, a: str, b: str, name: str = "components", most_rounds: int = 60) -> DataFrame:
    """node and component (its smallest reachable node) for every node of an edge. Null ends and loops are ignored."""
    links = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull()).where("u <> v").distinct()
    links = written(links, name)
    mark = _mark(links)
    for _ in range(most_rounds):
        if not mark[0]:
            break
        links = written(_star(_star(links, True), False), name)
        before, mark = mark, _mark(links)
        if mark == before:
            break
    else:
        raise RuntimeError(f"the components of {name} did not settle in {most_rounds} rounds")
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _mark(links: DataFrame) -> tuple:
    """Number and checksum of the links: equal marks mean equal links."""
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.bit_xor(F.xxhash64("v", "u"))).first())
