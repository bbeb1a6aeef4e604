"""Connected components of a distributed edge list by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressmill.llm.common import forget, written


def _stars(edges: DataFrame, larger_only: bool) -> DataFrame:
    """Large-star links the larger neighbours of every node to its least neighbour (itself included); small-star links
    the smaller neighbours and the node itself to the least of them. `edges` has u > v."""
    both = edges if not larger_only else edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    near = both.join(least, "u")
    if larger_only:
        return near.where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
    return near.where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.withColumnRenamed("m", "v")).distinct()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component): every id that occurs in a link, with the smallest id it is connected to.

    Links to oneself and repeated links do not matter; a link with a null end is ignored; no links, no rows. The working
    edge list never grows beyond the links, and each round goes through a written table, so lineage stays short."""
    u, v = F.col(a), F.col(b)
    edges = written(links.where(u != v).select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).distinct(), "cc")
    seen = None
    while True:
        step = written(_stars(_stars(edges, True), False), "cc")
        print_ = step.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        forget(edges)
        edges = step
        if tuple(print_) == seen:
            break
        seen = tuple(print_)
    centres = edges.select(F.col("v").alias("id")).distinct().withColumn("component", F.col("id"))
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(centres)
