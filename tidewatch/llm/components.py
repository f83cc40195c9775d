"""Connected components of an edge table, by alternating star contractions.

Each round hangs every node below the smallest node it knows of; the rounds end when nothing
moves. The edges stay a table in the shared folder: none of them reach the driver, and a
node with very many edges is spread over salted keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import discard, stored

SALTS = 32


def _salted_join(edges: DataFrame, least: DataFrame) -> DataFrame:
    """edges (u, v) with the new parent m of each u; u may hold any share of the edges."""
    left = edges.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)))
    right = least.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).withColumn("salt", F.col("salt").cast("long"))
    return left.join(right, ["u", "salt"]).select("u", "v", "m")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    # a node that is its neighbourhood's smallest keeps its larger neighbours as they are
    moved = _salted_join(both.where("v > u"), least.where("m < u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    roots = least.where("m = u").select("u")
    kept = _salted_join(both.where("v > u"), roots.withColumn("m", F.col("u"))).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(kept).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b: comparable, not null) -> (node, root) for every node that has an edge to
    another and isn't its component's smallest node. An empty table gives an empty one."""
    now = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    state = _state(now)
    while state[0]:
        wide = stored(_large_star(now), "large")
        then = stored(_small_star(wide), "small")
        discard(wide)
        discard(now)
        now, before, state = then, state, _state(then)
        if state == before:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
