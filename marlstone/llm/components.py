"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import materialize

SALTS = 16


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """Hang the neighbours of each node under the least of them: all larger ones (large star) or the node itself
    with its smaller ones (small star)."""
    both = edges if small else edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
    # the edges of a node with very many are dealt over SALTS tasks
    salted = both.withColumn("_s", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int"))
    joined = salted.join(least.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["u", "_s"])
    if small:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    else:
        out = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return out.where("u <> v").distinct() if small else out


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node and root (the least node that it reaches) for every node of a link; a node linked only with itself is left out."""
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    while not edges.isEmpty():
        edges = materialize(_star(_star(edges, small=False), small=True), "edges", few=True)
        # done once every node hangs under one that hangs under none
        heads = edges.groupBy("u").agg(F.count("*").alias("n"))
        if edges.join(heads.select(F.col("u").alias("v")), "v", "left_semi").isEmpty() and heads.where("n > 1").isEmpty():
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select("v", "v").distinct())
