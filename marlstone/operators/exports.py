"""Trees of nodes and their export."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.session import shared_dir


def manifest_diff(nodes: DataFrame, manifest: DataFrame) -> DataFrame:
    """token and change (new, updated, unchanged, disappeared) of nodes(token, hash) against manifest(token, hash, output_exists)."""
    n, m = nodes.select("token", F.col("hash").alias("_new")), manifest.select("token", F.col("hash").alias("_old"), "output_exists")
    change = F.when(F.col("_old").isNull(), "new").when(F.col("_new").isNull(), "disappeared").when(
        (F.col("_new") != F.col("_old")) | ~F.col("output_exists"), "updated").otherwise("unchanged")
    return n.join(m, "token", "full").select("token", change.alias("change"))


def tree_top_segment(nodes: DataFrame, root: str) -> DataFrame:
    """token, title and top of nodes(token, parent, title): the title of the ancestor right below root, the node's own if it is that one.

    Every node jumps to its ancestor, then to that one's, and so on: each round doubles the distance, so that a tree of depth n takes
    log2(n) joins. Nodes that do not hang below root (below no node, or in a cycle) are left out.
    """
    spark = nodes.sparkSession

    def kept(rows: DataFrame) -> DataFrame:
        path = shared_dir(spark)
        rows.write.parquet(path)
        return spark.read.schema(rows.schema).parquet(path)

    # at: the ancestor that a node has reached; done: that one is right below root. What jumps to no node hangs elsewhere and goes.
    jumps = kept(nodes.select("token", F.when(F.col("parent") == root, F.col("token")).otherwise(F.col("parent")).alias("at"), F.coalesce(F.col("parent") == root, F.lit(False)).alias("done")))
    steps, left = 1, jumps.where("not done").count()
    while left and steps < jumps.count():
        ahead = jumps.select(F.col("token").alias("at"), F.col("at").alias("_to"), F.col("done").alias("_done"))
        moved = jumps.where("not done").join(ahead, "at").select("token", F.col("_to").alias("at"), F.col("_done").alias("done"))
        jumps = kept(jumps.where("done").unionByName(moved))
        # whoever is still on the way after as many steps as there are nodes goes round in a cycle
        steps, left = 2 * steps, jumps.where("not done").count()
    tops = nodes.where(F.col("parent") == root).select(F.col("token").alias("at"), F.col("title").alias("top"))
    return jumps.where("done").join(tops, "at").join(nodes.select("token", "title"), "token").select("token", "title", "top")


def export_report(diff: DataFrame, failed: DataFrame, skipped: DataFrame, nodes: DataFrame | None = None, trace: DataFrame | None = None, kind: str = "docx") -> DataFrame:
    """action and n: changes, failures and skipped nodes.

    nodes(type, images) add what was scanned, how many are documents (of the kind that is exported), the images of those, and the others by
    type; trace(action) adds what was done, by action.
    """
    rows = diff.groupBy(F.col("change").alias("action")).agg(F.count("*").alias("n"))
    rows = rows.union(failed.agg(F.count("*").alias("n")).select(F.lit("failed").alias("action"), "n")).union(
        skipped.agg(F.count("*").alias("n")).select(F.lit("skipped").alias("action"), "n"))
    if nodes is not None:
        mine = F.coalesce(F.col("type") == kind, F.lit(False))
        totals = nodes.agg(F.count("*").alias("scanned"), F.count_if(mine).alias("docs"), F.coalesce(F.sum(F.when(mine, F.col("images"))), F.lit(0)).alias("images"))
        rows = rows.union(totals.unpivot([], ["scanned", "docs", "images"], "action", "n")).union(
            nodes.where(~mine).groupBy(F.concat(F.lit("skipped "), F.coalesce("type", F.lit(""))).alias("action")).agg(F.count("*").alias("n")))
    if trace is not None:
        rows = rows.union(trace.groupBy(F.concat(F.lit("did "), "action").alias("action")).agg(F.count("*").alias("n")))
    return rows
