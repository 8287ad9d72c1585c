"""Attribution: which lines of a document an answer rests on, and which documents matter."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions import text as T
from marlstone.operators.text_jobs import explode_lines, normalize_html_tables

HITS_PER_DOCUMENT = 3
MAX_SOURCES, RATIO = 8, 0.5


def fence_state(lines: DataFrame) -> DataFrame:
    """lines(path, line, body) with marker (the line is a code fence) and fenced (it lies inside one)."""
    marked = lines.withColumn("_s", T.strip("body")).withColumn("marker", F.substring("_s", 1, 3).isin("```", "~~~"))
    w = Window.partitionBy("path").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.col("marker").cast("int")).over(w), F.lit(0))
    return marked.withColumn("fenced", before % 2 == 1)


def locate_hits(docs: DataFrame, wanted: DataFrame, limit: int = HITS_PER_DOCUMENT) -> DataFrame:
    """query_id, path, line, snippet: for each wanted(query_id, path, needles) the best lines of docs(path, content).

    Lines score by the number of needles they hold; fences are skipped, and titles outside fences.
    """
    return _hits(docs.join(wanted.select("path").distinct(), "path", "left_semi"), wanted, limit)


def _hits(docs: DataFrame, wanted: DataFrame, limit: int = HITS_PER_DOCUMENT) -> DataFrame:
    """locate_hits of docs that are wanted. Lines are dealt by path once; what is sorted has a line's snippet and not the needles of its query."""
    lines = fence_state(explode_lines(docs))
    body = lines.where(~F.col("marker") & (F.col("_s") != "") & (F.col("fenced") | ~T.is_title_line(F.col("_s")))).select("path", "line", "body")
    scored = body.join(wanted, "path").withColumn("score", F.size(F.filter("needles", lambda n: F.contains(F.col("body"), n)))).where("score > 0")
    shown = scored.select("query_id", "path", "line", "score", T.line_snippet(F.col("body"), F.col("needles")).alias("snippet"))
    w = Window.partitionBy("query_id", "path").orderBy(F.desc("score"), "line")
    return shown.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= limit).select("query_id", "path", "line", "snippet")


def resolve_citations(paths: DataFrame, docs: DataFrame) -> DataFrame:
    """paths with title and content; an unknown path stays, its stem being the title."""
    return paths.join(docs.select("path", "title", "content"), "path", "left").withColumn(
        "title", F.when(F.coalesce("title", F.lit("")) == "", T.stem("path")).otherwise(F.col("title")))


def locate_sources(paths: DataFrame, docs: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, path, title, hits (line and snippet, by line) for paths(query_id, path): every row stays, with or without hits."""
    own = docs.join(paths.select("path").distinct(), "path", "left_semi")
    known = resolve_citations(paths, own)
    wanted = paths.join(queries.select("query_id", T.needles("text").alias("needles")), "query_id").where(F.size("needles") > 0)
    shown = own.select("path", normalize_html_tables("content").alias("content"))
    hits = _hits(shown, wanted).groupBy("query_id", "path").agg(F.sort_array(F.collect_list(F.struct("line", "snippet"))).alias("hits"))
    empty = F.array().cast("array<struct<line:int,snippet:string>>")
    return known.join(hits, ["query_id", "path"], "left").select("query_id", "path", "title", F.coalesce("hits", empty).alias("hits"))


def evidence(steps: DataFrame) -> DataFrame:
    """trace_id, path, hits, strong, read, first_seen from steps(trace_id, seq, tool, path, matched_by)."""
    return steps.where("path is not null").groupBy("trace_id", "path").agg(
        F.count("*").alias("hits"), F.bool_or(F.coalesce(F.col("matched_by") == "fts", F.lit(False))).alias("strong"),
        F.bool_or(F.col("tool") == "read").alias("read"), F.min("seq").alias("first_seen"))


def rank_sources(found: DataFrame, most: int = MAX_SOURCES, ratio: float = RATIO) -> DataFrame:
    """found with score and rank: read counts 3, strong 2, hits up to 3; what is below a share of the trace's best goes."""
    score = 3 * F.col("read").cast("int") + 2 * F.col("strong").cast("int") + F.least(F.col("hits"), F.lit(3))
    best = F.max("score").over(Window.partitionBy("trace_id"))
    w = Window.partitionBy("trace_id").orderBy(F.desc("score"), "first_seen", "path")
    return found.withColumn("score", score).withColumn("_b", best).where(F.col("score") >= ratio * F.col("_b")).withColumn(
        "rank", F.row_number().over(w)).where(F.col("rank") <= most).drop("_b")
