"""Usage traces: folding events, signals, summaries and roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlstone.sources import parts as P


def fold_traces(events: DataFrame) -> DataFrame:
    """One row for each trace of events(trace_id, member, seq, ts, type, path, query, zero_hit, content, citations).

    Steps in order of seq; search steps give retrieved paths (distinct, in order) and zero-hit queries; the last answer
    gives citations; the signals compare the two.
    """
    e = events.where("type <> 'notice'")
    step = F.struct("seq", "type", "path", "query", "zero_hit")
    folded = e.groupBy("trace_id").agg(
        F.min("member").alias("member"), F.min("ts").alias("ts"),
        F.sort_array(F.collect_list(F.when(F.col("type").isin("search", "read"), step))).alias("steps"),
        F.max_by("content", F.when(F.col("type") == "answer", F.col("seq"))).alias("answer"),
        F.max_by("citations", F.when(F.col("type") == "answer", F.col("seq"))).alias("_cited"),
        F.bool_or(F.col("type") == "error").alias("failed"))
    return with_signals(folded)


def with_signals(folded: DataFrame) -> DataFrame:
    search = F.filter("steps", lambda s: s["type"] == "search")
    hit = F.filter(search, lambda s: ~s["zero_hit"] & s["path"].isNotNull())
    none = F.filter(search, lambda s: s["zero_hit"] | s["path"].isNull())
    out = folded.withColumns({
        "retrieved": F.array_distinct(F.transform(hit, lambda s: s["path"])),
        "zero_hit_queries": F.transform(none, lambda s: s["query"]),
        "citations": F.array_distinct(F.coalesce("_cited", F.array().cast("array<string>")))})
    return out.drop("_cited").withColumns({
        "cited_not_retrieved": F.array_except("citations", "retrieved"),
        "retrieved_but_unused": F.slice(F.array_except("retrieved", "citations"), 1, 10),
        "answer_chars": F.length(F.coalesce("answer", F.lit(""))),
        "no_hit_answer": (F.coalesce("answer", F.lit("")) != "") & (F.size("citations") == 0)})


def _metrics() -> list[Column]:
    n = F.count("*")
    return [
        n.alias("traces"), F.count_if(F.size("zero_hit_queries") > 0).alias("zero_hit_traces"),
        F.round(F.count_if(F.size("zero_hit_queries") > 0) / n, 4).alias("zero_hit_rate"), F.round(F.count_if(F.size("citations") > 0) / n, 4).alias("citation_rate"),
        F.sum(F.size("cited_not_retrieved")).alias("cited_not_retrieved"), F.round(F.avg(F.size("steps")), 2).alias("avg_steps")]


def usage_summary(traces: DataFrame) -> DataFrame:
    return traces.agg(*_metrics())


def top_zero_hit_queries(traces: DataFrame, n: int = 10) -> DataFrame:
    """query and count of the most frequent queries without hits; ties by query."""
    return traces.select(F.explode("zero_hit_queries").alias("query")).where("query <> ''").groupBy("query").agg(F.count("*").alias("count")).orderBy(F.desc("count"), "query").limit(n)


def usage_rollup(traces: DataFrame, questions: int = 20) -> DataFrame:
    """month, day, member, the metrics and the first questions of each day and member."""
    day = F.date_format("ts", "yyyy-MM-dd")
    dated = traces.withColumn("day", day)
    place = F.row_number().over(Window.partitionBy("day", "member").orderBy("ts", "trace_id"))
    asked = dated.where(F.coalesce("question", F.lit("")) != "").select("day", "member", "ts", "trace_id", "question", place.alias("_p")).where(F.col("_p") <= questions)
    first = asked.groupBy("day", "member").agg(F.transform(F.sort_array(F.collect_list(F.struct("_p", "question"))), lambda x: x["question"]).alias("questions"))
    return dated.groupBy("day", "member").agg(*_metrics()).join(first, ["day", "member"], "left").withColumns({
        "questions": F.coalesce("questions", F.array().cast("array<string>")), "month": F.substring("day", 1, 7)})


ROLLUP = """member long, traces long, zero_hit_traces long, zero_hit_rate double, citation_rate double, cited_not_retrieved long, avg_steps double,
  questions array<string>, day string"""


def filed_rollups(spark: SparkSession, path: str) -> DataFrame:
    """The roll-ups that file_rollups keeps."""
    return P.read_parts(spark, path, ROLLUP).withColumn("month", F.substring("day", 1, 7))


def file_rollups(traces: DataFrame, path: str, run: str, keep: int = 12) -> list[str]:
    """Roll up the traces and file the days by month; the months that were written.

    The days of the traces, which are all traces of those days, stand for what was filed of them, and other days stay. Months
    without a change are not written, so a repeated run leaves files and rows alike; only the newest `keep` months stay.
    """
    spark = traces.sparkSession
    new = usage_rollup(traces).select("month", *(f.split()[0] for f in ROLLUP.split(","))).persist()
    months = sorted(r[0] for r in new.select("month").distinct().collect())  # one for each month of the traces
    filed = P.current(spark, path)["parts"]
    stay = sorted({*filed, *months})[-keep:] if keep else []
    old = P.read_parts(spark, path, ROLLUP, months).withColumn("month", F.substring("day", 1, 7)).select(new.columns)
    now = old.join(new.select("day").distinct(), "day", "left_anti").select(new.columns).unionByName(new)
    print_of = lambda df: {r[0]: r[1:] for r in df.groupBy("month").agg(F.count("*"), F.sum(F.xxhash64(*new.columns).cast("decimal(38,0)"))).collect()}
    before, after = print_of(old), print_of(now)
    changed = [m for m in months if m in stay and before.get(m) != after.get(m)]
    gone = [m for m in filed if m not in stay]
    written = P.replace_parts(now.where(F.col("month").isin(changed)), path, run, "month", [*changed, *gone]) if changed or gone else []
    new.unpersist()
    return written


def last_days(traces: DataFrame, n: int) -> DataFrame:
    """The traces of the last n days that have any."""
    day = F.to_date("ts")
    days = traces.select(day.alias("_d")).distinct().orderBy(F.desc("_d")).limit(n)
    return traces.withColumn("_d", day).join(days, "_d", "left_semi").drop("_d")


def question_candidates(traces: DataFrame, limit: int = 20) -> DataFrame:
    """question, ts and reasons: distinct questions with a search without hits or an answer without citations, the first ones."""
    reasons = F.array_compact(F.array(F.when(F.size("zero_hit_queries") > 0, "zero_hit"), F.when(F.col("no_hit_answer"), "uncited_answer")))
    bad = traces.where("question <> ''").withColumn("reasons", reasons).where(F.size("reasons") > 0)
    w = Window.partitionBy("question").orderBy("ts", "trace_id")
    return bad.withColumn("_r", F.row_number().over(w)).where("_r = 1").orderBy("ts", "trace_id").limit(limit).select("question", "ts", "trace_id", "reasons")
