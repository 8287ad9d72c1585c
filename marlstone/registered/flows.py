"""Queries over sinks, sources and streams: derived rows are written to the shared folder and read again."""

from __future__ import annotations

from pyspark.sql import functions as F

from marlstone.operators import state as S
from marlstone.operators import text_jobs as J
from marlstone.operators import usage as U
from marlstone.plans import views as V
from marlstone.registered.base import Registry
from marlstone.registered.logs import FOLDED_SQL, ROLLUP_SQL, events, folded_columns
from marlstone.session import shared_dir
from marlstone.sources import files as I
from marlstone.streaming import streams as W

#: Cases in an object of the question set and documents in a file of texts, at most or about.
CASES, TEXTS = 1000, 1000

query = Registry()
QUERIES, ORACLES = query.queries, query.oracles


@query("jsonl_log", "select seq, member, result, strftime(started_at, '%Y-%m-%d') as day from v_runs", "v_runs")
def jsonl(spark, d):
    """A2, A3: an appended log with broken lines among its rows."""
    out = shared_dir(spark)
    rows = V.runs(spark, d).select("seq", "member", "result", F.date_format("started_at", "yyyy-MM-dd").alias("day"))
    I.append_jsonl(rows.where("seq % 2 = 0"), out)
    I.append_jsonl(rows.where("seq % 2 = 1"), out)
    V.table(spark, d, "region").select(F.concat(F.lit('{"seq": '), "r_name").alias("value")).write.mode("append").text(out)
    return I.read_jsonl(spark, out, "seq long, member long, result string, day string")


@query("registry_rewrite", "select false as wrote_again, count(*) as n from v_conversions", "v_conversions")
def registry(spark, d):
    """A4: a second write of equal rows does nothing."""
    out = shared_dir(spark)
    rows = S.source_registry(V.conversions(spark, d), V.scan_2(spark, d))
    I.write_registry(rows, out, ["relative_path"])
    again = I.write_registry(rows.repartition(3), out, ["relative_path"])
    return spark.read.schema(rows.schema).json(out).agg(F.lit(again).alias("wrote_again"), F.count("*").alias("n"))


@query("published_snapshots", "select day as published_at, count(*) as n from (select unnest(['2024-01-02', '2024-01-03']) as day), v_scan_1 where day <> '2024-01-02' or doc_id % 2 = 0 group by day", "v_scan_1")
def snapshots(spark, d):
    """A5: three snapshots, of which the newest two stay."""
    out = shared_dir(spark)
    scan = V.scan_1(spark, d)
    for day, df in (("2024-01-01", scan.where("doc_id % 3 = 0")), ("2024-01-02", scan.where("doc_id % 2 = 0")), ("2024-01-03", scan)):
        I.publish_snapshot(df, out, day, keep=2)
    return spark.read.parquet(f"{out}/history").groupBy(F.col("published_at").cast("string").alias("published_at")).agg(F.count("*").alias("n"))


def _per_batch(spark, folder: str) -> int:
    """Files in a batch of a folder that is drained: 8, and more of more than 256, so that batches grow with the files and not their number."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return max(8, -(-files.select("path").count() // 32))


def _blocks(df, each: int):
    """A column that deals the rows of df evenly over blocks of about `each` rows, by their place and not by a key."""
    return F.pmod(F.monotonically_increasing_id(), F.lit(max(1, -(-df.count() // each))))


@query("question_set", "select item_id::varchar as id, text as question, 1::int as n_expected from benchmark")
def questions(spark, d):
    """Nested question objects made of the benchmark, each of a bounded number of cases."""
    out = shared_dir(spark)
    case = F.struct(F.col("item_id").cast("string").alias("id"), F.col("text").alias("question"), F.array(F.lit("members/a.md")).alias("expected_paths"))
    items = V.table(spark, d, "benchmark")
    items.select(case.alias("case"), _blocks(items, CASES).alias("b")).groupBy("b").agg(F.collect_list("case").alias("cases")).select("cases").write.json(out)
    return I.load_question_set(spark, out, lines=True).select("id", "question", F.size("expected_paths").alias("n_expected"))


@query("decode_text", "select doc_id::varchar as path, case when doc_id % 5 = 0 then null when doc_id % 5 = 2 then text || ' 仓库é' else text end as text, case when doc_id % 5 = 0 then 'binary' end as error from documents")
def decode(spark, d):
    """UTF-8 with and without a mark, NUL bytes, and GB18030."""
    n = F.col("doc_id")
    raw = F.when(n % 5 == 0, F.concat(F.col("text"), F.lit("\x00"))).when(n % 5 == 1, F.concat(F.lit("﻿"), "text")).otherwise(F.col("text"))
    other = F.pandas_udf(lambda t: t.map(lambda x: (x + " 仓库é").encode("gb18030"), na_action="ignore"), "binary")
    content = F.when(n % 5 == 2, other(F.when(n % 5 == 2, F.col("text")))).otherwise(raw.cast("binary"))
    return I.decode_text_corpus(V.table(spark, d, "documents").select(n.cast("string").alias("path"), content.alias("content")))


@query("custom_converter", "select doc_id::varchar as path, case when doc_id % 7 = 0 then null else '# ' || doc_id || chr(10) || text end as content, case when doc_id % 7 = 0 then 'ValueError: unreadable' end as error from documents")
def converter(spark, d):
    """A user's function from bytes to Markdown, with its failures."""

    def convert(path: str, raw: bytes) -> str:
        if int(path) % 7 == 0:
            raise ValueError("unreadable")
        return f"# {path}\n{raw.decode()}"

    return J.convert_with(V.table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("path"), F.col("text").cast("binary").alias("content")), convert)


def _drain(stream, out: str, spark):
    q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def _replay(spark, df, files: int = 4):
    """df as a stream over files in the shared folder."""
    out = shared_dir(spark)
    df.repartitionByRange(files, "ts").sortWithinPartitions("ts").write.parquet(out)
    return spark.readStream.schema(df.schema).parquet(out)


@query("stream_sessions", """with m as (select event_id as message_id, user_id as session_id, ts from events),
g as (select *, case when ts < lag(ts) over w + interval 30 minute then 0 else 1 end as fresh from m window w as (partition by session_id order by ts, message_id)),
s as (select *, sum(fresh) over (partition by session_id order by ts, message_id) as burst from g)
select session_id, min(ts) as opened, max(ts) + interval 30 minute as closed, count(*) as n from s group by session_id, burst""")
def sessions(spark, d):
    """T4: bursts of messages by the stream; those that its watermark has not closed at the end by the batch twin."""
    m = V.table(spark, d, "events").select(F.col("event_id").alias("message_id"), F.col("user_id").alias("session_id"), F.col("ts").cast("timestamp").alias("ts"))
    last = m.agg((F.max("ts") - F.expr("interval 1 hour")).alias("last"))
    done = _drain(W.stream_sessions(_replay(spark, m)), shared_dir(spark), spark).crossJoin(F.broadcast(last)).where("closed <= last")  # one row
    s = done.union(W.session_bursts(m).crossJoin(F.broadcast(last)).where("closed > last"))
    return s.select("session_id", F.col("opened").cast("timestamp_ntz").alias("opened"), F.col("closed").cast("timestamp_ntz").alias("closed"), "n")


@query("stream_session_heads", r"""select session_id, timestamp '2024-01-01 00:00:00' + to_seconds(max(message_id)) as updated_at,
  coalesce(nullif(substring(trim(regexp_replace(coalesce(min_by(content, message_id) filter (kind = 'user'), ''), '[ \t\n\r\x0B\f]+', ' ', 'g'), ' '), 1, 20), ''), 'New session') as title
from v_messages group by session_id""", "v_messages")
def heads(spark, d):
    """T4: title and last update of each session, merged into a table in buckets as its messages arrive in shuffled files."""
    out, state = shared_dir(spark), shared_dir(spark)
    m = V.messages(spark, d).withColumn("ts", F.timestamp_seconds(F.lit(1_704_067_200) + F.col("message_id")))
    m.repartition(4, F.xxhash64("message_id")).write.parquet(out)
    stream = spark.readStream.schema(m.schema).option("maxFilesPerTrigger", 2).parquet(out)
    stream.writeStream.foreachBatch(W.sessions_into(spark, state)).option("checkpointLocation", f"{state}-checkpoint").trigger(availableNow=True).start().awaitTermination()
    return W.sessions_of(spark, state).select("session_id", F.col("updated_at").cast("timestamp_ntz").alias("updated_at"), "title")


@query("stream_usage_days", """select cast(ts as date) as day, member, count(*) as traces, count(*) filter (zero_hit) as zero_hit_traces, count(*) filter (seq % 3 = 0) as cited from v_trace_events group by 1, 2""", "v_trace_events")
def usage_days(spark, d):
    """Daily counters kept by a stream; days that its watermark has not closed at the end are counted in a batch."""
    t = V.trace_events(spark, d).select(F.col("ts").cast("timestamp").alias("ts"), "member", F.col("zero_hit").cast("int").alias("n_zero"), (F.col("seq") % 3 == 0).cast("int").alias("n_citations"))
    last = t.agg(F.to_date(F.max("ts") - F.expr("interval 1 day")).alias("last"))
    done = _drain(W.stream_usage(_replay(spark, t)), shared_dir(spark), spark).crossJoin(F.broadcast(last)).where("day < last")  # one row
    return done.union(W.usage_days(t).crossJoin(F.broadcast(last)).where("day >= last")).drop("last")


@query("stream_traces", FOLDED_SQL, "v_trace_events")
def traces(spark, d):
    """Traces folded by a stateful stream whose files are shuffled in time; those that its watermark has not closed at the end by the batch fold."""
    e = events(spark, d).select("trace_id", "member", "seq", F.col("ts").cast("timestamp").alias("ts"), "type", "path", "citations", "content", "query", "zero_hit")
    out = shared_dir(spark)
    e.repartition(F.xxhash64("seq")).write.parquet(out)
    # the events of a trace lie within a day; a second apart from the watermark, so that its rounding never decides
    last = e.agg((F.max("ts") - F.expr("interval 2 days 1 second")).alias("last"))
    done = _drain(W.stream_traces(spark.readStream.schema(e.schema).parquet(out), "1 day"), shared_dir(spark), spark).crossJoin(F.broadcast(last)).where("ended_at < last")  # one row
    open_ = e.groupBy("trace_id").agg(F.max("ts").alias("_t")).crossJoin(F.broadcast(last)).where("_t >= last").select("trace_id")
    rest = U.fold_traces(e.join(open_, "trace_id", "left_semi")).withColumns({"n_steps": F.size("steps").cast("long"), "n_zero": F.size("zero_hit_queries").cast("long")})
    return folded_columns(done).union(folded_columns(rest))


@query("filed_rollups", ROLLUP_SQL, "v_trace_events")
def filed(spark, d):
    """Roll-ups filed by month; the traces of odd days come in a later run, and a repeated run writes nothing."""
    t = U.fold_traces(events(spark, d)).withColumn("question", F.col("trace_id"))
    out = shared_dir(spark)
    for run in ("0", "1", "1-again"):
        U.file_rollups(t.where(F.dayofmonth("ts") % 2 == int(run[0])), out, run, keep=1200)
    return U.filed_rollups(spark, out).withColumn("questions", F.array_join("questions", "|"))


@query("scan_sources", "select 'k=' || source as folder, sum(strlen(text) + 1)::bigint as bytes, true as supported from documents group by source")
def scan(spark, d):
    """A1: the texts of each source as files of bounded numbers of texts, scanned with their hashes."""
    out = shared_dir(spark)
    docs = V.table(spark, d, "documents")
    dealt = docs.select("text", F.col("source").alias("k"), _blocks(docs, 20 * TEXTS).alias("b")).repartition("k", "b").drop("b")
    dealt.write.partitionBy("k").format("text").option("lineSep", "\x1f").option("maxRecordsPerFile", TEXTS).save(out)
    found = I.scan_sources(spark, out).where("relative_path like 'k=%.txt'")
    return found.groupBy(F.substring_index("relative_path", "/", 1).alias("folder")).agg(F.sum("size").alias("bytes"), F.bool_and("supported").alias("supported"))


@query("stream_ingest", "select count(distinct source) as n_files, sum(strlen(text) + 1)::bigint as bytes, count(distinct source) as n_hashes from documents")
def ingest(spark, d):
    """The texts of each source as files of bounded numbers of texts, merged into a table of sources batch by batch; the files of a source count as one."""
    out, state, sink = shared_dir(spark), shared_dir(spark), shared_dir(spark)
    docs = V.table(spark, d, "documents")
    dealt = docs.select("text", F.col("source").alias("k"), _blocks(docs, 20 * TEXTS).alias("b")).repartition("k", "b").drop("b")
    dealt.write.partitionBy("k").format("text").option("lineSep", "\x1f").option("maxRecordsPerFile", TEXTS).save(out)

    W.stream_ingest(spark, out, W.merge_into(spark, sink), state, _per_batch(spark, out)).awaitTermination()
    source = F.regexp_extract("relative_path", "^k=([^/]*)/", 1)
    each = W.sources_of(spark, sink).where("status = 'discovered'").groupBy(source.alias("k")).agg(F.sum("size").alias("size"), F.sum(F.xxhash64("sha256").cast("decimal(38,0)")).alias("digest"))
    return each.agg(F.count("*").alias("n_files"), F.sum("size").alias("bytes"), F.countDistinct("digest").alias("n_hashes"))


@query("ingest_states", """with s as (select source, unicode(right(source, 1)) % 4 as u, sum(strlen(text) + 1)::bigint as bytes from documents group by source)
select 'k=' || source as folder, case u when 0 then 'source_missing' when 1 then 'converted' when 2 then 'failed' else 'discovered' end as status, bytes,
  case u when 1 then 'unchanged' when 2 then 'previous_failed' else 'new_source' end as reason from s""")
def states(spark, d):
    """Files ingested in batches with the conversions that are known, then a scan in which some sources are gone; the state and the reason of each source's files."""
    out, state, sink, due, seen, done = (shared_dir(spark) for _ in range(6))
    docs = V.table(spark, d, "documents")
    dealt = docs.select("text", F.col("source").alias("k"), _blocks(docs, 20 * TEXTS).alias("b")).repartition("k", "b").drop("b")
    dealt.write.partitionBy("k").format("text").option("lineSep", "\x1f").option("maxRecordsPerFile", TEXTS).save(out)
    source = F.regexp_extract("relative_path", "^k=([^/]*)/", 1)
    u = F.ascii(F.right(source, F.lit(1))) % 4
    I.scan_sources(spark, out).where("relative_path like 'k=%.txt'").write.parquet(seen)  # files are hashed once, not for each batch
    scan = spark.read.parquet(seen)
    scan.where(u.isin(1, 2)).select("relative_path", F.col("sha256").alias("source_sha256"), F.when(u == 1, "converted").otherwise("failed").alias("status"), F.lit(True).alias("output_exists")).write.parquet(done)
    known = spark.read.parquet(done)
    note = lambda rows, epoch: rows.write.mode("overwrite").parquet(f"{due}/epoch={epoch}")
    W.stream_ingest(spark, out, W.merge_into(spark, sink, known, note), state, _per_batch(spark, out)).awaitTermination()
    W.mark_missing_into(spark, sink, scan.where(u != 0), "1")
    why = spark.read.parquet(due).select("relative_path", "reason")
    each = W.sources_of(spark, sink).join(why, "relative_path", "left").withColumn("reason", F.coalesce("reason", F.lit("unchanged")))
    return each.groupBy(F.concat(F.lit("k="), source).alias("folder"), "status", "reason").agg(F.sum("size").alias("bytes"))
