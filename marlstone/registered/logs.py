"""Queries over traces, runs, inspection, retention, evaluation, sessions and exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from marlstone.functions import text as T
from marlstone.operators import attribution as A
from marlstone.operators import exports as X
from marlstone.operators import governance as G
from marlstone.operators import search as S
from marlstone.operators import sessions as M
from marlstone.operators import usage as U
from marlstone.plans import views as V
from marlstone.registered.base import Registry
from marlstone.registered.search import QTOK, expected, knowledge_sql, stored
from marlstone.session import shared_dir
from marlstone.sources.files import pointed_to

query = Registry()
QUERIES, ORACLES = query.queries, query.oracles


def events(spark, d):
    """Trace events with the columns that folding needs."""
    path = F.concat(F.lit("p"), F.col("doc_id").cast("string"))
    return V.trace_events(spark, d).withColumns({
        "path": F.when(F.col("type").isin("search", "read") & ~F.col("zero_hit"), path),
        "query": F.when(F.col("type") == "search", F.concat(F.lit("q"), (F.col("seq") % 7).cast("string"))),
        "content": F.when(F.col("type") == "answer", F.concat(F.lit("answer "), F.col("seq").cast("string"))),
        "citations": F.when(F.col("type") == "answer", F.when(F.col("seq") % 3 == 0, F.array().cast("array<string>")).otherwise(
            F.array(F.concat(F.lit("p"), (F.col("seq") % 40).cast("string")), F.lit("p1"))))})


def traces(spark, d):
    return U.fold_traces(events(spark, d)).withColumn("question", F.concat(F.lit("Q"), F.pmod(F.crc32(F.col("trace_id").cast("binary")), F.lit(50)).cast("string")))


_EVENTS = """ev as (select *, case when type in ('search', 'read') and not zero_hit then 'p' || doc_id end as path, case when type = 'search' then 'q' || (seq % 7) end as query,
  case when type = 'answer' then 'answer ' || seq end as content,
  case when type = 'answer' then (case when seq % 3 = 0 then []::varchar[] else ['p' || (seq % 40), 'p1'] end) end as cites from v_trace_events)"""
_TRACES = _EVENTS + """,
ans as (select trace_id, max_by(content, seq) as answer, max_by(cites, seq) as cites from ev where type = 'answer' group by trace_id),
ret as (select trace_id, path, min(seq) as s from ev where type = 'search' and path is not null group by trace_id, path),
cit as (select distinct trace_id, unnest(cites) as path from ans),
tr as (
  select e.trace_id, min(member) as member, min(ts) as ts, count(*) filter (type in ('search', 'read')) as n_steps, count(*) filter (type = 'search' and path is null) as n_zero, bool_or(type = 'error') as failed
  from ev e group by e.trace_id),
full_ as (
  select tr.*, (select count(*) from ret where ret.trace_id = tr.trace_id) as n_retrieved, (select count(*) from cit where cit.trace_id = tr.trace_id) as n_citations,
    (select count(*) from cit where cit.trace_id = tr.trace_id and path not in (select path from ret where ret.trace_id = cit.trace_id)) as n_cited_not,
    least(10, (select count(*) from ret where ret.trace_id = tr.trace_id and path not in (select path from cit where cit.trace_id = ret.trace_id))) as n_unused,
    coalesce(len(answer), 0) as answer_chars from tr left join ans using (trace_id))"""


FOLDED_SQL = f"""with {_TRACES} select trace_id, member, n_steps, n_zero, failed, n_retrieved, n_citations, n_cited_not, n_unused, answer_chars::int as answer_chars, answer_chars > 0 and n_citations = 0 as no_hit_answer,
  (select coalesce(string_agg(path, '|' order by s), '') from ret where ret.trace_id = full_.trace_id) as retrieved, (select coalesce(string_agg(path, '|' order by path), '') from cit where cit.trace_id = full_.trace_id) as citations,
  (select coalesce(string_agg(query, '|' order by seq), '') from ev where ev.trace_id = full_.trace_id and type = 'search' and path is null) as zero_hit_queries,
  (select coalesce(string_agg(path, '|' order by path), '') from cit where cit.trace_id = full_.trace_id and path not in (select path from ret where ret.trace_id = cit.trace_id)) as cited_not_retrieved from full_"""


def folded_columns(folded):
    """What the oracle of folded traces has, of traces with n_steps and n_zero."""
    n = lambda c: F.size(c).cast("long")
    return folded.select("trace_id", "member", "n_steps", "n_zero", "failed", n("retrieved").alias("n_retrieved"), n("citations").alias("n_citations"),
                         n("cited_not_retrieved").alias("n_cited_not"), n("retrieved_but_unused").alias("n_unused"), "answer_chars", "no_hit_answer",
                         F.array_join("retrieved", "|").alias("retrieved"), F.array_join(F.sort_array("citations"), "|").alias("citations"), F.array_join("zero_hit_queries", "|").alias("zero_hit_queries"),
                         F.array_join(F.sort_array("cited_not_retrieved"), "|").alias("cited_not_retrieved"))


@query("fold_traces", FOLDED_SQL, "v_trace_events")
def fold(spark, d):
    """T1 (batch), F5"""
    return folded_columns(traces(spark, d).withColumns({"n_steps": F.size("steps").cast("long"), "n_zero": F.size("zero_hit_queries").cast("long")}))


_METRICS = """count(*) as traces, count(*) filter (n_zero > 0) as zero_hit_traces, round(count(*) filter (n_zero > 0) / count(*), 4) as zero_hit_rate,
  round(count(*) filter (n_citations > 0) / count(*), 4) as citation_rate, sum(n_cited_not)::bigint as cited_not_retrieved, round(avg(n_steps), 2) as avg_steps"""


@query("usage_summary", f"with {_TRACES} select {_METRICS} from full_", "v_trace_events")
def summary(spark, d):
    """F3"""
    return U.usage_summary(traces(spark, d))


@query("top_zero_hit_queries", f"with {_EVENTS} select query, count(*) as count from ev where type = 'search' and path is null group by query order by count desc, query limit 10", "v_trace_events")
def top_zero(spark, d):
    """F3"""
    return U.top_zero_hit_queries(traces(spark, d))


ROLLUP_SQL = f"""with {_TRACES} select strftime(ts, '%Y-%m-%d') as day, strftime(ts, '%Y-%m') as month, member, {_METRICS}, array_to_string((list(trace_id order by ts, trace_id))[:20], '|') as questions from full_ group by 1, 2, 3"""


@query("usage_rollup", ROLLUP_SQL, "v_trace_events")
def rollup(spark, d):
    """F4, T2 (batch); the question of a trace is its id here."""
    return U.usage_rollup(traces(spark, d).withColumn("question", F.col("trace_id"))).withColumn("questions", F.array_join("questions", "|"))


@query("last_days", f"with {_TRACES} select trace_id from full_ where cast(ts as date) in (select distinct cast(ts as date) as x from full_ order by x desc limit 5)", "v_trace_events")
def last_days(spark, d):
    """the last days that have data"""
    return U.last_days(traces(spark, d), 5).select("trace_id")


_ERRORS = """select seq, member, result, case when result = 'failed' then 'boom ' || seq end as error from v_runs"""


def runs(spark, d):
    return V.runs(spark, d).withColumn("error", F.when(F.col("result") == "failed", F.concat(F.lit("boom "), F.col("seq").cast("string"))))


@query("evidence", """select trace_id, path, count(*) as hits, bool_or(fts) as strong, bool_or(type = 'read') as read, min(seq) as first_seen from (
  select *, 'p' || doc_id as path, type = 'search' and seq % 2 = 0 as fts from v_trace_events where type in ('search', 'read')) group by trace_id, path""", "v_trace_events")
def evidence(spark, d):
    """E13"""
    return A.evidence(steps(spark, d))


def steps(spark, d):
    e = V.trace_events(spark, d).where("type in ('search', 'read')")
    by = F.when((F.col("type") == "search") & (F.col("seq") % 2 == 0), "fts").when(F.col("type") == "search", "substring")
    return e.select("trace_id", "seq", F.col("type").alias("tool"), F.concat(F.lit("p"), F.col("doc_id").cast("string")).alias("path"), by.alias("matched_by"))


@query("rank_sources", """with e as (select trace_id, path, count(*) as hits, bool_or(fts) as strong, bool_or(type = 'read') as read, min(seq) as first_seen from (
  select *, 'p' || doc_id as path, type = 'search' and seq % 2 = 0 as fts from v_trace_events where type in ('search', 'read')) group by trace_id, path),
s as (select *, 3 * read::int + 2 * strong::int + least(hits, 3) as score from e)
select trace_id, path, score, rank from (select *, row_number() over (partition by trace_id order by score desc, first_seen, path) as rank from (select *, max(score) over (partition by trace_id) as b from s) where score >= 0.5 * b) where rank <= 8""", "v_trace_events")
def ranked(spark, d):
    """E14"""
    return A.rank_sources(A.evidence(steps(spark, d))).select("trace_id", "path", "score", "rank")


@query("question_candidates", f"""with {_TRACES}, c as (select event_count.*, 'Q' || (event_count.seq0 % 50) as question from (select f.*, (select min(seq) from ev where ev.trace_id = f.trace_id) as seq0 from full_ f) event_count),
b as (select *, n_zero > 0 as z, answer_chars > 0 and n_citations = 0 as u from c)
select question, trace_id, (z::int + u::int) as n_reasons from (select *, row_number() over (partition by question order by ts, trace_id) as r from b where z or u) where r = 1 order by ts, trace_id limit 20""", "v_trace_events")
def candidates(spark, d):
    """H13"""
    first = V.trace_events(spark, d).groupBy("trace_id").agg(F.min("seq").alias("s"))
    t = U.fold_traces(events(spark, d)).join(first, "trace_id").withColumn("question", F.concat(F.lit("Q"), (F.col("s") % 50).cast("string")))
    return U.question_candidates(t).select("question", "trace_id", F.size("reasons").alias("n_reasons"))


@query("run_health", f"""with r as ({_ERRORS}), t as (select * from r order by seq desc limit 20)
select count(*) as window, count(*) filter (result = 'ok') as ok, count(*) filter (result = 'locked') as locked, count(*) filter (result not in ('ok', 'locked')) as failed,
  max_by(result, seq) as last_result, coalesce((select error from t order by seq desc limit 1), '') as last_error,
  count(*) filter (seq > coalesce((select max(seq) from t where result = 'ok'), -1)) as streak, (count(*) filter (seq > coalesce((select max(seq) from t where result = 'ok'), -1)) >= 3)::int as blocking,
  (select least(count(*), 20) from v_runs where result = 'locked' and member % 3 = 0) as lock_recoveries from t""", "v_runs")
def health(spark, d):
    """Locks of every third member are taken over."""
    return G.run_health(runs(spark, d), 20, runs(spark, d).where("result = 'locked' and member % 3 = 0"))


@query("trailing_streak", "select member, count(*) filter (seq > coalesce(o, -1)) as streak from (select *, max(case when result = 'ok' then seq end) over (partition by member) as o from v_runs) group by member", "v_runs")
def streak(spark, d):
    """H5, for each member"""
    from pyspark.sql import Window

    ok = F.max(F.when(F.col("result") == "ok", F.col("seq"))).over(Window.partitionBy("member"))
    return V.runs(spark, d).withColumn("o", ok).groupBy("member").agg(F.count_if(F.col("o").isNull() | (F.col("seq") > F.col("o"))).alias("streak"))


@query("is_due", "select max(started_at) as last_started_at, max(started_at) <= timestamp '2024-02-01 00:00:00' - interval 1440 minute as due from v_runs", "v_runs")
def due(spark, d):
    """H6"""
    return G.is_due(G.last_started_at(V.runs(spark, d)), F.expr("timestamp'2024-02-01 00:00:00'"), 1440).select(F.col("last_started_at").cast("timestamp_ntz").alias("last_started_at"), "due")


@query("split_retention", "select seq, case when started_at < timestamp '2024-01-20 00:00:00' - interval 10 day then strftime(started_at, '%Y-%m') end as archive_month from v_runs", "v_runs")
def retention(spark, d):
    """H8"""
    return G.split_retention(V.runs(spark, d), F.expr("timestamp'2024-01-20 00:00:00'"), 10).select("seq", "archive_month")


def items(spark, d):
    return V.table(spark, d, "documents").select(
        F.when(F.col("doc_id") % 3 == 0, "log").otherwise(F.col("source")).alias("kind"), F.when(F.col("doc_id") % 17 == 0, F.concat(F.lit("latest"), F.col("doc_id").cast("string"))).otherwise(
            F.concat(F.lit("r"), F.lpad(F.col("doc_id").cast("string"), 9, "0"))).alias("name"), (F.col("n_chars") * 10000).alias("bytes"))


_ITEMS = """it as (select case when doc_id % 3 = 0 then 'log' else source end as kind, case when doc_id % 17 = 0 then 'latest' || doc_id else 'r' || lpad(doc_id::varchar, 9, '0') end as name, n_chars * 10000 as bytes from documents),
old as (select * from (select *, row_number() over (partition by kind order by name desc) as r from it where kind <> 'log' and not starts_with(lower(name), 'latest')) where r > 2)"""


@query("keep_newest", f"with {_ITEMS} select kind, name, bytes from old")
def newest(spark, d):
    """H7"""
    return G.keep_newest(items(spark, d).where("kind <> 'log'"), 2)


@query("prune_plan", f"""with {_ITEMS} select 'delete' as action, kind || '/' || name as item, bytes from old union all select 'rotate', kind || '/' || name, bytes from it where kind = 'log' and bytes > 10485760
union all select 'archive', strftime(started_at, '%Y-%m'), count(*) from v_runs where started_at < timestamp '2024-01-20 00:00:00' - interval 10 day group by 2""", "v_runs")
def prune(spark, d):
    """H9"""
    return G.prune_plan(items(spark, d), V.runs(spark, d), F.expr("timestamp'2024-01-20 00:00:00'"), keep=2, days=10)


@query("prune_applied", f"""with {_ITEMS}, act as (
  select 'delete' as action, kind || '/' || name as item from old union all select 'rotate', kind || '/' || name from it where kind = 'log' and bytes > 10485760
  union all select distinct 'archive', strftime(started_at, '%Y-%m') from v_runs where started_at < timestamp '2024-01-20 00:00:00' - interval 10 day)
select 'audit ' || action as what, count(*) as n from act group by action
union all select 'archived ' || strftime(started_at, '%Y-%m'), count(*) from v_runs where started_at < timestamp '2024-01-20 00:00:00' - interval 10 day group by 1
union all select 'runs left', count(*) from v_runs where started_at >= timestamp '2024-01-20 00:00:00' - interval 10 day
union all select 'items left', count(*) from it where kind || '/' || name not in (select kind || '/' || name from old)
union all select 'items rotated', count(*) from it where kind = 'log' and bytes > 10485760""", "v_runs")
def prune_applied(spark, d):
    """H9: the plan carried out, with its audit."""
    out = shared_dir(spark)
    G.apply_prune(items(spark, d), V.runs(spark, d), F.expr("timestamp'2024-01-20 00:00:00'"), out, "20240120", keep=2, days=10)
    mine = pointed_to(spark, out)
    told = lambda df, what: df.select(what.alias("what"), "n")
    count = lambda df, *by: df.groupBy(*by).agg(F.count("*").alias("n"))
    left = spark.read.parquet(f"{out}/items/{mine}")
    return (
        told(count(spark.read.schema("action string").json(f"{out}/audit/{mine}/plan"), "action"), F.concat(F.lit("audit "), "action"))
        .union(told(count(spark.read.parquet(f"{out}/archive/{mine}"), "archive_month"), F.concat(F.lit("archived "), F.col("archive_month").cast("string"))))
        .union(told(count(spark.read.parquet(f"{out}/runs/{mine}")), F.lit("runs left"))).union(told(count(left), F.lit("items left")))
        .union(told(count(left.where(F.endswith("name", F.lit(".1")))), F.lit("items rotated"))))


def inspected(spark, d):
    docs = V.documents(spark, d).where("doc_id % 5 <> 0")
    kind = F.when(F.col("doc_id") % 2 == 0, ".pdf").otherwise(".md")
    sample = V.documents(spark, d).select("path", "doc_id", kind.alias("file_type")).select(F.col("path").alias("relative_path"), "file_type", F.col("path").alias("output_path"))
    body = F.when(F.col("doc_id") % 7 == 0, F.lit("")).when(F.col("doc_id") % 11 == 0, F.concat(F.lit("# t\n"), "content", F.lit("�"))).otherwise(F.col("content"))
    return G.check_documents(sample, docs.select(F.col("path").alias("output_path"), F.lit("main.md").alias("name"), body.cast("binary").alias("content")))


_INSPECT = r"""chk as (select path as relative_path, ft as file_type, case when doc_id % 5 = 0 or b = '' then 0 else len(b) end as total_chars,
  case when doc_id % 5 = 0 then ['output_missing'] when b = '' then ['empty_file: main.md'] else list_filter([
    case when contains(b, chr(65533)) then 'replacement_chars: 1' end, case when len(b) < 200 then 'near_empty: ' || len(b) || ' chars' end,
    case when ft = '.pdf' and not regexp_matches(b, '(?m)^#\s+\S+') then 'no_h1_title' end,
    case when ft = '.pdf' and not regexp_matches(l, '[\p{L}\p{N}\p{Pe}\p{Pf}.!?…。！？`|*-]') then 'suspect_truncation: last=''' || l || '''' end], lambda x: x is not null) end as issues
from (select *, right(rtrim(b, ' ' || chr(10) || chr(9)), 1) as l from (select path, doc_id, case when doc_id % 2 = 0 then '.pdf' else '.md' end as ft,
   case when doc_id % 7 = 0 then '' when doc_id % 11 = 0 then '# t' || chr(10) || content || chr(65533) else content end as b from v_documents)))"""


@query("check_documents", f"with {_INSPECT} select relative_path, file_type, total_chars::int as total_chars, array_to_string(issues, ';') as issues from chk", "v_documents")
def checks(spark, d):
    """F7"""
    return inspected(spark, d).select("relative_path", "file_type", "total_chars", F.array_join("issues", ";").alias("issues"))


@query("inspection_report", f"""with {_INSPECT}, k as (select split_part(unnest(issues), ':', 1) as name from chk)
select 'total' as section, 'sampled' as name, count(*) as n from chk union all select 'total', 'clean', count(*) filter (len(issues) = 0) from chk
union all select 'total', 'blocking', count(*) from k where name in ('output_missing', 'empty_file', 'invalid_utf8', 'replacement_chars', 'nul_bytes', 'broken_images')
union all select 'issue', name, count(*) from k group by name union all select 'type', file_type, count(*) from chk group by file_type""", "v_documents")
def report(spark, d):
    """F6"""
    return G.inspection_report(inspected(spark, d))


@query("inspection_blocking", f"""with {_INSPECT}, k as (select split_part(unnest(issues), ':', 1) as name from chk),
t as (select * from v_runs order by seq desc limit 20), h as (select (count(*) filter (seq > coalesce((select max(seq) from t where result = 'ok'), -1)) >= 3)::int as blocking from t)
select 'total' as section, 'sampled' as name, count(*) as n from chk union all select 'total', 'clean', count(*) filter (len(issues) = 0) from chk
union all select 'total', 'blocking', (select count(*) from k where name in ('output_missing', 'empty_file', 'invalid_utf8', 'replacement_chars', 'nul_bytes', 'broken_images')) + blocking from h
union all select 'issue', name, count(*) from k group by name union all select 'type', file_type, count(*) from chk group by file_type""", "v_documents", "v_runs")
def blocking(spark, d):
    """the report in which the health of runs is among what blocks."""
    return G.inspection_report(inspected(spark, d), G.run_health(runs(spark, d)))


@query("conversion_timing", "select 'c' || (member % 5) as converter, '.pdf' as suffix, result as status, count(*) as n, avg(seconds) as avg_seconds, quantile_disc(seconds, 0.5) as p50_seconds from v_runs group by 1, 3", "v_runs")
def timing(spark, d):
    """F11"""
    r = V.runs(spark, d).select(F.concat(F.lit("c"), (F.col("member") % 5).cast("string")).alias("converter"), F.lit(".pdf").alias("suffix"), F.col("result").alias("status"), "seconds")
    return G.conversion_timing(r)


@query("review_registry", "select doc_id as feedback_id, source_sha256, 'quality' as category, status as review_status, case when doc_id % 2 = 0 then relative_path else '' end as output_path from v_conversions", "v_conversions")
def review(spark, d):
    """C11"""
    f = V.conversions(spark, d).select(F.col("doc_id").alias("feedback_id"), "source_sha256", F.lit("quality").alias("category"), F.col("status").alias("review_status"),
                                       F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("/repo/"), "relative_path")).otherwise(F.concat(F.lit("/other/"), "relative_path")).alias("output_path"))
    return G.review_registry(f, "/repo")


@query("retrieval_metrics", f"""with {knowledge_sql(10)},
r as (select q.query_id, min(rank) as r from (select distinct query_id from v_queries) q left join (select h.query_id, h.rank from found h join v_expected e using (query_id, path)) x using (query_id) group by q.query_id)
select count(*) as cases, count(*) filter (r <= 1) as hit_at_1, count(*) filter (r <= 3) as hit_at_3, count(*) filter (r <= 5) as hit_at_5, count(*) filter (r <= 10) as hit_at_10,
  count(*) filter (r is null) as miss, round(sum(coalesce(1.0::double / r, 0)) / count(*), 3) as mrr from r""", "v_documents", "v_queries", "v_expected")
def retrieval(spark, d):
    """F8"""
    hits = S.knowledge_search(V.documents(spark, d), V.queries(spark, d), 10, index=stored(spark, d, "tokens"))
    found, _, members = expected(spark, d)
    return G.retrieval_metrics(hits, found, V.queries(spark, d), members=members)


_KEYWORDS = """v_queries as (
  select item_id as query_id, case when len(string_split(text, ' ')) >= 5 then array_to_string(string_split(text, ' ')[2:4], ' ') else text end as text from benchmark)"""


@query("retrieval_metrics_keywords", f"""with {_KEYWORDS}, {knowledge_sql(10)},
r as (select q.query_id, min(rank) as r from (select distinct query_id from v_queries) q left join (select h.query_id, h.rank from found h join v_expected e using (query_id, path)) x using (query_id) group by q.query_id)
select count(*) as cases, count(*) filter (r <= 1) as hit_at_1, count(*) filter (r <= 3) as hit_at_3, count(*) filter (r <= 5) as hit_at_5, count(*) filter (r <= 10) as hit_at_10,
  count(*) filter (r is null) as miss, round(sum(coalesce(1.0::double / r, 0)) / count(*), 3) as mrr from r""", "v_documents", "v_expected")
def retrieval_keywords(spark, d):
    """F8: the same cases asked by their keywords, joined by blanks; items of fewer than five words are asked whole."""
    words = F.split("text", " ")
    asked = V.queries(spark, d).select("query_id", F.when(F.size(words) >= 5, F.array_join(F.slice(words, 2, 3), " ")).otherwise(F.col("text")).alias("text"))
    found, _, members = expected(spark, d)
    return G.retrieval_metrics(S.knowledge_search(V.documents(spark, d), asked, 10, index=stored(spark, d, "tokens")), found, asked, members=members)


@query("citation_metrics", r"""with a as (select conv_id as query_id, text as answer, 'members/src' || (conv_id % 20) || '/d' || conv_id || '/d' || conv_id || '.md' as path from conversations where role = 'assistant'),
j as (select distinct query_id, answer, path from a), q as (select distinct query_id, answer from a), k as (select j.*, v.content from j left join v_documents v using (path))
select (select count(*) from q) as answers, (select count(*) from q where regexp_matches(answer, '\S')) as answered, (select count(*) from q) as with_citation, (select count(*) from q where query_id % 3 = 0) as expected_in_citations,
  count(*) as citations, count(content) as existing, count(*) filter (query_id % 2 = 0) as retrieved,
  count(*) filter (content is not null and list_has_any(regexp_extract_all(answer, '[0-9]+(?:\.[0-9]+)?'), regexp_extract_all(content, '[0-9]+(?:\.[0-9]+)?'))) as supported from (select distinct query_id, path, content, list_distinct(regexp_extract_all(answer, '[0-9]+(?:\.[0-9]+)?')) as t, answer from k)""", "v_documents")
def citations(spark, d):
    """F9, S4"""
    n = F.col("conv_id").cast("string")
    path = F.concat(F.lit("members/src"), (F.col("conv_id") % 20).cast("string"), F.lit("/d"), n, F.lit("/d"), n, F.lit(".md"))
    a = V.table(spark, d, "conversations").where("role = 'assistant'").select(F.col("conv_id").alias("query_id"), F.col("text").alias("answer"), F.array(path).alias("citations"))
    got = a.where("query_id % 2 = 0").select("query_id", F.explode("citations").alias("path"))
    one = a.groupBy("query_id", "answer").agg(F.first("citations").alias("citations"))
    wanted = a.where("query_id % 3 = 0").select("query_id", F.explode("citations").alias("path")).distinct()
    return G.citation_metrics(one, V.documents(spark, d), got, wanted)


_TITLES = r"""select session_id, title from (select session_id, max(message_id) as updated, count(*) as n_messages, coalesce(nullif(substring(trim(regexp_replace(coalesce(min_by(content, message_id) filter (kind = 'user'), ''), '[ \t\n\r\x0B\f]+', ' ', 'g'), ' '), 1, 20), ''), 'New session') as title
from v_messages group by session_id)"""


@query("session_list", r"""select session_id, max(message_id) as updated, count(*) as n_messages, coalesce(nullif(substring(trim(regexp_replace(coalesce(min_by(content, message_id) filter (kind = 'user'), ''), '[ \t\n\r\x0B\f]+', ' ', 'g'), ' '), 1, 20), ''), 'New session') as title
from v_messages group by session_id""", "v_messages")
def sessions(spark, d):
    """H10, H11"""
    return M.session_list(V.messages(spark, d))


@query("session_history", "select session_id, message_id, kind, content, row_number() over (partition by session_id order by message_id) as place from v_messages", "v_messages")
def history(spark, d):
    """The messages of every session in order."""
    return M.histories(V.messages(spark, d)).select("session_id", "message_id", "kind", "content", "place")


@query("delete_sessions", "select session_id, message_id from v_messages where session_id % 3 <> 0", "v_messages")
def deleted(spark, d):
    """C13"""
    m = V.messages(spark, d)
    return M.delete_sessions(m, m.where("session_id % 3 = 0")).select("session_id", "message_id")


@query("session_buckets", """with s as (select conv_id as session_id, 'Chat ' || conv_id as title, timestamp '2024-01-01 12:00:00' + to_hours(conv_id) as updated_at from (select distinct conv_id from conversations)),
b as (select *, date_diff('day', cast(updated_at as date), date '2024-01-09') as k from s where contains(lower(title), '1')),
c as (select *, case when k <= 0 then 'today' when k = 1 then 'yesterday' when k < 7 then 'week' else 'older' end as bucket from b)
select session_id, bucket, row_number() over (partition by bucket order by updated_at desc, session_id desc) as place from c""")
def buckets(spark, d):
    """H14"""
    c = V.table(spark, d, "conversations").select("conv_id").distinct()
    s = c.select(F.col("conv_id").alias("session_id"), F.concat(F.lit("Chat "), F.col("conv_id").cast("string")).alias("title"),
                 F.expr("timestamp_ntz'2024-01-01 12:00:00' + make_dt_interval(0, cast(conv_id as int))").alias("updated_at"))
    return M.session_buckets(s, F.lit("2024-01-09").cast("date"), "1").select("session_id", "bucket", "place")


@query("searchable_text", "select conv_id, turn, case when role = 'system' then null when turn % 4 = 1 then 'm' || turn else nullif(trim(text, ' ' || chr(10)), '') end as body from conversations")
def searchable(spark, d):
    """D17"""
    t = V.table(spark, d, "conversations")
    payload = F.to_json(F.struct(
        F.when(F.col("role") == "system", "tool_call").otherwise("answer").alias("type"), F.when(F.col("turn") % 4 == 1, " ").otherwise(F.col("text")).alias("content"), F.concat(F.lit("m"), F.col("turn").cast("string")).alias("message")))
    body = F.when((F.col("turn") % 4 != 1) & (F.col("role") != "system") & (T.strip("text") == ""), None).otherwise(M.searchable_text(payload))
    return t.select("conv_id", "turn", body.alias("body"))


_MQ = """qs as (select item_id as query_id, text from benchmark)"""
_MS = rf"""{_MQ}, qt as (select query_id, {QTOK} as ts from qs), qf as (select query_id, unnest(ts) as t, unnest(range(1, len(ts) + 1)) as i from qt),
ql as (select query_id, t, i from qf a where not exists (select 1 from qf b where b.query_id = a.query_id and lower(b.t) = lower(a.t) and b.i < a.i)),
ph as (select query_id, t, regexp_extract_all(strip_accents(lower(t)), '[\p{{L}}\p{{N}}]+')[1] as token from ql),
fl as (select message_id, session_id, regexp_extract_all(strip_accents(lower(coalesce(content, ''))), '[\p{{L}}\p{{N}}]+') as ts from v_messages where kind <> 'process'),
ln as (select message_id, len(ts) as n from fl), co as (select count(*) as nd, avg(n) as av from ln),
tf as (select message_id, token, count(*) as f from (select message_id, unnest(ts) as token from fl) group by 1, 2), df as (select token, count(*) as df from tf group by token),
sc as (select query_id, message_id, round(sum(greatest(ln((nd - df + 0.5) / (df + 0.5)), 1e-6) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * n / av))), 9) as score from ph join tf using (token) join df using (token) join ln using (message_id), co group by 1, 2)"""


@query("search_messages", f"""with {_MS}, hit as (select * from (select *, row_number() over (partition by query_id order by score desc, message_id) as rank from sc) where rank <= 20),
hc as (select query_id, message_id, content from hit join v_messages using (message_id)),
plc as (select query_id, message_id, any_value(content) as c, min(instr(lower(content), lower(t))) filter (instr(lower(content), lower(t)) > 0) - 1 as p from hc join ql using (query_id) group by query_id, message_id),
cut as (select query_id, message_id, c, case when p is null then 0 else greatest(0, p - 30) end as s, case when p is null then least(len(c), 60) else least(len(c), p + 30) end as e from plc),
sn as (select query_id, message_id, (case when s > 0 then '...' else '' end) || substring(c, s + 1, e - s) || (case when e < len(c) then '...' else '' end) as snippet from cut), ti as ({_TITLES})
select query_id, session_id, message_id, score, rank, title, snippet from hit join (select message_id, session_id from fl) using (message_id) join sn using (query_id, message_id) join ti using (session_id)""", "v_messages")
def search_messages(spark, d):
    """E15, C17, D15"""
    return M.search_messages(V.messages(spark, d), V.queries(spark, d), 20).select("query_id", "session_id", "message_id", "score", "rank", "title", "snippet")


@query("manifest_diff", """with n as (select doc_id::varchar as token, sha256(case when doc_id % 7 = 0 then text || 'x' else text end) as h from documents where doc_id % 10 <> 1),
m as (select doc_id::varchar as token, sha256(text) as h, doc_id % 17 <> 0 as o from documents where doc_id % 10 <> 2)
select coalesce(n.token, m.token) as token, case when m.h is null then 'new' when n.h is null then 'disappeared' when n.h <> m.h or not o then 'updated' else 'unchanged' end as change from n full join m on n.token = m.token""")
def manifest(spark, d):
    """C14"""
    t = V.table(spark, d, "documents").withColumn("token", F.col("doc_id").cast("string"))
    n = t.where("doc_id % 10 <> 1").select("token", F.sha2(F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text")), 256).alias("hash"))
    return X.manifest_diff(n, t.where("doc_id % 10 <> 2").select("token", F.sha2("text", 256).alias("hash"), (F.col("doc_id") % 17 != 0).alias("output_exists")))


@query("tree_top_segment", """with recursive n as (select doc_id, case when doc_id < 10 then -1 else doc_id // 10 end as parent, 't' || doc_id as title from documents),
t(doc_id, title, top) as (select doc_id, title, title from n where parent = -1 union all select n.doc_id, n.title, t.top from n join t on n.parent = t.doc_id)
select doc_id::varchar as token, title, top from t""")
def tree(spark, d):
    """C15"""
    n = V.table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("token"), F.when(F.col("doc_id") < 10, "root").otherwise(F.floor(F.col("doc_id") / 10).cast("string")).alias("parent"),
                                              F.concat(F.lit("t"), F.col("doc_id").cast("string")).alias("title"))
    return X.tree_top_segment(n, "root")


@query("export_report", """with c as (select case doc_id % 4 when 0 then 'new' when 1 then 'updated' else 'unchanged' end as action from documents)
select action, count(*) as n from c group by action union all select 'failed', count(*) from documents where doc_id % 9 = 0 union all select 'skipped', count(*) from documents where doc_id % 11 = 0""")
def export(spark, d):
    """F12"""
    t = V.table(spark, d, "documents")
    n = F.col("doc_id") % 4
    return X.export_report(t.select(F.when(n == 0, "new").when(n == 1, "updated").otherwise("unchanged").alias("change")), t.where("doc_id % 9 = 0"), t.where("doc_id % 11 = 0"))


@query("export_totals", """with n as (select doc_id, case when doc_id % 11 = 0 then 'sheet' when doc_id % 13 = 0 then 'bitable' else 'docx' end as type, doc_id % 3 as images from documents)
select 'new' as action, count(*) as n from n where type = 'docx' union all select 'failed', count(*) from n where doc_id % 9 = 0 union all select 'skipped', count(*) from n where type <> 'docx'
union all select 'scanned', count(*) from n union all select 'docs', count(*) from n where type = 'docx' union all select 'images', coalesce(sum(images), 0)::bigint from n where type = 'docx'
union all select 'skipped ' || type, count(*) from n where type <> 'docx' group by type
union all select case when doc_id % 9 = 0 then 'did write-failed' else 'did written' end, count(*) from n where type = 'docx' group by 1""")
def totals(spark, d):
    """what an export scanned, left out by type, and did."""
    kind = F.when(F.col("doc_id") % 11 == 0, "sheet").when(F.col("doc_id") % 13 == 0, "bitable").otherwise("docx")
    nodes = V.table(spark, d, "documents").select("doc_id", kind.alias("type"), (F.col("doc_id") % 3).alias("images"))
    mine = nodes.where("type = 'docx'")
    did = mine.select(F.when(F.col("doc_id") % 9 == 0, "write-failed").otherwise("written").alias("action"))
    return X.export_report(mine.select(F.lit("new").alias("change")), nodes.where("doc_id % 9 = 0"), nodes.where("type <> 'docx'"), nodes, did)
