"""Queries over the ingestion state machine."""

from __future__ import annotations

from pyspark.sql import functions as F

from marlstone.functions import text as T
from marlstone.operators import state as S
from marlstone.plans import views as V
from marlstone.registered.base import Registry

query = Registry()
QUERIES, ORACLES = query.queries, query.oracles


_SUF = "lower(regexp_extract(relative_path, '[^/](\\.[^./]+)$', 1))"
_HEAVY = "('.pdf', '.docx', '.doc', '.pptx', '.ppt')"
_SUPPORTED = "('.md', '.markdown', '.txt', '.pdf', '.docx', '.doc', '.pptx', '.ppt', '.xlsx')"
_STATE = """state as (select relative_path, size, sha256, case when doc_id % 3 = 0 then 'converted' else 'quality_failed' end as status, doc_id from v_scan_1)"""


def state(spark, d):
    return V.scan_1(spark, d).withColumn("status", F.when(F.col("doc_id") % 3 == 0, "converted").otherwise("quality_failed"))


@query("route_format", f"""select relative_path, {_SUF} as suffix, {_SUF} in {_SUPPORTED} as supported,
  case when {_SUF} in ('.md', '.markdown') then 'markdown-copy' when {_SUF} = '.txt' then 'text-decode' when {_SUF} = '.xlsx' then 'table-parts'
       when {_SUF} in {_HEAVY} then 'document-converter' end as converter,
  case when {_SUF} in ('.md', '.markdown', '.txt') then 'source' else 'tool' end as origin,
  ({_SUF} in {_HEAVY})::int as cost from v_scan_1""", "v_scan_1")
def route(spark, d):
    """B1, B2"""
    return S.route_format(V.scan_1(spark, d)).select("relative_path", "suffix", "supported", "converter", "origin", S.cost_class().alias("cost"))


@query("output_path", """select relative_path, 'members/ada/' || regexp_extract(relative_path, '^(.*)/', 1) || '/' || stem || '/' || stem || '.md' as output_path
from (select relative_path, regexp_replace(split_part(relative_path, '/', -1), '\\.[^.]*$', '') as stem from v_scan_1)""", "v_scan_1")
def output(spark, d):
    """B6"""
    return V.scan_1(spark, d).select("relative_path", S.output_path("ada").alias("output_path"))


@query("exclude_sources", """select s.relative_path, sha256, case when doc_id % 9 = 0 then 'ignored' end as status, case when doc_id % 9 = 0 then 'excluded' end as reason from v_scan_1 s""", "v_scan_1")
def exclude(spark, d):
    """B7"""
    scan = V.scan_1(spark, d)
    return S.exclude_sources(scan, scan.where("doc_id % 9 = 0")).select("relative_path", "sha256", "status", "reason")


@query("upsert_sources", f"""with {_STATE} select coalesce(n.relative_path, s.relative_path) as relative_path, coalesce(n.size, s.size) as size, coalesce(n.sha256, s.sha256) as sha256,
  case when n.relative_path is null or s.sha256 = n.sha256 then s.status else 'discovered' end as status,
  coalesce(timestamp '2024-02-01 00:00:00' + to_minutes(n.doc_id), timestamp '2024-01-01 00:00:00' + to_minutes(s.doc_id)) as mtime
from state s full join v_scan_2 n on s.relative_path = n.relative_path""", "v_scan_1", "v_scan_2")
def upsert(spark, d):
    """C1"""
    changed = lambda df, month: df.withColumn("mtime", F.expr(f"timestamp_ntz'2024-{month}-01 00:00:00' + make_dt_interval(0, 0, cast(doc_id as int))"))
    return S.upsert_sources(changed(state(spark, d), "01"), changed(V.scan_2(spark, d), "02"))


@query("conversion_reason", f"""select s.relative_path, s.sha256, case when {_SUF.replace('relative_path', 's.relative_path')} not in {_SUPPORTED} then 'unsupported'
  when c.source_sha256 is null then 'new_source' when c.source_sha256 <> s.sha256 then 'source_changed' when c.status not in ('converted', 'quality_warned') then 'previous_failed'
  when not coalesce(output_exists, false) then 'output_missing' else 'unchanged' end as reason
from v_scan_2 s left join v_conversions c on s.relative_path = c.relative_path""", "v_scan_2", "v_conversions")
def reason(spark, d):
    """C2"""
    return S.conversion_reason(V.scan_2(spark, d), V.conversions(spark, d))


@query("backfill_status", """select s.relative_path, s.sha256, coalesce(c.status, 'discovered') as status, c.status is not null and c.status <> 'discovered' as changed
from v_scan_2 s left join v_conversions c on s.relative_path = c.relative_path and s.sha256 = c.source_sha256""", "v_scan_2", "v_conversions")
def backfill(spark, d):
    """C3"""
    return S.backfill_status(V.scan_2(spark, d).withColumn("status", F.lit("discovered")), V.conversions(spark, d))


@query("mark_missing", f"""with {_STATE} select relative_path, case when relative_path in (select relative_path from v_scan_2) then status else 'source_missing' end as status from state""", "v_scan_1", "v_scan_2")
def missing(spark, d):
    """C4"""
    return S.mark_missing(state(spark, d), V.scan_2(spark, d)).select("relative_path", "status")


@query("recover_stale", """select relative_path, case when stale then 'failed_retryable' else status end as status, case when stale then 'stale_recovered' end as reason,
  case when stale then 'processing was interrupted' end as error_message
from (select *, status = 'processing' and updated_at < timestamp '2024-01-01 09:00:00' - interval 60 minute as stale from v_conversions)""", "v_conversions")
def stale(spark, d):
    """C5"""
    return S.recover_stale(V.conversions(spark, d), F.expr("timestamp_ntz'2024-01-01 09:00:00'"), 60).select("relative_path", "status", "reason", "error_message")


@query("plan_batches", f"""select relative_path, n, ((n - 1) // 50 + 1)::bigint as batch from (
  select relative_path, row_number() over (order by ({_SUF} in {_HEAVY})::int, lower(relative_path), relative_path) as n from v_scan_1)""", "v_scan_1")
def batches(spark, d):
    """C6"""
    return S.plan_batches(V.scan_1(spark, d).select("relative_path"), 50).select("relative_path", "n", "batch")


_GATE_TEXT = "case when doc_id % 19 = 0 then text || chr(65533) when doc_id % 23 = 0 then '' else text end"


@query("gate", f"""select doc_id, case when doc_id % 29 = 0 then 'failed_retryable' when tool and bad then 'quality_failed' when cred then 'blocked_secret' when bad then 'quality_warned' else 'converted' end as status
from (select doc_id, doc_id % 2 = 0 as tool, trim(t, ' ' || chr(10) || chr(9) || chr(13)) = '' or contains(t, chr(65533)) as bad,
        regexp_matches(t, '(?i)\\b(api[_-]?key|token|secret|password)["'']?\\s*[:=]\\s*["''][0-9A-Za-z_\\-]{{16,}}["'']') as cred
      from (select doc_id, {_GATE_TEXT} as t from documents))""")
def gated(spark, d):
    """C7, D3, D4"""
    t = F.when(F.col("doc_id") % 19 == 0, F.concat("text", F.lit("�"))).when(F.col("doc_id") % 23 == 0, "").otherwise(F.col("text"))
    docs = V.table(spark, d, "documents").select("doc_id", t.alias("text"))
    from marlstone.operators.text_jobs import scan_credentials

    judged = scan_credentials(docs).select(
        "doc_id", F.when(F.col("doc_id") % 2 == 0, "tool").otherwise("source").alias("origin"), T.markdown_errors("text").alias("errors"),
        F.col("ok").alias("credentials_ok"), F.when(F.col("doc_id") % 29 == 0, "converter crashed").alias("failure"))
    return S.gate(judged).select("doc_id", "status")


_FINDINGS = "findings as (select source_sha256, case when doc_id % 2 = 0 then 'source_quality' else 'credential' end as category, status from v_conversions where status like 'quality%')"


@query("new_feedback", f"""with {_FINDINGS}, feedback as (select source_sha256, category, case when doc_id % 3 = 0 then 'resolved' else 'open' end as review_status from (
  select source_sha256, case when doc_id % 2 = 0 then 'source_quality' else 'credential' end as category, doc_id from v_conversions where status like 'quality%' and doc_id % 5 = 0))
select distinct source_sha256, category from findings f where not exists (
  select 1 from feedback b where b.source_sha256 = f.source_sha256 and b.category = f.category and review_status <> 'resolved')""", "v_conversions")
def feedback(spark, d):
    """C8, S3"""
    c = V.conversions(spark, d).where("status like 'quality%'").withColumn("category", F.when(F.col("doc_id") % 2 == 0, "source_quality").otherwise("credential"))
    old = c.where("doc_id % 5 = 0").withColumn("review_status", F.when(F.col("doc_id") % 3 == 0, "resolved").otherwise("open"))
    return S.new_feedback(c, old).select("source_sha256", "category")


@query("source_registry", """select c.relative_path, source_sha256, s.size as source_bytes, 'quarry' as converter, '1.0' as version, status, 'members/' || c.relative_path as output_path
from v_conversions c left join v_scan_2 s on c.relative_path = s.relative_path""", "v_conversions", "v_scan_2")
def sources(spark, d):
    """C9, B8, B9"""
    return S.source_registry(V.conversions(spark, d), V.scan_2(spark, d))


@query("knowledge_registry", """with img as (select regexp_replace(path, '/[^/]*$', '') as dir, count(*) as images from v_documents, range(3) where doc_id % 4 > range group by dir)
select v.path, title, strlen(content) as bytes, coalesce(images, 0) as images, case when doc_id % 2 = 0 then sha256(content) else '' end as source_sha256,
  case when doc_id % 2 = 0 then strftime(timestamp '2024-01-01 00:00:00' + to_minutes(doc_id), '%Y-%m-%d %H:%M:%S') else '' end as converted_at
from v_documents v left join img on regexp_replace(v.path, '/[^/]*$', '') = img.dir""", "v_documents")
def knowledge(spark, d):
    """C10"""
    docs = V.documents(spark, d)
    n = F.least(F.lit(3), F.col("doc_id") % 4).cast("int")
    images = docs.where(n > 0).select(F.explode(F.sequence(F.lit(1), n)).alias("i"), "path").select(
        F.concat(F.regexp_replace("path", "/[^/]*$", "/images/"), F.col("i").cast("string"), F.lit(".png")).alias("path"))
    registry = docs.where("doc_id % 2 = 0").select("path", F.sha2("content", 256).alias("source_sha256"), F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, cast(doc_id as int))").alias("converted_at"))
    return S.knowledge_registry(docs, registry, images)


@query("refresh_index", """with d as (select path, sha256(case when doc_id % 7 = 0 then content || 'x' else content end) as n from v_documents where doc_id % 10 <> 1),
i as (select path, sha256(content) as o from v_documents where doc_id % 10 <> 2)
select coalesce(d.path, i.path) as path, coalesce(n, o) as content_sha256,
  case when o is null then 'add' when n is null then 'delete' when o <> n then 'update' else 'keep' end as action from d full join i on d.path = i.path""", "v_documents")
def refresh(spark, d):
    """C12, D7"""
    v = V.documents(spark, d)
    new = v.where("doc_id % 10 <> 1").select("path", F.sha2(F.when(F.col("doc_id") % 7 == 0, F.concat("content", F.lit("x"))).otherwise(F.col("content")), 256).alias("content_sha256"))
    return S.refresh_index(new, v.where("doc_id % 10 <> 2").select("path", F.sha2("content", 256).alias("content_sha256")))


@query("status_overview", f"""with {_STATE} select 'source' as kind, status as name, count(*) as n from state group by status union all select 'total', 'sources', count(*) from state
union all select 'open', 'issues', count(*) from v_conversions where status not in ('converted', 'quality_warned')
union all select 'open', 'warnings', count(*) from v_conversions where status = 'quality_warned'""", "v_scan_1", "v_conversions")
def overview(spark, d):
    """F1"""
    return S.status_overview(state(spark, d), V.conversions(spark, d))


@query("non_success", """select relative_path, status, substring(repeat(relative_path, 40), 1, 400) as error from v_conversions where status not in ('converted', 'quality_warned')""", "v_conversions")
def failures(spark, d):
    """B10"""
    return S.non_success(V.conversions(spark, d).withColumn("error_message", F.repeat("relative_path", F.lit(40))))


@query("warned", """select relative_path, status, substring(relative_path, 1, 400) as warning from v_conversions where status = 'quality_warned'""", "v_conversions")
def warnings(spark, d):
    """B10"""
    return S.warned(V.conversions(spark, d).withColumn("warning_message", F.col("relative_path")))


@query("run_summary", f"""with r as (select case when {_SUF.replace('relative_path', 's.relative_path')} not in {_SUPPORTED} then 'unsupported'
  when c.source_sha256 is null then 'new_source' when c.source_sha256 <> s.sha256 then 'source_changed' when c.status not in ('converted', 'quality_warned') then 'previous_failed'
  when not coalesce(output_exists, false) then 'output_missing' else 'unchanged' end as reason from v_scan_2 s left join v_conversions c on s.relative_path = c.relative_path)
select count(*) as scanned, count(*) filter (reason in ('new_source', 'source_changed', 'previous_failed', 'output_missing')) as queued,
  count(*) filter (reason in ('unchanged', 'unsupported', 'excluded')) as skipped,
  (select count(*) from v_conversions where status in ('converted', 'quality_warned')) as converted, (select count(*) from v_conversions where status = 'quality_warned') as warned,
  (select count(*) from v_conversions where status in ('quality_failed', 'failed_retryable', 'blocked_secret')) as failed, 0::bigint as missing,
  ceil(count(*) filter (reason in ('new_source', 'source_changed', 'previous_failed', 'output_missing')) / 50.0)::bigint as batches, (select count(*) from documents where doc_id % 10 <> 1) as indexed,
  (select string_agg(reason || '=' || n, ',' order by reason) from (select reason, count(*) as n from r group by reason)) as reasons from r""", "v_scan_2", "v_conversions")
def summary(spark, d):
    """F2"""
    reasons = S.conversion_reason(V.scan_2(spark, d), V.conversions(spark, d))
    planned = S.plan_batches(reasons.where("reason in ('new_source', 'source_changed', 'previous_failed', 'output_missing')"), 50)
    docs = V.documents(spark, d).select("path", "doc_id", F.sha2("content", 256).alias("content_sha256"))
    one = S.run_summary(reasons, V.conversions(spark, d), planned, S.refresh_index(docs.where("doc_id % 10 <> 1"), docs.where("doc_id % 10 <> 2")))
    pairs = F.array_join(F.transform(F.map_entries("reason_counts"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return one.withColumn("reasons", pairs).drop("reason_counts")


@query("stratified_sample", """select relative_path, file_type, status from (
  select relative_path, ft as file_type, status, row_number() over (partition by ft order by relative_path) - 1 as i, greatest(1, count(*) over (partition by ft) // 6) as step
  from (select *, lower(regexp_extract(relative_path, '[^/](\\.[^./]+)$', 1)) as ft from v_conversions where status in ('converted', 'quality_warned')))
where i % step = 0 and i // step < 6""", "v_conversions")
def sample(spark, d):
    """H1"""
    return S.stratified_sample(V.conversions(spark, d))
