"""Adapter views: the shapes of a knowledge corpus over the tables of a data folder.

Each view is a DataFrame here and the same rows as DuckDB SQL in `SQL`, so that every operator can be checked.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, member, title, content, doc_id."""
    d = F.concat(F.lit("d"), F.col("doc_id").cast("string"))
    return table(spark, sf_dir, "documents").select(
        F.concat_ws("/", F.lit("members"), "source", d, F.concat(d, F.lit(".md"))).alias("path"),
        F.col("source").alias("member"), F.substring(F.substring_index("text", "\n", 1), 1, 60).alias("title"),
        F.col("text").alias("content"), "doc_id")


_SUFFIX = {0: ".md", 1: ".txt", 2: ".pdf", 3: ".docx", 4: ".pptx", 5: ".xlsx", 6: ".png"}


def _suffix():
    out = F.lit(".MD")
    for k, s in _SUFFIX.items():
        out = F.when(F.col("doc_id") % 8 == k, s).otherwise(out)
    return out


def scan_1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """relative_path, size, sha256, doc_id: a first snapshot of sources."""
    return table(spark, sf_dir, "documents").where("doc_id % 10 <> 0").select(
        F.concat("source", F.lit("/d"), F.col("doc_id").cast("string"), _suffix()).alias("relative_path"),
        F.col("n_chars").alias("size"), F.sha2("text", 256).alias("sha256"), "doc_id")


def scan_2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A later snapshot: some sources are gone, some new, some changed."""
    text = F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("v2"))).otherwise(F.col("text"))
    return table(spark, sf_dir, "documents").where("doc_id % 10 <> 1").select(
        F.concat("source", F.lit("/d"), F.col("doc_id").cast("string"), _suffix()).alias("relative_path"),
        F.col("n_chars").alias("size"), F.sha2(text, 256).alias("sha256"), "doc_id")


def conversions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """relative_path, source_sha256, converter_version, status, updated_at, output_exists, doc_id."""
    status = F.lit("converted")
    for k, s in ((0, "failed_retryable"), (1, "quality_failed"), (2, "quality_warned"), (3, "processing")):
        status = F.when(F.col("doc_id") % 11 == k, s).otherwise(status)
    return scan_1(spark, sf_dir).where("doc_id % 13 <> 0 and doc_id % 8 <> 6").select(
        "relative_path", F.col("sha256").alias("source_sha256"), F.lit("quarry-1.0").alias("converter_version"),
        status.alias("status"), F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, cast(doc_id as int))").alias("updated_at"),
        (F.col("doc_id") % 17 != 0).alias("output_exists"), "doc_id")


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id and text: all benchmark items, whole."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """session_id, message_id (a number that orders by session and turn), kind, content."""
    kind = F.when(F.col("role") == "user", "user").when(F.col("role") == "assistant", "answer").otherwise("process")
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("session_id"), (F.col("conv_id") * 10000 + F.col("turn")).alias("message_id"), kind.alias("kind"), F.col("text").alias("content"))


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq, member, started_at, result, seconds: a log of runs."""
    result = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "signup", "locked").otherwise("ok")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("seq"), F.col("user_id").alias("member"), F.col("ts").alias("started_at"), result.alias("result"), F.col("value").alias("seconds"))


def trace_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """trace_id, member, seq, ts, type, doc_id, zero_hit: events of traced questions."""
    kind = F.lit("error")
    for k, s in (("purchase", "answer"), ("click", "read"), ("view", "search"), ("signup", "start")):
        kind = F.when(F.col("event_type") == k, s).otherwise(kind)
    return table(spark, sf_dir, "events").select(
        F.concat(F.col("user_id").cast("string"), F.lit("-"), F.col("ts").cast("date").cast("string")).alias("trace_id"),
        F.col("user_id").alias("member"), F.col("event_id").alias("seq"), "ts", kind.alias("type"),
        (F.col("event_id") % 40).alias("doc_id"), (F.col("event_id") % 5 == 0).alias("zero_hit"))


def html_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id and content: one HTML table of orders for each customer that has any."""
    row = F.concat(F.lit("<tr><td>"), F.col("o_orderkey").cast("string"), F.lit("</td><td>"), F.col("o_orderstatus"), F.lit("</td></tr>"))
    return table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.sort_array(F.collect_list(F.struct("o_orderkey", row.alias("r")))).alias("rows")).select(
        "id", F.concat(F.lit("<table><tr><th>key</th><th>status</th></tr>"), F.array_join(F.col("rows.r"), ""), F.lit("</table>")).alias("content"))


_SCAN_PATH = """source||'/d'||cast(doc_id as varchar)||case doc_id % 8 when 0 then '.md' when 1 then '.txt' when 2 then '.pdf'
  when 3 then '.docx' when 4 then '.pptx' when 5 then '.xlsx' when 6 then '.png' else '.MD' end"""
SQL = {
    "v_documents": """select 'members/'||source||'/d'||cast(doc_id as varchar)||'/d'||cast(doc_id as varchar)||'.md' as path, source as member,
  substring(split_part(text, chr(10), 1), 1, 60) as title, text as content, doc_id from documents""",
    "v_scan_1": f"select {_SCAN_PATH} as relative_path, n_chars as size, sha256(text) as sha256, doc_id from documents where doc_id % 10 <> 0",
    "v_scan_2": f"""select {_SCAN_PATH} as relative_path, n_chars as size, sha256(case when doc_id % 7 = 0 then text||'v2' else text end) as sha256, doc_id
  from documents where doc_id % 10 <> 1""",
    "v_conversions": """select relative_path, sha256 as source_sha256, 'quarry-1.0' as converter_version,
  case doc_id % 11 when 0 then 'failed_retryable' when 1 then 'quality_failed' when 2 then 'quality_warned' when 3 then 'processing' else 'converted' end as status,
  timestamp '2024-01-01 00:00:00' + to_minutes(doc_id) as updated_at, doc_id % 17 <> 0 as output_exists, doc_id
  from v_scan_1 where doc_id % 13 <> 0 and doc_id % 8 <> 6""",
    "v_queries": "select item_id as query_id, text from benchmark",
    # documents that hold the words of a benchmark item in a row
    "v_expected": r"""select query_id, path from (select item_id as query_id, ' ' || array_to_string(regexp_extract_all(strip_accents(lower(text)), '[\p{L}\p{N}]+'), ' ') || ' ' as w from benchmark) b
  join (select path, ' ' || array_to_string(regexp_extract_all(strip_accents(lower(content)), '[\p{L}\p{N}]+'), ' ') || ' ' as ws from v_documents) d on contains(ws, w) where w <> '  '""",
    "v_messages": """select conv_id as session_id, conv_id * 10000 + turn as message_id,
  case role when 'user' then 'user' when 'assistant' then 'answer' else 'process' end as kind, text as content from conversations""",
    "v_runs": """select event_id as seq, user_id as member, ts as started_at,
  case event_type when 'error' then 'failed' when 'signup' then 'locked' else 'ok' end as result, value as seconds from events""",
    "v_trace_events": """select cast(user_id as varchar)||'-'||cast(cast(ts as date) as varchar) as trace_id, user_id as member, event_id as seq, ts,
  case event_type when 'signup' then 'start' when 'view' then 'search' when 'click' then 'read' when 'purchase' then 'answer' else 'error' end as type,
  event_id % 40 as doc_id, event_id % 5 = 0 as zero_hit from events""",
    "v_html_tables": """select o_custkey as id, '<table><tr><th>key</th><th>status</th></tr>'||string_agg(
  '<tr><td>'||cast(o_orderkey as varchar)||'</td><td>'||o_orderstatus||'</td></tr>', '' order by o_orderkey)||'</table>' as content from orders group by o_custkey""",
}
_NEEDS = {"v_conversions": ["v_scan_1"], "v_expected": ["v_documents"]}


def with_views(body: str, *names: str) -> str:
    """DuckDB SQL of body with the named views in front."""
    order: list[str] = []
    for n in names:
        order += [x for x in [*_NEEDS.get(n, []), n] if x not in order]
    head = ",\n".join(f"{n} as ({SQL[n]})" for n in order)
    body = body.strip()
    return f"with {head},\n{body[4:].strip()}" if body.lower().startswith("with") else f"with {head}\n{body}"
