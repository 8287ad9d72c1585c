"""Sessions of messages: lists, titles, buckets, history, search and deletion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions import text as T
from marlstone.operators import search as S
from marlstone.operators.state import place_in_group


def searchable_text(payload: Column | str) -> Column:
    """The first of content and message in a JSON payload that is not blank; null for steps of tools."""
    p = T.col(payload)
    pick = lambda k: F.nullif(T.strip(F.get_json_object(p, f"$.{k}")), F.lit(""))
    return F.when(F.coalesce(F.get_json_object(p, "$.type"), F.lit("")).isin("tool_call", "tool_result", "process"), None).otherwise(F.coalesce(pick("content"), pick("message")))


def session_list(messages: DataFrame) -> DataFrame:
    """session_id, updated (last message), n_messages and title (of the first question)."""
    first = F.min_by("content", F.when(F.col("kind") == "user", F.col("message_id")))
    return messages.groupBy("session_id").agg(F.max("message_id").alias("updated"), F.count("*").alias("n_messages"), first.alias("_q")).withColumn(
        "title", T.session_title("_q")).drop("_q")


def histories(messages: DataFrame) -> DataFrame:
    """messages with their place in their session, those with a payload that is no JSON left out if there is a payload."""
    own = messages.where(F.try_parse_json("payload").isNotNull()) if "payload" in messages.columns else messages
    return own.withColumn("place", F.row_number().over(Window.partitionBy("session_id").orderBy("message_id")))


def history(messages: DataFrame, session_id: int) -> DataFrame:
    """The messages of a session in order."""
    return histories(messages.where(F.col("session_id") == session_id)).orderBy("place").drop("place")


def delete_sessions(table: DataFrame, ids: DataFrame) -> DataFrame:
    """What is left of a table (sessions, messages or their index) without the sessions of ids."""
    return table.join(ids.select("session_id").distinct(), "session_id", "left_anti")


def search_messages(messages: DataFrame, queries: DataFrame, limit: int = 20) -> DataFrame:
    """query_id, session_id, message_id, score, rank, snippet, title: any expanded token, BM25 over message texts; steps of tools are left out.

    Queries of the same text are answered once and get their rows at the end; a hit meets the tokens of its query last.
    """
    n = max(1, min(100, limit))
    said = messages.where("kind <> 'process'").withColumn("_key", F.col("message_id"))
    pairs = F.array_join(F.flatten(F.transform(F.regexp_extract_all(F.coalesce("content", F.lit("")), F.lit(r"[一-鿿]{3,}"), F.lit(0)), T.cjk_pairs)), " ")
    expanded = said.select("message_id", F.concat_ws(" ", "content", F.nullif(pairs, F.lit(""))).alias("content"))
    asked, members = S.alike(queries)
    hits = S.match_any(S.Index(expanded, {"content": 1.0}, key="message_id"), asked, n)
    tokens = asked.select("query_id", T.expanded_tokens("text").alias("_t"))
    titles = session_list(messages).select("session_id", "title")
    found = hits.join(said.select("message_id", "session_id", "content"), "message_id").join(titles, "session_id").join(tokens, "query_id")
    return S.for_all(found.select("query_id", "session_id", "message_id", "score", "rank", T.message_snippet("content", F.col("_t")).alias("snippet"), "title"), members)


def session_buckets(sessions: DataFrame, now: Column, keyword: str = "") -> DataFrame:
    """sessions(session_id, title, updated_at) whose title contains keyword, with bucket and place in it (newest first)."""
    days = F.datediff(F.to_date(now), F.to_date("updated_at"))
    bucket = F.when(days <= 0, "today").when(days == 1, "yesterday").when(days < 7, "week").otherwise("older")
    found = sessions.where(F.contains(F.lower("title"), F.lit(keyword.lower()))).withColumn("bucket", bucket)
    return place_in_group(found, "bucket", F.desc("updated_at"), F.desc("session_id"))
