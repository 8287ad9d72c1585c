"""Structured Streaming twins of the batch operators."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions import text as T
from marlstone.operators import state as S
from marlstone.sources import parts as P

TRACE = """trace_id string, member long, n_steps long, n_zero long, retrieved array<string>, zero_hit_queries array<string>, citations array<string>,
  answer string, failed boolean, closed_by string, ended_millis long"""
#: Traces are held and folded in so many groups by the hash of their id, as a call for each trace would cost more than its events.
TRACE_GROUPS = 4096
#: Events of a trace are held as JSON lists of these fields.
_HELD = ("seq", "millis", "member", "type", "path", "query", "content", "citations")


def _plain(v):
    """A value of pandas as JSON has it."""
    if v is None or isinstance(v, str):
        return v
    if hasattr(v, "tolist"):
        return v.tolist()
    return list(v) if isinstance(v, (list, tuple)) else None if v != v else int(v)


def _fold_events(trace_id: str, events: list[dict], closed_by: str) -> dict:
    """The row of a trace, whatever the order in which its events came."""
    events = sorted(events, key=lambda e: (e["seq"], e["millis"]))
    searches = [e for e in events if e["type"] == "search"]
    answers = [e for e in events if e["type"] == "answer"]
    missed = [e for e in searches if e["path"] is None]
    return {
        "trace_id": trace_id, "member": min((e["member"] for e in events if e["member"] is not None), default=None),
        "n_steps": len(searches) + sum(e["type"] == "read" for e in events), "n_zero": len(missed),
        "retrieved": list(dict.fromkeys(e["path"] for e in searches if e["path"] is not None)),
        "zero_hit_queries": [e["query"] for e in missed if e["query"] is not None],
        "citations": list(dict.fromkeys((answers[-1]["citations"] or []) if answers else [])), "answer": answers[-1]["content"] if answers else None,
        "failed": any(e["type"] == "error" for e in events), "closed_by": closed_by, "ended_millis": max(e["millis"] for e in events)}


def _ends(events: list[dict]) -> str | None:
    """What ends a trace of which no event can be missing: numbered from 0 or 1 without a gap up to its answer or error."""
    last = max(events, key=lambda e: e["seq"])
    numbers = {e["seq"] for e in events}
    whole = min(numbers) in (0, 1) and len(numbers) == last["seq"] - min(numbers) + 1
    return last["type"] if whole and last["type"] in ("answer", "error") else None


def stream_traces(events: DataFrame, idle: str = "30 minutes") -> DataFrame:
    """One row for each finished trace of a stream of events(trace_id, member, seq, ts, type, path, citations, content and, if
    there is one, query), with the signals of the batch fold: queries without hits, what was cited and not retrieved, or
    retrieved and not used, the answer's length, and whether an answer cites nothing. Notices are ignored.

    Events may come in any order within `idle`: a trace is held and folded in order of seq, at once when it is numbered
    without gaps up to its answer or error, else when the watermark, `idle` behind the latest event, has passed its last
    event by `idle`. Events that come after that make a row of their own. What is held grows with the traces that are open, and lies in TRACE_GROUPS
    groups; a batch rewrites the groups that it has events of.
    """
    wait = int(pd.Timedelta(idle).total_seconds() * 1000)

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held: dict[str | None, list[dict]] = {}
        fresh: set[str | None] = set()
        for line in state.get[0] if state.exists else []:
            trace, events = json.loads(line)
            held[trace] = [dict(zip(_HELD, e)) for e in events]
        if not state.hasTimedOut:
            for pdf in batches:
                for trace, *values in zip(pdf["trace_id"].tolist(), *(pdf[k].tolist() for k in _HELD)):
                    fresh.add(trace)
                    held.setdefault(trace, []).append(dict(zip(_HELD, map(_plain, values))))
        done = []
        for trace in list(held):
            late = trace not in fresh and max(e["millis"] for e in held[trace]) + wait < state.getCurrentWatermarkMs()
            if end := "timeout" if late else trace in fresh and _ends(held[trace]):
                done.append(_fold_events(trace, held.pop(trace), end))
        if held:
            state.update(([json.dumps([trace, [[e[k] for k in _HELD] for e in events]]) for trace, events in held.items()],))
            state.setTimeoutTimestamp(min(max(e["millis"] for e in events) for events in held.values()) + wait)
        elif state.exists:
            state.remove()
        if done:
            yield pd.DataFrame(done)

    asked = events if "query" in events.columns else events.withColumn("query", F.lit(None).cast("string"))
    told = asked.where("type <> 'notice'").withWatermark("ts", idle).select("trace_id", "ts", F.unix_millis("ts").alias("millis"), *[c for c in _HELD if c != "millis"]).withColumn(
        "_g", F.pmod(F.xxhash64("trace_id"), F.lit(TRACE_GROUPS)))
    folded = told.groupBy("_g").applyInPandasWithState(fold, TRACE, "events array<string>", "append", "EventTimeTimeout")
    said = F.coalesce("answer", F.lit(""))
    return folded.withColumns({
        "cited_not_retrieved": F.array_except("citations", "retrieved"), "retrieved_but_unused": F.slice(F.array_except("retrieved", "citations"), 1, 10),
        "answer_chars": F.length(said), "no_hit_answer": (said != "") & (F.size("citations") == 0),
        "ended_at": F.timestamp_millis("ended_millis")}).drop("ended_millis")


def usage_days(traces: DataFrame) -> DataFrame:
    """The batch twin of stream_usage."""
    return traces.groupBy(F.to_date("ts").alias("day"), "member").agg(
        F.count("*").alias("traces"), F.count_if(F.col("n_zero") > 0).alias("zero_hit_traces"), F.count_if(F.col("n_citations") > 0).alias("cited"))


def stream_usage(traces: DataFrame, late: str = "1 day") -> DataFrame:
    """day, member, traces, zero_hit_traces, cited of a stream of traces(ts, member, n_zero, n_citations); days close when the watermark passes."""
    day = F.window("ts", "1 day")
    counted = traces.withWatermark("ts", late).groupBy(day, "member").agg(
        F.count("*").alias("traces"), F.count_if(F.col("n_zero") > 0).alias("zero_hit_traces"), F.count_if(F.col("n_citations") > 0).alias("cited"))
    return counted.select(F.to_date("window.start").alias("day"), "member", "traces", "zero_hit_traces", "cited")


def stream_ingest(spark: SparkSession, folder: str, on_batch: Callable[[DataFrame, int], None], checkpoint: str, max_files: int = 1000):
    """Hand new files (relative_path below folder, size, sha256, mtime) to on_batch, max_files at a time, until none is left; the
    checkpoint resumes after a crash.

    The file source knows paths: files edited in place and deleted ones are found by comparing scans.
    """
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option(
        "recursiveFileLookup", True).option("maxFilesPerTrigger", max_files).load(folder)
    below = F.regexp_replace("path", "^[a-z]+:/*", "/")
    root = re.sub("^[a-z]+:/*", "/", folder).rstrip("/") + "/"
    rows = files.select(F.replace(below, F.lit(root), F.lit("")).alias("relative_path"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"), F.col("modificationTime").alias("mtime"))
    return rows.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(on_batch).start()


SOURCES = "relative_path string, size long, sha256 string, status string, mtime timestamp"
#: Sources in a bucket at most, on average; the number of buckets doubles when there are more.
BUCKET_ROWS = 1_000_000


def sources_of(spark: SparkSession, state: str) -> DataFrame:
    """The table of sources that merge_into and mark_missing_into keep below `state`."""
    return P.read_parts(spark, state, SOURCES)


def _rewrite(spark: SparkSession, state: str, run: str, keys: DataFrame, change: Callable[[DataFrame], DataFrame], schema: str = SOURCES) -> list[str]:
    """Rewrite the buckets that hold the keys (one column), with what `change` makes of their rows; the buckets written.

    Twice as many buckets, when the rows outgrow them, touch all once; that is as often as the table has doubled.
    """
    at = P.current(spark, state)
    if at["run"] == run:
        return []  # a batch that is repeated after it was committed
    n, rows = at.get("buckets", 1), at.get("rows", 0)
    grown = n
    while rows + keys.count() > grown * BUCKET_ROWS:
        grown *= 2
    bucket = lambda k: F.pmod(F.xxhash64(keys.columns[0]), F.lit(k)).cast("int")
    hit = {str(r[0]) for r in keys.select(bucket(n)).distinct().collect()}  # as many as buckets, at most
    if not hit:
        return []
    touched = sorted(hit) if grown == n else sorted(at["parts"])
    before = P.read_parts(spark, state, schema, touched)
    now = change(before).withColumn("bucket", bucket(grown))
    return P.replace_parts(now, state, run, "bucket", touched, buckets=grown, rows=rows + now.count() - before.count())


def _arrived(spark: SparkSession, state: str, batch: DataFrame) -> DataFrame:
    """The rows of a batch, written once below `state` by the tasks that read them: what follows is no plan of the stream's, so that it
    has as many tasks as so few rows need, and not as many as a shuffle may have."""
    batch.write.mode("overwrite").parquet(f"{state}/arrived")
    return spark.read.schema(batch.schema).parquet(f"{state}/arrived")


def merge_into(spark: SparkSession, state: str, conversions: DataFrame | Callable[[], DataFrame] | None = None, on_due: Callable[[DataFrame, int], None] | None = None) -> Callable[[DataFrame, int], None]:
    """A function for stream_ingest that merges each batch into the table of sources below `state`.

    on_due gets (relative_path, sha256, reason) of the batch's sources that are to be converted: those that are new or changed,
    whose last conversion failed, or whose output is missing, by conversions(relative_path, source_sha256, status, output_exists). It may
    convert, gate and index them; `conversions` as a function is asked again afterwards, and statuses are taken from it.

    The table lies in buckets by path; a batch rewrites the buckets that it touches. One that breaks off leaves the table before,
    and is repeated by the checkpoint; on_due may then see its sources again.
    """
    known = conversions if callable(conversions) else lambda: conversions

    def merge(batch: DataFrame, epoch: int) -> None:
        new = _arrived(spark, state, batch).dropDuplicates(["relative_path"])
        if on_due is not None and P.current(spark, state)["run"] != f"batch-{epoch}":
            c = known()
            c = spark.createDataFrame([], "relative_path string, source_sha256 string, status string, output_exists boolean") if c is None else c
            on_due(S.conversion_reason(new, c).where("reason not in ('unsupported', 'unchanged')"), epoch)

        def change(before: DataFrame) -> DataFrame:
            now = S.upsert_sources(before, new)
            if known() is None:
                return now
            status = S.backfill_status(now, known()).select("relative_path", F.col("status").alias("_s"))
            return now.join(status, "relative_path").withColumn("status", F.col("_s")).drop("_s")

        _rewrite(spark, state, f"batch-{epoch}", new.select("relative_path"), change)

    return merge


def mark_missing_into(spark: SparkSession, state: str, scan: DataFrame, run: str) -> list[str]:
    """Mark the sources below `state` that a whole scan does not have; buckets without such a source stay as they are."""
    here = scan.select("relative_path").distinct()
    gone = sources_of(spark, state).where("status <> 'source_missing'").join(here, "relative_path", "left_anti").select("relative_path")
    return _rewrite(spark, state, f"missing-{run}", gone, lambda before: S.mark_missing(before, here))


def stream_sessions(messages: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """session_id, opened, closed and n of bursts of messages(session_id, message_id, ts) that no longer gap parts; repeated messages count once."""
    once = messages.withWatermark("ts", late).dropDuplicatesWithinWatermark(["session_id", "message_id"])
    return once.groupBy(F.session_window("ts", gap), "session_id").agg(F.count("*").alias("n")).select(
        "session_id", F.col("session_window.start").alias("opened"), F.col("session_window.end").alias("closed"), "n")


def session_bursts(messages: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """The batch twin of stream_sessions."""
    return messages.dropDuplicates(["session_id", "message_id"]).groupBy(F.session_window("ts", gap), "session_id").agg(F.count("*").alias("n")).select(
        "session_id", F.col("session_window.start").alias("opened"), F.col("session_window.end").alias("closed"), "n")


HEADS = "session_id long, updated_at timestamp, first_id long, question string"


def _heads(messages: DataFrame) -> DataFrame:
    """The latest time and the first question of each session."""
    asked = F.when(F.col("kind") == "user", F.struct("message_id", "content"))
    return messages.groupBy("session_id").agg(F.max("ts").alias("updated_at"), F.min(asked).alias("_q")).select(
        "session_id", "updated_at", F.col("_q.message_id").alias("first_id"), F.col("_q.content").alias("question"))


def session_heads(messages: DataFrame) -> DataFrame:
    """session_id, updated_at and title of messages(session_id, message_id, kind, content, ts); sessions without an id are left out."""
    return _titled(_heads(messages.where("session_id is not null")))


def _titled(heads: DataFrame) -> DataFrame:
    return heads.select("session_id", "updated_at", T.session_title(F.coalesce("question", F.lit(""))).alias("title"))


def sessions_into(spark: SparkSession, state: str) -> Callable[[DataFrame, int], None]:
    """A function for foreachBatch that keeps the heads of sessions below `state` as messages arrive, in any order and repeated ones as well:
    the latest time and the first question. The table lies in buckets, as that of merge_into does."""

    def merge(batch: DataFrame, epoch: int) -> None:
        new = _heads(_arrived(spark, state, batch.where("session_id is not null"))).persist()

        def change(before: DataFrame) -> DataFrame:
            both = before.unionByName(new)
            first = F.min(F.when(F.col("first_id").isNotNull(), F.struct("first_id", "question")))
            return both.groupBy("session_id").agg(F.max("updated_at").alias("updated_at"), first.alias("_q")).select("session_id", "updated_at", "_q.first_id", "_q.question")

        _rewrite(spark, state, f"batch-{epoch}", new.select("session_id"), change, HEADS)
        new.unpersist()

    return merge


def sessions_of(spark: SparkSession, state: str) -> DataFrame:
    """session_id, updated_at and title of the sessions that sessions_into keeps below `state`."""
    return _titled(P.read_parts(spark, state, HEADS))
