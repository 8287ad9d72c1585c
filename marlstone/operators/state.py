"""The ingestion state machine: every transition is a join of a snapshot with the state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions import text as T
from marlstone.session import shared_dir

SUCCESS = ("converted", "quality_warned")
DIRECT = (".md", ".markdown", ".txt")
HEAVY = (".pdf", ".docx", ".doc", ".pptx", ".ppt")
CONVERTED = (*HEAVY, ".xlsx")


def route_format(df: DataFrame, path: str = "relative_path") -> DataFrame:
    """df with suffix, supported, converter (label or null) and origin (source or tool)."""
    s = T.suffix(path)
    converter = F.when(s.isin(".md", ".markdown"), "markdown-copy").when(s == ".txt", "text-decode").when(s == ".xlsx", "table-parts").when(
        s.isin(*HEAVY), "document-converter")
    return df.withColumns({
        "suffix": s, "supported": s.isin(*DIRECT, *CONVERTED), "converter": converter,
        "origin": F.when(s.isin(*DIRECT), "source").otherwise("tool")})


def cost_class(path: Column | str = "relative_path") -> Column:
    return T.suffix(path).isin(*HEAVY).cast("int")


def output_path(member: str, path: Column | str = "relative_path") -> Column:
    """members/<m>/<dir>/<stem>/<stem>.md"""
    parts = F.split(T.col(path), "/")
    folder = F.slice(parts, F.lit(1), F.size(parts) - 1)
    return F.array_join(F.concat(F.array(F.lit("members"), F.lit(member)), folder, F.array(T.stem(path), F.concat(T.stem(path), F.lit(".md")))), "/")


def exclude_sources(scan: DataFrame, excluded: DataFrame) -> DataFrame:
    """scan with status `ignored` and reason `excluded` for the excluded paths, null for others."""
    flag = excluded.select("relative_path", F.lit(True).alias("_x")).distinct()
    return scan.join(flag, "relative_path", "left").withColumns({
        "status": F.when(F.col("_x"), "ignored"), "reason": F.when(F.col("_x"), "excluded")}).drop("_x")


def upsert_sources(state: DataFrame, scan: DataFrame) -> DataFrame:
    """state(relative_path, size, sha256, status) merged with scan(relative_path, size, sha256): new sources are discovered, a status stays while the hash does.

    mtime is refreshed alike where either has it.
    """
    s, n = state.alias("s"), scan.alias("n")
    times = [f"{side}.mtime" for side, df in (("n", scan), ("s", state)) if "mtime" in df.columns]
    same = F.col("s.sha256") == F.col("n.sha256")
    return s.join(n, F.col("s.relative_path") == F.col("n.relative_path"), "full").select(
        F.coalesce("n.relative_path", "s.relative_path").alias("relative_path"), F.coalesce("n.size", "s.size").alias("size"),
        F.coalesce("n.sha256", "s.sha256").alias("sha256"),
        F.when(F.col("n.relative_path").isNull() | same, F.col("s.status")).otherwise("discovered").alias("status"),
        *([F.coalesce(*times).alias("mtime")] if times else []))


def conversion_reason(scan: DataFrame, conversions: DataFrame) -> DataFrame:
    """scan(relative_path, sha256) with the first reason that applies."""
    c = conversions.select("relative_path", F.col("source_sha256").alias("_sha"), F.col("status").alias("_status"), F.col("output_exists").alias("_out"))
    ok = route_format(scan).join(c, "relative_path", "left")
    reason = (
        F.when(~F.col("supported"), "unsupported").when(F.col("_sha").isNull(), "new_source").when(F.col("_sha") != F.col("sha256"), "source_changed")
        .when(~F.col("_status").isin(*SUCCESS), "previous_failed").when(~F.coalesce("_out", F.lit(False)), "output_missing").otherwise("unchanged"))
    return ok.select("relative_path", "sha256", reason.alias("reason"))


def backfill_status(sources: DataFrame, conversions: DataFrame) -> DataFrame:
    """sources with the status of the conversion of the same path and hash, and whether it changed."""
    c = conversions.select("relative_path", F.col("source_sha256").alias("sha256"), F.col("status").alias("_new"))
    changed = F.col("_new").isNotNull() & (F.col("_new") != F.col("status"))
    return sources.join(c, ["relative_path", "sha256"], "left").select(
        "relative_path", "sha256", F.coalesce("_new", "status").alias("status"), changed.alias("changed"))


def mark_missing(state: DataFrame, scan: DataFrame) -> DataFrame:
    """state with status `source_missing` where the scan has no such path."""
    here = scan.select("relative_path", F.lit(True).alias("_here")).distinct()
    return state.join(here, "relative_path", "left").withColumn(
        "status", F.when(F.col("_here").isNull(), "source_missing").otherwise(F.col("status"))).drop("_here")


def recover_stale(conversions: DataFrame, now: Column, minutes: int = 60) -> DataFrame:
    """conversions that have been processing for longer become retryable, with a reason and an error if they had none."""
    stale = (F.col("status") == "processing") & (F.col("updated_at") < now - F.make_dt_interval(mins=F.lit(minutes)))
    out = conversions.withColumn("_stale", stale)
    for c, text in (("reason", "stale_recovered"), ("error_message", "processing was interrupted")):
        before = F.col(c) if c in conversions.columns else F.lit(None).cast("string")
        value = F.lit(text) if c == "reason" else F.coalesce(before, F.lit(text))
        out = out.withColumn(c, F.when(F.col("_stale"), value).otherwise(before))
    return out.withColumn("status", F.when(F.col("_stale"), "failed_retryable").otherwise(F.col("status"))).drop("_stale")


#: Rows that one task numbers, about.
RANGE_ROWS = 1_000_000


def global_row_number(df: DataFrame, *order: Column | str, ranges: int | None = None) -> DataFrame:
    """df with `n`, its place from 1 in a total order, without one task that sees all rows.

    Rows are dealt into ranges of the order and written with their range, so that counting and numbering see the same
    ranges; counts give offsets, and each range is numbered by itself.
    """
    spark = df.sparkSession
    path = shared_dir(spark)
    ranges = ranges or max(1, -(-df.count() // RANGE_ROWS))
    df.repartitionByRange(ranges, *order).withColumn("_range", F.spark_partition_id()).write.parquet(path)
    ranged = spark.read.parquet(path)
    counts = ranged.groupBy("_range").agg(F.count("*").alias("_k"))  # one row for each range
    along = Window.orderBy("_range")
    offsets = counts.withColumn("_before", F.sum("_k").over(along) - F.col("_k")).select("_range", "_before")
    inside = Window.partitionBy("_range").orderBy(*order)
    numbered = ranged.withColumn("_i", F.row_number().over(inside))
    return numbered.join(offsets, "_range").withColumn("n", (F.col("_before") + F.col("_i")).cast("long")).drop("_range", "_i", "_before")


def place_in_group(df: DataFrame, group: str, *order: Column | str) -> DataFrame:
    """df with `place`, from 1 in a total order of each group, however few and large the groups are. Groups are not null."""
    numbered = global_row_number(df, F.col(group), *order)
    first = numbered.groupBy(group).agg(F.min("n").alias("_first"))
    return numbered.join(first, group).withColumn("place", F.col("n") - F.col("_first") + 1).drop("n", "_first")


def plan_batches(pending: DataFrame, size: int, lanes: bool = True, path: str = "relative_path") -> DataFrame:
    """pending with its batch number: light formats first (lanes), then by path."""
    key = F.concat(cost_class(path).cast("string"), F.lower(T.col(path))) if lanes else F.lower(T.col(path))
    keyed = pending.withColumn("_order", key)
    numbered = global_row_number(keyed, F.col("_order"), T.col(path))
    return numbered.withColumn("batch", F.floor((F.col("n") - 1) / size) + 1).drop("_order")


def gate(docs: DataFrame) -> DataFrame:
    """docs(origin, errors, credentials_ok, failure) with the status that they enter the state with."""
    bad = F.size("errors") > 0
    tool = F.col("origin") == "tool"
    return docs.withColumn("status", F.when(F.col("failure").isNotNull(), "failed_retryable").when(tool & bad, "quality_failed").when(
        ~F.col("credentials_ok"), "blocked_secret").when(bad, "quality_warned").otherwise("converted"))


def new_feedback(findings: DataFrame, feedback: DataFrame) -> DataFrame:
    """findings without an unresolved record of the same hash and category; one of each."""
    open_ = feedback.where("review_status <> 'resolved'").select("source_sha256", "category").distinct()
    return findings.dropDuplicates(["source_sha256", "category"]).join(open_, ["source_sha256", "category"], "left_anti")


def run_summary(reasons: DataFrame, statuses: DataFrame, planned: DataFrame | None = None, indexed: DataFrame | None = None) -> DataFrame:
    """One row: how a run went, with the counts by reason as a map.

    batches are those of planned(batch), indexed the documents that stand in the index after the actions of indexed(action); each is
    left out without its frame.
    """
    r = reasons.groupBy("reason").agg(F.count("*").alias("n"))
    of = lambda *names: F.coalesce(F.sum(F.when(F.col("reason").isin(*names), F.col("n"))), F.lit(0)).cast("long")
    left = r.agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("scanned"),
        of("new_source", "source_changed", "previous_failed", "output_missing").alias("queued"),
        of("unchanged", "unsupported", "excluded").alias("skipped"),
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("reason", "n")))).alias("reason_counts"))
    right = statuses.agg(
        F.count_if(F.col("status").isin(*SUCCESS)).alias("converted"), F.count_if(F.col("status") == "quality_warned").alias("warned"),
        F.count_if(F.col("status").isin("quality_failed", "failed_retryable", "blocked_secret")).alias("failed"),
        F.count_if(F.col("status") == "source_missing").alias("missing"))
    if planned is not None:
        right = right.crossJoin(planned.agg(F.countDistinct("batch").alias("batches")))
    if indexed is not None:
        right = right.crossJoin(indexed.agg(F.count_if(F.col("action") != "delete").alias("indexed")))
    return left.crossJoin(right)  # one row each


def refresh_index(docs: DataFrame, index: DataFrame) -> DataFrame:
    """path, content_sha256 and action (add, update, keep, delete) of each document of the folder or the index."""
    d, i = docs.select("path", F.col("content_sha256").alias("_new")), index.select("path", F.col("content_sha256").alias("_old"))
    action = F.when(F.col("_old").isNull(), "add").when(F.col("_new").isNull(), "delete").when(F.col("_old") != F.col("_new"), "update").otherwise("keep")
    return d.join(i, "path", "full").select("path", F.coalesce("_new", "_old").alias("content_sha256"), action.alias("action"))


def status_overview(sources: DataFrame, conversions: DataFrame) -> DataFrame:
    """kind, name, n: sources by status, their total, open issues and open warnings."""
    by = sources.groupBy(F.lit("source").alias("kind"), F.col("status").alias("name")).agg(F.count("*").alias("n"))
    total = sources.agg(F.count("*").alias("n")).select(F.lit("total").alias("kind"), F.lit("sources").alias("name"), "n")
    issues = conversions.agg(F.count_if(~F.col("status").isin(*SUCCESS)).alias("n")).select(F.lit("open").alias("kind"), F.lit("issues").alias("name"), "n")
    warned = conversions.agg(F.count_if(F.col("status") == "quality_warned").alias("n")).select(F.lit("open").alias("kind"), F.lit("warnings").alias("name"), "n")
    return by.union(total).union(issues).union(warned)


def non_success(conversions: DataFrame) -> DataFrame:
    return conversions.where(~F.col("status").isin(*SUCCESS)).select("relative_path", "status", F.substring(F.coalesce("error_message", F.lit("")), 1, 400).alias("error"))


def warned(conversions: DataFrame) -> DataFrame:
    return conversions.where("status = 'quality_warned'").select("relative_path", "status", F.substring(F.coalesce("warning_message", F.lit("")), 1, 400).alias("warning"))


def split_converter_version(version: Column | str) -> tuple[Column, Column]:
    """name and version, split at the first dash; without one all is the name."""
    parts = F.split(T.col(version), "-", 2)
    return F.get(parts, F.lit(0)), F.coalesce(F.get(parts, F.lit(1)), F.lit(""))


def relative_path(path: Column | str, root: str) -> Column:
    """What follows root, or nothing: absolute paths never leak."""
    p = T.col(path)
    base = root.rstrip("/") + "/"
    return F.when(F.startswith(p, F.lit(base)), F.substring(p, F.lit(len(base) + 1), F.lit(2147483647))).otherwise("")


def guard_paths(df: DataFrame, suffixes: tuple[str, ...] = (".md", ".markdown"), path: str = "path") -> DataFrame:
    """df with `reason` why a path may not be read: it escapes members/ once . and .. are folded, or has another suffix; null if it may."""
    folded = F.aggregate(F.split(T.col(path), "/"), F.array().cast("array<string>"), lambda a, x: F.when(x.isin("", "."), a).when(
        (x == "..") & (F.size(a) > 0) & (F.element_at(F.concat(F.array(F.lit("")), a), -1) != ".."), F.slice(a, F.lit(1), F.size(a) - 1)).otherwise(F.concat(a, F.array(x))))
    inside = T.let(folded, lambda f: (F.get(f, F.lit(0)) == "members") & (F.size(f) > 1))
    reason = F.when(F.startswith(T.col(path), F.lit("/")) | ~F.coalesce(inside, F.lit(False)), "outside members").when(~T.suffix(path).isin(*suffixes), "wrong suffix")
    return df.withColumn("reason", reason)


def source_registry(conversions: DataFrame, sources: DataFrame, root: str = "members") -> DataFrame:
    """One row for each conversion: bytes of its source, converter and version apart, its output below the root."""
    name, version = split_converter_version("converter_version")
    size = sources.select("relative_path", F.col("size").alias("source_bytes"))
    return conversions.join(size, "relative_path", "left").select(
        "relative_path", "source_sha256", "source_bytes", name.alias("converter"), version.alias("version"), "status",
        F.concat(F.lit(f"{root}/"), relative_path(F.concat(F.lit("/repo/"), "relative_path"), "/repo")).alias("output_path"))


def knowledge_registry(docs: DataFrame, registry: DataFrame, images: DataFrame) -> DataFrame:
    """path, title, bytes, images (files in the sibling images folder), the source's hash or nothing, and, where the registry has it, converted_at or nothing."""
    folder = lambda c: F.regexp_replace(c, r"/[^/]*$", "")
    n = images.groupBy(F.regexp_replace("path", r"/images/[^/]*$", "").alias("_dir")).agg(F.count("*").alias("images"))
    said = [c for c in ("source_sha256", "converted_at") if c in registry.columns]
    src = registry.select("path", *said)
    return docs.withColumn("_dir", folder(F.col("path"))).join(n, "_dir", "left").join(src, "path", "left").select(
        "path", "title", F.octet_length("content").cast("long").alias("bytes"), F.coalesce("images", F.lit(0)).alias("images"), *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in said])


def stratified_sample(conversions: DataFrame, per_type: int = 6) -> DataFrame:
    """Successes of each suffix, evenly spaced along the path."""
    ok = conversions.where(F.col("status").isin(*SUCCESS)).withColumn("file_type", T.suffix("relative_path"))
    n = ok.groupBy("file_type").agg(F.count("*").alias("_n"))
    step = F.greatest(F.lit(1), F.floor(F.col("_n") / per_type))
    placed = place_in_group(ok, "file_type", "relative_path").join(n, "file_type").withColumn("_i", F.col("place") - 1)
    return placed.where((F.col("_i") % step == 0) & (F.col("_i") / step < per_type)).select("relative_path", "file_type", "status")
