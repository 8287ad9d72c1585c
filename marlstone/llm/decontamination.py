"""Benchmark decontamination: a prefix-filtered set join of item windows with documents.

Every window of an item is a set of word shingles. Shingles are ordered by rarity in the documents; since a
window must be contained whole, its prefix is its one rarest shingle. Documents are posted under the shingles that are
some window's prefix, at the places that leave room for the window before and behind (positional and length bounds).
Postings and windows are joined on the shingle, and the words of the window are compared in the same join, so that a
shingle that many windows and many documents share never pairs those that differ.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from marlstone.llm.common import columns_of, fresh, key_filter, materialize, table
from marlstone.llm.wordhash import ALNUM, U, Words, mix, shingles, words_of

WINDOW = 10
SHINGLE = 5
#: Bits of the filters of shingles that documents are held against before the joins.
FILTER_BITS = 25
#: Texts that are hashed together in a task.
ROWS = 256
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_words(text: str | None) -> list[bytes]:
    """The words of a text, A-Z lower-cased (bytes.lower knows no others)."""
    return _WORD.findall((text or "").encode("utf-8", "replace").lower())


def _shingles(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of k words and where they begin; runs of different lengths differ."""
    s, at = shingles(words, k)
    return mix(s + U(k)).view(np.int64), at


def item_windows(items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """item_id, w (the words, a blank between), n (words) and s (shingles in order): the windows of each item. An item
    with fewer words than a window is one window, an item without words or without an id none."""
    schema = StructType([items.schema["item_id"], *StructType.fromDDL("w string, n int, s array<long>")])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        for b in batches:
            texts, out = b.column("text").to_pylist(), []
            hashed = words_of(texts, ALNUM)
            for i, item in enumerate(b.column("item_id").to_pylist()):
                words, own = plain_words(texts[i]), hashed.of(i)
                for j in range(max(1, len(words) - window + 1)) if words else ():
                    w = own[j : j + window]
                    s, _ = _shingles(Words(w, np.array([0, len(w)])), min(shingle, len(w)))
                    out.append({"item_id": item, "w": b" ".join(words[j : j + window]).decode("utf-8", "replace"), "n": len(w), "s": s.tolist()})
            yield pa.RecordBatch.from_pylist(out, schema=to_arrow_schema(schema))

    return items.where("item_id is not null").select("item_id", "text").mapInArrow(cut, schema)


def shingle_counts(docs: DataFrame, parts: DataFrame, shingle: int) -> DataFrame:
    """s and df: how often shingles occur in docs(text), for all shingles of parts(s) that do and, by the filter's false hits, some others."""
    keep = key_filter(parts, "s", FILTER_BITS)
    sizes = [r.k for r in parts.select("k").distinct().collect()]  # 1 to `shingle`

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, ROWS):
                w = words_of(whole.column("text").slice(lo, ROWS).to_pylist(), ALNUM)
                for k in sizes:
                    s, _ = _shingles(w, k)
                    u, n = np.unique(s[keep(s)], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(n, pa.int64())], names=["s", "n"])

    return docs.select("text").mapInArrow(count, "s long, n long").groupBy("s").agg(F.sum("n").alias("df"))


def window_prefixes(docs: DataFrame, items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """w, n, k, s, o and items: each distinct window all of whose shingles occur in docs, with its rarest one, the
    shingle's length and place, and the sorted names of its items."""
    wins = materialize(item_windows(items, window, shingle), "windows")
    k = F.least(F.lit(shingle), F.col("n")).alias("k")
    parts = materialize(wins.select("w", "n", "s").distinct().select("w", "n", k, F.posexplode("s").alias("o", "s")), "window-shingles")
    rarest = parts.join(shingle_counts(docs, parts, shingle), "s", "left").groupBy("w", "n", "k").agg(
        F.min(F.struct("df", "s", "o")).alias("p"), F.count("df").alias("found"), F.count("*").alias("all")).where("found = all")
    owners = wins.groupBy("w").agg(F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    return materialize(rarest.join(owners, "w").select("w", "n", "k", F.col("p.s").alias("s"), F.col("p.o").alias("o"), "items"), "prefixes")


def postings(docs: DataFrame, prefixes: DataFrame) -> DataFrame:
    """One row for each row of docs(doc_id, text) with n_words and s null, and one for each place of a document at which a
    window can stand by its prefix: s, start and w (the words there). k1 and k2 are hashes of the text."""
    keep = key_filter(prefixes, "s", FILTER_BITS)
    room = [(r.k, r.n, r.o) for r in prefixes.select("k", "n", "o").distinct().collect()]  # a few dozen at most
    schema = StructType([docs.schema["doc_id"], *StructType.fromDDL("k1 long, k2 long, n_words long, s long, start int, n int, w string")])

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, ROWS):
                b = whole.slice(lo, ROWS)
                texts = b.column("text").to_pylist()
                hashed, found = words_of(texts, ALNUM), []
                text_of = hashed.texts()
                for k in sorted({k for k, _, _ in room}):
                    s, at = _shingles(hashed, k)
                    hit = np.flatnonzero(keep(s))
                    for n, o in [(n, o) for kk, n, o in room if kk == k]:
                        t = text_of[at[hit]]
                        start = at[hit] - o
                        fits = (start >= hashed.ptr[t]) & (start + n <= hashed.ptr[t + 1])
                        found += zip(t[fits].tolist(), (start - hashed.ptr[t])[fits].tolist(), s[hit][fits].tolist(), [n] * int(fits.sum()), strict=True)
                rows, last, words = [], -1, []
                for t, start, x, n in sorted(found):
                    if t != last:
                        last, words = t, plain_words(texts[t])
                    rows.append((t, x, start, n, b" ".join(words[start : start + n]).decode("utf-8", "replace")))
                size = len(texts)
                take = pa.array([*range(size), *(r[0] for r in rows)], pa.int64())
                none = [None] * size
                yield pa.RecordBatch.from_arrays([
                    *(b.column(c).take(take) for c in ("doc_id", "k1", "k2")), pa.array(np.diff(hashed.ptr)).take(take),
                    *(pa.array([*none, *(r[i] for r in rows)], kind) for i, kind in ((1, pa.int64()), (2, pa.int32()), (3, pa.int32()), (4, pa.string())))],
                    names=schema.names)

    return docs.select("doc_id", "text", *_keys()).mapInArrow(probe, schema)


def _keys(first: str = "k1", second: str = "k2"):
    """Two hashes by which a text is known; equal texts are judged alike."""
    return [F.xxhash64("text").alias(first), F.xxhash64(F.lit(1), "text").alias(second)]


def _hits(posted: DataFrame, prefixes: DataFrame) -> DataFrame:
    """k1, k2, start, n and items: the windows that stand in a text, once for equal texts."""
    places = posted.where("s is not null").select("k1", "k2", "s", "start", "w").distinct()
    return places.join(prefixes, ["s", "w"]).select("k1", "k2", "start", "n", "items")


def find_leaks(docs: DataFrame, items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items (sorted as strings), spans and contaminated for every row of docs.

    spans are the hit ranges of words as starts and ends. Null and empty texts have no words. Repeated ids and
    rows are judged each by itself; null item ids are left out; extra columns are ignored. Without windows
    nothing is hit. An empty table gives an empty result.
    """
    prefixes = window_prefixes(docs, items, window, shingle)
    posted = materialize(postings(docs, prefixes), "postings")
    hits = materialize(_hits(posted, prefixes), "hits")
    along = Window.partitionBy("k1", "k2").orderBy("start", "n")
    before = F.max(F.col("start") + F.col("n")).over(along.rowsBetween(Window.unboundedPreceding, -1))
    begun = hits.select("k1", "k2", "start", "n", (before.isNull() | (F.col("start") > before)).cast("int").alias("new"))
    ranges = begun.withColumn("no", F.sum("new").over(along.rowsBetween(Window.unboundedPreceding, 0))).groupBy("k1", "k2", "no").agg(
        F.min("start").alias("a"), F.max(F.col("start") + F.col("n")).alias("b"))
    spans = ranges.groupBy("k1", "k2").agg(F.sum(F.col("b") - F.col("a")).alias("n_hit"), F.flatten(F.transform(
        F.sort_array(F.collect_list(F.struct("a", "b"))), lambda x: F.array(x["a"], x["b"]))).alias("spans"))
    owners = hits.select("k1", "k2", F.explode("items").alias("item")).groupBy("k1", "k2").agg(F.sort_array(F.collect_set("item")).alias("items"))
    judged = posted.where("s is null").select("doc_id", "k1", "k2", "n_words").join(spans.join(owners, ["k1", "k2"]), ["k1", "k2"], "left")
    return judged.select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.size(F.coalesce("items", F.array().cast("array<string>"))).cast("long").alias("n_items"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"), F.coalesce("spans", F.array().cast("array<int>")).alias("spans"),
        F.col("n_hit").isNotNull().alias("contaminated"))


def remove_leaks(docs: DataFrame, items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """The rows of docs without any window of an item, with the columns of docs, whatever their names."""
    prefixes = window_prefixes(docs, items, window, shingle)
    posted = materialize(postings(docs, prefixes).where("s is not null"), "postings")
    a, b = fresh("k1", docs.columns), fresh("k2", docs.columns)
    leaking = _hits(posted, prefixes).select(F.col("k1").alias(a), F.col("k2").alias(b)).distinct()
    return docs.select("*", *_keys(a, b)).join(leaking, [a, b], "left_anti").select(*columns_of(docs))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


OP6_SQL = r"""
with w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as words
  from documents),
i as (
  select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as words
  from benchmark),
win as (
  select distinct item_id, array_to_string(words[p : p + 9], ' ') as win, least(len(words), 10) as n
  from (select item_id, words, unnest(range(1, greatest(2, len(words) - 8))) as p from i where len(words) > 0)),
sizes as (select distinct n from win),
wins as (
  select doc_id, n, p, array_to_string(words[p : p + n - 1], ' ') as win
  from (select doc_id, words, n, unnest(range(1, len(words) - n + 2)) as p from w, sizes where len(words) >= n)),
hit as (
  select doc_id, wins.n, p, item_id from wins join win on wins.win = win.win and wins.n = win.n),
marks as (
  select doc_id, count(distinct q) as n_hit from (select doc_id, unnest(range(p, p + n)) as q from hit) group by doc_id),
who as (
  select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items
  from (select distinct doc_id, cast(item_id as varchar) as item from hit) group by doc_id)
select w.doc_id, len(words)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
       sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from w left join marks using (doc_id) left join who using (doc_id)
"""

QUERIES = {"op6_decontamination": op6_decontamination}
ORACLES = {"op6_decontamination": OP6_SQL}
