"""Mixing sources to target weights by exact budgets of words.

Every document gets a hash-random key. Within a source the documents are range-sorted by that key
(ranges are prefixes of the uniform hash, so a hot source is spread over all of them), a distributed
prefix sum of sizes gives each document's place, and the source is cut at its budget: whole passes over
the source first, then the documents that lie before the cut, the last of them in part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlstone.llm.common import SPACE_CLASS, bits_for, table

WEIGHTS = (1, 2, 3)
MAX_EPOCHS = 3
#: Documents in one range of hash keys, about.
RANGE_ROWS = 50_000
LEAST_RANGES = 256


def n_words(text: Column) -> Column:
    """Words of a text, 0 for null."""
    parts = F.split(F.coalesce(text, F.lit("")), SPACE_CLASS + "+")
    edge = F.when(F.get(parts, F.lit(0)) == "", 1).otherwise(0) + F.when(
        (F.size(parts) > 1) & (F.element_at(parts, -1) == ""), 1).otherwise(0)
    return (F.size(parts) - edge).cast("long")


def random_key(doc_id: Column, text: Column) -> Column:
    """A key that depends on id and text alone, so that reruns agree and rows that share an id spread over ranges."""
    return F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.md5(F.coalesce(text, F.lit("")))))


def source_targets(sizes: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """source, source_size, target from source and source_size.

    Sources by code point (null last) weigh `weights`, repeating, and share the sum of all sizes; a target
    stops at max_epochs times its source's size and the excess is shared again by weight: with sources
    sorted by cap / weight, the first k are at their caps and the rest share what is left by weight, for the
    least k at which none of the rest is above its cap. One row for each source; no documents come here.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_fill = Window.orderBy(F.col("cap") / F.col("weight"), F.col("rank"))
    everything = Window.partitionBy()
    weight = F.get(F.array(*[F.lit(w) for w in weights]), ((F.col("rank") - 1) % len(weights)).cast("int"))
    filled = (
        sizes.withColumn("rank", F.row_number().over(by_name)).withColumn("weight", weight.cast("long"))
        .withColumn("cap", F.col("source_size") * max_epochs)
        .withColumn("cap_before", F.coalesce(F.sum("cap").over(by_fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("weight_left", F.sum("weight").over(by_fill.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("total", F.sum("source_size").over(everything))
        .withColumn("level", (F.col("total") - F.col("cap_before")).cast("double") / F.col("weight_left").cast("double"))
        .withColumn("fits", F.col("level") * F.col("weight") <= F.col("cap"))
    )
    level = F.min(F.when(F.col("fits"), F.struct(F.col("cap_before").alias("b"), F.col("level").alias("v")))).over(everything)["v"]
    return filled.withColumn("_level", level).select(
        "source", "source_size",
        F.coalesce(F.least(F.col("cap").cast("double"), F.col("_level") * F.col("weight")), F.col("cap").cast("double")).alias("target"),
    )


def place(docs: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """doc_id, source, text hash and what the mix takes, for every row of docs(doc_id, text, source).

    size (0 for null text), source_size, target, copies (whole passes), cut (words of one more, partial
    or whole, copy) and taken = copies * size + cut. Null sources are one source, the last. Rows with the
    same id keep an order by their text's hash, equal rows by an arbitrary but exchangeable order. An empty
    table gives an empty result, and a source without words takes none.
    """
    return _placed(docs, weights, max_epochs, [])


def _placed(docs: DataFrame, weights, max_epochs: int, keep: list[str]) -> DataFrame:
    sized = docs.select(
        "doc_id", "source", n_words(F.col("text")).alias("size"), F.xxhash64("text").alias("_text"),
        random_key(F.col("doc_id"), F.col("text")).alias("_key"), *keep,
    )
    ranges = bits_for(docs.select("doc_id").count(), RANGE_ROWS, LEAST_RANGES)
    high = lambda k: (F.conv(F.substring(k, 1, 8), 16, 10).cast("long") * ranges / (1 << 32)).cast("long")
    per_range = (
        sized.select("source", "size", high(F.col("_key")).alias("_range")).groupBy("source", "_range")
        .agg(F.sum("size").alias("range_size"))
    )
    along = Window.partitionBy("source").orderBy("_range")
    offsets = per_range.withColumn("_before", F.sum("range_size").over(along) - F.col("range_size"))
    sizes = per_range.groupBy("source").agg(F.sum("range_size").alias("source_size"))
    offsets = offsets.alias("o").join(
        source_targets(sizes, weights, max_epochs).alias("t"), F.col("o.source").eqNullSafe(F.col("t.source"))
    ).select(F.col("o.source").alias("_source"), F.col("_range").alias("_at"), "_before", "source_size", "target")
    in_range = Window.partitionBy("source", "_range").orderBy("_key", "doc_id", "_text")
    placed = (
        sized.withColumn("_range", high(F.col("_key")))
        .withColumn("_inside", F.sum("size").over(in_range.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
        .join(offsets, F.col("source").eqNullSafe(F.col("_source")) & (F.col("_range") == F.col("_at")))
    )
    budget = F.floor("target")
    copies = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    left = budget - F.col("copies") * F.col("source_size") - F.col("_before") - F.col("_inside")
    return (
        placed.withColumn("copies", copies)
        .withColumn("cut", F.greatest(F.lit(0), F.least(F.col("size"), left)).cast("long"))
        .withColumn("taken", F.col("copies") * F.col("size") + F.col("cut"))
    )


def mix(docs: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """The mixed corpus with the columns of docs: each document as often as the mix takes it.

    The one document of a source that the budget cuts appears once more with its first words up to the cut;
    a document of no words is left out.
    """
    # the caller's columns travel as one, so that no name of theirs meets one of ours
    whole = docs.select("doc_id", "text", "source", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    placed = _placed(whole, weights, max_epochs, ["_row"])
    times = F.col("copies") + F.when(F.col("cut") > 0, 1).otherwise(0)
    rows = placed.where(F.col("taken") > 0).withColumn("_n", F.explode(F.sequence(F.lit(1).cast("long"), times)))
    words = F.filter(F.split(F.col("_row.text"), SPACE_CLASS + "+"), lambda w: w != "")
    text = F.when(
        (F.col("_n") > F.col("copies")) & (F.col("cut") < F.col("size")), F.array_join(F.slice(words, F.lit(1), F.col("cut").cast("int")), " ")
    ).otherwise(F.col("_row.text"))
    return rows.select(*[text.alias(c) if c == "text" else F.col("_row")[c].alias(c) for c in docs.columns])


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return place(docs).select("doc_id", "size", "source_size", "target", "taken", "copies", "cut")


OP4_SQL = r"""
with d as (
  select doc_id, source, md5(concat(coalesce(cast(doc_id as varchar), ''), md5(coalesce(text, '')))) as k,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size from documents),
s as (
  select source, sum(size)::bigint as source_size from d group by source),
r as (
  select *, row_number() over (order by source nulls last) as rank from s),
w as (
  select *, ((rank - 1) % 3 + 1)::bigint as weight, source_size * 3 as cap from r),
f as (
  select *, coalesce(sum(cap) over (order by cap::double / weight, rank rows between unbounded preceding and 1 preceding), 0) as cap_before,
         sum(weight) over (order by cap::double / weight, rank rows between current row and unbounded following) as weight_left,
         sum(source_size) over () as total from w),
l as (
  select *, (total - cap_before)::double / weight_left::double as level from f),
v as (
  select arg_min(level, cap_before) as v from l where level * weight <= cap),
t as (
  select source, source_size, coalesce(least(cap::double, v * weight), cap::double) as target from l, v),
p as (
  select d.doc_id, d.size, t.source_size, t.target,
         sum(size) over (partition by d.source order by k, doc_id) - size as before,
         case when source_size > 0 then (floor(target)::bigint // source_size) else 0 end as copies
  from d join t on d.source is not distinct from t.source)
select doc_id, size, source_size, target, copies,
       greatest(0, least(size, floor(target)::bigint - copies * source_size - before))::bigint as cut,
       (copies * size + greatest(0, least(size, floor(target)::bigint - copies * source_size - before)))::bigint as taken
from p
"""

QUERIES = {"op4_mixing": op4_mixing}
ORACLES = {"op4_mixing": OP4_SQL}
