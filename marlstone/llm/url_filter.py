"""URL filter: a sort-merge range join of urls with host and path rules.

A host is turned round into a canonical key (``www.example.net`` -> ``net.example.www.``), so that a
rule's host and all its subdomains form one interval of keys. Rules and urls are one table of events,
range-partitioned and sorted by key; each range begins with the rules whose intervals are open at its first
key, and a sweep over its events keeps the stack of open rules. The longest rule on the stack whose path
starts the url's path decides. There is one way for any number of rules, and none passes the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from marlstone.llm.common import lower_ascii, materialize, table

DEFAULT_VERDICT = "allow"


class Rule(NamedTuple):
    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path


#: The production rules: blocked and allowed hosts with path prefixes.
RULES = [
    Rule("net", "/", "block"),
    Rule("example.net", "/en/", "allow"),
    Rule("example.com", "/de/", "block"),
    Rule("org", "/fr/", "allow"),
]


def url_host(url: Column | str) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://`` or for null."""
    rest = F.regexp_extract(F.coalesce(_col(url), F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return lower_ascii(rest)


def url_path(url: Column | str) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://`` or for null."""
    return F.regexp_extract(F.coalesce(_col(url), F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def host_key(host: Column) -> Column:
    """Labels in reverse order, each followed by a dot: all subdomains share the prefix."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


class RuleStack:
    """The rules of the open intervals, outermost first: of each host its paths, by their lengths."""

    def __init__(self):
        self.open: list[tuple[str, str, dict[str, str], list[int]]] = []

    def move(self, key: str) -> None:
        """Close the intervals that do not reach key."""
        while self.open and not key.startswith(self.open[-1][0]):
            self.open.pop()

    def add(self, key: str, host: str, path: str, verdict: str) -> None:
        self.move(key)
        if not self.open or self.open[-1][0] != key:
            self.open.append((key, host, {}, []))
        _, _, paths, lengths = self.open[-1]
        paths[path] = verdict
        if len(path) not in lengths:
            lengths.append(len(path))
            lengths.sort(reverse=True)

    def best(self, path: str) -> tuple[str | None, str | None]:
        """The longest rule for a path below the key that move was called with, and its verdict."""
        found: tuple[int, int, str | None, str | None] = (-1, -1, None, None)
        for _, host, paths, lengths in self.open:
            own = next((path[:n] for n in lengths if n <= len(path) and path[:n] in paths), None)
            if own is not None:
                found = max(found, (len(host) + len(own), len(host), host + own, paths[own]))
        return found[2:]


def _sweep(default: str, schema: StructType):
    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, stack, last, known = None, RuleStack(), None, {}
        for b in batches:
            rule, verdict = [], []
            for own, key, is_url, host, path, says in zip(*(b.column(c).to_pylist() for c in ("part", "key", "is_url", "host", "path", "verdict")), strict=True):
                if own != part:
                    part, stack, last = own, RuleStack(), None
                if not is_url:
                    stack.add(key, host, path, says)
                    last = None
                    continue
                if key != last:
                    stack.move(key)
                    last, known = key, {}
                if path not in known:
                    known[path] = stack.best(path)
                found = known[path]
                rule.append(found[0])
                verdict.append(default if found[0] is None else found[1])
            urls = b.filter(b.column("is_url"))
            yield pa.RecordBatch.from_arrays(
                [urls.column(c) for c in ("page_id", "host", "path")] + [pa.array(rule, pa.string()), pa.array(verdict, pa.string())], names=schema.names)

    return sweep


def filter_urls(pages: DataFrame, rules: list[Rule] | DataFrame, default: str = DEFAULT_VERDICT) -> DataFrame:
    """Judge every row of pages(page_id, url): page_id, host, path, rule and verdict.

    A rule fits its host and all subdomains where the url's path starts with the rule's path; the longest
    rule (host and path together, then the longer host) wins, else rule is null and verdict is `default`.
    Of rules with one host and path the verdict that comes first by code point holds; rules with a null host, path or
    verdict are left out. Null urls and urls without ``://`` have an empty host and path and meet no rule. Rows repeat
    as they repeat in pages; other columns of pages are left out, so their names can't clash; an empty table gives
    an empty result. rules are a list or a DataFrame(host, path, verdict) of any size. The paths of the rules of one
    host and its ancestors are held in a task together.
    """
    if not isinstance(rules, DataFrame):
        rules = pages.sparkSession.createDataFrame(list(rules), "host string, path string, verdict string")
    clean = rules.where("host is not null and path is not null and verdict is not null").groupBy("host", "path").agg(
        F.min("verdict").alias("verdict")).withColumn("key", host_key(F.col("host")))
    urls = pages.select(F.lit(True).alias("is_url"), "page_id", url_host("url").alias("host"), url_path("url").alias("path")).select(
        host_key(F.col("host")).alias("key"), "*", F.lit(None).cast("string").alias("verdict"), F.monotonically_increasing_id().alias("row"))
    opened = clean.select(
        "key", F.lit(False).alias("is_url"), F.lit(None).cast(pages.schema["page_id"].dataType).alias("page_id"), "host", "path", "verdict", F.lit(-1).cast("long").alias("row"))
    # the row's number splits a host with very many urls over several ranges
    order = ["key", "is_url", "row"]
    events = urls.select(*opened.columns).union(opened).repartitionByRange(*order).sortWithinPartitions(*order)
    ranged = materialize(events.withColumn("part", F.spark_partition_id()), "url-ranges")
    first = ranged.groupBy("part").agg(F.min("key").alias("first"))
    # every prefix of a key that ends in a dot is an ancestor
    labels = F.split("first", r"\.")
    above = first.select("part", F.explode(F.transform(
        F.sequence(F.lit(1), F.size(labels) - 1), lambda n: F.concat(F.array_join(F.slice(labels, F.lit(1), n), "."), F.lit(".")))).alias("key"))
    seeds = above.join(clean, "key").select(
        "key", F.lit(False).alias("is_url"), F.lit(None).cast(pages.schema["page_id"].dataType).alias("page_id"), "host", "path", "verdict",
        F.lit(-2).cast("long").alias("row"), "part")
    schema = StructType([pages.schema["page_id"], *StructType.fromDDL("host string, path string, rule string, verdict string")])
    swept = ranged.union(seeds.select(*ranged.columns)).repartition("part").sortWithinPartitions("part", F.col("row") > -2, *order)
    return swept.mapInArrow(_sweep(default, schema), schema)


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"), RULES)


_VALUES = ", ".join(f"('{r.host}', '{r.path}', '{r.verdict}')" for r in RULES)
OP1_SQL = rf"""
with p as (
  select page_id,
         translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) as path
  from pages),
r(rh, rp, rv) as (values {_VALUES}),
m as (
  select p.page_id, max(struct_pack(n := length(rh || rp), t := rh || rp, v := rv)) as best
  from p join r on (host = rh or ends_with(host, '.' || rh)) and starts_with(path, rp)
  group by p.page_id)
select p.page_id, p.host, p.path, best.t as rule, coalesce(best.v, '{DEFAULT_VERDICT}') as verdict
from p left join m using (page_id)
"""

QUERIES = {"op1_url_filter": op1_url_filter}
ORACLES = {"op1_url_filter": OP1_SQL}
