"""An inverted index with positions, stored in generations that are merged level by level.

Below the path of a stored index:

* `postings/g…` (key, scope, field, token, positions), in folders by the hash of the token and sorted by scope inside, so that a search reads
  the folders of its tokens and, scoped, the row groups of its scope;
* `runs/g…` (key, scope, units): the distinct runs of characters of each field of a document, document by document;
* `tokens/g…` (key, scope, n_tokens, digest, t0, t1, …): the tokens of each field of a document in order, document by document, for sets of queries
  that are held against every document;
* `lines/g…` (key, line, first, n): which of a document's content tokens stand in which of its lines;
* `live/v…` (key, scope, n_tokens, digest, generation): the documents of a version, each with the generation that holds it. What
  other generations hold of it, or of documents that are gone, is dead: it is passed over, and dropped when generations are merged;
* `manifest/v…`: the generations of a version. It is written last; a version without a complete manifest does not exist, so that a
  refresh or a merge that breaks off leaves the version before.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions import text as T
from marlstone.operators import scoring

# Weights of fields.
TITLE_WEIGHT, CONTENT_WEIGHT = 8.0, 3.0
#: Tokens in one folder of a generation, about.
FOLDER_TOKENS = 20_000_000
#: So many generations of one level are merged into one of the next.
FANOUT = 4
#: What tokens of queries consist of, lower-cased: a token that a text contains lies within one such run.
RUN = r"[0-9a-z_\-\.一-鿿]+"
#: What an index holds; each kind can be written alone, or later.
KINDS = ("postings", "runs", "lines", "tokens")


def clean_text(text: Column | str) -> Column:
    """A text without byte order marks at its beginning; empty for null."""
    return F.regexp_replace(F.coalesce(T.col(text), F.lit("")), "^\\uFEFF+", "")


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def scope_of(path: Column | str) -> Column:
    """The member below whose folder a path lies; empty for other paths below members/, null for all others."""
    parts = F.split(T.col(path), "/")
    return F.when(F.startswith(T.col(path), F.lit("members/")), F.when(F.size(parts) > 2, F.get(parts, F.lit(1))).otherwise(""))


class Index:
    """What BM25 needs, computed from documents when it is asked: postings(key, field, token, positions), lengths(key, n_tokens) and totals."""

    kinds = KINDS

    def __init__(self, docs: DataFrame, fields: dict[str, float] | None = None, key: str = "path"):
        self.fields = fields or {"title": TITLE_WEIGHT, "content": CONTENT_WEIGHT}
        self.key, self.docs = key, docs
        self.scope = scope_of(key) if key == "path" else F.lit("")
        each = docs.select(key, self.scope.alias("scope"), *[T.index_tokens(clean_text(f)).alias(f"_t{i}") for i, f in enumerate(self.fields)])
        self.tokens = each.select(key, "scope", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"_t{i}").alias("tokens")) for i, f in enumerate(self.fields)])).alias("_f")).select(key, "scope", "_f.*")
        self.counted = each.select(key, "scope", sum(F.size(f"_t{i}") for i in range(len(self.fields))).cast("long").alias("n_tokens"))
        self.lengths = self.counted.groupBy(key).agg(F.sum("n_tokens").alias("n_tokens"))

    def words(self, *rest: Column) -> DataFrame:
        """key, scope, n_tokens and the tokens t0, t1, … of the fields, document by document; `rest` are more columns."""
        own = [T.index_tokens(clean_text(f)).alias(f"t{i}") for i, f in enumerate(self.fields)]
        names = [f"t{i}" for i in range(len(self.fields))]
        each = self.docs.select(self.key, self.scope.alias("scope"), *rest, *own)
        return each.select(self.key, "scope", sum(F.size(t) for t in names).cast("long").alias("n_tokens"), *each.columns[2:])

    def mapped(self, f, rest: str, *columns: str) -> DataFrame:
        """What f makes of batches of words(key, generation, columns): rows (key, rest), f having to keep key and generation."""
        kind = self.docs.schema[self.key].dataType.simpleString()
        return self.words().select(self.key, F.lit(0).alias("generation"), *columns).mapInArrow(f, f"`{self.key}` {kind}, generation int, {rest}").drop("generation")

    def _grouped(self) -> DataFrame:
        """key, scope, field, token and positions, made document by document, without a shuffle."""
        kind = self.tokens.schema[self.key].dataType.simpleString()
        return self.tokens.mapInArrow(scoring.grouped_positions, f"`{self.key}` {kind}, scope string, field string, token string, positions array<int>")

    @property
    def postings(self) -> DataFrame:
        return self._grouped().drop("scope")

    def positions_of(self, asked: DataFrame) -> DataFrame:
        """key, field, token, at for the tokens of asked(token)."""
        return self._grouped().drop("scope").join(asked, "token").withColumnRenamed("positions", "at")

    def corpus(self) -> DataFrame:
        return self.lengths.agg(F.count("*").alias("n_docs"), F.avg("n_tokens").alias("avg_tokens"))

    def units(self) -> DataFrame:
        """key, scope and units: for each field (field, units) the distinct runs of characters that tokens of queries can lie in."""
        runs = lambda f: F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(F.col(f), F.lit(""))), F.lit(RUN), F.lit(0)))
        return self.docs.select(self.key, self.scope.alias("scope"), F.array(*[F.struct(F.lit(f).alias("field"), runs(f).alias("units")) for f in self.fields]).alias("units"))

    def runs(self) -> DataFrame:
        """key, field and unit: the runs of units(), one a row."""
        return self.units().select(self.key, F.explode("units").alias("_u")).select(self.key, "_u.field", F.explode("_u.units").alias("unit"))

    def lines(self) -> DataFrame:
        """key, line (from 1), first and n: the tokens of content that stand in a line, first to first + n - 1."""
        sizes = self.docs.select(self.key, F.transform(T.lines(clean_text("content")), lambda x: F.size(T.index_tokens(x))).alias("_n"))

        def numbered(batches):
            for batch in batches:
                per, n = np.asarray(batch.column(1).value_lengths()), np.asarray(batch.column(1).flatten(), np.int64)
                before = np.cumsum(n) - n
                begun = np.repeat(before[scoring._starts(per)[per > 0]], per[per > 0])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.repeat(np.arange(len(per)), per))), pa.array(scoring._spread(per) + 1, pa.int32()), pa.array(n, pa.int32()), pa.array(before - begun, pa.int32())], names=[batch.schema.names[0], "line", "n", "first"])

        return sizes.mapInArrow(numbered, f"`{self.key}` {sizes.schema[self.key].dataType.simpleString()}, line int, n int, first int")

    def store(self, path: str, kinds: tuple[str, ...] = KINDS) -> StoredIndex:
        """Write the index, or some kinds of what it holds, as the first version of a stored one."""
        return _add(self, path, _next_version(self.docs.sparkSession, path), None, [], kinds)


def _digest(fields: dict[str, float]) -> Column:
    """The digest of the indexed fields."""
    return F.sha2(F.concat(*[F.sha2(clean_text(f), 256) for f in fields]), 256).alias("digest")


def _files(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def _versions(spark: SparkSession, path: str) -> list[int]:
    """The complete versions, oldest first."""
    p, fs = _files(spark, f"{path}/manifest")
    if not fs.exists(p):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(p)]  # two or three, as older ones are removed
    return sorted(int(n[1:]) for n in names if n[1:].isdigit() and fs.exists(_files(spark, f"{path}/manifest/{n}/_SUCCESS")[0]))


def _next_version(spark: SparkSession, path: str) -> int:
    return max([0, *_versions(spark, path)]) + 1


def _put(rows: DataFrame, path: str, kind: str, generation: int, token: str, folders: int) -> None:
    """Write rows in folders by the hash of a column; Spark sizes the files by the data, so that a frequent token has several."""
    cut = rows.withColumn("folder", F.pmod(F.xxhash64(token), F.lit(folders)).cast("int")).hint("rebalance", "folder")
    order = ["folder", "scope", token] if "scope" in rows.columns else ["folder", token]
    cut.sortWithinPartitions(*order).write.mode("overwrite").partitionBy("folder").parquet(f"{path}/{kind}/g{generation}")


def _folders(tokens: int) -> int:
    """A power of two, so that a folder of a small generation is several of a large one."""
    n = 1
    while n * FOLDER_TOKENS < tokens:
        n *= 2
    return n


def _commit(spark: SparkSession, path: str, version: int, generations: list[tuple[int, int, int, int]], fields: dict[str, float], key: str, kinds: tuple[str, ...]) -> StoredIndex:
    """Make a version, whose data are written, the current one."""
    spark.createDataFrame(generations or [(0, 0, 0, 0)], "generation int, level int, folders int, docs long").coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest/v{version}")
    return StoredIndex(spark, path, fields, key, kinds=kinds)


def _write(new: Index, path: str, kind: str, generation: int, folders: int) -> None:
    """Write one kind of what an index holds as part of a generation."""
    if kind == "postings":
        _put(new._grouped(), path, kind, generation, "token", folders)
    elif kind == "tokens":
        new.words(_digest(new.fields)).write.mode("overwrite").parquet(f"{path}/{kind}/g{generation}")
    elif {"title", "content"} <= set(new.fields):
        (new.units() if kind == "runs" else new.lines()).write.mode("overwrite").parquet(f"{path}/{kind}/g{generation}")


def _add(new: Index, path: str, version: int, kept: DataFrame | None, generations: list[tuple[int, int, int, int]], kinds: tuple[str, ...] = KINDS) -> StoredIndex:
    """Write new documents as a generation, and the version that it makes with what is kept of others."""
    spark, key = new.docs.sparkSession, new.key
    if "tokens" in kinds:  # texts are cut into tokens once, and these counted
        _write(new, path, "tokens", version, 1)
        each = spark.read.parquet(f"{path}/tokens/g{version}").select(key, "scope", "n_tokens", "digest")
    else:
        sizes = sum(F.size(T.index_tokens(clean_text(f))) for f in new.fields).cast("long")
        each = new.docs.select(key, new.scope.alias("scope"), sizes.alias("n_tokens"), _digest(new.fields))
    own = each.withColumn("generation", F.lit(version))
    (own if kept is None else kept.unionByName(own)).write.mode("overwrite").parquet(f"{path}/live/v{version}")
    per = {r.generation: r for r in spark.read.parquet(f"{path}/live/v{version}").groupBy("generation").agg(F.count("*").alias("docs"), F.sum("n_tokens").alias("tokens")).collect()}  # one row for each generation
    if version in per:
        folders = _folders(per[version].tokens)
        for kind in kinds:
            if kind != "tokens":
                _write(new, path, kind, version, folders)
        generations = [*generations, (version, 0, folders, per[version].docs)]
    return _commit(spark, path, version, [g for g in generations if g[0] in per], new.fields, key, kinds)


class StoredIndex(Index):
    """A version of a stored index (the current one): all of it if member is None, what is below members/ if it is empty, else what is below that member's folder."""

    def __init__(self, spark: SparkSession, path: str, fields: dict[str, float] | None = None, key: str = "path", member: str | None = None, version: int | None = None, kinds: tuple[str, ...] = KINDS):
        self.fields = fields or {"title": TITLE_WEIGHT, "content": CONTENT_WEIGHT}
        self.key, self.path, self.spark, self.member, self.kinds = key, path, spark, member, kinds
        self.version = version or _versions(spark, path)[-1]
        self.generations = [(r.generation, r.level, r.folders, r.docs) for r in spark.read.parquet(f"{path}/manifest/v{self.version}").where("folders > 0").orderBy("generation").collect()]  # FANOUT for each level at most
        self.live = self._within(spark.read.parquet(f"{path}/live/v{self.version}"))
        self.lengths = self.live.select(key, "n_tokens")

    def scoped(self, member: str | None) -> StoredIndex:
        """The index of the documents below members/, or below a member's folder, with statistics of their own."""
        return StoredIndex(self.spark, self.path, self.fields, self.key, "" if member is None else member, self.version, self.kinds)

    def supply(self, docs: DataFrame, kind: str) -> StoredIndex:
        """The index with one more kind, made of the documents that it was made of; only for one that was never refreshed."""
        if len(self.generations) > 1 or any(level for _, level, _, _ in self.generations):
            raise ValueError("an index that was refreshed gets no more kinds")
        for g, _, folders, _ in self.generations:
            _write(Index(docs, self.fields, self.key), self.path, kind, g, folders)
        return StoredIndex(self.spark, self.path, self.fields, self.key, self.member, self.version, (*self.kinds, kind))

    def _within(self, rows: DataFrame) -> DataFrame:
        if self.member is None:
            return rows
        return rows.where(F.col("scope") == self.member) if self.member else rows.where(F.col("scope").isNotNull())

    def _stored(self, kind: str, rest: str, asked: DataFrame | None = None, which: list[int] | None = None) -> DataFrame:
        """Rows of live documents with their scopes: all, or those of the tokens of asked(token), from the generations `which` or all."""
        schema = f"`{self.key}` {self.live.schema[self.key].dataType.simpleString()}, scope string, {rest}"
        chosen = [g for g in self.generations if which is None or g[0] in which]
        wanted: set[int] = set()
        if asked is not None and chosen:
            most = max(g[2] for g in chosen)
            wanted = {r.f for r in asked.select(F.pmod(F.xxhash64("token"), F.lit(most)).cast("int").alias("f")).distinct().collect()}  # folders at most
        parts = []
        for g, _, folders, _ in chosen:
            part = self._within(self.spark.read.schema(schema).parquet(f"{self.path}/{kind}/g{g}"))
            if asked is not None:
                part = part.where(F.col("folder").isin(sorted({f % folders for f in wanted}))).join(asked, "token")
            parts.append(part.drop("folder").withColumn("generation", F.lit(g)))
        return self._alive(union_all(parts)) if parts else self.spark.createDataFrame([], schema).drop("folder")

    def _alive(self, rows: DataFrame) -> DataFrame:
        """rows with a generation, without those of documents that another generation holds now."""
        dead = len(self.generations) > 1 or any(g[3] != self._count for g in self.generations)
        return (rows.join(self.live.select(self.key, "generation"), [self.key, "generation"], "left_semi") if dead else rows).drop("generation")

    @property
    def _count(self) -> int:
        if not hasattr(self, "_n"):
            self._n = self.live.count() if self.member is None else self.spark.read.parquet(f"{self.path}/live/v{self.version}").count()
        return self._n

    def _grouped(self, asked: DataFrame | None = None, which: list[int] | None = None) -> DataFrame:
        return self._stored("postings", "field string, token string, positions array<int>, folder int", asked, which)

    def positions_of(self, asked: DataFrame) -> DataFrame:
        return self._grouped(asked).drop("scope").withColumnRenamed("positions", "at")

    def words(self, which: list[int] | None = None) -> DataFrame:
        """As of an index that is not stored, with the generation and the digest; also what is dead."""
        if "tokens" not in self.kinds:
            raise ValueError("the index was stored without the kind tokens")
        kind = self.live.schema[self.key].dataType.simpleString()
        schema = f"`{self.key}` {kind}, scope string, n_tokens long, digest string, " + ", ".join(f"t{i} array<string>" for i in range(len(self.fields)))
        parts = [self._within(self.spark.read.schema(schema).parquet(f"{self.path}/tokens/g{g}")).withColumn("generation", F.lit(g)) for g, *_ in self.generations if which is None or g in which]
        return union_all(parts) if parts else self.spark.createDataFrame([], f"{schema}, generation int")

    def mapped(self, f, rest: str, *columns: str) -> DataFrame:
        kind = self.live.schema[self.key].dataType.simpleString()
        return self._alive(self.words().select(self.key, "generation", *columns).mapInArrow(f, f"`{self.key}` {kind}, generation int, {rest}"))

    def units(self, which: list[int] | None = None) -> DataFrame:
        return self._stored("runs", "units array<struct<field: string, units: array<string>>>", which=which)

    def lines(self) -> DataFrame:
        parts = [self.spark.read.parquet(f"{self.path}/lines/g{g}").withColumn("generation", F.lit(g)) for g, *_ in self.generations]
        return self._alive(union_all(parts)) if parts else self.spark.createDataFrame([], f"`{self.key}` string, line int, n int, first int")

    def refresh(self, docs: DataFrame) -> StoredIndex:
        """The index of docs as they are now: new and changed documents are indexed, those gone are dropped, and generations are merged where there are FANOUT."""
        now = docs.select(self.key, _digest(self.fields))
        same = self.live.join(now, [self.key, "digest"], "left_semi")
        changed = docs.join(same.select(self.key), self.key, "left_anti")
        return _add(Index(changed, self.fields, self.key), self.path, self.version + 1, same.select(self.key, "scope", "n_tokens", "digest", "generation"), self.generations, self.kinds).compact()

    def compact(self) -> StoredIndex:
        """Merge the generations of a level that has FANOUT of them into one of the next, and rewrite those of which more than half is dead."""
        alive = {r.generation: (r.n, r.tokens) for r in self.live.groupBy("generation").agg(F.count("*").alias("n"), F.sum("n_tokens").alias("tokens")).collect()}
        levels: dict[int, list[int]] = {}
        for g, level, _, _ in self.generations:
            levels.setdefault(level, []).append(g)
        full = next(((level, gs) for level, gs in sorted(levels.items()) if len(gs) >= FANOUT), None)
        thin = next(((level - 1, [g]) for g, level, _, docs in self.generations if 2 * alive[g][0] < docs), None)
        found = full or thin
        if found is None:
            self.vacuum()
            return self
        level, merged = found
        version = self.version + 1
        folders = _folders(sum(alive[g][1] for g in merged))
        if "postings" in self.kinds:
            _put(self._grouped(which=merged), self.path, "postings", version, "token", folders)
        if "tokens" in self.kinds:
            self._alive(self.words(merged)).write.mode("overwrite").parquet(f"{self.path}/tokens/g{version}")
        if {"title", "content"} <= set(self.fields):
            if "runs" in self.kinds:
                self.units(which=merged).write.mode("overwrite").parquet(f"{self.path}/runs/g{version}")
            if "lines" in self.kinds:
                of_merged = self.live.where(F.col("generation").isin(merged)).select(self.key)
                self.lines().join(of_merged, self.key, "left_semi").write.mode("overwrite").parquet(f"{self.path}/lines/g{version}")
        moved = F.when(F.col("generation").isin(merged), F.lit(version)).otherwise(F.col("generation"))
        self.live.withColumn("generation", moved).write.mode("overwrite").parquet(f"{self.path}/live/v{version}")
        rest = [g for g in self.generations if g[0] not in merged]
        return _commit(self.spark, self.path, version, [*rest, (version, level + 1, folders, sum(alive[g][0] for g in merged))], self.fields, self.key, self.kinds).compact()

    def vacuum(self, keep: int = 2) -> None:
        """Remove versions but the last ones, and generations that those do not name. Readers of older versions lose their data."""
        versions = _versions(self.spark, self.path)
        kept = versions[-keep:]
        named = {r.generation for v in kept for r in self.spark.read.parquet(f"{self.path}/manifest/v{v}").collect()}
        gone = [f"manifest/v{v}" for v in versions[:-keep]] + [f"live/v{v}" for v in versions[:-keep]]
        for kind in KINDS:
            p, fs = _files(self.spark, f"{self.path}/{kind}")
            if fs.exists(p):  # a folder for each generation
                gone += [f"{kind}/{s.getPath().getName()}" for s in fs.listStatus(p) if int(s.getPath().getName()[1:]) not in named]
        for name in gone:
            p, fs = _files(self.spark, f"{self.path}/{name}")
            fs.delete(p, True)
