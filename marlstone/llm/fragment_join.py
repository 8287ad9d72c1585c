"""Jaccard join of word n-gram sets by vertical partitioning.

The global order of n-grams is that of their hashes, and fragments are cuts of it, so that all are loaded alike without any
statistics. Texts with equal sets are one class.

1. Two sets that link differ in few n-grams: at most H for the sizes of a band. The order is cut into more than H fragments, so
   linked sets agree wholly in some of them. Classes are posted under each of their segments (fragment and digest of the n-grams in
   it); a segment that one class alone has leads nowhere. Fragments in which a class has nothing are not posted; where those could
   be all in which two sets agree, both are posted under the mark of their band instead.
2. Every posting list elects leaders, and each class is compared with the leader that it shares most segments with. So a group of
   thousands of near copies costs two comparisons a member, and lists that lie in one component are done.
3. Classes in the other lists that hold too many n-grams alone have no partner and leave. Of those that stay, members outside a list's
   largest component are compared with the rest, unless what the two hold alone, or how often they agree in a finer cut, rules a link
   out. Lists with very many such members are first split by the segments of another cut, in which linked sets agree somewhere, too;
   what stays as long is worked off a number of leaders a round.
4. A comparison counts the overlap in each of PARTS coarse fragments on its own and sums the counts for each pair. The first fragment
   is counted alone: the n-grams that two sets do not share in it may not exceed what the sizes allow in all.

No link between different sets is lost in any step, and none is made without the exact sum of overlaps.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from marlstone.llm.common import key_filter, materialize, table
from marlstone.llm.components import connected_components
from marlstone.llm.near_duplicates import KEY, ROW, _label, class_id, shingle_sets
from marlstone.llm.wordhash import U, mix

#: Coarse fragments in which overlaps are counted.
PARTS = 8
#: A band's largest size over its least.
BAND = 1.25
#: Lists with more members outside their largest component are split by another cut; of those that stay as long, LEADERS are compared with all in a round.
LONG, LEADERS = 2048, 512
#: Fragments of the fine cut for each n-gram that sets of a band can differ in.
FINE = 4
#: Bits that a fine signature keeps of a fragment.
BITS = 4
#: Bits of the filters that texts and segments are held against; false hits are joined away.
FILTER_BITS = 25
ROWS = 128


def _bands(most: int = 1 << 40) -> np.ndarray:
    """The least size of each band."""
    edges = [1]
    while edges[-1] < most:
        edges.append(max(edges[-1] + 1, math.floor(edges[-1] * BAND)))
    return np.array(edges, dtype=np.int64)


EDGES = _bands()


def differing(total, percent: int):
    """N-grams that linked sets of this total size have alone, together and at most."""
    return total - 2 * (-(-percent * total // (100 + percent)))


def most_differing(band: int, percent: int) -> int:
    """The same for any two sets up to the sizes of a band."""
    return int(2 * (EDGES[band + 1] - 1) * (100 - percent) // (100 + percent))


def fragments_of(band: int, percent: int) -> int:
    """Fragments of a band's cut; linked sets agree in fragments_of - most_differing of them at least."""
    h = most_differing(band, percent)
    return h + 1 + h // 4


def _cut(s: np.ndarray, pieces: int) -> np.ndarray:
    """Where the fragments of a cut begin and the last one ends in a set (sorted hashes)."""
    return np.concatenate(([0], np.searchsorted(((s >> U(32)) * U(pieces)) >> U(32), np.arange(1, pieces + 1, dtype=U))))


def _bands_of(n: int, percent: int) -> list[int]:
    """The bands of a set: its own and those of all larger sets that it can link with, as far as sets of a band can differ and link."""
    own, last = np.searchsorted(EDGES, [n, n * 100 // percent], side="right") - 1
    return [int(b) for b in range(own, last + 1) if n and most_differing(b, percent)]


def segment_keys(s: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The keys under which a set is posted, and how many bands above its own each is of."""
    keys, steps = [np.zeros(0, dtype=U)], [np.zeros(0, dtype=np.int32)]
    sums = np.concatenate((np.zeros(1, dtype=U), np.cumsum(mix(s))))
    own = int(np.searchsorted(EDGES, len(s), side="right")) - 1
    for band in _bands_of(len(s), percent):
        k = fragments_of(band, percent)
        at = _cut(s, k)
        full = np.flatnonzero(at[1:] > at[:-1])
        place = mix((U(band) << U(40)) + full.astype(U) + U(1))
        found = mix(sums[at[full + 1]] - sums[at[full]] + place) + (at[full + 1] - at[full]).astype(U)
        if len(full) <= most_differing(band, percent):  # all fragments in which a partner agrees may be empty
            found = np.append(found, mix(np.array([U(band) << U(40)], dtype=U)))
        keys.append(found)
        steps.append(np.full(len(found), band - own, dtype=np.int32))
    return np.concatenate(keys).view(np.int64), np.concatenate(steps)


def fine_signatures(s: np.ndarray, percent: int) -> list[tuple[int, np.ndarray]]:
    """For each band of a set (as steps above its own) BITS bits for every fragment of a FINE times finer cut. Two sets of a band that
    differ in x n-grams differ in the bits of x fragments at most. A word holds one bit of 64 fragments; BITS words in a row are theirs."""
    own = int(np.searchsorted(EDGES, len(s), side="right")) - 1
    sums = np.concatenate((np.zeros(1, dtype=U), np.cumsum(mix(s))))
    out = []
    for band in _bands_of(len(s), percent):
        pieces = FINE * most_differing(band, percent)
        at = _cut(s, pieces)
        found = np.zeros(-(-pieces // 64) * 64, dtype=U)
        found[:pieces] = mix(sums[at[1:]] - sums[at[:-1]])
        words = [np.packbits(((found >> U(63 - i)) & U(1)).astype(np.uint8)).view(np.int64) for i in range(BITS)]
        out.append((band - own, np.stack(words, axis=1).ravel()))
    return out


def _differing(x: str, y: str) -> Column:
    """Fragments in whose bits two signatures differ."""
    def word(n: Column) -> Column:
        apart = [F.get(x, n * BITS + i).bitwiseXOR(F.get(y, n * BITS + i)) for i in range(BITS)]
        any_ = apart[0]
        for a in apart[1:]:
            any_ = any_.bitwiseOR(a)
        return F.bit_count(any_)

    return F.aggregate(F.sequence(F.lit(0), (F.size(x) / BITS).cast("int") - 1), F.lit(0), lambda total, n: total + word(n))


def _segments(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """key and cid of every segment of every text, once for a class and task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for whole in batches:
            for lo in range(0, whole.num_rows, ROWS):
                keys, cids = [], []
                for s in shingle_sets(whole.column("text").slice(lo, ROWS).to_pylist(), k):
                    if len(s) and (c := class_id(s)) not in seen:
                        seen.add(c)
                        keys.append(segment_keys(s, percent)[0])
                        cids.append(np.full(len(keys[-1]), c))
                if keys:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.concatenate(cids))], names=["key", "cid"])

    return docs.select("text").mapInArrow(run, "key long, cid long")


def _base(docs: DataFrame, shared: DataFrame, k: int, percent: int) -> DataFrame:
    """doc_id, row number, KEY (a hash of the text), n_shingles, cid, and the keys with their steps, of those that are shared and few more,
    for each row of docs."""
    keep = key_filter(shared, "key", FILTER_BITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, ROWS):
                b = whole.slice(lo, ROWS)
                sets = shingle_sets(b.column("text").to_pylist(), k)
                posted = [segment_keys(s, percent) for s in sets]
                hits = [keep(keys) for keys, _ in posted]
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id"), b.column(ROW), b.column(KEY), pa.array([len(s) for s in sets], pa.int64()), pa.array([class_id(s) for s in sets], pa.int64()),
                     pa.array([keys[h] for (keys, _), h in zip(posted, hits, strict=True)], pa.list_(pa.int64())), pa.array([steps[h] for (_, steps), h in zip(posted, hits, strict=True)], pa.list_(pa.int32()))],
                    names=["doc_id", ROW, KEY, "n_shingles", "cid", "keys", "steps"])

    return docs.select("doc_id", "text", ROW, F.xxhash64("text").alias(KEY)).mapInArrow(
        run, StructType([docs.schema["doc_id"], *StructType.fromDDL(f"{ROW} long, {KEY} long, n_shingles long, cid long, keys array<long>, steps array<int>")]))


def _parts(docs: DataFrame, wanted: DataFrame, k: int, percent: int) -> DataFrame:
    """cid, g and tokens: the n-grams of the wanted classes (cid, KEY) in each coarse fragment g; from PARTS on, their fine signatures by step."""
    keep = key_filter(wanted, KEY, FILTER_BITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for whole in batches:
            whole = whole.filter(pa.array(keep(whole.column(KEY).to_numpy())))
            for lo in range(0, whole.num_rows, ROWS):
                cids, parts, tokens = [], [], []
                for s in shingle_sets(whole.column("text").slice(lo, ROWS).to_pylist(), k):
                    if len(s) and (c := class_id(s)) not in seen:
                        seen.add(c)
                        at = _cut(s, PARTS)
                        own = [(g, s[at[g] : at[g + 1]].view(np.int64)) for g in range(PARTS) if at[g + 1] > at[g]]
                        for g, t in own + [(PARTS + step, t) for step, t in fine_signatures(s, percent)]:
                            cids.append(c)
                            parts.append(g)
                            tokens.append(t)
                yield pa.RecordBatch.from_arrays([pa.array(cids, pa.int64()), pa.array(parts, pa.int32()), pa.array(tokens, pa.list_(pa.int64()))], names=["cid", "g", "tokens"])

    found = docs.select("text", F.xxhash64("text").alias(KEY)).mapInArrow(run, "cid long, g int, tokens array<long>")
    return found.join(wanted.select("cid"), "cid", "left_semi").dropDuplicates(["cid", "g"])


def _room(na: Column, nb: Column, percent: int) -> Column:
    """differing() of columns."""
    total = na + nb
    return total - 2 * F.floor((percent * total + (99 + percent)) / (100 + percent))


def overlapping(pairs: DataFrame, sizes: DataFrame, parts: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of classes with 100 * intersection >= percent * union: overlaps are counted in each coarse fragment
    and summed. sizes has cid and n, parts cid, g and tokens."""
    a, b = sizes.select(F.col("cid").alias("a"), F.col("n").alias("na")), sizes.select(F.col("cid").alias("b"), F.col("n").alias("nb"))
    sized = pairs.join(a, "a").join(b, "b").where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
    left = parts.select(F.col("cid").alias("a"), "g", F.col("tokens").alias("x"))
    right = parts.select(F.col("cid").alias("b"), "g", F.col("tokens").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    none = F.array().cast("array<long>")  # a class may have nothing in a fragment
    first = sized.join(left.where("g = 0").drop("g"), "a", "left").join(right.where("g = 0").drop("g"), "b", "left").withColumns({"x": F.coalesce("x", none), "y": F.coalesce("y", none)})
    alone = F.size("x") + F.size("y") - 2 * F.col("o")
    near = materialize(first.withColumn("o", both).where(alone <= _room(F.col("na"), F.col("nb"), percent)).select("a", "b", "na", "nb", "o"), "pairs", few=True)
    rest = near.select("a", "b").join(left.where("g > 0"), "a").join(right.where("g > 0"), ["b", "g"]).select("a", "b", both.alias("o"))
    total = near.select("a", "b", "o").union(rest).groupBy("a", "b").agg(F.sum("o").alias("o"))
    return total.join(near.drop("o"), ["a", "b"]).where(100 * F.col("o") >= percent * (F.col("na") + F.col("nb") - F.col("o"))).select("a", "b")


class _Links:
    """The components that links have joined so far: cid and c of every class that has a shared segment."""

    def __init__(self, sizes: DataFrame, parts: DataFrame, percent: int):
        self.sizes, self.parts, self.percent = sizes.withColumn("alone", F.lit(0).cast("long")), parts.where(F.col("g") < PARTS), percent
        self.signatures = parts.where(F.col("g") >= PARTS).select("cid", (F.col("g") - PARTS).alias("step"), F.col("tokens").alias("sig"))
        self.of = sizes.select("cid", F.col("cid").alias("c"))

    def compare(self, pairs: DataFrame) -> None:
        """Compare distinct pairs (a, b) and merge what they link."""
        links = overlapping(pairs, self.sizes, self.parts, self.percent)
        a, b = self.of.toDF("a", "ca"), self.of.toDF("b", "cb")
        between = materialize(links.join(a, "a").join(b, "b").where("ca <> cb").select(F.least("ca", "cb").alias("ca"), F.greatest("ca", "cb").alias("cb")).distinct(), "links", few=True)
        if not between.isEmpty():
            roots = connected_components(between, "ca", "cb").toDF("c", "root")
            self.of = materialize(self.of.join(roots, "c", "left").select("cid", F.coalesce("root", "c").alias("c")), "groups", few=True)


def _proposals(lists: DataFrame) -> DataFrame:
    """For each class the leader that most of its lists have, among those of most shared segments and those by hash."""
    central = F.min(F.struct((-F.col("shared")).alias("o"), F.xxhash64("cid").alias("h"), "cid"))
    drawn = F.min(F.struct(F.xxhash64(F.lit("drawn"), F.pmod("key", F.lit(4)), "cid").alias("h"), "cid"))
    leaders = lists.groupBy("key").agg(central.alias("x"), drawn.alias("y")).select("key", F.array(
        F.struct(F.lit(0).alias("kind"), F.col("x.cid").alias("a")), F.struct(F.lit(1).alias("kind"), F.col("y.cid").alias("a"))).alias("s"))
    met = lists.select("key", F.col("cid").alias("b")).join(leaders, "key").select("b", F.inline("s")).where("a <> b")
    best = met.groupBy("b", "kind", "a").agg(F.count("*").alias("n")).groupBy("b", "kind").agg(F.max(F.struct("n", "a")).alias("m"))
    return best.select(F.least("m.a", "b").alias("a"), F.greatest("m.a", "b").alias("b")).distinct()


def _open(links: _Links, lists: DataFrame) -> DataFrame:
    """key, cid, step, n, alone, c, m, others and top: lists of several components, one of those with the same members, with their numbers of members and
    of those outside the largest component, top."""
    now = materialize(lists.select("key", "cid", "step").join(links.of, "cid"), "lists", few=True)
    same = [F.bit_xor(F.xxhash64(F.lit(i), "cid", "step")).alias(f"x{i}") for i in range(2)]
    mixed = now.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.min("step").alias("least"), F.count("*").alias("m"), *same).where("lo < hi and least = 0")
    mixed = mixed.groupBy("m", "x0", "x1").agg(F.min("key").alias("key")).select("key", "m")
    by_group = now.join(mixed, "key").groupBy("key", "m", "c").agg(F.count("*").alias("k"))
    about = by_group.groupBy("key", "m").agg(F.max(F.struct("k", "c")).alias("t")).select("key", "m", (F.col("m") - F.col("t.k")).alias("others"), F.col("t.c").alias("top"))
    return materialize(now.join(about, "key").join(links.sizes, "cid"), "lists", few=True)


def _pruned(links: _Links, lists: DataFrame) -> DataFrame:
    """key, cid and step of the lists, without classes that have more n-grams alone, of all classes in lists, than they could have beside a partner."""
    tokens = links.parts.join(lists.select("cid").distinct(), "cid", "left_semi").select("cid", F.explode("tokens").alias("t"))
    once = tokens.groupBy("t").agg(F.count("*").alias("k"), F.min("cid").alias("cid")).where("k = 1")
    links.sizes = materialize(links.sizes.drop("alone").join(once.groupBy("cid").agg(F.count("*").alias("alone")), "cid", "left").withColumn("alone", F.coalesce("alone", F.lit(0))), "sizes", few=True)
    largest = F.floor(F.col("n") * 100 / links.percent)
    able = links.sizes.where(F.col("alone") <= _room(F.col("n"), largest, links.percent) + 1)  # a total of one less may leave room for one more
    return materialize(lists.select("key", "cid", "step").join(able, "cid", "left_semi"), "lists", few=True)


def _pairs(links: _Links, askers: DataFrame, members: DataFrame) -> DataFrame:
    """Distinct pairs of classes of different components in one list, one of them an asker (all outside the largest component, or some of
    those), whose n-grams held alone and whose fine signatures leave room for a link."""
    x, y = (rows.join(links.signatures, ["cid", "step"]).alias(a) for rows, a in ((askers, "x"), (members, "y")))
    room = _room(F.col("x.n"), F.col("y.n"), links.percent)
    met = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.c") != F.col("y.c")) & ((F.col("x.step") == 0) | (F.col("y.step") == 0)) & (F.col("y.first") | (F.col("x.cid") < F.col("y.cid")))
                 & (F.col("x.alone") + F.col("y.alone") <= room) & (100 * F.least("x.n", "y.n") >= links.percent * F.greatest("x.n", "y.n"))
                 & (_differing("x.sig", "y.sig") <= room))
    return met.select(F.least("x.cid", "y.cid").alias("a"), F.greatest("x.cid", "y.cid").alias("b")).distinct()


def _split(long_: DataFrame, links: _Links) -> DataFrame:
    """The lists by the segments of another cut of the n-grams, in which linked sets agree somewhere, too: key, cid and step."""
    tokens = long_.select("key", "cid", "step").distinct().join(links.parts.select("cid", "tokens"), "cid").select("key", "cid", "step", F.explode("tokens").alias("t"))
    # the sizes of a list's members differ by the threshold and a band at most, so one number of fragments, twice what can differ, fits a list
    most = long_.groupBy("key").agg(F.max("n").alias("n")).select("key", (2 * F.floor(2 * F.col("n") * (100 - links.percent) / (100 + links.percent)) + 1).alias("k"))
    placed = tokens.join(most, "key").groupBy("key", "cid", "step", "k", F.pmod(F.xxhash64(F.lit("cut"), "t"), "k").alias("f")).agg(F.bit_xor(F.xxhash64("t")).alias("x"), F.count("*").alias("n"))
    found = placed.select(F.xxhash64("key", "f", "x", "n").alias("key"), "cid", "step")
    # as in the first cut: where fragments without n-grams could be all that partners agree in, there is a list for those
    bare = placed.groupBy("key", "cid", "step", "k").agg(F.count("*").alias("full")).where("2 * full <= k - 1").select(F.xxhash64("key", F.lit("bare")).alias("key"), "cid", "step")
    return found.union(bare).distinct()


def _finish(links: _Links, lists: DataFrame) -> None:
    """Find all links between components that are left."""
    for cut in (True, False):
        now = _open(links, lists)
        if now.isEmpty():
            return
        now = _open(links, _pruned(links, now))
        direct = F.col("others") <= LONG
        ready = now.where(direct)
        links.compare(_pairs(links, ready.where("c <> top"), ready.withColumn("first", F.col("c") == F.col("top"))))
        long_ = now.where(~direct)
        if long_.isEmpty():
            return
        lists = materialize(_split(long_, links), "lists", few=True) if cut else long_.select("key", "cid", "step")
    r = 0
    while True:
        now = _open(links, lists)
        if now.isEmpty():
            return
        # some members outside the largest component are compared with all; then they leave the list
        drawn = F.xxhash64(F.lit(r), "key", "cid")
        chosen = now.where("c <> top").where(F.pmod(drawn, F.col("others")) < LEADERS).groupBy("key").agg(F.slice(F.sort_array(F.collect_set(F.struct(drawn.alias("h"), "cid"))), 1, 2 * LEADERS).alias("s"))
        chosen = materialize(chosen.select("key", F.explode("s").alias("x")).select("key", "x.cid"), "leaders", few=True)
        links.compare(_pairs(links, now.join(chosen, ["key", "cid"]), now.withColumn("first", F.lit(True))))
        lists = materialize(now.join(chosen, ["key", "cid"], "left_anti").select("key", "cid", "step"), "lists", few=True)
        r += 1


def jaccard_components(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles and component_id for every row of docs(doc_id, text).

    Two texts are linked if 100 * intersection >= percent * union of their sets of word n-grams; component_id is the least
    doc_id that a text reaches over links, itself included. Texts without words (null, empty) are linked with nothing. Rows that
    repeat an id with the same set are that document again. A row without an id takes the component's least id, or null if no row of
    it has one. Extra columns are ignored; an empty table gives an empty result.
    """
    docs = docs.select("doc_id", "text", F.monotonically_increasing_id().alias(ROW))
    spread = _segments(docs, shingle, percent).groupBy("key").agg(F.min("cid").alias("lo"), F.max("cid").alias("hi"))
    shared = materialize(spread.where("lo < hi").select("key"), "shared")
    base = materialize(_base(docs, shared, shingle, percent), "base")
    classes = materialize(base.where("n_shingles > 0").groupBy("cid").agg(
        F.min("doc_id").alias("rep"), F.max("n_shingles").alias("n"), F.count("*").alias("copies"), F.min(ROW).alias("first"), F.min(KEY).alias(KEY)), "classes")
    one = base.join(classes.select(F.col("first").alias(ROW)), ROW, "left_semi").select("cid", (F.size("keys") / F.col("n_shingles")).alias("shared"), F.explode(F.arrays_zip("keys", "steps")).alias("x"))
    lists = materialize(one.select("cid", "shared", F.col("x.keys").alias("key"), F.col("x.steps").alias("step")).join(shared, "key", "left_semi"), "postings")
    wanted = materialize(classes.join(lists.select("cid").distinct(), "cid", "left_semi").select("cid", "n", KEY), "wanted", few=True)
    links = _Links(wanted.select("cid", "n"), materialize(_parts(docs, wanted, shingle, percent), "parts"), percent)
    links.compare(_proposals(lists))
    _finish(links, lists)
    return _label(base, classes, links.of).select("doc_id", "n_shingles", "component_id")


def op12_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), shingle=3, percent=90)


QUERIES = {"op12_jaccard_join": op12_jaccard_join}
ORACLES: dict[str, str] = {}
