"""MinHash near-duplicates by an inverted join on signature coordinates.

1. Every text becomes its set of word shingles; texts with equal sets are one class. Each class has a MinHash
   signature of COORDINATES values.
2. Each class is posted under every pair of coordinate and value. Pairs that only one class has are skipped: a
   class with fewer shared coordinates than the match threshold can have no partner, and of the others only the
   prefix of the rarest is needed, since two classes that agree in `least` coordinates have one in either's prefix.
3. Every posting list elects leaders, classes whose coordinates are shared most and one by a hash; each class
   proposes to the leader of either kind with which its signature has most collisions, and proposals are confirmed on
   the full sets. So a group of thousands costs two comparisons for each member, not one for each pair.
4. Lists that still hold several components are looked at by their shingles: rarest first, two sets at the threshold
   share a shingle that comes so early in both that enough of either set is left behind it. Shingles that one class
   alone has, and lists whose places or sizes rule out a link or that lie in one component, are skipped. What is left
   is short lists, whose pairs count collisions and are confirmed, and long ones, whose leaders are compared with all
   members and then leave the list until it is short or of one component. No link between different texts is lost.
   So coordinates propose links and say which classes are open; the candidates of this last step come from shingles.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from marlstone.llm.common import columns_of, fresh, key_filter, materialize, table
from marlstone.llm.components import connected_components
from marlstone.llm.wordhash import NON_SPACE, U, mix, shingles, words_of

COORDINATES = 64
#: Lists of so many classes are compared pair by pair; of longer ones LEADERS classes a round are compared with all.
SHORT, LEADERS = 256, 64
#: Sizes within this ratio share a band.
BAND = 1.04
#: Bits of the filter of texts whose sets are kept; its false hits are joined away.
FILTER_BITS = 25
ROWS = 128
#: The column that numbers rows, since ids may be missing or repeated.
ROW, KEY = "_near_duplicates_row", "_near_duplicates_key"

_SEEDS = np.random.default_rng(20240601)
_MULTIPLY = _SEEDS.integers(1, 1 << 63, COORDINATES, dtype=np.uint64) * U(2) + U(1)
_ADD = _SEEDS.integers(0, 1 << 63, COORDINATES, dtype=np.uint64)


def least_matches(threshold: float, coordinates: int = COORDINATES) -> int:
    """Coordinates in which two sets at the threshold agree but for one case in some 100,000 (4.3 deviations)."""
    return max(1, math.floor(coordinates * threshold - 4.3 * math.sqrt(coordinates * threshold * (1 - threshold))))


def shingle_sets(texts: list[str | None], k: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; a text of fewer words is one shingle, one without words none."""
    w = words_of(texts, NON_SPACE)
    s, at = shingles(w, k)
    bounds = np.searchsorted(at, w.ptr)
    out = []
    for i in range(len(texts)):
        n = w.ptr[i + 1] - w.ptr[i]
        if n >= k:
            out.append(np.unique(s[bounds[i] : bounds[i + 1]]))
        elif n:
            whole = w.of(i)
            h = whole[:1].copy()
            for x in whole[1:]:
                h = mix(h * U(3) + x)
            out.append(h)
        else:
            out.append(np.zeros(0, dtype=U))
    return out


def class_id(s: np.ndarray) -> int:
    """A 64-bit id of a set, the same for equal sets; 0 is the empty set."""
    return int(mix(np.array([mix(s).sum() + U(len(s))], dtype=U)).view(np.int64)[0]) if len(s) else 0


def _signatures(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, row number, key (a hash of the text), n_shingles, cid and signature (null for an empty set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, ROWS):
                b = whole.slice(lo, ROWS)
                sets = shingle_sets(b.column("text").to_pylist(), k)
                full = [i for i, s in enumerate(sets) if len(s)]
                sig: list = [None] * len(sets)
                if full:
                    h = np.concatenate([sets[i] for i in full])
                    starts = np.cumsum([0] + [len(sets[i]) for i in full])[:-1]
                    values = np.stack([np.minimum.reduceat((h * m + a) >> U(32), starts) for m, a in zip(_MULTIPLY, _ADD, strict=True)], axis=1)
                    for i, v in zip(full, values.astype(np.uint32).view(np.int32).tolist(), strict=True):
                        sig[i] = v
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id"), b.column(ROW), b.column(KEY), pa.array([len(s) for s in sets], pa.int64()),
                     pa.array([class_id(s) for s in sets], pa.int64()), pa.array(sig, pa.list_(pa.int32()))],
                    names=["doc_id", ROW, KEY, "n_shingles", "cid", "sig"])

    return docs.select("doc_id", "text", ROW, F.xxhash64("text").alias(KEY)).mapInArrow(
        run, StructType([docs.schema["doc_id"], *StructType.fromDDL(f"{ROW} long, {KEY} long, n_shingles long, cid long, sig array<int>")]))


def _sets(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """cid and set (hashes) of the wanted classes (cid, key), one row each. Texts go by a filter of fixed size first, then by a join;
    a task emits a class once, so that a text with very many copies does not send as many sets."""
    keep = key_filter(wanted, KEY, FILTER_BITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for whole in batches:
            whole = whole.filter(pa.array(keep(whole.column(KEY).to_numpy())))
            for lo in range(0, whole.num_rows, ROWS):
                named = {class_id(s): s for s in shingle_sets(whole.column("text").slice(lo, ROWS).to_pylist(), k) if len(s)}
                sets = [s for c, s in named.items() if c not in seen]
                seen.update(named)
                ends = np.cumsum([0] + [len(s) for s in sets])
                flat = np.concatenate(sets) if sets else np.zeros(0, dtype=U)
                yield pa.RecordBatch.from_arrays([
                    pa.array([class_id(s) for s in sets], pa.int64()),
                    pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat.view(np.int64)))], names=["cid", "set"])

    found = docs.select("text", F.xxhash64("text").alias(KEY)).mapInArrow(run, "cid long, set array<long>")
    return found.join(wanted.select("cid"), "cid", "left_semi").dropDuplicates(["cid"])


def _same(x: str, y: str) -> Column:
    """Coordinates in which two signatures agree."""
    return F.size(F.filter(F.arrays_zip(x, y), lambda z: z[x] == z[y]))


def _confirm(sets: DataFrame, pairs: DataFrame, least: int, percent: int) -> DataFrame:
    """The pairs (a, b) of at least `least` collisions whose full sets have 100 * intersection >= percent * union."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = []
            for x, y in zip(b.column("sa"), b.column("sb"), strict=True):
                both = np.concatenate((x.values.to_numpy(), y.values.to_numpy()))
                both.sort()
                same = int(np.count_nonzero(both[1:] == both[:-1]))
                ok.append(100 * same >= percent * (len(both) - same))
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    left = sets.select(F.col("cid").alias("a"), F.col("set").alias("sa"), F.col("sig").alias("ga"))
    right = sets.select(F.col("cid").alias("b"), F.col("set").alias("sb"), F.col("sig").alias("gb"))
    met = pairs.select("a", "b").join(left, "a").join(right, "b").where(_same("ga", "gb") >= least)
    return met.select("a", "b", "sa", "sb").mapInArrow(check, "a long, b long")


def _collisions(pairs: DataFrame, classes: DataFrame, least: int, percent: int) -> DataFrame:
    """The pairs (a, b, kind) with n (coordinates that agree) of at least `least` and sizes within the threshold."""
    a = classes.select(F.col("cid").alias("a"), F.col("sig").alias("ga"), F.col("n_shingles").alias("na"))
    b = classes.select(F.col("cid").alias("b"), F.col("sig").alias("gb"), F.col("n_shingles").alias("nb"))
    counted = pairs.join(a, "a").join(b, "b").where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
    return counted.select("a", "b", "kind", _same("ga", "gb").alias("n")).where(F.col("n") >= least)


class _Groups:
    """The components that links have joined so far: cid and c of every class that has a posting."""

    def __init__(self, wanted: DataFrame, sets: DataFrame, least: int, percent: int):
        self.sets, self.least, self.percent = sets, least, percent
        self.of = wanted.select("cid", F.col("cid").alias("c"))

    def join(self, rows: DataFrame) -> DataFrame:
        """rows, which have a cid, with their component c."""
        return rows.join(self.of, "cid")

    def link(self, pairs: DataFrame) -> bool:
        """Confirm pairs (a, b) and merge what they link; whether there was a link."""
        links = _confirm(self.sets, pairs, self.least, self.percent)
        a, b = self.of.toDF("a", "ca"), self.of.toDF("b", "cb")
        between = materialize(links.join(a, "a").join(b, "b").where("ca <> cb").select(F.least("ca", "cb").alias("ca"), F.greatest("ca", "cb").alias("cb")).distinct(), "links", few=True)
        if between.isEmpty():
            return False
        roots = connected_components(between, "ca", "cb").toDF("c", "root")
        self.of = materialize(self.of.join(roots, "c", "left").select("cid", F.coalesce("root", "c").alias("c")), "groups", few=True)
        return True


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of docs(doc_id, text).

    Two texts are linked if 100 * intersection >= percent * union of their shingle sets; component_id is the
    least doc_id that a text reaches over links, itself included, and kept marks that document. Texts without
    words (null, empty) are linked with nothing. Rows that repeat an id with the same set are that document again and
    are kept or not alike; where the component's least id has several sets, one of them is kept. A row without an id
    takes the component's least id, or null if no row of it has one; of the latter, one row of each component is kept.
    Extra columns are ignored; an empty table gives an empty result.
    """
    return _judged(docs.select("doc_id", "text", F.monotonically_increasing_id().alias(ROW)), shingle, percent).drop(ROW)


def _judged(docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """near_duplicates with the number of each row, as the table of signatures stores it."""
    least = least_matches(percent / 100)
    base = materialize(_signatures(docs, shingle), "signatures")
    classes = materialize(base.where("n_shingles > 0").groupBy("cid").agg(
        F.min("doc_id").alias("rep"), F.max("n_shingles").alias("n_shingles"), F.count("*").alias("copies"), F.first("sig").alias("sig"),
        F.min(ROW).alias("first"), F.min(KEY).alias(KEY)), "classes")
    lists = _prefix_lists(classes, least)
    wanted = materialize(classes.join(lists.select("cid").distinct(), "cid", "left_semi"), "wanted")
    sets = materialize(_sets(docs, wanted, shingle).join(wanted.select("cid", "sig"), "cid"), "sets")
    groups = _Groups(wanted, sets, least, percent)
    groups.link(_proposals(lists, wanted, least, percent))
    _link_by_shingles(groups, lists)
    return _label(base, classes, groups.of)


def _prefix_lists(classes: DataFrame, least: int) -> DataFrame:
    """cid, j, v and shared: the postings that are needed to find partners; shared is the length of all lists that the class is in."""
    posted = classes.select("cid", F.posexplode("sig").alias("j", "v"))
    counts = posted.groupBy("j", "v").agg(F.count("*").alias("n")).where("n > 1")
    shared = posted.join(counts, ["j", "v"]).groupBy("cid").agg(F.sort_array(F.collect_list(F.struct("n", "j", "v"))).alias("s"), F.sum("n").alias("shared"))
    prefix = F.slice("s", F.lit(1), F.greatest(F.lit(0), F.size("s") - least + 1))
    cut = shared.where(F.size("s") >= least).select("cid", "shared", F.explode(prefix).alias("x"))
    return materialize(cut.select("cid", "shared", "x.j", "x.v"), "postings")


def _proposals(lists: DataFrame, classes: DataFrame, least: int, percent: int) -> DataFrame:
    """For each class the leader of one of its lists with most collisions, among those that share most and those by hash."""
    central = F.min(F.struct((-F.col("shared")).alias("o"), F.xxhash64("cid").alias("h"), "cid"))
    drawn = F.min(F.struct(F.xxhash64(F.lit("drawn"), F.col("j") % 4, "cid").alias("h"), "cid"))
    leaders = lists.groupBy("j", "v").agg(central.alias("x"), drawn.alias("y")).select("j", "v", F.array(
        F.struct(F.lit(0).alias("kind"), F.col("x.cid").alias("a")), F.struct(F.lit(1).alias("kind"), F.col("y.cid").alias("a"))).alias("s"))
    pairs = lists.join(leaders, ["j", "v"]).select(F.col("cid").alias("b"), F.inline("s")).where("a <> b").distinct()
    best = _collisions(pairs, classes, least, percent).groupBy("b", "kind").agg(F.max(F.struct("n", "a")).alias("m"))
    return best.select(F.least("m.a", "b").alias("a"), F.greatest("m.a", "b").alias("b")).distinct()


def _enough(n: Column, other: Column, percent: int) -> Column:
    """Shingles that sets of these sizes share at the threshold, at least."""
    return F.ceil((n + other) * percent / (100 + percent))


def _shingle_lists(groups: _Groups, lists: DataFrame, percent: int) -> DataFrame:
    """cid, c, n, i, t and band: classes posted under the shingles by which they can find partners of another component.

    i is the shingle's place in its class, rarest first; behind it n - i shingles are left, the shingle itself included.
    A class is posted in the band of its own size and as a guest in the bands above that partners can have.
    """
    mixed = groups.join(lists).groupBy("j", "v").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi").select("j", "v")
    open_ = lists.join(mixed, ["j", "v"], "left_semi").select("cid").distinct()
    tokens = groups.sets.join(open_, "cid", "left_semi").select("cid", F.size("set").alias("n"), F.explode("set").alias("t"))
    often = tokens.groupBy("t").agg(F.count("*").alias("df")).where("df > 1")
    ranked = tokens.join(often, "t").groupBy("cid", "n").agg(F.sort_array(F.collect_list(F.struct("df", "t"))).alias("s"))
    alone = F.col("n") - F.size("s")  # shingles of this class only come first
    most = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
    placed = ranked.where(alone < most).select(
        "cid", "n", alone.alias("alone"), F.posexplode(F.slice("s", F.lit(1), (most - alone).cast("int"))).alias("p", "x")).select(
        "cid", "n", (F.col("alone") + F.col("p")).alias("i"), "x.t")
    band = lambda n: F.floor(F.log(n.cast("double")) / math.log(BAND))
    own, last = band(F.col("n")), band(F.col("n") * 100.0 / percent)
    posted = groups.join(placed).select("*", (own).alias("own"), F.explode(F.sequence(own, last)).alias("band"))
    # a guest meets only classes of the band's sizes or more
    least_size = F.greatest("n", F.ceil(F.pow(F.lit(BAND), "band") - 1e-6))
    posted = posted.where((F.col("band") == F.col("own")) | (F.col("n") - F.col("i") >= _enough(F.col("n"), least_size, percent)))
    posted = materialize(posted.withColumn("home", F.col("band") == F.col("own")).drop("own"), "shingles")
    sizes = posted.groupBy("t", "band").agg(
        F.min("n").alias("any_n"), F.min(F.when(F.col("home"), F.col("n"))).alias("home_n"), F.min("c").alias("lo"), F.max("c").alias("hi"))
    sizes = sizes.where("lo < hi and home_n is not null").select("t", "band", "any_n", "home_n")
    partner = F.when(F.col("home"), F.col("any_n")).otherwise(F.col("home_n"))
    alive = posted.join(sizes, ["t", "band"]).where(F.col("n") - F.col("i") >= _enough(F.col("n"), partner, percent))
    return materialize(alive.drop("any_n", "home_n"), "shingles")


def _link_by_shingles(groups: _Groups, lists: DataFrame) -> None:
    """Find all links between components that are left: short lists pair by pair, then leaders of the long ones."""
    percent = groups.percent
    alive = _shingle_lists(groups, lists, percent).drop("c")
    done = None  # the leaders that have been compared, with their lists

    def open_lists() -> tuple[DataFrame, DataFrame]:
        now = groups.join(alive if done is None else alive.join(done, ["t", "band", "cid"], "left_anti"))
        now = materialize(now, "lists", few=True)
        by_group = now.groupBy("t", "band", "c").agg(F.count("*").alias("m"), F.max("home").alias("homes"))
        about = by_group.groupBy("t", "band").agg(
            F.sum("m").alias("m"), F.max(F.struct("m", "c")).alias("top"), F.count("*").alias("groups"), F.max("homes").alias("homes")).where("groups > 1 and homes")
        return now, materialize(about.select("t", "band", "m", (F.col("m") - F.col("top.m")).alias("others"), F.col("top.c").alias("top")), "lists", few=True)

    def compare(pairs: DataFrame) -> None:
        groups.link(pairs.distinct())

    r = 0
    while True:
        now, about = open_lists()
        if about.isEmpty():
            return
        member = now.join(about, ["t", "band"])
        short, long_ = member.where(F.col("m") <= SHORT), member.where(F.col("m") > SHORT)
        if r == 0:  # what short lists link need not be compared in long ones
            compare(_pairs(short, short, percent))
        else:
            # only classes outside a list's largest component have to be compared with all
            drawn = F.xxhash64(F.lit(r), "t", "cid")
            chosen = member.where(F.col("c") != F.col("top")).where(F.pmod(drawn, F.col("others")) < LEADERS).groupBy("t", "band").agg(
                F.slice(F.sort_array(F.collect_set(F.struct(drawn.alias("h"), "cid"))), 1, 2 * LEADERS).alias("s"))
            leaders = materialize(chosen.select("t", "band", F.explode("s").alias("x")).select("t", "band", "x.cid"), "leaders", few=True)
            compare(_pairs(member.join(leaders, ["t", "band", "cid"]), member, percent, both=True))
            done = leaders if done is None else materialize(done.union(leaders), "leaders", few=True)
        left = about.where(F.col("others") > LEADERS) if r else about.where(F.col("m") > SHORT)
        left = left.select("t", "band")
        if left.isEmpty():
            return
        alive, r = materialize(alive.join(left, ["t", "band"], "left_semi"), "lists", few=True), r + 1


def _pairs(left: DataFrame, right: DataFrame, percent: int, both: bool = False) -> DataFrame:
    """Pairs (a, b) of different components in one list whose sizes and places leave room for a link; each once if
    left is right, else every class of left with every one of right."""
    x, y = left.alias("x"), right.alias("y")
    na, nb = F.col("x.n"), F.col("y.n")
    room = F.least(na - F.col("x.i"), nb - F.col("y.i")) >= _enough(na, nb, percent)
    once = F.col("x.cid") != F.col("y.cid") if both else F.col("x.cid") < F.col("y.cid")
    on = (F.col("x.t") == F.col("y.t")) & (F.col("x.band") == F.col("y.band")) & (F.col("x.c") != F.col("y.c")) & once & (F.col("x.home") | F.col("y.home")) & room
    return x.join(y, on).select(F.least("x.cid", "y.cid").alias("a"), F.greatest("x.cid", "y.cid").alias("b"))


def _label(base: DataFrame, classes: DataFrame, groups: DataFrame) -> DataFrame:
    of_class = classes.join(groups, "cid", "left").select(
        "cid", "rep", "copies", "first", F.col("c").alias("_root"), F.col("c").isNotNull().alias("_linked"))
    # the least id and one class that has it; classes without ids come last
    names = of_class.where("_linked").groupBy("_root").agg(F.min(F.struct(F.col("rep").isNull().alias("none"), "rep", "cid")).alias("_m"))
    named = of_class.where("_linked").join(names, "_root").select(
        "cid", F.col("_m.rep").alias("component_id"), "first", (F.col("cid") == F.col("_m.cid")).alias("_stands")).union(
        of_class.where("not _linked and copies > 1").select("cid", "rep", "first", F.lit(True)))
    out = base.select("doc_id", ROW, "n_shingles", "cid").join(named, "cid", "left")
    in_group = (F.col("n_shingles") > 0) & F.col("_stands").isNotNull()
    kept = F.col("_stands") & F.when(F.col("component_id").isNull(), F.col(ROW) == F.col("first")).otherwise(
        F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))
    return out.select("doc_id", ROW, "n_shingles", F.when(in_group, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
                      F.when(in_group, kept).otherwise(True).alias("kept"))


def keep_one(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs that stand for their component, with the columns of docs; rows are told apart by a stored number."""
    row = fresh(ROW, docs.columns)
    numbered = materialize(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    judged = _judged(numbered.select("doc_id", "text", F.col(row).alias(ROW)), shingle, percent).where("not kept").select(F.col(ROW).alias(row))
    return numbered.join(judged, row, "left_anti").select(*columns_of(docs))


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), shingle=3, percent=85)


QUERIES = {"op8_near_dedup": op8_near_dedup}
ORACLES: dict[str, str] = {}
