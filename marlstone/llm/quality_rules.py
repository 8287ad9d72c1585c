"""Quality rules: a decision list learned from labelled statistics and applied as a Spark expression.

Statistics of every whole text are computed with built-in functions only. Rules that describe bad texts
are learned by sequential covering: each rule grows as a conjunction of thresholds on two thirds of the
labelled rows, is pruned on the remaining third, and is kept while it is precise there; what it covers
is set aside before the next rule. The ordered list becomes one `CASE WHEN`.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm.common import SPACE_CLASS, columns_of, let, table

#: Labelled rows that the list is learned from at most, chosen by a hash of their id.
MAX_LABELLED = 20_000
#: A rule must be this precise on the pruning rows and on all rows, and cover so many bad ones.
MIN_PRECISION, MIN_COVERED = 0.9, 5
#: Parameters of `learn`: rules of a list, conditions of a rule, and thresholds that are tried for a condition (values of
#: the labelled rows, evenly spaced in their order). They bound the search for rules, not the rows that are judged.
MAX_RULES, MAX_CONDITIONS, THRESHOLDS = 8, 3, 24
#: Repeated windows are looked up in a list of up to this many hashes, and by sorting beyond; both give the same count.
FEW = 24

FEATURES = {
    "symbol_share": "n_symbols / greatest(word_chars, 1)",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "mean_word": "word_chars / greatest(n_words, 1)",
    "distinct_share": "n_distinct / greatest(n_words, 1)",
    "words_per_line": "n_words / greatest(n_lines, 1)",
}


def words(text: Column) -> Column:
    """The words of a text in order; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE_CLASS + "+"), lambda w: w != "")


def repeated_words(w: Column) -> Column:
    """Words that lie in a 3-word window found twice or more, the first occurrence included.

    Windows are compared by a 64-bit hash of their words.
    """
    windows = F.transform(
        F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))
    )

    def covered(positions: Column) -> Column:
        start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("last"))
        return F.aggregate(
            positions, start,
            lambda a, p: F.struct((a["n"] + F.least(F.lit(3), p - a["last"])).alias("n"), p.alias("last")),
            lambda a: a["n"],
        )

    def by_list(h: Column, again: Column) -> Column:
        tagged = F.transform(h, lambda x, i: F.when(F.array_contains(again, x), i))
        return covered(F.filter(tagged, lambda p: p.isNotNull()))

    def by_sort(h: Column) -> Column:
        ordered = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        pair = lambda s: F.transform(
            F.filter(s, lambda x, i: (F.get(s, i - 1)["h"] == x["h"]) | (F.get(s, i + 1)["h"] == x["h"])),
            lambda x: x["i"],
        )
        return covered(F.sort_array(let(ordered, pair)))

    def again_in(h: Column) -> Column:
        return let(F.sort_array(h), lambda s: F.array_distinct(F.filter(s, lambda x, i: (i > 0) & (F.get(s, i - 1) == x))))

    def count(h: Column) -> Column:
        return let(again_in(h), lambda again: F.when(F.size(again) == 0, F.lit(0).cast("long"))
                   .when(F.size(again) <= FEW, by_list(h, again)).otherwise(by_sort(h)))

    return F.when(F.size(w) < 3, F.lit(0).cast("long")).otherwise(let(windows, count))


def with_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with a struct `_s` of statistics of the whole text.

    A null or empty text has none of anything. Existing columns stay, except one named `_s`.
    """
    t = F.coalesce(F.col(text), F.lit(""))

    def stats(w: Column) -> Column:
        lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
        with_lines = lambda ls: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            (F.size(F.split(t, r"[#*$%&|<>]")) - 1).cast("long").alias("n_symbols"),
            (F.size(ls) - F.size(F.array_distinct(ls))).cast("long").alias("n_dup_lines"),
            repeated_words(w).alias("n_repeat_words"),
            F.size(ls).cast("long").alias("n_lines"),
            F.size(F.array_distinct(w)).cast("long").alias("n_distinct"),
        )
        return let(lines, with_lines)

    # a generated column is computed once, whatever is asked of it later
    return docs.drop("_s").select("*", F.explode(F.array(let(words(t), stats))).alias("_s"))


def base_failed(s: str = "_s") -> Column:
    return (F.col(f"{s}.n_words") < 50) | (100 * F.col(f"{s}.n_repeat_words") > 50 * F.col(f"{s}.n_words"))


def features(df: DataFrame, s: str = "_s") -> DataFrame:
    """The shares that rules use, from the struct s, as columns."""
    flat = df.select("*", *[F.col(f"{s}.{k}").alias(k) for k in (
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct")])
    return flat.select("*", *[F.expr(e).alias(k) for k, e in FEATURES.items()])


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def holds(self, row: dict) -> bool:
        return row[self.feature] > self.threshold if self.above else row[self.feature] <= self.threshold

    def column(self) -> Column:
        c = F.expr(FEATURES[self.feature])
        return c > self.threshold if self.above else c <= self.threshold


@dataclass
class DecisionList:
    """Ordered rules that reject; what none covers is kept."""

    rules: list[list[Condition]]

    def kept(self) -> Column:
        """The verdict as an ordered conditional over the statistics' columns."""
        out = F.lit(True)
        for rule in reversed(self.rules):
            both = F.lit(True)
            for c in rule:
                both = both & c.column()
            out = F.when(both, F.lit(False)).otherwise(out)
        return out


def _covered(rows: list[dict], rule: list[Condition]) -> list[dict]:
    return [r for r in rows if all(c.holds(r) for c in rule)]


def _precision(rows: list[dict]) -> float:
    """Share of bad rows, with one row of doubt on each side."""
    return (sum(r["bad"] for r in rows) + 1) / (len(rows) + 2)


def _best_condition(rows: list[dict], thresholds: int) -> Condition | None:
    """The threshold with the most gain: bad rows covered times the precision won.

    It is set halfway between the last value on one side and the first on the other.
    """
    now, all_bad = _precision(rows), sum(r["bad"] for r in rows)
    best, gain = None, 0.0
    for f in FEATURES:
        ordered = sorted((r[f], r["bad"]) for r in rows)
        bad_up_to, bad = [], 0
        for _, is_bad in ordered:
            bad += is_bad
            bad_up_to.append(bad)
        cuts = [i for i in range(len(ordered) - 1) if ordered[i][0] < ordered[i + 1][0]]
        step = max(1, len(cuts) // thresholds)
        for i in {*cuts[::step], *cuts[:1], *cuts[-1:]}:
            for above in (True, False):
                n, n_bad = (len(rows) - i - 1, all_bad - bad_up_to[i]) if above else (i + 1, bad_up_to[i])
                won = n_bad * ((n_bad + 1) / (n + 2) - now)
                if n_bad >= MIN_COVERED and won > gain:
                    best, gain = Condition(f, above, (ordered[i][0] + ordered[i + 1][0]) / 2), won
    return best


def _grow(rows: list[dict], conditions: int, thresholds: int) -> list[Condition]:
    rule: list[Condition] = []
    inside = rows
    while len(rule) < conditions and inside and not all(r["bad"] for r in inside):
        best = _best_condition(inside, thresholds)
        if best is None:
            break
        rule.append(best)
        inside = [r for r in inside if best.holds(r)]
    return rule


def _prune(rule: list[Condition], rows: list[dict]) -> list[Condition]:
    """Drop final conditions while that does not lower precision on the pruning rows."""
    while len(rule) > 1 and _precision(_covered(rows, rule[:-1])) >= _precision(_covered(rows, rule)):
        rule = rule[:-1]
    return rule


def learn(rows: list[dict], max_rules: int = MAX_RULES, max_conditions: int = MAX_CONDITIONS, thresholds: int = THRESHOLDS) -> DecisionList:
    """Sequential covering over rows with the features, `bad` and `fold` (0 and 1 grow, 2 prunes)."""
    grow, prune = [r for r in rows if r["fold"] < 2], [r for r in rows if r["fold"] == 2]
    rules: list[list[Condition]] = []
    while len(rules) < max_rules and any(r["bad"] for r in grow):
        rule = _prune(_grow(grow, max_conditions, thresholds), prune)
        unseen = _covered(prune, rule)
        both = unseen + _covered(grow, rule)
        if not rule or sum(r["bad"] for r in both) < MIN_COVERED or _precision(both) < MIN_PRECISION or not unseen:
            break
        if sum(r["bad"] for r in unseen) < MIN_PRECISION * len(unseen):
            break
        rules.append(rule)
        grow = [r for r in grow if not all(c.holds(r) for c in rule)]
        prune = [r for r in prune if not all(c.holds(r) for c in rule)]
    return DecisionList(rules)


def labelled_rows(docs: DataFrame, labels: DataFrame, most: int = MAX_LABELLED) -> list[dict]:
    """Features and label of at most `most` labelled ids, those without one label left out; of an id with several texts the first
    by code point counts."""
    sample = (
        labels.where("quality in (0, 1) and doc_id is not null")
        .groupBy("doc_id").agg(F.max("quality").alias("hi"), F.min("quality").alias("lo")).where("hi = lo")
        .select("doc_id", (F.col("hi") == 0).alias("bad"), F.xxhash64(F.lit("sample"), "doc_id").alias("_h"))
        .orderBy("_h", "doc_id").limit(most)
    )
    joined = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")  # the sample has at most `most` rows
    joined = joined.groupBy("doc_id", "bad").agg(F.min("text").alias("text"))  # one row for each id
    rows = features(with_statistics(joined)).where(~base_failed())
    fold = F.pmod(F.xxhash64(F.lit("fold"), "doc_id"), F.lit(3))
    return [r.asDict() for r in rows.select("doc_id", "bad", fold.alias("fold"), *FEATURES).orderBy("doc_id", "fold").collect()]


def learn_from(docs: DataFrame, labels: DataFrame, most: int = MAX_LABELLED) -> DecisionList:
    """The list learned from documents that have a label; without bad labels it rejects nothing."""
    return learn(labelled_rows(docs, labels, most))


def judge(docs: DataFrame, rules: DecisionList) -> DataFrame:
    """docs with the statistics, base_failed and kept.

    Null and empty texts have no words and so fail the base rule. Each row is judged by itself, repeated
    rows alike; columns of docs other than those added stay.
    """
    flat = features(with_statistics(docs.drop(*FEATURES, "_s", "n_words", "word_chars", "n_symbols", "n_dup_lines",
                                              "n_repeat_words", "n_lines", "n_distinct")))
    return flat.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & rules.kept())


def filter_quality(docs: DataFrame, rules: DecisionList) -> DataFrame:
    """The rows of docs that are kept, with the columns of docs."""
    judged = with_statistics(docs.withColumn("_row", F.struct(*columns_of(docs))))
    flat = judged.select("_row", "_s.*")
    fails = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return flat.where(~fails & rules.kept()).select("_row.*")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rules = learn_from(docs, table(spark, sf_dir, "labels"))
    return judge(docs.select("doc_id", "text"), rules).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


QUERIES = {"op3_quality_rules": op3_quality_rules}
ORACLES: dict[str, str] = {}
