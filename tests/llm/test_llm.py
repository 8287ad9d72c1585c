"""The training-data operators against brute force, SQL and hand-made cases."""


import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from marlstone.llm import compression_quality, decontamination, katz, licence_scan, mixing, near_duplicates, quality_rules, registry, token_ids, url_filter, wordhash
from tests.compare import assert_same, connect

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"w{i % 977} v{i % 31}" for i in range(40_000))
ODD = [
    (1, None, None, None, None), (2, "", "en", "s", 0), (3, "one", "en", "s", 3), (4, LONG, "en", "s", len(LONG)), (5, LONG, None, "s", None), (None, "a b c d", "en", None, 7),
    (7, "tie tie tie tie", "en", "t", 1), (7, "tie tie tie tie", "en", "t", 1), (8, " \t\n\x0b ", "en", "t", 1), (9, "Ünï çödé — “quotes” 日本語 <|endoftext|>", "x", "u", 9),
]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and very long texts, repeated rows, and columns whose names clash with those of results."""
    return spark.createDataFrame(ODD, SCHEMA).withColumns({c: F.lit(1) for c in ("size", "kept", "score", "component_id", "n_words", "_s", "rank")})


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_sql(spark, sf_dir, name):
    assert_same(registry.QUERIES[name](spark, sf_dir), connect(sf_dir), registry.ORACLES[name])


def test_entry_has_all():
    import __spark_entry__ as E

    assert {f"op{n}" for n in range(1, 14)} <= {q.split("_")[0] for q in E.queries()} and "pipeline" in E.queries()


# ---- words

def plain_words(text, pattern="[^\x20\x09-\x0d]+", lower=True):
    t = text or ""
    return re.findall(pattern, "".join(c.lower() if "A" <= c <= "Z" else c for c in t) if lower else t)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aB \n\t.é日", max_size=30)), max_size=6), st.integers(1, 40))
def test_words_are_those_of_the_pattern(texts, segment):
    before, wordhash.SEGMENT = wordhash.SEGMENT, segment
    try:
        w = wordhash.words_of(texts, wordhash.NON_SPACE)
    finally:
        wordhash.SEGMENT = before
    names: dict = {}
    for i, t in enumerate(texts):
        own = plain_words(t)
        assert len(w.of(i)) == len(own)
        for h, x in zip(w.of(i).tolist(), own):
            assert names.setdefault(h, x) == x
    assert len(set(names.values())) == len(names)


# ---- 1 URL filter

URLS = ["http://A.example.NET/en/x?q", "https://example.net", "http://net/", "http://network/", "http://x.example.com/de/1#a", "http://example.org/fr/", "ftp://example.org/en", "nothing", None, "a://b://c/d", "http://example.net/en/"]


@pytest.mark.parametrize("how", ["list", "table"])
def test_url_rules(spark, how):
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(URLS)] + [(None, URLS[0], "x")] * 2, "page_id long, url string, rule string")
    rules = url_filter.RULES if how == "list" else spark.createDataFrame(url_filter.RULES, "host string, path string, verdict string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.filter_urls(pages, rules).collect()}
    assert got[0] == got[None] == ("a.example.net", "/en/x", "example.net/en/", "allow")
    assert got[1] == ("example.net", "", None, "allow")
    assert got[2][2:] == ("net/", "block") and got[3][2:] == (None, "allow")
    assert got[4][2:] == ("example.com/de/", "block") and got[5][2:] == ("org/fr/", "allow") and got[6][2] is None
    assert got[7][:2] == got[8][:2] == ("", "") and got[9][:2] == ("b:", "//c/d")


def test_many_url_rules_and_a_hot_host(spark):
    """Rules at every level, with ties and nulls, swept in many ranges, against each rule tried on each url."""
    rng = np.random.default_rng(3)
    label = lambda: "abc"[rng.integers(0, 3)]
    host = lambda: ".".join(label() for _ in range(rng.integers(1, 5)))
    path = lambda: "/" + "".join("xy/"[rng.integers(0, 3)] for _ in range(rng.integers(0, 6)))
    rules = [(host(), path(), ["allow", "block"][rng.integers(0, 2)]) for _ in range(300)] + [("a", "", "block"), ("a", "/", "allow"), ("a", "/", "block")]
    nulls = [(None, "/", "block"), ("a", None, "block"), ("a", "/x", None)]
    hosts = [host() for _ in range(300)] + ["a.b.c"] * 150
    urls = [f"http://{h}{path()}?q" for h in hosts]

    def judged(h, p):
        fit = [(len(rh + rp), len(rh), rh + rp, v) for rh, rp, v in sorted(rules, reverse=True) if (h == rh or h.endswith("." + rh)) and p.startswith(rp)]
        best = max(fit, key=lambda x: x[:2], default=None)
        return (None, "allow") if best is None else (best[2], min(x[3] for x in fit if x[:3] == best[:3]))

    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "37")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = url_filter.filter_urls(pages, spark.createDataFrame(rules + nulls, "host string, path string, verdict string")).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(got) == len(urls)
    for r in got:
        assert (r.host, r.path) == tuple(re.match("http://([^/]*)([^?]*)", urls[r.page_id]).groups())
        assert (r.rule, r.verdict) == judged(r.host, r.path)


def test_no_pages(spark):
    assert url_filter.filter_urls(spark.createDataFrame([], "page_id long, url string"), url_filter.RULES).count() == 0


# ---- 2 and 5 tokens

def test_ids_round_trip(spark, odd, sf_dir, monkeypatch):
    monkeypatch.setattr(token_ids, "SHARD_ROWS", 40)
    monkeypatch.setattr(token_ids, "BLOCK_IDS", 5_000)
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(token_ids.tokenizer_path())
    for docs in (odd, documents(spark, sf_dir)):
        got = sorted(token_ids.read_ids(spark, token_ids.write_ids(docs, token_ids.tokenizer_path()), with_ids=True).collect(), key=lambda r: r.start)
        rows = docs.select("doc_id", "text").collect()
        want = sorted([((-1 if r.doc_id is None else r.doc_id), t.encode(r.text or "", add_special_tokens=False).ids + [1]) for r in rows])
        assert [(-1 if r.doc_id is None else r.doc_id) for r in got] == [w[0] for w in want]
        at = 0
        for r, (_, ids) in zip(got, want):
            assert r.start == at and r.n_tokens == len(ids)
            at += len(ids)
        assert Counter((r.doc_id, bytes(r.ids)) for r in got) == Counter((None if d == -1 else d, np.array(i, dtype="<u4").tobytes()) for d, i in want)
        assert all(r.ids_crc32 == zlib.crc32(bytes(r.ids)) for r in got)


def test_no_ids(spark, empty):
    assert token_ids.read_ids(spark, token_ids.write_ids(empty, token_ids.tokenizer_path())).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1), max_size=50))
def test_code(values):
    v = np.array(values, dtype="<u4")
    assert token_ids.decode_ranks(*token_ids.encode_ranks(v), np.array([len(v)])).tolist() == values
    a, b = token_ids.encode_ranks(v), token_ids.encode_ranks(v[::-1])
    both = token_ids.decode_ranks(a[0] + b[0], a[1] + b[1], np.array([len(v), len(v)]))
    assert both.tolist() == values + values[::-1]


@pytest.mark.parametrize("name, parted", [("word_bpe_49k.json", True), ("byte_bpe_50k.json", False)])
def test_any_tokenizer(spark, odd, sf_dir, name, parted):
    from tokenizers import Tokenizer

    path = token_ids.tokenizer_path(name)
    t = Tokenizer.from_file(path)
    docs = odd.select("doc_id", "text").union(documents(spark, sf_dir).select("doc_id", "text").limit(40))
    assert token_ids.Encoder(path).parted == token_ids.Encoder(path).plain == parted
    got = Counter(bytes(r.ids) for r in token_ids.read_ids(spark, token_ids.write_ids(docs, path, end_id=None), with_ids=True).collect())
    assert got == Counter(np.array(t.encode(r.text or "", add_special_tokens=False).ids, dtype="<u4").tobytes() for r in docs.collect())


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aBé'sS \n\t\u00a0\u0301İΣσ.<|endoftx>12日\x1c\u2028", max_size=40)), min_size=1, max_size=4))
def test_pieces_give_what_whole_texts_give(texts):
    e = token_ids.encoder(token_ids.tokenizer_path())
    e.unchecked = 0
    assert [x.tolist() for x in e.ids(texts)] == [e.library.encode(x or "", add_special_tokens=False).ids for x in texts]


def test_other_splits_are_not_taken_for_blanks():
    split = {"type": "Split", "pattern": {"Regex": " ?[a-z]+"}, "behavior": "Removed", "invert": True}
    config = {"normalizer": None, "pre_tokenizer": split, "added_tokens": [], "post_processor": None}
    assert not token_ids.blanks_part(config) and not token_ids.blanks_part(config | {"pre_tokenizer": None})
    assert token_ids.blanks_part(config | {"pre_tokenizer": split | {"pattern": {"Regex": "[a-z]+|[^a-z\\s]+"}}})


def test_counts(spark, sf_dir):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(token_ids.tokenizer_path())
    lengths = [len(t.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in documents(spark, sf_dir).collect()]
    sums = token_ids.with_suffix_sums(token_ids.length_histogram(documents(spark, sf_dir), token_ids.tokenizer_path())).cache()
    for r in sums.collect():
        assert r.n_docs == lengths.count(r.length) and r.docs_from == sum(x >= r.length for x in lengths)
        assert r.tokens_from == sum(x for x in lengths if x >= r.length) and r.truncated_total == sum(min(x, r.length) for x in lengths)
    got = {r.limit: r.total for r in token_ids.truncated_totals(sums, [1, 100, 10**6]).collect()}
    assert got == {k: sum(min(x, k) for x in lengths) for k in (1, 100, 10**6)}
    q = {r.share: r.length for r in token_ids.quantiles(sums, [0.5, 1.0]).collect()}
    assert q == {0.5: sorted(lengths)[math.ceil(len(lengths) / 2) - 1], 1.0: max(lengths)}
    per_cent = {p: r.length for r in sums.collect() for p in r.percents}
    assert per_cent == {p: sorted(lengths)[math.ceil(p * len(lengths) / 100) - 1] for p in range(1, 101)}


def test_count_query(spark, sf_dir):
    got = {r.length: r for r in registry.QUERIES["op5_token_counts"](spark, sf_dir).collect()}
    lengths = [r.n_tokens for r in token_ids.count_tokens(documents(spark, sf_dir), token_ids.tokenizer_path()).collect()]
    assert set(got) == {*lengths, *token_ids.LIMITS}
    for x in token_ids.LIMITS:
        assert got[x].truncated_total == sum(min(n, x) for n in lengths) and got[x].docs_from == sum(n >= x for n in lengths)


def test_count_of_nothing(spark, empty, odd):
    assert token_ids.with_suffix_sums(token_ids.length_histogram(empty, token_ids.tokenizer_path())).count() == 0
    assert token_ids.length_histogram(odd, token_ids.tokenizer_path()).agg(F.sum("n_docs")).first()[0] == len(ODD)


# ---- 3 quality rules

def statistics(t):
    t = t or ""
    w = plain_words(t, lower=False)
    lines = [x for x in t.split("\n") if plain_words(x)]
    tri = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n, hit = Counter(tri), set()
    for i, x in enumerate(tri):
        if n[x] > 1:
            hit |= {i, i + 1, i + 2}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(hit)


def test_statistics(spark, odd, sf_dir):
    extra = spark.createDataFrame([(20, "a b c a b c"), (21, " ".join(f"r{i % 50} s{i % 50}" for i in range(300))), (22, "x\ny\nx\n \nx"), (23, "# a * b | c <d> & $ %")], "doc_id long, text string")
    for docs in (odd, extra, documents(spark, sf_dir)):
        rows = quality_rules.with_statistics(docs).select("text", "_s").collect()
        assert all(tuple(r._s)[:5] == statistics(r.text) for r in rows)


def test_rules_find_bad_texts(spark, sf_dir):
    d = sf_dir.replace("0.001", "0.01")
    docs, labels = documents(spark, d), spark.read.parquet(f"{d}/labels.parquet")
    rules = quality_rules.learn_from(docs, labels)
    judged = quality_rules.judge(docs, rules).select("doc_id", "base_failed", "kept").join(labels.select("doc_id", "quality"), "doc_id").where("not base_failed").collect()
    right = sum(r.kept == (r.quality == 1) for r in judged)
    assert rules.rules and right / len(judged) > 0.95
    assert quality_rules.filter_quality(docs, rules).columns == docs.columns


def test_verdicts_are_those_of_the_rules(spark, odd, sf_dir):
    """The expression in Spark against the conditions one by one, rows without words included."""
    C = quality_rules.Condition
    rules = quality_rules.DecisionList([[C("symbol_share", True, 0.05), C("mean_word", False, 6.0)], [C("dup_line_share", True, 0.2)], [C("distinct_share", False, 0.3)], [C("words_per_line", True, 90.0)]])
    kinds = set()
    for docs in (odd, documents(spark, sf_dir)):
        for r in quality_rules.judge(docs, rules).collect():
            row = r.asDict()
            failed = row["n_words"] < 50 or 100 * row["n_repeat_words"] > 50 * row["n_words"]
            kept = not failed and not any(all(c.holds(row) for c in rule) for rule in rules.rules)
            assert (row["base_failed"], row["kept"]) == (failed, kept)
            kinds.add((failed, kept))
        assert quality_rules.filter_quality(docs, rules).count() == quality_rules.judge(docs, rules).where("kept").count()
    assert len(kinds) == 3


def test_rules_without_labels(spark, odd, empty):
    none = quality_rules.learn([])
    assert none.rules == []
    got = quality_rules.judge(odd, none).select("doc_id", "base_failed", "kept").collect()
    assert len(got) == len(ODD) and {r.doc_id: r.kept for r in got}[1] is False
    assert quality_rules.filter_quality(empty, none).count() == 0
    assert quality_rules.filter_quality(odd, none).columns == odd.columns


# ---- 4 mixing

def test_mix(spark, odd, empty, sf_dir):
    for docs in (odd, documents(spark, sf_dir)):
        rows = mixing.place(docs).collect()
        assert len(rows) == docs.count()
        total, per = sum(r.size for r in rows), defaultdict(list)
        for r in rows:
            per[r.source].append(r)
            assert 0 <= r.taken <= 3 * r.size
        for own in per.values():
            assert sum(r.size for r in own) == own[0].source_size and abs(sum(r.taken for r in own) - own[0].target) <= 1
        assert abs(sum(own[0].target for own in per.values()) - min(total, 3 * total)) < 1e-6 * total + 1
        mixed = mixing.mix(docs)
        assert mixed.columns == docs.columns
        assert mixed.select(F.sum(mixing.n_words(F.col("text")))).first()[0] == sum(r.taken for r in rows)
    assert mixing.place(empty).count() == mixing.mix(empty).count() == 0


def test_mix_of_private_names_and_one_id(spark):
    rows = [(1, f"word{i} and more words {i}", "s", "keep") for i in range(300)] + [(None, "a b", None, "keep")] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, _row string").withColumns({c: F.col("_row") for c in ("_key", "_range", "cut", "copies", "_n")})
    placed, mixed = mixing.place(docs).collect(), mixing.mix(docs)
    assert len(placed) == 303 and len({r._range for r in placed}) > 100
    assert mixed.columns == docs.columns and {(r._row, r._n, r.cut) for r in mixed.collect()} == {("keep",) * 3}
    assert mixed.select(F.sum(mixing.n_words(F.col("text")))).first()[0] == sum(r.taken for r in placed)


# ---- 6 decontamination

def test_windows(spark):
    ten = " ".join(f"x{i}" for i in range(10))
    items = spark.createDataFrame([(1, ten), (2, "short Item"), (3, None), (4, ""), (None, "y z"), (10, ten + " x10"), (11, "short item")], "item_id long, text string")
    docs = spark.createDataFrame(
        [(1, "a, " + ten.upper() + " b"), (2, "x0 x1 x2"), (3, None), (4, ""), (5, f"{ten} {ten} x10"), (6, "a short, item! short item"), (6, "a short, item! short item")], "doc_id long, text string")
    got = [(r.doc_id, r.n_words, r.n_hit, list(r.items)) for r in decontamination.find_leaks(docs, items).orderBy("doc_id").collect()]
    assert got == [(1, 12, 10, ["1", "10"]), (2, 3, 0, []), (3, 0, 0, []), (4, 0, 0, []), (5, 21, 21, ["1", "10"]), (6, 5, 4, ["11", "2"]), (6, 5, 4, ["11", "2"])]


def brute_leaks(text, items):
    """Words, hit words and items of a text, by every window at every place."""
    words = plain_words(text, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    hit, who = set(), set()
    for item, body in items:
        own = plain_words(body, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
        for w in {tuple(own[i : i + 10]) for i in range(max(1, len(own) - 9))} if own else ():
            at = [i for i in range(len(words) - len(w) + 1) if tuple(words[i : i + len(w)]) == w]
            hit.update(i + j for i in at for j in range(len(w)))
            who |= {str(item)} if at else set()
    return len(words), len(hit), sorted(who)


@pytest.mark.parametrize("bits", [decontamination.FILTER_BITS, 15])
def test_windows_that_many_texts_share(spark, odd, bits, monkeypatch):
    """A passage in most items and documents, items of all lengths, a filter with and without false hits."""
    monkeypatch.setattr(decontamination, "FILTER_BITS", bits)
    rng = np.random.default_rng(4)
    common = [f"c{i % 7}" for i in range(14)]
    words = lambda n: [f"w{x}" for x in rng.integers(0, 6, n)]
    items = [(i, " ".join([*words(i % 13), *common[: 12 if i % 2 else 0], *words(i % 4)])) for i in range(40)]
    docs = [(i, " ".join([*words(60), *common, *words(5), *(items[i % 40][1].upper().split() if i % 3 else ())])) for i in range(60)]
    docs += [r[:2] for r in ODD if r[1] != LONG]
    got = decontamination.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    want = Counter((d, *brute_leaks(t, items)[:2], tuple(brute_leaks(t, items)[2])) for d, t in docs)
    assert Counter((r.doc_id, r.n_words, r.n_hit, tuple(r.items)) for r in got) == want
    assert all(sum(b - a for a, b in zip(r.spans[::2], r.spans[1::2])) == r.n_hit for r in got)


def test_dotted_names_stay(spark, odd, sf_dir):
    """Columns with dots and back-quotes in their names go through the stages that filter."""
    docs = documents(spark, sf_dir).withColumns({"a.b": F.lit(1), "c`d": F.lit(2)})
    labels, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("labels", "benchmark"))
    for kept in (quality_rules.filter_quality(docs, quality_rules.learn_from(docs, labels)), near_duplicates.keep_one(docs), decontamination.remove_leaks(docs, items)):
        assert kept.columns == docs.columns and 0 < kept.count() <= docs.count()


def test_many_copies_of_a_near_copied_text_are_one_set(spark):
    rows = [(i, " ".join(f"w{j}" for j in range(60))) for i in range(3000)] + [(5000, " ".join(f"w{j}" for j in range(61)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    wanted = near_duplicates._signatures(docs.withColumn(near_duplicates.ROW, F.monotonically_increasing_id()), 3).groupBy("cid").agg(F.min(near_duplicates.KEY).alias(near_duplicates.KEY))
    plan = near_duplicates._sets(docs, wanted, 3)
    assert plan.count() == 2
    got = near_duplicates.near_duplicates(docs, 3, 85).collect()
    assert {r.component_id for r in got} == {0} and sum(r.kept for r in got) == 1


def test_leaks_keep_the_callers_columns(spark):
    ten = " ".join(f"x{i}" for i in range(10))
    docs = spark.createDataFrame([(1, ten, "keep"), (2, "clean " + ten[:-1], "keep"), (3, None, "keep")], "doc_id long, text string, k1 string").withColumns(
        {c: F.col("k1") for c in ("_hit", "_n", "_items", "K2", "s", "w", "items", "n_words")})
    kept = decontamination.remove_leaks(docs, spark.createDataFrame([(1, ten)], "item_id long, text string"))
    assert kept.columns == docs.columns
    assert {(r.doc_id, r._hit, r._n, r.k1, r.K2, r.items) for r in kept.collect()} == {(d, *["keep"] * 5) for d in (2, 3)}


def test_no_items(spark, odd, empty):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.find_leaks(odd, none).where("contaminated").count() == 0
    kept = decontamination.remove_leaks(odd, none)
    assert kept.columns == odd.columns and kept.count() == len(ODD)
    assert decontamination.find_leaks(empty, none).count() == 0


# ---- 7 Katz

def brute_katz(docs, order, others=None):
    """What docs teach, and the scores of docs or of others."""
    words = {k: plain_words(t) + ["</s>"] for k, (_, t) in enumerate(docs)}
    held = {k: i is None or zlib.crc32(str(i).encode()) % 10 == 0 for k, (i, _) in enumerate(docs)}
    after = {k: defaultdict(Counter) for k in range(1, order + 1)}
    for d, w in words.items():
        for k in after if not held[d] else ():
            padded = ["<s>"] * (k - 1) + w
            for i in range(len(w)):
                after[k][tuple(padded[i : i + k - 1])][padded[i + k - 1]] += 1
    c1 = after[1][()]
    n = sum(c1.values())
    rates = {k: katz.discounts(np.array([sum(list(c.values()).count(r) for c in after[k].values()) for r in range(7)])) for k in after}
    d = lambda k, c: rates[k][c] if c <= 5 else 1.0
    left = 1 - sum(d(1, c) * c for c in c1.values()) / n
    weights = {}

    def p(context, w):
        k = len(context) + 1
        own = after[k].get(context)
        if k == 1:
            return d(1, c1[w]) * c1[w] / n if c1[w] else left
        if not own:
            return p(context[1:], w)
        total, none = sum(own.values()), all(c > 5 for c in own.values())
        if w in own:
            return d(k, own[w]) * own[w] / (total + none)
        if context not in weights:
            mass = 1 / (total + 1) if none else 1 - sum(d(k, c) * c for c in own.values()) / total
            weights[context] = mass / (1 - sum(p(context[1:], x) for x in own))
        return weights[context] * p(context[1:], w)

    out = {}
    for k, (i, t) in enumerate(others or docs):
        w = plain_words(t) + ["</s>"]
        padded = ["<s>"] * (order - 1) + w
        score = sum(math.log10(p(tuple(padded[j : j + order - 1]), x)) for j, x in enumerate(w))
        out[k] = (i is None or zlib.crc32(str(i).encode()) % 10 == 0, len(w), score, sum(math.log10((c1[x] + 0.1) / (n + 0.1 * (len(c1) + 1))) for x in w))
    return out, p, c1, after


def katz_rows(spark, sf_dir):
    """Documents and all odd rows, the long and the repeated ones too."""
    return [(r.doc_id, r.text) for r in documents(spark, sf_dir).limit(120).collect()] + [(r[0] and r[0] + 10**6, r[1]) for r in ODD]


def assert_katz(got, rows, want):
    rounded = lambda i, held, n, score, base: (i, held, n, round(score, 5), round(base, 5))
    a = sorted((rounded(r.doc_id, r.held_out, r.n_tokens, r.score, r.base_score) for r in got), key=repr)
    b = sorted((rounded(i, *want[k]) for k, (i, _) in enumerate(rows)), key=repr)
    assert len(a) == len(b)
    for x, y in zip(a, b):
        assert x[:3] == y[:3] and abs(x[3] - y[3]) < 1e-4 and abs(x[4] - y[4]) < 1e-4


@pytest.mark.parametrize("order, chunk", [(2, 2_000_000), (2, 5_000), (3, 5_000), (4, 30_000)])
def test_katz(spark, sf_dir, order, chunk, monkeypatch):
    monkeypatch.setattr(katz, "CHUNK_TOKENS", chunk)
    monkeypatch.setattr(katz.Words, "hot", property(lambda self: 200.0))
    rows = katz_rows(spark, sf_dir)
    want, p, c1, after = brute_katz(rows, order)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).withColumns({c: F.lit(1) for c in ("chunk", "part", "held", "score", "kind")})
    assert_katz(katz.score_texts(docs, order).collect(), rows, want)
    for context in (("<s>",) * (order - 1), next(iter(after[order]))):
        assert abs(sum(p(context, w) for w in c1) + p(context, "<unseen>") - 1) < 1e-9


@pytest.mark.parametrize("order", [2, 3])
def test_katz_scores_other_texts_from_its_tables(spark, sf_dir, order, monkeypatch):
    monkeypatch.setattr(katz.Words, "hot", property(lambda self: 200.0))
    rows = katz_rows(spark, sf_dir)
    others = [(r.doc_id, r.text) for r in documents(spark, sf_dir).orderBy(F.desc("doc_id")).limit(60).collect()] + [(1, "Entirely new words, the"), (2, None), (3, "the the the")]
    model = katz.train(spark.createDataFrame(rows, "doc_id long, text string"), order)
    want, _, c1, after = brute_katz(rows, order, others)
    assert_katz(model.score(spark.createDataFrame(others, "doc_id long, text string").repartition(2)).collect(), others, want)
    assert sorted(r["count"] for r in model.word_table().collect()) == sorted(c1.values())
    for k in range(2, order + 1):
        assert sorted(r["count"] for r in model.ngram_table(k).collect()) == sorted(c for own in after[k].values() for c in own.values())
        # seen words and the rest together have all probability after every context
        d = [float(x) for x in model.levels[k - 2].discount]
        whole = model.ngram_table(k).join(model.context_table(k), "context").withColumn(
            "p", F.coalesce(F.get(F.array(*map(F.lit, d)), F.col("count").cast("int")), F.lit(1.0)) * F.col("count") / (F.col("total") + (F.col("least") > katz.K).cast("int")))
        sums = whole.groupBy("context").agg((F.sum("p") + F.first("backoff") * (1 - F.first("mass"))).alias("all")).collect()
        assert len(sums) == len(after[k]) and all(abs(r["all"] - 1) < 1e-9 for r in sums)


def test_katz_of_nothing(spark, empty):
    assert katz.score_texts(empty).count() == 0


# ---- 8 near-duplicates

def brute_components(docs, k, percent):
    sets = []
    for _, t in docs:
        w = plain_words(t)
        sets.append(frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset())
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        least[find(i)] = min(least.get(find(i), d), d)
    return {d: (len(sets[i]), least[find(i)]) for i, (d, _) in enumerate(docs)}


@pytest.mark.parametrize("k, percent", [(3, 85), (5, 80)])
def test_near_duplicates(spark, sf_dir, k, percent):
    rng = np.random.default_rng(5)
    base = [f"b{i}" for i in rng.integers(0, 5000, 150)]
    rows = [(r.doc_id, r.text) for r in documents(spark, sf_dir).collect()]
    for i in range(60):  # a group of copies with more and more changes
        w = list(base)
        for x in rng.integers(0, len(w), i // 6):
            w[x] = f"e{i}x{x}"
        rows.append((1000 + i, " ".join(w)))
    rows += [(2000 + i, " ".join(base)) for i in range(20)] + [(3000, None), (3001, ""), (3002, "only two"), (3003, "Only  TWO")]
    want = brute_components(rows, k, percent)
    got = near_duplicates.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), k, percent).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


@pytest.mark.parametrize("short, leaders", [(near_duplicates.SHORT, near_duplicates.LEADERS), (4, 3)])
def test_large_group_of_near_copies(spark, monkeypatch, short, leaders):
    """500 copies with up to eight changed words; a third of them is linked with none."""
    monkeypatch.setattr(near_duplicates, "SHORT", short)
    monkeypatch.setattr(near_duplicates, "LEADERS", leaders)
    rng = np.random.default_rng(11)
    base = [f"b{i}" for i in rng.integers(0, 400, 150)]
    rows = []
    for i in range(500):
        w = list(base)
        for x in rng.integers(0, len(w), i % 9):
            w[x] = f"e{rng.integers(0, 40)}"
        rows.append((i, " ".join(w)))
    want = brute_components(rows, 3, 85)
    alone = Counter(c for _, c in want.values())
    assert 100 < sum(n == 1 for n in alone.values()) < 400
    got = near_duplicates.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want


def test_odd_copies(spark, odd, empty):
    got = near_duplicates.near_duplicates(odd).collect()
    assert len(got) == len(ODD) and {r.component_id for r in got if r.doc_id in (4, 5)} == {4}
    kept = near_duplicates.keep_one(odd)
    assert kept.columns == odd.columns and kept.count() == len(ODD) - 1
    assert near_duplicates.near_duplicates(empty).count() == 0


def test_copies_of_missing_and_repeated_ids(spark):
    a, b, c, d, e, f = ("".join(f" {x}{i}" for i in range(60)) for x in "abcdef")
    rows = [(1, a), (None, a), (None, b),  # a copy without an id beside a unique text without one
            (2, c), (5, c), (5, d),  # an id with two texts, one of them a copy
            (None, e), (None, e), (None, e + " more"),  # copies that all lack an id
            (6, f), (6, f + " more"), (7, f),  # near copies that share the least id
            (None, None), (None, "")]
    kept = [(r.doc_id, r.text) for r in near_duplicates.keep_one(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()]
    group = lambda x: [k for k in kept if k[1] and k[1].startswith(x)]
    assert group(a) == [(1, a)] and group(b) == [(None, b)] and group(c) == [(2, c)] and group(d) == [(5, d)]
    assert len(group(e)) == len(group(f)) == 1 and group(e)[0][0] is None and group(f)[0][0] == 6
    assert len(kept) == 8


# ---- 9 licences

def test_licences(spark, odd, empty):
    rows = [(1, "x\nLicensed under the Apache License, Version 2.0.\ny"), (2, "RELEASED under the mit license"), (3, "unlicensed text of the work"), (4, None), (5, licence_scan.TEMPLATES["MIT"][2]),
            (6, "This work is licensed under the GNU General Public License, version 3.")]
    got = {(r.doc_id, r.line): r.licence for r in licence_scan.scan_licences(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    # the whole text of the first is close enough, too
    assert got == {(1, 1): "Apache-2.0", (1, -1): "Apache-2.0", (2, 0): "MIT", (5, 0): "MIT", (6, 0): "GPL-3.0"}
    assert licence_scan.scan_licences(odd).count() == licence_scan.scan_licences(empty).count() == 0
    assert licence_scan.scan_licences(odd, {}).count() == 0


def test_licences_wrapped_and_in_mid_line(spark):
    mit, isc = licence_scan.TEMPLATES["MIT"][2].split(), licence_scan.TEMPLATES["ISC"][1].split()
    wrapped = "\n".join(" ".join(mit[i : i + 12]) for i in range(0, len(mit), 12))
    code = "\n".join(f"def f{i}(x): return x * {i}  # number {i}" for i in range(80))
    rows = [(1, f"Copyright 2020 Ada\n\n{wrapped}\n{code}"), (2, f"{code}\nCopyright 2020 X Y Z. All rights reserved. And here the prose goes on for quite some time.\n{code}"),
            (3, f"{code}\n * {' '.join(isc)} and then much more text {' '.join(f'q{i}' for i in range(300))}"), (4, code), (5, "Licensed under the Apache\nLicense, Version 2.0. " + "then other words " * 20),
            (6, f"{wrapped}\n{code}\n{wrapped}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("line", "licence", "dice", "_w", "_p", "_f")})
    got = sorted((r.doc_id, r.line, r.licence) for r in licence_scan.scan_licences(docs).collect())
    n = len(code.split("\n"))
    assert got == [(1, 2, "MIT"), (2, n, "Proprietary"), (3, n, "ISC"), (5, 0, "Apache-2.0"), (6, 0, "MIT"), (6, len(wrapped.split("\n")) + n, "MIT")]


# ---- 10 compression

def test_classifier(spark, sf_dir):
    d = sf_dir.replace("0.001", "0.01")
    labels = spark.read.parquet(f"{d}/labels.parquet")
    got = registry.QUERIES["op10_quality_classifier"](spark, d).join(labels, "doc_id").where("held_out").collect()
    ranks = sorted((r.score, r.quality) for r in got)
    good, bad = [s for s, q in ranks if q == 1], [s for s, q in ranks if q == 0]
    auc = sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / (len(good) * len(bad))
    assert auc > 0.9 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)


def test_scores_are_those_of_the_model(spark, sf_dir):
    """On plain Python, whole texts; held-out labels and repeated ids change nothing."""
    d = sf_dir.replace("0.001", "0.01")
    docs, labels = documents(spark, d), spark.read.parquet(f"{d}/labels.parquet")
    model = compression_quality.fit(docs, labels)
    text = {r.doc_id: r.text for r in docs.collect()}
    for r in registry.QUERIES["op10_quality_classifier"](spark, d).collect():
        assert r.score == model.score(text[r.doc_id]) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
    held = compression_quality.held_out(F.col("doc_id"))
    turned = labels.withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert compression_quality.fit(docs.withColumn("text", F.when(held, F.lit("other")).otherwise(F.col("text"))).repartition(5), turned) == model
    assert compression_quality.fit(docs.union(docs), labels) == model


def test_classifier_of_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = compression_quality.fit(odd, labels)
    got = compression_quality.score_quality(odd, model).collect()
    assert len(got) == len(ODD) and {r.score for r in got} == {0.5}
    assert compression_quality.score_quality(empty, model).count() == 0


# ---- the pipeline

def test_a_run_folder_is_removed(spark, sf_dir):
    import os

    from marlstone.llm import common

    with common.run_folder(spark) as folder:
        kept = common.materialize(spark.range(5))
        near_duplicates.near_duplicates(documents(spark, sf_dir).limit(20)).count()
        files = [f.replace("file://", "") for f in kept.inputFiles()]
        assert files and all(folder.split("/")[-1] in f and os.path.exists(f) for f in files)
    assert not any(map(os.path.exists, files)) and folder not in common.shared_dir(spark)



def plain_pipeline(docs, rules, benchmark, statistics_of):
    """The five stages on lists of (doc_id, text, source): (doc_id, ids) of what comes out."""
    import hashlib

    from tokenizers import Tokenizer

    def kept(text):
        s = statistics_of[text]
        failed = s["n_words"] < 50 or 100 * s["n_repeat_words"] > 50 * s["n_words"]
        return not failed and not any(all(c.holds(s) for c in rule) for rule in rules.rules)

    docs = [d for d in docs if kept(d[1])]
    groups = brute_components([(i, t) for i, t, _ in docs], 5, 80)
    docs = [d for d in docs if groups[d[0]][1] == d[0]]
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    items = [plain_words(b, word) for b in benchmark]
    windows = {tuple(w[i : i + 10]) for w in items if w for i in range(max(1, len(w) - 9))}
    sizes = {len(w) for w in windows}
    clean = lambda w: not any(tuple(w[i : i + n]) in windows for n in sizes for i in range(len(w) - n + 1))
    docs = [d for d in docs if clean(plain_words(d[1], word))]
    own = defaultdict(list)
    for d in docs:
        own[d[2]].append(d)
    size = {s: sum(len(plain_words(t, lower=False)) for _, t, _ in ds) for s, ds in own.items()}
    names = sorted(own, key=lambda s: (s is None, s or ""))
    weight, cap = {s: i % 3 + 1 for i, s in enumerate(names)}, {s: 3 * n for s, n in size.items()}
    target, left, open_ = {}, float(sum(size.values())), set(names)
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > cap[s]}
        for s in full or open_:
            target[s] = float(cap[s]) if full else level * weight[s]
        left -= sum(target[s] for s in full)
        open_ = open_ - full if full else set()
    t = Tokenizer.from_file(token_ids.tokenizer_path())
    out = []
    for s, ds in own.items():
        copies = int(target[s] + 1e-9) // size[s] if size[s] else 0
        rest = int(target[s] + 1e-9) - copies * size[s]
        for i, text, _ in sorted(ds, key=lambda d: hashlib.md5((str(d[0]) + hashlib.md5(d[1].encode()).hexdigest()).encode()).hexdigest()):
            w = plain_words(text, lower=False)
            take = min(rest, len(w))
            rest -= take
            for body in [text] * copies + ([text] if take == len(w) else [" ".join(w[:take])] if take else []):
                out.append((i, t.encode(body, add_special_tokens=False).ids + [1]))
    return out


def test_pipeline_against_plain_python(spark, sf_dir):
    import corpus_pipeline as P

    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    rules = quality_rules.learn_from(docs, labels)
    judged = quality_rules.judge(docs.select("doc_id", "text"), quality_rules.DecisionList([]))
    rows = [(r.doc_id, r.text, r.source) for r in docs.select("doc_id", "text", "source").collect()]
    want = plain_pipeline(rows, rules, [r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()], {r.text: r.asDict() for r in judged.collect()})
    got = P.run(spark, sf_dir).orderBy("start").collect()
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == Counter((d, len(i), zlib.crc32(np.array(i, dtype="<u4").tobytes())) for d, i in want)
    assert [r.doc_id for r in got] == sorted(r.doc_id for r in got) and len(got) > 50
    assert [r.start for r in got] == [0, *np.cumsum([r.n_tokens for r in got])[:-1].tolist()]


def test_pipeline_of_odd_rows(spark, odd, empty, sf_dir, tmp_path):
    """Nulls, empty and long texts, repeated rows, private column names and no rows at all through every stage."""
    import corpus_pipeline as P

    some = documents(spark, sf_dir).where("doc_id < 60")
    wide = {c: F.lit("keep") for c in ("_row", "_key", "_hit", "k1", "cid", "kept", "score", "size", "_w", "shard")}
    for i, docs in enumerate((odd.select(*some.columns).union(some).union(some.limit(5)).withColumns(wide), empty.withColumns(wide))):
        first = docs.columns
        for name, stage in P.STAGES:
            stage(spark, docs, sf_dir).write.parquet(str(tmp_path / f"{i}-{name}"))
            docs = spark.read.parquet(str(tmp_path / f"{i}-{name}"))
            if name != "token_ids":
                assert docs.columns == first
                assert docs.where(" or ".join(f"`{c}` <> 'keep'" for c in wide)).count() == 0
        assert (docs.count() > 0) == (i == 0)


def test_pipeline(spark, sf_dir, tmp_path):
    import corpus_pipeline as P

    docs = documents(spark, sf_dir)
    counts = [docs.count()]
    for name, stage in P.STAGES:
        before = docs
        stage(spark, docs, sf_dir).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        counts.append(docs.count())
        if name != "token_ids":
            assert docs.columns == before.columns
    assert counts[0] > counts[1] >= counts[2] >= counts[3] and counts[4] == counts[5]
    assert sorted(docs.columns) == ["doc_id", "ids_crc32", "n_tokens", "start"]
