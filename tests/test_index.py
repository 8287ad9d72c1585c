"""The stored index: generations that are merged, scopes, score bounds, the dictionary of runs, and passages."""

import random
import re

import pytest
from pyspark.sql import functions as F

from marlstone.operators import index as I
from marlstone.operators import search as S

WORDS = [f"w{i}" for i in range(60)]


def corpus(n, seed=1):
    rng = random.Random(seed)
    return [(f"members/m{i % 3}/d{i}/d{i}.md", f"t{i} {rng.choice(WORDS)}", "\n".join(" ".join(rng.choices(WORDS, [1 / (k + 1) for k in range(60)], k=rng.randint(0, 12))) for _ in range(4))) for i in range(n)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "path string, title string, content string")


def same_as_rebuilt(index, now):
    fresh = I.Index(now)
    assert sorted(index.lengths.collect()) == sorted(fresh.lengths.collect())
    assert sorted(index.postings.select(*fresh.postings.columns).collect()) == sorted(fresh.postings.collect())
    assert sorted(index.runs().select("path", "field", "unit").collect()) == sorted(fresh.runs().select("path", "field", "unit").collect())
    assert sorted(index.lines().select("path", "line", "first", "n").collect()) == sorted(fresh.lines().select("path", "line", "first", "n").collect())


def test_generations_are_merged(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(I, "FANOUT", 2)
    path, rows = str(tmp_path / "i"), corpus(40)
    index = I.Index(frame(spark, rows[:5])).store(path)
    for k in range(1, 7):
        now = rows[5 * (k // 3) : 5 * k + 5]  # documents come, go and change
        now = [(p, t, c + " changed" if i % 7 == k else c) for i, (p, t, c) in enumerate(now)]
        index = index.refresh(frame(spark, now))
        assert len(index.generations) <= 4 and len(list((tmp_path / "i" / "manifest").iterdir())) <= 2
    same_as_rebuilt(index, frame(spark, now))
    named = {g[0] for g in index.generations}
    assert len(list((tmp_path / "i" / "postings").iterdir())) <= 2 * len(named) + 2
    assert max(g[1] for g in index.generations) >= 2
    assert index.refresh(frame(spark, [])).postings.count() == 0


@pytest.mark.parametrize("step", ["_commit", "_put"])
def test_a_merge_that_breaks_off_leaves_the_version_before(spark, tmp_path, monkeypatch, step):
    path, rows = str(tmp_path / "i"), corpus(12)
    docs = frame(spark, rows)
    index = I.Index(frame(spark, rows[:6])).store(path).refresh(docs)
    whole = getattr(I, step)

    def broken(*args):
        if step == "_put":
            whole(*args)
        raise RuntimeError("lost")

    monkeypatch.setattr(I, "FANOUT", 2)
    monkeypatch.setattr(I, step, broken)
    with pytest.raises(RuntimeError):
        index.compact()
    again = I.StoredIndex(spark, path)
    assert again.version == index.version
    same_as_rebuilt(again, docs)
    monkeypatch.setattr(I, step, whole)
    merged = again.compact()  # over what the broken one left
    assert len(merged.generations) == 1
    same_as_rebuilt(merged, docs)


def test_scopes_have_statistics_of_their_own(spark, tmp_path):
    rows = [*corpus(30), ("members/README.md", "w1", "w2 w3"), ("elsewhere/x.md", "w1", "w2 w3")]
    docs = frame(spark, rows)
    queries = spark.createDataFrame([(1, "w1 w2"), (2, "w40"), (3, "w5 w6 w7 d3")], "query_id long, text string")
    index = I.Index(docs.where("path not like '%d5%'")).store(str(tmp_path / "i")).refresh(docs)
    for member in ("m2", None):
        own = S.member_scope(docs, member)
        assert sorted(S.match_any(index.scoped(member), queries, 10).collect()) == sorted(S.match_any(I.Index(own), queries, 10).collect())
        got = S.knowledge_search(docs, queries, 4, member=member, index=index).collect()
        assert sorted(got) == sorted(S.knowledge_search(own, queries, 4).collect()) and all(r.path.startswith(f"members/{member}/" if member else "members/") for r in got)


def plain_scores(index, phrases):
    parts = S.contributions(index, S.phrase_frequencies(index, phrases))
    return phrases.join(parts, "pieces").groupBy("query_id", "path").agg(F.sum("s").alias("score"), F.countDistinct("phrase").alias("n")), parts


def test_bounds_keep_the_best_and_leave_rows_out(spark, tmp_path):
    rows = corpus(300, seed=3)
    index = I.Index(frame(spark, rows)).store(str(tmp_path / "i"))
    rng = random.Random(9)
    queries = spark.createDataFrame([(i, " ".join(rng.sample(WORDS, 8)) + " w0 w1 w2") for i in range(20)], "query_id long, text string")
    phrases = S.query_phrases(queries)
    scored, parts = plain_scores(index, phrases)
    for limit in (5, 1000):
        want = S.top(scored.select("query_id", "path", S.rounded(F.col("score")).alias("score")), limit)
        got = S.top(S.best_any(index, phrases, parts, limit).select("query_id", "path", S.rounded(F.col("score")).alias("score")), limit)
        assert sorted(got.select("query_id", "path", "score", "rank").collect()) == sorted(want.select("query_id", "path", "score", "rank").collect())
    considered = S.best_any(index, phrases, parts, 5).count()
    assert considered < 0.7 * scored.count()
    sizes = phrases.groupBy("query_id").agg(F.count("*").alias("m"))
    every = scored.join(sizes, "query_id").where("n = m").select("query_id", "path", S.rounded(F.col("score")).alias("score"))
    assert sorted(S.best_all(index, phrases, parts).select("query_id", "path", S.rounded(F.col("score")).alias("score")).collect()) == sorted(every.collect())


def test_passages_against_a_plain_search(spark, tmp_path):
    rows = [*corpus(40, seed=5), ("members/m/z/z.md", "w1 w2", "w1 W2, w1\nw2 w1 w2\n\nw3"), ("members/m/y/y.md", "", None)]
    docs = frame(spark, rows)
    items = [(1, "w1 w2"), (2, "w1 w2 w1 w2"), (3, "w0"), (4, ""), (5, None), (6, "w0 nowhere"), (7, "..."), (8, rows[3][2]), (9, "w2 W1-w2 w3")]
    index = I.Index(docs.where("path not like '%d7%'")).store(str(tmp_path / "i")).refresh(docs)
    tokens = lambda t: re.findall("[a-z0-9]+", (t or "").lower())
    want = set()
    for q, text in items:
        w = tokens(text)
        for path, _, content in rows:
            at = [(t, k + 1) for k, line in enumerate((content or "").split("\n")) for t in tokens(line)]
            for i in range(len(at) - len(w) + 1) if w else ():
                if [t for t, _ in at[i : i + len(w)]] == w:
                    want.add((q, path, i, len(w), at[i][1], at[i + len(w) - 1][1]))
    got = S.passage_lines(index, S.passages(index, spark.createDataFrame(items, "query_id long, text string")))
    assert {tuple(r) for r in got.select("query_id", "path", "start", "n", "first_line", "last_line").collect()} == want and len(want) > 20


def test_containment_by_the_stored_dictionary(spark, tmp_path):
    rows = [*corpus(30, seed=7), ("members/m/u/u.md", "Über w1", "x.md or-e 仓库发布 W10w")]
    docs = frame(spark, rows)
    index = I.Index(docs.where("path not like '%d2%'")).store(str(tmp_path / "i")).refresh(docs)
    queries = spark.createDataFrame([(1, "w1"), (2, "10w 仓库"), (3, "r-e .md zz"), (4, "w5 w59 库发布")], "query_id long, text string")
    assert sorted(S.substring_search(docs, queries, 50, index).collect()) == sorted(S.substring_search(docs, queries, 50).collect())


def test_kinds_are_written_alone_and_later(spark, tmp_path):
    docs = frame(spark, corpus(20))
    index = I.Index(docs).store(str(tmp_path / "i"), ("postings",))
    assert not (tmp_path / "i" / "runs").exists() and not (tmp_path / "i" / "lines").exists()
    same_as_rebuilt(index.supply(docs, "runs").supply(docs, "lines"), docs)


def test_best_rows_of_slices_and_blocks(spark, tmp_path, monkeypatch):
    """Small slices and blocks of queries give what a join of all phrases with all documents gives, without shuffling pairs of them."""
    monkeypatch.setattr(S.scoring, "BLOCK", 3)
    index = I.Index(frame(spark, [*corpus(60, seed=3), *[(f"members/copy/c{i}/c.md", "w1", "w1 w2 w2.w3") for i in range(20)]])).store(str(tmp_path / "i"), ("postings",))
    queries = spark.createDataFrame([(i, t) for i, t in enumerate(["w1 w2", "w0 w0. w5", "w2.w3 w1", "w59 nowhere", "w1", "", "t3 w1"])], "query_id long, text string")
    phrases = S.query_phrases(queries)
    scored, _ = plain_scores(index, phrases)
    want = S.top(scored.select("query_id", "path", S.rounded(F.col("score")).alias("score")), 4)
    assert sorted(S.match_any(index, queries, 4).select("query_id", "path", "score", "rank").collect()) == sorted(want.select("query_id", "path", "score", "rank").collect())
    sizes = phrases.groupBy("query_id").agg(F.count("*").alias("m"))
    every = S.top(scored.join(sizes, "query_id").where("n = m").select("query_id", "path", S.rounded(F.col("score")).alias("score")), 4)
    assert sorted(S.match_all(index, queries, 4).select("query_id", "path", "score", "rank").collect()) == sorted(every.select("query_id", "path", "score", "rank").collect())


def test_common_tokens_of_paths(spark, monkeypatch):
    """Tokens that most paths hold give the same rows whether documents are paired with all queries by them or stand for others alike."""
    docs = frame(spark, corpus(40))
    queries = spark.createDataFrame([(i, f"members m{i % 3} d{i} md nowhere") for i in range(12)], "query_id long, text string")
    monkeypatch.setattr(S, "COMMON", 10**9)
    want = sorted(S.path_channel(docs, queries, 5).collect())
    monkeypatch.setattr(S, "COMMON", 20)
    assert sorted(S.path_channel(docs, queries, 5).collect()) == want and len(want) == 60


def test_tokens_by_document_give_what_positions_give(spark, tmp_path, monkeypatch):
    """Phrases are counted where a document's tokens are read, over merged generations and scopes, and nothing is exchanged by document."""
    rows = [*corpus(60, seed=3), *[(f"members/copy/c{i}/c.md", "w1", "w1 w2 w2.w3 w3.w3.w3") for i in range(20)], ("members/m/e/e.md", "", None)]
    docs, before = frame(spark, rows), frame(spark, [(p, t, f"{c} old") for p, t, c in rows[::2]] + [("members/m1/gone/gone.md", "w1", "w1 w2")])
    queries = spark.createDataFrame([(i, t) for i, t in enumerate(["w1 w2", "w0 w0. w5", "w2.w3 w1", "w3.w3 w3-w3-w3", "w59 nowhere", "", "t3 w1"])], "query_id long, text string")
    of = {k: I.Index(before).store(str(tmp_path / k), (k,)).refresh(frame(spark, rows[:40])).refresh(docs) for k in ("postings", "tokens")}
    for member in (None, "m2"):
        for match in (S.match_any, S.match_all):
            got, want = (sorted(match(of[k].scoped(member), queries, 4).collect()) for k in ("tokens", "postings"))
            assert got == want and got
    monkeypatch.setattr(S.scoring, "by_document", None)  # the exchange of tokens
    assert S.match_any(of["tokens"], queries, 4).count() and S.match_any(I.Index(docs), queries, 4).count()


def test_rows_of_one_key_are_one_document(spark, tmp_path):
    rows = [("members/a/a.md", "w1", "w2 w2"), ("members/a/a.md", "w3", ""), ("members/a/a.md", "x", "y"), ("members/b/b.md", "w1 w3", "w2")]
    queries = spark.createDataFrame([(1, "w1 w2 w3"), (2, "w1 a b")], "query_id long, text string")
    one = [("members/a/a.md", "w1 w3 x", "w2 w2 y"), rows[3]]
    for index in (I.Index(frame(spark, rows)), I.Index(frame(spark, rows)).store(str(tmp_path / "i"), ("tokens",))):
        for match in (S.match_any, S.match_all):
            assert sorted(match(index, queries, 4).collect()) == sorted(match(I.Index(frame(spark, one)), queries, 4).collect())
    got = {(r.query_id, r.path): r.score for r in S.path_channel(frame(spark, rows), spark.createDataFrame([(1, "members a/a.md zz"), (2, "b.md")], "query_id long, text string"), 4).collect()}
    assert got == {(1, "members/a/a.md"): round(3 * (1 / 4 + 1 / 3), 9), (1, "members/b/b.md"): 0.25, (2, "members/b/b.md"): 1.0}


def test_passages_need_no_exchange_of_positions(spark, tmp_path, monkeypatch):
    docs = frame(spark, [("members/m/z/z.md", "w1 w2", "w1 W2, w1\nw2 w1 w2\n\nw3"), ("members/m/y/y.md", "", "w2 w1")])
    index = I.Index(docs).store(str(tmp_path / "i"), ("tokens", "lines"))
    monkeypatch.setattr(I.StoredIndex, "positions_of", None)
    got = S.passage_lines(index, S.passages(index, spark.createDataFrame([(1, "w1 w2 w1"), (2, "W1 w2 w1"), (3, "w2 w1 w1")], "query_id long, text string")))
    want = [(q, "members/m/z/z.md", s, 3, a, b) for q in (1, 2) for s, a, b in ((0, 1, 1), (2, 1, 2))]
    assert sorted(tuple(r) for r in got.select("query_id", "path", "start", "n", "first_line", "last_line").collect()) == want
