"""Small cases with results worked out by hand."""

import json
import re
import sqlite3

import pytest
from pyspark.sql import functions as F

from marlstone.functions import text as T
from marlstone.operators import attribution as A
from marlstone.operators import governance as G
from marlstone.operators import search as S
from marlstone.operators import sessions as M
from marlstone.operators import state as st
from marlstone.operators import text_jobs as J
from marlstone.registered import flows as R
from marlstone.sources import files as I
from marlstone.streaming import streams as W


def one(spark, expr, **cols):
    return spark.createDataFrame([tuple(cols.values())], list(cols)).select(expr.alias("x")).first().x


DOCS = [
    ("members/ada/tin/tin.md", "tin-ore 仓库", "# tin-ore 仓库\n发布流程与环境变量。The quick réaux fox"),
    ("members/ada/zinc/zinc.md", "Zinc", "zinc data store\nquick brown fox tin ore"),
    ("members/other/x/x.md", "Other", "nothing here but a fox, fox and tin"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, "path string, title string, content string")


def fts(query: str) -> dict:
    con = sqlite3.connect(":memory:")
    con.execute("create virtual table f using fts5(path unindexed, title, content)")
    con.executemany("insert into f values (?, ?, ?)", DOCS)
    return {p: -s for p, s in con.execute("select path, bm25(f, 0.0, 8.0, 3.0) from f where f match ?", (query,))}


@pytest.mark.parametrize("text, match", [("quick fox", '"quick" OR "fox"'), ("tin-ore fox", '"tin-ore" OR "fox"'), ("aux Zinc reaux", '"aux" OR "Zinc" OR "reaux"')])
def test_or_channel_has_the_scores_of_fts5(spark, docs, text, match):
    q = spark.createDataFrame([(1, text)], "query_id long, text string")
    got = {r.path: r.score for r in S.match_any(S.Index(docs), q, 10).collect()}
    expected = fts(match)
    assert got.keys() == expected.keys()
    assert all(abs(got[p] - expected[p]) < 1e-8 for p in got)


def test_and_channel(spark, docs):
    q = spark.createDataFrame([(1, "quick fox"), (2, "fox missing")], "query_id long, text string")
    got = {(r.query_id, r.path) for r in S.match_all(S.Index(docs), q, 10).collect()}
    assert got == {(1, p) for p in fts('"quick" AND "fox"')}


def test_tokens(spark):
    assert one(spark, T.query_tokens("t"), t="Zinc zinc a 环境变量 x-y.z 字") == ["Zinc", "环境变量", "x-y.z"]
    assert one(spark, T.expanded_tokens("t"), t="环境变量 ab") == ["环境变量", "ab", "环境", "境变", "变量"]
    assert one(spark, T.needles("t"), t="环境变量 环境") == ["环境变量", "环境", "境变", "变量"]


def test_lines_as_splitlines(spark):
    t = "a\r\nb\rc\n\nd e\x85f\n"
    assert one(spark, T.lines("t"), t=t) == t.splitlines()
    assert one(spark, T.lines("t"), t="") == []


def test_title(spark):
    assert one(spark, T.extract_title("t", F.lit("a/b.md")), t="x\n#no\n# Yes \n# Late") == "Yes"
    assert one(spark, T.extract_title("t", F.lit("a/b.md")), t="#x") == "b"
    assert one(spark, T.ensure_title("t", F.lit("s"), F.lit("tool")), t="\n body") == "# s\n\nbody"
    assert one(spark, T.ensure_title("t", F.lit("s"), F.lit("tool")), t="# s\n\nbody") == "# s\n\nbody"


def test_markdown_inspection(spark):
    assert one(spark, T.markdown_errors("t"), t=" \n") == ["nothing but white space"]
    assert one(spark, T.markdown_errors("t"), t="a�") == ["has undecodable characters (U+FFFD)"]
    assert one(spark, T.repeated_runs("t"), t="aaab --- xx") == 2


def test_html_table(spark):
    t = "x <table><tr><th>A</th><th>B</th></tr><tr><td>1&amp;2</td></tr></table> y"
    assert one(spark, J.normalize_html_tables("t"), t=t) == "x | A | B |\n| --- | --- |\n| 1&2 |  | y"
    assert one(spark, J.normalize_html_tables("t"), t="plain") == "plain"


def test_hits_skip_fences_and_titles(spark):
    text = "# deploy title\n\n**deploy**\n\n```\n# deploy in code\n```\nplain deploy line\n---\nother"
    docs = spark.createDataFrame([("p", text)], "path string, content string")
    want = spark.createDataFrame([(1, "p", ["deploy"])], "query_id long, path string, needles array<string>")
    assert sorted(r.line for r in A.locate_hits(docs, want).collect()) == [6, 8]


def test_reasons_in_order(spark):
    scan = spark.createDataFrame([(p, "one") for p in ("a.txt", "b.txt", "c.txt", "d.txt", "e.txt", "f.png")], "relative_path string, sha256 string")
    conv = spark.createDataFrame([("b.txt", "two", "converted", True), ("c.txt", "one", "quality_failed", True), ("d.txt", "one", "converted", False), ("e.txt", "one", "quality_warned", True)],
                                 "relative_path string, source_sha256 string, status string, output_exists boolean")
    got = {r.relative_path: r.reason for r in st.conversion_reason(scan, conv).collect()}
    assert got == {"a.txt": "new_source", "b.txt": "source_changed", "c.txt": "previous_failed", "d.txt": "output_missing", "e.txt": "unchanged", "f.png": "unsupported"}


def test_batches(spark):
    p = spark.createDataFrame([("c.txt",), ("a.pdf",), ("b.txt",)], "relative_path string")
    got = {r.relative_path: (r.n, r.batch) for r in st.plan_batches(p, 2).collect()}
    assert got == {"b.txt": (1, 1), "c.txt": (2, 1), "a.pdf": (3, 2)}


def test_source_ranking(spark):
    rows = [(1, i, "search", f"p{i}", "fts") for i in range(20)] + [(1, 30, "read", "p3", None), (1, 31, "search", "weak", "substring")]
    steps = spark.createDataFrame(rows, "trace_id long, seq long, tool string, path string, matched_by string")
    got = [r.path for r in A.rank_sources(A.evidence(steps)).orderBy("rank").collect()]
    # p3: read, strong, two hits = 7; the others have 3, below half of it
    assert got == ["p3"]


def test_run_health_streak(spark):
    rows = [(1, "ok", None), (2, None, "boom"), (3, "locked", None), (4, None, "x" * 300)]
    r = G.run_health(spark.createDataFrame(rows, "seq long, result string, error string")).first()
    assert (r.window, r.ok, r.locked, r.failed, r.streak, r.blocking, len(r.last_error)) == (4, 1, 1, 2, 3, 1, 200)


def test_guard(spark):
    df = spark.createDataFrame([("members/a/b.md",), ("members/../b.md",), ("members/a/../../../x.md",), ("members/a.exe",), ("members/a/../b.md",)], "path string")
    assert [r.reason for r in st.guard_paths(df).collect()] == [None, "outside members", "outside members", "wrong suffix", None]


def test_session_titles(spark):
    assert one(spark, T.session_title("t"), t="  a \n b" + "c" * 30) == "a b" + "c" * 17
    assert one(spark, M.searchable_text("t"), t='{"content": " ", "message": "m"}') == "m"


def test_files(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.md").write_text("x")
    (tmp_path / "empty.txt").write_text("")
    got = {r.relative_path: (r.size, r.supported) for r in I.scan_sources(spark, str(tmp_path)).collect()}
    assert got == {"d/a.md": (1, True), "empty.txt": (0, True)}


def test_decoding(spark):
    df = spark.createDataFrame([("a", "é".encode()), ("b", b"x\x00"), ("c", b"\xef\xbb\xbfz"), ("d", b"\xff\xfe\xfd"), ("e", "仓库".encode("gb18030"))], "path string, content binary")
    got = {r.path: (r.text, r.error) for r in I.decode_text_corpus(df).collect()}
    assert got == {"a": ("é", None), "b": (None, "binary"), "c": ("z", None), "d": (None, "undecodable"), "e": ("仓库", None)}


def test_registry_is_written_once(spark, tmp_path):
    df = spark.createDataFrame([(2, "b"), (1, None)], "k int, v string")
    assert I.write_registry(df, str(tmp_path / "r"), ["k"])
    assert not I.write_registry(df.orderBy("k"), str(tmp_path / "r"), ["k"])
    assert I.write_registry(df.where("k = 1"), str(tmp_path / "r"), ["k"])


def test_trace_stream(spark, tmp_path):
    schema = "trace_id string, member long, seq long, ts timestamp, type string, path string, citations array<string>, content string"
    rows = [("t", 1, 1, "start", None, None, None), ("t", 1, 2, "search", "a", None, None), ("t", 1, 3, "search", None, None, None), ("t", 1, 4, "answer", None, ["a", "a"], "hi")]
    df = spark.createDataFrame([(r[0], r[1], r[2], None, *r[3:]) for r in rows], schema).withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("seq")))
    for i in range(2):  # the trace spans two batches
        df.where("seq <= 2" if i == 0 else "seq > 2").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = W.stream_traces(s).writeStream.format("memory").queryName("traces_out").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = spark.sql("select * from traces_out").collect()
    assert [(r.trace_id, r.n_steps, r.n_zero, r.retrieved, r.citations, r.answer, r.failed) for r in got] == [("t", 2, 1, ["a"], ["a"], "hi", False)]
    assert [(r.zero_hit_queries, r.cited_not_retrieved, r.retrieved_but_unused, r.answer_chars, r.no_hit_answer) for r in got] == [([], [], [], 2, False)]


def test_sessions_stream_equals_batch(spark, tmp_path):
    rows = [(1, 1, 0), (1, 2, 60), (1, 2, 60), (1, 3, 7200), (2, 4, 30), (9, 9, 10**6)]
    df = spark.createDataFrame(rows, "session_id long, message_id long, t long").select("session_id", "message_id", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("t")).alias("ts"))
    df.coalesce(1).write.parquet(str(tmp_path / "m"))
    s = W.stream_sessions(spark.readStream.schema(df.schema).parquet(str(tmp_path / "m")))
    q = s.writeStream.format("memory").queryName("sessions_out").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    closed = spark.sql("select * from sessions_out where session_id < 9")
    assert sorted(closed.collect()) == sorted(W.session_bursts(df).where("session_id < 9").collect())


def test_stored_index_and_highlight(spark, docs, tmp_path):
    q = spark.createDataFrame([(1, "quick fox"), (2, "tin-ore")], "query_id long, text string")
    index = S.Index(docs)
    stored = index.store(str(tmp_path / "index"))
    assert sorted(S.match_any(stored, q, 10).collect()) == sorted(S.match_any(index, q, 10).collect())
    got = {(r.query_id, r.path): r.excerpt for r in S.highlight(index, docs, S.match_any(index, q, 10).select("query_id", "path"), q, width=3).collect()}
    assert got[(1, "members/ada/zinc/zinc.md")] == "...[quick] brown [fox]..."
    assert got[(1, "members/other/x/x.md")] == "...[fox] [fox] and..."
    assert got[(2, "members/ada/zinc/zinc.md")] == "...fox [tin] [ore]" or "[tin] [ore]" in got[(2, "members/ada/zinc/zinc.md")]


def test_refreshed_index_equals_a_new_one(spark, docs, tmp_path):
    """Documents that are added, changed, dropped and brought back; nothing is read of what is gone."""
    q = spark.createDataFrame([(1, "quick fox zinc"), (2, "tin-ore stone")], "query_id long, text string")
    changed = docs.withColumn("content", F.when(F.col("path").contains("zinc"), "a stone and a fox").otherwise(F.col("content")))
    index = S.Index(docs.where("path not like '%tin%'")).store(str(tmp_path / "i"))
    for now in (changed, docs.where("path like '%zinc%'"), docs.limit(0), docs):
        index = index.refresh(now)
        fresh = S.Index(now)
        assert sorted(S.match_any(index, q, 10).collect()) == sorted(S.match_any(fresh, q, 10).collect())
        assert sorted(index.lengths.collect()) == sorted(fresh.lengths.collect())
        assert sorted(index.postings.select(*fresh.postings.columns).collect()) == sorted(fresh.postings.collect())


def test_knowledge_search_has_titles_and_snippets(spark, docs):
    q = spark.createDataFrame([(1, "quick"), (2, "the")], "query_id long, text string")
    got = {(r.query_id, r.path): (r.title, r.snippet) for r in S.knowledge_search(docs, q, 5).collect()}
    assert got[(1, "members/ada/zinc/zinc.md")] == ("Zinc", "zinc data store quick brown fox tin ore")
    assert all(title and snippet for title, snippet in got.values())


def test_containment(spark, docs):
    """Tokens anywhere in content, titles and paths, whatever their case, against a plain search."""
    texts = ["Quick fox store", "tin ada", "to", "仓库 members md", "x.md TH or-e", "zin 发布流程与"]
    q = spark.createDataFrame(list(enumerate(texts)), "query_id long, text string")
    tokens = {i: {x.lower() for x in re.findall(r"[0-9A-Za-z_\-\.]+|[\u4e00-\u9fff]{2,}", t) if len(x) >= 2} for i, t in enumerate(texts)}
    want = {(i, p): sum((x in c.lower()) + (x in h.lower()) for x in own) for i, own in tokens.items() for p, h, c in DOCS}
    assert {(r.query_id, r.path): r.score for r in S.substring_search(docs, q, 9).collect()} == {k: n for k, n in want.items() if n}
    holds = {x: [p for p, _, _ in DOCS if x in p] for own in tokens.values() for x in own}
    want = {(i, p): sum(1 / len(holds[x]) for x in own if p in holds[x]) for i, own in tokens.items() for p, _, _ in DOCS}
    got = {(r.query_id, r.path): r.score for r in S.path_channel(docs, q, 9).collect()}
    assert got.keys() == {k for k, n in want.items() if n} and all(abs(got[k] - want[k]) < 1e-8 for k in got)


def test_tables_with_markup_in_cells():
    block = "<TABLE class='x'><tr><th>A</th><th>B|C</th></tr><tr><td>a <5 and b> 3</td><td>x<br/>y &amp; <b>z</b></td></tr><tr><td rowspan=2>one</td></tr></table >"
    assert J.pipe_table(block) == "| A | B\\|C |\n| --- | --- |\n| a <5 and b> 3 | x y & z |\n| one |  |"
    assert J.with_pipe_tables("k <table></table> l <tables> <table><tr><td>1</td></tr></table> m <table> open") == "k <table></table> l <tables> | 1 |\n| --- | m <table> open"


def test_flows_write_bounded_files_and_objects(spark, sf_dir, tmp_path, monkeypatch):
    monkeypatch.setattr(R, "CASES", 3, raising=False)
    monkeypatch.setattr(R, "TEXTS", 2, raising=False)
    outs = iter(f"{tmp_path}/{i}" for i in range(4))
    monkeypatch.setattr(R, "shared_dir", lambda spark: next(outs))
    items, docs = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("benchmark", "documents"))
    assert R.questions(spark, sf_dir).count() == items.count()
    objects = [json.loads(x) for p in (tmp_path / "0").glob("part-*") for x in p.read_text().splitlines()]
    assert len(objects) > 1 and max(len(x["cases"]) for x in objects) <= 4
    got = R.ingest(spark, sf_dir).first()
    sizes = [p.read_bytes().count(b"\x1f") for p in (tmp_path / "1").glob("k=*/part-*")]
    assert max(sizes) <= 2 and sum(sizes) == docs.count()
    n = docs.select("source").distinct().count()
    assert (got.n_files, got.n_hashes) == (n, n)


def test_tops_of_deep_trees_and_cycles(spark):
    from marlstone.operators import exports as X

    rows = [(f"n{i}", "root" if i == 0 else f"n{i - 1}", f"t{i}") for i in range(700)]
    rows += [("a", "root", "A"), ("b", "a", "B"), ("c", "c2", "C"), ("c2", "c", "C2"), ("d", "c", "D"), ("self", "self", "S"), ("lost", "nowhere", "L"), ("none", None, "N")]
    got = {r.token: (r.title, r.top) for r in X.tree_top_segment(spark.createDataFrame(rows, "token string, parent string, title string"), "root").collect()}
    assert got == {**{f"n{i}": (f"t{i}", "t0") for i in range(700)}, "a": ("A", "A"), "b": ("B", "A")}
    assert X.tree_top_segment(spark.createDataFrame([], "token string, parent string, title string"), "root").count() == 0


def test_publication_and_pruning_survive_a_run_that_breaks_off(spark, tmp_path, monkeypatch):
    """A pointer names the current version; what broke off is not seen, and a repeated run gives the same tables."""
    out = str(tmp_path / "p")
    a, b = spark.range(3), spark.range(5)
    with pytest.raises(ValueError):
        I.latest_snapshot(spark, out)
    I.publish_snapshot(a, out, "2024-01-01", keep=1)
    with monkeypatch.context() as m:
        m.setattr(I, "point_to", lambda *x: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            I.publish_snapshot(b, out, "2024-01-02", keep=1)
    assert I.latest_snapshot(spark, out).count() == 3
    for _ in range(2):
        I.publish_snapshot(b, out, "2024-01-02", keep=1)
        assert I.latest_snapshot(spark, out).count() == 5 and [p.name for p in (tmp_path / "p" / "history").iterdir() if not p.name.startswith(".")] == ["published_at=2024-01-02"]

    out, now = str(tmp_path / "q"), F.expr("timestamp'2024-01-20 00:00:00'")
    runs = spark.createDataFrame([(1, "2024-01-01 00:00:00"), (2, "2024-01-19 00:00:00"), (3, "unreadable")], "seq long, started_at string")
    items = spark.createDataFrame([("log", "x", 50), ("log", "x.1", 40), ("log", "x.2", 30), ("log", "y", 1), ("docs", "a1", 7), ("docs", "a2", 8), ("docs", "a3", 9)], "kind string, name string, bytes long")
    prune = lambda run: G.apply_prune(items, runs, now, out, run, keep=2, days=10, rotate_bytes=20, log_keep=2)
    with monkeypatch.context() as m:
        m.setattr(I, "point_to", lambda *x: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            prune("r1")
    assert I.pointed_to(spark, out) is None
    for _ in range(2):
        prune("r1")
        mine = I.pointed_to(spark, out)
        read = lambda kind: sorted(tuple(r) for r in spark.read.parquet(f"{out}/{kind}/{mine}").collect())
        assert mine == "run=r1" and read("items") == [("docs", "a2", 8), ("docs", "a3", 9), ("log", "x.1", 50), ("log", "x.2", 40), ("log", "y", 1)]
        assert [r[0] for r in read("archive")] == [1] and [r[0] for r in read("runs")] == [2, 3]
        summary = spark.read.json(f"{out}/audit/{mine}/summary").first()
        assert (summary.archived_runs, summary.kept_runs, summary.frozen_runs, summary.freed_bytes) == (1, 2, 1, 37)


def test_message_snippets(spark):
    text = "a" * 40 + " Fox " + "b" * 40
    cut = lambda t, *tokens: one(spark, T.message_snippet("t", F.array(*map(F.lit, tokens)).cast("array<string>")), t=t)
    assert cut(text, "zinc", "fox") == "..." + "a" * 29 + " Fox " + "b" * 26 + "..."
    assert cut("a fox", "FOX") == "a fox" and cut(text, "zinc") == text[:60] + "..." and cut("short") == "short"
