"""Columns and parts that complete operators: times, batches, run health, citations, index pages, headers, totals, heads of sessions."""

from pyspark.sql import functions as F

from marlstone.operators import exports as X
from marlstone.operators import governance as G
from marlstone.operators import state as S
from marlstone.operators import text_jobs as J
from marlstone.sources import parts as P
from marlstone.streaming import streams as W


def test_times_of_sources(spark):
    state = spark.sql("select 'a' as relative_path, 1L as size, 'x' as sha256, 'converted' as status, timestamp'2024-01-01' as mtime union all select 'b', 1L, 'y', 'converted', timestamp'2024-01-02'")
    scan = spark.sql("select 'a' as relative_path, 1L as size, 'x' as sha256, timestamp'2024-03-01' as mtime")
    got = {r.relative_path: (r.status, r.mtime.month) for r in S.upsert_sources(state, scan).collect()}
    assert got == {"a": ("converted", 3), "b": ("converted", 1)}  # touched without a change; not in the scan
    assert "mtime" not in S.upsert_sources(state.drop("mtime"), scan.drop("mtime")).columns
    assert {r.mtime.day for r in S.upsert_sources(state, scan.drop("mtime")).collect()} == {1, 2}


def test_run_health_blocks_the_report(spark):
    checks = spark.createDataFrame([("a", ".md", ["output_missing"]), ("b", ".md", [])], "relative_path string, file_type string, issues array<string>")
    runs = spark.createDataFrame([(n, "failed", "boom") for n in range(3)], "seq long, result string, error string")
    log = spark.range(30)
    assert [G.run_health(runs, 20, log).first().lock_recoveries, G.run_health(runs, 20, log.limit(0)).first().lock_recoveries, G.run_health(runs).first().lock_recoveries] == [20, 0, 0]
    n = lambda df: df.where("name = 'blocking'").first().n
    assert (n(G.inspection_report(checks)), n(G.inspection_report(checks, G.run_health(runs))), n(G.inspection_report(checks, G.run_health(runs.limit(2))))) == (1, 2, 1)


def test_expected_citations(spark):
    answers = spark.createDataFrame([(1, "see 42", ["p", "p", "q"]), (2, "  ", None), (3, None, []), (4, "x", ["q"])], "query_id long, answer string, citations array<string>")
    docs = spark.createDataFrame([("p", "about 42")], "path string, content string")
    expected = spark.createDataFrame([(1, "q"), (1, "z"), (4, "z"), (9, "q")], "query_id long, path string")
    r = G.citation_metrics(answers, docs, answers.limit(0).select("query_id", F.lit("p").alias("path")), expected).first()
    assert (r.answers, r.answered, r.with_citation, r.expected_in_citations, r.citations, r.existing, r.supported) == (4, 2, 2, 1, 3, 1, 1)


def test_index_page_and_header(spark):
    rows = [("s", n, [str(n), "a|b"]) for n in range(1, 9)] + [("r", 1, ["h"]), ("r", 2, ["v"])]
    parts = J.table_to_markdown_parts(spark.createDataFrame(rows, "sheet string, row long, cells array<string>"), 3)
    r = J.table_index(parts, F.lit("book")).first()
    assert r.content == "# book\n\n## Sheets\n\n- [r](sheets/r.md): 1 rows, 1 files\n- [s](sheets/s.md): 7 rows, 3 files\n" and (r.n_sheets, r.n_rows, r.n_files) == (2, 8, 4)
    docs = spark.createDataFrame([("p", "t --> u", "![](https://h/file/ab)"), ("q", None, "none")], "path string, title string, content string")
    assets = spark.createDataFrame([("ab", "x.png")], "token string, name string")
    got = {r.path: r.content for r in J.rewrite_assets(docs, assets, J.provenance(title="title", by=F.lit("me"))).collect()}
    assert got == {"p": "<!-- title=t -- > u | by=me -->\n\n![](x.png)", "q": "<!-- title= | by=me -->\n\nnone"}


def test_totals_of_an_export(spark):
    nodes = spark.createDataFrame([("docx", 2), ("docx", None), ("sheet", 5), (None, 1)], "type string, images long")
    none = nodes.limit(0)
    got = {r.action: r.n for r in X.export_report(none.select(F.col("type").alias("change")), none, none, nodes, spark.sql("select 'written' as action")).collect()}
    assert got == {"failed": 0, "skipped": 0, "scanned": 4, "docs": 2, "images": 2, "skipped sheet": 1, "skipped ": 1, "did written": 1}


def test_heads_of_sessions_in_any_order(spark, tmp_path):
    rows = [(1, 5, "user", "second", 50), (1, 2, "user", "  first\nquestion ", 20), (1, 9, "answer", "x", 90), (2, 1, "answer", "no question", 10), (2, 3, "user", None, 30), (None, 4, "user", "lost", 40)]
    m = spark.createDataFrame(rows, "session_id long, message_id long, kind string, content string, t long").withColumn("ts", F.timestamp_seconds("t")).drop("t")
    state = str(tmp_path / "s")
    merge = W.sessions_into(spark, state)
    merge(m.where("message_id >= 5"), 0)
    assert [r.title for r in W.sessions_of(spark, state).collect()] == ["second"]
    merge(m.where("message_id < 5 or message_id = 9"), 1)  # earlier messages come later, one again
    before = P.current(spark, state)
    merge(m.where("message_id < 5"), 1)  # repeated after its commit
    assert P.current(spark, state) == before
    got = sorted(map(tuple, W.sessions_of(spark, state).collect()))
    assert got == sorted(map(tuple, W.session_heads(m).collect()))
    assert [(r[0], r[2]) for r in got] == [(1, "first question"), (2, "New session")]
    merge(m.limit(0), 2)
    assert sorted(map(tuple, W.sessions_of(spark, state).collect())) == got
