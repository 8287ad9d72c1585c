"""Tables in parts: ingestion in buckets, filed roll-ups, and traces whose events come in any order."""

import random

import pytest
from pyspark.sql import functions as F

from marlstone.operators import usage as U
from marlstone.sources import files as I
from marlstone.sources import parts as P
from marlstone.streaming import streams as W

SCAN = "relative_path string, size long, sha256 string"


def _rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_batches_rewrite_the_buckets_they_touch(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(W, "BUCKET_ROWS", 8)
    state, seen = str(tmp_path / "s"), []
    known = spark.createDataFrame([("p3.md", "h3", "converted", True), ("p4.md", "old", "converted", True), ("p5.md", "h5", "failed", True)], "relative_path string, source_sha256 string, status string, output_exists boolean")
    merge = W.merge_into(spark, state, known, lambda due, epoch: seen.append((epoch, _rows(due))))
    batch = lambda *ns, h="h": spark.createDataFrame([(f"p{n}.md", n, f"{h}{n}") for n in ns], SCAN)
    merge(batch(*range(40)), 0)
    assert P.current(spark, state)["buckets"] == 8 and P.current(spark, state)["rows"] == 40
    status = lambda: {r.relative_path: r.status for r in W.sources_of(spark, state).collect()}
    want = {f"p{n}.md": "discovered" for n in range(40)} | {"p3.md": "converted", "p5.md": "failed"}
    assert status() == want
    reasons = {p: r for p, _, r in seen[0][1]}
    assert reasons["p4.md"] == "source_changed" and reasons["p5.md"] == "previous_failed" and reasons["p6.md"] == "new_source" and "p3.md" not in reasons

    merge(batch(3, h="new"), 1)  # one path, one bucket
    parts = P.current(spark, state)["parts"]
    assert list(parts.values()).count("batch-1") == 1 and status() == want | {"p3.md": "discovered"}
    merge(batch(3, h="new"), 1)  # repeated after its commit
    assert P.current(spark, state)["parts"] == parts and [e for e, _ in seen] == [0, 1]

    with monkeypatch.context() as m:
        m.setattr(P, "point_to", lambda *x: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            merge(batch(5, 99, h="new"), 2)
    assert P.current(spark, state)["parts"] == parts and status() == want | {"p3.md": "discovered"}
    merge(batch(5, 99, h="new"), 2)
    assert status() == want | {"p3.md": "discovered", "p5.md": "discovered", "p99.md": "discovered"}

    written = W.mark_missing_into(spark, state, W.sources_of(spark, state).where("relative_path <> 'p7.md'"), "1")
    assert len(written) == 1 and status()["p7.md"] == "source_missing" and sum(s == "source_missing" for s in status().values()) == 1
    assert W.mark_missing_into(spark, state, W.sources_of(spark, state).where("relative_path <> 'p7.md'"), "2") == []
    for epoch, n in ((3, 1000), (4, 2000)):  # what was replaced goes with the next run but one
        merge(batch(*range(n, n + 60)), epoch)
    assert P.current(spark, state)["rows"] == 161 == W.sources_of(spark, state).count()
    merge(batch(1), 5)
    on_disk = {p.parent.name + "/" + p.name for p in (tmp_path / "s" / "data").glob("*/bucket=*")}
    at = P.current(spark, state)
    assert on_disk == {f"{r}/bucket={b}" for b, r in at["parts"].items()} | set(at["replaced"])


def test_rollups_are_filed_by_month(spark, tmp_path):
    path = str(tmp_path / "r")
    schema = "trace_id string, member long, seq long, ts timestamp, type string, path string, query string, zero_hit boolean, content string, citations array<string>"
    days = [f"20{22 + m // 12}-{m % 12 + 1:02d}-{d:02d}" for m in range(14) for d in (3, 9)]
    event = lambda day, i: (f"{day}-{i}", 1, 1, None, "search", "p" if i % 2 else None, f"q{i}", False, None, None)

    def traces(*what):
        e = spark.createDataFrame([(*event(d, i), d) for d, i in what], schema + ", d string").withColumn("ts", F.to_timestamp("d")).drop("d")
        return U.fold_traces(e).withColumn("question", F.col("trace_id"))

    everything = [(d, i) for d in days for i in range(3)]
    assert U.file_rollups(traces(*everything), path, "1") == sorted({d[:7] for d in days})[-12:]
    files = lambda: {p: p.stat().st_mtime_ns for p in (tmp_path / "r").rglob("*.parquet")}
    at, before = files(), _rows(U.filed_rollups(spark, path))
    assert len(before) == 24 and U.file_rollups(traces(*everything), path, "2") == [] and files() == at and _rows(U.filed_rollups(spark, path)) == before

    late = days[-1]  # its whole day again, with a late trace; the other day of the month stays
    assert U.file_rollups(traces(*[(late, i) for i in range(4)]), path, "3") == [late[:7]]
    got = {r.day: r for r in U.filed_rollups(spark, path).collect()}
    assert got[late].traces == 4 and got[late].questions == [f"{late}-{i}" for i in range(4)] and got[days[-2]].traces == 3 and len(got) == 24
    assert [r for r in before if r[-2] != late] == [tuple(r) for r in sorted(got.values()) if r.day != late]

    assert U.file_rollups(traces(("2023-03-01", 0)), path, "4") == ["2023-03"]
    assert sorted(P.current(spark, path)["parts"]) == [f"2022-{m:02d}" for m in range(4, 13)] + ["2023-01", "2023-02", "2023-03"]
    assert U.file_rollups(traces(("2020-01-01", 0)), path, "5") == [] and U.filed_rollups(spark, str(tmp_path / "none")).count() == 0


def test_traces_in_any_order_equal_the_batch_fold(spark, tmp_path):
    """Events of hundreds of traces, shuffled over files that are read one by one, within what the watermark allows."""
    rnd = random.Random(3)
    schema = "trace_id string, member long, seq long, ts timestamp, type string, path string, query string, zero_hit boolean, content string, citations array<string>"
    rows = []
    for t in range(150):
        numbered = t % 2 == 0  # the others have gaps, and wait for the watermark
        kinds = [rnd.choice(["search", "read", "notice", "search"]) for _ in range(rnd.randrange(1, 6))] + [rnd.choice(["answer", "error", "read"])]
        for i, kind in enumerate(k for k in kinds if k != "notice" or not numbered):
            path = f"p{rnd.randrange(4)}" if kind in ("search", "read") and rnd.random() < 0.7 else None
            rows.append((f"t{t}", 5, i + 1 if numbered else 7 * i + 3, t * 60 + i, kind, path, f"q{i}" if kind == "search" else None, kind == "search" and path is None,
                         f"answer {i}" if kind == "answer" else None, [f"p{rnd.randrange(4)}", "p1"] if kind == "answer" else None))
    rows.append(("end", 5, 3, 10**6, "search", None, None, True, None, None))
    df = spark.createDataFrame([(*r[:3], None, *r[4:], r[3]) for r in rows], schema + ", s long").withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("s"))).drop("s").persist()
    for i in range(4):  # three files of shuffled events, then one that lets time pass
        part = df.where("trace_id = 'end'") if i == 3 else df.where("trace_id <> 'end'").where(F.pmod(F.xxhash64("trace_id", "seq"), F.lit(3)) == i)
        part.orderBy(F.rand(1)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    W.stream_traces(s, "4 hours").writeStream.format("memory").queryName("any_order").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    want = U.fold_traces(df.where("trace_id <> 'end'"))
    cols = ["trace_id", "member", "failed", "answer", "retrieved", "citations", "cited_not_retrieved", "retrieved_but_unused", "zero_hit_queries", "answer_chars", "no_hit_answer"]
    got = spark.sql("select * from any_order")
    assert {r.closed_by for r in got.collect()} == {"answer", "error", "timeout"}
    key = lambda r: r.trace_id
    assert sorted(got.select(*cols, "n_steps").collect(), key=key) == sorted(want.select(*cols, F.size("steps").cast("long").alias("n_steps")).collect(), key=key)


def test_traces_of_one_group_end_each_at_its_time(spark, tmp_path, monkeypatch):
    """Traces that share a group: one ends whole, one by the watermark while the group gets events of others, one stays open."""
    monkeypatch.setattr(W, "TRACE_GROUPS", 1)
    rows = [[("a", 1, 0, "start"), ("b", 1, 60, "start")], [("a", 2, 60, "answer"), ("c", 5, 30_000, "read")], [("c", 6, 30_060, "read")], [("c", 7, 30_120, "read")]]
    for part in rows:
        df = spark.createDataFrame([(t, 1, seq, at, kind, None, [], None) for t, seq, at, kind in part], "trace_id string, member long, seq long, t long, type string, path string, citations array<string>, content string")
        df.withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("t"))).drop("t").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(spark.read.parquet(str(tmp_path / "in")).schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    W.stream_traces(s, "1 hour").writeStream.format("memory").queryName("one_group").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    assert sorted((r.trace_id, r.closed_by, r.n_steps) for r in spark.sql("select * from one_group").collect()) == [("a", "answer", 0), ("b", "timeout", 0)]


def test_a_batch_has_as_many_tasks_as_its_rows_need(spark, tmp_path):
    """A stream's session does not fit its shuffles to the rows; what is done with a batch there would have as many tasks as a shuffle may have, in each batch."""
    of_stream = spark.newSession()
    of_stream.conf.set("spark.sql.adaptive.enabled", "false")
    of_stream.conf.set("spark.sql.shuffle.partitions", "64")
    state, seen = str(tmp_path / "s"), []
    merge = W.merge_into(spark, state, None, lambda due, epoch: seen.append((due.rdd.getNumPartitions(), len(_rows(due)))))
    for epoch in range(2):
        merge(of_stream.createDataFrame([(f"p{n}.md", n, f"h{epoch}{n}") for n in range(20)], SCAN), epoch)
    assert [n for _, n in seen] == [20, 20] and all(tasks <= 16 for tasks, _ in seen)


def test_batches_of_a_drained_folder_grow_and_not_their_number(spark, tmp_path):
    from marlstone.registered import flows

    for n, want in ((20, 8), (320, 10)):
        for i in range(n):
            (tmp_path / f"f{i}").write_text("x")
        assert flows._per_batch(spark, str(tmp_path)) == want
