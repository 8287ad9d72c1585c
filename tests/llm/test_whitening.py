"""Whitening and fill-in-the-middle against numpy, plain Python and odd rows."""

import hashlib
import math
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from marlstone.llm import fill_middle, whitening

VECTORS = "vec_id long, embedding array<float>, label int"


def plain_whitening(vectors, weights="counts", components=32):
    """Eigenvalues, deviations and whitened vectors of (id, x) rows, copies expanded."""
    x = np.array([v for _, v in vectors], dtype=np.int64)
    fitted = x if weights == "counts" else np.unique(x, axis=0)
    n, total = len(fitted), [int(s) for s in fitted.sum(axis=0)]
    c = fitted - np.array([s / n for s in total])
    v = c.T @ c / n
    e, vec = np.linalg.eigh(v)
    e, vec = e[::-1][:components], vec[:, ::-1][:, :components]
    deviation = [sum((n * int(a) - s) ** 2 for a, s in zip(row, total)) for row in x]
    return n, deviation, (x - np.array([s / n for s in total])) @ vec / np.sqrt(e), e / np.trace(v)


def x_of(c):
    return [math.floor(64 * float(np.float32(v))) + 1_000_000 for v in c]


@pytest.mark.parametrize("weights", ["counts", "one"])
def test_whitening_against_numpy(spark, weights, monkeypatch):
    monkeypatch.setattr(whitening, "HOT", 4)  # the vector that a third of the rows have is dealt over several tasks
    rng = np.random.default_rng(5)
    rows = [(i, [float(v) for v in rng.normal(size=6)], 0) for i in range(300)]
    rows += [(1000 + i, rows[7][1], 0) for i in range(150)] + [(7, rows[7][1], 0), (None, rows[3][1], 0)]
    bad = [(2000, None, 0), (2001, [None] + [0.5] * 5, 0), (2002, [float("nan")] * 6, 0), (2003, [float("inf")] + [0.0] * 5, 0), (2004, [3e30] + [0.0] * 5, 0), (2005, [], 0), (2006, [0.5] * 5, 0)]
    frame = spark.createDataFrame(rows + bad, VECTORS).withColumns({c: F.lit(1) for c in ("n", "key", "component", "a.b", "copies")}).repartition(5)
    got = whitening.whiten(frame, weights=weights).toPandas()
    kept = [(i, x_of(v)) for i, v, _ in rows]
    n, deviation, z, explained = plain_whitening(kept, weights)
    assert len(got) == 6 * len(rows) and set(got.n) == {n} and got.identity_error.max() < 1e-9 and got.identity_error.nunique() == 1
    by = {}
    for r in got.itertuples():
        by.setdefault((-1 if r.vec_id != r.vec_id else int(r.vec_id), r.deviation), {}).setdefault(r.component, []).append(r.whitened)
        assert abs(r.explained / explained[r.component - 1] - 1) < 1e-4
    signs = np.sign([by[0, deviation[0]][k + 1][0] * z[0][k] for k in range(6)])
    for (i, _), dev, row in zip(kept, deviation, z, strict=True):
        found = by[-1 if i is None else i, dev]
        assert all(np.allclose(found[k + 1], row[k] * signs[k], atol=1e-9) for k in range(6))


def test_vectors_that_do_not_spread(spark):
    schema = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    for rows in ([], [(1, [1.0, 2.0], 0)], [(1, [1.0, 2.0], 0), (2, [1.0, 2.0], 0)], [(1, None, 0)], [(1, [], 0), (2, [], 0)]):
        got = whitening.whiten(spark.createDataFrame(rows, VECTORS))
        assert got.columns == schema and got.count() == 0
    # the second dimension follows the first: one component
    got = whitening.whiten(spark.createDataFrame([(i, [float(i), float(2 * i)], 0) for i in range(5)], VECTORS)).toPandas()
    assert set(got.component) == {1} and len(got) == 5 and abs(got.explained.iloc[0] - 1) < 1e-9


def test_sums_and_deviations_beyond_64_bits(spark):
    big = 2.0**50
    rows = [(1, [big, 0.0], 0), (2, [-big, 1.0], 0), (3, [big, 3.0], 0)]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).toPandas()
    assert set(got.n) == {3} and got.deviation.isna().all()
    with pytest.raises(ValueError):
        whitening.fit(None, 2, weights="some")


# ---- fill-in-the-middle

TOKEN = re.compile("[\x20\x09-\x0d]*[^\x20\x09-\x0d]+|[\x20\x09-\x0d]+")


def plain_fim(doc_id, text):
    text = text or ""
    units = TOKEN.findall(text)
    n = len(units)
    h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return doc_id, n, "plain", None, None, sha(text), sha(text), text
    out = f"<S>{s}<P>{p}<M>{m}" if h4 % 100 < 80 else f"<P>{p}<S>{s}<M>{m}"
    return doc_id, n, "spm" if h4 % 100 < 80 else "psm", len(p), len(m), sha(out), sha(text), out


@pytest.mark.parametrize("frame_bytes", [1, 7, 1 << 14])
def test_middles(spark, frame_bytes):
    long_ = " ".join(f"w{i % 977} é{i % 31}" for i in range(40_000 if frame_bytes > 7 else 400))
    texts = [None, "", "one", " \t\n\x0b ", "  two words  ", "日本語 text — “quoted”  \n", "a <P> b", "a <S", "x<M>", "< P > <p>", "<<P", "w" * 5000, long_]
    rows = [(i, texts[i % len(texts)]) for i in range(20 * len(texts))] + [(None, "no id here at all"), (3, "tie tie"), (3, "tie tie")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("n", "form", "frames", "a.b")}).repartition(4)
    out = fill_middle.fill_in_middle(fill_middle.frame_table(docs, frame_bytes))
    key = lambda r: (r[0] is None, r[0] or 0, r[5], r[6])
    expected = sorted((plain_fim(*r) for r in rows), key=key)
    got = sorted((tuple(r) for r in fill_middle.digests(out).collect()), key=key)
    assert got == [e[:7] for e in expected]
    assert sorted(r.text for r in fill_middle.unframe(out).collect()) == sorted(e[7] for e in expected)
    assert {"spm", "psm", "plain"} == {r[2] for r in got}


def test_middles_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert fill_middle.digests(fill_middle.fill_in_middle(fill_middle.frame_table(docs))).columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab \n\té日", max_size=60), st.integers(1, 20), st.data())
def test_frames_part_where_units_end(text, frame_bytes, data):
    frames = fill_middle.pack(text.encode(), frame_bytes)
    units = TOKEN.findall(text)
    assert sum(f[1] for f in frames) == len(units) and sum(f[2] for f in frames) == len(text)
    a, b = sorted(data.draw(st.integers(0, len(units))) for _ in range(2))
    parts, opened = fill_middle.cut(frames, [a, b])
    assert [b"".join(fill_middle.read(p)).decode() for p in parts] == ["".join(units[:a]), "".join(units[a:b]), "".join(units[b:])]
    assert opened <= 2 and [sum(f[1] for f in p) for p in parts] == [a, b - a, len(units) - b]
    for form in ("psm", "spm"):
        assert b"".join(fill_middle.restore(fill_middle.transform(frames, form, a, b)[0], form)).decode() == text


def test_only_cut_frames_are_opened():
    text = " ".join(f"word{i}" for i in range(5000)).encode()
    frames = fill_middle.pack(text, 512)
    parts, opened = fill_middle.cut(frames, [1000, 4000])
    assert opened == 2 and len(frames) > 80
    kept = {f[0] for f in frames}
    assert sum(f[0] not in kept for p in parts for f in p) <= 4
