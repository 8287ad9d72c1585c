"""The Jaccard join against brute force."""

from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from marlstone.llm import fragment_join
from tests.llm.test_llm import LONG, ODD, SCHEMA, brute_components, documents


def found(spark, rows, k, percent):
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return {r.doc_id: (r.n_shingles, r.component_id) for r in fragment_join.jaccard_components(frame, k, percent).collect()}


@pytest.mark.parametrize("k, percent", [(3, 90), (5, 80)])
def test_join(spark, sf_dir, k, percent):
    rng = np.random.default_rng(5)
    base = [f"b{i}" for i in rng.integers(0, 5000, 150)]
    rows = [(r.doc_id, r.text) for r in documents(spark, sf_dir).collect()]
    for i in range(60):  # a group of copies with more and more changes
        w = list(base)
        for x in rng.integers(0, len(w), i // 6):
            w[x] = f"e{i}x{x}"
        rows.append((1000 + i, " ".join(w)))
    rows += [(2000 + i, " ".join(base)) for i in range(20)] + [(3000, None), (3001, ""), (3002, "only two"), (3003, "Only  TWO")]
    rows += [(4000 + i, " ".join(f"s{j}" for j in range(9 + i))) for i in range(30)]  # short texts, each of which goes on from the one before
    assert found(spark, rows, k, percent) == brute_components(rows, k, percent)


@pytest.mark.parametrize("long_, leaders", [(fragment_join.LONG, fragment_join.LEADERS), (6, 8)])
def test_large_group_with_many_that_link_with_none(spark, monkeypatch, long_, leaders):
    monkeypatch.setattr(fragment_join, "LONG", long_)
    monkeypatch.setattr(fragment_join, "LEADERS", leaders)
    rng = np.random.default_rng(11)
    base = [f"b{i}" for i in rng.integers(0, 400, 150)]
    rows = []
    for i in range(200):
        w = list(base)
        for x in rng.integers(0, len(w), i % 8):
            w[x] = f"e{rng.integers(0, 40)}"
        rows.append((i, " ".join(w)))
    want = brute_components(rows, 3, 90)
    assert 30 < sum(n == 1 for n in Counter(c for _, c in want.values()).values()) < 170
    assert found(spark, rows, 3, 90) == want


def test_passages_that_many_share_make_no_pairs(spark, monkeypatch):
    """Texts of which three quarters are one passage: a list for each of its n-grams would hold them all."""
    counted = []
    kept = fragment_join.overlapping
    monkeypatch.setattr(fragment_join, "overlapping", lambda pairs, *a: counted.append(pairs.count()) or kept(pairs, *a))
    passage = " ".join(f"p{i}" for i in range(300))
    rows = [(i, passage + " " + " ".join(f"q{i}x{j}" for j in range(100))) for i in range(600)]
    rows += [(1000 + i, passage + " " + " ".join(f"q7x{j}" for j in range(100)) + f" z{i}") for i in range(3)]
    got = found(spark, rows, 3, 90)
    assert {i: c for i, (_, c) in got.items() if c != i} == {1000 + i: 7 for i in range(3)}
    assert sum(counted) < 20_000  # of 180,000


def test_odd_rows(spark):
    frame = spark.createDataFrame(ODD, SCHEMA).withColumns({c: F.lit(1) for c in ("n", "own", "key", "component_id", "a.b", "cid", "c", "home")})
    got = fragment_join.jaccard_components(frame).collect()
    assert len(got) == len(ODD) and {r.component_id for r in got if r.doc_id in (4, 5)} == {4}
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in got if r.doc_id in (1, 2, 7, 8)} == {(1, 0, 1), (2, 0, 2), (7, 1, 7), (8, 0, 8)}
    assert [r.component_id for r in got if r.doc_id is None] == [None]
    assert fragment_join.jaccard_components(spark.createDataFrame([], SCHEMA)).count() == 0
    near = LONG.replace("w500 ", "", 3)
    rows = [(10, LONG), (11, near), (None, LONG + " end"), (12, "w1 " * 30_000), (13, "w2 " * 30_000)]
    got = fragment_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.component_id) for r in got) == [(False, 10, 10), (False, 11, 10), (False, 12, 12), (False, 13, 13), (True, 0, 10)]


@settings(max_examples=150, deadline=None)
@given(st.integers(1, 400), st.data())
def test_linked_sets_share_a_key(n, data):
    """Two sets at the threshold have a segment in common, or both the mark of their band."""
    percent = data.draw(st.sampled_from([60, 80, 90, 95]))
    rng = np.random.default_rng(data.draw(st.integers(0, 10_000)))
    a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2))
    lost, new = data.draw(st.integers(0, n // 5 + 1)), data.draw(st.integers(0, n // 5 + 1))
    b = np.unique(np.concatenate((rng.permutation(a)[lost:], rng.integers(0, 1 << 63, new, dtype=np.uint64) * np.uint64(2))))
    same = len(np.intersect1d(a, b))
    linked = 100 * same >= percent * (len(a) + len(b) - same) and len(a) and len(b)
    if linked and same < max(len(a), len(b)):
        assert fragment_join.differing(len(a) + len(b), percent) >= len(a) + len(b) - 2 * same
        small, large = sorted((a, b), key=len)
        keys, steps = fragment_join.segment_keys(large, percent)
        assert set(keys[steps == 0]) & set(fragment_join.segment_keys(small, percent)[0])
        own = dict(fragment_join.fine_signatures(large, percent))[0]
        bands = np.searchsorted(fragment_join.EDGES, [len(small), len(large)], side="right")
        other = dict(fragment_join.fine_signatures(small, percent))[bands[1] - bands[0]]
        apart = np.bitwise_or.reduce((own ^ other).reshape(-1, fragment_join.BITS), axis=1)
        assert sum(int(w).bit_count() for w in apart.view(np.uint64)) <= len(a) + len(b) - 2 * same
