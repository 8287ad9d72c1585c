"""Tokens of the index against those of SQLite's full-text index."""

import sqlite3
import unicodedata

import pytest
from pyspark.sql import functions as F

from marlstone.functions import text as T


@pytest.fixture(scope="module")
def plain():
    """Tokens of a text by FTS5 with its default tokenizer."""
    con = sqlite3.connect(":memory:")
    try:
        con.execute("create virtual table t using fts5(x, tokenize='unicode61')")
    except sqlite3.OperationalError:
        pytest.skip("no FTS5")
    con.execute("create virtual table v using fts5vocab(t, 'instance')")

    def tokens(text):
        con.execute("delete from t")
        con.execute("insert into t values (?)", (text,))
        return [r[0] for r in con.execute("select term from v order by offset")]

    return tokens


def test_accents_fold_as_in_fts5(spark, plain):
    """Every letter that both know up to U+1FFF between others, every mark that FTS5 drops, and words that mix them."""
    # letters that are younger than the tables of FTS5 have no lower case and no plain form there
    young = lambda c: plain(c) == [c] and (c.lower() != c or "\u1c80" <= c <= "\u1c88")
    letters = [c for c in map(chr, range(0x41, 0x2000)) if unicodedata.category(c)[0] in "LN" and len(plain(f"q{c}q")) == 1 and not young(c)]
    # nor does every Java know the youngest letters that FTS5 knows
    known = spark.createDataFrame([(c,) for c in letters], "c string").where(F.col("c").rlike(r"^[\p{L}\p{N}]$"))
    letters = [r.c for r in known.collect()]
    marks = [c for c in map(chr, range(0x300, 0x370)) if plain(f"q{c}q") == ["qq"]]
    assert len(letters) > 5000 and len(marks) > 20
    words = [f"q{c}q" for c in letters] + [f"re{m}aux Ab{m}c{m} {m}d e{m} f" for m in marks] + ["\u1e0dd \u01e7q \u01b0\u0301a \u1ea5b", "CAF\u00c9 cafe\u0301 \u0130stanbul", "\u03a3\u03af\u03c3\u03c5\u03c6\u03bf\u03c2", ""]
    df = spark.createDataFrame(list(enumerate(words)), "i long, w string")
    got = {r.i: r.t for r in df.select("i", T.index_tokens("w").alias("t")).collect()}
    wrong = [(words[i], t, plain(words[i])) for i, t in got.items() if t != plain(words[i])]
    assert not wrong, (len(wrong), wrong[:20])
