"""Windows of licence notices in long texts, against a plain search over all pairs of windows."""

import random
import re
import time

from marlstone.llm import licence_scan as L

SMALL = {"A": ["one two three four five six"], "B": ["four five six seven", "all rights reserved"], "C": ["one two three four five six"]}


def _words(text):
    return [w.strip(".") for w in re.sub(r"[^a-z0-9.]", " ", text.lower()).split() if w.strip(".")]


def _plain(text, templates, limit):
    """(line, licence, dice) of a text by comparing everything with everything."""
    known = [(k, {tuple(w[i : i + 2]) for i in range(len(w) - 1)}, len(w)) for k, ts in templates.items() for w in map(_words, ts)]
    dice = lambda g, t: 2 * len(g & t) / (len(g) + len(t))
    best = lambda g: min(((-dice(g, t), k) for k, t, _ in known if g), default=(0, ""))
    grams = lambda w: {tuple(w[i : i + 2]) for i in range(len(w) - 1)}
    parts = text.split("\n")
    rows = [(i, *best(grams(_words(p)))) for i, p in enumerate(parts)] + ([(-1, *best(grams(_words(text))))] if len(parts) > 1 else [])
    rows = [(i, k, -d) for i, d, k in rows if -d >= limit]
    words = [(w, i) for i, p in enumerate(parts) for w in _words(p)]
    pairs = [(words[i][0], words[i + 1][0]) for i in range(len(words) - 1)]
    wins = []
    for k, t, n in known:
        for i, p in enumerate(pairs):
            d = dice(set(pairs[i : i + n - 1]), t)
            if p in t and d >= limit:
                wins.append((-d, k, i, n))
    plain = list(rows)
    for x in wins:
        if any(y[2] < x[2] + x[3] and x[2] < y[2] + y[3] and y[:3] < x[:3] for y in wins):
            continue
        first, last = words[x[2]][1], words[min(x[2] + x[3], len(words)) - 1][1]
        if not any(k == x[1] and (i == -1 or (i == first == last)) for i, k, _ in plain):
            rows.append((first, x[1], -x[0]))
    return sorted((i, k, round(d, 9)) for i, k, d in rows)


def test_windows_equal_a_plain_search(spark):
    rnd = random.Random(5)
    vocabulary = "one two three four five six seven all rights reserved x y".split()
    phrases = [t for ts in SMALL.values() for t in ts]
    texts = []
    for n in (3, 20, 60, 200, 400):
        for _ in range(6):
            parts = [rnd.choice(phrases) if rnd.random() < 0.4 else rnd.choice(vocabulary) for _ in range(n)]
            texts.append("".join(p + rnd.choice("   \n") for p in parts))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got: dict[int, list] = {i: [] for i in range(len(texts))}
    for r in L.scan_licences(docs, SMALL).collect():
        got[r.doc_id].append((r.line, r.licence, round(r.dice, 9)))
    for i, text in enumerate(texts):
        assert sorted(got[i]) == _plain(text, SMALL, L.THRESHOLD), text


def test_tens_of_thousands_of_notices_in_one_text(spark):
    n = 32_000
    docs = spark.createDataFrame([(1, "All rights reserved.\n" * n), (2, "x All rights reserved. " * n)], "doc_id long, text string")
    begin = time.time()
    got = {(r.doc_id, r.licence): r["count"] for r in L.scan_licences(docs).groupBy("doc_id", "licence").count().collect()}
    assert got[1, "Proprietary"] == n + 1  # each line and the whole text
    assert got[2, "Proprietary"] == n
    assert time.time() - begin < 30
