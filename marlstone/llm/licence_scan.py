"""Licence scan: passages of documents compared to licence templates by Dice coefficient over word bigrams.

A passage is a line, a whole text of several lines, or a window: as many words of the text as a template has, over
line ends, beginning where two words of the template follow each other. So a notice is found in mid-line and wrapped over
the lines of a longer text. Text is normalised to lower-case words of letters, digits and inner dots. Templates whose
number of bigrams cannot reach the threshold with the passage's are pruned by size; passages are skipped that hold no
word without which no template can be reached, and windows are looked at only in texts that hold enough of a
template's bigrams. Built-in functions only, and no shuffle.
"""

from __future__ import annotations

import math
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm.common import let, table

THRESHOLD = 0.8

# Short licence notices in common use, by identifier.
TEMPLATES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the "
        "License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law "
        "or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR "
        "CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and "
        "limitations under the License.",
    ],
    "BSD-2-Clause": [
        "Licensed under the BSD 2-Clause License.", "Released under the Simplified BSD License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
        "conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the "
        "following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and "
        "the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED "
        "BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE "
        "IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT "
        "HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, "
        "BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
        "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR "
        "OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ],
    "BSD-3-Clause": ["Licensed under the BSD 3-Clause License.", "Released under the New BSD License."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC0-1.0": ["This work is dedicated to the public domain under CC0 1.0 Universal."],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2."],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as "
        "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This "
        "program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
        "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    ],
    "AGPL-3.0": ["This work is licensed under the GNU Affero General Public License, version 3."],
    "LGPL-3.0": ["This work is licensed under the GNU Lesser General Public License, version 3."],
    "ISC": [
        "Released under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS "
        "PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES "
        "OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR "
        "CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF "
        "CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS "
        "SOFTWARE.",
    ],
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
        "permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright "
        "notice and this permission notice shall be included in all copies or substantial portions of the Software. THE "
        "SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE "
        "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR "
        "COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR "
        "OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
    "Proprietary": ["All rights reserved."],
}


def normalised_words(passage: Column) -> Column:
    """Lower-case words of letters, digits and inner dots."""
    parts = F.split(F.regexp_replace(F.lower(passage), r"[^\p{L}\p{N}.]", " "), " +")
    return F.filter(F.transform(parts, lambda w: F.btrim(w, F.lit("."))), lambda w: w != "")


def bigrams(words: Column) -> Column:
    """The distinct pairs of words that follow each other."""
    pairs = F.transform(
        F.sequence(F.lit(0), F.size(words) - 2), lambda i: F.concat_ws(" ", F.get(words, i), F.get(words, i + 1)))
    return F.when(F.size(words) < 2, F.array().cast("array<string>")).otherwise(F.array_distinct(pairs))


class Template(NamedTuple):
    licence: str
    grams: list[str]
    #: words of its text
    words: int


def load_templates(spark: SparkSession, templates: dict[str, list[str]] | None = None) -> list[Template]:
    """The templates with a bigram, by name; as small as the list of templates."""
    rows = [(k, t) for k, ts in (TEMPLATES if templates is None else templates).items() for t in ts]
    flat = spark.createDataFrame(rows, "licence string, body string").select("licence", normalised_words(F.col("body")).alias("w"))
    return sorted(Template(r.licence, sorted(r.grams), r.n) for r in flat.select("licence", bigrams(F.col("w")).alias("grams"), F.size("w").alias("n")).collect() if r.grams)


def least_shared(n: int, threshold: float) -> int:
    """Bigrams of a template of n that any passage at the threshold has: both sizes are at least n * t / (2 - t)."""
    return max(1, math.ceil(n * threshold / (2 - threshold) - 1e-9))


def anchors(templates: list[Template], threshold: float) -> list[str]:
    """Words of which any passage at the threshold has at least one.

    A passage that reaches a template of n bigrams has one of any n - least_shared + 1 of them; of each template those
    with the word that most templates share are taken.
    """
    spread: dict[str, int] = {}
    for t in templates:
        for w in {w for g in t.grams for w in g.split(" ")}:
            spread[w] = spread.get(w, 0) + 1
    telling = lambda g: max(g.split(" "), key=lambda w: (len(w) > 5, spread[w], len(w), w))
    chosen: set[str] = set()
    for t in templates:
        need = len(t.grams) - least_shared(len(t.grams), threshold) + 1
        best = sorted(t.grams, key=lambda g: (telling(g) not in chosen, len(telling(g)) <= 5, -spread[telling(g)], g))[:need]
        chosen.update(map(telling, best))
    return sorted(w for w in chosen if not any(v != w and v in w for v in chosen))


def scan_licences(docs: DataFrame, templates: dict[str, list[str]] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, line (from 0; -1 for the whole text; that of its first word for a window), licence and dice: the best
    template of each line and of the whole text, and each window that no better one overlaps.

    Ties go to the first licence by name, then to the earlier window. Windows are left out where their line or the whole
    text is reported with the same licence. Null and empty texts have no passages, repeated rows give repeated results,
    other columns are ignored, whatever their names; without templates or documents the result is empty.
    """
    known = load_templates(docs.sparkSession, templates)
    needed = anchors(known, threshold) if known else []
    has_any = lambda c: reduce(lambda a, b: a | b, [F.contains(c, F.lit(w)) for w in needed], F.lit(False))
    listed = F.array(*[F.struct(
        F.lit(t.licence).alias("licence"), F.array(*map(F.lit, t.grams)).alias("g"), F.lit(t.words).alias("words"), F.lit(least_shared(len(t.grams), threshold)).alias("need"))
        for t in known]) if known else F.array().cast("array<struct<licence:string,g:array<string>,words:int,need:int>>")
    all_grams = F.array(*map(F.lit, sorted({g for t in known for g in t.grams}))).cast("array<string>")
    # |A & B| is at most the smaller size, so Dice >= t needs sizes within t / (2 - t) of each other
    room = threshold / (2 - threshold)
    unlike = lambda g, t: -2 * F.size(F.array_intersect(g, t["g"])) / (F.size(g) + F.size(t["g"]))

    def best(g: Column) -> Column:
        near = F.filter(listed, lambda t: (F.size(t["g"]) >= F.size(g) * room) & (F.size(t["g"]) * room <= F.size(g)))
        return F.array_min(F.transform(near, lambda t: F.struct(unlike(g, t).alias("d"), t["licence"].alias("licence"))))

    def row(line: Column, of: Column) -> Column:
        return F.struct(line.cast("int").alias("line"), of["licence"].alias("licence"), of["d"].alias("d"))

    def of_lines(lines: Column) -> Column:
        return F.transform(lines, lambda x, i: let(F.when(has_any(F.lower(x)), let(let(normalised_words(x), bigrams), best)), lambda b: F.when(b["d"] <= -threshold, row(i, b))))

    def windows(part: Column, begin: Column, t: Column) -> Column:
        """The windows of a template that start in a part of the pairs."""
        starts = F.filter(F.transform(part, lambda g, i: F.when(F.array_contains(t["g"], g), begin + i)), lambda i: i.isNotNull())
        cut = F.transform(starts, lambda i: let(F.array_distinct(F.slice("_p", i + 1, t["words"] - 1)), lambda g: F.struct(
            unlike(g, t).alias("d"), t["licence"].alias("licence"), i.alias("at"), t["words"].alias("n"))))
        return F.filter(cut, lambda x: x["d"] <= -threshold)

    def in_blocks(ts: Column, reach: Column) -> Column:
        """The windows of a text by blocks of its pairs; a block is as long as the longest template, so what overlaps starts in blocks side by side."""
        blocks = F.sequence(F.lit(0), ((F.size("_p") - 1) / reach).cast("int"))
        return F.transform(blocks, lambda b: let(F.slice("_p", b * reach + 1, reach), lambda part: F.flatten(F.transform(ts, lambda t: windows(part, b * reach, t)))))

    def undominated(blocks: Column) -> Column:
        better = lambda x, y: (y["d"] < x["d"]) | ((y["d"] == x["d"]) & ((y["licence"] < x["licence"]) | ((y["licence"] == x["licence"]) & (y["at"] < x["at"]))))
        overlap = lambda x, y: (y["at"] < x["at"] + x["n"]) & (x["at"] < y["at"] + y["n"])
        around = lambda b: F.flatten(F.array_compact(F.array(F.when(b > 0, F.get(blocks, b - 1)), F.get(blocks, b), F.get(blocks, b + 1))))
        return F.flatten(F.transform(blocks, lambda own, b: F.when(F.size(own) == 0, own).otherwise(
            let(around(b), lambda near: F.filter(own, lambda x: ~F.exists(near, lambda y: overlap(x, y) & better(x, y)))))))

    lines = F.split("text", "\n")
    # each generated column is computed once
    spoken = F.flatten(F.transform(lines, lambda x, i: F.transform(normalised_words(x), lambda w: F.struct(w.alias("w"), i.alias("line")))))
    told = docs.select("doc_id", "text").where(has_any(F.lower("text"))).select("doc_id", "text", F.explode(F.array(spoken)).alias("_w"))
    follow = F.when(F.size("_w") < 2, F.array().cast("array<string>")).otherwise(F.transform(
        F.sequence(F.lit(0), F.size("_w") - 2), lambda i: F.concat_ws(" ", F.get("_w", i)["w"], F.get("_w", i + 1)["w"])))
    paired = told.select("doc_id", "text", "_w", F.explode(F.array(follow)).alias("_p"))
    whole = F.when(F.size(lines) > 1, let(let(F.array_distinct("_p"), best), lambda b: F.when(b["d"] <= -threshold, row(F.lit(-1), b))))
    present = F.array_intersect("_p", all_grams)
    enough = let(present, lambda own: F.filter(listed, lambda t: F.size(F.array_intersect(own, t["g"])) >= t["need"]))
    found = paired.select("doc_id", "_w", "_p", F.explode(F.array(F.struct(of_lines(lines).alias("lines"), whole.alias("whole"), enough.alias("t")))).alias("_f"))
    reach = F.coalesce(F.array_max(F.transform("_f.t", lambda t: t["words"])), F.size("_p") + 1)
    wins = let(let(reach, lambda r: in_blocks(F.col("_f.t"), r)), undominated)
    placed = F.transform(wins, lambda x: F.struct(
        F.get("_w", x["at"])["line"].cast("int").alias("line"), x["licence"].alias("licence"), x["d"].alias("d"),
        F.get("_w", F.least(x["at"] + x["n"], F.size("_w")) - 1)["line"].alias("last")))
    same = lambda r, x: F.coalesce(r["licence"] == x["licence"], F.lit(False))
    new = F.filter(placed, lambda x: ~(same(F.col("_f.whole"), x) | ((x["last"] == x["line"]) & same(F.get("_f.lines", x["line"]), x))))
    plain = F.array_compact(F.concat("_f.lines", F.array("_f.whole")))
    rows = F.concat(plain, F.transform(new, lambda x: F.struct(x["line"].alias("line"), x["licence"].alias("licence"), x["d"].alias("d"))))
    return found.select("doc_id", F.inline(rows)).select("doc_id", "line", "licence", (-F.col("d")).alias("dice"))


def op9_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licences(table(spark, sf_dir, "documents"))


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_VALUES = ", ".join(f"({_quoted(k)}, {_quoted(t)})" for k, ts in TEMPLATES.items() for t in ts)
_WORDS = r"""list_filter(list_transform(string_split_regex(regexp_replace(lower({0}), '[^\p{{L}}\p{{N}}.]', ' ', 'g'), ' +'), lambda w: trim(w, '.')), lambda w: w <> '')"""
OP9_SQL = f"""
with t as (
  select row_number() over () as t, licence, {_WORDS.format("body")} as w from (values {_VALUES}) v(licence, body)),
tg as (
  select distinct t, licence, w[i] || ' ' || w[i + 1] as g from (select *, unnest(range(1, len(w))) as i from t)),
tn as (select t, licence, count(*) as n, any_value(len(w)) as words from tg join t using (t, licence) group by t, licence),
l as (
  select doc_id, unnest(range(0, len(s))) as line, unnest(s) as body from (select doc_id, string_split(text, chr(10)) as s from documents where text is not null)
  union all
  select doc_id, -1, text from documents where contains(text, chr(10))),
lw as (select row_number() over () as u, doc_id, line, {_WORDS.format("body")} as w from l),
lg as (select distinct u, doc_id, line, w[i] || ' ' || w[i + 1] as g from (select *, unnest(range(1, len(w))) as i from lw)),
ln as (select u, count(*) as n from lg group by u),
c as (
  select u, doc_id, line, tg.t, count(*) as k from lg join tg using (g) group by u, doc_id, line, tg.t),
d as (
  select u, doc_id, line, licence, 2.0::double * k / (ln.n + tn.n) as dice from c join ln using (u) join tn using (t)),
plain as (
  select doc_id, line::int as line, min(licence) as licence, dice from (
    select *, max(dice) over (partition by u) as top from d) where dice = top and dice >= {THRESHOLD} group by u, doc_id, line, dice),
ws as (
  select doc_id, line, w, row_number() over (partition by doc_id order by line, i) - 1 as pos from (
    select doc_id, line, unnest(w) as w, unnest(range(1, len(w) + 1)) as i from lw where line >= 0)),
p as (select doc_id, line, pos, w || ' ' || lead(w) over (partition by doc_id order by pos) as g from ws),
has as (
  select doc_id, t from (select distinct doc_id, tg.t, g from p join tg using (g)) join tn using (t) group by doc_id, t
  having count(*) >= any_value(greatest(1, ceil(n * {THRESHOLD} / (2 - {THRESHOLD}) - 1e-9)))),
starts as (select p.doc_id, t, p.pos, p.line from p join has using (doc_id) join tg using (t, g)),
win as (
  select s.doc_id, s.t, s.pos, s.line, count(distinct p.g) as n, count(distinct tg.g) as k from starts s join tn using (t)
  join p on p.doc_id = s.doc_id and p.pos >= s.pos and p.pos < s.pos + tn.words - 1 and p.g is not null left join tg on tg.t = s.t and tg.g = p.g group by all),
wd as (
  select doc_id, pos, line, licence, words, 2.0::double * k / (win.n + tn.n) as dice from win join tn using (t) where 2.0::double * k / (win.n + tn.n) >= {THRESHOLD}),
kept as (
  select * from wd x where not exists (select 1 from wd y where y.doc_id = x.doc_id and y.pos < x.pos + x.words and x.pos < y.pos + y.words and (
    y.dice > x.dice or (y.dice = x.dice and (y.licence < x.licence or (y.licence = x.licence and y.pos < x.pos)))))),
ends as (select doc_id, max(pos) as last from ws group by doc_id),
new as (
  select k.*, e.line as last_line from kept k join ends using (doc_id) join ws e on e.doc_id = k.doc_id and e.pos = least(k.pos + k.words - 1, ends.last))
select doc_id, line, licence, dice from plain
union all
select doc_id, line::int, licence, dice from new x where not exists (
  select 1 from plain r where r.doc_id = x.doc_id and r.licence = x.licence and (r.line = -1 or (r.line = x.line and x.last_line = x.line)))
"""

QUERIES = {"op9_licence_scan": op9_licence_scan}
ORACLES = {"op9_licence_scan": OP9_SQL}
