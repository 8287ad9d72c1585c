"""Text as columns: tokens, lines, titles, snippets and what else is said about one document's text."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters at which a line ends, besides CR LF.
LINE_ENDS = r"\r\n|[\n\r\x0B\f\x1C\x1D\x1E\x85\u2028\u2029]"
#: White space as in Unicode.
BLANK = r"[\s\x0B\x1C-\x1F\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]"
# Fixed value: what counts as a token of a query.
TOKEN = r"[0-9A-Za-z_\-\.]+|[\u4e00-\u9fff]{2,}"


def let(value: Column, body) -> Column:
    """Evaluate value once for a row and hand it to body."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def distinct_ignoring_case(tokens: Column) -> Column:
    """Tokens in order without those that came before in another case."""
    ranked = F.sort_array(F.transform(tokens, lambda t, i: F.struct(F.lower(t).alias("low"), i.alias("i"), t.alias("t"))))
    firsts = let(ranked, lambda r: F.filter(r, lambda x, i: (i == 0) | (F.get(r, i - 1)["low"] != x["low"])))
    ordered = F.sort_array(F.transform(firsts, lambda x: F.struct(x["i"].alias("i"), x["t"].alias("t"))))
    return F.transform(ordered, lambda x: x["t"])


def query_tokens(text: Column | str) -> Column:
    """Words and runs of two or more CJK characters, at least two characters long, distinct but for case."""
    found = F.regexp_extract_all(F.coalesce(col(text), F.lit("")), F.lit(TOKEN), F.lit(0))
    return distinct_ignoring_case(F.filter(found, lambda t: F.length(t) >= 2))


def cjk_pairs(token: Column) -> Column:
    """The adjacent pairs of characters of a CJK token of three or more."""
    pairs = F.transform(F.sequence(F.lit(1), F.length(token) - 1), lambda i: F.substring(token, i, F.lit(2)))
    return F.when(token.rlike(r"^[\u4e00-\u9fff]{3,}$"), pairs).otherwise(F.array().cast("array<string>"))


def expanded_tokens(text: Column | str) -> Column:
    """Tokens, then the pairs of the CJK ones, distinct."""
    return let(query_tokens(text), lambda ts: F.array_distinct(F.concat(ts, F.flatten(F.transform(ts, cjk_pairs)))))


def needles(text: Column | str) -> Column:
    """Tokens each followed by its CJK pairs, distinct but for case: what lines are searched for."""
    return distinct_ignoring_case(let(query_tokens(text), lambda ts: F.flatten(F.transform(
        ts, lambda t: F.concat(F.array(t), cjk_pairs(t))))))


def index_tokens(text: Column | str) -> Column:
    """Tokens of the inverted index: runs of letters and digits, lower-cased, accents folded."""
    return F.regexp_extract_all(fold_accents(F.lower(F.coalesce(col(text), F.lit("")))), F.lit(r"[\p{L}\p{N}\p{Co}]+"), F.lit(0))


def _foldings() -> tuple[str, str]:
    """Characters and what they fold to, by Unicode's decompositions: a Latin letter with one mark is its base letter, a letter with a form
    of its own (final sigma, long s) is its plain form; the marks that such Latin letters have, standing alone, are dropped."""
    letters, plain, marks = [], [], set()
    for c in map(chr, range(0x80, 0x2000)):
        parts = unicodedata.normalize("NFD", c)
        base = parts[0].casefold()
        if len(parts) == 2 and base.isascii() and base.isalpha():
            marks.add(parts[1])
            if c.islower():
                letters.append(c)
                plain.append(base)
        elif c.islower() and len(c.casefold()) == 1 and c.casefold() != c and c.casefold() < "\u1000":
            letters.append(c)
            plain.append(c.casefold())
    return "".join(letters + sorted(marks)), "".join(plain)


FOLDED_FROM, FOLDED_TO = _foldings()


def fold_accents(text: Column) -> Column:
    """Lower-case text without the accents of Latin letters, composed or not; letters with two marks stay."""
    return F.translate(text, FOLDED_FROM, FOLDED_TO)


def lines(text: Column | str) -> Column:
    """The lines of a text; no last empty one."""
    parts = F.split(F.coalesce(col(text), F.lit("")), LINE_ENDS)
    return let(parts, lambda p: F.when(F.element_at(p, -1) == "", F.slice(p, F.lit(1), F.size(p) - 1)).otherwise(p))


def strip(text: Column | str) -> Column:
    return F.regexp_replace(col(text), f"^{BLANK}+|{BLANK}+$", "")


def collapse(text: Column | str) -> Column:
    """Runs of white space as one blank, none at the ends."""
    return F.btrim(F.regexp_replace(col(text), f"{BLANK}+", " "), F.lit(" "))


def stem(path: Column | str) -> Column:
    name = F.element_at(F.split(col(path), "/"), -1)
    return F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")


def suffix(path: Column | str) -> Column:
    """The last extension, lower-cased, with its dot; empty without one."""
    return F.lower(F.regexp_extract(col(path), r"[^/](\.[^./]+)$", 1))


def extract_title(text: Column | str, path: Column | str) -> Column:
    """The first line that starts with '# ', without it; else the path's stem."""
    heads = F.filter(lines(text), lambda x: F.startswith(x, F.lit("# ")))
    return let(heads, lambda h: F.when(F.size(h) > 0, strip(F.substring(F.get(h, F.lit(0)), F.lit(3), F.lit(2147483647)))).otherwise(stem(path)))


def has_heading(text: Column | str) -> Column:
    return col(text).rlike(r"(?m)^#\s+\S+")


def ensure_title(text: Column | str, title: Column | str, origin: Column | str) -> Column:
    """A heading in front of texts of tools that have none."""
    return F.when((col(origin) == "tool") & ~has_heading(text), F.concat(F.lit("# "), col(title), F.lit("\n\n"), F.regexp_replace(
        col(text), f"^{BLANK}+", ""))).otherwise(col(text))


def markdown_errors(text: Column | str) -> Column:
    t = col(text)
    return F.array_compact(F.array(
        F.when(strip(t) == "", "nothing but white space"), F.when(F.contains(t, F.lit("\ufffd")), "has undecodable characters (U+FFFD)"),
        F.when(F.contains(t, F.lit("\x00")), "has NUL characters")))


def repeated_runs(text: Column | str) -> Column:
    """Runs of three or more of a character within a line."""
    return F.regexp_count(col(text), F.lit(r"(.)\1{2,}"))


def markdown_warnings(text: Column | str) -> Column:
    t = col(text)
    runs = repeated_runs(t)
    return F.array_compact(F.array(
        F.when(~has_heading(t), "lacks a first-level heading"), F.when(F.length(strip(t)) < 80, "shorter than 80 characters"),
        F.when(runs > 0, F.concat(F.lit("repeats a character three times or more: "), runs.cast("string")))))


def is_title_line(stripped: Column) -> Column:
    """Headings, rules of three or more - or =, and lines that are bold as a whole."""
    bold = lambda w: (
        F.startswith(stripped, F.lit(w)) & F.endswith(stripped, F.lit(w)) & (F.length(stripped) > 4)
        & ~F.contains(F.substring(stripped, F.lit(3), F.length(stripped) - 4), F.lit(w)))
    return F.startswith(stripped, F.lit("#")) | stripped.rlike("^(-{3,}|={3,})$") | bold("**") | bold("__")


def window(text: Column, at: Column, size: Column, before: int, after: int) -> Column:
    """The part of text around position `at` (from 1), with dots where it is cut."""
    start = F.greatest(F.lit(0), at - 1 - before)
    end = F.least(F.length(text), at - 1 + size + after)
    return F.concat(
        F.when(start > 0, "...").otherwise(""), strip(F.substring(text, start + 1, end - start)),
        F.when(end < F.length(text), "...").otherwise(""))


def longest(tokens: Column) -> Column:
    """The longest token, the first of them; null without any."""
    return let(F.array_max(F.transform(tokens, F.length)), lambda n: F.get(F.filter(tokens, lambda t: F.length(t) == n), F.lit(0)))


def snippet_window(text: Column | str, anchor: Column, width: int = 80) -> Column:
    """Around the first occurrence of anchor, or the first 2 * width characters."""
    flat = F.translate(col(text), "\r\n", "  ")
    half = width // 2
    return F.when(F.instr(flat, anchor) > 0, window(flat, F.instr(flat, anchor), F.length(anchor), half, half)).otherwise(
        strip(F.substring(flat, 1, 2 * width)))


def earliest_snippet(text: Column | str, tokens: Column, each_side: int = 40) -> Column:
    """Around the token that comes first, whatever its case; else the first 2 * each_side characters."""
    low = F.lower(col(text))
    places = F.filter(F.transform(tokens, lambda t, i: F.struct(
        F.instr(low, F.lower(t)).alias("at"), i.alias("i"), F.length(t).alias("n"))), lambda p: p["at"] > 0)
    best = F.array_min(places)
    at, n = best["at"], best["n"]
    start = F.greatest(F.lit(0), at - 1 - each_side)
    end = F.least(F.length(col(text)), at - 1 + n + each_side)
    return F.when(best.isNull(), strip(F.substring(col(text), 1, 2 * each_side))).otherwise(
        strip(F.replace(F.substring(col(text), start + 1, end - start), F.lit("\n"), F.lit(" "))))


def message_snippet(text: Column | str, tokens: Column, each_side: int = 30) -> Column:
    """each_side characters before and behind the place of the token that comes first, whatever its case, with dots where the text
    goes on; without one the first 2 * each_side."""
    t = col(text)
    first = F.array_min(F.filter(F.transform(tokens, lambda x: F.instr(F.lower(t), F.lower(x))), lambda at: at > 0)) - 1

    def shown(start: Column, end: Column) -> Column:
        dots = lambda cut: F.when(cut, "...").otherwise("")
        return F.concat(dots(start > 0), F.substring(t, start + 1, end - start), dots(end < F.length(t)))

    return F.when(first.isNull(), shown(F.lit(0), F.least(F.length(t), F.lit(2 * each_side)))).otherwise(
        shown(F.greatest(F.lit(0), first - each_side), F.least(F.length(t), first + each_side)))


def line_snippet(line: Column, wanted: Column, width: int = 120) -> Column:
    """A line with its white space collapsed, around the longest needle it holds."""
    return let(collapse(line), lambda flat: let(longest(F.filter(wanted, lambda n: F.contains(flat, n))), lambda a: F.when(
        a.isNull(), F.substring(flat, 1, width)).otherwise(window(flat, F.instr(flat, a), F.length(a), width // 3, width // 2))))


def session_title(question: Column | str, size: int = 20, default: str = "New session") -> Column:
    return let(collapse(F.coalesce(col(question), F.lit(""))), lambda t: F.when(t == "", default).otherwise(F.substring(t, 1, size)))


def distinctive_terms(text: Column | str) -> Column:
    """Numbers and CJK runs of four or more."""
    t = F.coalesce(col(text), F.lit(""))
    return F.array_union(F.regexp_extract_all(t, F.lit(r"[0-9]+(?:\.[0-9]+)?"), F.lit(0)), F.regexp_extract_all(t, F.lit(r"[\u4e00-\u9fff]{4,}"), F.lit(0)))


def knowledge_paths(text: Column | str) -> Column:
    """Distinct members/….md paths in free text or JSON."""
    plain = F.replace(F.coalesce(col(text), F.lit("")), F.lit("\\/"), F.lit("/"))
    return F.array_distinct(F.regexp_extract_all(plain, F.lit(r"members/[^\s\"'<>|\\]+?\.md"), F.lit(0)))


def highlight_anchors(snippet: Column | str) -> Column:
    """Up to three longest distinct runs of CJK (two or more) or word characters (four or more), longest first."""
    runs = F.array_distinct(F.regexp_extract_all(F.coalesce(col(snippet), F.lit("")), F.lit(r"[\u4e00-\u9fff]{2,}|[0-9A-Za-z_]{4,}"), F.lit(0)))
    ranked = F.sort_array(F.transform(runs, lambda t, i: F.struct((-F.length(t)).alias("n"), i.alias("i"), t.alias("t"))))
    return F.slice(F.transform(ranked, lambda r: r["t"]), 1, 3)


def image_targets(text: Column | str) -> Column:
    return F.regexp_extract_all(F.coalesce(col(text), F.lit("")), F.lit(r"!\[[^\]]*\]\(([^)\s]+)\)"), F.lit(1))
