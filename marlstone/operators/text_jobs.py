"""Corpus-wide text jobs: credentials, HTML tables, table parts, asset links, contracts."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions import text as T

#: rule -> pattern of credentials. Own rules; matched values are never shown.
CREDENTIAL_RULES = {
    "secret_key": r"\bsk-[A-Za-z0-9_\-]{20,}",
    "bearer_token": r"(?i)\bbearer\s+[A-Za-z0-9._\-]{20,}",
    "assigned_secret": r"""(?i)\b(?:api[_-]?key|token|secret|password)["']?\s*[:=]\s*["'][0-9A-Za-z_\-]{16,}["']""",
    "private_key": r"-----BEGIN [A-Z ]*PRIVATE KEY-----",
}


def scan_credentials(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with credentials (rule and count, no values), summary and ok."""
    counts = F.filter(F.array(*[F.struct(F.lit(k).alias("rule"), F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(p)).alias("n")) for k, p in CREDENTIAL_RULES.items()]), lambda x: x["n"] > 0)
    out = docs.select("*", F.explode(F.array(counts)).alias("credentials"))
    summary = F.array_join(F.transform("credentials", lambda x: F.concat(x["rule"], F.lit(" x"), x["n"].cast("string"))), ", ")
    return out.withColumns({"summary": summary, "ok": F.size("credentials") == 0})


_TABLE_EDGE = re.compile(r"<(/?)table\b", re.I)


class _Cells(HTMLParser):
    """What the cells of a table say, row by row; markup inside a cell is dropped, a break becomes a blank."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.rows: list[list[str]] = []
        self.cell: list[str] | None = None

    def handle_starttag(self, tag, attrs):
        if tag == "tr":
            self.close_cell()
            self.rows.append([])
        elif tag in ("td", "th"):
            self.close_cell()
            self.cell = []
        elif tag == "br" and self.cell is not None:
            self.cell.append(" ")

    def handle_endtag(self, tag):
        if tag in ("td", "th", "tr", "table"):
            self.close_cell()

    def handle_data(self, data):
        if self.cell is not None:
            self.cell.append(data)

    def close_cell(self):
        if self.cell is not None:
            said = " ".join("".join(self.cell).split()).replace("|", "\\|")
            if not self.rows:
                self.rows.append([])
            self.rows[-1].append(said)
            self.cell = None


def pipe_table(block: str) -> str:
    """One HTML table as a pipe table; a block without cells stays."""
    reader = _Cells()
    reader.feed(block)
    reader.close()
    rows = list(filter(None, reader.rows))
    if not rows:
        return block
    width = max(map(len, rows))
    rows.insert(1, ["---"] * width)
    return "\n".join("".join(f"| {cell} " for cell in [*r, *[""] * (width - len(r))]) + "|" for r in rows)


def with_pipe_tables(text: str) -> str:
    """A text with each of its tables, up to the first end tag behind its beginning, as a pipe table."""
    out, done, begin = [], 0, None
    for edge in _TABLE_EDGE.finditer(text):
        if not edge[1]:
            begin = edge.start() if begin is None else begin
        elif begin is not None and (end := text.find(">", edge.end()) + 1):
            out += [text[done:begin], pipe_table(text[begin:end])]
            done, begin = end, None
    return "".join([*out, text[done:]])


def _normalized(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: with_pipe_tables(t) if t else t)


def normalize_html_tables(text: Column | str) -> Column:
    """Every HTML table in a text as a pipe table; texts without one do not reach Python."""
    t = T.col(text)
    has = F.contains(F.lower(t), F.lit("<table"))
    return F.when(has, F.pandas_udf(_normalized, "string")(F.when(has, t))).otherwise(t)


def table_to_markdown_parts(rows: DataFrame, part_rows: int = 5000) -> DataFrame:
    """sheet, part, name and content from rows(sheet, row, cells), row 1 being the header: pipe tables of at most part_rows rows."""
    clean = F.transform("cells", lambda c: T.collapse(F.replace(F.coalesce(c, F.lit("")), F.lit("|"), F.lit("\\|"))))
    header = rows.where("row = 1").select("sheet", F.transform(clean, lambda c, i: F.when(c == "", F.concat(F.lit("Column"), (i + 1).cast("string"))).otherwise(c)).alias("_h"))
    body = rows.where("row > 1").select("sheet", "row", clean.alias("_c")).withColumn("part", F.floor((F.col("row") - 2) / part_rows) + 1)
    line = lambda c: F.concat(F.lit("| "), F.array_join(c, " | "), F.lit(" |"))
    parts = body.groupBy("sheet", "part").agg(F.sort_array(F.collect_list(F.struct("row", line(F.col("_c")).alias("l")))).alias("_rows"))
    dashes = line(F.transform("_h", lambda c: F.lit("---")))
    name = F.concat("sheet", F.when(F.col("part") > 1, F.concat(F.lit("-"), F.lpad(F.col("part").cast("string"), 3, "0"))).otherwise(""), F.lit(".md"))
    return parts.join(header, "sheet").select("sheet", "part", name.alias("name"), F.size("_rows").alias("n_rows"), F.array_join(
        F.concat(F.array(line(F.col("_h")), dashes), F.col("_rows.l")), "\n").alias("content"))


def table_index(parts: DataFrame, book: Column | str, folder: str = "sheets") -> DataFrame:
    """book, n_sheets, n_rows, n_files and content of the index page over the parts of table_to_markdown_parts, which say their book: a line for each
    sheet, in order of their names, with the file of its first part."""
    sheets = parts.groupBy(T.col(book).alias("book"), "sheet").agg(F.min_by("name", "part").alias("_first"), F.sum("n_rows").alias("_rows"), F.count("*").alias("_files"))
    line = F.concat(F.lit("- ["), "sheet", F.lit(f"]({folder}/"), "_first", F.lit("): "), F.col("_rows").cast("string"), F.lit(" rows, "), F.col("_files").cast("string"), F.lit(" files"))
    pages = sheets.groupBy("book").agg(
        F.count("*").alias("n_sheets"), F.sum("_rows").alias("n_rows"), F.sum("_files").alias("n_files"), F.sort_array(F.collect_list(F.struct("sheet", line.alias("l")))).alias("_lines"))
    page = F.concat(F.lit("# "), "book", F.lit("\n\n## Sheets\n\n"), F.array_join("_lines.l", "\n"), F.lit("\n"))
    return pages.select("book", "n_sheets", "n_rows", "n_files", page.alias("content"))


def provenance(**said: Column | str) -> Column:
    """A Markdown comment that says where a text comes from, in front of it; no value ends the comment."""
    shown = [F.concat(F.lit(f"{name}="), F.replace(F.coalesce(T.col(value).cast("string"), F.lit("")), F.lit("-->"), F.lit("-- >"))) for name, value in said.items()]
    return F.concat(F.lit("<!-- "), F.concat_ws(" | ", *shown), F.lit(" -->\n\n"))


def explode_lines(docs: DataFrame, text: str = "content") -> DataFrame:
    """docs' path with line (from 1) and body."""
    return docs.select("path", F.posexplode(T.lines(text)).alias("_i", "body")).select("path", (F.col("_i") + 1).alias("line"), "body")


def read_document(docs: DataFrame, offset: int = 0, limit: int = 200) -> DataFrame:
    """path, title, content (a page of lines), offset, returned_lines, total_lines and truncated."""
    if offset < 0 or limit < 1:
        raise ValueError("offset must not be negative and limit at least 1")
    cut = docs.select("path", T.extract_title("content", "path").alias("title"), F.explode(F.array(T.lines("content"))).alias("_l"))
    page = F.slice("_l", offset + 1, limit)
    return cut.select("path", "title", F.array_join(page, "\n").alias("content"), F.lit(offset).alias("offset"), F.size(page).alias("returned_lines"),
                      F.size("_l").alias("total_lines"), (offset + F.size(page) < F.size("_l")).alias("truncated"))


def display_document(docs: DataFrame, offset: int = 0, limit: int = 200) -> DataFrame:
    """As read_document, the lines being those after tables are normalised."""
    title = docs.select("path", T.extract_title("content", "path").alias("_t"))
    return read_document(docs.withColumn("content", normalize_html_tables("content")), offset, limit).join(title, "path").withColumn("title", F.col("_t")).drop("_t")


def safe_names(nodes: DataFrame) -> DataFrame:
    """nodes(rel, seq, title, token) with a file name; later ones of a name in a folder get their token's beginning."""
    safe = F.regexp_replace("title", r'[\\/:*?"<>|\x00-\x1f]', "_")
    w = Window.partitionBy("rel", "_safe").orderBy("seq")
    again = F.row_number().over(w) > 1
    return nodes.withColumn("_safe", safe).withColumn("name", F.when(again, F.concat("_safe", F.lit("-"), F.substring("token", 1, 6))).otherwise(F.col("_safe"))).drop("_safe")


def image_references(docs: DataFrame, files: DataFrame) -> DataFrame:
    """path and broken: local image references of each document that no file of files(path) answers."""
    refs = docs.select("path", F.explode(T.image_targets("content")).alias("ref")).where(~F.col("ref").rlike("^(https?://|data:)"))
    full = refs.withColumn("_file", F.concat(F.regexp_replace("path", "/[^/]*$", "/"), "ref"))
    broken = full.join(files.select(F.col("path").alias("_file")), "_file", "left_anti").groupBy("path").agg(F.count("*").alias("broken"))
    return docs.select("path").join(broken, "path", "left").select("path", F.coalesce("broken", F.lit(0)).alias("broken"))


def classify_images(refs: DataFrame) -> DataFrame:
    """refs(path, ref) with kind (asset, external, unavailable) and the asset's path below the root."""
    joined = F.concat(F.regexp_replace("path", "/?[^/]*$", "/"), "ref")
    fold = F.aggregate(F.split(joined, "/"), F.array().cast("array<string>"), lambda a, x: F.when(x.isin("", "."), a).when(
        x == "..", F.when(F.size(a) > 0, F.slice(a, F.lit(1), F.greatest(F.lit(0), F.size(a) - 1))).otherwise(F.array(F.lit("<out>")))).otherwise(F.concat(a, F.array(x))))
    asset = F.array_join(fold, "/")
    kind = F.when(F.col("ref").rlike("(?i)^https?://"), "external").when(
        (F.col("ref") == "") | F.col("ref").rlike(r"^([A-Za-z]:|[/\\]|[a-z]+:)") | F.contains(asset, F.lit("<out>")), "unavailable").otherwise("asset")
    return refs.withColumn("kind", kind).withColumn("asset", F.when(F.col("kind") == "asset", asset))


def rewrite_assets(docs: DataFrame, assets: DataFrame, header: Column | None = None) -> DataFrame:
    """docs(path, content) with links to …/file/<token> replaced by the local names of assets(token, name), and how many were; a header over
    columns of docs, such as provenance(…), is put in front."""
    found = docs.select("path", F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(r"\(([^)\s]*/file/[0-9A-Za-z]+)\)"), F.lit(1)))).alias("url"))
    known = found.withColumn("token", F.regexp_extract("url", "/file/([0-9A-Za-z]+)$", 1)).join(assets, "token").groupBy("path").agg(
        F.sort_array(F.collect_list(F.struct("url", "name"))).alias("_a"))
    done = F.aggregate("_a", F.col("content"), lambda t, x: F.replace(t, F.concat(F.lit("("), x["url"], F.lit(")")), F.concat(F.lit("("), x["name"], F.lit(")"))))
    text = F.coalesce(done, "content")
    return docs.join(known, "path", "left").select("path", (text if header is None else F.concat(header, text)).alias("content"), F.coalesce(F.size("_a"), F.lit(0)).alias("images"))


def validate_contract(rows: DataFrame, required: list[str], hashes: list[str] = (), key: str = "path") -> DataFrame:
    """key, column, problem: values that are missing or empty, and hashes that are not 64 hexadecimal digits."""
    checks = [F.when(F.coalesce(F.col(c).cast("string"), F.lit("")) == "", F.struct(F.lit(c).alias("column"), F.lit("missing").alias("problem"))) for c in required]
    checks += [F.when(~F.coalesce(F.col(c), F.lit("")).rlike("^[0-9a-f]{64}$"), F.struct(F.lit(c).alias("column"), F.lit("not a sha256").alias("problem"))) for c in hashes]
    return rows.select(key, F.explode(F.array_compact(F.array(*checks))).alias("_p")).select(key, "_p.column", "_p.problem")


def convert_with(files: DataFrame, convert, schema: str = "path string, content string, error string") -> DataFrame:
    """Apply a user's function from bytes to Markdown to files(path, content); an exception becomes the row's error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for path, raw in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    out.append((path, convert(path, bytes(raw)), None))
                except Exception as e:  # the row takes the failure lane
                    out.append((path, None, f"{type(e).__name__}: {e}"[:400]))
            yield pd.DataFrame(out, columns=["path", "content", "error"])

    return files.select("path", "content").mapInPandas(run, schema)
