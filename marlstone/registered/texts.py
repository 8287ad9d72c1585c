"""Queries over text functions, corpus text jobs and attribution."""

from __future__ import annotations

from pyspark.sql import functions as F

from marlstone.functions import text as T
from marlstone.operators import attribution as A
from marlstone.operators import search
from marlstone.operators import state as S
from marlstone.operators import text_jobs as J
from marlstone.plans import views as V
from marlstone.registered.base import Registry, lines_sql
from marlstone.registered.search import QTOK, expected

query = Registry()
QUERIES, ORACLES = query.queries, query.oracles

_WS = r"[ \t\n\r\x0B\f]"
_MD = "case when doc_id % 3 = 0 then '# ' || source || chr(10) || text when doc_id % 31 = 0 then '' else text end"


def md(spark, d):
    t = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("# "), "source", F.lit("\n"), "text")).when(F.col("doc_id") % 31 == 0, "").otherwise(F.col("text"))
    return V.table(spark, d, "documents").select("doc_id", t.alias("t"), F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"))


@query("inspect_markdown", rf"""select doc_id, case when regexp_replace(t, '^{_WS}+|{_WS}+$', '', 'g') = '' then 1 else 0 end as n_errors,
  (case when regexp_matches(t, '(?m)^#\s+\S+') then 0 else 1 end) + (case when len(regexp_replace(t, '^{_WS}+|{_WS}+$', '', 'g')) < 80 then 1 else 0 end) as n_warnings
from (select doc_id, {_MD} as t from documents)""")
def inspect(spark, d):
    """D3, without the count of repeated characters, which the other engine's patterns cannot say."""
    w = F.filter(T.markdown_warnings("t"), lambda x: ~F.startswith(x, F.lit("repeats ")))
    return md(spark, d).select("doc_id", F.size(T.markdown_errors("t")).alias("n_errors"), F.size(w).alias("n_warnings"))


@query("repeated_characters", r"""select doc_id, coalesce(runs, 0)::bigint as runs from documents left join (select doc_id, sum(case when c = p and c <> q and c <> chr(10) then 1 else 0 end)::bigint as runs from (
  select doc_id, c, lag(c, 2) over w = c and lag(c) over w = c as is_third, lag(c) over w as p0, case when lag(c) over w = c and lag(c, 2) over w = c then c end as p,
    case when lag(c, 1) over w = c and lag(c, 2) over w = c and lag(c, 3) over w = c then c else '' end as q
  from (select doc_id, unnest(string_split(text, '')) as c, unnest(range(1, len(text) + 1)) as i from documents) window w as (partition by doc_id order by i))
group by doc_id) using (doc_id)""")
def repeated(spark, d):
    """D3: runs of three or more of a character."""
    return V.table(spark, d, "documents").select("doc_id", T.repeated_runs(F.coalesce("text", F.lit(""))).cast("long").alias("runs"))


@query("scan_credentials", r"""select doc_id, n as found, n = 0 as ok from (select doc_id, len(regexp_extract_all(text, '(?i)\b(api[_-]?key|token|secret|password)["'']?\s*[:=]\s*["''][0-9A-Za-z_\-]{16,}["'']'))
  + len(regexp_extract_all(text, '\bsk-[A-Za-z0-9_\-]{20,}')) + len(regexp_extract_all(text, '(?i)\bbearer\s+[A-Za-z0-9._\-]{20,}')) + len(regexp_extract_all(text, '-----BEGIN [A-Z ]*PRIVATE KEY-----')) as n from documents)""")
def credentials(spark, d):
    """D4"""
    docs = J.scan_credentials(V.table(spark, d, "documents"))
    return docs.select("doc_id", F.aggregate("credentials", F.lit(0).cast("long"), lambda a, x: a + x["n"]).alias("found"), "ok")


@query("ensure_title", rf"""select doc_id, sha256(case when not regexp_matches(t, '(?m)^#\s+\S+') and doc_id % 2 = 0 then '# d' || doc_id || chr(10) || chr(10) || regexp_replace(t, '^{_WS}+', '') else t end) as sha
from (select doc_id, {_MD} as t from documents)""")
def ensure(spark, d):
    """D5, D7"""
    x = md(spark, d).withColumn("origin", F.when(F.col("doc_id") % 2 == 0, "tool").otherwise("source"))
    return x.select("doc_id", F.sha2(T.ensure_title("t", T.stem("path"), "origin"), 256).alias("sha"))


@query("extract_title", f"""select doc_id, case when len(h) > 0 then trim(h[1][3:], ' ' || chr(9)) else 'd' || doc_id end as title
from (select doc_id, list_filter({lines_sql(_MD)}, lambda l: starts_with(l, '# ')) as h from documents)""")
def title(spark, d):
    """D6"""
    return md(spark, d).select("doc_id", T.extract_title("t", "path").alias("title"))


@query("explode_lines", f"""select doc_id, line, sha256(body) as sha from (select doc_id, unnest(l) as body, unnest(range(1, len(l) + 1))::int as line from (select doc_id, {lines_sql('text')} as l from documents))""")
def lines(spark, d):
    """D12"""
    docs = V.table(spark, d, "documents").select(F.col("doc_id").alias("path"), F.col("text").alias("content"))
    return J.explode_lines(docs).select(F.col("path").alias("doc_id"), "line", F.sha2("body", 256).alias("sha"))


@query("title_lines", rf"""select count(*) as n, count(*) filter (starts_with(s, '#') or regexp_matches(s, '^(-{{3,}}|={{3,}})$')
   or (starts_with(s, '**') and ends_with(s, '**') and len(s) > 4 and not contains(s[3:-3], '**')) or (starts_with(s, '__') and ends_with(s, '__') and len(s) > 4 and not contains(s[3:-3], '__'))) as titles
from (select regexp_replace(unnest({lines_sql(_MD)}), '^{_WS}+|{_WS}+$', '', 'g') as s from documents)""")
def title_lines(spark, d):
    """D13"""
    body = md(spark, d).select(F.explode(T.lines("t")).alias("l")).select(T.strip("l").alias("s"))
    return body.agg(F.count("*").alias("n"), F.count_if(T.is_title_line(F.col("s"))).alias("titles"))


@query("read_document", f"""select path, title, array_to_string(l[6:10], chr(10)) as content, 5 as offset, len(l[6:10])::int as returned_lines, len(l)::int as total_lines, 5 + len(l[6:10]) < len(l) as truncated
from (select path, {lines_sql('content')} as l, regexp_replace(split_part(path, '/', -1), '\\.[^.]*$', '') as title from v_documents)""", "v_documents")
def read(spark, d):
    """A10"""
    return J.read_document(V.documents(spark, d), offset=5, limit=5)


_TABLE_SQL = r"""select id, content, rows, '| ' || array_to_string(list_transform(rows[1], lambda c: c), ' | ') || ' |' || chr(10) || '| --- | --- |' || chr(10)
  || array_to_string(list_transform(rows[2:], lambda r: '| ' || array_to_string(r, ' | ') || ' |'), chr(10)) as md
  from (select id, content, list_transform(regexp_extract_all(content, '<tr>(.*?)</tr>', 1), lambda r: regexp_extract_all(r, '<t[dh]>(.*?)</t[dh]>', 1)) as rows from v_html_tables)"""


@query("normalize_html_tables", f"select id, 'before' || chr(10) || md || chr(10) || 'after' as content from ({_TABLE_SQL})", "v_html_tables")
def html(spark, d):
    """D8, U4"""
    t = V.html_tables(spark, d).withColumn("content", F.concat(F.lit("before\n"), "content", F.lit("\nafter")))
    return t.select("id", J.normalize_html_tables("content").alias("content"))


@query("display_document", f"""select path, '' || id as title, array_to_string(l[2:3], chr(10)) as content, 1 as offset, 2 as returned_lines, len(l)::int as total_lines, 3 < len(l) as truncated
from (select id, 't/' || id || '.md' as path, string_split(md, chr(10)) as l from ({_TABLE_SQL}))""", "v_html_tables")
def display(spark, d):
    """A11"""
    t = V.html_tables(spark, d).select(F.concat(F.lit("t/"), F.col("id").cast("string"), F.lit(".md")).alias("path"), "content")
    return J.display_document(t, offset=1, limit=2)


@query("table_parts", """with r as (select o_custkey as sheet, row_number() over (partition by o_custkey order by o_orderkey) + 1 as row, o_orderkey, o_orderstatus from orders)
select 'r' || sheet as sheet, (row - 2) // 3 + 1 as part, 'r' || sheet || case when (row - 2) // 3 > 0 then '-' || lpad(((row - 2) // 3 + 1)::varchar, 3, '0') else '' end || '.md' as name, count(*)::int as n_rows,
  '| key | Column2 |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || o_orderkey || ' | ' || o_orderstatus || ' |', chr(10) order by row) as content from r group by sheet, (row - 2) // 3""")
def parts(spark, d):
    """The orders of each customer as a sheet."""
    from pyspark.sql import Window

    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    body = V.table(spark, d, "orders").select(F.concat(F.lit("r"), F.col("o_custkey").cast("string")).alias("sheet"), (F.row_number().over(w) + 1).alias("row"),
                                              F.array(F.col("o_orderkey").cast("string"), F.col("o_orderstatus")).alias("cells"))
    head = body.select("sheet", F.lit(1).alias("row"), F.array(F.lit("key"), F.lit(" ")).alias("cells")).distinct()
    return J.table_to_markdown_parts(head.union(body), 3)


@query("table_index", """with s as (select o_custkey, count(*) as n from orders group by 1)
select 'b' || (o_custkey // 100) as book, count(*) as n_sheets, sum(n)::bigint as n_rows, sum((n + 2) // 3)::bigint as n_files, '# b' || (o_custkey // 100) || chr(10) || chr(10) || '## Sheets' || chr(10) || chr(10) ||
  string_agg('- [r' || o_custkey || '](sheets/r' || o_custkey || '.md): ' || n || ' rows, ' || ((n + 2) // 3) || ' files', chr(10) order by 'r' || o_custkey) || chr(10) as content from s group by o_custkey // 100""")
def index_pages(spark, d):
    """The index page of a book, which holds the sheets of a hundred customers."""
    number = F.floor(F.substring("sheet", 2, 20).cast("long") / 100).cast("string")
    return J.table_index(parts(spark, d), F.concat(F.lit("b"), number))


_FLAT = "translate(text, chr(13) || chr(10), '  ')"
_STRIP = "trim(({0}), ' ' || chr(9) || chr(10) || chr(13))"


@query("snippet_window", f"""select doc_id, case when pos > 0 then (case when pos - 41 > 0 then '...' else '' end) || {_STRIP.format("substring(f, greatest(0, pos - 41) + 1, least(len(f), pos - 1 + len(a) + 40) - greatest(0, pos - 41))")}
   || (case when least(len(f), pos - 1 + len(a) + 40) < len(f) then '...' else '' end) else {_STRIP.format('substring(f, 1, 160)')} end as snippet
from (select doc_id, f, a, instr(f, a) as pos from (select doc_id, {_FLAT} as f, case when doc_id % 2 = 0 then coalesce(nullif(split_part({_FLAT}, ' ', 30), ''), 'zzzz') else 'zzzz' end as a from documents))""")
def snippet(spark, d):
    """D10"""
    flat = F.translate("text", "\r\n", "  ")
    x = V.table(spark, d, "documents").withColumn("a", F.when(F.col("doc_id") % 2 == 0, F.coalesce(F.nullif(F.split_part(flat, F.lit(" "), F.lit(30)), F.lit("")), F.lit("zzzz"))).otherwise("zzzz"))
    return x.select("doc_id", T.snippet_window("text", F.col("a")).alias("snippet"))


@query("session_titles", r"""select conv_id, turn, case when t = '' then 'New session' else substring(t, 1, 20) end as title from (
  select conv_id, turn, trim(regexp_replace(coalesce(text, ''), '[ \t\n\r\x0B\f]+', ' ', 'g'), ' ') as t from conversations)""")
def titles(spark, d):
    """D16"""
    return V.table(spark, d, "conversations").select("conv_id", "turn", T.session_title("text").alias("title"))


@query("distinctive_terms", r"""select page_id, len(list_distinct(regexp_extract_all(html, '[0-9]+(?:\.[0-9]+)?'))) as n_terms from pages""")
def terms(spark, d):
    """D18"""
    return V.table(spark, d, "pages").select("page_id", F.size(T.distinctive_terms("html")).cast("long").alias("n_terms"))


@query("knowledge_paths", """select doc_id, count(distinct p) as n, min(p) as first_path from (select doc_id, unnest(['members/' || source || '/d' || doc_id || '.md', 'members/a/b.md', 'members/a/b.md']) as p from documents) group by doc_id""")
def paths(spark, d):
    """D19"""
    x = V.table(spark, d, "documents").select("doc_id", F.concat(
        F.lit('see "members\\/'), "source", F.lit("\\/d"), F.col("doc_id").cast("string"), F.lit('.md", members/a/b.md and '), F.lit("members/a/b.md, but not other/x.md")).alias("t"))
    return x.select("doc_id", T.knowledge_paths("t").alias("p")).select("doc_id", F.size("p").cast("long").alias("n"), F.array_min("p").alias("first_path"))


@query("highlight_anchors", r"""with r as (select doc_id, t, min(i) as i from (select doc_id, unnest(x) as t, unnest(range(1, len(x) + 1)) as i from (
  select doc_id, regexp_extract_all(text, '[\x{4e00}-\x{9fff}]{2,}|[0-9A-Za-z_]{4,}') as x from documents)) group by doc_id, t)
select doc_id, coalesce(anchors, '') as anchors from documents left join (
  select doc_id, string_agg(t, '|' order by k) as anchors from (select doc_id, t, row_number() over (partition by doc_id order by -len(t), i) as k from r) where k <= 3 group by doc_id) using (doc_id)""")
def anchors(spark, d):
    """D22, of whole texts"""
    return V.table(spark, d, "documents").select("doc_id", F.array_join(T.highlight_anchors("text"), "|").alias("anchors"))


_REF = "case doc_id % 6 when 0 then 'images/a' || doc_id || '.png' when 1 then '../up.png' when 2 then 'https://h/x.png' when 3 then 'C:/x.png' when 4 then '../../../../x.png' else '/abs.png' end"


def refs(spark, d):
    n = F.col("doc_id") % 6
    s = F.col("doc_id").cast("string")
    ref = F.when(n == 0, F.concat(F.lit("images/a"), s, F.lit(".png"))).when(n == 1, "../up.png").when(n == 2, "https://h/x.png").when(n == 3, "C:/x.png").when(n == 4, "../../../../x.png").otherwise("/abs.png")
    return V.documents(spark, d).withColumn("ref", ref)


@query("classify_images", f"""select path, ref, case doc_id % 6 when 2 then 'external' when 0 then 'asset' when 1 then 'asset' else 'unavailable' end as kind,
  case doc_id % 6 when 0 then 'members/' || member || '/d' || doc_id || '/' || ref when 1 then 'members/' || member || '/up.png' end as asset from (select *, {_REF} as ref from v_documents)""", "v_documents")
def images(spark, d):
    """D23"""
    return J.classify_images(refs(spark, d).select("path", "ref"))


@query("image_references", """select path, case when doc_id % 6 in (1, 3, 4, 5) or doc_id % 12 = 6 then 1::bigint else 0 end as broken from v_documents""", "v_documents")
def broken(spark, d):
    """D21"""
    docs = refs(spark, d).withColumn("content", F.concat("content", F.lit("\n![x]("), "ref", F.lit(")")))
    files = docs.where("doc_id % 12 = 0").select(F.concat(F.regexp_replace("path", "/[^/]*$", "/"), "ref").alias("path"))
    return J.image_references(docs, files)


@query("rewrite_assets", """select path, sha256(content || ' (' || case when doc_id % 2 = 0 then 'img' || doc_id || '.png' else 'https://h/file/t' || doc_id end || ')') as sha, (doc_id % 2 = 0)::int as images from v_documents""", "v_documents")
def rewrite(spark, d):
    """D20"""
    s = F.col("doc_id").cast("string")
    docs = V.documents(spark, d)
    assets = docs.where("doc_id % 2 = 0").select(F.concat(F.lit("t"), s).alias("token"), F.concat(F.lit("img"), s, F.lit(".png")).alias("name"))
    linked = docs.select("path", F.concat("content", F.lit(" (https://h/file/t"), s, F.lit(")")).alias("content"))
    return J.rewrite_assets(linked, assets).select("path", F.sha2("content", 256).alias("sha"), "images")


@query("asset_provenance", """select path, sha256('<!-- source=wiki | title=' || replace(coalesce(title, ''), '-->', '-- >') || ' | node=n' || doc_id || ' -->' || chr(10) || chr(10) || content || ' (' || case when doc_id % 2 = 0 then 'img' || doc_id || '.png' else 'https://h/file/t' || doc_id end || ')') as sha from v_documents""", "v_documents")
def provenance(spark, d):
    """Documents with rewritten links below a header that says where they come from."""
    s = F.col("doc_id").cast("string")
    docs = V.documents(spark, d)
    assets = docs.where("doc_id % 2 = 0").select(F.concat(F.lit("t"), s).alias("token"), F.concat(F.lit("img"), s, F.lit(".png")).alias("name"))
    linked = docs.withColumn("content", F.concat("content", F.lit(" (https://h/file/t"), s, F.lit(")")))
    return J.rewrite_assets(linked, assets, J.provenance(source=F.lit("wiki"), title="title", node=F.concat(F.lit("n"), s))).select("path", F.sha2("content", 256).alias("sha"))


@query("validate_contract", """select path, 'title' as column, 'missing' as problem from v_documents where coalesce(title, '') = '' union all select path, 'sha', 'not a sha256' from v_documents where doc_id % 4 = 0""", "v_documents")
def contract(spark, d):
    """A8"""
    docs = V.documents(spark, d).withColumn("sha", F.when(F.col("doc_id") % 4 == 0, "bad").otherwise(F.sha2("content", 256)))
    return J.validate_contract(docs, ["path", "title"], ["sha"])


@query("guard_paths", """select path, case doc_id % 4 when 0 then 'outside members' when 1 then 'wrong suffix' when 2 then 'outside members' end as reason from (
  select doc_id, case doc_id % 4 when 0 then 'members/../x' || doc_id || '.md' when 1 then path || '.exe' when 2 then '/' || path else 'members/a/../' || path end as path from v_documents)""", "v_documents")
def guard(spark, d):
    """B5"""
    n = F.col("doc_id") % 4
    p = F.when(n == 0, F.concat(F.lit("members/../x"), F.col("doc_id").cast("string"), F.lit(".md"))).when(n == 1, F.concat("path", F.lit(".exe"))).when(
        n == 2, F.concat(F.lit("/"), "path")).otherwise(F.concat(F.lit("members/a/../"), "path"))
    return S.guard_paths(V.documents(spark, d).select(p.alias("path"))).select("path", "reason")


@query("safe_names", """select token, case when row_number() over (partition by rel, safe order by seq) > 1 then safe || '-' || token[:6] else safe end as name
from (select doc_id as seq, source as rel, sha256(doc_id::varchar) as token, 'a_b' || (doc_id % 100) as safe from documents)""")
def names(spark, d):
    """B12"""
    x = V.table(spark, d, "documents").select(F.col("doc_id").alias("seq"), F.col("source").alias("rel"), F.sha2(F.col("doc_id").cast("string"), 256).alias("token"),
                                              F.concat(F.lit("a/b"), (F.col("doc_id") % 100).cast("string")).alias("title"))
    return J.safe_names(x).select("token", "name")


_NEED = QTOK.replace("coalesce(text, '')", "text")
_LOCATE = rf"""nd as (select query_id, list_filter(ts, lambda t, i: list_position(list_transform(ts, lambda u: lower(u)), lower(t)) = i) as needles from (select query_id, {_NEED} as ts from v_queries)),
want as (select e.query_id, e.path, needles from v_expected e join nd using (query_id)),
ln as (select w.query_id, w.path, w.needles, unnest(l) as body, unnest(range(1, len(l) + 1))::int as line from (select want.*, {lines_sql('content')} as l from want join v_documents using (path)) w),
sc as (select *, len(list_filter(needles, lambda n: contains(body, n))) as score from ln where trim(body) <> '' and not starts_with(trim(body), '#')),
best as (select * from (select *, row_number() over (partition by query_id, path order by score desc, line) as r from sc where score > 0) where r <= 3)"""


_SNIPPET = r"""select query_id, path, line, case when a is null then substring(f, 1, 120) else (case when pos - 41 > 0 then '...' else '' end)
  || trim(substring(f, greatest(0, pos - 41) + 1, least(len(f), pos - 1 + len(a) + 60) - greatest(0, pos - 41))) || (case when least(len(f), pos - 1 + len(a) + 60) < len(f) then '...' else '' end) end as snippet
from (select *, instr(f, a) as pos from (select *, list_reduce(list_filter(needles, lambda n: contains(f, n)), lambda p, q: case when len(q) > len(p) then q else p end) as a
  from (select query_id, path, line, needles, trim(regexp_replace(body, '[ \t\n\r\x0B\f]+', ' ', 'g'), ' ') as f from best)))"""


@query("locate_hits", f"with {_LOCATE} {_SNIPPET}", "v_expected", "v_queries")
def locate(spark, d):
    """E11, H3, D14"""
    found, asked, members = expected(spark, d)
    wanted = found.join(asked.select("query_id", T.needles("text").alias("needles")), "query_id")
    return search.for_all(A.locate_hits(V.documents(spark, d), wanted).select("query_id", "path", "line", "snippet"), members)


@query("locate_sources", f"""with {_LOCATE}, sn as ({_SNIPPET}),
own as (select query_id, path, string_agg(line::varchar, ',' order by line) as lines, string_agg(snippet, chr(10) order by line) as snippets from sn group by query_id, path)
select e.query_id, e.path, case when d.title = '' then '?' else d.title end as title, lines, snippets
from v_expected e join v_documents d using (path) left join own using (query_id, path)""", "v_expected", "v_queries")
def sources(spark, d):
    """E12, C16"""
    found, asked, members = expected(spark, d)
    out = A.locate_sources(found, V.documents(spark, d), asked)
    joined = lambda f, by: F.when(F.size("hits") > 0, F.array_join(F.transform("hits", lambda h: h[f].cast("string")), by))
    return search.for_all(out.select("query_id", "path", "title", joined("line", ",").alias("lines"), joined("snippet", "\n").alias("snippets")), members)
