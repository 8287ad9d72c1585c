"""Queries over the search operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from marlstone.functions import text as T
from marlstone.operators import search as S
from marlstone.plans import views as V
from marlstone.registered.base import Registry, lines_sql
from marlstone.session import shared_dir

query = Registry()
QUERIES, ORACLES = query.queries, query.oracles


QTOK = r"""list_filter(regexp_extract_all(coalesce(text, ''), '[0-9A-Za-z_\-\.]+|[\x{4e00}-\x{9fff}]{2,}'), lambda t: len(t) >= 2)"""
_PH = rf"""
qt as (select query_id, {QTOK} as ts from v_queries),
qu as (select query_id, t, i from (select query_id, unnest(ts) as t, unnest(range(1, len(ts) + 1)) as i from qt)),
qd as (select query_id, t, i from qu a where not exists (select 1 from qu b where b.query_id = a.query_id and lower(b.t) = lower(a.t) and b.i < a.i)),
phrases as (select query_id, i as phrase, regexp_extract_all(strip_accents(lower(t)), '[\p{{L}}\p{{N}}]+') as pieces from qd),
ph as (select * from phrases where len(pieces) > 0),
fields as (
  select path, 8.0 as w, regexp_extract_all(strip_accents(lower(title)), '[\p{{L}}\p{{N}}]+') as ts from v_documents
  union all select path, 3.0, regexp_extract_all(strip_accents(lower(content)), '[\p{{L}}\p{{N}}]+') from v_documents),
lengths as (select path, sum(len(ts)) as n_tokens from fields group by path),
corpus as (select count(*) as n_docs, avg(n_tokens) as avg_tokens from lengths),
flat as (select path, w, ts, unnest(ts) as token, unnest(range(1, len(ts) + 1)) as pos from fields),
dp as (select distinct pieces from ph),
hits as (select pieces, path, sum(w) as f from flat join dp on token = pieces[1] where ts[pos : pos + len(pieces) - 1] = pieces group by pieces, path),
df as (select pieces, count(*) as df from hits group by pieces),
sc as (
  select pieces, path, greatest(ln((n_docs - df + 0.5) / (df + 0.5)), 1e-6) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * n_tokens / avg_tokens)) as s
  from hits join df using (pieces) join lengths using (path), corpus),
scored as (
  select query_id, path, round(sum(s), 9) as score, count(distinct phrase) as n from ph join sc using (pieces) group by query_id, path),
sizes as (select query_id, count(*) as n_all from ph group by query_id)"""
_TOKENS = r"""
tk as (select distinct query_id, lower(t) as token from qd)"""
_PATHS = r"""
phit as (select path, token from v_documents join (select distinct token from tk) on contains(lower(path), token)),
pdf as (select token, count(*) as df from phit group by token),
pscore as (select query_id, path, round(sum(1.0::double / df), 9) as score from tk join phit using (token) join pdf using (token) group by query_id, path)"""


def _top(src: str, limit: int, extra: str = "") -> str:
    return f"""select query_id, path, score, rank from (select query_id, path, score, row_number() over (partition by query_id order by score desc, path) as rank
  from {src} {extra}) where rank <= {limit}"""


#: The stored index of each data folder and the kinds that it has, by application and the time at which its documents were written.
_built: dict[tuple, tuple[str, tuple[str, ...]]] = {}


def stored(spark, d, *kinds):
    """The index of the documents with these kinds, stored in the shared folder: each kind is built once for all queries of an application and then read by folders."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{d}/documents.parquet")
    written = path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).getModificationTime()
    known = (spark.sparkContext.applicationId, str(d), written)
    if known not in _built:
        out = shared_dir(spark)
        S.Index(V.documents(spark, d)).store(out, kinds)
        _built[known] = out, kinds
    out, had = _built[known]
    index = S.StoredIndex(spark, out, kinds=had)
    for kind in set(kinds) - set(had):
        index = index.supply(V.documents(spark, d), kind)
        _built[known] = out, index.kinds
    return index


def expected(spark, d):
    """query_id and path: the documents that hold the words of a benchmark item in a row, by the stored tokens, for one item of each text; those items
    (query_id, text); and every item's id with that of the one of its text (S.alike). Copies of an item meet the copies of a document only where a query
    gives its rows (S.for_all)."""
    asked, members = S.alike(V.queries(spark, d))
    out = shared_dir(spark)
    S.passages(stored(spark, d, "tokens"), asked).select("query_id", "path").distinct().write.parquet(out)
    return spark.read.parquet(out), asked, members


@query("search_or_bm25", f"with {_PH} {_top('scored', 10)}", "v_documents", "v_queries")
def search_or(spark, d):
    """The OR channel."""
    return S.match_any(stored(spark, d, "tokens"), V.queries(spark, d), 10).select("query_id", "path", "score", "rank")


@query("search_and_bm25", f"with {_PH} {_top('scored join sizes using (query_id)', 30, 'where n = n_all')}", "v_documents", "v_queries")
def search_and(spark, d):
    """The AND channel."""
    return S.match_all(stored(spark, d, "tokens"), V.queries(spark, d), 30).select("query_id", "path", "score", "rank")


@query("search_index_stats", f"""with {_PH} select token, count(*) as n_positions, count(distinct path) as n_docs from flat group by token""", "v_documents", "v_queries")
def index_stats(spark, d):
    """Positions and documents of each token of the index."""
    p = stored(spark, d, "postings").postings
    return p.groupBy("token").agg(F.sum(F.size("positions")).alias("n_positions"), F.countDistinct("path").alias("n_docs"))


@query("search_stored_index", f"with {_PH} {_top('scored', 10)}", "v_documents", "v_queries")
def search_stored(spark, d):
    """The OR channel over an index that began with other documents and was refreshed twice: some were not
    there yet, some had other texts, some are gone."""
    docs = V.documents(spark, d)
    n = F.col("doc_id")
    first = docs.where(n % 3 != 0).withColumn("content", F.when(n % 5 == 0, F.concat(F.lit("\ufeffolder words "), "content")).otherwise(F.col("content")))
    gone = docs.where(n % 7 == 0).withColumn("path", F.concat("path", F.lit(".old")))
    index = S.Index(first.unionByName(gone)).store(shared_dir(spark), ("tokens",)).refresh(docs.where(n % 3 != 1)).refresh(docs)
    return S.match_any(index, V.queries(spark, d), 10).select("query_id", "path", "score", "rank")


@query("search_highlight")
def highlight(spark, d):
    """Excerpts of the best three hits; tests compare them with a plain search for the best window."""
    docs, queries, index = V.documents(spark, d), V.queries(spark, d), stored(spark, d, "tokens")
    return S.highlight(index, docs, S.match_any(index, queries, 3), queries).select("query_id", "path", "rank", "excerpt")


_PATH_QUERIES = """v_queries as (
  select doc_id as query_id, source || ' d' || cast(doc_id as varchar) as text from documents where doc_id % 50 = 0)"""


@query("search_path_channel", f"with {_PATH_QUERIES}, {_PH}, {_TOKENS}, {_PATHS} {_top('pscore', 15)}", "v_documents")
def search_path(spark, d):
    """Documents by tokens of their path."""
    return S.path_channel(V.documents(spark, d), path_queries(spark, d), 15).select("query_id", "path", "score", "rank")


def path_queries(spark, d):
    docs = V.table(spark, d, "documents").where("doc_id % 50 = 0")
    return docs.select(F.col("doc_id").alias("query_id"), F.concat("source", F.lit(" d"), F.col("doc_id").cast("string")).alias("text"))


_MIXED = """v_queries as (
  select item_id as query_id, text || ' d' || cast(item_id as varchar) as text from benchmark)"""


def mixed_queries(spark, d):
    return V.queries(spark, d).withColumn("text", F.concat("text", F.lit(" d"), F.col("query_id").cast("string")))


def _hybrid(limit: int) -> str:
    cut = 3 * limit
    return f"""
chan as (
  select query_id, path, rank, 0 as channel, 3.0::double as w from ({_top('scored join sizes using (query_id)', cut, 'where n = n_all')})
  union all select query_id, path, rank, 1, 1.0 from ({_top('scored', cut)})
  union all select query_id, path, rank, 2, 2.0 from ({_top('pscore', cut)})),
fused as (select query_id, path, round(sum(w / (60 + rank)), 9) as score, min(channel) as tier from chan group by query_id, path),
hyb as (select * from (select *, row_number() over (partition by query_id order by score desc, tier, path) as rank from fused) where rank <= {limit})"""


@query("search_hybrid_rrf", f"with {_MIXED}, {_PH}, {_TOKENS}, {_PATHS}, {_hybrid(10)} select query_id, path, score, tier, rank from hyb", "v_documents")
def search_hybrid(spark, d):
    """Three channels fused."""
    return S.hybrid_search(V.documents(spark, d), mixed_queries(spark, d), 10, stored(spark, d, "tokens")).select("query_id", "path", "score", "tier", "rank")


_SUB = """
shit as (select path, token, contains(lower(content), token)::int + contains(lower(title), token)::int as n
  from v_documents join (select distinct token from tk) on contains(lower(content), token) or contains(lower(title), token)),
sscore as (select query_id, path, sum(n)::bigint as score from tk join shit using (token) group by query_id, path)"""


@query("search_substring", f"with {_PH}, {_TOKENS}, {_SUB} {_top('sscore', 20)}", "v_documents", "v_queries")
def search_substring(spark, d):
    """Containment of tokens, by the index's dictionary of runs."""
    return S.substring_search(V.documents(spark, d), V.queries(spark, d), 20, stored(spark, d, "runs")).select("query_id", "path", "score", "rank")


def knowledge_sql(limit: int) -> str:
    """Common tables up to `found`: the combined search for v_queries over v_documents."""
    return f"""{_PH}, {_TOKENS}, {_PATHS}, {_hybrid(3 * limit)}, {_SUB},
short as (select query_id from (select distinct query_id from v_queries) where query_id not in (select query_id from hyb group by query_id having count(*) >= {limit})),
allhits as (
  select query_id, path, rank as r, 0 as b from hyb
  union all select query_id, path, rank, 1 from ({_top('sscore', 4 * limit, 'where query_id in (select query_id from short)')})),
firsts as (select query_id, path, min(struct_pack(b := b, r := r)) as f from allhits group by query_id, path),
found as (select query_id, path, rank, case f.b when 0 then 'fts' else 'substring' end as matched_by
  from (select *, row_number() over (partition by query_id order by f, path) as rank from firsts) where rank <= {limit})"""


def snippet_sql(hits: str, tokens: str, key: str, content: str, each: int) -> str:
    """Of hits(query_id, key) the context of the token of tokens(query_id, t, i) that comes first in content."""
    return f"""
  select h.query_id, h.{key}, trim(case when b is null then substring(c, 1, {2 * each}) else replace(substring(c, greatest(0, b.at - 1 - {each}) + 1,
      least(len(c), b.at - 1 + b.n + {each}) - greatest(0, b.at - 1 - {each})), chr(10), ' ') end, ' ' || chr(9) || chr(10) || chr(13)) as snippet
  from (select h.query_id, h.{key}, any_value({content}) as c, min(struct_pack(at := instr(lower({content}), lower(t)), i := i, n := len(t))) filter (instr(lower({content}), lower(t)) > 0) as b
    from ({hits}) h left join {tokens} tk using (query_id) group by h.query_id, h.{key}) h"""


@query("search_knowledge", f"""with {_MIXED}, {knowledge_sql(5)},
hc as (select query_id, path, content from found join v_documents using (path)), sn as ({snippet_sql('select * from hc', 'qd', 'path', 'content', 40)})
select query_id, path, rank, matched_by, title, snippet from found join sn using (query_id, path) join (select path, title from v_documents) using (path)""", "v_documents")
def search_knowledge(spark, d):
    """The combined search with its substring fallback, titles and snippets."""
    return S.knowledge_search(V.documents(spark, d), mixed_queries(spark, d), 5, index=stored(spark, d, "tokens"))


#: Members whose documents are searched alone.
_MEMBERS = ("src0", "src1", "src7")


def _scoped_sql(member: str) -> str:
    docs = f"v_documents as (select * from ({V.SQL['v_documents']}) where member = '{member}')"
    return f"select '{member}' as member, * from (with {docs}, v_queries as ({V.SQL['v_queries']}), {_PH} {_top('scored', 5)})"


@query("search_member_scope", " union all ".join(_scoped_sql(m) for m in _MEMBERS))
def search_members(spark, d):
    """Searches below some members' folders, each with the statistics of its own documents, from one index."""
    index, queries = stored(spark, d, "postings"), V.queries(spark, d)
    found = [S.match_any(index.scoped(m), queries, 5).select(F.lit(m).alias("member"), "query_id", "path", "score", "rank") for m in _MEMBERS]
    return found[0].union(found[1]).union(found[2])


@query("locate_passages", r"""with it as (select query_id, regexp_extract_all(strip_accents(lower(text)), '[\p{L}\p{N}]+') as w from v_queries),
dl as (select path, unnest(l) as body, unnest(range(1, len(l) + 1))::int as line from (select path, LINES as l from v_documents)),
lt as (select path, line, regexp_extract_all(strip_accents(lower(body)), '[\p{L}\p{N}]+') as ts from dl),
fl as (select path, line, token, (row_number() over (partition by path order by line, p) - 1)::int as pos from (select path, line, unnest(ts) as token, unnest(range(1, len(ts) + 1)) as p from lt)),
dt as (select path, list(token order by pos) as ts from fl group by path),
st as (select query_id, w, path, pos as start from it join fl on token = w[1] join dt using (path) where ts[pos + 1 : pos + len(w)] = w)
select query_id, path, start, len(w)::int as n, a.line as first_line, b.line as last_line
from st join fl a using (path) join fl b using (path) where a.pos = start and b.pos = start + len(w) - 1""".replace("LINES", lines_sql("content")), "v_documents", "v_queries")
def locate_passages(spark, d):
    """Where benchmark items stand, word by word: places and lines, both from the stored index."""
    index = stored(spark, d, "tokens", "lines")
    asked, members = S.alike(V.queries(spark, d))
    return S.for_all(S.passage_lines(index, S.passages(index, asked)), members)


@query("knowledge_document_filter", """select path, member, title from v_documents
where starts_with(path, 'members/') and not (split_part(path, '/', -1) = 'README.md' and len(string_split(path, '/')) <= 3)""", "v_documents")
def knowledge_filter(spark, d):
    """What counts as knowledge."""
    return S.knowledge_documents(V.documents(spark, d)).select("path", "member", "title")


@query("list_documents_prefix", "select path, title from v_documents where starts_with(path, 'members/src1/') order by path limit 200", "v_documents")
def list_prefix(spark, d):
    """A listing with its limit."""
    return S.list_documents(V.documents(spark, d), member="src1", limit=200)


@query("query_tokens", rf"""with qt as (select query_id, {QTOK} as ts from (select doc_id as query_id, text from documents))
select query_id, t as token, i as place from (
  select query_id, t, row_number() over (partition by query_id order by i) as i from (
    select query_id, t, i, row_number() over (partition by query_id, lower(t) order by i) as k
    from (select query_id, unnest(ts) as t, unnest(range(1, len(ts) + 1)) as i from qt)) where k = 1)""")
def tokens(spark, d):
    """Tokens of whole texts."""
    docs = V.table(spark, d, "documents").select(F.col("doc_id").alias("query_id"), "text")
    return docs.select("query_id", F.posexplode(T.query_tokens("text")).alias("p", "token")).select("query_id", "token", (F.col("p") + 1).cast("long").alias("place"))


def search_entry(spark, d):
    return search_or(spark, d)
