"""Queries over the test tables, one for each operator, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodeleaf.config import Config
from lodeleaf.functions import text as T
from lodeleaf.functions.embedding import HashingEmbedder
from lodeleaf.functions.vectors import dot, norm, usable
from lodeleaf.operators import answer, chunking, evaluate, filters, fusion, lexical, mmr, sections
from lodeleaf.plans import retrieve
from lodeleaf.plans.engine import status_of
from lodeleaf.sources import audit_log, files, store
from lodeleaf.sources.lineage import cut, spread, stored_once
from lodeleaf.streaming.incremental import event_windows

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return spread(_table(spark, d, "documents"))


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "chunks").dropDuplicates(["chunk_id"])


_FEW = 1_000_000  # repeated ids that are sent to all tasks


def _once(spark: SparkSession, d: str) -> DataFrame:
    """The chunks, each once, for searches: only ids are shuffled, and those that are repeated are sent to all tasks."""
    rows = _table(spark, d, "chunks").withColumn("_at", F.xxhash64("_metadata.file_path", "_metadata.row_index"))
    several = cut(rows.groupBy(F.col("chunk_id").alias("_id")).agg(F.count("*").alias("_n"), F.min("_at").alias("_first")).filter("_n > 1"))
    if several.count() > _FEW:
        return _chunks(spark, d)
    return rows.join(F.broadcast(several), F.col("chunk_id").eqNullSafe(F.col("_id")) & (F.col("_at") != F.col("_first")), "left_anti").drop("_at")


def _vectors(spark: SparkSession, d: str, chunks: DataFrame | None = None) -> DataFrame:
    return (_once(spark, d) if chunks is None else chunks).filter((F.col("embedder") == "hashing") & usable(F.col("vec"), F.col("dim")))


def _latest(spark: SparkSession, d: str) -> DataFrame:
    """The registry, of each document its newest row."""
    w = W.partitionBy("doc_id").orderBy(F.desc("updated_at"), F.desc_nulls_last("source_hash"))
    return _table(spark, d, "kb_documents").withColumn("n", F.row_number().over(w)).filter("n = 1").drop("n")


# Queries in words: id, text, access labels, tags.
_WORDS = [
    (1, "retention plan storage quota ticket queue", None, None),
    (2, "error code device manifest", ["public"], None),
    (3, "Bericht zum Vorfall Freigabe Stufe", ["team", "hr", "legal"], ["policy", "howto", "scan"]),
    (4, "审计链条 休假申请单", None, ["draft"]),
    (5, "用語集 部署 記録", ["board", "public"], []),
    (6, "nothing to see", [], None),
]
_QUERY_DDL = "query_id long, query string, acls array<string>, tags array<string>"


def _words(spark: SparkSession) -> DataFrame:
    return retrieve.prepared(spark.createDataFrame(_WORDS, _QUERY_DDL).withColumn("vec", F.array(F.lit(0.0))), Config(), None)


def _id(c: str) -> Column:
    """A number for a text id: the first 60 bits of its MD5."""
    return F.conv(F.substring(F.md5(c), 1, 15), 16, 10).cast("long")


def _fiftieth(spark: SparkSession, d: str, chunks: DataFrame | None = None) -> DataFrame:
    """The query set for searches: every chunk whose id is divisible by 50, as a query."""
    rows = _vectors(spark, d, chunks).withColumn("query_id", _id("chunk_id")).filter("text is not null and query_id % 50 = 0")
    return cut(retrieve.prepared(rows.select("query_id", F.col("text").alias("query"), "vec"), Config(history_turns=0), None))


# --- SQL shared by several oracles

_SPACE = r"\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"


def _strip_sql(c: str) -> str:
    return f"regexp_replace({c}, '^[{_SPACE}]+|[{_SPACE}]+$', '', 'g')"


def _tokens_sql(c: str) -> str:
    return (
        f"list_concat(regexp_extract_all(lower({c}), '[a-z0-9_]+'), flatten(list_transform(regexp_extract_all(lower({c}), '[{T.CJK}]+'), "
        "lambda run: list_concat(string_split(run, ''), list_transform(range(1, length(run)), lambda i: substr(run, i, 2))))))"
    )


def _sql_list(x: list[str] | None) -> str:
    return "NULL::VARCHAR[]" if x is None else "[" + ", ".join(f"'{v}'" for v in x) + "]::VARCHAR[]"


_C = "c AS (SELECT DISTINCT ON (chunk_id) * FROM chunks)"
_V = "v AS (SELECT * FROM c WHERE embedder = 'hashing' AND len(vec) = dim AND dim > 0 AND len(list_filter(vec, lambda x: isnan(x))) = 0 AND len(list_filter(vec, lambda x: x <> 0)) > 0)"
_LATEST = "latest AS (SELECT * FROM kb_documents QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY updated_at DESC, source_hash DESC NULLS LAST) = 1)"
_WORDS_SQL = "q AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{t}', {_sql_list(a)}, {_sql_list(g)})" for i, t, a, g in _WORDS) + ") AS t(query_id, query, acls, wanted))"
_SEES = "(q.acls IS NULL OR list_contains(q.acls, d.acl)) AND (q.wanted IS NULL OR len(q.wanted) = 0 OR list_has_any(d.tags, q.wanted))"


def _bm25_sql(docs: str, queries: str, sees: str) -> str:
    """CTEs up to lx(query_id, chunk_id, doc_id, seq, lex), for d = docs and q = queries."""
    return f"""
    {queries},
    qt AS (SELECT query_id, term, k FROM (SELECT query_id, unnest(list_distinct_ordered) AS term, generate_subscripts(list_distinct_ordered, 1) AS k
        FROM (SELECT query_id, list_filter(t, lambda x, i: list_position(t, x) = i) AS list_distinct_ordered FROM (SELECT query_id, {_tokens_sql("query")} AS t FROM q)))),
    d AS (SELECT chunk_id, doc_id, seq, acl, tags, vec, {_tokens_sql("coalesce(text, '')")} AS tokens, text FROM {docs}),
    seen AS (SELECT q.query_id, d.chunk_id, d.doc_id, d.seq, len(d.tokens) AS dl FROM d JOIN q ON {sees}),
    st AS (SELECT query_id, count(*) AS n, CASE WHEN coalesce(avg(dl), 0) = 0 THEN 1.0::DOUBLE ELSE avg(dl) END AS mean FROM seen GROUP BY 1),
    tf AS (SELECT chunk_id, term, count(*) AS f FROM (SELECT chunk_id, unnest(tokens) AS term FROM d) GROUP BY 1, 2),
    p AS (SELECT s.query_id, s.chunk_id, s.dl, qt.term, qt.k, tf.f FROM seen s JOIN tf ON tf.chunk_id = s.chunk_id JOIN qt ON qt.query_id = s.query_id AND qt.term = tf.term),
    df AS (SELECT query_id, term, count(*) AS df FROM p GROUP BY 1, 2),
    parts AS (SELECT p.query_id, p.chunk_id, p.k, ln(1 + (st.n - df.df + 0.5::DOUBLE) / (df.df + 0.5::DOUBLE)) * p.f * 2.5::DOUBLE / (p.f + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * greatest(p.dl, 1) / st.mean)) AS x
        FROM p JOIN df ON df.query_id = p.query_id AND df.term = p.term JOIN st ON st.query_id = p.query_id),
    s AS (SELECT query_id, chunk_id, list_reduce(list(x ORDER BY k), lambda a, b: a + b) AS lex FROM parts GROUP BY 1, 2),
    lx AS (SELECT n.query_id, n.chunk_id, n.doc_id, n.seq, coalesce(s.lex, 0.0::DOUBLE) AS lex FROM seen n LEFT JOIN s ON s.query_id = n.query_id AND s.chunk_id = n.chunk_id)"""


_FIFTIETH_SQL = "q AS (SELECT * FROM (SELECT ('0x' || substr(md5(chunk_id), 1, 15))::BIGINT AS query_id, text AS query, vec AS q_vec FROM v WHERE text IS NOT NULL) WHERE query_id % 50 = 0)"
_SCORED_SQL = f"""WITH {_C}, {_V}, {_bm25_sql("v", _FIFTIETH_SQL, "true")},
    vx AS (SELECT q.query_id, v.chunk_id, v.doc_id, v.seq, CASE WHEN len(v.vec) = len(q.q_vec) THEN list_reduce(list_transform(range(1, len(v.vec) + 1), lambda i: v.vec[i] * q.q_vec[i]), lambda a, b: a + b, 0.0::DOUBLE) END AS vec_score FROM v, q),
    rv AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY vec_score DESC NULLS LAST, doc_id, seq, chunk_id) AS vec_rank FROM vx),
    rl AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY lex DESC, doc_id, seq, chunk_id) AS lex_rank FROM lx),
    pool AS (SELECT query_id, chunk_id, rv.doc_id, rv.seq, vec_score, lex, CASE WHEN vec_rank <= 50 THEN vec_rank END AS vec_rank, CASE WHEN lex_rank <= 50 THEN lex_rank END AS lex_rank
        FROM rv JOIN rl USING (query_id, chunk_id) WHERE vec_rank <= 50 OR lex_rank <= 50),
    rrf AS (SELECT *, coalesce(1.0::DOUBLE / (60 + vec_rank), 0.0::DOUBLE) + coalesce(1.0::DOUBLE / (60 + lex_rank), 0.0::DOUBLE) AS score FROM pool),
    fused AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_rank NULLS LAST, lex_rank NULLS LAST) AS rank FROM rrf)"""


def _by_block(spark: SparkSession, d: str, f: Callable[[DataFrame, DataFrame], DataFrame], lexical_too: bool = True, chunks: DataFrame | None = None, asked: DataFrame | None = None) -> DataFrame:
    """Of each block of the query set, with all chunks.  chunks and asked: those and the query set, where the caller has them."""
    once = _once(spark, d) if chunks is None else chunks
    rows = retrieve.ready(_vectors(spark, d, once), lexical_too)
    return reduce(DataFrame.unionByName, [f(q, rows) for q in retrieve.query_blocks(_fiftieth(spark, d, once) if asked is None else asked)])


def _ranking(spark: SparkSession, d: str, config: Config | None = None, chunks: DataFrame | None = None, asked: DataFrame | None = None) -> DataFrame:
    c = config or Config()
    return _by_block(spark, d, lambda q, rows: retrieve.candidates(q, rows, c, c.top_k), True, chunks, asked)


def _r(c: str):
    return F.round(c, 6).alias(c)


# --- text and terms


@query(f"WITH {_C}, t AS (SELECT chunk_id, unnest({_tokens_sql('text')}) AS term FROM c) SELECT chunk_id, term, count(*) AS f FROM t GROUP BY 1, 2")
def tokenize_terms(spark, d):
    return lexical.term_frequencies(_chunks(spark, d), "chunk_id", "text").withColumnRenamed("id", "chunk_id")


@query(f"WITH {_C}, t AS (SELECT DISTINCT chunk_id, unnest({_tokens_sql('text')}) AS term FROM c) SELECT term, count(*) AS df FROM t GROUP BY 1")
def term_stats(spark, d):
    return lexical.document_frequencies(lexical.term_frequencies(_chunks(spark, d), "chunk_id", "text"))


@query(f"WITH {_C} SELECT count(*) AS n_docs, round(avg(len({_tokens_sql('text')})), 6) AS avg_len FROM c WHERE text IS NOT NULL")
def corpus_stats(spark, d):
    return lexical.corpus_stats(_chunks(spark, d).filter("text is not null"), "text").select("n_docs", _r("avg_len"))


@query(f"WITH {_C}, b AS (SELECT chunk_id, regexp_extract_all(lower(text), '[a-z0-9_]+') AS t FROM c WHERE text IS NOT NULL) SELECT unnest(list_transform(range(1, len(t)), lambda i: t[i] || '_' || t[i + 1])) AS bigram, count(*) AS n FROM b GROUP BY 1")
def token_bigrams(spark, d):
    words = F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9_]+"), F.lit(0))
    return _chunks(spark, d).filter("text is not null").select(F.explode(T.bigrams(words)).alias("bigram")).groupBy("bigram").agg(F.count("*").alias("n"))


@query(f"WITH {_C} SELECT chunk_id, sha256(text) AS query_sha256, length(text) AS query_len, len(list_distinct({_tokens_sql('text')})) AS query_terms FROM c WHERE text IS NOT NULL")
def query_record(spark, d):
    q = _chunks(spark, d).filter("text is not null")
    return q.select("chunk_id", F.sha2("text", 256).alias("query_sha256"), F.length("text").cast("long").alias("query_len"), F.size(F.array_distinct(T.tokenize(F.col("text")))).cast("long").alias("query_terms"))


_HISTORY = [(1, "ledger", ["a b", "c", ""], ["x", "y"]), (2, "ledger", None, None), (3, " permit ", ["one"], []), (4, "", ["alone", "two", "three"], None)]


@query("SELECT * FROM (VALUES (1, 'ledger c x y'), (2, 'ledger'), (3, 'permit  one'), (4, 'two three')) AS t(query_id, effective)")
def history_expand(spark, d):
    q = spark.createDataFrame(_HISTORY, "query_id long, query string, history array<string>, domain_terms array<string>")
    return q.select("query_id", T.expand_query(F.col("query"), F.col("history"), F.col("domain_terms"), 2).alias("effective"))


@query("SELECT doc_id, string_split(path, '/')[-1] AS name, lower(regexp_extract(path, '(\\.[^./]+)$', 1)) AS extension, lower(regexp_extract(path, '(\\.[^./]+)$', 1)) IN ('.md', '.markdown') AS markdown, sha256(path)[1:32] AS kb_id FROM documents")
def path_parts(spark, d):
    p = F.col("path")
    return _table(spark, d, "documents").select("doc_id", T.basename(p).alias("name"), T.extension(p).alias("extension"), T.is_markdown(p).alias("markdown"), T.document_id(p).alias("kb_id"))


@query("SELECT doc_id, sha256(text) AS source_hash FROM documents")
def content_sha256(spark, d):
    return _table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("source_hash"))


# --- chunking

_WINDOWS_SQL = f"""WITH d AS (SELECT doc_id, text, length(text) AS n FROM documents WHERE text IS NOT NULL AND length(text) > 0),
    i AS (SELECT doc_id, text, n, unnest(range(0, CAST(ceil(greatest(0, n - 800) / 680.0) AS BIGINT) + 1)) * 680 AS s FROM d),
    j AS (SELECT *, least(n, s + 800) AS far FROM i),
    k AS (SELECT *, far - strpos(reverse(substr(text, s + 1, far - s)), ' ') AS sp, strpos(reverse(substr(text, s + 1, far - s)), ' ') AS b FROM j),
    w AS (SELECT doc_id, s, CASE WHEN far < n AND b > 0 AND sp > s + 400 THEN sp ELSE far END AS e, text FROM k),
    x AS (SELECT doc_id, s AS start_pos, e AS end_pos, {_strip_sql("substr(text, s + 1, e - s)")} AS t FROM w),
    windows AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY start_pos) - 1 AS seq, start_pos, end_pos, t FROM x WHERE t <> '')
"""


def _plain_windows(spark, d) -> DataFrame:
    return chunking.windows(_documents(spark, d), "doc_id", "text").withColumnRenamed("id", "doc_id")


@query(_WINDOWS_SQL + "SELECT doc_id, seq, start_pos, end_pos, sha256(t) AS text_hash FROM windows")
def chunk_windows(spark, d):
    w = _plain_windows(spark, d)
    return w.select("doc_id", F.col("seq").cast("long").alias("seq"), F.col("start").cast("long").alias("start_pos"), F.col("end").cast("long").alias("end_pos"), F.sha2("text", 256).alias("text_hash"))


@query(_WINDOWS_SQL + """, g AS (SELECT *, greatest(0, start_pos - max(end_pos) OVER (PARTITION BY doc_id ORDER BY start_pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS gap FROM windows)
    SELECT doc_id, CAST(sum(CASE WHEN gap > 0 THEN 1 ELSE 0 END) AS BIGINT) AS gaps, CAST(sum(coalesce(gap, 0)) AS BIGINT) AS uncovered FROM g GROUP BY 1""")
def chunk_coverage(spark, d):
    return chunking.coverage(_plain_windows(spark, d), "doc_id").select("doc_id", "gaps", F.col("uncovered").cast("long").alias("uncovered"))


@query(_WINDOWS_SQL + "SELECT doc_id, seq, least(start_pos // 1000, greatest(0, (SELECT length(text) - 1 FROM documents x WHERE x.doc_id = windows.doc_id) // 1000)) + 1 AS page FROM windows")
def page_asof(spark, d):
    """Pages of a thousand characters."""
    docs = _table(spark, d, "documents").filter("text is not null")
    pages = F.transform(F.sequence(F.lit(0), F.floor(F.greatest(F.lit(0), F.length("text") - 1) / 1000).cast("int")), lambda k: F.struct((k + 1).cast("int").alias("page"), (k * 1000).cast("int").alias("start")))
    at = docs.select("doc_id", pages.alias("pages"))
    w = _plain_windows(spark, d).select("doc_id", "seq", "start").join(at, "doc_id")
    return w.select("doc_id", F.col("seq").cast("long").alias("seq"), chunking.page_of(F.col("pages"), F.col("start")).cast("long").alias("page"))


@query()
def markdown_windows(spark, d):
    docs = _documents(spark, d).withColumn("markdown", T.is_markdown(F.col("path")))
    return chunking.windows(docs, "doc_id", "text", 800, 120, "markdown").select(F.col("id").alias("doc_id"), "seq", "start", "end", "section", "text")


@query()
def section_paths(spark, d):
    docs = _documents(spark, d).filter(T.is_markdown(F.col("path")))
    return chunking.sections(docs, "doc_id", "text").withColumnRenamed("id", "doc_id")


_TREE_SQL = """WITH r AS (SELECT DISTINCT doc_id, ordinal_no AS o, section, start_pos AS s, end_pos AS e FROM sections WHERE coalesce(section, '') <> ''),
    tp AS (SELECT *, list_filter(list_transform(string_split(section, '>'), lambda x: trim(x)), lambda x: x <> '') AS parts FROM r),
    tl AS (SELECT *, unnest(range(1, len(parts) + 1)) AS level FROM tp),
    tn AS (SELECT doc_id, o, s, e, level, array_to_string(parts[1:level], ' > ') AS path, parts[level] AS title, CASE WHEN level > 1 THEN array_to_string(parts[1:level - 1], ' > ') END AS parent FROM tl),
    tg AS (SELECT doc_id, path, arg_min(title, o * 100 + level) AS title, min(level) AS level, arg_min(s, o * 100 + level) AS start_pos, max(e) AS end_pos, max(parent) AS parent, min(o * 100 + level) AS place FROM tn GROUP BY 1, 2),
    tree AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY place) - 1 AS ordinal FROM tg)
"""


def _tree(spark, d) -> DataFrame:
    rows = _table(spark, d, "sections").select("doc_id", "ordinal_no", "section", "start_pos", "end_pos").distinct()
    return chunking.section_tree(rows, "doc_id", "ordinal_no", "section", "start_pos", "end_pos")


@query(_TREE_SQL + "SELECT doc_id, path AS section, title, CAST(level AS INTEGER) AS level, start_pos, end_pos, parent, ordinal FROM tree")
def section_tree(spark, d):
    t = _tree(spark, d)
    return t.select(F.col("id").alias("doc_id"), "section", "title", "level", F.col("start").alias("start_pos"), F.col("end").alias("end_pos"), "parent", F.col("ordinal").cast("long").alias("ordinal"))


# --- ranking

_WORDS_BM25 = f"WITH {_C}, {_bm25_sql('c', _WORDS_SQL, _SEES)}"


def _lexical(spark, d) -> DataFrame:
    chunks = _chunks(spark, d).withColumn("vec", F.lit(None).cast("array<double>"))
    return retrieve.scored(_words(spark), retrieve.ready(chunks), 10)


@query(_WORDS_BM25 + ", r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY lex DESC, doc_id, seq, chunk_id) AS rank FROM lx) SELECT query_id, chunk_id, round(lex, 6) AS lex, rank FROM r WHERE rank <= 10")
def bm25_acl_scoped(spark, d):
    """Queries in words, each with the statistics of what it may see; zero scores take part."""
    top = fusion.top(_lexical(spark, d), "lex", "rank", 10)
    return top.select("query_id", "chunk_id", _r("lex"), F.col("rank").cast("long").alias("rank"))


@query(_SCORED_SQL + " SELECT query_id, chunk_id, round(lex, 6) AS lex, lex_rank AS rank FROM rl WHERE lex_rank <= 10")
def bm25_topk(spark, d):
    rows = _by_block(spark, d, lambda q, rows: retrieve.scored(q, rows, 10))
    return fusion.top(rows, "lex", "rank", 10).select("query_id", "chunk_id", _r("lex"), F.col("rank").cast("long").alias("rank"))


@query(_SCORED_SQL + " SELECT query_id, chunk_id, round(vec_score, 6) AS vec_score, vec_rank AS rank FROM rv WHERE vec_rank <= 10")
def vector_topk(spark, d):
    rows = _by_block(spark, d, lambda q, rows: retrieve.scored(q, rows, 10, False), False)
    return fusion.vector_only(rows, 10).select("query_id", "chunk_id", _r("vec_score"), F.col("rank").cast("long").alias("rank"))


@query("SELECT vec_id, round(sqrt(list_reduce(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE), lambda a, b: a + b)), 6) AS norm FROM embeddings")
def vector_norms(spark, d):
    return _table(spark, d, "embeddings").select("vec_id", F.round(norm(F.col("embedding")), 6).alias("norm"))


@query(_SCORED_SQL + " SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM fused")
def hybrid_rrf(spark, d):
    return _ranking(spark, d).select("query_id", "chunk_id", _r("score"), F.col("rank").cast("long").alias("rank"))


_WEIGHTED = """, m AS (SELECT *, min(vec_score) OVER w AS v0, max(vec_score) OVER w AS v1, min(lex) OVER w AS l0, max(lex) OVER w AS l1 FROM pool WINDOW w AS (PARTITION BY query_id)),
    s2 AS (SELECT *, 0.5::DOUBLE * ((vec_score - v0) / CASE WHEN v1 = v0 THEN 1.0::DOUBLE ELSE v1 - v0 END) + 0.5::DOUBLE * ((lex - l0) / CASE WHEN l1 = l0 THEN 1.0::DOUBLE ELSE l1 - l0 END) AS ws FROM m)"""


@query(_SCORED_SQL + _WEIGHTED + " SELECT query_id, chunk_id, round(ws, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY ws DESC, vec_rank NULLS LAST, lex_rank NULLS LAST) AS rank FROM s2")
def hybrid_weighted(spark, d):
    return _ranking(spark, d, Config(hybrid_mode="weighted")).select("query_id", "chunk_id", _r("score"), F.col("rank").cast("long").alias("rank"))


@query(_SCORED_SQL + " SELECT query_id, chunk_id, round(score, 6) AS score FROM fused WHERE score >= 0.02")
def min_score_filter(spark, d):
    return fusion.at_least(_ranking(spark, d), 0.02).select("query_id", "chunk_id", _r("score"))


_MMR_POOL = """WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
    s AS (SELECT e.vec_id, e.v, list_dot_product(e.v, z.v) AS score FROM e, (SELECT v FROM e WHERE vec_id = 0) z),
    p AS (SELECT *, row_number() OVER (ORDER BY score DESC, vec_id) AS rank FROM s QUALIFY rank <= 50),
    r AS (SELECT *, (score - min(score) OVER ()) / (max(score) OVER () - min(score) OVER ()) AS rel FROM p),
    a1 AS (SELECT * FROM r ORDER BY rel DESC, rank LIMIT 1),
    r2 AS (SELECT r.*, list_dot_product(r.v, a1.v) AS red FROM r, a1 WHERE r.vec_id <> a1.vec_id),
    a2 AS (SELECT * FROM r2 ORDER BY rel - 0.3 * red DESC, rank LIMIT 1),
    r3 AS (SELECT r2.* REPLACE (greatest(r2.red, list_dot_product(r2.v, a2.v)) AS red) FROM r2, a2 WHERE r2.vec_id <> a2.vec_id),
    a3 AS (SELECT * FROM r3 ORDER BY rel - 0.3 * red DESC, rank LIMIT 1)
"""


@query(_MMR_POOL + "SELECT vec_id, 1 AS final_rank FROM a1 UNION ALL SELECT vec_id, 2 FROM a2 UNION ALL SELECT vec_id, 3 FROM a3")
def mmr_topk(spark, d):
    e = _table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("vec"))
    zero = e.filter("vec_id = 0").select(F.col("vec").alias("q"))
    scored = e.join(F.broadcast(zero), how="cross").select(F.lit(0).cast("long").alias("query_id"), F.col("vec_id").cast("string").alias("chunk_id"), "vec_id", "vec", dot(F.col("vec"), F.col("q")).alias("score"))
    pool = fusion.top(scored, "score", "rank", 50, ("vec_id",))
    return mmr.mmr(pool, 0.3, 3).select(F.col("chunk_id").cast("long").alias("vec_id"), "final_rank")


@query(f"WITH {_C}, {_WORDS_SQL} SELECT q.query_id, count(*) AS n FROM c d JOIN q ON {_SEES} GROUP BY 1")
def acl_tag_filter(spark, d):
    return retrieve.pairs(_words(spark), _chunks(spark, d).select("acl", "tags")).groupBy("query_id").agg(F.count("*").alias("n"))


@query("SELECT acl, count(*) AS n FROM (SELECT DISTINCT ON (chunk_id) * FROM chunks) WHERE acl IN ('team', 'hr') AND list_has_any(tags, ['policy', 'howto']) GROUP BY 1")
def pushed_acl_filter(spark, d):
    """Labels given on the driver, which reach the scan."""
    rows = _table(spark, d, "chunks").filter(filters.visible_to(["team", "hr"], ["policy", "howto"]))
    return rows.dropDuplicates(["chunk_id"]).groupBy("acl").agg(F.count("*").alias("n"))


# --- sections

_SECTION_SQL = _TREE_SQL.replace("WITH r AS", "r0 AS").replace("FROM r)", "FROM r0)").strip().rstrip(",")
_NODES_SQL = f"""{_SCORED_SQL}, {_SECTION_SQL},
    cand AS (SELECT f.*, c.section, c.text, c.start_pos FROM fused f JOIN c USING (chunk_id)),
    leaf AS (SELECT query_id, section, max(score) AS leaf FROM cand WHERE coalesce(section, '') <> '' GROUP BY 1, 2),
    par AS (SELECT DISTINCT path AS child, parent AS up FROM tree WHERE parent IS NOT NULL),
    best AS (SELECT query_id, section, max(leaf) AS score FROM (SELECT * FROM leaf UNION ALL SELECT query_id, up, leaf FROM leaf JOIN par ON par.child = leaf.section) GROUP BY 1, 2),
    nodes AS (SELECT b.query_id, t.path AS section, t.level, b.score, row_number() OVER (PARTITION BY b.query_id ORDER BY b.score DESC, t.doc_id, t.ordinal) AS place
        FROM (SELECT DISTINCT query_id, doc_id FROM cand) s JOIN tree t ON t.doc_id = s.doc_id JOIN best b ON b.query_id = s.query_id AND b.section = t.path)"""


def _candidates(spark, d, *more: str) -> DataFrame:
    """The fused ranking with the columns that the section operators need, and more."""
    chunks = _once(spark, d)
    ranked = _ranking(spark, d, chunks=chunks).select("query_id", "chunk_id", "doc_id", "score", "rank")
    return stored_once(ranked.join(chunks.select("chunk_id", "section", *more), "chunk_id"), "candidates")


@query(_NODES_SQL + " SELECT query_id, section, CAST(level AS INTEGER) AS level, round(score, 6) AS score, place FROM nodes")
def section_scores(spark, d):
    """Every scored section, as sections.scores gives them."""
    nodes = sections.scores(_candidates(spark, d), _tree(spark, d))
    return nodes.select("query_id", "section", "level", _r("score"), F.col("place").cast("long").alias("place"))


@query(_NODES_SQL + """, sel AS (SELECT query_id, section, place FROM nodes WHERE place <= 3),
    m AS (SELECT c.query_id, c.chunk_id, c.rank, c.start_pos, c.section, min(s.place) AS place FROM cand c LEFT JOIN sel s ON s.query_id = c.query_id AND (c.section = s.section OR starts_with(c.section, s.section || ' > ')) GROUP BY ALL),
    k AS (SELECT *, coalesce(section, '') = '' OR place IS NOT NULL AS passes FROM m),
    a AS (SELECT *, max(passes::INT) OVER (PARTITION BY query_id) = 1 AND query_id IN (SELECT query_id FROM sel) AS active FROM k)
    SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN active THEN CASE WHEN coalesce(section, '') = '' OR place IS NULL THEN 1073741824 ELSE place END END NULLS FIRST, CASE WHEN active THEN start_pos END NULLS FIRST, rank) AS rank
    FROM a WHERE NOT active OR passes""")
def section_filter(spark, d):
    rows = _candidates(spark, d, "start_pos")
    chosen = sections.first_sections(sections.scores(rows, _tree(spark, d)), 3)
    return sections.keep_selected(rows, chosen).select("query_id", "chunk_id", F.col("rank").cast("long").alias("rank"))


@query(_NODES_SQL + " SELECT query_id, section, substr(arg_max(text, score * 1e6 - rank * 1e-3), 1, 200) AS snippet FROM cand WHERE coalesce(section, '') <> '' GROUP BY 1, 2")
def section_snippets(spark, d):
    return sections.snippets(_candidates(spark, d, "text"))


# --- answers and evaluation

_PICKED_SQL = f"""{_SCORED_SQL},
    cit AS (SELECT f.query_id, f.rank AS position, q.query, c.text FROM fused f JOIN c USING (chunk_id) JOIN q ON q.query_id = f.query_id WHERE f.rank <= 3),
    raw AS (SELECT *, list_filter(regexp_extract_all(text, '[^。．.!?！？\\n]*[。．.!?！？\\n]|[^。．.!?！？\\n]+$'), lambda s: {_strip_sql("s")} <> '') AS parts FROM cit),
    sent AS (SELECT query_id, position, query, unnest(CASE WHEN len(parts) > 0 THEN parts ELSE [text] END) AS sentence, unnest(range(0, greatest(len(parts), 1))) AS sentence_no FROM raw),
    ov AS (SELECT *, len(list_intersect({_tokens_sql("query")}, {_tokens_sql("sentence")})) AS overlap FROM sent),
    pk AS (SELECT *, row_number() OVER (PARTITION BY query_id, position ORDER BY overlap DESC, sentence_no) AS pick FROM ov),
    picked AS (SELECT query_id, position, pick, sentence_no, {_strip_sql("sentence")} AS sentence, overlap FROM pk WHERE pick <= 2)"""


def _citations(spark, d) -> DataFrame:
    chunks = _once(spark, d)
    q = _fiftieth(spark, d, chunks)
    top = _ranking(spark, d, chunks=chunks, asked=q).filter("rank <= 3").select("query_id", F.col("rank").alias("position"), "chunk_id")
    return top.join(chunks.select("chunk_id", "text"), "chunk_id").join(q.select("query_id", "query"), "query_id")


@query(_PICKED_SQL + " SELECT query_id, position, pick, sentence_no, sentence, overlap FROM picked WHERE sentence <> ''")
def sentence_pick(spark, d):
    p = answer.picked_sentences(_citations(spark, d))
    return p.select("query_id", F.col("position").cast("long").alias("position"), F.col("pick").cast("long").alias("pick"), F.col("sentence_no").cast("long").alias("sentence_no"), "sentence", F.col("overlap").cast("long").alias("overlap"))


@query(_PICKED_SQL + """, lines AS (SELECT query_id, position, string_agg(sentence, ' ' ORDER BY pick) || ' [' || position || ']' AS line FROM picked WHERE sentence <> '' GROUP BY 1, 2)
    SELECT query_id, string_agg(line, chr(10) ORDER BY position) AS answer FROM lines GROUP BY 1""")
def extractive_answer(spark, d):
    return answer.extractive(_citations(spark, d))


@query(f"WITH {_C}, {_LATEST} SELECT chunk_id, coalesce(title, '') || '#p' || page || ':' || start_pos || '-' || end_pos || CASE WHEN coalesce(section, '') <> '' THEN ' (' || section || ')' ELSE '' END AS location FROM c JOIN latest USING (doc_id)")
def citation_location(spark, d):
    rows = store.chunks_with_documents(_chunks(spark, d), _latest(spark, d))
    return rows.select("chunk_id", T.location(F.coalesce("title", F.lit("")), F.col("page"), F.col("start_pos"), F.col("end_pos"), F.col("section")).alias("location"))


_PATTERNS = [(1, ["retention", "quota"]), (2, ["Manifest"]), (3, ["nothing"]), (4, [""]), (5, ["BOARD/", "faq"]), (6, ["x"])]


@query(_WORDS_BM25 + f""", {_LATEST}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY lex DESC, doc_id, seq, chunk_id) AS rank FROM lx QUALIFY rank <= 10),
    pat AS (SELECT * FROM (VALUES {", ".join(f"({i}, {_sql_list(p)})" for i, p in _PATTERNS)}) AS t(query_id, pats)),
    h AS (SELECT r.query_id, min(r.rank) AS first_rank FROM r JOIN latest k USING (doc_id) JOIN pat ON pat.query_id = r.query_id WHERE len(list_filter(pats, lambda p: contains(lower(coalesce(k.path, '') || ' ' || coalesce(k.title, '')), lower(p)))) > 0 GROUP BY 1),
    a AS (SELECT pat.query_id, h.first_rank FROM pat LEFT JOIN h ON h.query_id = pat.query_id)
    SELECT count(*) AS cases, round(avg(CASE WHEN first_rank <= 10 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 4) AS recall, round(avg(coalesce(1.0::DOUBLE / first_rank, 0)), 4) AS mrr FROM a""")
def eval_hit_mrr(spark, d):
    top = fusion.top(_lexical(spark, d), "lex", "rank", 10)
    results = top.join(_latest(spark, d).select("doc_id", "path", "title"), "doc_id")
    qrels = spark.createDataFrame(_PATTERNS, "query_id long, relevant array<string>")
    return evaluate.summary(evaluate.first_ranks(results, qrels), 10)


# --- store

_SPELLED = "regexp_replace(lower(trim({c})), '^sha256:', '')"


@query(f"""WITH {_LATEST} SELECT d.path, CASE WHEN sha256(coalesce(d.text, '')) = {_SPELLED.format(c="l.source_hash")} THEN 'skipped' WHEN l.doc_id IS NOT NULL THEN 'updated' ELSE 'indexed' END AS status
    FROM documents d LEFT JOIN latest l ON l.doc_id = sha256(d.path)[1:32]""")
def incremental_status(spark, d):
    found = _table(spark, d, "documents").select("path", T.document_id(F.col("path")).alias("doc_id"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("source_hash"), F.lit(None).cast("string").alias("error"))
    stored = _latest(spark, d).select("doc_id", F.regexp_replace(F.lower(F.trim("source_hash")), "^sha256:", "").alias("source_hash"))
    return status_of(found, stored).select("path", "status")


@query(f"""WITH {_LATEST}, old AS (SELECT * FROM kb_documents QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY updated_at, source_hash NULLS LAST) = 1),
    new AS (SELECT l.* FROM latest l JOIN old o USING (doc_id) WHERE l.updated_at > o.updated_at)
    SELECT o.doc_id, coalesce(n.source_hash, CASE WHEN n.doc_id IS NULL THEN o.source_hash END) AS source_hash, o.created_at::TIMESTAMP AS created_at, coalesce(n.updated_at, o.updated_at)::TIMESTAMP AS updated_at FROM old o LEFT JOIN new n USING (doc_id)""")
def upsert_merge(spark, d):
    """The registry's oldest rows, updated by its newest."""
    all_rows = _table(spark, d, "kb_documents")
    w = W.partitionBy("doc_id").orderBy("updated_at", F.asc_nulls_last("source_hash"))
    old = all_rows.withColumn("n", F.row_number().over(w)).filter("n = 1").drop("n")
    new = _latest(spark, d).alias("l").join(old.select("doc_id", F.col("updated_at").alias("u")), "doc_id").filter("updated_at > u").drop("u")
    return store.upsert(old, new).select("doc_id", "source_hash", "created_at", "updated_at")


@query(f"WITH {_C}, {_LATEST} SELECT acl, count(*) AS n FROM c WHERE doc_id NOT IN (SELECT doc_id FROM latest WHERE acl = 'hr') GROUP BY 1")
def forget_antijoin(spark, d):
    gone = _latest(spark, d).filter("acl = 'hr'").select("doc_id")
    return _chunks(spark, d).select("doc_id", "acl").join(gone, "doc_id", "left_anti").groupBy("acl").agg(F.count("*").alias("n"))


@query(f"WITH {_LATEST} SELECT doc_id, title, array_to_string(list_sort(list_distinct(coalesce(tags, []))), ',') AS tags, row_number() OVER (ORDER BY updated_at DESC, doc_id) AS place FROM latest")
def docs_listing(spark, d):
    """The whole listing; places are counted within days, behind the documents of all later days."""
    rows = _latest(spark, d).select("doc_id", "title", F.array_join(filters.tag_set(F.col("tags")), ",").alias("tags"), "updated_at", F.to_date("updated_at").alias("day"))
    later = W.orderBy(F.desc_nulls_last("day")).rowsBetween(W.unboundedPreceding, -1)
    days = rows.groupBy("day").agg(F.count("*").alias("n")).select(F.col("day").alias("of"), F.coalesce(F.sum("n").over(later), F.lit(0)).alias("before"))
    placed = rows.withColumn("k", F.row_number().over(W.partitionBy("day").orderBy(F.desc("updated_at"), "doc_id")))
    return placed.join(days, F.col("day").eqNullSafe(F.col("of"))).select("doc_id", "title", "tags", (F.col("before") + F.col("k")).alias("place"))


@query(f"WITH {_C}, {_LATEST} SELECT (SELECT count(*) FROM latest) AS documents, (SELECT count(*) FROM c) AS chunks")
def store_stats(spark, d):
    docs = _latest(spark, d).agg(F.count("*").alias("documents"))
    return docs.join(_chunks(spark, d).agg(F.count("*").alias("chunks")), how="cross")


@query(f"WITH {_C}, {_LATEST} SELECT l.path, l.title, count(*) AS chunks FROM c JOIN latest l USING (doc_id) GROUP BY 1, 2")
def chunks_of_documents(spark, d):
    return store.chunks_with_documents(_chunks(spark, d).select("doc_id"), _latest(spark, d)).groupBy("path", "title").agg(F.count("*").alias("chunks"))


# --- audit


@query("""WITH RECURSIVE b AS (SELECT row_number() OVER (ORDER BY batch_no, item_id) AS n, item_id || ':' || coalesce(source_hash, '') AS body FROM (SELECT DISTINCT ON (item_id) * FROM incoming)),
    ch(n, prev, hash) AS (SELECT n, repeat('0', 64), sha256(repeat('0', 64) || '|' || body) FROM b WHERE n = 1
        UNION ALL SELECT b.n, ch.hash, sha256(ch.hash || '|' || b.body) FROM ch JOIN b ON b.n = ch.n + 1) SELECT * FROM ch""")
def chain_build(spark, d):
    items = _table(spark, d, "incoming").dropDuplicates(["item_id"])
    return audit_log.chain(items, ["batch_no", "item_id"], F.concat(F.col("item_id").cast("string"), F.lit(":"), F.coalesce("source_hash", F.lit(""))))


def _log(spark, d) -> DataFrame:
    """Events as a log: (line, latency_ms, hits, acls)."""
    hit = F.struct(F.concat(F.col("user_id").cast("string"), F.lit(":0")).alias("chunk_id"), F.col("value").alias("score"))
    return _table(spark, d, "events").select(F.col("event_id").alias("line"), F.col("value").alias("latency_ms"), F.array(hit).alias("hits"), F.array("event_type").alias("acls"))


@query("SELECT count(*) AS queries, count(*) AS total_hits, 1.0::DOUBLE AS avg_hits_per_query, round(avg(coalesce(value, 0)), 2) AS avg_latency_ms FROM events")
def audit_stats(spark, d):
    t = audit_log.totals(_log(spark, d))
    return t.select("queries", F.col("total_hits").cast("long").alias("total_hits"), "avg_hits_per_query", "avg_latency_ms")


@query("""WITH t AS (SELECT user_id, count(*) AS hits, min(event_id) AS first_at FROM events GROUP BY 1 ORDER BY hits DESC, first_at LIMIT 10)
    SELECT CAST(user_id AS VARCHAR) AS doc_id, coalesce(c_name, CAST(user_id AS VARCHAR)) AS title, hits FROM t LEFT JOIN customer ON c_custkey = user_id""")
def audit_top_docs(spark, d):
    titles = _table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("doc_id"), F.col("c_name").alias("title"))
    return audit_log.top_documents(_log(spark, d), titles)


@query("SELECT event_type AS acl, count(*) AS queries FROM events GROUP BY 1")
def acl_distribution(spark, d):
    return audit_log.acl_distribution(_log(spark, d))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def event_hours(spark, d):
    return event_windows(_table(spark, d, "events")).withColumn("total", F.round("total", 4))


# --- no SQL: checked against brute force in the tests


@query("SELECT count(DISTINCT item_id) AS entries, (count(DISTINCT item_id) + 1) // 2 AS line, 'content does not fit its hash' AS problem FROM incoming")
def chain_verify(spark, d):
    """The log that all deliveries make, with its middle entry changed: its first bad line."""
    items = _table(spark, d, "incoming").groupBy("item_id").agg(F.min("batch_no").alias("batch_no"))
    event = items.select("item_id", "batch_no", F.lit(1.5).alias("ts"), F.to_json(F.struct(F.lit("query").alias("type"), F.col("item_id").alias("item"))).alias("event"))
    lines = cut(audit_log.log_lines(event, ["batch_no", "item_id"], "ts", "event"))
    middle = F.col("line") == F.floor((F.lit(lines.count()) + 1) / 2)
    return audit_log.verify_lines(lines.withColumn("value", F.when(middle, F.regexp_replace("value", '"item":', '"item":9')).otherwise(F.col("value"))))


@query()
def hash_embed(spark, d):
    return _documents(spark, d).select("doc_id", HashingEmbedder().column(F.col("text")).alias("vec"))


@query()
def hashed_vector_topk(spark, d):
    e = HashingEmbedder()
    docs = _documents(spark, d).select(F.col("doc_id").cast("string").alias("chunk_id"), F.col("doc_id").cast("string").alias("doc_id"), F.lit(0).alias("seq"), "text", F.lit("public").alias("acl"), F.array().cast("array<string>").alias("tags"), e.column(F.col("text")).alias("vec"))
    q = retrieve.prepared(spark.createDataFrame(_WORDS[:2], _QUERY_DDL), Config(), e)
    return fusion.vector_only(retrieve.scored(q, retrieve.ready(docs, False), 10, False), 10).select("query_id", "chunk_id", "score", "rank")


@query()
def html_extract(spark, d):
    docs = _documents(spark, d).filter("text is not null").select(F.concat("path", F.lit(".html")).alias("path"), F.to_binary(F.concat(F.lit("<html><head><title>"), F.coalesce("title", F.lit("")), F.lit("</title></head><body><p>"), "text", F.lit("</p></body></html>")), F.lit("utf-8")).alias("content"))
    return files.documents_of(docs).select("path", "source_hash", "title", "text")


@query()
def retrieve_full(spark, d):
    """The whole pipeline: pools, fusion, sections, diversity, citations."""
    q = _fiftieth(spark, d).select("query_id", "query", F.col("q_vec").alias("vec"))
    tree = _table(spark, d, "sections").select("doc_id", "section", F.col("depth").alias("level"), F.col("ordinal_no").alias("ordinal"), "parent").distinct()
    return retrieve.retrieve(q, _vectors(spark, d), _latest(spark, d), tree, Config(history_turns=0))[0]
