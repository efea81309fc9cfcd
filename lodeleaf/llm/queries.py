"""The queries of this subpackage, over whole tables with production parameters."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common as C
from . import history as H
from . import mixing as M
from . import near_duplicates as N
from . import neighbours as V
from . import packing as P
from . import pii as PII
from . import sentences as SE
from . import splitting as S
from . import term_counts as TC

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return N.found_pairs(C.table(spark, d, "chunks"), "chunk_id", "text").toDF("chunk_id_a", "chunk_id_b")


def p1_classes(spark: SparkSession, d: str) -> DataFrame:
    return N.classes(C.table(spark, d, "chunks"), "chunk_id", "text").withColumnRenamed("id", "chunk_id")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    cut = S.split(C.table(spark, d, "chunks"), "chunk_id", "text")
    return cut.groupBy(F.col("id").alias("chunk_id")).agg(F.max("forced").alias("forced"))


def p2_pieces(spark: SparkSession, d: str) -> DataFrame:
    return S.split_chunks(*(C.table(spark, d, t) for t in ("chunks", "kb_documents", "documents", "sections")))


def p2_limits(spark: SparkSession, d: str) -> DataFrame:
    """Of each oversized chunk, whether its pieces keep to the limits and hold all of it: what SQL can ask of them."""
    chunks = C.table(spark, d, "chunks")
    pieces = S.split(chunks, "chunk_id", "text").select("id", "piece_no", F.col("start_pos").alias("a"), F.col("end_pos").alias("b"), F.col("text").alias("piece"))
    near = W.partitionBy("id").orderBy("piece_no")
    whole = chunks.groupBy(F.col("chunk_id").cast("string").alias("id")).agg(F.min("text").alias("text"))
    rows = pieces.withColumn("before", F.lag("b").over(near)).join(whole, "id")
    is_right = F.col("piece") == F.substring(F.col("text"), F.col("a") + 1, F.col("b") - F.col("a"))
    gap = F.when(F.col("a") > F.col("before"), F.substring(F.col("text"), F.col("before") + 1, F.col("a") - F.col("before"))).otherwise(F.lit(""))
    checked = rows.groupBy(F.col("id").alias("chunk_id")).agg(
        F.every(F.length("piece") <= S.LIMIT).alias("in_limit"), F.every(is_right).alias("offsets_right"), F.every(F.trim(F.regexp_replace(gap, C.BLANKS, "")) == "").alias("nothing_lost"),
        F.every(F.coalesce(F.col("before") - F.col("a"), F.lit(S.OVERLAP)) <= S.OVERLAP + S.OVERLAP // 2).alias("overlap_in_bounds"), (F.count("*") > 1).alias("divided"),
    )
    return checked


def _history(spark: SparkSession, d: str) -> H.History:
    history = H.History(spark)
    history.append(C.table(spark, d, "chunks"))
    return history


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    batch = C.table(spark, d, "incoming").select("batch_no", "item_id", "text", "source_hash")
    known = H.known_hashes(C.table(spark, d, "kb_documents"), batch)
    history = _history(spark, d)
    found = C.cut(history.duplicates(batch).union(known).distinct())
    history.drop()
    return found


def p3_new(spark: SparkSession, d: str) -> DataFrame:
    history = _history(spark, d)
    new = C.cut(H.new_items(history, C.table(spark, d, "kb_documents"), C.table(spark, d, "incoming")))
    history.drop()
    return new


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return V.alike_pairs(C.table(spark, d, "chunks"), "chunk_id", "vec", "dim", "embedder").toDF("chunk_id_a", "chunk_id_b")


def p4_neighbours(spark: SparkSession, d: str) -> DataFrame:
    return V.neighbours(C.table(spark, d, "chunks"), "chunk_id", "vec", "dim", "embedder").withColumnsRenamed({"id": "chunk_id", "other": "neighbour"})


def _terms(spark: SparkSession, d: str) -> DataFrame:
    """All chunks, as they come to a store in two increments, by a hash of the document."""
    store = TC.TermStore(spark, f"{C.checkpoint_dir(spark).rstrip('/')}/terms-{uuid.uuid4().hex}")
    chunks = C.table(spark, d, "chunks").select("chunk_id", "doc_id", "text")
    arrival = F.coalesce(F.pmod(F.xxhash64(F.substring_index("chunk_id", ":", 1)), F.lit(2)), F.lit(0))
    for k in (0, 1):
        added = TC.once(chunks.filter(arrival == k), "chunk_id", "text")
        store.apply(TC.deltas(added, F.lit(None).cast("string"), F.col("text")))
    found = C.cut(TC.marked(store.counts()))
    store.drop()
    return found


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _terms(spark, d).filter("mark is not null").select("term", "mark")


def p5_terms(spark: SparkSession, d: str) -> DataFrame:
    return _terms(spark, d)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return SE.unit_ends(C.table(spark, d, "chunks"), "chunk_id", "text").withColumnRenamed("id", "chunk_id")


def p6_units(spark: SparkSession, d: str) -> DataFrame:
    return SE.sentences(C.table(spark, d, "chunks"), "chunk_id", "text").withColumnRenamed("id", "chunk_id")


def p6_kept(spark: SparkSession, d: str) -> DataFrame:
    """Of each chunk, how many code points that are no whitespace its units hold: all that it has."""
    units = SE.sentences(C.table(spark, d, "chunks"), "chunk_id", "text")
    return units.groupBy(F.col("id").alias("chunk_id")).agg(F.sum(F.length(F.regexp_replace("text", C.BLANKS, ""))).alias("n_chars"))


def p7_pack(spark: SparkSession, d: str) -> DataFrame:
    return P.pack(C.table(spark, d, "documents"), C.table(spark, d, "pack_limits"))


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    return P.report(p7_pack(spark, d), P.curves(C.table(spark, d, "documents")))


def p7_limits(spark: SparkSession, d: str) -> DataFrame:
    """Of each container size: containers that are too full, documents split though they fit, documents packed."""
    packed = C.cut(p7_pack(spark, d))
    bins = packed.groupBy("container", "bin_id").agg(F.sum("n_tokens").alias("n"), F.max("capacity").alias("capacity"))
    documents = packed.groupBy("container", "doc_id").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("parts"), F.max("capacity").alias("capacity"))
    full = bins.groupBy("container").agg(F.sum((F.col("n") > F.col("capacity")).cast("long")).alias("too_full"))
    split = documents.groupBy("container").agg(F.sum(((F.col("parts") > 1) & (F.col("n") <= F.col("capacity"))).cast("long")).alias("split_though_fit"), F.count("*").alias("documents"))
    return full.join(split, "container")


def p8_limits(spark: SparkSession, d: str) -> DataFrame:
    """Of each target: whether its documents are used at most so often, its budget is its share of what the sources that
    have documents share out, and is missed by less than its largest document."""
    documents = C.table(spark, d, "documents")
    used, shares = M.mix(documents, C.table(spark, d, "mix_targets"))
    most = used.groupBy("source").agg(F.max("repeats").alias("most"))
    largest = M.sized(documents).groupBy("source").agg(F.max("n_tokens").alias("largest"))
    all_of = W.partitionBy()
    part = F.when(F.col("available_tokens") > 0, F.col("target_share")).otherwise(F.lit(0.0))
    rows = shares.withColumns({"wanted": part / F.sum(part).over(all_of), "given": F.col("budget_tokens") / F.sum("budget_tokens").over(all_of)})
    rows = rows.join(most, "source", "left").join(largest, "source", "left")
    left = F.col("budget_tokens") - F.col("actual_tokens")
    met = (F.abs(F.col("given") - F.col("wanted")) < 1e-6) & (left > -1) & (left <= F.coalesce("largest", F.lit(0)))
    return rows.select("source", (F.coalesce("most", F.lit(0)) <= F.col("max_repeats")).alias("repeats_kept"), met.alias("share_met"))


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    return M.mix(C.table(spark, d, "documents"), C.table(spark, d, "mix_targets"))[0]


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return M.mix(C.table(spark, d, "documents"), C.table(spark, d, "mix_targets"))[1]


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return PII.mentions(C.table(spark, d, "documents"))


def p9_redacted(spark: SparkSession, d: str) -> DataFrame:
    return PII.redacted(C.table(spark, d, "documents"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (p1_found, p1_classes, p2_found, p2_pieces, p2_limits, p3_found, p3_new, p4_found, p4_neighbours, p5_found, p5_terms, p6_found, p6_units, p6_kept, p7_pack, p7_report, p7_limits, p8_mix, p8_shares, p8_limits, p9_found, p9_redacted)}

_ONCE = "SELECT chunk_id, min(text) AS text FROM chunks WHERE chunk_id IS NOT NULL GROUP BY chunk_id"
_NORM = r"trim(regexp_replace(lower(text), '[\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+', ' ', 'g'))"

ORACLE: dict[str, str] = {
    "p1_found": f"""
        WITH n AS (SELECT chunk_id, {_NORM} AS t FROM ({_ONCE}) WHERE text IS NOT NULL),
        g AS (SELECT DISTINCT chunk_id, unnest(list_transform(range(1, length(t) - 7), lambda i: hash(substr(t, i, 9)))) AS g FROM n WHERE length(t) >= 200),
        s AS (SELECT chunk_id, count(*) AS n FROM g GROUP BY 1),
        o AS (SELECT a.chunk_id AS a, b.chunk_id AS b, count(*) AS n FROM g a JOIN g b ON a.g = b.g AND a.chunk_id < b.chunk_id GROUP BY 1, 2)
        SELECT o.a AS chunk_id_a, o.b AS chunk_id_b FROM o JOIN s x ON x.chunk_id = o.a JOIN s y ON y.chunk_id = o.b WHERE o.n >= 0.6 * (x.n + y.n - o.n)""",
    "p2_found": r"""
        SELECT chunk_id, CAST(regexp_matches(text, '[^\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}.!?。！？।؟]{801}') AS INTEGER) AS forced
        FROM (SELECT chunk_id, min(text) AS text FROM chunks GROUP BY chunk_id)
        WHERE length(regexp_replace(text, '^[\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+|[\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+$', '', 'g')) > 800""",
    "p3_found": f"""
        WITH i AS (SELECT item_id, min(batch_no) AS batch_no, min(text) AS text, min(regexp_replace(lower(trim(source_hash)), '^sha256:', '')) AS h FROM incoming GROUP BY 1),
        x AS (SELECT *, row_number() OVER (ORDER BY batch_no, item_id) AS place FROM i),
        t AS (SELECT place AS id, item_id, {_NORM} AS t FROM x WHERE text IS NOT NULL
              UNION ALL SELECT -row_number() OVER (ORDER BY text), NULL, {_NORM} FROM (SELECT DISTINCT text FROM chunks WHERE text IS NOT NULL)),
        g AS (SELECT DISTINCT id, item_id, unnest(list_transform(range(1, length(t) - 7), lambda i: hash(substr(t, i, 9)))) AS g FROM t WHERE length(t) >= 200),
        s AS (SELECT id, count(*) AS n FROM g GROUP BY 1),
        o AS (SELECT a.id AS a, b.id AS b, any_value(a.item_id) AS item_id, count(*) AS n FROM g a JOIN g b ON a.g = b.g AND a.id > 0 AND b.id < a.id GROUP BY 1, 2)
        SELECT DISTINCT o.item_id FROM o JOIN s x ON x.id = o.a JOIN s y ON y.id = o.b WHERE o.n >= 0.6 * (x.n + y.n - o.n)
        UNION
        SELECT item_id FROM x WHERE text IS NULL AND (h IN (SELECT regexp_replace(lower(trim(source_hash)), '^sha256:', '') FROM kb_documents WHERE source_hash IS NOT NULL)
          OR EXISTS (SELECT 1 FROM x y WHERE y.h = x.h AND y.place < x.place))""",
}
ORACLE["p4_found"] = """
    WITH v AS (SELECT chunk_id, any_value(embedder) AS e, any_value(dim) AS dim, any_value(vec) AS v FROM chunks
               WHERE len(vec) = dim AND len(list_filter(vec, lambda x: isnan(x))) = 0 AND len(list_filter(vec, lambda x: x <> 0)) > 0 GROUP BY chunk_id),
    c AS (SELECT a.chunk_id AS a, b.chunk_id AS b, list_cosine_similarity(a.v, b.v) AS s FROM v a JOIN v b ON a.e IS NOT DISTINCT FROM b.e AND a.dim = b.dim AND a.chunk_id <> b.chunk_id),
    r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY s DESC, b) AS n FROM c WHERE s >= 0.8)
    SELECT DISTINCT least(a, b) AS chunk_id_a, greatest(a, b) AS chunk_id_b FROM r WHERE n <= 5"""
_TERMS_SQL = f"""
    WITH r AS (SELECT chunk_id, lower(text) AS t FROM ({_ONCE}) WHERE {_NORM} <> ''),
    runs AS (SELECT chunk_id, unnest(regexp_extract_all(t, '[{TC.CJK}]+')) AS run FROM r),
    terms AS (SELECT chunk_id, unnest(regexp_extract_all(t, '[a-z0-9_]+')) AS term FROM r
        UNION ALL SELECT chunk_id, unnest(string_split(run, '')) FROM runs
        UNION ALL SELECT chunk_id, unnest(list_transform(range(1, length(run)), lambda i: substr(run, i, 2))) FROM runs),
    counts AS (SELECT term, count(*) AS occurrences, count(DISTINCT chunk_id) AS records FROM terms GROUP BY term),
    m AS (SELECT *, CASE WHEN records > 0.1 * (SELECT count(*) FROM r) THEN 'common' WHEN records <= 2 THEN 'rare' END AS mark FROM counts)
"""
ORACLE["p5_found"] = _TERMS_SQL + "SELECT term, mark FROM m WHERE mark IS NOT NULL"
ORACLE["p5_terms"] = _TERMS_SQL + "SELECT term, occurrences, records, mark FROM m"

_CLASSES_SQL = f"""
    WITH n AS (SELECT chunk_id, t FROM (SELECT chunk_id, {_NORM} AS t FROM ({_ONCE}) WHERE text IS NOT NULL) WHERE length(t) >= 200),
    k AS (SELECT t, min(chunk_id) AS class_id, count(*) AS copies FROM n GROUP BY 1),
    g AS (SELECT DISTINCT class_id AS c, unnest(list_transform(range(1, length(t) - 7), lambda i: hash(substr(t, i, 9)))) AS g FROM k),
    s AS (SELECT c, count(*) AS n FROM g GROUP BY 1),
    o AS (SELECT a.c AS a, b.c AS b, count(*) AS n FROM g a JOIN g b ON a.g = b.g AND a.c < b.c GROUP BY 1, 2),
    l AS (SELECT o.a, o.b FROM o JOIN s x ON x.c = o.a JOIN s y ON y.c = o.b WHERE o.n >= 0.6 * (x.n + y.n - o.n)),
    e AS (SELECT c, count(*) AS n_links FROM (SELECT a AS c FROM l UNION ALL SELECT b FROM l) GROUP BY 1)
    SELECT n.chunk_id, k.class_id, k.copies, coalesce(e.n_links, 0) AS n_links FROM n JOIN k ON k.t = n.t LEFT JOIN e ON e.c = k.class_id"""
ORACLE["p1_classes"] = _CLASSES_SQL
ORACLE["p3_new"] = f"""SELECT * REPLACE (arrived_at::TIMESTAMP AS arrived_at) FROM (SELECT DISTINCT ON (item_id) * FROM incoming WHERE item_id IS NOT NULL ORDER BY item_id, batch_no, text NULLS FIRST, arrived_at)
    WHERE item_id NOT IN ({ORACLE["p3_found"]})"""
_LONG_SQL = ORACLE["p2_found"].partition("WHERE length(")[2]
ORACLE["p2_limits"] = f"SELECT chunk_id, true AS in_limit, true AS offsets_right, true AS nothing_lost, true AS overlap_in_bounds, true AS divided FROM (SELECT chunk_id, min(text) AS text FROM chunks GROUP BY chunk_id) WHERE length({_LONG_SQL}"
ORACLE["p6_kept"] = f"SELECT chunk_id, n_chars FROM (SELECT chunk_id, length(regexp_replace(text, '{C.BLANKS_SQL}', '', 'g')) AS n_chars FROM ({_ONCE}) WHERE text IS NOT NULL) WHERE n_chars > 0"
ORACLE["p7_limits"] = "SELECT container, 0 AS too_full, 0 AS split_though_fit, (SELECT count(*) FROM documents WHERE length(text) > 0) AS documents FROM pack_limits"
ORACLE["p8_limits"] = "SELECT source, true AS repeats_kept, true AS share_met FROM mix_targets"
