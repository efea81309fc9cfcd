"""Retrieval of a batch of queries as one plan.

Queries: (query_id, query, vec, acls, tags, top_k, history, domain_terms); of these query_id and query must be there.
A single question is a batch of one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodeleaf.config import Config
from lodeleaf.functions import text as T
from lodeleaf.functions.embedding import Embedder
from lodeleaf.operators import fusion, lexical, mmr, sections
from lodeleaf.operators.filters import visible
from lodeleaf.plans import block
from lodeleaf.sources.lineage import cut, stored_once

BLOCK = 4000  # queries that are broadcast at once
_OPTIONAL = {"acls": "array<string>", "tags": "array<string>", "top_k": "int", "history": "array<string>", "domain_terms": "array<string>"}


def prepared(queries: DataFrame, config: Config, embedder: Embedder | None) -> DataFrame:
    """Queries with all columns, their effective text, its distinct terms and its vector."""
    q = queries
    for name, kind in _OPTIONAL.items():
        q = q.withColumn(name, F.col(name).cast(kind) if name in q.columns else F.lit(None).cast(kind))
    q = q.withColumn("effective", T.expand_query(F.col("query"), F.col("history"), F.col("domain_terms"), config.history_turns))
    if "vec" not in q.columns:
        if embedder is None:
            raise ValueError("queries without vec need an embedder")
        q = q.withColumn("vec", embedder.column(F.col("effective")))
    return q.select(F.col("query_id").cast("long").alias("query_id"), "query", "effective", F.array_distinct(T.tokenize(F.col("effective"))).alias("q_terms"), F.col("vec").alias("q_vec"), "acls", F.col("tags").alias("wanted"), "top_k")


def query_blocks(queries: DataFrame, size: int = BLOCK) -> list[DataFrame]:
    """Batches that are small enough to broadcast."""
    n = queries.count()
    blocks = max(1, -(-n // size))
    if blocks == 1:
        return [queries]
    return [queries.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == k) for k in range(blocks)]


def pairs(queries: DataFrame, chunks: DataFrame) -> DataFrame:
    """Each query of a block with each chunk that it sees: a stated query set against all rows."""
    seen = visible(F.col("acl"), F.col("tags"), F.col("acls"), F.col("wanted"))
    return chunks.join(F.broadcast(queries), seen, "inner")


def ready(chunks: DataFrame, lexical_too: bool = True) -> DataFrame:
    """Chunks with their tokens: those of the store, or tokenized once for all blocks and passes."""
    stored = "tokens" in chunks.columns
    if lexical_too and stored:
        chunks = chunks.withColumn("tokens", F.coalesce("tokens", T.tokenize(F.coalesce("text", F.lit("")))))  # older rows have none
    elif lexical_too:
        chunks = lexical.tokenized(chunks)
    elif not stored:
        chunks = chunks.withColumn("tokens", F.lit(None).cast("array<string>"))
    needed = chunks.select(F.col("chunk_id").cast("string").alias("chunk_id"), F.col("doc_id").cast("string").alias("doc_id"), F.col("seq").cast("int").alias("seq"), "acl", "tags", F.col("vec").cast("array<double>").alias("vec"), "tokens")
    if not lexical_too or stored:
        return needed
    # columns of a file take a fraction of the room of checkpointed rows.  Of each query every partition keeps its best
    # rows, so there is one partition for each core
    return stored_once(needed, "chunks").coalesce(chunks.sparkSession.sparkContext.defaultParallelism)


def scored(queries: DataFrame, chunks: DataFrame, limit: int, lexical_too: bool = True) -> DataFrame:
    """(query_id, top_k, chunk_id, doc_id, seq, vec_score, lex) of visible chunks, so many of the best by either score for each
    query (and more); vectors of another size than the query's have no score."""
    return block.scored(queries, chunks, limit, lexical_too)


def candidates(queries: DataFrame, chunks: DataFrame, config: Config, most_k: int) -> DataFrame:
    """(query_id, chunk_id, doc_id, seq, vec_score, lex, vec_rank, lex_rank, score, rank), the fused ranking before any filter."""
    rows = scored(queries, chunks, max(config.candidate_pool, 4 * most_k), config.hybrid)
    if not config.hybrid:
        return fusion.vector_only(rows, config.candidate_pool, most_k)
    return fusion.fuse(fusion.pools(rows, config.candidate_pool, most_k), config.hybrid_mode, config.bm25_weight)


def retrieve(queries: DataFrame, chunks: DataFrame, documents: DataFrame, tree: DataFrame, config: Config, embedder: Embedder | None = None, selected: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Citations (query_id, rank, chunk_id, ..., tags), and the scored sections (query_id, section, score, level, place).

    chunks, documents and tree: as in the store.  selected: (query_id, section, place), sections that were chosen
    elsewhere and take the place of the best ones."""
    found, scored_sections = [], []
    asked = cut(prepared(queries, config, embedder))
    most_k = max(config.top_k, asked.agg(F.max("top_k")).first()[0] or 0)
    rows = ready(chunks, config.hybrid)
    for part in query_blocks(asked):
        ranked = candidates(part, rows, config, most_k)
        # a few rows for each query; rows and vectors come back by a join that starts from these
        details = chunks.select("chunk_id", "text", "page", "start_pos", "end_pos", "section", "acl", "tags", "vec")
        ranked = cut(cut(ranked).join(details, "chunk_id"))  # at most two pools of rows for each query
        nodes = sections.scores(ranked, tree.select(F.col("doc_id").alias("id"), "section", "level", "ordinal", "parent"))
        kept = fusion.at_least(ranked, config.min_score)
        chosen = selected if selected is not None else sections.first_sections(nodes, config.structure_top_sections) if config.structure_aware else None
        if chosen is not None:
            kept = sections.keep_selected(kept, chosen)
        own_k = F.coalesce(F.nullif(F.col("top_k"), F.lit(0)), F.lit(config.top_k))
        if config.mmr_lambda > 0:
            picked = mmr.mmr(kept, config.mmr_lambda, config.top_k)
            final = kept.drop("rank").join(picked, ["query_id", "chunk_id"]).withColumnRenamed("final_rank", "rank")
        else:
            final = kept.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy("rank"))).filter(F.col("rank") <= own_k)
        cited = final.join(documents.select("doc_id", "path", "title"), "doc_id")
        found.append(cited.select("query_id", "rank", "chunk_id", "doc_id", "score", "text", "page", "start_pos", "end_pos", "path", "title", "acl", "section", "tags"))
        scored_sections.append(nodes.select("query_id", "section", "score", "level", "place"))
    return _union(found), _union(scored_sections)


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out
