"""Ranking and fusion of two scores for each query."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

RRF_K = 60


def top(rows: DataFrame, score: str, rank: str, limit: int, order: tuple[str, ...] = ("doc_id", "seq", "chunk_id")) -> DataFrame:
    """The best rows of each query, ranked from 1; ties by document and place.  Each task keeps only its best before anything is shuffled."""
    w = W.partitionBy("query_id").orderBy(F.desc_nulls_last(score), *order)
    return rows.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= limit)


def _within(rows: DataFrame, rank: str, pool: int) -> DataFrame:
    """Cuts to the pool of the query, which may ask for more than the least pool."""
    own = F.greatest(F.lit(pool), F.coalesce(F.col("top_k"), F.lit(0)) * 4) if "top_k" in rows.columns else F.lit(pool)
    return rows.filter(F.col(rank) <= own)


def pools(scored: DataFrame, pool: int, most_k: int = 0) -> DataFrame:
    """Rows (query_id, chunk_id, vec_score, lex) in the pool of either score, with vec_rank and lex_rank."""
    limit = max(pool, 4 * most_k)

    def place(score: str) -> Column:
        return F.row_number().over(W.partitionBy("query_id").orderBy(F.desc_nulls_last(score), "doc_id", "seq", "chunk_id"))

    # both ranks of rows that are sent once; scored has a row of a query once
    own = F.least(F.lit(limit), F.greatest(F.lit(pool), F.coalesce(F.col("top_k"), F.lit(0)) * 4) if "top_k" in scored.columns else F.lit(pool))
    ranked = scored.withColumn("vec_rank", place("vec_score")).withColumn("lex_rank", place("lex"))
    both = ranked.withColumns({c: F.when(F.col(c) <= own, F.col(c)) for c in ("vec_rank", "lex_rank")})
    return both.filter(F.col("vec_rank").isNotNull() | F.col("lex_rank").isNotNull())


def rrf(vec_rank: Column, lex_rank: Column, k: int = RRF_K) -> Column:
    zero = F.lit(0.0)
    return F.coalesce(1.0 / (k + vec_rank), zero) + F.coalesce(1.0 / (k + lex_rank), zero)


def min_max(value: str, by: str = "query_id") -> Column:
    """Scaled to 0..1 over the rows of a query; a range of zero counts as one."""
    w = W.partitionBy(by)
    lo, hi = F.min(value).over(w), F.max(value).over(w)
    return (F.col(value) - lo) / F.when(hi == lo, F.lit(1.0)).otherwise(hi - lo)


def fuse(candidates: DataFrame, mode: str = "rrf", weight: float = 0.5) -> DataFrame:
    """Adds score and rank to rows of pools; ties as they entered: by vec_rank, then by lex_rank."""
    if mode == "weighted":
        scored = candidates.withColumn("score", (1 - weight) * min_max("vec_score") + weight * min_max("lex"))
    else:
        scored = candidates.withColumn("score", rrf(F.col("vec_rank"), F.col("lex_rank")))
    w = W.partitionBy("query_id").orderBy(F.desc("score"), F.asc_nulls_last("vec_rank"), F.asc_nulls_last("lex_rank"))
    return scored.withColumn("rank", F.row_number().over(w))


def vector_only(scored: DataFrame, pool: int, most_k: int = 0) -> DataFrame:
    rows = _within(top(scored, "vec_score", "vec_rank", max(pool, 4 * most_k)), "vec_rank", pool)
    return rows.withColumns({"lex_rank": F.lit(None).cast("int"), "score": F.col("vec_score"), "rank": F.col("vec_rank")})


def at_least(ranked: DataFrame, min_score: float) -> DataFrame:
    """Only a positive bound drops rows; it is held against the fused score."""
    return ranked.filter(F.col("score") >= min_score) if min_score > 0 else ranked
