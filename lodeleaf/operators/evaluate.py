"""Hit rate and mean reciprocal rank."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeleaf.operators.filters import relevant


def first_ranks(results: DataFrame, qrels: DataFrame) -> DataFrame:
    """(query_id, first_rank): rank of the first relevant result, null without one; a row for each case.

    results: (query_id, rank, path, title); qrels: (query_id, relevant)."""
    hits = results.join(qrels.select("query_id", "relevant"), "query_id").filter(relevant(F.col("path"), F.col("title"), F.col("relevant")))
    firsts = hits.groupBy("query_id").agg(F.min("rank").alias("first_rank"))
    return qrels.select("query_id").join(firsts, "query_id", "left")


def summary(ranks: DataFrame, top_k: int) -> DataFrame:
    """One row: cases, recall (share of cases with a hit in the top k) and mrr, to four places."""
    hit = F.coalesce(F.col("first_rank") <= top_k, F.lit(False))
    mean = lambda c: F.round(F.coalesce(F.avg(c), F.lit(0.0)), 4)
    return ranks.agg(F.count("*").alias("cases"), mean(hit.cast("double")).alias("recall"), mean(F.when(hit, 1.0 / F.col("first_rank")).otherwise(F.lit(0.0))).alias("mrr"))
