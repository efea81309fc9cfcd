"""BM25 over the chunks that each query may see."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeleaf.functions import text as T

K1, B = 1.5, 0.75


def term_frequencies(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, term, f)"""
    return df.select(F.col(id_col).alias("id"), F.explode(T.tokenize(F.col(text_col))).alias("term")).groupBy("id", "term").agg(F.count("*").alias("f"))


def document_frequencies(postings: DataFrame) -> DataFrame:
    """(term, df) of postings that are unique by (id, term)."""
    return postings.groupBy("term").agg(F.count("*").alias("df"))


def corpus_stats(df: DataFrame, text_col: str) -> DataFrame:
    """One row: how many texts, and their mean length in tokens (1 for none)."""
    n = F.size(T.tokenize(F.col(text_col)))
    mean = F.coalesce(F.avg(n), F.lit(0.0))
    return df.agg(F.count("*").alias("n_docs"), F.when(mean == 0, F.lit(1.0)).otherwise(mean).alias("avg_len"))


def tokenized(chunks: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds tokens (of a null text none), once for each chunk: a generator of one row keeps the optimizer from repeating the work inside later expressions."""
    return chunks.select("*", F.inline(F.array(F.struct(T.tokenize(F.coalesce(text_col, F.lit(""))).alias("tokens")))))
