"""Maximal marginal relevance."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pick(relevance: np.ndarray, vectors: np.ndarray, k: int, weight: float) -> list[int]:
    """Places of the chosen rows, in the order of choice; of equal values the first wins."""
    span = relevance.max() - relevance.min()
    rel = (relevance - relevance.min()) / (span or 1.0)
    redundancy = np.zeros(len(rel))
    chosen: list[int] = []
    free = np.ones(len(rel), dtype=bool)
    while len(chosen) < min(k, len(rel)):
        value = np.where(free, rel - weight * redundancy, -np.inf)
        best = int(np.argmax(value))
        similarity = vectors @ vectors[best]
        redundancy = similarity if not chosen else np.maximum(redundancy, similarity)
        chosen.append(best)
        free[best] = False
    return chosen


def mmr(ranked: DataFrame, weight: float, k: int = 5) -> DataFrame:
    """Rows (query_id, chunk_id, rank, score, vec and, if there is one, top_k) to (query_id, chunk_id, final_rank).

    A query has at most two pools of rows, so a group is small whatever the collection.  Vectors that are
    null or of another size than the first are taken as zero."""
    own_k = F.coalesce(F.nullif(F.col("top_k"), F.lit(0)), F.lit(k)) if "top_k" in ranked.columns else F.lit(k)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("rank", kind="stable")
        dim = next((len(v) for v in rows["vec"] if v is not None and len(v)), 1)
        vectors = np.array([v if v is not None and len(v) == dim else np.zeros(dim) for v in rows["vec"]], dtype=np.float64)
        chosen = pick(rows["score"].to_numpy(dtype=np.float64), vectors, int(rows["k"].iloc[0]), weight)
        return pd.DataFrame({"query_id": rows["query_id"].iloc[chosen].to_numpy(), "chunk_id": rows["chunk_id"].iloc[chosen].to_numpy(), "final_rank": range(1, len(chosen) + 1)})

    cut = ranked.select("query_id", "chunk_id", "rank", "score", F.col("vec").cast("array<double>").alias("vec"), own_k.alias("k"))
    return cut.groupBy("query_id").applyInPandas(run, "query_id long, chunk_id string, final_rank int")
