"""Cases of an evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def load_qrels(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, query, relevant) from a JSON array of {query, relevant}; query_id is the place in it."""
    rows = spark.read.text(path, wholetext=True).select(F.from_json("value", "array<struct<query:string,relevant:array<string>>>").alias("cases"))
    return rows.select(F.posexplode("cases").alias("query_id", "c")).select(F.col("query_id").cast("long").alias("query_id"), "c.query", "c.relevant")
