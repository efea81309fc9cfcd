"""Scores of sections, and ranking by them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodeleaf.operators.filters import in_section


def leaf_scores(ranked: DataFrame) -> DataFrame:
    """(query_id, section, leaf): best score of the candidates in a section."""
    return ranked.filter(F.coalesce("section", F.lit("")) != "").groupBy("query_id", "section").agg(F.max("score").alias("leaf"))


def scores(ranked: DataFrame, tree: DataFrame, documents: DataFrame | None = None) -> DataFrame:
    """(query_id, id, section, level, ordinal, score, place): nodes with a score, ranked from 1.

    A node has the best of its own leaf and of its direct children; a path counts across documents.
    tree: (id, section, level, ordinal, parent).  documents, if given: (query_id, id) of those that the query
    sees; else those of its candidates."""
    leaf = leaf_scores(ranked)
    parents = tree.select(F.col("section").alias("child"), F.col("parent").alias("up")).filter("parent is not null").distinct()
    lifted = leaf.join(parents, leaf["section"] == parents["child"]).select("query_id", F.col("up").alias("section"), "leaf")
    best = leaf.union(lifted).groupBy("query_id", "section").agg(F.max("leaf").alias("score"))
    seen = documents if documents is not None else ranked.select("query_id", F.col("doc_id").alias("id")).distinct()
    nodes = seen.join(tree.select("id", "section", "level", "ordinal"), "id").join(best, ["query_id", "section"])
    return nodes.withColumn("place", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "id", "ordinal")))


def snippets(ranked: DataFrame, length: int = 200) -> DataFrame:
    """(query_id, section, snippet): the start of the best candidate of each section, the first of equals."""
    rows = ranked.filter(F.coalesce("section", F.lit("")) != "")
    return rows.groupBy("query_id", "section").agg(F.substring(F.max_by("text", F.struct(F.col("score"), -F.col("rank"))), 1, length).alias("snippet"))


def keep_selected(ranked: DataFrame, selected: DataFrame) -> DataFrame:
    """Rows in a selected section or in none, ordered by section and place in the document.

    selected: (query_id, section, place), a few rows for each query.  A query whose rows would all go, or that has
    no selected section, keeps its ranking."""
    paths = selected.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("place", "section"))).alias("paths"))
    joined = ranked.join(F.broadcast(paths), "query_id", "left")  # a row for each query
    first = F.get(F.filter("paths", lambda p: in_section(F.col("section"), p["section"])), F.lit(0))["place"]
    blank = F.coalesce("section", F.lit("")) == ""
    passes = blank | F.coalesce(first.isNotNull(), F.lit(False))
    sorted_by = F.when(blank | first.isNull(), F.lit(1 << 30)).otherwise(first)
    w = W.partitionBy("query_id")
    flagged = joined.withColumns({"passes": passes, "by": sorted_by}).withColumn("any", F.max(F.col("passes").cast("int")).over(w) == 1)
    active = F.col("paths").isNotNull() & F.col("any")
    rows = flagged.filter(~active | F.col("passes"))
    keys = [F.when(active, F.col("by")), F.when(active, F.col("start_pos")), F.col("rank")]
    return rows.withColumn("rank", F.row_number().over(w.orderBy(*keys))).drop("paths", "passes", "by", "any")


def first_sections(scored: DataFrame, n: int) -> DataFrame:
    return scored.filter(F.col("place") <= max(1, n)).select("query_id", "section", "place")


def section_filter(section: Column, paths: list[str]) -> Column:
    """Whether a section is under any of a few paths of the driver."""
    out = F.coalesce(section, F.lit("")) == ""
    for p in paths:
        out = out | in_section(section, F.lit(p))
    return out
