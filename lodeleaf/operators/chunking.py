"""Documents to sections, windows and pages.  Null texts give nothing."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as Ty

from lodeleaf.functions import text as T

_HEADING = re.compile(r"^(#{1,6})\s+(.+?)\s*$", re.MULTILINE)
LEVELS = 6


_SPANS = Ty.ArrayType(Ty.StructType([Ty.StructField("start", Ty.IntegerType()), Ty.StructField("level", Ty.IntegerType()), Ty.StructField("title", Ty.StringType())]))


@F.pandas_udf(_SPANS)
def headings(text: pd.Series) -> pd.Series:
    """Headings of Markdown texts, with offsets in code points."""
    return pd.Series([[{"start": m.start(), "level": len(m.group(1)), "title": m.group(2)} for m in _HEADING.finditer(t)] if t else [] for t in text])


def sections(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, ordinal, section, title, level, start, end): the text from each heading to the next, with the path of its headings.

    Text before the first heading is a section with an empty path; so is a text without headings."""
    base = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter("text is not null")
    parsed = base.select("id", F.length("text").alias("n"), headings("text").alias("h"))
    own = parsed.select("id", "n", F.posexplode("h").alias("k", "x")).select("id", "n", F.col("k").alias("ordinal"), "x.start", "x.level", "x.title")
    order = W.partitionBy("id").orderBy("ordinal")
    running = order.rowsBetween(W.unboundedPreceding, W.currentRow)
    cols = {"end": F.lead("start").over(order)}
    for level in range(1, LEVELS + 1):
        here = F.when(F.col("level") == level, F.struct("ordinal", "title"))
        cols[f"h{level}"] = F.last(here, ignorenulls=True).over(running)
    stacked = own.withColumns(cols)
    # a heading is still open if none of a lower or the same level came after it
    path = []
    for level in range(1, LEVELS + 1):
        mine = F.col(f"h{level}")
        shut = F.lit(False)
        for above in range(1, level):
            shut = shut | F.coalesce(F.col(f"h{above}.ordinal") > mine["ordinal"], F.lit(False))
        path.append(F.when((F.col("level") >= level) & ~shut, mine["title"]))
    named = stacked.select("id", "ordinal", F.concat_ws(" > ", *path).alias("section"), "title", "level", "start", F.coalesce("end", "n").cast("int").alias("end"))
    first = F.coalesce(F.get(F.col("h"), F.lit(0))["start"], F.col("n"))
    lead = parsed.filter((first > 0)).select("id", F.lit(-1).alias("ordinal"), F.lit("").alias("section"), F.lit("").alias("title"), F.lit(0).alias("level"), F.lit(0).alias("start"), first.cast("int").alias("end"))
    return lead.unionByName(named)


def section_tree(df: DataFrame, id_col: str, ordinal_col: str, section_col: str, start_col: str, end_col: str) -> DataFrame:
    """(id, section, title, level, start, end, parent, ordinal): a node for each prefix of the paths of a document.

    A path that comes again keeps its first start and its greatest end; ordinal is the order of first appearance."""
    parts = F.filter(F.transform(F.split(F.col(section_col), ">"), T.strip), lambda p: p != "")
    rows = df.filter(F.coalesce(section_col, F.lit("")) != "").select(F.col(id_col).alias("id"), F.col(ordinal_col).alias("o"), parts.alias("p"), F.col(start_col).alias("s"), F.col(end_col).alias("e"))
    rows = rows.filter(F.size("p") > 0).select("id", "o", "p", "s", "e", F.explode(F.sequence(F.lit(1), F.size("p"))).alias("level"))
    node = rows.withColumn("section", F.array_join(F.slice("p", F.lit(1), F.col("level")), " > ")).withColumn("title", F.get("p", F.col("level") - 1))
    node = node.withColumn("parent", F.when(F.col("level") > 1, F.array_join(F.slice("p", F.lit(1), F.col("level") - 1), " > ")))
    seen = node.groupBy("id", "section").agg(F.min_by(F.struct("title", "level", "parent", "s"), F.struct("o", "level")).alias("x"), F.max("e").alias("end"), F.min(F.struct("o", "level")).alias("place"))
    ordinal = F.row_number().over(W.partitionBy("id").orderBy("place")) - 1
    return seen.select("id", "section", "x.title", "x.level", F.col("x.s").alias("start"), "end", "x.parent", ordinal.cast("int").alias("ordinal"))


def window_ends(text: Column, lo: Column, hi: Column, size: int, overlap: int) -> Column:
    """Array of (start, end) windows of a stretch of a text.

    Starts are size - overlap apart; a window that stops inside the stretch goes back to its last space,
    if that lies in its second half."""
    step = size - overlap
    last = F.ceil(F.greatest(F.lit(0), hi - lo - size) / F.lit(float(step))).cast("int")
    starts = F.transform(F.sequence(F.lit(0), last), lambda m: lo + m * step)

    def window(i: Column) -> Column:
        far = F.least(hi, i + size)
        back = F.locate(" ", F.reverse(F.substring(text, i + 1, far - i)))
        space = far - back
        return F.struct(i.cast("int").alias("start"), F.when((far < hi) & (back > 0) & (space > i + size // 2), space).otherwise(far).cast("int").alias("end"))

    return F.when(hi > lo, F.transform(starts, window)).otherwise(F.array().cast("array<struct<start:int,end:int>>"))


def windows(df: DataFrame, id_col: str, text_col: str, size: int = 800, overlap: int = 120, markdown_col: str | None = None) -> DataFrame:
    """(id, seq, text, start, end, section): windows of each document; of Markdown ones, of each section.

    Blank windows are left out before numbering; text is stripped, start and end are of the window before that."""
    if size <= 0 or not 0 <= overlap < size:
        raise ValueError("size must be positive and overlap at least 0 and smaller")
    base = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), (F.col(markdown_col) if markdown_col else F.lit(False)).alias("md")).filter("text is not null")
    whole = F.array(F.struct(F.lit(0).alias("o"), F.lit("").alias("section"), F.lit(0).alias("lo"), F.length("text").alias("hi")))
    rows = base.filter("not coalesce(md, false)").select("id", "text", whole.alias("stretches"))
    if markdown_col:
        marked = base.filter("md").select("id", "text")
        own = sections(marked, "id", "text").groupBy("id").agg(F.collect_list(F.struct(F.col("ordinal").alias("o"), "section", F.col("start").alias("lo"), F.col("end").alias("hi"))).alias("stretches"))
        rows = rows.unionByName(marked.join(own, "id").select("id", "text", "stretches"))

    def pieces(s: Column) -> Column:
        piece = lambda w: F.struct(s["o"].alias("o"), s["section"].alias("section"), w["start"].alias("start"), w["end"].alias("end"), T.strip(F.substring(F.col("text"), w["start"] + 1, w["end"] - w["start"])).alias("text"))
        return F.transform(window_ends(F.col("text"), s["lo"], s["hi"], size, overlap), piece)

    # cut in the document's row: what is multiplied are the pieces, not the document
    cut = rows.select("id", F.explode(F.flatten(F.transform("stretches", pieces))).alias("p")).select("id", "p.*").filter("text <> ''")
    seq = F.row_number().over(W.partitionBy("id").orderBy("o", "start")) - 1
    return cut.withColumn("seq", seq.cast("int")).select("id", "seq", "text", "start", "end", "section")


def page_of(pages: Column, position: Column) -> Column:
    """Number of the last page that starts at or before a position; before all of them the first; without pages 1."""
    before = F.filter(pages, lambda p: p["start"] <= position)
    return F.coalesce(F.try_element_at(before, F.lit(-1))["page"], F.get(pages, F.lit(0))["page"], F.lit(1))


def coverage(chunks: DataFrame, id_col: str = "id") -> DataFrame:
    """(id, gaps, uncovered): places between neighbouring windows that are in none."""
    w = W.partitionBy(id_col).orderBy("start", "seq").rowsBetween(W.unboundedPreceding, -1)
    gap = F.greatest(F.lit(0), F.col("start") - F.max("end").over(w))
    return chunks.withColumn("gap", F.coalesce(gap, F.lit(0))).groupBy(id_col).agg(F.sum((F.col("gap") > 0).cast("int")).alias("gaps"), F.sum("gap").alias("uncovered"))
