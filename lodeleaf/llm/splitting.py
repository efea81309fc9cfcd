"""Splitting oversized texts at natural boundaries, by content-defined chunking.

A rolling hash over the last ``WINDOW`` code points marks landmarks; a piece ends at the first landmark
between the least and the greatest size, snapped to the nearest natural boundary: a heading or blank line
first, then a line end, a sentence end, a word end, and only in a stretch without any of these the landmark
itself.  Since landmarks and boundaries depend on nearby text only, an edit alters the pieces around it and
leaves the others as they are.  Each piece starts ``overlap`` code points before the end of the one before
it, or up to half as many more where a word starts there.

Texts of at most ``limit`` code points (without whitespace at both ends) and null texts give no piece.
Offsets are 0-based code points in the text as given; pieces carry no whitespace at their ends.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

LIMIT, OVERLAP = 800, 120
WINDOW, AVERAGE = 24, 128  # code points hashed; mean distance of landmarks

# The sentence ends that TESTDATA.md names.
ENDS = ".!?。！？।؟"
_CLOSERS = "\"'”’»)]」』）】》"
_CUTS = [  # kinds of boundaries from the best to the least
    ("section", re.compile(r"\n[^\S\n]*\n\s*|\n(?=#{1,6}\s)")),
    ("line", re.compile(r"[\n\r\f]+")),
    ("sentence", re.compile(rf"[!?。！？।؟…]+[{re.escape(_CLOSERS)}]*\s*|\.[{re.escape(_CLOSERS)}]*\s+")),
    ("word", re.compile(r"\s+")),
]
_SNAP = (300, 200, 160, 400)  # how far from a landmark a boundary of each kind may lie
_PIECES = pa.schema([("id", pa.string()), ("piece_no", pa.int32()), ("start_pos", pa.int32()), ("end_pos", pa.int32()), ("text", pa.string()), ("cut_at", pa.string()), ("forced", pa.int32())])


def landmarks(text: str) -> np.ndarray:
    """Offsets behind which the rolling hash has a landmark."""
    c = C.codes(text)
    if len(c) < WINDOW:
        return np.empty(0, np.int64)
    h = np.lib.stride_tricks.sliding_window_view(C.mix(c.astype(np.uint64) + np.uint64(1)), WINDOW)
    rolled = np.bitwise_xor.reduce(h << np.arange(WINDOW, dtype=np.uint64), axis=1)
    return np.flatnonzero(C.mix(rolled) % np.uint64(AVERAGE) == 0) + WINDOW


def _boundaries(text: str) -> list[np.ndarray]:
    return [np.array([m.end() for m in rx.finditer(text)], dtype=np.int64) for _, rx in _CUTS]


def _end(start: int, low: int, high: int, marks: np.ndarray, cuts: list[np.ndarray]) -> tuple[int, str]:
    """Where the piece from start ends: between low and high."""
    k = int(np.searchsorted(marks, low))
    mark = int(marks[k]) if k < len(marks) and marks[k] <= high else high
    for (kind, _), at, reach in zip(_CUTS, cuts, _SNAP, strict=True):
        near = at[np.searchsorted(at, max(low, mark - reach)) : np.searchsorted(at, min(high, mark + reach), side="right")]
        if len(near):
            return int(near[np.argmin(np.abs(near - mark))]), kind
    for (kind, _), at in zip(_CUTS, cuts, strict=True):  # none near the landmark: any in reach
        near = at[np.searchsorted(at, start + OVERLAP + 1) : np.searchsorted(at, high, side="right")]
        if len(near):
            return int(near[-1]), kind
    return mark, "landmark"


def pieces(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, str]]:
    """(start, end, kind of cut at the end) of the pieces of a text; one piece if it isn't longer than limit."""
    if not 0 <= overlap < limit // 2:
        raise ValueError("overlap must be at least 0 and less than half of limit")
    lead, stop = len(text) - len(text.lstrip()), len(text.rstrip())
    if stop - lead <= limit:
        return [(lead, stop, "end")] if stop > lead else []
    marks, cuts, out, start = landmarks(text), _boundaries(text), [], lead
    words = cuts[-1]
    while stop - start > limit:
        end, kind = _end(start, start + limit // 2, start + limit, marks, cuts)
        while end - 1 > start and text[end - 1].isspace():
            end -= 1
        out.append((start, end, kind))
        back = max(start + 1, end - overlap)
        k = int(np.searchsorted(words, back, side="right")) - 1
        if k >= 0 and words[k] > max(start, back - overlap // 2):
            back = int(words[k])
        while back < stop and text[back].isspace():
            back += 1
        start = back
    out.append((start, stop, "end"))
    return out


@cache
def _forced(limit: int) -> re.Pattern[str]:
    return re.compile(rf"[^\s{ENDS}]{{{limit + 1},}}")


def is_forced(text: str, limit: int = LIMIT) -> int:
    """1 if a stretch of more code points than the limit has no whitespace and no sentence end."""
    return int(_forced(limit).search(text) is not None)


def _split(batches: Iterator[pa.RecordBatch], limit: int, overlap: int) -> Iterator[pa.RecordBatch]:
    for batch in C.rechunk(batches, 256):
        rows = []
        for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if text is None or len(text.strip()) <= limit:
                continue
            forced = is_forced(text, limit)
            rows += [(i, k, a, b, text[a:b], kind, forced) for k, (a, b, kind) in enumerate(pieces(text, limit, overlap))]
        yield C.batch_of(_PIECES, *(map(list, zip(*rows, strict=True)) if rows else [[]] * 7))


def split(df: DataFrame, id_col: str, text_col: str, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(id, piece_no, start_pos, end_pos, text, cut_at, forced) of each text longer than limit; each id once."""
    long = df.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("t")).filter(F.length("t") > limit)
    long = long.groupBy("id").agg(F.min("t").alias("t"))
    return long.mapInArrow(lambda b: _split(b, limit, overlap), "id string, piece_no int, start_pos int, end_pos int, text string, cut_at string, forced int")


def split_chunks(chunks: DataFrame, registry: DataFrame, documents: DataFrame, sections: DataFrame) -> DataFrame:
    """The pieces of oversized chunks with offsets in their documents and the section of each.

    A chunk's start is kept if the document has the chunk's text there; else the text's first place in the
    document is taken.  Without the document (it isn't there, or no longer holds the text) start_pos is kept if end_pos fits it, and is null
    otherwise.  section: the deepest section over the piece's start; the chunk's own where there is none."""
    cols = ["chunk_id", "doc_id", "start_pos", "end_pos", "section", "text"]
    # of rows with one id the one whose text is cut
    row = F.min(F.struct("text", *(c for c in cols if c not in ("text", "chunk_id")))).alias("row")
    long = chunks.select(cols).filter(F.length("text") > LIMIT).groupBy("chunk_id").agg(row).select("chunk_id", "row.*")
    paths = registry.select("doc_id", "path").filter("path is not null").groupBy("doc_id").agg(F.min("path").alias("path"))
    whole = documents.select("path", F.col("text").alias("whole")).filter("path is not null").groupBy("path").agg(F.max("whole").alias("whole"))
    placed = long.join(paths, "doc_id", "left").join(whole, "path", "left")
    right = F.expr("substring(whole, start_pos + 1, length(text)) = text and start_pos >= 0")
    found = F.expr("nullif(locate(text, whole), 0) - 1")
    fits = F.when(F.expr("start_pos >= 0 and end_pos - start_pos = length(text)"), F.col("start_pos"))
    base = placed.select("chunk_id", "doc_id", "section", F.when(right, F.col("start_pos")).otherwise(F.coalesce(found, fits)).alias("base"))
    cut = split(chunks, "chunk_id", "text").withColumnRenamed("id", "chunk_id").join(base, "chunk_id")
    cut = cut.withColumns({"start_pos": (F.col("base") + F.col("start_pos")).cast("int"), "end_pos": (F.col("base") + F.col("end_pos")).cast("int")}).drop("base")
    cut = C.cut(cut)
    over = sections.select(F.col("doc_id").alias("d"), F.col("section").alias("within"), F.col("depth"), F.col("ordinal_no"), F.col("start_pos").alias("s"), F.col("end_pos").alias("e"))
    best = cut.join(over, (F.col("doc_id") == F.col("d")) & (F.col("s") <= F.col("start_pos")) & (F.col("start_pos") < F.col("e"))).groupBy("chunk_id", "piece_no").agg(F.max_by("within", F.struct("depth", "ordinal_no")).alias("within"))
    return cut.join(best, ["chunk_id", "piece_no"], "left").select("chunk_id", "piece_no", "doc_id", "start_pos", "end_pos", F.coalesce("within", "section").alias("section"), "cut_at", "forced", "text")
