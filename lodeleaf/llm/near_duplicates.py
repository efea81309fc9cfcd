"""Near-duplicate texts by an inverted join over signature coordinates.

Every text of at least 200 normalised code points gets a signature of ``COORDINATES`` coordinates; each
is a tuple of ``ROWS`` minima of a one-permutation MinHash over the 9-code-point substrings.  A text is
posted under each (coordinate, value), except that its ``SKIPPED`` longest lists are skipped: lists are ordered by
their lengths, as counters of a fixed number tell, which is one order for all texts, so that a pair with
``SKIPPED`` + ``MATCHES`` coordinates alike has at least ``MATCHES`` in the lists that are left (its prefix).  Collisions
in these are counted for each pair of texts, and pairs with ``MATCHES`` or more are held against the exact measure.
Equal texts are one class throughout: they are posted once as far as a task remembers, and come back as members of it.

A list of more than ``LONG`` texts, by its counter, is cut to blocks by a hash of the text, and each pair of blocks
is a cell of its own: a posting is sent to the cells of its block, and cells are spread over the tasks by a hash
of key and blocks.  So a list, however long, is no single task's work.

At a similarity of 0.6 a pair is lost with a probability of about 1 %, at 0.65 of 0.1 %, above 0.7 of less
than 0.01 %.  Nothing is capped.

Null, blank and short texts take no part; repeated rows of an id count once; an empty table gives an
empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

COORDINATES, ROWS, MATCHES, SKIPPED = 50, 4, 2, 2
LONG, COUNTERS = 2048, 1 << 18

_TEXTS = pa.schema([("id", pa.string()), ("fp", pa.int64()), ("norm", pa.string())])
_SIGNED = pa.schema([("fp", pa.int64()), ("keys", pa.list_(pa.int64()))])
_PAIRS = pa.schema([("a", pa.int64()), ("b", pa.int64())])
_POSTED = pa.schema([("cell", pa.int64()), ("side", pa.int8()), ("fp", pa.int64())])
_COUNTS = pa.schema([("counter", pa.int32()), ("n", pa.int64())])
_LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("similarity", pa.float64())])
_SEEN = 500_000  # fingerprints a task remembers, to post copies once


def _normalised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in C.rechunk(batches):
        out: tuple[list, list, list] = [], [], []
        for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if i is not None and t is not None and len(n := C.normalise(t)) >= C.MIN_CHARS:
                for column, x in zip(out, (i, C.fingerprint(n), n), strict=True):
                    column.append(x)
        yield C.batch_of(_TEXTS, *out)


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _normalised(batches):
        yield batch.select(["id", "fp"])


def _distinct_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts, each once as far as the task remembers."""
    seen: set[int] = set()
    for batch in _normalised(batches):
        fresh = []
        for fp in batch.column(1).to_pylist():
            fresh.append(fp not in seen)
            seen.add(fp)
        if len(seen) > _SEEN:
            seen.clear()
        yield batch.filter(pa.array(fresh, pa.bool_())).select(["fp", "norm"])


def signatures(texts: list[str]) -> np.ndarray:
    """A row of signed 64-bit keys for each normalised text, which has at least nine code points."""
    bins = COORDINATES * ROWS
    lengths = np.array([len(t) for t in texts])
    grams = C.gram_hashes(C.codes("".join(texts)))
    ends = np.cumsum(lengths)
    which = np.repeat(np.arange(len(texts)), lengths)[: len(grams)]
    inside = np.arange(len(grams)) + C.GRAM <= ends[which]
    grams, which = grams[inside], which[inside]
    cell = which * bins + (((grams >> np.uint64(32)) * np.uint64(bins)) >> np.uint64(32)).astype(np.int64)
    low = np.full(len(texts) * bins, np.iinfo(np.int64).max)
    np.minimum.at(low, cell, (grams & np.uint64(0xFFFFFFFF)).astype(np.int64))
    low = low.reshape(len(texts), bins)
    # an empty bin takes the value of the last filled one before it, in a circle, with the distance mixed in
    twice = np.concatenate((low, low), axis=1)
    at = np.maximum.accumulate(np.where(twice != np.iinfo(np.int64).max, np.arange(2 * bins), -1), axis=1)[:, bins:]
    away = np.arange(bins, 2 * bins) - at
    full = np.take_along_axis(twice, at, axis=1).astype(np.uint64) + away.astype(np.uint64) * np.uint64(0x632BE59BD9B4E019)
    parts = full.reshape(len(texts), COORDINATES, ROWS)
    key = np.broadcast_to(np.arange(1, COORDINATES + 1, dtype=np.uint64), parts.shape[:2]).copy()
    for r in range(ROWS):
        key = C.mix(key * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, r])
    return key.view(np.int64)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _distinct_texts(batches):
        for part in C.rechunk([batch], 256):  # arrays that stay in the processor's cache
            keys = signatures(part.column(1).to_pylist())
            offsets = np.arange(len(keys) + 1, dtype=np.int32) * COORDINATES
            yield C.batch_of(_SIGNED, part.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys.ravel())))


def _counter(keys: np.ndarray) -> np.ndarray:
    return (keys.view(np.uint64) >> np.uint64(20)) % np.uint64(COUNTERS)


def _lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many postings fall to each counter."""
    n = np.zeros(COUNTERS, dtype=np.int64)
    for batch in batches:
        n += np.bincount(_counter(batch.column(1).flatten().to_numpy()).astype(np.int64), minlength=COUNTERS)
    at = np.flatnonzero(n)
    yield C.batch_of(_COUNTS, at.astype(np.int32), n[at])


def _post(lengths: np.ndarray):
    """Signatures to postings (cell, side, fp) of all but the longest lists.

    Side 0: all pairs of a cell are pairs of its list; sides 1 and 2: those of one with the other."""

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in C.rechunk(batches, 4096):
            keys = batch.column(1).flatten().to_numpy().reshape(-1, COORDINATES)
            fp = batch.column(0).to_numpy()
            long = lengths[_counter(keys)]
            # by length, then key: one order of lists for all texts
            order = np.lexsort((keys, long), axis=1)[:, : COORDINATES - SKIPPED]
            keys, long = np.take_along_axis(keys, order, 1).ravel(), np.take_along_axis(long, order, 1).ravel()
            fp = np.repeat(fp, COORDINATES - SKIPPED)
            blocks = -(-long // LONG)
            one = blocks <= 1
            yield C.batch_of(_POSTED, keys[one], np.zeros(int(one.sum()), np.int8), fp[one])
            at = np.flatnonzero(~one)
            while len(at):  # some at a time: each is sent to as many cells as its list has blocks
                some, at = at[: max(1, 1_000_000 // int(blocks[at].max()))], at[max(1, 1_000_000 // int(blocks[at].max())) :]
                b = blocks[some]
                row = np.repeat(some, b)
                other = np.arange(len(row)) - np.repeat(np.cumsum(b) - b, b)
                own = (C.mix(fp[row].view(np.uint64).copy()) % blocks[row].astype(np.uint64)).astype(np.int64)
                low, high = np.minimum(own, other), np.maximum(own, other)
                cell = C.mix(keys[row].view(np.uint64) + C.mix((low * (1 << 31) + high + 1).view(np.uint64))).view(np.int64)
                yield C.batch_of(_POSTED, cell, np.where(own == other, 0, np.where(own < other, 1, 2)).astype(np.int8), fp[row])

    return post


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of sorted postings (cell, side, fp), whole cells, repetitions left out."""
    held = [np.empty(0, np.int64), np.empty(0, np.int8), np.empty(0, np.int64)]
    for batch in batches:
        held = [np.concatenate((h, batch.column(k).to_numpy(zero_copy_only=False))) for k, h in enumerate(held)]
        cell, side, fp = held
        if not len(cell):
            continue
        keep = np.r_[True, (cell[1:] != cell[:-1]) | (side[1:] != side[:-1]) | (fp[1:] != fp[:-1])]
        cell, side, fp = (h[keep] for h in held)
        last = int(np.searchsorted(cell, cell[-1]))
        yield cell[:last], side[:last], fp[:last]
        held = [cell[last:], side[last:], fp[last:]]
    yield tuple(held)


def _collide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs of texts of each list, once for each list that both are in."""
    triangles: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def pairs(left: np.ndarray, right: np.ndarray) -> pa.RecordBatch:
        return C.batch_of(_PAIRS, np.minimum(left, right), np.maximum(left, right))

    for cell, side, fp in _cells(batches):
        if not len(cell):
            continue
        starts = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
        sizes = np.diff(np.r_[starts, len(cell)])
        crossed = np.maximum.reduceat(side, starts) > 0
        for n in np.unique(sizes[~crossed]):
            if n < 2:
                continue  # a list of one text gives no pair
            own = starts[~crossed & (sizes == n)]
            if n <= 64:
                x, y = triangles.setdefault(int(n), np.triu_indices(int(n), 1))
                step = max(1, 200_000 // len(x))
                for at in range(0, len(own), step):
                    yield pairs(fp[(own[at : at + step, None] + x).ravel()], fp[(own[at : at + step, None] + y).ravel()])
            else:
                for s in own:
                    for i in range(int(n) - 1):
                        yield pairs(np.full(int(n) - 1 - i, fp[s + i]), fp[s + i + 1 : s + n])
        for s, n in zip(starts[crossed], sizes[crossed], strict=True):
            one, two = (fp[s : s + n][side[s : s + n] == k] for k in (1, 2))
            step = max(1, 200_000 // max(1, len(two)))
            for at in range(0, len(one) if len(two) else 0, step):
                yield pairs(np.repeat(one[at : at + step], len(two)), np.tile(two, len(one[at : at + step])))


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in C.rechunk(batches, 1024):
        sets: dict[int, np.ndarray] = {}
        out: tuple[list, list, list] = [], [], []
        a, b, left, right = (batch.column(n).to_pylist() for n in ("a", "b", "norm_a", "norm_b"))
        for i, j, s, t in zip(a, b, left, right, strict=True):
            for fp, text in ((i, s), (j, t)):
                if fp not in sets:
                    sets[fp] = C.gram_set(text)
            if (x := C.jaccard(sets[i], sets[j])) >= C.SIMILAR:
                for column, v in zip(out, (i, j, x), strict=True):
                    column.append(v)
        yield C.batch_of(_LINKS, *out)


def members(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, fp): fp is the class of equal normalised texts; each id once for each of its texts."""
    return df.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("t")).mapInArrow(_members, "id string, fp long").distinct()


def links(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(a, b, similarity): the pairs of different classes that are alike, smaller fp first."""
    source = df.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("t"))
    signed = C.cut(source.mapInArrow(_sign, "fp long, keys array<long>"))
    lengths = np.zeros(COUNTERS, dtype=np.int64)
    counted = signed.mapInArrow(_lengths, "counter int, n long").groupBy("counter").agg(F.sum("n").alias("n")).toArrow()  # at most COUNTERS rows
    lengths[counted.column(0).to_numpy()] = counted.column(1).to_numpy()
    postings = signed.mapInArrow(_post(lengths), "cell long, side byte, fp long").repartition("cell").sortWithinPartitions("cell", "side", "fp")
    candidates = postings.mapInArrow(_collide, "a long, b long").groupBy("a", "b").agg(F.count("*").alias("n")).filter(F.col("n") >= MATCHES).select("a", "b")
    texts = source.mapInArrow(_distinct_texts, "fp long, norm string").dropDuplicates(["fp"])
    left, right = (texts.select(F.col("fp").alias(x), F.col("norm").alias(f"norm_{x}")) for x in "ab")
    return candidates.join(left, "a").join(right, "b").mapInArrow(_verify, "a long, b long, similarity double")


def found_pairs(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id_a, id_b): all pairs of different ids whose texts are alike, copies included, smaller id first."""
    m = members(df, id_col, text_col)
    x, y = m.select(F.col("fp").alias("a"), F.col("id").alias("x")), m.select(F.col("fp").alias("b"), F.col("id").alias("y"))
    same = x.join(y, (F.col("a") == F.col("b")) & (F.col("x") < F.col("y"))).select("x", "y")
    cross = C.cut(links(df, id_col, text_col)).select("a", "b").join(x, "a").join(y, "b").filter("x <> y")
    return same.union(cross.select(F.least("x", "y"), F.greatest("x", "y"))).distinct().toDF("id_a", "id_b")


def classes(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row for each id: class_id (its smallest id), copies (ids in the class), n_links (other classes alike)."""
    m = members(df, id_col, text_col)
    found = links(df, id_col, text_col)
    degree = found.select(F.col("a").alias("fp")).union(found.select("b")).groupBy("fp").agg(F.count("*").alias("n_links"))
    group = m.groupBy("fp").agg(F.min("id").alias("class_id"), F.count("*").alias("copies"))
    return m.join(group.join(degree, "fp", "left"), "fp").select("id", "class_id", "copies", F.coalesce("n_links", F.lit(0)).alias("n_links"))
