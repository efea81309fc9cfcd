"""Filling containers of fixed capacity with neighbouring documents along a space-filling curve.

A document becomes a vector of hashed 4-code-point substrings, projected to four dimensions by fixed random
signs; its place on a Hilbert curve through them is its key.  Documents are range-sorted by the key, so each
task holds a stretch of the curve, and packed in its order by best fit into a bounded number of open
containers; when these run out, the fullest is closed.  What is open at the end of a stretch is packed again,
largest first.  Waste is therefore a few containers for each task, whatever the number of documents.

Only a document longer than the capacity is split: into full containers and a rest, which is packed as an
item.  Null and empty texts have no tokens and are left out.  Equal documents have the same key and are
spread by a hash of their id, so a hot group is many stretches.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from . import tokens as T

GRAM, BUCKETS, DIMS, BITS = 4, 256, 4, 8
OPEN = 256  # open containers of a task
_PACKED = pa.schema([("container", pa.string()), ("bin_id", pa.string()), ("doc_id", pa.int64()), ("part_no", pa.int32()), ("start_token", pa.int64()), ("n_tokens", pa.int64()), ("capacity", pa.int64())])
PACKED_DDL = "container string, bin_id string, doc_id long, part_no int, start_token long, n_tokens long, capacity long"
_SIGNS = np.where(C.mix(np.arange(1, BUCKETS * DIMS + 1, dtype=np.uint64)) & np.uint64(1), 1.0, -1.0).reshape(BUCKETS, DIMS)


def project(texts: list[str | None]) -> np.ndarray:
    """Points in [0, 1) of so many dimensions."""
    lengths = np.array([len(t or "") for t in texts])
    joined = "".join(t or "" for t in texts)
    out = np.full((len(texts), DIMS), 0.5)
    if len(joined) < GRAM:
        return out
    c = C.codes(joined).astype(np.uint64)
    h = np.zeros(len(c) - GRAM + 1, dtype=np.uint64)
    for k in range(GRAM):
        h = h * np.uint64(0x9E3779B97F4A7C15) + c[k : len(c) - GRAM + 1 + k]
    h = C.mix(h)
    which = np.repeat(np.arange(len(texts)), lengths)[: len(h)]
    ends = np.cumsum(lengths)
    inside = np.arange(len(h)) + GRAM <= ends[which]
    cell = which[inside] * BUCKETS + (h[inside] % np.uint64(BUCKETS)).astype(np.int64)
    sign = np.where(h[inside] >> np.uint64(40) & np.uint64(1), 1.0, -1.0)
    v = np.bincount(cell, sign, len(texts) * BUCKETS).reshape(len(texts), BUCKETS)
    norm = np.linalg.norm(v, axis=1, keepdims=True)
    p = (v / np.maximum(norm, 1e-9)) @ _SIGNS
    return np.clip(0.5 + p / 6, 0, np.nextafter(1, 0))


def hilbert(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place on the Hilbert curve of points in [0, 1), by Skilling's transposition."""
    x = (points * (1 << bits)).astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            high = (x[i] & q) != 0
            t = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0] ^ t)
            x[i] ^= t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where(x[n - 1] & q, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def _keys(texts: list[str | None]) -> dict[str, pa.Array]:
    return {"curve": pa.array(hilbert(project(texts)))}


class _Bins:
    """Best fit into at most OPEN open containers."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.open: list[tuple[int, int]] = []  # (room, no.), by room
        self.items: dict[int, list] = {}
        self.made = 0

    def put(self, item: tuple) -> list[list]:
        """The containers that this closes."""
        size, closed = item[3], []
        k = bisect_left(self.open, (size, -1))
        if k < len(self.open):
            room, no = self.open.pop(k)
        else:
            if len(self.open) >= OPEN:
                closed.append(self.items.pop(self.open.pop(0)[1]))
            room, no = self.capacity, self.made
            self.made += 1
            self.items[no] = []
        self.items[no].append(item)
        if room - size:
            insort(self.open, (room - size, no))
        else:
            closed.append(self.items.pop(no))
        return closed

    def rest(self) -> list[list]:
        """What is open, packed again, largest items first."""
        again = _Bins(self.capacity)
        items = sorted((x for no in sorted(self.items) for x in self.items[no]), key=lambda x: -x[3])
        out = [b for x in items for b in again.put(x)]
        return out + list(again.items.values())


def _pack(limits: list[tuple[str, int]]):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        bins = {name: _Bins(capacity) for name, capacity in limits}
        numbers = dict.fromkeys(bins, 0)

        def rows(name: str, full: list[list]) -> list[tuple]:
            out = []
            for b in full:
                bin_id = f"{name}-{task:05d}-{numbers[name]:08d}"
                numbers[name] += 1
                out += [(name, bin_id, *x, bins[name].capacity) for x in b]
            return out

        def batch_of(out: list[tuple]) -> pa.RecordBatch:
            return C.batch_of(_PACKED, *(map(list, zip(*out, strict=True)) if out else [[]] * 7))

        for batch in batches:
            out = []
            for doc_id, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for name, capacity in limits:
                    full, left = divmod(n, capacity)
                    for part in range(full):
                        out += rows(name, [[(doc_id, part, part * capacity, capacity)]])
                    if left:
                        out += rows(name, bins[name].put((doc_id, full, full * capacity, left)))
                if len(out) > 20_000:
                    yield batch_of(out)
                    out = []
            yield batch_of(out)
        for name, b in bins.items():
            yield batch_of(rows(name, b.rest()))

    return pack


def sized(documents: DataFrame, id_col: str, text_col: str, tokenizer: str = T.DEFAULT) -> DataFrame:
    """(doc_id, n_tokens, curve)."""
    rows = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).filter(F.length("text") > 0)
    return rows.mapInArrow(lambda b: T.counts(b, tokenizer, _keys), "doc_id long, n_tokens long, curve long")


def pack(documents: DataFrame, limits: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = T.DEFAULT, rows_per_task: int = 250_000) -> DataFrame:
    """(container, bin_id, doc_id, part_no, start_token, n_tokens, capacity): a row for each item in a container.

    limits: (container, capacity_tokens), a table of fixed size; more than 1,000 sizes are refused."""
    sizes = [(r[0], r[1]) for r in limits.filter("container is not null and capacity_tokens > 0").groupBy("container").agg(F.max("capacity_tokens").cast("int")).orderBy("container").limit(1001).collect()]
    if len(sizes) > 1000:
        raise ValueError("more than 1,000 container sizes")
    items = C.cut(sized(documents, id_col, text_col, tokenizer))
    tasks = max(1, min(-(-items.count() // rows_per_task), 100_000))
    spread = F.xxhash64("doc_id").alias("spread")
    along = items.select("doc_id", "n_tokens", "curve", spread).repartitionByRange(tasks, "curve", "spread").sortWithinPartitions("curve", "spread")
    return along.select("doc_id", "n_tokens").mapInArrow(_pack(sizes), PACKED_DDL)


def curves(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, curve): the place of each document on the curve, as a number."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in C.rechunk(batches, 512):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(hilbert(project(batch.column(1).to_pylist())).astype(np.float64))], names=["doc_id", "curve"])

    rows = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).filter(F.length("text") > 0)
    return rows.mapInArrow(place, "doc_id long, curve double")


def report(packed: DataFrame, places: DataFrame | None = None) -> DataFrame:
    """(container, capacity, n_bins, n_items, n_tokens, unused_share, spread) of each container size.

    spread: of containers with several documents, the mean standard deviation of their places on the curve, as a share of that of all
    documents: about 1 for documents put together at random, little for neighbours.  Null without places (doc_id, curve)."""
    if places is None:
        items = packed.withColumn("curve", F.lit(None).cast("double"))
    else:
        items = packed.join(places.groupBy("doc_id").agg(F.max("curve").alias("curve")), "doc_id", "left")
    by_bin = items.groupBy("container", "bin_id").agg(F.sum("n_tokens").alias("n"), F.max("capacity").alias("capacity"), F.count("*").alias("items"), F.stddev_samp("curve").alias("own"), F.count("curve").alias("k"), F.sum("curve").alias("s"), F.sum(F.col("curve") * F.col("curve")).alias("ss"))
    unused = 1 - F.sum("n") / F.sum("capacity")
    of_all = F.sqrt(F.sum("ss") / F.sum("k") - (F.sum("s") / F.sum("k")) ** 2)
    spread = F.avg(F.when(F.col("k") > 1, F.col("own"))) / F.nullif(of_all, F.lit(0.0))
    return by_bin.groupBy("container").agg(F.max("capacity").alias("capacity"), F.count("*").alias("n_bins"), F.sum("items").alias("n_items"), F.sum("n").alias("n_tokens"), F.round(unused, 6).alias("unused_share"), F.round(spread, 3).alias("spread"))
