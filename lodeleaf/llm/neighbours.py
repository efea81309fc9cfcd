"""The most similar vectors of every vector, from balanced posting lists.

Vectors are compared within one embedder and dimension.  Centroids are trained on a bounded sample
(``EACH`` vectors for each list, from ``SAMPLE`` to ``MOST_SAMPLE`` of a group) and kept balanced; every vector is then put into up to ``COPIES`` lists: the
nearest one and further ones that a distance ratio admits, so that boundary vectors stand in several.
Lists are found by a beam search over a graph of the centroids that each task holds in memory.  A graph of neighbours alone
falls apart into islands, so the search begins at the centroids of the nearest hubs, of which all are compared; up to
``HUBS`` centroids every one is its own hub.

The number of lists grows with the vectors, so that a list has ``LIST`` of them before copies: up to ``MOST_LISTS``
lists directly, and beyond that (some 25 million vectors) by a second level.  A list that the sample shows
to be longer than ``CELL``, whether there are too many vectors or too many in one place, gets centroids of its own,
trained on a bounded sample of it in its task, and its vectors are placed again, in ``COPIES_BELOW`` lists each;
the work on a list is spread over tasks.  Each list is one task's piece of work, in blocks of rows.

Equal vectors are one class, of which the k + 1 smallest ids are enough for any answer, so that a hot group of
copies is one row.  What is sent is 16 bits for each number, which leaves an error of about 1e-5 in a cosine.

Null ids, vectors that are null, of another size than ``dim``, not finite or all zero take no part.  Repeated
rows of an id count once for each different vector.  Ties go to the smaller id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common as C

LIST, CELL = 1500, 18_000  # vectors aimed at for a list before copies; in a list with copies, from which it is divided
COPIES, COPIES_BELOW, RATIO = 4, 2, 1.35  # lists of a vector, also of a list that is divided; how far beyond the nearest, as a ratio of distances
SAMPLE, MOST_SAMPLE, EACH, ROUNDS, MOST_LISTS = 32_768, 131_072, 16, 8, 16_384
DEGREE, BEAM = 24, 12
HUBS, NEAR_HUBS, OF_HUB = 4096, 6, 16  # most hubs; hubs at which a search begins, with so many centroids each
SPREAD = 500_000  # vectors of a list that is divided for each task

_PACKED = pa.schema([("id", pa.string()), ("embedder", pa.string()), ("dim", pa.int32()), ("fp", pa.int64()), ("packed", pa.binary())])
_PLACED = pa.schema([("cell", pa.int64()), ("fp", pa.int64()), ("packed", pa.binary())])
_PLACED_DDL = "cell long, fp long, packed binary"
_NEAR = pa.schema([("fp", pa.int64()), ("others", pa.list_(pa.int64())), ("similarities", pa.list_(pa.float32()))])
_NEAR_DDL = "fp long, others array<long>, similarities array<float>"


def usable(df: DataFrame, id_col: str, vec_col: str, dim_col: str, embedder_col: str) -> DataFrame:
    v = F.col(vec_col)
    rows = df.select(F.col(id_col).cast("string").alias("id"), F.coalesce(embedder_col, F.lit("")).alias("embedder"), F.col(dim_col).cast("int").alias("dim"), v.cast("array<double>").alias("vec"))
    return rows.filter(F.col("id").isNotNull() & F.col("vec").isNotNull() & (F.size("vec") == F.col("dim")) & (F.col("dim") > 0))


def pack(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors as 16-bit numbers with a factor each."""
    top = np.abs(vectors).max(axis=1)
    return np.rint(vectors * (32767 / top)[:, None]).astype(np.int16), (top / 32767).astype(np.float32)


def unpack(packed: list[bytes], dim: int) -> np.ndarray:
    raw = np.frombuffer(b"".join(packed), dtype=np.uint8).reshape(len(packed), 4 + 2 * dim)
    factor = np.ascontiguousarray(raw[:, :4]).view(np.float32)
    out = np.ascontiguousarray(raw[:, 4:]).view(np.int16).astype(np.float32) * factor
    return out / np.linalg.norm(out, axis=1, keepdims=True)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in C.rechunk(batches):
        dims = batch.column(2).to_numpy(zero_copy_only=False)
        for dim in np.unique(dims):
            part = batch.filter(pa.array(dims == dim))
            lists = part.column(3)
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(part.num_rows, int(dim))
            with np.errstate(invalid="ignore", over="ignore"):
                top = np.abs(flat).max(axis=1)
                ok = np.isfinite(flat).all(axis=1) & (top > 0)
            if not ok.any():
                continue
            flat = flat[ok] / top[ok, None]
            numbers, factor = pack(flat / np.linalg.norm(flat, axis=1, keepdims=True))
            rows = [f.tobytes() + n.tobytes() for f, n in zip(factor, numbers, strict=True)]
            part = part.filter(pa.array(ok))
            fps = [xxhash.xxh3_64_intdigest(r + repr((e, int(dim))).encode()) for r, e in zip(rows, part.column(1).to_pylist(), strict=True)]
            yield C.batch_of(_PACKED, part.column(0), part.column(1), part.column(2), np.array(fps, dtype=np.uint64).view(np.int64), rows)


def train(sample: np.ndarray, n_lists: int, seed: int = 7) -> np.ndarray:
    """Balanced spherical k-means: lists that are too long are split, and the shortest dissolved."""
    rng = np.random.default_rng(seed)
    centroids = sample[rng.choice(len(sample), min(n_lists, len(sample)), replace=False)]
    for turn in range(ROUNDS):
        near = np.concatenate([np.argmax(sample[a : a + 4096] @ centroids.T, axis=1) for a in range(0, len(sample), 4096)])
        sizes = np.bincount(near, minlength=len(centroids))
        sums = np.zeros_like(centroids)
        np.add.at(sums, near, sample)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        centroids = np.where(norm > 0, sums / np.maximum(norm, 1e-12), centroids)
        if turn < ROUNDS - 2 and len(centroids) > 3:
            long = np.argsort(-sizes)[: max(1, len(centroids) // 16)]
            long = long[sizes[long] > 2 * sizes.mean()]
            for give, take in zip(np.argsort(sizes), long, strict=False):
                if sizes[give] < 0.5 * sizes.mean():
                    centroids[give] = sample[rng.choice(np.flatnonzero(near == take))]
    return np.ascontiguousarray(centroids, dtype=np.float32)


def train_many(sample: np.ndarray, n_lists: int) -> np.ndarray:
    """The same for many lists, of parts of the sample that are near one another."""
    if n_lists <= HUBS:
        return train(sample, n_lists)
    parts = train(sample, max(2, n_lists // 128))
    near = np.concatenate([np.argmax(sample[a : a + 4096] @ parts.T, axis=1) for a in range(0, len(sample), 4096)])
    each = [sample[near == k] for k in range(len(parts))]
    return np.concatenate([train(x, max(1, round(n_lists * len(x) / len(sample)))) for x in each if len(x)])


class CentroidGraph:
    """Centroids with links from each to its nearest ones; searched by a beam from the nearest hubs."""

    def __init__(self, centroids: np.ndarray):
        self.centroids, self.hubs = centroids, None
        n = len(centroids)
        if n <= HUBS:
            return
        self.links = np.zeros((n, DEGREE), dtype=np.int32)
        for a in range(0, n, 1024):
            s = centroids[a : a + 1024] @ centroids.T
            s[np.arange(len(s)), np.arange(a, a + len(s))] = -9
            self.links[a : a + 1024] = np.argpartition(-s, DEGREE - 1, axis=1)[:, :DEGREE]
        self.hubs = train(centroids, min(HUBS, n // 8))
        self.of_hub = np.concatenate([np.argpartition(-(self.hubs[a : a + 256] @ centroids.T), OF_HUB - 1, axis=1)[:, :OF_HUB] for a in range(0, len(self.hubs), 256)]).astype(np.int32)

    def entries(self, x: np.ndarray) -> np.ndarray:
        """Centroids of the nearest hubs, of each row once; -1 instead of repetitions."""
        near = np.argpartition(-(x @ self.hubs.T), NEAR_HUBS - 1, axis=1)[:, :NEAR_HUBS]
        ids = np.sort(self.of_hub[near].reshape(len(x), -1).astype(np.int64), axis=1)
        ids[:, 1:][ids[:, 1:] == ids[:, :-1]] = -1
        return ids

    def search(self, x: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
        """(ids, similarities) of the nearest centroids found for each row, best first; -1 where there are fewer."""
        q, n = len(x), len(self.centroids)
        rows = np.arange(q)[:, None]
        if self.hubs is None:
            score = x @ self.centroids.T
            ids = np.argpartition(-score, beam - 1, axis=1)[:, :beam] if n > beam else np.broadcast_to(np.arange(n), (q, n))
            order = np.argsort(-score[rows, ids], axis=1)
            ids = ids[rows, order]
            return ids, score[rows, ids]
        seen = np.zeros((q, n), dtype=bool)
        ids = self.entries(x)
        score = np.where(ids >= 0, np.einsum("qd,qnd->qn", x, self.centroids[ids]), np.float32(-9))
        done = ids < 0
        seen[np.nonzero(~done)[0], ids[~done]] = True
        for _ in range(4 * beam):
            order = np.argsort(-score, axis=1)[:, :beam]
            ids, score, done = ids[rows, order], score[rows, order], done[rows, order]
            best = np.argmin(done, axis=1)  # the first that isn't expanded
            active = np.flatnonzero(~done[np.arange(q), best])
            if not len(active):
                break
            done[active, best[active]] = True
            new = self.links[ids[active, best[active]]]
            fresh = ~seen[active[:, None], new]
            seen[active[:, None], new] = True
            got = np.einsum("qd,qnd->qn", x[active], self.centroids[new])
            more_ids = np.full((q, new.shape[1]), -1, dtype=np.int64)
            more, closed = np.full((q, new.shape[1]), -9.0, dtype=np.float32), np.ones((q, new.shape[1]), dtype=bool)
            more_ids[active], more[active], closed[active] = np.where(fresh, new, -1), np.where(fresh, got, -9), ~fresh
            ids, score, done = np.hstack((ids, more_ids)), np.hstack((score, more)), np.hstack((done, closed))
        return ids, score


def lists_of(graph: CentroidGraph, x: np.ndarray, copies: int = COPIES) -> tuple[np.ndarray, np.ndarray]:
    """(row, list) pairs: up to so many lists of each vector, as far as the ratio of distances admits."""
    ids, score = graph.search(x)
    ids, score = ids[:, :copies], score[:, :copies]
    distance = np.sqrt(np.maximum(2 - 2 * score, 0))
    keep = (ids >= 0) & (distance <= np.maximum(distance[:, :1], 0.05) * RATIO)
    keep[:, 0] = True
    row, column = np.nonzero(keep)
    return row, ids[row, column]


def _place(groups: dict[tuple[str, int], tuple[int, CentroidGraph]], copies: int):
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in C.rechunk(batches, 1024):
            keep = [fp not in seen for fp in batch.column(3).to_pylist()]
            seen.update(batch.column(3).to_pylist())
            if len(seen) > 500_000:
                seen.clear()
            batch = batch.filter(pa.array(keep, pa.bool_()))
            names = list(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True))
            for name in sorted(set(names) & set(groups)):
                part = batch.filter(pa.array([n == name for n in names]))
                base, graph = groups[name]
                row, which = lists_of(graph, unpack(part.column(4).to_pylist(), name[1]), copies)
                yield C.batch_of(_PLACED, which + base, part.column(3).take(pa.array(row)), part.column(4).take(pa.array(row)))

    return place


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Of sorted rows, those of each first column."""
    held: list[pa.RecordBatch] = []
    current = None
    for batch in batches:
        keys = batch.column(0).to_numpy()
        edges = np.r_[0, np.flatnonzero(keys[1:] != keys[:-1]) + 1, len(keys)]
        for a, b in zip(edges, edges[1:], strict=False):
            if a == b:
                continue
            if held and keys[a] != current:
                yield pa.Table.from_batches(held)
                held = []
            current = keys[a]
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def _kth(sim: np.ndarray, k: int) -> np.ndarray:
    """Of each row a bound that at least k of its values reach; for long rows the k-th of the greatest of 16 each."""
    if sim.shape[1] <= 32 * k or sim.shape[1] % 16:
        return np.partition(sim, sim.shape[1] - k, axis=1)[:, sim.shape[1] - k]
    top = sim.reshape(len(sim), 16, -1).max(axis=1)
    return np.partition(top, top.shape[1] - k, axis=1)[:, top.shape[1] - k]


def _nearest(k: int, least: float):
    def rank(sim: np.ndarray, left: np.ndarray, right: np.ndarray) -> pa.RecordBatch:
        """Of each row, its k best columns of at least the least similarity; ties with the k-th stay in."""
        bound = np.full(len(sim), max(least, -2.0), dtype=np.float32)
        busy = np.flatnonzero((sim >= least).sum(axis=1) > k) if least > -1 else np.arange(len(sim))
        if len(busy) and sim.shape[1] > k:
            bound[busy] = np.maximum(bound[busy], _kth(sim[busy], k))
        x, y = np.nonzero(sim >= bound[:, None])
        s = sim[x, y]
        order = np.lexsort((-s, x))
        x, y, s = x[order], y[order], s[order]
        first = np.searchsorted(x, np.arange(len(sim)))
        last = s[np.minimum(first[x] + k - 1, len(s) - 1)]
        kept = (np.arange(len(x)) - first[x] < k) | (s == last)
        x, y, s = x[kept], y[kept], s[kept]
        rows, first = np.unique(x, return_index=True)
        offsets = pa.array(np.r_[first, len(x)].astype(np.int32))
        return C.batch_of(_NEAR, left[rows], pa.ListArray.from_arrays(offsets, pa.array(right[y])), pa.ListArray.from_arrays(offsets, pa.array(s.astype(np.float32))))

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _runs(batches):
            fp, first = np.unique(t.column(1).to_numpy(), return_index=True)
            packed = t.column(2).combine_chunks().take(pa.array(first)).to_pylist()
            m, more = len(fp), -len(fp) % 16
            x = unpack(packed, (len(packed[0]) - 4) // 2)
            x = np.concatenate((x, np.zeros((more, x.shape[1]), dtype=x.dtype)))
            step = max(16, min(1024, 8_000_000 // len(x)))
            for a in range(0, m, step):
                sim = x[a : min(m, a + step)] @ x.T
                sim[np.arange(len(sim)), np.arange(a, a + len(sim))] = -3
                sim[:, m:] = -3
                yield rank(sim, fp[a : a + step], np.r_[fp, np.zeros(more, np.int64)])

    return near


def _train_lists(n_lists: dict[int, int]):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The sampled vectors of each list to its centroids."""
        for t in _runs(batches):
            cell, packed = t.column(0)[0].as_py(), sorted(set(t.column(2).to_pylist()))
            x = unpack(packed, (len(packed[0]) - 4) // 2)
            centroids = train(x, max(1, min(n_lists[cell], len(x) // 4)))
            yield pa.RecordBatch.from_arrays([pa.array([cell], pa.int64()), pa.array([centroids.tobytes()], pa.binary())], names=["cell", "packed"])

    return work


def _place_below(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each list its centroids first (fp null), then its vectors."""
    current, blob, graph = None, None, None
    for batch in C.rechunk(batches, 1024):
        cells, none = batch.column(0).to_numpy(), np.asarray(batch.column(1).is_null())
        edges = np.r_[0, np.flatnonzero((cells[1:] != cells[:-1]) | none[1:] | none[:-1]) + 1, len(cells)]
        for a, b in zip(edges, edges[1:], strict=False):
            if none[a]:
                if cells[a] != current:
                    current, blob, graph = cells[a], batch.column(2)[int(a)].as_py(), None
                continue
            part = batch.slice(a, b - a)
            if cells[a] != current:  # nothing was sampled of it
                current, blob = cells[a], None
            if blob is None:
                row, which = np.arange(b - a), np.zeros(b - a, np.int64)
            else:
                packed = part.column(2).to_pylist()
                dim = (len(packed[0]) - 4) // 2
                graph = graph or CentroidGraph(np.frombuffer(blob, dtype=np.float32).reshape(-1, dim))
                row, which = lists_of(graph, unpack(packed, dim), COPIES_BELOW)
            yield C.batch_of(_PLACED, (1 << 40) + int(current) * (1 << 16) + which, part.column(1).take(pa.array(row)), part.column(2).take(pa.array(row)))


def _divided(placed: DataFrame, sizes: dict[int, float]) -> DataFrame:
    """The rows of lists that are too long, in lists below them.  sizes: of each such list, at most MOST_LISTS of a group."""
    spark = placed.sparkSession
    n_lists = {c: int(min(1 << 15, -(-n * COPIES_BELOW // (LIST * COPIES)))) for c, n in sizes.items()}
    plan = spark.createDataFrame([(c, min(1.0, max(4096, 16 * n_lists[c]) / n), max(1, int(n // SPREAD))) for c, n in sizes.items()], "cell long, rate double, salts int")
    rows = placed.join(F.broadcast(plan), "cell")
    drawn = F.pmod(F.xxhash64("fp", F.lit(3)), F.lit(1 << 20)) < F.col("rate") * (1 << 20)
    sample = rows.filter(drawn).select("cell", "fp", "packed").repartition("cell").sortWithinPartitions("cell")
    trained = C.cut(sample.mapInArrow(_train_lists(n_lists), "cell long, packed binary"))
    first = trained.join(F.broadcast(plan), "cell").select("cell", F.lit(None).cast("long").alias("fp"), "packed", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    rest = rows.select("cell", "fp", "packed", F.pmod(F.xxhash64("fp", F.lit(5)), F.col("salts")).cast("int").alias("salt"))
    ordered = first.union(rest).repartition("cell", "salt").sortWithinPartitions("cell", "salt", F.col("fp").asc_nulls_first())
    return ordered.select("cell", "fp", "packed").mapInArrow(_place_below, _PLACED_DDL)


def nearest_classes(packed: DataFrame, sizes: dict[tuple[str, int], int], k: int, least: float, list_size: int, copies: int) -> DataFrame:
    """(fp, other, similarity): for each class of equal vectors its k nearest other classes."""
    spark = packed.sparkSession
    groups, base, long = {}, 0, {}
    for (embedder, dim), n in sorted(sizes.items()):
        n_lists = max(1, min(MOST_LISTS, round(n / list_size)))
        most = min(MOST_SAMPLE, max(SAMPLE, EACH * n_lists))
        rate = min(1.0, most / n)
        picked = packed.filter((F.col("embedder") == embedder) & (F.col("dim") == dim) & (F.pmod(F.xxhash64("fp"), F.lit(1_000_003)) < int(rate * 1_000_003) + 1))
        rows = [bytes(r[0]) for r in picked.select("packed").dropDuplicates().limit(2 * most).collect()]  # bounded: most on average
        if not rows:
            continue
        sample = unpack(rows, dim)
        centroids = train_many(sample, max(1, min(n_lists, len(sample) // 8)))
        graph = CentroidGraph(centroids)
        which = np.concatenate([lists_of(graph, sample[a : a + 1024], copies)[1] for a in range(0, len(sample), 1024)])
        share = np.bincount(which, minlength=len(centroids)) * (n / len(sample))
        long |= {base + int(c): float(share[c]) for c in np.flatnonzero(share > CELL)}
        groups[(embedder, dim)] = (base, graph)
        base += len(centroids)
    if not groups:
        return spark.createDataFrame([], "fp long, other long, similarity double")
    placed = packed.mapInArrow(_place(groups, copies), _PLACED_DDL)
    if long:
        placed = placed.filter(~F.col("cell").isin(sorted(long))).union(_divided(placed, long))
    near = placed.repartition("cell").sortWithinPartitions("cell").mapInArrow(_nearest(k, least), _NEAR_DDL)
    # a row for each vector and list is sent, once; what follows is by fp as well.  A list may sum a pair in another order
    each = near.repartition("fp").select("fp", F.inline(F.arrays_zip(F.col("others").alias("other"), F.col("similarities").alias("similarity"))))
    best = each.groupBy("fp", "other").agg(F.max("similarity").cast("double").alias("similarity"))
    return best.withColumn("n", F.rank().over(W.partitionBy("fp").orderBy(F.desc("similarity")))).filter(F.col("n") <= k).drop("n")


def neighbours(df: DataFrame, id_col: str, vec_col: str, dim_col: str, embedder_col: str, k: int = 5, least: float = -1.0, list_size: int | None = None, copies: int = COPIES) -> DataFrame:
    """(id, other, similarity, rank): the k most similar other ids of each id, of at least the least similarity."""
    source = usable(df, id_col, vec_col, dim_col, embedder_col)
    sizes = {(r[0], r[1]): r[2] for r in source.groupBy("embedder", "dim").count().collect()}  # a row for each embedder and size
    packed = source.mapInArrow(_pack, "id string, embedder string, dim int, fp long, packed binary")
    near = C.cut(nearest_classes(packed, sizes, k, least, list_size or LIST, copies))
    C.release(df.sparkSession)
    members = C.cut(packed.select("id", "fp").distinct())
    first = W.partitionBy("fp").orderBy("id")
    slots = members.withColumn("n", F.row_number().over(first)).filter(F.col("n") <= k + 1).groupBy("fp").agg(F.array_sort(F.collect_list("id")).alias("slots"))
    best = W.partitionBy("fp").orderBy(F.desc("similarity"), "first_id")
    known = slots.select(F.col("fp").alias("other"), "slots", F.col("slots")[0].alias("first_id"))
    other = near.join(known, "other").withColumn("n", F.row_number().over(best)).filter(F.col("n") <= k)
    pool = other.select("fp", "similarity", F.explode("slots").alias("other")).union(slots.select("fp", F.lit(1.0), F.explode("slots")).filter(F.lit(1.0) >= F.lit(least)))
    order = F.expr("array_sort(collect_list(struct(-similarity as s, other)))")  # at most (k + 1) * (k + 1) of them
    pool = pool.groupBy("fp").agg(F.slice(order, 1, k + 1).alias("pool"))
    mine = members.join(pool, "fp").select("id", F.slice(F.filter("pool", lambda p: p["other"] != F.col("id")), 1, k).alias("best"))
    return mine.select("id", F.posexplode("best").alias("rank", "x")).select("id", F.col("x.other").alias("other"), (-F.col("x.s")).alias("similarity"), (F.col("rank") + 1).alias("rank"))


def alike_pairs(df: DataFrame, id_col: str, vec_col: str, dim_col: str, embedder_col: str, k: int = 5, least: float = 0.8) -> DataFrame:
    """(id_a, id_b): pairs of at least the least similarity of which one is among the k nearest of the other."""
    n = neighbours(df, id_col, vec_col, dim_col, embedder_col, k, least)
    return n.filter("id <> other").select(F.least("id", "other").alias("id_a"), F.greatest("id", "other").alias("id_b")).distinct()
