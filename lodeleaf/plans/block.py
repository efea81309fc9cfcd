"""Scores of a block of queries against all chunks, a batch of chunks at a time.

A block is at most ``retrieve.BLOCK`` queries, which every task holds: their vectors as a matrix and their terms as an
inverted index, (term) to (query, place).  Of each query a task keeps its best rows only, so what is shuffled are a
few rows for each query and task.  Statistics take one pass before, of which a row for each term comes back.

Two steps give the exact ranking.  A batch is first scored with 32-bit products of matrices, terms that are rare by their
postings; a row stays if its score may, with the bound of the error, still be among the first.  Those that stay of a
segment are scored again: sums of 64-bit numbers in the order of the query's terms and of the vector's numbers.

Large blocks are grouped by the terms that queries share, and chunks go to the group that is nearest: for each pair of
groups the columns are the terms that are frequent in both, which are far fewer than those that are frequent at all (texts
of two languages have hardly any).  Groups decide how a score is summed in the first step, not which pairs are scored.

Of equal scores the first row by document and place stays, so ties go as they do in the final ranking.
"""

from __future__ import annotations

import copy
import math
import pickle
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeleaf.operators.lexical import B, K1

ROWS, SEGMENT = 512, 32_768  # chunks of a batch; of a segment, after which what is left is scored exactly
DENSE, SPARSE = 0.04, 25.0  # cost of a number in a product of matrices, and of a posting that is looked up, in ns
MOST_DENSE = 4096  # terms that have columns, over all groups of chunks
GROUPS, LEAST_GROUP, MARKS = 8, 64, 1024  # of queries and of chunks; queries of one on average; terms that tell them apart
HELD = 8192  # chunks that are held while they are divided by group
CELLS = 16_000_000  # of a table of frequencies
ERROR = 1.2e-7  # of one 32-bit operation, twice what it is at most
TINY = np.finfo(np.float32).tiny
NEEDED = ["chunk_id", "doc_id", "seq", "acl", "tags", "vec", "tokens"]
SCORED_DDL = "query_id long, top_k int, chunk_id string, doc_id string, seq int, vec_score double, lex double"
_SCORED = pa.schema([("query_id", pa.int64()), ("top_k", pa.int32()), ("chunk_id", pa.string()), ("doc_id", pa.string()), ("seq", pa.int32()), ("vec_score", pa.float64()), ("lex", pa.float64())])
_STATS = pa.schema([("query", pa.int32()), ("entry", pa.int32()), ("df", pa.int64()), ("length", pa.int64())])


class Block:
    """Queries of a block, from rows (query_id, q_terms, q_vec, acls, wanted, top_k).

    groups: where each group of queries begins, and the end; centres: by term its weight for each group."""

    def __init__(self, rows: list, groups: list[int] | None = None, centres: dict[str, np.ndarray] | None = None):
        self.groups = groups or [0, len(rows)]
        self.ids = np.array([r["query_id"] for r in rows], dtype=np.int64)
        self.top_k = [r["top_k"] for r in rows]
        self.acls = [None if r["acls"] is None else set(r["acls"]) for r in rows]
        self.wanted = [set(r["wanted"]) if r["wanted"] else None for r in rows]
        self.scoped = [q for q in range(len(rows)) if self.acls[q] is not None or self.wanted[q] is not None]
        # vectors by size: (which queries, matrix)
        sizes: dict[int, list[int]] = {}
        for q, r in enumerate(rows):
            if r["q_vec"] is not None:
                sizes.setdefault(len(r["q_vec"]), []).append(q)
        self.vectors = {d: (np.array(own), np.array([rows[q]["q_vec"] for q in own], dtype=np.float64).reshape(len(own), d)) for d, own in sizes.items()}
        # entries (query, place) by term
        places = [(t, q, k) for q, r in enumerate(rows) for k, t in enumerate(r["q_terms"] or [])]
        vocabulary = sorted({t for t, _, _ in places})
        at = {t: i for i, t in enumerate(vocabulary)}
        term = np.array([at[t] for t, _, _ in places], dtype=np.int64)
        order = np.argsort(term, kind="stable")
        self.vocabulary = pa.array(vocabulary, pa.string())
        self.term = term[order]
        self.query = np.array([q for _, q, _ in places], dtype=np.int64)[order]
        self.place = np.array([k for _, _, k in places], dtype=np.int64)[order]
        self.first = np.searchsorted(self.term, np.arange(len(vocabulary) + 1))
        self.idf, self.mean = np.zeros(len(places)), np.ones(len(rows))
        self.share = np.zeros(len(vocabulary))  # of the chunks that have a term
        self.marks = pa.array(list(centres or {}), pa.string())
        self.centres = np.array(list((centres or {}).values()), dtype=np.float64).reshape(len(self.marks), len(self.groups) - 1).T.copy()  # of each group
        # entries in the order of queries and places
        self.entries = np.lexsort((self.place, self.query))
        self.starts = np.searchsorted(self.query[self.entries], np.arange(len(rows) + 1))

    def __getstate__(self) -> bytes:
        """In short numbers and compressed: a copy of what is sent lies on the disk of each executor."""
        short = {k: getattr(self, k).astype(np.int32) for k in ("term", "query", "entries")}
        return zlib.compress(pickle.dumps(self.__dict__ | short | {"place": None}), 1)

    def __setstate__(self, state: bytes) -> None:
        self.__dict__ = pickle.loads(zlib.decompress(state))
        for k in ("term", "query", "entries"):
            setattr(self, k, getattr(self, k).astype(np.int64))

    def for_statistics(self) -> Block:
        """What statistics need: without scopes the vocabulary only."""
        own = copy.copy(self)
        own.vectors, own.marks, own.centres = {}, self.marks[:0], self.centres[:, :0]
        if not self.scoped:
            own.term = own.query = own.entries = own.idf = np.empty(0, np.int64)
        return own

    def group_of(self, batch: pa.RecordBatch) -> np.ndarray:
        """The group of each row."""
        lists = batch.column("tokens")
        row = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
        ids = pc.index_in(lists.flatten(), value_set=self.marks).fill_null(-1).to_numpy(zero_copy_only=False)
        row, ids = row[ids >= 0], ids[ids >= 0]
        return np.argmax([np.bincount(row, own[ids], batch.num_rows) for own in self.centres], axis=0)

    def seen(self, batch: pa.RecordBatch) -> np.ndarray | None:
        """Which row (second) each query (first) sees; None if all see all."""
        if not self.scoped:
            return None
        out = np.ones((len(self.ids), batch.num_rows), dtype=bool)
        acl, tags = batch.column("acl").to_pylist(), [set(t or ()) for t in batch.column("tags").to_pylist()]
        for q in self.scoped:
            if self.acls[q] is not None:
                out[q] &= np.array([a in self.acls[q] for a in acl], dtype=bool)
            if self.wanted[q] is not None:
                out[q] &= np.array([not self.wanted[q].isdisjoint(t) for t in tags], dtype=bool)
        return out

    def postings(self, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(row, term, how often) of each term of a row that is a query's, and the length of each row in tokens."""
        lists = batch.column("tokens")
        length = np.diff(lists.offsets.to_numpy())
        ids = pc.index_in(lists.flatten(), value_set=self.vocabulary).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        row = np.repeat(np.arange(batch.num_rows), length)
        held, n = np.unique(row[ids >= 0] * max(1, len(self.vocabulary)) + ids[ids >= 0], return_counts=True)
        row, term = np.divmod(held, max(1, len(self.vocabulary)))
        return row, term, n, length

    def collisions(self, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(times, entry): how many entries each of these terms has, and all of them."""
        return _collisions(self.first, term)


def _collisions(first: np.ndarray, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    times = first[term + 1] - first[term] if len(term) else np.empty(0, np.int64)
    entry = np.repeat(first[term] - (np.cumsum(times) - times), times) + np.arange(int(times.sum())) if len(term) else np.empty(0, np.int64)
    return times, entry


def _grouped(rows: list) -> tuple[list, list[int], dict[str, np.ndarray]]:
    """The queries by group, where each group begins, and the weights of the terms that tell groups apart.  One group for
    few queries, and for those that don't all see the same."""
    k = min(GROUPS, len(rows) // LEAST_GROUP)
    if k < 2 or any(r["acls"] is not None or r["wanted"] for r in rows):
        return rows, [0, len(rows)], {}
    count = Counter(t for r in rows for t in r["q_terms"] or [])
    terms = [t for t, _ in count.most_common(MARKS)]
    weight = np.sqrt(np.log(1 + len(rows) / np.array([count[t] for t in terms]))).astype(np.float32)
    at = {t: i for i, t in enumerate(terms)}
    x = np.zeros((len(rows), len(terms)), dtype=np.float32)
    for q, r in enumerate(rows):
        own = [at[t] for t in r["q_terms"] or [] if t in at]
        x[q, own] = weight[own]
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), TINY)
    centres = x[np.random.default_rng(0).choice(len(rows), k, replace=False)]
    for _ in range(8):
        group = np.argmax(x @ centres.T, axis=1)
        centres = np.stack([x[group == g].sum(axis=0) for g in range(k)])
        centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), TINY)
    group = np.argmax(x @ centres.T, axis=1)
    order = np.argsort(group, kind="stable")
    starts = np.searchsorted(group[order], np.arange(k + 1))
    return [rows[q] for q in order], starts.tolist(), dict(zip(terms, (centres * weight).T, strict=True))


def _by_group(block: Block, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Batches of rows of one group each, with the group."""
    if len(block.groups) == 2:
        yield from ((0, batch) for batch in _batches(batches))
        return

    def divided() -> Iterator[tuple[int, pa.RecordBatch]]:
        whole = pa.Table.from_batches(held).combine_chunks().to_batches()
        held.clear()
        for rows in whole:
            group = block.group_of(rows)
            for k in np.unique(group).tolist():
                yield from ((k, batch) for batch in _batches(iter([rows.take(pa.array(np.flatnonzero(group == k)))])))

    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= HELD:
            yield from divided()
            n = 0
    if held:
        yield from divided()


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            if "doc_id" in batch.schema.names:
                part = part.take(_order(part))
            yield pa.RecordBatch.from_arrays([pa.concat_arrays([c]) for c in part.columns], names=batch.schema.names)


def _order(rows: pa.RecordBatch | pa.Table) -> pa.Array:
    """By document and place, as Spark sorts them."""
    return pc.sort_indices(rows, sort_keys=[(c, "ascending") for c in ("doc_id", "seq", "chunk_id")], null_placement="at_start")


def _statistics(block: Block):
    """Rows of the whole (query and entry -1) and of each term (query -1) if all queries see all; else of each query and entry."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n_rows, length, df = np.zeros(len(block.ids), np.int64), np.zeros(len(block.ids), np.int64), np.zeros(len(block.query), np.int64)
        own = np.zeros(len(block.vocabulary), np.int64)
        for batch in _batches(batches):
            seen = block.seen(batch)
            row, term, _, tokens = block.postings(batch)
            if seen is None:
                n_rows += batch.num_rows
                length += int(tokens.sum())
                own += np.bincount(term, minlength=len(own))
            else:
                n_rows += seen.sum(axis=1)
                length += seen @ tokens
                times, entry = block.collisions(term)
                entry = entry[seen[block.query[entry], np.repeat(row, times)]]
                df += np.bincount(entry, minlength=len(df))
        if block.scoped:
            q, e = np.arange(len(block.ids)), np.flatnonzero(df)
            columns = (np.r_[q, block.query[e]], np.r_[np.full(len(q), -1), e], np.r_[n_rows, df[e]], np.r_[length, np.zeros(len(e), np.int64)])
        else:
            t = np.flatnonzero(own)
            columns = (np.full(len(t) + 1, -1), np.r_[-1, t], np.r_[n_rows[:1], own[t]], np.r_[length[:1], np.zeros(len(t), np.int64)])
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _STATS, strict=True)], schema=_STATS)

    return count


class _Lexical:
    """BM25 of a block: within a bound for batches, exactly for pairs."""

    def __init__(self, block: Block):
        self.block, n = block, len(block.ids)
        n_terms, groups = len(block.vocabulary), list(pairwise(block.groups))
        of = np.repeat(np.arange(len(groups)), np.diff(block.groups))[block.query] if n_terms else np.zeros(0, np.int64)  # of an entry its group
        have = np.zeros((len(groups), n_terms))  # of a group's queries that have a term
        for g, (a, b) in enumerate(groups):
            have[g] = np.bincount(block.term[of == g], minlength=n_terms)[:n_terms] / max(1, b - a)
        lift = have / np.maximum(np.diff(block.first) / max(1, n), TINY)
        self.column, self.dense, self.first, self.query, self.idf = [], [], [], [], []
        for k in range(len(groups)):  # of chunks
            taken, column = np.zeros((len(groups), n_terms), dtype=bool), np.full(n_terms, -1)
            for g in range(len(groups)):
                gain = np.minimum(1, block.share * lift[k]) * have[g] * SPARSE
                chosen = np.argsort(-gain, kind="stable")[: MOST_DENSE // len(groups)]
                taken[g, chosen[gain[chosen] > DENSE]] = True
            used = np.flatnonzero(taken.any(axis=0))
            column[used] = np.arange(len(used))
            parts = []
            for g, (a, b) in enumerate(groups):
                terms = np.flatnonzero(taken[g])
                place = np.full(n_terms, -1)
                place[terms] = np.arange(len(terms))
                e = np.flatnonzero((of == g) & taken[g][block.term])
                weights = np.zeros((b - a, len(terms)), dtype=np.float32)
                weights[block.query[e] - a, place[block.term[e]]] = block.idf[e]
                parts.append((column[terms], weights))
            rest = np.flatnonzero(~taken[of, block.term])
            self.column.append(column)
            self.dense.append(parts)
            self.first.append(np.searchsorted(block.term[rest], np.arange(n_terms + 1)))
            self.query.append(block.query[rest].astype(np.int32))
            self.idf.append(block.idf[rest])
        self.terms = block.term[block.entries]  # of the queries one after another
        self.error = (np.diff(block.starts) + 16) * ERROR
        self.means = [(mean, np.flatnonzero(block.mean == mean)) for mean in np.unique(block.mean)]

    def scores(self, n: int, row: np.ndarray, term: np.ndarray, f: np.ndarray, length: np.ndarray, k: int = 0) -> np.ndarray:
        """Of queries and rows of group k; rows lie one after another in memory, so that the postings of a row meet a small part of it."""
        block, n_queries = self.block, len(self.block.ids)
        out = np.zeros((n, n_queries), dtype=np.float32)
        dl = np.maximum(length, 1)[row]
        column = self.column[k][term] if len(term) else np.zeros(0, np.int64)
        dense = np.flatnonzero(column >= 0)
        rare = np.flatnonzero(np.diff(self.first[k])[term]) if len(term) else np.zeros(0, np.int64)
        times, entry = _collisions(self.first[k], term[rare])
        width = int(self.column[k].max(initial=-1)) + 1
        for mean, own in self.means:
            whole = len(own) == n_queries  # else there is one group
            product = out if whole else np.zeros((n, len(own)), dtype=np.float32)
            w = f * (K1 + 1) / (f + K1 * ((1 - B) + B * dl / mean))
            if width:
                columns = np.zeros((n, width), dtype=np.float32)
                columns[row[dense], column[dense]] = w[dense]
                for (a, b), (terms, weights) in zip(pairwise(block.groups), self.dense[k], strict=True):
                    if len(terms) and b > a:
                        part = columns if len(terms) == width else columns[:, terms]
                        product[:, a:b] = part @ (weights if whole else weights[own]).T
            if len(entry):
                q, at, value = self.query[k][entry], np.repeat(row[rare], times), np.repeat(w[rare], times) * self.idf[k][entry]
                if not whole:
                    place = np.full(n_queries, -1)
                    place[own] = np.arange(len(own))
                    q = place[q]
                    at, value, q = at[q >= 0], value[q >= 0], q[q >= 0]
                product += np.bincount(at * len(own) + q, value, n * len(own)).reshape(n, len(own))
            if not whole:
                out[:, own] = product
        return out.T

    def exact(self, q: np.ndarray, row: np.ndarray, postings: list[np.ndarray], length: np.ndarray) -> np.ndarray:
        """Of pairs that are sorted by row; postings: (row, term, f), by row."""
        block, out = self.block, np.zeros(len(q))
        n_terms = len(block.vocabulary)
        if not n_terms or not len(q):
            return out
        step = max(1, min(64, CELLS // n_terms))  # few rows stay in the processor's cache
        table = np.zeros((step, n_terms), dtype=np.int32)
        flat = table.reshape(-1)
        edges = np.arange(0, int(row[-1]) + step + 1, step)
        pairs_at, postings_at = np.searchsorted(row, edges), np.searchsorted(postings[0], edges.astype(postings[0].dtype))  # of one type, else all are converted
        for a, i, j, x, y in zip(edges[:-1].tolist(), pairs_at[:-1], pairs_at[1:], postings_at[:-1], postings_at[1:], strict=True):
            if i == j:
                continue
            at = postings[0][x:y] - a, postings[1][x:y]
            table[at] = postings[2][x:y]
            times = block.starts[q[i:j] + 1] - block.starts[q[i:j]]
            place = np.repeat(block.starts[q[i:j]] - (np.cumsum(times) - times), times) + np.arange(int(times.sum()))
            f = flat[np.repeat((row[i:j] - a) * n_terms, times) + self.terms[place]]
            met = np.flatnonzero(f)
            pair, entry, f = np.repeat(np.arange(j - i), times)[met], block.entries[place[met]], f[met].astype(np.int64)
            dl = np.maximum(length, 1)[row[i:j][pair]]
            value = block.idf[entry] * f * (K1 + 1) / (f + K1 * ((1 - B) + B * dl / block.mean[q[i:j][pair]]))
            out[i:j] = np.bincount(pair, value, j - i)
            table[at] = 0
        return out


class _Vectors:
    """Dot products of a block: within a bound for batches, exactly for pairs."""

    def __init__(self, block: Block):
        self.n = len(block.ids)
        self.sizes = {}
        for d, (own, matrix) in block.vectors.items():
            with np.errstate(all="ignore"):
                norm = np.linalg.norm(matrix, axis=1)
                self.sizes[d] = own, matrix, matrix.astype(np.float32), norm

    def scores(self, vectors: dict[int, tuple[np.ndarray, np.ndarray]], n: int) -> tuple[np.ndarray, np.ndarray]:
        """Scores, -inf for none, and how far each may be off.  vectors: by size the rows and their matrix."""
        out, error = np.full((self.n, n), -np.inf, dtype=np.float32), np.zeros(self.n)
        for d, (fit, x) in vectors.items():
            if d not in self.sizes:
                continue
            own, matrix, short, norm = self.sizes[d]
            with np.errstate(all="ignore"):
                far = np.linalg.norm(x, axis=1)
                got = (x.astype(np.float32) @ short.T).T  # laid out as the scores of terms
            odd_q, odd = np.flatnonzero(~_plain(norm)), np.flatnonzero(~_plain(far))
            far[odd] = 0
            error[own] = np.maximum(error[own], (d + 16) * ERROR * norm * far.max(initial=0))
            error[own[odd_q]] = 0
            if len(odd_q) or len(odd):  # numbers that 32 bits can't hold
                out, got = out.astype(np.float64), got.astype(np.float64)
                got[odd_q] = _products(matrix[odd_q], x)
                got[:, odd] = _products(matrix, x[odd])
            if len(own) == self.n and len(fit) == n:
                out = got
            else:
                out[np.ix_(own, fit)] = got
        return out, error

    def exact(self, q: np.ndarray, row: np.ndarray, vectors: dict[int, tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        out = np.full(len(q), np.nan)
        for d, (fit, x) in vectors.items():
            if d not in self.sizes or not len(q):
                continue
            own, matrix = self.sizes[d][:2]
            of_q, of_row = np.full(self.n, -1), np.full(max(int(row.max()), int(fit.max(initial=0))) + 1, -1)
            of_q[own], of_row[fit] = np.arange(len(own)), np.arange(len(fit))
            pairs = np.flatnonzero((of_q[q] >= 0) & (of_row[row] >= 0))
            for a in range(0, len(pairs), 8192):
                p = pairs[a : a + 8192]
                with np.errstate(all="ignore"):
                    out[p] = np.cumsum(matrix[of_q[q[p]]] * x[of_row[row[p]]], axis=1)[:, -1] if d else 0.0
        return out


def _plain(norm: np.ndarray) -> np.ndarray:
    """Whether vectors of these lengths can be multiplied in 32 bits."""
    return (norm == 0) | ((norm > 1e-12) & (norm < 1e15))


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of all rows with all rows, summed in order; -inf for none."""
    out = np.zeros((len(a), len(b)))
    with np.errstate(all="ignore"):
        for k in range(a.shape[1]):
            out += a[:, k : k + 1] * b[:, k]
    return np.where(np.isnan(out), -np.inf, out)


class _Best:
    """Rows of a segment that may be among the first of a query by one score, and the bound below which none is."""

    def __init__(self, n_queries: int, limit: int, floor: float):
        self.n, self.limit, self.floor = n_queries, limit, floor
        self.bound = np.full(n_queries, floor)  # a score that so many rows have at least
        self.q, self.row, self.low, self.high = [], [], [], []
        self.held = 0

    def add(self, s: np.ndarray, error: tuple[np.ndarray, np.ndarray], seen: np.ndarray | None, base: int) -> None:
        """The exact score of each query and score s is from s - s * error[0] - error[1] to the like above it."""
        n = s.shape[1]
        lowest = TINY if self.floor == 0 else np.finfo(s.dtype).min  # above the floor
        if seen is not None:
            s = np.where(seen, s, np.nan)

        def off(value: np.ndarray, q: np.ndarray | slice) -> np.ndarray:
            return np.where(np.isfinite(value), np.abs(np.where(np.isfinite(value), value, 0)) * error[0][q] + error[1][q], 0)

        if n >= self.limit and len(at := np.flatnonzero(self.bound <= self.floor)):
            part = s[at] if seen is None else np.where(np.isnan(s[at]), -np.inf, s[at])
            kth = np.partition(part, n - self.limit, axis=1)[:, n - self.limit].astype(np.float64)
            self.bound[at] = np.where(kth > self.floor, np.maximum(self.floor, kth - off(kth, at)), self.floor)

        def least(q: np.ndarray | slice) -> np.ndarray:
            own = self.bound[q]
            value = np.clip(np.where(own > self.floor, own - off(own, q), -np.inf), np.finfo(s.dtype).min, np.finfo(s.dtype).max)
            with np.errstate(over="ignore"):
                return np.maximum(np.nextafter(value.astype(s.dtype), s.dtype.type(-np.inf)), s.dtype.type(lowest))

        i, q = np.divmod(np.flatnonzero((s >= least(slice(None))[:, None]).T), self.n)
        if len(at := np.flatnonzero(np.bincount(q, minlength=self.n) > 2 * self.limit)):  # the batch itself has a better bound
            part = s[at] if seen is None else np.where(np.isnan(s[at]), -np.inf, s[at])
            kth = np.partition(part, n - self.limit, axis=1)[:, n - self.limit].astype(np.float64)
            self.bound[at] = np.maximum(self.bound[at], kth - off(kth, at))
            kept = s[q, i] >= least(slice(None))[q]
            i, q = i[kept], q[kept]
        value = s[q, i].astype(np.float64)
        self._put(q, i + base, value - off(value, q), value + off(value, q))
        few = np.flatnonzero(self.bound <= self.floor)
        if len(few):  # of a batch the first rows at the floor; it is sorted
            at = s[few] < lowest
            at &= np.cumsum(at, axis=1) <= self.limit
            k, i = np.nonzero(at)
            self._put(few[k], i + base, np.full(len(k), self.floor), np.full(len(k), self.floor))
        if self.held > 3 * self.limit * self.n:
            self.prune()

    def _put(self, q: np.ndarray, row: np.ndarray, low: np.ndarray, high: np.ndarray) -> None:
        for held, new in ((self.q, q), (self.row, row), (self.low, low), (self.high, high)):
            held.append(new)
        self.held += len(q)

    def prune(self) -> None:
        q, low = np.concatenate(self.q), np.concatenate(self.low)
        order = np.lexsort((-low, q))
        first = np.searchsorted(q[order], np.arange(self.n + 1))
        enough = np.flatnonzero(np.diff(first) >= self.limit)
        self.bound[enough] = np.maximum(self.bound[enough], low[order[first[enough] + self.limit - 1]])
        kept = np.concatenate(self.high) >= self.bound[q]
        self.q, self.row, self.low, self.high = [q[kept]], [np.concatenate(self.row)[kept]], [low[kept]], [np.concatenate(self.high)[kept]]
        self.held = int(kept.sum())

    def taken(self) -> tuple[np.ndarray, np.ndarray]:
        """(query, row) of the rows that are left, which are forgotten."""
        if not self.q:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        self.prune()
        out = self.q[0], self.row[0]
        self.q, self.row, self.low, self.high, self.held = [], [], [], [], 0
        return out


def _keep(block: Block, limit: int, lexical: bool):
    n_queries = len(block.ids)

    def first_of(pairs: np.ndarray, by: int) -> tuple[np.ndarray, np.ndarray]:
        """Of pairs (query, place of the row, vec, lex) the first of each query, and the last of these scores where there are so many."""
        key = pairs[:, by]
        pairs = pairs[np.lexsort((pairs[:, 1], -np.where(np.isnan(key), -np.inf, key), pairs[:, 0]))]
        first = np.searchsorted(pairs[:, 0], np.arange(n_queries + 1))
        pairs_kept = pairs[np.arange(len(pairs)) - first[pairs[:, 0].astype(np.int64)] < limit]
        bound = np.full(n_queries, -np.inf)
        full = np.flatnonzero(np.diff(first) >= limit)
        last = pairs[first[full] + limit - 1, by]
        bound[full] = np.where(np.isnan(last), -np.inf, last)
        return pairs_kept, bound

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors = _Vectors(block)
        words = _Lexical(block) if lexical else None
        none = np.zeros(n_queries)
        best = [_Best(n_queries, limit, f) for f in (-np.inf, 0.0)[: 1 + lexical]]
        held = [np.empty((0, 4)) for _ in best]  # of each list the first rows so far, (query, row, vec, lex)
        names: list[pa.RecordBatch] = []
        base = 0  # of the segment, within the rows whose names are held

        def close() -> None:
            nonlocal names, base, held
            taken = [b.taken() for b in best]
            keys = np.unique(np.concatenate([row * n_queries + q for q, row in taken]))
            row, q = np.divmod(keys, n_queries)
            vec = vectors.exact(q, row, {d: (np.concatenate([f for f, _ in parts]), np.concatenate([x for _, x in parts])) for d, parts in segment.items()})
            lex = words.exact(q, row, [np.concatenate([p[k] for p in postings]) for k in range(3)], np.concatenate(lengths)) if words else np.full(len(q), np.nan)
            table = pa.Table.from_batches(names)
            order = _order(table).to_numpy()
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            for h in held:
                h[:, 1] = place[h[:, 1].astype(np.int64)]
            new = np.stack((q, place[row + base], vec, lex), axis=1)
            for k, b in enumerate(best):
                held[k], bound = first_of(np.concatenate((held[k], new[np.isin(keys, taken[k][1] * n_queries + taken[k][0])])), 2 + k)
                b.bound = np.maximum(bound, b.floor)
            used = np.unique(np.concatenate([h[:, 1] for h in held])).astype(np.int64)
            for h in held:
                h[:, 1] = np.searchsorted(used, h[:, 1])
            names = table.take(pa.array(order[used])).combine_chunks().to_batches() or [names[0].slice(0, 0)]
            base = len(used)

        segment: dict[int, list] = {}
        postings, lengths, at = [], [], 0
        for k, batch in _by_group(block, batches):
            n = batch.num_rows
            column = batch.column("vec")
            sizes = np.diff(column.offsets.to_numpy()) if column.null_count == 0 else np.array([-1 if v is None else len(v) for v in column.to_pylist()])
            own = {}
            for d in vectors.sizes:
                if len(fit := np.flatnonzero(sizes == d)):
                    own[d] = fit, column.take(pa.array(fit)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(fit), d)
                    segment.setdefault(d, []).append((fit + at, own[d][1]))
            seen = block.seen(batch)
            s, error = vectors.scores(own, n)
            best[0].add(s, (none, error), seen, at)
            if words:
                row, term, f, length = block.postings(batch)
                best[1].add(words.scores(n, row, term, f, length, k), (words.error, none), seen, at)
                postings.append(((row + at).astype(np.int32), term.astype(np.int32), f.astype(np.int32)))
                lengths.append(length)
            names.append(batch.select(["chunk_id", "doc_id", "seq"]))
            at += n
            if at >= SEGMENT or max(b.held for b in best) > 6 * limit * n_queries:  # the latter with many equal scores
                close()
                segment, postings, lengths, at = {}, [], [], 0
        if at:
            close()
        if not names:
            return
        table = pa.Table.from_batches(names).combine_chunks()
        flat = np.concatenate(held)
        q, row = flat[:, 0].astype(np.int64), flat[:, 1].astype(np.int64)
        _, first = np.unique(q * max(1, base) + row, return_index=True)
        q, row, flat = q[first], row[first], flat[first]
        null = np.isnan(flat[:, 2])
        top_k = pa.array(block.top_k, pa.int32()).take(pa.array(q))
        cells = [table.column(c).take(pa.array(row)) for c in ("chunk_id", "doc_id", "seq")]
        out = [pa.array(block.ids[q]), top_k, *(c.combine_chunks() for c in cells), pa.array(flat[:, 2], mask=null), pa.array(flat[:, 3], mask=np.full(len(flat), not lexical))]
        whole = pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(out, _SCORED, strict=True)], schema=_SCORED)
        for a in range(0, whole.num_rows, 1 << 16):
            yield whole.slice(a, 1 << 16)

    return score


def scored(queries: DataFrame, chunks: DataFrame, limit: int, lexical: bool = True) -> DataFrame:
    """(query_id, top_k, chunk_id, doc_id, seq, vec_score, lex): of each query a superset of its first rows, so many by
    either score.  queries: a block, as of retrieve.query_blocks; chunks: with the columns NEEDED."""
    spark = chunks.sparkSession
    asked = queries.select("query_id", "q_terms", "q_vec", "acls", "wanted", "top_k").orderBy("query_id").collect()  # at most a block
    block = Block(*_grouped(asked)) if lexical else Block(asked)
    if not len(block.ids):
        return spark.createDataFrame([], SCORED_DDL)
    rows = chunks.select(*NEEDED)
    if lexical:
        parts = rows.select("acl", "tags", "tokens").mapInArrow(_statistics(block.for_statistics()), "query int, entry int, df long, length long").groupBy("query", "entry").agg(F.sum("df").alias("df"), F.sum("length").alias("length"))
        stats = parts.collect()  # a row for each query, and each of its terms
        n_docs, df = np.zeros(len(block.ids), np.int64), np.zeros(len(block.query), np.int64)
        for r in stats:
            own = slice(None) if r["query"] < 0 else r["query"]
            if r["entry"] < 0:
                n_docs[own] = r["df"]
                block.mean[own] = r["length"] / r["df"] if r["length"] else 1.0
            elif r["query"] < 0:
                df[block.first[r["entry"]] : block.first[r["entry"] + 1]] = r["df"]
            else:
                df[r["entry"]] = r["df"]
        for e in np.flatnonzero(df).tolist():
            n, own = int(n_docs[block.query[e]]), int(df[e])
            block.idf[e] = math.log(1 + (n - own + 0.5) / (own + 0.5))
        np.maximum.at(block.share, block.term, df / max(1, int(n_docs.max(initial=0))))
    return rows.mapInArrow(_keep(block, limit, lexical), SCORED_DDL)
