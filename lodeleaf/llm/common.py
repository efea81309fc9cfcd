"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from lodeleaf.sources.lineage import checkpoint_dir, cut, release, spread  # noqa: F401
from pyspark.sql import DataFrame, SparkSession

GRAM = 9  # code points of a shingle in the measure of TESTDATA.md
MIN_CHARS = 200  # shorter normalised texts do not count there
SIMILAR = 0.6

# Whitespace of TESTDATA.md and Python's, as patterns of Java and of SQL.
BLANKS = r"(?U)[\s\x1c-\x1f\x85]+"
BLANKS_SQL = r"[\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"

_BASE = 0x9E3779B97F4A7C15
_P, _P2, _P4 = (np.uint64(pow(_BASE, k, 1 << 64)) for k in (1, 2, 4))
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def normalise(text: str) -> str:
    """Lower case, each run of Unicode whitespace one space, ends trimmed."""
    return " ".join(text.lower().split())


def fingerprint(text: str) -> int:
    """64 bits of a normalised text, signed."""
    h = xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass"))
    return h - (1 << 64) if h >> 63 else h


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64, in place."""
    h ^= h >> np.uint64(30)
    h *= _M1
    h ^= h >> np.uint64(27)
    h *= _M2
    h ^= h >> np.uint64(31)
    return h


def gram_hashes(c: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run of nine codes; at least nine must be given."""
    h = c.astype(np.uint64)
    last = h[8:]
    h = h[:-1] * _P + h[1:]
    h = h[:-2] * _P2 + h[2:]
    h = h[:-4] * _P4 + h[4:]
    return mix(h[: len(last)] * _P + last)


def gram_set(text: str) -> np.ndarray:
    return np.unique(gram_hashes(codes(text)))


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two sorted arrays without repetitions."""
    both = np.concatenate((a, b))
    both.sort(kind="stable")
    n = int(np.count_nonzero(both[1:] == both[:-1]))
    return n / (len(a) + len(b) - n)


def strings(column: pa.Array | pa.ChunkedArray) -> list:
    return column.to_pylist()


def rechunk(batches: Iterable[pa.RecordBatch], rows: int = 2048) -> Iterator[pa.RecordBatch]:
    """Batches of at most so many rows, to bound what an operator holds."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def batch_of(schema: pa.Schema, *columns: object) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
