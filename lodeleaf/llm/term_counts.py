"""How often each term occurs, and in how many records, kept up by signed deltas.

``deltas`` turns changes of records (old text, new text) into per-term changes of both counts; a record
that is added has no old text, a deleted one no new text.  Terms are counted inside each task before
anything is shuffled, so a term that fills a third of all records is a few partial rows.  The number of
records is kept the same way, as the count of the empty term ``TOTAL``.  ``merge`` adds deltas to counts; ``TermStore``
keeps the counts in a Parquet table, partitioned by a hash of the term, and rewrites from the deltas only the
partitions that they touch; ``marked`` needs nothing but the counts.

Null and blank texts are no records.  Repeated ids count once (the smallest text, if they differ); null ids don't
count, further columns are ignored.  Empty tables give empty counts.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

COMMON_SHARE = 0.1  # in more than this share of records: common
RARE_RECORDS = 2  # in at most so many: rare
TERMS_EACH = 250_000  # terms for each partition of a store, when it is made
TOTAL = ""  # no term is empty
MOST_REPEATED = 200_000  # ids that come several times, up to which they are sent to all tasks; beyond, all texts are shuffled
_HELD = 400_000  # terms a task holds before it hands its counts on

# The ranges of characters that are taken one by one and in pairs.
CJK = "㐀-䶿一-鿿豈-﫿぀-ヿ"
_TERMS = re.compile(rf"[a-z0-9_]+|[{CJK}]+")
_DELTAS = pa.schema([("term", pa.string()), ("occurrences", pa.int64()), ("records", pa.int64())])
DELTA_DDL = "term string, occurrences long, records long"


def terms(text: str) -> list[str]:
    """Terms of a text, with repetitions."""
    out: list[str] = []
    for run in _TERMS.findall(text.lower()):
        if run.isascii():
            out.append(run)
        else:
            out.extend(run)
            out.extend(map(str.__add__, run, run[1:]))
    return out


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    occurrences: Counter[str] = Counter()
    records: Counter[str] = Counter()

    def rows() -> pa.RecordBatch:
        kept = [(t, o, records[t]) for t, o in occurrences.items() if o or records[t]]
        return C.batch_of(_DELTAS, *map(list, zip(*kept, strict=True))) if kept else C.batch_of(_DELTAS, [], [], [])

    for batch in C.rechunk(batches):
        for old, new in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if old == new:
                continue
            if new and not new.isspace():
                occurrences.update(t := terms(new))
                records.update(set(t))
                records[TOTAL] += 1
            if old and not old.isspace():
                occurrences.subtract(t := terms(old))
                records.subtract(set(t))
                records[TOTAL] -= 1
            occurrences[TOTAL] += 0
        if len(occurrences) > _HELD:
            yield rows()
            occurrences.clear()
            records.clear()
    yield rows()


def deltas(changes: DataFrame, old: Column, new: Column) -> DataFrame:
    """(term, occurrences, records): signed changes, one row for each term that changes."""
    parts = changes.select(old.alias("old"), new.alias("new")).mapInArrow(_count, DELTA_DDL)
    return _total(parts)


def _total(parts: DataFrame) -> DataFrame:
    return parts.groupBy("term").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records")).filter("occurrences <> 0 or records <> 0")


def merge(counts: DataFrame, changed: DataFrame) -> DataFrame:
    return _total(counts.select("term", "occurrences", "records").union(changed.select("term", "occurrences", "records")))


def once(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text), each id once.  Only ids are shuffled, and the texts of those that come several times."""
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter("id is not null")
    repeated = C.cut(rows.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1").select("id"))
    if repeated.limit(MOST_REPEATED + 1).count() > MOST_REPEATED:
        return rows.groupBy("id").agg(F.min("text").alias("text"))
    several = rows.join(F.broadcast(repeated), "id", "left_semi").groupBy("id").agg(F.min("text").alias("text"))
    return rows.join(F.broadcast(repeated), "id", "left_anti").union(several)


def changes_between(old: DataFrame, new: DataFrame) -> DataFrame:
    """(id, old_text, new_text) of the records (id, text) that were added, changed or deleted."""
    a, b = old.select("id", F.col("text").alias("old_text")), new.select("id", F.col("text").alias("new_text"))
    return a.join(b, "id", "full_outer").filter(~F.col("old_text").eqNullSafe(F.col("new_text")))


def marked(counts: DataFrame, share: float = COMMON_SHARE, rare: int = RARE_RECORDS) -> DataFrame:
    """(term, occurrences, records, mark): common, rare, or null."""
    total = counts.filter(F.col("term") == TOTAL).agg(F.coalesce(F.sum("records"), F.lit(0)).alias("n"))  # one row
    mark = F.when(F.col("records") > F.col("n") * F.lit(share), "common").when(F.col("records") <= rare, "rare")
    return counts.filter(F.col("term") != TOTAL).join(F.broadcast(total), how="cross").select("term", "occurrences", "records", mark.alias("mark"))


class TermStore:
    """Counts kept at a path: versions of a table that is partitioned by a hash of the term.

    The number of partitions follows from the size of the first deltas, if it isn't given, and stays.  Each version
    has the partitions it changed; a run that dies leaves no _SUCCESS, and its folder isn't read.  One writer at a time."""

    def __init__(self, spark, path: str, partitions: int | None = None):
        self.spark, self.path, self._wanted = spark, path.rstrip("/"), partitions

    def _fs(self):
        jvm = self.spark._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        return jvm, root.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _versions(self) -> tuple[dict[int, str], list[tuple[str, int]], int | None]:
        """The newest complete folder of each partition, all others, and the number of partitions."""
        jvm, fs = self._fs()
        root, newest, all_parts, of = jvm.org.apache.hadoop.fs.Path(self.path), {}, [], None
        if not fs.exists(root):
            return {}, [], None
        for s in fs.listStatus(root):
            name = s.getPath().getName()
            if not fs.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS")):
                continue
            of = int(name.split("-")[1])
            for p in fs.listStatus(s.getPath()):
                if (part := p.getPath().getName()).startswith("part_of="):
                    k = int(part[8:])
                    all_parts.append((name, k))
                    newest[k] = max(newest.get(k, ""), name)
        return newest, [(v, k) for v, k in all_parts if newest[k] != v], of

    def counts(self) -> DataFrame:
        """(term, occurrences, records), with the row of TOTAL."""
        newest, _, _ = self._versions()
        if not newest:
            return self.spark.createDataFrame([], DELTA_DDL)
        return self.spark.read.schema(DELTA_DDL).parquet(*(f"{self.path}/{v}/part_of={k}" for k, v in sorted(newest.items()))).filter("term is not null")

    def apply(self, changed: DataFrame) -> None:
        """Writes anew the partitions that the deltas touch."""
        newest, _, of = self._versions()
        changed = C.cut(changed)
        of = of or self._wanted or max(1, min(4096, changed.count() // TERMS_EACH))
        part = F.pmod(F.xxhash64("term"), F.lit(of)).cast("int").alias("part_of")
        touched = sorted(r[0] for r in changed.select(part).distinct().collect())  # at most as many as there are partitions
        if not touched:
            return
        old = [f"{self.path}/{newest[k]}/part_of={k}" for k in touched if k in newest]
        rows = changed
        if old:
            rows = merge(self.spark.read.schema(DELTA_DDL).parquet(*old).filter("term is not null"), rows)
        kept = rows.select("*", part).repartition(min(of, len(touched)), "part_of")
        # a partition that lost all its terms still gets a file, so that its old version isn't read
        blank = self.spark.createDataFrame([(None, 0, 0, k) for k in touched], DELTA_DDL + ", part_of int").coalesce(1)
        number = 1 + max((int(v[1:10]) for v in newest.values()), default=0)
        kept.union(blank).write.partitionBy("part_of").parquet(f"{self.path}/v{number:09d}-{of}-{uuid.uuid4().hex[:8]}")

    def vacuum(self) -> int:
        """Deletes partitions that a newer version replaces; how many."""
        jvm, fs = self._fs()
        _, old, _ = self._versions()
        for v, k in old:
            fs.delete(jvm.org.apache.hadoop.fs.Path(f"{self.path}/{v}/part_of={k}"), True)
        return len(old)

    def drop(self) -> None:
        jvm, fs = self._fs()
        fs.delete(jvm.org.apache.hadoop.fs.Path(self.path), True)

    def read(self) -> DataFrame:
        return self.counts().filter(F.col("term") != TOTAL)
