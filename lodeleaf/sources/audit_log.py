"""A log of queries, each entry bound to the one before it by a hash."""

from __future__ import annotations

import fcntl
import hashlib
import json
import os
import time
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as Ty

GENESIS = "0" * 64
EVENT_DDL = (
    "type string, query_sha256 string, query_len int, query_terms int, acls array<string>, tags array<string>, top_k int, "
    "hits array<struct<chunk_id:string,score:double>>, latency_ms double, generator string, embedder string, retrieval string, "
    "context_expanded boolean, reasoning boolean, config_fingerprint string, offline boolean"
)


def canonical(value: object) -> str:
    return json.dumps(value, sort_keys=True, ensure_ascii=False, separators=(",", ":"))


def entry_hash(ts: object, prev: object, event: object) -> str:
    return hashlib.sha256(canonical({"event": event, "prev": prev, "ts": ts}).encode("utf-8", "surrogatepass")).hexdigest()


class AuditLog:
    """The log in a local file; appends take a lock."""

    def __init__(self, path: str):
        self.path = path

    def _head(self) -> str:
        """Hash of the last entry, read from the end of the file; of a last line that can't be read, up to the first such line."""
        if not os.path.exists(self.path):
            return GENESIS
        try:
            last = self._last_line()
            return json.loads(last).get("hash", GENESIS) if last else GENESIS
        except (ValueError, AttributeError):
            head = GENESIS
            with open(self.path, encoding="utf-8", errors="replace") as lines:
                for line in filter(str.strip, lines):
                    try:
                        head = json.loads(line).get("hash", head)
                    except (ValueError, AttributeError):
                        break
            return head

    def _last_line(self) -> str:
        with open(self.path, "rb") as log:
            at, tail = log.seek(0, os.SEEK_END), b""
            while at and b"\n" not in tail.strip():
                step = min(at, 1 << 16)
                at -= step
                log.seek(at)
                tail = log.read(step) + tail
            return tail.strip().rpartition(b"\n")[2].decode()

    def append_all(self, events: list[dict], now: float | None = None) -> list[str]:
        """Appends events in order; their hashes."""
        Path(self.path).resolve().parent.mkdir(parents=True, exist_ok=True)
        out = []
        with open(self.path, "a", encoding="utf-8") as log:
            fcntl.flock(log, fcntl.LOCK_EX)
            prev = self._head()
            for event in events:
                ts = time.time() if now is None else now
                digest = entry_hash(ts, prev, event)
                log.write(canonical({"ts": ts, "prev": prev, "event": event, "hash": digest}) + "\n")
                prev = digest
                out.append(digest)
        return out

    def append(self, event: dict) -> str:
        return self.append_all([event])[0]

    def lines(self, spark: SparkSession) -> DataFrame:
        return numbered_lines(spark, self.path) if os.path.exists(self.path) else spark.createDataFrame([], "line long, value string")

    def verify(self, spark: SparkSession, expected_head: str | None = None) -> tuple[bool, str]:
        """Whether the log is whole, and what is wrong first; a missing log is.  A cut tail shows only against expected_head."""
        row = verify_lines(self.lines(spark)).first()
        if row["line"] is not None:
            return False, f"line {row['line']}: {row['problem']}"
        if expected_head is not None and self._head() != expected_head:
            return False, "the last entry is not the expected one"
        return True, f"whole, {row['entries']} entries"

    def __len__(self) -> int:
        if not os.path.exists(self.path):
            return 0
        with open(self.path, encoding="utf-8") as lines:
            return sum(1 for line in lines if line.strip())


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, value) of a text file, from 1.  The file is read in splits; what is counted is a row for each of them."""
    rows = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("id"))
    order = W.orderBy("file", "at").rowsBetween(W.unboundedPreceding, -1)  # over splits
    splits = rows.groupBy("file", "at").agg(F.count("*").alias("n"), F.min("id").alias("first")).withColumn("before", F.coalesce(F.sum("n").over(order), F.lit(0)))
    return rows.join(splits.select("file", "at", "first", "before"), ["file", "at"]).select((F.col("before") + F.col("id") - F.col("first") + 1).alias("line"), "value")


_ENTRY = Ty.StructType([Ty.StructField("ok", Ty.BooleanType()), *(Ty.StructField(n, Ty.StringType()) for n in ("prev", "hash", "computed"))])


@F.pandas_udf(_ENTRY)
def _read_entry(value: pd.Series) -> pd.DataFrame:
    def one(line: str) -> tuple:
        try:
            e = json.loads(line)
            return True, e.get("prev"), e.get("hash"), entry_hash(e.get("ts"), e.get("prev"), e.get("event"))
        except (ValueError, AttributeError):
            return False, None, None, None

    return pd.DataFrame([one(v) for v in value], columns=["ok", "prev", "hash", "computed"])


PART = 1_000_000  # lines whose links are checked in one task


def verify_lines(lines: DataFrame) -> DataFrame:
    """One row: entries, and line and problem of the first bad one, if any.

    Hashes are computed in parallel, links are checked in parts of PART lines; of each part its last hash goes to the next."""
    part = F.floor((F.col("line") - 1) / PART).alias("part")
    read = lines.filter(F.trim("value") != "").withColumn("e", _read_entry("value")).select("line", part, "e.*")
    ends = read.groupBy("part").agg(F.max_by("hash", "line").alias("last"))
    heads = ends.select("part", F.lag("last", 1, GENESIS).over(W.orderBy("part")).alias("head"))  # a row for each part
    before = F.coalesce(F.lag("hash").over(W.partitionBy("part").orderBy("line")), F.when(F.row_number().over(W.partitionBy("part").orderBy("line")) == 1, F.col("head")))
    problem = F.when(~F.col("ok"), "not valid JSON").when(~F.col("computed").eqNullSafe(F.col("hash")), "content does not fit its hash").when(~F.col("prev").eqNullSafe(before), "does not follow the entry before")
    checked = read.join(heads, "part").withColumn("problem", problem)
    return checked.agg(F.count("*").alias("entries"), F.min(F.when(F.col("problem").isNotNull(), F.struct("line", "problem"))).alias("x")).select("entries", "x.line", "x.problem")


def log_lines(events: DataFrame, order: list[str], ts: str, event: str) -> DataFrame:
    """(line, value): the log that events make in an order, with a time (a number) and a JSON object of each; one task, as of ``chain``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, prev = 0, GENESIS
        for batch in batches:
            rows = []
            for t, body in zip(batch["ts"], batch["event"], strict=True):
                n += 1
                entry = {"ts": float(t), "prev": prev, "event": json.loads(body)}
                prev = entry_hash(entry["ts"], prev, entry["event"])
                rows.append((n, canonical(entry | {"hash": prev})))
            yield pd.DataFrame(rows, columns=["line", "value"])

    one = events.select(*order, F.col(ts).cast("double").alias("ts"), F.col(event).alias("event")).repartition(1).sortWithinPartitions(*order)
    return one.mapInPandas(run, "line long, value string")


def chain(events: DataFrame, order: list[str], body: Column) -> DataFrame:
    """(n, prev, hash) of events in an order: each hash is of the one before, a bar and the body.

    A chain has one order, so one task runs along the sorted bodies; it holds a batch of them at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, prev = 0, GENESIS
        for batch in batches:
            rows = []
            for text in batch["body"]:
                n += 1
                digest = hashlib.sha256(f"{prev}|{text}".encode("utf-8", "surrogatepass")).hexdigest()
                rows.append((n, prev, digest))
                prev = digest
            yield pd.DataFrame(rows, columns=["n", "prev", "hash"])

    one = events.select(*order, body.alias("body")).repartition(1).sortWithinPartitions(*order)
    return one.mapInPandas(run, "n long, prev string, hash string")


def events(lines: DataFrame) -> DataFrame:
    """(line, event) of the query events; blank and bad lines are skipped."""
    parsed = lines.filter(F.trim("value") != "").select("line", F.from_json("value", f"struct<event:struct<{_nested()}>>").alias("e"))
    return parsed.select("line", F.col("e.event").alias("event")).filter("event.type = 'query'")


def _nested() -> str:
    return ",".join(f"{n}:{t}" for n, t in (p.strip().split(" ", 1) for p in EVENT_DDL.split(", ")))


def totals(e: DataFrame) -> DataFrame:
    """One row: queries, total_hits, avg_hits_per_query, avg_latency_ms (to two places).  e: (line, latency_ms, hits, acls)."""
    hits = F.coalesce(F.size("hits"), F.lit(0))
    mean = lambda c: F.round(F.coalesce(F.avg(c), F.lit(0.0)), 2)
    return e.agg(F.count("*").alias("queries"), F.coalesce(F.sum(hits), F.lit(0)).alias("total_hits"), mean(hits).alias("avg_hits_per_query"), mean(F.coalesce("latency_ms", F.lit(0.0))).alias("avg_latency_ms"))


def top_documents(e: DataFrame, titles: DataFrame, n: int = 10) -> DataFrame:
    """(doc_id, title, hits): the documents hit most, the earlier of equals first; without a title the id stands for it."""
    exploded = e.select("line", F.posexplode("hits").alias("k", "h")).select(F.struct("line", "k").alias("at"), F.split_part(F.col("h.chunk_id"), F.lit(":"), F.lit(1)).alias("doc_id"))
    top = exploded.groupBy("doc_id").agg(F.count("*").alias("hits"), F.min("at").alias("at")).orderBy(F.desc("hits"), "at").limit(n)
    return top.join(titles, "doc_id", "left").select("doc_id", F.coalesce("title", "doc_id").alias("title"), "hits", "at").orderBy(F.desc("hits"), "at").drop("at")


def acl_distribution(e: DataFrame) -> DataFrame:
    """(acl, queries), in order of first appearance."""
    exploded = e.select("line", F.posexplode("acls").alias("k", "acl"))
    return exploded.groupBy("acl").agg(F.count("*").alias("queries"), F.min(F.struct("line", "k")).alias("at")).orderBy("at").drop("at")

