"""The knowledge base in Parquet: tables in buckets of documents, published together by a numbered manifest."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeleaf.operators.filters import tag_set, visible_to
from lodeleaf.operators.lexical import tokenized

BUCKETS = 64  # of a new store; some hundred megabytes of a table each are well

DOCUMENTS = "doc_id string, path string, title string, source_hash string, acl string, tags array<string>, meta struct<embedder:string,chunk_size:int,markdown:boolean>, created_at timestamp, updated_at timestamp"
CHUNKS = "chunk_id string, doc_id string, seq int, text string, start_pos int, end_pos int, page int, section string, acl string, tags array<string>, embedder string, dim int, vec array<double>, tokens array<string>"
SECTIONS = "doc_id string, ordinal int, section string, title string, level int, start_pos int, end_pos int, parent string"
TABLES = {"documents": DOCUMENTS, "chunks": CHUNKS, "sections": SECTIONS}


def defaults() -> dict:
    return {"acl": F.lit("public"), "tags": F.array().cast("array<string>"), "page": F.lit(1), "section": F.lit(""), "embedder": F.lit("hashing"), "dim": F.lit(0)}


class Store:
    """A folder with numbered manifests and, for each table and version, folders of the buckets that the version wrote.

    A document's rows are in the bucket that a hash of its id tells, in all tables, so a change rewrites the buckets
    of the changed documents and nothing else.  A manifest names the version of each bucket of each table.
    A writer builds its buckets and then creates the next manifest, which fails if another writer was there first;
    readers take the newest manifest that is whole, so they see all tables of one state, and a writer that dies leaves
    the last one.  What no manifest needs stays until vacuum, except that erasure removes it at once."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path, self._wanted = spark, path.rstrip("/"), buckets
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    # --- versions

    def _numbers(self) -> list[int]:
        folder = self._path(f"{self.path}/manifests")
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)] if self._fs.exists(folder) else []
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def _manifest(self) -> tuple[int, dict]:
        """The number of the newest manifest that is whole (0 for none), and what is in it."""
        for number in reversed(self._numbers()):
            stream = self._fs.open(self._path(f"{self.path}/manifests/{number:012d}.json"))
            try:
                return number, json.loads(bytes(stream.readAllBytes()).decode())
            except ValueError:
                continue  # its writer died
            finally:
                stream.close()
        return 0, {"buckets": self._wanted, "tables": {name: {} for name in TABLES}}

    def version(self) -> int:
        return self._manifest()[0]

    def _folders(self, name: str, state: dict, only: list[int] | None = None) -> list[str]:
        return [f"{self.path}/{name}/{v}/bucket={k}" for k, v in sorted(state["tables"][name].items(), key=lambda x: int(x[0])) if only is None or int(k) in only]

    def _read(self, name: str, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], TABLES[name])
        rows = self.spark.read.schema(TABLES[name]).parquet(*folders)
        return rows.withColumns({c: F.coalesce(F.col(c), d) for c, d in defaults().items() if c in rows.columns})

    def table(self, name: str) -> DataFrame:
        """A table of the current state; empty before the first.  Columns that its files lack get their defaults."""
        return self._read(name, self._folders(name, self._manifest()[1]))

    def _publish(self, changed: DataFrame, make: dict) -> int:
        """Writes anew the buckets of the changed documents (doc_id); make: of each table, its old rows there to its new ones."""
        number, state = self._manifest()
        bucket = F.pmod(F.xxhash64("doc_id"), F.lit(state["buckets"])).cast("int")
        touched = [r[0] for r in changed.select(bucket).distinct().collect()]  # at most as many as there are buckets
        version = f"v-{uuid.uuid4().hex}"
        for name, ddl in TABLES.items():
            rows = make[name](self._read(name, self._folders(name, state, touched)))
            if name == "chunks" and "tokens" not in rows.columns:
                rows = tokenized(rows)
            columns = [c.split(" ")[0] for c in _split_ddl(ddl)]
            rows.select(*columns, bucket.alias("bucket")).repartition(max(1, len(touched)), "bucket").write.partitionBy("bucket").parquet(f"{self.path}/{name}/{version}")
            written = {int(s.getPath().getName()[7:]) for s in self._fs.listStatus(self._path(f"{self.path}/{name}/{version}")) if s.getPath().getName().startswith("bucket=")}
            for k in touched:
                state["tables"][name].pop(str(k), None)
            state["tables"][name] |= {str(k): version for k in written}
        target = self._path(f"{self.path}/manifests/{max(self._numbers(), default=0) + 1:012d}.json")
        if self._manifest()[0] != number or self._fs.exists(target):
            raise RuntimeError("another writer has published a version meanwhile")
        stream = self._fs.create(target, False)  # an error if it is there
        stream.write(json.dumps(state).encode())
        stream.close()
        return self.version()

    def vacuum(self) -> int:
        """Deletes buckets and manifests that the current state doesn't need; how many buckets."""
        number, state = self._manifest()
        keep, n = {f for name in TABLES for f in self._folders(name, state)}, 0
        for name in TABLES:
            root = self._path(f"{self.path}/{name}")
            for v in self._fs.listStatus(root) if self._fs.exists(root) else []:
                folders = [f"{self.path}/{name}/{v.getPath().getName()}/{s.getPath().getName()}" for s in self._fs.listStatus(v.getPath()) if s.getPath().getName().startswith("bucket=")]
                for f in folders:
                    if f not in keep:
                        self._fs.delete(self._path(f), True)
                        n += 1
                if not any(f in keep for f in folders):
                    self._fs.delete(v.getPath(), True)
        for k in self._numbers():
            if k < number:
                self._fs.delete(self._path(f"{self.path}/manifests/{k:012d}.json"), False)
        return n

    # --- reading

    @property
    def documents(self) -> DataFrame:
        return self.table("documents")

    @property
    def chunks(self) -> DataFrame:
        return self.table("chunks")

    @property
    def sections(self) -> DataFrame:
        return self.table("sections")

    def visible_chunks(self, acls: list[str] | None = None, tags: list[str] | None = None) -> DataFrame:
        """Chunks that a caller sees, with path and title; the filter reaches the scan."""
        return chunks_with_documents(self.chunks.filter(visible_to(acls, tags)), self.documents)

    def get_document(self, doc_id: str) -> DataFrame:
        return self.documents.filter(F.col("doc_id") == doc_id)

    def get_tree(self, doc_id: str) -> DataFrame:
        return self.sections.filter(F.col("doc_id") == doc_id).orderBy("ordinal")

    def stored_hash(self, doc_id: str) -> str | None:
        row = self.get_document(doc_id).select("source_hash").first()
        return row[0] if row else None

    def list_documents(self) -> DataFrame:
        return self.documents.orderBy(F.desc("updated_at"), "doc_id")

    def stats(self) -> dict:
        return {"documents": self.documents.count(), "chunks": self.chunks.count()}

    # --- writing

    def replace(self, documents: DataFrame, chunks: DataFrame, sections: DataFrame, emptied: DataFrame | None = None) -> int:
        """Upserts documents with all their chunks and sections; emptied (doc_id) lose theirs."""
        changed = documents.select("doc_id") if emptied is None else documents.select("doc_id").union(emptied.select("doc_id"))
        chunks = chunks if "tokens" in chunks.columns else tokenized(chunks)
        return self._publish(changed, {"documents": lambda old: upsert(old, documents), "chunks": lambda old: replace_of(old, chunks, changed), "sections": lambda old: replace_of(old, sections, changed)})

    def forget(self, doc_ids: list[str]) -> int:
        """Erases documents from all tables, and the files that held them."""
        gone = self.spark.createDataFrame([(d,) for d in doc_ids], "doc_id string")
        version = self._publish(gone, {name: lambda old: old.join(gone, "doc_id", "left_anti") for name in TABLES})
        self.vacuum()
        return version


def _split_ddl(ddl: str) -> list[str]:
    out, depth, at = [], 0, 0
    for i, ch in enumerate(ddl):
        depth += (ch == "<") - (ch == ">")
        if ch == "," and depth == 0:
            out.append(ddl[at:i].strip())
            at = i + 1
    return [*out, ddl[at:].strip()]


def chunks_with_documents(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Adds path and title; chunks without a document are left out.  Spark broadcasts documents only where their size allows."""
    return chunks.join(documents.select("doc_id", "path", "title"), "doc_id")


def upsert(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows by doc_id: new ones replace old ones but keep their created_at; tags sorted, each once."""
    made = old.select("doc_id", F.col("created_at").alias("first_made"))
    fresh = new.join(made, "doc_id", "left").withColumns({"created_at": F.coalesce("first_made", "created_at"), "tags": tag_set(F.col("tags"))}).drop("first_made")
    return old.join(new.select("doc_id"), "doc_id", "left_anti").unionByName(fresh.select(*old.columns))


def replace_of(old: DataFrame, new: DataFrame, changed: DataFrame) -> DataFrame:
    """Old rows of unchanged documents, and the new rows."""
    return old.join(changed, "doc_id", "left_anti").unionByName(new.select(*old.columns))
