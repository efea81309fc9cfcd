"""Files to documents."""

from __future__ import annotations

import html.parser
import io
import os
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeleaf.functions import text as T

# Extensions that are read as they are, and those with a reader of their own.
TEXT = (".txt", ".md", ".markdown", ".rst", ".log", ".csv", ".json", ".yaml", ".yml")
HTML, PDF = (".html", ".htm"), (".pdf",)
SUPPORTED = TEXT + HTML + PDF
_BREAKING = frozenset("p br div li tr h1 h2 h3 h4 h5 h6".split())
DOC_DDL = "path string, source_hash string, title string, text string, pages array<struct<page:int,start:int>>, error string"


class _Page(html.parser.HTMLParser):
    """Text with a line break where a block starts; the title apart."""

    def __init__(self, strip_scripts: bool):
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.title: list[str] = []
        self.inside: list[str] = []
        self.skipped = frozenset(("script", "style")) if strip_scripts else frozenset()

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in _BREAKING:
            self.parts.append("\n")
        if tag == "title" or tag in self.skipped:
            self.inside.append(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag in self.inside:
            self.inside.remove(tag)

    def handle_data(self, data: str) -> None:
        if "title" in self.inside:
            self.title.append(data)
        elif not self.inside:
            self.parts.append(data)


def extract_html(source: str, strip_scripts: bool = False) -> tuple[str, str]:
    """(text, title) of a page; script and style contents stay in unless they are to be stripped."""
    page = _Page(strip_scripts)
    page.feed(source)
    body = re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+", " ", "".join(page.parts))).strip()
    return body, "".join(page.title).strip()


def decode(content: bytes) -> str:
    """UTF-8 without its invalid bytes, line ends as \\n."""
    return re.sub(r"\r\n?", "\n", content.decode("utf-8", errors="ignore"))


def extract(path: str, content: bytes) -> tuple[str, str, list[tuple[int, int]]]:
    """(text, title, pages) of a file; RuntimeError for what can't be read."""
    name = os.path.basename(path)
    kind = os.path.splitext(name)[1].lower()
    if kind in TEXT:
        return decode(content), name, [(1, 0)]
    if kind in HTML:
        body, title = extract_html(decode(content))
        return body, title or name, [(1, 0)]
    if kind in PDF:
        try:
            from pypdf import PdfReader
        except ImportError as e:
            raise RuntimeError("reading PDF files needs the optional package pypdf") from e
        pages, parts, at = [], [], 0
        for number, page in enumerate(PdfReader(io.BytesIO(content)).pages, 1):
            part = page.extract_text() or ""
            pages.append((number, at))
            parts.append(part)
            at += len(part) + 1
        return "\n".join(parts), name, pages
    raise RuntimeError(f"unsupported file type {kind or name!r}; supported: {' '.join(SUPPORTED)}")


def _extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for path, digest, content in zip(batch["path"], batch["source_hash"], batch["content"], strict=True):
            try:
                body, title, pages = extract(path, content)
                rows.append((path, digest, title, body, [{"page": p, "start": s} for p, s in pages], None))
            except RuntimeError as e:
                rows.append((path, digest, None, None, [], str(e)))
        yield pd.DataFrame(rows, columns=["path", "source_hash", "title", "text", "pages", "error"])


def local_path(c):
    """A file URI as a plain path."""
    return F.regexp_replace(c, "^file:/+", "/")


def documents_of(files: DataFrame) -> DataFrame:
    """Files (path, content), as of the binaryFile source, to (path, source_hash, title, text, pages, error); error is null where the file was read."""
    rows = files.select(local_path(F.col("path")).alias("path"), F.sha2("content", 256).alias("source_hash"), "content")
    return rows.mapInPandas(_extract, DOC_DDL)


def hashes(files: DataFrame) -> DataFrame:
    """(path, source_hash)"""
    return files.select(local_path(F.col("path")).alias("path"), F.sha2("content", 256).alias("source_hash"))


def _empty_files(spark: SparkSession, path: str) -> list[str]:
    """Files of no bytes, which the binaryFile source leaves out of its listing."""
    if "://" not in path:
        found = [path] if os.path.isfile(path) else [os.path.join(at, n) for at, _, names in os.walk(path) for n in names]
        return [f for f in found if not os.path.basename(f).startswith(("_", ".")) and os.path.getsize(f) == 0]
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    listing, out = where.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(where, True), []
    while listing.hasNext():
        status = listing.next()
        if status.getLen() == 0 and not status.getPath().getName().startswith(("_", ".")):
            out.append(status.getPath().toString())
    return out


def scan(spark: SparkSession, paths: list[str]) -> tuple[DataFrame | None, list[str]]:
    """Files under paths (path, content), folders with all below them; and the paths that don't exist."""
    missing = [p for p in paths if "://" not in p and not os.path.exists(p)]
    there = [os.path.abspath(p) if "://" not in p else p for p in paths if p not in missing]
    if not there:
        return None, missing
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(there).select("path", "content")
    empty = [(f, bytearray()) for p in there for f in _empty_files(spark, p)]
    return files.union(spark.createDataFrame(empty, "path string, content binary")) if empty else files, missing
