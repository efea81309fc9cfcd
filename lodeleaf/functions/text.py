"""Column functions on text, all built from Spark's own."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters that are tokens of their own, in runs; Unicode whitespace as Python's str.strip sees it.
CJK = "㐀-䶿一-鿿豈-﫿぀-ヿ"
SPACE = r"\t-\r\x1c-\x20\x85\xa0  -     　"
STOPS = "。．.!?！？\\n"


def strip(c: Column) -> Column:
    """Without Unicode whitespace at either end."""
    return F.regexp_replace(c, f"^[{SPACE}]+|[{SPACE}]+$", "")


def tokenize(c: Column) -> Column:
    """Runs of ASCII letters, digits and underscores first; then of each CJK run its characters and its pairs."""
    low = F.lower(c)
    words = F.regexp_extract_all(low, F.lit("[a-z0-9_]+"), F.lit(0))
    runs = F.regexp_extract_all(low, F.lit(f"[{CJK}]+"), F.lit(0))

    def pieces(run: Column) -> Column:
        n = F.length(run)
        at = F.sequence(F.lit(1), n)
        single = F.transform(at, lambda p: F.substring(run, p, F.lit(1)))
        pairs = F.transform(F.filter(at, lambda p: p < n), lambda p: F.substring(run, p, F.lit(2)))
        return F.concat(single, pairs)

    return F.concat(words, F.flatten(F.transform(runs, pieces)))


def bigrams(tokens: Column) -> Column:
    """Neighbouring tokens joined by an underscore."""
    n = F.greatest(F.size(tokens) - 1, F.lit(0))
    return F.zip_with(F.slice(tokens, F.lit(1), n), F.slice(tokens, F.lit(2), n), lambda a, b: F.concat_ws("_", a, b))


def sentences(c: Column) -> Column:
    """Pieces that end behind a stop or a line break; blank ones are left out; a text without any is its own."""
    parts = F.filter(F.split(c, f"(?<=[{STOPS}])"), lambda s: strip(s) != "")
    return F.when(F.size(parts) > 0, parts).otherwise(F.array(c))


def expand_query(query: Column, history: Column, domain_terms: Column, turns: int) -> Column:
    """The query with the last turns of the history and the domain terms."""
    none = F.array().cast("array<string>")
    past = F.coalesce(history, none)
    last = none if turns <= 0 else F.slice(past, F.greatest(F.lit(1), F.size(past) - (turns - 1)), F.lit(turns))
    terms = F.array_join(F.coalesce(domain_terms, none), " ")
    parts = F.filter(F.concat(F.array(query), last, F.array(terms)), lambda p: p.isNotNull() & (p != ""))
    return strip(F.array_join(parts, " "))


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(path: Column) -> Column:
    """Lower case, with its dot; empty without one."""
    return F.lower(F.regexp_extract(basename(path), r"(\.[^.]+)$", 1))


def is_markdown(path: Column) -> Column:
    return extension(path).isin(".md", ".markdown")


def document_id(path: Column) -> Column:
    return F.substring(F.sha2(path, 256), 1, 32)


def location(title: Column, page: Column, start: Column, end: Column, section: Column) -> Column:
    """title#p1:0-10 (section)"""
    where = F.concat(title, F.lit("#p"), page.cast("string"), F.lit(":"), start.cast("string"), F.lit("-"), end.cast("string"))
    return F.when(F.coalesce(section, F.lit("")) != "", F.concat(where, F.lit(" ("), section, F.lit(")"))).otherwise(where)
