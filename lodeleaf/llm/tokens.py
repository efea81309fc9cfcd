"""Sizes of texts in tokens of a public byte-level BPE vocabulary."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import cache
from pathlib import Path

import numpy as np
import pyarrow as pa

DEFAULT = "/opt/tokenizers/byte_bpe_50k.tiktoken"

# Fixed value: the split pattern of this family of vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_EDGE = re.compile(r"(?<=\S)(?= \S)")  # no token reaches over such a place
_HELD = 300_000


@cache
def encoding(path: str = DEFAULT):
    import tiktoken

    lines = Path(path).read_bytes().splitlines()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("local", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


class Counter:
    """Counts tokens; words that come again are looked up."""

    def __init__(self, path: str = DEFAULT):
        self.encode = encoding(path).encode_ordinary
        self.known: dict[str, int] = {}

    def __call__(self, text: str | None) -> int:
        if not text:
            return 0
        if "  " in text:
            units = _EDGE.split(text)
        else:
            first, *rest = text.split(" ")
            units = [first, *map(" ".__add__, rest)]
        known, total = self.known, 0
        if len(known) > _HELD:
            known.clear()
        for u in units:
            n = known.get(u)
            if n is None:
                n = len(self.encode(u)) if u else 0
                if len(u) < 40:
                    known[u] = n
            total += n
        return total


def counts(batches: Iterator[pa.RecordBatch], path: str, extra=None) -> Iterator[pa.RecordBatch]:
    """Of batches whose last column is text: the columns before it, n_tokens, and what extra makes of the texts."""
    count = Counter(path)
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            texts = part.column(part.num_columns - 1).to_pylist()
            columns = [*part.columns[:-1], pa.array(np.array([count(t) for t in texts], dtype=np.int64))]
            names = [*part.schema.names[:-1], "n_tokens"]
            if extra is not None:
                more = extra(texts)
                columns += more.values()
                names += more.keys()
            yield pa.RecordBatch.from_arrays(columns, names=names)
