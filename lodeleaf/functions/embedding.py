"""Embedders: a text column to a vector column."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from lodeleaf.config import Config
from lodeleaf.functions.text import CJK

_WORDS, _RUNS = re.compile("[a-z0-9_]+"), re.compile(f"[{CJK}]+")
_CACHE = 200_000


class Embedder(Protocol):
    name: str
    dim: int

    def column(self, text: Column) -> Column: ...

    def embed(self, texts: list[str]) -> list[list[float]]: ...


def tokens_of(text: str) -> list[str]:
    """As functions.text.tokenize."""
    low = text.lower()
    out = _WORDS.findall(low)
    for run in _RUNS.findall(low):
        out += [*run, *(run[i : i + 2] for i in range(len(run) - 1))]
    return out


class HashingEmbedder:
    """Signed feature hashing of tokens and neighbouring pairs, scaled to unit length.

    Null and empty texts give a zero vector."""

    name = "hashing"

    def __init__(self, dim: int = 256, use_bigrams: bool = True):
        self.dim, self.use_bigrams = dim, use_bigrams
        self._known: dict[str, tuple[int, int]] = {}

    def place(self, token: str) -> tuple[int, int]:
        """Index and sign of a token: from the first eight bytes and the last bit of its 128-bit BLAKE2b."""
        got = self._known.get(token)
        if got is None:
            if len(self._known) > _CACHE:
                self._known.clear()
            digest = hashlib.blake2b(token.encode(), digest_size=16).digest()
            got = self._known[token] = (int.from_bytes(digest[:8], "big") % self.dim, 1 if digest[-1] & 1 else -1)
        return got

    def vector(self, text: str | None) -> np.ndarray:
        tokens = tokens_of(text or "")
        if self.use_bigrams:
            tokens = tokens + [f"{a}_{b}" for a, b in zip(tokens, tokens[1:], strict=False)]
        sums, place = [0] * self.dim, self.place
        for t in tokens:
            i, sign = place(t)
            sums[i] += sign
        v = np.array(sums, dtype=np.float64)
        length = float(np.sqrt(v @ v))
        return v / (length or 1.0)

    def embed(self, texts: list[str]) -> list[list[float]]:
        return [self.vector(t).tolist() for t in texts]

    def column(self, text: Column) -> Column:
        dim, pairs = self.dim, self.use_bigrams

        @F.pandas_udf("array<double>")
        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            own = HashingEmbedder(dim, pairs)
            for batch in batches:
                yield pd.Series([own.vector(t) for t in batch])

        return run(text)


class SentenceEmbedder:
    """A locally stored sentence-transformers model; the library is optional."""

    name = "sentence-transformers"

    def __init__(self, model: str, offline: bool = True):
        try:
            from sentence_transformers import SentenceTransformer
        except ImportError as e:
            raise RuntimeError("the embedder 'sentence-transformers' needs the package sentence-transformers") from e
        self.model_name, self.offline = model, offline
        self._model = SentenceTransformer(model, local_files_only=offline)
        self.dim = int(self._model.get_sentence_embedding_dimension())

    def embed(self, texts: list[str]) -> list[list[float]]:
        return self._model.encode(texts, normalize_embeddings=True).tolist()

    def column(self, text: Column) -> Column:
        model, offline = self.model_name, self.offline

        @F.pandas_udf("array<double>")
        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            own = SentenceEmbedder(model, offline)  # once for each task
            for batch in batches:
                yield pd.Series(own.embed(batch.fillna("").tolist()))

        return run(text)


EMBEDDERS = {"hashing": lambda c: HashingEmbedder(c.embedding_dim), "sentence-transformers": lambda c: SentenceEmbedder(c.st_model, c.is_offline)}


def get_embedder(config: Config) -> Embedder:
    if config.embedder not in EMBEDDERS:
        raise ValueError(f"unknown embedder {config.embedder!r}; known: {', '.join(EMBEDDERS)}")
    return EMBEDDERS[config.embedder](config)
