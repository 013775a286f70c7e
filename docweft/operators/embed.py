"""Embedders, Arrow functions over batches. The default hashes words into 64 buckets."""

from __future__ import annotations

import hashlib
import importlib.util
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from docweft.config import Embedding

DIM = 64


class EmbeddingError(RuntimeError):
    pass


_BLANKS = r"[\t-\r\x{85}\p{Z}]+"
_MARKS = ".,;:!?\"'()[]"
_BUCKETS: dict[str, int] = {}
BUCKETS_KEPT = 200_000


def bucket(word: str) -> int:
    """MD5 of a bare, lower-cased word modulo 64; -1 where nothing is left of it."""
    bare = word.strip(_MARKS).lower()
    return hashlib.md5(bare.encode()).digest()[-1] % DIM if bare else -1


def _hashed(text: pa.Array) -> pa.Array:
    words = pc.split_pattern_regex(pc.fill_null(text, "").cast(pa.string()), _BLANKS)
    ends, flat = words.offsets.to_numpy(), words.values
    coded = flat.slice(ends[0], ends[-1] - ends[0]).dictionary_encode()
    if len(_BUCKETS) > BUCKETS_KEPT:
        _BUCKETS.clear()
    known = []
    for w in coded.dictionary.to_pylist():
        at = _BUCKETS.get(w)
        if at is None:
            at = _BUCKETS[w] = bucket(w)
        known.append(at)
    at = np.array(known, np.int64)[coded.indices.to_numpy()] if known else np.zeros(0, np.int64)
    row = np.repeat(np.arange(len(text)), np.diff(ends))
    some = at >= 0
    counts = np.bincount(row[some] * DIM + at[some], minlength=len(text) * DIM).reshape(-1, DIM).astype(float)
    norm = np.sqrt((counts * counts).sum(1, keepdims=True))
    unit = np.divide(counts, norm, out=counts, where=norm > 0)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(text) + 1, dtype=np.int32) * DIM), pa.array(unit.reshape(-1)))


def hashing(text: Column | str) -> Column:
    """Unit-length counts of a text's words by bucket; a null text, or one without words, has zeros. A distinct word of a batch is digested once."""
    return _hashing(F.col(text) if isinstance(text, str) else text)


@F.arrow_udf(ArrayType(DoubleType()))
def _hashing(text: pa.Array) -> pa.Array:
    return _hashed(text)


def available(module: str) -> bool:
    return importlib.util.find_spec(module) is not None


def local(cfg: Embedding) -> Callable[[Column], Column]:
    if not available("sentence_transformers"):
        raise EmbeddingError("sentence_transformers is not installed")

    @F.pandas_udf("array<float>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        from sentence_transformers import SentenceTransformer

        model = SentenceTransformer(cfg.model)
        for s in parts:
            yield pd.Series(list(model.encode(s.fillna("").tolist(), batch_size=cfg.batch_size, normalize_embeddings=True)))

    return run


def remote(cfg: Embedding) -> Callable[[Column], Column]:
    if not available("openai"):
        raise EmbeddingError("openai is not installed")

    @F.pandas_udf("array<float>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        from openai import OpenAI

        client = OpenAI(api_key=cfg.api_key or "none", base_url=cfg.api_base or None)
        for s in parts:
            texts, out = s.fillna("").tolist(), []
            for i in range(0, len(texts), min(cfg.batch_size or 32, 500)):
                got = client.embeddings.create(model=cfg.model, input=texts[i : i + min(cfg.batch_size or 32, 500)])
                out += [d.embedding for d in sorted(got.data, key=lambda d: d.index)]
            yield pd.Series(out)

    return run


REGISTRY: dict[str, Callable[[Embedding], Callable[[Column], Column]]] = {"hashing": lambda cfg: hashing, "local": local, "openai": remote, "custom": remote}


def get_embedder(cfg: Embedding = Embedding()) -> Callable[[Column], Column]:
    """A function from a text column to a vector column."""
    if cfg.provider not in REGISTRY:
        raise EmbeddingError(f"no embedder {cfg.provider!r}")
    return REGISTRY[cfg.provider](cfg)
