"""Token counters: an estimate inside Catalyst, or a vocabulary file read once per Python worker."""

from __future__ import annotations

import base64
from collections.abc import Callable
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as T

_PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=4)
def _encoder(path: str) -> Callable[[list[str]], list[int]]:
    if path.endswith(".tiktoken"):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        e = tiktoken.Encoding("file", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})
        return lambda texts: [len(x) for x in e.encode_ordinary_batch(texts, num_threads=1)]
    import sentencepiece

    s = sentencepiece.SentencePieceProcessor(model_file=path)
    return lambda texts: [len(x) for x in s.encode(texts, num_threads=1)]


def counter(encoding: str = "words") -> Callable[[Column], Column]:
    """A function from text to number of tokens; ``words`` stays in the JVM, a path counts with that vocabulary."""
    if encoding == "words":
        return T.count_tokens

    @F.pandas_udf("int")
    def run(s: pd.Series) -> pd.Series:
        return pd.Series(_encoder(encoding)(s.fillna("").tolist()), dtype="int32")

    return run


def array_counter(encoding: str) -> Callable[[Column], Column]:
    """As ``counter``, of every text of an array, with the vocabulary of a path."""

    @F.pandas_udf("array<int>")
    def run(s: pd.Series) -> pd.Series:
        return pd.Series([_encoder(encoding)([x or "" for x in texts]) for texts in s])

    return run
