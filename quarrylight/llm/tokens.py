"""Token counts under a public tokenizer."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pandas as pd
import tiktoken
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: The file of ranks and the pattern that splits text before merging; both are parameters of ``token_counter``.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_loaded: dict[int, tiktoken.Encoding] = {}


def _encoding(data: bytes, pattern: str) -> tiktoken.Encoding:
    key = hash((data, pattern))
    if key not in _loaded:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}
        _loaded[key] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _loaded[key]


def token_counter(spark: SparkSession, path: str = TOKENIZER, pattern: str = PATTERN):  # noqa: ANN201
    """A function from a text column to its number of tokens; null and empty texts have 0.

    The driver reads the file of ranks, under 2 MB whatever the data, and broadcasts it.
    """
    with open(path, "rb") as f:
        ranks = spark.sparkContext.broadcast(f.read())

    @F.pandas_udf("bigint")
    def count(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoding = _encoding(ranks.value, pattern)
        for batch in texts:
            yield pd.Series([len(encoding.encode_ordinary(t)) if t else 0 for t in batch], dtype="int64")

    def counted(text: Column) -> Column:
        return count(text)

    return counted
