"""Token counts by a public tokenizer whose vocabulary file is named by a path."""

from __future__ import annotations

import base64
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"

# Fixed value: the pattern that splits text before the merges of the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=2)
def encoding(vocabulary: str = VOCABULARY):
    import tiktoken

    with open(vocabulary, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_count(text: Column | str, vocabulary: str = VOCABULARY) -> Column:
    """Tokens of each whole text; zero for an empty one, null for null."""

    @F.pandas_udf(T.LongType())
    def count(texts: pd.Series) -> pd.Series:
        encode = encoding(vocabulary).encode_ordinary
        return pd.Series([None if t is None else len(encode(t)) for t in texts], dtype="Int64")

    return count(text)


def clean_source(source: Column | str) -> Column:
    """A source's name without differences of case, outer blanks, blanks and underscores; null stays null."""
    return F.regexp_replace(F.lower(F.trim(source)), r"[\s_-]+", "-")


def sized(documents: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source", vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, source (clean), n_tokens, and a hash of number and text that orders equal rows."""
    d = documents.select(
        F.col(doc_id).cast("long").alias("doc_id"),
        clean_source(source).alias("source"),
        F.coalesce(token_count(text, vocabulary), F.lit(0)).alias("n_tokens"),
        F.xxhash64(F.col(doc_id), F.col(text)).alias("row"),
    )
    return d
