"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
import os
from functools import lru_cache

import pandas as pd
from pyspark import SparkContext, SparkFiles
from pyspark.sql import Column
from pyspark.sql import functions as F

#: A file of ranks; any other is given as parameter or in FACTLOOM_TOKENIZER.
DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: how this public vocabulary cuts a text into words before it merges bytes.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def vocabulary(path: str | None = None) -> str:
    return path or os.environ.get("FACTLOOM_TOKENIZER", DEFAULT_VOCABULARY)


@lru_cache(maxsize=2)
def encoder(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=8)
def _shipped(path: str, application: str) -> str:
    """The name under which executors get a vocabulary file of the driver, sent once an application."""
    SparkContext.getOrCreate().addFile(path)
    return os.path.basename(path)


def token_count(text: Column | str, path: str | None = None) -> Column:
    """Tokens of a text; null for null, 0 for the empty text.  The vocabulary goes to the executors as a file."""
    name = _shipped(vocabulary(path), SparkContext.getOrCreate().applicationId)

    @F.pandas_udf("int")
    def count(texts: pd.Series) -> pd.Series:
        enc = encoder(SparkFiles.get(name))
        return pd.Series([None if t is None else len(enc.encode_ordinary(t)) for t in texts], dtype="Int32")

    return count(text)
