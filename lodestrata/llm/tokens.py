"""Token counts of texts by a public tokenizer; the vocabulary file's path is a parameter."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

DEFAULT_VOCABULARY = os.environ.get("LODESTRATA_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.tiktoken")
#: The pattern that goes with the rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_SLICE = 200_000


@lru_cache(maxsize=4)
def encoding(path: str):
    """A byte-level BPE encoding from a rank file."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count(path: str, text: str) -> int:
    e = encoding(path)
    try:
        return len(e.encode_ordinary(text))
    except BaseException as error:  # a run of blanks beyond the pattern's limits
        if isinstance(error, (KeyboardInterrupt, SystemExit)) or len(text) <= _SLICE:
            raise
        return sum(len(e.encode_ordinary(text[i : i + _SLICE])) for i in range(0, len(text), _SLICE))


def token_count(text: Column, vocabulary: str = DEFAULT_VOCABULARY) -> Column:
    """Tokens of a text (null for null)."""

    @F.pandas_udf("bigint")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([None if t is None else count(vocabulary, t) for t in batch], dtype="Int64")

    return run(text)
