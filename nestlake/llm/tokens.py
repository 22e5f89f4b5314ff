"""Token counts by a public byte-level BPE vocabulary."""

from __future__ import annotations

import base64
import functools
import os

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Vocabulary of ranks; any file of the same form may be given instead.
VOCABULARY = os.environ.get("NESTLAKE_VOCABULARY", "/opt/tokenizers/byte_bpe_multi_50k.tiktoken")
# Fixed value: the pre-tokenisation pattern that belongs to these vocabularies.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@functools.cache
def encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(text: str | Column, path: str = VOCABULARY) -> Column:
    """Tokens of a text column; a null text has none."""

    @F.pandas_udf("int")
    def count(texts: pd.Series) -> pd.Series:
        e = encoding(path)
        return texts.map(lambda t: len(e.encode_ordinary(t)) if isinstance(t, str) else 0).astype("int32")

    return count(text)
