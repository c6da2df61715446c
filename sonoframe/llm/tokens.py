"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: Rank file of the byte-level BPE that sizes are measured in; any such file may be given instead.
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"

#: Splits text before the merges of the rank files (fixed value of the vocabulary).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_encodings: dict[int, object] = {}


def _encoding(rank_file: bytes):
    key = hash(rank_file)
    if key not in _encodings:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, rank_file.splitlines()) if a}
        _encodings[key] = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encodings[key]


def token_count(spark: SparkSession, text: Column, vocabulary: str = VOCABULARY) -> Column:
    """Number of tokens of a text, as int; 0 for a null or empty one. Special tokens are ordinary text.

    The rank file (under 1 MB) is read on the driver and broadcast, so executors need no file.
    """
    ranks = spark.sparkContext.broadcast(Path(vocabulary).read_bytes())

    def counts(parts: Iterator["pd.Series"]) -> Iterator["pd.Series"]:
        import pandas as pd

        encoding = _encoding(ranks.value)
        for part in parts:
            yield pd.Series([len(encoding.encode_ordinary(t)) if t else 0 for t in part], dtype="int32")

    import pandas as pd

    counts.__annotations__ = {"parts": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(counts, "int")(text)
