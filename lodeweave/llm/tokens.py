"""Token counts of texts under a public byte-level BPE vocabulary (a file of ranks; never trained here)."""

from __future__ import annotations

import base64
import functools
import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodeweave.plans.runtime import spread

#: Where the vocabulary lies on every machine; a parameter of each operator that counts tokens.
VOCABULARY = os.environ.get("LODEWEAVE_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.tiktoken")
# Fixed value: the pre-tokenisation pattern that belongs to this vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@functools.lru_cache(maxsize=4)
def encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("from-file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(texts: DataFrame, text: str, path: str = VOCABULARY, out: str = "tokens") -> DataFrame:
    """texts with the whole text replaced by its number of tokens (LONG); NULL stays NULL, an empty text has 0."""
    keep = [f for f in texts.schema.fields if f.name not in (text, out)]
    schema = T.StructType([*keep, T.StructField(out, T.LongType())])
    names = [f.name for f in schema.fields]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoding(path).encode_ordinary
        for rows in batches:
            rows[out] = pd.Series([None if x is None else len(encode(x)) for x in rows[text]], index=rows.index, dtype="Int64")
            yield rows[names]

    return spread(texts.select(*[F.col(f.name) for f in keep], F.col(text))).mapInPandas(run, schema)
