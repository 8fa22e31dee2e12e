"""Sizes in tokens of a public tokenizer."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codeloom.session import spread

#: Where the vocabulary files are; a parameter of every operator that counts tokens.
VOCABULARY = os.environ.get("CODELOOM_TOKENIZERS", "/opt/tokenizers") + "/byte_bpe_50k.tiktoken"

# fixed value: the published split pattern of the 50k byte-level vocabulary
SPLIT = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=2)
def encoding(path: str):
    """The tokenizer of a ``.tiktoken`` rank file, once per Python worker."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})


def token_counts(df: DataFrame, keep: list[str], text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """``keep`` columns plus ``n_tokens`` (long) of the whole text.

    Null and empty texts have 0 tokens.  No shuffle; only ``keep`` and the text
    are read, and the text does not come back.
    """

    def count(batches: Iterator) -> Iterator:
        import pyarrow as pa

        enc = encoding(vocabulary)
        for b in batches:
            texts = b.column("_text").to_pylist()
            n = [len(enc.encode_ordinary(t)) if t else 0 for t in texts]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], pa.array(n, pa.int64())], names=[*keep, "n_tokens"])

    cols = [F.col(f"`{c}`") for c in keep]
    schema = T.StructType([*df.select(*cols).schema.fields, T.StructField("n_tokens", T.LongType())])
    return spread(df.select(*cols, F.col(f"`{text}`").alias("_text"))).mapInArrow(count, schema)
