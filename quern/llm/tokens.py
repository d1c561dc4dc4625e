"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from quern.operators.skew import spread

#: A byte-level BPE vocabulary as ranks, and how it splits text before merging.
DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
DEFAULT_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@functools.lru_cache(maxsize=2)
def encoder(vocabulary: str = DEFAULT_VOCABULARY, pattern: str = DEFAULT_PATTERN):
    """The tokenizer of a vocabulary file; once per process."""
    import tiktoken

    with open(vocabulary, "rb") as file:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
    return tiktoken.Encoding("public", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def with_token_counts(
    df: DataFrame, text: str = "text", vocabulary: str = DEFAULT_VOCABULARY, pattern: str = DEFAULT_PATTERN
) -> DataFrame:
    """df with its text column replaced by n_tokens (long), the size of the whole text.

    A column n_tokens the input has already is replaced. A null or empty text has 0 tokens. Special tokens' strings count as
    ordinary text. The other columns pass through as Arrow buffers; select
    what is needed first. The vocabulary file must be readable on every
    worker; its path is a parameter.
    """
    keep = [f for f in df.schema.fields if f.name not in (text, "n_tokens")]
    names = [f.name for f in keep]

    def run(batches):
        encode = encoder(vocabulary, pattern).encode_ordinary
        for batch in batches:
            counts = np.fromiter((len(encode(t)) if t else 0 for t in batch.column(text).to_pylist()), np.int64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(counts)], [*names, "n_tokens"])

    return spread(df.select(*names, text)).mapInArrow(run, T.StructType([*keep, T.StructField("n_tokens", T.LongType())]))
