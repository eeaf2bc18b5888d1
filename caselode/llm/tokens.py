"""Text sizes in tokens of a public tokenizer."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caselode.session import spread

#: A vocabulary file of ranks; the same path must exist on every executor.
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Fixed value: the published pre-tokenizer pattern of this family of vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@cache
def _encoder(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(df: DataFrame, id_col: str, text_col: str, *keep: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """id, n_tokens and the ``keep`` columns of every row; NULL and empty texts have 0 tokens."""
    rows = df.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{text_col}`").alias("text"), *[F.col(f"`{c}`").cast("string").alias(c) for c in keep])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(vocabulary)
        for batch in batches:
            n = pa.array([len(encoder.encode_ordinary(t)) if t else 0 for t in batch.column(1).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), n, *batch.columns[2:]], names=["id", "n_tokens", *keep])

    return spread(rows).mapInArrow(count, ", ".join(["id bigint", "n_tokens bigint", *[f"`{c}` string" for c in keep]]))
