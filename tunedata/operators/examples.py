"""From normalised records to indexed training examples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tunedata.operators.filters import keep_trainable, word_count
from tunedata.operators.indexing import dense_ids
from tunedata.session import cut_lineage


def index_examples(
    df: DataFrame, key: str, *, max_length: int, tokens: Column | None = None, pretrain: bool = False
) -> DataFrame:
    """Drop unusable examples and number the rest ``0, 1, 2, ...`` in ``key`` order.

    ``df`` has ``prompt`` and ``response``; ``tokens`` counts a prompt's tokens (white-space
    tokens by default) and is worked out once: the surviving keys and counts are
    checkpointed, numbered, and joined back to the rows.
    """
    n = word_count(F.col("prompt")) if tokens is None else tokens
    counted = df.select(key, "prompt", "response", F.least(n, F.lit(max_length)).alias("prompt_tokens"))
    kept = keep_trainable(counted, max_length=max_length, pretrain=pretrain).select(key, "prompt_tokens")
    ids = dense_ids(cut_lineage(kept), key)
    return df.drop("prompt_tokens").join(ids, key)
