"""Token sequences: assembly, label masks, positions, repair.

Arrays hold one sequence per row, so these are expressions within a row. Tables with
one row per token use the long form.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tunedata.functions.arrays import let
from tunedata.operators.indexing import running_sums

# --- fixed values -------------------------------------------------------------------
IGNORE_LABEL = -100
MASKED_POSITION = 1
# ------------------------------------------------------------------------------------


def assemble(prompt: Column, response: Column, eos: Column, max_length: int) -> Column:
    """Prompt, response and end token, cut to ``max_length``, with the last token forced to ``eos``."""
    whole = F.slice(F.concat(prompt, response, F.array(eos)), 1, max_length)
    return F.concat(F.slice(whole, F.lit(1), F.size(whole) - 1), F.array(eos))


def label_mask(tokens: Column, prompt_tokens: Column, mask: Column | None = None) -> Column:
    """Tokens as labels, with the prompt and masked positions set to the ignored label."""
    ignored = F.lit(IGNORE_LABEL).cast("bigint")
    if mask is None:
        return F.transform(tokens, lambda t, i: F.when(i < prompt_tokens, ignored).otherwise(t))
    pairs = F.arrays_zip(tokens.alias("t"), mask.alias("m"))
    return F.transform(
        pairs,
        lambda p, i: F.when((i < prompt_tokens) | (p["m"] == 0), ignored).otherwise(p["t"]),
    )


def token_positions(
    tokens: DataFrame, seq: str, key: str, mask: str, *, tie: Sequence[str] = (), out: str = "position_id"
) -> DataFrame:
    """Position ids over unmasked tokens (long form); masked tokens get 1."""
    counted = running_sums(tokens, key, {out: F.col(mask).cast("bigint")}, by=[seq], tie=tie)
    masked = F.lit(MASKED_POSITION).cast("bigint")
    return counted.withColumn(out, F.when(F.col(mask) == 0, masked).otherwise(F.col(out) - 1))


def repair_generated(
    df: DataFrame, tokens: str, *, prompt_length: str, eos: int, pad: int
) -> DataFrame:
    """End generated sequences with ``eos`` right after their last real token.

    Adds ``attention_mask`` and ``action_mask``. A sequence that fills its width, or has
    no real token, gets ``eos`` in its last slot.
    """
    real = lambda t: (t != eos) & (t != pad)
    last = F.coalesce(F.array_max(F.transform(tokens, lambda t, i: F.when(real(t), i))), F.lit(-1))
    width = F.size(tokens)

    def repaired(last: Column) -> Column:
        end = F.when(last < 0, width - 1).otherwise(F.least(last + 1, width - 1))
        return F.struct(
            F.transform(tokens, lambda t, i: F.when(i == end, F.lit(eos)).otherwise(t)).alias("tokens"),
            F.transform(tokens, lambda t, i: (real(t) | (i == end)).cast("int")).alias("mask"),
        )

    fixed = df.withColumn("_fixed", let(last, repaired))
    fixed = fixed.withColumn(tokens, F.col("_fixed.tokens")).withColumn("attention_mask", F.col("_fixed.mask"))
    states = F.slice(F.col(tokens), F.col(prompt_length), F.size(tokens) - F.col(prompt_length))
    return fixed.withColumn(
        "action_mask", F.transform(states, lambda t: real(t).cast("int"))
    ).drop("_fixed")
