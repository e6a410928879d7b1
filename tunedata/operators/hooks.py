"""Where a caller's own model enters: vectorised functions over Arrow batches.

No model is shipped. The caller passes a loader, run once per Python worker task, and a
function from a batch of inputs to a batch of outputs. It gets ``BATCH_BYTES`` of text at a time, and only
these become Python objects: an Arrow batch can be 10,000 long texts, of which a model's own steps make copies.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from tunedata.operators.filters import word_tokens

#: Bytes of text a caller's function gets at once; one longer text is a batch of its own.
BATCH_BYTES = 1 << 20


def _batched(
    load: Callable[[], object], run: Callable[[object, pd.Series], pd.Series | pd.DataFrame], returns: str, kind: pa.DataType,
) -> Callable[[Column], Column]:
    """``run`` on a column, ``BATCH_BYTES`` of its rows at a time."""
    size = BATCH_BYTES

    def pieces(batch: pa.Array) -> Iterator[pd.Series]:
        lengths = np.full(len(batch), batch.nbytes // max(1, len(batch)))
        if pa.types.is_string(batch.type) or pa.types.is_large_string(batch.type):
            lengths = pc.fill_null(pc.binary_length(batch), 0).to_numpy(zero_copy_only=False)
        ends, low = np.cumsum(lengths, dtype=np.int64), 0
        while low < len(batch):
            most = size + (ends[low - 1] if low else 0)
            high = max(low + 1, int(np.searchsorted(ends, most, side="right")))
            yield batch.slice(low, high - low).to_pandas()
            low = high

    def arrow(values: pd.Series | pd.DataFrame, kind: pa.DataType) -> pa.Array:
        if pa.types.is_struct(kind):
            return pa.StructArray.from_arrays([arrow(values[field.name], field.type) for field in kind], fields=list(kind))
        try:
            return pa.Array.from_pandas(values, type=kind)
        except pa.ArrowInvalid:  # of another type, which Spark casts
            return pa.Array.from_pandas(values)

    @F.arrow_udf(returns)
    def infer(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = load()
        for batch in batches:
            for texts in pieces(batch):
                found = run(model, texts)
                if len(found) != len(texts):
                    raise ValueError(f"{len(found)} outputs for {len(texts)} inputs")
                yield arrow(found, kind)
            del batch  # before the next one is read

    return infer


def _list_of(kind: pa.DataType) -> pa.DataType:
    return pa.list_(pa.field("element", kind))


def generate(
    df: DataFrame, prompt: str, load: Callable[[], object],
    run: Callable[[object, pd.Series], pd.Series], out: str = "output",
) -> DataFrame:
    """Add the generated text of each prompt."""

    return df.withColumn(out, _batched(load, run, "string", pa.string())(F.col(prompt)))


def tokens(text: Column, tokenize: Callable[[pd.Series], pd.Series] | None = None) -> Column:
    """Token ids by the caller's tokenizer, or white-space tokens on the JVM without one."""
    if tokenize is None:
        return word_tokens(text)
    return _batched(lambda: None, lambda _, texts: tokenize(texts), "array<bigint>", _list_of(pa.int64()))(text)


def label_scores(
    df: DataFrame, text: str, load: Callable[[], object],
    run: Callable[[object, pd.Series], pd.Series], out: str = "logits",
) -> DataFrame:
    """Add one array of label logits per text; decisions are made from it by built-ins."""

    return df.withColumn(out, _batched(load, run, "array<double>", _list_of(pa.float64()))(F.col(text)))


def judged(model: object, check: Callable[[object, pd.Series], pd.Series], texts: pd.Series) -> pd.DataFrame:
    """Verdict and error of each text. Where ``check`` fails it is tried on both halves, down to single texts.

    So k texts that fail of n cost at most some 2 k log2(n) + 1 calls, and their errors are their own.
    """
    out = pd.DataFrame({"verdict": None, "error": None}, index=range(len(texts)), dtype="object")
    waiting = [(0, len(texts))] if len(texts) else []
    while waiting:
        low, high = waiting.pop()
        try:
            found = list(check(model, texts.iloc[low:high]))
            if len(found) != high - low:
                raise ValueError(f"{len(found)} verdicts for {high - low} texts")
            out.iloc[low:high, 0] = found
        except Exception as problem:  # noqa: BLE001 - any failure of the caller's model
            if high - low == 1:
                out.iloc[low, 1] = f"{type(problem).__name__}: {problem}"
            else:
                middle = (low + high) // 2
                waiting += [(middle, high), (low, middle)]
    return out


def guard_verdicts(
    df: DataFrame, text: str, load: Callable[[], object], check: Callable[[object, pd.Series], pd.Series],
) -> DataFrame:
    """Add ``verdict`` and ``error``: a text the guard fails on keeps its row, with the error.

    ``check`` judges a batch of texts. A batch on which it fails is halved until the texts that fail stand alone.
    """

    judge = _batched(
        load, lambda model, texts: judged(model, check, texts), "verdict string, error string",
        pa.struct([("verdict", pa.string()), ("error", pa.string())]))
    return df.withColumn("_judged", judge(F.col(text))).select(
        *df.columns, F.col("_judged.verdict").alias("verdict"), F.col("_judged.error").alias("error")
    )
