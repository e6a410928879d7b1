"""Safety decisions and their metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tunedata.functions.arrays import sigmoid
from tunedata.operators.filters import any_true

# --- fixed values: harm labels and thresholds ---------------------------------------
LABEL_NAMES = (
    "animal_abuse",
    "child_abuse",
    "controversial_topics,politics",
    "discrimination,stereotype,injustice",
    "drug_abuse,weapons,banned_substance",
    "financial_crime,property_crime,theft",
    "hate_speech,offensive_language",
    "misinformation_regarding_ethics,laws_and_safety",
    "non_violent_unethical_behavior",
    "privacy_violation",
    "self_harm",
    "sexually_explicit,adult_content",
    "terrorism,organized_crime",
    "violence,aiding_and_abetting,incitement",
)
DEFAULT_THRESHOLD = 0.4
METRIC_EPSILON = 1e-8
SAFE_VERDICT = "safe"
# ------------------------------------------------------------------------------------


def decide_labels(
    df: DataFrame, logits: str = "logits", *, labels: tuple[str, ...] = LABEL_NAMES,
    threshold: float = DEFAULT_THRESHOLD, as_bool: bool = False,
) -> DataFrame:
    """Add ``flagged`` and a ``categories`` map of probabilities, or of booleans."""
    names = F.array(*[F.lit(n) for n in labels])
    out = df.withColumn("_p", F.transform(logits, lambda x: sigmoid(x.cast("double"))))
    values = F.transform("_p", lambda p: p > threshold) if as_bool else F.col("_p")
    return (
        out.withColumn("flagged", F.array_max("_p") > threshold)
        .withColumn("categories", F.map_from_arrays(names, values))
        .drop("_p")
    )


def violated_categories(categories: Column) -> Column:
    """Names of the categories that are true."""
    return F.map_keys(F.map_filter(categories, lambda _, v: F.coalesce(v, F.lit(False))))


def flag_rate(df: DataFrame, by: list[str] | None = None, flagged: str = "flagged") -> DataFrame:
    hits = F.count_if(F.col(flagged))
    return df.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("n"),
        hits.alias("n_flagged"),
        (100 * F.try_divide(hits, F.count(F.lit(1)))).alias("flag_pct"),
    )


def binary_metrics(
    df: DataFrame, label: str = "label", predicted: str = "predicted", *, by: list[str] | None = None,
    eps: float = METRIC_EPSILON,
) -> DataFrame:
    """Counts, accuracy, precision, recall and F1 (the last three with ``eps``)."""
    y, p = F.col(label).cast("int"), F.col(predicted).cast("int")
    counts = df.groupBy(*(by or [])).agg(
        F.count_if((y == 1) & (p == 1)).alias("tp"),
        F.count_if((y == 0) & (p == 1)).alias("fp"),
        F.count_if((y == 0) & (p == 0)).alias("tn"),
        F.count_if((y == 1) & (p == 0)).alias("fn"),
    )
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    scored = counts.withColumn("accuracy", F.try_divide(tp + tn, tp + fp + tn + fn))
    scored = scored.withColumn("precision", tp / (tp + fp + eps)).withColumn("recall", tp / (tp + fn + eps))
    return scored.withColumn(
        "f1", 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall") + eps)
    )


def multilabel_metrics(
    df: DataFrame, label: str = "label", predicted: str = "predicted", *, labels: tuple[str, ...] = LABEL_NAMES
) -> DataFrame:
    """Binary metrics of "any label" and of each label, from boolean arrays."""
    names = F.array(*[F.lit(n) for n in ("flagged", *labels)])
    any_of = lambda c: F.concat(F.array(F.exists(c, lambda v: v)), F.col(c))
    rows = df.select(F.inline(F.arrays_zip(names.alias("name"), any_of(label).alias("y"), any_of(predicted).alias("p"))))
    return binary_metrics(rows, "y", "p", by=["name"])


def guard_miss_rate(df: DataFrame, categories: str = "category", verdict: str = "verdict") -> DataFrame:
    """Share of harmful samples a guard calls safe.

    A sample is harmful if any category is true. One whose check failed (null verdict)
    stays in the denominator and is never a miss.
    """
    harmful = any_true(F.col(categories))
    missed = harmful & F.coalesce(F.lower(F.col(verdict)) == SAFE_VERDICT, F.lit(False))
    return df.agg(F.count_if(harmful).alias("harmful"), F.count_if(missed).alias("missed")).withColumn(
        "fnr", F.try_divide(F.col("missed"), F.col("harmful"))
    )
