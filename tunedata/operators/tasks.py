"""Instruction records from labelled task data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tunedata.operators.filters import first_rows

# --- fixed values: instructions, class names and answer markers of the tasks --------
SENTIMENT_INSTRUCTION = "Analyze the sentiment of the input, and respond only positive or negative"
SENTIMENT_NAMES = ("negative", "positive")
NEWS_INSTRUCTION = (
    "Categorize the news article given in the input into one of the 4 categories:\n\n"
    "World\nSports\nBusiness\nSci/Tech\n"
)
NEWS_NAMES = ("World", "Sports", "Business", "Sci/Tech")
SENTIMENT_FORMS = (("negative", "Negative"), ("positive", "Positive"))
NEWS_FORMS = (("World", "world"), ("Sports", "sports"), ("Business", "business"), ("Sci/Tech", "sci"))
RAW_ANSWER_MARK = "####"
ANSWER_MARK = "The final answer is: "
# ------------------------------------------------------------------------------------


def class_name(label: Column, names: tuple[str, ...]) -> Column:
    """Name by label number; every number without an own name gets the last one."""
    result = None
    for number, name in enumerate(names[:-1]):
        result = F.when(label == number, name) if result is None else result.when(label == number, name)
    return result.otherwise(names[-1])


def label_task(
    df: DataFrame, text: str, label: str, instruction: str, names: tuple[str, ...]
) -> DataFrame:
    return df.select(
        *[c for c in df.columns if c not in (text, label)],
        F.lit(instruction).alias("instruction"),
        F.col(text).alias("input"),
        class_name(F.col(label), names).alias("output"),
    )


def sentiment_task(df: DataFrame, text: str = "sentence", label: str = "label") -> DataFrame:
    return label_task(df, text, label, SENTIMENT_INSTRUCTION, SENTIMENT_NAMES)


def news_task(df: DataFrame, text: str = "text", label: str = "label") -> DataFrame:
    return label_task(df, text, label, NEWS_INSTRUCTION, NEWS_NAMES)


def arithmetic_task(df: DataFrame, question: str = "question", answer: str = "answer") -> DataFrame:
    return df.select(
        *[c for c in df.columns if c not in (question, answer)],
        F.col(question).alias("instruction"),
        F.replace(F.col(answer), F.lit(RAW_ANSWER_MARK), F.lit(ANSWER_MARK)).alias("output"),
    )


def generator_task(df: DataFrame, generator: str, n: int, order: str) -> DataFrame:
    """First ``n`` records of one generator, instruction and output only."""
    chosen = df.filter(F.col("generator") == generator)
    return first_rows(chosen, n, order).select(order, "instruction", "output")
