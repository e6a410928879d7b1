"""Multiple-choice exams: prompts, answers, scores by subject and group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tunedata.functions.answers import CHOICES, argmax_choice, extract_choice
from tunedata.functions.templates import DEFAULT_SYSTEM_TEXT, system_chat

__all__ = ["argmax_choice", "extract_choice"]

# --- fixed values: exam texts -------------------------------------------------------
ANSWER_HEAD = "\n答案："
STEP_HEAD = "\n答案：让我们一步一步思考，\n"
FINAL_HEAD = "\n所以答案是"
FINAL_TAIL = "。\n\n"
ASK = "\n答案是什么？ "
ASK_STEPS = "\n答案是什么？让我们一步一步思考，\n1."
FIRST_STEP = "1."
HEADER_BEFORE = "以下是中国关于"
HEADER_AFTER = "考试的单项选择题，请选出其中的正确答案。\n\n"
CHAT_REPLY_BEFORE = "好的，我会结合"
CHAT_REPLY_AFTER = "相关知识回答"
CHAT_OPEN = "[INST] "
CHAT_ANSWER = "\n答案：[/INST]"
HIDDEN_ANSWER = "NA"
# ------------------------------------------------------------------------------------


def question_block(question: Column, options: dict[str, Column]) -> Column:
    lines = [F.concat(F.lit(f"\n{c}. "), options[c].cast("string")) for c in CHOICES]
    return F.concat(question, *lines)


def format_choices(
    question: Column,
    options: dict[str, Column],
    *,
    answer: Column | None = None,
    explanation: Column | None = None,
    cot: bool = False,
    with_prompt: bool = False,
    chat_suffix: str = ASK,
) -> Column:
    """Question with its options; with ``answer`` a worked example, else a prompt to complete."""
    block = question_block(question, options)
    if answer is not None:
        if cot:
            return F.concat(block, F.lit(STEP_HEAD), explanation, F.lit(FINAL_HEAD), answer, F.lit(FINAL_TAIL))
        return F.concat(block, F.lit(ANSWER_HEAD), answer, F.lit("\n\n"))
    if with_prompt:
        return F.concat(block, F.lit(ASK_STEPS if cot else chat_suffix))
    return F.concat(block, F.lit(STEP_HEAD + FIRST_STEP if cot else ANSWER_HEAD))


def exam_header(subject: Column) -> Column:
    return F.concat(F.lit(HEADER_BEFORE), subject, F.lit(HEADER_AFTER))


def chat_header(subject: Column, system_text: str = DEFAULT_SYSTEM_TEXT) -> Column:
    reply = F.concat(F.lit(CHAT_REPLY_BEFORE), subject, F.lit(CHAT_REPLY_AFTER))
    return F.concat(system_chat(exam_header(subject), system_text), reply)


def chat_example(question: Column, options: dict[str, Column], answer: Column) -> Column:
    return F.concat(F.lit(CHAT_OPEN), question_block(question, options), F.lit(CHAT_ANSWER), answer, F.lit("\n"))


def few_shot_prefix(
    dev: DataFrame, example: Column, k: int, *, subject: str = "subject", order: str = "pos", chat: bool = False
) -> DataFrame:
    """Header and the first ``k`` worked examples per subject (-1 takes all).

    Examples are cut to ``k`` in every partition before they are gathered or built, so only a
    prompt's worth of text meets in one row. All of a subject must fit a prompt, so -1 is for small sets.
    """
    picked = dev
    if k >= 0:
        first = Window.partitionBy(subject).orderBy(order)
        picked = dev.withColumn("_rank", F.row_number().over(first)).filter(F.col("_rank") <= k)
    picked = picked.withColumn("_example", example)
    header = chat_header(F.col(subject)) if chat else exam_header(F.col(subject))
    shots = picked.groupBy(subject).agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct(order, "_example"))), lambda s: s["_example"]), ""
        ).alias("_shots")
    )
    subjects = dev.select(subject).distinct()
    return subjects.join(shots, subject, "left").select(
        subject, F.concat(header, F.coalesce(F.col("_shots"), F.lit(""))).alias("prefix")
    )


def expected_answers(answer: Column, hidden: bool) -> Column:
    """Answer key, or a placeholder where the key is withheld."""
    return F.lit(HIDDEN_ANSWER) if hidden else answer


def subject_scores(df: DataFrame, *, answer: str = "answer", expected: str = "expected", by: tuple[str, ...] = ("subject",)) -> DataFrame:
    """Questions, right answers and percent score per subject (and take)."""
    right = F.count_if(F.col(answer) == F.col(expected))
    total = F.count(F.lit(1))
    return df.groupBy(*by).agg(
        total.alias("n"), right.alias("n_correct"), (100 * right / total).alias("score_pct")
    )


def rollup_scores(scores: DataFrame, subjects: DataFrame, *, subject: str = "subject", grp: str = "grp") -> DataFrame:
    """Scores per group and over all, weighted by questions, as fractions."""
    joined = scores.join(subjects.select(subject, grp), subject)
    return (
        joined.rollup(grp)
        .agg(F.sum("n").alias("n"), F.sum("n_correct").alias("n_correct"), F.grouping(grp).alias("_all"))
        .select(
            F.when(F.col("_all") == 1, F.lit("All")).otherwise(F.col(grp)).alias("grp"),
            "n",
            "n_correct",
            F.try_divide(F.col("n_correct"), F.col("n")).alias("score_frac"),
        )
    )


def resolve_categories(subcategories: DataFrame, categories: DataFrame) -> DataFrame:
    """Category of each subject through its subcategories; the category listed last wins."""
    pairs = subcategories.select("subject", F.explode("subcat").alias("_sub"))
    named = categories.select("category", "ord", F.explode("subcats").alias("_sub"))
    return pairs.join(named, "_sub").groupBy("subject").agg(
        F.max_by("category", F.struct("ord", "category")).alias("category")
    )


def repeat_takes(df: DataFrame, takes: int) -> DataFrame:
    """Every question once per take; one job instead of one run per take."""
    return df.select("*", F.explode(F.sequence(F.lit(0), F.lit(takes - 1))).alias("take"))
