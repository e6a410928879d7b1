import math
import re

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import Row, functions as F

from tunedata.functions import answers as an
from tunedata.functions.templates import between, strip_echo
from tunedata.operators import evaluation as ev
from tunedata.operators import exams as ex
from tunedata.operators import ranking as rk
from tunedata.operators import safety as sf
from tunedata.operators import tasks as tk

MARK = tk.ANSWER_MARK
CASES = [
    ("no number at all", math.inf), (f"{MARK}none", math.inf), (f"3 and {MARK}none", 3.0), (f"{MARK}1 {MARK}2", 1.0),
    ("total 1,234.", 1234.0), ("x -0.5", -0.5), (f"9 {MARK}-1,000.25 or 4", -1000.25), ("", math.inf),
]


@pytest.mark.parametrize("text,want", CASES)
def test_number(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(an.extract_number(F.col("t"), MARK).alias("x")).first().x == want


def test_two_missing_numbers_agree_unless_told_otherwise(spark):
    df = spark.createDataFrame([("none", "nothing"), ("3", "3.0")], "a string, b string")
    score = lambda **k: ev.accuracy(ev.numeric_match(df, "a", "b", **k)).first().score_pct
    assert score() == 100.0 and score(count_missing=False) == 50.0
    assert ev.accuracy(ev.numeric_match(df.limit(0), "a", "b")).first().score_pct is None


def options(a="w", b="x", c="y", d="z"):
    return dict(zip("ABCD", (a, b, c, d)))


def columns(opts):
    return {k: F.lit(v) for k, v in opts.items()}


CHOICE_CASES = [
    ("所以答案是E。选A", options(), "A", False),
    ("所以答案是A。所以答案是C。", options(), "C", True),
    ("选择B，D是正确的", options(), "D", False),
    ("hmm B or C", options(), "B", False),
    ("it is yes", options("no", "yes", "it is", "yes"), "C", False),
    ("say yes", options("no", "yes", "maybe", "yes"), "D", False),
    ("xy", options("y", "xy", "x", "q"), "B", False),
]


@pytest.mark.parametrize("text,opts,answer,direct", CHOICE_CASES)
def test_choice_cascade(spark, text, opts, answer, direct):
    df = spark.createDataFrame([(1, text)], "id int, t string")
    row = df.select(an.extract_choice(F.col("t"), columns(opts), 1, "id").alias("r")).first().r
    assert (row.answer, row.direct) == (answer, direct)


def test_unusable_choice_is_seeded(spark):
    df = spark.range(400).withColumn("t", F.lit("???"))
    pick = lambda seed: [r.r.answer for r in df.select(an.extract_choice(F.col("t"), columns(options()), seed, "id").alias("r")).collect()]
    assert pick(1) == pick(1) != pick(2) and set(pick(1)) == set("ABCD")


def test_argmax(spark):
    nan, inf = float("nan"), float("inf")
    rows = [([1.0, 2.0, 2.0, 0.0], [0.0] * 4), ([nan, 1.0, 1.0, 1.0], [0.0] * 4), ([inf, 1.0, 1.0, 1.0], [0.0] * 4)]
    df = spark.createDataFrame(rows, "a array<double>, b array<double>")
    assert [r.x for r in df.select(an.argmax_choice(F.col("a"), F.col("b")).alias("x")).collect()] == ["B", None, None]


@settings(max_examples=25, deadline=None)
@given(st.text(alphabet="aB!?. \n\tΩ-_", max_size=30))
def test_normalise_answer_property(spark, text):
    bare = re.sub(r"[!-/:-@\[-`{-~]", "", text.lower())
    got = spark.createDataFrame([(text,)], "t string").select(an.normalise_answer(F.col("t")).alias("x")).first().x
    assert got == " ".join(bare.split())


def test_echo(spark):
    df = spark.createDataFrame([("p### Response:\n a \n### Response: b",), ("none",)], "t string")
    assert [r.x for r in df.select(strip_echo(F.col("t")).alias("x")).collect()] == ["a", None]


def test_untemplate(spark):
    text = "x### Instruction:\ni\n\n### Input:\nv\n\n### Response:\n"
    df = spark.createDataFrame([(text, s) for s in ("ft", "harmful", "system")], "p string, s string")
    got = [r.x for r in df.select(rk.untemplate(F.col("p"), F.col("s")).alias("x")).collect()]
    assert got == ["v", "i\n\n### Input:\nv", text]
    assert df.select(between(F.col("p"), "absent", "### Input").alias("x")).first().x == "x### Instruction:\ni"


def test_few_shot_all_and_none(spark):
    dev = spark.createDataFrame([("s", i, f"q{i}") for i in range(4)], "subject string, pos int, q string")
    text = lambda k: ex.few_shot_prefix(dev, F.col("q"), k).first().prefix
    assert text(-1).endswith("q0q1q2q3") and text(2).endswith("\n\nq0q1") and text(0).endswith("\n\n")


def test_rollup_is_weighted(spark):
    scores = spark.createDataFrame([("a", 3, 3), ("b", 1, 0), ("c", 4, 1)], "subject string, n bigint, n_correct bigint")
    groups = spark.createDataFrame([("a", "g"), ("b", "g"), ("c", "h")], "subject string, grp string")
    got = {r.grp: r.score_frac for r in ex.rollup_scores(scores, groups).collect()}
    assert got == {"g": 0.75, "h": 0.25, "All": 0.5}


def test_later_category_wins(spark):
    sub = spark.createDataFrame([("law", ["x", "y"]), ("art", ["x"])], "subject string, subcat array<string>")
    cat = spark.createDataFrame([("General", ["x"], 0), ("Special", ["y"], 1)], "category string, subcats array<string>, ord int")
    assert {r.subject: r.category for r in ex.resolve_categories(sub, cat).collect()} == {"law": "Special", "art": "General"}


def test_threshold_is_strict(spark):
    df = spark.createDataFrame([([0.0] * 14,)], "logits array<double>")
    assert sf.decide_labels(df, threshold=0.5).first().flagged is False
    assert sf.decide_labels(df).first().flagged is True
    marks = sf.decide_labels(df, threshold=0.4, as_bool=True).select(sf.violated_categories(F.col("categories")).alias("v"))
    assert marks.first().v == list(sf.LABEL_NAMES)


def test_binary_metrics_of_one_class(spark):
    row = sf.binary_metrics(spark.createDataFrame([(0, 0), (0, 0)], "label int, predicted int")).first()
    assert (row.accuracy, row.precision, row.recall, row.f1) == (1.0, 0.0, 0.0, 0.0)


def test_guard_errors_stay_in_the_denominator(spark):
    rows = [({"a": True}, "SAFE"), ({"a": True}, None), ({"a": False}, "safe"), ({"a": True}, "unsafe")]
    row = sf.guard_miss_rate(spark.createDataFrame(rows, "category map<string,boolean>, verdict string")).first()
    assert (row.harmful, row.missed) == (3, 1)


def test_forms(spark):
    df = spark.createDataFrame([Row(p="sci/tech"), Row(p="sci"), Row(p="Sci/Tech"), Row(p=None)])
    got = [r.x for r in df.select(ev.matches_forms(F.col("p"), F.lit(3), tk.NEWS_FORMS).alias("x")).collect()]
    assert got == [False, True, True, False]
