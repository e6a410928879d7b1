import pytest
from pyspark.sql import Row, functions as F

from tunedata.functions import templates as tp
from tunedata.operators import filters as fl
from tunedata.operators import normalise as nz


def test_first_shape_wins_and_null_is_absent(spark):
    df = spark.createDataFrame(
        [(1, "p", "c", "l", None), (2, "USER:p", None, "l</s>", None), (3, None, "c", "l", None), (4, "p", None, None, "t")],
        "id int, prompt string, chosen string, label string, target string")
    got = {r.id: (r.shape, r.prompt, r.response) for r in nz.normalise_sft(df).collect()}
    assert got[1] == ("chosen", "p", "c")
    assert got[2] == ("labelled_chat", "p", "l")
    assert got[3] == ("unknown", None, None)
    assert got[4][0] == "adv_prompts" and got[4][1].endswith("### Instruction:\np\n\n### Response:\n")


def test_instruction_input_variants(spark):
    rows = [("i", None, "o", "ft"), ("i", "", "o", None), ("i", "x", "", "ft")]
    df = spark.createDataFrame(rows, "instruction string, input string, output string, source string")
    got = nz.normalise_sft(df).collect()
    assert [("### Input:" in r.prompt) for r in got] == [False, False, True]
    assert [r.source for r in got] == ["ft", None, "ft"] and got[2].response == ""
    strict = nz.normalise_sft(df, require_input=True).collect()
    assert [r.shape for r in strict] == ["unknown", "instruct", "instruct"]


def test_toxic_prompt_structs(spark):
    df = spark.createDataFrame([Row(begin=0, end=3, prompt=Row(text="p"), continuation=Row(text="c"), source="s")])
    row = nz.normalise_sft(df).first()
    assert (row.shape, row.response, row.source) == ("toxic_prompts", "c", "s")
    assert "### Instruction:\np\n" in row.prompt


def test_safety_record_with_false_flag(spark):
    df = spark.createDataFrame([("p", "r", {"self_harm": False}, False)], "prompt string, response string, category map<string,boolean>, is_safe boolean")
    assert nz.normalise_sft(df).first().shape == "safety_qa"


def test_arena_ties(spark):
    turns = lambda t: [Row(role="user", content="q"), Row(role="assistant", content=t)]
    schema = "winner string, conversation_a array<struct<role:string,content:string>>, conversation_b array<struct<role:string,content:string>>"
    df = spark.createDataFrame([("model_a", turns("a"), turns("b")), ("model_b", turns("a"), turns("b")), ("tie", turns("a"), turns("b"))], schema)
    got = [r.chosen for r in nz.normalise_pairs(df).collect()]
    assert got == ["qa\n", "qb\n", "qb\n"]
    assert nz.normalise_pairs(df, drop_ties=True).count() == 2


def test_equal_scores_choose_second_answer(spark):
    df = spark.createDataFrame([("q", "a0", "a1", 0.5, 0.5, None)], "question string, answer_0 string, answer_1 string, score_0 double, score_1 double, margin double")
    row = nz.normalise_pairs(df).first()
    assert (row.chosen, row.rejected, row.margin) == ("a1", "a0", 0.0)
    assert nz.normalise_pairs(df, drop_ties=True).count() == 0


def test_dialogue_markers(spark):
    df = spark.createDataFrame([("prompter:hiassistant:yo", "c"), ("x prompter:", "c")], "prompt string, chosen string")
    got = [r.prompt for r in nz.normalise_prompts(df, template=tp.HUMAN_TEMPLATE).collect()]
    assert got == ["\nHuman: hi\nAssistant: yo\nAssistant: ", "x prompter:"]


def test_single_turn_conversation(spark):
    df = spark.createDataFrame([(1, [Row(role="user", content="only")])], "id int, turns array<struct<role:string,content:string>>")
    row = nz.flatten_conversation(df).first()
    assert (row.prompt, row.response) == ("", "only")


def test_length_edges(spark):
    df = spark.createDataFrame([(97,), (98,), (100,), (500,)], "prompt_tokens int").withColumn("prompt", F.lit("p")).withColumn("response", F.lit("r"))
    assert [r.prompt_tokens for r in fl.keep_trainable(df, max_length=100).collect()] == [97]
    assert fl.keep_trainable(df, max_length=100, pretrain=True).count() == 4
    empty = df.withColumn("response", F.when(F.col("prompt_tokens") == 97, "").otherwise(F.lit(None).cast("string")))
    assert fl.keep_trainable(empty, max_length=1000).count() == 0


def test_predicates(spark):
    df = spark.createDataFrame([(1, True), (2, False), (3, None)], "id int, is_safe boolean")
    assert [r.id for r in fl.keep_unsafe(df).collect()] == [2, 3]
    marks = spark.createDataFrame([({"a": False, "b": True},), ({"a": False},), ({},), (None,)], "m map<string,boolean>")
    assert [r.x for r in marks.select(fl.any_true(F.col("m")).alias("x")).collect()] == [True, False, False, False]
    with pytest.raises(ValueError):
        fl.keep_source(df, "other")
    assert fl.first_rows(df, None, "id").count() == 3


def test_strip_and_count_use_all_white_space(spark):
    df = spark.createDataFrame([("　 a b\x1cc \n",)], "t string")
    row = df.select(tp.strip(F.col("t")).alias("s"), fl.word_count(F.col("t")).alias("n")).first()
    assert row.s == "a b\x1cc" and row.n == len("　 a b\x1cc \n".split()) == 3
