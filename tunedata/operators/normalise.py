"""Bring mixed corpora to one schema.

A record belongs to the first shape whose listed columns are all present and not
null. Absent columns count as null, so one function serves a single corpus as well
as a union of many. Each result carries the name of the matched ``shape``; records
that match none get ``shape = 'unknown'`` and can be filtered to quarantine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tunedata.functions import templates as tp

UNKNOWN = "unknown"


def _text(df: DataFrame, name: str, field: str | None = None) -> Column:
    """Column as text; a struct column gives its ``field``, a missing one null."""
    if name not in df.columns:
        return F.lit(None).cast("string")
    if isinstance(df.schema[name].dataType, T.StructType):
        return F.col(name)[field] if field else F.lit(None).cast("string")
    return F.col(name).cast("string")


def _present(df: DataFrame, *names: str) -> Column:
    condition = F.lit(True)
    for name in names:
        condition = condition & (F.col(name).isNotNull() if name in df.columns else F.lit(False))
    return condition


def _turns(df: DataFrame, name: str, template: str, *, drop_last: bool, role: str, value: str, marker: str):
    if name not in df.columns:
        return F.lit(None).cast("string")
    turns = tp.all_but_last(F.col(name)) if drop_last else F.col(name)
    return tp.render_turns(turns, role, value, marker, template)


def _dispatch(df: DataFrame, shapes: list[tuple[str, Column, dict[str, Column]]], fields: dict[str, str]) -> DataFrame:
    """Keep other columns, add ``shape`` and the fields of the first matching shape."""

    def chain(pick, default: Column) -> Column:
        result = None
        for name, matches, values in shapes:
            value = pick(name, values)
            result = F.when(matches, value) if result is None else result.when(matches, value)
        return result.otherwise(default)

    added = {"shape": chain(lambda name, _: F.lit(name), F.lit(UNKNOWN))}
    for field, dtype in fields.items():
        null = F.lit(None).cast(dtype)
        added[field] = chain(lambda _, values, f=field, n=null: values.get(f, n), null)
    return df.select("*", *[value.alias(f"_n_{name}") for name, value in added.items()]).select(
        *[c for c in df.columns if c not in added],
        *[F.col(f"_n_{name}").alias(name) for name in added],
    )


def normalise_sft(
    df: DataFrame,
    *,
    input_key: str | None = None,
    output_key: str | None = None,
    require_input: bool = False,
    extended: bool = True,
    chat_template: str = "{}",
) -> DataFrame:
    """Instruction, chat and safety records to ``(shape, prompt, response, source)``.

    ``require_input`` lets instruction records match only with a non-null input;
    ``extended=False`` leaves out the toxic-prompt and adversarial shapes.
    """
    if input_key and output_key:
        custom = {"prompt": F.col(input_key), "response": F.col(output_key)}
        return _dispatch(df, [("custom", F.lit(True), custom)], dict.fromkeys(["prompt", "response", "source"], "string"))
    prompt = _text(df, "prompt", "text")
    context = _text(df, "input")
    source = _text(df, "source")
    needed = ("instruction", "output") + (("input",) if require_input else ())
    last_turn = F.try_element_at(F.col("conversations"), F.lit(-1))["value"] if "conversations" in df.columns else F.lit(None)
    shapes = [
        ("chosen", _present(df, "prompt", "chosen"), {"prompt": prompt, "response": _text(df, "chosen")}),
        ("labelled_chat", _present(df, "prompt", "label"),
         {"prompt": tp.scrub_roles(prompt), "response": tp.scrub_end(_text(df, "label"))}),
        ("system_qa", _present(df, "system_prompt", "response"),
         {"prompt": _text(df, "question", "full_text"), "response": _text(df, "response")}),
        ("chat_turns", _present(df, "conversations"),
         {"prompt": _turns(df, "conversations", chat_template, drop_last=True, role="from", value="value", marker="human"),
          "response": last_turn}),
        ("instruct", _present(df, *needed),
         {"prompt": tp.instruction_prompt(_text(df, "instruction"), context),
          "response": _text(df, "output"), "source": source}),
        ("io_pair", _present(df, "input", "output"), {"prompt": context, "response": _text(df, "output")}),
        ("safety_qa", _present(df, "prompt", "response", "category", "is_safe"),
         {"prompt": tp.instruction_prompt(prompt), "response": _text(df, "response"), "source": source}),
    ]
    if extended:
        shapes += [
            ("toxic_prompts", _present(df, "begin", "end"),
             {"prompt": tp.instruction_prompt(prompt), "response": _text(df, "continuation", "text"), "source": source}),
            ("adv_prompts", _present(df, "prompt", "target"),
             {"prompt": tp.instruction_prompt(prompt), "response": _text(df, "target"), "source": source}),
        ]
    return _dispatch(df, shapes, dict.fromkeys(["prompt", "response", "source"], "string"))


def normalise_base(
    df: DataFrame, *, template: str | None = None, input_key: str | None = None, output_key: str | None = None
) -> DataFrame:
    """The two base shapes to ``(shape, prompt, response)``; the system text is dropped."""
    fields = dict.fromkeys(["prompt", "response"], "string")
    if input_key and output_key:
        custom = {"prompt": _templated(F.col(input_key), template), "response": F.col(output_key)}
        return _dispatch(df, [("custom", F.lit(True), custom)], fields)
    shapes = [
        ("chosen", _present(df, "prompt", "chosen"),
         {"prompt": tp.rewrite_dialogue(_text(df, "prompt")), "response": _text(df, "chosen")}),
        ("system_qa", _present(df, "system_prompt", "response"),
         {"prompt": _templated(_text(df, "question", "full_text"), template), "response": _text(df, "response")}),
    ]
    return _dispatch(df, shapes, fields)


def normalise_prompts(df: DataFrame, *, template: str | None = None, input_key: str | None = None) -> DataFrame:
    """Six prompt shapes to ``(shape, prompt)``."""
    fields = {"prompt": "string"}
    if input_key:
        return _dispatch(df, [("custom", F.lit(True), {"prompt": _templated(F.col(input_key), template)})], fields)
    instruction, context = _text(df, "instruction"), _text(df, "input")
    question = _text(df, "question", "full_text")
    joined = F.when(F.length(context) >= 1, F.concat(instruction, F.lit("\n"), context)).otherwise(instruction)
    arena = _turns(df, "conversation_a", template or "{}", drop_last=True, role="role", value="content", marker="user")
    shapes = [
        ("markers", _present(df, "prompt", "chosen"), {"prompt": tp.rewrite_dialogue(_text(df, "prompt"))}),
        ("system_qa", _present(df, "system_prompt", "response"), {"prompt": _templated(question, template)}),
        ("eval_input", _present(df, "eval_input"), {"prompt": _templated(_text(df, "eval_input"), template)}),
        ("arena", _present(df, "winner", "conversation_a"), {"prompt": arena}),
        ("web_compare", _present(df, "question", "answer_1"), {"prompt": _templated(question, template)}),
        ("instruct", _present(df, "instruction", "input", "output"), {"prompt": _templated(joined, template)}),
    ]
    return _dispatch(df, shapes, fields)


def normalise_pairs(
    df: DataFrame,
    *,
    template: str | None = None,
    prompt_key: str | None = None,
    chosen_key: str | None = None,
    rejected_key: str | None = None,
    drop_ties: bool = False,
) -> DataFrame:
    """Preference records to ``(shape, prompt, chosen, rejected, margin)``.

    Any winner but ``model_a`` makes the second conversation the chosen one, and
    equal scores make the second answer the chosen one. ``drop_ties`` removes ties.
    """
    margin = F.coalesce(F.col("margin").cast("double") if "margin" in df.columns else F.lit(None), F.lit(0.0))
    fields = {"prompt": "string", "chosen": "string", "rejected": "string", "margin": "double"}
    if chosen_key and rejected_key:
        prompt = _templated(F.col(prompt_key), template) if prompt_key else F.lit("")
        custom = {"prompt": prompt, "chosen": F.col(chosen_key), "rejected": F.col(rejected_key), "margin": margin}
        return _dispatch(df, [("custom", F.lit(True), custom)], fields)

    def arena(name):
        return _turns(df, name, template or "{}", drop_last=False, role="role", value="content", marker="user")

    first = _text(df, "winner") == "model_a"
    score_0 = F.col("score_0") if "score_0" in df.columns else F.lit(None).cast("double")
    score_1 = F.col("score_1") if "score_1" in df.columns else F.lit(None).cast("double")
    better_0 = F.coalesce(score_0 > score_1, F.lit(False))
    a0, a1 = _text(df, "answer_0"), _text(df, "answer_1")
    a, b = arena("conversation_a"), arena("conversation_b")
    given = F.coalesce(_text(df, "prompt"), F.lit(""))
    shapes = [
        ("chosen", _present(df, "chosen", "rejected"),
         {"prompt": tp.rewrite_dialogue(given), "chosen": _text(df, "chosen"), "rejected": _text(df, "rejected"),
          "margin": margin}),
        ("arena", _present(df, "winner", "conversation_a"),
         {"prompt": F.lit(""), "chosen": F.when(first, a).otherwise(b), "rejected": F.when(first, b).otherwise(a),
          "margin": margin}),
        ("web_compare", _present(df, "answer_0", "answer_1"),
         {"prompt": _templated(_text(df, "question", "full_text"), template),
          "chosen": F.when(better_0, a0).otherwise(a1), "rejected": F.when(better_0, a1).otherwise(a0),
          "margin": margin}),
    ]
    if drop_ties:
        tie = F.coalesce(~_text(df, "winner").isin("model_a", "model_b"), F.lit(False)) | F.coalesce(
            score_0 == score_1, F.lit(False)
        )
        df = df.filter(~tie)
    return _dispatch(df, shapes, fields)


def normalise_unpaired(
    df: DataFrame,
    *,
    template: str | None = None,
    prompt_key: str | None = None,
    output_key: str | None = None,
    label_key: str | None = None,
) -> DataFrame:
    """Single judged answers to ``(shape, prompt, response, label)``."""
    fields = {"prompt": "string", "response": "string", "label": "int"}
    if output_key and label_key:
        prompt = _templated(F.col(prompt_key), template) if prompt_key else F.lit("")
        custom = {"prompt": prompt, "response": F.col(output_key), "label": F.col(label_key).cast("int")}
        return _dispatch(df, [("custom", F.lit(True), custom)], fields)
    score = F.col("score").cast("int") if "score" in df.columns else F.lit(None).cast("int")
    values = {"prompt": _templated(_text(df, "instruction"), template), "response": _text(df, "response"), "label": score}
    return _dispatch(df, [("unpaired", _present(df, "score"), values)], fields)


def _templated(text: Column, template: str | None) -> Column:
    return tp.fill(template, text) if template else text


def turns_to_conversations(turns: DataFrame, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """Turn rows to one array per conversation, in turn order (one record per conversation)."""
    return turns.groupBy(conv).agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct(turn, "role", "text"))),
            lambda t: F.struct(t["role"].alias("role"), t["text"].alias("content")),
        ).alias("turns")
    )


def flatten_conversation(
    df: DataFrame, turns: str = "turns", *, role: str = "role", value: str = "content",
    marker: str = "user", template: str = "{}",
) -> DataFrame:
    """All turns but the last become the prompt, the last one the response."""
    return df.select(
        *[c for c in df.columns if c != turns],
        tp.render_turns(tp.all_but_last(F.col(turns)), role, value, marker, template).alias("prompt"),
        F.try_element_at(F.col(turns), F.lit(-1))[value].alias("response"),
    )
