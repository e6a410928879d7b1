"""Queries: record shapes, templates, conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from tunedata.functions import templates as tp
from tunedata.operators import normalise as nz
from tunedata.plans.registry import query, table


def _case(shape: dict[int, object], key="k", dtype: str | None = None):
    """Value by shape number, null for the others."""
    result = None
    for number, value in shape.items():
        result = F.when(F.col(key) == number, value) if result is None else result.when(F.col(key) == number, value)
    return result if dtype is None else result.cast(dtype)


def mixed_records(spark, sf_dir, shapes: int = 12):
    """Every document as a record of one of the SFT shapes (or of none), by its number."""
    docs = table(spark, sf_dir, "documents").withColumn("k", F.col("doc_id") % shapes)
    text, lang, src = F.col("text"), F.col("lang"), F.col("source")
    turn = lambda who, what: F.struct(F.lit(who).alias("from"), what.alias("value"))
    answer = F.concat(lang, F.lit(": "), text)
    return docs.select(
        "doc_id",
        _case({0: text, 1: F.concat(F.lit("USER: "), text, F.lit(" ASSISTANT:")), 7: text, 8: text, 9: text}).alias("prompt"),
        _case({0: answer}).alias("chosen"),
        _case({1: F.concat(answer, F.lit("</s>"))}).alias("label"),
        _case({2: F.lit("system")}).alias("system_prompt"),
        _case({2: text}).alias("question"),
        _case({2: answer, 7: answer}).alias("response"),
        _case({3: F.array(turn("human", text), turn("gpt", lang), turn("human", src), turn("gpt", answer))}).alias("conversations"),
        _case({4: text, 5: text, 11: text}).alias("instruction"),
        _case({4: src, 5: F.lit(""), 6: text}).alias("input"),
        _case({4: answer, 5: answer, 6: answer, 11: answer}).alias("output"),
        _case({7: F.create_map(F.lit("privacy_violation"), F.col("n_chars") > 2000)}).alias("category"),
        _case({7: F.col("n_chars") <= 2000}).alias("is_safe"),
        _case({8: F.lit(0)}).alias("begin"),
        _case({8: F.col("n_chars").cast("int")}).alias("end"),
        _case({8: F.struct(answer.alias("text"))}).alias("continuation"),
        _case({9: answer}).alias("target"),
        F.when(F.col("doc_id") % 2 == 0, src).alias("source"),
    )


def _sft_sql(strict: bool) -> str:
    plain = "'" + tp.PREAMBLE + "### Instruction:\n' || text || '\n\n### Response:\n'"
    full = "'" + tp.PREAMBLE_WITH_INPUT + "### Instruction:\n' || text || '\n\n### Input:\n' || source || '\n\n### Response:\n'"
    unknown = "8, 9, 10, 11" if strict else "10"
    late = "" if strict else f"WHEN k IN (8, 9, 11) THEN {plain}"
    carried = "4, 5, 7" if strict else "4, 5, 7, 8, 9, 11"
    names = "'chosen','labelled_chat','system_qa','chat_turns','instruct','instruct','io_pair','safety_qa','toxic_prompts','adv_prompts','unknown','instruct'"
    return f"""
WITH d AS (SELECT *, doc_id % 12 AS k FROM documents)
SELECT doc_id,
  CASE WHEN k IN ({unknown}) THEN 'unknown' ELSE [{names}][k + 1] END AS shape,
  CASE WHEN k IN ({unknown}) THEN NULL WHEN k IN (0, 2, 6) THEN text WHEN k = 1 THEN ' ' || text || ' '
       WHEN k = 3 THEN text || lang || chr(10) || source
       WHEN k = 4 THEN {full} WHEN k IN (5, 7) THEN {plain} {late} END AS prompt,
  CASE WHEN k IN ({unknown}) THEN NULL ELSE lang || ': ' || text END AS response,
  CASE WHEN k IN ({carried}) AND doc_id % 2 = 0 THEN source END AS source
FROM d
"""


@query("norm_sft", _sft_sql(False))
def norm_sft(spark, sf_dir):
    out = nz.normalise_sft(mixed_records(spark, sf_dir))
    return out.select("doc_id", "shape", "prompt", "response", "source")


@query("norm_sft_strict", _sft_sql(True))
def norm_sft_strict(spark, sf_dir):
    out = nz.normalise_sft(mixed_records(spark, sf_dir), require_input=True, extended=False)
    return out.select("doc_id", "shape", "prompt", "response", "source")


@query("tmpl_instruction", f"""
SELECT doc_id, CASE WHEN doc_id % 3 = 0
  THEN '{tp.PREAMBLE}### Instruction:\n' || text || '\n\n### Response:\n'
  ELSE '{tp.PREAMBLE_WITH_INPUT}### Instruction:\n' || text || '\n\n### Input:\n' || source || '\n\n### Response:\n' END AS prompt
FROM documents
""")
def tmpl_instruction(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    context = F.when(F.col("doc_id") % 3 > 0, F.col("source")).when(F.col("doc_id") % 2 == 0, "")
    return docs.select("doc_id", tp.instruction_prompt(F.col("text"), context).alias("prompt"))


@query("norm_scrub", """
SELECT conv_id, turn, replace(replace(role || 'USER: ' || text || ' ASSISTANT:', 'USER:', ''), 'ASSISTANT:', '') AS prompt,
       replace(text || '</s>', '</s>', '') AS response FROM conversations
""")
def norm_scrub(spark, sf_dir):
    t = table(spark, sf_dir, "conversations")
    chat = F.concat(F.col("role"), F.lit("USER: "), F.col("text"), F.lit(" ASSISTANT:"))
    return t.select(
        "conv_id", "turn", tp.scrub_roles(chat).alias("prompt"),
        tp.scrub_end(F.concat(F.col("text"), F.lit("</s>"))).alias("response"),
    )


@query("conv_flatten", """
WITH n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations)
SELECT conv_id,
  coalesce(string_agg(CASE WHEN back = 1 THEN NULL WHEN contains(role, 'user') THEN 'Human: ' || text || chr(10) || 'Assistant: '
             ELSE text || chr(10) END, '' ORDER BY turn), '') AS prompt,
  max(CASE WHEN back = 1 THEN text END) AS response
FROM n GROUP BY conv_id
""")
def conv_flatten(spark, sf_dir):
    conversations = nz.turns_to_conversations(table(spark, sf_dir, "conversations"))
    return nz.flatten_conversation(conversations, template=tp.HUMAN_TEMPLATE)


def _prompt_records(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("k", F.col("doc_id") % 9)
    text, src = F.col("text"), F.col("source")
    turn = lambda who, what: F.struct(F.lit(who).alias("role"), what.alias("content"))
    return docs.select(
        "doc_id",
        _case({0: F.concat(F.lit("prompter:"), text, F.lit("assistant:"), src), 1: text}).alias("prompt"),
        _case({0: src, 1: src}).alias("chosen"),
        _case({2: F.lit("system")}).alias("system_prompt"),
        _case({2: src}).alias("response"),
        _case({2: text, 5: text}).alias("question"),
        _case({3: text}).alias("eval_input"),
        _case({4: F.lit("tie")}).alias("winner"),
        _case({4: F.array(turn("user", text), turn("assistant", src), turn("user", src))}).alias("conversation_a"),
        _case({5: src}).alias("answer_1"),
        _case({6: text, 7: text}).alias("instruction"),
        _case({6: src, 7: F.lit("")}).alias("input"),
        _case({6: src, 7: src}).alias("output"),
    )


@query("norm_prompt", """
SELECT doc_id,
  ['markers','markers','system_qa','eval_input','arena','web_compare','instruct','instruct','unknown'][doc_id % 9 + 1] AS shape,
  CASE doc_id % 9
    WHEN 0 THEN chr(10) || 'Human: ' || replace(text, 'assistant:', chr(10) || 'Assistant: ') || chr(10) || 'Assistant: ' || source || chr(10) || 'Assistant: '
    WHEN 1 THEN text
    WHEN 4 THEN 'Human: ' || text || chr(10) || 'Assistant: ' || source || chr(10)
    WHEN 6 THEN 'Human: ' || text || chr(10) || source || chr(10) || 'Assistant: '
    WHEN 8 THEN NULL
    ELSE 'Human: ' || text || chr(10) || 'Assistant: ' END AS prompt
FROM documents
""")
def norm_prompt(spark, sf_dir):
    out = nz.normalise_prompts(_prompt_records(spark, sf_dir), template=tp.HUMAN_TEMPLATE)
    return out.select("doc_id", "shape", "prompt")


@query("norm_markers", """
SELECT doc_id, CASE WHEN doc_id % 2 = 0
  THEN replace(replace('prompter:' || text || 'assistant:' || source || 'prompter:' || lang, 'prompter:', chr(10) || 'Human: '),
               'assistant:', chr(10) || 'Assistant: ') || chr(10) || 'Assistant: '
  ELSE 'x prompter:' || text END AS prompt
FROM documents
""")
def norm_markers(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    marked = F.concat(F.lit("prompter:"), F.col("text"), F.lit("assistant:"), F.col("source"), F.lit("prompter:"), F.col("lang"))
    raw = F.when(F.col("doc_id") % 2 == 0, marked).otherwise(F.concat(F.lit("x prompter:"), F.col("text")))
    return docs.select("doc_id", tp.rewrite_dialogue(raw).alias("prompt"))


@query("norm_base", """
SELECT doc_id, ['chosen', 'system_qa', 'unknown'][doc_id % 3 + 1] AS shape,
  CASE doc_id % 3 WHEN 0 THEN text WHEN 1 THEN 'Human: ' || text || chr(10) || 'Assistant: ' END AS prompt,
  CASE WHEN doc_id % 3 < 2 THEN source END AS response
FROM documents
""")
def norm_base(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("k", F.col("doc_id") % 3)
    records = docs.select(
        "doc_id", _case({0: F.col("text")}).alias("prompt"), _case({0: F.col("source")}).alias("chosen"),
        _case({1: F.lit("s")}).alias("system_prompt"), _case({1: F.col("text")}).alias("question"),
        _case({1: F.col("source")}).alias("response"),
    )
    out = nz.normalise_base(records, template=tp.HUMAN_TEMPLATE)
    return out.select("doc_id", "shape", "prompt", "response")


def _pair_records(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("k", F.col("doc_id") % 8)
    text, src, lang = F.col("text"), F.col("source"), F.col("lang")
    turn = lambda who, what: F.struct(F.lit(who).alias("role"), what.alias("content"))
    a = F.array(turn("user", text), turn("assistant", src))
    b = F.array(turn("user", text), turn("assistant", lang))
    return docs.select(
        "doc_id",
        _case({0: F.concat(F.lit("prompter:"), text), 6: text}).alias("prompt"),
        _case({0: src, 1: src, 6: src}).alias("chosen"),
        _case({0: lang, 1: lang}).alias("rejected"),
        _case({0: F.col("n_chars") / 4}).alias("margin"),
        _case({2: F.lit("model_a"), 3: F.lit("tie")}).alias("winner"),
        _case({2: a, 3: a}).alias("conversation_a"),
        _case({2: b, 3: b}).alias("conversation_b"),
        _case({4: F.struct(text.alias("full_text")), 5: F.struct(text.alias("full_text"))}).alias("question"),
        _case({4: src, 5: src}).alias("answer_0"),
        _case({4: lang, 5: lang}).alias("answer_1"),
        _case({4: F.lit(1.0), 5: F.lit(0.5)}).alias("score_0"),
        _case({4: F.lit(0.0), 5: F.lit(0.5)}).alias("score_1"),
    )


@query("norm_pref", """
WITH d AS (SELECT *, doc_id % 8 AS k,
  'Human: ' || text || chr(10) || 'Assistant: ' AS q FROM documents)
SELECT doc_id, ['chosen','chosen','arena','arena','web_compare','web_compare','unknown','unknown'][k + 1] AS shape,
  CASE WHEN k = 0 THEN chr(10) || 'Human: ' || text || chr(10) || 'Assistant: '
       WHEN k IN (1, 2, 3) THEN '' WHEN k IN (4, 5) THEN q END AS prompt,
  CASE WHEN k IN (0, 1, 4) THEN source WHEN k = 2 THEN q || source || chr(10) WHEN k = 3 THEN q || lang || chr(10) WHEN k = 5 THEN lang END AS chosen,
  CASE WHEN k IN (0, 1, 4) THEN lang WHEN k = 2 THEN q || lang || chr(10) WHEN k = 3 THEN q || source || chr(10) WHEN k = 5 THEN source END AS rejected,
  CASE WHEN k = 0 THEN n_chars / 4 WHEN k < 6 THEN 0.0::DOUBLE END AS margin
FROM d
""")
def norm_pref(spark, sf_dir):
    out = nz.normalise_pairs(_pair_records(spark, sf_dir), template=tp.HUMAN_TEMPLATE)
    return out.select("doc_id", "shape", "prompt", "chosen", "rejected", "margin")


@query("norm_unpaired", """
SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'unknown' ELSE 'unpaired' END AS shape,
  CASE WHEN doc_id % 4 > 0 THEN 'Human: ' || text || chr(10) || 'Assistant: ' END AS prompt,
  CASE WHEN doc_id % 4 > 0 THEN source END AS response,
  CASE WHEN doc_id % 4 > 0 THEN (n_chars % 2)::INT END AS label
FROM documents
""")
def norm_unpaired(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    records = docs.select(
        "doc_id", F.col("text").alias("instruction"), F.col("source").alias("response"),
        F.when(F.col("doc_id") % 4 > 0, (F.col("n_chars") % 2).cast("int")).alias("score"),
    )
    out = nz.normalise_unpaired(records, template=tp.HUMAN_TEMPLATE)
    return out.select("doc_id", "shape", "prompt", "response", "label")


@query("tmpl_input", "SELECT item_id, 'Human: ' || text || chr(10) || 'Assistant: ' AS prompt FROM benchmark")
def tmpl_input(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", tp.fill(tp.HUMAN_TEMPLATE, F.col("text")).alias("prompt"))


@query("norm_custom_keys", """
SELECT 'sft' AS kind, doc_id, text AS prompt, lang AS response, source AS other FROM documents
UNION ALL SELECT 'prompt', doc_id, 'Human: ' || text || chr(10) || 'Assistant: ', NULL, NULL FROM documents
UNION ALL SELECT 'pair', doc_id, '', lang, source FROM documents
UNION ALL SELECT 'unpaired', doc_id, '', lang, CAST(n_chars AS VARCHAR) FROM documents
""")
def norm_custom_keys(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumnRenamed("source", "origin")
    null = F.lit(None).cast("string")
    sft = nz.normalise_sft(docs, input_key="text", output_key="lang").select(
        F.lit("sft").alias("kind"), "doc_id", "prompt", "response", F.col("origin").alias("other"))
    prompts = nz.normalise_prompts(docs, template=tp.HUMAN_TEMPLATE, input_key="text").select(
        F.lit("prompt").alias("kind"), "doc_id", "prompt", null.alias("response"), null.alias("other"))
    pairs = nz.normalise_pairs(docs, template=tp.HUMAN_TEMPLATE, chosen_key="lang", rejected_key="origin").select(
        F.lit("pair").alias("kind"), "doc_id", "prompt", F.col("chosen").alias("response"), F.col("rejected").alias("other"))
    unpaired = nz.normalise_unpaired(docs, template=tp.HUMAN_TEMPLATE, output_key="lang", label_key="n_chars").select(
        F.lit("unpaired").alias("kind"), "doc_id", "prompt", "response", F.col("label").cast("string").alias("other"))
    return sft.unionByName(prompts).unionByName(pairs).unionByName(unpaired)


@query("tmpl_qa", """
SELECT doc_id, 'BEGINNING OF CONVERSATION: USER: ' || text || ' ASSISTANT:' || source AS qa FROM documents
""")
def tmpl_qa(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", tp.qa_text(F.col("text"), F.col("source")).alias("qa"))


@query("tmpl_system", f"""
SELECT item_id, '[INST] <<SYS>>' || chr(10) || '{tp.DEFAULT_SYSTEM_TEXT}' || chr(10) || '<</SYS>>' || chr(10) || chr(10) || text || ' [/INST]' AS prompt
FROM benchmark
""")
def tmpl_system(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", tp.system_chat(F.col("text")).alias("prompt"))
