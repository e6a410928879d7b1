"""Queries: token counts, sequences, masks, positions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tunedata.operators import tokens as tk
from tunedata.operators.filters import word_count, word_tokens
from tunedata.operators.indexing import rank_rows
from tunedata.plans.filtering import WORDS_SQL
from tunedata.plans.pairs import TOKENS_SQL
from tunedata.plans.registry import query, table

LINE_ORDER = (
    "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
    "l_returnflag", "l_linestatus", "l_shipdate",
)
TOKEN_ROWS_SQL = f"""
SELECT l_orderkey AS seq_id, l_orderkey // 64 AS batch, -l_discount AS logp, -l_tax AS logp_ref,
  CASE WHEN l_returnflag <> 'R' THEN 1 ELSE 0 END AS mask, l_quantity AS quantity,
  CASE WHEN l_linestatus = 'F' THEN l_linenumber ELSE -100 END AS label,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, {', '.join(LINE_ORDER)}) - 1 AS pos
FROM lineitem
"""


def token_rows(spark, sf_dir, with_pos: bool = True):
    """Order lines as logged tokens of a sequence per order."""
    lines = table(spark, sf_dir, "lineitem")
    if with_pos:
        lines = rank_rows(lines, "l_linenumber", by=["l_orderkey"], tie=LINE_ORDER)
    else:
        lines = lines.withColumn("pos", F.lit(None).cast("bigint"))
    return lines.select(
        F.col("l_orderkey").alias("seq_id"), F.floor(F.col("l_orderkey") / 64).alias("batch"), "pos",
        (-F.col("l_discount")).alias("logp"), (-F.col("l_tax")).alias("logp_ref"),
        (F.col("l_returnflag") != "R").cast("int").alias("mask"), F.col("l_quantity").alias("quantity"),
        F.when(F.col("l_linestatus") == "F", F.col("l_linenumber")).otherwise(-100).alias("label"),
    )


@query("tok_count", f"SELECT doc_id, least({WORDS_SQL}, 2048) AS prompt_tokens FROM documents")
def tok_count(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", word_count(F.col("text"), 2048).alias("prompt_tokens"))


@query("tok_assemble", f"""
WITH t AS (SELECT doc_id, list_concat({TOKENS_SQL}, [n_chars, 7, 1])[1:300] AS s FROM documents)
SELECT doc_id, array_to_string(list_concat(s[1:len(s) - 1], [1]), ' ') AS tokens FROM t
""")
def tok_assemble(spark, sf_dir):
    prompt = F.transform(word_tokens(F.col("text")), lambda w: F.length(w).cast("bigint"))
    response = F.array(F.col("n_chars"), F.lit(7).cast("bigint"))
    whole = tk.assemble(prompt, response, F.lit(1).cast("bigint"), 300)
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(whole.cast("array<string>"), " ").alias("tokens"))


@query("tok_labels", f"""
WITH t AS (SELECT doc_id, {TOKENS_SQL} AS s, doc_id % 20 AS plen FROM documents)
SELECT doc_id, array_to_string(list_transform(s, lambda x, i: CASE WHEN i <= plen OR x = 2 THEN -100 ELSE x END), ' ') AS labels FROM t
""")
def tok_labels(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", (F.col("doc_id") % 20).alias("plen"),
        F.transform(word_tokens(F.col("text")), lambda w: F.length(w).cast("bigint")).alias("tokens"))
    docs = docs.withColumn("mask", F.transform("tokens", lambda t: (t != 2).cast("int")))
    labels = tk.label_mask(F.col("tokens"), F.col("plen"), F.col("mask"))
    return docs.select("doc_id", F.array_join(labels.cast("array<string>"), " ").alias("labels"))


@query("tok_positions", f"""
SELECT seq_id, pos, mask, CASE WHEN mask = 0 THEN 1 ELSE
  (sum(mask) OVER (PARTITION BY seq_id ORDER BY pos))::BIGINT - 1 END AS position_id
FROM ({TOKEN_ROWS_SQL})
""")
def tok_positions(spark, sf_dir):
    rows = token_rows(spark, sf_dir).select("seq_id", "pos", "mask")
    return tk.token_positions(rows, "seq_id", "pos", "mask")


@query("tok_repair", f"""
WITH t AS (SELECT doc_id, {TOKENS_SQL} AS s FROM documents),
k AS (SELECT *, coalesce(list_max(list_transform(s, lambda x, i: CASE WHEN x NOT IN (2, 3) THEN i ELSE 0 END)), 0) AS last, len(s) AS w FROM t),
e AS (SELECT *, CASE WHEN last = 0 THEN w ELSE least(last + 1, w) END AS fin FROM k),
f AS (SELECT doc_id, list_transform(s, lambda x, i: CASE WHEN i = fin THEN 2 ELSE x END) AS fixed,
      list_transform(s, lambda x, i: CASE WHEN x NOT IN (2, 3) OR i = fin THEN 1 ELSE 0 END) AS att, w FROM e)
SELECT doc_id, array_to_string(fixed, ' ') AS tokens, array_to_string(att, ' ') AS attention_mask,
  array_to_string(list_transform(fixed[least(3, w):w - 1], lambda x: CASE WHEN x NOT IN (2, 3) THEN 1 ELSE 0 END), ' ') AS action_mask
FROM f
""")
def tok_repair(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", F.transform(word_tokens(F.col("text")), lambda w: F.length(w)).alias("tokens"))
    docs = docs.withColumn("plen", F.least(F.lit(3), F.size("tokens")))
    fixed = tk.repair_generated(docs, "tokens", prompt_length="plen", eos=2, pad=3)
    text = lambda c: F.array_join(F.col(c).cast("array<string>"), " ").alias(c)
    return fixed.select("doc_id", text("tokens"), text("attention_mask"), text("action_mask"))
