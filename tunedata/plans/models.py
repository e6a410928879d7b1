"""Queries: the caller's model hooks, with deterministic stand-ins for models."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from tunedata.functions.templates import instruction_prompt, strip_echo
from tunedata.operators import hooks, safety
from tunedata.plans.registry import examples, query, r6, table


@query("udf_generate", """
SELECT doc_id, trim(regexp_replace(regexp_replace(lower(text), '^\\s+', ''), '\\s+$', '')) AS output FROM documents
""")
def udf_generate(spark, sf_dir):
    """A stand-in model that echoes its prompt and answers with the lower-cased text."""

    def run(mark: str, prompts: pd.Series) -> pd.Series:
        body = prompts.str.split("### Instruction:\n", n=1).str[1].str.split("\n\n" + mark, n=1).str[0]
        return prompts + body.str.lower()

    docs = table(spark, sf_dir, "documents").select("doc_id", instruction_prompt(F.col("text")).alias("prompt"))
    said = hooks.generate(docs, "prompt", lambda: "### Response:", run)
    return said.select("doc_id", strip_echo(F.col("output")).alias("output"))


@query("udf_tokenize", """
SELECT doc_id, len(string_split(text, ' ')) AS n_tokens, list_sum(list_transform(string_split(text, ' '), lambda w: length(w)))::BIGINT AS total FROM documents
""")
def udf_tokenize(spark, sf_dir):
    """A stand-in tokenizer that maps words to their lengths."""

    def tokenize(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [len(w) for w in t.split(" ")])

    docs = table(spark, sf_dir, "documents").select("doc_id", hooks.tokens(F.col("text"), tokenize).alias("ids"))
    total = F.aggregate("ids", F.lit(0).cast("bigint"), lambda a, x: a + x)
    return docs.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), total.alias("total"))


@query("udf_moderate", """
WITH s AS (SELECT doc_id, list_transform(range(14), lambda i: 1 / (1 + exp(-((length(text) % (i + 5)) - 3.0::DOUBLE)))) AS p FROM documents)
SELECT doc_id, list_max(p) > 0.99 AS flagged, round(list_sum(p), 6) AS mass FROM s
""")
def udf_moderate(spark, sf_dir):
    """A stand-in scorer with logits from the text length."""

    def run(shift: float, texts: pd.Series) -> pd.Series:
        return texts.str.len().map(lambda n: [(n % (i + 5)) - shift for i in range(14)])

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    decided = safety.decide_labels(hooks.label_scores(docs, "text", lambda: 3.0, run), threshold=0.99)
    mass = F.aggregate(F.map_values("categories"), F.lit(0.0), lambda a, x: a + x)
    return decided.select("doc_id", "flagged", r6(mass, "mass"))


@query("udf_guard", """
SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN NULL WHEN length(text) % 2 = 0 THEN 'safe' ELSE 'unsafe' END AS verdict,
  CASE WHEN doc_id % 9 = 0 THEN 'ValueError: empty text' END AS error
FROM documents JOIN labels USING (doc_id)
""")
def udf_guard(spark, sf_dir):
    """A stand-in guard that fails on empty texts."""

    def check(_model, texts):
        if (texts == "").any():
            raise ValueError("empty text")
        return (texts.str.len() % 2 == 0).map({True: "safe", False: "unsafe"})

    rows = examples(spark, sf_dir).select("doc_id", F.when(F.col("doc_id") % 9 == 0, "").otherwise(F.col("text")).alias("text"))
    return hooks.guard_verdicts(rows, "text", lambda: None, check).select("doc_id", "verdict", "error")
