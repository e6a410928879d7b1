"""Queries: shards, batches, positional joins, pair building."""

from __future__ import annotations

from pyspark.sql import functions as F

from tunedata.functions.permutation import permuted_sql
from tunedata.operators import exams, pairing
from tunedata.operators.filters import word_tokens
from tunedata.operators.indexing import rank_rows
from tunedata.plans.registry import EXAMPLES_SQL, WEIGHT_STATE_SQL, examples, query, r6, table, weight_state
from tunedata.session import cut_lineage


def key_sql(seed: int, column: str) -> str:
    return f"('0x' || substr(md5('{seed}:' || {column}), 1, 15))::BIGINT"


@query("shard_assign", f"""
WITH p AS (SELECT doc_id, row_number() OVER (ORDER BY {key_sql(45, 'doc_id')}, doc_id) - 1 AS perm, count(*) OVER () AS n FROM documents),
f AS (SELECT doc_id, perm FROM p UNION ALL SELECT doc_id, perm + n FROM p WHERE perm + n < 7 * ceil(n / 7))
SELECT doc_id, (perm % 7)::INT AS shard, perm // 7 AS shard_pos FROM f
""")
def shard_assign(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id")
    return pairing.assign_shards(docs, "doc_id", 7, seed=42, epoch=3)


@query("batch_assign", f"""
WITH p AS (SELECT doc_id, row_number() OVER (ORDER BY {key_sql(42, 'doc_id')}, doc_id) - 1 AS perm, count(*) OVER () AS n FROM documents),
f AS (SELECT doc_id, perm FROM p UNION ALL SELECT doc_id, perm + n FROM p WHERE perm + n < 3 * ceil(n / 3))
SELECT doc_id, (perm % 3)::INT AS shard, (perm // 3) // 10 AS batch FROM f
""")
def batch_assign(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id")
    shards = pairing.assign_shards(docs, "doc_id", 3, seed=42)
    return pairing.assign_batches(shards, 10, pos="shard_pos").select("doc_id", "shard", "batch")


@query("zip_cyclic", f"""
WITH e AS (SELECT doc_id, source, (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) // 10 AS batch FROM ({EXAMPLES_SQL})),
len AS (SELECT max(batch) FILTER (source = 'harmful') + 1 AS na, max(batch) FILTER (source = 'ft') + 1 AS nb FROM e),
a AS (SELECT s AS step, 'a' AS side, doc_id, batch FROM e, len, range(100000) t(s)
      WHERE source = 'harmful' AND s < nb AND na < nb AND (2 * (nb + 1) + s) % na = batch),
b AS (SELECT batch AS step, 'b' AS side, doc_id, batch FROM e WHERE source = 'ft')
SELECT * FROM a UNION ALL SELECT * FROM b
""")
def zip_cyclic(spark, sf_dir):
    rows = examples(spark, sf_dir).select("doc_id", "source")
    batches = pairing.assign_batches(rank_rows(rows, "doc_id", by=["source"]), 10)
    batches = cut_lineage(batches.select("doc_id", "batch", "source"))
    side = lambda name: batches.filter(F.col("source") == name).drop("source")
    return pairing.cyclic_zip(side("harmful"), side("ft"), epoch=2)


@query("shard_epochs", f"""
WITH RECURSIVE ids AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS x, count(*) OVER () AS n FROM documents),
{permuted_sql("SELECT epoch, x FROM ids, range(3) e(epoch)", "SELECT count(*) FROM documents", "(42 + epoch)")},
p AS (SELECT doc_id, epoch, place AS perm, n FROM placed JOIN ids USING (x)),
f AS (SELECT doc_id, epoch, perm FROM p UNION ALL SELECT doc_id, epoch, perm + n FROM p WHERE perm + n < 7 * ceil(n / 7))
SELECT doc_id, epoch::INT AS epoch, (perm % 7)::INT AS shard, perm // 7 AS shard_pos FROM f
""")
def shard_epochs(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id")
    return pairing.assign_shards_over(docs, "doc_id", 7, seed=42, epochs=3)


@query("zip_epochs", f"""
WITH RECURSIVE e AS (SELECT doc_id, CASE WHEN source = 'harmful' THEN 'a' ELSE 'b' END AS side FROM ({EXAMPLES_SQL})),
ids AS (SELECT *, row_number() OVER (PARTITION BY side ORDER BY doc_id) - 1 AS x FROM e),
c AS (SELECT count(*) FILTER (side = 'a') AS na, count(*) FILTER (side = 'b') AS nb,
        ceil(count(*) FILTER (side = 'a') / 10)::BIGINT AS ba, ceil(count(*) FILTER (side = 'b') / 10)::BIGINT AS bb FROM e),
{permuted_sql("SELECT epoch, x FROM ids, range(3) t(epoch) WHERE side = 'b'", "SELECT nb FROM c", "(42 + epoch)")},
long AS (SELECT epoch, x, place // 10 AS step FROM placed),
{permuted_sql("SELECT p AS epoch, x FROM ids, c, range(100000) t(p) WHERE side = 'a' AND p < ceil(3 * (bb + 1) / ba)", "SELECT na FROM c",
              "(42 + (epoch * (SELECT ba FROM c)) // (SELECT bb + 1 FROM c))").replace("size", "size2").replace("feistel", "feistel2").replace("placed", "placed2")},
short AS (SELECT (epoch * ba + place // 10) // (bb + 1) AS epoch, (epoch * ba + place // 10) % (bb + 1) AS step, x FROM placed2, c)
SELECT doc_id, side, epoch::INT AS epoch, step FROM long JOIN ids USING (x) WHERE side = 'b' UNION ALL
SELECT doc_id, side, epoch::INT, step FROM short JOIN ids USING (x), c WHERE side = 'a' AND epoch < 3 AND step < bb
""")
def zip_epochs(spark, sf_dir):
    rows = cut_lineage(examples(spark, sf_dir).select("doc_id", "source"))
    side = lambda name: rows.filter(F.col("source") == name).select("doc_id")
    return pairing.zip_epochs(side("harmful"), side("ft"), "doc_id", 10, seed=42, epochs=3)


@query("join_pred", """
SELECT d.doc_id, d.text AS input, coalesce(CAST(l.quality AS VARCHAR), 'none') AS output
FROM documents d JOIN labels l ON d.doc_id = l.doc_id
""")
def join_pred(spark, sf_dir):
    inputs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("input"))
    predictions = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("string").alias("output"))
    return pairing.join_by_id(inputs, predictions, "doc_id")


@query("gather_mean", f"""
SELECT count(*) AS n, round(avg(logit), 6) AS mean FROM ({WEIGHT_STATE_SQL})
WHERE example_id IN (SELECT doc_id FROM labels WHERE toxic = 1)
""")
def gather_mean(spark, sf_dir):
    members = table(spark, sf_dir, "labels").filter(F.col("toxic") == 1).select(F.col("doc_id").alias("example_id"))
    return pairing.gather_mean(weight_state(spark, sf_dir), members, "example_id", "logit").select("n", r6("mean", "mean"))


@query("bal_interleave", f"""
WITH r AS (SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY {key_sql(43, 'doc_id')}, doc_id) - 1 AS rn FROM labels),
s AS (SELECT least(count(*) FILTER (quality = 1), count(*) FILTER (quality = 0)) AS m FROM labels)
SELECT doc_id, quality, 2 * rn + CASE WHEN quality = 0 THEN 1 ELSE 0 END AS slot FROM r, s WHERE rn < m
""")
def bal_interleave(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    return pairing.balanced_interleave(labels, "doc_id", "quality", seed=42, epoch=1)


@query("kto_mismatch", f"""
WITH e AS (SELECT doc_id, text AS prompt, lang || doc_id AS response, quality AS label,
                  row_number() OVER (ORDER BY doc_id) - 1 AS pos FROM ({EXAMPLES_SQL})),
b AS (SELECT *, pos // 8 AS batch FROM e)
SELECT doc_id, prompt, response, label, batch FROM b UNION ALL
SELECT doc_id, prompt, coalesce(lead(response) OVER (PARTITION BY batch ORDER BY pos),
       first_value(response) OVER (PARTITION BY batch ORDER BY pos)), -1, batch FROM b
""")
def kto_mismatch(spark, sf_dir):
    rows = examples(spark, sf_dir).select(
        "doc_id", F.col("text").alias("prompt"), F.concat("lang", F.col("doc_id").cast("string")).alias("response"),
        F.col("quality").alias("label"))
    batches = rows.join(pairing.assign_batches(rank_rows(rows.select("doc_id"), "doc_id"), 8), "doc_id")
    return pairing.mismatch_pairs(batches).select("doc_id", "prompt", "response", "label", "batch")


@query("pref_unpivot", """
SELECT doc_id, text AS response, 1 AS label FROM documents UNION ALL SELECT doc_id, source, 0 FROM documents
""")
def pref_unpivot(spark, sf_dir):
    pairs = table(spark, sf_dir, "documents").select(
        "doc_id", F.col("text").alias("chosen"), F.col("source").alias("rejected"))
    return pairing.unpivot_pairs(pairs)


TOKENS_SQL = "list_transform(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> ''), lambda w: length(w))"


@query("pref_concat", f"""
WITH t AS (SELECT conv_id, turn, role, {TOKENS_SQL} AS tokens FROM conversations),
p AS (SELECT u.conv_id, u.turn, u.tokens AS c, a.tokens AS r FROM t u JOIN t a ON u.conv_id = a.conv_id AND a.turn = u.turn + 1),
s AS (SELECT conv_id, turn, 'chosen' AS side, c AS tokens FROM p UNION ALL SELECT conv_id, turn, 'rejected', r FROM p),
w AS (SELECT *, max(len(tokens)) OVER (PARTITION BY conv_id) AS width FROM s)
SELECT conv_id, turn, side, array_to_string(list_concat(tokens, list_transform(range(width - len(tokens)), lambda i: 0)), ' ') AS tokens FROM w
""")
def pref_concat(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", F.transform(word_tokens(F.col("text")), lambda w: F.length(w)).alias("c"))
    nxt = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("c").alias("r"))
    stacked = pairing.stack_sides(turns.join(nxt, ["conv_id", "turn"]), "c", "r")
    padded = pairing.pad_batch(stacked, "tokens", "conv_id", side="right", value=0)
    return padded.withColumn("tokens", F.array_join(F.col("tokens").cast("array<string>"), " "))


@query("pad_batch", f"""
WITH t AS (SELECT doc_id, {TOKENS_SQL} AS tokens, (row_number() OVER (ORDER BY doc_id) - 1) // 16 AS batch FROM documents),
w AS (SELECT *, max(len(tokens)) OVER (PARTITION BY batch) AS width FROM t)
SELECT doc_id, batch, array_to_string(list_concat(list_transform(range(width - len(tokens)), lambda i: 2), tokens), ' ') AS tokens FROM w
""")
def pad_batch(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    tokens = docs.select("doc_id", F.transform(word_tokens(F.col("text")), lambda w: F.length(w)).alias("tokens"))
    batches = pairing.assign_batches(rank_rows(docs.select("doc_id"), "doc_id"), 16).drop("pos")
    padded = pairing.pad_batch(tokens.join(batches, "doc_id"), "tokens", side="left", value=2)
    return padded.withColumn("tokens", F.array_join(F.col("tokens").cast("array<string>"), " "))


@query("join_dim", """
SELECT c.c_custkey, n.n_name AS subject, r.r_name AS grp FROM customer c
JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey
""")
def join_dim(spark, sf_dir):
    nation = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    dim = nation.select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("subject"), F.col("r_name").alias("grp"))
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    return pairing.join_by_id(rows, dim, "c_nationkey").select("c_custkey", "subject", "grp")


@query("cat_resolve", """
WITH sub AS (SELECT s_name AS subject, n_name AS sub FROM supplier JOIN nation ON n_nationkey = s_nationkey
             UNION ALL SELECT s_name, n_name FROM supplier JOIN nation ON n_nationkey = (s_nationkey + 7) % 25),
hit AS (SELECT subject, r_name, r_regionkey FROM sub JOIN nation ON n_name = sub JOIN region ON n_regionkey = r_regionkey),
ranked AS (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY r_regionkey DESC) AS rn FROM hit)
SELECT subject, r_name AS category FROM ranked WHERE rn = 1
""")
def cat_resolve(spark, sf_dir):
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    names = nation.select(F.col("n_nationkey").alias("k"), "n_name")
    keyed = table(spark, sf_dir, "supplier").select(
        F.col("s_name").alias("subject"), F.explode(F.array(F.col("s_nationkey"), (F.col("s_nationkey") + 7) % 25)).alias("k"))
    subcategories = keyed.join(names, "k").groupBy("subject").agg(F.collect_set("n_name").alias("subcat"))
    categories = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).groupBy("r_name", "r_regionkey").agg(
        F.collect_list("n_name").alias("subcats")).select(F.col("r_name").alias("category"), F.col("r_regionkey").alias("ord"), "subcats")
    return exams.resolve_categories(subcategories, categories)
