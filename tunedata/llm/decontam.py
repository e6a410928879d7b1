"""Find benchmark passages in training documents with a positional inverted index.

The index holds the postings (term, document, position) of training words. A passage is looked up
from its rarest terms: their posting lists, shifted by the terms' offsets in the passage, are
intersected, and what is left is compared word by word. Only terms that are among the rarest of
some passage are looked up, so only their postings are stored. How rare a term is, is counted over
all training documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tunedata.llm.text import free_name, lower_ascii, row_key
from tunedata.session import cut_lineage

#: ASCII letters and digits, and all that is not ASCII. A-Z are made lower case word by word.
_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WINDOW = 10
#: Rarest terms whose posting lists are intersected.
ANCHORS = 2
#: Lookup terms up to which they are broadcast (with their passages at most some 100 MB); beyond, both sides are shuffled.
BROADCAST_ROWS = 200_000


def raw_words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(_WORD), F.lit(0))


def fold(word: Column) -> Column:
    """A-Z in lower case; plain ASCII words take the short way."""
    return F.when(F.octet_length(word) == F.char_length(word), F.lower(word)).otherwise(lower_ascii(word))


def words(text: Column) -> Column:
    return F.transform(raw_words(text), fold)


def passages(bench: DataFrame, item_col: str = "item_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(item_id, win, phrase): the windows of every item. An item of fewer words, but not none, is one."""
    worded = bench.select(F.col(item_col).alias("item_id"), words(F.col(text_col)).alias("all")).filter(F.size("all") > 0)
    at = F.sequence(F.lit(1), F.greatest(F.size("all") - window + 1, F.lit(1)))
    return worded.select("item_id", F.explode(F.transform(at, lambda i: F.slice(F.col("all"), i, window))).alias("phrase")).select(
        "item_id", F.xxhash64("phrase").alias("win"), "phrase")


def _light(df: DataFrame) -> DataFrame:
    """A written table, broadcast if it is counted to be small."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def lookups(keyed: DataFrame, phrases: DataFrame, anchors: int = ANCHORS) -> DataFrame:
    """(term, win, offset, rank, wanted): the rarest terms of each phrase, by number of training words; ``wanted`` is how many."""
    placed = phrases.select("win", F.posexplode("phrase").alias("offset", "term"))
    terms = _light(cut_lineage(placed.select("term").distinct()))
    seen = keyed.select(F.explode(raw_words(F.col("text"))).alias("word")).select(fold(F.col("word")).alias("term"))
    counts = seen.join(terms, "term").groupBy("term").count()
    rank = F.row_number().over(Window.partitionBy("win").orderBy(F.coalesce("count", F.lit(0)), "term", "offset"))
    ranked = placed.join(counts, "term", "left").withColumn("rank", rank).filter(F.col("rank") <= anchors)
    wanted = F.max("rank").over(Window.partitionBy("win"))
    return ranked.select("term", "win", "offset", "rank", wanted.alias("wanted"))


def postings(keyed: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, doc, pos): where the given terms stand in the training documents."""
    placed = keyed.select("doc", F.posexplode(raw_words(F.col("text"))).alias("pos", "word"))
    return placed.select("doc", "pos", fold(F.col("word")).alias("term")).join(_light(terms), "term")


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, key, text); ``doc`` is a short number for the postings. Should two documents share one, both are
    compared word by word with what either proposes."""
    named = docs.filter(F.col(text_col).isNotNull()).select(row_key(id_col, text_col).alias("key"), F.col(text_col).alias("text"))
    return named.select(F.xxhash64("key").alias("doc"), "key", "text")


def _index(docs: DataFrame, phrases: DataFrame, id_col: str, text_col: str, anchors: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    keyed = _keyed(docs, id_col, text_col)
    wanted = cut_lineage(lookups(keyed, phrases, anchors))
    index = cut_lineage(postings(keyed, cut_lineage(wanted.select("term").distinct())))
    return keyed, wanted, index


def exact_matches(docs: DataFrame, phrases: DataFrame, id_col: str = "doc_id", text_col: str = "text", anchors: int = ANCHORS) -> DataFrame:
    """(key, win, start, length): every occurrence of a phrase (win, phrase), one row of it per document key."""
    keyed, wanted, index = _index(docs, phrases, id_col, text_col, anchors)
    starts = index.join(_light(wanted), "term").select("doc", "win", (F.col("pos") - F.col("offset")).alias("start"), "wanted", F.expr("shiftleft(1, rank - 1)").alias("bit"))
    # One bit for each of the lists, so that a posting that comes twice counts once.
    met = starts.filter("start >= 0").groupBy("doc", "win", "start").agg(F.bit_or("bit").alias("bits"), F.first("wanted").alias("wanted"))
    met = met.filter("bits = shiftleft(1, wanted) - 1")
    proposed = met.join(phrases.select("win", "phrase"), "win").groupBy("doc").agg(
        F.collect_list(F.struct("start", "win", F.size("phrase").alias("length"), "phrase")).alias("proposed"))
    checked = proposed.join(keyed, "doc").select("key", "proposed", words(F.col("text")).alias("all"))
    same = F.filter("proposed", lambda c: F.slice(F.col("all"), c["start"] + 1, c["length"]) == c["phrase"])
    return checked.select("key", F.explode(same).alias("hit")).select("key", "hit.win", "hit.start", "hit.length").distinct()


def proximity_matches(docs: DataFrame, phrases: DataFrame, slack: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(key, win, pos): places where all words of a phrase stand, in any order and as often as it holds them, within its
    length plus ``slack`` words.

    Looked up from the phrase's rarest term, at ``pos``; the others may lie on either side of it.
    """
    keyed, wanted, index = _index(docs, phrases, id_col, text_col, 1)
    near = index.join(_light(wanted), "term").join(phrases.select("win", "phrase"), "win")
    proposed = near.groupBy("doc").agg(F.collect_list(F.struct("pos", "win", "phrase")).alias("proposed"))
    checked = proposed.join(keyed, "doc").select("key", "proposed", words(F.col("text")).alias("all"))

    def close(c):
        span = F.size(c["phrase"]) + slack
        spans = F.transform(F.sequence(F.greatest(c["pos"] - span + 1, F.lit(0)), c["pos"]), lambda i: F.slice(F.col("all"), i + 1, span))

        def times(term, among):
            return F.size(F.filter(among, lambda w: w == term))

        terms = F.array_distinct(c["phrase"])
        return F.exists(spans, lambda part: F.forall(terms, lambda t: times(t, part) >= times(t, c["phrase"])))

    return checked.select("key", F.explode(F.filter("proposed", close)).alias("hit")).select("key", "hit.win", "hit.pos").distinct()


def contamination(
    docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    bench_text: str = "text", window: int = WINDOW,
) -> DataFrame:
    """(key, n_hit, items): for documents in which a window of an item occurs, the words inside any
    occurrence and the ids of the items as strings, sorted.

    ``key`` is ``text.row_key``; rows that repeat id and text are one document. Null and empty texts
    hold no words, on either side, and match nothing. An item without an id counts for n_hit only.
    """
    items = cut_lineage(passages(bench, item_col, bench_text, window).distinct())
    phrases = cut_lineage(items.select("win", "phrase").distinct())
    hits = cut_lineage(exact_matches(docs, phrases, id_col, text_col))
    spans = F.array_sort(F.collect_list(F.struct("start", (F.col("start") + F.col("length")).alias("end"))))
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))

    def covered(acc, span):
        return F.struct((acc["n"] + F.greatest(F.lit(0), span["end"] - F.greatest(span["start"], acc["end"]))).alias("n"), F.greatest(acc["end"], span["end"]).alias("end"))

    n_hit = hits.groupBy("key").agg(spans.alias("spans")).select("key", F.aggregate("spans", zero, covered)["n"].cast("long").alias("n_hit"))
    named = hits.select("key", "win").distinct().join(items.select("win", F.col("item_id").cast("string").alias("item")), "win")
    found = named.groupBy("key").agg(F.array_sort(F.collect_set("item")).alias("items"))
    return n_hit.join(found, "key")


def flag(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Adds n_hit, items and contaminated to every row of ``docs``; columns of those names are replaced."""
    kept = docs.drop("n_hit", "items", "contaminated")
    key = free_name(kept, "row_key")
    joined = kept.withColumn(key, row_key(id_col, text_col)).join(found.withColumnRenamed("key", key), key, "left").drop(key)
    none = F.array().cast("array<string>")
    return joined.withColumns({
        "n_hit": F.coalesce("n_hit", F.lit(0)).cast("long"), "items": F.coalesce("items", none),
        "contaminated": F.coalesce(F.col("n_hit") > 0, F.lit(False)),
    })


def contamination_sql(documents: str, benchmark: str) -> str:
    """Flags per document in DuckDB's SQL: all slices of the lengths that occur, joined with the windows."""
    def split(table, key):
        upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
        return rf"SELECT {key}, coalesce(regexp_extract_all(translate(text, '{upper}', '{lower}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM {table}"

    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, * FROM ({split(documents, 'doc_id')})),
b AS ({split(benchmark, 'item_id')}),
p AS (SELECT DISTINCT item_id, phrase FROM (
  SELECT item_id, w[i + 1:i + 10] AS phrase FROM (SELECT *, unnest(range(greatest(len(w) - 9, 1))) AS i FROM b WHERE len(w) > 0))),
n AS (SELECT DISTINCT len(phrase) AS length FROM p),
g AS (SELECT r, i, length, w[i + 1:i + length] AS phrase FROM (
  SELECT r, w, length, unnest(range(len(w) - length + 1)) AS i FROM d, n WHERE len(w) >= length)),
h AS (SELECT r, i, length, item_id FROM g JOIN p USING (phrase)),
c AS (SELECT r, count(DISTINCT pos) AS n_hit FROM (SELECT r, unnest(range(i, i + length)) AS pos FROM h) GROUP BY r),
e AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
      FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item FROM h WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (r) LEFT JOIN e USING (r)"""
