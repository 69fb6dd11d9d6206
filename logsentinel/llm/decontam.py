"""Benchmark decontamination (operator 7): a prefix-filtered containment join, in DataFrame functions only.

1. Benchmark items become distinct windows of item words; the words of these windows are counted in
   the whole corpus.
2. Of a window that must occur whole, one token is a sufficient prefix: its rarest word (ties: the
   word itself). Windows are gathered under these anchors.
3. Documents are split once and each word is looked up among the anchors (a set of checked size, in
   several blocks beyond it). Only an anchor's surroundings leave the document: the positional bound says
   where the window must begin, the length bound that it lies inside the document, and exactly this
   slice is compared.
4. All rows of a document meet in one aggregate; an outer explode keeps documents without anchors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .session import checkpoint

#: Characters between words, before A-Z are lower-cased.
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Benchmark words and anchors that are broadcast or looked up at once.
BROADCAST_ROWS = 20_000


def _words(text: Column) -> Column:
    """Words and, where the text begins or ends with a gap, an empty string there."""
    return F.split(F.coalesce(text, F.lit("")), GAP, -1)


def _count(words: Column) -> Column:
    n = F.size(words)
    edges = F.when(F.element_at(words, 1) == "", 1).otherwise(0) + F.when((n > 1) & (F.element_at(words, -1) == ""), 1).otherwise(0)
    return (n - edges).cast("long")


def windows(benchmark: DataFrame, width: int = 10, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(key, n, items): distinct windows, their number of words, and the items that have them.

    An item of fewer words, but not none, is one window.
    """
    lower = F.translate(F.coalesce(text_col, F.lit("")), UPPER, LOWER)
    w = F.filter(F.split(lower, GAP, -1), lambda x: x != "")
    items = benchmark.select(F.col(id_col).cast("string").alias("item"), w.alias("w")).where(F.size("w") > 0)
    n = F.least(F.size("w"), F.lit(width))
    cut = items.withColumn("n", n).select("item", "n", "w", F.explode(F.sequence(F.lit(1), F.size("w") - F.col("n") + 1)).alias("at"))
    return cut.select(F.array_join(F.slice("w", F.col("at"), F.col("n")), " ").alias("key"), "n", "item").groupBy("key", "n").agg(F.collect_set("item").alias("items"))


def _in_blocks(table: DataFrame, key: str) -> list[DataFrame]:
    blocks = max(1, -(-table.count() // BROADCAST_ROWS))
    return [table.where(F.pmod(F.xxhash64(key), F.lit(blocks)) == i) for i in range(blocks)]


def anchors(docs: DataFrame, wins: DataFrame, text_col: str = "text") -> DataFrame:
    """(anchor, wins): the windows under their rarest word by its count in all documents."""
    tokens = wins.select("key", "n", "items", F.posexplode(F.split("key", " ")).alias("off", "word"))
    lowered = checkpoint(tokens.select(F.lower("word").alias("word")).distinct())
    counts = None
    for vocabulary in _in_blocks(lowered, "word"):
        seen = docs.select(F.explode(_words(F.lower(text_col))).alias("word")).join(F.broadcast(vocabulary), "word", "left_semi").groupBy("word").agg(F.count("*").alias("df"))
        counts = seen if counts is None else counts.unionByName(seen)
    ranked = tokens.withColumn("low", F.lower("word")).join(counts.withColumnRenamed("word", "low"), "low", "left")
    best = ranked.groupBy("key", "n", "items").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "low", "off")).alias("a"))
    win = F.struct(F.col("a.off").alias("off"), F.col("n").alias("n"), F.col("key").alias("key"), F.col("items").alias("items"))
    return best.groupBy(F.col("a.low").alias("anchor")).agg(F.collect_list(win).alias("wins"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_hit, n_items, items_sha256, contaminated) for every row.

    Words are runs of 0-9, A-Z (lower-cased), a-z and all characters beyond ASCII. A word inside any
    occurrence of a window is hit. Null or empty text has no words and no hits; without hits the digest is
    that of an empty string; rows that repeat an id are judged each by itself; null ids stay null; an empty
    benchmark marks nothing; an empty table gives an empty result; other columns are not read.
    """
    wins = checkpoint(windows(benchmark, width))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    table = checkpoint(anchors(texts, wins, "text"))
    rows = texts.select(F.monotonically_increasing_id().alias("row"), "id", _words(F.col("text")).alias("w"))
    parts = None
    for i, block in enumerate(_in_blocks(table, "anchor")):
        known = [r[0] for r in block.select("anchor").collect()]
        places = F.filter(F.sequence(F.lit(1), F.size("w")), lambda p: F.lower(F.get("w", p - 1)).isin(known))
        around = F.transform(
            places,
            lambda p: F.struct(
                F.lower(F.get("w", p - 1)).alias("word"),
                p.alias("p"),
                F.greatest(p - width + 1, F.lit(1)).alias("from"),
                F.slice("w", F.greatest(p - width + 1, F.lit(1)), F.lit(2 * width - 1)).alias("near"),
            ),
        )
        explode = F.explode if i else F.explode_outer
        at = rows.select("row", "id", _count(F.col("w")).alias("n_words"), explode(around).alias("c")).select("row", "id", "n_words", "c.*")
        at = at.join(F.broadcast(block.withColumnRenamed("anchor", "word")), "word", "left")
        start = lambda x: F.col("p") - x["off"]
        local = lambda x: start(x) - F.col("from") + 1
        inside = lambda x: (start(x) >= 1) & (local(x) >= 1) & (local(x) + x["n"] - 1 <= F.size("near"))
        same = lambda x: F.translate(F.array_join(F.slice("near", F.greatest(local(x), F.lit(1)), x["n"]), " "), UPPER, LOWER) == x["key"]
        hits = F.transform(F.filter("wins", lambda x: inside(x) & same(x)), lambda x: F.struct(start(x).alias("s"), (start(x) + x["n"]).alias("e"), x["items"].alias("items")))
        found = at.select("row", "id", "n_words", hits.alias("hits"))
        parts = found if parts is None else parts.unionByName(found)
    one = parts.groupBy("row", "id", "n_words").agg(F.flatten(F.collect_list("hits")).alias("hits"))
    spans = F.array_sort(F.transform("hits", lambda h: F.struct(h["s"], h["e"])))
    covered = F.aggregate(
        spans,
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end")),
        lambda a, h: F.struct((a["n"] + F.greatest(F.lit(0), h["e"] - F.greatest(a["end"], h["s"]))).cast("long").alias("n"), F.greatest(a["end"], h["e"]).alias("end")),
        lambda a: a["n"],
    )
    items = F.array_sort(F.array_distinct(F.flatten(F.transform("hits", lambda h: h["items"]))))
    out = one.select("id", "n_words", covered.alias("n_hit"), items.alias("items"))
    return out.select(F.col("id").alias(id_col), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are not contaminated, each judged by itself.

    Its text alone decides on a row, so the text's digest (and the id, which deals out copies) is a key that holds whenever the table is read.
    """
    key = F.concat(F.sha2(text_col, 256), F.lit(":"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    keyed = docs.withColumn("__key", key)
    bad = decontaminate(keyed, benchmark, id_col="__key", text_col=text_col).where("contaminated").select("__key").distinct()
    return keyed.join(bad, "__key", "left_anti").drop("__key")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


SQL = r"""
WITH w AS (
  SELECT 'd' AS kind, CAST(doc_id AS VARCHAR) AS id, text FROM documents UNION ALL SELECT 'b', CAST(item_id AS VARCHAR), text FROM benchmark),
t AS (
  SELECT kind, id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM w),
b AS (
  SELECT id AS item, least(len(w), 10) AS n, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM t WHERE kind = 'b' AND len(w) > 0),
win AS (SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS key FROM b),
sizes AS (SELECT DISTINCT n FROM win),
dw AS (
  SELECT id, s.n, w, unnest(range(1, len(w) - s.n + 2)) AS i FROM t, sizes s WHERE kind = 'd' AND len(w) >= s.n),
hit AS (
  SELECT k.id, k.i, k.n, win.item FROM (SELECT id, n, i, array_to_string(w[i:i + n - 1], ' ') AS key FROM dw) k JOIN win ON win.n = k.n AND win.key = k.key),
pos AS (SELECT id, count(DISTINCT p) AS n_hit FROM (SELECT id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY id),
its AS (SELECT id, list_sort(list_distinct(list(item))) AS items FROM hit GROUP BY id)
SELECT CAST(t.id AS BIGINT) AS doc_id, CAST(len(t.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(len(items), 0) AS BIGINT) AS n_items,
  sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM t LEFT JOIN pos ON pos.id = t.id LEFT JOIN its ON its.id = t.id WHERE t.kind = 'd'
"""
