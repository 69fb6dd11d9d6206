"""Near-duplicates (operator 2): one-permutation MinHash with optimal densification.

1. Each text becomes its set of five-word shingles (64-bit hashes) in an Arrow function; the set
   gives a digest, and one permutation gives ``BINS`` minima. Empty bins take the value of a bin that a
   universal probing sequence finds first (optimal densification), so that small sets collide
   like large ones. ``ROWS`` bins make a band, a band's hash is a bucket.
2. Texts with equal sets become one vertex (its smallest id), so copies never meet in a bucket.
3. Star-shaped candidates: a bucket's centre is its most connected member (members of a bucket
   count for each other over all bands); each member is paired with the centre only. Pairs are
   confirmed on full sets, and components contracted.
4. What a star can't see is done exactly: in buckets that still hold several components, vertices and
   pairs are excluded by upper bounds of an intersection, which can't exclude a link, and the
   remaining pairs across components are confirmed on full sets.

A pair of similarity 0.75 shares no band with probability (1 - 0.75**4)**40 = 2.5e-7.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from . import textkit as K
from .graph import components
from .session import checkpoint, stored

BANDS, ROWS = 40, 4
BINS = BANDS * ROWS
WIDTH = 5
PERCENT = 75
#: Rounds of bounds before the remaining pairs are compared, and the parts of all hashes in the last bound.
NARROWING, GROUPS = 2, 64


@lru_cache(maxsize=1)
def _probes(steps: int = 64) -> np.ndarray:
    """The bin that each empty bin asks at each step."""
    j, t = np.meshgrid(np.arange(BINS, dtype=np.uint64), np.arange(steps, dtype=np.uint64), indexing="ij")
    return (K.mix(j * np.uint64(1_000_003) + t + np.uint64(77)) % np.uint64(BINS)).astype(np.int64)


def densify(values: np.ndarray, filled: np.ndarray) -> np.ndarray:
    """Fills empty bins (rows: texts) by the first filled bin of their probing sequence."""
    out, probes = values.copy(), _probes()
    row, col = np.nonzero(~filled & filled.any(axis=1)[:, None])
    for t in range(probes.shape[1]):
        if not len(row):
            return out
        asked = probes[col, t]
        hit = filled[row, asked]
        out[row[hit], col[hit]] = values[row[hit], asked[hit]]
        row, col = row[~hit], col[~hit]
    for r in np.unique(row):  # few filled bins: each empty bin takes one by a rank that only depends on the pair
        have = np.flatnonzero(filled[r])
        need = col[row == r]
        rank = K.mix(need[:, None].astype(np.uint64) * np.uint64(BINS) + have[None, :].astype(np.uint64) + np.uint64(991))
        out[r, need] = values[r, have[np.argmin(rank, axis=1)]]
    return out


def text_sets(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, and each text's first (n + 1)."""
    data = K.LOWER[data]
    starts, ends, first = K.words(data, offs)
    hashed, at = K.shingles(K.hashes(data, starts, ends), first, WIDTH)
    text = np.repeat(np.arange(len(offs) - 1), np.diff(at))
    hashed = K.sort_within(hashed, at)
    keep = np.ones(len(hashed), bool)
    keep[1:] = (hashed[1:] != hashed[:-1]) | (text[1:] != text[:-1])
    hashed, text = hashed[keep], text[keep]
    return hashed, np.searchsorted(text, np.arange(len(offs)))


def band_hashes(sets: np.ndarray, first: np.ndarray) -> np.ndarray:
    """(texts, BANDS) bucket keys; rows of empty sets have no meaning."""
    n = len(first) - 1
    text = np.repeat(np.arange(n), np.diff(first))
    bins = ((sets >> np.uint64(32)) * np.uint64(BINS) >> np.uint64(32)).astype(np.int64)
    values, filled = np.zeros((n, BINS), np.uint64), np.zeros((n, BINS), bool)
    lead = np.ones(len(sets), bool)
    lead[1:] = (bins[1:] != bins[:-1]) | (text[1:] != text[:-1])
    values[text[lead], bins[lead]] = sets[lead]
    filled[text[lead], bins[lead]] = True
    signature = densify(values, filled).reshape(n, BANDS, ROWS)
    h = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), (n, BANDS)) + np.uint64(1)
    for r in range(ROWS):
        h = K.mix(h * np.uint64(0x9E3779B97F4A7C15) ^ signature[:, :, r])
    return h


def _lists(flat: np.ndarray, first: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(flat.view(np.int64)))


def _set_digest(sets: np.ndarray, first: np.ndarray, seed: int) -> np.ndarray:
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(K.mix(sets + np.uint64(seed)), dtype=np.uint64)])
    return (K.mix((total[first[1:]] - total[first[:-1]]) ^ np.diff(first).astype(np.uint64))).view(np.int64)


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, lo, hi, bands): lo and hi are 128 bits of a digest of the set; bands is null for empty sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in K.slices(batch, text_col):
                sets, first = text_sets(*K.utf8(part.column(text_col)))
                sizes = np.diff(first)
                bands = band_hashes(sets, first)[sizes > 0]
                at = np.concatenate([[0], np.cumsum(np.where(sizes > 0, BANDS, 0))])
                yield pa.RecordBatch.from_arrays(
                    [part.column(id_col), pa.array(sizes, pa.int64()), pa.array(_set_digest(sets, first, 11)), pa.array(_set_digest(sets, first, 23)), _lists(bands.ravel(), at)],
                    names=["id", "n_shingles", "lo", "hi", "bands"],
                )

    schema = f"id {docs.schema[id_col].dataType.simpleString()}, n_shingles long, lo long, hi long, bands array<long>"
    return docs.select(id_col, text_col).mapInArrow(run, schema)


def shingle_sets(docs: DataFrame, id_col: str = "node", text_col: str = "text") -> DataFrame:
    """(node, n, shingles): the full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in K.slices(batch, text_col):
                sets, first = text_sets(*K.utf8(part.column(text_col)))
                yield pa.RecordBatch.from_arrays([part.column(id_col), pa.array(np.diff(first), pa.int64()), _lists(sets, first)], names=["node", "n", "shingles"])

    schema = f"node {docs.schema[id_col].dataType.simpleString()}, n long, shingles array<long>"
    return docs.select(id_col, text_col).mapInArrow(run, schema)


def _confirm(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) whose full sets have 100 * intersection >= PERCENT * union."""
    left = sets.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("shingles").alias("sb"))
    sizes = (100 * F.least("na", "nb") >= PERCENT * F.greatest("na", "nb"))
    both = pairs.join(left, "a").join(right, "b").where(sizes)
    common = F.size(F.array_intersect("sa", "sb"))
    return both.where(100 * common >= PERCENT * (F.col("na") + F.col("nb") - common)).select("a", "b")


def _stars(members: DataFrame) -> DataFrame:
    """Pairs of each bucket's centre with a representative of each other component of the bucket."""
    best = members.groupBy("bucket", "comp").agg(F.max(F.struct("degree", (-F.col("node")).alias("minus"))).alias("rep"))
    inside = W.partitionBy("bucket")
    centred = best.withColumn("centre", F.max("rep").over(inside)).where("rep.minus <> centre.minus")
    return centred.select((-F.col("rep.minus")).alias("x"), (-F.col("centre.minus")).alias("y")).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def _with_components(members: DataFrame, comps: DataFrame) -> DataFrame:
    return members.drop("comp").join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))


def _open(members: DataFrame) -> DataFrame:
    """Members of buckets that hold several components."""
    spread = members.groupBy("bucket").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x < y").select("bucket")
    return members.join(spread, "bucket", "left_semi")


def _narrow(members: DataFrame, sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members that may still have a link across components, and their sets with ``common``.

    ``common`` counts the shingles that occur in another open vertex too, so no intersection is larger, and
    ``groups`` counts them by GROUPS parts of all hashes, so none is larger than the sum of the smaller counts.
    A link between sets of n and m shingles needs an intersection of PERCENT / (100 + PERCENT) of n + m at least.
    """
    open_sets = sets.select("node", "n", "shingles").join(members.select("node").distinct(), "node", "left_semi")
    flat = open_sets.select("node", F.explode("shingles").alias("h"))
    shared = flat.groupBy("h").agg(F.count("*").alias("c")).where("c > 1").select("h")
    common = flat.join(shared, "h", "left_semi").groupBy("node").agg(F.count("*").alias("common"), F.array(*[F.count_if(F.pmod("h", F.lit(GROUPS)) == g).cast("int") for g in range(GROUPS)]).alias("groups"))
    open_sets = checkpoint(open_sets.join(common, "node").where(f"100 * common >= {PERCENT} * n"))
    sized = members.select("bucket", "node", "comp").join(open_sets.select("node", "n", "common", "groups"), "node")
    around = sized.groupBy("bucket").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.min("n").alias("least"), F.max("common").alias("most")).where("x < y")
    able = sized.join(around, "bucket").where(f"{100 + PERCENT} * least(common, most) >= {PERCENT} * (n + greatest(least, n * {PERCENT} / 100))")
    return checkpoint(able.select("bucket", "node", "comp", "n", "common", "groups")), open_sets


def links(nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """Confirmed links (a, b) between vertices that keep every component whole.

    ``nodes``: node, bands; ``docs``: node, text of one row for each vertex (joined only for candidates).
    """
    buckets = nodes.select("node", F.explode("bands").alias("bucket"))
    members = buckets.withColumn("mates", F.count("*").over(W.partitionBy("bucket"))).where("mates > 1")
    members = checkpoint(members)
    degree = members.groupBy("node").agg(F.sum("mates").alias("degree"))
    members = checkpoint(members.drop("mates").join(degree, "node").withColumn("comp", F.col("node")))
    sets = checkpoint(shingle_sets(docs.join(degree.select("node"), "node", "left_semi")))
    tested = checkpoint(_stars(members))
    found = checkpoint(_confirm(tested, sets))
    members = checkpoint(_open(_with_components(members, components(found))))
    for _ in range(NARROWING):
        members, sets = _narrow(members, sets)
    x, y = (members.select("bucket", *(F.col(c).alias(f"{c}_{side}") for c in ("node", "comp", "n", "common", "groups"))) for side in "ab")
    needed = F.col("n_a") + F.col("n_b")
    bound = F.aggregate(F.zip_with("groups_a", "groups_b", lambda p, q: F.least(p, q)), F.lit(0), lambda t, g: t + g)
    able = F.expr(f"node_a < node_b AND comp_a <> comp_b AND 100 * least(n_a, n_b) >= {PERCENT} * greatest(n_a, n_b)")
    able = able & ((100 + PERCENT) * F.least("common_a", "common_b") >= PERCENT * needed) & ((100 + PERCENT) * bound >= PERCENT * needed)
    crossing = x.withColumnRenamed("bucket", "own").join(y, (F.col("own") == F.col("bucket")) & able).select(F.col("node_a").alias("a"), F.col("node_b").alias("b")).distinct()
    return checkpoint(found.unionByName(_confirm(crossing.join(tested, ["a", "b"], "left_anti"), sets)))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id, kept) for every row.

    Words are runs of bytes other than ASCII white space, A-Z lower-cased; a text of fewer than five
    words is one shingle. A null or empty text, or one without words, has an empty set and is alone.
    Rows that repeat an id are one vertex (links of any of their texts count) and each get a row.
    A null id is nobody's copy: component_id null, kept true. Ties: the smallest id stays. An empty
    table gives an empty result; other columns are not read. Ids are integers.
    """
    ids = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = checkpoint(signatures(ids, "id", "text"))
    linked = rows.where("n_shingles > 0 AND id IS NOT NULL")
    same = linked.groupBy("lo", "hi").agg(F.min(F.struct("id", "bands")).alias("one")).select("lo", "hi", F.col("one.id").alias("node"), F.col("one.bands").alias("bands"))
    same = checkpoint(same)
    texts = ids.withColumnRenamed("id", "node")
    edges = links(same.select("node", "bands"), texts)
    ids_of_sets = linked.select("id", "lo", "hi").join(same.select("lo", "hi", "node"), ["lo", "hi"])
    repeated = linked.select("id", "lo", "hi").distinct().groupBy("id").count().where("count > 1").select("id")
    same_id = ids_of_sets.join(repeated, "id", "left_semi").where("id <> node").select(F.col("node").alias("a"), F.col("id").alias("b")).distinct()
    comps = components(edges.unionByName(same_id))
    of_set = same.select("lo", "hi", "node").join(comps, "node", "left").select("lo", "hi", F.coalesce("comp", "node").alias("component_id"))
    out = rows.drop("bands").join(of_set, ["lo", "hi"], "left")
    own = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("id"))
    own = F.when(F.col("id").isNotNull(), own)
    return out.select(F.col("id").alias(id_col), "n_shingles", own.alias("component_id"), F.coalesce(F.col("id") == own, F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay: exactly one of each component, the one with the smallest id (null ids come last).

    Rows are numbered in a stored copy, so rows that repeat an id and rows without one are documents of their own.
    """
    rows = stored(docs.withColumn("__row", F.monotonically_increasing_id()))
    comps = near_duplicates(rows, "__row", text_col).select("__row", "component_id")
    first = F.min(F.struct(F.col(id_col).isNull(), F.col(id_col), F.col("__row"))).getField("__row")
    kept = rows.select("__row", id_col).join(comps, "__row").groupBy("component_id").agg(first.alias("__row")).select("__row")
    return rows.join(kept, "__row", "left_semi").drop("__row")


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: Brute force over all shared shingles, for small tables.
SQL = r"""
WITH RECURSIVE tok AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
sh AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM tok),
cls AS (SELECT s AS one, min(doc_id) AS node, len(s) AS n FROM (SELECT doc_id, list_sort(s) AS s FROM sh) GROUP BY s),
ex AS (SELECT node, n, unnest(one) AS h FROM cls WHERE n > 0),
pr AS (SELECT a.node AS a, b.node AS b, a.n AS na, b.n AS nb, count(*) AS c FROM ex a JOIN ex b ON a.h = b.h AND a.node < b.node GROUP BY ALL),
lk AS (SELECT a, b FROM pr WHERE 100 * c >= 75 * (na + nb - c)),
e AS (SELECT a, b FROM lk UNION ALL SELECT b, a FROM lk),
reach AS (SELECT node, node AS r FROM cls WHERE n > 0 UNION SELECT e.b, reach.r FROM reach JOIN e ON e.a = reach.node),
comp AS (SELECT node, min(r) AS comp FROM reach GROUP BY node)
SELECT d.doc_id, CAST(len(d.s) AS BIGINT) AS n_shingles, coalesce(m.comp, d.doc_id) AS component_id, d.doc_id = coalesce(m.comp, d.doc_id) AS kept
FROM (SELECT doc_id, list_sort(s) AS s FROM sh) d LEFT JOIN cls ON cls.one = d.s AND cls.n > 0 LEFT JOIN comp m ON m.node = cls.node
"""
