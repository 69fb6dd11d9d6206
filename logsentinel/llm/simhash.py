"""SimHash near-duplicates (operator 11): fingerprints, and links by BK-trees of shards.

1. A text's fingerprint is the majority of each bit over the XXH64 of its three-word shingles.
   Equal fingerprints become one vertex, so copies are searched once.
2. Two fingerprints that differ in at most RADIUS bits agree in one of RADIUS + 1 parts of their
   bits. So there are RADIUS + 1 views, each dealt into shards by the hash of one part; near
   fingerprints share a shard in at least one view. A shard that is too large is cut into pieces.
3. Each piece is a BK-tree: a node's children are keyed by their Hamming distance to it. Spark
   joins the trees of a shard to the pieces of the same shard, which is how a tree gets to all
   queries that need it (through the driver it would take all fingerprints there). A query
   follows only the edges within RADIUS of its own distance.
4. A task hands on a forest of the links it found, at most one row for each of its fingerprints;
   components are counted over these.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkit as K
from .graph import components
from .session import checkpoint

WIDTH, SEED, RADIUS = 3, 42, 2
#: Fingerprints of a piece (as many as a hash deals out), and the pairs of query and node that a search holds at once.
PIECE, BLOCK = 2048, 1 << 16
#: Copies of a fingerprint are joined by broadcast where they are more than 1 in COMMON rows.
COMMON = 1000
#: Shingles whose bits are counted at once.
CHUNK = 1 << 18


def shingle_hashes(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of every run of WIDTH words joined by one blank (fewer words are one run), and each text's first (n + 1)."""
    data = K.LOWER[data]
    starts, ends, first = K.words(data, offs)
    count = np.diff(first)
    runs = np.where(count >= WIDTH, count - WIDTH + 1, np.minimum(count, 1))
    out_first = np.concatenate([[0], np.cumsum(runs)])
    begin = np.repeat(first[:-1] - out_first[:-1], runs) + np.arange(out_first[-1])
    end = begin + np.repeat(np.minimum(count, WIDTH), runs)
    out, h = np.zeros(len(begin), np.uint64), xxhash.xxh64_intdigest
    for at in range(0, len(begin), CHUNK):
        b, e = begin[at : at + CHUNK], end[at : at + CHUNK]
        s, sizes = starts[b[0] : e[-1]], ends[b[0] : e[-1]] - starts[b[0] : e[-1]]
        to = np.cumsum(sizes + 1)
        inside = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        joined = np.full(int(to[-1]), 32, np.uint8)
        joined[np.repeat(to - sizes - 1, sizes) + inside] = data[np.repeat(s, sizes) + inside]
        text = joined.tobytes()
        spans = zip((to - sizes - 1)[b - b[0]].tolist(), (to - 1)[e - 1 - b[0]].tolist(), strict=True)
        out[at : at + len(b)] = np.fromiter((h(text[x:y], SEED) for x, y in spans), np.uint64, len(b))
    return out, out_first


def text_fingerprints(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """The fingerprint of each text; zero without words."""
    hashed, first = shingle_hashes(data, offs)
    counts, n = np.zeros((len(offs) - 1, 64), np.int64), np.diff(first)
    text = np.repeat(np.arange(len(n)), n)
    for at in range(0, len(hashed), CHUNK):
        bits = np.unpackbits(hashed[at : at + CHUNK].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        lead = np.flatnonzero(np.diff(text[at : at + CHUNK], prepend=-1))
        for i, j in zip(lead.tolist(), [*lead[1:].tolist(), len(bits)], strict=True):
            counts[text[at + i]] += bits[i:j].sum(axis=0, dtype=np.int64)
    return np.packbits(2 * counts > n[:, None], axis=1).view(">u8").astype(np.uint64).ravel()


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp): the fingerprint of each row's text as a signed 64-bit number; a null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in K.slices(batch, text_col):
                yield pa.RecordBatch.from_arrays([part.column(id_col), pa.array(text_fingerprints(*K.utf8(part.column(text_col))).view(np.int64))], names=["id", "fp"])

    return docs.select(id_col, text_col).mapInArrow(run, f"id {docs.schema[id_col].dataType.simpleString()}, fp long")


class Tree:
    """A BK-tree in arrays: ``keys`` (node * 128 + distance) of all edges in order, and the child of each.

    It is the tree that inserting the values one after the other gives, built level by level: of the values at a node,
    the first one of each distance becomes its child and the others go on to that child.
    """

    def __init__(self, values: np.ndarray):
        self.values = values
        at, node, keys, child = np.arange(1, len(values)), np.zeros(max(len(values) - 1, 0), np.int64), [], []
        while len(at):
            key = node * 128 + np.bitwise_count(values[at] ^ values[node]).astype(np.int64)
            order = np.argsort(key, kind="stable")
            at, key = at[order], key[order]
            lead = np.ones(len(at), bool)
            lead[1:] = key[1:] != key[:-1]
            keys.append(key[lead])
            child.append(at[lead])
            node = at[lead][np.cumsum(lead) - 1][~lead]
            at = at[~lead]
        keys = np.concatenate(keys) if keys else np.zeros(0, np.int64)
        child = np.concatenate(child) if child else np.zeros(0, np.int64)
        order = np.argsort(keys)
        self.keys, self.child = keys[order], child[order]

    def near(self, queries: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
        """Indices (query, value) of all pairs within ``radius``: depth-first, in blocks of bounded size."""
        found_q, found_v = [], []
        if len(self.values):
            stack = [(np.arange(a, min(a + BLOCK, len(queries))), np.zeros(min(BLOCK, len(queries) - a), np.int64)) for a in range(0, len(queries), BLOCK)]
            while stack:
                q, node = stack.pop()
                if not len(q):
                    continue
                d = np.bitwise_count(queries[q] ^ self.values[node]).astype(np.int64)
                hit = d <= radius
                found_q.append(q[hit])
                found_v.append(node[hit])
                low, high = np.searchsorted(self.keys, node * 128 + np.maximum(d - radius, 0)), np.searchsorted(self.keys, node * 128 + d + radius, "right")
                n = high - low
                total = np.concatenate([[0], np.cumsum(n)])
                cuts = np.unique(np.concatenate([[0], np.searchsorted(total, np.arange(BLOCK, total[-1], BLOCK)), [len(n)]]))
                for x, y in zip(cuts[:-1], cuts[1:], strict=True):
                    m = n[x:y]
                    edges = np.repeat(low[x:y] - (total[x:y] - total[x]), m) + np.arange(total[y] - total[x])
                    stack.append((np.repeat(q[x:y], m), self.child[edges]))
        none = np.zeros(0, np.int64)
        return np.concatenate(found_q or [none]), np.concatenate(found_v or [none])


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[list[int], list[int]]:
    """The links a - b without those that close a circle."""
    up: dict[int, int] = {}

    def top(x: int) -> int:
        root = x
        while up.get(root, root) != root:
            root = up[root]
        while up.get(x, x) != root:
            up[x], x = root, up[x]
        return root

    out_a, out_b = [], []
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        p, q = top(x), top(y)
        if p != q:
            up[max(p, q)] = min(p, q)
            out_a.append(x)
            out_b.append(y)
    return out_a, out_b


def _parts(fp: Column) -> list[Column]:
    """RADIUS + 1 parts of the bits."""
    ends = [64 * i // (RADIUS + 1) for i in range(RADIUS + 2)]
    return [F.shiftrightunsigned(F.shiftleft(fp, 64 - high), 64 - high + low) for low, high in zip(ends[:-1], ends[1:], strict=True)]


def links(vertices: DataFrame) -> DataFrame:
    """Links (a, b) between distinct fingerprints ``fp`` within RADIUS, as forests that keep every component whole."""
    many = vertices.count()
    if not many:
        return vertices.select(F.col("fp").alias("a"), F.col("fp").alias("b"))
    shards = max(1, many // PIECE)
    views = F.array(*[F.struct(F.lit(v).alias("view"), F.pmod(F.xxhash64(p), F.lit(shards)).alias("shard")) for v, p in enumerate(_parts(F.col("fp")))])
    dealt = vertices.select("fp", F.explode(views).alias("v")).select("fp", "v.view", "v.shard")
    large = dealt.groupBy("view", "shard").agg(F.ceil(F.count("*") / (2 * PIECE)).alias("pieces"))
    cut = dealt.join(large, ["view", "shard"]).withColumn("piece", F.pmod(F.xxhash64("fp", F.lit(1)), F.col("pieces")))
    pieces = checkpoint(cut.groupBy("view", "shard", "piece").agg(F.sort_array(F.collect_list("fp")).alias("fps")))
    trees = pieces.select("view", "shard", F.col("piece").alias("tree"), F.col("fps").alias("nodes"))
    meetings = pieces.join(trees, ["view", "shard"]).where("tree <= piece")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                queries, nodes = (batch.column(c)[i].values.to_numpy(zero_copy_only=False) for c in ("fps", "nodes"))
                q, v = Tree(nodes.view(np.uint64)).near(queries.view(np.uint64))
                a, b = queries[q], nodes[v]
                other = a != b
                a, b = _forest(a[other], b[other])
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return meetings.select("fps", "nodes").mapInArrow(run, "a long, b long")


def simhash_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint, component_id) for every row; component_id is the smallest id of the texts that links can reach.

    Words are runs of bytes other than ASCII white space, A-Z lower-cased. Null and empty texts, and those without words, have
    fingerprint zero and are linked like any other. Rows that repeat an id or a text each get a row; a null id names no component, its
    row gets the smallest id of its component (null if all are null). Texts of any length are read whole. An empty table gives an
    empty result; other columns are not read. Ids are integers.
    """
    rows = checkpoint(fingerprints(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "id", "text"))
    vertices = checkpoint(rows.groupBy("fp").agg(F.min("id").alias("least"), F.count("*").alias("copies")))
    comps = components(links(vertices.select("fp"))).withColumnRenamed("node", "fp")
    named = vertices.join(comps, "fp", "left").withColumn("comp", F.coalesce("comp", "fp"))
    least = named.groupBy("comp").agg(F.min("least").alias("component_id"))
    known = checkpoint(named.join(least, "comp").select("fp", "component_id", "copies"))
    # a fingerprint of over 1 in COMMON rows is looked up where its rows are: there are fewer than COMMON of these
    often = F.col("copies") > F.lit(rows.count() // COMMON)
    hot = F.broadcast(known.where(often).select("fp", "component_id", F.lit(True).alias("hot")))
    looked = rows.join(hot, "fp", "left")
    rest = looked.where("hot IS NULL").select("id", "fp").join(known.where(~often).select("fp", "component_id"), "fp")
    every = looked.where("hot").select("id", "fp", "component_id").unionByName(rest.select("id", "fp", "component_id"))
    return every.select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op11_simhash_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
