"""Spelling variants (operator 12): words within one edit, found in tries over letter-group counts.

1. Runs of letters are counted in the tasks that read the texts; a task hands on one row for each distinct word and flush.
2. A word is the vector of its counts in letter groups. One edit changes the vector by a surplus of at most one in one group and a
   deficit of at most one in another. Words with the same length and the same counts in the first FIXED groups are a shard; so a
   shard's near words are in a few shards that its own key names, and Spark joins shards to these.
3. Within a shard words are arranged in a trie by the counts of the other groups. A search goes down depth-first with what is left of
   its budget of one surplus and one deficit, many words at a time; words at the leaves it reaches are verified.
4. Each word's form is its most frequent near word; roots follow forms by doubling.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkit as K
from .session import checkpoint

DAMAGE, LEAST_LENGTH, LEAST_COUNT, TIMES = 199, 6, 5, 5
#: Letters of the groups; the last group has all others. The first FIXED counts are part of a shard's key.
GROUPS, FIXED = ("ei", "an", "o", "t", "r", "s", "u", "hl", "dm"), 2
#: Words of a piece of a shard (as many as a hash deals out), entries of a search at once, distinct words that a task holds.
PIECE, BLOCK, HELD = 4096, 1 << 16, 400_000
#: Bytes of a text that are read at once, and the longest word that is verified in arrays.
CHUNK, LONG = 1 << 22, 32
_RUN, _REST = re.compile(rb"(?:[a-z]|\xC3[\x80-\xBF])+"), re.compile(rb"(?:[A-Za-z]|\xC3[\x80-\xBF])*")


def _runs(text: bytes) -> Iterator[list[bytes]]:
    """The runs of a text, piece by piece; a piece ends behind a run."""
    at = 0
    while at < len(text):
        to = at + CHUNK
        if to < len(text):
            # back to a byte that begins a character, then on to the end of a run that it may be in
            while (text[to] & 0xC0) == 0x80:
                to -= 1
            to = _REST.match(text, to).end()
        yield _RUN.findall(text[at:to].lower())
        at = to


def damaged(doc_id: bytes, counts: Counter) -> Iterator[tuple[str, int]]:
    """Words of a text with their counts, after the code points that a checksum of id and word names are deleted."""
    before = zlib.crc32(doc_id + b":")
    for run, n in counts.items():
        if len(run) >= LEAST_LENGTH:
            h = zlib.crc32(run, before)
            word = run.decode()
            if h % DAMAGE == 0:
                i = h % len(word)
                word = word[:i] + word[i + 1 :]
            if len(word) >= LEAST_LENGTH:
                yield word, n


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", damage: bool = True) -> DataFrame:
    """(word, n): how often each word of at least LEAST_LENGTH code points occurs in all texts, if at least LEAST_COUNT times.

    With ``damage`` one code point of about 1 in DAMAGE words of a text is deleted first (a null id is written as nothing).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], names=["word", "n"])
            total.clear()
            return out

        for batch in batches:
            for key, text in zip(batch.column("id"), batch.column("text"), strict=True):
                own: Counter = Counter()
                for runs in _runs((text.as_py() or "").encode()):
                    own.update(runs)
                if damage:
                    for word, n in damaged((key.as_py() or "").encode(), own):
                        total[word] += n
                else:
                    for run, n in own.items():
                        total[run.decode()] += n
                if len(total) > HELD:
                    yield flush()
        yield flush()

    texts = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    return texts.mapInArrow(run, "word string, n long").where(F.length("word") >= LEAST_LENGTH).groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


def _group_of() -> np.ndarray:
    out = np.full(256, len(GROUPS), np.int64)
    for g, letters in enumerate(GROUPS):
        out[[ord(c) for c in letters]] = g
    return out


def vectors(words: list[str]) -> np.ndarray:
    """Counts of each word's letters in the groups behind the first FIXED ones."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    codes = np.frombuffer("".join(words).encode("latin-1"), np.uint8)
    width = len(GROUPS) + 1
    flat = np.bincount(np.repeat(np.arange(len(words)), size) * width + _group_of()[codes], minlength=len(words) * width)
    return flat.reshape(-1, width)[:, FIXED:]


class Trie:
    """Words in order of their vectors; level by level the edges (parent * BASE + count), in order, and their ranges of words."""

    BASE = 1 << 32

    def __init__(self, vecs: np.ndarray):
        self.order = np.lexsort(vecs.T[::-1])
        vecs = vecs[self.order]
        parent, self.levels = np.zeros(len(vecs), np.int64), []
        for level in range(vecs.shape[1]):
            key = parent * self.BASE + vecs[:, level]
            lead = np.ones(len(key), bool)
            lead[1:] = key[1:] != key[:-1]
            self.levels.append(key[lead])
            parent = np.cumsum(lead) - 1
        self.first = np.concatenate([np.flatnonzero(lead), [len(vecs)]]) if len(vecs) else np.zeros(1, np.int64)

    def search(self, vecs: np.ndarray, surplus: int, deficit: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query, word) candidates: words whose counts have ``surplus`` more and ``deficit`` fewer than the query's at most, one in a group."""
        n = len(vecs) if len(self.order) else 0
        stack = [(0, np.arange(a, min(a + BLOCK, n)), np.zeros(min(BLOCK, n - a), np.int64), np.full(min(BLOCK, n - a), surplus), np.full(min(BLOCK, n - a), deficit)) for a in range(0, n, BLOCK)]
        while stack:
            level, q, node, s, d = stack.pop()
            if level == len(self.levels):
                size = self.first[node + 1] - self.first[node]
                total = np.concatenate([[0], np.cumsum(size)])
                cuts = np.unique(np.concatenate([[0], np.searchsorted(total, np.arange(BLOCK, total[-1], BLOCK)), [len(q)]]))
                for x, y in zip(cuts[:-1], cuts[1:], strict=True):
                    inside = np.arange(total[y] - total[x]) - np.repeat(total[x:y] - total[x], size[x:y])
                    yield np.repeat(q[x:y], size[x:y]), self.order[np.repeat(self.first[node[x:y]], size[x:y]) + inside]
                continue
            edges, went = self.levels[level], []
            for step, able in ((0, slice(None)), (1, s > 0), (-1, d > 0)):
                count = vecs[q[able], level] + step
                at = np.minimum(np.searchsorted(edges, node[able] * self.BASE + count), len(edges) - 1)
                hit = (edges[at] == node[able] * self.BASE + count) & (count >= 0)
                went.append((q[able][hit], at[hit], s[able][hit] - (step > 0), d[able][hit] - (step < 0)))
            q, node, s, d = (np.concatenate(x) for x in zip(*went, strict=True))
            stack.extend((level + 1, q[a : a + BLOCK], node[a : a + BLOCK], s[a : a + BLOCK], d[a : a + BLOCK]) for a in range(0, len(q), BLOCK))


def one_edit(a: str, b: str) -> bool:
    """Whether exactly one code point is inserted, deleted or replaced."""
    if len(a) < len(b):
        a, b = b, a
    if len(a) - len(b) > 1 or a == b:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(b))
    return a[i + 1 :] == (b[i + 1 :] if len(a) == len(b) else b[i:])


class Letters:
    """Words as rows of codes, from the left and from the right; longer words than LONG are compared one by one."""

    def __init__(self, words: list[str]):
        self.words = words
        self.size = np.fromiter(map(len, words), np.int64, len(words))
        cut = [w[:LONG] for w in words]
        self.left = np.frombuffer("".join(w.ljust(LONG, "\0") for w in cut).encode("latin-1"), np.uint8).reshape(-1, LONG)
        self.right = np.frombuffer("".join(w[-LONG:].rjust(LONG, "\0")[::-1] for w in words).encode("latin-1"), np.uint8).reshape(-1, LONG)


def verified(a: Letters, b: Letters, i: np.ndarray, j: np.ndarray, same_length: bool) -> np.ndarray:
    """Which pairs differ by exactly one edit; lengths are equal, or ``a``'s words are one longer."""
    if same_length:
        ok = np.count_nonzero(a.left[i] != b.left[j], axis=1) == 1
    else:  # what agrees from the left and what agrees from the right cover the shorter word
        n = b.size[j]
        left, right = (np.argmin(np.concatenate([x[i] == y[j], np.zeros((len(i), 1), bool)], axis=1), axis=1) for x, y in ((a.left, b.left), (a.right, b.right)))
        ok = np.minimum(left, n) + np.minimum(right, n) >= n
    for k in np.flatnonzero((a.size[i] > LONG) | (b.size[j] > LONG)):
        ok[k] = one_edit(a.words[i[k]], b.words[j[k]])
    return ok


def _best(of: np.ndarray, other: np.ndarray, words: list[str], names: list[str], counts: np.ndarray) -> Iterator[tuple[str, int, int, str]]:
    """(word, near words, largest count, word of it) of pairs of indices."""
    rank = np.argsort(np.argsort(np.array(names, object), kind="stable")) if len(of) else other
    order = np.lexsort((rank[other], -counts[other], of))
    of, other = of[order], other[order]
    lead = np.flatnonzero(np.diff(of, prepend=-1))
    for at, n in zip(lead.tolist(), np.diff(np.append(lead, len(of))).tolist(), strict=True):
        yield words[of[at]], n, int(counts[other[at]]), names[other[at]]


def near_words(words: DataFrame) -> DataFrame:
    """(word, n_near, best): for each word that has near ones their number, and (count, word) of the most frequent.

    ``words`` (word, n) are distinct and in the range of U+0000 to U+00FF.
    """
    count_in = lambda letters: F.length("word") - F.length(F.translate("word", letters, ""))
    keys = ["size", *(f"c{g}" for g in range(FIXED))]
    keyed = words.select("word", "n", F.length("word").alias("size"), *[count_in(GROUPS[g]).alias(f"c{g}") for g in range(FIXED)])
    many = keyed.groupBy(*keys).agg(F.ceil(F.count("*") / PIECE).alias("pieces"))
    cut = keyed.join(many, keys).withColumn("piece", F.pmod(F.xxhash64("word"), F.col("pieces")))
    shards = checkpoint(cut.groupBy(*keys, "piece").agg(F.collect_list("word").alias("words"), F.collect_list("n").alias("counts")))
    # targets of a shard: the same length (one surplus and one deficit at most), or one code point less (one deficit)
    moves = []
    for shorter in (0, 1):
        steps = [tuple(0 for _ in range(FIXED))] + [tuple(x * (g == h) for h in range(FIXED)) for g in range(FIXED) for x in (1, -1)]
        steps += [tuple((h == g) - (h == k) for h in range(FIXED)) for g in range(FIXED) for k in range(FIXED) if g != k]
        for step in steps:
            surplus, deficit = 1 - shorter - step.count(1), 1 - step.count(-1)
            if surplus >= 0:
                moves.append(F.struct(F.lit(-shorter).alias("by"), *[F.lit(x).alias(f"m{g}") for g, x in enumerate(step)], F.lit(surplus).alias("surplus"), F.lit(deficit).alias("deficit")))
    asked = shards.select("*", F.explode(F.array(*moves)).alias("m")).select(
        (F.col("size") + F.col("m.by")).alias("size"), *[(F.col(f"c{g}") + F.col(f"m.m{g}")).alias(f"c{g}") for g in range(FIXED)],
        F.col("words").alias("asked"), F.col("counts").alias("asked_counts"), F.col("piece").alias("asking"), F.col("m.by").alias("by"), F.col("m.surplus").alias("surplus"), F.col("m.deficit").alias("deficit"),
        F.concat_ws(",", *[F.col(f"m.m{g}") for g in range(FIXED)]).alias("step"))
    # of two shards of one length each is the other's target, so the one with the smaller step asks; inside a shard the smaller piece does
    still = ",".join("0" for _ in range(FIXED))
    meetings = asked.join(shards, keys).where((F.col("by") < 0) | (F.col("step") > still) | ((F.col("step") == still) & (F.col("asking") <= F.col("piece"))))
    names = ["words", "counts", "asked", "asked_counts", "by", "surplus", "deficit", "step", "asking", "piece"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                x = {c: batch.column(c)[i] for c in names}
                words, asked = x["words"].as_py(), x["asked"].as_py()
                counts, asked_counts = (x[c].values.to_numpy(zero_copy_only=False) for c in ("counts", "asked_counts"))
                same, itself = x["by"].as_py() == 0, x["step"].as_py() == still and x["by"].as_py() == 0 and x["asking"].as_py() == x["piece"].as_py()
                a, b, pairs = Letters(asked), Letters(words), []
                for q, w in Trie(vectors(words)).search(vectors(asked), x["surplus"].as_py(), x["deficit"].as_py()):
                    if itself:
                        q, w = q[q < w], w[q < w]
                    ok = verified(a, b, q, w, same)
                    pairs.append((q[ok], w[ok]))
                q, w = (np.concatenate(p) for p in zip(*pairs, strict=True)) if pairs else (np.zeros(0, np.int64), np.zeros(0, np.int64))
                if itself:
                    found = list(_best(np.concatenate([q, w]), np.concatenate([w, q]), words, words, counts))
                else:
                    found = [*_best(q, w, asked, words, counts), *_best(w, q, words, asked, asked_counts)]
                columns = list(zip(*found, strict=True)) or [(), (), (), ()]
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.string())], names=["word", "near", "near_n", "other"])

    found = meetings.select(*names).mapInArrow(run, "word string, near long, near_n long, other string")
    return found.groupBy("word").agg(F.sum("near").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("minus"), F.col("other").alias("word"))).alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): the last word of each chain of forms (word, form); counts grow along a chain, so it ends."""
    at = checkpoint(forms.select("word", F.col("form").alias("root")))
    while True:
        on = at.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = checkpoint(at.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        at = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            return at


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", damage: bool = False) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every word of the texts, see ``word_counts``.

    ``form`` is the most frequent near word (ties: the smallest in code-point order) if it is TIMES as frequent, else null; ``root`` is the end of the chain
    of forms, the word itself without one. Null and empty texts have no words; rows that repeat count each; texts are read whole, in pieces where
    they are long; an empty table gives an empty result; other columns are not read.
    """
    words = checkpoint(word_counts(docs, id_col, text_col, damage))
    near = checkpoint(near_words(words))
    joined = words.join(near, "word", "left").withColumn("able", -F.col("best.minus") >= TIMES * F.col("n"))
    forms = joined.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(F.col("able"), F.col("best.word")).alias("form"), F.when(F.col("able"), -F.col("best.minus")).alias("form_n"))
    ends = roots(forms.where("form IS NOT NULL"))
    return forms.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(spark.read.parquet(f"{sf_dir}/documents.parquet"), damage=True)
