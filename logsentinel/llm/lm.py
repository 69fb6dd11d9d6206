"""LM scoring (operator 5): a log-bilinear model over word vectors, trained by noise-contrastive estimation.

The model's units are the end of a text, the ``FREQUENT`` most frequent training words, and ``CLASSES`` classes of all other
words by their surface (short words by themselves, longer ones by their ending). A unit has a vector for each of the two places
before the token and one as the token itself; it predicts by the sum of the context's vectors times its own, and a bias,
normalised over all units. A word of a class has its smoothed share of the class's training counts, so that the
probabilities of a context add up to 1 over the training vocabulary and one unknown token for each class.

1. Each scan task packs its texts into compressed blocks, which are written once as a table. Each block counts its own tokens
   where it lies, so that only one row for each distinct token and block is shuffled.
2. A training text's row goes to one of ``training tokens / SHARD_TOKENS`` shards by the hash of its id and text, and a shard is
   read in the order of these hashes, so the model depends on the rows alone and not on how tasks read them. Shard 0 gives the
   first weights (``FIRST_PASSES``); from these every shard is trained once more (``PASSES``), so that all training tokens count, and
   the shards' weights are averaged by their tokens in Spark. The driver sees the averages and the frequent words only (a
   bounded number, whatever the corpus).
3. Counts over all training texts come back to the blocks that have the token, and the block's texts are scored by
   batched matrix products; a task keeps the normaliser of each context that it has met.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from . import textkit as K
from .session import stored

FREQUENT, CLASSES, DIM = 703, 64, 16
#: Unit 0 is the end, then the frequent words, then the classes of the other words (class 0 is the end's and stays unused).
UNITS = 1 + FREQUENT + CLASSES
#: Bytes of text in a block, about; a longer text is a block of its own.
BLOCK_BYTES = 8 << 20
#: Key of the end of a text.
END_KEY = -(2**63)
#: Training tokens of a shard, about; tokens that are mixed at once; noise units of a minibatch.
SHARD_TOKENS, MIXED, NOISE = 1 << 20, 1 << 18, 128
#: (rate, tokens of a minibatch) of the passes over shard 0, and of the passes over every shard after them.
FIRST_PASSES, PASSES = ((0.02, 1024), (0.02, 1024), (0.01, 1024), (0.005, 1024)), ((0.005, 2048),)


def _tokens(batch: pa.RecordBatch, text: str = "text") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys and classes of all tokens with each text's end, and each text's first token (n + 1)."""
    data, offs = K.utf8(batch.column(text))
    data = K.LOWER[data]
    starts, ends, first = K.words(data, offs)
    h = K.hashes(data, starts, ends)
    size = ends - starts
    tail = K.hashes(data, np.where(size > 3, ends - 2, starts), ends, seed=5)
    cls = 1 + (tail % np.uint64(CLASSES - 1)).astype(np.int64)
    n = len(offs) - 1
    out_first = first + np.arange(n + 1)
    keys, classes = np.full(len(h) + n, END_KEY, np.int64), np.zeros(len(h) + n, np.int64)
    body = np.ones(len(keys), bool)
    body[out_first[1:] - 1] = False
    keys[body], classes[body] = h.view(np.int64), cls
    return keys, classes, out_first


def to_units(keys: np.ndarray, classes: np.ndarray, head: np.ndarray) -> np.ndarray:
    """Units of tokens; ``head`` holds the frequent words' keys, sorted."""
    if not len(head):
        return np.where(keys == END_KEY, 0, 1 + FREQUENT + classes)
    at = np.minimum(np.searchsorted(head, keys), len(head) - 1)
    return np.where(keys == END_KEY, 0, np.where(head[at] == keys, 1 + at, 1 + FREQUENT + classes))


def contexts(units: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Units of the second-last and the last token before each token; before a text there are ends."""
    one, two = np.zeros_like(units), np.zeros_like(units)
    one[1:], two[2:] = units[:-1], units[:-2]
    begin = first[:-1][np.diff(first) > 0]
    one[begin] = two[begin] = 0
    second = begin + 1
    second = second[second < len(units)]
    two[second] = 0
    return two, one


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of a task's rows (id, text, h, held_out), compressed; a block is named by the hash of its content."""
    held, size = [], 0

    def block() -> pa.RecordBatch:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, held[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_table(pa.Table.from_batches(held).combine_chunks())
        data = sink.getvalue().to_pybytes()
        return pa.RecordBatch.from_arrays([pa.array(np.array([xxhash.xxh3_64_intdigest(data)], np.uint64).view(np.int64)), pa.array([data], pa.binary())], names=["block", "data"])

    for batch in batches:
        for part in K.slices(batch):
            held.append(part)
            size += part.nbytes
            if size >= BLOCK_BYTES:
                yield block()
                held, size = [], 0
    if held:
        yield block()


def _unpack(data: pa.Scalar) -> Iterator[pa.RecordBatch]:
    for batch in pa.ipc.open_stream(data.as_buffer()):
        yield from K.slices(batch)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each block the distinct tokens with their training counts."""
    for batch in batches:
        for block, data in zip(batch.column("block"), batch.column("data"), strict=True):
            keys, classes, train = [], [], []
            for part in _unpack(data):
                k, c, first = _tokens(part)
                known = ~np.repeat(np.asarray(part.column("held_out").to_numpy(zero_copy_only=False), bool), np.diff(first))
                u, at, back = np.unique(k, return_index=True, return_inverse=True)
                keys.append(u)
                classes.append(c[at])
                train.append(np.bincount(back, weights=known, minlength=len(u)).astype(np.int64))
            k, c, n = map(np.concatenate, (keys, classes, train))
            u, at, back = np.unique(k, return_index=True, return_inverse=True)
            total = np.bincount(back, weights=n, minlength=len(u)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(u), block.as_py(), np.int64)), pa.array(u), pa.array(c[at], pa.int32()), pa.array(total)], names=["block", "key", "class", "train"])


def begin(unit_counts: np.ndarray, seed: int = 7) -> np.ndarray:
    """Weights (UNITS, 3 * DIM + 1) before training: small vectors for the two places and the token, and the units' own frequency as bias."""
    share = (unit_counts + 0.5) / (unit_counts.sum() + 0.5 * UNITS)
    return np.concatenate([np.random.default_rng(seed).normal(0, 0.1, (UNITS, 3 * DIM)), np.log(share)[:, None]], axis=1)


def _rows_added(index: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """(UNITS, n) sums of rows by index."""
    out = np.zeros((UNITS, rows.shape[1]), rows.dtype)
    order = np.argsort(index, kind="stable")
    at = index[order]
    lead = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    out[at[lead]] = np.add.reduceat(rows[order], lead, axis=0)
    return out


class Trainer:
    """Noise-contrastive estimation against the units' own frequencies, ``NOISE`` noise units for a minibatch, by Adam."""

    def __init__(self, weights: np.ndarray, unit_counts: np.ndarray, rate: float, seed: int | list[int]):
        """``weights`` are those of a beginning (UNITS, 3 * DIM + 1), or a ``state`` (3, UNITS, 3 * DIM + 1), from which Adam goes on without a start of its own."""
        go_on = weights.ndim == 3
        self.w = (weights[0] if go_on else weights).astype(np.float32)
        #: Average of the weights of about the last 50 steps, which is what a task hands on.
        self.smooth = self.w.copy()
        share = (unit_counts + 0.5) / (unit_counts.sum() + 0.5 * UNITS)
        self.shift, self.cum = np.log(NOISE * share).astype(np.float32), np.cumsum(share)
        self.mean, self.var = (x.astype(np.float32) for x in (weights[1:] if go_on else np.zeros((2, *self.w.shape))))
        self.steps, self.settled = 0, go_on
        self.rate, self.rng = rate, np.random.default_rng(seed)

    @property
    def state(self) -> np.ndarray:
        return np.stack([self.smooth, self.mean, self.var]).astype(np.float64)

    def step(self, two: np.ndarray, one: np.ndarray, target: np.ndarray) -> None:
        w, d = self.w, DIM
        noise = np.minimum(np.searchsorted(self.cum, self.rng.random(NOISE)), UNITS - 1)
        hidden, out, other = w[two, :d] + w[one, d : 2 * d], w[target, 2 * d : 3 * d], w[noise, 2 * d : 3 * d]
        good = np.einsum("bd,bd->b", hidden, out) + w[target, -1] - self.shift[target]
        bad = hidden @ other.T + (w[noise, -1] - self.shift[noise])
        with np.errstate(over="ignore"):  # 1 / (1 + inf) is the right limit
            good, bad = (1 / (1 + np.exp(-good)) - 1) / len(target), 1 / (1 + np.exp(-bad)) / len(target)
        g_hidden = good[:, None] * out + bad @ other
        grad = np.zeros_like(w)
        grad[:, :d], grad[:, d : 2 * d] = _rows_added(two, g_hidden), _rows_added(one, g_hidden)
        grad[:, 2 * d :] = _rows_added(target, np.concatenate([good[:, None] * hidden, good[:, None]], axis=1))
        np.add.at(grad[:, 2 * d :], noise, np.concatenate([bad.T @ hidden, bad.sum(axis=0)[:, None]], axis=1))
        self.steps += 1
        self.mean += np.float32(0.1) * (grad - self.mean)
        self.var += np.float32(0.01) * (grad * grad - self.var)
        young = 0.0 if self.settled else 1.0
        self.w -= np.float32(self.rate) * (self.mean / np.float32(1 - young * 0.9**self.steps)) / (np.sqrt(self.var / np.float32(1 - young * 0.99**self.steps)) + np.float32(1e-8))
        self.smooth += np.float32(max(0.02, 1 / self.steps)) * (self.w - self.smooth)

    def learn(self, units: np.ndarray, first: np.ndarray, batch: int) -> None:
        """Minibatches of about equal size, ``batch`` tokens or so, of the texts' tokens, mixed."""
        units = units.astype(np.int32)
        two, one = contexts(units, first)
        for now in np.array_split(self.rng.permutation(len(units)), max(1, round(len(units) / batch))):
            self.step(two[now], one[now], units[now])


def _to_shards(head: np.ndarray, shards: int):
    """Of each training row its shard, its hash, and its tokens' units as two bytes each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column("data"):
                for part in _unpack(data):
                    part = part.filter(pa.compute.invert(part.column("held_out")))
                    k, c, first = _tokens(part)
                    u = to_units(k, c, head).astype("<i2")
                    h = part.column("h").to_numpy()
                    shard = (K.mix(h.view(np.uint64)) % np.uint64(shards)).astype(np.int32)
                    at = first.tolist()
                    yield pa.RecordBatch.from_arrays([pa.array(shard), pa.array(h), pa.array([u[x:y].tobytes() for x, y in zip(at[:-1], at[1:], strict=True)], pa.binary())], names=["shard", "h", "units"])

    return run


def _mixed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(shard, units, first) of runs of rows of one shard with ``MIXED`` tokens or more, wherever batches are cut."""
    shard, held, size = None, [], 0

    def run() -> tuple[int, np.ndarray, np.ndarray]:
        return shard, np.concatenate(held), np.concatenate([[0], np.cumsum([len(x) for x in held])])

    for batch in batches:
        for of, data in zip(batch.column("shard").to_pylist(), batch.column("units"), strict=True):
            if held and (of != shard or size >= MIXED):
                yield run()
                held, size = [], 0
            shard = of
            held.append(np.frombuffer(data.as_buffer(), "<i2"))
            size += len(held[-1])
    if held:
        yield run()


def _learn(rows: DataFrame, unit_counts: np.ndarray, weights: np.ndarray, passes: tuple[tuple[float, int], ...], seed: int) -> np.ndarray:
    """State after passes over the rows (shard, h, units): every shard goes on from ``weights``, and the shards' states are averaged
    by their tokens. With several passes a task keeps the shard's units (two bytes a token)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def result() -> pa.RecordBatch:
            for model.rate, batch in passes[1:]:
                for one in kept:
                    model.learn(*one, batch)
            flat = model.state.ravel()
            return pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat)), pa.int32()), pa.array(flat * tokens), pa.array(np.full(len(flat), tokens), pa.int64())], names=["place", "value", "tokens"])

        now, model, kept, tokens = None, None, [], 0
        for shard, units, first in _mixed(batches):
            if shard != now:
                if model is not None:
                    yield result()
                now, model, kept, tokens = shard, Trainer(weights, unit_counts, passes[0][0], [seed, shard]), [], 0
            model.learn(units, first, passes[0][1])
            tokens += len(units)
            if len(passes) > 1:
                kept.append((units, first))
        if model is not None:
            yield result()

    dealt = rows.repartition("shard").sortWithinPartitions("shard", "h", "units")
    out = dealt.mapInArrow(run, "place int, value double, tokens long").groupBy("place").agg((F.sum("value") / F.sum("tokens")).alias("value")).toArrow()
    order = np.argsort(out.column("place").to_numpy())
    return out.column("value").to_numpy()[order].reshape(3, *weights.shape[-2:]) if len(order) else weights


class Model:
    """Normalised log10 probabilities of units; the normaliser of a context is computed once."""

    def __init__(self, weights: np.ndarray):
        self.two, self.one, self.out, self.bias = np.split(weights.astype(np.float32), [DIM, 2 * DIM, 3 * DIM], axis=1)
        self.bias = self.bias[:, 0]
        self.norm = np.full(UNITS * UNITS, np.nan, np.float32)

    def log_probabilities(self, two: np.ndarray, one: np.ndarray) -> np.ndarray:
        """(contexts, UNITS), by a matrix product."""
        s = (self.two[two] + self.one[one]) @ self.out.T + self.bias
        top = s.max(axis=1, keepdims=True)
        return (s - top - np.log(np.exp(s - top).sum(axis=1, keepdims=True))) / np.log(np.float32(10))

    def score(self, two: np.ndarray, one: np.ndarray, target: np.ndarray, rows: int = 4096) -> np.ndarray:
        context = two.astype(np.int64) * UNITS + one
        fresh = np.unique(context[np.isnan(self.norm[context])])
        for at in range(0, len(fresh), rows):
            now = fresh[at : at + rows]
            s = (self.two[now // UNITS] + self.one[now % UNITS]) @ self.out.T
            s += self.bias
            top = s.max(axis=1)
            s -= top[:, None]
            self.norm[now] = top + np.log(np.exp(s, out=s).sum(axis=1))
        s = np.einsum("bd,bd->b", self.two[two] + self.one[one], self.out[target]) + self.bias[target]
        return ((s - self.norm[context]) / np.log(10)).astype(np.float64)


@lru_cache(maxsize=1)
def _model(data: bytes) -> Model:
    """One model for all tasks of a worker."""
    return Model(np.frombuffer(data, np.float32).reshape(UNITS, -1))


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 7, held: int = 2) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row.

    Rows whose crc32 of the id as text is ``held`` modulo ``folds`` are not learned from (a null id counts
    as 0). Null or empty text is one token, the end. With no training rows counts are 0 and units are about
    equally likely. Repeated rows count each; an empty table gives an empty result; other columns are not read. A text of any
    length is read whole, as a block of its own where it is long; rows that repeat id and text are in one shard. Words are compared by 64-bit hashes: among a million distinct
    words two share a hash with a probability of 3e-8. Ties among frequent words are broken by their hash.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(
        F.col(id_col).alias("id"),
        F.col(text_col).alias("text"),
        F.xxhash64(id_col, text_col).alias("h"),
        (F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(0)) % folds == held).alias("held_out"),
    )
    blocks = stored(texts.mapInArrow(_pack, "block long, data binary"))
    words = stored(blocks.mapInArrow(_count, "block long, key long, class int, train long"))
    totals = stored(words.groupBy("key", "class").agg(F.sum("train").alias("c")).where("c > 0"))
    frequent = totals.where(F.col("key") != END_KEY).orderBy(F.desc("c"), "key").limit(FREQUENT).collect()
    head = np.sort(np.array([r["key"] for r in frequent], np.int64))
    by_class = np.zeros((CLASSES, 2), np.int64)  # tokens and distinct words of each class, without the frequent ones
    ends, taken = 0, {(r["key"]): r["c"] for r in frequent}
    for r in totals.groupBy("class").agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect():
        by_class[r["class"]] = r["n"], r["v"]
    n, v = (int(x) for x in by_class.sum(axis=0))
    for r in frequent:
        by_class[r["class"]] -= r["c"], 1
    ends, by_class[0] = by_class[0, 0], 0
    unit_counts = np.concatenate([[ends], [taken[k] for k in head.tolist()], np.zeros(FREQUENT - len(head)), by_class[:, 0]]).astype(np.float64)
    weights = begin(unit_counts)
    if n:
        rows = stored(blocks.select("data").mapInArrow(_to_shards(head, max(1, round(n / SHARD_TOKENS))), "shard int, h long, units binary"))
        weights = _learn(rows.where("shard = 0"), unit_counts, weights, FIRST_PASSES, 0)
        for i, one in enumerate(PASSES, 1):
            weights = _learn(rows, unit_counts, weights, (one,), i)
        weights = weights[0] if weights.ndim == 3 else weights
    shared = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float32).tobytes())
    # The end and the frequent words are in nearly every block: their counts go along with the task instead of through the join.
    rare = ~F.col("key").isin([END_KEY, *head.tolist()])
    known = words.where(rare).select("block", "key").join(totals.where(rare).select("key", "c"), "key").select("block", "key", "c")

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        order = np.argsort(right.column("key").to_numpy())
        keys, counts = right.column("key").to_numpy()[order], right.column("c").to_numpy()[order]
        model_of = _model(shared.value)
        share = np.log10(by_class.sum(axis=1) + 1.0)
        out = []
        for data in left.column("data"):
            for part in _unpack(data):
                k, c, first = _tokens(part)
                u = to_units(k, c, head)
                count = np.where(u > FREQUENT, K.lookup(keys, counts, k), unit_counts[u].astype(np.int64))
                log_count = np.log10(count + 1.0)
                base = log_count - np.log10(n + v + 1)
                model = model_of.score(*contexts(u, first), u) + np.where(u > FREQUENT, log_count - share[c], 0.0)
                sums = [np.add.reduceat(x, first[:-1]) for x in (base, model, (count > 0).astype(np.int64))]
                out.append(pa.RecordBatch.from_arrays([part.column("id"), part.column("held_out"), pa.array(np.diff(first), pa.int64()), pa.array(sums[2]), pa.array(np.full(part.num_rows, n), pa.int64()), pa.array(sums[0]), pa.array(sums[1])], names=names))
        return pa.Table.from_batches(out) if out else nothing

    names = [id_col, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    kinds = [to_arrow_type(docs.schema[id_col].dataType), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
    nothing = pa.schema(list(zip(names, kinds, strict=True))).empty_table()

    schema = f"{id_col} {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return blocks.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(score, schema)


def op5_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
