"""Toxicity (operator 6): subword-bag embeddings averaged into a linear softmax.

A word is the average of the vectors of its character n-grams (3 to 5 bytes, with word boundaries)
and of itself, all hashed into ``BUCKETS`` vectors, so misspellings share most vectors with their
word. Every run of ``WINDOW`` words is averaged into a softmax of two classes; a text has the maximum of its
windows, so a short remark counts in a long text, and texts that are joined score as the worst of them, but for
the windows across the seams. Windows are an extension of averaging the whole text (``window=None``); the README has the
figures of folds inside the training rows on which it was chosen. Vectors and softmax are trained jointly in numpy on a
bounded sample of labelled rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkit as K
from .labelled import fold, sample

BUCKETS, DIM, WINDOW = 1 << 18, 8, 8
GRAMS = (3, 4, 5)
#: Bounds of the sample that the model is fitted on: ids of each label, bytes of all texts of each label.
TRAIN_TOXIC, TRAIN_CLEAN = 2000, 4000
TRAIN_BYTES = {1: 8 << 20, 0: 16 << 20}
#: Bytes that a row counts for at least.
ROW_BYTES = 16
STEPS, RATE, DECAY = 100, 0.05, 1e-5
#: Subwords of fewer training texts keep a zero vector, and so many labels are taken to be wrong.
LEAST_TEXTS, NOISE = 5, 0.03

SEP = np.ones(256, bool)
SEP[48:58] = SEP[65:91] = SEP[97:123] = SEP[128:] = False


def subwords(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams of each word and of the word itself, and each word's first (n + 1)."""
    size = ends - starts
    at = np.concatenate([[0], np.cumsum(size + 2)])
    text = np.full(int(at[-1]) + 8, ord("<"), np.uint8)
    inner = np.ones(int(at[-1]), bool)
    inner[at[:-1]] = inner[at[1:] - 1] = False
    text[: int(at[-1])][inner] = data[np.repeat(starts - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]
    text[at[1:] - 1] = ord(">")
    loads = np.ndarray((int(at[-1]) + 1,), "<u8", text.data, 0, (1,))
    whole = K.hashes(text, at[:-1], at[1:], seed=3) % np.uint64(BUCKETS)
    many = sum(np.maximum(size + 2 - n + 1, 0) for n in GRAMS) + 1
    first = np.concatenate([[0], np.cumsum(many)]).astype(np.int64)
    out = np.empty(int(first[-1]), np.int64)
    out[first[:-1]] = whole.view(np.int64)
    used = np.ones(len(size), np.int64)
    for n in GRAMS:
        count = np.maximum(size + 2 - n + 1, 0)
        step = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
        gram = loads[np.repeat(at[:-1], count) + step] & np.uint64((1 << 8 * n) - 1)
        out[np.repeat(first[:-1] + used, count) + step] = (K.mix(gram + np.uint64(n << 56)) % np.uint64(BUCKETS)).view(np.int64)
        used += count
    return out, first


class Bags:
    """Distinct words of some texts with their subwords, and for each text its words; built slice by slice.

    ``parts`` are byte and offset arrays (``textkit.utf8``). Windows of ``window`` words begin at all words of a text but the
    last ones; a text shorter than a window is one. Without a window a text is averaged whole.
    """

    def __init__(self, parts: Iterable[tuple[np.ndarray, np.ndarray]], window: int | None = WINDOW, least: int = 0):
        known, gram, many = K.Memo(1 << 62), [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
        word, count, seen = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)], np.zeros(BUCKETS, np.int32)
        self.window, self.words = window, 0
        for data, offs in parts:
            data = K.LOWER[data]
            starts, ends, first = K.words(data, offs, SEP)
            u, at, back = np.unique(K.hashes(data, starts, ends), return_index=True, return_inverse=True)
            ids, old = known.find(u)
            fresh = np.flatnonzero(~old)
            g, f = subwords(data, starts[at[fresh]], ends[at[fresh]])
            ids[fresh] = self.words + np.arange(len(fresh))
            known.add(u[fresh], ids[fresh])
            self.words += len(fresh)
            gram.append(g.astype(np.int32))
            many.append(np.diff(f))
            word.append(ids[back].astype(np.int32))
            count.append(np.diff(first))
            if least:
                of, at = subwords(data, starts[at], ends[at])
                for t in np.split(back, first[1:-1]):
                    t = np.unique(t)
                    n = np.diff(at)[t]
                    seen[np.unique(of[np.repeat(at[t] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))])] += 1
        self.gram, many, self.word, self.count = map(np.concatenate, (gram, many, word, count))
        self.gram_first = np.concatenate([[0], np.cumsum(many)]).astype(np.int64)
        #: Buckets of at least ``least`` texts.
        self.common = np.flatnonzero(seen >= least)
        self.has = self.count > 0
        last = np.cumsum(self.count)
        self.first, self.size = (last - self.count)[self.has], self.count[self.has]
        if window:
            self.full = np.repeat(last.astype(np.int32), self.count) - np.arange(len(self.word), dtype=np.int32) >= window
            self.short = self.size < window

    def of_words(self, bucket_scores: np.ndarray) -> np.ndarray:
        """A word is the average of its subwords."""
        if not self.words:
            return np.zeros(0, np.float32)
        return np.add.reduceat(bucket_scores[self.gram], self.gram_first[:-1]) / np.diff(self.gram_first)

    def slide(self, word: np.ndarray) -> np.ndarray:
        """For scores of the distinct words the averages of the windows by their first words; -inf where none begins."""
        word = word.astype(np.float32)[self.word]
        out = word.copy()
        for k in range(1, min(self.window, len(word))):
            out[:-k] += word[k:]
        out /= self.window
        out[~self.full] = -np.inf
        out[self.first[self.short]] = np.add.reduceat(word, self.first)[self.short] / np.maximum(self.size[self.short], self.window // 4)
        return out

    def texts(self, word: np.ndarray) -> np.ndarray:
        """Maximum of each text's windows, whatever their number (or its average); 0 for a text without words."""
        out = np.zeros(len(self.has))
        if len(self.word) and self.window:
            out[self.has] = np.maximum.reduceat(self.slide(word), self.first)
        elif len(self.word):
            out[self.has] = np.add.reduceat(word[self.word], self.first) / self.size
        return out

    def tops(self, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Score of each text that has words, and first word and number of words of the window that decides it."""
        if not self.window:
            return np.add.reduceat(word[self.word], self.first) / self.size, self.first, self.size
        z = self.slide(word)
        text = np.maximum.reduceat(z, self.first)
        top = np.flatnonzero(z == np.repeat(text, self.size))
        return text, top[np.searchsorted(top, self.first)], np.minimum(self.size, self.window)


def train(parts: Iterable[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, window: int | None = WINDOW, steps: int = STEPS, rate: float = RATE, noise: float = NOISE, seed: int = 5) -> dict[str, np.ndarray]:
    """Buckets with a vector, their vectors (n, DIM), and softmax (DIM, 2), (2,), by Adam on all texts at once.

    With one label only, or without texts, the model knows the labels' share alone.
    """
    rng = np.random.default_rng(seed)
    share = (labels.sum() + 0.25) / (len(labels) + 1)
    out = {"used": np.zeros(0, np.int64), "vectors": np.zeros((0, DIM)), "soft": np.zeros((DIM, 2)), "bias": np.log([1 - share, share])}
    bags = Bags(parts, window, LEAST_TEXTS)
    y = labels[bags.has].astype(float)
    if not len(y) or y.min() == y.max():
        return out
    used = bags.common
    place = np.full(BUCKETS, -1, np.int32)
    place[used] = np.arange(len(used))
    many = np.diff(bags.gram_first)
    gram = place[bags.gram]
    kept, gram = np.add.reduceat(gram >= 0, bags.gram_first[:-1], dtype=np.int64), gram[gram >= 0]
    known, weight = np.flatnonzero(kept), 1.0 / many
    known_first = np.cumsum(kept[known]) - kept[known]
    y = noise + (1 - 2 * noise) * y
    p = {"vectors": rng.normal(0, 0.1, (len(used), DIM)), "soft": rng.normal(0, 1.0, (DIM, 2)), "bias": out["bias"] - [0, 3.0 if window else 0.0]}
    mean, var = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}
    for step in range(1, steps + 1):
        line = p["soft"][:, 1] - p["soft"][:, 0]
        word = np.zeros(len(many))
        if len(known):
            word[known] = np.add.reduceat((p["vectors"] @ line)[gram], known_first) * weight[known]
        text, top, long = bags.tops(word)
        err = (1 / (1 + np.exp(-np.clip(text + p["bias"][1] - p["bias"][0], -30, 30))) - y) / len(y)
        share_of_word = np.repeat(err / (np.maximum(long, window // 4) if window else long), long)
        step_in = np.arange(int(long.sum())) - np.repeat(np.cumsum(long) - long, long)
        word = np.bincount(bags.word[np.repeat(top, long) + step_in], weights=share_of_word, minlength=len(many)) * weight
        g = np.bincount(gram, weights=np.repeat(word, kept), minlength=len(used))
        own = p["vectors"].T @ g
        grads = {"vectors": g[:, None] * line + DECAY * p["vectors"], "soft": np.stack([-own, own], axis=1), "bias": np.array([-err.sum(), err.sum()])}
        now = rate * min(1.0, 2 * (1 - step / (steps + 1)))
        for k, v in grads.items():
            mean[k] = 0.9 * mean[k] + 0.1 * v
            var[k] = 0.99 * var[k] + 0.01 * v * v
            p[k] = p[k] - now * (mean[k] / (1 - 0.9**step)) / (np.sqrt(var[k] / (1 - 0.99**step)) + 1e-10)
    return p | {"used": used}


def parts_of(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for part in K.slices(pa.RecordBatch.from_arrays([texts], names=["text"])):
        yield K.utf8(part.column("text"))


def _trained(**settings):
    """A function for a task: the model of all its rows (text, label), as one row; rows are put in an order that no shuffle changes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = list(batches)
        held = (pa.Table.from_batches(rows) if rows else pa.table({"text": pa.array([], pa.string()), "label": pa.array([], pa.int32())})).sort_by([("label", "ascending"), ("text", "ascending")])
        texts = pa.concat_arrays(held.column("text").chunks) if held.num_rows else pa.array([], pa.string())
        model = train(parts_of(texts), held.column("label").to_numpy().astype(np.int64), **settings)
        yield pa.RecordBatch.from_arrays([pa.array([np.asarray(model[k], kind).tobytes()], pa.binary()) for k, kind in MODEL.items()], names=list(MODEL))

    return run


#: Settings of the plain form, in which the average of all of a text's subword vectors decides.
AVERAGED = {"window": None, "steps": 300, "rate": 0.1, "noise": 0.0}


#: What a model holds, and as which type it travels.
MODEL = {"used": "<i4", "vectors": "<f4", "soft": "<f8", "bias": "<f8"}


def training_rows(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(text, label) of at most TRAIN_TOXIC and TRAIN_CLEAN ids of the labels whose crc32 of the id modulo ``folds`` is not ``held``.

    One text of each id is learned from (of several the one with the smallest hash); texts of any length, but an id is
    passed over where its text doesn't fit what is left of TRAIN_BYTES. So ids, rows and bytes of the sample are bounded.
    """
    picked = sample(docs.select(id_col, text_col), labels, "toxic", folds, held, {1: TRAIN_TOXIC, 0: TRAIN_CLEAN}, id_col)
    size = F.greatest(F.octet_length(text_col), F.lit(ROW_BYTES))
    left, over = dict(TRAIN_BYTES), []
    for i, label, n in picked.select(id_col, "label", F.coalesce(size, F.lit(ROW_BYTES))).orderBy(F.xxhash64(id_col), id_col).collect():
        if n > left[label]:
            over.append(i)
        else:
            left[label] -= n
    rows = picked.where(~F.col(id_col).isin(over)) if over else picked
    return rows.select(F.coalesce(text_col, F.lit("")).alias("text"), "label")


def fit(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0, id_col: str = "doc_id", text_col: str = "text", **settings) -> dict[str, np.ndarray]:
    """The model from ``training_rows``: a task trains on them, and only the model comes to the driver (``BUCKETS`` vectors at most).

    ``settings`` go to ``train``: windows by default, ``AVERAGED`` for the average of the whole text.
    """
    row = training_rows(docs, labels, folds, held, id_col, text_col).repartition(1).mapInArrow(_trained(**settings), ", ".join(f"{k} binary" for k in MODEL)).first()
    if row is None:  # no rows, so Spark ran no task
        return train([], np.zeros(0, np.int64), **settings)
    model = {k: np.frombuffer(row[k], kind) for k, kind in MODEL.items()}
    return model | {k: model[k].reshape(-1, n) for k, n in (("vectors", DIM), ("soft", 2))}


def bucket_scores(model: dict[str, np.ndarray]) -> np.ndarray:
    """Of each bucket its vector's part of the logit; 0 where it has none."""
    out = np.zeros(BUCKETS, np.float32)
    out[model["used"]] = model["vectors"] @ (model["soft"][:, 1] - model["soft"][:, 0])
    return out


class Scorer:
    """The model in a task: scores of the texts of a batch."""

    def __init__(self, docs: DataFrame, model: dict[str, np.ndarray], window: int | None = WINDOW):
        self.window = window
        self.shared = docs.sparkSession.sparkContext.broadcast(bucket_scores(model))
        self.bias = float(model["bias"][1] - model["bias"][0])

    def __call__(self, column: pa.Array) -> np.ndarray:
        bags = Bags([K.utf8(column)], self.window)
        z = bags.texts(bags.of_words(self.shared.value))
        return 1 / (1 + np.exp(-np.clip(z + self.bias, -500, 500)))


def predict(docs: DataFrame, model: dict[str, np.ndarray], id_col: str = "doc_id", text_col: str = "text", averaged: dict[str, np.ndarray] | None = None) -> DataFrame:
    """(id, score) for every row: the softmax's probability of the toxic class, for the maximum of the text's windows.

    With a model ``averaged`` also average_score: that of the average of all of the text's subword vectors.

    A text without words (null, empty) gets the softmax of the bias alone; repeated rows a row each; null ids
    stay null; an empty table gives an empty result; other columns are not read.
    """
    scorers = {"score": Scorer(docs, model)} | ({"average_score": Scorer(docs, averaged, None)} if averaged else {})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in K.slices(batch, text_col):
                yield pa.RecordBatch.from_arrays([part.column(id_col), *[pa.array(s(part.column(text_col)), pa.float64()) for s in scorers.values()]], names=[id_col, *scorers])

    return docs.select(id_col, text_col).mapInArrow(run, f"{id_col} {docs.schema[id_col].dataType.simpleString()}, " + ", ".join(f"{n} double" for n in scorers))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with a score under ``threshold``, all columns as they are, in one pass without a shuffle.

    Rows are judged, not ids: repeated rows and rows with null ids are kept or dropped each by their text. Null and empty
    texts have the score of the bias alone. Very long texts are averaged window by window like others. An empty table
    stays empty; without usable labels every score is 0.25, so all rows stay at the default.
    """
    scorer = Scorer(docs, fit(docs, labels, id_col=id_col, text_col=text_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in K.slices(batch, text_col):
                yield part.filter(pa.array(scorer(part.column(text_col)) < threshold))

    return docs.mapInArrow(run, docs.schema)


def score_toxicity(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, score, predicted, average_score) for every row; see ``fit`` and ``predict``. average_score comes from a model that was trained on averages."""
    of = lambda **settings: fit(docs, labels, folds, held, id_col, text_col, **settings)
    scored = predict(docs, of(), id_col, text_col, of(**AVERAGED))
    return scored.select(id_col, (fold(id_col, folds) == held).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"), "average_score")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
