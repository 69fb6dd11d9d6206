"""Quality classifier (operator 4): a sparse rule ensemble.

Statistics of whole texts are computed in Arrow functions. On a bounded sample of labelled rows small
boosted trees are grown over the statistics; every path from a root becomes a conjunctive rule, and a
logistic regression with an L1 penalty keeps few of them. The kept rules are compiled into one Spark column.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textkit as K
from .labelled import fold, sample

#: Bounds of the sample that the model is fitted on: ids of each label.
TRAIN_GOOD, TRAIN_BAD = 8000, 8000
TREES, DEPTH, BINS, LEAF, SHRINK = 30, 3, 32, 10, 0.3
PENALTY, LASSO_STEPS = 2e-3, 400

_CLASSES = {
    "upper": np.arange(65, 91),
    "lower": np.arange(97, 123),
    "digit": np.arange(48, 58),
    "blank": np.array([9, 10, 11, 12, 13, 32]),
    "shout": np.array([33, 63]),
    "bar": np.array([124]),
    "stop": np.array([44, 46, 58, 59]),
    "symbol": np.array([ord(c) for c in "#$%&*+-/<=>@\\^_`~(){}[]\"'"]),
    "other": np.arange(128, 256),
}
STATS = [*(f"{c}_share" for c in _CLASSES), "log_words", "word_bytes", "distinct_words", "repeated_lines", "repeated_runs", "repeated_neighbours", "words_a_line", "capital_words", "marked_words", "open_words", "longest_word"]


def stat(name: str) -> str:
    """A statistic's column; the prefix keeps it apart from columns of the table."""
    return f"__stat_{name}"


def _per_text(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values)])
    return (total[first[1:]] - total[first[:-1]]).astype(float)


def _repeats(hashed: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Share of a text's items that have occurred in it before."""
    count = np.diff(first)
    text = np.repeat(np.arange(len(count)), count)
    h = K.sort_within(hashed, first)
    again = (h[1:] == h[:-1]) & (text[1:] == text[:-1])
    return np.bincount(text[1:][again], minlength=len(count)) / np.maximum(count, 1)


def statistics(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """(texts, len(STATS)); all 0 for empty texts."""
    size = np.maximum(np.diff(offs), 1)
    out = []
    for members in _CLASSES.values():
        table = np.zeros(256, np.uint8)
        table[members] = 1
        out.append(_per_text(table[data], offs) / size)
    starts, ends, first = K.words(data, offs)
    words = np.maximum(np.diff(first), 1)
    h = K.hashes(K.LOWER[data], starts, ends)
    line = np.ones(256, bool)
    line[:] = False
    line[10] = True
    ls, le, lf = K.words(data, offs, line)
    runs, rf = K.shingles(h, first, 5)
    same = np.zeros(len(h), np.int64)
    same[1:] = h[1:] == h[:-1]
    same[first[:-1][np.diff(first) > 0]] = 0
    edge = np.zeros(256, np.uint8)
    for c in ("symbol", "shout", "bar"):
        edge[_CLASSES[c]] = 1
    upper = np.zeros(256, np.uint8)
    upper[65:91] = 1
    last = data[ends - 1] if len(ends) else np.zeros(0, np.uint8)
    second = data[np.minimum(starts + 1, np.maximum(ends - 1, 0))] if len(starts) else np.zeros(0, np.uint8)
    length = ends - starts
    longest = np.zeros(len(size))
    if len(length):
        has = np.diff(first) > 0
        longest[has] = np.maximum.reduceat(length, first[:-1][has])
    out += [
        np.log1p(np.diff(first)),
        _per_text(length, first) / words,
        1 - _repeats(h, first),
        _repeats(K.hashes(data, ls, le), lf),
        _repeats(runs, rf),
        _per_text(same, first) / words,
        np.diff(first) / np.maximum(np.diff(lf), 1),
        _per_text(upper[second], first) / words,
        _per_text(edge[last], first) / words,
        _per_text((length <= 2).astype(np.int64), first) / words,
        np.minimum(longest, 1000),
    ]
    table = np.stack(out, axis=1)
    table[np.diff(offs) == 0] = 0
    return np.round(table, 9)


def with_statistics(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """The columns ``keep`` and the statistics of each row's whole text, named as ``stat`` names them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in K.slices(batch, text_col):
                table = statistics(*K.utf8(part.column(text_col)))
                yield pa.RecordBatch.from_arrays([part.column(k) for k in keep] + [pa.array(table[:, i]) for i in range(len(STATS))], names=[*keep, *map(stat, STATS)])

    schema = T.StructType([docs.schema[k] for k in keep] + [T.StructField(stat(s), T.DoubleType()) for s in STATS])
    return docs.select(*dict.fromkeys([*keep, text_col])).mapInArrow(run, schema)


Rule = tuple[tuple[int, str, float], ...]


def _grow(codes: np.ndarray, cuts: list[np.ndarray], grad: np.ndarray, hess: np.ndarray) -> tuple[list[Rule], np.ndarray]:
    """One tree on gradients: the paths to all its nodes, and each row's step."""
    rules: list[Rule] = []
    step = np.zeros(len(grad))

    def split(rows: np.ndarray, path: Rule, depth: int) -> None:
        if path:
            rules.append(path)
        best = (1e-6, None)
        g, h = grad[rows].sum(), hess[rows].sum()
        if depth and len(rows) >= 2 * LEAF:
            for f, c in enumerate(cuts):
                if not len(c):
                    continue
                code = codes[rows, f]
                n = np.cumsum(np.bincount(code, minlength=len(c) + 1))[:-1]
                gl = np.cumsum(np.bincount(code, weights=grad[rows], minlength=len(c) + 1))[:-1]
                hl = np.cumsum(np.bincount(code, weights=hess[rows], minlength=len(c) + 1))[:-1]
                gain = gl**2 / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g**2 / (h + 1)
                gain[(n < LEAF) | (len(rows) - n < LEAF)] = 0
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (gain[k], (f, k))
        if best[1] is None:
            step[rows] = -g / (h + 1)
            return
        f, k = best[1]
        left = codes[rows, f] <= k
        split(rows[left], (*path, (f, "<=", float(cuts[f][k]))), depth - 1)
        split(rows[~left], (*path, (f, ">", float(cuts[f][k]))), depth - 1)

    split(np.arange(len(grad)), (), DEPTH)
    return rules, step


def _simplify(rule: Rule) -> Rule:
    """One bound for each statistic and side, in a fixed order."""
    bound: dict[tuple[int, str], float] = {}
    for f, op, v in rule:
        bound[f, op] = (min if op == "<=" else max)(bound.get((f, op), v), v)
    return tuple(sorted((f, op, v) for (f, op), v in bound.items()))


def _holds(x: np.ndarray, rule: Rule) -> np.ndarray:
    ok = np.ones(len(x), bool)
    for f, op, v in rule:
        ok &= x[:, f] <= v if op == "<=" else x[:, f] > v
    return ok


def train(x: np.ndarray, y: np.ndarray) -> dict:
    """{"bias": b, "rules": [(weight, rule)]}. With one label only, or no rows, only the bias."""
    share = (y.sum() + 0.5) / (len(y) + 1)
    bias = float(np.log(share / (1 - share)))
    if not len(y) or y.min() == y.max():
        return {"bias": bias, "rules": []}
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
    cuts = [c[c < x[:, f].max()] for f, c in enumerate(cuts)]
    codes = np.stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)], axis=1)
    margin, rules = np.full(len(y), bias), {}
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        paths, step = _grow(codes, cuts, p - y, np.maximum(p * (1 - p), 1e-6))
        margin += SHRINK * step
        rules |= dict.fromkeys(map(_simplify, paths))
    kept = [r for r in rules if 0 < _holds(x, r).sum() < len(y)]
    a = np.stack([_holds(x, r) for r in kept], axis=1).astype(np.float32) if kept else np.zeros((len(y), 0), np.float32)
    centre, spread = a.mean(axis=0), np.maximum(a.std(axis=0), 1e-3)
    a = (a - centre) / spread
    w, z, t, b = np.zeros(a.shape[1]), np.zeros(a.shape[1]), 1.0, bias
    lipschitz = 0.25 * max(float(np.linalg.eigvalsh(a.T @ a / len(y))[-1]) if a.shape[1] else 1.0, 1.0)
    for _ in range(LASSO_STEPS):  # accelerated proximal gradient
        err = 1 / (1 + np.exp(-(a @ z + b))) - y
        new = z - (a.T @ err) / len(y) / lipschitz
        new = np.sign(new) * np.maximum(np.abs(new) - PENALTY / lipschitz, 0)
        b -= err.mean()
        t, before = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        z, w = new + (before - 1) / t * (new - w), new
    weights = w / spread
    return {"bias": float(b - weights @ centre), "rules": [(float(v), r) for v, r in zip(weights, kept, strict=True) if abs(v) > 1e-9]}


def compile_rules(model: dict) -> Column:
    """The ensemble as one column over the statistics: a logistic function of the weights of the rules that hold."""
    total = F.lit(model["bias"])
    for weight, rule in model["rules"]:
        hold = None
        for f, op, v in rule:
            c = F.col(stat(STATS[f])) <= v if op == "<=" else F.col(stat(STATS[f])) > v
            hold = c if hold is None else hold & c
        total = total + F.when(hold, weight).otherwise(0.0)
    return 1 / (1 + F.exp(-total))


def fit(docs: DataFrame, labels: DataFrame, folds: int = 3, held: int = 1, id_col: str = "doc_id", text_col: str = "text") -> dict:
    """Rules from at most TRAIN_GOOD and TRAIN_BAD ids of the labels whose crc32 of the id modulo ``folds`` is not ``held``."""
    picked = sample(docs.select(id_col, text_col), labels, "quality", folds, held, {1: TRAIN_GOOD, 0: TRAIN_BAD}, id_col)
    rows = with_statistics(picked, (id_col, "label"), text_col).orderBy(id_col, *map(stat, STATS)).toArrow()
    x = np.stack([rows.column(stat(s)).to_numpy() for s in STATS], axis=1) if rows.num_rows else np.zeros((0, len(STATS)))
    return train(x, np.asarray(rows.column("label").to_numpy(), float))


def score_quality(docs: DataFrame, labels: DataFrame, folds: int = 3, held: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, score, predicted) for every row.

    Null and empty texts have statistics of 0 and are scored like the others; repeated rows get a row each;
    null ids stay null; without usable labels every score is 0.5; an empty table gives an empty result;
    other columns are not read.
    """
    model = fit(docs, labels, folds, held, id_col, text_col)
    scored = with_statistics(docs, (id_col,), text_col).select(id_col, (fold(id_col, folds) == held).alias("held_out"), compile_rules(model).alias("score"))
    return scored.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))


def drop_low_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with a score of at least ``threshold``, all columns as they are, in one pass without a shuffle."""
    model = fit(docs, labels, id_col=id_col, text_col=text_col)
    return with_statistics(docs, tuple(docs.columns), text_col).where(compile_rules(model) >= threshold).select(*docs.columns)


def describe(model: dict) -> str:
    """The rules in words, strongest first."""
    return json.dumps([[round(w, 4), " and ".join(f"{STATS[f]} {op} {v:.6g}" for f, op, v in r)] for w, r in sorted(model["rules"], key=lambda x: -abs(x[0]))], indent=1)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
