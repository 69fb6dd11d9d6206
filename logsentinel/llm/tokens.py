"""Token counts and token ids by public tokenizers (operators 3 and 9 use these kernels).

Whole texts are cut into units at boundaries where the tokenizer itself always cuts, equal units
of a batch are encoded once by ``encode_batch`` and remembered in the task, and only lengths (or
ids) are put together again. The result equals encoding the whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textkit as K


@lru_cache(maxsize=4)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


class Encoder:
    """Encodes the units of batches; ids are kept in one pool when ``ids`` is set."""

    def __init__(self, path: str, ids: bool = False, limit: int = 2_000_000):
        self.tokenizer, self.ids, self.memo = _tokenizer(path), ids, K.Memo(limit)
        self.pool = np.zeros(1 << 16, np.uint32)
        #: Places in the pool of the units that are kept (n + 1, in the order of their numbers), and how many are.
        self.bounds = np.zeros(1 << 12, np.int64)
        self.used = self.kept = 0

    def _encode(self, texts: list[str]) -> list:
        return self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)

    def units(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A value for each unit (its length, or its number where ids are kept) and each text's first unit."""
        starts, ends, first = K.units(data, offs)
        h = K.hashes(data, starts, ends)
        uniq, at, inverse = np.unique(h, return_index=True, return_inverse=True)
        values, known = self.memo.find(uniq)
        if not known.all():
            missing = np.flatnonzero(~known)
            if self.memo.full(len(missing)):
                self.memo.clear()
                self.used, self.kept, missing = 0, 0, np.arange(len(uniq))
            new = np.zeros(len(missing), np.int64)
            raw = data.tobytes()
            for lo in range(0, len(missing), 8192):
                some = at[missing[lo : lo + 8192]]
                got = self._encode([raw[s:e].decode("utf-8", "replace") for s, e in zip(starts[some].tolist(), ends[some].tolist(), strict=True)])
                if self.ids:
                    new[lo : lo + len(some)] = self._keep([g.ids for g in got])
                else:
                    new[lo : lo + len(some)] = [len(g) for g in got]
            self.memo.add(uniq[missing], new)
            values[missing] = new
        return values[inverse], first

    def _keep(self, ids: list[list[int]]) -> np.ndarray:
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        total = int(sizes.sum())
        if self.used + total > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(max(total, len(self.pool)), np.uint32)])
        self.pool[self.used : self.used + total] = np.fromiter((i for x in ids for i in x), np.uint32, total)
        numbers = self.kept + np.arange(len(sizes))
        if self.kept + len(sizes) >= len(self.bounds):
            self.bounds = np.concatenate([self.bounds, np.zeros(max(len(sizes), len(self.bounds)), np.int64)])
        self.bounds[numbers + 1] = self.used + np.cumsum(sizes)
        self.used, self.kept = self.used + total, self.kept + len(sizes)
        return numbers

    def lengths(self, values: np.ndarray) -> np.ndarray:
        """The numbers of tokens of units."""
        return self.bounds[values + 1] - self.bounds[values] if self.ids else values

    def ids_of(self, values: np.ndarray) -> np.ndarray:
        """The ids of units, one after the other."""
        size, begin = self.lengths(values), self.bounds[values]
        stop = np.cumsum(size)
        total = int(stop[-1]) if len(stop) else 0
        return self.pool[np.repeat(begin - (stop - size), size) + np.arange(total)]


@lru_cache(maxsize=4)
def encoder(path: str, ids: bool = False) -> Encoder:
    """One for each Python worker, so that a later task finds what an earlier one has encoded."""
    return Encoder(path, ids)


def per_text(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of the values of each text."""
    total = np.concatenate([[0], np.cumsum(values)])
    return total[first[1:]] - total[first[:-1]]


def count_tokens(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Adds nothing but lengths: (id, n_bytes, n_tokens) for every row.

    Batches are balanced by bytes (about 4 MB at once) and long texts are split at safe boundaries.
    A null or empty text has 0 bytes and 0 tokens; repeated rows are counted each; a null id stays
    null; an empty table gives an empty result; other columns are not read.
    """
    path = path or public_tokenizers.path("word_bpe_49k.json")
    kind = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField(id_col, kind), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path)
        for batch in batches:
            for part in K.slices(batch, text_col):
                data, offs = K.utf8(part.column(text_col))
                values, first = coder.units(data, offs)
                yield pa.RecordBatch.from_arrays([part.column(id_col), pa.array(np.diff(offs), pa.int64()), pa.array(per_text(values, first), pa.int64())], names=[id_col, "n_bytes", "n_tokens"])

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def op3_token_counts(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return count_tokens(docs).withColumn("over_limit", F.col("n_tokens") > 2048)
