"""Best-fit packing of documents into token sequences by the sum-of-squares rule (operator 9).

Texts are tokenized in Arrow functions to pieces (lengths and checksums only), pieces are dealt
into shards of bounded size, and each shard is packed by itself: a piece goes where the sum of the
squared counts of open sequences per residual gap becomes smallest.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkit as K
from .tokens import encoder, per_text

#: Documents that share a packing shard, on average.
SHARD_DOCS = 20_000


def token_pieces(docs: DataFrame, capacity: int = 2048, path: str | None = None, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, piece, start, length, ids_crc32): each text's ids, then ``end_id``, cut only where over ``capacity``.

    The first piece of a cut text takes the remainder, the others are full. Null or empty text: one
    piece of one token. Repeated rows give their pieces each; a null id stays null; an empty table
    gives an empty result.
    """
    path = path or public_tokenizers.path("byte_bpe_50k.json")
    schema = f"{id_col} {docs.schema[id_col].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path, True)
        for batch in batches:
            for part in K.slices(batch, text_col):
                values, first = coder.units(*K.utf8(part.column(text_col)))
                tokens = per_text(coder.lengths(values), first)
                stop = np.cumsum(tokens + 1)
                ids = np.full(int(stop[-1]) if len(stop) else 0, end_id, "<u4")
                body = np.ones(len(ids), bool)
                body[stop - 1] = False
                ids[body] = coder.ids_of(values)
                total = tokens + 1
                pieces = -(-total // capacity)
                row = np.repeat(np.arange(len(total)), pieces)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                head = total - (pieces - 1) * capacity
                start = np.where(piece > 0, head[row] + (piece - 1) * capacity, 0)
                length = np.where(piece > 0, capacity, head[row])
                raw, at = memoryview(ids.tobytes()), (stop - total)[row] + start
                crc = [zlib.crc32(raw[4 * a : 4 * (a + n)]) for a, n in zip(at.tolist(), length.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(id_col).take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                    names=[id_col, "piece", "start", "length", "ids_crc32"],
                )

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin number and offset of each length, in the order given.

    The rule needs only the number of open bins for each residual gap; of the bins of the chosen
    gap the latest is filled. A new bin is a bin of gap ``capacity`` of which there are always enough.
    """
    count = np.zeros(capacity + 1, np.int64)
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins, offsets, made = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), 0
    never = np.int64(1 << 60)
    for i, size in enumerate(lengths.tolist()):
        if size >= capacity:
            bins[i], offsets[i], made = made, 0, made + 1
            continue
        # change of the sum for each gap g in size .. capacity - 1: one bin less with gap g, one more with gap g - size (a full bin has none)
        gaps = count[size:capacity]
        change = np.where(gaps > 0, 1 - 2 * gaps, never)
        change[1:] += 2 * count[1 : capacity - size] + 1
        g, fresh = (size + int(change.argmin()) if len(change) else 0), 2 * count[capacity - size] + 1
        if len(change) and change[g - size] < fresh:
            b = open_bins[g].pop()
            count[g] -= 1
        else:
            b, g, made = made, capacity, made + 1
        bins[i], offsets[i] = b, capacity - g
        if g > size:
            open_bins[g - size].append(b)
            count[g - size] += 1
    return bins, offsets


def pack(pieces: DataFrame, capacity: int = 2048, shards: int = 1, id_col: str = "doc_id") -> DataFrame:
    """Adds sequence_id and offset. Shards are packed apart, and equal rows are spread over them; longer pieces come first, ties by id, piece and checksum."""
    schema = f"{id_col} {pieces.schema[id_col].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    keys = [id_col, "piece", "start", "length", "ids_crc32"]

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        order = [("length", "descending"), (id_col, "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")]
        rows = rows.select(keys).take(pc.sort_indices(rows, sort_keys=order, null_placement="at_end"))
        bins, offsets = sum_of_squares(rows["length"].to_numpy(), capacity)
        return rows.append_column("sequence_id", pa.array((key[0].as_py() << 40) + bins)).append_column("offset", pa.array(offsets))

    # the running number of a row in its task deals equal rows out to all shards; a repeated task gives the same numbers
    shard = F.pmod(F.xxhash64(*keys, F.monotonically_increasing_id()), F.lit(max(1, shards))).alias("shard")
    return pieces.select(*keys, shard).groupBy("shard").applyInArrow(run, schema)


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def pack_documents(docs: DataFrame, capacity: int = 2048, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of all documents with their sequence and place in it."""
    shards = -(-docs.count() // SHARD_DOCS)
    return pack(token_pieces(docs, capacity, path, 0, id_col, text_col), capacity, shards, id_col)
