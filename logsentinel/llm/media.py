"""Media columns (operator 10): texts as progressive JPEG files, and files as RGB tensors with features."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import jpeg
from . import textkit as K

PAD = 192


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, media): each text's UTF-8 bytes, filled up with blanks to a positive multiple of 192, as a
    progressive JPEG file that keeps them without loss.

    Null or empty text: a payload of 192 blanks. Repeated rows give equal files; null ids stay null; an
    empty table gives an empty result; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in K.slices(batch, text_col):
                data, offs = K.utf8(part.column(text_col))
                media = []
                for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True):
                    n = max(PAD, -(-(b - a) // PAD) * PAD)
                    media.append(jpeg.encode_payload(data[a:b].tobytes().ljust(n)))
                yield pa.RecordBatch.from_arrays([part.column(id_col), pa.array(np.diff(offs), pa.int64()), pa.array(media, pa.binary())], names=[id_col, "n_bytes", "media"])

    return docs.select(id_col, text_col).mapInArrow(run, f"{id_col} {docs.schema[id_col].dataType.simpleString()}, n_bytes long, media binary")


def feature(rgb: np.ndarray) -> str:
    """Size, and mean and spread of each channel."""
    flat = rgb.reshape(-1, 3)
    mean, spread = flat.mean(axis=0, dtype=np.float64), flat.std(axis=0, dtype=np.float64)
    return f"{rgb.shape[1]}x{rgb.shape[0]} " + " ".join(f"{m:.2f}/{s:.2f}" for m, s in zip(mean, spread, strict=True))


def read_media(stored: DataFrame, tensors: bool = True, payloads: bool = True, keep: tuple[str, ...] = ("doc_id", "n_bytes")) -> DataFrame:
    """Reads the files of a binary column ``media`` back: sizes and digests of file and payload, feature, width and
    height, and on demand the payload and the tensor (rgb: height x width x 3 bytes).

    A null file, one that is no progressive JPEG, is cut short, is broken, or claims more than ``jpeg.MOST_PIXELS`` or more blocks
    than its bytes could hold gives nulls in all of these columns; a file without a stored payload gives nulls in the
    payload's. Repeated rows give equal rows; an empty table gives an empty result; very long texts are one large image each.
    """
    kinds = {f.name: f.dataType.simpleString() for f in stored.schema.fields}
    extra = [("payload", "binary")] * payloads + [("width", "int"), ("height", "int")] + [("rgb", "binary")] * tensors
    fields = [("payload_bytes", "long"), ("payload_sha256", "string"), ("tail_crc32", "long"), ("media_bytes", "long"), ("media_sha256", "string"), ("feature", "string"), *extra]
    arrow = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "int": pa.int32()}

    def one(media: bytes | None) -> dict:
        if media is None:
            return {}
        try:
            image = jpeg.read_coefficients(media)
            payload = jpeg.read_payload(image) if image["comment"].startswith(b"payload ") else None
            rgb = jpeg.to_rgb(image)
        except (ValueError, KeyError, IndexError, ArithmeticError, struct.error):  # whatever a broken file may lead to
            return {}
        row = {"media_bytes": len(media), "media_sha256": hashlib.sha256(media).hexdigest(), "feature": feature(rgb), "width": image["width"], "height": image["height"]}
        if tensors:
            row |= {"rgb": rgb.tobytes()}
        if payload is not None:
            row |= {"payload_bytes": len(payload), "payload_sha256": hashlib.sha256(payload).hexdigest(), "tail_crc32": zlib.crc32(payload[-16:])}
            row |= {"payload": payload} if payloads else {}
        return row

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            media, step = batch.column("media"), 256
            for at in range(0, batch.num_rows, step):
                rows = [one(m.as_py()) for m in media.slice(at, step)]
                part = batch.slice(at, step)
                yield pa.RecordBatch.from_arrays([part.column(k) for k in keep] + [pa.array([r.get(n) for r in rows], arrow[k]) for n, k in fields], names=[*keep, *(n for n, _ in fields)])

    schema = ", ".join(f"{k} {kinds[k]}" for k in keep) + ", " + ", ".join(f"{n} {k}" for n, k in fields)
    return stored.select(*keep, "media").mapInArrow(run, schema)


def store_media(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes (id, n_bytes, media) as a table, reads its files back and writes their tensors beside it: (id, n_bytes, sizes and digests,
    feature, width, height, rgb). Returns the table of tensors."""
    store_texts(docs, id_col, text_col).write.mode("errorifexists").parquet(f"{path}/media")
    read = read_media(docs.sparkSession.read.parquet(f"{path}/media"), tensors=True, payloads=False, keep=(id_col, "n_bytes"))
    read.write.mode("errorifexists").parquet(f"{path}/tensors")
    return docs.sparkSession.read.parquet(f"{path}/tensors")


def op10_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_media(store_texts(spark.read.parquet(f"{sf_dir}/documents.parquet")), tensors=False, payloads=False)
