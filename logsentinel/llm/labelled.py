"""Bounded samples of labelled rows, on which classifiers are fitted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(id_col: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; 0 for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(0)) % folds


def sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, held: int, most: dict[int, int], id_col: str = "doc_id") -> DataFrame:
    """One row of ``docs`` with a column ``label`` for each of at most ``most[label]`` ids of each label that may be learned from.

    Which ids is decided by a hash, from the labels alone; only these ids (a bounded number) are
    broadcast. Several label rows of an id count as the highest; null labels and ids are ignored. Of several
    rows of an id the one with the smallest hash stays, so the rows are bounded like the ids.
    """
    usable = labels.where(F.col(id_col).isNotNull() & F.col(label).isNotNull()).where(fold(id_col, folds) != held)
    of_id = usable.groupBy(id_col).agg(F.max(F.col(label).cast("int")).alias("label")).where("label IN (0, 1)")
    order = [F.xxhash64(id_col), F.col(id_col)]
    picked = of_id.where("label = 1").orderBy(*order).limit(most[1]).unionByName(of_id.where("label = 0").orderBy(*order).limit(most[0]))
    rest = [c for c in docs.columns if c != id_col]
    one = docs.join(F.broadcast(picked), id_col).groupBy(id_col, "label").agg(F.min(F.struct(F.xxhash64(*rest).alias("h"), F.struct(*rest).alias("row"))).alias("one"))
    return one.select(id_col, *[F.col(f"one.row.{c}").alias(c) for c in rest], "label")
