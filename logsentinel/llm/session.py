"""Settings that the operators take from the session."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from logsentinel.sources.kept import checkpoint, stored  # noqa: F401  operators import them from here


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def total_bytes(df: DataFrame, col: str = "text") -> int:
    """Bytes of all values of a string column (one scan, one number)."""
    return int(df.selectExpr(f"coalesce(sum(octet_length({col})), 0) AS n").first()["n"])
