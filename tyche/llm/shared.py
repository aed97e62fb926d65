"""Reading the tables of a scale folder, and handing rows to Arrow functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..storage import fresh_path, kept, mapped

__all__ = ["fresh_path", "kept", "mapped", "table"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
