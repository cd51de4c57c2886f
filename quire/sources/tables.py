"""Table access for the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quire.session import prepare


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A base table as it is stored; how many splits it is read in is a session setting."""
    return prepare(spark).read.parquet(f"{root.rstrip('/')}/{name}.parquet")
