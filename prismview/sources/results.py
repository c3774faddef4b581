"""Small result tables as files."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_results(df: DataFrame, folder: str, name: str, corpus: str, scale: str, tag: str = "") -> str:
    """One CSV with a header for a table of a few rows a query; committed by Spark's committer, so it appears whole or not at all."""
    path = f"{folder}/{name}_{corpus}_{scale}{'_' + tag if tag else ''}"
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)
    return path
