"""Sinks.

Nothing here collects a result to the driver: previews are ``limit`` inside the
plan (a ``TakeOrderedAndProject`` when the input is sorted) written by one task,
full results are written by every task in parallel.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def csv_safe(df: DataFrame) -> DataFrame:
    """CSV cannot hold nested values: struct / array / map / vector columns are
    rendered as JSON text, everything else is kept."""
    cols = []
    for field in df.schema.fields:
        dt = field.dataType
        if isinstance(dt, (T.StructType, T.ArrayType, T.MapType)):
            cols.append(F.to_json(F.col(field.name)).alias(field.name))
        elif dt.typeName() == "vector":
            from pyspark.ml.functions import vector_to_array
            cols.append(F.to_json(vector_to_array(F.col(field.name))).alias(field.name))
        else:
            cols.append(F.col(field.name))
    return df.select(*cols)


def save_preview(df: DataFrame, path: str, n: int = 20) -> None:
    """First ``n`` rows of an (ordered) result as one header CSV file."""
    csv_safe(df.limit(n)).coalesce(1).write.mode("overwrite").option("header", "true").csv(path)


def save_full(df: DataFrame, path: str, fmt: str = "parquet", partition_by: list[str] | None = None) -> None:
    """The whole result, written in parallel (``overwrite``)."""
    out = csv_safe(df) if fmt == "csv" else df
    writer = out.write.mode("overwrite").format(fmt)
    if fmt == "csv":
        writer = writer.option("header", "true")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)
