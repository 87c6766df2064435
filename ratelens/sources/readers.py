"""Scans.

``read_table`` is the one entry point: a named collection under a root folder,
read with an explicit schema when one is known.  Filters and projections are
left to Catalyst, which pushes them into the parquet / ORC scan (``PushedFilters``,
``ReadSchema``); JSON and CSV scans parse only the projected fields.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ratelens.schemas import SCHEMAS

#: Reading modes: files of a schema that this package writes must fit it; collections from
#: elsewhere may drift, and ``read_checked`` tells what did not fit.
MODES = {"predictions": "FAILFAST"}
CORRUPT = "_corrupt_record"

_EXT = {"parquet": ".parquet", "json": ".json", "csv": ".csv", "orc": ".orc"}


def table_path(root: str, name: str, fmt: str = "parquet") -> str:
    root = root.rstrip("/")
    return f"{root}/{name}{_EXT.get(fmt, '')}"


def read_table(spark: SparkSession, root: str, name: str, fmt: str = "parquet",
               schema: T.StructType | None = None, mode: str | None = None,
               **options) -> DataFrame:
    """Batch scan of collection ``name`` stored under ``root``.

    ``fmt`` is any ``spark.read.format``; document-store connectors are used the
    same way by passing their format name and options (``path`` then unused).
    """
    reader = spark.read.format(fmt)
    if schema is None and fmt in ("json", "csv"):
        schema = SCHEMAS.get(name)
    if schema is not None and fmt != "parquet":
        reader = reader.schema(schema)
    if fmt in ("json", "csv"):
        reader = reader.option("mode", mode or MODES.get(name, "PERMISSIVE"))
    if fmt == "csv":
        reader = reader.option("header", "true")
    for key, value in options.items():
        reader = reader.option(key, value)
    if _EXT.get(fmt) is None:
        return reader.load()
    return reader.load(table_path(root, name, fmt))


@dataclass(frozen=True)
class Checked:
    """A scan with its rejected records: ``good`` rows by the schema; ``bad``, a written table
    ``file, record, parsed`` (where it was, the whole text, what could be read of it)."""

    good: DataFrame
    bad: DataFrame
    n_bad: int


def read_checked(spark: SparkSession, root: str, name: str, quarantine: str, fmt: str = "json",
                 schema: T.StructType | None = None, max_bad: int | None = None, **options) -> Checked:
    """Scan of a JSON or CSV collection that may drift: records that do not fit the schema go whole
    to the folder ``quarantine`` (Parquet) instead of becoming rows of nulls in silence.

    The rejected are written in one pass over the files and counted from that table; more than
    ``max_bad`` raise.  Good rows are a second scan without the corrupt column, so
    their filters and columns are still pushed into it."""
    schema = schema if schema is not None else SCHEMAS[name]
    corrupt = CORRUPT
    while corrupt in schema.fieldNames():
        corrupt += "_"
    wide = T.StructType([*schema.fields, T.StructField(corrupt, T.StringType(), True)])
    read = {**options, "columnNameOfCorruptRecord": corrupt}
    every = read_table(spark, root, name, fmt, wide, "PERMISSIVE", **read)
    parsed = F.to_json(F.struct(*schema.fieldNames()))
    bad = every.filter(F.col(corrupt).isNotNull()).select(
        F.col("_metadata.file_path").alias("file"), F.col(corrupt).alias("record"), parsed.alias("parsed"))
    bad.write.mode("overwrite").parquet(quarantine)
    kept = spark.read.parquet(quarantine)
    n_bad = kept.count()
    if max_bad is not None and n_bad > max_bad:
        raise ValueError(f"{n_bad} records of {name!r} do not fit the schema (at most {max_bad} allowed); see {quarantine}")
    good = read_table(spark, root, name, fmt, schema, "DROPMALFORMED", **read)
    return Checked(good, kept, n_bad)


def drift_report(spark: SparkSession, root: str, name: str, schema: T.StructType | None = None) -> DataFrame:
    """``field, kind, n`` of a JSON-lines collection: top-level fields that the schema does not know
    (``unknown``), and fields of the schema that records lack (``missing``), with their
    records; lines that are no JSON object are left to ``read_checked``."""
    schema = schema if schema is not None else SCHEMAS[name]
    lines = spark.read.text(table_path(root, name, "json"))
    known = F.array(*(F.lit(c) for c in schema.fieldNames()))
    keys = lines.select(F.json_object_keys("value").alias("k")).filter(F.col("k").isNotNull())
    each = keys.select(F.explode(F.concat(
        F.transform(F.array_except("k", known), lambda k: F.struct(k.alias("field"), F.lit("unknown").alias("kind"))),
        F.transform(F.array_except(known, F.col("k")), lambda k: F.struct(k.alias("field"), F.lit("missing").alias("kind"))))).alias("x"))
    return each.groupBy("x.field", "x.kind").agg(F.count(F.lit(1)).alias("n"))


def read_collection(spark: SparkSession, name: str, fmt: str, name_option: str = "collection", **options) -> DataFrame:
    """Connector form: ``spark.read.format(fmt).options(...)`` for a named
    collection; the connector gets the name as its option ``name_option``
    (``collection`` for document stores, ``dbtable`` for tables)."""
    schema = SCHEMAS.get(name)
    reader = spark.read.format(fmt)
    if schema is not None:
        reader = reader.schema(schema)
    return reader.options(**{name_option: name, **options}).load()


def read_result_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None,
                    columns: list[str] | None = None, escape: str = "\\") -> DataFrame:
    """Read a header CSV written by a sink; ``columns`` prunes like ``usecols``.

    ``schema`` describes the whole file; without one, columns are taken by
    header name as strings (no inference pass).  Large files are split across
    tasks by ``spark.sql.files.maxPartitionBytes`` instead of being chunked on
    one machine, and unused columns are not parsed (CSV column pruning).
    """
    reader = spark.read.option("header", "true").option("mode", "FAILFAST").option("escape", escape)
    if schema is not None:
        reader = reader.schema(schema)
    df = reader.csv(path)
    return df.select(*columns) if columns else df
