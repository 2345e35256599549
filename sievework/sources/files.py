"""Readers and writers by file extension. Columnar formats keep pushdown and pruning; text formats take a schema."""

from __future__ import annotations

import json
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from ..errors import DependencyError

BUILTIN = {".parquet": "parquet", ".orc": "orc", ".csv": "csv", ".tsv": "csv", ".txt": "text", ".json": "json", ".jsonl": "json"}
UNSUPPORTED = (".xlsx", ".xls", ".xlsm", ".pickle", ".pkl")


def read(spark: SparkSession, path: str, schema: StructType | str | None = None, **options: str) -> DataFrame:
    """Read by extension. Give a schema for csv and json at scale: without one they are read twice to infer it."""
    end = PurePosixPath(path.rstrip("/")).suffix.lower()
    if end == ".feather":
        return read_feather(spark, path)
    if end in UNSUPPORTED:
        raise DependencyError(f"{end} files need a reader that is not part of the engine")
    if end not in BUILTIN:
        raise ValueError(f"unknown extension {end!r}; there are {sorted([*BUILTIN, '.feather'])}")
    reader = spark.read.options(**options)
    if schema is not None:
        reader = reader.schema(schema)
    if BUILTIN[end] == "csv":
        reader = reader.option("header", options.get("header", "true")).option("sep", options.get("sep", "\t" if end == ".tsv" else ","))
        if schema is None:
            reader = reader.option("inferSchema", "true")
    if end == ".json":
        reader = reader.option("multiLine", options.get("multiLine", "false" if _by_lines(spark, path) else "true"))
    return reader.format(BUILTIN[end]).load(path)


def _by_lines(spark: SparkSession, path: str) -> bool:
    """Whether a .json file's first line is an object by itself, as write() has it: else it is one document over several lines."""
    first = spark.read.text(path).filter(F.trim("value") != "").first()
    try:
        return first is not None and isinstance(json.loads(first[0]), dict)
    except ValueError:
        return False


def read_feather(spark: SparkSession, path: str) -> DataFrame:
    """An Arrow file through the driver: for files that fit it."""
    import pyarrow.feather as feather

    return spark.createDataFrame(feather.read_table(path))


def read_table(spark: SparkSession, name: str) -> DataFrame:
    return spark.read.table(name)


def write(df: DataFrame, path: str, mode: str = "errorifexists", partition_by: list[str] | None = None, **options: str) -> None:
    end = PurePosixPath(path.rstrip("/")).suffix.lower()
    if end not in BUILTIN:
        raise ValueError(f"unknown extension {end!r}; there are {sorted(BUILTIN)}")
    writer = df.write.mode(mode).options(**options)
    if BUILTIN[end] == "csv":
        writer = writer.option("header", options.get("header", "true")).option("sep", options.get("sep", "\t" if end == ".tsv" else ","))
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.format(BUILTIN[end]).save(path)
