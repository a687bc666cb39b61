"""Parquet and CSV tables, and the check that a table has the columns a spec names."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weekwatch.specs import TableSpec

SUCCESS = "_SUCCESS"


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, on whatever file system the path names."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    return hadoop.getFileSystem(conf).exists(hadoop)


def is_file(spark: SparkSession, path: str) -> bool:
    """Whether a single file is there, and not a folder."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(hadoop) and fs.getFileStatus(hadoop).isFile()


def table_complete(spark: SparkSession, path: str) -> bool:
    """Whether a table is there whole: a single file, or a folder whose write was committed."""
    return is_file(spark, path) or path_exists(spark, f"{path}/{SUCCESS}")


def scan(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """The table at ``path``, lazily; with a schema no file is opened to plan."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path)


def scan_present(
    spark: SparkSession, folder: str, specs: Sequence[TableSpec]
) -> list[tuple[TableSpec, DataFrame | None]]:
    """Each spec with its table, or with None where there is no such table.

    A folder whose write was never committed is not a table, and is an error: read as
    one, it would pass for the whole.
    """
    paths = [(spec, f"{folder}/{spec.file_name}") for spec in specs]
    for spec, path in paths:
        if path_exists(spark, path) and not table_complete(spark, path):
            raise ValueError(f"the write of table {spec.name!r} at {path} was never finished")
    return [
        (spec, conform(scan(spark, path), spec) if path_exists(spark, path) else None)
        for spec, path in paths
    ]


def conform(df: DataFrame, spec: TableSpec) -> DataFrame:
    """Fail on missing columns, make the date a date, whole counts bigint, NaN null."""
    needed = dict.fromkeys(
        (
            *spec.group_keys,
            *spec.key_cols,
            *spec.measure_cols,
            spec.cases_col,
            spec.year_col,
            spec.week_col,
            spec.date_col,
            *spec.natural_key,
            *spec.metrics,
            *spec.passthrough,
            *spec.detect_metrics,
            *spec.silence_keys,
        )
    )
    missing = [c for c in needed if c not in df.columns]
    if missing:
        raise ValueError(f"table {spec.name!r} lacks the columns {', '.join(missing)}")
    changed = {}
    for field in df.schema.fields:
        column = F.col(field.name)
        if field.name == spec.date_col:
            if not isinstance(field.dataType, T.DateType):
                changed[field.name] = column.cast("date")
        elif isinstance(field.dataType, (T.FloatType, T.DoubleType)):
            changed[field.name] = F.when(~F.isnan(column), column).cast("double")
        elif isinstance(field.dataType, (T.ByteType, T.ShortType, T.IntegerType)) and (
            field.name in spec.measure_cols or field.name in spec.metrics
        ):
            changed[field.name] = column.cast("bigint")
    return df.withColumns(changed) if changed else df


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)
