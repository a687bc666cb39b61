"""Compare a Spark result with a SQL result, whatever the order of rows and columns."""

from __future__ import annotations

import datetime
import math
from collections import Counter
from pathlib import Path
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame

if TYPE_CHECKING:  # a run without SQL needs no database
    import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    import duckdb

    con = duckdb.connect()
    for table in TABLES:
        if Path(f"{sf_dir}/{table}.parquet").exists():
            con.execute(f"create view {table} as select * from '{sf_dir}/{table}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float):
        # As text, so that a negative zero is not taken for zero.
        return "nan" if math.isnan(value) else repr(round(value, 6))
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    return value


def rows_of(names, rows) -> tuple[list[str], Counter]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], Counter(tuple(_plain(r[i]) for i in order) for r in rows)


def spark_rows(df: DataFrame) -> tuple[list[str], Counter]:
    return rows_of(df.columns, df.collect())


def sql_rows(con: duckdb.DuckDBPyConnection, sql: str) -> tuple[list[str], Counter]:
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    return rows_of(names, result.fetchall())


def difference(df: DataFrame, con: duckdb.DuckDBPyConnection, sql: str) -> str | None:
    """None when both give the same rows, else the first differences."""
    (names, ours), (sql_names, theirs) = spark_rows(df), sql_rows(con, sql)
    if names != sql_names:
        return f"columns {names} against {sql_names}"
    if ours == theirs:
        return None
    extra, lacking = list((ours - theirs).items())[:3], list((theirs - ours).items())[:3]
    return f"{ours.total()} against {theirs.total()} rows; only here {extra}; only there {lacking}"


# The SQL types that hold the same values as each Spark type.
SAME_TYPES = {
    "bigint": {"BIGINT", "INTEGER"},
    "int": {"BIGINT", "INTEGER"},
    "double": {"DOUBLE"},
    "string": {"VARCHAR"},
    "boolean": {"BOOLEAN"},
    "date": {"DATE"},
}


def type_difference(df: DataFrame, con: duckdb.DuckDBPyConnection, sql: str) -> str | None:
    """None when every column has the same kind of type on both sides."""
    theirs = {row[0]: row[1] for row in con.execute(f"describe {sql}").fetchall()}
    wrong = {c: (t, theirs.get(c)) for c, t in df.dtypes if theirs.get(c) not in SAME_TYPES[t]}
    return f"types {wrong}" if wrong else None
