"""A relational database as a snapshot source, read in parallel ranges."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

FETCH_ROWS = 50_000
_ORDERED = (
    T.ByteType,
    T.ShortType,
    T.IntegerType,
    T.LongType,
    T.DecimalType,
    T.DateType,
    T.StringType,
)


def quoted(identifier: str) -> str:
    """An identifier as SQL text; quotes inside it are doubled."""
    return '"' + identifier.replace('"', '""') + '"'


def literal(value) -> str:
    """A number as it is, anything else as quoted SQL text."""
    if isinstance(value, (int, float, Decimal)):
        return str(value)
    return "'" + str(value).replace("'", "''") + "'"


@dataclass
class JdbcSource:
    """Tables of one schema.

    ``url`` and ``properties`` (user, password, driver) come from the deployment.
    A table is split into ``partitions`` parts, each one task that streams
    ``FETCH_ROWS`` rows at a time. PostgreSQL tables are split by pages, so parts are
    equal whatever the columns hold. Elsewhere, or where ``split_columns`` names one, a
    column's ranges are chosen to hold equally many rows; it may be of any type.
    """

    spark: SparkSession
    url: str
    properties: Mapping[str, str]
    schema: str = "public"
    partitions: int = 64
    split_columns: Mapping[str, str] = field(default_factory=dict)

    def _reader(self, **options):
        return self.spark.read.format("jdbc").options(
            url=self.url, fetchsize=str(FETCH_ROWS), **self.properties, **options
        )

    def tables(self) -> list[str]:
        schema = self.schema.replace("'", "''")
        listing = (
            "select table_name from information_schema.tables "
            f"where table_schema = '{schema}' and table_type = 'BASE TABLE'"
        )
        # The catalog's list of names: one row per table.
        return sorted(row[0] for row in self._reader(query=listing).load().collect())

    def count(self, table: str) -> int:
        return self._reader(query=f"select count(*) as n from {self._name(table)}").load().first()[0]

    def _name(self, table: str) -> str:
        return f"{quoted(self.schema)}.{quoted(table)}"

    # ---- parts ----

    def pages_query(self, table: str) -> str:
        """How many pages a PostgreSQL table has."""
        name = literal(self._name(table))
        return (
            f"select pg_relation_size({name}::regclass) / current_setting('block_size')::bigint as pages"
        )

    def page_predicates(self, pages: int) -> list[str]:
        """Conditions that part the rows by page; the last part is open, the table may have grown."""
        parts = max(1, min(self.partitions, pages))
        starts = [pages * i // parts for i in range(parts)]
        low = [f"ctid >= '({start},0)'::tid" for start in starts]
        high = [f" and ctid < '({start},0)'::tid" for start in starts[1:]] + [""]
        return [a + b for a, b in zip(low, high, strict=True)]

    def distinct_query(self, table: str, columns: Sequence[str]) -> str:
        counts = ", ".join(f"count(distinct {quoted(c)}) as {quoted(c)}" for c in columns)
        return f"select {counts} from {self._name(table)}"

    def bounds_query(self, table: str, column: str) -> str:
        """The smallest value of each of ``partitions`` parts with equally many rows."""
        c = quoted(column)
        parts = f"select {c}, ntile({self.partitions}) over (order by {c}) as part from {self._name(table)}"
        return f"select part, min({c}) as low from ({parts} where {c} is not null) as parts group by part"

    def range_predicates(self, column: str, lows: Sequence) -> list[str]:
        """Conditions that part the rows at the given values, nulls in the first part.

        The values come in the database's own order, which need not be ours.
        """
        c = quoted(column)
        cuts = [literal(v) for v in dict.fromkeys(lows)][1:]
        if not cuts:
            return ["1 = 1"]
        between = [f"{c} >= {a} and {c} < {b}" for a, b in zip(cuts, cuts[1:])]
        return [f"{c} < {cuts[0]} or {c} is null", *between, f"{c} >= {cuts[-1]}"]

    def split_column(self, table: str, schema: T.StructType) -> str | None:
        """The named column, else the one with the most different values."""
        if table in self.split_columns:
            return self.split_columns[table]
        fits = [f.name for f in schema.fields if isinstance(f.dataType, _ORDERED)]
        if not fits:
            return None
        counts = self._reader(query=self.distinct_query(table, fits)).load().first()
        return max(fits, key=lambda c: counts[c])

    def predicates(self, table: str, schema: T.StructType) -> list[str] | None:
        if self.url.startswith("jdbc:postgresql:") and table not in self.split_columns:
            return self.page_predicates(self._reader(query=self.pages_query(table)).load().first()[0])
        column = self.split_column(table, schema)
        if column is None:
            return None
        # At most one row per part.
        lows = self._reader(query=self.bounds_query(table, column)).load().collect()
        return self.range_predicates(column, [row["low"] for row in sorted(lows, key=lambda r: r["part"])])

    def read(self, table: str) -> DataFrame:
        name = self._name(table)
        whole = self._reader(dbtable=name).load()
        parts = self.predicates(table, whole.schema)
        if not parts or len(parts) == 1:
            return whole
        properties = {**self.properties, "fetchsize": str(FETCH_ROWS)}
        return self.spark.read.jdbc(self.url, name, predicates=parts, properties=properties)
