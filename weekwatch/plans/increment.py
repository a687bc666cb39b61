"""Validation of a table that grows by files.

What a file adds to the findings is counted once and kept: its cells, and how often it has each key. The
next run reads only files that it has not counted, and adds up what is kept of the files that are there now;
so files that were replaced or taken away stop counting without being read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weekwatch.functions import quoted
from weekwatch.operators import profile
from weekwatch.plans.common import together
from weekwatch.plans.validation import Validation
from weekwatch.sources.scratch import store
from weekwatch.sources.tables import conform, scan
from weekwatch.sources.upsert import BATCH, UpsertTable
from weekwatch.specs import TableSpec

# A file is known by its path, length and time of change.
FILE = ["file", "bytes", "changed"]
FILE_SCHEMA = T.StructType(
    [T.StructField(c, t()) for c, t in zip(FILE, (T.StringType, T.LongType, T.TimestampType), strict=True)]
)


def files_of(spark: SparkSession, path: str) -> DataFrame:
    """The Parquet files of a table, ``file, bytes, changed``, from the listing; none is opened."""
    listed = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path)
    return listed.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_size").alias("bytes"),
        F.col("_metadata.file_modification_time").alias("changed"),
    )


class KeptCounts:
    """The counts of single files under ``path``: tables of cells, keys and counted files, in batches.

    A batch is one run. Its files are written last, so a run that ends before has counted nothing, and the next
    one takes its number and replaces what it left.
    """

    def __init__(self, spark: SparkSession, path: str, cells: T.StructType, keys: T.StructType):
        def kept(name: str, schema: T.StructType) -> UpsertTable:
            return UpsertTable(spark, f"{path.rstrip('/')}/{name}", schema, FILE)

        self.cells, self.keys, self.files = kept("cells", cells), kept("keys", keys), kept("files", FILE_SCHEMA)

    def next_batch(self) -> int:
        newest = self.files.rows().agg(F.max(BATCH)).first()[0]
        return 0 if newest is None else newest + 1

    def put(self, cells: DataFrame, keys: DataFrame, files: DataFrame) -> None:
        """Add the counts of files not counted before."""
        batch = self.next_batch()
        together(lambda: self.cells.put(cells, batch), lambda: self.keys.put(keys, batch))
        self.files.put(files, batch)


def _count(table: DataFrame, spec: TableSpec) -> tuple[DataFrame, DataFrame]:
    """The cells and the keys of a table, per file that the rows lie in."""
    of_file = {
        "file": F.col("_metadata.file_path"),
        "bytes": F.col("_metadata.file_size"),
        "changed": F.col("_metadata.file_modification_time"),
    }
    columns = table.columns
    marked = conform(table.withColumns(of_file), spec)
    cells = profile.integrity_cells(marked, spec, FILE, columns)
    return cells, marked.groupBy(*FILE, *spec.key_cols).agg(F.count(F.lit(1)).alias("n"))


def validate_increment(
    spark: SparkSession, path: str, spec: TableSpec, kept_dir: str, folder: str | None = None
) -> Validation:
    """``validate`` of the table at ``path``, reading only files that earlier runs have not counted.

    ``kept_dir`` holds the counts of this table between runs, and one run at a time may write there. Files are
    told apart by path, length and time of change: a replaced one is counted anew, and one that is gone counts no
    more. A run that fails is repeated whole. The table must not change while it is validated, and all files must have the
    same columns as ever; a table that gained a column needs a new ``kept_dir``. Findings are stored in ``folder``,
    by default the session's scratch folder.
    """
    table = scan(spark, path)
    clash = [c for c in (*FILE, BATCH, "n") if c in table.columns]
    if clash:
        raise ValueError(f"columns named {', '.join(clash)} cannot be counted by file")
    cells, keys = _count(table, spec)
    kept = KeptCounts(spark, kept_dir, cells.schema, keys.schema)
    present = store(files_of(spark, path), "files", folder)
    new = store(present.join(kept.files.rows().select(*FILE), FILE, "left_anti"), "new-files", folder)
    # Spark's own listing holds these names as well; files outside of them are not opened.
    names = [row["file"] for row in new.select("file").collect()]
    if names:
        kept.put(*_count(table.where(F.col("_metadata.file_path").isin(names)), spec), new)

    def of_present(rows: DataFrame) -> DataFrame:
        return rows.join(present, FILE, "left_semi")

    groups = list(dict.fromkeys((*spec.group_keys, spec.year_col, spec.date_col)))
    counts = [c for c in cells.columns if c not in (*FILE, *groups)]
    summed = of_present(kept.cells.rows()).groupBy(*groups).agg(*(F.sum(quoted(c)).alias(c) for c in counts))
    per_key = of_present(kept.keys.rows()).groupBy(*spec.key_cols).agg(F.sum("n").alias("n"))
    stored, duplicates = together(
        lambda: store(summed, f"cells-{spec.name}", folder),
        lambda: store(profile.rows_beyond_first(per_key), f"duplicates-{spec.name}", folder),
    )
    return Validation(conform(table, spec), spec, stored, duplicates)
