"""Weekly counts per region, with planted defects, derived from the order tables.

A cell is a (nation, market segment, week of shipping). Shipped lines stand in
for cases, returned lines for admissions, and returned lines with a high
discount for deaths. Arithmetic on the cell number decides which cells get a
missing, negative or contradictory value, so every check has something to find.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weekwatch.specs import DEATHS, HOSP, TableSpec

SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
EPOCH_MONDAY = "1995-01-02"
REPLICAS = 3
MEASURES = [f"{m}_{a}" for m in ("cases", "hosp", "deaths") for a in ("under5", "60plus", "total")]
INCIDENCES = [f"incidence_{m}" for m in MEASURES]

WEEKLY_PROV = TableSpec(
    name="weekly_prov",
    group_keys=("department",),
    key_cols=("ubigeo", "week_start"),
    hosp=HOSP,
    deaths=DEATHS,
    year_bounds=(1995, 2001),
    natural_key=("department", "province", "week_start"),
    metrics=(*MEASURES, *INCIDENCES),
    passthrough=("ubigeo", "ano", "semana"),
    tie_break="ubigeo",
    silence_keys=("department", "province"),
)
#: The same rows cleaned to one per department and week.
WEEKLY_PROV_BY_DEPARTMENT = WEEKLY_PROV.with_(
    name="weekly_prov_by_department", natural_key=("department", "week_start")
)
WEEKLY_DEPT = TableSpec(
    name="weekly_dept",
    group_keys=("department",),
    key_cols=("department", "week_start"),
    hosp=HOSP,
    deaths=DEATHS,
    year_bounds=(1995, 2001),
    natural_key=("department", "week_start"),
    metrics=tuple(MEASURES),
    passthrough=("ano", "semana"),
    detect_metrics=("cases_total", "hosp_total", "deaths_total"),
)


# The columns read from the given tables.
SCHEMAS = {
    "lineitem": "l_orderkey bigint, l_quantity double, l_discount double, l_returnflag string, "
    "l_shipdate timestamp_ntz",
    "orders": "o_orderkey bigint, o_custkey bigint",
    "customer": "c_custkey bigint, c_nationkey int, c_mktsegment string",
    "nation": "n_nationkey int, n_name string",
}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table; with its schema named, planning opens no file."""
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def _counts() -> list[Column]:
    quantity = F.col("l_quantity")
    ages = {"under5": quantity <= 10, "60plus": quantity >= 41, "total": F.lit(True)}
    returned = F.col("l_returnflag") == "R"
    kinds = {
        "cases": F.lit(True),
        "hosp": returned,
        "deaths": returned & (F.col("l_discount") >= 0.09),
    }
    return [
        F.count_if(kind & age).alias(f"{k}_{a}")
        for k, kind in kinds.items()
        for a, age in ages.items()
    ]


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per cell, with its defects: the table before replication.

    Lines meet their order and its customer, and are counted per cell before the
    names of the nations are attached.
    """
    day = F.to_date("l_shipdate")
    lines = _table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("o_orderkey"),
        "l_quantity",
        "l_returnflag",
        "l_discount",
        F.date_sub(day, F.weekday(day)).alias("week_start"),
    )
    orders = _table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    customers = _table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    nations = _table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("department")
    )
    place = ["c_nationkey", "c_mktsegment"]
    people = customers.groupBy(*place).agg(F.count(F.lit(1)).alias("people"))
    counted = (
        lines.join(orders.join(customers, "c_custkey"), "o_orderkey")
        .groupBy(*place, "week_start")
        .agg(*_counts())
    )
    known = F.array_position(F.array(*(F.lit(s) for s in SEGMENTS)), F.col("c_mktsegment"))
    segment = F.when(known > 0, known - 1).otherwise(len(SEGMENTS) - 1)
    located = (
        counted.join(people, place)
        .join(nations, "c_nationkey")
        .withColumn("ubigeo", F.col("c_nationkey") * 5 + segment)
        .withColumn("week_no", F.floor(F.datediff("week_start", F.lit(EPOCH_MONDAY)) / 7))
        .withColumn("cell", F.col("ubigeo") * 367 + F.col("week_no"))
    )
    return _with_defects(located).select(
        "ubigeo",
        "department",
        F.col("c_mktsegment").alias("province"),
        "ano",
        "semana",
        "week_start",
        *MEASURES,
        *INCIDENCES,
        "people",
    )


def _every(n: int) -> Column:
    return F.col("cell") % n == 0


def _with_defects(located: DataFrame) -> DataFrame:
    hosp, deaths = F.col("hosp_total"), F.col("deaths_total")
    broken = {
        "hosp_total": F.when(_every(97), None)
        .when(_every(83), F.col("cases_total") + 2)
        .otherwise(hosp),
        "deaths_total": F.when(_every(89), hosp + 1).otherwise(deaths),
        "hosp_under5": F.when(_every(101), -1).otherwise(F.col("hosp_under5")),
        "deaths_under5": F.when(_every(109), deaths + 1).otherwise(F.col("deaths_under5")),
        "ano": F.when(_every(107), 1990).otherwise(F.year("week_start")),
        "semana": F.when(_every(103), 54).otherwise(F.weekofyear("week_start")),
    }
    rates = {f"incidence_{m}": F.col(m) * 100000.0 / F.col("people") for m in MEASURES}
    # One projection: every rule looks at the original counts.
    return located.withColumns({**rates, **broken})


def replicated(df: DataFrame, copies: int) -> DataFrame:
    """Every row ``copies`` times, as the source repeats each total per sub-region."""
    copy = F.explode(F.sequence(F.lit(1), F.lit(copies)))
    return df.withColumn("__copy", copy).drop("__copy")


def weekly_prov(spark: SparkSession, sf_dir: str, copies: int = REPLICAS) -> DataFrame:
    """Counts per province and week; each row repeated."""
    return replicated(cells(spark, sf_dir).drop("people"), copies)


def weekly_dept(spark: SparkSession, sf_dir: str, copies: int = 1) -> DataFrame:
    """Counts per department and week, year and week taken from the date."""
    sums = [F.sum(m).alias(m) for m in MEASURES]
    by_week = cells(spark, sf_dir).groupBy("department", "week_start").agg(*sums)
    dated = by_week.withColumns(
        {"ano": F.year("week_start"), "semana": F.weekofyear("week_start")}
    )
    return dated if copies == 1 else replicated(dated, copies)
