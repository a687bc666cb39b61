"""The detectors on raw rows against the window forms, with groups cut into many ranges."""

import math
import random

import pytest

from compare import spark_rows
from weekwatch.functions import ordered
from weekwatch.operators import outliers, raw_outliers

SCHEMA = "place string, season int, day int, cases bigint, rate double"
METRICS = ["cases", "rate"]


@pytest.fixture(scope="module", params=["broadcast", "salted"])
def rows(request, spark):
    pick = random.Random(9)
    out = []
    for place, size in (("hot", 900), ("small", 40), (None, 60), ("one", 1), ("flat", 30)):
        for day in range(size):
            cases = None if pick.random() < 0.1 else 5 if place == "flat" else pick.choice([1, 2, 2, 3, 50, day])
            rate = None if pick.random() < 0.1 else round(pick.gauss(0, 1), 3)
            out.append((place, day % 4, day, cases, rate))
    out.append(("empty", 0, 0, None, None))
    before = ordered.BROADCAST_GROUPS
    ordered.BROADCAST_GROUPS = before if request.param == "broadcast" else 0
    yield spark.createDataFrame(out, SCHEMA).repartition(7)
    ordered.BROADCAST_GROUPS = before


def alike(ours, theirs):
    columns = theirs.columns
    assert spark_rows(ours.select(columns)) == spark_rows(theirs)


@pytest.mark.parametrize("mode", ["nearest", "linear"])
def test_iqr(rows, mode):
    alike(raw_outliers.flag_iqr(rows, ["place"], METRICS, interpolation=mode), outliers.flag_iqr(rows, ["place"], METRICS, interpolation=mode))


def test_mad_and_seasonal(rows):
    alike(raw_outliers.flag_mad(rows, ["place"], METRICS), outliers.flag_mad(rows, ["place"], METRICS))
    alike(raw_outliers.flag_seasonal(rows, ["place"], METRICS, "season"), outliers.flag_seasonal(rows, ["place"], METRICS, "season"))


@pytest.mark.parametrize(("window", "bucket"), [(13, 20), (6, 6), (1, 5), (4, 100_000)])
def test_rolling(rows, window, bucket):
    ours = raw_outliers.flag_rolling_z(rows, ["place"], METRICS, ["day"], window, bucket_rows=bucket)
    alike(ours, outliers.flag_rolling_z(rows, ["place"], METRICS, "day", window))


def test_running_totals(spark):
    pick = random.Random(2)
    rows = [(pick.choice(["a", "b", None]), n, pick.randint(1, 5)) for n in range(400)]
    found = ordered.running(spark.createDataFrame(rows, "g string, n int, w int"), ["g"], ["n"], ordered.F.col("w")).collect()
    assert len(found) == len(rows)
    for r in found:
        mine = [x for x in rows if x[0] == r["g"]]
        assert (r["__upto"], r["__total"]) == (sum(x[2] for x in mine if x[1] <= r["n"]), sum(x[2] for x in mine))


def test_ranks_of_counted_values(spark):
    values = [1.0] * 7 + [2.0] * 2 + [9.0] * 4
    counts = spark.createDataFrame([("g", v, values.count(v)) for v in set(values)], "g string, value double, n bigint")
    for mode in ("nearest", "linear"):
        wanted = {f"q{i}": i / 10 for i in range(11)}
        found = ordered.rank_quantiles(counts, ["g"], wanted, mode).first()
        for name, q in wanted.items():
            place = (len(values) - 1) * q
            low = math.floor(place + 0.5) if mode == "nearest" else math.floor(place)
            part = 0 if mode == "nearest" else place - low
            high = min(low + 1, len(values) - 1)
            assert found[name] == pytest.approx((1 - part) * values[low] + part * values[high])


def test_no_rows(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert raw_outliers.flag_iqr(none, ["place"], METRICS).collect() == []
    assert raw_outliers.flag_mad(none, ["place"], METRICS).collect() == []
    assert raw_outliers.flag_rolling_z(none, ["place"], METRICS, ["day"]).collect() == []
