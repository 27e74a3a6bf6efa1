"""Values on an edge fall to the side that the statements put them on, wherever the rows came from."""

import math

from pyspark.sql import functions as F

from phaseloom.operators import diagrams as dg
from phaseloom.operators import windows as wn
from phaseloom.plans.views import rounded_double


def test_grid_points_of_curves_are_decimals(spark):
    bars = spark.createDataFrame([(1, 0.5, 1.2), (1, 1.4, 3.0), (1, 1.7, 1.9)], "id int, birth double, death double")
    got = {r["g"]: r["alive"] for r in dg.betti_curve(bars, ["id"], 0.8, 0.1, 20).collect()}
    assert got == {g: sum(b <= (8 + g) / 10 < d for _, b, d in [(1, 0.5, 1.2), (1, 1.4, 3.0), (1, 1.7, 1.9)]) for g in range(20)}
    bars = spark.createDataFrame([(1, 0.5, 1.2000000000000002)], "id int, birth double, death double")
    assert [r["alive"] for r in dg.betti_curve(bars, ["id"], 0.8, 0.1, 20).orderBy("g").collect()][3:6] == [1, 1, 0]


def test_means_of_windows_are_added_up_in_order(spark):
    values = [0.1, 0.7, 1e16, -1e16, 0.3, 0.25, 29.27, 122.79]
    rows = [(1, k, v) for k, v in enumerate(values)]
    total = 0.0
    for v in values:
        total += v
    mean, square = total / 8, 0.0
    for v in values:
        square += v * v
    bits = ["1" if v >= mean else "0" for v in values]
    want = len({"".join(bits[i : i + n]) for n in range(1, 5) for i in range(9 - n)}) / 8
    for some in (rows, rows[::-1], rows[2:] + rows[:2]):
        df = spark.createDataFrame(some, "w int, k int, v double").coalesce(1)
        assert df.select(F.avg("v").over(wn.whole(["w"], "k")).alias("m")).first()["m"] == mean
        assert wn.substring_diversity(df, ["w"]).first()["lzc"] == want
        assert wn.power(df, ["w"]).first()["power"] == square / 8


def test_a_value_on_the_mean_is_not_under_it(spark):
    values = [38.2, 71.25, 20.05, 55.96, 27.16, 7.28, 65.81, 75.54, 203.55, 117.64, 172.17, 115.86, 26.38, 105.05, 20.88, 17.22]
    total = 0.0
    for v in values:
        total += v
    assert total / 16 > 71.25 == math.fsum(values) / 16
    df = spark.createDataFrame([(1, k, v) for k, v in enumerate(values)], "w int, k int, v double")
    bits = ["1" if v >= 71.25 else "0" for v in values]
    assert wn.substring_diversity(df, ["w"]).first()["lzc"] == len({"".join(bits[i : i + n]) for n in range(1, 5) for i in range(17 - n)}) / 16
    assert wn.with_mean(df, "v", ["w"], "k", "m").select("m").distinct().collect() == [(71.25,)]
    odd = spark.createDataFrame([(1, 0, math.inf), (1, 1, 1.0), (2, 0, None), (2, 1, 3.0), (3, 0, None)], "w int, k int, v double")
    assert dict(wn.with_mean(odd, "v", ["w"], "k", "m").select("w", "m").distinct().collect()) == {1: math.inf, 2: 3.0, 3: None}


def test_doubles_are_rounded_as_in_statements(spark):
    x = 4121.034999999999
    while math.floor(x * 100 + 0.5) == math.floor(4121.034 * 100 + 0.5):
        x = math.nextafter(x, math.inf)
    assert spark.createDataFrame([(x,), (-x,)], "x double").select(rounded_double(F.col("x"), 2).alias("r")).collect() == [(4121.04,), (-4121.04,)]
