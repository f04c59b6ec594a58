import math
import random

import pytest
from pyspark.sql import functions as F

from skyfold.operators import skew
from skyfold.operators.nearby import pairs_within, regions_containing

SCHEMA = "id string, ra_deg double, dec_deg double, _cell int, _salt string"


def frame(spark, points, name="id"):
    return spark.createDataFrame([(*p, 1, "clash") for p in points], SCHEMA).withColumnRenamed("id", name)


def angle(a, b, c, d):
    a, b, c, d = map(math.radians, (a, b, c, d))
    return math.degrees(2 * math.asin(min(1, math.sqrt(math.sin((d - b) / 2) ** 2 + math.cos(b) * math.cos(d) * math.sin((c - a) / 2) ** 2))))


@pytest.mark.parametrize("radius", [5 / 3600, 0.5, 7.0])
def test_against_brute_force(spark, radius):
    rng = random.Random(1)
    centres = [(0.0, 0.0), (359.9999, 10.0), (10.0, 89.99), (200.0, -89.999), (123.0, 45.0), (360.0, -30.0), (77.0, 90.0)]
    around = lambda n: [(f"p{i}", (x + rng.gauss(0, radius) / max(0.02, math.cos(math.radians(y)))) % 360, max(-90.0, min(90.0, y + rng.gauss(0, radius)))) for i in range(n) for x, y in [rng.choice(centres)]]
    left, right = around(150), around(250)
    expected = {(a[0], b[0]) for a in left for b in right if angle(*a[1:], *b[1:]) <= radius}
    got = [tuple(r) for r in pairs_within(frame(spark, left, "a"), frame(spark, right, "b"), radius, left_id="a", right_id="b").select("a", "b").collect()]
    assert len(got) == len(set(got)) and set(got) == expected and expected


def test_bad_positions_repeats_and_empty(spark):
    nan, inf = float("nan"), float("inf")
    left = [("x", 1.0, 2.0), ("x", 1.0, 2.0), (None, 1.0, 2.0), ("n", None, 2.0), ("m", nan, 2.0), ("o", 361.0, 2.0), ("q", 1.0, inf)]
    right = [("y", 1.0, 2.0), ("y", 1.0, 2.0001), ("z", 1.0, 3.0), ("w", nan, nan), (None, 1.0, 2.0)]
    found = pairs_within(frame(spark, left, "a"), frame(spark, right, "b"), 0.001, left_id="a", right_id="b")
    assert [(r["a"], r["b"], r["separation_deg"]) for r in found.collect()] == [("x", "y", 0.0)]
    assert pairs_within(frame(spark, [], "a"), frame(spark, right, "b"), 1.0, left_id="a", right_id="b").count() == 0


def test_hot_cell_is_split_and_whole(spark, monkeypatch):
    found = []
    plain = skew.find_hot
    monkeypatch.setattr("skyfold.operators.nearby.find_hot", lambda df, keys: found.append(plain(df, keys, least=100, share=20)) or found[-1])
    right = [(f"r{i}", 50.0 + i * 1e-7, 20.0) for i in range(500)] + [(f"s{i}", float(i % 360), 0.0) for i in range(700)]
    got = pairs_within(frame(spark, [("a", 50.0, 20.0)], "a"), frame(spark, right, "b"), 0.01, left_id="a", right_id="b")
    assert got.count() == 500 and found[0].hot


def test_regions(spark):
    square = ("s", [10.0, 20.0, 20.0, 10.0], [0.0, 0.0, 10.0, 10.0])
    hook = ("h", [12.3, 13.9, 13.9, 12.9, 12.9, 12.3], [1.1, 1.1, 1.6, 1.6, 4.2, 4.2])
    regions = spark.createDataFrame([square, hook, ("bad", [1.0, 2.0], [1.0, 2.0]), ("null", [1.0, None, 3.0], [1.0, 2.0, 5.0])], "region string, ra_list array<double>, dec_list array<double>")
    points = [("in", 15.0, 5.0), ("both", 12.5, 3.0), ("notch", 13.5, 3.0), ("out", 25.0, 5.0), ("none", None, 5.0)]
    got = {tuple(r) for r in regions_containing(frame(spark, points), regions, point_id="id", region_id="region").collect()}
    assert got == {("in", "s"), ("both", "s"), ("both", "h"), ("notch", "s")}


def test_plan_has_no_cross_join(spark):
    df = frame(spark, [("a", 1.0, 1.0)])
    plan = pairs_within(df.withColumnRenamed("id", "a"), df.withColumnRenamed("id", "b"), 0.1, left_id="a", right_id="b")._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert F
