import random
from datetime import datetime

from pyspark.sql import functions as F

from skyfold.llm.resolution import Field, claims, facts, judged_survivors, learn_quality, survivors, truths

SCHEMA = "host string, source string, at timestamp_ntz, row long, v double, w double, value string, rows int"
FIELDS = [Field("v", 0, 100), Field("w", -5, 5)]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA)


def trust(spark):
    return spark.createDataFrame([("Best", 1), ("good ", 2), ("good", 5), (None, 0)], "source_code string, trust_rank int")


def chosen(spark, rows):
    got = survivors(frame(spark, rows), F.col("host"), FIELDS, source="source", trust=trust(spark), updated="at", row_id="row").collect()
    return {(r["record_key"], r["field_name"]): (r["row_id"], r["value"]) for r in got}


def test_order_of_trust_then_time_then_row(spark):
    day = lambda d: datetime(2024, 1, d)
    nan = float("nan")
    rows = [
        ("a", "GOOD", day(9), 1, 10.0, 0.0), ("a", " best ", day(1), 2, 20.0, None), ("a", "best", None, 3, 30.0, 1.0), ("a", "best", day(1), 0, None, nan),
        ("b", "nobody", None, 7, 1.0, 9.0), ("b", None, day(3), 8, 2.0, None), ("b", "x", day(3), 6, 3.0, None),
        ("c", "best", day(1), 9, 1.0, 1.0), (None, "best", day(1), 10, 1.0, 1.0), (None, "best", day(1), 11, 1.0, 1.0),
        ("d", "good", day(2), 12, 100.0, 5.0), ("d", "good", day(2), 12, 100.0, 5.0), ("e", "good", day(2), 13, nan, 6.0), ("e", "good", day(2), 14, 101.0, None),
    ]
    assert chosen(spark, rows) == {("a", "v"): (2, 20.0), ("a", "w"): (3, 1.0), ("b", "v"): (6, 3.0), ("d", "v"): (12, 100.0), ("d", "w"): (12, 5.0)}


def test_empty(spark):
    assert chosen(spark, []) == {}
    assert truths(frame(spark, []), F.col("host"), FIELDS, "source").count() == 0


def test_quality_is_learned_and_several_values_kept(spark):
    rng = random.Random(7)
    rows = []
    for i in range(400):
        real = {float(rng.randint(1, 50)), float(rng.randint(51, 99))} if i % 4 == 0 else {float(rng.randint(1, 99))}
        for source, hit, wrong in (("sharp", 0.95, 0.02), ("fair", 0.8, 0.1), ("also", 0.85, 0.05), ("wild", 0.3, 0.9)):
            for value in real:
                if rng.random() < hit:
                    rows.append((f"h{i}", source, None, len(rows), value, None))
            if rng.random() < wrong:
                rows.append((f"h{i}", source, None, len(rows), rng.uniform(1, 99), None))
        rows[-1] = rows[-1]
        for value in real:
            rows.append((f"h{i}", "truth", None, -1, value, None))
    real = {(r[0], r[4]) for r in rows if r[1] == "truth"}
    df = frame(spark, [r for r in rows if r[1] != "truth"])
    quality = learn_quality(facts(claims(df, F.col("host"), FIELDS, "source")))
    assert quality.sensitivity["v|sharp"] > 0.8 > 0.6 > quality.sensitivity["v|wild"]
    assert quality.false_positive["v|wild"] > 0.5 > quality.false_positive["v|sharp"]
    spread = learn_quality(facts(claims(df, F.col("host"), FIELDS, "source")), most_patterns=3)
    assert all(abs(a[k] - b[k]) < 1e-9 for a, b in zip(vars(quality).values(), vars(spread).values()) for k in a) and vars(quality).keys() == vars(spread).keys()
    chosen_too = judged_survivors(df, F.col("host"), FIELDS, source="source", trust=trust(spark), updated="at", row_id="row").collect()
    assert all(0 <= r["probability"] <= 1 and r["best_value"] is not None for r in chosen_too) and len(chosen_too) > 300
    judged = truths(df, F.col("host"), FIELDS, "source").collect()
    right = sum(((r["record_key"], r["value"]) in real) == (r["probability"] >= 0.5) for r in judged)
    assert right / len(judged) > 0.93
    kept = {}
    for r in judged:
        kept.setdefault(r["record_key"], []).append(r["probability"] >= 0.5)
    assert sum(sum(v) >= 2 for v in kept.values()) > 50
