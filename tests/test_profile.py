import math
import random
import statistics

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from pyspark.sql import functions as F

from skyfold.operators.profile import Usable, chunk_statistics, column_profile, distinct_values, exact_medians, load_findings, pattern_profile, profile_loads

USABLE = [Usable("p", -50, 800), Usable("r", 0, 100, above=True)]


def write(spark, data, path, files=1):
    df = spark.createDataFrame(data, "retrieval_id int, load_no int, p double, r double, path string, v int").coalesce(1)
    (df.repartition(files) if files > 1 else df).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def make(seed=1):
    rng = random.Random(seed)
    odd = [None, float("nan"), float("inf"), -float("inf"), -9999.0]
    data = []
    for load in (1, 2, 3, None):
        for _ in range(157):
            p = rng.choice(odd) if rng.random() < (0.4 if load == 2 else 0.05) else round(rng.gauss(5, 2) * (3 if load == 3 else 1), 2)
            r = 1.25 if load == 3 and rng.random() < 0.6 else rng.uniform(0.5, 2)
            data.append((1, load, p, r, "x", 1))
    return data


def test_against_brute_force(spark, tmp_path):
    data = make()
    got = {(r["load_no"], r["column_name"]): r for r in profile_loads(write(spark, data, str(tmp_path / "t"), 3), USABLE, different=True).collect()}
    assert len(got) == 8
    for load in (1, 2, 3, None):
        for u, i in zip(USABLE, (2, 3)):
            values = [d[i] for d in data if d[1] == load]
            ok = [v for v in values if v is not None and not math.isnan(v) and (u.low < v if u.above else u.low <= v) and v <= u.high]
            row = got[load, u.column]
            assert (row["rows"], row["nulls"], row["usable"], row["bad"]) == (157, sum(v is None for v in values), len(ok), len([v for v in values if v is not None]) - len(ok))
            assert row["median"] == statistics.median(ok) and (row["least"], row["most"]) == (min(ok), max(ok))
            assert row["different"] == len({str(v) for v in values if v is not None})
            most = max(ok.count(v) for v in set(ok))
            assert (row["top_share"] is not None) == (most > 0.25 * len(ok))
    assert got[3, "r"]["top_value"] == 1.25


def test_findings(spark, tmp_path):
    found = {(r["load_no"], r["column_name"], r["finding"]) for r in load_findings(profile_loads(write(spark, make(), str(tmp_path / "t")), USABLE)).collect()}
    assert {(2, "p", "bad_values"), (3, "p", "median_jump"), (3, "r", "constant_fill")} <= found
    assert not any(f[0] == 1 and f[2].endswith("jump") for f in found)


def test_footers_are_used_where_a_chunk_holds_one_load(spark, tmp_path):
    data = make()
    df = write(spark, [d for d in data if d[1] == 1], str(tmp_path / "one"))
    stats = {r["column_name"]: r for r in chunk_statistics(df, ["p", "r"]).collect()}
    values = [d[2] for d in data if d[1] == 1]
    assert stats["p"]["nulls"] == sum(v is None for v in values) and stats["p"]["loads"][0]["load_no"] == 1
    assert stats["p"]["candidates"] == len({str(v) for v in values if v is not None})
    row = next(r for r in profile_loads(df, USABLE).collect() if r["column_name"] == "p")
    assert row["nulls"] == stats["p"]["nulls"]


@pytest.mark.parametrize("options", [{}, {"use_dictionary": False}, {"dictionary_pagesize_limit": 2000, "write_batch_size": 100}, {"data_page_version": "2.0", "compression": "zstd"}])
def test_candidates_of_large_and_partly_plain_chunks(spark, tmp_path, options):
    rng = random.Random(3)
    for n, kinds in ((1_000_000, 4000), (3000, 1500)):
        values = [None, float("nan"), *(rng.randrange(kinds) / 4 for _ in range(n))]
        pq.write_table(pa.table({"retrieval_id": pa.array([1] * len(values), pa.int32()), "load_no": pa.array([1] * len(values), pa.int32()), "p": values}), tmp_path / f"{n}.parquet", row_group_size=2_000_000, **options)
        (row,) = chunk_statistics(spark.read.parquet(str(tmp_path / f"{n}.parquet")), ["p"]).collect()
        assert row["candidates"] == len(set(values[2:])) + 1


def test_medians_narrow_without_gathering(spark):
    rng = random.Random(4)
    data = [(1, 1, "a", v) for v in [rng.lognormvariate(0, 9) for _ in range(1001)]] + [(1, 2, "a", 3.0)] * 500 + [(2, 1, "a", 1.0), (2, 1, "a", 2.0)]
    data += [(2, 2, "a", v) for v in [1.0] * 6 + [2.0] * 6] + [(2, 3, "a", v) for v in [-1e308] * 9 + [1e308] * 9 + [5e-324] * 2] + [(2, 4, "a", v) for v in [1.0] * 7 + [math.nextafter(1, 2)] * 7 + [9.0] * 9 + [-9.0] * 9]
    values = spark.createDataFrame(data, "a int, b int, c string, v double").select(F.struct("a", "b", "c").alias("key"), "v")
    parts = values.groupBy("key").agg(F.min("v").alias("least"), F.max("v").alias("most"), F.count("*").alias("n"))
    got = {tuple(r["key"])[:2]: r["median"] for r in exact_medians(values, parts, bins=8, most_inside=3).collect()}
    assert got == {(1, 1): statistics.median(d[3] for d in data[:1001]), (1, 2): 3.0, (2, 1): 1.5, (2, 2): 1.5, (2, 3): 5e-324, (2, 4): statistics.median([1.0, math.nextafter(1, 2)])}


def test_columns_read_only_chunks_that_need_it(spark, tmp_path):
    whole = pa.table({"retrieval_id": pa.array([1] * 400, pa.int32()), "load_no": pa.array([1] * 200 + [2] * 200, pa.int32()), "p": [None, float("nan"), *(float(i % 50) for i in range(398))]})
    for name, options in (("footers", {}), ("plain", {"use_dictionary": False}), ("bare", {"write_statistics": False})):
        path = str(tmp_path / f"{name}.parquet")
        pq.write_table(whole, path, row_group_size=200, **options)
        df = spark.read.parquet(path)
        (row,) = column_profile(df, ["p"]).collect()
        assert (row["rows"], row["nulls"], row["least"], row["most"], row["different"]) == (400, 1, 0.0, 49.0, 51)
        assert (row["chunks"], row["read_chunks"]) == (2, 0 if name == "footers" else 2)
        assert distinct_values(df, ["p"]).where("from_dictionary").isEmpty() == (name != "footers")
        counts = {(r["load_no"]): r["n"] for r in distinct_values(df, ["p"]).groupBy("load_no").agg(F.count_distinct("v").alias("n")).collect()}
        assert counts == {1: 51, 2: 50}


def test_patterns(spark):
    df = spark.createDataFrame([(1, 1, "ab1"), (1, 1, None), (1, 1, "ab"), (1, 1, "ab1\n"), (1, None, None), (1, 2, "")], "retrieval_id int, load_no int, t string")
    got = {r["load_no"]: tuple(r)[3:] for r in pattern_profile(df, {"t": "ab|ab[0-9]"}).collect()}
    assert got == {1: (4, 1, 1, 1 / 3), None: (1, 1, 0, None), 2: (1, 0, 1, 1.0)}
    assert pattern_profile(df.limit(0), {"t": "a"}).count() == 0


def test_empty(spark, tmp_path):
    assert profile_loads(write(spark, [], str(tmp_path / "e")), USABLE, different=True).count() == 0
