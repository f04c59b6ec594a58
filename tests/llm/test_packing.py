import random
from collections import defaultdict

import pytest

from skyfold.llm import packing
from skyfold.llm.packing import pack


def one_by_one(sizes, capacity):
    """Best fit in descending order, item by item."""
    gaps = []
    for s in sorted(sizes, reverse=True):
        fits = [g for g in gaps if g >= s]
        if fits:
            gaps.remove(min(fits))
            gaps.append(min(fits) - s)
        else:
            gaps.append(capacity - s)
    return sorted(gaps)


def check(spark, sizes, capacity=100):
    df = spark.createDataFrame([(i % 900, s, "clash") for i, s in enumerate(sizes)], "doc_id long, size long, container_id string")
    rows = pack(df, "doc_id", "size", capacity).collect()
    used, parts = defaultdict(int), defaultdict(list)
    for r in rows:
        used[r["container_id"]] += r["n_units"]
        parts[r["doc_id"]].append((r["piece_no"], r["first_unit"], r["n_units"]))
    assert all(u <= capacity for u in used.values())
    if len(sizes) <= 900:
        for i, s in enumerate(sizes):
            s = s or 0
            assert sorted(parts[i]) == [(k, k * capacity, min(capacity, s - k * capacity)) for k in range(max(1, -(-s // capacity)))]
    return rows, used


def test_every_item_once_and_full_containers(spark):
    rng = random.Random(2)
    sizes = [rng.choice([rng.randint(1, 40), rng.randint(1, 100), rng.randint(101, 1000), None, 0]) for _ in range(900)]
    rows, used = check(spark, sizes)
    assert sum(used.values()) == sum(s or 0 for s in sizes)
    assert set(used) == set(range(-(-sum(used.values()) // 100))) or len(used) <= 1.02 * sum(used.values()) / 100 + 1


def test_one_size_holds_a_third_and_repeated_rows(spark):
    rows, used = check(spark, [30] * 1500 + [10] * 1500 + [100] * 100)
    assert len(rows) == 3100 and sum(used.values()) == 70000 and len(used) == 700


@pytest.mark.parametrize("events,finish", [(60, 0), (200_000, 0), (200, 20)])
def test_supersteps_pack_as_tightly_as_item_by_item(spark, monkeypatch, events, finish):
    """Whatever the ranges: many small ones, where items take gaps of other ranges, or one."""
    monkeypatch.setattr(packing, "_EVENTS", events)
    monkeypatch.setattr(packing, "_FINISH", finish)
    rng = random.Random(3)
    sizes = [rng.choice([rng.randint(1, 100), rng.randint(5, 50), 34, 20]) for _ in range(400)] + [51] * 30 + [49] * 30
    rows, used = check(spark, sizes)
    gaps = one_by_one(sizes, 100)
    assert set(used) == set(range(len(used))) and len(used) <= 1.02 * len(gaps)


def test_levels_name_the_gap_of_each_item():
    assert packing._levels({(0, 2): 3, (1, 1): 2, (1, 2): 1, (2, 1): 5}) == [(0, 0, 0), (1, 3, 1), (2, 2, 0)]
    assert packing._finish([(7, 60), (8, 50), (9, 10)], [(3, 55)], 100, 5) == ([(7, 5), (8, 3), (9, 5)], 6)


def test_empty_and_only_empty_texts(spark):
    assert check(spark, [])[0] == []
    assert {r["container_id"] for r in check(spark, [0, None, 0])[0]} == {0}
