import random
from datetime import datetime, timedelta

import pytest

from skyfold.operators import skew
from skyfold.operators.orphans import Reference, Target, key_runs, orphan_references

DAY = [datetime(2024, 1, 1) + timedelta(days=20 * i) for i in range(12)]
CHILD, PARENT = "id long, k long, h string, t timestamp_ntz, code string, run int, salt int", "pk long, ph string, a timestamp_ntz, b timestamp_ntz, code string"


def found(spark, child, parent, gone=True):
    c, p = spark.createDataFrame([(*r, "clash", 1, 2) for r in child], CHILD), spark.createDataFrame([(*r, "clash") for r in parent], PARENT)
    targets = [Target("n", p, "pk", "a", "b" if gone else None), Target("s", p, "ph", "a", "b", as_text=True)]
    refs = [Reference("c.k", c, "k", "id", "t", "n"), Reference("c.h", c, "h", "id", "t", "s")]
    return sorted((tuple(r) for r in orphan_references(refs, targets).collect()), key=repr)


def brute(child, parent, gone=True):
    out = []
    norm = lambda s: None if s is None or s.strip().lower() in ("", "-") else s.strip().lower()
    for i, k, h, t in child:
        for name, key, rows in (("c.k", k, [(x[0], x[2], x[3] if gone else None) for x in parent]), ("c.h", norm(h), [(norm(x[1]), x[2], x[3]) for x in parent])):
            if key is None:
                continue
            mine = [x for x in rows if x[0] == key]
            started = [x for x in mine if t is not None and x[1] is not None and x[1] <= t]
            if not mine:
                reason = "missing"
            elif any(x[2] is None or x[2] > t for x in started):
                continue
            else:
                reason = "deleted" if started else "late"
            if reason == "deleted" and not gone and name == "c.k":
                reason = "late"
            out.append((name, i, reason, None if t is None else t.strftime("%Y-%m")))
    return sorted(out, key=repr)


@pytest.mark.parametrize("gone", [True, False])
def test_against_brute_force(spark, gone):
    rng = random.Random(3)
    keys = [*range(-5, 40), *range(250, 262), 10**18, 10**18 + 1, -(2**63), 2**63 - 1]
    day = lambda p: rng.choice(DAY) if rng.random() < p else None
    parent = [(rng.choice([*keys, None]), rng.choice(["a", " B", "c\t", "-", None, "Ω", "a1", "a2", "A3 ", "a007", "7", "1" * 30, "x9y"]), day(0.95), day(0.4)) for _ in range(60)]
    child = [(i, rng.choice([*keys, None, 41, 100]), rng.choice(["A ", "b", "d", "", " ", "-", None, "ω\u00a0", "a2", "a4", "a7", "a07", "A007", "7", "1" * 30, "1" * 29, "x9y", "x9"]), day(0.95)) for i in range(400)]
    child += child[:3]
    assert found(spark, child, parent, gone) == brute(child, parent, gone)


def test_empty_tables(spark):
    assert found(spark, [], [(1, "a", DAY[0], None)]) == []
    assert found(spark, [(1, 5, "x", DAY[0])], []) == [("c.h", 1, "missing", "2024-01"), ("c.k", 1, "missing", "2024-01")]


def test_runs_are_contiguous(spark):
    p = spark.createDataFrame([("", k, DAY[0]) for k in [3, 4, 5, 5, 9, 255, 256, 257]], "stem string, code long, loaded timestamp_ntz")
    assert sorted((r["run_start"], r["run_end"], len(r["first_loads"])) for r in key_runs(p).collect()) == [(3, 5, 3), (9, 9, 1), (255, 255, 1), (256, 257, 2)]


def test_hot_key_is_salted(spark, monkeypatch):
    used = []
    plain = skew.find_hot
    monkeypatch.setattr("skyfold.operators.orphans.find_hot", lambda df, keys: used.append(plain(df, keys, least=50, share=20)) or used[-1])
    child = [(i, 7, "h", DAY[i % 12]) for i in range(300)] + [(1000 + i, i, None, DAY[1]) for i in range(200)]
    parent = [(7, "h", DAY[4], DAY[8]), (8, "g", DAY[0], None)]
    assert found(spark, child, parent) == brute(child, parent) and any(s.hot for s in used)
