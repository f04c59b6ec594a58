import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from skyfold.operators import snapshot_diff
from skyfold.operators.snapshot_diff import snapshot_changes

SCHEMA = "snap int, at timestamp_ntz, k string, a double, b string, snapshot_no string, content string"


def changes(spark, data, **options):
    df = spark.createDataFrame([(r[0], None if r[1] is None else datetime(2024, 1, 1) + timedelta(minutes=r[1]), *r[2:], "clash", "clash") for r in data], SCHEMA)
    return snapshot_changes(df, F.col("k"), "snap", "at", {"a": F.col("a") + 0.0, "b": F.col("b")}, **options)


def brute(data):
    best = {}
    for snap, at, k, a, b in data:
        if k and snap is not None:
            v = ("nan" if a is not None and a != a else a if a is None else a + 0.0, b)
            order = (at is not None, at or 0, repr(v))
            if (snap, k) not in best or order[:2] > best[snap, k][0][:2]:
                best[snap, k] = (order, v)
    snaps = sorted({r[0] for r in data if r[0] is not None})
    out = set()
    for x, y in zip(snaps, snaps[1:]):
        for k in {k for s, k in best if s in (x, y)}:
            old, new = best.get((x, k)), best.get((y, k))
            if old is None or new is None or old[1] != new[1]:
                out.add((k, y, "added" if old is None else "removed" if new is None else "changed"))
    return out


def test_against_brute_force(spark):
    rng = random.Random(5)
    data = []
    for snap in (1, 2, 4, 9):
        for k in range(300):
            if rng.random() < 0.95:
                data.append((snap, 1, f"key{k:03d}", float(k) if rng.random() < 0.97 else rng.choice([None, float("nan"), -0.0]), None if k % 7 == 0 else "x" * (k % 5)))
    for chunk in (1, 8, 64, 10**6):
        got = [tuple(r)[:3] for r in changes(spark, data, mean_chunk=chunk).collect()]
        assert set(got) == brute(data) and len(got) == len(set(got))


def test_digests_discard_most_rows_of_quiet_tables():
    """The rows that are compared one by one are those of chunks whose digests differ, wherever batches end."""
    import numpy as np
    import pyarrow as pa

    keys = [f"k{i:05d}" for i in range(5000)]
    rng = np.random.default_rng(1)
    hashes = {k: int(h) for k, h in zip(keys, rng.integers(0, 1 << 62, 5000))}
    rows = [(k, s, "new" if s == 2 and i % 100 == 0 else "old", hashes[k]) for i, k in enumerate(keys) for s in (1, 2)]
    table = pa.table({"key": [r[0] for r in rows], "snapshot_no": [r[1] for r in rows], "content": [r[2] for r in rows], "key_hash": [r[3] for r in rows], "digest_a": [hash(r[:1] + r[2:]) for r in rows], "digest_b": [hash(r[2:] + r[:1]) for r in rows]})
    seen = []
    for size in (7, 1000, 10000):
        out = pa.Table.from_batches(list(snapshot_diff._differ([1, 2], 8)(iter(table.to_batches(max_chunksize=size)))))
        seen.append(sorted(zip(out["record_key"].to_pylist(), out["old"].to_pylist(), out["new"].to_pylist())))
    assert seen[0] == seen[1] == seen[2] == [(k, "old", "new") for i, k in enumerate(keys) if i % 100 == 0]
    starts = [i for i, k in enumerate(keys) if hashes[k] % 8 == 0]
    chunks = [keys[a:b] for a, b in zip([0, *starts], [*starts, len(keys)])]
    still = sum(len(c) for c in chunks if any(int(k[1:]) % 100 == 0 for k in c))
    assert still < 0.2 * len(keys)


def test_nulls_ties_repeats_and_columns(spark):
    data = [(1, 5, "p", 1.0, "x"), (1, 5, "p", 1.0, "x"), (1, 7, "p", 2.0, "x"), (1, None, "p", 9.0, "x"), (1, 1, None, 1.0, None), (1, 1, "", 1.0, None), (None, 1, "q", 1.0, None), (3, 1, "p", 2.0, None), (3, 1, "q\x1f", 0.0, None)]
    got = {r["record_key"]: (r["snapshot_no"], r["change_kind"], r["changed_columns"]) for r in changes(spark, data).collect()}
    assert got == {"p": (3, "changed", ["b"]), "q\x1f": (3, "added", None)}


def test_empty_and_single_snapshot(spark):
    assert changes(spark, []).count() == 0
    assert changes(spark, [(1, 1, "p", 1.0, "x")]).count() == 0


def test_hot_key(spark):
    data = [(s, i, "hot", float(i), None) for s in (1, 2) for i in range(3000)] + [(s, 1, f"k{i}", 1.0, "z" * 20000) for s in (1, 2) for i in range(20)]
    assert changes(spark, data).count() == 0
