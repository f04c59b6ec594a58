from skyfold.llm import linkage

HOST = "hostname string, hip_name string, hd_name string, ra double, dec double, sy_dist double, record string"
STAR = "wgsn_id string, hip string, hd string, other_id string, ra2000 string, de2000 string, distance_ly string, name string"


def found(spark, hosts, stars, **options):
    h = spark.createDataFrame([(*r, "clash") for r in hosts], HOST)
    s = spark.createDataFrame([(*r, "clash") for r in stars], STAR)
    return {(r["host_key"], r["wgsn_id"]): r["confidence"] for r in linkage.link(h, s, **options).collect()}


HOSTS = [
    ("Velar-12", "HIP 5000", "HD 77", 10.0, 20.0, 100.0), ("Velar–12 ", "hip5000", None, 10.0, 20.0, 100.0), ("Velar-12 B", None, "HD 78", 10.001, 20.001, 100.0),
    ("TKV 9", "HIP 1234", None, 200.0, -30.0, 50.0), ("GJX 3", None, None, None, None, None), (None, "HIP 9", None, 1.0, 1.0, 1.0), ("!!", None, None, 1.0, 1.0, 1.0), ("OGR 8", "HIP 777", None, 359.9999, 5.0, 40.0),
]
LY = 3.26156


def test_cases(spark):
    stars = [
        ("same", "HIP 5000", "-", "velar 12", "10.0002", "20.0001", str(100 * LY)),
        ("companion", "--", "78 ", "VELAR-12 B", "10.001", "20.001", None),
        ("wrong-hip", "1234", "_", None, "90.0", "60.0", str(900 * LY)),
        ("typo", "1234", "", "TKV 8", "200.0001", "-30.0001", str(51 * LY)),
        ("nameless-field", None, None, None, "10.004", "20.0", str(700 * LY)),
        ("by-name", None, None, "GJX 3", "x", None, None),
        ("over-zero", "777", "", "", "0.0002", "5.0", str(41 * LY)),
        (None, "5000", None, "Velar-12", "10.0", "20.0", None),
        ("nothing", None, None, None, None, None, None),
    ]
    got = found(spark, HOSTS, stars)
    assert set(got) == {("velar12", "same"), ("velar12b", "companion"), ("tkv9", "typo"), ("gjx3", "by-name"), ("ogr8", "over-zero")}
    assert all(0.5 <= c <= 1 for c in got.values())


def test_hot_values_and_copies(spark, monkeypatch):
    monkeypatch.setattr(linkage, "HOT_PAIRS", 100)
    hosts = [(f"TKV {i}", "HIP 1", None, float(i), 10.0, 100.0) for i in range(60)]
    stars = [(f"s{i}", "HIP 1", None, f"TKV {i}", f"{i}.0001", "10.0", None) for i in range(60)] + [(f"c{i}", "HIP 1", None, "TKV 5", "5.0001", "10.0", None) for i in range(200)]
    got = found(spark, hosts, stars)
    assert set(got) == {(f"tkv{i}", f"s{i}") for i in range(60)} | {("tkv5", f"c{i}") for i in range(200)}


def test_hot_values_lose_no_pair_that_agrees_nowhere_else(spark, monkeypatch):
    hosts = [(f"Qorvex {c}", None, None, None, None, None) for c in "bcd"] + [("Zulth 4", "HIP 31", "HD 8", 10.0, 10.0, float(d)) for d in range(20, 32)] + [(f"TKV {i}", "HIP 4", None, None, None, None) for i in range(12)]
    stars = [(f"n{i}", None, None, "Qorvex c", None, None, str(100 + i)) for i in range(40)] + [(f"d{i}", None, "8", None, None, None, str((20 + i % 12) * LY + i / 99)) for i in range(40)] + [(f"h{i}", "4", None, f"TKV {i % 15}", None, None, str(50 + i)) for i in range(40)]
    whole = found(spark, hosts, stars)
    assert {s for _, s in whole} >= {f"n{i}" for i in range(40)} | {f"d{i}" for i in range(40)}
    monkeypatch.setattr(linkage, "HOT_PAIRS", 30)
    hot = found(spark, hosts, stars)
    assert set(hot) == set(whole) and all(abs(hot[k] - whole[k]) < 1e-9 for k in whole)


def test_empty(spark):
    assert found(spark, [], [("a", "HIP 5", None, "x 1", "1.0", "1.0", None)]) == {} and found(spark, HOSTS, []) == {}


def test_close_texts_are_all_close_pairs(spark):
    import random

    from pyspark.sql import functions as F

    rng = random.Random(3)
    texts = [(rng.choice(["velar", "tkv", "o", "", "εri"]) + "".join(rng.choice("0123") for _ in range(rng.randint(0, 5)))) or "x" for _ in range(300)] + ["a", "b", "a" * 300, "a" * 301, "velar99bc"]
    left, right = (spark.createDataFrame([(t,) for t in part] + [(None,)], "text string") for part in (texts[:180], texts[120:]))
    got = {tuple(r) for r in linkage.close_texts(left, right).collect()}
    bits = {r["text"]: {64 * k + i for k in (0, 1) for i in range(64) if r["b"][k] >> i & 1} for r in left.union(right).where("text is not null").select("text", linkage._bits(F.col("text")).alias("b")).collect()}
    want = {(a, b) for a in set(texts[:180]) for b in set(texts[120:]) if bits[a] != bits[b] and len(bits[a] - bits[b]) <= 2 and len(bits[b] - bits[a]) <= 2}
    assert got == want and len(want) > 100
    one_off = [("velar12345", "velar12745"), ("velar12345", "velar1245"), ("velar1245", "velar12345"), ("tkv7", "tkv9"), ("quenby5", "quembyn5")]
    pairs = {tuple(r) for r in linkage.close_texts(spark.createDataFrame(one_off[:4], "text string, b string"), spark.createDataFrame([(b,) for _, b in one_off[:4]], "text string")).collect()}
    assert set(one_off[:4]) <= pairs


def test_one_wrong_letter_everywhere_and_no_position(spark):
    import random

    rng = random.Random(5)
    numbers = [(rng.randint(10000, 89999), rng.randint(10000, 89999)) for _ in range(200)]
    hosts = HOSTS + [(f"Mirsat {2000 + i}", f"HIP {a}", f"HD {b}", None, None, 100.0 + i) for i, (a, b) in enumerate(numbers)]
    other = lambda n: str(n)[:2] + str((n // 100 + 5) % 10) + str(n)[3:]
    stars = [("typos", other(numbers[50][0]), other(numbers[50][1]), "Mirsat 2950", None, None, str(150.2 * LY))] + [(f"m{i}", str(numbers[i][0]), str(numbers[i][1]), f"Mirsat {2000 + i}", None, None, None) for i in range(100, 160)]
    got = found(spark, hosts, stars)
    assert ("mirsat2050", "typos") in got and len(got) == 61


def test_confidence_is_calibrated_on_planted_pairs(spark):
    """Of the pairs of each confidence about as many are true; stars are corrupted copies of hosts, and strangers."""
    import random

    rng = random.Random(11)
    hosts, stars, truth = [], [], {}
    wrong = lambda s: s[:-2] + rng.choice("0123456789") + s[-1]
    for i in range(1000):
        row = [f"{rng.choice(['Velar', 'TKV', 'Ogr', 'Mirsat'])} {rng.randint(1000, 9999)}", str(rng.randint(1000, 90000)), str(rng.randint(1000, 90000)), rng.uniform(0, 360), rng.uniform(-80, 80), rng.uniform(10, 900)]
        hosts.append((row[0], f"HIP {row[1]}", f"HD {row[2]}", *row[3:]))
        if i % 2:
            keep = lambda v, p, bad: None if rng.random() < p else wrong(v) if rng.random() < bad else v  # noqa: E731, B023
            spot = rng.random()
            ra, dec = (row[3], row[4] + rng.choice([0, 1, 3]) / 3600) if spot < 0.6 else (row[3], row[4] + rng.uniform(-15, 15) / 3600) if spot < 0.8 else (None, None)
            stars.append((f"s{i}", keep(row[1], 0.5, 0.2), keep(row[2], 0.6, 0.2), keep(row[0], 0.4, 0.15), str(ra), str(dec), str(row[5] * rng.uniform(0.9, 1.1) * LY) if rng.random() < 0.8 else None))
            truth[f"s{i}"] = linkage_key(row[0])
        else:
            stars.append((f"n{i}", str(rng.randint(1000, 90000)), None, f"{rng.choice(['Velar', 'TKV'])} {rng.randint(1000, 9999)}" if i % 4 else None, str(row[3]), str(row[4] + rng.uniform(-30, 30) / 3600), str(rng.uniform(10, 900) * LY)))
    got = found(spark, hosts, stars, least=0.0)
    table = {}
    for (host, star), c in got.items():
        table.setdefault(min(9, int(c * 10)), []).append((c, truth.get(star) == host))
    rows = {k: (len(v), sum(c for c, _ in v) / len(v), sum(t for _, t in v) / len(v)) for k, v in sorted(table.items())}
    print(rows)
    gap = sum(n * abs(c - t) for n, c, t in rows.values()) / sum(n for n, _, _ in rows.values())
    assert gap < 0.06 and rows[9][2] > 0.97 and rows[0][2] < 0.1


def linkage_key(name):
    return "".join(filter(str.isalnum, name.lower()))
