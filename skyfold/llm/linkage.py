"""The same stars in two catalogues that share no identifier."""

from __future__ import annotations

import math
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyfold.functions.names import search_key
from skyfold.functions.text import plain_decimal, strip
from skyfold.operators.nearby import on_sky, pairs_within, separation_deg
from skyfold.operators.skew import broadcast_checked
from skyfold.session import materialize

PLACEHOLDERS = ("", "-", "--", "_")
LIGHT_YEARS_PER_PARSEC = 3.26156
REACH_DEG = 20 / 3600  # positions further apart than this speak against a pair
APART = 2  # bits that either vector may have beyond the other: one wrong character changes two bigrams
HOT_PAIRS = 1_000_000  # a block value with more pairs than this is joined in tiles of about as many

# How often each level of a field is met among pairs that are the same star, and among other candidate pairs.
LEVELS: dict[str, dict[str, tuple[float, float]]] = {
    "name": {"equal": (0.86, 0.004), "close": (0.08, 0.2), "near": (0.02, 0.1), "differ": (0.04, 0.696)},
    "component": {"equal": (0.99, 0.55), "conflict": (0.01, 0.45)},
    "hip": {"equal": (0.88, 0.02), "close": (0.04, 0.004), "near": (0.01, 0.08), "differ": (0.07, 0.896)},
    "hd": {"equal": (0.93, 0.01), "close": (0.03, 0.004), "near": (0.01, 0.08), "differ": (0.03, 0.906)},
    "position": {"same": (0.72, 0.02), "close": (0.06, 0.04), "around": (0.215, 0.34), "far": (0.00001, 0.6)},
    "distance": {"equal": (0.80, 0.13), "near": (0.18, 0.1), "differ": (0.02, 0.77)},
}
UNTOLD = {("name", "name")}  # a field by which pairs were chosen tells nothing within its route
PRIOR = {"block": 0.03, "name": 0.001}  # share of true pairs among those that share a value or place, and those that only have close names


def _bit_places(text: Column) -> Column:
    """The bits, 0 to 127, that the text's padded bigrams set; null for null."""
    padded = F.concat(F.lit("^"), text, F.lit("$"))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.char_length(padded) - 1), lambda i: F.pmod(F.xxhash64(F.substr(padded, i, F.lit(2))), F.lit(128)).cast("int")))


def _bits(text: Column) -> Column:
    """Array of two longs: the 128-bit vector of the text's padded bigrams; null for null."""
    at = _bit_places(text)
    word = lambda low: F.aggregate(F.filter(at, lambda b: (b >= low) & (b < low + 64)), F.lit(0).cast("long"), lambda v, b: v.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), b - low)))
    return F.when(text.isNotNull(), F.array(word(0), word(64)))


def _beyond(a: Column, b: Column) -> Column:
    """How many bits of ``a`` are not set in ``b``."""
    return F.bit_count(a[0].bitwiseAND(F.bitwise_not(b[0]))) + F.bit_count(a[1].bitwiseAND(F.bitwise_not(b[1])))


def is_close(a: Column, b: Column) -> Column:
    """Whether either vector has at most ``APART`` bits beyond the other, a Hamming distance of at most twice that."""
    return (_beyond(a, b) <= APART) & (_beyond(b, a) <= APART)


def dice(a: Column, b: Column) -> Column:
    """Dice score of two bit vectors; null if either is missing."""
    common = F.bit_count(a[0].bitwiseAND(b[0])) + F.bit_count(a[1].bitwiseAND(b[1]))
    return F.try_divide(2.0 * common, F.bit_count(a[0]) + F.bit_count(a[1]) + F.bit_count(b[0]) + F.bit_count(b[1]))


def _given(column: str) -> Column:
    text = strip(column)
    return F.when(~text.isin(*PLACEHOLDERS), text)


def _number(column: str) -> Column:
    """The catalogue number at the end of a designation, without leading zeros or a component letter."""
    digits = F.regexp_extract(strip(column), r"(?U)0*([0-9]+)\s*[A-Za-z]?\z", 1)
    return F.when(digits != "", digits)


def _described(df: DataFrame) -> DataFrame:
    """Adds the stem and component of ``name`` and the bit vectors of the attributes."""
    stem = F.regexp_extract("name", r"\A(.*[0-9])([a-h])\z", 1)
    has = F.coalesce(stem != "", F.lit(False))
    df = df.withColumn("component", F.when(has, F.regexp_extract("name", r"\A(.*[0-9])([a-h])\z", 2)).when(F.col("name").isNotNull(), "")).withColumn("stem", F.when(has, stem).otherwise(F.col("name")))
    return df.withColumns({f"{c}_bits": _bits(F.col(c)) for c in ("stem", "hip", "hd")})


def host_records(df: DataFrame) -> DataFrame:
    """(host_key, record, name, hip, hd, ra_deg, dec_deg, parsec): the different descriptions of each host."""
    rows = df.select(search_key("hostname").alias("host_key"), _number("hip_name").alias("hip"), _number("hd_name").alias("hd"), F.col("ra").cast("double").alias("ra_deg"), F.col("dec").cast("double").alias("dec_deg"), F.col("sy_dist").cast("double").alias("parsec"))
    rows = rows.where(F.col("host_key") != "").distinct()
    sky = on_sky(F.col("ra_deg"), F.col("dec_deg"))
    rows = rows.withColumns({c: F.when(sky, F.col(c)) for c in ("ra_deg", "dec_deg")}).withColumn("parsec", F.when(F.col("parsec") > 0, F.col("parsec"))).withColumn("name", F.col("host_key"))
    return _described(rows.withColumn("record", F.md5(F.to_json(F.struct("host_key", "hip", "hd", "ra_deg", "dec_deg", "parsec")))))


def star_records(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(one description per group of stars that are described alike, (wgsn_id, record) of every star)."""
    key = search_key(_given("other_id"))
    rows = df.select("wgsn_id", F.when(key != "", key).alias("name"), _number("hip").alias("hip"), _number("hd").alias("hd"), plain_decimal("ra2000").alias("ra_deg"), plain_decimal("de2000").alias("dec_deg"), (plain_decimal("distance_ly") / LIGHT_YEARS_PER_PARSEC).alias("parsec"))
    sky = on_sky(F.col("ra_deg"), F.col("dec_deg"))
    rows = rows.where("wgsn_id is not null").withColumns({c: F.when(sky, F.col(c)) for c in ("ra_deg", "dec_deg")}).withColumn("parsec", F.when(F.col("parsec") > 0, F.col("parsec")))
    described = ["name", "hip", "hd", "ra_deg", "dec_deg", "parsec"]
    rows = rows.withColumn("record", F.md5(F.to_json(F.struct(*described))))
    return _described(rows.select("record", *described).distinct()), rows.select("wgsn_id", "record").distinct()


FIELDS = ("record", "component", "stem_bits", "hip_bits", "hd_bits", "ra_deg", "dec_deg", "parsec", "stem", "hip", "hd")
BLOCKS = ("stem", "hip", "hd")


def _sides(stars: DataFrame, hosts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The two descriptions with the columns that are compared, as ``s_`` and ``h_``."""
    return stars.select(*[F.col(c).alias(f"s_{c}") for c in FIELDS]), hosts.select("host_key", *[F.col(c).alias(f"h_{c}") for c in FIELDS])


def _blocks(df: DataFrame, side: str) -> DataFrame:
    """The rows once for each attribute they have, with (block, value): the attribute's vector as one key."""
    bits = lambda c: F.col(f"{side}_{c}_bits")
    keys = F.array(*[F.struct(F.lit(i).alias("block"), F.when(bits(c).isNotNull(), F.xxhash64(F.lit(c), bits(c))).alias("value")) for i, c in enumerate(BLOCKS)])
    return df.withColumn("x", F.explode(F.filter(keys, lambda x: x["value"].isNotNull()))).select("*", "x.*").drop("x")


def _agree(c: str) -> Column:
    return F.coalesce(F.col(f"s_{c}_bits") == F.col(f"h_{c}_bits"), F.lit(False))


def _joined_in_tiles(left: DataFrame, right: DataFrame, keys: list[str], left_row: str, right_row: str) -> DataFrame:
    """``left`` joined to ``right`` on ``keys``; keys with very many pairs are cut into tiles of some ``HOT_PAIRS``.

    Each row of one side then has a stripe, and is copied to all stripes of the other. All pairs of all keys are kept.
    """
    n_left, n_right = (df.groupBy(*keys).agg(F.count("*").alias(n)) for df, n in ((left, "_l"), (right, "_r")))
    stripes = lambda n: F.ceil(F.col(n) / math.isqrt(HOT_PAIRS)).cast("int")
    hot = materialize(n_left.join(n_right, keys).where(F.col("_l") * F.col("_r") > HOT_PAIRS).select(*keys, stripes("_l").alias("_left_stripes"), stripes("_r").alias("_right_stripes")))
    if hot.isEmpty():
        return left.join(right, keys)
    known = broadcast_checked(hot, 1_000_000)

    def tiled(df: DataFrame, row: str, own: str, other: str) -> DataFrame:
        marked = df.join(known, keys, "left").withColumn(own, F.coalesce(F.pmod(F.xxhash64(row, F.lit(own)), F.col(f"{own}s")), F.lit(0)).cast("int"))
        return marked.withColumn(other, F.explode(F.sequence(F.lit(0), F.coalesce(F.col(f"{other}s"), F.lit(1)) - 1))).drop("_left_stripes", "_right_stripes")

    # as for close pairs, the planner must not take an exploded side for a small one
    met = tiled(left, left_row, "_left_stripe", "_right_stripe").join(tiled(right, right_row, "_right_stripe", "_left_stripe").hint("merge"), [*keys, "_left_stripe", "_right_stripe"])
    return met.drop("_left_stripe", "_right_stripe")


def _tables(rarest: Column) -> Column:
    """The keys of a vector in the multi-index: groups of its rarest bits, given by their rank, packed into a number.

    Two vectors of at most n bits that have at most two beyond each other share n - 2 bits, so of the six rarest of
    either, four at least are common and met in one table; for smaller vectors the groups are smaller, for every size that
    the other vector may have.
    """
    most = 4 + APART
    keys = F.lit(None).cast("array<long>")
    for n in range(1, most + 1):
        sizes = sorted({max(0, min(4, larger - APART)) for larger in range(n, n + APART + 1)})
        groups = [reduce(Column.__add__, [F.get(rarest, F.lit(i)).cast("long") * (1 << 7 * k) for k, i in enumerate(at)], F.lit(size << 56)) for size in sizes for at in combinations(range(n), size)]
        keys = F.when((F.size(rarest) == n) if n < most else (F.size(rarest) >= n), F.array(*groups)).otherwise(keys)
    return keys


def close_texts(left: DataFrame, right: DataFrame) -> DataFrame:
    """(left_text, right_text) of all pairs of different vectors that are close (``is_close``), from one column ``text`` each.

    Multi-index Hamming search: a vector is entered in a table for each group of four of its six rarest bits, pairs
    that meet in a table are verified on the whole vectors. No close pair escapes. Rarity is counted over all texts
    of both sides. Tables cut from the vector by position would not select: names differ in few of their bits, and
    most are common to many.
    """
    sides = [df.select("text").where("text is not null").distinct().withColumn("places", _bit_places(F.col("text"))) for df in (left, right)]
    seen = sides[0].unionByName(sides[1]).select(F.explode("places").alias("place")).groupBy("place").agg(F.count("*").alias("n"))
    order = [r["place"] for r in seen.orderBy("n", "place").collect()]  # 128 at most
    rank = {place: i for i, place in enumerate(order + [p for p in range(128) if p not in set(order)])}
    ranks = F.array(*[F.lit(rank[p]) for p in range(128)])

    def entered(df: DataFrame, name: str) -> DataFrame:
        rarest = F.slice(F.array_sort(F.transform("places", lambda p: F.get(ranks, p))), 1, 4 + APART)
        # written once: as part of the explosion they would be worked out anew for every table
        ranked = materialize(df.select(F.col("text").alias(name), _bits(F.col("text")).alias(f"{name}_bits"), rarest.alias("rarest")))
        return ranked.select(name, f"{name}_bits", F.explode(_tables(F.col("rarest"))).alias("table"))

    met = _joined_in_tiles(entered(sides[0], "left_text"), entered(sides[1], "right_text"), ["table"], "left_text", "right_text")
    a, b = F.col("left_text_bits"), F.col("right_text_bits")
    return met.where(is_close(a, b) & (a != b)).select("left_text", "right_text").distinct()


def candidate_pairs(stars: DataFrame, hosts: DataFrame) -> DataFrame:
    """Both descriptions of the records that agree in a bit vector, have close names, or whose positions are close.

    A record's vector is the sequence of its attributes' vectors. By the pigeonhole principle two records whose
    vectors differ little have an attribute that differs less: the index looks up equal vectors of each attribute
    and close vectors of the names (``close_texts``), which every host has. Close numbers alone are no candidates:
    catalogue numbers fill their range, so every record has dozens of them. Positions are looked up by their cell and its
    neighbours. Every pair comes once, from the first of these that it meets in. All pairs of all values are kept.
    ``route`` is ``name`` for pairs that only have close names, else ``block``.
    """
    sides = _sides(stars, hosts)
    left, right = (_blocks(df, side) for df, side in zip(sides, "sh"))
    columns = [*[f"s_{c}" for c in FIELDS], "host_key", *[f"h_{c}" for c in FIELDS]]
    first = reduce(lambda rest, i: F.when(_agree(BLOCKS[i]), F.lit(i)).otherwise(rest), reversed(range(len(BLOCKS))), F.lit(None).cast("int"))
    met = _joined_in_tiles(left.drop("block"), right, ["value"], "s_record", "h_record").where(F.col("block") == first).select(*columns)

    names = materialize(close_texts(stars.select(F.col("stem").alias("text")), hosts.select(F.col("stem").alias("text"))).toDF("s_stem", "h_stem"))
    arc = separation_deg(F.col("s_ra_deg"), F.col("s_dec_deg"), F.col("h_ra_deg"), F.col("h_dec_deg"))
    near = _joined_in_tiles(sides[0].join(names, "s_stem"), sides[1].join(names, "h_stem"), ["s_stem", "h_stem"], "s_record", "h_record")
    near = near.where(first.isNull() & F.coalesce(arc > REACH_DEG, F.lit(True))).select(*columns)

    spots = pairs_within(stars.withColumnRenamed("record", "star"), hosts.withColumnRenamed("record", "host"), REACH_DEG, left_id="star", right_id="host").select("star", "host")
    close = spots.join(sides[0], F.col("star") == F.col("s_record")).join(sides[1], F.col("host") == F.col("h_record")).where(first.isNull()).select(*columns)
    return met.unionByName(close).withColumn("route", F.lit("block")).unionByName(near.withColumn("route", F.lit("name")))


def compared(both: DataFrame) -> DataFrame:
    """The candidate pairs with the level of each field; null where a side lacks it."""

    def alike(c: str) -> Column:
        a, b = F.col(f"s_{c}_bits"), F.col(f"h_{c}_bits")
        score = dice(a, b)
        # equal vectors of different texts are only close
        return F.when(score.isNull(), None).when(F.col(f"s_{c}") == F.col(f"h_{c}"), "equal").when(is_close(a, b), "close").when(score >= 0.5, "near").otherwise("differ")

    arc = separation_deg(F.col("s_ra_deg"), F.col("s_dec_deg"), F.col("h_ra_deg"), F.col("h_dec_deg")) * 3600
    off = F.abs(F.ln(F.col("s_parsec") / F.col("h_parsec")))
    return both.select(
        F.col("s_record").alias("star"), F.col("h_record").alias("host"), "host_key", "route", alike("stem").alias("name"),
        F.when(F.col("s_stem") == F.col("h_stem"), F.when(F.col("s_component") == F.col("h_component"), "equal").otherwise("conflict")).alias("component"),
        alike("hip").alias("hip"), alike("hd").alias("hd"),
        F.when(arc.isNull(), None).when(arc <= 2.5, "same").when(arc <= 3.5, "close").when(arc <= REACH_DEG * 3600, "around").otherwise("far").alias("position"),
        F.when(off.isNull(), None).when(off <= 0.08, "equal").when(off <= 0.16, "near").otherwise("differ").alias("distance"), arc.alias("arc_seconds"),
    )


def calibrated(levels: DataFrame, *, rounds: int = 8, anchor: float = 0.5) -> DataFrame:
    """Adds ``confidence``, the posterior that a pair is the same star; a row stands for ``pairs`` pairs.

    Fields weigh by how much oftener a level of their Dice score is met among true pairs than among others. The
    frequencies start at ``LEVELS`` and are re-estimated on all candidate pairs by expectation-maximisation, the starting
    values counting for ``anchor`` times as many pairs as there are, and 200 more. Pairs met by close names only have
    a share of true pairs and frequencies of their own, free but for the 200; their names tell no more about them. Pairs are grouped by their levels, so the table that
    comes to the driver has a row per combination, at most a few thousand whatever the number of pairs.
    """
    fields = list(LEVELS)
    patterns = [(r["route"], tuple(r[f] if (r["route"], f) not in UNTOLD else None for f in fields), r["n"]) for r in levels.groupBy("route", *fields).agg(F.sum("pairs").alias("n")).collect()]
    m = {f: {k: v[0] for k, v in LEVELS[f].items()} for f in fields}
    u = {route: {f: {k: v[1] for k, v in LEVELS[f].items()} for f in fields} for route in PRIOR}
    prior = dict(PRIOR)

    def posterior(route: str, pattern: tuple) -> float:
        odds = math.log(prior[route] / (1 - prior[route])) + sum(math.log(m[f][x] / u[route][f][x]) for f, x in zip(fields, pattern) if x is not None)
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, odds))))

    def shares(i: int, f: str, weighted: list, start: int, anchor: float) -> dict[str, float]:
        seen = {k: sum(n for pattern, n in weighted if pattern[i] == k) for k in LEVELS[f]}
        weight = anchor * sum(seen.values()) + 200
        return {k: (seen[k] + weight * LEVELS[f][k][start]) / (sum(seen.values()) + weight) for k in LEVELS[f]}

    for _ in range(rounds):
        weighted = [(route, pattern, n, posterior(route, pattern)) for route, pattern, n in patterns]
        for route, start in PRIOR.items():
            own, mine = (anchor if route == "block" else 0.0), [w for w in weighted if w[0] == route]
            yes, total = sum(n * p for *_, n, p in mine), sum(n for *_, n, _ in mine)
            prior[route] = (yes + (own * total + 200) * start) / (total * (1 + own) + 200)
            u[route] = {f: shares(i, f, [(pattern, n * (1 - p)) for _, pattern, n, p in mine], 1, own) for i, f in enumerate(fields)}
        m = {f: shares(i, f, [(pattern, n * p) for _, pattern, n, p in weighted], 0, anchor) for i, f in enumerate(fields)}

    def odds(route: str) -> Column:
        terms = [F.lit(math.log(prior[route] / (1 - prior[route])))]
        for f in fields:
            if (route, f) not in UNTOLD:
                terms.append(F.coalesce(*[F.when(F.col(f) == k, math.log(m[f][k] / u[route][f][k])) for k in LEVELS[f]], F.lit(0.0)))
        return reduce(Column.__add__, terms)

    return levels.withColumn("confidence", 1 / (1 + F.exp(-F.when(F.col("route") == "block", odds("block")).otherwise(odds("name")))))


def link(planets: DataFrame, faint_stars: DataFrame, *, least: float = 0.5) -> DataFrame:
    """(host_key, wgsn_id, confidence, arc_seconds): pairs of a host and a star with at least that confidence.

    A star goes to its most likely host (ties to the closer, then to the lesser key); a host may have several
    stars. Placeholders and blanks are missing values; rows without a host name or star id are left out. Stars
    described alike are compared once, and each of them gets a row.
    """
    hosts = materialize(host_records(planets))
    described, members = star_records(faint_stars)
    stars = materialize(described)
    # A star's pairs with the same levels have the same confidence: the closest, then least of them stands for all,
    # and the table has a row per star and combination of levels, not per pair.
    pairs = compared(candidate_pairs(stars, hosts))
    levels = materialize(pairs.groupBy("star", "route", *LEVELS).agg(F.count("*").alias("pairs"), F.min(F.struct(F.coalesce("arc_seconds", F.lit(1e9)).alias("arc"), "host_key")).alias("nearest")))
    scored = calibrated(levels).where(F.col("confidence") >= least)
    best = scored.groupBy("star").agg(F.min(F.struct((-F.col("confidence")).alias("c"), "nearest.arc", "nearest.host_key")).alias("b"))
    best = best.select("star", "b.host_key", (-F.col("b.c")).alias("confidence"), F.when(F.col("b.arc") < 1e9, F.col("b.arc")).alias("arc_seconds"))
    return members.join(best, members["record"] == best["star"]).select("host_key", "wgsn_id", "confidence", "arc_seconds")
