"""One surviving record per group of duplicates, with a model of how far each source is to be trusted."""

from __future__ import annotations

import json
import math
from collections import defaultdict
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyfold.functions.text import reference_text, strip
from skyfold.operators.skew import broadcast_checked, salted_join
from skyfold.session import materialize

UNKNOWN = "?"


@dataclass(frozen=True)
class Field:
    """A column to resolve and the bounds of its usable values, both inclusive; NaN never is usable."""

    column: str
    low: float
    high: float

    def usable(self) -> Column:
        c = F.col(self.column).cast("double")
        return F.when(c.between(self.low, self.high) & ~F.isnan(c), c)


@dataclass(frozen=True)
class Quality:
    """Sensitivity and false-positive rate by (field, source), and the share of true values by field."""

    sensitivity: dict[str, float]
    false_positive: dict[str, float]
    share: dict[str, float]

    def probability(self, field: Column, claimed: Column, denied: Column) -> Column:
        """Posterior truth of a value claimed by some sources and not by the others that speak on its record."""

        def logit(p: float) -> float:
            return math.log(p / (1 - p))

        tables = [
            {k: math.log(self.sensitivity[k] / self.false_positive[k]) for k in self.sensitivity},
            {k: math.log((1 - self.sensitivity[k]) / (1 - self.false_positive[k])) for k in self.sensitivity},
            {k: logit(v) for k, v in self.share.items()},
        ]
        yes, no, base = (F.from_json(F.lit(json.dumps(t)), "map<string,double>") for t in tables)
        add = lambda table: lambda total, s: total + F.coalesce(F.try_element_at(table, F.concat(field, F.lit("|"), s)), F.lit(0.0))
        odds = F.aggregate(denied, F.aggregate(claimed, F.coalesce(F.try_element_at(base, field), F.lit(0.0)), add(yes)), add(no))
        return 1 / (1 + F.exp(-F.greatest(F.lit(-500.0), F.least(F.lit(500.0), odds))))


def claims(df: DataFrame, key: Column, fields: list[Field], source: str) -> DataFrame:
    """(record_key, field_name, value, source) of every usable value; an unknown source is ``?``. Rows may repeat."""
    name = F.coalesce(F.when(F.lower(strip(source)) != "", F.lower(strip(source))), F.lit(UNKNOWN))
    said = F.filter(F.array(*[F.struct(F.lit(f.column).alias("field_name"), (f.usable() + 0.0).alias("value")) for f in fields]), lambda x: x["value"].isNotNull())
    return df.select(key.alias("record_key"), name.alias("source"), F.explode(said).alias("x")).where("record_key is not null").select("record_key", "source", "x.*")


def facts(claimed: DataFrame) -> DataFrame:
    """(record_key, field_name, value, claimed, denied): who claims a value, and who of the record's other sources does not.

    The reports are shuffled once, combined by value before; the record's sources are gathered from its values.
    """
    by_value = materialize(claimed.groupBy("record_key", "field_name", "value").agg(F.collect_set("source").alias("claimed")))
    speakers = by_value.select("record_key", "field_name", F.explode("claimed").alias("s")).groupBy("record_key", "field_name").agg(F.collect_set("s").alias("speakers"))
    both = salted_join(by_value, speakers, ["record_key", "field_name"], ["value"], "inner")
    return both.select("record_key", "field_name", "value", F.array_sort("claimed").alias("claimed"), F.array_sort(F.array_except("speakers", "claimed")).alias("denied"))


MOST_PATTERNS = 100_000  # rows of the pattern table that are learned from on the driver; more of them stay distributed


def learn_quality(found: DataFrame, *, rounds: int = 10, sensitivity: tuple[float, float] = (50, 50), false_positive: tuple[float, float] = (10, 90), share: tuple[float, float] = (10, 10), most_patterns: int = MOST_PATTERNS) -> Quality:
    """Two-sided source quality by expectation-maximisation over the values' latent truth.

    The pairs are the beta priors' counts. All facts count, grouped by who claims and who denies them: that table
    does not grow with the facts, but with the ways in which sources agree. Up to ``most_patterns`` of its rows are fetched
    once; a larger table stays where it is, and each round is one aggregation over it that brings four numbers per
    field and source to the driver. Both ways give the same numbers.
    """
    patterns = materialize(found.groupBy("field_name", "claimed", "denied").agg(F.count("*").alias("n")))
    few = patterns.limit(most_patterns + 1).collect()
    local = [(r["field_name"], r["claimed"], r["denied"], r["n"]) for r in few] if len(few) <= most_patterns else None
    tables: Quality | None = None
    for _ in range(rounds):
        sums, totals = _expected(local, tables) if local is not None else _expected_at_workers(patterns, tables)
        tables = Quality(
            {k: (s[1] + sensitivity[0]) / (s[0] + sum(sensitivity)) for k, s in sums.items()},
            {k: (s[3] + false_positive[0]) / (s[2] + sum(false_positive)) for k, s in sums.items()},
            {k: (s[0] + share[0]) / (s[1] + sum(share)) for k, s in totals.items()},
        )
    return tables or Quality({}, {}, {})


def _expected(patterns: list[tuple], tables: Quality | None) -> tuple[dict, dict]:
    """Expected counts by field and source (true values, claimed among them, false ones, claimed among them) and by field (true values, values)."""
    sums, totals = defaultdict(lambda: [0.0] * 4), defaultdict(lambda: [0.0] * 2)
    for field, claimed, denied, n in patterns:
        if tables is None:  # at first, a value is as true as the share of sources that claim it
            p = len(claimed) / (len(claimed) + len(denied))
        else:
            odds = math.log(tables.share[field] / (1 - tables.share[field]))
            odds += sum(math.log(tables.sensitivity[f"{field}|{s}"] / tables.false_positive[f"{field}|{s}"]) for s in claimed)
            odds += sum(math.log((1 - tables.sensitivity[f"{field}|{s}"]) / (1 - tables.false_positive[f"{field}|{s}"])) for s in denied)
            p = 1 / (1 + math.exp(-max(-500.0, min(500.0, odds))))
        for sources, yes in ((claimed, 1), (denied, 0)):
            for s in sources:
                row = sums[f"{field}|{s}"]
                for i, x in enumerate((p, p * yes, 1 - p, (1 - p) * yes)):
                    row[i] += n * x
        totals[field][0] += n * p
        totals[field][1] += n
    return sums, totals


def _expected_at_workers(patterns: DataFrame, tables: Quality | None) -> tuple[dict, dict]:
    """``_expected`` of a pattern table too large for the driver."""
    p = F.size("claimed") / (F.size("claimed") + F.size("denied")) if tables is None else tables.probability(F.col("field_name"), F.col("claimed"), F.col("denied"))
    judged = patterns.withColumn("p", p)
    said = F.concat(F.transform("claimed", lambda s: F.struct(s.alias("s"), F.lit(1.0).alias("yes"))), F.transform("denied", lambda s: F.struct(s.alias("s"), F.lit(0.0).alias("yes"))))
    voted = judged.select("field_name", "n", "p", F.explode(F.concat(said, F.array(F.struct(F.lit(None).cast("string").alias("s"), F.lit(0.0).alias("yes"))))).alias("v"))
    true, false = F.col("n") * F.col("p"), F.col("n") * (1 - F.col("p"))
    rows = voted.groupBy("field_name", F.col("v.s").alias("s")).agg(F.sum(true).alias("a"), F.sum(true * F.col("v.yes")).alias("b"), F.sum(false).alias("c"), F.sum(false * F.col("v.yes")).alias("d")).collect()
    sums = {f"{r['field_name']}|{r['s']}": (r["a"], r["b"], r["c"], r["d"]) for r in rows if r["s"] is not None}
    return sums, {r["field_name"]: (r["a"], r["a"] + r["c"]) for r in rows if r["s"] is None}


def truths(df: DataFrame, key: Column, fields: list[Field], source: str) -> DataFrame:
    """(record_key, field_name, value, sources, probability): every claimed value with the probability that it is true.

    Several values of a field may be true; those of 0.5 or more are the ones to retain.
    """
    found = materialize(facts(claims(df, key, fields, source)))
    quality = learn_quality(found)
    return found.withColumn("probability", quality.probability(F.col("field_name"), F.col("claimed"), F.col("denied"))).select("record_key", "field_name", "value", F.col("claimed").alias("sources"), "probability")


def survivors(df: DataFrame, key: Column, fields: list[Field], *, source: str, trust: DataFrame, updated: str, row_id: str) -> DataFrame:
    """(record_key, field_name, row_id, value, rows): the value that survives for each record and field by declared trust.

    Records with fewer than two rows are no duplicates and left out, as are fields without a usable value. The
    declared trust in sources (``trust``: source_code, trust_rank; 1 is the most trusted, sources not in it come last)
    goes first, then the latest ``updated`` (null last), then the least ``row_id``, and the least value where rows
    share that too. That order leaves nothing for the model of ``truths`` to decide; ``judged_survivors`` adds its
    opinion. Null keys, blanks and ``-`` are no record. Repeated rows count as rows. One aggregation, combined
    before its shuffle, so a record with very many rows costs no task more than another.
    """
    order = trust.select(F.lower(strip("source_code")).alias("_code"), F.col("trust_rank").cast("int").alias("_rank")).groupBy("_code").agg(F.min("_rank").alias("_rank"))
    rows = df.select(
        key.alias("record_key"), F.lower(strip(source)).alias("_code"), F.col(updated).cast("timestamp_ntz").alias("_at"), F.col(row_id).cast("long").alias("row_id"), *[f.usable().alias(f.column) for f in fields]
    ).where("record_key is not null")
    ranked = rows.join(broadcast_checked(order, 100_000), "_code", "left")
    age = F.coalesce(-F.unix_micros(F.col("_at").cast("timestamp")), F.lit((1 << 63) - 1))
    best = [F.min(F.when(F.col(f.column).isNotNull(), F.struct(F.coalesce("_rank", F.lit((1 << 31) - 1)).alias("rank"), age.alias("age"), "row_id", F.col(f.column).alias("value")))).alias(f.column) for f in fields]
    chosen = ranked.groupBy("record_key").agg(F.count("*").alias("rows"), *best).where("rows >= 2")
    named = F.array(*[F.struct(F.lit(f.column).alias("field_name"), F.col(f.column).alias("best")) for f in fields])
    return chosen.select("record_key", "rows", F.explode(named).alias("x")).where("x.best is not null").select("record_key", "x.field_name", "x.best.row_id", "x.best.value", "rows")


def judged_survivors(df: DataFrame, key: Column, fields: list[Field], *, source: str, trust: DataFrame, updated: str, row_id: str) -> DataFrame:
    """``survivors`` with ``probability``, what the model of source quality thinks of the value, and ``best_value``, its own choice (ties to the least)."""
    judged = materialize(truths(df, key, fields, source))
    best = judged.groupBy("record_key", "field_name").agg(F.min(F.struct((-F.col("probability")).alias("p"), "value"))["value"].alias("best_value"))
    chosen = survivors(df, key, fields, source=source, trust=trust, updated=updated, row_id=row_id).withColumn("value", F.col("value") + 0.0)
    return chosen.join(judged.drop("sources"), ["record_key", "field_name", "value"], "left").join(best, ["record_key", "field_name"], "left")


HOST_FIELDS = [Field("stellar_temperature_k", 2000, 60000), Field("stellar_mass_solar", 0.01, 150), Field("stellar_radius_solar", 0.01, 2000), Field("stellar_luminosity_log_solar", -6, 7)]


def host_key() -> Column:
    return reference_text("host_id")
