"""References to records that do not exist, or did not when the reference was loaded."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyfold.functions.text import reference_text
from skyfold.operators.skew import find_hot
from skyfold.session import materialize

_RUN_BITS = 8  # a run of consecutive keys is cut at multiples of 256


@dataclass(frozen=True)
class Target:
    """A table of records with a key; ``loaded`` and ``deleted`` bound the time in which a row is in force."""

    name: str
    df: DataFrame
    key: str
    loaded: str
    deleted: str | None = None
    as_text: bool = False


@dataclass(frozen=True)
class Reference:
    """A column that refers to a target's key."""

    name: str
    df: DataFrame
    column: str
    row_id: str
    loaded: str
    target: str


def _coded(column: Column, as_text: bool) -> tuple[Column, Column]:
    """(stem, code) of a key, exactly: of a text the number that ends it, without leading zeros and of 18 digits at most, and what goes before."""
    if not as_text:
        return F.lit(""), column.cast("long")
    text = reference_text(column.cast("string"))
    digits = F.regexp_extract(text, r"([1-9][0-9]{0,17})\z", 1)
    return F.left(text, F.length(text) - F.length(digits)), F.when(digits != "", digits.cast("long")).otherwise(F.when(text.isNotNull(), -1)).cast("long")


def key_runs(parents: DataFrame) -> DataFrame:
    """(stem, bucket, run_start, run_end, first_loads) of the integer column ``code``: contiguous keys of a stem share one row.

    ``first_loads`` holds, in key order, when each key of the run was first loaded.
    """
    first = parents.groupBy("stem", F.shiftright("code", _RUN_BITS).alias("bucket"), "code").agg(F.min("loaded").alias("loaded"))
    island = F.col("code") - F.row_number().over(Window.partitionBy("stem", "bucket").orderBy("code"))
    members = F.array_sort(F.collect_list(F.struct("code", "loaded")))
    return (
        first.withColumn("island", island)
        .groupBy("stem", "bucket", "island")
        .agg(F.min("code").alias("run_start"), F.max("code").alias("run_end"), F.transform(members, lambda m: m["loaded"]).alias("first_loads"))
        .drop("island")
    )


def _as_of_runs(refs: DataFrame, runs: DataFrame) -> DataFrame:
    """Each reference with ``inside``, whether the last run that starts at or before it in its bucket reaches it, and ``first``, when its key was first loaded."""
    refs = refs.withColumn("bucket", F.shiftright("code", _RUN_BITS))
    keys = [F.col("stem"), F.col("bucket")]
    hot = find_hot(refs, keys)
    left = refs.select("stem", "bucket", hot.one(keys, [F.col("row_id"), F.col("name")]).alias("salt"), "code", F.struct("name", "row_id", "t").alias("ref"))
    right = runs.select("stem", "bucket", F.explode(hot.every(keys)).alias("salt"), F.col("run_start").alias("code"), F.struct("run_start", "run_end", "first_loads").alias("run"))
    both = left.unionByName(right, allowMissingColumns=True)
    order = Window.partitionBy("stem", "bucket", "salt").orderBy("code", F.col("ref").isNotNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    matched = both.withColumn("run", F.last("run", ignorenulls=True).over(order)).where("ref is not null")
    inside = F.coalesce(F.col("code") <= F.col("run.run_end"), F.lit(False))
    return matched.select("stem", "code", "ref.*", inside.alias("inside"), F.when(inside, F.get("run.first_loads", (F.col("code") - F.col("run.run_start")).cast("int"))).alias("first"))


def _in_force(refs: DataFrame, parents: DataFrame) -> DataFrame:
    """Each reference with (started, open_until) of its key at its own time: rows loaded by then, and the latest end of them."""
    keys = [F.col("stem"), F.col("code")]
    hot = find_hot(refs, keys)
    left = refs.select("stem", "code", hot.one(keys, [F.col("row_id"), F.col("name")]).alias("salt"), F.col("t").alias("at"), F.struct("name", "row_id", "t").alias("ref"))
    forever = F.lit("9999-12-31").cast("timestamp_ntz")
    until = F.max(F.coalesce(F.col("deleted"), forever))  # of rows loaded at the same time the last to end counts
    ends = parents.where("loaded is not null").groupBy("stem", "code", F.col("loaded").alias("at")).agg(until.alias("until"))
    both = left.unionByName(ends.withColumn("salt", F.explode(hot.every(keys))), allowMissingColumns=True)
    so_far = Window.partitionBy("stem", "code", "salt").orderBy(F.col("at").asc_nulls_first(), F.col("ref").isNotNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = both.select("ref", F.count("until").over(so_far).alias("started"), F.max("until").over(so_far).alias("open_until"))
    return both.where("ref is not null").select("ref.*", F.when(F.col("ref.t").isNull(), 0).otherwise(F.col("started")).alias("started"), F.when(F.col("ref.t").isNotNull(), F.col("open_until")).alias("open_until"))


def orphan_references(references: list[Reference], targets: list[Target]) -> DataFrame:
    """(ref_column, child_row_id, reason, load_month) of references with no target row in force at their load time.

    ``missing``: the target has no row of the key; ``deleted``: it has one loaded by then; ``late``: only later
    ones (or ones without a load time). Null keys, and blank or ``-`` in text keys, are no reference. A reference
    without a load time finds nothing in force. Repeated rows are each reported. Times are compared as
    ``timestamp_ntz``; extra columns are never read.

    Keys are integers, or texts that end on one: they are compressed into runs of consecutive numbers of the same
    stem, a reference is matched as of the last run start and is missing beyond the run's end. For targets with
    deletions the references inside a run then look, key by key, at the running maximum of the ends of the rows
    loaded so far. References are read and written once for both steps; redelivered parent rows are combined before
    they are shuffled, hot keys are split by salts, nothing is broadcast.
    """
    found = []
    for target in targets:
        stem, code = _coded(F.col(target.key), target.as_text)
        deleted = F.col(target.deleted).cast("timestamp_ntz") if target.deleted else F.lit(None).cast("timestamp_ntz")
        parents = target.df.select(stem.alias("stem"), code.alias("code"), F.col(target.loaded).cast("timestamp_ntz").alias("loaded"), deleted.alias("deleted")).where("code is not null")
        refs = []
        for r in references:
            if r.target == target.name:
                stem, code = _coded(F.col(r.column), target.as_text)
                refs.append(r.df.select(F.lit(r.name).alias("name"), stem.alias("stem"), code.alias("code"), F.col(r.row_id).cast("long").alias("row_id"), F.col(r.loaded).cast("timestamp_ntz").alias("t")).where("code is not null"))
        if not refs:
            continue
        met = _as_of_runs(materialize(reduce(DataFrame.unionByName, refs)), key_runs(parents))
        if not target.deleted:
            reason = F.when(~F.col("inside"), "missing").when(F.coalesce(F.col("first") <= F.col("t"), F.lit(False)), None).otherwise("late")
            judged = met.select("name", "row_id", "t", reason.alias("reason"))
        else:
            met = materialize(met.drop("first"))
            reason = F.when(F.coalesce(F.col("open_until") > F.col("t"), F.lit(False)), None).when(F.col("started") > 0, "deleted").otherwise("late")
            judged = _in_force(met.where("inside"), parents).select("name", "row_id", "t", reason.alias("reason")).unionByName(met.where("not inside").select("name", "row_id", "t", F.lit("missing").alias("reason")))
        found.append(judged.where("reason is not null").select(F.col("name").alias("ref_column"), F.col("row_id").alias("child_row_id"), "reason", F.date_format("t", "yyyy-MM").alias("load_month")))
    return reduce(DataFrame.unionByName, found)
