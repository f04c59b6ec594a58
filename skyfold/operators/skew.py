"""Hot keys: found by counting over fixed hash buckets, then split by a salt."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Salting:
    """Hash buckets whose keys are split in ``salts`` parts. A salt only spreads rows; no row is dropped."""

    hot: tuple[int, ...]
    buckets: int
    salts: int

    def _is_hot(self, keys: list[Column]) -> Column | None:
        if not self.hot:
            return None
        bucket = F.pmod(F.xxhash64(*keys), F.lit(self.buckets))
        return F.call_function("array_contains", F.expr(f"array({','.join(f'{b}L' for b in self.hot)})"), bucket)

    def one(self, keys: list[Column], spread: list[Column]) -> Column:
        """The salt of a row on the large side, chosen by its ``spread`` columns."""
        hot = self._is_hot(keys)
        return F.lit(0) if hot is None else F.when(hot, F.pmod(F.xxhash64(*spread), F.lit(self.salts))).otherwise(0).cast("int")

    def every(self, keys: list[Column]) -> Column:
        """All salts a row of the other side has to be copied to, as an array."""
        hot, none = self._is_hot(keys), F.array(F.lit(0))
        return none if hot is None else F.when(hot, F.sequence(F.lit(0), F.lit(self.salts - 1))).otherwise(none)


def find_hot(df: DataFrame, keys: list[Column], *, buckets: int = 1 << 16, share: int = 2000, least: int = 100_000, salts: int = 48) -> Salting:
    """Buckets holding over ``least`` rows and over a ``share``-th of all rows (so fewer than ``share`` of them).

    Every key with that many rows lies in such a bucket. Counts are combined before the shuffle, and one row of
    at most ``share`` numbers reaches the driver.
    """
    counted = df.select(F.pmod(F.xxhash64(*keys), F.lit(buckets)).alias("b")).groupBy("b").agg(F.count("*").alias("n"))
    found = counted.agg(F.sum("n").alias("total"), F.collect_list(F.when(F.col("n") > least, F.struct("b", "n"))).alias("large")).first()
    hot = sorted(x["b"] for x in found["large"] if x["n"] * share > found["total"])
    return Salting(tuple(hot), buckets, salts)


def broadcast_checked(df: DataFrame, most_rows: int) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``most_rows`` rows; otherwise as it is, for a shuffled join."""
    return F.broadcast(df) if df.limit(most_rows + 1).count() <= most_rows else df


def salted_join(left: DataFrame, right: DataFrame, keys: list[str], spread: list[str], how: str = "left") -> DataFrame:
    """``left`` joined to ``right`` on ``keys``; rows of hot keys of ``left`` are spread over salts by ``spread``.

    ``right`` should hold few rows a key: those of hot keys are copied to every salt. Null keys match nothing.
    Both sides are used as they are, so either should be cheap to compute twice or be materialized.
    """
    columns = [F.col(k) for k in keys]
    hot = find_hot(left, columns)
    if not hot.hot:
        return left.join(right, keys, how)
    salted = left.withColumn("_salt", hot.one(columns, [F.col(c) for c in spread]))
    return salted.join(right.withColumn("_salt", F.explode(hot.every(columns))), [*keys, "_salt"], how).drop("_salt")
