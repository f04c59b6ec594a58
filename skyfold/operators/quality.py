"""Expectations on outputs, key uniqueness, and joins whose cardinality is checked."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

log = logging.getLogger("skyfold")


class ExpectationError(AssertionError):
    """An output differs from what was expected of it."""


class CardinalityError(ValueError):
    """A join key is not unique on a side where it has to be."""


def expect(name: str, actual: object, expected: object, *, strict: bool = False) -> bool:
    """Whether a figure is as expected; logs it, and raises if ``strict``."""
    if actual == expected:
        log.info("%s: %s as expected", name, actual)
        return True
    log.warning("%s: %s, expected %s", name, actual, expected)
    if strict:
        raise ExpectationError(f"{name}: got {actual}, expected {expected}")
    return False


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys without nulls that occur more than once, with their number."""
    return df.dropna(subset=keys).groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def assert_unique(df: DataFrame, keys: list[str]) -> None:
    """Raises if a key occurs twice; one row reaches the driver."""
    twice = duplicate_keys(df, keys).head(1)
    if twice:
        raise CardinalityError(f"key {keys} is not unique, e.g. {twice[0].asDict()}")


def validated_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left", validate: str = "m:1") -> DataFrame:
    """A join on equal keys (null never matches) after checking the sides that ``validate`` (1:1, m:1, 1:m) calls unique."""
    sides = validate.split(":")
    for side, df in zip(sides, (left, right)):
        if side == "1":
            assert_unique(df, keys)
    return left.join(right, keys, how)
