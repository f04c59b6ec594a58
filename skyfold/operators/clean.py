"""Scalar clean-up of staged tables: headers, placeholders, prefixes, lenient numbers."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skyfold.functions.text import strip

# What the naming catalogues write for "no value".
PLACEHOLDERS = ("", "_", "-", "--")


def tidy_headers(df: DataFrame) -> DataFrame:
    """Column names without HTML tags and outer white space."""
    return df.toDF(*[re.sub("<[^>]*>", "", c).strip() for c in df.columns])


def rename_strictly(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Renames columns; a missing one raises, unlike Spark's own renaming."""
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise ValueError(f"columns not found: {', '.join(missing)}")
    return df.withColumnsRenamed(names)


def _strings(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]


def strip_strings(df: DataFrame) -> DataFrame:
    """Every string column without Unicode white space at its ends."""
    return df.withColumns({c: strip(F.col(f"`{c}`")) for c in _strings(df)})


def null_placeholders(df: DataFrame, tokens: tuple[str, ...] = PLACEHOLDERS) -> DataFrame:
    """Placeholders in string columns become null; other cells stay as they are, untrimmed."""
    return df.withColumns({c: F.when(~strip(F.col(f"`{c}`")).isin(*tokens), F.col(f"`{c}`")) for c in _strings(df)})


def without_prefix(column: Column | str, catalogue: str) -> Column:
    """A designation without its catalogue's name, in any case."""
    return F.regexp_replace(column, rf"(?i)^{re.escape(catalogue)}\s*", "")


def captured_long(column: Column | str, pattern: str) -> Column:
    """The first group of a pattern that matches the whole text, as a long; null for anything else."""
    return F.regexp_extract(column, rf"\A(?:{pattern})\z", 1).try_cast("bigint")


def lenient_double(column: Column | str) -> Column:
    """The double a text spells, else null; unlike a bare cast it takes no type suffix such as ``1d``."""
    c = F.col(column) if isinstance(column, str) else column
    return F.when(c.rlike(r"(?i)\A\s*[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:e[+-]?[0-9]+)?\s*\z|\A\s*[+-]?(?:inf|infinity|nan)\s*\z"), c).try_cast("double")


def known(condition: Column) -> Column:
    """A condition whose unknown counts as false."""
    return F.coalesce(condition, F.lit(False))
