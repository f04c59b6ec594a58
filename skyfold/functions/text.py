"""Text clean-up as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space of Unicode; F.trim takes U+0020 only.
_SPACE = r"[\s\u00a0\u200b\ufeff\x1c-\x1f]"
# The trailing run is tried from its first character only: long runs inside a text cost no more than their length.
_EDGES = rf"(?U)\A{_SPACE}++|(?={_SPACE})(?<!{_SPACE}){_SPACE}++\z"


def strip(column: Column | str) -> Column:
    """Without Unicode white space at either end; null stays null."""
    text = F.col(column) if isinstance(column, str) else column
    # texts that have none there, however long, are not searched
    edges = F.concat(F.substring(text, 1, 1), F.substring(text, -1, 1))
    return F.when(edges.rlike(f"(?U){_SPACE}"), F.regexp_replace(text, _EDGES, "")).otherwise(text)


def plain_decimal(column: Column | str) -> Column:
    """The double of a trimmed plain decimal (optional sign and fraction), else null."""
    text = strip(column)
    return F.when(text.rlike(r"\A[+-]?[0-9]+(\.[0-9]+)?\z"), text).try_cast("double")


def reference_text(column: Column | str) -> Column:
    """A reference held as text: trimmed and lower-cased; blank and ``-`` are null."""
    text = F.lower(strip(column))
    return F.when(~text.isin("", "-"), text)


def exact_text(*columns: Column) -> Column:
    """One string for several values, equal exactly when all of them are (null equals null only, -0.0 is 0.0)."""
    return F.concat_ws("\x1f", *[F.coalesce(F.concat(F.lit("="), F.regexp_replace(c.cast("string"), "[\x1e\x1f]", "\x1e\x1e")), F.lit("\x1e")) for c in columns])
