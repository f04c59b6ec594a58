"""Search over the published build."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from skyfold.operators import search
from skyfold.sources.published import ALIASES, STARS, open_views


def search_build(spark: SparkSession, root: Path | str, query: str, limit: int = 20) -> DataFrame:
    """``search`` over the stars and aliases that are published under ``root`` now; raises ``NotPublishedError`` if they are not."""
    with open_views(spark, root, {"stars": STARS, "alias": ALIASES}) as views:
        return search.search(views.table("stars"), views.table("alias"), query, limit)
