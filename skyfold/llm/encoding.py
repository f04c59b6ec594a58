"""Token ids and token counts of a text column."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skyfold.llm.vocabulary import Encoder, load

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def _encoded(df: DataFrame, text: str, path: str, count_only: bool) -> Column:
    # The vocabulary is read here once and sent with its fixed size (some 50,000 tokens); executors need no file.
    table = df.sparkSession.sparkContext.broadcast(load(path))

    @F.pandas_udf(T.IntegerType() if count_only else T.ArrayType(T.IntegerType()))
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = Encoder(table.value)
        for texts in batches:
            if count_only:
                yield pd.Series([len(encoder.ids(t)) for t in texts], dtype="int32")
            else:
                yield pd.Series([encoder.ids(t) for t in texts], dtype=object)

    return encode(F.col(text).cast("string"))


def with_ids(df: DataFrame, text: str, ids: str = "ids", *, vocabulary: str = VOCABULARY) -> DataFrame:
    """``df`` with the token ids of whole texts, without special tokens; null and empty texts get an empty list.

    Pre-tokens that are tokens are resolved by a minimal perfect hash over the vocabulary; the others are merged
    with a heap over linked bytes. Rows stay where they are: nothing is shuffled, repeated texts are encoded each.
    """
    return df.withColumn(ids, _encoded(df, text, vocabulary, False))


def with_token_count(df: DataFrame, text: str, count: str = "n_tokens", *, vocabulary: str = VOCABULARY) -> DataFrame:
    """``df`` with the number of tokens of whole texts, 0 for null."""
    return df.withColumn(count, _encoded(df, text, vocabulary, True))
