import base64
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from skyfold.llm.encoding import VOCABULARY, with_ids, with_token_count
from skyfold.llm.vocabulary import PATTERN, Encoder, PerfectHash, load, merged, read_ranks


@pytest.fixture(scope="module")
def plain():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=read_ranks(VOCABULARY), special_tokens={})


def test_perfect_hash_is_minimal_and_knows_strangers():
    table = PerfectHash([str(i).encode() for i in range(1000)], list(range(1000)))
    assert len(table.keys) == 1000 and all(table.get(str(i).encode()) == i for i in range(1000))
    assert table.get(b"1000") is None and table.get(b"") is None


def test_every_token_merges_to_itself():
    table = load(VOCABULARY)
    some = random.Random(1).sample(sorted(read_ranks(VOCABULARY).items()), 3000)
    assert all(merged(k, table) == [v] and table.get(k) == v for k, v in some)


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=300))
def test_any_text_as_the_public_library_does(plain, text):
    encoder = Encoder(load(VOCABULARY))
    ids = encoder.ids(text)
    assert ids == plain.encode_ordinary(text)
    back = {v: k for k, v in read_ranks(VOCABULARY).items()}
    assert b"".join(back[i] for i in ids).decode() == text
    assert base64


def test_columns(spark, plain):
    texts = [None, "", " ", "Bayer α Cen\n\n  x", "<|endoftext|>", "星" * 50, "a" * 40000, "x y " * 20000, "same", "same"]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, count string")
    got = {r["doc_id"]: r["ids"] for r in with_ids(df, "text").collect()}
    assert got == {i: plain.encode_ordinary(t or "") for i, t in enumerate(texts)}
    counts = {r["doc_id"]: r["n_tokens"] for r in with_token_count(df, "text").collect()}
    assert counts == {i: len(v) for i, v in got.items()}
    assert with_ids(df.limit(0), "text").count() == 0
