import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from orderloom.llm.byte_bpe import PATTERN, Encoder, PerfectHash, encode_texts, load_ranks
from orderloom.llm.queries import vocabulary_path

PATH = vocabulary_path()
needs_vocabulary = pytest.mark.skipif(not os.path.exists(PATH), reason="no vocabulary")


@pytest.fixture(scope="module")
def pair():
    tiktoken = pytest.importorskip("tiktoken")
    ranks = load_ranks(PATH)
    return Encoder(PerfectHash(ranks)), tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_perfect_hash_is_minimal_and_rejects_strangers():
    items = {f"key{i}".encode(): i * 3 for i in range(5000)}
    h = PerfectHash(items)
    assert len(h.keys) == len(items) and set(h.keys) == set(items)
    assert all(h.get(k) == v for k, v in items.items())
    assert all(h.get(f"other{i}".encode()) == -1 for i in range(2000))
    assert PerfectHash({}).get(b"a") == -1 and PerfectHash({b"a": 5}).get(b"a") == 5


@needs_vocabulary
@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text_as_the_public_encoder(pair, text):
    mine, public = pair
    text = text.encode("utf-8", "ignore").decode()
    assert mine.encode(text) == public.encode_ordinary(text)


@needs_vocabulary
def test_frame(spark, pair):
    texts = [None, "", "Hello  world's\n\n 123", "<|endoftext|>", "ééé" * 4000, "🚚 مرحبا नमस्ते", "a" * 20000]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    got = {r.doc_id: r.ids for r in encode_texts(df, PATH).collect()}
    assert got == {i: pair[1].encode_ordinary(t or "") for i, t in enumerate(texts)}
    assert encode_texts(df.limit(0), PATH).count() == 0


@needs_vocabulary
def test_round_trip(pair):
    text = "Ægirsund Crème — 12×50 ½ \t x"
    assert pair[1].decode(pair[0].encode(text)) == text
