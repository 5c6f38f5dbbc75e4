"""Token counts, encoding and decoding against the tokenizers library."""

import random

import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from barspark.llm import bpe, token_counts
from barspark.llm.queries import QUERIES, texts

PATH = public_tokenizers.path("byte_bpe_50k.json")
PARTS = [
    "a", "s", "re", "'", "'s", "'ll", " ", "  ", "\n", "\t", "1", "22", "!", "é", "日本", " ", "<|endoftext|>",
    "<|endoftext", "|>", "\U0001f600", "\U00010d40", "aaaa", "the", "ing", "V", "===", "ࡠ", "\x85", "\x1c",
]
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def made_up(count=400, seed=3):
    draw = random.Random(seed)
    return ["".join(draw.choice(PARTS) for _ in range(draw.randint(0, 40))) for _ in range(count)]


def test_encoder_equals_library(library):
    words = [*made_up(3000), "", "a" * 3001, " " * 5000, "ab" * 2000]
    ids, rows = bpe.Encoder(PATH)(pa.array(words))
    for i, expected in enumerate(library.encode_batch(words, add_special_tokens=False)):
        assert ids[rows[i] : rows[i + 1]].tolist() == expected.ids, repr(words[i])


def test_round_trip_with_nulls_ties_and_extra_columns(spark, library):
    rows = [(i, t, "x") for i, t in enumerate(made_up(200))] + [(500, None, None), (501, "", "y"), (501, "", "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids_ string")
    got = bpe.round_trip(df, PATH).collect()
    assert len(got) == len(rows) and got[0].ids_ == "x"
    for r in got:
        text = r.text or ""
        assert r.ids == library.encode(text, add_special_tokens=False).ids
        assert r.decoded == library.decode(r.ids, skip_special_tokens=False) == text


def test_decode_of_cut_characters(spark, library):
    ids = library.encode("日本語").ids[:1]
    df = spark.createDataFrame([(ids,), (None,), ([],)], "ids array<int>")
    assert [r.decoded for r in bpe.decode(df, PATH).collect()] == [library.decode(ids, skip_special_tokens=False), "", ""]


def test_counts_equal_library(spark, library, monkeypatch):
    monkeypatch.setattr(token_counts, "TABLE", 50)
    words = [*made_up(300), None, "", "x" * 5000]
    df = spark.createDataFrame([(i, t, 7) for i, t in enumerate(words)], "doc_id long, text string, n_bytes int")
    got = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(df, PATH).collect()}
    assert got == {i: len(library.encode(t or "", add_special_tokens=False).ids) for i, t in enumerate(words)}


def test_worker_cache_is_emptied_when_full(library, monkeypatch):
    import numpy as np

    monkeypatch.setattr(token_counts, "CACHE", 60)
    counter = token_counts.Counter(PATH, np.zeros(0, np.uint64), np.zeros(0, np.int32))
    for seed in range(5):
        words = made_up(30, seed)
        assert counter(pa.array(words)).tolist() == [len(e.ids) for e in library.encode_batch(words, add_special_tokens=False)]


def test_empty_tables(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert token_counts.count_tokens(df, PATH).count() == 0
    assert bpe.round_trip(df, PATH).count() == 0


def test_queries_over_whole_tables(spark, library):
    import hashlib

    docs = {r.doc_id: r.text or "" for r in texts(spark, SF).collect()}
    counts = {r.doc_id: r for r in QUERIES["op5_token_counts"](spark, SF).collect()}
    done = {r.doc_id: r for r in QUERIES["op7_bpe"](spark, SF).collect()}
    assert counts.keys() == done.keys() == docs.keys()
    for i, text in docs.items():
        ids = library.encode(text, add_special_tokens=False).ids
        assert (counts[i].n_tokens, counts[i].n_bytes, counts[i].over_limit) == (len(ids), len(text.encode()), len(ids) > 512)
        assert done[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        decoded = library.decode(ids, skip_special_tokens=False)
        assert done[i].decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()
