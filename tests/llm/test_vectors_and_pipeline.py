"""The prefix forest against all pairs, and the pipeline stage by stage."""

import random
import re

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from test_similarity import brute_components, brute_contamination
from test_texts import brute_base
from tokenizers import Tokenizer

import corpus_pipeline
from barspark.llm import prefix_forest, secret_scan
from barspark.llm.queries import BPE_FILE, QUERIES, table, toxicity_model
from barspark.llm.toxicity import score

SF = "/root/testdata/sf0.001"


def brute(ids, vectors, query, k):
    scores = {}
    at = {i: v for i, v in zip(ids, vectors, strict=True)}
    for i, v in zip(ids, vectors, strict=True):
        if i != query and len(v) == len(at[query]):
            scores[i] = float(np.einsum("ij,j->i", v[None], at[query])[0])
    return sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:k]


def test_whole_share_is_exact(spark, monkeypatch):
    monkeypatch.setattr(prefix_forest, "BLOCK", 40)
    monkeypatch.setattr(prefix_forest, "QUERIES", 7)
    draw = np.random.default_rng(1)
    vectors = [draw.standard_normal(8) * draw.uniform(0.1, 5) for _ in range(150)]
    vectors[10] = vectors[11] = vectors[12]  # ties
    df = spark.createDataFrame([(i, v.tolist(), "q") for i, v in enumerate(vectors)], "vec_id long, embedding array<double>, asked string")
    got = prefix_forest.nearest(df, F.col("vec_id") % 5 == 0, k=6, share=1.0).collect()
    for q in range(0, 150, 5):
        own = sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])
        assert [(r.vec_id, r.score) for r in own] == brute(range(150), vectors, q, 6)


def test_vectors_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (5, [0.5, 0.5]), (1, None), (2, [0.0, 0.0]), (3, [nan, 1.0]), (4, [inf, 1.0]), (10, [None, 1.0]), (None, [1.0, 1.0]), (6, [1.0, 1.0, 1.0]), (7, []), (5, [0.5, 0.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in prefix_forest.nearest(df, F.col("vec_id") % 5 == 0).collect()]
    assert sorted(got) == [(0, 1, 5, 0.5), (5, 1, 0, 0.5)]
    assert prefix_forest.nearest(df.limit(0), F.lit(True)).count() == 0


def test_recall_of_the_query(spark):
    sf = "/root/testdata/sf0.01"
    rows = table(spark, sf, "embeddings").toPandas()
    ids, vectors = rows["vec_id"].tolist(), np.stack(rows["embedding"]).astype(float)
    got = QUERIES["op1_prefix_forest"](spark, sf).toPandas()
    hit = total = 0
    for q in [i for i in ids if i % 20 == 0]:
        own = got[got.query_id == q].sort_values("rank")
        truth = dict(brute(ids, vectors, q, 20))
        hit, total = hit + len(set(own.vec_id) & set(truth)), total + len(truth)
        assert own["rank"].tolist() == list(range(1, 21)) and own.score.is_monotonic_decreasing
    assert hit / total >= 0.9


@pytest.fixture(scope="module")
def staged(spark, tmp_path_factory):
    """What each stage of the pipeline returns, read again from Parquet."""
    folder = tmp_path_factory.mktemp("pipeline")
    docs, out = table(spark, SF, "documents"), []
    for name, step in corpus_pipeline.STAGES:
        step(spark, docs, SF).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        out.append(docs)
    return out


def texts_of(df):
    return {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}


def test_stages_take_effect_on_what_they_are_given(spark, staged):
    source = table(spark, SF, "documents")
    for df in staged[:-1]:
        assert df.columns == source.columns
    civil, distinct, clean, masked = map(texts_of, staged[:4])
    scored = score(source, toxicity_model(spark, source, SF)).filter("score < 0.7")
    assert civil.keys() == {r.doc_id for r in scored.collect()}
    parts = brute_components(list(civil.items()), 5, 80)
    assert distinct.keys() == {i for i in civil if parts[i][1] == i}
    items = [(r.item_id, r.text) for r in table(spark, SF, "benchmark").collect()]
    judged = brute_contamination(list(distinct.items()), items, 13)
    assert clean.keys() == {i for i, n, hit, _ in judged if not (hit and 20 * hit >= n)}
    assert masked.keys() == clean.keys()
    for i, text in masked.items():
        assert text == secret_scan.mask(clean[i], secret_scan.scan(clean[i]))
        assert not brute_base(re.sub(re.escape(secret_scan.MASK), "\n", text))


def test_last_stage_and_run(spark, staged):
    library = Tokenizer.from_file(public_tokenizers.path(BPE_FILE))
    rows = {r.doc_id: r for r in staged[-1].collect()}
    for i, text in texts_of(staged[3]).items():
        assert rows[i].ids == library.encode(text, add_special_tokens=False).ids and rows[i].reversible
    whole = {(r.doc_id, r.n_tokens) for r in corpus_pipeline.run(spark, SF).collect()}
    assert whole == {(i, r.n_tokens) for i, r in rows.items()}


def test_stages_on_odd_tables(spark):
    long_text = " ".join(random.Random(1).choice(["river", "stone"]) + str(i) for i in range(60_000))
    rows = [(1, None, "en", None, None), (2, "", None, "s", 0), (3, long_text, "en", "s", 9), (4, long_text, "en", "s", 9), (5, "one", "en", "s", 3)]
    odd = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for df in (odd, odd.limit(0)):
        kept = df
        for _, step in corpus_pipeline.STAGES:
            kept = step(spark, kept, SF)
        assert {r.doc_id for r in kept.collect()} == ({1, 2, 3, 5} if df is odd else set())


def test_contamination_is_decided_row_by_row(spark):
    item = table(spark, SF, "benchmark").orderBy("item_id").first().text
    rows = [(None, item), (None, "a calm river"), (1, item), (1, "a grey stone"), (2, "a calm river"), (3, item), (None, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 3) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.keep_uncontaminated(spark, docs, SF)
    assert got.columns == docs.columns
    left = [(None, "a calm river"), (1, "a grey stone"), (2, "a calm river"), (None, None)]
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted(left, key=str)
