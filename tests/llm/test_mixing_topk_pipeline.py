import random

import numpy as np
import pytest
from helpers import documents, rows_of

from cairnwise.llm import langid, mixing, topk


def test_targets_follow_weights_and_limits():
    got = mixing.source_targets({"b": 100, "a": 1000, None: 50, "c": 0})
    # order a, b, c, null with weights 5, 2, 1, 5; the mix wants 1725 words
    assert got["c"] == 0 and got[None] == 100 and got["b"] == 200
    assert got["a"] == pytest.approx(1725 - 300)
    assert mixing.source_targets({}) == {}
    assert mixing.source_targets({"x": 10}) == {"x": 15.0}


def test_mixing_budgets(spark):
    rng = random.Random(6)
    texts = ["word " * rng.randrange(0, 300) for _ in range(900)] + [None, "", "\t\n x y \x0b"]
    sources = [rng.choice(["s1", "s2", "s2", "s2", None, "z"]) for _ in texts]
    docs = documents(spark, texts, sources=sources).repartition(5)
    mix = mixing.mix_sources(docs).collect()
    assert len(mix) == len(texts)
    again = {r["doc_id"]: r["taken"] for r in mixing.mix_sources(docs.repartition(3)).collect()}
    assert again == {r["doc_id"]: r["taken"] for r in mix}
    assert next(r["size"] for r in mix if r["doc_id"] == 902) == 1
    for source in set(sources):
        rows = [r for r in mix if r["source"] == source]
        assert {r["source_size"] for r in rows} == {sum(r["size"] for r in rows)}
        assert sum(r["taken"] for r in rows) == int(rows[0]["target"] + 0.5)
        assert all(0 <= r["taken"] <= 2 * r["size"] for r in rows)
        assert sum(0 < r["taken"] % max(1, r["size"]) for r in rows) <= 1
    whole = mixing.mixed_documents(docs)
    assert whole.columns == docs.columns
    assert whole.count() == sum(r["epochs"] for r in mix)


def test_mixing_ranges_agree_with_one_range(spark, monkeypatch):
    texts = ["w " * (i % 17) for i in range(500)]
    docs = documents(spark, texts, sources=["a" if i % 3 else "b" for i in range(500)])
    one = {r["doc_id"]: r["taken"] for r in mixing.mix_sources(docs).collect()}
    monkeypatch.setattr(mixing, "RANGE_ROWS", 10)
    assert {r["doc_id"]: r["taken"] for r in mixing.mix_sources(docs).collect()} == one


def test_rows_without_ids_spread_and_equal_rows_share_one_place(spark, monkeypatch):
    """A third of all rows without an id, and many copies of one row: ranges stay even, the budget is met exactly."""
    rows = [(i, f"{'w ' * (i % 7)}{i}", "web") for i in range(400)] + [(None, f"{'v ' * (i % 5)}n{i}", "web") for i in range(400)]
    rows += [(None, "same text here", "web")] * 150 + [(7, "a b", None)] * 50
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    monkeypatch.setattr(mixing, "RANGE_ROWS", 20)
    monkeypatch.setattr(mixing, "COPIES", 8)
    mix = mixing.mix_sources(docs).collect()
    assert len(mix) == len(rows)
    for source in ("web", None):
        mine = [r for r in mix if r["source"] == source]
        words = [len(t.split()) for _, t, s in rows if s == source]
        assert sorted(r["size"] for r in mine) == sorted(words) and mine[0]["source_size"] == sum(words)
        assert sum(r["taken"] for r in mine) == int(mine[0]["target"] + 0.5)
        assert all(0 <= r["taken"] <= 2 * r["size"] for r in mine)
    key = lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["source"] or "", r["size"], r["taken"])
    again = mixing.mix_sources(docs.repartition(7)).collect()
    assert sorted(map(key, again)) == sorted(map(key, mix))
    monkeypatch.setattr(mixing, "RANGE_ROWS", 10**9)
    assert sorted(map(key, mixing.mix_sources(docs).collect())) == sorted(map(key, mix))


def test_mixing_edges(spark):
    assert mixing.mix_sources(documents(spark, [])).count() == 0
    same = documents(spark, ["a b", "a b", "a b"], ids=[1, 1, None], sources=[None] * 3)
    rows = mixing.mix_sources(same).collect()
    assert len(rows) == 3 and sum(r["taken"] for r in rows) == 9
    nothing = documents(spark, [None, ""], sources=["a", "b"])
    assert {r["taken"] for r in mixing.mix_sources(nothing).collect()} == {0}
    assert mixing.mixed_documents(nothing).count() == 0


def test_mixed_documents_with_null_and_shared_ids(spark):
    texts = [f"{chr(97 + i)} " * (i + 1) for i in range(12)] + [None, ""]
    docs = documents(spark, texts, sources=["s", "t"] * 7, ids=[None] * 7 + [5] * 7)
    budget = sum(r["epochs"] for r in mixing.mix_sources(docs).collect())
    assert 0 < budget < 24
    got = mixing.mixed_documents(docs).collect()
    assert len(got) == budget
    assert {(r["text"], r["source"]) for r in got} <= set(zip(texts, ["s", "t"] * 7))


def _brute_top(rows, every, k):
    best = {}
    fine = {}
    for i, v in rows:
        if v is not None and all(x is not None and np.isfinite(x) for x in v):
            fine[i] = [int(np.floor(256 * float(np.float32(x)))) for x in v]
    for q in fine:
        if q % every == 0:
            scores = sorted((-sum(a * b for a, b in zip(fine[q], fine[c])), c) for c in fine if c != q)
            best[q] = [(c, -s) for s, c in scores[:k]]
    return best


@pytest.mark.parametrize("block,query_block", [(64, 7), (2048, 512)])
def test_topk_against_brute_force(spark, block, query_block):
    rng = np.random.default_rng(2)
    scale = rng.lognormal(0, 1, 700)[:, None] * np.geomspace(1, 0.01, 12)[None, :]
    vectors = (rng.normal(size=(700, 12)) * scale).astype(np.float32)
    vectors[300:360] = vectors[300]
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    rows += [(700, None), (750, [float("nan")] * 12), (800, [None] * 12), (850, [float("inf")] * 12), (900, [0.0] * 12), (950, [-1.0] * 12)]
    frame = spark.createDataFrame([(i, v, 1.5, "x") for i, v in rows], "vec_id bigint, embedding array<float>, score double, block string")
    got = {}
    for r in topk.top_inner_products(frame, 50, 5, block=block, query_block=query_block).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(got[r["query_id"]])
    assert got == _brute_top(rows, 50, 5)


def test_rows_that_share_an_id(spark):
    """Every row is a candidate and, as a query, has ranks of its own; only its own row is left out."""
    rng = np.random.default_rng(5)
    rows = [(int(i), rng.integers(-3, 4, 6).astype(float).tolist()) for i in rng.integers(0, 160, 400)] + [(50, [1.0] * 6)] * 9
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    want = []
    for a, (q, x) in enumerate(rows):
        if q % 50 == 0:
            scored = sorted((-65536 * int(np.dot(x, y)), c) for b, (c, y) in enumerate(rows) if a != b)
            want += [(q, rank, c, -s) for rank, (s, c) in enumerate(scored[:5], 1)]
    for block, query_block in ((16, 3), (2048, 512)):
        got = [tuple(r) for r in topk.top_inner_products(frame, 50, 5, block=block, query_block=query_block).collect()]
        assert sorted(got) == sorted(want)


def test_unequal_lengths_raise(spark):
    frame = spark.createDataFrame([(0, [1.0]), (1, [1.0, 2.0])], "vec_id bigint, embedding array<float>")
    with pytest.raises(ValueError, match="components"):
        topk.top_inner_products(frame, 50, 5)


def test_language_sample_is_bounded(spark):
    rows = [(i, f"text {i}", "en") for i in range(60)] + [(3, "text 3", "en")] * 3000 + [(None, f"none {i % 40}", "fr") for i in range(2000)]
    known = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    sample = langid.training_sample(known, 50).collect()
    assert {lang: sum(r["lang"] == lang for r in sample) for lang in ("en", "fr")} == {"en": 50, "fr": 40}


def test_topk_edges(spark):
    schema = "vec_id bigint, embedding array<float>"
    assert topk.top_inner_products(spark.createDataFrame([], schema), 50, 5).count() == 0
    few = spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0, 0.0]), (1, [1.0, 0.0]), (None, [9.0, 9.0]), (3, [])], schema)
    got = [tuple(r) for r in topk.top_inner_products(few, 50, 5).collect()]
    assert sorted(got) == [(0, 1, 1, 65536), (0, 2, 1, 65536)]  # rows that share an id are two candidates


def test_pipeline_runs_and_keeps_clean_documents(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, sf_dir)
        assert after.columns == docs.columns, name
        docs = corpus_pipeline.materialise(after, f"test-{name}")
    assert docs.count() > 0
    rows = corpus_pipeline.run(spark, sf_dir)
    assert rows.count() == docs.count()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "exact", "near", "mix", "encode"]


def test_near_copies_and_scores_on_the_given_table(spark, sf_dir):
    from cairnwise.llm import queries

    quality = rows_of(queries.op1_quality(spark, sf_dir))
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").collect()
    good = [quality[r["doc_id"]]["kept"] for r in labels if r["quality"] == 1]
    bad = [quality[r["doc_id"]]["kept"] for r in labels if r["quality"] == 0]
    assert sum(good) >= 0.98 * len(good) and sum(bad) <= 0.5 * len(bad)
    held = [r for r in queries.op10_language_id(spark, sf_dir).collect() if r["held_out"]]
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) >= 0.95 * len(held)
