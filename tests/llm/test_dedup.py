import random

import pytest
from helpers import documents, line_dedup, near_groups, rows_of, sha

from cairnwise.llm import bagminhash, exact_dedup, line_dedup as lines_module
from cairnwise.llm.components import components


def test_exact_duplicates_edges(spark):
    texts = ["a", "", None, "b", "a", "A", "b", "a", "x" * 200_000, "x" * 200_000]
    ids = [5, 1, 2, 3, 9, 4, 3, None, 20, 21]
    docs = documents(spark, texts, ids=ids)
    rows = exact_dedup.exact_duplicates(docs).collect()
    assert len(rows) == len(texts)
    kept = sorted((r["keep_id"], r["group_size"]) for r in rows if r["kept"])
    assert kept == [(2, 2), (3, 2), (4, 1), (9, 3), (21, 2)]
    assert {r["text_sha256"] for r in rows} == {sha(t or "") for t in texts}
    left = exact_dedup.drop_exact_duplicates(docs)
    assert left.columns == docs.columns
    assert sorted(r["doc_id"] for r in left.collect()) == [2, 3, 4, 9, 21]


def test_exact_duplicates_hot_text(spark):
    texts = ["hot"] * 3000 + [f"t{i % 1000}" for i in range(3000)]
    rows = exact_dedup.exact_duplicates(documents(spark, texts), frequent=16).collect()
    assert {(r["keep_id"], r["group_size"]) for r in rows if r["doc_id"] < 3000} == {(2999, 3000)}
    assert all(r["keep_id"] == 5000 + r["doc_id"] % 1000 for r in rows if r["doc_id"] >= 3000)
    docs = documents(spark, texts)
    digests = docs.select("doc_id", exact_dedup.text_digest(docs["text"]).alias("digest"), docs["doc_id"].alias("tag"))
    winners = exact_dedup.frequent_digests(digests, frequent=16).collect()
    assert [(r["winner"]["doc_id"], r["group_size"]) for r in winners] == [(2999, 3000)]


def test_exact_duplicates_empty(spark):
    docs = documents(spark, [])
    assert exact_dedup.exact_duplicates(docs).count() == 0
    assert exact_dedup.drop_exact_duplicates(docs).count() == 0


def test_line_dedup_against_brute_force(spark):
    rng = random.Random(3)
    pool = [f"line number {i} of the pool" for i in range(20)] + ["short", "", "  Line Number 3 of the POOL\t", "é" * 9, "é" * 10]
    texts = ["\n".join(rng.choice(pool) for _ in range(rng.randrange(12))) for _ in range(150)]
    texts += [None, "", "\n\n", "the hot line is everywhere", *["the hot line is everywhere\nx"] * 60, "z" * 100_000 + "\n" + pool[0]]
    docs = documents(spark, texts)
    got = rows_of(lines_module.dedup_lines(docs.repartition(7)))
    want = line_dedup(dict(enumerate(texts)))
    assert {d: (r["n_lines"], r["n_dropped"], r["kept_text"]) for d, r in got.items()} == want


def test_line_dedup_hash_over_partition_borders(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    coalesce = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        texts = ["one line that all of them hold"] * 500 + ["another line of several\nand more text here"] * 300
        got = rows_of(lines_module.dedup_lines(documents(spark, texts)))
        want = line_dedup(dict(enumerate(texts)))
        assert {d: (r["n_lines"], r["n_dropped"], r["kept_text"]) for d, r in got.items()} == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", coalesce)


def test_line_dedup_null_and_repeated_ids(spark):
    texts = ["a line of some length", "a line of some length", "a line of some length", "a line of some length"]
    docs = documents(spark, texts, ids=[None, 4, 4, 6])
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_dropped"]) for r in lines_module.dedup_lines(docs).collect())
    assert got == [(False, 4, 1), (False, 4, 1), (False, 6, 1), (True, 0, 0)]
    assert lines_module.dedup_lines(documents(spark, [])).count() == 0


def _edited(rng, text, share):
    w = text.split()
    for _ in range(int(len(w) * share)):
        w[rng.randrange(len(w))] = f"new{rng.randrange(10**6)}"
    return " ".join(w)


def _prose(rng, n, prefix="w"):
    return " ".join(f"{prefix}{rng.randrange(3000)}" for _ in range(n))


@pytest.fixture(scope="module")
def near_texts():
    rng = random.Random(5)
    texts = []
    for _ in range(25):
        base = _prose(rng, rng.randrange(60, 400))
        texts.append(base)
        for _ in range(rng.randrange(0, 5)):
            texts.append(_edited(rng, base, rng.choice([0.005, 0.01, 0.02, 0.05])))
    hot = _prose(rng, 200, "h")
    texts += [_edited(rng, hot, 0.005) for _ in range(40)]
    passage = _prose(rng, 60, "p")
    texts += [f"{_prose(rng, 120)} {passage}" for _ in range(30)]
    texts += [texts[0], texts[0], "", None, "   ", "one two", "One, two!", "a b c", "a b c d e f", "same " * 3000, "same " * 3000]
    return texts


def test_near_duplicates_against_brute_force(spark, near_texts):
    docs = documents(spark, near_texts)
    got = rows_of(bagminhash.near_duplicates(docs.repartition(5)))
    want = near_groups(dict(enumerate(near_texts)))
    assert {d: r["group_id"] for d, r in got.items()} == want
    assert {d for d, r in got.items() if r["kept"]} == set(want.values())
    left = bagminhash.drop_near_duplicates(docs)
    assert left.columns == docs.columns
    assert {r["doc_id"] for r in left.collect()} == set(want.values())


def test_near_duplicates_edges(spark):
    assert bagminhash.near_duplicates(documents(spark, [])).count() == 0
    docs = documents(spark, ["a b c d e f", "a b c d e f", None, ""], ids=[None, 3, 3, None])
    rows = bagminhash.near_duplicates(docs).collect()
    assert len(rows) == 4 and sum(r["kept"] for r in rows) == 2


def test_signatures_are_unbiased_for_weighted_jaccard():
    import numpy as np

    rng = np.random.default_rng(1)
    m, estimates, truth = 256, [], None
    for trial in range(30):
        names = rng.integers(0, 2**47, 60).astype(np.uint64)
        a, b = np.r_[np.arange(1, 41), np.zeros(20, int)], np.r_[np.zeros(20, int), np.arange(1, 41)]
        a, b = a % 9 + (a > 0), b % 9 + (b > 0)
        truth = np.minimum(a, b).sum() / np.maximum(a, b).sum()
        keys = np.concatenate([names[a > 0], names[b > 0] | np.uint64(1 << 48)])
        counts = np.concatenate([a[a > 0], b[b > 0]])
        order = np.argsort(keys)
        s = bagminhash.bag_min_hash(keys[order], counts[order], 2, m)
        estimates.append((s[0] == s[1]).mean())
    assert abs(np.mean(estimates) - truth) < 4 * (truth * (1 - truth) / m / 30) ** 0.5


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, k) for k in range(101, 160)] + [(200, 201), (201, 200)]
    got = {r["node"]: r["comp"] for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert {got[i] for i in range(61)} == {0} and {got[i] for i in range(100, 160)} == {100} and got[201] == 200


def test_dropping_near_duplicates_with_null_and_shared_ids(spark):
    rng = random.Random(9)
    a, b, c, d, e = (_prose(rng, 120) for _ in range(5))
    near_a = f"{a} more"
    texts, ids = [a, b, c, near_a, d, near_a + " x", e, e, None, ""], [None, None, None, 1, 1, 2, 3, 3, 4, 4]
    docs = documents(spark, texts, ids=ids)
    left = [(r["doc_id"], r["text"]) for r in bagminhash.drop_near_duplicates(docs.repartition(3)).collect()]
    # the group of a keeps id 1's row of it; all other texts are alone
    assert sorted((i is None, i or 0, t or "") for i, t in left) == sorted(
        [(False, 1, near_a), (False, 1, d), (False, 3, e), (False, 4, ""), (True, 0, b), (True, 0, c)]
    )
