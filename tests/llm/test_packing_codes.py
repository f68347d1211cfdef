"""Packing and vector codes against brute force and the tokenizers library."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from helpers import documents
from tokenizers import Tokenizer

from cairnwise.llm import packing, vector_codes
from cairnwise.llm.queries import TOKENIZERS

WORDS = f"{TOKENIZERS}/word_bpe_49k.json"


def packed(spark, texts, ids=None, capacity=4096):
    """Checks one packing and returns its rows."""
    rows = packing.pack_documents(documents(spark, texts, ids=ids), WORDS, 1, capacity).collect()
    lib, want = Tokenizer.from_file(WORDS), Counter()
    for doc, text in zip(ids or range(len(texts)), texts):
        full = lib.encode(text or "", add_special_tokens=False).ids + [1]
        for k in range(0, len(full), capacity):
            part = np.array(full[k : k + capacity], "<u4")
            want[doc, k // capacity, k, len(part), zlib.crc32(part.tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    sequences = defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in sequences.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= capacity
    return rows, sequences


def best_fit(lengths, capacity):
    """Sequences that best fit decreasing makes, one piece at a time."""
    room = []
    for n in sorted(lengths, reverse=True):
        fits = [k for k in range(len(room)) if room[k] >= n]
        if fits:
            room[min(fits, key=lambda k: room[k])] -= n
        else:
            room.append(capacity - n)
    return len(room)


def test_plan_is_best_fit_decreasing():
    for seed in range(40):
        r = random.Random(seed)
        capacity = r.choice([1, 7, 40, 200])
        lengths = [r.randint(1, r.choice([capacity, max(1, capacity // 3)])) for _ in range(r.choice([0, 1, 30, 600]))]
        slots = packing.plan(Counter(lengths), capacity)
        places = defaultdict(list)
        for length, rank, count, each, sequence, offset in zip(*slots.values()):
            for k in range(count):
                places[sequence + k // each].append((offset + k % each * length, length))
        assert Counter(n for p in places.values() for _, n in p) == Counter(lengths)
        for p in places.values():
            p.sort()
            assert [o for o, _ in p] == [sum(n for _, n in p[:i]) for i in range(len(p))]
            assert sum(n for _, n in p) <= capacity
        assert len(places) == best_fit(lengths, capacity)


def test_plan_does_not_grow_with_the_number_of_pieces():
    r = random.Random(1)
    few = {n: r.randint(1, 20) for n in range(1, 4097)}
    slots = {k: len(packing.plan({n: c * k for n, c in few.items()}, 4096)["length"]) for k in (1, 1000, 10**9)}
    assert slots[10**9] < 2 * slots[1000] < 400_000


def test_packing_equals_the_library(spark):
    r = random.Random(3)
    vocabulary = "the of a token, Words. día schön 漢字 <|endoftext|> x1y2 don't ... !!".split()
    texts = [None, "", " \n", "a"] + [" ".join(r.choices(vocabulary, k=r.choice([1, 5, 60, 400]))) for _ in range(120)]
    rows, sequences = packed(spark, texts, capacity=256)
    assert len(sequences) <= math.ceil(sum(x["length"] for x in rows) / 256) + 1


def test_other_tokenizers_encode_whole_texts(spark):
    texts = ["Two  words.", "a,b  c", None, "", " lead"]
    path = f"{TOKENIZERS}/byte_bpe_50k.json"
    rows = packing.pack_documents(documents(spark, texts), path, 1).collect()
    lib = Tokenizer.from_file(path)
    assert {r["doc_id"]: r["length"] for r in rows} == {i: len(lib.encode(t or "").ids) + 1 for i, t in enumerate(texts)}


def test_long_texts_repeats_and_null_ids(spark):
    long = "word " * 30_000
    rows, _ = packed(spark, [long, long, "tie", "tie", None, "x " * 4095], ids=[5, 5, None, None, 1, 2])
    assert sum(x["doc_id"] == 5 for x in rows) == 2 * math.ceil(30_001 / 4096)
    assert [x["piece"] for x in rows if x["doc_id"] == 2] == [0]  # exactly as long as a sequence


def test_empty_table(spark):
    assert packing.pack_documents(documents(spark, ["x"]).where("false"), WORDS, 1).collect() == []


def test_ranks_over_many_tasks(spark):
    frame = documents(spark, ["one two"] * 300 + ["three"] * 200).repartition(7)
    rows = packing.pack_documents(frame, WORDS, 1, capacity=10).collect()
    assert len({(x["sequence_id"], x["offset"]) for x in rows}) == 500
    assert len({x["sequence_id"] for x in rows}) == best_fit([x["length"] for x in rows], 10)


SCHEMA = "vec_id bigint, embedding array<float>, label int, code string, row bigint, part int"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, lab, "x", 1, 2) for i, v, lab in rows], SCHEMA)


def brute_codes(rows, parts=16, entries=64, rounds=2):
    """Counter of result rows, by plain integers."""
    fine = [(i, [math.floor(256 * float(np.float32(x))) for x in v], lab) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    if not fine:
        return Counter()
    raw = {id(q): v for q, (_, v, _) in zip([q[1] for q in fine], [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])])}
    first = sorted(fine, key=lambda r: (r[0] is None, r[0] or 0, raw[id(r[1])]))[:entries]
    wide = len(fine[0][1]) // parts
    cut = lambda v, p: v[p * wide : (p + 1) * wide]
    books = [[cut(r[1], p) for r in first] for p in range(parts)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            groups = defaultdict(list)
            for _, v, _ in fine:
                groups[near(cut(v, p), books[p])[1]].append(cut(v, p))
            books[p] = [[sum(c) // len(groups[k]) for c in zip(*groups[k])] if k in groups else e for k, e in enumerate(books[p])]
    sha = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    coded = [(i, [near(cut(v, p), books[p]) for p in range(parts)], lab) for i, v, lab in fine]
    totals = Counter()
    for _, c, lab in coded:
        totals[lab] += sum(d for d, _ in c)
    return Counter((i, "".join(f"{k:02x}" for _, k in c), sum(d for d, _ in c), totals[lab], sha) for i, c, lab in coded)


def random_vectors(n, seed, low=-1.0, high=1.0, wide=32):
    r = random.Random(seed)
    return [(i, [r.uniform(low, high) for _ in range(wide)], r.choice([None, 1, 2])) for i in range(n)]


@pytest.mark.parametrize(
    "rows",
    [
        random_vectors(150, 1),
        random_vectors(20, 2),  # fewer rows than entries
        random_vectors(90, 3, -3e5, 3e5),  # 64-bit tables
        [(i % 7, [float((i * k) % 3) for k in range(16)], 1) for i in range(200)],  # ties, repeated ids and rows
        random_vectors(70, 4) + [(None, [0.5] * 32, 1), (None, [0.25] * 32, None), (900, None, 1), (901, [None] + [0.0] * 31, 2)]
        + [(902, [math.nan] + [0.0] * 31, 2), (903, [math.inf] + [0.0] * 31, 2), (904, [-0.001] * 32, 2)],
    ],
    ids=["many", "few", "wide values", "ties", "nulls"],
)
def test_codes_equal_brute_force(spark, rows):
    got = vector_codes.compress_vectors(vectors(spark, rows).repartition(5)).collect()
    names = ("vec_id", "code", "error", "label_error", "codebooks_sha256")
    assert Counter(tuple(r[n] for n in names) for r in got) == brute_codes(rows)


def test_empty_and_unusable_vectors(spark):
    assert vector_codes.compress_vectors(vectors(spark, [(1, None, 1), (2, [math.nan] * 16, 1)])).collect() == []
    for rows in ([(1, [0.0] * 16, 1), (2, [0.0] * 32, 1)], [(1, [0.0] * 20, 1)], [(1, [1e30] * 16, 1)]):
        with pytest.raises(Exception, match="components|component"):
            vector_codes.compress_vectors(vectors(spark, rows)).collect()
