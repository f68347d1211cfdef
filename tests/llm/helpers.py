"""Small tables and brute-force versions for the tests of the training-data operators."""

from __future__ import annotations

import collections
import hashlib
import re

DOC_SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, kept string, comp int, n bigint"


def documents(spark, texts, langs=None, sources=None, ids=None):
    """A documents table with extra columns whose names clash with internal ones."""
    rows = []
    for i, text in enumerate(texts):
        rows.append(
            (
                ids[i] if ids else i,
                text,
                langs[i] if langs else "en",
                sources[i] if sources else "s",
                len(text or ""),
                "x",
                7,
                9,
            )
        )
    return spark.createDataFrame(rows, DOC_SCHEMA)


def rows_of(frame, key="doc_id"):
    return {r[key]: r for r in frame.collect()}


def sha(text):
    return hashlib.sha256(text.encode("utf-8")).hexdigest()


BLANKS = " \t\n\x0b\x0c\r"


def line_dedup(docs):
    """{doc_id: (lines, dropped, kept text)} of {doc_id: text}."""
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    holders = collections.defaultdict(set)
    keyed = {}
    for d, text in docs.items():
        keyed[d] = [(line, line.strip(BLANKS).translate(lower)) for line in (text or "").split("\n")]
        for _, key in keyed[d]:
            if len(key) >= 10:
                holders[key].add(d)
    out = {}
    for d, lines in keyed.items():
        kept = [line for line, key in lines if len(key) < 10 or min(holders[key]) == d]
        out[d] = (len(lines), len(lines) - len(kept), "\n".join(kept))
    return out


ASSIGN = re.compile(
    r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII
)


def base_spans(text):
    spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(spans)


def words(text):
    punctuation = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
    return [w for w in (x.lower().strip(punctuation) for x in (text or "").split()) if w]


def shingles(text, n=5):
    w = words(text)
    if not w:
        return collections.Counter()
    return collections.Counter(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1)))


def similarity(a, b):
    a, b = shingles(a), shingles(b)
    union = sum((a | b).values())
    return sum((a & b).values()) / union if union else 0.0


def near_groups(docs, least=0.8):
    """{doc_id: smallest id of its group} by comparing every pair."""
    parent = {d: d for d in docs}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(docs)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            same = (docs[a] or "") == (docs[b] or "")
            if same or similarity(docs[a], docs[b]) >= least:
                ra, rb = sorted((root(a), root(b)))
                parent[rb] = ra
    return {d: root(d) for d in docs}
