"""Language identification by sparse multinomial logistic regression.

Features are TF-IDF weighted character n-grams of the lower-cased text in
which everything but letters is one blank, hashed into a fixed table. The
model is trained with follow-the-regularised-leader (proximal, per-coordinate
rates) under an elastic-net penalty, so most weights are exactly zero; a
temperature fitted on held-back training documents calibrates its scores.

Document frequencies are counted over all training documents. The regression
itself is fitted on a bounded sample of them: at most PER_LANGUAGE documents
of each language, those whose hashed ids are smallest. The table of weights
has a fixed number of slots per language and is broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairnwise.llm.wordwise import slices

SLOT_BITS = 17
ORDERS = (1, 2, 3)
#: Documents of each language that the regression is fitted on, at most.
PER_LANGUAGE = 500
EPOCHS = 4
#: Bytes of text that a worker handles at once.
SLICE = 4 << 20
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """For every code point whether it is a letter."""
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def letter_codes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of the lower-cased texts with other characters as single blanks.

    Every text begins and ends with a blank. Returns the codes, the number of
    codes of each text and whether it has a letter.
    """
    low = pc.fill_null(pc.utf8_lower(texts), "")
    sizes = pc.utf8_length(low).to_numpy(zero_copy_only=False).astype(np.int64)
    raw = np.frombuffer("".join(low.to_pylist()).encode("utf-32-le", "surrogatepass"), "<u4")
    doc = np.repeat(np.arange(len(sizes)), sizes + 2)
    codes = np.full(len(raw) + 2 * len(sizes), 32, np.uint32)
    inner = np.ones(len(codes), bool)
    ends = np.cumsum(sizes + 2)
    inner[ends - 1] = inner[ends - sizes - 2] = False
    codes[inner] = np.where(_letters()[raw], raw, 32)
    again = np.zeros(len(codes), bool)
    again[1:] = (codes[1:] == 32) & (codes[:-1] == 32) & (doc[1:] == doc[:-1])
    codes, doc = codes[~again], doc[~again]
    counts = np.bincount(doc, minlength=len(sizes))
    letters = np.bincount(doc[codes != 32], minlength=len(sizes)) > 0
    return codes, counts, letters


def ngram_slots(codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slots of all n-grams, text after text by order, and the text of each."""
    doc = np.repeat(np.arange(len(counts)), counts)
    value, slots, docs = np.zeros(len(codes), np.uint64), [], []
    for n in range(1, max(ORDERS) + 1):
        value = (value[: len(codes) - n + 1] + codes[n - 1 :].astype(np.uint64) + np.uint64(n)) * _MULTIPLIER
        if n == 1:
            same = codes != 32
        else:
            same = doc[n - 1 :] == doc[: len(doc) - n + 1]
        if n in ORDERS:
            slots.append((value[same] >> np.uint64(64 - SLOT_BITS)).astype(np.int32))
            docs.append(doc[: len(same)][same])
        value = value ^ (value >> np.uint64(29))
    return np.concatenate(slots), np.concatenate(docs)


def document_frequencies(rows: DataFrame) -> tuple[np.ndarray, int]:
    """In how many texts each slot occurs, over all rows; at most 2**SLOT_BITS sums reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(1 << SLOT_BITS, np.int64), 0
        for batch in slices(batches, "text", SLICE):
            codes, counts, _ = letter_codes(batch.column("text"))
            slots, docs = ngram_slots(codes, counts)
            order = np.argsort(docs, kind="stable")
            slots = slots[order]
            ends = np.cumsum(np.bincount(docs, minlength=len(counts)))
            seen = np.zeros(1 << SLOT_BITS, bool)
            begin = 0
            for end in ends.tolist():
                own = slots[begin:end]
                if len(own) < 20_000:
                    df[np.unique(own)] += 1
                else:
                    seen[own] = True
                    df += seen
                    seen[own] = False
                begin = end
            n += len(counts)
        used = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(used, -1), pa.int32()), pa.array(np.append(df[used], n))], names=["slot", "n"]
        )

    found = rows.select("text").mapInArrow(run, "slot int, n bigint").groupBy("slot").agg(F.sum("n").alias("n")).collect()
    df, n = np.zeros(1 << SLOT_BITS, np.int64), 0
    for slot, count in found:
        if slot < 0:
            n = count
        else:
            df[slot] = count
    return df, n


def features(text: str, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slots and TF-IDF values of one text; term frequencies are shares of its n-grams."""
    codes, counts, _ = letter_codes(pa.array([text]))
    slots, _ = ngram_slots(codes, counts)
    used, n = np.unique(slots, return_counts=True)
    return used, n / max(1, len(slots)) * idf[used] * SCALE


#: Brings the shares of n-grams to a size that suits the learning rate.
SCALE = 20.0


def train(
    samples: list[tuple[str, int]], labels: int, idf: np.ndarray, alpha=0.5, beta=1.0, l1=0.02, l2=0.01, epochs=EPOCHS, seed=7
) -> tuple[np.ndarray, float]:
    """Weights (slots, labels) and the temperature.

    One sample in five is held back for the temperature, which minimises their
    negative log likelihood over a grid.
    """
    rng = np.random.default_rng(seed)
    xs = [(*features(t, idf), y) for t, y in samples]
    order = rng.permutation(len(xs))
    held = order[: len(xs) // 5] if len(xs) >= 10 else order
    fit = order[len(xs) // 5 :] if len(xs) >= 10 else order
    z, g2 = np.zeros((len(idf), labels)), np.zeros((len(idf), labels))

    def weights(slots):
        zs, n = z[slots], g2[slots]
        w = -(zs - np.sign(zs) * l1) / ((beta + np.sqrt(n)) / alpha + l2)
        return np.where(np.abs(zs) <= l1, 0.0, w)

    for _ in range(epochs):
        for i in rng.permutation(fit):
            slots, value, y = xs[i]
            w = weights(slots)
            p = softmax(value @ w)
            p[y] -= 1
            grad = value[:, None] * p[None, :]
            root = np.sqrt(g2[slots])
            g2[slots] += grad**2
            z[slots] += grad - (np.sqrt(g2[slots]) - root) / alpha * w
    final = weights(np.arange(len(idf)))
    logits = [(xs[i][1] @ final[xs[i][0]], xs[i][2]) for i in held]
    grid = np.geomspace(0.05, 5, 60)
    losses = [-sum(np.log(max(1e-12, softmax(a / t)[y])) for a, y in logits) for t in grid]
    return final, float(grid[int(np.argmin(losses))]) if logits else 1.0


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def training_sample(known: DataFrame, per_language: int) -> DataFrame:
    """``h, v, lang, text``: at most ``per_language`` rows a language, chosen by a hash of id and text.

    Repeated rows are one row, so the bound holds for all that reaches the
    driver; only hashes are ranked.
    """
    id_hash = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    keyed = known.select(id_hash.alias("h"), F.xxhash64("text").alias("v"), "lang", "text")
    turn = F.row_number().over(Window.partitionBy("lang").orderBy("h", "v"))
    ranked = keyed.select("h", "v", "lang").distinct().withColumn("turn", turn)
    chosen = ranked.where(F.col("turn") <= per_language).select("h", "v", "lang")
    return keyed.join(F.broadcast(chosen), ["h", "v", "lang"], "left_semi").dropDuplicates(["h", "v", "lang"])


def fit_language_model(rows: DataFrame, per_language: int = PER_LANGUAGE) -> tuple[list[str], np.ndarray, float]:
    """Languages, table of idf-weighted weights and temperature from ``doc_id, text, lang``.

    Rows with a null language, or without text, teach nothing; of each language
    at most ``per_language`` different (id, text) rows are learned from.
    """
    known = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    df, n = document_frequencies(known)
    idf = np.where(df > 0, np.log((1 + n) / (1 + df)) + 1, 0.0)
    sample = training_sample(known, per_language)
    got = sorted((r["h"], r["lang"], r["text"]) for r in sample.select("h", "lang", "text").collect())
    languages = sorted({lang for _, lang, _ in got})
    place = {lang: i for i, lang in enumerate(languages)}
    if not languages:
        return [], np.zeros((1 << SLOT_BITS, 0), np.float32), 1.0
    weights, temperature = train([(text, place[lang]) for _, lang, text in got], len(languages), idf)
    return languages, (weights * (idf * SCALE)[:, None]).astype(np.float32), temperature


def predict_languages(
    docs: DataFrame, model: tuple[list[str], np.ndarray, float], id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per input row: ``doc_id, lang_pred, score`` from the text alone.

    ``score`` is the calibrated probability of the predicted language. A null
    text, or one without a letter, is ``und`` with score 0; so is every text when
    nothing was learned. Ties go to the language that sorts first; repeated
    rows give repeated results; other columns are not read.
    """
    languages, table, temperature = model
    shared = docs.sparkSession.sparkContext.broadcast(table)
    names = pa.array(languages + ["und"], pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = shared.value
        for batch in slices(batches, "text", SLICE):
            codes, counts, letters = letter_codes(batch.column("text"))
            n, k = batch.num_rows, len(languages)
            logits = np.zeros((n, max(1, k)))
            slots, at = ngram_slots(codes, counts)
            size = np.bincount(at, minlength=n)
            for j in range(k):
                logits[:, j] = np.bincount(at, weights=weights[:, j][slots], minlength=n) / np.maximum(size, 1)
            p = softmax(logits / temperature)
            ok = letters & (k > 0)
            best = np.where(ok, p.argmax(axis=1), k)
            score = np.where(ok, p.max(axis=1), 0.0)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), names.take(pa.array(best)), pa.array(score)], names=["doc_id", "lang_pred", "score"]
            )

    rows = docs.select(docs[id_col].cast("string").alias("doc_id"), docs[text_col].alias("text"))
    return rows.mapInArrow(run, "doc_id string, lang_pred string, score double").withColumn(
        "doc_id", F.col("doc_id").cast(docs.schema[id_col].dataType)
    )
