"""Near duplicates by BagMinHash signatures of word shingles.

A document is the multiset of its shingles of five words. Its signature has m
components; for two documents each agrees with the probability of their
weighted Jaccard similarity, sum of minima over sum of maxima of the counts.
Every shingle owns Poisson processes over (weight, time), one for each dyadic
weight interval [0,1), [1,2), [2,4), ...; a point lands on a random component
and counts if its weight level lies below the shingle's count. Only points up
to a time limit are made: the limit follows from the document's total weight
so that all components are probably filled, and is raised for the documents
where they are not. So the work is about m log m points per document, not m
times its shingles.

Components are banded. In every bucket all members are compared with one
leader: the similarity is estimated from the signatures, then the multiset
overlap is verified exactly. Tight groups are settled by that with one
comparison a member. Buckets that still hold several components form families
(what is connected through such buckets); inside a family the exact overlaps
of all its texts come from products of small incidence matrices. Families are
cut into chunks, and a task sees two chunks at a time and returns only the
links that join components. Chunks of one settled component never meet, so a
large group meets the few texts around it once; f texts of many small
components are dealt f * f / CHUNK times. A family that has grown beyond
FAMILY texts is worked on bucket by bucket in the same way.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairnwise.llm.components import components
from cairnwise.llm.exact_dedup import text_digest
from cairnwise.llm.wordwise import slices, spread, words_of
from cairnwise.session import materialise

WORDS = 5
SIMILARITY = 0.8
BANDS, ROWS = 32, 6
#: Standard errors by which a signature estimate may miss the threshold before a pair is dropped unverified.
MARGIN = 4.5
#: Texts of a chunk, and of the largest family that is compared as a whole.
CHUNK = 128
FAMILY = 8192
#: Components at most that are broadcast.
LARGE = 1000
#: Bytes of text that a worker handles at once.
SLICE = 8 << 20
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"

_A, _B, _GOLD = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * _A
    x = (x ^ (x >> np.uint64(27))) * _B
    return x ^ (x >> np.uint64(31))


def shingle_keys(texts: pa.Array, words: int = WORDS) -> np.ndarray:
    """Sorted keys, one per shingle occurrence: text number << 48 | 48 bits of the shingle's hash.

    A word is what lies between white space, lower-cased, without punctuation
    at its ends; a text of fewer words is one shingle, one without words has
    none. At most 65,536 texts.
    """
    distinct, index, counts = words_of(pc.fill_null(texts, ""), pc.utf8_split_whitespace)
    plain = pc.utf8_trim(pc.utf8_lower(distinct), characters=PUNCTUATION).to_pylist()
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) | 1 if w else 0 for w in plain), np.uint64, len(plain))
    flat = hashes[index]
    doc = np.repeat(np.arange(len(counts)), counts)[flat != 0]
    flat = flat[flat != 0]
    n = np.bincount(doc, minlength=len(counts))
    padded = np.zeros(len(flat) + (words - 1) * len(n), np.uint64)
    begin = np.cumsum(n) - n + (words - 1) * np.arange(len(n))
    padded[spread(begin, n)] = flat
    made = np.where(n >= words, n - words + 1, np.minimum(n, 1))
    at = spread(begin, made)
    value = np.zeros(len(at), np.uint64)
    for k in range(words):
        value = mix(value * _GOLD + padded[at + k])
    key = (np.repeat(np.arange(len(n)), made).astype(np.uint64) << np.uint64(48)) | (value >> np.uint64(16))
    key.sort()
    return key


def weighted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, their counts, and for every occurrence its number among equal ones."""
    fresh = np.ones(len(keys), bool)
    fresh[1:] = keys[1:] != keys[:-1]
    begin = np.flatnonzero(fresh)
    counts = np.diff(np.append(begin, len(keys)))
    return keys[begin], counts, np.arange(len(keys)) - np.repeat(begin, counts)


def bag_min_hash(keys: np.ndarray, counts: np.ndarray, n: int, m: int) -> np.ndarray:
    """Signatures (n, m) of n bags as 32-bit names of the first points; bags without shingles get zeros."""
    doc = (keys >> np.uint64(48)).astype(np.int64)
    name = keys & np.uint64((1 << 48) - 1)
    total = np.bincount(doc, weights=counts, minlength=n)
    best = np.full(n * m, np.inf)
    rows = []  # (bag, seed, rate, lowest level, weight) of every process
    low, length, j = 0, 1, 0
    here = np.arange(len(keys))
    while len(here):
        seed = mix(name[here] * _GOLD + np.uint64(j + 1))
        rows.append((doc[here], seed, np.full(len(here), float(length * m)), np.full(len(here), float(low)), counts[here]))
        low, length, j = low + length, max(1, low + length), j + 1
        here = here[counts[here] > low]
    bag, seed, rate, lows, weight = (np.concatenate(x) for x in zip(*rows)) if rows else [np.zeros(0)] * 5
    limit = (np.log(m) + 2) / np.maximum(total, 1)
    wanted = total > 0
    while wanted.any():
        at = np.flatnonzero(wanted[bag])
        when, k = np.zeros(len(at)), 0
        while len(at):
            k += 1
            random = mix(seed[at] + np.array([k], np.uint64) * _GOLD)
            when = when - np.log1p(-(random >> np.uint64(11)).astype(np.float64) * 2.0**-53) / rate[at]
            go = when <= limit[bag[at]]
            at, when, random = at[go], when[go], random[go]
            more = mix(random + np.uint64(1))
            level = lows[at] + (more >> np.uint64(32)).astype(np.float64) * 2.0**-32 * (rate[at] / m)
            take = level < weight[at]
            place = bag[at] * m + ((more & np.uint64(0xFFFFFFFF)) * np.uint64(m) >> np.uint64(32)).astype(np.int64)
            np.minimum.at(best, place[take], when[take])
        open_ = np.isinf(best.reshape(n, m)).any(axis=1)
        wanted &= open_
        limit = np.where(wanted, limit * 2, limit)
    best[np.isinf(best)] = 0
    return (mix(best.view(np.uint64)) & np.uint64(0xFFFFFFFF)).astype(np.uint32).reshape(n, m)


def band_keys(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    parts = signatures.astype(np.uint64).reshape(len(signatures), bands, rows)
    value = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), parts.shape[:2]).copy()
    for k in range(rows):
        value = mix(value * _GOLD + parts[:, :, k])
    return value.view(np.int64)


def sketches(docs: DataFrame, id_col: str, text_col: str, words: int, bands: int, rows: int) -> DataFrame:
    """``tag, doc_id, digest, bands, signature`` of every row; the signature keeps a byte a component."""
    m = bands * rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE):
            n = batch.num_rows
            keys, counts, _ = weighted(shingle_keys(batch.column("text"), words))
            signatures = bag_min_hash(keys, counts, n, m)
            has = np.zeros(n, bool)
            has[(keys >> np.uint64(48)).astype(np.int64)] = True
            flat = band_keys(signatures, bands, rows)[has].reshape(-1)
            offsets = pa.array(np.concatenate([[0], np.cumsum(has * bands)]), pa.int32())
            columns = [
                batch.column("tag"),
                batch.column("doc_id"),
                batch.column("digest"),
                pa.ListArray.from_arrays(offsets, pa.array(flat)),
                pa.array([s.tobytes() for s in (signatures & 0xFF).astype(np.uint8)], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["tag", "doc_id", "digest", "bands", "signature"])

    made = docs.select(
        F.monotonically_increasing_id().alias("tag"),
        docs[id_col].cast("bigint").alias("doc_id"),
        text_digest(docs[text_col]).alias("digest"),
        F.coalesce(docs[text_col], F.lit("")).alias("text"),
    ).mapInArrow(run, "tag bigint, doc_id bigint, digest binary, bands array<bigint>, signature binary")
    return materialise(made, "sketches")


def shingle_units(texts: DataFrame, words: int) -> DataFrame:
    """``node, units``: one 64-bit unit per shingle occurrence, so that multisets become sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE):
            keys = shingle_keys(batch.column("text"), words)
            _, _, number = weighted(keys)
            unit = mix((keys & np.uint64((1 << 48) - 1)) * _GOLD + number.astype(np.uint64)).view(np.int64)
            n = np.bincount((keys >> np.uint64(48)).astype(np.int64), minlength=batch.num_rows)
            offsets = pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32())
            lists = pa.ListArray.from_arrays(offsets, pa.array(unit))
            yield pa.RecordBatch.from_arrays([batch.column("node"), lists], names=["node", "units"])

    return texts.mapInArrow(run, "node bigint, units array<bigint>")


def _agreement(bands_by_rows: int):
    @F.pandas_udf("double")
    def agree(a: pd.Series, b: pd.Series) -> pd.Series:
        if not len(a):
            return pd.Series([], dtype=float)
        x, y = (np.frombuffer(b"".join(s), np.uint8).reshape(-1, bands_by_rows) for s in (a, b))
        share = (x == y).mean(axis=1)
        return pd.Series((share - 1 / 256) / (1 - 1 / 256))

    return agree


def _linked(pairs: DataFrame, signatures: DataFrame, units: DataFrame, similarity: float, m: int) -> DataFrame:
    """The pairs (a, b) whose exact weighted Jaccard similarity reaches the threshold."""
    least = similarity - MARGIN * (similarity * (1 - similarity) / m) ** 0.5
    side = lambda t, x: t.select(*[F.col(c).alias(x if c == "node" else f"{c}_{x}") for c in t.columns])
    near = pairs.join(side(signatures, "a"), "a").join(side(signatures, "b"), "b")
    near = near.where(_agreement(m)("signature_a", "signature_b") >= least).select("a", "b")
    both = near.join(side(units, "a"), "a").join(side(units, "b"), "b")
    shared = F.size(F.array_intersect("units_a", "units_b"))
    whole = F.size("units_a") + F.size("units_b") - F.col("shared")
    return both.withColumn("shared", shared).where(F.col("shared") >= F.lit(similarity) * whole).select("a", "b")


def _deal(texts: DataFrame) -> DataFrame:
    """``part, i, j, chunk, node, comp``: the texts of a part cut into chunks, in all pairs of chunks that may hold new links.

    A component of CHUNK texts or more has chunks of its own, which never meet
    each other, so a large settled group meets only the few texts around it.
    """
    texts = materialise(texts, "family-texts")
    many = texts.groupBy("part", "comp").agg(F.count(F.lit(1)).alias("n"))
    many = many.withColumn("own", F.when(F.col("n") >= CHUNK, F.col("comp")))
    cut = many.groupBy("part", "own").agg(F.ceil(F.sum("n") / CHUNK).cast("int").alias("chunks"))
    before = Window.partitionBy("part").orderBy("own").rowsBetween(Window.unboundedPreceding, -1)
    cut = cut.select(
        F.col("part").alias("p"),
        F.col("own").alias("o"),
        "chunks",
        F.coalesce(F.sum("chunks").over(before), F.lit(0)).cast("int").alias("first"),
        F.sum("chunks").over(Window.partitionBy("part")).cast("int").alias("total"),
    )
    placed = texts.join(many.drop("n"), ["part", "comp"])
    placed = placed.join(cut, (placed["part"] == cut["p"]) & placed["own"].eqNullSafe(cut["o"]))
    chunk = F.col("first") + F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")
    apart = lambda j: F.col("own").isNull() | (j < F.col("first")) | (j >= F.col("first") + F.col("chunks"))
    others = F.filter(F.sequence(F.lit(0), F.col("total") - 1), apart)
    met = placed.withColumn("chunk", chunk).withColumn("other", F.explode(others))
    return met.select("part", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), "chunk", "node", "comp")


def _compare_families(members: DataFrame, labels: DataFrame, units: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) that join the components left in buckets, by comparing all texts of each family."""
    state = members.join(labels, "node", "left").select("key", "leader", "node", F.coalesce("comp", "node").alias("comp"))
    mixed = state.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high")
    state = materialise(state.join(mixed.select("key"), "key", "left_semi"), "mixed-buckets")
    families = components(state.where("node <> leader").select(F.col("leader").alias("a"), F.col("node").alias("b")))
    sizes = families.groupBy("comp").agg(F.count(F.lit(1)).alias("size"))
    placed = families.withColumnRenamed("comp", "family").join(sizes.withColumnRenamed("comp", "family"), "family")
    comps = state.select("node", "comp").distinct()
    whole = placed.where(F.col("size") <= FAMILY).join(comps, "node").select(F.concat(F.lit("f"), "family").alias("part"), "node", "comp")
    large = state.join(placed.where(F.col("size") > FAMILY).select("node"), "node", "left_semi")
    dealt = _deal(whole.unionByName(large.select(F.concat(F.lit("b"), "key").alias("part"), "node", "comp"))).join(units, "node")

    def compare(group: pa.Table) -> pa.Table:
        node, comp, chunk = (group.column(c).to_numpy() for c in ("node", "comp", "chunk"))
        lists = group.column("units").combine_chunks()
        overlap, size = overlaps(lists.flatten().to_numpy(), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
        linked = overlap >= similarity * (size[:, None] + size[None, :] - overlap) - 1e-9
        linked |= comp[:, None] == comp[None, :]
        if len(np.unique(chunk)) == 2:  # pairs inside a chunk belong to that chunk's own group
            linked &= (chunk[:, None] != chunk[None, :]) | (comp[:, None] == comp[None, :])
        root = spanning_roots(linked)
        apart = comp[root] != comp
        return pa.table({"a": node[root][apart], "b": node[apart]}, schema=pa.schema([("a", pa.int64()), ("b", pa.int64())]))

    return dealt.groupBy("part", "i", "j").applyInArrow(compare, "a bigint, b bigint")


def overlaps(flat: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sizes of the sets and of all their pairwise intersections."""
    n = len(lengths)
    row = np.repeat(np.arange(n), lengths)
    _, index, counts = np.unique(flat, return_inverse=True, return_counts=True)
    shared = counts > 1
    column = (np.cumsum(shared) - 1)[index]
    row, column = row[shared[index]], column[shared[index]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    total, width = np.zeros((n, n)), 1 << 13
    for begin in range(0, int(shared.sum()), width):
        a, b = np.searchsorted(column, [begin, begin + width])
        part = np.zeros((n, width), np.float32)
        part[row[a:b], column[a:b] - begin] = 1
        total += part @ part.T
    np.fill_diagonal(total, lengths)
    return total, lengths.astype(float)


def spanning_roots(linked: np.ndarray) -> np.ndarray:
    """For each row of a symmetric relation the smallest row of its component."""
    n = len(linked)
    label = np.arange(n)
    while True:
        lower = np.minimum(label, np.where(linked, label[None, :], n).min(axis=1))
        lower = lower[lower]
        if (lower == label).all():
            return label
        label = lower


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per input row: ``doc_id, class_id, group_id, group_size, kept``.

    ``class_id`` is the smallest id among equal texts, ``group_id`` the smallest
    id of the connected component of texts linked by a similarity of at least
    ``similarity``, ``group_size`` its rows; the row with the smallest id is
    ``kept``. Texts without words (null counts as empty) form classes of equal
    texts only. A null id ranks above all others; of rows that share the smallest
    id exactly one is kept. Other columns are not read.
    """
    return _near_duplicates(docs, id_col, text_col, **options).drop("digest")


def _near_duplicates(
    docs: DataFrame,
    id_col: str,
    text_col: str,
    words: int = WORDS,
    similarity: float = SIMILARITY,
    bands: int = BANDS,
    rows: int = ROWS,
) -> DataFrame:
    """The columns of ``near_duplicates``, and the text's ``digest``."""
    m = bands * rows
    sketch = sketches(docs, id_col, text_col, words, bands, rows)
    classes = materialise(sketch.groupBy("digest").agg(F.min("tag").alias("node")), "classes")
    firsts = sketch.join(classes.select(F.col("node").alias("tag")), "tag", "left_semi")
    entries = firsts.select(F.explode("bands").alias("key"), F.col("tag").alias("node"))
    shared = entries.groupBy("key").agg(F.min("node").alias("leader"), F.max("node").alias("last")).where("leader <> last")
    members = materialise(entries.join(shared.select("key", "leader"), "key"), "buckets")
    nodes = members.select("node").distinct()
    active = materialise(firsts.join(nodes, firsts["tag"] == nodes["node"], "left_semi"), "active")
    signatures = active.select(F.col("tag").alias("node"), "signature")
    source = docs.select(
        docs[id_col].cast("bigint").alias("doc_id"), text_digest(docs[text_col]).alias("digest"), docs[text_col].alias("text")
    )
    wanted = active.select(F.col("tag").alias("node"), F.col("doc_id").alias("w_id"), F.col("digest").alias("w_digest"))
    texts = source.join(
        wanted, source["doc_id"].eqNullSafe(wanted["w_id"]) & (source["digest"] == wanted["w_digest"])
    ).select("node", F.coalesce("text", F.lit("")).alias("text"))
    units = materialise(shingle_units(texts, words), "units")
    pairs = members.where("node <> leader").select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct()
    edges = materialise(_linked(pairs, signatures, units, similarity, m), "links")
    rest = _compare_families(members, components(edges), units, similarity)
    labels = components(edges.unionByName(materialise(rest, "family-links")))
    grouped = classes.join(labels, "node", "left").select("digest", F.coalesce("comp", "node").alias("comp"))
    member = materialise(sketch.select("tag", "doc_id", "digest").join(grouped, "digest"), "near-groups")
    lowest = F.struct(F.col("doc_id").isNull(), "doc_id", "tag")
    by_comp = member.groupBy("comp").agg(F.min(lowest).alias("low"), F.count(F.lit(1)).alias("group_size"))
    by_class = member.groupBy("digest").agg(F.min("doc_id").alias("class_id"))
    # At most LARGE components can hold so many rows; they are broadcast, so that no task gets all rows of one.
    by_comp = materialise(by_comp, "components")
    least = max(2, sketch.count() // LARGE + 1)
    large = F.broadcast(by_comp.where(F.col("group_size") >= least))
    others = member.join(large.select("comp"), "comp", "left_anti").join(by_comp.where(F.col("group_size") < least), "comp")
    return (
        member.join(large, "comp")
        .unionByName(others)
        .join(by_class, "digest")
        .select(
            "doc_id",
            "class_id",
            F.col("low.doc_id").alias("group_id"),
            "group_size",
            (F.col("tag") == F.col("low.tag")).alias("kept"),
            "digest",
        )
    )


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with its own columns, one row of each group.

    Decisions are joined on id and digest, so rows that share an id, or have
    none, are judged by their texts; rows that repeat in both are reduced to one.
    """
    key = ["__id", "__null", "__digest"]

    def keys(column, digest) -> list:
        return [F.coalesce(column, F.lit(0)).alias("__id"), column.isNull().alias("__null"), digest.alias("__digest")]

    kept = _near_duplicates(docs, id_col, text_col, **options).where("kept").select(*keys(F.col("doc_id"), F.col("digest")))
    own = docs.select(
        F.struct(*[docs[c] for c in docs.columns]).alias("__own"), *keys(docs[id_col].cast("bigint"), text_digest(docs[text_col]))
    )
    # The join and the window share their keys, so texts are shuffled once.
    first = Window.partitionBy(*key).orderBy(F.col("__own")[text_col])
    joined = own.join(kept, key, "left_semi")
    return joined.withColumn("__n", F.row_number().over(first)).where("__n = 1").select("__own.*")
