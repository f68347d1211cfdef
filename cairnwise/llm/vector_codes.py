"""Compressing vectors to one byte a part, by codebooks of small integer vectors.

Components are quantised to integers, vectors cut into equal parts, and every
part is replaced by the number of its nearest codebook entry. Distances come
from per-dimension value dictionaries: a batch holds few distinct integers in
a dimension, so the squared differences of each of them to all entries are
tabulated once, and a part's distances are gathers from these tables, added up
over its dimensions.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnwise.session import materialise

PARTS = 16
ENTRIES = 64
ROUNDS = 2
SCALE = 256
#: Shares into which the rows of a label are dealt when its total is joined back.
SALTS = 16


def quantised(column: pa.Array, width: int) -> np.ndarray:
    """Integers floor(SCALE * x) of a batch of vectors, one row each."""
    lengths = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    if (lengths != width).any():
        raise ValueError(f"vectors of {width} components expected, found {sorted(set(lengths.tolist()) - {width})}")
    scaled = np.floor(column.flatten().to_numpy().astype(np.float64) * SCALE).reshape(-1, width)
    # Every difference squared and summed over a vector has to fit a 64-bit integer.
    if len(scaled) and np.abs(scaled).max() >= (2**61 / width) ** 0.5:
        raise ValueError("a component is too large for exact 64-bit distances")
    return scaled.astype(np.int64)


def nearest(values: np.ndarray, codebooks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry and squared distance, for every row and part.

    ``codebooks`` is (parts, entries, components). Ties go to the lower index.
    """
    parts, entries, wide = codebooks.shape
    n = len(values)
    spread = max(int(values.max(initial=0)), int(codebooks.max(initial=0))) - min(int(values.min(initial=0)), int(codebooks.min(initial=0)))
    dtype = np.int32 if wide * spread * spread < 2**31 else np.int64
    code, error = np.empty((n, parts), np.int64), np.empty((n, parts), np.int64)
    for p in range(parts):
        total = np.zeros((n, entries), dtype)
        for d in range(wide):
            distinct, index = np.unique(values[:, p * wide + d], return_inverse=True)
            table = ((distinct[:, None] - codebooks[p, :, d][None, :]) ** 2).astype(dtype)
            total += table[index]
        code[:, p] = total.argmin(axis=1)
        error[:, p] = total[np.arange(n), code[:, p]]
    return code, error


def usable(vectors: DataFrame, vector_col: str):
    """True for vectors without null, NaN or infinite components."""
    finite = F.forall(
        vectors[vector_col].cast("array<double>"),
        lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))),
    )
    return vectors[vector_col].isNotNull() & finite


def _sums(rows: DataFrame, codebooks: np.ndarray) -> list:
    """Per part and entry: how many parts it is nearest to, and their componentwise sums."""
    parts, entries, wide = codebooks.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((parts, entries), np.int64)
        sums = np.zeros((parts, entries, wide), object)  # Python integers: a task's sums cannot overflow
        for batch in batches:
            values = quantised(batch.column("vector"), parts * wide)
            code, _ = nearest(values, codebooks)
            for p in range(parts):
                counts[p] += np.bincount(code[:, p], minlength=entries)
                part = np.zeros((entries, wide), np.int64)
                np.add.at(part, code[:, p], values[:, p * wide : (p + 1) * wide])
                sums[p] += part
        p, k = np.nonzero(counts)
        lists = [[str(x) for x in sums[a, b]] for a, b in zip(p, k)]
        columns = [pa.array(p, pa.int32()), pa.array(k, pa.int32()), pa.array(counts[p, k]), pa.array(lists, pa.list_(pa.string()))]
        yield pa.RecordBatch.from_arrays(columns, names=["part", "entry", "many", "sums"])

    made = rows.select("vector").mapInArrow(run, "part int, entry int, many bigint, sums array<string>")
    total = [F.sum(F.col("sums")[d].cast("decimal(38,0)")).alias(f"s{d}") for d in range(wide)]
    return made.groupBy("part", "entry").agg(F.sum("many").alias("many"), *total).collect()


def fit_codebooks(rows: DataFrame, parts: int, entries: int, rounds: int) -> np.ndarray | None:
    """Codebooks (parts, entries, components) after ``rounds`` rounds over all ``rows``; None without rows.

    The first entries are the parts of the rows with the smallest ids (equal and
    null ids by their vectors, nulls last). Only the first rows and one sum per
    part and entry come to the driver.
    """
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(entries).select("vector").collect()
    if not first:
        return None
    width = len(first[0]["vector"])
    if not width or width % parts:
        raise ValueError(f"vectors of {width} components cannot be cut into {parts} equal parts")
    start = quantised(pa.array([r["vector"] for r in first], pa.list_(pa.float64())), width)
    codebooks = np.ascontiguousarray(start.reshape(len(first), parts, -1).transpose(1, 0, 2))
    for _ in range(rounds):
        fresh = codebooks.copy()
        for r in _sums(rows, codebooks):
            fresh[r["part"], r["entry"]] = [int(r[f"s{d}"]) // r["many"] for d in range(codebooks.shape[2])]
        codebooks = fresh
    return codebooks


def compress_vectors(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    parts: int = PARTS,
    entries: int = ENTRIES,
    rounds: int = ROUNDS,
) -> DataFrame:
    """``vec_id, code, error, label_error, codebooks_sha256`` of every usable vector.

    Null vectors and vectors that hold a null, NaN or infinite component are
    left out. Rows are coded one by one, so repeated rows and ids give a row
    each; a null id stays null, null labels count as one label. With fewer rows
    than ``entries`` each gives an entry; an empty table gives no rows. Vectors
    of unequal length, of a length that the parts do not divide, or with
    components beyond exact 64-bit distances raise. Other columns are not read.
    """
    rows = vectors.where(usable(vectors, vector_col)).select(
        vectors[id_col].cast("bigint").alias("vec_id"),
        vectors[label_col].alias("label"),
        vectors[vector_col].cast("array<double>").alias("vector"),
    )
    codebooks = fit_codebooks(rows, parts, entries, rounds)
    if codebooks is None:
        empty = "vec_id bigint, code string, error bigint, label_error bigint, codebooks_sha256 string"
        return vectors.sparkSession.createDataFrame([], empty)
    digest = hashlib.sha256(",".join(map(str, codebooks.reshape(-1).tolist())).encode()).hexdigest()
    digits = np.array([f"{i:02x}" for i in range(codebooks.shape[1])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code, error = nearest(quantised(batch.column("vector"), codebooks.shape[0] * codebooks.shape[2]), codebooks)
            columns = [
                batch.column("vec_id"),
                batch.column("label"),
                pa.array(["".join(x) for x in digits[code]], pa.string()),
                pa.array(error.sum(axis=1)),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "label", "code", "error"])

    kind = rows.schema["label"].dataType.simpleString()
    coded = materialise(rows.mapInArrow(run, f"vec_id bigint, label {kind}, code string, error bigint"), "vector-codes")
    totals = coded.groupBy("label").agg(F.sum("error").alias("label_error"))
    totals = totals.select(F.col("label").alias("of"), "label_error", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("share"))
    dealt = coded.withColumn("salt", (F.monotonically_increasing_id() % SALTS).cast("int"))
    joined = dealt.join(totals, dealt["label"].eqNullSafe(totals["of"]) & (dealt["salt"] == totals["share"]))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
