"""Exact top-k inner products over norm-sorted blocks of vectors.

Vectors are made integer, range-partitioned by descending length and packed
into blocks. A rotation by the eigenvectors of the Gram matrix (the right
singular vectors) puts most of a vector's length into its first components, so
a partial product over these, plus the product of the two residual lengths
(Cauchy-Schwarz), bounds the full product. The longest blocks give every query
a first threshold; a block is then sent only to the query blocks that it may
still serve, and inside a block only vectors whose bound reaches a query's
threshold are multiplied in full, in exact integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairnwise.session import materialise

BLOCK = 2048
QUERY_BLOCK = 512
#: Blocks of the longest vectors that give the first thresholds.
HEADS = 2
STEP = 256
#: Tasks at most that multiply pairs of blocks.
PAIR_TASKS = 10_000

_BLOCKS = "block string, longest double, n int, ids binary, rows binary, data binary"
_FOUND = "query_id bigint, query_row bigint, vec_id bigint, row bigint, score bigint"


def integer_vectors(vectors: DataFrame, id_col: str, vector_col: str, scale: float) -> DataFrame:
    """``vec_id, row, x array<bigint>, n2 double``; vectors that are null or hold a null or non-finite component go.

    ``row`` is a number of its own for every row, so that rows may share an id.
    """
    x = vectors[vector_col].cast("array<double>")
    fine = (
        vectors[id_col].isNotNull()
        & x.isNotNull()
        & (F.size(x) > 0)
        & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    )
    whole = vectors.where(fine).select(
        vectors[id_col].cast("bigint").alias("vec_id"), F.transform(x, lambda c: F.floor(c * scale)).alias("x")
    )
    whole = whole.withColumn("row", F.monotonically_increasing_id())
    return whole.withColumn("n2", F.aggregate("x", F.lit(0.0), lambda a, c: a + c.cast("double") * c.cast("double")))


def rotation(vectors: DataFrame, dim: int) -> np.ndarray:
    """Eigenvectors of the Gram matrix, largest first; one dim x dim sum per partition reaches the driver's sum."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram = np.zeros((dim, dim))
        for batch in batches:
            x = _matrix(batch.column("x"), dim).astype(np.float64)
            gram += x.T @ x
        cells = np.arange(dim * dim)
        yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int32()), pa.array(gram.reshape(-1))], names=["cell", "value"])

    rows = vectors.select("x").mapInArrow(run, "cell int, value double").groupBy("cell").agg(F.sum("value").alias("v")).collect()
    gram = np.zeros(dim * dim)
    for r in rows:
        gram[r["cell"]] = r["v"]
    _, basis = np.linalg.eigh(gram.reshape(dim, dim))
    return np.ascontiguousarray(basis[:, ::-1])


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, dim)


def pack_blocks(vectors: DataFrame, dim: int, size: int) -> DataFrame:
    """Blocks of at most ``size`` vectors in order of descending length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, size):
                part = batch.slice(a, min(size, batch.num_rows - a))
                ids, rows = (part.column(c).to_numpy() for c in ("vec_id", "row"))
                row = [
                    [f"{ids[0]}:{rows[0]}:{len(ids)}"],
                    [float(np.sqrt(part.column("n2").to_numpy().max()))],
                    [len(ids)],
                    [ids.astype("<i8").tobytes()],
                    [rows.astype("<i8").tobytes()],
                    [_matrix(part.column("x"), dim).astype("<i8").tobytes()],
                ]
                kinds = [pa.string(), pa.float64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(v, t) for v, t in zip(row, kinds)], names=["block", "longest", "n", "ids", "rows", "data"]
                )

    order = [F.desc("n2"), F.col("vec_id"), F.col("row")]
    return vectors.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, _BLOCKS)


def best_of_block(
    q_rows: np.ndarray, q: np.ndarray, ids: np.ndarray, x_rows: np.ndarray, x: np.ndarray, basis: np.ndarray, k: int, least: np.ndarray, head: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best vectors of one block for each query, as (query row, vector row, score).

    ``x`` is sorted by descending length; ``least`` is each query's threshold,
    which only scores at or above it can pass; it rises while the block is read.
    """
    qf, xf = q.astype(np.float64), x.astype(np.float64)
    qr, xr = qf @ basis, xf @ basis
    q_rest = np.sqrt(np.maximum((qr[:, head:] ** 2).sum(1), 0))
    x_rest = np.sqrt(np.maximum((xr[:, head:] ** 2).sum(1), 0))
    q_norm, x_norm = np.sqrt((qf**2).sum(1)), np.sqrt((xf**2).sum(1))
    least = least.copy()
    slack = 1e-9 * (1 + q_norm)
    rows, cols, scores = [], [], []
    for a in range(0, len(x), STEP):
        part = slice(a, a + STEP)
        alive = np.flatnonzero(q_norm * x_norm[a] * (1 + 1e-9) + slack >= least)
        if not len(alive):
            break
        bound = qr[alive, :head] @ xr[part, :head].T + np.outer(q_rest[alive], x_rest[part])
        margin = slack[alive] * (1 + x_norm[a])
        r, c = np.nonzero(bound + margin[:, None] >= least[alive][:, None])
        r, c = alive[r], c + a
        own = q_rows[r] == x_rows[c]
        r, c = r[~own], c[~own]
        score = np.einsum("ij,ij->i", q[r], x[c])
        rows.append(r)
        cols.append(c)
        scores.append(score)
        flat_r, flat_c, flat_s = map(np.concatenate, (rows, cols, scores))
        order = np.lexsort((x_rows[flat_c], ids[flat_c], -flat_s, flat_r))
        flat_r, flat_c, flat_s = flat_r[order], flat_c[order], flat_s[order]
        rank = np.arange(len(flat_r)) - np.searchsorted(flat_r, flat_r)
        keep = rank < k
        rows, cols, scores = [flat_r[keep]], [flat_c[keep]], [flat_s[keep]]
        full = rank == k - 1
        least[flat_r[full]] = np.maximum(least[flat_r[full]], flat_s[full])
    if not rows:
        none = np.zeros(0, np.int64)
        return none, none, none
    return rows[0], cols[0], scores[0]


def top_inner_products(
    vectors: DataFrame,
    query_every: int,
    k: int,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    scale: float = 256.0,
    head_share: float = 0.25,
    block: int = BLOCK,
    query_block: int = QUERY_BLOCK,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k best vectors of every query.

    Queries are the rows whose id is divisible by ``query_every``; every
    row but the query's own is a candidate. Components become
    floor(scale * x); scores are exact integers (|scale * x| below 2**28), ties go
    to the smaller id. Vectors that are null or empty, have a null id, or hold a
    null or non-finite component take no part; unequal lengths raise. Rows that share
    an id, or repeat, are rows of their own: each is a candidate, and as a
    query each has its own ranks. An empty table gives an empty result.
    """
    spark = vectors.sparkSession
    whole = materialise(integer_vectors(vectors, id_col, vector_col, scale), "vectors")
    lengths = whole.agg(F.min(F.size("x")).alias("low"), F.max(F.size("x")).alias("high")).first()
    if not lengths["high"]:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    if lengths["low"] != lengths["high"]:
        raise ValueError(f"vectors of {lengths['low']} to {lengths['high']} components have no inner product")
    dim = lengths["high"]
    basis = rotation(whole, dim)
    head = max(1, int(dim * head_share))
    blocks = materialise(pack_blocks(whole, dim, block), "blocks")
    queries = materialise(pack_blocks(whole.where(F.col("vec_id") % query_every == 0), dim, query_block), "queries")

    def serve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                q_ids, q_rows, ids, x_rows = (np.frombuffer(row[c], "<i8") for c in ("q_ids", "q_rows", "ids", "rows"))
                q, x = (np.frombuffer(row[c], "<i8").reshape(-1, dim) for c in ("q_data", "data"))
                least = np.frombuffer(row["least"], "<f8") if row["least"] is not None else np.full(len(q_ids), -np.inf)
                r, c, s = best_of_block(q_rows, q, ids, x_rows, x, basis, k, least, head)
                columns = [pa.array(v) for v in (q_ids[r], q_rows[r], ids[c], x_rows[c], s)]
                yield pa.RecordBatch.from_arrays(columns, names=["query_id", "query_row", "vec_id", "row", "score"])

    q = queries.select(
        F.col("block").alias("q_block"), F.col("ids").alias("q_ids"), F.col("rows").alias("q_rows"), F.col("data").alias("q_data")
    )
    heads = blocks.orderBy(F.desc("longest"), "block").limit(HEADS)
    met = q.join(F.broadcast(heads)).withColumn("least", F.lit(None).cast("binary"))
    met = met.select("q_ids", "q_rows", "q_data", "ids", "rows", "data", "least").repartition(F.hash("q_rows", "rows"))
    found = materialise(met.mapInArrow(serve, _FOUND), "first")
    best = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id", "row")
    kth = found.withColumn("r", F.row_number().over(best)).where(F.col("r") == k).select("query_row", F.col("score").alias("kth"))

    def thresholds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                rows = np.frombuffer(row["q_rows"], "<i8")
                known = {t["query_row"]: t["kth"] for t in row["kths"] or []}
                least = np.array([known.get(i, -np.inf) for i in rows.tolist()], np.float64)
                norms = np.sqrt((np.frombuffer(row["q_data"], "<i8").reshape(-1, dim).astype(np.float64) ** 2).sum(1))
                # a block whose longest vector is shorter than this serves none of these queries
                reach = np.where(least > 0, least / np.maximum(norms, 1e-9), 0.0).min() if len(rows) else 0.0
                kinds = [pa.string(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.float64()]
                value = [row["q_block"], row["q_ids"], row["q_rows"], row["q_data"], least.astype("<f8").tobytes(), float(reach) * (1 - 1e-9)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([v], t) for v, t in zip(value, kinds)], names=["q_block", "q_ids", "q_rows", "q_data", "least", "reach"]
                )

    place = materialise(pack_places(q), "places")
    per_block = place.join(kth, "query_row").groupBy("q_block").agg(F.collect_list(F.struct("query_row", "kth")).alias("kths"))
    ready = materialise(
        q.join(per_block, "q_block", "left").mapInArrow(
            thresholds, "q_block string, q_ids binary, q_rows binary, q_data binary, least binary, reach double"
        ),
        "thresholds",
    )
    rest = blocks.join(F.broadcast(heads.select("block")), "block", "left_anti")
    meets = ready.select("q_block", "reach").join(rest.select("block", "longest"), F.col("longest") >= F.col("reach"))
    sent = meets.select("q_block", "block").join(rest, "block").join(ready, "q_block")
    # A number of partitions, so that adaptive execution does not put many pairs into one task.
    held = [f.agg(F.sum("n")).first()[0] or 0 for f in (queries, blocks)]
    pairs = max(1, min(-(-held[0] // query_block) * -(-held[1] // block), PAIR_TASKS))
    sent = sent.select("q_ids", "q_rows", "q_data", "ids", "rows", "data", "least").repartition(pairs, F.hash("q_rows", "rows"))
    later = sent.mapInArrow(serve, _FOUND)
    ranked = found.unionByName(later).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def pack_places(queries: DataFrame) -> DataFrame:
    """``query_row, q_block``: where every query stands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                rows = np.frombuffer(row["q_rows"], "<i8")
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rows), pa.array([row["q_block"]] * len(rows), pa.string())], names=["query_row", "q_block"]
                )

    return queries.select("q_rows", "q_block").mapInArrow(run, "query_row bigint, q_block string")
