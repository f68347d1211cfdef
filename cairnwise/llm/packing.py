"""Best-fit packing of documents into fixed-size sequences, planned on a histogram of lengths.

Documents are tokenised and cut into pieces of at most ``capacity`` ids. How
many sequences are filled in which way depends on the lengths alone, so the
plan is made from the histogram (at most ``capacity`` numbers): lengths in
descending order go to the open sequences with the least room that still fits,
whole runs of equal sequences at once. Every piece has a rank among the pieces
of its length; it takes the planned slot of that rank.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairnwise.llm.token_files import word_encoder
from cairnwise.llm.wordwise import slices, spread
from cairnwise.session import materialise

CAPACITY = 4096
#: Bytes of text that a worker tokenises at once.
SLICE = 16 << 20
_PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, part int, local bigint"


def plan(counts: dict[int, int], capacity: int) -> dict[str, np.ndarray]:
    """Best fit decreasing over the histogram ``{length: pieces}``.

    Returns slots as parallel arrays: the ``count`` pieces of ``length`` whose
    ranks begin at ``rank`` go to consecutive sequences from ``sequence`` on,
    ``each`` of them into one sequence from ``offset`` on. Sequences with the
    same room form runs; a length splits at most one run in three, so the
    number of slots is bounded by ``capacity``, not by the number of pieces.
    """
    room: dict[int, list[tuple[int, int]]] = {}  # free ids -> runs (first sequence, sequences)
    slots, opened = [], 0
    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        for free in sorted(r for r in room if r >= length):
            each = free // length  # best fit comes back to a sequence while it still fits
            runs = room.pop(free)
            while runs and left:
                first, n = runs.pop()
                full = min(n, left // each)
                placed = full * each
                if full:
                    slots.append((length, rank, placed, each, first, capacity - free))
                    room.setdefault(free - each * length, []).append((first, full))
                rest = left - placed
                if full < n and rest:  # rest < each: one sequence takes what is left
                    slots.append((length, rank + placed, rest, rest, first + full, capacity - free))
                    room.setdefault(free - rest * length, []).append((first + full, 1))
                    full, placed = full + 1, left
                if full < n:
                    runs.append((first + full, n - full))
                left, rank = left - placed, rank + placed
            if runs:
                room.setdefault(free, []).extend(runs)
            if not left:
                break
        each = capacity // length
        for n, take in ((left // each, each), (1, left % each)):
            if n and take:
                slots.append((length, rank, n * take, take, opened, 0))
                room.setdefault(capacity - take * length, []).append((opened, n))
                opened, rank = opened + n, rank + n * take
    names = ("length", "rank", "count", "each", "sequence", "offset")
    columns = np.array(sorted(slots), np.int64).reshape(-1, len(names)).T
    return dict(zip(names, columns))


def cut_documents(docs: DataFrame, tokenizer_path: str, end_id: int, capacity: int, id_col: str, text_col: str) -> DataFrame:
    """One row per piece, with its task (``part``) and its number among the task's pieces of that length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in slices(batches, "text", SLICE):
            ids = word_encoder(tokenizer_path).encode(batch.column("text"))
            counts = ids.lengths + 1
            flat = np.full(int(counts.sum()), end_id, "<u4")
            first = np.cumsum(counts) - counts
            flat[spread(first, ids.lengths)] = ids.flat
            pieces = -(-counts // capacity)
            row = np.repeat(np.arange(len(counts)), pieces)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            start = piece * capacity
            length = np.minimum(capacity, counts[row] - start)
            begin = first[row] + start
            crc = [zlib.crc32(flat[a:b]) for a, b in zip(begin.tolist(), (begin + length).tolist())]
            order = np.argsort(length, kind="stable")
            sizes, at, many = np.unique(length[order], return_index=True, return_counts=True)
            local = np.empty(len(length), np.int64)
            local[order] = np.arange(len(length)) - np.repeat(at, many) + np.repeat(seen[sizes], many)
            seen[sizes] += many
            columns = [
                batch.column("doc_id").take(pa.array(row)),
                pa.array(piece, pa.int32()),
                pa.array(start),
                pa.array(length),
                pa.array(crc, pa.int64()),
                pa.array(np.full(len(row), part), pa.int32()),
                pa.array(local),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "start", "length", "ids_crc32", "part", "local"])

    rows = docs.select(docs[id_col].cast("bigint").alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    return rows.mapInArrow(run, _PIECES)


def pack_documents(
    docs: DataFrame,
    tokenizer_path: str,
    end_id: int,
    capacity: int = CAPACITY,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` of every piece.

    A document is its ids and ``end_id``; only one longer than ``capacity`` is
    cut. A null or empty text gives the end id alone. Rows are packed one by
    one: a repeated id or row gives its pieces again, a null id stays null. An
    empty table gives no rows; other columns are not read.

    Ranks are made without sorting: a task numbers its own pieces of each
    length, and the tasks' counts are summed up in front of it. The histogram
    (at most ``capacity`` rows) and the plan pass the driver; pieces do not.
    """
    pieces = materialise(cut_documents(docs, tokenizer_path, end_id, capacity, id_col, text_col), "pieces")
    tasks = pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("many"))
    ahead = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = tasks.select("part", "length", F.coalesce(F.sum("many").over(ahead), F.lit(0)).alias("base"))
    histogram = pieces.groupBy("length").agg(F.count(F.lit(1)).alias("many")).collect()
    slots = plan({r["length"]: r["many"] for r in histogram}, capacity)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Slots are sorted by (length, rank); a piece belongs to the last one that begins at or before it.
        first = np.searchsorted(slots["length"], np.arange(capacity + 2))
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            slot = np.empty(len(length), np.int64)
            order = np.argsort(length, kind="stable")
            sizes, at, many = np.unique(length[order], return_index=True, return_counts=True)
            for size, a, n in zip(sizes.tolist(), at.tolist(), many.tolist()):
                here = order[a : a + n]
                slot[here] = first[size] + np.searchsorted(slots["rank"][first[size] : first[size + 1]], rank[here], "right") - 1
            inside = rank - slots["rank"][slot]
            each = slots["each"][slot]
            columns = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            columns += [pa.array(slots["sequence"][slot] + inside // each), pa.array(slots["offset"][slot] + inside % each * length)]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    ranked = pieces.join(base, ["part", "length"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("local")).alias("rank")
    )
    return ranked.mapInArrow(
        place, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint"
    )
