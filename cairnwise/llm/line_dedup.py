"""Line-level deduplication that moves line hashes, not lines.

Line hashes are range-partitioned and sorted by hash, document and position;
document and position are part of the range key, so a line found in a third of
all documents is split over partitions. Each partition is read as one stream
that keeps only the first document of the current hash. A hash may run over
partition borders: every partition also reports the rows of its first hash
that it cannot decide and the first document of its last hash (one row per
partition), which settles them. The decisions come back as one compressed
bitmap per document.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnwise.session import materialise

#: ASCII white space that is stripped from a line's ends.
BLANKS = " \t\n\x0b\x0c\r"
LEAST_LENGTH = 10

_DECIDED, _HEAD, _TAIL = 0, 1, 2
_OUT = "kind int, h1 bigint, h2 bigint, doc bigint, version bigint, pos int"
_NO_ID = -(2**63)


def line_key(line: Column) -> Column:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.translate(F.btrim(line, F.lit(BLANKS)), upper, lower)


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows of one partition: dropped rows, undecided head rows, one tail row."""
    head = last = None  # hash of the partition's first group; (h1, h2, first document) of the current group
    names = ["kind", "h1", "h2", "doc", "version", "pos"]
    types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32()]

    def out(kind, h1, h2, doc, version, pos):
        n = len(doc)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.asarray(x), t) for x, t in zip((np.full(n, kind), h1, h2, doc, version, pos), types, strict=True)],
            names=names,
        )

    for batch in batches:
        if not batch.num_rows:
            continue
        h1, h2, doc, version, pos = (batch.column(n).to_numpy() for n in names[1:])
        fresh = np.empty(len(h1), bool)
        fresh[0] = last is None or (h1[0], h2[0]) != last[:2]
        fresh[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        index = np.maximum.accumulate(np.where(fresh, np.arange(len(h1)), -1))
        first = np.where(index >= 0, doc[np.maximum(index, 0)], doc[0] if last is None else last[2])
        if head is None:
            head = (h1[0], h2[0])
        drop = doc != first
        yield out(_DECIDED, h1[drop], h2[drop], doc[drop], version[drop], pos[drop])
        open_ = ~drop & (h1 == head[0]) & (h2 == head[1])
        if open_.any():
            yield out(_HEAD, h1[open_], h2[open_], doc[open_], version[open_], pos[open_])
        last = (h1[-1], h2[-1], first[-1])
    if last is not None:
        yield out(_TAIL, [last[0]], [last[1]], [last[2]], [0], [0])


def _pack(dropped: pd.Series) -> pd.Series:
    def one(positions) -> bytes:
        keep = np.ones(-(-(max(positions) + 1) // 8) * 8, np.uint8)
        keep[positions] = 0
        return zlib.compress(np.packbits(keep, bitorder="little").tobytes())

    return dropped.map(one)


def _unpack(bitmap: pd.Series) -> pd.Series:
    def one(packed):
        if packed is None:
            return None
        return np.unpackbits(np.frombuffer(zlib.decompress(packed), np.uint8), bitorder="little").astype(bool)

    return bitmap.map(one)


def keep_mask(bitmap: Column) -> Column:
    """The bits of a keep bitmap as an array; lines past its end are kept."""
    return F.pandas_udf(_unpack, "array<boolean>")(bitmap)


def _lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(docs[text_col], F.lit(""))
    return docs.select(docs[id_col].cast("bigint").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("version"))


def line_keep_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_LENGTH) -> DataFrame:
    """``doc, version, bitmap`` of every document that loses a line.

    ``doc`` is the id (a null id counts as one that is smaller than all
    others), ``version`` the hash of its text, ``bitmap`` the compressed keep
    bits by line position. Rows that share an id count as one document.
    """
    lines = (
        _lines(docs, id_col, text_col)
        .select(
            F.coalesce("doc_id", F.lit(_NO_ID)).alias("doc"), "version", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line")
        )
        .select("doc", "version", "pos", line_key(F.col("line")).alias("key"))
        .where(F.length("key") >= least)
        .select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"), "doc", "version", "pos")
    )
    order = ["h1", "h2", "doc", "version", "pos"]
    streamed = lines.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_stream, _OUT)
    found = materialise(streamed, "line-decisions")
    tails = found.where(F.col("kind") == _TAIL).groupBy("h1", "h2").agg(F.min("doc").alias("winner"))
    heads = found.where(F.col("kind") == _HEAD).join(F.broadcast(tails), ["h1", "h2"]).where("winner < doc")
    columns = ["doc", "version", "pos"]
    dropped = found.where(F.col("kind") == _DECIDED).select(columns).unionByName(heads.select(columns))
    return dropped.groupBy("doc", "version").agg(F.collect_set("pos").alias("dropped")).select(
        "doc", "version", F.pandas_udf(_pack, "binary")("dropped").alias("bitmap")
    )


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_LENGTH) -> DataFrame:
    """One row per input row: ``doc_id, n_lines, n_dropped, kept_text``.

    A key (the line stripped of ASCII white space, A-Z lower-cased) of at least
    ``least`` code points that several documents hold loses all its lines but
    those of the smallest id. A null or empty text is one empty line. Rows that
    share an id count as one document, and repeated rows lose the same lines.
    Other columns are not read; an empty table gives an empty result.
    """
    rows = _lines(docs, id_col, text_col).withColumn("doc", F.coalesce("doc_id", F.lit(_NO_ID)))
    joined = rows.join(line_keep_bitmaps(docs, id_col, text_col, least), ["doc", "version"], "left")
    lines = joined.select("doc_id", "text", F.split("text", "\n", -1).alias("lines"), keep_mask(F.col("bitmap")).alias("mask"))
    kept = F.when(F.col("mask").isNull(), F.col("lines")).otherwise(
        F.filter("lines", lambda x, i: F.coalesce(F.get(F.col("mask"), i), F.lit(True)))
    )
    return lines.select("doc_id", F.size("lines").cast("bigint").alias("n_lines"), kept.alias("kept"), "text").select(
        "doc_id",
        "n_lines",
        (F.col("n_lines") - F.size("kept")).cast("bigint").alias("n_dropped"),
        F.array_join("kept", "\n").alias("kept_text"),
    )
