"""Token ids in bit-plane shuffled binary files.

A file holds the ids of consecutive documents. Ids are cut into blocks of a
fixed number; a block is transposed into byte planes (or bit planes), so that
similar bits lie together, and each plane is compressed with zstandard. A
chunk index (place, planes, number of ids and checksum of every block) and a
document index (id and number of tokens) stand at the file's end, so any block
can be read alone.

Layout, little-endian: ``CWBP``, planes..., document index, chunk index,
trailer ``<QIQII`` = (document index offset, its bytes, number of documents,
chunk index bytes, number of blocks), ``CWBP``.
"""

from __future__ import annotations

import json
import os
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairnwise.llm.wordwise import Ragged, WordCache, ragged_of, slices, spread, sums, words_of
from cairnwise.session import materialise, scratch_path

MAGIC = b"CWBP"
BLOCK = 1 << 16
#: Tasks at most that read files.
READERS = 10_000
#: Pre-tokenizer pattern under which words between white space, and letters before stops, are encoded alone.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_TRAILER = "<QIQII"
_MANIFEST = "file string, first_doc bigint, documents bigint, tokens bigint"


def split_planes(ids: np.ndarray, width: int, bits: bool) -> list[bytes]:
    """``width`` byte planes of the ids, or 8 * width bit planes."""
    raw = ids.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :width]
    if not bits:
        return [np.ascontiguousarray(raw[:, k]).tobytes() for k in range(width)]
    return [np.packbits(raw[:, k] >> b & 1).tobytes() for k in range(width) for b in range(8)]


def join_planes(planes: list[bytes], count: int, width: int, bits: bool) -> np.ndarray:
    raw = np.zeros((count, 4), np.uint8)
    for k in range(width):
        if bits:
            for b in range(8):
                raw[:, k] |= np.unpackbits(np.frombuffer(planes[8 * k + b], np.uint8), count=count) << b
        else:
            raw[:, k] = np.frombuffer(planes[k], np.uint8)
    return raw.reshape(-1).view("<u4")


class TokenFileWriter:
    """Writes one file as a stream; holds one block and the two indexes."""

    def __init__(self, sink, width: int, bits: bool = False, level: int = 3, block: int = BLOCK):
        self.sink, self.width, self.bits, self.block = sink, width, bits, block
        self.zstd = zstandard.ZstdCompressor(level=level)
        self.held: list[np.ndarray] = []
        self.n_held = self.at = 0
        self.docs, self.counts, self.chunks = [], [], []
        self._write(MAGIC)

    def _write(self, data: bytes) -> None:
        self.sink.write(data)
        self.at += len(data)

    def _flush(self, ids: np.ndarray) -> None:
        raw = ids.astype("<u4").tobytes()
        planes = [self.zstd.compress(p) for p in split_planes(ids, self.width, self.bits)]
        self.chunks.append(struct.pack(f"<QII{len(planes)}I", self.at, len(ids), zlib.crc32(raw), *map(len, planes)))
        for p in planes:
            self._write(p)

    def add(self, doc_ids: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> None:
        self.docs.append(doc_ids.astype("<i8"))
        self.counts.append(counts.astype("<u4"))
        self.held.append(ids)
        self.n_held += len(ids)
        if self.n_held >= self.block:
            flat = np.concatenate(self.held)
            whole = len(flat) // self.block * self.block
            for a in range(0, whole, self.block):
                self._flush(flat[a : a + self.block])
            self.held, self.n_held = [flat[whole:]], len(flat) - whole

    def close(self) -> None:
        if self.n_held:
            self._flush(np.concatenate(self.held))
        doc_at, n_docs = self.at, sum(map(len, self.docs))
        packed = self.zstd.compress(np.concatenate(self.docs).tobytes() + np.concatenate(self.counts).tobytes())
        self._write(packed)
        index = struct.pack("<BB", self.width, self.bits) + b"".join(self.chunks)
        self._write(index)
        self._write(struct.pack(_TRAILER, doc_at, len(packed), n_docs, len(index), len(self.chunks)) + MAGIC)


class TokenFileReader:
    """Reads a file through anything with read_at(bytes, offset) and size()."""

    def __init__(self, source):
        self.source = source
        tail = struct.calcsize(_TRAILER)
        end = source.size()
        trailer = source.read_at(tail + 4, end - tail - 4)
        if trailer[-4:] != MAGIC:
            raise ValueError("not a token file")
        doc_at, doc_bytes, n, index_bytes, n_chunks = struct.unpack(_TRAILER, trailer[:-4])
        raw = zstandard.ZstdDecompressor().decompress(source.read_at(doc_bytes, doc_at), max_output_size=max(1, 12 * n))
        self.doc_ids = np.frombuffer(raw, "<i8", n)
        self.counts = np.frombuffer(raw, "<u4", n, 8 * n)
        index = source.read_at(index_bytes, end - tail - 4 - index_bytes)
        self.width, self.bits = index[0], bool(index[1])
        n_planes = self.width * (8 if self.bits else 1)
        entry = f"<QII{n_planes}I"
        self.chunks = [struct.unpack_from(entry, index, 2 + k * struct.calcsize(entry)) for k in range(n_chunks)]

    def block(self, k: int) -> np.ndarray:
        at, count, crc, *sizes = self.chunks[k]
        body, planes, unzip = self.source.read_at(sum(sizes), at), [], zstandard.ZstdDecompressor()
        for size in sizes:
            planes.append(unzip.decompress(body[:size], max_output_size=max(1, count)))
            body = body[size:]
        ids = join_planes(planes, count, self.width, self.bits)
        if zlib.crc32(ids.tobytes()) != crc:
            raise ValueError("a block's checksum differs")
        return ids

    def documents(self) -> Iterator[np.ndarray]:
        """The ids of each document in turn; holds one block and one document."""
        rest, k = np.zeros(0, "<u4"), 0
        for count in self.counts.tolist():
            parts, need = [], count
            while need:
                if not len(rest):
                    rest, k = self.block(k), k + 1
                parts.append(rest[:need])
                rest = rest[need:]
                need -= len(parts[-1])
            yield np.concatenate(parts) if parts else np.zeros(0, "<u4")


def _filesystem(path: str):
    """The file system of a shared folder and the path inside it."""
    from pyarrow import fs

    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path.removeprefix("file:")


class WordEncoder:
    """Ids of texts by their distinct words, through the tokenizers library.

    The tokenizer drops white space, so words between white space are encoded
    alone. A word of letters with stops or commas behind it is encoded as the
    letters and as the stops, which the pre-tokenizer separates anyway. Both
    hold for files whose pre-tokenizer drops white space and splits as above;
    texts of any other file are encoded whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.dtype = np.uint16 if self.lib.get_vocab_size() <= 65536 else np.uint32
        self.width = self.dtype().itemsize
        self.cache = WordCache(self._encode, self.dtype)
        first = ((json.loads(self.lib.to_str()).get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
        self.apart = first.get("behavior") == "Removed" and first.get("invert") and first.get("pattern") == {"Regex": WORD_PATTERN}

    def _encode(self, words: list[str]) -> list:
        return [e.ids for e in self.lib.encode_batch_fast(words, add_special_tokens=False)] if words else []

    def encode(self, texts: pa.Array) -> Ragged:
        if not self.apart:
            return ragged_of(self._encode(texts.to_pylist()), self.dtype)
        split = lambda a: pc.split_pattern_regex(a, r"[ \t\n\x0b\x0c\r]+")
        words, index, counts = words_of(texts, split)
        stem = pc.utf8_rtrim(words, characters=".,")
        apart = pc.match_substring_regex(stem, r"\p{L}$")
        stem = pc.if_else(apart, stem, words)
        tail = _tails(words, stem)
        both = pa.concat_arrays([stem, tail]).dictionary_encode()
        ids = self.cache(both.dictionary)
        place = both.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        a, b = ids.take(place[: len(words)]), ids.take(place[len(words) :])
        lengths = a.lengths + b.lengths
        flat = np.empty(int(lengths.sum()), self.dtype)
        at = np.cumsum(lengths) - lengths
        flat[spread(at, a.lengths)] = a.flat
        flat[spread(at + a.lengths, b.lengths)] = b.flat
        out = Ragged(flat, lengths).take(index)
        return Ragged(out.flat, sums(out.lengths, counts))


def _tails(words: pa.Array, stem: pa.Array) -> pa.Array:
    """What is left of each word behind its stem."""
    size = (pc.binary_length(words).to_numpy() - pc.binary_length(stem).to_numpy()).astype(np.int64)
    words = pa.concat_arrays([words])  # without an offset
    ends = np.frombuffer(words.buffers()[1], np.int32, len(words) + 1)[1:].astype(np.int64)
    data = np.frombuffer(words.buffers()[2] or b"", np.uint8)[spread(ends - size, size)]
    offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
    return pa.StringArray.from_buffers(len(words), pa.py_buffer(offsets), pa.py_buffer(data))


@lru_cache(maxsize=2)
def word_encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def write_token_files(
    docs: DataFrame,
    tokenizer_path: str,
    end_id: int,
    folder: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    bits: bool = False,
    level: int = 3,
    block: int = BLOCK,
) -> DataFrame:
    """Tokenise, and write the ids in ascending id order; returns the manifest.

    ``docs`` is range-partitioned and sorted by id; every partition becomes one
    file, written as a stream into ``folder`` (by default a new one in the shared
    folder). A file's name is new for every attempt of a task, and the manifest
    ``file, first_doc, documents, tokens`` names those of the successful ones, so
    a lost executor leaves at most unlisted files. A null text counts as empty
    and gives only the end id; a null id is written as the smallest 64-bit
    integer; rows with the same id are ordered by a hash of their text. An empty
    table gives an empty manifest.
    """
    folder = folder or scratch_path(docs.sparkSession, "token-files")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = None
        tokens = documents = 0
        for batch in slices(batches, "text"):
            encoder = word_encoder(tokenizer_path)
            ids = encoder.encode(batch.column("text"))
            counts = ids.lengths + 1
            flat = np.empty(len(ids.flat) + len(counts), encoder.dtype)
            at = np.cumsum(counts) - counts
            flat[spread(at, ids.lengths)] = ids.flat
            flat[at + ids.lengths] = end_id
            doc_ids = batch.column("doc").to_numpy()
            if writer is None:
                name, first = f"{uuid.uuid4().hex}.cwbp", int(doc_ids[0])
                files, inside = _filesystem(folder)
                files.create_dir(inside, recursive=True)
                sink = files.open_output_stream(f"{inside}/{name}")
                writer = TokenFileWriter(sink, encoder.width, bits, level, block)
            writer.add(doc_ids, counts, flat)
            tokens, documents = tokens + len(flat), documents + len(counts)
        if writer is not None:
            writer.close()
            sink.close()
            row = [[f"{folder}/{name}"], [first], [documents], [tokens]]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in row], names=["file", "first_doc", "documents", "tokens"])

    rows = docs.select(
        F.coalesce(docs[id_col].cast("bigint"), F.lit(-(2**63))).alias("doc"), F.coalesce(docs[text_col], F.lit("")).alias("text")
    )
    ordered = rows.repartitionByRange("doc").sortWithinPartitions("doc", F.xxhash64("text"))
    return materialise(ordered.mapInArrow(run, _MANIFEST), "token-manifest")


def read_token_files(manifest: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, read from the files.

    ``start`` counts the ids of all documents before it: the files' totals are
    summed up in order of their first document (one row per file), a file's own
    documents while it is read. Ids are not unpacked into rows here; use
    :class:`TokenFileReader` for them.
    """
    before = Window.orderBy("first_doc", "file").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.withColumn("start", F.coalesce(F.sum("tokens").over(before), F.lit(0)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, start in zip(batch.column("file").to_pylist(), batch.column("start").to_pylist()):
                fs, inside = _filesystem(name)
                with fs.open_input_file(inside) as source:
                    reader = TokenFileReader(source)
                    crc = np.fromiter((zlib.crc32(x.tobytes()) for x in reader.documents()), np.int64, len(reader.counts))
                counts = reader.counts.astype(np.int64)
                starts = start + np.cumsum(counts) - counts
                columns = [pa.array(x) for x in (reader.doc_ids.astype(np.int64), starts, counts, crc)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "n_tokens", "ids_crc32"])

    schema = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"
    # A number of partitions, so that adaptive execution does not read many files in one task.
    spread_out = files.select("file", "start").repartition(max(1, min(manifest.count(), READERS)))
    return spread_out.mapInArrow(run, schema).withColumn(
        "doc_id", F.when(F.col("doc_id") != -(2**63), F.col("doc_id"))
    )
