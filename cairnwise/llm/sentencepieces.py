"""SentencePiece encoding that keeps byte offsets, and decoding.

The model's normalisation is repeated with alignment: at every position the
longest prefix found in the compiled character map is replaced, and each byte
of the replacement remembers the source bytes it came from; then white space
is treated as the model says. The pieces tile the normalised text, so their
lengths project every piece to a span of the original bytes.

Texts whose normalisation is the identity (no character map, single blanks
only) are encoded by their distinct words when no piece of the vocabulary runs
over a word start; all others are encoded whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnwise.llm.wordwise import Ragged, WordCache, binary_array, slices, spread, sums, words_of

BLANK = "▁"
#: Bytes of text that a worker handles at once.
SLICE = 4 << 20
_SCHEMA = "doc_id string, ids binary, piece_ends binary, decoded string"


class CharacterMap:
    """A compiled character map: a double-array trie over UTF-8 and its replacements.

    Layout: a little-endian uint32 with the trie's bytes, the trie as uint32
    units, then zero-terminated replacement strings.
    """

    def __init__(self, blob: bytes):
        size = int(np.frombuffer(blob, "<u4", 1)[0]) if blob else 0
        self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist() if blob else []
        self.strings = blob[4 + size :]

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Length of the longest prefix of data[at:] in the map, and its replacement."""
        units, best = self.units, None
        if not units:
            return None
        node = self._child(units[0])
        for i in range(at, len(data)):
            node ^= data[i]
            unit = units[node] if node < len(units) else 0
            if unit & 0x800000FF != data[i]:
                break
            node ^= self._child(unit)
            if unit >> 8 & 1:
                best = i + 1 - at, units[node] & 0x7FFFFFFF
        if best is None:
            return None
        return best[0], self.strings[best[1] : self.strings.index(b"\0", best[1])]

    @staticmethod
    def _child(unit: int) -> int:
        return (unit >> 10) << ((unit & 0x200) >> 6)


def _char_length(byte: int) -> int:
    return 1 if byte < 0xC0 else 2 if byte < 0xE0 else 3 if byte < 0xF0 else 4


def normalise_aligned(text: str, charmap: CharacterMap, spec) -> tuple[bytes, np.ndarray]:
    """The normalised text and, for every byte boundary in it, the source offset.

    ``spec`` has the model's switches add_dummy_prefix, remove_extra_whitespaces
    and escape_whitespaces. Source bytes that vanish belong to what follows them.
    """
    data = text.encode("utf-8")
    parts: list[tuple[bytes, int]] = []  # replacement of a source character or prefix, and where the source ends
    at = 0
    while at < len(data):
        hit = charmap.longest(data, at)
        length, put = hit if hit else (n := _char_length(data[at]), data[at : at + n])
        at += length
        parts.append((put, at))
    out, ends = bytearray(), [0]
    blank = BLANK.encode() if spec.escape_whitespaces else b" "
    if spec.remove_extra_whitespaces:
        while parts and not parts[0][0].strip(b" "):
            parts.pop(0)
        while parts and not parts[-1][0].strip(b" "):
            parts.pop()
    if spec.add_dummy_prefix and parts:
        out += blank
        ends += [0] * len(blank)
    was_blank = False
    for put, end in parts:
        for k in range(len(put)):
            one = put[k : k + 1]
            if one == b" ":
                if spec.remove_extra_whitespaces and was_blank:
                    continue
                one = blank
            was_blank = put[k : k + 1] == b" "
            out += one
            ends += [end] * len(one)
    return bytes(out), np.array(ends, np.int64)


class PieceEncoder:
    """One model, loaded once per Python worker."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        self.lib = sentencepiece.SentencePieceProcessor(model_file=path)
        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        self.spec = model.normalizer_spec
        self.charmap = CharacterMap(self.spec.precompiled_charsmap)
        names = [p.piece for p in model.pieces]
        byte = np.array([p.type == 6 for p in model.pieces])
        self.unknown = self.lib.unk_id()
        size = np.array([len(x.encode("utf-8")) for x in names], np.int64)
        blanks = np.array([x.count(BLANK) for x in names], np.int64)
        silent = np.array([p.type == 3 for p in model.pieces])
        self.normal_size = np.where(byte, 1, np.where(silent, 0, size))
        self.source_size = np.where(byte, 1, np.where(silent, 0, size - 2 * blanks))
        self.by_word = (
            not self.spec.precompiled_charsmap
            and self.spec.add_dummy_prefix
            and self.spec.escape_whitespaces
            and not self.spec.remove_extra_whitespaces
            and not model.trainer_spec.treat_whitespace_as_suffix
            and model.trainer_spec.model_type == 2
            and model.trainer_spec.byte_fallback
            and not any(BLANK in x.lstrip(BLANK) for x in names)
            and not any(p.type == 4 for p in model.pieces)
        )
        self.cache = WordCache(lambda words: self.lib.encode(words, num_threads=1), np.uint16 if len(names) < 65536 else np.uint32, 150_000)

    def encode_whole(self, text: str) -> tuple[list[int], np.ndarray]:
        """Ids and the source offset at which each piece ends."""
        ids = self.lib.encode(text, num_threads=1)
        normal, ends = normalise_aligned(text, self.charmap, self.spec)
        known = self.normal_size[ids] if ids else []
        if self.unknown in ids:  # an unknown piece is as long as the text it stands for
            pieces = self.lib.encode(text, out_type=str, num_threads=1)
            known = [len(p.encode("utf-8")) if i == self.unknown else n for i, p, n in zip(ids, pieces, known)]
        stops = np.cumsum(np.array(known, np.int64)) if ids else np.zeros(0, np.int64)
        if ids and stops[-1] != len(normal):
            raise ValueError("the pieces do not tile the normalised text")
        return ids, ends[stops]

    def encode(self, texts: pa.Array, begin: bool, end: bool) -> tuple[Ragged, Ragged]:
        """Ids and piece ends of every text; begin and end ids have empty spans."""
        n = len(texts)
        if self.by_word:
            odd = pc.or_(
                pc.match_substring_regex(texts, f"^ |  | $|{BLANK}|\\x00"), pc.equal(pc.binary_length(texts), 0)
            ).to_numpy(zero_copy_only=False)
        else:
            odd = np.ones(n, bool)
        plain = np.flatnonzero(~odd)
        words, index, counts = words_of(texts.take(pa.array(plain)), lambda a: pc.split_pattern(a, " "))
        by_word = self.cache(words)
        ids = by_word.take(index)
        sizes = self.source_size[ids.flat]
        per_text = sums(ids.lengths, counts)
        starts = np.cumsum(per_text) - per_text
        sizes[starts] -= 1  # the first blank is not in the source
        ends = np.cumsum(sizes)
        ends -= np.repeat(ends[starts] - sizes[starts], per_text)
        hard = [self.encode_whole(texts[int(i)].as_py()) for i in np.flatnonzero(odd)]
        lengths = np.zeros(n, np.int64)
        lengths[plain] = per_text
        lengths[odd] = [len(x[0]) for x in hard]
        whole = lengths + begin + end
        at = np.cumsum(whole) - whole + begin
        flat, stops = np.zeros(int(whole.sum()), np.uint32), np.zeros(int(whole.sum()), np.uint32)
        put = spread(at[plain], per_text)
        flat[put], stops[put] = ids.flat, ends
        for i, (one, ones_ends) in zip(np.flatnonzero(odd), hard):
            flat[at[i] : at[i] + len(one)], stops[at[i] : at[i] + len(one)] = one, ones_ends
        if begin:
            flat[at - 1] = self.lib.bos_id()
        if end:
            flat[at + lengths] = self.lib.eos_id()
            stops[at + lengths] = pc.binary_length(texts).to_numpy(zero_copy_only=False)
        return Ragged(flat, whole), Ragged(stops, whole)

    def decode(self, ids: Ragged) -> list[str]:
        edges = ids.starts.tolist()
        return [self.lib.decode(ids.flat[a:b].tolist()) for a, b in zip(edges, edges[1:])]


@lru_cache(maxsize=2)
def encoder(path: str) -> PieceEncoder:
    return PieceEncoder(path)


def encode_documents(
    docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", begin: bool = True, end: bool = True
) -> DataFrame:
    """One row per input row: ``doc_id, ids, piece_ends, decoded``.

    ``ids`` and ``piece_ends`` are little-endian unsigned 32-bit integers, one
    per piece: a piece covers the original UTF-8 bytes from the end of the piece
    before it (0 at first) to its own end. ``decoded`` is what the model decodes
    the ids to. A null text counts as empty and gives only the begin and end
    ids; a null id stays null; repeated rows give repeated results; other
    columns are not read. ``model_path`` must exist on every executor.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = encoder(model_path)
        for batch in slices(batches, "text", SLICE):
            ids, ends = model.encode(batch.column("text"), begin, end)
            columns = [
                batch.column("doc_id"),
                binary_array(ids.flat.astype("<u4", copy=False), ids.lengths).cast(pa.binary()),
                binary_array(ends.flat.astype("<u4", copy=False), ends.lengths).cast(pa.binary()),
                pa.array(model.decode(ids), pa.string()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "ids", "piece_ends", "decoded"])

    rows = docs.select(docs[id_col].cast("string").alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    return rows.mapInArrow(run, _SCHEMA).withColumn("doc_id", F.col("doc_id").cast(docs.schema[id_col].dataType))
