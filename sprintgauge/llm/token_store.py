"""Token ids of whole texts in ORC files, in ascending document order.

Integer columns of ORC are run-length encoded per stripe; each stripe has a row
index with the least and greatest id per stride and a Bloom filter on ``doc_id``, so
a look-up reads the few strides that can hold a document, and a scan is split by
stripe. Rows are range-partitioned by id and sorted inside a file; a row's place in
the whole sequence is its place in its file plus the sizes of the files before,
one number per file.

Encoding remembers, per Python worker, the ids of at least the last ``CACHE_PIECES``
pieces: texts are cut at single spaces and line feeds, which no token of
this tokenizer spans. The marks behind the last letter of a piece are remembered apart.

Defined results: a null text is an empty text and yields the end id alone; a null
document id sorts first; repeated rows are kept, ties go by a hash of the text; an
empty table gives no rows. Only the id and text columns are read.
"""

from __future__ import annotations

import struct
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .byte_level import TwoAges, stand_ins
from .words import ragged

END_ID = 1
CACHE_PIECES = 300_000
#: ORC settings: stripes small enough to read in parallel, an index entry each 2,000 rows.
ORC_OPTIONS = {
    "compression": "zstd", "orc.stripe.size": str(16 << 20), "orc.create.index": "true",
    "orc.row.index.stride": "2000", "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01",
}
_LATIN_END = "ɐ"
#: Bytes of text that are encoded at a time; a longer text is alone.
SLICE_BYTES = 4 << 20
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: The second bytes of U+00C0 to U+00FF (the first is 195): capitals, and what is no letter.
_LOWER_SECOND = np.arange(256, dtype=np.uint8)
_LOWER_SECOND[[*range(0x80, 0x97), *range(0x98, 0x9F)]] += 32
_LETTER = np.array([b < 128 and chr(b).isalpha() or 128 <= b < 192 and b not in (0x97, 0xB7) for b in range(256)])
_MARK = np.array([32 < b < 127 and not chr(b).isalnum() for b in range(256)])


def _parted(pieces: pa.Array) -> tuple[pa.Array, pa.Array]:
    """Of each piece the text up to its last letter in lower case, and the marks behind that.

    Only pieces of ASCII and U+00C0 to U+00FF are changed: no character of theirs changes
    with its neighbours, and no token holds a letter and the mark behind it. Pieces with a ``<``
    stay: there may be special tokens in them.
    """
    _, offsets, data = pieces.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int32)[pieces.offset:pieces.offset + len(pieces) + 1].astype(np.int64)
    data = np.frombuffer(data, dtype=np.uint8)[offsets[0]:offsets[-1]] if data else np.zeros(0, dtype=np.uint8)
    offsets = offsets - offsets[0]
    start, end = offsets[:-1], offsets[1:]
    other = np.concatenate([[0], np.cumsum((data >= 192) & (data != 195) | (data == ord("<")))])
    plain = other[end] == other[start]
    lower = np.where(data < 128, _LOWER[data], data)
    second = np.flatnonzero(data == 195) + 1
    lower[second] = _LOWER_SECOND[data[second]]
    data = np.where(np.repeat(plain, end - start), lower, data)
    last = np.maximum.accumulate(np.where(_MARK[data], -1, np.arange(len(data))))  # no mark: the last one so far
    last = np.append(last, -1)[end - 1]  # of an empty piece that of another
    cut = plain & (last >= start) & (end > start) & _LETTER[np.append(data, 0)[last]]
    middle = np.where(cut, last + 1, end)

    def text(start: np.ndarray, end: np.ndarray) -> pa.Array:
        size = end - start
        return pa.StringArray.from_buffers(
            len(size), pa.py_buffer(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)),
            pa.py_buffer(data[ragged(start, size)]))

    return text(start, middle), text(middle, end)


def _strings(pieces: pa.Array) -> list[str]:
    """The strings of an array; none has a space in it."""
    if not len(pieces):
        return []
    return pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(pieces)], pa.int32()), pieces), " ")[0].as_py().split(" ")


class PieceEncoder(TwoAges):
    """Piece of text -> its ids as little-endian 32-bit bytes, remembered.

    A word of Latin letters is normalised here and goes straight to the library's
    model; a full stop or comma after a letter is always a token of its own.
    Anything else goes through the library's whole chain.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__(CACHE_PIECES)
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        self.stand_ins = dict(enumerate(stand_ins()))

    def _whole(self, piece: str) -> bytes:
        return np.array(self.tokenizer.encode(piece, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _word(self, word: str) -> bytes:
        word = word.lower()
        if not word.isascii():  # byte by byte
            word = unicodedata.normalize("NFC", word).encode().decode("latin-1").translate(self.stand_ins)
        ids = [t.id for t in self.model.tokenize(word)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def make(self, piece: str) -> bytes:
        word, tail = piece, b""
        # A capital that becomes a letter and a mark keeps the stop: they are one token's text.
        if len(piece) > 1 and piece[-1] in ".," and piece[-2].isalpha() and len(piece[-2].lower()) == 1:
            word, tail = piece[:-1], self._whole(piece[-1])
        plain = word.isalpha() and (word.isascii() or (max(word) < _LATIN_END and "İ" not in word))
        return (self._word(word) if plain else self._whole(word)) + tail

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, text.replace("\n", " ").split(" ")))

    def encode_all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of some texts, one after the other with the end id behind each, and their numbers.

        Each different part of a piece is looked up once; the rest is done on arrays.
        """
        lists = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        offsets = lists.offsets.to_numpy().astype(np.int64)
        coded = lists.values.slice(offsets[0], offsets[-1] - offsets[0]).dictionary_encode()
        words, marks = (x.dictionary_encode() for x in _parted(coded.dictionary))
        of_word, of_marks = ([self[p] for p in _strings(x.dictionary)] for x in (words, marks))
        found = [of_word[w] + of_marks[m] for w, m in zip(
            words.indices.to_numpy().tolist(), marks.indices.to_numpy().tolist())]
        size = np.array([len(f) // 4 for f in found], dtype=np.int64)
        start = np.cumsum(size) - size
        ids = np.append(np.frombuffer(b"".join(found), dtype="<i4"), np.int32(END_ID))
        # One more piece per text: the end id.
        piece = np.insert(coded.indices.to_numpy().astype(np.int64), offsets[1:] - offsets[0], len(found))
        size, start = np.append(size, 1), np.append(start, len(ids) - 1)
        ends = np.cumsum(size[piece])[offsets[1:] - offsets[0] + np.arange(len(texts))]
        return ids[ragged(start[piece], size[piece])], np.diff(ends, prepend=0)


_ENCODERS: dict[str, PieceEncoder] = {}


def _encoder(path: str) -> PieceEncoder:
    if path not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[path] = PieceEncoder(path)
    return _ENCODERS[path]


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Runs of rows with about ``SLICE_BYTES`` of text, which bounds what is held at a time."""
    end = np.cumsum(pc.binary_length(batch.column("text")).to_numpy().astype(np.int64))
    begin = 0
    while begin < batch.num_rows:
        before = end[begin - 1] if begin else 0
        stop = max(int(np.searchsorted(end, before + SLICE_BYTES, side="right")), begin + 1)
        yield batch.slice(begin, stop - begin)
        begin = stop


def write(docs: DataFrame, folder: str, tokenizer: str, partitions: int | None = None) -> None:
    """Encode ``doc_id, text`` and write ``part, doc_id, place, n_tokens, ids`` to ``folder``."""
    spark = docs.sparkSession
    count = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.coalesce(F.col("text"), F.lit("")).alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text"))
    rows = rows.repartitionByRange(count, "doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    schema = "part int, doc_id long, place long, n_tokens long, ids array<int>"

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, place = _encoder(tokenizer).encode_all, TaskContext.get().partitionId(), 0
        for batch in batches:
            for some in _slices(batch):
                flat, sizes = encode(some.column("text"))
                ends = np.cumsum(sizes)
                offsets = np.concatenate([[0], ends]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(sizes), part, dtype=np.int32)), some.column("doc_id"),
                    pa.array(place + ends - sizes), pa.array(sizes),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)),
                ], ["part", "doc_id", "place", "n_tokens", "ids"])
                place += int(ends[-1])

    rows.select("doc_id", "text").mapInArrow(encoded, schema).write.format("orc").options(**ORC_OPTIONS).save(folder)


def read(spark: SparkSession, folder: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids``; ``start`` counts the ids of all rows before."""
    rows = spark.read.schema("part int, doc_id long, place long, n_tokens long, ids array<int>").orc(folder)
    files = rows.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    # One row per file: safe to number in one task and to broadcast.
    files = files.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))
    return rows.join(F.broadcast(files), "part").select(
        "doc_id", (F.col("base") + F.col("place")).alias("start"), "n_tokens", "ids")


def lookup(spark: SparkSession, folder: str, doc_ids: list[int]) -> DataFrame:
    """The rows of some documents; index and Bloom filter skip the other strides."""
    return read(spark, folder).filter(F.col("doc_id").isin(doc_ids))


def checksums(rows: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens`` and the unsigned crc32 of the ids as 32-bit integers."""
    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("ids")
            offsets = ids.offsets.to_numpy()
            flat = memoryview(np.ascontiguousarray(ids.values.to_numpy(), dtype="<i4")).cast("B")
            crc = [zlib.crc32(flat[4 * a:4 * b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("start"), batch.column("n_tokens"), pa.array(crc, pa.int64())],
                ["doc_id", "start", "n_tokens", "ids_crc32"])

    return rows.mapInArrow(digest, "doc_id long, start long, n_tokens long, ids_crc32 long")
