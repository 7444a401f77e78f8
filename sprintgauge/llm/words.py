"""Words of whole texts as flat numpy arrays, one Arrow batch at a time.

A word is a run of characters other than space and the ASCII controls 9 to 13.
In UTF-8 those bytes occur only as themselves, so words are found on bytes, and a
word's 64-bit hash is a sum of pseudo-random numbers, one per byte and place: no Python
object is made per word. Hashes of word sequences mix word hashes step by step, so no
pair of different sequences collides by its structure. Texts are taken in slices of about ``SLICE_BYTES`` (a longer text
is a slice of its own), which bounds the memory of a task.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
_U64 = np.uint64
_FAR, _NEXT, _SIZE = _U64(0x9E3779B97F4A7C15), _U64(0xD1B54A32D192ED03), _U64(0x8CB92BA72F3D8DD7)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
#: Also parts words at ASCII punctuation and digits.
LETTERS_ONLY = _SPACE.copy()
LETTERS_ONLY[[b for b in range(33, 127) if not chr(b).isalpha()]] = True
#: Places in a word whose numbers come from a table.
_PLACES = 64
_TABLE = np.random.default_rng(20240229).integers(0, (1 << 64) - 1, _PLACES * 256, dtype=np.uint64, endpoint=True)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class Words(NamedTuple):
    """The words of some texts: ``first[d]:first[d + 1]`` are those of text ``d``."""

    hashes: np.ndarray
    start: np.ndarray
    stop: np.ndarray
    first: np.ndarray
    data: np.ndarray


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every input bit."""
    x = x ^ (x >> _U64(30))
    x = x * _U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U64(27))
    x = x * _U64(0x94D049BB133111EB)
    return x ^ (x >> _U64(31))


def _byte_numbers(place: np.ndarray, byte: np.ndarray) -> np.ndarray:
    """A pseudo-random number for each byte at its place in a word."""
    near = np.minimum(place, _PLACES - 1)
    out = _TABLE[near * 256 + byte]
    far = np.flatnonzero(place >= _PLACES)
    if len(far):
        out[far] = mix(mix(place[far].astype(np.uint64) + _FAR) + byte[far].astype(np.uint64))
    return out


def _sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs of ``values``, modulo 2**64."""
    run = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values, out=run[1:])
    stop = np.cumsum(sizes)
    return run[stop] - run[stop - sizes]


def find(data: np.ndarray, offsets: np.ndarray, lower: bool = False,
         between: np.ndarray = _SPACE) -> Words:
    """The words of the texts ``data[offsets[d]:offsets[d + 1]]``.

    ``between`` marks the bytes that part words.
    """
    base = int(offsets[0])
    data, offsets = data[base:int(offsets[-1])], (offsets - base).astype(np.int64)
    if lower:
        data = _LOWER[data]
    n = len(data)
    if n == 0:
        none = np.zeros(0, dtype=np.int64)
        return Words(none.astype(np.uint64), none, none, np.zeros(len(offsets), np.int64), data)
    inside = ~between[data]
    edge = np.zeros(n + 1, dtype=bool)  # a word may not run over the end of its text
    edge[offsets] = True
    opens = inside.copy()
    opens[1:] &= ~inside[:-1] | edge[1:n]
    closes = inside.copy()
    closes[:-1] &= ~inside[1:] | edge[1:n]
    start = np.flatnonzero(opens)
    stop = np.flatnonzero(closes) + 1
    sizes = stop - start
    stops = np.cumsum(sizes)
    place = np.arange(int(stops[-1]) if len(stops) else 0) - np.repeat(stops - sizes, sizes)
    hashes = mix(_sums(_byte_numbers(place, data[inside]), sizes))
    return Words(hashes, start, stop, np.searchsorted(start, offsets), data)


def column(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a text column; null is the empty text."""
    texts = batch.column(name)
    if texts.null_count:
        texts = texts.fill_null("")
    texts = texts.cast(pa.large_string())
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data else np.zeros(0, dtype=np.uint8)
    return data, offsets


def slices(batch: pa.RecordBatch, text: str = "text", lower: bool = False,
           between: np.ndarray = _SPACE, size: int = SLICE_BYTES) -> Iterator[tuple[int, int, Words]]:
    """``(begin, end, words)`` for runs of rows whose texts have about ``size`` bytes."""
    if not batch.num_rows:
        return
    data, offsets = column(batch, text)
    begin = 0
    while begin < batch.num_rows:
        end = int(np.searchsorted(offsets, offsets[begin] + size, side="right")) - 1
        end = min(max(end, begin + 1), batch.num_rows)
        yield begin, end, find(data, offsets[begin:end + 1], lower, between)
        begin = end


def _followed(first: np.ndarray, then: np.ndarray) -> np.ndarray:
    return mix(mix(first + _NEXT) + then)


def windows(words: Words, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each window of ``length`` words, and which windows lie in one text.

    Window ``i`` begins at word ``i`` of all words; a window over the end of its
    text, or of all texts, is marked False. Hashes of 1, 2, 4 .. words are put together.
    """
    n = len(words.hashes)
    if n < length:
        return np.zeros(n, dtype=np.uint64), np.zeros(n, dtype=bool)
    block, reach, made, done = words.hashes, 1, None, 0
    while True:
        if length & reach:
            made = block if made is None else _followed(made[:n - done - reach + 1], block[done:])
            done += reach
        if 2 * reach > length:
            break
        block, reach = _followed(block[:-reach], block[reach:]), 2 * reach
    hashes = np.zeros(n, dtype=np.uint64)
    hashes[:n - length + 1] = made
    last = np.repeat(words.first[1:], np.diff(words.first))
    return hashes, np.arange(n) + length <= last


def stems(words: Words, size: int) -> np.ndarray:
    """Hash of the first ``size`` bytes of each word."""
    total = np.zeros(len(words.start), dtype=np.uint64)
    for place in range(size):
        here = np.flatnonzero(words.start + place < words.stop)
        total[here] += _byte_numbers(np.full(len(here), place), words.data[words.start[here] + place])
    return mix(total)


def texts_of(words: Words) -> np.ndarray:
    """The text to which each word belongs."""
    return np.repeat(np.arange(len(words.first) - 1), np.diff(words.first))


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of the runs ``starts[i] .. starts[i] + lengths[i]``, one after the other."""
    if not len(starts):
        return np.zeros(0, dtype=np.int64)
    ends = np.cumsum(lengths)
    return np.arange(int(ends[-1])) + np.repeat(starts - (ends - lengths), lengths)


def wholes(words: Words) -> np.ndarray:
    """Hash of all words of each text in order; texts of equal words have equal hashes."""
    sizes = np.diff(words.first)
    salts = mix(np.arange(int(sizes.max(initial=0)), dtype=np.uint64) + _SIZE)
    place = np.arange(len(words.hashes)) - np.repeat(words.first[:-1], sizes)
    return mix(_sums(mix(words.hashes ^ salts[place]), sizes) + mix(sizes.astype(np.uint64)))
