"""Benchmark items hidden in documents, with errors, by pigeonhole pieces.

Texts are compared lower-cased, with each run of white space as one space. An item
of m characters may occur with up to ``rate * m`` edits (insertions, deletions,
substitutions). It is cut into one piece more than that, so an occurrence holds at
least one piece unchanged: pieces are looked up at every place of every whole text by
their first eight characters, and each hit is verified by Myers' bit-parallel
distance over the window that the item could cover. An item too short for any edit
counts only where it begins and ends at word borders of the document; scripts written
without spaces have a border at every character.

The items are the stated query set: they go to the tasks in blocks of about
``BLOCK_CHARS`` characters, one scan of the documents per block.

Defined results: null and blank items match nothing; a null text matches nothing;
rows with a null id are reported under null; repeated rows give equal rows once per
id; an empty table on either side gives no rows. Only ids and texts are read.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from . import words as W

RATE = 0.08
BLOCK_CHARS = 4 << 20
_KEY = 8
_BITS = 20
_SPREAD = np.uint64(0x9E3779B97F4A7C15)
_WHITE = np.zeros(256, dtype=bool)
_WHITE[[32, 9, 10, 11, 12, 13]] = True


def normal(text: str) -> str:
    """The form in which texts are compared."""
    lowered = pc.utf8_lower(pa.scalar(text)).as_py()
    return " ".join(p for p in lowered.translate({9: 32, 10: 32, 11: 32, 12: 32, 13: 32}).split(" ") if p)


def codes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One byte per character (equal characters have equal bytes), and where each begins."""
    start = np.flatnonzero((data & 0xC0) != 0x80)
    code = data[start]
    wide = np.flatnonzero(code >= 0x80)
    if len(wide):
        at = start[wide]
        size = np.diff(np.append(start, len(data)))[wide]
        mixed = data[at].astype(np.uint32)
        for k in (1, 2, 3):
            more = size > k
            mixed[more] = mixed[more] * 37 + data[at[more] + k]
        code = code.copy()
        code[wide] = (mixed % 127 + 128).astype(np.uint8)
    return code, start


def distance(item: str, text: str, most: int) -> tuple[int, int]:
    """Least edit distance of ``item`` to a substring of ``text`` and where that ends.

    Myers' recurrence on whole integers, one bit per character of the item; the
    distance is ``most + 1`` or more when nothing is near enough.
    """
    m = len(item)
    full, top = (1 << m) - 1, 1 << (m - 1)
    masks: dict[str, int] = defaultdict(int)
    for i, c in enumerate(item):
        masks[c] |= 1 << i
    plus, minus, score = full, 0, m
    best, end = m, 0
    for j, c in enumerate(text, 1):
        eq = masks.get(c, 0)
        keep = eq | minus
        diagonal = (((eq & plus) + plus) ^ plus) | eq
        up = minus | (~(diagonal | plus) & full)
        down = plus & diagonal
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        up = (up << 1) & full
        plus = ((down << 1) & full) | (~(keep | up) & full)
        minus = up & keep
        if score < best:
            best, end = score, j
            if not best:
                break
    return (best, end) if best <= most else (most + 1, 0)


class Pieces:
    """The pieces of a block of items, sorted by their first eight characters."""

    def __init__(self, items: list[tuple[int, str]], rate: float):
        self.items = [(i, n, self.budget(len(n), rate)) for i, n in ((i, normal(t or "")) for i, t in items) if n]
        rows = []
        for k, (_, text, most) in enumerate(self.items):
            code, _ = codes(np.frombuffer(text.encode(), dtype=np.uint8))
            cuts = [len(text) * p // (most + 1) for p in range(most + 2)]
            for a, b in zip(cuts, cuts[1:]):
                rows.append((k, a, b - a, *self.ends(code[a:b])))
        self.rows = np.array([r[:3] for r in rows], dtype=np.int64).reshape(-1, 3)
        self.head = np.array([r[3] for r in rows], dtype=np.uint64)
        self.tail = np.array([r[4] for r in rows], dtype=np.uint64)

    @staticmethod
    def budget(size: int, rate: float) -> int:
        """Edits allowed: a share of the item, as long as pieces keep eight characters."""
        return max(0, min(int(rate * size), size // _KEY - 1))

    @staticmethod
    def ends(code: np.ndarray) -> tuple[int, int]:
        size = min(len(code), _KEY)
        return int.from_bytes(code[:size].tobytes(), "little"), int.from_bytes(code[len(code) - size:].tobytes(), "little")

    def hits(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(row, place)`` of each piece found in a run of character bytes."""
        n = len(code)
        padded = np.concatenate([code, np.zeros(_KEY, dtype=np.uint8)])
        view = np.ndarray(shape=(n,), dtype="<u8", buffer=padded, strides=(1,))
        found_rows, found_places = [], []
        for size in np.unique(np.minimum(self.rows[:, 2], _KEY)):
            keep = np.uint64((1 << (8 * int(size))) - 1)
            own = np.flatnonzero(np.minimum(self.rows[:, 2], _KEY) == size)
            own = own[np.argsort(self.head[own], kind="stable")]
            heads = self.head[own]
            seen = np.zeros(1 << _BITS, dtype=bool)
            seen[(heads * _SPREAD) >> np.uint64(64 - _BITS)] = True
            place = np.flatnonzero(seen[((view & keep) * _SPREAD) >> np.uint64(64 - _BITS)])
            value = view[place] & keep
            low, high = np.searchsorted(heads, value, "left"), np.searchsorted(heads, value, "right")
            place, low, count = place[high > low], low[high > low], (high - low)[high > low]
            row = own[W.ragged(low, count)]
            place = np.repeat(place, count)
            last = place + self.rows[row, 2] - size
            fits = last <= n - size
            row, place, last = row[fits], place[fits], last[fits]
            same = (view[last] & keep) == self.tail[row]
            found_rows.append(row[same])
            found_places.append(place[same])
        return np.concatenate(found_rows), np.concatenate(found_places)


#: Scripts without spaces between words: Thai to Tibetan, Myanmar, Khmer, kana, Han.
_UNSPACED = re.compile("[\u0e00-\u0fff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")


def bordered(text: str, a: int, b: int) -> bool:
    """Whether ``text[a:b]`` begins and ends at word borders."""
    def inside(x: str, y: str) -> bool:
        return all((c.isalnum() or c == "_") and not _UNSPACED.match(c) for c in (x, y))

    return not (a > 0 and inside(text[a - 1], text[a]) or b < len(text) and inside(text[b - 1], text[b]))


def _scan(pieces: Pieces, texts: pa.Array, ids: list) -> list[tuple]:
    lowered = pc.utf8_lower(texts)
    data, offsets = W.column(pa.RecordBatch.from_arrays([lowered], ["text"]), "text")
    data, offsets = data[offsets[0]:offsets[-1]], offsets - offsets[0]
    code, start = codes(data)
    first = np.searchsorted(start, offsets)
    white = _WHITE[code]
    code = np.where(white, np.uint8(32), code)
    opens = np.zeros(len(code) + 1, dtype=bool)
    opens[first] = True
    keep = np.ones(len(code), dtype=bool)
    keep[1:] = ~(white[1:] & white[:-1]) | opens[1:-1]
    code, start = code[keep], start[keep]
    first = np.searchsorted(start, offsets)
    if not len(code) or not len(pieces.rows):
        return []
    row, place = pieces.hits(code)
    item, shift = pieces.rows[row, 0], place - pieces.rows[row, 1]
    doc = np.searchsorted(first, place, "right") - 1
    out: dict[tuple[int, int], tuple[int, int]] = {}
    tried: set[tuple[int, int, int]] = set()
    for d, k, s in sorted(set(zip(doc.tolist(), item.tolist(), shift.tolist()))):
        _, text, most = pieces.items[k]
        low, high = int(first[d]), int(first[d + 1])
        a, b = max(low, s - most), min(high, s + len(text) + most)
        if b - a < len(text) - most or (d, k) in out and not out[d, k][0]:
            continue
        if not most:
            if s < low or s + len(text) > high:
                continue
            a, b = max(low, s - 1), min(high, s + len(text) + 1)
            window = normal_window(bytes(data[int(start[a]):int(start[b]) if b < len(start) else len(data)]))
            if window[s - a:s - a + len(text)] == text and bordered(window, s - a, s - a + len(text)):
                out[d, k] = 0, s - low
            continue
        # Windows of one item that begin in one stretch of the budget share a look.
        stretch = (d, k, s // (most + 1))
        if stretch in tried:
            continue
        tried.add(stretch)
        a, b = max(low, s // (most + 1) * (most + 1) - most), min(high, (s // (most + 1) + 1) * (most + 1) + len(text) + most)
        end = int(start[b]) if b < len(start) else len(data)
        window = normal_window(bytes(data[int(start[a]):end]))
        found, at = distance(text, window, most)
        if found <= most and ((d, k) not in out or found < out[d, k][0]):
            out[d, k] = found, max(a + at - len(text), low) - low
    return [(ids[d], pieces.items[k][0], *v) for (d, k), v in out.items()]


def normal_window(data: bytes) -> str:
    """A piece of lower-cased text with runs of white space made one space."""
    text = data.decode("utf-8", "replace").translate({9: 32, 10: 32, 11: 32, 12: 32, 13: 32})
    while "  " in text:
        text = text.replace("  ", " ")
    return text


def matches(docs: DataFrame, items: DataFrame, rate: float = RATE) -> DataFrame:
    """``doc_id, item_id, distance, at``: items found in documents, best place of each.

    ``at`` is the character, counted in the compared form, at which it begins.
    """
    items = items.select("item_id", F.col("text").cast("string").alias("text")).filter("text IS NOT NULL")
    size = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-size // BLOCK_CHARS))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, item_id long, distance int, at int"
    out = None
    for block in range(blocks):
        own = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block)
        pieces = Pieces([(r.item_id, r.text) for r in own.collect()], rate)  # one block: bounded

        def run(batches: Iterator[pa.RecordBatch], pieces: Pieces = pieces) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                _, offsets = W.column(batch, "text")
                begin = 0
                while begin < batch.num_rows:
                    end = int(np.searchsorted(offsets, offsets[begin] + W.SLICE_BYTES, side="right")) - 1
                    end = min(max(end, begin + 1), batch.num_rows)
                    some = batch.slice(begin, end - begin)
                    texts = some.column("text").fill_null("")
                    found = _scan(pieces, texts, some.column("doc_id").to_pylist())
                    begin = end
                    if found:
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(c, t) for c, t in zip(zip(*found), (pa.int64(), pa.int64(), pa.int32(), pa.int32()))],
                            ["doc_id", "item_id", "distance", "at"])

        part = rows.mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    best = F.min(F.struct("distance", "at")).alias("best")
    return out.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "best.distance", "best.at")
