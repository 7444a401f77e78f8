"""Byte-level BPE: a backtracking encoder and an offset-table decoder.

A text is cut into pre-tokens by the usual pattern. Inside a pre-token an
Aho-Corasick automaton over all tokens gives the longest token at each place. The
encoder takes the longest token that may stand after the last one; when none may, it
marks the place as a dead end and steps back. Two tokens may stand side by side if
merging by rank would leave the border between them alone, which is decided from the
two parts of each token, once per pair. No place is tried twice, so the work is
linear, and the result is what merging by rank gives.

Decoding is a lookup: all token bytes lie in one array and an offset table says where
each begins.

Per Python worker, the last ``CACHE_PIECES`` pieces or more are remembered.

Defined results: a null text is encoded as an empty one; empty texts have no ids;
special tokens written in a text become their ids, as in the library; repeated rows
and null document ids stay; an empty table gives no rows. Only the id and text
columns are read.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .byte_level import TwoAges, stand_ins
from .words import ragged

CACHE_PIECES = 300_000
CACHE_PAIRS = 1_000_000
#: Fixed value: the pre-token pattern of this family of vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: White space on both sides of a space, or before one that ends the text.
_RUNS = re.compile(r"[^\S ] (?:\s|\Z)|  ")


class Bpe(TwoAges):
    """A vocabulary file; as a mapping, piece of text -> its ids as 32-bit bytes."""

    def __init__(self, path: str):
        import ahocorasick
        import regex

        super().__init__(CACHE_PIECES)
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        byte = {c: b for b, c in enumerate(stand_ins())}
        as_bytes = lambda shown: bytes(byte[c] for c in shown)
        ids = {as_bytes(shown): i for shown, i in spec["model"]["vocab"].items()}
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*ids.values(), *special.values()]) + 1
        self.special = special
        self.split_special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True))) or "(?!)")
        self.pattern = regex.compile(PATTERN)
        self.text = [b""] * size
        for token, i in ids.items():
            self.text[i] = token
        for token, i in special.items():
            self.text[i] = token.encode()
        # The two parts each token is merged from, and the rank of that merge.
        self.rank = [-1] * size
        self.left, self.right = list(range(size)), list(range(size))
        self.merged: dict[int, int] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            a, b = as_bytes(a), as_bytes(b)
            whole = ids[a + b]
            self.merged.setdefault(ids[a] << 32 | ids[b], whole)
            if self.rank[whole] < 0:
                self.rank[whole], self.left[whole], self.right[whole] = rank, ids[a], ids[b]
        # The next shorter token that begins a token.
        self.shorter = [-1] * size
        for token, i in ids.items():
            for n in range(len(token) - 1, 0, -1):
                if (j := ids.get(token[:n])) is not None:
                    self.shorter[i] = j
                    break
        self.matches = ahocorasick.Automaton()
        for token, i in ids.items():
            self.matches.add_word(token.decode("latin-1"), (len(token), i))
        self.matches.make_automaton()
        self.length = [len(t) for t in self.text]
        self.pairs: dict[int, bool] = {}
        self.known: dict[str, bytes] = {}
        self.bytes = np.frombuffer(b"".join(self.text), dtype=np.uint8)
        self.sizes = np.array(self.length, dtype=np.int64)
        self.offsets = np.concatenate([[0], np.cumsum(self.sizes)])

    def _border_stays(self, a: int, b: int) -> bool:
        """Whether merging by rank keeps the border between tokens ``a`` and ``b``.

        Undo the merges that touch the border, latest first: if two parts that meet
        there have a merge of their own that comes before the merge being undone on
        either side, that merge would have gone first and closed the border.
        """
        rank, merged = self.rank, self.merged
        limit = len(rank) + 1
        while True:
            whole = merged.get(a << 32 | b)
            if whole is not None and rank[whole] < limit:
                return False
            if rank[a] > rank[b]:
                limit, a = rank[a], self.right[a]
            elif rank[b] >= 0:
                # The pair to the left goes first among equals, so b's own merge counts.
                limit, b = rank[b] + 1, self.left[b]
            else:
                return True

    def _tokens(self, piece: bytes) -> list[int]:
        n = len(piece)
        longest, reach = [-1] * n, [0] * n
        for end, (size, token) in self.matches.iter(piece.decode("latin-1")):
            if size > reach[at := end - size + 1]:
                reach[at], longest[at] = size, token
        if reach[0] == n:
            return [longest[0]]
        alive = [True] * (n + 1)
        tokens: list[int] = []
        pairs, length, shorter = self.pairs, self.length, self.shorter
        at, token = 0, longest[0]
        while at < n:
            last = tokens[-1] if tokens else -1
            while token >= 0:
                if alive[at + length[token]]:
                    if last < 0:
                        break
                    pair = last << 32 | token
                    fits = pairs.get(pair)
                    if fits is None:
                        if len(pairs) >= CACHE_PAIRS:
                            pairs.clear()
                        fits = pairs[pair] = self._border_stays(last, token)
                    if fits:
                        break
                token = shorter[token]
            if token >= 0:
                tokens.append(token)
                at += length[token]
                token = longest[at] if at < n else -1
            else:
                alive[at] = False
                token = tokens.pop()
                at -= length[token]
        return tokens

    def _pretoken(self, piece: str) -> bytes:
        known = self.known.get(piece)
        if known is None:
            known = np.array(self._tokens(piece.encode()), dtype="<u4").tobytes()
            if len(self.known) >= CACHE_PIECES:
                self.known.clear()
            self.known[piece] = known
        return known

    def make(self, piece: str) -> bytes:
        return b"".join(map(self._pretoken, self.pattern.findall(piece)))

    def _ordinary(self, text: str) -> bytes:
        if _RUNS.search(text):  # the pattern looks along runs of white space
            return b"".join(map(self._pretoken, self.pattern.findall(text)))
        first, *rest = text.split(" ")
        if not rest:
            return self[first] if first else b""
        # A single space belongs to what follows it, so " " + piece stands alone.
        return (self[first] if first else b"") + b"".join([self[" " + piece] for piece in rest])

    def encode(self, text: str) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers."""
        if not any(token in text for token in self.special):
            return self._ordinary(text)
        out, at = [], 0
        for match in self.split_special.finditer(text):
            out.append(self._ordinary(text[at:match.start()]))
            out.append(np.array([self.special[match.group()]], dtype="<u4").tobytes())
            at = match.end()
        return b"".join([*out, self._ordinary(text[at:])])

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of a run of ids."""
        ids = ids.astype(np.int64)
        return self.bytes[ragged(self.offsets[ids], self.sizes[ids])].tobytes()


_LOADED: dict[str, Bpe] = {}


def load(path: str) -> Bpe:
    """The vocabulary at ``path``, read once per Python worker."""
    if path not in _LOADED:
        _LOADED.clear()
        _LOADED[path] = Bpe(path)
    return _LOADED[path]


def _mapped(docs: DataFrame, schema: str, row, names: list[str]) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.coalesce(F.col("text"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 512):  # bounds what is held at a time
                some = batch.slice(begin, 512)
                columns = row(some.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([some.column("doc_id"), *columns], names)

    return rows.mapInArrow(run, schema)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, ids``."""
    def row(texts: list[str]) -> list[pa.Array]:
        ids = [np.frombuffer(load(path).encode(t), dtype="<i4") for t in texts]
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
        return [pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids)))]

    return _mapped(docs, "doc_id long, ids array<int>", row, ["doc_id", "ids"])


def decode(rows: DataFrame, path: str) -> DataFrame:
    """``doc_id, text`` from ``doc_id, ids``; bytes that are no UTF-8 become U+FFFD."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [load(path).decode(np.array(x or [], dtype=np.int64)).decode("utf-8", "replace")
                     for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return rows.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """Encode and decode each whole text: ``doc_id, n_tokens, ids_sha256, decoded_sha256``."""
    def row(texts: list[str]) -> list[pa.Array]:
        bpe = load(path)
        ids = [bpe.encode(t) for t in texts]
        decoded = [bpe.decode(np.frombuffer(x, dtype="<u4")) for x in ids]
        utf8 = [t if t == s.encode() else t.decode("utf-8", "replace").encode() for t, s in zip(decoded, texts)]
        return [pa.array([len(x) // 4 for x in ids], pa.int64()),
                pa.array([hashlib.sha256(x).hexdigest() for x in ids]),
                pa.array([hashlib.sha256(t).hexdigest() for t in utf8])]

    return _mapped(docs, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", row,
                   ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
