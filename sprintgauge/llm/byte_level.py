"""What both tokenizers need: stand-ins for bytes, and a bounded memory of pieces."""

from __future__ import annotations


def stand_ins() -> list[str]:
    """For each byte its character: printable Latin-1 as itself, others from U+0100 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


class TwoAges(dict):
    """A mapping that makes missing values and forgets the oldest half when full.

    Lookups of known pieces cost no more than in a plain dictionary.
    """

    def __init__(self, size: int):
        super().__init__()
        self.size, self.old = size, {}

    def make(self, piece: str) -> bytes:
        raise NotImplementedError

    def __missing__(self, piece: str) -> bytes:
        value = self.old.get(piece)
        if value is None:
            value = self.make(piece)
        if len(self) >= self.size:
            self.old = dict(self)
            self.clear()
        self[piece] = value
        return value
