"""A task holds the lists of some candidates of its block at a time."""

import numpy as np
import pandas as pd
import pytest

from sprintgauge.operators import neighbours


@pytest.mark.parametrize("twice", [False, True])
def test_pieces_give_what_whole_blocks_give(monkeypatch, twice):
    draw = np.random.default_rng(8)
    dense = draw.random((90, 30)) * (draw.random((90, 30)) < 0.3)
    dense[::9] = 0
    dense[1::9] = dense[2]  # equal distances, ties by id
    dense /= np.maximum(np.linalg.norm(dense, axis=1), 1e-12)[:, None]
    copies = 1 + twice
    frame = pd.DataFrame({"row_id": np.arange(90)[::-1], "idx": [np.repeat(np.flatnonzero(v), copies) for v in dense],
                          "val": [np.repeat(v[v != 0], copies) / copies for v in dense]})
    monkeypatch.setattr(neighbours, "_STEP", 16)  # rows that hold a term twice are taken in these steps
    whole = neighbours._sparse_block(frame[:25], frame, 4, True).reset_index(drop=True)

    held = []
    lists = neighbours._Postings.lists.func
    monkeypatch.setattr(neighbours._Postings, "lists", property(lambda self: (held.append(self.rows), lists(self))[1]))
    monkeypatch.setattr(neighbours, "_CANDIDATES", 16)
    found = neighbours._sparse_block(frame[:25], frame, 4, True).reset_index(drop=True)
    pd.testing.assert_frame_equal(found, whole)
    assert held and max(held) <= 16 and len(found) == 100


def test_some_rows_of_postings():
    frame = pd.DataFrame({"idx": [[1, 5], [], [2], [5, 6, 7], []], "val": [[.6, .8], [], [1.0], [.1, .2, .3], []]})
    every = neighbours._Postings(frame)
    for begin, stop in [(0, 2), (1, 4), (2, 9), (4, 5)]:
        some, own = every.some(begin, stop), neighbours._Postings(frame[begin:stop])
        assert some.rows == own.rows
        for name in ("lengths", "row", "term", "value"):
            assert getattr(some, name).tolist() == getattr(own, name).tolist()
