"""Retrieval answers every curated row, from the row's own description."""

import math
import re
from collections import Counter

import numpy as np

from sprintgauge.plans import base, retrieval


def _nearest(texts, k=3):
    bags = {i: Counter(re.findall("[a-z0-9_]{2,}", " ".join(re.findall(
        "[\\x00-\\x08\\x0e-\\x1b\\x21-\\x7f]+", t)).lower())) for i, t in texts.items()}
    terms = {t: at for at, t in enumerate(sorted(set().union(*bags.values())))}
    df = Counter(t for bag in bags.values() for t in bag)
    ids = sorted(bags)
    m = np.zeros((len(ids), len(terms)))
    for at, i in enumerate(ids):
        for t, n in bags[i].items():
            m[at, terms[t]] = n * (math.log((1 + len(ids)) / (1 + df[t])) + 1)
    norms = np.sqrt((m * m).sum(axis=1))
    m /= np.where(norms > 0, norms, 1)[:, None]
    full = (norms > 0).astype(float)
    d = full[:, None] + full[None, :] - 2 * m @ m.T
    np.fill_diagonal(d, np.inf)
    return {i: (np.sort(d[at])[:k], {j: d[at, b] for b, j in enumerate(ids)}) for at, i in enumerate(ids)}


def test_every_curated_row_is_answered(spark, sf_dir):
    rows = {r.row_ord: r for r in base.curated(spark, sf_dir).collect()}
    for name in ("prompt_few_shot", "answer_by_neighbours"):
        got = [r.row_id for r in retrieval.QUERIES[name](spark, sf_dir).select("row_id").collect()]
        assert sorted(got) == sorted(rows)
    # Also where the embeddings table ends: neighbours come from all descriptions.
    wanted, found = _nearest({i: r.description for i, r in rows.items()}), {}
    for r in retrieval.retrieved(spark, sf_dir).collect():
        found.setdefault(r.query_id, {})[r.rank] = r
    assert set(found) == set(rows)
    for i, near in found.items():
        least, apart = wanted[i]
        got = [apart[near[rank].neighbour_id] for rank in (1, 2, 3)]
        assert np.allclose(got, least, atol=1e-8), (i, got, least)
