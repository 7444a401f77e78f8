"""Katz backoff against a plain recursion over dictionaries."""

import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sprintgauge.llm import katz, queries

END, BEGIN = "</s>", "<s>"


def tokens(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", low) + [END]


class Plain:
    """Counts in dictionaries, probabilities by the recursion as it is written."""

    def __init__(self, texts, order):
        self.order = order
        self.counts = [Counter() for _ in range(order)]
        for text in texts:
            t = [BEGIN] * (order - 1) + tokens(text)
            for i in range(order - 1, len(t)):
                for m in range(order):
                    self.counts[m][tuple(t[i - m:i + 1])] += 1
        self.d = [katz.discounts(Counter(c.values())) for c in self.counts]
        self.total = sum(self.counts[0].values())
        self.after = [dict() for _ in range(order)]
        for m in range(order):
            for gram, c in self.counts[m].items():
                self.after[m].setdefault(gram[:-1], {})[gram[-1]] = c

    def kept(self, m, c):
        return c * (self.d[m][c] if c < len(self.d[m]) else 1.0)

    def p(self, context, word):
        m = len(context)
        seen = self.after[m].get(context)
        if not seen:
            return self.p(context[1:], word) if m else 1.0
        t, lost = sum(seen.values()), sum(c - self.kept(m, c) for c in seen.values())
        if lost < 1e-9:
            t, lost = t + 1, 1.0
        if word in seen:
            return self.kept(m, seen[word]) / t
        if not m:
            return lost / t
        return lost / t / (1 - sum(self.p(context[1:], w) for w in seen)) * self.p(context[1:], word)

    def score(self, text):
        t = [BEGIN] * (self.order - 1) + tokens(text)
        n = self.order - 1
        return sum(math.log10(self.p(tuple(t[i - n:i]), t[i])) for i in range(n, len(t)))

    def base(self, text):
        v = len(self.counts[0])
        return sum(math.log10((self.counts[0][(w,)] + 0.5) / (self.total + 0.5 * (v + 1))) for w in tokens(text))


def corpus(n=120):
    rng = random.Random(5)
    common = [f"w{i}" for i in range(12)]
    texts = []
    for i in range(n):
        size = rng.choice([0, 1, 2, 10, 40])
        words = [rng.choice(common) if rng.random() < 0.7 else f"R{rng.randrange(150)}" for _ in range(size)]
        texts.append(" ".join(words) + rng.choice(["", " W1 w2 w3", "\tw1\nw2"]))
    return [(i, t) for i, t in enumerate(texts)] + [(3, "w1 again"), (3, "w1 again"), (None, "w2 w3"), (700, None), (701, " \n")]


@pytest.mark.parametrize("order,head", [(1, 30), (2, 30), (2, 1 << 20), (3, 40)])
def test_scores_equal_the_plain_recursion(spark, monkeypatch, order, head):
    monkeypatch.setattr(katz, "HEAD", head)
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns(
        {c: F.lit("clash") for c in ("key", "row", "train", "value", "n", "c", "ctx", "low", "base", "score")})
    learn = lambda i: i is not None and i % 4 != 1
    plain = Plain([t for i, t in rows if learn(i)], order)
    got = katz.learn_and_score(docs, F.col("doc_id") % 4 != 1, order).collect()
    key = lambda i, n, s: (-1 if i is None else i, n, round(s, 6))
    want = sorted((key(i, len(tokens(t)), plain.score(t)), plain.base(t),
                   sum((w,) in plain.counts[0] for w in tokens(t))) for i, t in rows)
    have = sorted((key(r.doc_id, r.n_tokens, r.score), r.base_score, r.n_known) for r in got)
    assert [w[0] for w in want] == [h[0] for h in have]
    assert [w[2] for w in want] == [h[2] for h in have]
    assert [h[1] for h in have] == pytest.approx([w[1] for w in want], rel=1e-9)
    assert {r.train_tokens for r in got} == {plain.total}


def test_probabilities_add_up_to_one():
    plain = Plain([t for _, t in corpus()], 3)
    words = [w for (w,) in plain.counts[0]] + ["never seen"]
    for context in [(BEGIN, BEGIN), ("w1", "w2"), ("w2", "w3"), ("never seen", "w1"), ("w1", "never seen")]:
        assert sum(plain.p(context, w) for w in words) == pytest.approx(1, abs=1e-9)


def test_discounts():
    n = {1: 1000, 2: 400, 3: 220, 4: 140, 5: 100, 6: 75}
    d = katz.discounts(n)
    stars = [(r + 1) * n[r + 1] / n[r] for r in range(1, 6)]
    assert all(0 < x < 1 for x in d[1:])
    # What the discounts take away is what Good and Turing give to the unseen.
    assert sum(n[r] * (1 - d[r]) * r for r in range(1, 6)) == pytest.approx(n[1])
    assert [d[r] * r - stars[r - 1] for r in range(1, 6)] != [0] * 5
    for odd in ({}, {1: 5}, {2: 5}, {1: 3, 2: 4, 3: 5, 4: 6, 5: 7, 6: 8}):
        assert all(0 < x <= 1 for x in katz.discounts(odd))


def test_edges(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert katz.learn_and_score(none, F.lit(True)).count() == 0
    long = " ".join(f"v{i % 5003}" for i in range(60_000))
    docs = spark.createDataFrame([(1, long), (2, "v1 v2"), (3, "x" * 100_000)], "doc_id long, text string")
    got = {r.doc_id: r for r in katz.learn_and_score(docs, F.col("doc_id") == 1).collect()}
    assert got[1].n_tokens == got[1].n_known == got[1].train_tokens == 60_001
    assert got[3].n_known == 1 and got[2].n_known == 3 and got[2].score > got[3].score
    nothing = katz.learn_and_score(docs, F.lit(False)).collect()
    assert {r.train_tokens for r in nothing} == {0} and {r.n_known for r in nothing} == {0}


def test_held_out_texts_are_likelier_than_by_words_alone(spark, sf_dir):
    got = queries.katz_query(spark, sf_dir).filter("held_out").agg(F.sum("score"), F.sum("base_score"), F.sum("n_tokens")).first()
    assert got[0] > got[1] and got[2] > 0
    sizes = spark.read.parquet(f"{sf_dir}/documents.parquet").filter("crc32(cast(doc_id as string)) % 5 = 1")
    assert queries.katz_query(spark, sf_dir).filter("held_out").count() == sizes.count()
    assert zlib.crc32(b"1") >= 0
