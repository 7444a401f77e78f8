"""Spelling groups against a comparison of all words."""

import random
import re
import zlib
from collections import Counter

from pyspark.sql import functions as F

from sprintgauge.llm import spelling


def plain_counts(docs):
    counts = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1:]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1:] == short for i in range(len(long)))


def plain_groups(docs):
    counts, forms, out = plain_counts(docs), {}, {}
    for w, n in counts.items():
        close = [v for v in counts if near(w, v)]
        best = min(close, key=lambda v: (-counts[v], v.encode()), default=None)
        if best is not None and counts[best] >= 10 * n:
            forms[w] = best
        out[w] = len(close)
    def root(w):
        while w in forms:
            w = forms[w]
        return w
    return {(w, forms.get(w), root(w), n, out[w], counts[forms[w]] if w in forms else None) for w, n in counts.items()}


def rows(df):
    return {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


def variants(rng, word):
    i = rng.randrange(len(word))
    return rng.choice([word[:i] + word[i + 1:], word[:i] + rng.choice("abÉé×ÿ") + word[i:], word[:i] + rng.choice("abÉé") + word[i + 1:]])


def test_groups_equal_all_pairs(spark):
    rng = random.Random(11)
    docs, i = [], 0
    bases = ["".join(rng.choice("aab") for _ in range(rng.randint(6, 9))) for _ in range(40)] + ["aaaaaaaa", "Élémentaires"]
    for base in bases:
        chain, n = base, rng.choice([2, 3, 30, 300])
        while n >= 1:
            docs.append((i, f"{chain} " * n if i % 2 else f"1{chain.upper()}, " * n))
            i, n, chain = i + 1, n // 10, variants(rng, chain)
    docs += [(None, "nullids nullids"), (1, None), (2, ""), (1, "aaaaaaaa aaaaaaaa"), (1, "aaaaaaaa aaaaaaaa")]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("word", "n", "id", "run")})
    got = rows(spelling.groups(df))
    assert got == plain_groups(docs)
    assert any(r[1] for r in got) and any(r[1] and r[1] != r[2] for r in got)


def test_whole_table_equals_all_pairs_of_its_words(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    some = docs.filter("doc_id % 5 = 0")
    assert rows(spelling.groups(some)) == plain_groups([(r.doc_id, r.text) for r in some.collect()])


def test_very_long_words_and_empty_tables(spark):
    long = "xy" * 200_000
    docs = spark.createDataFrame([(1, long), (2, long), (3, long + "z"), (4, long + "z")], "doc_id long, text string")
    got = {len(r.word): (r.n, r.n_near) for r in spelling.groups(docs, slip=1 << 40).collect()}
    assert got == {400_000: (2, 1), 400_001: (2, 1)}
    assert spelling.groups(docs.limit(0)).count() == 0
