"""Language identification by function words."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from . import lexicon


def detect_language(text: Column) -> Column:
    """The language whose function words occur most; ``unknown`` without any.

    The function words of all languages are picked out of the letter runs
    first, so the per-language counts go over a short array. Ties go to the
    language listed first.
    """
    everything = sorted({w for words in lexicon.LANGUAGE_WORDS.values() for w in words})
    letter_runs = F.regexp_extract_all(F.lower(text), F.lit(r"\p{L}+"), F.lit(0))
    hits = F.filter(letter_runs, lambda run: run.isin(everything))

    def count_of(found: Column, words: list[str]) -> Column:
        return F.size(F.filter(found, lambda word: word.isin(words)))

    def best_of(found: Column) -> Column:
        scores = [
            F.struct(
                count_of(found, words).alias("n"),
                F.lit(-position).alias("preference"),
                F.lit(code).alias("code"),
            )
            for position, (code, words) in enumerate(lexicon.LANGUAGE_WORDS.items())
        ]
        best = F.greatest(*scores)
        return F.when(best["n"] > 0, best["code"])

    # A one-element transform evaluates the array of hits once.
    label = F.transform(F.array(hits), best_of)[0]
    return F.coalesce(label, F.lit(lexicon.UNKNOWN_LANGUAGE))
