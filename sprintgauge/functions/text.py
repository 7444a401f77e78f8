"""Text expressions: cleaning, tokens, counts and the two treated views.

Everything is a built-in expression, so it stays inside the JVM. Classes are
spelled as ASCII ranges because ``\\s`` and ``\\b`` mean different things in
different regex engines.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from . import lexicon

WHITESPACE = r"[\t-\r\x1c-\x20]"
NON_BLANK = r"[^\t-\r\x1c-\x20]"


def as_text(value: Column) -> Column:
    """String form of a value, NULL as the empty string."""
    return F.coalesce(value.cast("string"), F.lit(""))


def is_nonblank(text: Column) -> Column:
    return F.coalesce(text.rlike(NON_BLANK), F.lit(False))


def strip(text: Column) -> Column:
    """Trim every ASCII whitespace character, not the blank alone."""
    return F.regexp_replace(text, rf"^{WHITESPACE}+|{WHITESPACE}+\z", "")


def clean_ascii(text: Column) -> Column:
    """Runs of non-ASCII characters and whitespace become one blank.

    Pulling out what stays and joining it is several times faster than
    replacing what goes, because nearly every blank would be a match.
    """
    kept = F.regexp_extract_all(text, F.lit(r"[\x00-\x08\x0e-\x1b\x21-\x7f]+"), F.lit(0))
    return F.array_join(kept, " ")


def strip_tags(text: Column) -> Column:
    """Drop comments, script/style/template bodies and tags; keep entities."""
    no_comment = F.regexp_replace(text, r"(?s)<!--.*?-->", "")
    no_script = F.regexp_replace(
        no_comment,
        r"(?is)<script[^>]*>.*?</script[^>]*>|<style[^>]*>.*?</style[^>]*>"
        r"|<template[^>]*>.*?</template[^>]*>",
        "",
    )
    return F.regexp_replace(no_script, r"<[!?/a-zA-Z][^>]*>", "")


def word_count(text: Column) -> Column:
    """Words: maximal runs of letters, digits and underscores."""
    return F.regexp_count(text, F.lit(r"[\p{L}\p{N}_]+"))


def sentence_count(text: Column) -> Column:
    """Pieces between sentence enders that hold something; NULL counts 0."""
    pieces = F.split(text, rf"[.!?]+(?:{WHITESPACE}|\z)")
    filled = F.filter(pieces, lambda piece: piece.rlike(NON_BLANK))
    return F.when(is_nonblank(text), F.size(filled)).otherwise(F.lit(0))


def tokenize(text: Column) -> Column:
    """Vectoriser tokens: lower-case word runs of two characters or more."""
    return F.regexp_extract_all(
        F.lower(clean_ascii(text)), F.lit(r"[a-z0-9_]{2,}"), F.lit(0)
    )


def lemmas(text: Column) -> Column:
    """Content words in a reduced form, blank-separated.

    Stop words are tested on the surface form and length on the reduced form.
    Irregular forms come from a small map. Each suffix rule is one pass over
    the tokens; its regex runs only on tokens that end in the suffix.
    """
    tokens = F.regexp_extract_all(F.lower(text), F.lit(r"[a-z0-9_]+"), F.lit(0))
    irregular = F.create_map(
        *[F.lit(part) for pair in lexicon.IRREGULAR_LEMMAS.items() for part in pair]
    )
    kept = F.filter(tokens, lambda token: ~token.isin(lexicon.STOP_WORDS))
    reduced = F.transform(kept, lambda token: F.when(
        token.isin(list(lexicon.IRREGULAR_LEMMAS)), F.try_element_at(irregular, token)
    ).otherwise(token))
    for suffix, pattern, tail in lexicon.SUFFIX_RULES:
        reduced = _apply_rule(reduced, suffix, pattern, "$1" + tail)
    return F.array_join(F.filter(reduced, lambda token: F.length(token) > 1), " ")


def _apply_rule(tokens: Column, suffix: str, pattern: str, replacement: str) -> Column:
    return F.transform(tokens, lambda token: F.when(
        token.endswith(suffix), F.regexp_replace(token, pattern, replacement)
    ).otherwise(token))
