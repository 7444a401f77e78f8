"""Quality rules as a ledger: measure once, store failure bits, apply policies later.

``ledger`` evaluates every rule over every whole text in one pass of built-in
functions and keeps one bit per failed rule. A policy is a mask of rules, so a new
policy, or what a rule alone costs, is bit arithmetic over the ledger: the texts are
not read again.

Defined results: a null text has no words and fails ``few_words``; a null id keeps
its row; repeated rows stay repeated; an empty table gives an empty ledger. Only the
id and text columns are read, so other columns cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

SPACE = r"[\x20\x09-\x0D]+"

#: Rule -> whether a document fails it, from the measurements. The position is the bit.
RULES = {
    "few_words": "n_words < 50",
    "repeated_words": "100 * n_repeat_words > 50 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "duplicate_lines": "10 * n_dup_lines > 6 * n_lines",
    "word_length": "word_chars > 20 * n_words OR word_chars < 2 * n_words",
    "capitals": "2 * n_capitals > word_chars",
    "exclamations": "2 * n_exclamations > n_words",
}
#: Version -> rules that a document must pass.
POLICIES = {
    "base-1": ("few_words", "repeated_words"),
    "web-1": tuple(RULES),
}


def mask(policy: str) -> int:
    """The bits of the rules in a policy."""
    order = list(RULES)
    return sum(1 << order.index(rule) for rule in POLICIES[policy])


def measurements(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and what the rules look at, one row per row of ``docs``.

    ``n_repeat_words`` counts the words that lie in a 3-word window found at least
    twice in the text. Windows are compared by 64-bit hash: sorting (hash, place)
    pairs inside the row brings equal windows together in n log n.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("doc_id"), text.alias("text"),
        F.array_remove(F.split(text, SPACE), "").alias("words"),
        F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
    )
    words = F.col("words")
    places = F.transform(words, lambda w, i: F.struct(
        F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("i")))
    rows = rows.select(
        "doc_id", "text", "words", "lines",
        F.sort_array(F.slice(places, F.lit(1), F.greatest(F.size(words) - 2, F.lit(0)))).alias("grams"),
    )
    grams = F.col("grams")
    twice = F.filter(grams, lambda g, i: g["h"].eqNullSafe(F.get(grams, i - 1)["h"])
                     | g["h"].eqNullSafe(F.get(grams, i + 1)["h"]))
    covered = F.aggregate(
        F.sort_array(F.transform(twice, lambda g: g["i"])),
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda a, i: F.struct((a["n"] + 3 - F.greatest(a["end"] - i, F.lit(0))).alias("n"),
                              (i + 3).alias("end")),
        lambda a: a["n"].cast("long"))

    def count(pattern: str) -> Column:
        return F.regexp_count("marks", F.lit(pattern)).cast("long")

    # One look at the text for all characters that are counted; they are few.
    marks = F.array_join(F.regexp_extract_all("text", F.lit("[A-Z!#*$%&|<>]"), F.lit(0)), "")
    return rows.withColumn("marks", marks).select(
        "doc_id", F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        count("[#*$%&|<>]").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        covered.alias("n_repeat_words"),
        count("[A-Z]").alias("n_capitals"), count("!").alias("n_exclamations"),
    )


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Measurements and ``failed``, the bitmask of the rules that each row fails."""
    bits = F.lit(0).cast("long")
    for bit, rule in enumerate(RULES.values()):
        bits = bits + F.when(F.expr(rule), F.lit(1 << bit)).otherwise(0)
    return measurements(docs, id_col, text_col).withColumn("failed", bits)


def passes(failed: Column, policy: str) -> Column:
    """Whether a ledger row passes a policy."""
    return failed.bitwiseAND(F.lit(mask(policy))) == 0


def ablation(rows: DataFrame, policy: str) -> DataFrame:
    """Per rule of a policy: rows that fail it, and rows that only it rejects.

    The ledger is first summed by bitmask, at most ``2 ** len(RULES)`` rows, so the
    shuffle does not grow with the documents.
    """
    order, all_bits = list(RULES), mask(policy)
    masks = rows.groupBy("failed").agg(F.count(F.lit(1)).alias("n"))
    bits = F.array(*(F.struct(F.lit(rule).alias("rule"), F.lit(1 << order.index(rule)).alias("bit"))
                     for rule in POLICIES[policy]))
    return (
        masks.select("failed", "n", F.explode(bits).alias("r"))
        .groupBy(F.col("r.rule").alias("rule"))
        .agg(F.sum(F.when(F.col("failed").bitwiseAND(F.col("r.bit")) != 0, F.col("n")).otherwise(0)).alias("n_failed"),
             F.sum(F.when(F.col("failed").bitwiseAND(F.lit(all_bits)) == F.col("r.bit"), F.col("n"))
                   .otherwise(0)).alias("n_only"),
             F.sum("n").alias("n_rows"))
    )


def verdicts(docs: DataFrame, policy: str = "web-1") -> DataFrame:
    """The ledger with ``base_failed`` and ``kept`` under a policy."""
    rows = ledger(docs)
    return rows.withColumns({
        "base_failed": ~passes(F.col("failed"), "base-1"),
        "kept": passes(F.col("failed"), "base-1") & passes(F.col("failed"), policy),
    })


def accepted(docs: DataFrame, policy: str = "web-1") -> DataFrame:
    """The rows of ``docs`` whose text passes a policy, with all their columns."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    # The running id keeps the filter above the measurements: pushed below them, it
    # would compute them again, once for each of their uses.
    measured = ledger(rows, "row", "row.text").withColumn("at", F.monotonically_increasing_id())
    kept = measured.filter(passes(F.col("failed"), policy) & (F.col("at") >= 0))
    return kept.select(*[F.col(f"doc_id.`{c}`").alias(c) for c in docs.columns])
