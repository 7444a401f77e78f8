"""Data for language models: vocabulary, encoded rows, masks, perplexity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import lexicon
from ..functions import metrics
from ..session import stage
from .features import token_frequencies, top_terms

# Ids of the special tokens; words follow.
PAD, UNK, CLS, SEP, MASK = range(5)
SPECIALS = 5
IGNORED = -100
_RANGE = 4294967296.0


def word_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"[a-z0-9_]+"), F.lit(0))


def vocabulary(df: DataFrame, text: str = "text", size: int | None = None) -> DataFrame:
    """``term, id``: words after the special tokens, most frequent first, ties by word.

    Every word by default, numbered by sorted partitions and their sizes; with
    ``size`` the at most ``size`` most frequent, and others become ``UNK``.
    """
    frequencies = token_frequencies(df, word_tokens(F.col(text)))
    if size is not None:
        ranked = top_terms(frequencies, (), size)
        return ranked.select("term", (F.col("rank") + SPECIALS - 1).alias("id"))
    # The id of a row holds its partition and, in the lower 33 bits, its place there.
    ordered = stage(frequencies.orderBy(F.desc("frequency"), "term").select(
        "term", F.monotonically_increasing_id().alias("_m")), "ordered_words")
    part, inside = F.shiftright("_m", 33), F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = ordered.groupBy(part.alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
    offsets = sizes.select("_p", (F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).alias("_before"))
    return ordered.withColumn("_p", part).join(F.broadcast(offsets), "_p").select(
        "term", (F.col("_before") + inside + SPECIALS).alias("id"))


def encode(df: DataFrame, words: DataFrame, row: list[str], text: str = "text",
           length: int = lexicon.SEQUENCE_LENGTH) -> DataFrame:
    """``input_ids`` and ``attention_mask`` of fixed length.

    Rows are cut to the sequence length and placed by key before they are
    exploded. The vocabulary may be of any size, so its join is left to the
    engine; only a small one is broadcast.
    """
    tokens = F.slice(word_tokens(F.col(text)), 1, length - 2)
    placed = df.select(*row, tokens.alias("_w")).repartition(*row)
    exploded = placed.select(*row, F.posexplode_outer("_w").alias("at", "term"))
    known = exploded.join(words, "term", "left")
    token = F.struct("at", F.coalesce("id", F.lit(UNK)).cast("int").alias("id"))
    gathered = known.groupBy(*row).agg(
        F.sort_array(F.collect_list(F.when(F.col("at").isNotNull(), token))).alias("_t")
    )
    ids = F.concat(F.array(F.lit(CLS)), F.transform("_t", lambda t: t["id"]), F.array(F.lit(SEP)))
    used = F.size("_t") + 2
    return gathered.select(
        *row,
        F.concat(ids, F.array_repeat(F.lit(PAD), length - used)).alias("input_ids"),
        F.concat(
            F.array_repeat(F.lit(1), used), F.array_repeat(F.lit(0), length - used)
        ).alias("attention_mask"),
    )


def mask_tokens(encoded: DataFrame, row: list[str], words: int, seed: int = lexicon.SEED,
                rate: float = lexicon.MASK_RATE) -> DataFrame:
    """Adds ``labels`` and masks ``input_ids``.

    Each word is chosen with probability ``rate``; of those, 80 % become the
    mask, 10 % a random word and 10 % stay. Draws come from an md5 over seed,
    row and position, so any task repeats them, and nothing is shuffled.
    """
    def draws(at: Column) -> Column:
        parts = [F.lit(str(seed)), *[F.col(k).cast("string") for k in row], at.cast("string")]
        return F.md5(F.concat_ws(":", *parts))

    def uniform(digest: Column, start: int) -> Column:
        return F.conv(F.substring(digest, start, 8), 16, 10).cast("double") / _RANGE

    def decide(token: Column, at: Column) -> Column:
        # A one-element transform computes the digest once per position.
        return F.transform(F.array(draws(at)), lambda digest: F.when(
            ((token >= SPECIALS) | (token == UNK)) & (uniform(digest, 1) < rate),
            F.struct(
                F.when(uniform(digest, 9) < 0.8, F.lit(MASK))
                .when(uniform(digest, 9) < 0.9,
                      (F.floor(uniform(digest, 17) * words) + SPECIALS).cast("int"))
                .otherwise(token).alias("shown"),
                token.alias("label"),
            ),
        ).otherwise(F.struct(token.alias("shown"), F.lit(IGNORED).alias("label"))))[0]

    decided = encoded.withColumn("_m", F.transform("input_ids", decide))
    others = [c for c in encoded.columns if c != "input_ids"]
    return decided.select(
        *others,
        F.transform("_m", lambda m: m["shown"]).alias("input_ids"),
        F.transform("_m", lambda m: m["label"]).alias("labels"),
    )


def word_losses(parts: DataFrame, text: str = "text") -> DataFrame:
    """``term, n, loss`` of held-out words under add-one unigram counts of train.

    ``parts`` carries ``part`` and the text. Train and held-out occurrences are
    counted side by side in one aggregation by word.
    """
    exploded = parts.select("part", F.explode(word_tokens(F.col(text))).alias("term"))
    counted = exploded.groupBy("term").agg(
        F.count(F.when(F.col("part") == "train", 1)).alias("seen"),
        F.count(F.when(F.col("part") == "holdout", 1)).alias("n"),
    )
    total = counted.agg((F.sum("seen") + F.count(F.lit(1))).alias("total"))
    loss = -F.log((F.col("seen") + 1) / total.scalar())
    return counted.filter("n > 0").select("term", "n", loss.alias("loss"))


def perplexity(losses: DataFrame, digits: int = 6) -> DataFrame:
    """exp of the mean loss, weighted by occurrence."""
    mean = F.sum(F.col("loss") * F.col("n")) / F.sum("n")
    return losses.agg(F.round(F.exp(mean), digits).alias("perplexity"))


def perplexity_of_rows(losses: DataFrame) -> DataFrame:
    """The same for a table with one loss per token."""
    return losses.agg(metrics.perplexity(F.col("loss")).alias("perplexity"))
