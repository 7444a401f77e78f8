"""No word is lost to a vocabulary limit."""

from pyspark.sql import functions as F

from sprintgauge.operators import language_model as lm


def test_rare_words_keep_their_ids(spark):
    rows = spark.range(32_000).select(
        F.col("id").alias("row_ord"), F.concat_ws(" ", F.lit("common"), F.concat(F.lit("w"), F.lpad("id", 6, "0"))).alias("text"))
    words = lm.vocabulary(rows)
    got = {x.term: x.id for x in words.collect()}
    assert got == {"common": 5, **{f"w{i:06d}": i + 6 for i in range(32_000)}}
    ids = lm.encode(rows.filter("row_ord >= 31990"), words, ["row_ord"], length=4).collect()
    assert {x.row_ord: x.input_ids for x in ids} == {i: [2, 5, i + 6, 3] for i in range(31_990, 32_000)}
