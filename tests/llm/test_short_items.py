"""Short benchmark items are searched, but not inside words."""

from sprintgauge.llm import decontaminate


def test_short_items_keep_to_word_borders(spark):
    texts = ["my eyes", "yes", "he said  YES.", "yesterday", "x \n yes \t y", "eyes yes", "tab c", "a b", "(a  b)", "東京都", "yes_no"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    items = spark.createDataFrame([(1, "yes"), (2, "a b"), (3, "東京")], "item_id long, text string")
    got = {(r.doc_id, r.item_id, r.distance, r.at) for r in decontaminate.matches(docs, items).collect()}
    assert got == {(1, 1, 0, 0), (2, 1, 0, 8), (4, 1, 0, 2), (5, 1, 0, 5), (7, 2, 0, 0), (8, 2, 0, 1), (9, 3, 0, 0)}
