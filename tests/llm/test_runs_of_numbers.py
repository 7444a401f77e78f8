"""Personal data beside other numbers, and day-first dates."""

import re

from sprintgauge.llm import pii

CASES = [("4111111111111111 123", "4111111111111111", 1), ("4111 1111 1111 1111 12/27", "4111 1111 1111 1111", 1),
         ("5 4111111111111111", "4111111111111111", 1), ("124 415-555-2671", "415-555-2671", 1),
         ("1234 4111 1111 1111 1111 999", "4111 1111 1111 1111", 1), ("1234 123-45-6789", "123-45-6789", 1),
         ("4111111111111111 7 4041894974608795 9", "4041894974608795", 2),
         ("1234567890123 42.144.35.254", "42.144.35.254", 1), ("25/12/2020", "25/12/2020", 1),
         ("4111 1111 1111 1111 25/12/2020", "25/12/2020", 2)]


def test_values_beside_numbers(spark):
    rows = [(i, f"see {c[0]} now") for i, c in enumerate(CASES)]
    got = {r.doc_id: r for r in pii.pseudonymise(spark.createDataFrame(rows, "doc_id long, text string"), "k").collect()}
    alone = [(i, c[1]) for i, c in enumerate(CASES)]
    single = {r.doc_id: r.text for r in pii.pseudonymise(spark.createDataFrame(alone, "doc_id long, text string"), "k").collect()}
    for i, (text, value, n) in enumerate(CASES):
        assert value not in got[i].text and single[i] in got[i].text and got[i].n_pseudonyms == n, (text, got[i])
        assert re.sub("[0-9]", "9", got[i].text) == re.sub("[0-9]", "9", f"see {text} now") or "." in value


def test_long_runs_end(spark):
    rows = [(0, "31/31/1999"), (1, "123456789012345678901234"), (2, "7 " * 20_000)]
    got = {r.doc_id: r for r in pii.pseudonymise(spark.createDataFrame(rows, "doc_id long, text string"), "k").collect()}
    assert [got[i].text for i in (0, 1)] == [rows[0][1], rows[1][1]] and len(got[2].text) == 40_000
