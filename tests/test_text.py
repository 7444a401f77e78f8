import re

from hypothesis import given, settings, strategies as st
import pytest
from pyspark.sql import functions as F

from sprintgauge.functions import answers, text
from sprintgauge.functions.html import _text_of, html_to_text
from sprintgauge.functions.language import detect_language


def column(spark, values, make):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r.o for r in df.select("i", make(F.col("t")).alias("o")).orderBy("i").collect()]


def test_clean_ascii_equals_python(spark):
    values = ["  aéèb \t c\n", "\x1c\x1d x\x00y\x7f ", "", "日本", "a\x0b\x0cb", "plain"]
    expected = [re.sub(r"\s+", " ", re.sub(r"[^\x00-\x7F]+", " ", v)).strip() for v in values]
    assert column(spark, values, text.clean_ascii) == expected


def test_nonblank_knows_all_whitespace(spark):
    values = [None, "", "   ", "\t\n\x0b\x0c\r", "\x1c\x1d\x1e\x1f", " a "]
    assert column(spark, values, text.is_nonblank) == [False] * 5 + [True]
    assert column(spark, [" \t a b\x1f\n"], text.strip) == ["a b"]


def test_counts(spark):
    values = [None, " ", "One. Two! Three", "No end", "a.b c? ", "...", "It is v1.2. Done."]
    assert column(spark, values, text.sentence_count) == [0, 0, 3, 1, 1, 0, 2]
    assert column(spark, ["a-b, c_d 12 é!", ""], text.word_count) == [5, 0]


def test_html(spark):
    markup = ["<p>a<b>b</b></p>c", "x<!-- no --> y", "<script>var t='</p>';</script>ok",
              "<style>p{}</style>&amp;&eacute;&lt;", "plain", None, "a < b", "1 &am 2 &amp"]
    expected = ["abc", "x y", "ok", "&é<", "plain", None, "a < b", "1 &am 2 &"]
    assert column(spark, markup, html_to_text) == expected


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab <>/&;!-\"'=pscrit", max_size=60))
def test_html_parser_never_fails(markup):
    assert isinstance(_text_of(markup), str)


def test_language(spark):
    values = ["the cat and the dog", "der Hund und die Katze", "le chat et les chiens", "el perro y la",
              "xyz", "", None, "theand", "THE"]
    assert column(spark, values, detect_language) == [
        "en", "de", "fr", "es", "unknown", "unknown", "unknown", "unknown", "en"]


def test_lemmas(spark):
    values = ["The users were adding new entries", "It is a", "classes and statuses", "women chose x"]
    assert column(spark, values, text.lemmas) == [
        "user add new entry", "", "class status", "woman choose"]


@pytest.mark.parametrize("raw,value", [
    ("5", 5.0), ("5 ", 5.0), ("five", None), ("", None), ("5d", None), ("1_000", None),
    ("a###b### 5", 5.0), ("x###\n3.", 3.0), ("###-2", -2.0), ("inf", None), ("1e3", None)])
def test_parse_answer(spark, raw, value):
    assert column(spark, [raw], answers.parse_answer) == [value]


def test_prompts_keep_braces_and_marker(spark):
    prompt = column(spark, ["use {x} and {requirement_description}"], answers.zero_shot_prompt)[0]
    assert "use {x} and {requirement_description}\n###OUTPUT" in prompt
    long = " ".join(["w"] * 50)
    cut = column(spark, [long, "short ###"], lambda c: answers.truncate_prompt(c, 10))
    assert cut == ["w w w w w w w w w\n###", "short ###"]


def test_text_after_an_unclosed_silent_element_survives():
    from sprintgauge.functions.html import _text_of

    assert _text_of("<ruby>kanji<rt>kan</ruby> after text") == "kanji after text"
    assert _text_of("<div><template>x</div> after text") == " after text"
    assert _text_of("a <![CDATA[kept]]> b") == "a kept b"
    for parent in ("div", "p", "ruby", "table"):
        for silent in ("rt", "rp", "template"):
            assert _text_of(f"<{parent}>a<br><{silent}>no<b>no</{parent}>tail</b>") == "atail"
