"""Every speaker's perspective is the whole dialogue, however long."""

from sprintgauge.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string"


def test_a_speaker_silent_in_a_chunk(spark):
    rows = [(c, i, "ann" if i == 0 else ("bob", "cat")[i % 2], str(i)) for c in (1, None) for i in range(150)]
    got = {(r.conv_id, r.chunk, r.speaker): r for r in chat.perspectives(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert set(got) == {(c, k, s) for c in (1, None) for k in range(3) for s in ("ann", "bob", "cat")}
    assert got[1, 1, "ann"].mask == "" and got[1, 1, "ann"].n_turns == 64 and "<|im_start|>user name=bob" in got[1, 1, "ann"].text
    assert got[1, 0, "ann"].mask and all(got[1, k, "bob"].mask for k in range(3))


def test_speakers_stay_apart(spark):
    names = ["a b", "a_b", "a\nb", "a\\sb", "a\\nb"]
    rows = [(1, i, n, str(i)) for i, n in enumerate(names)]
    got = chat.perspectives(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len({r.speaker for r in got}) == len(got) == len(names)
    assert all(len(r.mask.split(",")) == 1 and "\n" not in r.speaker and " " not in r.speaker for r in got)
