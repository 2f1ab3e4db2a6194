"""Chat formatting: exact round trips, the machine, defined cases."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from landmatch.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, ok string, segments int"
PIECES = ["</s>", "<s>", "[INST]", "[~INST]", "[/INST]", "<<SYS>>", "<</SYS>>\n", "\n<</SYS>>", "~", "<", "[", "<<", "/s>", "é𝄞", "\n", " ", "ok", "<<ROLE>>", "<~~</ROLE>>", "$1", "\\E", "\\"]


def rendered(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    return {r["conv_id"]: r for r in chat.read_back(chat.render(chat.segments(df))).collect()}


def test_round_trip_of_texts_full_of_control_strings(spark):
    rng = random.Random(7)
    roles = ["system", "user", "assistant", "tool", "<<SAYS>>", "", None]
    rows = [(c, t, rng.choice(roles), None if rng.random() < 0.1 else "".join(rng.choices(PIECES, k=rng.randrange(9))), "clash", 1) for c in range(120) for t in range(rng.randrange(1, 7))]
    rng.shuffle(rows)
    found = rendered(spark, rows)
    for c in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == c), key=lambda r: r[1])
        assert [(t["role"], t["text"]) for t in found[c]["turns"]] == [(r[2] or "", r[3] or "") for r in mine]
        assert found[c]["loss_text"] == "".join(r[3] or "" for r in mine if r[2] == "assistant")
        bare = found[c]["formatted"]
        assert sum(bare.count(x) for x in ("<s>[INST] ",)) == sum(r[2] == "user" for r in mine)


@pytest.mark.parametrize(
    ("roles", "bad", "complete"),
    [
        (["user", "assistant"], None, True), (["system", "user", "assistant", "user"], None, True), (["system", "assistant"], 1, False), (["assistant"], 0, False),
        (["user", "user", "assistant"], 1, False), (["system"], None, False), (["user", "tool", "assistant"], 1, False), ([None, "user"], 0, False),
    ],
)
def test_machine(spark, roles, bad, complete):
    got = rendered(spark, [(1, k, r, "x", "", 0) for k, r in enumerate(roles)])[1]
    assert (got["first_bad_turn"], got["complete"]) == (bad, complete)


def test_long_conversation_over_several_stretches(spark):
    n = 3 * chat.STRETCH + 5
    rows = [(5, 2 * k, ("user", "assistant")[k % 2], str(k), "", 0) for k in range(n)]
    rows[2000] = (5, 4000, "assistant", "again", "", 0)
    rows[2001] = (5, 4002, "assistant", "again", "", 0)
    got = rendered(spark, rows)[5]
    assert len(got["turns"]) == n
    assert got["first_bad_turn"] == 2000
    assert [t["text"] for t in got["turns"][1998:2002]] == ["1998", "1999", "again", "again"]


def test_nulls_ties_and_empty(spark):
    rows = [(None, None, "user", "a", "", 0), (None, None, "user", "a", "", 0), (None, 1, None, None, "", 0)]
    got = rendered(spark, rows)[None]
    assert [(t["role"], t["text"]) for t in got["turns"]] == [("user", "a"), ("user", "a"), ("", "")]
    assert got["loss_text"] == ""
    assert got["first_bad_turn"] == 1
    assert rendered(spark, []) == {}


def test_spans_are_the_loss_texts(spark):
    df = spark.createDataFrame([(1, 0, "user", "𝄞 q"), (1, 1, "assistant", "𝄞</s>!"), (1, 2, "user", "r"), (1, 3, "assistant", "z")], "conv_id long, turn long, role string, text string")
    row = chat.render(chat.segments(df)).first()
    parts = [row["formatted"][s["begin"] : s["begin"] + s["length"]] for s in row["spans"]]
    assert parts == ["𝄞<~/s>!", "z"]


def test_segments_carry_flags(spark):
    df = spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", "a")], "conv_id long, turn long, role string, text string")
    flags = [[s["loss"] for s in r["segments"]] for r in chat.segments(df).orderBy("turn").collect()]
    assert flags == [[False] * 3, [False, True, False]]
    assert chat.segments(df).where(F.col("ok")).count() == 2


def test_bad_templates_are_refused():
    mark = chat.Mark("<a>", "<b>")
    with pytest.raises(ValueError, match="overlap"):
        chat.Template({"user": mark}, mark, "<n>", ("<a>", "<b>", "a>"), {}, ())
    with pytest.raises(ValueError, match="control string"):
        chat.Template({"user": chat.Mark("x", "<b>")}, mark, "<n>", ("<a>", "<b>", "<n>"), {}, ())
