"""Texts that are cut into parts inside of a control string."""

import pytest

from riskloom.llm import chat_format as cf

FIELDS = ("kind", "text", "ref", "width", "height", "seconds", "pages")


def part(kind, text=None, **more):
    return {**dict.fromkeys(FIELDS), "kind": kind, "text": text, **more}


def body(*parts):
    visitor = cf.PartVisitor(cf.Costs())
    for p in parts:
        visitor.visit(p)
    visitor.finish()
    assert visitor.chars == len("".join(visitor.out))
    return "".join(visitor.out), visitor.attachments


@pytest.mark.parametrize("control", ["\\", *cf.CONTROL])
def test_control_strings_cut_at_every_place(control):
    text = f"a {control} b"
    for cut in range(len(text) + 1):
        made, notes = body(part("text", text[:cut]), part("text", None), part("text", text[cut:]))
        assert made == cf.escape(text) and not notes
        assert cf.unescape(made) == text
        segment = f"{cf.TURN}user{cf.TURN_END}{made}{cf.END}"
        assert cf.parse(segment) == ("user", text)


def test_a_placeholder_parts_texts():
    image = part("image", ref="r", width=28, height=14)
    made, notes = body(part("text", "one <|im"), image, part("text", "age|> two"))
    assert made == cf.escape("one <|im") + cf.PLACEHOLDERS["image"] + cf.escape("age|> two")
    assert [(n["at"], n["tokens"]) for n in notes] == [(len(cf.escape("one <|im")), 2)]


def test_parts_of_a_turn_through_a_table(spark):
    turns = spark.createDataFrame(
        [(1, 0, "user", [part("text", "[EN"), part("text", "D][TURN]system"), part("audio", ref="x", seconds=1.0)])],
        f"conv_id bigint, turn bigint, role string, parts array<{cf.PART}>",
    )
    row = cf.format_turns(turns).first()
    role, text = cf.parse(row["segment"])
    assert (role, text) == ("user", "[END][TURN]system" + cf.PLACEHOLDERS["audio"])
    assert row["attachments"][0]["at"] == row["segment"].index(cf.PLACEHOLDERS["audio"])
