import hashlib
import random
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerline.llm import chat_format
from ledgerline.llm.chat_format import PROBE, Reader, Template, format_chats, probe, read_back, unescape

SCHEMA = "conv_id long, turn long, role string, text string, seq long, loss boolean"
PIECES = ["\\", "#", "##", "### ", "### User: ", "### Assistant: ", "### Role ", ": ", "</turn>\n", "</turn>", "<", "\n", "a", "é", "\U0001f600", ""]


def brute(rows):
    chats = defaultdict(list)
    for conv, turn, role, text in rows:
        chats[conv].append((turn is None, turn or 0, role or "", text or ""))
    out = []
    for conv, turns in chats.items():
        turns.sort()
        said = "".join(f"{r}\n{t}\n" for *_, r, t in turns)
        lost = "".join(t for *_, r, t in turns if r == "assistant")
        out.append((conv, len(turns), hashlib.sha256(said.encode()).hexdigest(), len(lost), hashlib.sha256(lost.encode()).hexdigest()))
    return sorted(out, key=repr)


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, True) for r in rows], SCHEMA)


ROWS = [
    (1, 0, "system", "be brief"), (1, 1, "user", PROBE), (1, 2, "assistant", PROBE + "\\"), (2, 5, "assistant", "first"), (2, None, "user", None), (2, 1, None, "no role"), (2, 1, None, "no role"),
    (None, 0, "user", "lost"), (None, 1, "assistant", "found"), (3, 0, "User", "### User: x"), (3, 1, "tool: </turn>\n", "\\\\### Role a: "), (3, 2, "assistant", ""), (4, 0, "user", "é" * 200_000 + "</turn>\n"),
    (5, 0, "", ""), (6, 1, "user", "tie b"), (6, 1, "user", "tie a"),
]


def test_read_back_equals_the_input(spark):
    rows = ROWS + [(-7, 0, "user", PROBE), (-7, 1, "assistant", PROBE)]
    segments = format_chats(frame(spark, ROWS).select("conv_id", "turn", "role", "text").unionByName(probe(spark)))
    got = read_back(segments).collect()
    assert sorted(((r.conv_id, r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in got), key=repr) == brute(rows)
    chars = {r.conv_id: r.formatted_chars for r in got}
    told = segments.groupBy("conv_id").agg({"text": "listagg"}).collect()
    assert {r[0]: len(r[1]) for r in told} == chars


def test_segments_flags_and_faults(spark):
    got = format_chats(frame(spark, ROWS)).orderBy("conv_id", "seq").collect()
    one = [(r.text, r.loss, r.fault) for r in got if r.conv_id == 1]
    assert one[:3] == [("### System: ", False, None), ("be brief", False, None), ("</turn>\n", False, None)]
    assert [x[1] for x in one] == [False] * 7 + [True, False]
    # "### Assistant: " is a control string, "</turn> " is none, and backslashes are always escaped.
    assert one[7][0] == "\\\\\\### Assistant: </turn> ok\\\\"
    faults = {(r.conv_id, r.fault) for r in got if r.fault}
    assert (2, "start before ") in faults and (4, "user before end") in faults and (3, "start before User") in faults and (6, "user before user") in faults
    assert not any(c == 1 or c is None for c, _ in faults)


def test_long_conversation_and_many_short_ones(spark):
    rows = [(0, k, "user" if k % 2 == 0 else "assistant", f"turn {k} " * 50) for k in range(3000)] + [(k, 0, "user", "same") for k in range(1, 500)]
    random.Random(1).shuffle(rows)
    got = read_back(format_chats(frame(spark, rows)))
    found = got.collect()
    assert sorted(((r.conv_id, r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in found), key=repr) == brute(rows)
    assert {r.conv_id: r.n_faults for r in found}[0] == 0 and {r.n_faults for r in found if r.conv_id} == {1}


def test_empty_table(spark):
    empty = frame(spark, [])
    assert format_chats(empty).count() == 0 and read_back(format_chats(empty)).count() == 0


def test_other_template(spark):
    mine = Template(headers={"user": "[U]", "assistant": "[A]"}, other="[?", named="]", close="|", loss=frozenset({"user"}), follows={"start": ("assistant",), "assistant": ("user",), "user": ("end",)})
    rows = [(1, 0, "assistant", "[U]|[?]"), (1, 1, "user", "\\|]"), (2, 0, "x]|[", "y")]
    got = {r.conv_id: r for r in read_back(format_chats(frame(spark, rows), mine), mine).collect()}
    assert got[1].n_faults == 0 and got[1].loss_sha256 == hashlib.sha256(b"\\|]").hexdigest() and got[2].n_faults == 1
    assert got[2].turns_sha256 == hashlib.sha256(b"x]|[\ny\n").hexdigest()


@pytest.mark.parametrize("bad", [{"close": ""}, {"close": "\\"}, {"close": "aba"}, {"named": "::"}, {"other": "### User: x"}, {"other": "### "}])
def test_ambiguous_templates_are_refused(bad):
    with pytest.raises(ValueError):
        Template(**bad)


texts = st.lists(st.sampled_from(PIECES), max_size=12).map("".join)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.sampled_from(["system", "user", "assistant", ""]), texts), texts), max_size=6), st.integers(1, 9), st.booleans())
def test_any_text_is_read_back_from_any_pieces(turns, size, whole):
    template = Template()
    reader, got = Reader(template), []
    for role, text in turns:
        for piece, loss in template.turn(role, text):
            step = max(1, len(piece)) if whole else size
            for at in range(0, len(piece), step):
                reader.feed(piece[at : at + step], loss)
                got += reader.turns
                reader.turns = []
    assert reader.held == ""
    assert got == [(role, text, text if role == "assistant" else "") for role, text in turns]


@settings(max_examples=100, deadline=None)
@given(texts)
def test_no_control_string_stands_in_an_escaped_text(text):
    template = Template()
    escaped = template.escape(text)
    assert unescape(escaped) == text
    for control in template.controls:
        assert chat_format._plain(escaped, control, 0) == -1
