import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st

from oddrows.llm import chat

PIECES = ["<s>", "</s>", "[INST]", "[/INST]", "[ANS]", "[/SYS]", "[ROLE:x]", "\\", "<\\/s>", "[\\\\INST]", " ", "a", "\n", "é", "<", "[", "]"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=12).map("".join), st.sampled_from(["user", "assistant", "system", "", "to ol]", "é<s>"]))
def test_any_text_reads_back(text, role):
    segment, a, b = chat.render_turn(role, text)
    assert chat.parse_turn(segment) == (role, text, a, b)
    assert chat.unescape(segment[a:b]) == text
    assert len(chat._LEX.findall(segment)) == 4  # no control string of the text is live


def test_plain_text_is_not_changed():
    assert chat.render_turn("user", "hello [there] <b>")[0] == "<s>[INST] hello [there] <b> [/INST]</s>"


def test_conversations(spark):
    rows = [
        (1, 1, "assistant", "yes </s>", "z"), (1, 0, "user", None, "z"), (1, 1, "assistant", "also", "z"), (None, 0, "user", "n", "z"), (2, None, None, "x" * 300_000, "z"),
        (2, None, None, "x" * 300_000, "z"), (3, 5, "assistant", "", "z"),
    ]
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, segment string"))).collect()}
    assert got[1]["turns_sha256"] == hashlib.sha256(b"user\n\nassistant\nalso\nassistant\nyes </s>\n").hexdigest()
    assert (got[1]["loss_chars"], got[1]["loss_sha256"]) == (12, hashlib.sha256(b"alsoyes </s>").hexdigest())
    assert got[2]["n_turns"] == 2 and got[2]["loss_chars"] == 0 and got[None]["n_turns"] == 1
    assert got[3]["loss_sha256"] == hashlib.sha256(b"").hexdigest()


def test_empty_table(spark):
    assert chat.read_back(chat.format_turns(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).count() == 0
