import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st

from weftline.llm import chat

CONTROL = st.sampled_from(["<|im_start|>", "<|im_end|>", "<\\|", "\n", "assistant\n", "\\", "é", "x"])
TEXTS = st.lists(CONTROL, max_size=6).map("".join)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "sys\ntem", "\\n|<|"]), TEXTS), max_size=5))
def test_round_trip(turns):
    out, spans = chat.locate(turns, chat.chatml)
    assert chat.parse_chatml(out) == turns
    assert [chat.unescape(out[s[3] : s[4]]) for s in spans] == [t for _, t in turns]
    assert "".join(out[s[1] : s[2]] for s in spans) == out


def test_rewriting_template_is_detected():
    def forgets(turns):  # earlier assistant texts are dropped
        return "".join(f"[{r}] {t if r != 'assistant' or i == len(turns) - 1 else ''};" for i, (r, t) in enumerate(turns))

    turns = [("user", "a"), ("assistant", "b"), ("user", "c")]
    assert chat.format_turns(turns, forgets, ("assistant",))[3:] == ([], True)
    assert chat.format_turns(turns[:2], forgets, ("assistant",))[4] is False


def test_rewriting_for_some_prefixes_is_detected():
    def forgets(turns):  # only when the last turn is a user's
        return "".join(f"[{r}] {'' if r == 'assistant' and turns[-1][0] == 'user' else t};" for r, t in turns)

    for n in (64, 66, 67):
        turns = [("user" if i % 2 == 0 else "assistant", f"t{i}") for i in range(n)]
        assert chat.format_turns(turns, forgets, ("assistant",))[3:] == ([], True)


def test_long_conversation():
    turns = [("user" if i % 2 else "assistant", f"<|{i}") for i in range(3000)]
    out, spans = chat.locate(turns, chat.chatml)
    assert [chat.unescape(out[s[3] : s[4]]) for s in spans] == [t for _, t in turns]
    numbered = lambda turns: "".join(f"{i}:{t}|" for i, (_, t) in enumerate(turns))  # noqa: E731  not a concatenation
    out, spans = chat.locate(turns[:100], numbered)
    assert [out[s[3] : s[4]] for s in spans] == [t for _, t in turns[:100]]


def test_table(spark):
    rows = [(1, 1, "assistant", None), (1, 0, "user", "q"), (1, None, None, "first"), (2, 0, "assistant", "a"), (2, 0, "assistant", "a"), (None, 0, "user", "")]
    frame = spark.createDataFrame([(*r, 0) for r in rows], "conv_id long, turn long, role string, text string, n_turns long")
    found = {r["conv_id"]: r for r in chat.read_back(chat.format_conversations(frame)).collect()}
    assert {k: r["n_turns"] for k, r in found.items()} == {1: 3, 2: 2, None: 1}
    assert found[1]["turns_sha256"] == hashlib.sha256(b"\nfirst\nuser\nq\nassistant\n\n").hexdigest()
    assert (found[2]["loss_chars"], found[2]["loss_sha256"]) == (2, hashlib.sha256(b"aa").hexdigest())
    assert chat.format_conversations(frame.limit(0)).count() == 0


def test_prefixes_are_rendered_whatever_a_template_declares():
    seen = []

    def template(turns):
        seen.append(len(turns))
        return chat.chatml(turns)

    template.concatenates = True
    chat.locate([("user", "a"), ("assistant", "b"), ("user", "c")], template)
    assert sorted(set(seen)) == [1, 2, 3] and len(seen) == 9
