"""Chat formatting: spans found from outside, masks, round trips, rewrites."""

import hashlib
import itertools
import json
import random
from collections import defaultdict

import pytest

from panelkit.llm import chat

CONV = "conv_id long, turn long, role string, text string"
INST = chat.InstTemplate()


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def key(row):
    return tuple((x is not None, x) for x in row)


def plain(rows):
    """The report by grouping and whole rendering."""
    talks = defaultdict(list)
    for conv, turn, role, text in rows:
        talks[conv].append((turn is None, turn or 0, role or "", text or ""))
    out = []
    for conv, turns in talks.items():
        turns = [(r, x) for _, _, r, x in sorted(turns)]
        loss = "".join(x for r, x in turns if r == "assistant")
        out.append((conv, len(turns), sha("".join(f"{r}\n{x}\n" for r, x in turns)), len(loss), sha(loss),
                    len(INST(turns))))
    return sorted(out, key=key)


ODD = ([(1, 0, "user", "</s>[INST] ok [/INST]"), (1, 1, "assistant", "</s>[INST] ok [/INST]"), (2, 0, "assistant", ""),
        (3, 0, "system", "<<SYS>> <\\<SYS>> <<</SYS>>>"), (3, 1, "system", "\n\n"), (3, 2, None, None),
        (4, None, "tool", " [\\\\INST] "), (4, None, "user", None), (4, 5, "[/ROLE]", "[ROLE] x <s>"),
        (5, 0, "user", "same"), (5, 0, "user", "same"), (5, 0, "assistant", " </s"), (6, 0, "assistant", "a </s> b"),
        (None, 0, "user", "no id"), (None, 1, "assistant", "é🙂  ] ["), (7, 0, "user", "<"),
        (7, 1, "system", "<"), (7, 2, "user", "<"), (7, 3, "assistant", ">")]
       + [(8, k, ("user", "assistant")[k % 2], f"turn {k} " + "x" * (k % 7)) for k in range(200)]
       + [(9, 0, "assistant", "long " * 200_000)])


@pytest.fixture(params=["given", "odd"])
def talks(request, spark):
    if request.param == "odd":
        names = ["piece", "start", "place", "loss"]
        df = spark.createDataFrame([(*r, *"abcd") for r in ODD], CONV + "".join(f", {n} string" for n in names))
        return df.repartition(5), ODD
    df = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    return df, [tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()]


def test_read_back(talks):
    df, rows = talks
    got = [tuple(r) for r in chat.read_back(chat.format_turns(df)).collect()]
    assert sorted(got, key=key) == plain(rows)


def test_spans_and_pieces(talks):
    df, rows = talks
    by = defaultdict(list)
    for r in chat.format_turns(df).collect():
        by[r.conv_id].append(r)
    want = defaultdict(list)
    for conv, turn, role, text in rows:
        want[conv].append((turn is None, turn or 0, role or "", text or ""))
    assert set(by) == set(want)
    for conv, turns in by.items():
        turns.sort(key=lambda r: r.place)
        output = "".join(r.piece for r in turns)
        expected = [(r, x) for _, _, r, x in sorted(want[conv])]
        assert output == INST(expected)
        for r, (role, text) in zip(turns, expected):
            assert output[r.start:r.start + len(r.piece)] == r.piece
            assert INST.unescape(output[r.text_start:r.text_end]) == text
            assert r.loss == (role == "assistant") and not r.rewritten


def test_horizon_gives_what_whole_rendering_gives(spark, monkeypatch):
    """Long conversations by window equal the same ones rendered whole."""
    df = spark.createDataFrame(ODD, CONV).where("conv_id = 8")
    windowed = [tuple(r) for r in chat.format_turns(df).collect()]

    class Unbounded(chat.InstTemplate):
        horizon = None
    assert [tuple(r) for r in chat.format_turns(df, Unbounded()).collect()] == windowed
    assert len(windowed) == 200 > chat.WHOLE


def test_escape_round_trip():
    rng = random.Random(3)
    bits = ["<", "</", "s>", "\\", "[", "]", "INST", "/INST]", "<s>", "[INST]", "SYS>>", "<</", "/ROLE]", "[ROLE]", ">", "x", " "]
    for _ in range(20_000):
        text = "".join(rng.choice(bits) for _ in range(rng.randrange(8)))
        x = INST.escape(text)
        assert INST.unescape(x) == text
        assert not any(m in x for m in ("<s>", "</s>", "[INST]", "[/INST]", "[ROLE]", "[/ROLE]", "<<SYS>>", "<</SYS>>"))
    for roles in itertools.product(("user", "assistant", "system", "tool", ""), repeat=3):
        turns = [(r, "".join(rng.choice(bits) for _ in range(4))) for r in roles]
        assert INST.read(INST(turns)) == (turns, len(INST(turns)))


def test_rewriting_templates_are_found(spark):
    rows = [(1, 0, "system", "be brief"), (1, 1, "user", "a"), (1, 2, "assistant", "b"), (1, 3, "user", "c"),
            (1, 4, "assistant", "d"), (2, 0, "user", "q"), (2, 1, "assistant", "r")]
    df = spark.createDataFrame(rows, CONV)
    template = chat.LastSystemTemplate()
    got = {r.conv_id: r for r in chat.format_conversations(df, template).collect()}
    assert got[1].rewrites == [3] and got[2].rewrites == []
    turns = [(r, x) for c, _, r, x in rows if c == 1]
    assert got[1].output == template(turns)
    assert [got[1].output[s.start:s.end] for s in got[1].loss_spans] == ["b", "d"]
    assert got[1].output.index("be brief") > got[1].output.index("b </s>")

    thinking = [(3, 0, "user", "q"), (3, 1, "assistant", "why</think>because"), (3, 2, "user", "and"),
                (3, 3, "assistant", "hm</think>so")]
    out = chat.format_conversations(spark.createDataFrame(thinking, CONV), chat.AnswersOnlyTemplate()).first()
    assert out.rewrites == [3] and "why" not in out.output
    # The first answer is no longer written as it was given, so it is not learned from.
    assert [out.output[s.start:s.end] for s in out.loss_spans] == ["hm</think>so"]


def test_false_horizon_is_an_error():
    class LooksBack(chat.InstTemplate):
        def __call__(self, turns):
            return "".join(self.turn(r, f"{k}{x}") for k, (r, x) in enumerate(turns))
    talk = chat.Conversation(LooksBack())
    with pytest.raises(ValueError, match="horizon"):
        for k in range(5):
            talk.add("user", "x")

    class Rewrites(chat.LastSystemTemplate):
        horizon = 1
    talk = chat.Conversation(Rewrites())
    with pytest.raises(ValueError, match="rewrites"):
        for role in ("system", "user", "assistant", "user"):
            talk.add(role, "x")


def test_files_and_empty_table(spark, tmp_path):
    df = spark.createDataFrame(ODD, CONV)
    path = chat.write_jsonl(df.where("conv_id = 1"), f"file://{tmp_path}/chat")
    row = json.loads(spark.read.text(path).first()[0])
    assert row["n_turns"] == 2
    assert INST.unescape(row["output"][row["loss_spans"][0]["start"]:row["loss_spans"][0]["end"]]) == "</s>[INST] ok [/INST]"
    empty = df.where("false")
    assert chat.read_back(chat.format_turns(empty)).count() == 0 and chat.format_conversations(empty).count() == 0
