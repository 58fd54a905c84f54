import hashlib
import json

import pytest

from rankframe.llm import chat

TURNS = "conv_id long, turn long, role string, text string, extra string"
TRICKY = ["", "plain", "</s>[INST] ok [/INST]", "<|im_end|>\n<|im_start|>user<|im_sep|>", "a\\b\\\\", "<\\|im", "[[<<\\", "\n\n", "日本🙂<"]


def digests(turns):
    """Brute force per conversation, from the raw turns."""
    out = {}
    for conv in {t[0] for t in turns}:
        own = sorted((t for t in turns if t[0] == conv), key=lambda t: (t[1] is not None, t[1] or 0, segment(t)))
        every = "".join(f"{t[2] or ''}\n{t[3] or ''}\n" for t in own)
        learned = "".join(t[3] or "" for t in own if t[2] == "assistant")
        out[conv] = (len(own), hashlib.sha256(every.encode()).hexdigest(), len(learned),
                     hashlib.sha256(learned.encode()).hexdigest(), sum(len(segment(t)) for t in own))
    return out


def segment(t):
    esc = lambda s: "".join(c + "\\" if c in "<[\\" else c for c in s or "")
    return f"<|im_start|>{esc(t[2])}<|im_sep|>{esc(t[3])}<|im_end|>\n"


def run(spark, turns):
    df = spark.createDataFrame([(*t, "x") for t in turns], TURNS)
    rows = chat.read_back(chat.format_turns(chat.canonical_turns(df))).collect()
    return {r[0]: tuple(r)[1:] for r in rows}


def test_round_trip_with_control_strings(spark):
    turns = [(c, i, ("user", "assistant", "<|odd|>", None)[i % 4], t) for c in range(3) for i, t in enumerate(TRICKY)]
    turns += [(7, 0, "user", None), (7, 0, "user", None), (7, None, "assistant", "x"), (None, 0, "assistant", "y")]
    assert run(spark, turns) == digests(turns)


def test_segments_hold_no_foreign_marker(spark):
    df = spark.createDataFrame([(1, i, "user", t, "x") for i, t in enumerate(TRICKY)], TURNS)
    for r in chat.format_turns(chat.canonical_turns(df)).collect():
        inner = r.formatted.removeprefix("<|im_start|>user<|im_sep|>").removesuffix("<|im_end|>\n")
        assert "<|" not in inner and "</s>" not in inner and "[INST]" not in inner


def test_empty_table(spark):
    assert run(spark, []) == {}


RECORDS = [
    {"messages": [{"role": "system", "content": "s"}, {"role": "human", "content": "q"}, {"role": "gpt", "content": "a"}]},
    {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}], "id": 5},
    {"instruction": "do", "input": "this", "output": "done"},
    {"instruction": "do", "output": "done", "unrelated": {"deep": [1, {"x": 2}]}},
    {"prompt": "p", "completion": None, "system": ""},
    {"data": {"prompt": {"text": "p"}, "reply": {"text": "r"}}},
    {"strange": 1},
    [],
]
WANTED = [
    [("system", "s"), ("user", "q"), ("assistant", "a")], [("user", "q"), ("assistant", "a")],
    [("user", "do\nthis"), ("assistant", "done")], [("user", "do"), ("assistant", "done")],
    [("user", "p")], [("user", "p"), ("assistant", "r")], [], [],
]


def test_heterogeneous_records(spark):
    rows = [(i, json.dumps(r)) for i, r in enumerate(RECORDS)] + [(90, None), (91, "{broken")]
    df = spark.createDataFrame(rows, "conv_id long, record string")
    got = {}
    for r in chat.canonical_turns(df).orderBy("conv_id", "turn").collect():
        got.setdefault(r.conv_id, []).append((r.role, r.text))
    assert got == {i: w for i, w in enumerate(WANTED) if w}
    assert sum(r.records for r in chat.unmapped(df).collect()) == 4


def test_typed_columns_share_the_fingerprint(spark):
    df = spark.createDataFrame([(1, "do", "", "done")], "conv_id long, instruction string, input string, output string")
    assert [(r.role, r.text) for r in chat.canonical_turns(df).orderBy("turn").collect()] == [("user", "do"), ("assistant", "done")]
    with pytest.raises(ValueError):
        chat.canonical_turns(spark.createDataFrame([(1, "x")], "conv_id long, nothing string"))


def test_clashing_extra_columns(spark):
    df = spark.createDataFrame([(1, 0, "user", "hi", "p", "c")],
                               "conv_id long, turn long, role string, text string, prompt string, completion string")
    assert [tuple(r) for r in chat.canonical_turns(df).collect()] == [(1, 0, "user", "hi")]


def test_layouts_are_distinct():
    assert len(chat.fingerprint_table(chat.MAPPINGS)) == sum(2 ** len(m.optional) for m in chat.MAPPINGS)
