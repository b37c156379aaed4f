import hashlib
import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from newsloom.llm import chat

TEXT = st.text(alphabet=st.sampled_from(list("ab\\#</turn> :\n=é😀")), max_size=40)


@given(st.lists(st.tuples(st.one_of(st.sampled_from(["user", "assistant", "system", "", "User", "=x", "a: b"]), TEXT), TEXT), max_size=6))
@settings(max_examples=300, deadline=None)
def test_template_is_reversible(turns):
    done = [chat.format_turn(r, t) for r, t in turns]
    assert list(chat.parse_turns("".join(d[0] for d in done))) == turns
    for (r, t), (text, a, b) in zip(turns, done):
        assert chat.unescape(text[a:b]) == (t if r == "assistant" else "")


def digest(turns):
    loss = "".join(t for r, t in turns if r == "assistant")
    return len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()


def test_read_back(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", "\\### Assistant: </turn> ok"), (2, 0, "system", None), (2, 1, None, "x"), (2, 1, "assistant", "é"), (2, 1, "assistant", "é"), (None, 0, "user", "q")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id bigint, turn bigint, role string, text string, loss_chars int")
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.read_back(chat.format_turns(chat.rows_to_turns(df))).collect()}
    want = {}
    for c in (1, 2, None):
        own = sorted((r for r in rows if r[0] == c), key=lambda r: (r[1], r[2] or "", r[3] or ""))
        want[c] = digest([(r[2] or "", r[3] or "") for r in own])
    assert got == want
    assert chat.read_back(chat.format_turns(chat.rows_to_turns(df.limit(0)))).count() == 0


def test_layouts(spark):
    records = [
        {"prompt": "p", "completion": "c"}, {"instruction": "i", "input": "x", "output": "o"}, {"instruction": "i", "output": "o"}, {"instruction": "i", "input": "", "output": "o"},
        {"messages": [{"role": "system", "content": "s"}, {"role": "user", "content": "u"}]}, {"conversations": [{"from": "human", "value": "h"}, {"from": "gpt", "value": "g"}]},
    ]
    df = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(records)] + [(99, None)], "id bigint, record string")
    got = {}
    for r in sorted(chat.records_to_turns(df, "id", "record").collect(), key=lambda r: (r.conv_id, r.turn)):
        got.setdefault(r.conv_id, []).append((r.role, r.text))
    assert got == {0: [("user", "p"), ("assistant", "c")], 1: [("user", "i\n\nx"), ("assistant", "o")], 2: [("user", "i"), ("assistant", "o")], 3: [("user", "i"), ("assistant", "o")], 4: [("system", "s"), ("user", "u")], 5: [("user", "h"), ("assistant", "g")]}
    with pytest.raises(ValueError, match="weird"):
        chat.to_turns({"weird": 1})
    assert chat.fingerprint({"b", "a"}) == chat.fingerprint(["a", "b"]) != chat.fingerprint(["a"])


def test_nulls_and_rejects(spark):
    records = [
        '{"prompt": "a", "completion": null}', '{"messages": []}', "null", '{"messages": [{"role": "user", "content": null}, null]}', '{"messages": null, "id": 7}', '{"messages": [{"content": "x"}]}',
        '{"prompt": 0, "response": {"a": 1}}', "{broken", "[1]", '{"weird": 1}', "", None, '{"prompt": "p", "completion": "c", "response": "r"}', '{"id": 3, "meta": {"x": [1]}, "question": "q", "answer": false}', "[" * 100_000, "{}",
    ]
    df = spark.createDataFrame([(i, r, 1) for i, r in enumerate(records)], "id bigint, record string, turn int")
    got = {}
    for r in sorted(chat.records_to_turns(df, "id", "record").collect(), key=lambda r: (r.conv_id, r.turn)):
        got.setdefault(r.conv_id, []).append((r.role, r.text))
    assert got == {0: [("user", "a"), ("assistant", "")], 3: [("user", "")], 5: [("", "x")], 13: [("user", "q"), ("assistant", "false")]}
    bad = {r.conv_id: r.problem for r in chat.rejects(df, "id", "record").collect()}
    assert sorted(bad) == [6, 7, 8, 9, 12, 14, 15] and "weird" in bad[9] and "response.a" in bad[6]
    assert chat.rejects(df.limit(0), "id", "record").count() == 0


def test_rows_survive_all_layouts(spark):
    r = __import__("random").Random(3)
    rows = [(i % 9, i, r.choice(["user", "assistant", "system", "human", "gpt", "User", "", "tool:x"]), r.choice(["", "a", '"q"\\n', "### User: x</turn>", "é😀\u2028"])) for i in range(200)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    records = chat.as_records(df)
    assert {min(__import__("json").loads(x.record)) for x in records.collect()} == {"conv_id", "messages", "conversations", "turns"}
    back = chat.read_records(records, "conv_id", "record", "first")
    assert sorted(tuple(x)[:4] for x in back.collect()) == sorted(rows) and back.filter("problem IS NOT NULL").count() == 0


def test_long_texts(spark):
    long = "</turn>### \\é" * 100_000
    df = spark.createDataFrame([(1, 0, "user", long), (1, 1, "assistant", long), (1, 1, "assistant", long)], "conv_id bigint, turn bigint, role string, text string")
    (got,) = chat.read_back(chat.format_turns(chat.read_records(chat.as_records(df), "conv_id", "record", "first"))).collect()
    assert (got.n_turns, got.turns_sha256, got.loss_chars, got.loss_sha256) == digest([("user", long), ("assistant", long), ("assistant", long)])
