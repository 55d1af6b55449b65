import hashlib
import json
import random

import pytest

from gridloom.llm import chat

ID_ROWS = "conv_id long, turn long, role string, text string"


def expected(turns):
    said = "".join(f"{r}\n{t}\n" for r, t in turns)
    loss = "".join(t for r, t in turns if r == "assistant")
    return len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()


def check(df, conversations):
    got = {r[0]: tuple(r)[1:5] for r in chat.digest(chat.formatted(df)).collect()}
    assert got == {k: expected(v) for k, v in conversations.items()}


def test_round_trip_of_hard_texts(spark):
    rnd = random.Random(1)
    alphabet = ["<", "|", "\\", "<|im_end|>", "<|im_start|>", "\n", "é", "a", "<|im_end|>\n", "\\n", "\x00", "𝄞"]
    text = lambda: "".join(rnd.choice(alphabet) for _ in range(rnd.randrange(12)))
    rows = [(c, t, rnd.choice(["user", "assistant", "a\nb", "\\n", "x<|y"]), text()) for c in range(120) for t in range(rnd.randrange(1, 6))]
    wanted = {}
    for c, _, role, said in rows:
        wanted.setdefault(c, []).append((role, said))
    check(chat.turns_of_table(spark.createDataFrame(rows, ID_ROWS).repartition(5), "conv_id"), wanted)


def test_nulls_ties_repeats_and_long_texts(spark):
    rows = [(1, None, "user", "first"), (1, 1, None, None), (1, 1, "assistant", "b"), (1, 1, "assistant", "b"), (None, 0, "user", ""), (2, 0, "assistant", "<|" * 100_000)]
    df = spark.createDataFrame([(*r, 5, "f") for r in rows], ID_ROWS + ", place int, mapping string")
    check(chat.turns_of_table(df, "conv_id"), {1: [("user", "first"), ("", ""), ("assistant", "b"), ("assistant", "b")], None: [("user", "")], 2: [("assistant", "<|" * 100_000)]})
    assert chat.formatted(chat.turns_of_table(df.limit(0), "conv_id")).count() == 0


def test_layouts_select_their_mappings(spark):
    records = [
        ("messages", {"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}], "extra": {"role": "x"}}),
        ("conversations", {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]}),
        ("prompt and completion", {"prompt": "q", "completion": "a", "score": 3}),
        ("prompt and completion", {"system": "be brief", "prompt": "q", "completion": "a"}),
        ("instruction", {"instruction": "q", "input": "more", "output": "a"}),
        ("instruction", {"instruction": "q", "output": "a"}),
        ("nested data", {"data": {"prompt": "q", "response": "a"}}),
        (None, {"unknown": 1}),
        (None, {"messages": []}),
        (None, None),
    ]
    rows = [(i, json.dumps(r) if r else "{broken", m) for i, (m, r) in enumerate(records)] + [(90, None, None)]
    got = {r.id: r for r in chat.read_back(chat.formatted(chat.turns_of_json(spark.createDataFrame(rows, "id long, record string, mapping string"), "id", "record"))).collect()}
    names = {r.id: r.mapping for r in chat.formatted(chat.turns_of_json(spark.createDataFrame(rows, "id long, record string, mapping string"), "id", "record")).collect()}
    assert names == {i: m for i, _, m in rows}
    for i, (m, r) in enumerate(records):
        turns = [tuple(t) for t in got[i].turns]
        assert got[i].loss == (["a"] if m else []) and turns[-1:] == ([("assistant", "a")] if m else [])
        assert len(turns) == (0 if not m else 3 if r.get("system") or r.get("input") else 2)


def test_nested_table_layout_and_unknown_columns(spark):
    df = spark.createDataFrame([(1, [("user", "q"), ("assistant", "a")], 3), (2, [], 4), (3, None, 5)], "conv_id long, turns array<struct<role:string,text:string>>, n int")
    check(chat.turns_of_table(df, "conv_id"), {1: [("user", "q"), ("assistant", "a")], 2: [], 3: []})
    with pytest.raises(ValueError):
        chat.turns_of_table(spark.range(3), "id")


def test_roles_come_back_as_they_were(spark):
    rows = [(1, 0, "gpt", "a"), (1, 1, "a\x00b", "b"), (1, 2, "\\\\n\\", "c"), (1, 3, "<|im_end|>\\\n", "d"), (1, 4, "assistant", "e")]
    check(chat.turns_of_table(spark.createDataFrame(rows, ID_ROWS), "conv_id"), {1: [(r, t) for _, _, r, t in rows]})


def test_records_of_one_id_stay_apart_and_nulls_take_nothing_away(spark):
    records = [
        (1, {"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]}),
        (1, {"messages": [{"role": "user", "content": "other"}]}),
        (2, {"messages": [{"role": "system", "content": None}, {"role": "user", "content": "q"}]}),
        (3, {"prompt": "kept out", "messages": [{"role": "user", "content": "q", "name": None}]}),
        (4, {"prompt": "q", "completion": None, "question": None}),
    ]
    df = spark.createDataFrame([(i, json.dumps(r)) for i, r in records], "id long, record string")
    got = sorted((r.id, r.mapping, [tuple(t) for t in r.turns]) for r in chat.read_back(chat.formatted(chat.turns_of_json(df, "id", "record"))).collect())
    assert got == [
        (1, "messages", [("user", "other")]),
        (1, "messages", [("user", "q"), ("assistant", "a")]),
        (2, "messages", [("system", ""), ("user", "q")]),
        (3, "messages", [("user", "q")]),
        (4, "prompt and completion", [("user", "q")]),
    ]


def test_fingerprints_are_those_of_sql(spark):
    paths = ["messages[].content", "messages[].role"]
    assert spark.sql("select xxhash64(array_join(array('messages[].content', 'messages[].role'), '\n')) as h").first().h == chat.fingerprint(paths)
    assert chat.selected(set(paths) | {"extra"}).name == "messages" and chat.selected({"role", "text"}) is None
    df = spark.createDataFrame([(1, 0, "user", "q")], ID_ROWS)
    assert chat.formatted(chat.turns_of_table(df, "conv_id")).first().fingerprint == chat.fingerprint(["role", "text", "turn"])
