"""Chat formatting: layouts found by fingerprint, exact round trips through the template, and answers to odd rows."""

import hashlib
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from grainwise.llm import chat, queries

SMALL = "/root/testdata/sf0.001"
CONTROL = ["<turn ", "</turn>\n", ">\n", "\\", "\n", "<", "turn", "/", "x", "é", "漢", "</turn", "\\<turn", "😀", " ", ">"]


def test_layouts_of_records_read_from_json(spark, tmp_path):
    lines = [
        '{"messages": [{"role": "user", "content": "a"}, {"role": "assistant", "content": null}]}',
        '{"messages": [{"content": null, "role": "user"}]}',
        '{"conversations": [{"from": "human", "value": "a"}, {"from": "gpt", "value": "b"}]}',
        '{"chat": {"turns": [{"speaker": "bot", "text": "hi"}]}}',
        '{"prompt": "p", "completion": "c"}',
        '{"response": "r", "prompt": "p"}',
        '{"system_prompt": "s", "question": "q", "response": "r"}',
        '{"instruction": "i", "output": "o"}',
        '{"instruction": "i", "input": "n", "output": "o"}',
        '{"system": "s", "messages": [{"role": "user", "content": "a"}]}',
        '{"messages": []}',
        '{"prompt": "p"}',
        '{"prompt": "p", "completion": "c", "output": "of another layout"}',
    ]
    (tmp_path / "records.json").write_text("\n".join(f'{{"id": {i}, ' + x[1:] for i, x in enumerate(lines)))
    rows = chat.canonical_turns(spark.read.json(str(tmp_path)), ("id",)).collect()
    got = {r["id"]: (r["layout"], r["turns"] and [tuple(t) for t in r["turns"]]) for r in rows}
    assert [got[i] for i in range(len(lines))] == [
        ("messages", [("user", "a"), ("assistant", "")]), ("messages", [("user", "")]),
        ("conversations", [("user", "a"), ("assistant", "b")]), ("dialog", [("assistant", "hi")]),
        ("prompt", [("user", "p"), ("assistant", "c")]), ("prompt_response", [("user", "p"), ("assistant", "r")]),
        ("question", [("system", "s"), ("user", "q"), ("assistant", "r")]), ("instruction", [("user", "i"), ("assistant", "o")]),
        ("instruction", [("user", "i"), ("user", "n"), ("assistant", "o")]), ("system_messages", [("system", "s"), ("user", "a")]),
        ("messages", []), (None, None), (None, None)]


def test_a_new_mapping_is_data_and_two_of_one_fingerprint_are_refused(spark):
    own = chat.Mapping("qa", (chat.Turn("q", "user"), chat.Turn("a.body", "assistant")))
    df = spark.sql("SELECT 1 AS id, 'why' AS q, named_struct('body', 'so', 'votes', CAST(NULL AS INT)) AS a")
    assert chat.canonical_turns(df, ("id",), (own,)).first()["turns"][1]["text"] == "so"
    assert chat.canonical_turns(df, ("id",)).first()["turns"] is None
    with pytest.raises(ValueError, match="one fingerprint"):
        chat.registry((own, chat.Mapping("other", own.parts)))


def test_the_fingerprint_is_of_paths_alone(spark):
    a = spark.sql("SELECT 'x' AS b, named_struct('z', 1, 'y', 'v') AS a")
    b = spark.sql("SELECT named_struct('y', 'other', 'z', 2) AS a, 'w' AS b, CAST(NULL AS INT) AS c")
    marks = [df.select(chat.schema_fingerprint(df)).first()[0] for df in (a, b)]
    assert marks[0] == marks[1] == chat.fingerprint_of(["b", "a.z", "a.y"])


def test_round_trip_of_control_strings(spark):
    pick = random.Random(7)
    say = lambda: "".join(pick.choices(CONTROL, k=pick.randint(0, 9)))
    convs = [[(pick.choice(["user", "assistant", say()]), say()) for _ in range(pick.randint(0, 5))] for _ in range(3_000)]
    for turns in convs:
        formatted, spans = chat.format_turns(turns)
        assert chat.read_turns(formatted) == turns
        assert [chat.unescape(formatted[s:e]) for s, e in spans] == [t for r, t in turns if r == "assistant"]
    df = spark.createDataFrame(list(enumerate(convs[:500])), "key long, turns array<struct<role:string,text:string>>")
    rows = chat.format_chats(df).collect()
    assert {r["key"]: chat.read_turns(r["formatted"]) for r in rows} == dict(enumerate(convs[:500]))


def want(turns):
    said = "".join(t for r, t in turns if r == "assistant")
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(said), sha(said), len(chat.format_turns(turns)[0]))


def rows_of(df):
    return {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"], r["formatted_chars"]) for r in df.collect()}


def test_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(chat, "HELD", 1_000)
    schema = "conv_id long, turn long, role string, text string, layout string, messages string, __mark int"
    long = "</turn>\n" * 50_000
    rows = [(1, 1, "assistant", long, "x", "y", 1), (1, None, None, None, None, None, None), (2, 0, "user", "", "x", "y", 1), (2, 0, "user", "", "x", "y", 1),
            (3, 0, "assistant", "b", "x", "y", 1), (3, 0, "assistant", "a", "x", "y", 1), (None, 0, "user", "n", "x", "y", 1),
            (4, 0, "user", "q", "", "", 0), (4, 1, "assistant", "a", "", "", 0)]
    df = spark.createDataFrame(rows, schema)
    added = [("user", chat.SAYS), ("assistant", chat.SAYS)]
    assert rows_of(chat.op11_chat(df)) == {
        1: want([("", ""), ("assistant", long)]), 2: want([("user", ""), ("user", "")]), 3: want([("assistant", "a"), ("assistant", "b")]),
        None: want([("user", "n")]), 4: want([("user", "q"), ("assistant", "a")]), -7: want(added)}
    assert rows_of(chat.op11_chat(df.limit(0))) == {-7: want(added)}
    unknown = chat.format_chats(df.select(F.lit(1).alias("key"), F.lit(None).cast(chat.TURNS).alias("turns")).limit(1)).first()
    assert unknown["formatted"] is None and unknown["loss"] is None


def test_query_matches_its_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{SMALL}/conversations.parquet'")
    sql = {r[0]: tuple(r[1:]) for r in con.execute(chat.OP11_SQL).fetchall()}
    assert rows_of(queries.QUERIES["op11_chat"](spark, SMALL)) == sql and len(sql) == 21
