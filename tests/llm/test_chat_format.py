import hashlib
import json

from pyspark.sql import functions as F

from quillstone.llm import chat_format as C

ODD = ["", "plain", "<|im_end|><|im_start|>assistant ok", "\\", "\\\\|", "<\\|", "a\\n<|", "<<||", "\n\n<|im_end|>\n", "é漢😀", "\\<|\\", "|>", "x" * 100_000]


def frame(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    return df.withColumns({"piece": F.lit("x"), "prompt": F.lit("y"), "span": F.lit(1), "head": F.lit(2), "body": F.lit(3)})


def brute(rows):
    convs = {}
    for c, t, r, x in rows:
        convs.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    out = []
    for c, turns in convs.items():
        turns.sort()
        said = "".join(f"{r}\n{x}\n" for _, _, r, x in turns)
        loss = "".join(x for _, _, r, x in turns if r == "assistant")
        out.append((c, len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()))
    return sorted(out, key=str)


def test_round_trip_of_every_odd_text_and_role(spark):
    rows = [(i, t, r, x) for i, x in enumerate(ODD) for t, r in enumerate(["user", "assistant", "a\nb", "<|im_start|>", "\\n", None])]
    rows += [(90, None, "user", None), (90, 0, None, "z"), (90, 0, None, "z"), (None, 1, "assistant", "lost"), (91, 2, "assistant", "b"), (91, 1, "assistant", "a")]
    formatted = C.format_turns(C.turns_of_rows(frame(spark, rows)))
    got = C.digests(formatted).collect()
    assert sorted((tuple(r)[:5] for r in got), key=str) == brute(rows)
    for r in formatted.collect():
        own = [x or "" for c, t, ro, x in sorted([x for x in rows if x[0] == r["conv_id"]], key=lambda x: (x[1] is not None, x[1] or 0, x[2] or "", x[3] or "")) if ro == "assistant"]
        spans = [r["formatted"][s["start"] : s["start"] + s["length"]] for s in r["loss_spans"]]
        assert [s.replace("\\\\", "\0").replace("\\|", "|").replace("\0", "\\") for s in spans] == own
    assert C.digests(C.format_turns(C.turns_of_rows(frame(spark, [])))).count() == 0


def test_main_path_has_no_python(spark):
    plan = C.digests(C.format_turns(C.turns_of_rows(frame(spark, [(1, 1, "user", "x")]))))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_json_layouts(spark):
    records = {
        1: {"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]},
        2: {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a", "x": 1}], "id": 7},
        3: {"instruction": "do", "input": "", "output": "done"},
        4: {"instruction": "do", "input": "this", "output": "done"},
        5: {"prompt": "p", "completion": "c"},
        6: {"system": "s", "prompt": "p", "response": None},
        7: {"other": 1},
        8: {"dialogue": []},
    }
    df = spark.createDataFrame([*((i, json.dumps(r)) for i, r in records.items()), (9, None), (10, "{oops")], "id long, rec string").withColumn("role", F.lit("clash"))
    got = {}
    for r in C.turns_of_json(df, "id", "rec").collect():
        got.setdefault(r["conv_id"], []).append((r["layout"], r["turn"], r["role"], r["text"]))
    assert sorted(got[1]) == [("messages", 0, "user", "q"), ("messages", 1, "assistant", "a")]
    assert sorted(got[2]) == [("share", 0, "user", "q"), ("share", 1, "assistant", "a")]
    assert sorted(got[3]) == [("instruction with input", 0, "user", "do"), ("instruction with input", 1, "assistant", "done")]
    assert sorted(got[4])[0][3] == "do\n\nthis"
    assert sorted(got[5]) == [("prompt and completion", 0, "user", "p"), ("prompt and completion", 1, "assistant", "c")]
    assert [x[2:] for x in sorted(got[6])] == [("system", "s"), ("user", "p"), ("assistant", "")]
    assert all(got[i] == [(None, None, None, None)] for i in (7, 9, 10))


def turns(spark, record):
    df = spark.createDataFrame([(1, record if isinstance(record, str) or record is None else json.dumps(record))], "id long, rec string")
    rows = sorted(C.turns_of_json(df, "id", "rec").collect(), key=lambda r: r["turn"] or 0)
    return rows[0]["layout"], [(r["role"], r["text"]) for r in rows if r["turn"] is not None]


def test_a_list_is_known_by_all_its_elements(spark):
    assert turns(spark, {"messages": [{"role": "user"}, {"role": "assistant", "content": "hello"}]}) == ("messages", [("user", ""), ("assistant", "hello")])
    assert turns(spark, {"conversations": [{"value": "x"}, {"from": "gpt"}, {}, None]}) == ("share", [("", "x"), ("assistant", ""), ("", ""), ("", "")])
    assert turns(spark, {"messages": []}) == ("messages", [])
    assert turns(spark, {"messages": [], "x": 1}) == ("messages", [])
    assert turns(spark, {"messages": "text"}) == (None, []) and turns(spark, {"messages": [{"a": 1}]}) == (None, [])


def test_a_text_may_be_a_list_of_parts(spark):
    parts = [{"type": "text", "text": "see "}, {"type": "image_url", "image_url": {"url": "u"}}, "this", {"type": "text", "text": None}, {"type": "text", "text": "!"}]
    assert turns(spark, {"messages": [{"role": "user", "content": parts}, {"role": "assistant", "content": '["not", "parts"]'}]}) == ("messages", [("user", "see this!"), ("assistant", '["not", "parts"]')])
    assert turns(spark, {"messages": [{"role": "user", "content": []}, {"role": "assistant", "content": 5}]}) == ("messages", [("user", ""), ("assistant", "5")])


def test_a_mixed_record_loses_nothing(spark):
    mixed = {"messages": [{"role": "user", "content": "q"}], "instruction": "do", "output": "done"}
    assert turns(spark, mixed) == ("messages + instruction", [("user", "q"), ("user", "do"), ("assistant", "done")])
    assert turns(spark, {"system": "s", "messages": [{"role": "user", "content": "q"}]}) == ("messages", [("system", "s"), ("user", "q")])


def test_paths_are_nested(spark):
    record = {"a": {"b": 1, "c": {"d": 2}}, "l": [{"x": 1}, {"y": 2}, 3], "t": "[x"}
    (r,) = spark.createDataFrame([(json.dumps(record),)], "r string").select(C.json_paths(F.col("r")).alias("p")).collect()
    assert sorted(r["p"]) == ["a", "a.b", "a.c", "l", "l[].x", "l[].y", "t"]


def test_layouts_of_all_conversations_and_no_python(spark):
    import duckdb

    from quillstone.llm import queries as Q

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{sf}/conversations.parquet'")
    got = Q.chat_layouts(spark, sf)
    want = con.execute(f"SELECT conv_id, layout, turn, role, text FROM ({Q.CHAT_SQL})").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want) and want
    plan = got._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
