import hashlib
import json
import sqlite3

import numpy as np
from pyspark.sql import functions as F

from loomspan.functions import text as T
from loomspan.operators import prepare
from loomspan.sources import databases, nested_usage

R = "doc_id long, role string, text string, tool_name string"


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'long' if isinstance(v, int) else 'string'}" for k, v in values.items())).select(column.alias("x")).first()["x"]


def test_embed_and_messages(spark):
    r = spark.createDataFrame([(1, "user", "é" * 5000, None), (2, "tool_result", "a  b", "Read"), (3, "assistant", " ", None), (4, "reasoning", "hm", None)], R)
    got = prepare.embed(r, lambda ts: np.array([[len(t), len(t.encode())] for t in ts]), 2).collect()
    assert [(x["doc_id"], list(x["embedding"])) for x in got] == [(1, [4096.0, 8192.0])]
    m = {x["doc_id"]: (x["speaker"], x["message"]) for x in prepare.conversation_messages(r).collect()}
    assert set(m) == {1, 2} and m[2] == ("tool", "[Read -> a b]") and len(m[1][1]) <= 150
    assert prepare.conversation_messages(r, compact=False).count() == 4


def test_hashes_and_refs(spark, tmp_path):
    field = lambda k, v: len(k).to_bytes(8, "little") + k.encode() + len(v.encode()).to_bytes(8, "little") + v.encode()
    links = "struct<legacy_turn_id:int,source_record_offset:long,event_id:string,source_tool_use_id:string>"
    rows = [("pi", "s", "/p", 3, "user", None, (None, None, None, None)), ("pi", "s", "/p", 3, "tool_use", "Read", (None, None, None, "t1")), ("pi", "", "/p", 3, "user", None, (None, None, "e1", None)), ("pi", "s", "/p", 3, "user", None, (7, 99, "e1", None)), ("pi", "sé" * 200, "/p", 3, "user", None, (7, None, None, None))]
    df = spark.createDataFrame(rows, f"source string, session_id string, source_path string, turn_id int, role string, tool_name string, links {links}")
    head = field("version", "rid1") + field("source", "pi")
    want = [
        head + field("session", "s") + field("source-path", "/p") + field("turn", "3") + field("role", "user") + field("tool", ""), head + field("session", "s") + field("source-tool-use", "t1") + field("role", "tool_use") + field("tool", "Read"),
        head + field("session", "/p") + field("event", "e1") + field("role", "user") + field("tool", ""), head + field("session", "s") + field("source-path", "/p") + field("source-record-offset", "99") + field("role", "user") + field("tool", ""),
        head + field("session", "sé" * 200) + field("source-path", "/p") + field("turn", "7") + field("role", "user") + field("tool", ""),
    ]
    assert [r[0] for r in df.select(T.record_id()).collect()] == ["rid1_" + hashlib.sha256(w).hexdigest() for w in want]
    ref = prepare.section_ref(F.lit("v"), F.lit("a:b"))
    assert tuple(one(spark, prepare.read_section_ref(ref), a=1)) == ("v", "a:b") and one(spark, prepare.read_section_ref(F.lit("x:y:z")), a=1) is None and one(spark, prepare.section_vector_id(F.lit("a"), F.lit("b"), F.lit("c")), a=1) > 0
    files = spark.createDataFrame([("a", 1, 2), ("b", 3, 4)], "source_path string, size long, mtime long")
    assert prepare.listing_fingerprint(files) == prepare.listing_fingerprint(files.orderBy(F.desc("size"))) != prepare.listing_fingerprint(files.limit(1))
    for k in (1, 2):
        prepare.replace_partitions(spark.createDataFrame([("x", k)] + [("y", 9)] * (k == 1), "s string, v int"), str(tmp_path / "t"), "s")
    assert sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "t")).select("s", "v").collect()) == [("x", 2), ("y", 9)]


def test_cursor_changes(spark):
    s = "session_id string, rows long, last_seq long, last_time long"
    got = prepare.cursor_changes(spark.createDataFrame([("a", 1, 1, 1), ("b", 2, 1, 1), ("c", 1, None, 1)], s), spark.createDataFrame([("a", 1, 1, 1), ("b", 1, 1, 1), ("d", 1, 1, 1)], s))
    assert {tuple(r) for r in got.collect()} == {("b", "changed"), ("c", "new"), ("d", "gone")}


def test_text_functions(spark):
    short = T.head_tail(100)
    r = one(spark, short(F.col("t")), t="é" * 500)
    assert len(r.encode()) <= 100 and "bytes truncated" in r and r.startswith("é") and r.endswith("é") and one(spark, short(F.col("t")), t="x") == "x"
    left = int(r.split("[... ")[1].split(" ")[0])
    assert len(("é" * 500).encode()) - left == len(r.replace(f"\n\n[... {left} bytes truncated ...]\n\n", "").encode())
    assert one(spark, T.label(F.col("t")), t="  Hi\n\x1b[31mred\x1b[0m <system-reminder>no\n</system-reminder> <b>bold</b>") == "Hi red bold" and len(one(spark, T.label(F.col("t")), t="w " * 500)) <= 150
    spans = one(spark, T.match_spans(F.col("t"), ["a.b", "C"], 2, 3), t="xx A.B yy c zz c")
    assert [(s["start"], s["end"], s["context"]) for s in spans] == [(3, 6, "xx A.B yy"), (10, 11, "yy c zz")] and one(spark, T.match_spans(F.col("t"), ["q"]), t="none") is None
    assert one(spark, T.compact_number(F.col("n")), n=1_234_567) == "1.2M" and one(spark, T.compact_number(F.col("n")), n=12) == "12" and T.since_ms("7d", 10**12) == 10**12 - 604_800_000
    assert one(spark, T.payload_text(F.col("t")), t='[{"type":"text","text":"a"},{"type":"text","text":"b"}]') == "a\nb" and one(spark, T.payload_text(F.col("t")), t='"q\\"r"') == 'q"r' and one(spark, T.payload_text(F.col("t")), t='{"a":1}') == '{"a":1}'
    assert one(spark, T.tag_value(F.col("t"), "cmd"), t="x <CMD a=1> go </cmd>") == "go" and one(spark, T.stamp_text(F.col("n")), n=0) == "-"


def test_nested_usage(spark, tmp_path):
    attr = lambda **a: [{"key": k.replace("__", "."), "value": {"intValue" if isinstance(v, int) else "stringValue": str(v)}} for k, v in a.items()]
    span = {"name": "chat", "traceId": "t", "spanId": "s", "startTimeUnixNano": "1750000000000000000", "attributes": attr(gen_ai__usage__input_tokens=100, gen_ai__usage__output_tokens=20) + [{"key": "gen_ai.usage.cache_read.input_tokens", "value": {"intValue": "40"}}, {"key": "gen_ai.response.model", "value": {"stringValue": "m"}}]}
    raw = json.dumps({"resourceSpans": [{"scopeSpans": [{"spans": [span, span, {"name": "tool", "attributes": attr(gen_ai__usage__input_tokens=5)}]}]}]})
    values = spark.createDataFrame([("/p", 0, None, raw), ("/p", 1, None, "broken"), ("/p", 2, None, None)], "source_path string, line_no long, key string, raw string")
    got = nested_usage.usage_in(values, nested_usage.span).collect()
    assert [(r["source_record_id"], r["uncached_input"], r["cache_read"], r["output"], r["timestamp_ms"], r["model"]) for r in got] == [("t:s", 60, 40, 20, 1750000000000, "m")]
    with sqlite3.connect(tmp_path / "state.vscdb") as c:
        c.executescript("CREATE TABLE ItemTable(key TEXT, value BLOB); CREATE TABLE cursorDiskKV(key TEXT, value BLOB);")
        c.execute("INSERT INTO cursorDiskKV VALUES(?, ?)", ("composerData:k1", json.dumps({"bubbles": [{"bubbleId": "b", "tokenCount": {"inputTokens": 3, "outputTokens": 4}, "usage": {"inputTokens": 3}, "createdAt": 1750000000000, "modelInfo": {"modelName": "mm"}}]}).encode()))
    got = nested_usage.usage_in(databases.editor_values(spark, str(tmp_path / "*.vscdb")), nested_usage.editor_state).collect()
    assert [(r["source_record_id"], r["session_id"], r["raw_input"], r["output"], r["model"]) for r in got] == [("b", "k1", 3, 4, "mm")]


def test_more_stores(spark, tmp_path):
    frame = lambda rows: spark.createDataFrame([("/f", json.dumps(r)) for r in rows], "source_path string, raw string")
    got = databases.opencode_objects(frame([{"id": "s"}]), frame([{"id": "m", "sessionID": "s", "role": "user", "time": {"created": 5}}]), frame([{"id": "p", "messageID": "m", "type": "text", "text": "hi"}, {"id": "q", "messageID": "m", "type": "tool"}])).collect()
    assert [(r["session_id"], r["role"], r["text"], r["ts"], r["conversation_kind"]) for r in got] == [("s", "user", "hi", 5, "main")]
    with sqlite3.connect(tmp_path / "v2.db") as c:
        c.executescript("CREATE TABLE session_message(id TEXT, session_id TEXT, type TEXT, time_created INT, data TEXT);")
        c.executemany("INSERT INTO session_message VALUES(?,?,?,?,?)", [("a", "s", "user", 1, '{"text":"hi"}'), ("b", "s", "tool", 2, '{"tool":"ls","state":{"input":{"x":1},"error":"bad"}}'), ("c", "s", "other", 3, "{}")])
    got = databases.opencode_v2_records(spark, str(tmp_path / "v2.db")).collect()
    assert sorted((r["role"], r["text"], r["tool_name"], r["tool_input"], r["tool_output"]) for r in got if r["tool_name"]) == [("assistant", "", "ls", '{"x":1}', "bad")] and len(got) == 2
    with sqlite3.connect(tmp_path / "bob.db") as c:
        c.executescript("CREATE TABLE messages(id INTEGER PRIMARY KEY, task_id TEXT, role TEXT, timestamp INT, model TEXT, tokens_in INT, tokens_out INT, cost REAL); INSERT INTO messages VALUES(1,'t','assistant',3,'m',5,6,0.5),(2,'t','user',4,NULL,9,9,9),(3,'t','assistant',5,'m',0,0,0);")
    assert [(r["uncached_input"], r["output"], r["source_cost_usd"]) for r in databases.bob_usage(spark, str(tmp_path / "bob.db")).collect()] == [(5, 6, 0.5)]


def test_labels(spark):
    say = lambda t: one(spark, T.label(F.col("t")), t=t)
    assert say("# AGENTS.md says") == "" and say("my Global Agent Preferences") == "" and say(" \n\t") == ""
    assert say("## Referenced chats with Codex:\nold talk\n## My request:\n do it\n now") == "do it now" and say("## Referenced ChatGPT conversation:\nold") == ""
    assert say("keep <skill name='x'>gone</skill>this <context>never closed") == "keep this"
    long = say("word " * 60)
    assert len(long) <= 150 and long == ("word " * 21).strip() + "…" + ("word " * 8).strip()
    assert say("x" * 400) == "x" * 109 + "…" + "x" * 40


def test_project_names_as_shown(spark):
    shown = {
        "-Users-ada-work-loom-mill": "loom-mill", "-home-ada-loom-mill": "loom-mill", "-Users-ada-loom": "~/loom", "-mnt-c-Users-ada-src-x": "x", "loom-mill": "loom-mill", "-Users-ada": "-Users-ada", "users-ada-code": "~/code", "": "", "-": "-",
    }
    df = spark.createDataFrame([(k,) for k in [*shown, None]], "p string")
    assert {r[0]: r[1] for r in df.select("p", T.project_display(F.col("p"))).collect()} == shown | {None: None}


def test_dollars(spark):
    df = spark.createDataFrame([(0,), (4_200_000,), (1_250_000_000,), (1_500_000_000_000,), (None,)], "n long")
    assert [r[0] for r in df.select(T.dollars(F.col("n"))).collect()] == ["$0.00", "$0.0042", "$1.25", "$1.5k", None]
