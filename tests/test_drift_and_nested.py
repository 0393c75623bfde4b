import json
from datetime import datetime

from loomspan.operators import drift, nested
from tests.conftest import item, omp_row

FIELDS = [
    ("step", "step_index", "number", False), ("step", "type", "string", False), ("step", "content", "string", True), ("step", "tool_calls", "array", True), ("call", "name", "string", False), ("call", "args", "object", False),
    ("grep", "Path", "string", False), ("grep", "Query", "string", False), ("title", "type", "string", False), ("title", "v", "number", False),
]
LINE = "line_id long, source_path string, raw string, line_no int, written_at timestamp_ntz, change string, owner string"


def lines(spark, raws, path="p"):
    return spark.createDataFrame([(i, path, r if r is None or isinstance(r, str) else json.dumps(r), i, None, "x", "x") for i, r in enumerate(raws)], LINE)


def changes(spark, steps, heads=()):
    schema = spark.createDataFrame(FIELDS, "owner string, field string, json_type string, is_optional boolean")
    return {(r["owner"], r["field"], r["change"]) for r in drift.file_changes(lines(spark, steps), lines(spark, heads), schema).collect()}


def test_changes(spark):
    call = lambda **a: {"step_index": 1, "type": "T", "tool_calls": [{"name": "grep", "args": a}]}
    assert changes(spark, [{"step_index": 1, "type": "T"}]) == set()
    assert changes(spark, [{"step_index": 1, "kind": "T"}]) == {("step", "type", "renamed")}
    assert changes(spark, [{"step_index": 1}]) == {("step", "type", "removed")}
    assert changes(spark, [{"step_index": 1, "type": "T", "extra": None}]) == {("step", "extra", "added")}
    assert changes(spark, [{"step_index": "1", "type": "T"}]) == {("step", "step_index", "retyped")}
    assert changes(spark, [{"step_index": None, "type": None}]) == set()
    assert changes(spark, [call(Path="a", query="b")]) == {("grep", "Query", "renamed")}
    assert changes(spark, [call(path="a", query="b")]) == {("grep", "Path", "removed"), ("grep", "Query", "removed"), ("grep", "path", "added"), ("grep", "query", "added")}
    assert changes(spark, [{"step_index": 1, "type": "T", "tool_calls": {"tool": "grep", "args": json.dumps({"Path": "a"})}}]) == {("step", "tool_calls", "retyped"), ("call", "name", "renamed"), ("call", "args", "retyped"), ("grep", "Query", "removed")}
    assert changes(spark, [{"step_index": 1, "type": "T", "tool_calls": [None, 3, {"name": "grep", "args": '{"Path": '}]}]) == {("call", "args", "retyped")}
    assert changes(spark, [], [{"type": "title", "v": "1"}, {"kind": "title", "v": 1}]) == {("title", "v", "retyped"), ("title", "type", "renamed")}
    assert changes(spark, ["not json", "[1]", "null", '{"step_index": NaN}', '{"a":1} x', "", None], ["{"]) == set()
    assert changes(spark, [], []) == set()


def test_union_schema_and_table(spark):
    schema = spark.createDataFrame(FIELDS, "owner string, field string, json_type string, is_optional boolean")
    t = lines(spark, [{"step_index": 1, "type": "T", "content": 5, "n": 1}, {"step_index": "2", "type": "U", "n": "a"}, {"step_index": "x", "kind": "V", "tool_calls": {"name": "g"}}])
    types = {(r["owner"], r["field"]): r["union_type"] for r in drift.union_schema(t, lines(spark, []), schema).collect()}
    assert types["step", "step_index"] == "string" and types["step", "n"] == "string" and types["step", "tool_calls"] == "object"
    rows = {r["line_no"]: r for r in drift.consistent_steps(t, lines(spark, []), schema).collect()}
    assert [rows[i]["step_index"] for i in range(3)] == ["1", "2", "x"] and [rows[i]["type"] for i in range(3)] == ["T", "U", "V"]
    assert rows[0]["content"] == 5.0 and rows[2]["tool_calls"] == '{"name":"g"}' and json.loads(rows[1]["other_fields"]) == {"n": "a"}


def test_lattice():
    b = drift.BITS
    assert drift.join() == drift.join(b["null"]) == "null" and drift.join(b["number"], b["null"]) == "number"
    assert drift.join(b["number"], b["string"]) == drift.join(b["boolean"], b["number"]) == "string"
    assert drift.join(b["object"], b["string"]) == drift.join(b["array"] | b["object"]) == "json"


def stamped(spark, rows):
    return spark.createDataFrame([(path, n, datetime(2026, 1, day), r if isinstance(r, str) else json.dumps(r)) for path, n, day, r in rows], "source_path string, line_no int, written_at timestamp_ntz, raw string")


def test_table_of_all_owners_and_log(spark):
    schema = spark.createDataFrame(FIELDS, "owner string, field string, json_type string, is_optional boolean")
    call = {"tool": "grep", "args": json.dumps({"Path": "a", "query": "b", "n": 1})}
    t = stamped(spark, [("p", 0, 3, {"step_index": 1, "type": "T", "tool_calls": [call]}), ("p", 1, 3, {"step_index": "x", "kind": "U", "more": [1]}), ("p", 2, 3, '{"step_index":')])
    h = stamped(spark, [("q", 2, 2, {"type": "session"}), ("q", 1, 2, {"type": "title", "v": 2**60 + 1}), ("r", 1, 1, {"kind": "title", "v": None})])
    rows = {(r["source_path"], r["line_no"], r["path"]): r for r in drift.consistent_table(t, h, schema).collect()}
    assert {k: r["owner"] for k, r in rows.items()} == {("p", 0, ""): "step", ("p", 0, "tool_calls[0]"): "call", ("p", 0, "tool_calls[0].args"): "grep", ("p", 1, ""): "step", ("q", 1, ""): "title", ("q", 2, ""): None, ("r", 1, ""): "title"}
    step, args = rows["p", 1, ""], rows["p", 0, "tool_calls[0].args"]
    assert step["fields"]["step"]["step_index"] == "x" and rows["p", 0, ""]["fields"]["step"]["step_index"] == "1" and step["fields"]["step"]["type"] == "U" and json.loads(step["other_fields"]) == {"more": [1]}
    assert rows["p", 0, "tool_calls[0]"]["fields"]["call"].asDict() == {"name": "grep", "args": call["args"]}
    assert args["fields"]["grep"].asDict() == {"Path": "a", "Query": "b"} and args["fields"]["step"] is None and json.loads(args["other_fields"]) == {"n": 1}
    assert rows["r", 1, ""]["fields"]["title"].asDict() == {"type": "title", "v": None} and json.loads(rows["q", 1, ""]["other_fields"]) == {"v": 2**60 + 1} and json.loads(rows["q", 2, ""]["other_fields"]) == {"type": "session"}
    log = [(r["source_path"], r["line_no"], r["owner"], r["field"], r["change"]) for r in drift.difference_log(t, h, schema).collect()]
    assert log == [
        ("r", 1, "title", "type", "renamed"), ("p", 0, "call", "args", "retyped"), ("p", 0, "call", "name", "renamed"), ("p", 0, "grep", "Query", "renamed"), ("p", 0, "grep", "n", "added"),
        ("p", 1, "step", "more", "added"), ("p", 1, "step", "step_index", "retyped"), ("p", 1, "step", "type", "renamed"),
    ]
    assert ("step", "kind") not in {(r["owner"], r["field"]) for r in drift.union_schema(t, h, schema).collect()}
    assert [(r["owner"], r["field"], r["line_no"]) for r in drift.observed(t, h, drift.agreed_fields(schema)).where("change = 'added'").orderBy("owner").collect()] == [("grep", "n", 0), ("step", "more", 1)]


def test_array_objects(spark, omp):
    rows = [
        omp_row(1, items=[item(text="a"), None, item("toolCall", arguments='{"edits":[{"h":[{"x":1},null,[{"y":2}]]},3]}')]), omp_row(2, items=None), omp_row(3, message=False), omp_row(4, items=[]),
        omp_row(5, items=[item("toolCall", arguments='{"edits":[{"a":1}')]), omp_row(6, items=[item("toolCall", arguments='[{"a":1}]')]),
    ]
    steps = [
        {"tool_calls": [{"args": {"E": [{"o": [{}]}]}}, None, "s"], "tags": ["t"]}, {"tool_calls": {"name": "x", "args": '{"E":[{"a":1}]}'}}, '{"tool_calls":[{}]', "null", '[{"a":1}]', None, {"w": {"a": [{"b": 1}]}}, {"content": '[{"not":"opened"}]', "x": []},
    ]
    got = {(r["parent_table"], r["parent_id"], r["path"]) for r in nested.array_objects(omp(rows), lines(spark, steps)).collect()}
    c = "message.content"
    assert got == {
        ("omp", 1, f"{c}[0]"), ("omp", 1, f"{c}[2]"), ("omp", 1, f"{c}[2].arguments.edits[0]"), ("omp", 1, f"{c}[2].arguments.edits[0].h[0]"), ("omp", 1, f"{c}[2].arguments.edits[0].h[2][0]"),
        ("omp", 5, f"{c}[0]"), ("omp", 6, f"{c}[0]"), ("omp", 6, f"{c}[0].arguments[0]"), ("transcript", 0, "tool_calls[0]"), ("transcript", 0, "tool_calls[0].args.E[0]"), ("transcript", 0, "tool_calls[0].args.E[0].o[0]"),
        ("transcript", 1, "tool_calls[0]"), ("transcript", 1, "tool_calls[0].args.E[0]"), ("transcript", 6, "w.a[0]"),
    }
    assert nested.array_objects(omp([]), lines(spark, [])).collect() == []


def test_flat_tables_keep_parents(spark, omp, tmp_path):
    rows = nested.flat_rows(omp([omp_row(1, items=[item("toolCall", arguments='{"edits":[{"path":"p","h":[{"n":1}]}]}')])]), lines(spark, []))
    edits = nested.flat_table(rows, "omp.message.content.arguments.edits", "path string").collect()
    hunks = nested.flat_table(rows, "omp.message.content.arguments.edits.h", "n int").collect()
    assert hunks[0]["parent_path"] == "message.content[0].arguments.edits[0]" and hunks[0]["n"] == 1 and len(edits) == 1
    nested.write_flat(rows, str(tmp_path / "flat"))
    assert spark.read.parquet(str(tmp_path / "flat")).count() == 3


def test_related_rows_have_objects_outside_arrays(spark, omp, tmp_path):
    steps = [{"step_index": 1, "tool_calls": [{"name": "x", "args": '{"E":[{"o":{"a":1}}]}'}]}, "not json"]
    rows = nested.related_rows(omp([omp_row(1, items=[item("toolCall", arguments='{"n":{"k":1}}')], output=5), omp_row(2, message=False)]), lines(spark, steps))
    got = {(r["table_tag"], r["parent_id"], r["path"], r["parent_path"], r["position"]) for r in rows.collect()}
    c, e = "message.content[0]", "tool_calls[0].args.E[0]"
    assert got == {
        ("omp.message", 1, "message", "", None), ("omp.message.usage", 1, "message.usage", "message", None), ("omp.message.content", 1, c, "message", 0),
        ("omp.message.content.arguments", 1, f"{c}.arguments", c, None), ("omp.message.content.arguments.n", 1, f"{c}.arguments.n", f"{c}.arguments", None),
        ("transcript", 0, "", None, None), ("transcript.tool_calls", 0, "tool_calls[0]", "", 0), ("transcript.tool_calls.args", 0, "tool_calls[0].args", "tool_calls[0]", None),
        ("transcript.tool_calls.args.E", 0, e, "tool_calls[0].args", 0), ("transcript.tool_calls.args.E.o", 0, f"{e}.o", e, None),
    }
    usage = nested.flat_table(rows, "omp.message.usage", "input long, output long").collect()
    assert [(r["parent_id"], r["input"], r["output"]) for r in usage] == [(1, 1, 5)]
