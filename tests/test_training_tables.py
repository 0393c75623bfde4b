"""Queries without SQL over the smallest tables, against plain Python that shares no code with them."""

import datetime as dt
import json
import os
from zoneinfo import ZoneInfo

import pyarrow.parquet as pq
import pytest

from loomspan.plans import training

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


def rows(name, *columns):
    return pq.read_table(f"{SF}/{name}.parquet", columns=list(columns)).to_pylist()


def loads(text):
    def refuse(_):
        raise ValueError

    try:
        return json.loads(text, parse_constant=refuse) if text else None
    except ValueError:
        return None


def flat(value, path):
    """The paths of all array elements that are objects."""
    if isinstance(value, dict):
        return [p for k, v in value.items() for p in flat(v, f"{path}.{k}".lstrip("."))]
    if isinstance(value, list):
        return [p for i, v in enumerate(value) for p in ([f"{path}[{i}]"] if isinstance(v, dict) else []) + flat(v, f"{path}[{i}]")]
    return []


def test_p6_found(spark):
    want = set()
    for r in rows("omp", "rec_id", "message"):
        for i, item in enumerate((r["message"] or {}).get("content") or []):
            if item is not None:
                at = f"message.content[{i}]"
                want |= {("omp", r["rec_id"], p) for p in [at, *flat(loads(item["arguments"]), f"{at}.arguments")]}
    for r in rows("transcript", "line_id", "raw"):
        o = loads(r["raw"])
        if not isinstance(o, dict):
            continue
        if isinstance(o.get("tool_calls"), dict):
            o["tool_calls"] = [o["tool_calls"]]
        for c in o.get("tool_calls") or [] if isinstance(o.get("tool_calls"), list) else []:
            for k, v in list(c.items()) if isinstance(c, dict) else []:
                if isinstance(v, str) and isinstance(loads(v), dict | list):
                    c[k] = loads(v)
        want |= {("transcript", r["line_id"], p) for p in flat(o, "")}
    got = [tuple(x) for x in training.p6_found(spark, SF).select("parent_table", "parent_id", "path").collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_p5_found(spark):
    names = {bool: "boolean", int: "number", float: "number", str: "string", dict: "object", list: "array", type(None): None}
    agreed = {}
    for f in rows("schema_fields", "owner", "field", "json_type", "is_optional"):
        agreed.setdefault(f["owner"], {})[f["field"]] = f
    want = set()

    def differences(path, owner, o):
        fields, said = agreed[owner], {}
        more = {k for k in o if k not in fields}
        replaced = set()
        for name, f in fields.items():
            if name in o:
                said[name] = o[name]
                if names[type(o[name])] not in (None, f["json_type"]):
                    want.add((path, owner, name, "retyped"))
            elif not f["is_optional"]:
                fit = [k for k in more if names[type(o[k])] in (None, f["json_type"])]
                want.add((path, owner, name, "renamed" if len(fit) == 1 else "removed"))
                if len(fit) == 1:
                    said[name] = o[fit[0]]
                    replaced.add(fit[0])
        want.update((path, owner, k, "added") for k in more - replaced)
        return said

    for r in rows("omp_head", "source_path", "raw"):
        o = loads(r["raw"])
        if isinstance(o, dict):
            owner = "title" if "title" in (o.get("type"), *[v for v in o.values() if isinstance(v, str)]) and o.get("type") != "session" else "session"
            differences(r["source_path"], owner, o)
    for r in rows("transcript", "source_path", "raw"):
        o = loads(r["raw"])
        if isinstance(o, dict):
            calls = differences(r["source_path"], "step", o).get("tool_calls")
            for c in [calls] if isinstance(calls, dict) else calls or []:
                if isinstance(c, dict):
                    said = differences(r["source_path"], "call", c)
                    args = loads(said.get("args")) if isinstance(said.get("args"), str) else said.get("args")
                    if isinstance(args, dict) and said.get("name") in agreed:
                        differences(r["source_path"], said["name"], args)
    assert {tuple(x) for x in training.p5_found(spark, SF).collect()} == want


def test_p4_found_for_iso_stamps(spark):
    """Of the forms that Python reads by itself, with a zone or in that of the machine, all come out, at the same instant."""
    zone = {m["machine"]: m["zone"] for m in rows("machines", "machine", "zone")}
    want = {}
    for r in rows("omp", "rec_id", "machine", "timestamp", "message"):
        for field, text in (("omp.timestamp", r["timestamp"]), ("omp.message.timestamp", (r["message"] or {}).get("timestamp"))):
            if text and len(text) > 15 and text[4] == "-" and text[10] in "T ":
                try:
                    t = dt.datetime.fromisoformat(text)
                except ValueError:
                    continue
                if not (len(text) == 24 and text.endswith("Z")):
                    t = t if t.tzinfo else t.replace(tzinfo=ZoneInfo(zone[r["machine"]]))
                    want[field, r["rec_id"]] = int((t - dt.datetime(1970, 1, 1, tzinfo=dt.UTC)) // dt.timedelta(milliseconds=1))
    got = {(r["field"], r["row_id"]): r["utc_ms"] for r in training.p4_found(spark, SF).collect()}
    assert len(want) > 100 and {k: got.get(k) for k in want} == want
