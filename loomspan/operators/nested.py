"""Nested records to flat tables that keep parent and position.

Each record is visited once, depth first. The visitor emits every object tagged
with the table it belongs to: its path is the primary key within the record, the
path of the object around it the parent key. Both inputs are read once for all
related tables, which are told apart by their tags when they are written.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.functions.rawjson import dump, parse, parse_object

EMITTED = "table_tag string, parent_table string, parent_id long, path string, parent_path string, position int, payload string"
_SCHEMA = pa.schema([("table_tag", pa.string()), ("parent_table", pa.string()), ("parent_id", pa.int64()), ("path", pa.string()), ("parent_path", pa.string()), ("position", pa.int32()), ("payload", pa.string())])


def objects(value: Any, path: str, around: str) -> Iterator[tuple[str, str, int | None, dict]]:
    """(path, path of the object around it, position, object) for each object below a value, at any depth, in order; position is None for the value of a key."""
    if isinstance(value, dict):
        for k, v in value.items():
            if isinstance(v, (dict, list)):
                at = f"{path}.{k}" if path else k
                if isinstance(v, dict):
                    yield at, path, None, v
                yield from objects(v, at, path)
    elif isinstance(value, list):
        for i, v in enumerate(value):
            if isinstance(v, (dict, list)):
                at = f"{path}[{i}]"
                if isinstance(v, dict):
                    yield at, around, i, v
                yield from objects(v, at, around)


def open_calls(obj: dict) -> dict:
    """A step with its tool_calls as an array and arguments given as text replaced by what they hold."""
    calls = obj.get("tool_calls")
    if isinstance(calls, dict):
        calls = [calls]
    if not isinstance(calls, list):
        return obj
    opened = []
    for c in calls:
        if isinstance(c, dict):
            held = {k: parse(v) if isinstance(v, str) and v.lstrip()[:1] in ("{", "[") else None for k, v in c.items()}
            c = {k: held[k] if isinstance(held[k], (dict, list)) else v for k, v in c.items()}
        opened.append(c)
    return {**obj, "tool_calls": opened}


def _tag(path: str) -> str:
    """The table of a row: its path without positions."""
    out, inside = [], False
    for ch in path:
        if ch == "[":
            inside = True
        elif ch == "]":
            inside = False
        elif not inside:
            out.append(ch)
    return "".join(out)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True) if rows else [()] * 7, _SCHEMA, strict=True)], schema=_SCHEMA)


def _emitted(table: str, i: int, found: Iterator[tuple[str, str, int | None, dict]], payloads: bool) -> list[tuple]:
    """The rows of visited objects; without payloads only those that are elements of arrays."""
    return [(f"{table}.{_tag(p)}", table, i, p, around, n, dump(v) if payloads else None) for p, around, n, v in found if payloads or n is not None]


def _steps(payloads: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i, raw in zip(b["line_id"].to_pylist(), b["raw"].to_pylist(), strict=True):
                obj = parse_object(raw)
                if obj is not None:
                    if payloads:
                        rows.append(("transcript", "transcript", i, "", None, None, dump(obj)))
                    rows += _emitted("transcript", i, objects(open_calls(obj), "", ""), payloads)
            yield _batch(rows)

    return run


def _records(payloads: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i, message, usage, items, arguments in zip(*(b[c].to_pylist() for c in ("rec_id", "message", "usage", "items", "arguments")), strict=True):
                if payloads:
                    rows.append(("omp.message", "omp", i, "message", "", None, message))
                    if usage is not None:
                        rows.append(("omp.message.usage", "omp", i, "message.usage", "message", None, usage))
                for n, (payload, text) in enumerate(zip(items or [], arguments or [], strict=True)):
                    if payload is None:
                        continue
                    item = f"message.content[{n}]"
                    rows.append(("omp.message.content", "omp", i, item, "message", n, payload if payloads else None))
                    held = parse(text) if text else None
                    if payloads and isinstance(held, dict):
                        rows.append(("omp.message.content.arguments", "omp", i, f"{item}.arguments", item, None, dump(held)))
                    rows += _emitted("omp", i, objects(held, f"{item}.arguments", item), payloads)
            yield _batch(rows)

    return run


def _visited(omp: DataFrame, transcript: DataFrame, payloads: bool) -> DataFrame:
    item = F.transform("message.content", lambda x: F.when(x.isNotNull(), F.to_json(x) if payloads else F.lit("")))
    # a text without a bracket can't hold an array, nor one without a brace an object
    held = F.transform("message.content", lambda x: F.when(x["arguments"].contains("{" if payloads else "["), x["arguments"]))
    own = F.to_json(F.col("message").dropFields("content", "usage")) if payloads else F.lit(None).cast("string")
    usage = F.to_json("message.usage") if payloads else F.lit(None).cast("string")
    records = omp.where("message is not null").select("rec_id", own.alias("message"), usage.alias("usage"), item.alias("items"), held.alias("arguments")).mapInArrow(_records(payloads), EMITTED)
    lines = transcript if payloads else transcript.where(F.col("raw").contains("[") | F.col("raw").contains('"tool_calls"'))
    return records.unionByName(lines.select("line_id", "raw").mapInArrow(_steps(payloads), EMITTED))


def related_rows(omp: DataFrame, transcript: DataFrame) -> DataFrame:
    """(table_tag, parent_table, parent_id, path, parent_path, position, payload) of every object of both tables: messages, usage, items, steps, calls, args and all others.

    position is null for objects that are no elements of arrays. A message's
    payload is without its content and usage, which are rows of their own; a step
    has the empty path, and no parent path. Null and scalar elements, text that
    isn't whole JSON, and null messages and lines give no row. Repeated source
    rows repeat.
    """
    return _visited(omp, transcript, True)


def flat_rows(omp: DataFrame, transcript: DataFrame) -> DataFrame:
    """Of ``related_rows`` those of the objects in arrays."""
    return related_rows(omp, transcript).where("position is not null")


def array_objects(omp: DataFrame, transcript: DataFrame) -> DataFrame:
    """(parent_table, parent_id, path) of ``flat_rows``, each once."""
    return _visited(omp, transcript, False).where("parent_id is not null").select("parent_table", "parent_id", "path")


def flat_table(rows: DataFrame, table_tag: str, schema: str) -> DataFrame:
    """One related table from ``flat_rows``: its keys and the payload read with the table's schema."""
    return rows.where(F.col("table_tag") == table_tag).select("parent_table", "parent_id", "path", "parent_path", "position", F.from_json("payload", schema).alias("v")).select("parent_table", "parent_id", "path", "parent_path", "position", "v.*")


def write_flat(rows: DataFrame, path: str) -> None:
    """All related tables in one pass, a folder for each tag."""
    rows.write.mode("overwrite").partitionBy("table_tag").parquet(path)
