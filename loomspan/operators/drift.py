"""Raw lines whose fields drift between files, read into one table, and what changed in each file.

Every line is visited once. The visit gives the schema of each object as the
fields it has, with a bit for each JSON type. Schemas fold by file, equal ones into
one and their types by bitwise or, which is the join of the type lattice: a field
seen as number and string becomes string, anything else mixed becomes JSON text.
What a file changes is read off its folded schemas: a field that lifts its agreed
type in the lattice is retyped, and what is missing or more is renamed, removed or
added. All of it combines before the shuffle, so a file of any number of lines
costs a row for each distinct schema. The union of all files' types is what
values are cast to.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspan.functions.rawjson import dump, kind, parse_object

BITS = {"null": 1, "boolean": 2, "number": 4, "string": 8, "object": 16, "array": 32}
OBSERVED = "source_path string, owner string, shape string, line_no int"
TYPED = "source_path string, owner string, field string, change string, mask int, line_no int"
OBJECTS = "source_path string, line_no int, written_at timestamp_ntz, owner string, path string, held map<string,string>, other_fields string, changes array<struct<field:string,change:string>>"
HEADS = ("title", "session")
_NUMBER = re.compile(r"[+-]?[0-9]{1,300}(\.[0-9]+)?")

Agreed = dict[str, dict[str, tuple[str, bool]]]


def agreed_fields(schema_fields: DataFrame) -> Agreed:
    """owner -> field -> (JSON type, optional); schema_fields is the table of what was agreed, a row for each field."""
    out: Agreed = {}
    rows = schema_fields.select("owner", "field", "json_type", "is_optional").where("owner is not null and field is not null").collect()
    for r in rows:
        out.setdefault(r["owner"], {})[r["field"]] = (r["json_type"], bool(r["is_optional"]))
    return out


def join(*masks: int) -> str:
    """The type that holds values of all masks: null below all, string above number and boolean, json on top."""
    m = 0
    for x in masks:
        m |= x
    m &= ~BITS["null"]
    one = {0: "null", **{b: t for t, b in BITS.items()}}.get(m)
    return one or ("json" if m & (BITS["object"] | BITS["array"]) else "string")


def lifts(json_type: str, mask: int) -> bool:
    """Whether the join of an agreed type and type bits lies above the agreed type in the lattice of bits; null lies below all."""
    own = BITS.get(json_type, 62)
    return (own | mask) & ~BITS["null"] != own


def compare(shape: dict[str, int], fields: dict[str, tuple[str, bool]]) -> tuple[list[tuple[str, str]], dict[str, str]]:
    """[(field, change)] of an object's schema (field -> type bits) against its owner's agreed fields, and {agreed name: name in the object} for those that are there."""
    unknown = {k: m for k, m in shape.items() if k not in fields}
    changes, names, taken = [], {}, set()
    for f, (json_type, optional) in fields.items():
        if f in shape:
            names[f] = f
            if lifts(json_type, shape[f]):
                changes.append((f, "retyped"))
        elif not optional:
            alike = [k for k, m in unknown.items() if not lifts(json_type, m)]
            if len(alike) == 1:
                changes.append((f, "renamed"))
                names[f] = alike[0]
                taken.add(alike[0])
            else:
                changes.append((f, "removed"))
    changes += [(k, "added") for k in unknown if k not in taken]
    return changes, names


class Seen:
    """What follows from the schema of an object, remembered: lines of a file are alike. Begins anew beyond ``most`` schemas."""

    def __init__(self, agreed: Agreed, most: int = 50_000):
        self.agreed, self.most, self.known = agreed, most, {}

    def __call__(self, owner: str, obj: dict) -> tuple[list[tuple[str, str]], dict[str, str], str]:
        """(changes, names, shape) of an object, shape being its schema as JSON of field -> type bits."""
        key = (owner, *obj, *map(type, obj.values()))
        got = self.known.get(key)
        if got is None:
            shape = {k: BITS[kind(v)] for k, v in obj.items()}
            got = (*compare(shape, self.agreed[owner]), dump(dict(sorted(shape.items()))))
            if len(self.known) >= self.most:
                self.known.clear()
            self.known[key] = got
        return got


def line_objects(obj: dict, seen: Seen, step: bool) -> Iterator[tuple[str, str, dict, list[tuple[str, str]], dict[str, str], str]]:
    """(owner, path in the line, object, changes, names, shape) of a line and the objects in it that have agreed fields."""
    agreed = seen.agreed
    if not step:
        owner = next((v for v in (obj.get("type"), *obj.values()) if isinstance(v, str) and v in HEADS), None)
        if owner in agreed:
            yield owner, "", obj, *seen(owner, obj)
        return
    if "step" not in agreed:
        return
    changes, names, shape = seen("step", obj)
    yield "step", "", obj, changes, names, shape
    calls = obj.get(names.get("tool_calls"))
    for i, call in enumerate(calls if isinstance(calls, list) else [calls]):
        if not isinstance(call, dict) or "call" not in agreed:
            continue
        changes, names, shape = seen("call", call)
        yield "call", f"tool_calls[{i}]", call, changes, names, shape
        tool, args = call.get(names.get("name")), call.get(names.get("args"))
        args = parse_object(args) if isinstance(args, str) else args
        if isinstance(tool, str) and isinstance(args, dict) and tool in agreed and tool not in ("step", "call", *HEADS):
            yield tool, f"tool_calls[{i}].args", args, *seen(tool, args)


def _visit(agreed: Agreed, step: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Seen(agreed)
        for b in batches:
            seen: dict[tuple[str, str, str], int] = {}
            for path, n, raw in zip(b["source_path"].to_pylist(), b["line_no"].to_pylist(), b["raw"].to_pylist(), strict=True):
                obj = parse_object(raw)
                if obj is None or path is None:
                    continue
                n = 0 if n is None else n
                for owner, _, _, _, _, shape in line_objects(obj, known, step):
                    key = (path, owner, shape)
                    seen[key] = min(seen.get(key, n), n)
            cols = list(zip(*seen, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([*[pa.array(c, pa.string()) for c in cols], pa.array(list(seen.values()), pa.int32())], names=["source_path", "owner", "shape", "line_no"])

    return run


def _differences(agreed: Agreed) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for path, owner, shape, n in zip(*(b[c].to_pylist() for c in ("source_path", "owner", "shape", "line_no")), strict=True):
                fields = parse_object(shape)
                changes, names = compare(fields, agreed[owner])
                agreed_name = {k: f for f, k in names.items()}
                rows += [(path, owner, agreed_name.get(f, f), "", m, n) for f, m in fields.items()]
                rows += [(path, owner, f, change, 0, n) for f, change in changes]
            types = [pa.string()] * 4 + [pa.int32()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True)) or [()] * 6, types, strict=True)], names=[c.split()[0] for c in TYPED.split(", ")])

    return run


def file_schemas(lines: DataFrame, agreed: Agreed, step: bool) -> DataFrame:
    """(source_path, owner, shape, line_no): the different schemas of the objects of each file, as JSON of field -> type bits, with the first line of each."""
    seen = lines.select("source_path", F.col("line_no").cast("int").alias("line_no"), "raw").mapInArrow(_visit(agreed, step), OBSERVED)
    return seen.groupBy("source_path", "owner", "shape").agg(F.min("line_no").alias("line_no"))


def observed(transcript: DataFrame, heads: DataFrame, agreed: Agreed) -> DataFrame:
    """(source_path, owner, field, change, mask, line_no): with change '' the JSON types that a file has in a field, else one change of the file, and the first line that shows it."""
    schemas = file_schemas(transcript, agreed, True).unionByName(file_schemas(heads, agreed, False))
    typed = schemas.mapInArrow(_differences(agreed), TYPED)
    return typed.groupBy("source_path", "owner", "field", "change").agg(F.bit_or("mask").alias("mask"), F.min("line_no").alias("line_no"))


def file_changes(transcript: DataFrame, heads: DataFrame, schema_fields: DataFrame) -> DataFrame:
    """(source_path, owner, field, change) of every file, once each: renamed, removed, added or retyped.

    Lines that aren't whole JSON objects, and rows without path, don't count. Of
    a required field that is missing and an unknown one of its type only a single
    candidate makes a renaming. Empty tables give no changes.
    """
    both = observed(transcript, heads, agreed_fields(schema_fields))
    return both.where("change <> ''").select("source_path", "owner", "field", "change").distinct()


def union_schema(transcript: DataFrame, heads: DataFrame, schema_fields: DataFrame) -> DataFrame:
    """(owner, field, union_type, files): the type that all files' values of a field are to be cast to, a renamed field counting under its agreed name."""
    both = observed(transcript, heads, agreed_fields(schema_fields)).where("change = ''")
    folded = both.groupBy("owner", "field").agg(F.bit_or("mask").alias("mask"), F.count("*").alias("files"))
    m = F.col("mask").bitwiseAND(F.lit(62))
    scalar = F.when(m == 0, "null").when(m == 2, "boolean").when(m == 4, "number").when(m == 16, "object").when(m == 32, "array").when(m.bitwiseAND(F.lit(48)) == 0, "string")
    return folded.select("owner", "field", F.coalesce(scalar, F.lit("json")).alias("union_type"), "files")


def _is_double(value: object) -> bool:
    """Whether a value, or the number that a text holds, is the same as a double; null is."""
    if value is None or isinstance(value, float):
        return True
    if isinstance(value, str):
        m = _NUMBER.fullmatch(value)
        return bool(m) and (bool(m[1]) or _is_double(int(value)))
    return isinstance(value, int) and not isinstance(value, bool) and abs(value) < 2**1023 and int(float(value)) == value


def union_types(transcript: DataFrame, heads: DataFrame, schema_fields: DataFrame) -> dict[str, dict[str, str]]:
    """owner -> agreed field -> union type; the agreed type where no file has a value of the field."""
    agreed = agreed_fields(schema_fields)
    own = schema_fields.select("owner", "field").distinct()
    seen = {(r["owner"], r["field"]): r["union_type"] for r in union_schema(transcript, heads, schema_fields).join(F.broadcast(own), ["owner", "field"], "left_semi").where("union_type <> 'null'").collect()}
    return {o: {f: seen.get((o, f), t) for f, (t, _) in fields.items()} for o, fields in agreed.items()}


def _objects(agreed: Agreed, types: dict[str, dict[str, str]], step: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    pairs = pa.list_(pa.struct([("field", pa.string()), ("change", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Seen(agreed)
        for b in batches:
            at, owners, paths, held, extra, changed = [], [], [], [], [], []
            for n, raw in enumerate(b["raw"].to_pylist()):
                obj = parse_object(raw)
                if obj is None:
                    continue
                for owner, path, it, changes, names, _ in list(line_objects(obj, known, step)) or [(None, "", obj, [], {}, "")]:
                    own = {f: (it[k], types[owner][f]) for f, k in names.items() if it[k] is not None}
                    rest = {k: v for k, v in it.items() if k not in names.values()}
                    rest |= {f: v for f, (v, t) in own.items() if t == "number" and not _is_double(v)}
                    at.append(n)
                    owners.append(owner)
                    paths.append(path)
                    held.append([(f, v if t == "string" and isinstance(v, str) else dump(v)) for f, (v, t) in own.items()])
                    extra.append(dump(rest) if rest else None)
                    changed.append([{"field": f, "change": c} for f, c in changes])
            keys = [b[c].take(pa.array(at, pa.int64())) for c in ("source_path", "line_no", "written_at")]
            text = [pa.array(c, pa.string()) for c in (owners, paths)]
            yield pa.RecordBatch.from_arrays([*keys, *text, pa.array(held, pa.map_(pa.string(), pa.string())), pa.array(extra, pa.string()), pa.array(changed, pairs)], names=["source_path", "line_no", "written_at", "owner", "path", "held", "other_fields", "changes"])

    return run


def _all_objects(transcript: DataFrame, heads: DataFrame, agreed: Agreed, types: dict[str, dict[str, str]]) -> DataFrame:
    each = [t.select("source_path", "line_no", F.col("written_at").cast("timestamp_ntz").alias("written_at"), "raw").mapInArrow(_objects(agreed, types, step), OBJECTS) for t, step in ((transcript, True), (heads, False))]
    return each[0].unionByName(each[1])


def consistent_table(transcript: DataFrame, heads: DataFrame, schema_fields: DataFrame) -> DataFrame:
    """Every object of both inputs in one table: source_path, line_no, written_at, owner, path in the line, fields and other_fields.

    An object is a step, a call, the arguments of an agreed tool, a title or a
    session. fields has a struct for each owner, null but for the row's own, with
    the agreed fields under their agreed names in the types of ``union_schema``:
    numbers are double, booleans boolean, strings text, all else JSON text.
    other_fields keeps what isn't agreed as JSON, and numbers that no double
    holds. Lines of no known owner have other_fields alone; lines that aren't
    whole JSON objects are left out.
    """
    agreed, types = agreed_fields(schema_fields), union_types(transcript, heads, schema_fields)
    cast = {"number": "double", "boolean": "boolean"}

    def typed(f: str, t: str) -> Column:
        return F.try_element_at("held", F.lit(f)).try_cast(cast.get(t, "string")).alias(f)

    structs = [F.when(F.col("owner") == o, F.struct(*[typed(f, t) for f, t in sorted(types[o].items())])).alias(o) for o in sorted(types)]
    fields = F.struct(*structs) if structs else F.lit(None).cast("string")
    return _all_objects(transcript, heads, agreed, types).select("source_path", "line_no", "written_at", "owner", "path", fields.alias("fields"), "other_fields")


def consistent_steps(transcript: DataFrame, heads: DataFrame, schema_fields: DataFrame) -> DataFrame:
    """The steps of ``consistent_table`` with their fields as columns: source_path, line_no, written_at, the agreed fields in the types of the union, other_fields."""
    return consistent_table(transcript, heads, schema_fields).where("owner = 'step'").select("source_path", "line_no", "written_at", "fields.step.*", "other_fields")


def difference_log(transcript: DataFrame, heads: DataFrame, schema_fields: DataFrame) -> DataFrame:
    """(file_time, source_path, line_no, owner, path, field, change) of every difference of every line, in the order of file time and line.

    The time of a file is that of its first row. Rows without path don't count, as in ``file_changes``.
    """
    agreed = agreed_fields(schema_fields)
    types = {o: {f: t for f, (t, _) in fields.items()} for o, fields in agreed.items()}
    files = transcript.select("source_path", "written_at").unionByName(heads.select("source_path", "written_at")).groupBy("source_path").agg(F.min(F.col("written_at").cast("timestamp_ntz")).alias("file_time"))
    each = _all_objects(transcript, heads, agreed, types).select("source_path", "line_no", "owner", "path", F.inline("changes"))
    return each.join(files, "source_path").select("file_time", "source_path", "line_no", "owner", "path", "field", "change").orderBy("file_time", "source_path", "line_no", "path", "field", "change")
