"""Native agent logs to records and usage events.

A line is read by itself: ``LINE_READERS`` give the parts of one line of a
provider, as dicts. What depends on earlier lines (session, directory and model
in force, turn numbers, the name of a call that a result answers) follows from
windows over the file's lines, so files are never parsed by a driver loop. A
line that isn't JSON, or of a type that no reader knows, gives no part.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterable, Iterator
from datetime import UTC, datetime
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomspan.functions.rawjson import dump, parse
from loomspan.operators.catalog import not_excluded, source_of_path
from loomspan.operators.usage import inherited_baseline

Part = dict[str, Any]
GUARDIAN = "guardian_review"
_TEXT = ["role", "text", "tool_name", "tool_input", "tool_output", "tool_id", "event_id", "parent_event_id", "session_id", "cwd", "model", "provider", "conversation_kind", "request_id", "message_id", "parent_session_id"]
_LONG = ["ts", "input", "cached", "cache_read", "cache_write", "cache_write_1h", "output", "reasoning"]
_FLAG = ["is_error", "sidechain", "counts"]
PARTS = ", ".join(["source string", "source_path string", "line_no long", "part int", *[f"{c} string" for c in _TEXT], *[f"{c} long" for c in _LONG], *[f"{c} boolean" for c in _FLAG], "cost double"])
_TYPES = [("source", pa.string()), ("source_path", pa.string()), ("line_no", pa.int64()), ("part", pa.int32()), *[(c, pa.string()) for c in _TEXT], *[(c, pa.int64()) for c in _LONG], *[(c, pa.bool_()) for c in _FLAG], ("cost", pa.float64())]


def text_of(value: Any) -> str:
    """Text of a content value: a string, or blocks with text joined by lines."""
    if isinstance(value, str):
        return value
    if isinstance(value, dict):
        return text_of(value.get("text", value.get("content", "")))
    if isinstance(value, list):
        return "\n".join(t for t in map(text_of, value) if t)
    return ""


def as_text(value: Any) -> str | None:
    return value if value is None or isinstance(value, str) else dump(value)


def millis(value: Any) -> int | None:
    """Milliseconds of an ISO stamp, or of a number of seconds, milli- or microseconds."""
    if isinstance(value, bool) or value is None:
        return None
    if isinstance(value, int | float):
        return int(value * 1000 if value < 10**11 else value if value < 10**14 else value // 1000)
    try:
        t = datetime.fromisoformat(value)
    except (TypeError, ValueError):
        return None
    return int((t if t.tzinfo else t.replace(tzinfo=UTC)).timestamp() * 1000)


def number(of: dict, *names: str) -> int:
    """The largest of some counters that may hold the same count."""
    return max([int(v) for n in names if isinstance(v := of.get(n), int | float) and not isinstance(v, bool)] or [0])


def obj(value: Any) -> dict:
    return value if isinstance(value, dict) else {}


def blocks(value: Any) -> list:
    return value if isinstance(value, list) else [{"type": "text", "text": value}] if isinstance(value, str) else []


def claude(o: dict) -> Iterator[Part]:
    m = obj(o.get("message"))
    side = bool(o.get("isSidechain"))
    base = {"ts": millis(o.get("timestamp")), "session_id": o.get("sessionId"), "cwd": o.get("cwd"), "event_id": o.get("uuid"), "parent_event_id": o.get("parentUuid"), "sidechain": side, "conversation_kind": "sidechain" if side else None, "model": m.get("model")}
    if o.get("type") not in ("user", "assistant"):
        return
    for b in blocks(m.get("content")):
        kind = obj(b).get("type")
        if kind == "text" and b.get("text"):
            yield base | {"role": o["type"], "text": b["text"]}
        elif kind == "thinking" and b.get("thinking"):
            yield base | {"role": "reasoning", "text": b["thinking"]}
        elif kind == "tool_use":
            yield base | {"role": "tool_use", "text": as_text(b.get("input")) or "", "tool_name": b.get("name"), "tool_input": as_text(b.get("input")), "tool_id": b.get("id")}
        elif kind == "tool_result":
            yield base | {"role": "tool_result", "text": text_of(b.get("content")), "tool_output": as_text(b.get("content")), "tool_id": b.get("tool_use_id"), "is_error": b.get("is_error")}
    u = obj(m.get("usage"))
    if o["type"] == "assistant" and u:
        write = number(u, "cache_creation_input_tokens")
        hour = min(write, number(obj(u.get("cache_creation")), "ephemeral_1h_input_tokens"))
        yield base | {"counts": True, "provider": "anthropic", "request_id": o.get("requestId"), "message_id": m.get("id"), "input": number(u, "input_tokens"), "cache_read": number(u, "cache_read_input_tokens"), "cache_write": write, "cache_write_1h": hour, "output": number(u, "output_tokens")}


def codex(o: dict) -> Iterator[Part]:
    p, ts = obj(o.get("payload")), millis(o.get("timestamp"))
    kind = p.get("type")
    if o.get("type") == "session_meta":
        review = p.get("thread_source") == GUARDIAN or obj(obj(p.get("source")).get("subagent")).get("other") == "guardian"
        yield {"ts": ts, "session_id": p.get("id"), "cwd": p.get("cwd"), "parent_session_id": p.get("forked_from_id"), "conversation_kind": GUARDIAN if review else None}
    elif o.get("type") == "turn_context":
        yield {"ts": ts, "cwd": p.get("cwd"), "model": p.get("model")}
    elif o.get("type") == "event_msg" and kind in ("task_started", "task_complete", "turn_aborted"):
        yield {"ts": ts, "role": "lifecycle", "text": kind}
    elif o.get("type") == "event_msg" and kind == "agent_reasoning" and p.get("text"):
        yield {"ts": ts, "role": "reasoning", "text": p["text"]}
    elif o.get("type") == "event_msg" and kind == "token_count":
        t = obj(obj(p.get("info")).get("total_token_usage"))
        if t:
            yield {"ts": ts, "counts": True, "provider": "openai", "input": number(t, "input_tokens"), "cached": number(t, "cached_input_tokens"), "output": number(t, "output_tokens"), "reasoning": number(t, "reasoning_output_tokens")}
    elif o.get("type") == "response_item" and kind == "message" and text_of(p.get("content")):
        yield {"ts": ts, "role": p.get("role"), "text": text_of(p.get("content")), "event_id": p.get("id")}
    elif o.get("type") == "response_item" and kind == "reasoning" and text_of(p.get("summary")):
        yield {"ts": ts, "role": "reasoning", "text": text_of(p.get("summary"))}
    elif o.get("type") == "response_item" and isinstance(kind, str) and kind.endswith("_call"):
        given = next((p[k] for k in ("arguments", "input", "action") if p.get(k) is not None), None)
        name = p.get("name") or kind.removesuffix("_call")
        yield {"ts": ts, "role": "tool_use", "text": as_text(given) or "", "tool_name": name, "tool_input": as_text(given), "tool_id": p.get("call_id")}
    elif o.get("type") == "response_item" and isinstance(kind, str) and kind.endswith("_output"):
        out = p.get("output", p.get("tools"))
        yield {"ts": ts, "role": "tool_result", "text": text_of(out) or as_text(out) or "", "tool_output": as_text(out), "tool_id": p.get("call_id")}


def codex_history(o: dict) -> Iterator[Part]:
    if o.get("text"):
        yield {"role": "user", "text": o["text"], "session_id": o.get("session_id"), "ts": int(o["ts"]) * 1000 if isinstance(o.get("ts"), int) else None}


def pi(o: dict) -> Iterator[Part]:
    m, ts = obj(o.get("message")), millis(o.get("timestamp"))
    base = {"ts": ts or millis(m.get("timestamp")), "event_id": o.get("id"), "parent_event_id": o.get("parentId")}
    if o.get("type") == "session":
        yield {"ts": ts, "session_id": o.get("id"), "cwd": o.get("cwd"), "parent_session_id": o.get("parentSession")}
    elif o.get("type") == "model_change":
        model = o.get("modelId") or o.get("model")
        yield {"ts": ts, "model": model, "provider": o.get("provider")}
    elif o.get("type") in ("compaction", "branch_summary") and o.get("summary"):
        yield base | {"role": "assistant", "text": o["summary"], "conversation_kind": "compaction" if o["type"] == "compaction" else "branch"}
    elif o.get("type") == "message":
        role = m.get("role")
        if role in ("tool", "toolResult"):
            yield base | {"role": "tool_result", "text": text_of(m.get("content")), "tool_name": m.get("toolName"), "tool_output": as_text(m.get("content")), "tool_id": m.get("toolCallId"), "is_error": m.get("isError")}
        elif role in ("user", "assistant", "system"):
            for b in blocks(m.get("content")):
                kind = obj(b).get("type")
                if kind == "text" and b.get("text"):
                    yield base | {"role": role, "text": b["text"]}
                elif kind == "thinking" and b.get("thinking"):
                    yield base | {"role": "reasoning", "text": b["thinking"]}
                elif kind == "toolCall":
                    yield base | {"role": "tool_use", "text": as_text(b.get("arguments")) or "", "tool_name": b.get("name"), "tool_input": as_text(b.get("arguments")), "tool_id": b.get("id")}
        u = obj(m.get("usage"))
        if role == "assistant" and u:
            cost = obj(u.get("cost")).get("total")
            yield base | {
                "counts": True, "model": m.get("model"), "provider": m.get("provider"), "message_id": m.get("id"), "input": number(u, "input", "inputTokens", "input_tokens"), "cache_read": number(u, "cacheRead", "cache_read", "cacheReadTokens"),
                "cache_write": number(u, "cacheWrite", "cache_write", "cacheWriteTokens"), "output": number(u, "output", "outputTokens", "output_tokens"), "cost": float(cost) if isinstance(cost, int | float) else None,
            }


def openclaw(o: dict) -> Iterator[Part]:
    for p in pi(o):
        yield p | {"model": None} if p.get("model") == "delivery-mirror" else p


def grok(o: dict) -> Iterator[Part]:
    params = obj(o.get("params"))
    u, meta = obj(params.get("update")), obj(params.get("_meta"))
    base = {"ts": millis(meta.get("agentTimestampMs")) or millis(o.get("timestamp")), "session_id": params.get("sessionId"), "event_id": meta.get("eventId")}
    kind, text = u.get("sessionUpdate"), text_of(u.get("content"))
    role = {"user_message_chunk": "user", "agent_message_chunk": "assistant", "agent_thought_chunk": "reasoning"}.get(kind)
    if role and text:
        yield base | {"role": role, "text": text}
    elif kind == "tool_call":
        name = obj(obj(u.get("_meta")).get("x.ai/tool")).get("name") or u.get("title")
        yield base | {"role": "tool_use", "text": as_text(u.get("rawInput")) or "", "tool_name": name, "tool_input": as_text(u.get("rawInput")), "tool_id": u.get("toolCallId")}
    elif kind == "tool_call_update" and u.get("status") in ("completed", "failed"):
        yield base | {"role": "tool_result", "text": text, "tool_output": as_text(u.get("content")), "tool_id": u.get("toolCallId"), "is_error": u["status"] == "failed"}
    elif kind == "session_recap" and u.get("summary"):
        yield base | {"role": "assistant", "text": u["summary"], "conversation_kind": "compaction"}
    elif kind == "turn_completed":
        usage = obj(u.get("usage"))
        for model, n in (obj(usage.get("modelUsage")) or {None: usage}).items():
            n = obj(n)
            total, read, write = number(n, "inputTokens"), number(n, "cachedReadTokens"), number(n, "cacheCreationTokens")
            read = min(read, total)
            ticks = n.get("costUsdTicks")
            yield base | {"counts": True, "model": model, "provider": "xai", "request_id": u.get("prompt_id"), "input": max(0, total - read - write), "cache_read": read, "cache_write": write, "output": number(n, "outputTokens"), "reasoning": number(n, "reasoningTokens"), "cost": ticks / 1e10 if isinstance(ticks, int) else None}


def cursor(o: dict) -> Iterator[Part]:
    m = obj(o.get("message")) or o
    role = o.get("role") or m.get("role")
    base = {"ts": millis(o.get("timestamp")), "event_id": o.get("id")}
    for b in blocks(m.get("content")):
        kind = obj(b).get("type")
        if kind == "text" and b.get("text") and role in ("user", "assistant"):
            yield base | {"role": role, "text": b["text"]}
        elif kind == "tool_use":
            yield base | {"role": "tool_use", "text": as_text(b.get("input")) or "", "tool_name": b.get("name"), "tool_input": as_text(b.get("input")), "tool_id": b.get("id") or b.get("toolCallId")}
        elif kind == "tool_result":
            yield base | {"role": "tool_result", "text": text_of(b.get("content")), "tool_output": as_text(b.get("content")), "tool_id": b.get("tool_use_id") or b.get("toolCallId")}


def copilot(o: dict) -> Iterator[Part]:
    kind = o.get("type", "")
    d = obj(o.get("data")) or obj(o.get("payload"))
    base = {"ts": millis(o.get("timestamp")) or millis(d.get("timestamp")), "event_id": o.get("id"), "parent_event_id": o.get("parentId")}
    if kind in ("session.start", "session.resume", "session.context_changed"):
        yield base | {"session_id": d.get("sessionId") or d.get("session_id"), "cwd": (obj(d.get("context")) or d).get("cwd"), "event_id": None}
    elif kind in ("user.message", "assistant.message"):
        text = text_of(next((d[k] for k in ("content", "message", "prompt") if d.get(k)), ""))
        if text.strip():
            yield base | {"role": kind.split(".")[0], "text": text}
    elif kind == "tool.execution_start":
        given = d.get("arguments", d.get("input"))
        yield base | {"role": "tool_use", "text": as_text(given) or "", "tool_name": d.get("toolName") or d.get("name"), "tool_input": as_text(given), "tool_id": d.get("toolCallId")}
    elif kind == "tool.execution_complete":
        out = d.get("result", d.get("output"))
        yield base | {"role": "tool_result", "text": text_of(out) or as_text(out) or "", "tool_output": as_text(out), "tool_id": d.get("toolCallId"), "is_error": d.get("success") is False}


def muse(o: dict) -> Iterator[Part]:
    p = obj(o.get("payload"))
    e, r = obj(p.get("event")), obj(p.get("record"))
    base = {"ts": millis(o.get("recorded_at")), "session_id": obj(o.get("stream")).get("id")}
    mid = e.get("message_id")
    kind = e.get("kind")
    if r:
        yield base | {"cwd": r.get("workspace_root") or r.get("cwd"), "model": r.get("model_id"), "provider": r.get("provider_id")}
    if kind == "started" and e.get("prompt"):
        yield base | {"role": "user", "text": e["prompt"]}
    elif kind == "assistant_message_committed" and e.get("text"):
        yield base | {"role": "assistant", "text": e["text"], "event_id": mid}
    elif kind == "reasoning_committed" and (e.get("text") or e.get("reasoning")):
        yield base | {"role": "reasoning", "text": e.get("text") or e.get("reasoning"), "event_id": mid and f"{mid}:reasoning"}
    elif kind == "assistant_tool_calls_committed":
        for c in map(obj, e.get("tool_calls") or []):
            yield base | {"role": "tool_use", "text": as_text(c.get("args")) or "", "tool_name": c.get("name"), "tool_input": as_text(c.get("args")), "tool_id": c.get("call_id") or c.get("id")}
    elif kind == "tool_result_batch_committed":
        for c in map(obj, e.get("results") or []):
            out = c.get("text") or c.get("output") or ""
            yield base | {"role": "tool_result", "text": as_text(out), "tool_output": as_text(out), "tool_id": c.get("tool_call_id")}
    elif kind == "model_completed":
        u = obj(e.get("usage"))
        yield base | {
            "counts": True, "model": e.get("model"), "input": number(u, "input_tokens", "input"), "cache_read": number(u, "cache_read_tokens", "cached_tokens"), "cache_write": number(u, "cache_write_tokens"),
            "output": number(u, "output_tokens", "output") + number(u, "reasoning_tokens"), "reasoning": number(u, "reasoning_tokens"),
        }


def antigravity(o: dict) -> Iterator[Part]:
    base = {"ts": millis(o.get("created_at")), "event_id": as_text(o.get("step_index"))}
    text, kind = text_of(o.get("content")), o.get("type")
    if o.get("thinking"):
        yield base | {"role": "reasoning", "text": o["thinking"]}
    if text:
        yield base | {"role": "user" if kind == "USER_INPUT" else "assistant" if kind == "PLANNER_RESPONSE" else "tool", "text": text, "tool_name": None if kind in ("USER_INPUT", "PLANNER_RESPONSE") else kind and kind.lower()}
    for c in map(obj, o.get("tool_calls") or []):
        yield base | {"role": "tool_use", "text": as_text(c.get("args")) or "", "tool_name": c.get("name"), "tool_input": as_text(c.get("args"))}


def jcode(o: dict) -> Iterator[Part]:
    """A whole file is one object."""
    yield {"session_id": o.get("id"), "cwd": o.get("working_dir") or o.get("cwd"), "model": o.get("model"), "provider": o.get("provider"), "parent_session_id": o.get("parent_id")}
    for m in map(obj, o.get("messages") or []):
        base = {"ts": millis(m.get("timestamp") or m.get("created_at")), "event_id": m.get("id")}
        for b in blocks(m.get("content")):
            kind = obj(b).get("type")
            if kind == "text" and b.get("text"):
                yield base | {"role": m.get("role"), "text": b["text"]}
            elif kind in ("reasoning", "thinking") and text_of(b.get("text") or b.get("thinking")):
                yield base | {"role": "reasoning", "text": text_of(b.get("text") or b.get("thinking"))}
            elif kind == "tool_use":
                yield base | {"role": "tool_use", "text": as_text(b.get("input")) or "", "tool_name": b.get("name"), "tool_input": as_text(b.get("input")), "tool_id": b.get("id")}
            elif kind == "tool_result":
                yield base | {"role": "tool_result", "text": text_of(b.get("content")), "tool_output": as_text(b.get("content")), "tool_id": b.get("tool_use_id")}
        u = obj(m.get("token_usage")) or obj(m.get("usage"))
        if u:
            yield base | {"counts": True, "input": number(u, "input_tokens", "input"), "cache_read": number(u, "cache_read_input_tokens", "cache_read"), "cache_write": number(u, "cache_creation_input_tokens", "cache_write"), "output": number(u, "output_tokens", "output") + number(u, "reasoning_tokens"), "reasoning": number(u, "reasoning_tokens")}


LINE_READERS: dict[str, Callable[[dict], Iterator[Part]]] = {
    "claude": claude, "codex": codex, "codex_history": codex_history, "pi": pi, "omp": pi, "openclaw": openclaw, "grok": grok, "cursor": cursor, "copilot": copilot, "muse": muse, "antigravity": antigravity, "jcode": jcode,
}


def _read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for source, path, line, raw in zip(*(b[c].to_pylist() for c in ("source", "source_path", "line_no", "raw")), strict=True):
            reader, o = LINE_READERS.get(source), parse(raw)
            if reader is None or not isinstance(o, dict):
                continue
            for k, p in enumerate(reader(o)):
                rows.append({"source": source, "source_path": path, "line_no": line, "part": k} | {c: v if not isinstance(v, dict | list) else dump(v) for c, v in p.items()})
        columns = [pa.array([_fit(r.get(c), t) for r in rows], t) for c, t in _TYPES]
        yield pa.RecordBatch.from_arrays(columns, names=[c for c, _ in _TYPES])


def _fit(value: Any, kind: pa.DataType) -> Any:
    """A value in its column's type; what doesn't fit is null, or text."""
    if value is None:
        return None
    if kind == pa.string():
        return value if isinstance(value, str) else dump(value)
    if kind == pa.bool_():
        return value if isinstance(value, bool) else None
    return value if isinstance(value, int | float) and not isinstance(value, bool) else None


def roots_below(root: str) -> list[str]:
    """root and the directories below it that Spark's listing passes over, as their names begin with a dot or an underscore."""
    hidden = [os.path.join(at, d) for at, dirs, _ in os.walk(root) for d in dirs if d[0] in "._"]
    return [root, *sorted(hidden)]


def is_session_file(path: Column) -> Column:
    """Whether a file below a projects folder of claude holds a session: at most two levels deep, or an agent's below a subagents folder. Other files all do."""
    inside = F.regexp_extract(path, r"/\.claude/projects/(.+)$", 1)
    depth = F.size(F.split(inside, "/"))
    return F.when(inside == "", True).when(inside.rlike(r"(^|/)subagents/"), inside.rlike(r"(^|/)agent-[^/]*$")).otherwise(depth <= 2)


def read_lines(spark: SparkSession, roots: str | list[str], glob: str = "*.jsonl", exclude: list[str] | None = None) -> DataFrame:
    """(source, source_path, line_no, raw) of all log files below the roots, the source told by the path.

    A single root that is a local directory is searched with its hidden
    directories; a list of roots is taken as it is, for any file system.

    Lines are numbered within their file from the order in which Spark reads
    them; a file's lines keep that order as their parts do.
    """
    text = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).text(roots if isinstance(roots, list) else roots_below(roots))
    lines = text.select(F.col("_metadata.file_path").alias("source_path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("raw"))
    lines = lines.where(not_excluded(F.col("source_path"), exclude or []) & is_session_file(F.col("source_path")))
    source = F.when(F.col("source_path").endswith("/history.jsonl") & F.col("source_path").contains("/.codex/"), "codex_history").otherwise(source_of_path(F.col("source_path")))
    order = Window.partitionBy("source_path").orderBy("block", "at")
    return lines.select(source.alias("source"), "source_path", (F.row_number().over(order) - 1).cast("bigint").alias("line_no"), "raw")


def read_objects(spark: SparkSession, roots: str | list[str], glob: str = "*.json") -> DataFrame:
    """(source, source_path, line_no, raw) of files that hold one object each."""
    text = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).text(roots if isinstance(roots, list) else roots_below(roots), wholetext=True)
    return text.select(source_of_path(F.col("_metadata.file_path")).alias("source"), F.col("_metadata.file_path").alias("source_path"), F.lit(0).cast("bigint").alias("line_no"), F.col("value").alias("raw"))


def parts(lines: DataFrame) -> DataFrame:
    """What the lines say, with the session, directory, model and provider in force; see ``PARTS``."""
    got = lines.select("source", "source_path", "line_no", "raw").mapInArrow(_read, PARTS)
    so_far = Window.partitionBy("source_path").orderBy("line_no", "part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    name = F.regexp_extract("source_path", r"([^/]+)\.jsonl?$", 1)
    for c in ("cwd", "model", "provider", "session_id"):
        got = got.withColumn(c, F.last(c, True).over(so_far))
    # of a rollout the first line says whether it is a review
    review = F.max(F.when((F.col("source") == "codex") & F.col("role").isNull(), F.col("conversation_kind"))).over(Window.partitionBy("source_path"))
    return got.withColumn("session_id", F.coalesce("session_id", name)).withColumn("review", review)


def records(lines: DataFrame) -> DataFrame:
    """The records of log lines: one for each text, call, result and thought, numbered within their session's file.

    A result without a tool name has that of the call with its id. The project is
    the last part of the directory.
    """
    p = parts(lines).where("role is not null")
    call = Window.partitionBy("source_path", "session_id", "tool_id")
    turn = Window.partitionBy("source_path").orderBy("line_no", "part")
    named = F.first(F.when(F.col("role") == "tool_use", F.col("tool_name")), True).over(call)
    p = p.withColumn("tool_name", F.when(F.col("tool_id").isNull() | F.col("tool_name").isNotNull(), F.col("tool_name")).otherwise(named))
    project = F.coalesce(F.regexp_extract("cwd", r"([^/]+)/?$", 1), F.lit(""))
    return p.select(
        "source", F.xxhash64("source_path", "line_no", "part").alias("doc_id"), F.coalesce("ts", F.lit(0)).alias("ts"), project.alias("project"), "session_id", "source_path", (F.row_number().over(turn) - 1).alias("turn_id"), "role",
        F.coalesce("text", F.lit("")).alias("text"), "tool_name", "tool_input", "tool_output", "tool_id", "event_id", "parent_event_id", "is_error",
        F.coalesce("conversation_kind", "review", F.when(F.col("source_path").rlike(r"/subagents/|/agent-[^/]*\.jsonl$"), "subagent")).alias("conversation_kind"),
    )


COUNTERS = ["input", "cached", "output", "reasoning"]


def _with_inherited(counted: DataFrame, all_parts: DataFrame) -> DataFrame:
    """counted with from_input and so on: the counters that a forked rollout has from its parent, the largest there up to the fork. Reviews count from nothing."""
    forks = all_parts.where((F.col("source") == "codex") & F.col("parent_session_id").isNotNull() & F.col("review").isNull()).groupBy(F.col("source_path").alias("child")).agg(F.min("parent_session_id").alias("parent"), F.min(F.coalesce("ts", F.lit(0))).alias("fork_ts"))
    snapshots = counted.where("source = 'codex'").select("session_id", F.coalesce("ts", F.lit(0)).alias("timestamp_ms"), *[F.coalesce(c, F.lit(0)).alias(c) for c in COUNTERS])
    base = inherited_baseline(forks, snapshots, COUNTERS).select(F.col("child").alias("source_path"), *[F.col(c).alias(f"from_{c}") for c in COUNTERS])
    return counted.join(base, "source_path", "left")


def usage_events(lines: DataFrame) -> DataFrame:
    """Token usage of log lines; events without any token are left out, but for grok's. Codex counters grow, so each event is what it adds."""
    all_parts = parts(lines)
    u = _with_inherited(all_parts.where("counts"), all_parts)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    before = Window.partitionBy("source_path").orderBy("line_no", "part").rowsBetween(Window.unboundedPreceding, -1)
    grown = lambda c: F.when(F.col("source") == "codex", F.greatest(F.lit(0), zero(c) - F.greatest(zero(f"from_{c}"), F.coalesce(F.max(zero(c)).over(before), F.lit(0))))).otherwise(zero(c))
    for c in ("input", "cached", "output", "reasoning"):
        u = u.withColumn(f"_{c}", grown(c))
    cached = F.least("_cached", "_input")
    e = u.select(
        "source", "source_path", "line_no", F.coalesce("ts", F.lit(0)).alias("timestamp_ms"), "session_id", F.regexp_extract("cwd", r"([^/]+)/?$", 1).alias("project"), "provider", "model", F.col("event_id").alias("source_record_id"), "request_id", "message_id",
        F.col("_input").alias("raw_input"), F.when(F.col("source") == "codex", F.col("_input") - cached).otherwise(F.col("_input")).alias("uncached_input"), F.when(F.col("source") == "codex", cached).otherwise(zero("cache_read")).alias("cache_read"),
        zero("cache_write").alias("cache_write"), zero("cache_write_1h").alias("cache_write_1h"), F.col("_output").alias("output"), F.col("_reasoning").alias("reasoning"), F.col("cost").alias("source_cost_usd"), F.coalesce("sidechain", F.lit(False)).alias("sidechain"),
        (F.col("source") == "grok").alias("cache_chain_excluded"), F.coalesce(F.col("review") == GUARDIAN, F.lit(False)).alias("permission_review"),
    )
    return e.where((F.col("uncached_input") + F.col("cache_read") + F.col("cache_write") + F.col("output") > 0) | (F.col("source") == "grok"))


def without_known_sessions(history: DataFrame, rollouts: DataFrame) -> DataFrame:
    """History records of sessions that have no rollout of their own."""
    return history.join(rollouts.select("session_id").distinct(), "session_id", "left_anti")


def read_workspaces(spark: SparkSession, roots: str | list[str], glob: str = "workspace.yaml") -> DataFrame:
    """(dir, cwd, git_root, repository, branch) from the workspace files beside session logs; lines that are blank, comments or indented don't count, the last of a key does."""
    text = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).text(roots if isinstance(roots, list) else roots_below(roots), wholetext=True)
    lines = F.filter(F.split("value", r"\r?\n"), lambda x: x.rlike(r"^[^\s#:][^:]*:\s*\S"))
    pairs = F.transform(lines, lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)).alias("k"), F.regexp_replace(F.trim(F.regexp_replace(x, r"^[^:]*:", "")), "^[\"']+|[\"']+$", "").alias("v")))
    of = lambda *names: F.get(F.reverse(F.filter("pairs", lambda p: p["k"].isin(*names) & (p["v"] != ""))), F.lit(0))["v"]
    rows = text.select(F.regexp_replace(F.col("_metadata.file_path"), r"[^/]+$", "").alias("dir"), pairs.alias("pairs"))
    return rows.select("dir", of("cwd").alias("cwd"), of("gitRoot", "git_root").alias("git_root"), of("repository").alias("repository"), of("branch").alias("branch"))


def with_workspaces(records: DataFrame, workspaces: DataFrame) -> DataFrame:
    """records of copilot whose log names no directory, with the project of the workspace file beside it: the repository's, else the directory's last part."""
    w = workspaces.select(F.col("dir").alias("_dir"), F.regexp_extract(F.coalesce("repository", "cwd", F.lit("")), r"([^/]+)/?$", 1).alias("_project"))
    j = records.withColumn("_dir", F.regexp_replace("source_path", r"[^/]+$", "")).join(w, "_dir", "left")
    return j.withColumn("project", F.when((F.col("source") == "copilot") & (F.col("project") == ""), F.coalesce("_project", "project")).otherwise(F.col("project"))).select(records.columns)
