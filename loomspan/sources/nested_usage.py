"""Token usage at any depth of nested JSON: telemetry spans, editor state, embedded transcripts.

A reader walks one value and yields what counts; the walk is the same for all,
so a provider is a rule for one object. A rule that says an object was counted
keeps the walk out of the parts that repeat its counters.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame

from loomspan.functions.rawjson import parse
from loomspan.sources.logs import millis, number, obj

FOUND = "source_path string, line_no long, source_record_id string, session_id string, request_id string, timestamp_ms long, project string, provider string, model string, raw_input long, uncached_input long, cache_read long, cache_write long, output long, reasoning long"
_SCHEMA = [(n, pa.int64() if t == "long" else pa.string()) for n, t in (x.split() for x in FOUND.split(", "))]
Rule = Callable[[dict, str], tuple[dict | None, tuple[str, ...]]]


def attributes(of: Any) -> dict:
    """Span attributes, given as an object or as a list of keys and wrapped values."""
    items = of.items() if isinstance(of, dict) else [(a.get("key"), a.get("value")) for a in of or [] if isinstance(a, dict)] if isinstance(of, list) else []
    out = {}
    for k, v in items:
        inner = next((v[w] for w in ("stringValue", "intValue", "doubleValue", "boolValue") if w in v), v) if isinstance(v, dict) else v
        out[k] = int(inner) if isinstance(inner, str) and inner.isdigit() else inner
    return out


def span(o: dict, fallback: str) -> tuple[dict | None, tuple[str, ...]]:
    """A chat span with tokens; cached input is part of the input."""
    a = attributes(o.get("attributes", o))
    total, output = number(a, "gen_ai.usage.input_tokens"), number(a, "gen_ai.usage.output_tokens")
    if (a.get("gen_ai.operation.name") or o.get("name")) != "chat" or not (total or output):
        return None, ()
    trace, own, response = o.get("traceId", o.get("trace_id")) or "", o.get("spanId", o.get("span_id")) or "", a.get("gen_ai.response.id")
    cached = min(total, number(a, "gen_ai.usage.cache_read.input_tokens"))
    began = o.get("startTimeUnixNano")
    return {
        "source_record_id": f"{trace}:{own}" if trace or own else f"response:{response}" if response else f"{fallback}:{total}:{output}", "session_id": a.get("gen_ai.conversation.id"), "request_id": response,
        "timestamp_ms": int(began) // 1_000_000 if began else millis(o.get("timestamp")) or 0, "project": a.get("copilot_chat.repo.remote_url") or a.get("github.copilot.git.repository"), "provider": "github-copilot",
        "model": a.get("gen_ai.response.model") or a.get("gen_ai.request.model"), "raw_input": total, "uncached_input": total - cached, "cache_read": cached, "cache_write": 0, "output": output,
        "reasoning": number(a, "gen_ai.usage.reasoning.output_tokens", "gen_ai.usage.reasoning_tokens"),
    }, ()


def editor_state(o: dict, fallback: str) -> tuple[dict | None, tuple[str, ...]]:
    """Counters of an object of its own or in tokenCount or usage, which are then not walked into."""
    for at in (o, obj(o.get("tokenCount")), obj(o.get("usage"))):
        total, output = number(at, "inputTokens", "input_tokens"), number(at, "outputTokens", "output_tokens")
        if total or output:
            break
    else:
        return None, ()
    own = next((o[k] for k in ("generationUUID", "generationId", "bubbleId", "id") if isinstance(o.get(k), str)), f"{fallback}:{o.get('createdAt')}:{total + output}")
    session = next((o[k] for k in ("sessionId", "composerId") if isinstance(o.get(k), str)), fallback.removeprefix("composerData:") if fallback.startswith("composerData:") else None)
    model = next((m[k] for m in (o, obj(o.get("modelInfo")), obj(o.get("modelConfig"))) for k in ("model", "modelName") if isinstance(m.get(k), str)), None)
    return {"source_record_id": own, "session_id": session, "timestamp_ms": millis(o.get("createdAt", o.get("timestamp"))) or 0, "model": model, "raw_input": total, "uncached_input": total, "cache_read": 0, "cache_write": 0, "output": output, "reasoning": 0}, ("tokenCount", "usage")


def walk(value: Any, rule: Rule, fallback: str) -> Iterator[dict]:
    """What the rule counts in a value and in all that it holds, in order, at any depth."""
    open_: list[Any] = [value]
    while open_:
        value = open_.pop()
        passed_over: tuple[str, ...] = ()
        if isinstance(value, dict):
            found, passed_over = rule(value, fallback)
            if found:
                yield found
            inner = [v for k, v in value.items() if k not in passed_over]
        else:
            inner = value if isinstance(value, list) else []
        open_ += [v for v in reversed(inner) if isinstance(v, dict | list)]


def _run(rule: Rule):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for path, line, key, raw in zip(*(b[c].to_pylist() for c in ("source_path", "line_no", "key", "raw")), strict=True):
                rows += [{"source_path": path, "line_no": line} | f for f in walk(parse(raw), rule, key or f"{path}:{line}")]
            yield pa.RecordBatch.from_arrays([pa.array([r.get(c) for r in rows], t) for c, t in _SCHEMA], names=[c for c, _ in _SCHEMA])

    return run


def usage_in(values: DataFrame, rule: Rule) -> DataFrame:
    """Usage in values (source_path, line_no, key, raw), by a rule; each record id with the same counts once."""
    return values.select("source_path", "line_no", "key", "raw").mapInArrow(_run(rule), FOUND).dropDuplicates(["source_record_id", "raw_input", "output"])
