"""Strict reading of raw JSON text, shared by the operators that visit raw lines."""

from __future__ import annotations

import json
from typing import Any


def _no_constant(name: str) -> None:
    raise ValueError(name)


_DECODER = json.JSONDecoder(parse_constant=_no_constant)


def parse(text: str | None) -> Any:
    """The value of a text that is whole JSON, else None; NaN and Infinity are no JSON, and text after the value spoils it."""
    if not text:
        return None
    try:
        return _DECODER.decode(text)
    except (ValueError, RecursionError):
        return None


def parse_object(text: str | None) -> dict | None:
    got = parse(text)
    return got if isinstance(got, dict) else None


def kind(value: Any) -> str:
    """The JSON type of a parsed value."""
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "boolean"
    if isinstance(value, str):
        return "string"
    if isinstance(value, dict):
        return "object"
    return "array" if isinstance(value, list) else "number"


def dump(value: Any) -> str:
    return json.dumps(value, ensure_ascii=False, separators=(",", ":"))
