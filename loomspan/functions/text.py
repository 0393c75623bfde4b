"""Text functions of the engine as column expressions; Python only where bytes must be counted."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

LABEL_CHARS, LABEL_TAIL, LABEL_BREAK = 150, 40, 80
# Wrappers whose whole content is no part of a prompt.
DROPPED = [
    "system-reminder", "command-message", "command-name", "local-command-stdout", "local-command-caveat", "local-command-output", "instructions", "environment_context", "cwd", "approval_policy", "shell", "user_instructions",
    "recommended_plugins", "skill", "user_action", "context", "task-notification", "task-id", "tool-use-id", "subagent_notification", "turn_aborted", "current_date", "timezone", "epoch", "collaboration_mode", "apps_instructions", "permissions", "total_tokens",
]
# Beginnings of prompts that are previews of other conversations, the line before the request itself, and texts that are no prompts.
PREVIEWS = r"(?is)^\s*## Referenced (?:ChatGPT conversation:|chats with Codex:)"
REQUEST_LINE = "## My request:"
BOILERPLATE = r"(?i)^# agents\.md|^## referenced chatgpt conversation:|global agent preferences|^you are a reminder observer"


def label(text: Column) -> Column:
    """A prompt as one line: wrappers and tags gone, escapes and control characters too, white space evened out, at most 150 characters.

    Of a longer text the head and the last 40 characters stay, both cut between
    words where that leaves enough. Of a prompt that begins with previews of other
    conversations only what follows the line of the request counts, and nothing
    if there is none. Boilerplate has an empty label, as has a blank text.
    """
    request = F.regexp_extract(text, rf"(?ism)^[ \t]*{REQUEST_LINE}[ \t]*$(.*)", 1)
    t = F.when(text.rlike(PREVIEWS), request).otherwise(text)
    tags = "|".join(DROPPED)
    t = F.regexp_replace(t, rf"(?is)<({tags})[^>]*>.*?</\1>", " ")
    t = F.regexp_replace(t, rf"(?is)<(?:{tags}).*", "")
    t = F.regexp_replace(t, r"<[A-Za-z/!][^>]*>", " ")
    t = F.regexp_replace(t, "\x1b\\[[0-9;]*[A-Za-z]", "")
    t = F.trim(F.regexp_replace(F.regexp_replace(t, r"\s+", " "), r"\p{Cc}", ""))
    t = F.when(t.rlike(BOILERPLATE), "").otherwise(t)
    head = F.substring(t, 1, LABEL_CHARS - LABEL_TAIL - 1)
    at = F.length(head) - F.length(F.substring_index(head, " ", -1)) - 1
    head = F.when(at > LABEL_BREAK, F.substring(head, F.lit(1), at)).otherwise(head)
    tail = F.substring(t, -LABEL_TAIL, LABEL_TAIL)
    tail = F.trim(F.substring(tail, F.instr(tail, " ") + 1, F.lit(LABEL_TAIL)))
    return F.when(F.length(t) <= LABEL_CHARS, t).otherwise(F.concat(head, F.lit("…"), tail))


def first_hit(text: Column, words: list[str]) -> Column:
    """The first position (from 1) at which one of the words stands, whatever the case; null without any."""
    low = F.lower(text)
    at = [F.nullif(F.locate(w.lower(), low), F.lit(0)) for w in words]
    return at[0] if len(at) == 1 else F.least(*at)


def snippet(text: Column, words: list[str], before: int = 80, length: int = 240) -> Column:
    """``length`` characters around the first hit, from ``before`` characters ahead of it; the beginning without a hit."""
    start = F.greatest(F.lit(1), F.coalesce(first_hit(text, words), F.lit(1)) - before)
    return F.substring(text, start, F.lit(length))


def abbreviated(text: Column, words: list[str], limit: int) -> Column:
    """A text of at most ``limit`` characters from the start, or from a quarter of the limit ahead of the first hit, with dots where something is left out."""
    start = F.greatest(F.lit(1), F.coalesce(first_hit(text, words), F.lit(1)) - limit // 4)
    cut = F.concat(F.when(start > 1, "…").otherwise(""), F.substring(text, start, F.lit(limit)), F.when(start + limit <= F.length(text), "…").otherwise(""))
    return F.when(F.length(text) <= limit, text).otherwise(cut)


def literal_pattern(words: list[str]) -> str:
    """An expression for any of the words, taken literally, whatever the case."""
    return "(?i)(?:" + "|".join("\\Q" + w.replace("\\E", "\\E\\\\E\\Q") + "\\E" for w in words) + ")"


def match_spans(text: Column, words: list[str], most: int = 5, around: int = 40) -> Column:
    """array<struct(start, end, context)>: the first ``most`` hits in characters from 0, with the text around them."""
    parts = F.split(text, literal_pattern(words))
    hits = F.regexp_extract_all(text, F.lit(literal_pattern(words)), F.lit(0))
    n = F.least(F.size(hits), F.lit(most))
    starts = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda k: F.aggregate(F.slice(parts, 1, k), F.lit(0), lambda s, p: s + F.length(p)) + F.aggregate(F.slice(hits, 1, k - 1), F.lit(0), lambda s, h: s + F.length(h)))
    spans = F.transform(F.slice(F.arrays_zip(starts.alias("start"), F.slice(hits, 1, F.greatest(n, F.lit(1))).alias("hit")), 1, F.greatest(n, F.lit(1))), lambda z: F.struct(z["start"].alias("start"), (z["start"] + F.length(z["hit"])).alias("end"), F.substring(text, F.greatest(F.lit(1), z["start"] + 1 - around), F.length(z["hit"]) + 2 * around).alias("context")))
    return F.when(n > 0, spans)


def head_tail(max_bytes: int, head_share: float = 0.75):
    """A function of a text column: texts over ``max_bytes`` keep head and tail, with a note of the bytes between; characters stay whole."""

    def shorten(text: str | None) -> str | None:
        raw = text.encode() if text is not None else b""
        if text is None or len(raw) <= max_bytes:
            return text
        note = f"\n\n[... {len(raw)} bytes truncated ...]\n\n"
        while True:
            room = max(0, max_bytes - len(note))
            head = raw[: int(room * head_share)].decode(errors="ignore")
            rest = room - len(head.encode())
            tail = raw[len(raw) - rest :].decode(errors="ignore") if rest else ""
            left_out = len(raw) - len(head.encode()) - len(tail.encode())
            again = f"\n\n[... {left_out} bytes truncated ...]\n\n"
            if len(again) == len(note):
                return head + again + tail
            note = again

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield b.map(shorten, na_action="ignore")

    return run


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(text)), r"[^\p{L}\p{N}]+", "-"), r"^-+|-+$", "")


def tag_value(text: Column, tag: str) -> Column:
    """The trimmed text inside the first such tag; null without one."""
    return F.nullif(F.trim(F.regexp_extract(text, rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}>", 1)), F.lit(""))


def base_name(path: Column) -> Column:
    """The last part of a path or remote, without .git."""
    return F.regexp_replace(F.element_at(F.split(F.regexp_replace(path, r"/+$", ""), "/"), -1), r"\.git$", "")


# Folders of a home in which projects lie, and which their names leave out.
PROJECT_FOLDERS = ["projects", "code", "repos", "src", "dev", "work", "documents"]


def project_display(project: Column) -> Column:
    """A project's name as shown: a path that was written with hyphens for slashes loses its home and a usual folder of projects; other names stay."""
    trimmed = F.regexp_replace(project, "^-+|-+$", "")
    low = F.lower(trimmed)
    parts = F.filter(F.split(trimmed, "-"), lambda x: x != "")
    lowered = F.transform(parts, F.lower)
    encoded = low.rlike("^(?:users|home)-|-users-") & (F.size(parts) >= 3)
    home = F.get(lowered, F.lit(0)) == "home"
    at = F.when(home, F.lit(1)).otherwise(F.array_position(lowered, "users")).cast("int")
    tail = F.when(encoded & (at > 0) & (F.size(parts) > at + 1), F.slice(parts, at + 2, F.size(parts)))
    usual = F.get(F.transform(tail, F.lower), F.lit(0)).isin(PROJECT_FOLDERS)
    shown = F.when(F.size(tail) == 1, F.concat(F.lit("~/"), tail[0])).when(usual, F.array_join(F.slice(tail, F.lit(2), F.size(tail)), "-")).otherwise(F.array_join(tail, "-"))
    return F.when(tail.isNotNull(), shown).otherwise(project)


def instant_ms(text: Column) -> Column:
    """Milliseconds of digits (over 10^10 milliseconds, else seconds), a date, or an RFC 3339 stamp; null for anything else."""
    digits = F.when(text.rlike(r"^\d{1,18}$"), text.cast("bigint"))
    stamp = F.unix_millis(F.try_to_timestamp(F.when(text.rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d{1,6})?(Z|[+-]\d\d:\d\d)$"), text)))
    day = F.unix_millis(F.try_to_timestamp(F.concat(F.when(text.rlike(r"^\d{4}-\d\d-\d\d$"), text), F.lit("T00:00:00Z"))))
    return F.coalesce(F.when(digits > 10_000_000_000, digits).otherwise(digits * 1000), stamp, day)


def stamp_text(ms: Column) -> Column:
    """RFC 3339 seconds in UTC; a dash for 0, which means unknown."""
    return F.when(ms == 0, "-").otherwise(F.concat(F.date_format(F.timestamp_add("SECOND", F.floor(ms / 1000), F.lit("1970-01-01").cast("timestamp_ntz")), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z")))


def since_ms(name: str, now_ms: int) -> int | None:
    """The begin of 24h, 7d or 30d before now; None for all."""
    hours = {"24h": 24, "7d": 168, "30d": 720}.get(name)
    return None if hours is None else now_ms - hours * 3_600_000


def compact_number(n: Column) -> Column:
    """1234 as 1.2k, and so on to trillions."""
    out = F.format_string("%d", n)
    for size, sign in ((10**3, "k"), (10**6, "M"), (10**9, "B"), (10**12, "T")):
        out = F.when(n >= size, F.format_string(f"%.1f{sign}", n / size)).otherwise(out)
    return out


def dollars(nanos: Column) -> Column:
    """Billionths of a dollar as $0.12, from a thousand on as $1.2k and so on; below a cent four digits. Null stays null."""
    v = nanos / 1_000_000_000
    whole = F.when(v >= 1000, F.concat(F.lit("$"), compact_number(F.floor(v))))
    return F.coalesce(whole, F.when((v > 0) & (v < 0.01), F.format_string("$%.4f", v)).otherwise(F.when(v.isNotNull(), F.format_string("$%.2f", v))))


def _length_le(text: Column) -> Column:
    """The length in bytes as eight bytes, the lowest first."""
    return F.unhex(F.array_join(F.reverse(F.regexp_extract_all(F.lpad(F.hex(F.octet_length(text).cast("bigint")), 16, "0"), F.lit(".."), F.lit(0))), ""))


def labelled_hash(*fields: tuple[str, Column]) -> Column:
    """SHA-256 over labels and values, each with its length before it; fields whose value is null are left out."""
    blank = F.unhex(F.lit(""))
    parts = [F.coalesce(F.concat(_length_le(F.lit(k)), F.encode(F.lit(k), "UTF-8"), _length_le(v), F.encode(v, "UTF-8")), blank) for k, v in fields]
    return F.sha2(F.concat(*parts), 256)


def record_id(version: str = "rid1") -> Column:
    """The stable id of a record: by its offset in the source, else its event or tool id, else its turn; role and tool always count. links has the link columns."""
    c = F.col
    offset = c("links.source_record_offset").cast("string")
    tool = F.when(c("role") == "tool_use", c("links.source_tool_use_id"))
    native = c("links.event_id").isNotNull() | tool.isNotNull()
    by_offset, by_native = offset.isNotNull(), offset.isNull() & native
    return F.concat(
        F.lit(f"{version}_"),
        labelled_hash(
            ("version", F.lit(version)), ("source", c("source")),
            ("session", F.when(by_native & (c("session_id") == ""), c("source_path")).otherwise(c("session_id"))),
            ("source-path", F.when(~by_native, c("source_path"))), ("source-record-offset", F.when(by_offset, offset)),
            ("event", F.when(by_native, c("links.event_id"))), ("source-tool-use", F.when(by_native & c("links.event_id").isNull(), tool)),
            ("turn", F.when(~by_offset & ~native, F.coalesce(c("links.legacy_turn_id"), c("turn_id")).cast("string"))),
            ("role", c("role")), ("tool", F.coalesce(c("tool_name"), F.lit(""))),
        ),
    )


def payload_text(payload: Column) -> Column:
    """A tool payload as text: strings as they are, text blocks joined by lines, anything else as its JSON."""
    blocks = F.from_json(payload, "array<struct<type:string,text:string>>")
    joined = F.array_join(F.transform(F.filter(blocks, lambda b: b["text"].isNotNull()), lambda b: b["text"]), "\n")
    string = F.from_json(F.concat(F.lit('{"v":'), payload, F.lit("}")), "v string")["v"]
    return F.when(F.ltrim(payload).startswith("["), F.coalesce(F.nullif(joined, F.lit("")), payload)).when(F.ltrim(payload).startswith('"'), F.coalesce(string, payload)).otherwise(payload)
