"""Saved memories: sections of markdown, what they refer to, and search over them."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import count

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspan.operators import lexical, ranking
from loomspan.operators.index import Index

SECTION_CHARS = 8_000
MOST_VIEWS = 8
FIELDS = (("content", 1.0), ("heading", 1.5), ("title", 1.25))
SECTIONS = "doc_id long, section int, section_id string, heading string, level int, start_line int, end_line int, content string, refs array<string>, dates array<string>"
_HEADING = re.compile(r"^ {0,3}(#{1,6})\s+(.*?)\s*#*\s*$")
_FENCE = re.compile(r"^ {0,3}(`{3,}|~{3,})")
_LINK = re.compile(r"\[[^\]]*\]\(([^)\s]+)\)|\b([\w./-]+\.(?:md|rs|py|ts|go|sql|toml):\d+)\b")
_DATE = re.compile(r"\b(\d{4}-\d{2}-\d{2})\b")


def slug(heading: str) -> str:
    return re.sub(r"[\W_]+", "-", heading.lower()).strip("-") or "document"


def reserved(ids: list[str]) -> list[str]:
    """The ids, each in turn with the first number from 2 on behind it that makes it new, where it was given before."""
    out: dict[str, None] = {}
    for i in ids:
        numbered = (f"{i}-{n}" for n in count(2))
        own = i
        while own in out:
            own = next(numbered)
        out[own] = None
    return list(out)


def section_ids(headings: list[str | None], pieces: list[int]) -> list[list[str]]:
    """The ids of each section's pieces: its slug, numbered where it comes again, with the number of the piece if there are several; all of them different."""
    seen: Counter = Counter()
    wanted = []
    for h, n in zip(headings, pieces, strict=True):
        base = slug(h or "")
        seen[base] += 1
        base = base if seen[base] == 1 else f"{base}-{seen[base]}"
        wanted.append([base] if n == 1 else [f"{base}-part-{k}" for k in range(1, n + 1)])
    given = iter(reserved([i for own in wanted for i in own]))
    return [[next(given) for _ in own] for own in wanted]


def sections(text: str) -> Iterator[dict]:
    """The sections of a markdown text: a heading and what follows up to the next, in pieces of at most 8,000 characters with ids of their own.

    Headings inside fences are text; a fence ends with as many signs as it began
    with, at least. Links and source references count outside of fences. Dates
    come from front matter and headings.
    """
    lines, parts, fence, front = text.splitlines(), [], "", False
    own = {"heading": None, "level": 0, "start": 1, "lines": [], "refs": [], "dates": []}
    for n, line in enumerate(lines, 1):
        front = (n == 1 and line.strip() == "---") or (front and not (n > 1 and line.strip() == "---"))
        mark = _FENCE.match(line)
        if fence:
            if mark and mark[1][0] == fence[0] and len(mark[1]) >= len(fence) and not line.strip().strip(fence[0]):
                fence = ""
        elif mark:
            fence = mark[1]
        else:
            h = None if front else _HEADING.match(line)
            if h:
                parts.append(own)
                own = {"heading": h[2], "level": len(h[1]), "start": n, "lines": [], "refs": [], "dates": _DATE.findall(h[2])}
            elif front:
                own["dates"] += _DATE.findall(line)
            own["refs"] += [a or b for a, b in _LINK.findall(line)]
        own["lines"].append(line)
    parts.append(own)
    filled = [p | {"body": body} for p in parts if (body := "\n".join(p["lines"])).strip()]
    cuts = [range(0, len(p["body"]), SECTION_CHARS) for p in filled]
    for p, own, starts in zip(filled, section_ids([p["heading"] for p in filled], list(map(len, cuts))), cuts, strict=True):
        at = p["start"]
        for k, section_id in zip(starts, own, strict=True):
            piece = p["body"][k : k + SECTION_CHARS]
            end = at + piece.count("\n")
            yield {"section_id": section_id, "heading": p["heading"], "level": p["level"], "start_line": at, "end_line": end, "content": piece, "refs": p["refs"] if k == 0 else [], "dates": p["dates"] if k == 0 else []}
            at = end


def _split(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    types = {"doc_id": pa.int64(), "section": pa.int32(), "section_id": pa.string(), "heading": pa.string(), "level": pa.int32(), "start_line": pa.int32(), "end_line": pa.int32(), "content": pa.string(), "refs": pa.list_(pa.string()), "dates": pa.list_(pa.string())}
    for b in batches:
        rows = [s | {"doc_id": i, "section": k} for i, t in zip(b["doc_id"].to_pylist(), b["text"].to_pylist(), strict=True) if t for k, s in enumerate(sections(t))]
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in types.items()], names=list(types))


def split_sections(documents: DataFrame) -> DataFrame:
    """The sections of documents (doc_id, text); null and blank texts have none."""
    return documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(_split, SECTIONS)


def title(text: Column) -> Column:
    """The first heading of the first level, else the title of the front matter."""
    return F.coalesce(F.nullif(F.regexp_extract(text, r"(?m)^# (.+?)\s*$", 1), F.lit("")), F.nullif(F.regexp_extract(text, r"(?s)\A---\n.*?^?title: ([^\n]+)", 1), F.lit("")))


def views_of(queries: list[str]) -> list[str]:
    """The different questions that aren't blank; more than eight are an error, and so are none."""
    views = list(dict.fromkeys(v.strip() for v in queries if v.strip()))
    if len(views) > MOST_VIEWS:
        raise ValueError(f"more than {MOST_VIEWS} different queries")
    return views


def eligible(sections: DataFrame, project: str | None = None, cwd: str | None = None, source: str | None = None, since: int | None = None, until: int | None = None) -> DataFrame:
    """sections (project, cwd, source, mtime) that a search may show; a cwd counts for what lies at it or above it, since and until both count."""
    c = F.col
    if project is not None:
        sections = sections.where(F.lower(c("project")) == project.lower())
    if cwd is not None:
        sections = sections.where((c("cwd") == cwd) | F.lit(cwd).startswith(F.concat(F.regexp_replace("cwd", "/+$", ""), F.lit("/"))))
    if source is not None:
        sections = sections.where(c("source") == source)
    if since is not None:
        sections = sections.where(c("mtime") >= since)
    if until is not None:
        sections = sections.where(c("mtime") <= until)
    return sections


def search(parts: DataFrame, queries: list[str], limit: int, per_document: int = 2, depth: int = 200, indexes: dict[str, Index] | None = None, allowed: DataFrame | None = None, newest_first: bool = False) -> DataFrame:
    """The best sections (doc_id, section) for several views of a question, with their score.

    Each view scores text, heading x 1.5 and title x 1.25; views fuse by reciprocal
    ranks; at most ``per_document`` sections of a document stay. Blank views and
    repeats don't count, more than eight are an error. Without any view all sections
    score 1. indexes: written indexes of the three fields by a ``section_key``, kept
    with doc_id and section; without them the texts are read. allowed: (doc_id,
    section) that may show (see ``eligible``); words count over all. newest_first:
    in order of mtime, which allowed then brings.
    """
    views = views_of(queries)
    key = ["doc_id", "section"]
    if not views or views == ["*"]:
        hits = parts.select(*key).withColumn("score", F.lit(1.0))
    else:
        cases = dict(enumerate(views))
        each = lambda f: indexes[f].search_each(cases) if indexes else lexical.bm25_each(parts, f, cases)
        fields = [each(f).select("case", *key, (F.col("score") * w).alias("score")) for f, w in FIELDS]
        summed = fields[0].unionByName(fields[1]).unionByName(fields[2]).groupBy("case", *key).agg(F.round(F.sum("score"), 6).alias("score"))
        hits = ranking.rrf_cases(summed if allowed is None else summed.join(allowed.select(*key), key, "left_semi"), key, depth)
    if allowed is not None:
        hits = hits.join(allowed.select(*key, *(["mtime"] if newest_first else [])), key)
    kept = ranking.capped(hits, ["doc_id"], per_document, F.desc("score"), "section")
    return kept.orderBy(F.desc("mtime"), F.desc("score"), *key).limit(limit) if newest_first else lexical.top(kept, limit, *key)


def refresh(stored: DataFrame, found: DataFrame, failed_roots: DataFrame) -> DataFrame:
    """stored memories (path, root, version, text) brought up to date with those found; what a failed root had stays and is marked stale.

    A path that is found is replaced; one that isn't found is gone, unless its root failed.
    """
    f = found.select("path", F.col("root").alias("f_root"), F.col("version").alias("f_version"), F.col("text").alias("f_text"))
    j = stored.join(f, "path", "full_outer").join(failed_roots.select("root", F.lit(True).alias("failed")), "root", "left")
    is_found = F.col("f_version").isNotNull()
    kept = j.where(is_found | F.coalesce("failed", F.lit(False)))
    return kept.select("path", F.coalesce("f_root", "root").alias("root"), F.coalesce("f_version", "version").alias("version"), F.when(is_found, F.col("f_text")).otherwise(F.col("text")).alias("text"), (~is_found).alias("stale"))
