"""Records made ready for models and readers: vectors, conversation messages, references, fingerprints."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspan.functions.text import label, labelled_hash

EMBED_BYTES = 8192


def embed(records: DataFrame, model: Callable[[list[str]], np.ndarray], dims: int, batch: int = 256) -> DataFrame:
    """(doc_id, embedding) of user and assistant records with text, by a model for batches of texts; a text counts up to 8,192 bytes, in whole characters."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            texts = [t.encode()[:EMBED_BYTES].decode(errors="ignore") for t in b]
            parts = [np.asarray(model(texts[k : k + batch]), np.float32) for k in range(0, len(texts), batch)]
            if any(p.shape[1] != dims for p in parts):
                raise ValueError(f"the model doesn't give {dims} dimensions")
            yield pd.Series([row.tolist() for p in parts for row in p], index=b.index)

    return records.where("role in ('user', 'assistant') and trim(text) <> ''").select("doc_id", run("text").alias("embedding"))


def conversation_messages(records: DataFrame, compact: bool = True, note_chars: int = 200) -> DataFrame:
    """records with speaker and message as a reader sees them: prompts cleaned, tools as notes, thoughts and lifecycle rows left out when compact."""
    role = F.col("role")
    speaker = F.when(role.isin("user", "assistant", "system"), role).when(role.isin("tool_use", "tool_result", "tool"), "tool").otherwise("note")
    note = F.concat(F.lit("["), F.coalesce("tool_name", F.lit("tool")), F.when(role == "tool_use", ": ").otherwise(" -> "), F.substring(F.regexp_replace("text", r"\s+", " "), 1, note_chars), F.lit("]"))
    message = F.when(speaker == "tool", note).when(speaker == "user", label(F.col("text")) if compact else F.trim("text")).otherwise(F.trim("text"))
    out = records.withColumn("speaker", speaker).withColumn("message", message)
    return out.where("speaker <> 'note' and message <> ''") if compact else out


def section_ref(version: Column, section_id: Column) -> Column:
    return F.concat_ws(":", F.lit("msec1"), version, section_id)


def read_section_ref(ref: Column) -> Column:
    """struct(version, section_id); null for anything else."""
    p = F.split(ref, ":", 3)
    return F.when((F.size(p) == 3) & (p[0] == "msec1"), F.struct(p[1].alias("version"), p[2].alias("section_id")))


def content_version(text: Column) -> Column:
    return F.sha2(text, 256)


def section_vector_id(stable_id: Column, section_id: Column, version: Column) -> Column:
    """A positive number for a section of a version of a memory."""
    return F.conv(F.substring(labelled_hash(("memory", stable_id), ("section", section_id), ("version", version)), 1, 15), 16, 10).cast("bigint")


def listing_fingerprint(files: DataFrame) -> str:
    """One hash of all files (source_path, size, mtime), the same in any order; it is a sum of row hashes, so nothing is gathered."""
    h = F.sha2(F.concat_ws("\x1f", "source_path", "size", "mtime"), 256)
    halves = [F.sum(F.conv(F.substring(h, 1 + 15 * k, 15), 16, 10).cast("decimal(38,0)")).alias(f"h{k}") for k in range(4)]
    row = files.agg(F.count("*").alias("n"), *halves).first()
    return hashlib.sha256("|".join(str(x) for x in row).encode()).hexdigest()


def cursor_changes(now: DataFrame, before: DataFrame) -> DataFrame:
    """Sessions of a store whose (rows, last_seq, last_time) differ from the last scan: session_id, change (new, changed, gone)."""
    j = now.select("session_id", F.struct("rows", "last_seq", "last_time").alias("n")).join(before.select("session_id", F.struct("rows", "last_seq", "last_time").alias("b")), "session_id", "full_outer")
    return j.where(~F.col("n").eqNullSafe(F.col("b"))).select("session_id", F.when(F.col("b").isNull(), "new").when(F.col("n").isNull(), "gone").otherwise("changed").alias("change"))


def replace_partitions(rows: DataFrame, path: str, by: str) -> None:
    """Write rows into a table partitioned by a column, replacing the partitions that occur in rows and no others."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)
