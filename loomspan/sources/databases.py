"""Stores in SQLite files, read by a Python data source, a partition for each file and range of rows."""

from __future__ import annotations

import glob
import os
import sqlite3
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class _Range(InputPartition):
    def __init__(self, path: str, low: int, high: int):
        self.path, self.low, self.high = path, low, high


class SqliteSource(DataSource):
    """options: path (a glob), table, rows (of a partition; 100,000). The schema names the columns; those that a file lacks are null. Add source_path for the file.

    Files that aren't databases, or lack the table, give no rows.
    """

    @classmethod
    def name(cls) -> str:
        return "loomspan_sqlite"

    def reader(self, schema):  # noqa: ANN001, ANN201
        return _Reader(schema, self.options)


class _Reader(DataSourceReader):
    def __init__(self, schema, options):  # noqa: ANN001
        self.columns = [f.name for f in schema.fields]
        self.paths, self.table, self.rows = options["path"], options["table"], int(options.get("rows", "100000"))

    def partitions(self) -> list[_Range]:
        out = []
        for path in sorted(glob.glob(self.paths, recursive=True)):
            try:
                with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as c:
                    high = c.execute(f'SELECT max(rowid) FROM "{self.table}"').fetchone()[0] or 0
            except sqlite3.Error:
                continue
            out += [_Range(path, k, k + self.rows) for k in range(0, high + 1, self.rows)]
        return out

    def read(self, partition: _Range) -> Iterator[tuple]:
        with sqlite3.connect(f"file:{partition.path}?mode=ro", uri=True) as c:
            have = {r[1] for r in c.execute(f'PRAGMA table_info("{self.table}")')}
            wanted = ", ".join(f'"{x}"' if x in have else "NULL" for x in self.columns if x != "source_path")
            for row in c.execute(f'SELECT {wanted or "1"} FROM "{self.table}" WHERE rowid >= ? AND rowid < ? ORDER BY rowid', (partition.low, partition.high)):
                it = (v.decode(errors="replace") if isinstance(v, bytes) else v for v in row)
                yield tuple(os.path.abspath(partition.path) if x == "source_path" else next(it) for x in self.columns)


def read_table(spark: SparkSession, path: str, table: str, schema: str) -> DataFrame:
    spark.dataSource.register(SqliteSource)
    return spark.read.format("loomspan_sqlite").schema(schema).option("path", path).option("table", table).load()


def opencode_records(spark: SparkSession, path: str) -> DataFrame:
    """Text parts of messages in their sessions: session x message x part; a session with a parent is a fork."""
    s = read_table(spark, path, "session", "source_path string, id string, directory string, parent_id string").select("source_path", F.col("id").alias("session_id"), "directory", "parent_id")
    m = read_table(spark, path, "message", "source_path string, id string, session_id string, time_created bigint, data string").select("source_path", F.col("id").alias("message_id"), "session_id", F.col("time_created").alias("ts"), F.get_json_object("data", "$.role").alias("role"))
    p = read_table(spark, path, "part", "source_path string, id string, message_id string, data string").select("source_path", F.col("id").alias("event_id"), "message_id", F.get_json_object("data", "$.type").alias("type"), F.get_json_object("data", "$.text").alias("text"))
    j = p.where("type = 'text' and text is not null").join(m, ["source_path", "message_id"]).join(s, ["source_path", "session_id"])
    return j.select(F.lit("opencode").alias("source"), "ts", F.lit("opencode").alias("project"), "session_id", "source_path", "role", "text", "event_id", F.when(F.col("parent_id").isNotNull(), "fork").otherwise("main").alias("conversation_kind"))


def opencode_usage(spark: SparkSession, path: str) -> DataFrame:
    """Usage of assistant messages; reasoning counts as output, rows without tokens are left out."""
    m = read_table(spark, path, "message", "source_path string, id string, session_id string, time_created bigint, data string")
    n = lambda k: F.coalesce(F.get_json_object("data", f"$.tokens.{k}").try_cast("bigint"), F.lit(0))
    u = m.where(F.get_json_object("data", "$.role") == "assistant").select(
        F.lit("opencode").alias("source"), "source_path", F.col("time_created").alias("timestamp_ms"), "session_id", F.col("id").alias("source_record_id"), F.get_json_object("data", "$.providerID").alias("provider"), F.get_json_object("data", "$.modelID").alias("model"),
        n("input").alias("uncached_input"), n("cache.read").alias("cache_read"), n("cache.write").alias("cache_write"), (n("output") + n("reasoning")).alias("output"),
    )
    return u.where("uncached_input + cache_read + cache_write + output > 0")


def opencode_objects(sessions: DataFrame, messages: DataFrame, parts: DataFrame) -> DataFrame:
    """The same records from frames (source_path, raw) of JSON files for sessions, messages and parts."""
    g = lambda k: F.get_json_object("raw", f"$.{k}")
    s = sessions.select(g("id").alias("session_id"), g("parentID").alias("parent_id"))
    m = messages.select(g("id").alias("message_id"), g("sessionID").alias("session_id"), g("role").alias("role"), g("time.created").try_cast("bigint").alias("ts"))
    p = parts.where(g("type") == "text").select("source_path", g("id").alias("event_id"), g("messageID").alias("message_id"), g("text").alias("text")).where("text is not null")
    j = p.join(m, "message_id").join(s, "session_id")
    return j.select(F.lit("opencode").alias("source"), "ts", F.lit("opencode").alias("project"), "session_id", "source_path", "role", "text", "event_id", F.when(F.col("parent_id").isNotNull(), "fork").otherwise("main").alias("conversation_kind"))


def opencode_v2_records(spark: SparkSession, path: str) -> DataFrame:
    """The rows of session_message, where a store has them: user, system and assistant texts, tools as assistant rows with tool fields, in order of time."""
    m = read_table(spark, path, "session_message", "source_path string, id string, session_id string, type string, time_created bigint, data string")
    g = lambda k: F.get_json_object("data", f"$.{k}")
    tool = F.when(F.col("type") == "tool", g("tool"))
    out = F.coalesce(g("state.output"), g("state.error"), g("output"))
    role = F.when(F.col("type") == "tool", "assistant").otherwise(F.col("type"))
    return m.where("type in ('user', 'system', 'assistant', 'tool')").select(
        F.lit("opencode").alias("source"), F.col("time_created").alias("ts"), F.lit("opencode").alias("project"), "session_id", "source_path", role.alias("role"), F.coalesce(F.when(tool.isNull(), g("text")), F.lit("")).alias("text"),
        tool.alias("tool_name"), F.when(tool.isNotNull(), g("state.input")).alias("tool_input"), F.when(tool.isNotNull(), out).alias("tool_output"), F.col("id").alias("event_id"),
    )


def editor_values(spark: SparkSession, path: str) -> DataFrame:
    """(source_path, line_no, key, raw) of the two state tables of an editor, for ``nested_usage.usage_in``."""
    rows = None
    for table in ("ItemTable", "cursorDiskKV"):
        t = read_table(spark, path, table, "source_path string, key string, value string").select("source_path", F.lit(0).cast("bigint").alias("line_no"), "key", F.col("value").alias("raw"))
        rows = t if rows is None else rows.unionByName(t)
    return rows.where("raw is not null")


def bob_usage(spark: SparkSession, path: str) -> DataFrame:
    """Usage of assistant messages that spent something; their own cost counts, and they are no part of cache chains."""
    m = read_table(spark, path, "messages", "source_path string, id bigint, task_id string, role string, timestamp bigint, model string, tokens_in bigint, tokens_out bigint, cache_reads bigint, cache_writes bigint, cost double")
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    u = m.where("role = 'assistant'").select(
        F.lit("bob").alias("source"), F.concat("source_path", F.lit("/"), "task_id").alias("source_path"), F.col("id").cast("string").alias("source_record_id"), F.col("task_id").alias("session_id"), F.col("timestamp").alias("timestamp_ms"), "model",
        n("tokens_in").alias("uncached_input"), n("cache_reads").alias("cache_read"), n("cache_writes").alias("cache_write"), n("tokens_out").alias("output"), F.col("cost").alias("source_cost_usd"), F.lit(True).alias("cost_authoritative"), F.lit(True).alias("cache_chain_excluded"),
    )
    return u.where("uncached_input + cache_read + cache_write + output > 0 or source_cost_usd > 0")


def bob_records(spark: SparkSession, path: str) -> DataFrame:
    """Messages of tasks under the virtual path of their task, in order of time, then row."""
    t = read_table(spark, path, "tasks", "source_path string, id string, workspace string").select("source_path", F.col("id").alias("session_id"), "workspace")
    m = read_table(spark, path, "messages", "source_path string, id bigint, task_id string, role string, content string, timestamp bigint").withColumnRenamed("task_id", "session_id")
    j = m.join(t, ["source_path", "session_id"])
    return j.select(F.lit("bob").alias("source"), F.col("timestamp").alias("ts"), F.regexp_extract("workspace", r"([^/]+)/?$", 1).alias("project"), "session_id", F.concat("source_path", F.lit("/"), "session_id").alias("source_path"), "role", F.coalesce("content", F.lit("")).alias("text"), F.col("id").alias("row"))


def hermes_usage(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(rows by model, totals by session) for ``usage.residual``."""
    s = read_table(spark, path, "sessions", "source_path string, id string, input_tokens bigint, output_tokens bigint").select("source_path", F.col("id").alias("session_id"), F.col("input_tokens").alias("input"), F.col("output_tokens").alias("output"))
    r = read_table(spark, path, "session_model_usage", "source_path string, session_id string, model string, input_tokens bigint, output_tokens bigint").select("source_path", "session_id", "model", F.col("input_tokens").alias("input"), F.col("output_tokens").alias("output"))
    return r, s
