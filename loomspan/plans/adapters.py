"""The test tables as the engine's records, sessions, usage events and memories; each with the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomspan.functions.stamps import wall_us
from loomspan.session import table

PROJECT = r"([^/]+)/[^/]+$"


def records(spark: SparkSession, sf: str) -> DataFrame:
    """session_message as records; a session's order is by time, then row."""
    m = table(spark, sf, "session_message")
    scope = Window.partitionBy("source", "session_id", "source_path").orderBy("ts", "row_id")
    return m.select(
        "source", F.col("row_id").alias("doc_id"), "ts", F.regexp_extract("source_path", PROJECT, 1).alias("project"), "session_id", "source_path",
        (F.row_number().over(scope) - 1).alias("turn_id"), "role", F.coalesce("content", F.lit("")).alias("text"), "tool_name",
        F.col("record_id").alias("event_id"), F.when(F.col("role") == "system", "main").when(F.col("tool_name").isNotNull(), "sidechain").alias("conversation_kind"),
    )


RECORDS_SQL = r"""records AS (
  SELECT source, row_id AS doc_id, ts, regexp_extract(source_path, '([^/]+)/[^/]+$', 1) AS project, session_id, source_path,
    CAST(row_number() OVER (PARTITION BY source, session_id, source_path ORDER BY ts, row_id) - 1 AS INT) AS turn_id,
    role, coalesce(content, '') AS text, tool_name, record_id AS event_id,
    CASE WHEN role = 'system' THEN 'main' WHEN tool_name IS NOT NULL THEN 'sidechain' END AS conversation_kind
  FROM session_message)"""


def sessions(spark: SparkSession, sf: str) -> DataFrame:
    """sessions, the latest row of each identity, blanks as nulls."""
    s = table(spark, sf, "sessions")
    own = Window.partitionBy("source", "session_id", "source_path").orderBy(F.desc("row_id"))
    null = lambda c: F.nullif(F.trim(c), F.lit("")).alias(c)
    return s.withColumn("rn", F.row_number().over(own)).where("rn = 1").select(
        "source", "session_id", "source_path", "project", "machine", "cwd", null("git_root"), null("git_common_dir"), null("repo_project"), "last_at", "message_count", null("label"), null("conversation_kind"), "parent_session_id"
    )


SESSIONS_SQL = """s AS (
  SELECT source, session_id, source_path, project, machine, cwd, nullif(trim(git_root), '') AS git_root, nullif(trim(git_common_dir), '') AS git_common_dir,
    nullif(trim(repo_project), '') AS repo_project, last_at, message_count, nullif(trim(label), '') AS label, nullif(trim(conversation_kind), '') AS conversation_kind, parent_session_id
  FROM (SELECT *, row_number() OVER (PARTITION BY source, session_id, source_path ORDER BY row_id DESC) AS rn FROM sessions) WHERE rn = 1)"""


def usage_events(spark: SparkSession, sf: str) -> DataFrame:
    """The usage of omp messages as usage events; the time is that of receipt, as its own stamps have many forms."""
    o = table(spark, sf, "omp").where("message.usage is not null")
    n = lambda c: F.coalesce(F.col(f"message.usage.{c}"), F.lit(0))
    return o.select(
        F.lit("omp").alias("source"), "source_path", F.col("rec_id").alias("row_idx"), F.col("line_no").cast("bigint").alias("source_order"), F.floor(wall_us(F.col("received_at")) / 1000).alias("timestamp_ms"),
        "session_id", F.col("project_id").alias("project"), F.col("message.provider").alias("provider"), F.col("message.model").alias("model"), F.col("id").alias("source_record_id"),
        F.nullif(F.trim("message.id"), F.lit("")).alias("message_id"), F.col("parentid").alias("request_id"), n("input").alias("raw_input"), n("input").alias("uncached_input"),
        n("cacheread").alias("cache_read"), n("cachewrite").alias("cache_write"), n("output").alias("output"), (F.col("rec_id") % 11 == 0).alias("sidechain"), (F.col("rec_id") % 37 == 0).alias("chain_break"),
    )


USAGE_SQL = """u AS (
  SELECT 'omp' AS source, source_path, rec_id AS row_idx, CAST(line_no AS BIGINT) AS source_order, epoch_ms(received_at) AS timestamp_ms, session_id, project_id AS project,
    message.provider AS provider, message.model AS model, id AS source_record_id, nullif(trim(message.id), '') AS message_id, parentid AS request_id,
    coalesce(message.usage.input, 0) AS raw_input, coalesce(message.usage.input, 0) AS uncached_input, coalesce(message.usage.cacheread, 0) AS cache_read,
    coalesce(message.usage.cachewrite, 0) AS cache_write, coalesce(message.usage.output, 0) AS output, rec_id % 11 = 0 AS sidechain, rec_id % 37 = 0 AS chain_break
  FROM omp WHERE message.usage IS NOT NULL)"""


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding", "label")
