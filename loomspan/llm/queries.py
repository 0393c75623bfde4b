"""Queries of the operators for training text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomspan.llm import conversations, packing, pii, tokens, truncation
from loomspan.session import table

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return conversations.conversations(table(spark, sf, "omp"), table(spark, sf, "session_message"))


def p1_events(spark: SparkSession, sf: str) -> DataFrame:
    """How many events of the log create, edit, repeat, retry or delete a message."""
    return conversations.event_counts(table(spark, sf, "omp"))


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return truncation.cut_rows(table(spark, sf, "session_message"), table(spark, sf, "transcript"))


def p7_rates(spark: SparkSession, sf: str) -> DataFrame:
    return truncation.cut_rates(table(spark, sf, "session_message"), table(spark, sf, "transcript"))


def p8_ids(spark: SparkSession, sf: str) -> DataFrame:
    return tokens.encoded(table(spark, sf, "documents"))


def p9_windows(spark: SparkSession, sf: str) -> DataFrame:
    return packing.windows(table(spark, sf, "documents"), table(spark, sf, "token_budgets"))


def p9_fill(spark: SparkSession, sf: str) -> DataFrame:
    return packing.fill_rates(p9_windows(spark, sf), table(spark, sf, "token_budgets"))


def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    return pii.distinct_mentions(table(spark, sf, "documents"), table(spark, sf, "name_lexicon"))


def p10_redacted(spark: SparkSession, sf: str) -> DataFrame:
    return pii.redacted(table(spark, sf, "documents"), table(spark, sf, "name_lexicon"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (p1_found, p1_events, p7_found, p7_rates, p8_ids, p9_windows, p9_fill, p10_found, p10_redacted)}

_DROPPED = """i AS (SELECT rec_id, unnest(list_concat([CASE WHEN id IS NOT NULL THEN 'r' || id END, CASE WHEN trim(message.id) <> '' THEN 'm' || message.id END],
    list_transform(list_filter(coalesce(message.content, []), lambda x: x.type = 'toolCall' AND trim(x.id) <> ''), lambda x: 'c' || x.id))) AS ident FROM omp),
  l AS (SELECT DISTINCT a.rec_id AS a, b.rec_id AS b FROM i a JOIN i b USING (ident)), r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b),
  g AS (SELECT a AS rec_id, min(b) AS comp FROM r GROUP BY a),
  dropped AS (SELECT rec_id FROM (SELECT rec_id, row_number() OVER (PARTITION BY comp ORDER BY coalesce(message.usage.output, -1) DESC, rec_id) AS n FROM g JOIN omp USING (rec_id)) WHERE n > 1)"""

SQL: dict[str, str] = {
    "p1_found": f"""WITH RECURSIVE {_DROPPED},
  e AS (SELECT rec_id, coalesce(session_id, nullif(regexp_extract(source_path, '_([^_/]+)\\.jsonl$', 1), '')) AS s, id, parentid AS p,
    CASE WHEN type = 'message' THEN CASE WHEN regexp_replace(lower(message.role), '[^a-z]', '', 'g') IN ('user', 'human') THEN 'user' WHEN regexp_replace(lower(message.role), '[^a-z]', '', 'g') IN ('assistant', 'agent', 'model', 'ai', 'bot') THEN 'assistant'
      WHEN regexp_replace(lower(message.role), '[^a-z]', '', 'g') IN ('tool', 'toolresult', 'tooloutput', 'function') THEN 'tool' WHEN regexp_replace(lower(message.role), '[^a-z]', '', 'g') IN ('system', 'developer') THEN 'system' END END AS speaker,
    coalesce(len(list_filter(message.content, lambda x: x.type = 'text' AND regexp_matches(x.text, '\\S'))), 0) > 0 AS says, coalesce(len(list_filter(message.content, lambda x: x.type = 'toolCall')), 0) > 0 AS calls
    FROM omp WHERE rec_id NOT IN (SELECT rec_id FROM dropped)),
  c AS (SELECT s, count(*) AS n, count(p) AS linked, count(*) FILTER (WHERE p IS NULL) AS tops FROM e WHERE s IS NOT NULL GROUP BY s),
  w(s, id, rec_id, place) AS (SELECT s, e.id, rec_id, 0 FROM e JOIN c USING (s) WHERE (linked > 0 OR n = 1) AND tops = 1 AND p IS NULL UNION ALL SELECT e.s, e.id, e.rec_id, place + 1 FROM w JOIN e ON e.s = w.s AND e.p = w.id),
  lines AS (SELECT s FROM w JOIN c USING (s) GROUP BY s HAVING count(*) = max(n) AND count(DISTINCT place) = max(n)),
  t AS (SELECT record_id AS id, min(ts) AS place FROM session_message WHERE source = 'omp' AND ts > 0 GROUP BY record_id),
  timed AS (SELECT e.s, e.rec_id, t.place, speaker FROM e JOIN c USING (s) LEFT JOIN t ON t.id = e.id WHERE linked = 0 AND n > 1),
  unclear AS (SELECT s FROM timed WHERE place IS NULL AND speaker IS NOT NULL UNION SELECT s FROM timed WHERE place IS NOT NULL GROUP BY s, place HAVING count(*) > 1),
  placed AS (SELECT s, rec_id, CAST(place AS BIGINT) AS place FROM w JOIN lines USING (s) UNION ALL SELECT s, rec_id, place FROM timed WHERE place IS NOT NULL AND s NOT IN (SELECT s FROM unclear)),
  said AS (SELECT e.*, place FROM placed JOIN e USING (s, rec_id) WHERE speaker IS NOT NULL),
  marks AS (SELECT s, place, CASE WHEN speaker = 'user' THEN 'U' ELSE 'R' END AS m FROM said WHERE speaker = 'user' OR (speaker = 'assistant' AND (says OR calls))),
  mute AS (SELECT DISTINCT s FROM (SELECT s, m, lead(m) OVER (PARTITION BY s ORDER BY place) AS next FROM marks) WHERE m = 'U' AND (next IS NULL OR next = 'U')),
  good AS (SELECT DISTINCT s FROM said WHERE says AND speaker IN ('user', 'assistant') AND s NOT IN (SELECT s FROM mute))
  SELECT session_id, turn_no, id, speaker FROM (SELECT s AS session_id, CAST(row_number() OVER (PARTITION BY s ORDER BY place) AS INT) AS turn_no, id, speaker FROM said WHERE s IN (SELECT s FROM good)) WHERE id IS NOT NULL""",
    "p1_events": f"""WITH RECURSIVE {_DROPPED}
  SELECT kind, count(*) AS events FROM (SELECT CASE WHEN o.rec_id = c.rec_id THEN 'create' WHEN o.message.usage.output IS NOT DISTINCT FROM c.message.usage.output THEN 'copy' WHEN o.id IS NOT DISTINCT FROM c.id THEN 'edit' ELSE 'retry' END AS kind
    FROM omp o LEFT JOIN g ON g.rec_id = o.rec_id JOIN omp c ON c.rec_id = coalesce(g.comp, o.rec_id)) GROUP BY kind""",
}
