"""Queries of the general training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.operators import drift, hierarchy, identifiers, nested, timestamps
from loomspan.session import table

Query = Callable[[SparkSession, str], DataFrame]


def _trees(spark: SparkSession, sf: str, paths: bool) -> DataFrame:
    omp = hierarchy.hierarchy(table(spark, sf, "omp"), "id", "parentid", F.col("source_path"), F.col("line_no"), paths=paths)
    sessions = hierarchy.hierarchy(table(spark, sf, "sessions"), "session_id", "parent_session_id", paths=paths)
    return omp.select(F.lit("omp").alias("node_kind"), "*").unionByName(sessions.select(F.lit("sessions").alias("node_kind"), "*"))


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return _trees(spark, sf, False).select("node_kind", F.col("node").alias("node_id"), F.col("root").alias("root_id"), "depth")


def p2_paths(spark: SparkSession, sf: str) -> DataFrame:
    """The path of every node outside cycles."""
    return _trees(spark, sf, True).where("path is not null").select("node_kind", F.col("node").alias("node_id"), "path")


def p2_descendants(spark: SparkSession, sf: str) -> DataFrame:
    """How many nodes lie below each node outside cycles that has any."""
    t = _trees(spark, sf, True)
    kinds = [hierarchy.descendants(t.where(F.col("node_kind") == k)).groupBy(F.col("ancestor").alias("node_id")).agg(F.count("*").alias("n"), F.max("distance").alias("height")).withColumn("node_kind", F.lit(k)) for k in ("omp", "sessions")]
    return kinds[0].unionByName(kinds[1])


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return identifiers.redundant_rows(table(spark, sf, "omp"))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return timestamps.foreign_stamps(spark, *[table(spark, sf, t) for t in ("omp", "transcript", "sessions", "machines")])


def p4_zones(spark: SparkSession, sf: str) -> DataFrame:
    """The zone that the data speak for, for each machine, beside the declared one."""
    stamps = timestamps.transcript_stamps(spark, *[table(spark, sf, t) for t in ("omp", "transcript", "sessions")])
    machines = table(spark, sf, "machines")
    return timestamps.estimate_zones(timestamps.parsed_stamps(stamps, machines), machines)


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return drift.file_changes(*[table(spark, sf, t) for t in ("transcript", "omp_head", "schema_fields")])


def p5_schema(spark: SparkSession, sf: str) -> DataFrame:
    return drift.union_schema(*[table(spark, sf, t) for t in ("transcript", "omp_head", "schema_fields")])


def p5_steps(spark: SparkSession, sf: str) -> DataFrame:
    return drift.consistent_steps(*[table(spark, sf, t) for t in ("transcript", "omp_head", "schema_fields")])


def p5_table(spark: SparkSession, sf: str) -> DataFrame:
    """Steps, calls, arguments of tools, titles and sessions in one table, in the types of p5_schema."""
    return drift.consistent_table(*[table(spark, sf, t) for t in ("transcript", "omp_head", "schema_fields")])


def p5_log(spark: SparkSession, sf: str) -> DataFrame:
    """Every difference of every line, in the order of file time and line."""
    return drift.difference_log(*[table(spark, sf, t) for t in ("transcript", "omp_head", "schema_fields")])


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return nested.array_objects(table(spark, sf, "omp"), table(spark, sf, "transcript"))


def p6_items(spark: SparkSession, sf: str) -> DataFrame:
    """The content items as a table of their own."""
    rows = nested.flat_rows(table(spark, sf, "omp"), table(spark, sf, "transcript"))
    return nested.flat_table(rows, "omp.message.content", "type string, text string, thinking string, data string, id string, name string, arguments string")


def p6_rows(spark: SparkSession, sf: str) -> DataFrame:
    """All related tables, told apart by table_tag."""
    return nested.related_rows(table(spark, sf, "omp"), table(spark, sf, "transcript"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (p2_found, p2_paths, p2_descendants, p3_found, p4_found, p4_zones, p5_found, p5_schema, p5_steps, p5_table, p5_log, p6_found, p6_items, p6_rows)}

_WALK = """WITH RECURSIVE n AS (SELECT 'omp' AS k, id, min(parentid) AS p FROM omp WHERE id IS NOT NULL GROUP BY id UNION ALL SELECT 'sessions', session_id, min(parent_session_id) FROM sessions WHERE session_id IS NOT NULL GROUP BY session_id),
  v AS (SELECT n.k, n.id, q.id AS p FROM n LEFT JOIN n q ON q.k = n.k AND q.id = n.p),
  w(k, id, cur, up, path) AS (SELECT k, id, id, p, [id] FROM v UNION ALL SELECT w.k, w.id, v.id, v.p, list_append(w.path, v.id) FROM w JOIN v ON v.k = w.k AND v.id = w.up WHERE NOT list_contains(w.path, w.up)),
  e AS (SELECT * FROM w WHERE up IS NULL OR list_contains(path, up)) """

SQL: dict[str, str] = {
    "p2_found": _WALK
    + """SELECT k AS node_kind, id AS node_id, CASE WHEN up IS NULL THEN cur ELSE list_min(path[list_position(path, up):]) END AS root_id,
  CAST(CASE WHEN up IS NULL THEN len(path) - 1 ELSE -1 END AS INT) AS depth FROM e""",
    "p2_paths": _WALK + "SELECT k AS node_kind, id AS node_id, '/' || array_to_string(list_reverse(path), '/') AS path FROM e WHERE up IS NULL",
    "p2_descendants": _WALK
    + """SELECT node_kind, node_id, count(*) AS n, CAST(max(d) AS INT) AS height FROM (SELECT k AS node_kind, unnest(path[2:]) AS node_id, generate_subscripts(path[2:], 1) AS d FROM e WHERE up IS NULL AND len(path) > 1) GROUP BY ALL""",
    "p3_found": """WITH RECURSIVE i AS (SELECT rec_id, unnest(list_concat([CASE WHEN id IS NOT NULL THEN 'r' || id END, CASE WHEN trim(message.id) <> '' THEN 'm' || message.id END],
    list_transform(list_filter(coalesce(message.content, []), lambda x: x.type = 'toolCall' AND trim(x.id) <> ''), lambda x: 'c' || x.id))) AS ident FROM omp),
  l AS (SELECT DISTINCT a.rec_id AS a, b.rec_id AS b FROM i a JOIN i b USING (ident)), r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b),
  g AS (SELECT a AS rec_id, min(b) AS comp FROM r GROUP BY a),
  o AS (SELECT rec_id, row_number() OVER (PARTITION BY comp ORDER BY coalesce(message.usage.output, -1) DESC, rec_id) AS n FROM g JOIN omp USING (rec_id)) SELECT rec_id FROM o WHERE n > 1""",
    "p6_items": """SELECT 'omp' AS parent_table, rec_id AS parent_id, 'message.content[' || pos || ']' AS path, 'message' AS parent_path, pos AS position, item.type AS type, item.text AS text, item.thinking AS thinking,
  item.data AS data, item.id AS id, item.name AS name, item.arguments AS arguments FROM (SELECT rec_id, unnest(message.content) AS item, CAST(generate_subscripts(message.content, 1) - 1 AS INT) AS pos FROM omp) WHERE item IS NOT NULL""",
    "p6_found": r"""WITH t AS (SELECT line_id AS id, raw, json_type(raw, '$.tool_calls') = 'OBJECT' AS lone FROM transcript WHERE json_valid(raw) AND json_type(raw) = 'OBJECT'),
  own AS (SELECT id, lone, replace(substr(fullkey, 3), '"', '') AS p, type, value FROM (SELECT id, lone, unnest(tree, recursive := true) FROM (SELECT id, lone, (SELECT list({'fullkey': fullkey, 'type': type, 'value': CAST(value AS VARCHAR)}) FROM json_tree(t.raw)) AS tree FROM t))),
  q AS (SELECT id, CASE WHEN lone AND (p = 'tool_calls' OR starts_with(p, 'tool_calls.')) THEN 'tool_calls[0]' || substr(p, 11) ELSE p END AS p, type, value FROM own),
  s AS (SELECT id, p, value FROM (SELECT id, p, json_extract_string(value, '$') AS value FROM q WHERE type = 'VARCHAR' AND regexp_matches(p, '^tool_calls\[[0-9]+\]\.[^.\[]+$')) WHERE json_valid(value) AND json_type(value) IN ('OBJECT', 'ARRAY')),
  deep AS (SELECT 'transcript' AS parent_table, id AS parent_id, p, value FROM s UNION ALL
    SELECT 'omp', rec_id, 'message.content[' || pos || '].arguments', arguments FROM (SELECT rec_id, unnest(message.content).arguments AS arguments, generate_subscripts(message.content, 1) - 1 AS pos FROM omp) WHERE json_valid(arguments) AND json_type(arguments) IN ('OBJECT', 'ARRAY')),
  inner_ AS (SELECT parent_table, parent_id, p || replace(substr(fullkey, 2), '"', '') AS path, type FROM (SELECT parent_table, parent_id, p, unnest(tree, recursive := true) FROM (SELECT parent_table, parent_id, p, (SELECT list({'fullkey': fullkey, 'type': type}) FROM json_tree(deep.value)) AS tree FROM deep)))
SELECT parent_table, parent_id, path FROM inner_ WHERE type = 'OBJECT' AND ends_with(path, ']') UNION ALL
SELECT 'transcript', id, p FROM q WHERE type = 'OBJECT' AND ends_with(p, ']') UNION ALL
SELECT 'omp', rec_id, 'message.content[' || pos || ']' FROM (SELECT rec_id, unnest(message.content) AS item, generate_subscripts(message.content, 1) - 1 AS pos FROM omp) WHERE item IS NOT NULL""",
}
