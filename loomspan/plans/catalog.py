"""Catalog queries over sessions and records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.operators import catalog
from loomspan.plans.adapters import RECORDS_SQL, SESSIONS_SQL, records, sessions
from loomspan.session import table

_R, _S = f"WITH {RECORDS_SQL}", f"WITH {SESSIONS_SQL}"
SQL: dict[str, str] = {}
SCOPE = catalog.SCOPE


def session_roll_up(spark: SparkSession, sf: str) -> DataFrame:
    """Sessions from records."""
    return catalog.roll_up(records(spark, sf)).fillna({"label_text": "-", "conversation_kind": "-"})


def _roll_up_sql(source: str) -> str:
    return f"""SELECT source, session_id, source_path, min(ts) AS started_at, max(ts) AS last_at, count(*) AS message_count,
    coalesce(arg_max(project, doc_id) FILTER (WHERE sets), arg_min(project, doc_id)) AS project,
    arg_min(text, (turn_id, ts, doc_id)) FILTER (WHERE role = 'user' AND trim(text) <> '') AS label_text,
    CASE WHEN bool_or(coalesce(conversation_kind = 'main', false)) THEN 'main' ELSE arg_min(conversation_kind, doc_id) FILTER (WHERE conversation_kind IS NOT NULL) END AS conversation_kind
  FROM (SELECT *, ts >= max(ts) OVER (PARTITION BY source, session_id, source_path ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AND project <> '' AS sets FROM {source}) GROUP BY ALL"""


SQL["session_roll_up"] = f"{_R} SELECT * REPLACE (coalesce(label_text, '-') AS label_text, coalesce(conversation_kind, '-') AS conversation_kind) FROM ({_roll_up_sql('records')})".replace("GROUP BY ALL", "GROUP BY source, session_id, source_path")


def session_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """The roll-up of one half of the records, brought up to date with the other half."""
    r = records(spark, sf)
    old, new = catalog.roll_up(r.where("doc_id % 2 = 0")), catalog.roll_up(r.where("doc_id % 2 = 1"))
    return catalog.upsert(old, new).fillna({"label_text": "-", "conversation_kind": "-"})


_HALF = lambda k: _roll_up_sql(f"(SELECT * FROM records WHERE doc_id % 2 = {k})").replace("GROUP BY ALL", "GROUP BY source, session_id, source_path")
SQL["session_upsert"] = f"""{_R}, o AS ({_HALF(0)}), n AS ({_HALF(1)})
  SELECT source, session_id, source_path, least(o.started_at, n.started_at) AS started_at, greatest(o.last_at, n.last_at) AS last_at,
    coalesce(o.message_count, 0) + coalesce(n.message_count, 0) AS message_count, coalesce(n.project, o.project) AS project,
    coalesce(o.label_text, n.label_text, '-') AS label_text, coalesce(o.conversation_kind, n.conversation_kind, '-') AS conversation_kind
  FROM o FULL JOIN n USING (source, session_id, source_path)"""


def session_delete(spark: SparkSession, sf: str) -> DataFrame:
    """Sessions without those whose path has no record any more."""
    s = sessions(spark, sf)
    gone = s.select("source_path").distinct().join(records(spark, sf).select("source_path").distinct(), "source_path", "left_anti")
    return catalog.delete(s, gone, ["source_path"]).select(*SCOPE)


SQL["session_delete"] = f"{_S} SELECT source, session_id, source_path FROM s WHERE source_path IN (SELECT source_path FROM session_message)"


def sessions_by_kind(spark: SparkSession, sf: str) -> DataFrame:
    """How many sessions each kind filter keeps."""
    kind = F.col("conversation_kind")
    s = sessions(spark, sf)
    return s.groupBy("source").agg(*[F.count_if(catalog.of_kind(kind, k)).alias(f"n_{k}") for k in ("all", "regular", "primary", "subagent")])


SQL["sessions_by_kind"] = f"""{_S} SELECT source, count(*) AS n_all, count_if(conversation_kind IS NULL OR conversation_kind <> 'guardian_review') AS n_regular,
  count_if(conversation_kind IS NULL OR conversation_kind = 'main') AS n_primary, count_if(conversation_kind NOT IN ('main', 'guardian_review')) AS n_subagent FROM s GROUP BY source"""


def session_selection(spark: SparkSession, sf: str) -> DataFrame:
    """The newest primary sessions of a project since a time."""
    s = sessions(spark, sf).where(F.coalesce("repo_project", "project").isin("amber-pier", "gale-ledger", "pine-forge") & (F.col("last_at") >= 1_760_000_000_000) & catalog.of_kind(F.col("conversation_kind"), "primary"))
    return s.select(*SCOPE, "last_at").orderBy(F.desc("last_at"), *SCOPE).limit(30)


SQL["session_selection"] = f"{_S} SELECT source, session_id, source_path, last_at FROM s WHERE coalesce(repo_project, project) IN ('amber-pier', 'gale-ledger', 'pine-forge') AND last_at >= 1760000000000 AND (conversation_kind IS NULL OR conversation_kind = 'main') ORDER BY last_at DESC, source, session_id, source_path LIMIT 30"


def sessions_below(spark: SparkSession, sf: str) -> DataFrame:
    """Sessions in or below a directory or of its repository."""
    return sessions(spark, sf).where(catalog.below(F.col("cwd"), F.col("git_root"), "/work/amber-pier")).select(*SCOPE)


SQL["sessions_below"] = f"{_S} SELECT source, session_id, source_path FROM s WHERE cwd = '/work/amber-pier' OR starts_with(cwd, '/work/amber-pier/') OR git_root = '/work/amber-pier'"


def project_summaries(spark: SparkSession, sf: str) -> DataFrame:
    """Sessions and last activity of each project."""
    return catalog.project_summaries(sessions(spark, sf)).fillna({"last_at": 0, "project": "-"})


SQL["project_summaries"] = f"{_S} SELECT coalesce(repo_project, project, '-') AS project, count(*) AS session_count, coalesce(max(last_at) FILTER (WHERE last_at > 0), 0) AS last_at FROM s WHERE conversation_kind IS NULL OR conversation_kind <> 'guardian_review' GROUP BY 1"


def distinct_projects(spark: SparkSession, sf: str) -> DataFrame:
    """the names of all projects, those without one under Unfiled."""
    name = F.coalesce(F.nullif(F.trim(F.coalesce("repo_project", "project")), F.lit("")), F.lit("Unfiled"))
    return sessions(spark, sf).select(name.alias("project")).distinct()


SQL["distinct_projects"] = f"{_S} SELECT DISTINCT coalesce(nullif(trim(coalesce(repo_project, project)), ''), 'Unfiled') AS project FROM s"


def distinct_sources(spark: SparkSession, sf: str) -> DataFrame:
    """F7, I5."""
    return sessions(spark, sf).select("source").distinct().orderBy("source")


SQL["distinct_sources"] = "SELECT DISTINCT source FROM sessions"


def matching_session_count(spark: SparkSession, sf: str) -> DataFrame:
    """sessions with a matching record by kind; the total is unknown if one of them isn't in the catalog."""
    hits = records(spark, sf).where(F.lower("text").contains("merger")).select(*SCOPE).distinct()
    j = hits.join(sessions(spark, sf).select(*SCOPE, "conversation_kind", F.lit(True).alias("known")), SCOPE, "left")
    return j.groupBy("source").agg(F.count("*").alias("n"), F.count_if(catalog.of_kind(F.col("conversation_kind"), "primary")).alias("n_primary"), F.count_if(F.col("known").isNull()).alias("n_unknown"))


SQL["matching_session_count"] = f"""WITH {RECORDS_SQL}, {SESSIONS_SQL}, h AS (SELECT DISTINCT source, session_id, source_path FROM records WHERE contains(lower(text), 'merger'))
  SELECT h.source, count(*) AS n, count_if(conversation_kind IS NULL OR conversation_kind = 'main') AS n_primary, count_if(s.session_id IS NULL) AS n_unknown
  FROM h LEFT JOIN s ON s.source = h.source AND s.session_id = h.session_id AND s.source_path = h.source_path GROUP BY h.source"""


def canonical_records(spark: SparkSession, sf: str) -> DataFrame:
    """the latest row of each record identity."""
    return catalog.latest_by_identity(records(spark, sf), ["source", "session_id", "event_id", "role"]).select("doc_id")


SQL["canonical_records"] = f"{_R} SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY source, session_id, event_id, role ORDER BY ts DESC, turn_id DESC, doc_id DESC) AS n FROM records) WHERE n = 1"


def session_bounds(spark: SparkSession, sf: str) -> DataFrame:
    """F24."""
    return records(spark, sf).where("ts > 0").groupBy(*SCOPE).agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


SQL["session_bounds"] = f"{_R} SELECT source, session_id, source_path, min(ts) AS first_ts, max(ts) AS last_ts FROM records WHERE ts > 0 GROUP BY source, session_id, source_path"


def stats(spark: SparkSession, sf: str) -> DataFrame:
    """Counts of rows and distinct things."""
    r = records(spark, sf).agg(F.count("*").alias("records"), F.countDistinct(*SCOPE).alias("sessions"), F.countDistinct("project").alias("projects"))
    return r.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("n")) for c in ("records", "sessions", "projects")])).alias("s")).select("s.*")


SQL["stats"] = f"{_R} SELECT 'records' AS name, count(*) AS n FROM records UNION ALL SELECT 'sessions', count(*) FROM (SELECT DISTINCT source, session_id, source_path FROM records) UNION ALL SELECT 'projects', count(DISTINCT project) FROM records"


def project_timeline(spark: SparkSession, sf: str) -> DataFrame:
    """Sessions, last activity and all times of each project."""
    t = catalog.timeline(sessions(spark, sf))
    return t.select("project", "session_count", "last_at", F.array_join(F.transform("stamps", lambda x: x.cast("string")), ",").alias("stamps"))


SQL["project_timeline"] = f"{_S} SELECT project, count(*) AS session_count, max(last_at) AS last_at, array_to_string(list_sort(list(last_at)), ',') AS stamps FROM s WHERE last_at > 0 AND trim(project) <> '' GROUP BY project"


def first_prompts(spark: SparkSession, sf: str) -> DataFrame:
    """the first user text of each session."""
    u = records(spark, sf).where("role = 'user' and trim(text) <> ''")
    return u.groupBy(*SCOPE).agg(F.min_by("text", F.struct("turn_id", "ts", "doc_id")).alias("prompt"))


SQL["first_prompts"] = f"{_R} SELECT source, session_id, source_path, arg_min(text, (turn_id, ts, doc_id)) AS prompt FROM records WHERE role = 'user' AND trim(text) <> '' GROUP BY source, session_id, source_path"


def source_classes(spark: SparkSession, sf: str) -> DataFrame:
    """Files by the provider that their path tells, and the kind it tells."""
    s = sessions(spark, sf).select(catalog.source_of_path(F.col("source_path")).alias("source"), catalog.session_kind(F.col("source_path"), F.col("source"), F.col("parent_session_id")).alias("kind"))
    return s.groupBy("source", "kind").agg(F.count("*").alias("n"))


_CLASS = " ".join(f"WHEN regexp_matches(source_path, '{p}') THEN '{s}'" for s, p in [("codex", r"/\.codex/"), ("opencode", r"/opencode/|/\.opencode/"), ("antigravity", "/antigravity/"), ("grok", r"/\.grok/"), ("cursor", r"/\.cursor/"), ("omp", r"/\.omp/"), ("pi", r"/\.pi/"), ("copilot", r"/\.copilot/")])
SQL["source_classes"] = f"{_S} SELECT CASE {_CLASS} ELSE 'claude' END AS source, CASE WHEN regexp_matches(lower(source_path), '/subagents?/|/agent-[^/]*\\.jsonl$') THEN 'subagent' WHEN source = 'opencode' AND parent_session_id IS NOT NULL THEN 'fork' WHEN contains(lower(source_path), '/guardian') THEN 'guardian_review' ELSE 'main' END AS kind, count(*) AS n FROM s GROUP BY 1, 2"


def excluded_paths(spark: SparkSession, sf: str) -> DataFrame:
    """A3: sessions whose path no glob excludes."""
    return sessions(spark, sf).where(catalog.not_excluded(F.col("source_path"), ["*/.codex/*", "/home/u1?/*"])).select(*SCOPE)


SQL["excluded_paths"] = f"{_S} SELECT source, session_id, source_path FROM s WHERE NOT regexp_matches(source_path, '^.*/\\.codex/.*$') AND NOT regexp_matches(source_path, '^/home/u1./.*$')"


def structure_audit(spark: SparkSession, sf: str) -> DataFrame:
    """Entry types and models of the files, without content."""
    o = table(spark, sf, "omp").select("type", F.coalesce("message.role", F.lit("-")).alias("role"), F.coalesce(F.col("message.model"), F.col("model"), F.lit("-")).alias("model"))
    return o.groupBy("type", "role", "model").agg(F.count("*").alias("n"))


SQL["structure_audit"] = "SELECT type, coalesce(message.role, '-') AS role, coalesce(message.model, model, '-') AS model, count(*) AS n FROM omp GROUP BY 1, 2, 3"


def records_by_repository(spark: SparkSession, sf: str) -> DataFrame:
    """C20, E5: records under the repository project of their session."""
    s = sessions(spark, sf).select(*SCOPE, "repo_project")
    j = records(spark, sf).join(s, SCOPE, "left").withColumn("project", F.coalesce("repo_project", "project"))
    return j.groupBy("project").agg(F.count("*").alias("n"))


SQL["records_by_repository"] = f"WITH {RECORDS_SQL}, {SESSIONS_SQL} SELECT coalesce(s.repo_project, r.project) AS project, count(*) AS n FROM records r LEFT JOIN s ON s.source = r.source AND s.session_id = r.session_id AND s.source_path = r.source_path GROUP BY 1"


def recent_sessions(spark: SparkSession, sf: str) -> DataFrame:
    """The sessions with the newest records."""
    return records(spark, sf).groupBy(*SCOPE).agg(F.max("ts").alias("last_ts")).orderBy(F.desc("last_ts"), *SCOPE).limit(25)


SQL["recent_sessions"] = f"{_R} SELECT source, session_id, source_path, max(ts) AS last_ts FROM records GROUP BY source, session_id, source_path ORDER BY last_ts DESC, source, session_id, source_path LIMIT 25"


def project_sessions(spark: SparkSession, sf: str) -> DataFrame:
    """Sessions matched to projects by the last part of the work tree, in the project's directory."""
    p = table(spark, sf, "projects").where("worktree is not null").select("project_id", F.element_at(F.split("worktree", "/"), -1).alias("project"))
    s = sessions(spark, sf).join(p, "project")
    return s.groupBy("project_id").agg(F.count("*").alias("n"), F.sum("message_count").alias("messages"))


SQL["project_sessions"] = f"{_S}, p AS (SELECT project_id, split_part(worktree, '/', -1) AS project FROM projects WHERE worktree IS NOT NULL) SELECT project_id, count(*) AS n, CAST(sum(message_count) AS BIGINT) AS messages FROM s JOIN p USING (project) GROUP BY project_id"

QUERIES = {
    f.__name__: f
    for f in (
        session_roll_up, session_upsert, session_delete, sessions_by_kind, session_selection, sessions_below, project_summaries, distinct_projects, distinct_sources, matching_session_count, canonical_records,
        session_bounds, stats, project_timeline, first_prompts, source_classes, excluded_paths, structure_audit, records_by_repository, recent_sessions, project_sessions,
    )
}
