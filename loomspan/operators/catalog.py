"""Session roll-ups, kinds, projects and the upsert of roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SCOPE = ["source", "session_id", "source_path"]


def roll_up(records: DataFrame, label: Column | None = None, arrival: str = "doc_id") -> DataFrame:
    """One row for each session identity of records.

    project is that of the last row, in order of arrival, whose time is at least
    all times before it and whose project isn't empty, else of the first row.
    label_text is the first user text by (turn, time, id) that isn't blank. kind is
    main if any row says so, else the first that arrived. All of it is one
    aggregation but for the running maximum of project.
    """
    label = F.col("text") if label is None else label
    before = Window.partitionBy(*SCOPE).orderBy(arrival).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = records.withColumn("_sets", (F.col("ts") >= F.max("ts").over(before)) & (F.col("project") != ""))
    kind = F.nullif(F.col("conversation_kind"), F.lit(""))
    user = (F.col("role") == "user") & (F.trim(label) != "")
    return rows.groupBy(*SCOPE).agg(
        F.min("ts").alias("started_at"), F.max("ts").alias("last_at"), F.count("*").alias("message_count"),
        F.coalesce(F.max_by("project", F.when(F.col("_sets"), F.col(arrival))), F.min_by("project", arrival)).alias("project"),
        F.min_by(F.when(user, label), F.when(user, F.struct("turn_id", "ts", "doc_id"))).alias("label_text"),
        F.when(F.bool_or(F.coalesce(kind == "main", F.lit(False))), "main").otherwise(F.min_by(kind, F.when(kind.isNotNull(), F.col(arrival)))).alias("conversation_kind"),
    )


def upsert(stored: DataFrame, delta: DataFrame) -> DataFrame:
    """stored sessions with a batch of roll-ups: earliest start, latest end, summed counts, the stored label and kind before the new, the new project."""
    both = stored.withColumn("_new", F.lit(0)).unionByName(delta.withColumn("_new", F.lit(1)))
    keep = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("_new"))).alias(c)
    return both.groupBy(*SCOPE).agg(F.min("started_at").alias("started_at"), F.max("last_at").alias("last_at"), F.sum("message_count").alias("message_count"), F.max_by("project", "_new").alias("project"), keep("label_text"), keep("conversation_kind"))


def delete(stored: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """stored without the rows of the given paths or scopes."""
    return stored.join(gone.select(*keys).distinct(), keys, "left_anti")


def of_kind(kind: Column, wanted: str) -> Column:
    """all; regular: no guardian review; primary: main or unknown; subagent: any other but guardian reviews."""
    return {
        "all": F.lit(True),
        "regular": kind.isNull() | (kind != "guardian_review"),
        "primary": kind.isNull() | (kind == "main"),
        "subagent": F.coalesce(~kind.isin("main", "guardian_review"), F.lit(False)),
    }[wanted]


def below(cwd: Column, git_root: Column, root: str) -> Column:
    """Whether a session ran in a directory, below it, or in its repository."""
    return F.coalesce((cwd == root) | cwd.startswith(root.rstrip("/") + "/"), F.lit(False)) | F.coalesce(git_root == root, F.lit(False))


def project_summaries(sessions: DataFrame) -> DataFrame:
    """(project, session_count, last_at) by repository project, else project; guardian reviews don't count, and a last_at of 0 is unknown."""
    s = sessions.where(of_kind(F.col("conversation_kind"), "regular")).withColumn("project", F.coalesce("repo_project", "project"))
    return s.groupBy("project").agg(F.count("*").alias("session_count"), F.max(F.when(F.col("last_at") > 0, F.col("last_at"))).alias("last_at"))


def latest_by_identity(records: DataFrame, identity: list[str]) -> DataFrame:
    """The latest row of each identity by (ts, turn_id, doc_id)."""
    w = Window.partitionBy(*identity).orderBy(F.desc("ts"), F.desc("turn_id"), F.desc("doc_id"))
    return records.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def timeline(sessions: DataFrame) -> DataFrame:
    """(project, session_count, last_at, stamps) of sessions with a known time and a project; stamps in order."""
    s = sessions.where("last_at > 0 and trim(project) <> ''")
    return s.groupBy("project").agg(F.count("*").alias("session_count"), F.max("last_at").alias("last_at"), F.sort_array(F.collect_list("last_at")).alias("stamps"))


def source_of_path(path: Column) -> Column:
    """The provider of a file by its path; the first rule that fits counts, and claude is the default."""
    rules = [
        ("bob", r"/\.bob/|/bob-shell/|/bob\.db"), ("codex", r"/\.codex/"), ("opencode", r"/opencode/|/\.opencode/"), ("jcode", r"/\.jcode/"), ("muse", r"/\.muse/|/muse/"),
        ("antigravity", r"/antigravity/|/antigravity-cli/"), ("grok", r"/\.grok/"), ("cursor", r"/\.cursor/"), ("omp", r"/\.omp/"), ("pi", r"/\.pi/"), ("openclaw", r"/\.openclaw/|/\.clawdbot/"),
        ("copilot", r"/\.copilot/"), ("hermes", r"/\.hermes/"),
    ]
    p = F.regexp_replace(path, r"\\", "/")
    out = F.lit("claude")
    for source, rule in reversed(rules):
        out = F.when(p.rlike(rule), source).otherwise(out)
    return out


def glob_regex(pattern: str) -> str:
    """A path glob as an anchored expression; * crosses slashes, ? is one character."""
    import re

    return "^" + "".join(".*" if part and set(part) == {"*"} else "." if part == "?" else re.escape(part) for part in re.split(r"(\*+|\?)", pattern)) + "$"


def not_excluded(path: Column, globs: list[str]) -> Column:
    keep = F.lit(True)
    for g in globs:
        keep = keep & ~path.rlike(glob_regex(g))
    return keep


def session_kind(path: Column, source: Column, parent: Column) -> Column:
    """The kind of a session by its path and parent."""
    p = F.lower(path)
    return F.when(p.rlike(r"/subagents?/"), "subagent").when(p.rlike(r"/agent-[^/]*\.jsonl$"), "subagent").when((source == "opencode") & parent.isNotNull(), "fork").when(p.contains("/guardian"), "guardian_review").otherwise("main")
