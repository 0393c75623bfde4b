"""Memories, and the scalar text functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.functions import text as T
from loomspan.operators import lexical, memory, ranking
from loomspan.operators.index import Index, resident
from loomspan.plans.adapters import RECORDS_SQL, records
from loomspan.plans.retrieval import record_index
from loomspan.session import table

SQL: dict[str, str] = {}
_R = f"WITH {RECORDS_SQL}"


def _parts(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").where("kind = 'memory' and text is not null")
    return memory.split_sections(docs).join(docs.select("doc_id", F.coalesce(memory.title(F.col("text")), F.lit("")).alias("title")), "doc_id").withColumn("heading", F.coalesce("heading", F.lit("")))


def section_indexes(spark: SparkSession, sf: str) -> dict[str, Index]:
    """One written index for each field that a memory search weighs."""
    keyed = _parts(spark, sf).withColumn("section_key", F.concat_ws(":", "doc_id", "section"))
    return {f: resident(spark, f"sections-{f}", f"{sf}/documents.parquet", keyed, "section_key", f, ("doc_id", "section")) for f, _ in memory.FIELDS}


def memory_sections(spark: SparkSession, sf: str) -> DataFrame:
    """Sections with headings, lines, references and dates."""
    return memory.split_sections(table(spark, sf, "documents").where("kind = 'memory'"))


def memory_search(spark: SparkSession, sf: str) -> DataFrame:
    """The best sections for three views of a question."""
    return memory.search(_parts(spark, sf), ["refresh task", "segment merger", "refresh task", " "], 30, indexes=section_indexes(spark, sf))


def memory_search_filtered(spark: SparkSession, sf: str) -> DataFrame:
    """The same among the memories of one source within bounds of time, newest first."""
    docs = table(spark, sf, "documents").where("kind = 'memory' and text is not null").select("doc_id", F.col("source").alias("m_source"), F.unix_millis(F.col("updated_at").cast("timestamp")).alias("mtime"))
    parts = _parts(spark, sf)
    allowed = memory.eligible(parts.select("doc_id", "section").join(docs, "doc_id").withColumnRenamed("m_source", "source"), since=1, until=4_102_444_800_000)
    return memory.search(parts, ["refresh task", "segment merger"], 30, indexes=section_indexes(spark, sf), allowed=allowed, newest_first=True).select("doc_id", "section", "mtime", F.round("score", 9).alias("score"))


def unified_search(spark: SparkSession, sf: str) -> DataFrame:
    """Records and memories in one list, each by its own ranks."""
    r = ranking.ranked(lexical.top(record_index(spark, sf).search("refresh segment").withColumn("score", F.round("score", 6)), 40, "doc_id"), F.desc("score"), "doc_id")
    docs = table(spark, sf, "documents").where("kind = 'memory' and text is not null")
    memories = resident(spark, "memories", f"{sf}/documents.parquet", docs, "doc_id", "text")
    m = ranking.ranked(lexical.top(memories.search("refresh segment").withColumn("score", F.round("score", 6)), 40, "doc_id"), F.desc("score"), "doc_id")
    both = r.select(F.lit("record").alias("corpus"), "doc_id", "rank").unionByName(m.select(F.lit("memory").alias("corpus"), "doc_id", "rank"))
    return both.select("corpus", "doc_id", F.round(1 / (60 + F.col("rank")), 9).alias("score")).orderBy(F.desc("score"), "corpus", "doc_id").limit(50)


def _ranked_sql(source: str, where: str) -> str:
    from loomspan.plans.retrieval import _bm25_sql

    return f"(WITH src AS (SELECT doc_id, text FROM {source} WHERE {where}), {_bm25_sql(['refresh', 'segment'], source='src')} SELECT doc_id, row_number() OVER (ORDER BY round(score, 6) DESC, doc_id) AS rank FROM hits ORDER BY rank LIMIT 40)"


SQL["unified_search"] = (
    f"{_R} SELECT corpus, doc_id, round(1.0 / (60 + rank), 9) AS score FROM (SELECT 'record' AS corpus, * FROM {_ranked_sql('records', 'true')} UNION ALL "
    f"SELECT 'memory', * FROM {_ranked_sql('documents', "kind = 'memory' AND text IS NOT NULL")}) ORDER BY score DESC, corpus, doc_id LIMIT 50"
)


def labels(spark: SparkSession, sf: str) -> DataFrame:
    """Prompts as labels; none of the tables' prompts is a preview of another conversation, so the SQL doesn't know these."""
    return records(spark, sf).where("role = 'user'").where(~F.col("text").rlike("(?i)## referenced ")).select("doc_id", T.label(F.col("text")).alias("label"))


_TAGS = "|".join(T.DROPPED)
SQL["labels"] = rf"""{_R}, a AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '(?is)<({_TAGS})[^>]*>.*?</({_TAGS})>', ' ', 'g'), '(?is)<({_TAGS}).*', '', 'g'), '<[A-Za-z/!][^>]*>', ' ', 'g') AS t FROM records WHERE role = 'user' AND NOT regexp_matches(text, '(?i)## referenced ')),
  b AS (SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(t, '\x1b\[[0-9;]*[A-Za-z]', '', 'g'), '\s+', ' ', 'g'), '\p{{Cc}}', '', 'g')) AS t FROM a),
  c AS (SELECT doc_id, CASE WHEN starts_with(lower(t), '# agents.md') OR contains(lower(t), 'global agent preferences') OR starts_with(lower(t), 'you are a reminder observer') THEN '' ELSE t END AS t FROM b),
  d AS (SELECT doc_id, t, left(t, 109) AS h, right(t, 40) AS e FROM c), f AS (SELECT *, length(h) - strpos(reverse(h), ' ') AS p FROM d)
  SELECT doc_id, CASE WHEN length(t) <= 150 THEN t ELSE CASE WHEN contains(h, ' ') AND p > 80 THEN left(h, p) ELSE h END || '…' || trim(CASE WHEN contains(e, ' ') THEN substring(e, strpos(e, ' ') + 1) ELSE e END) END AS label FROM f"""


def snippets(spark: SparkSession, sf: str) -> DataFrame:
    """The text around the first hit."""
    r = records(spark, sf).where(F.col("text").rlike(T.literal_pattern(["merger", "planner"])))
    t = F.col("text")
    return r.select("doc_id", T.snippet(t, ["merger", "planner"]).alias("snippet"), T.abbreviated(t, ["merger", "planner"], 100).alias("short"))


_AT = "coalesce(least(nullif(instr(lower(text), 'merger'), 0), nullif(instr(lower(text), 'planner'), 0)), 1)"
SQL["snippets"] = f"""{_R}, h AS (SELECT doc_id, text, {_AT} AS p FROM records WHERE contains(lower(text), 'merger') OR contains(lower(text), 'planner'))
  SELECT doc_id, substring(text, greatest(1, p - 80), 240) AS snippet, CASE WHEN length(text) <= 100 THEN text ELSE CASE WHEN p - 25 > 1 THEN '…' ELSE '' END || substring(text, greatest(1, p - 25), 100) || CASE WHEN greatest(1, p - 25) + 100 <= length(text) THEN '…' ELSE '' END END AS short FROM h"""


def match_spans(spark: SparkSession, sf: str) -> DataFrame:
    """Where the hits are."""
    r = records(spark, sf).select("doc_id", F.explode(T.match_spans(F.col("text"), ["segment"])).alias("s"))
    return r.select("doc_id", F.col("s.start").alias("start"), F.col("s.end").alias("end"), F.col("s.context").alias("context"))


SQL["match_spans"] = f"""{_R}, p AS (SELECT doc_id, text, string_split(lower(text), 'segment') AS parts FROM records WHERE contains(lower(text), 'segment')), e AS (SELECT doc_id, text, parts, unnest(range(1, least(len(parts) - 1, 5) + 1)) AS k FROM p),
  s AS (SELECT doc_id, text, CAST(list_sum(list_transform(parts[1:k], lambda x: length(x))) + 7 * (k - 1) AS INT) AS start FROM e)
  SELECT doc_id, start, start + 7 AS "end", substring(text, greatest(1, start + 1 - 40), 87) AS context FROM s"""


def path_names(spark: SparkSession, sf: str) -> DataFrame:
    """Projects by the last part of their paths, and slugs."""
    p = table(spark, sf, "projects").where("worktree is not null")
    return p.select("project_id", T.base_name(F.col("worktree")).alias("name"), T.slug(F.coalesce("project_name", F.lit(""))).alias("slug"))


SQL["path_names"] = r"SELECT project_id, regexp_replace(split_part(regexp_replace(worktree, '/+$', ''), '/', -1), '\.git$', '') AS name, regexp_replace(regexp_replace(lower(trim(coalesce(project_name, ''))), '[^\p{L}\p{N}]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM projects WHERE worktree IS NOT NULL"


def stamp_functions(spark: SparkSession, sf: str) -> DataFrame:
    """Stamps read and written."""
    s = table(spark, sf, "sessions").select("row_id", T.instant_ms(F.col("started_at")).alias("ms")).where("ms between 0 and 253402300799999")
    return s.select("row_id", "ms", T.stamp_text(F.col("ms")).alias("written"))


SQL["stamp_functions"] = r"""WITH m AS (SELECT row_id, CASE WHEN regexp_matches(started_at, '^\d{1,18}$') THEN CASE WHEN CAST(started_at AS BIGINT) > 10000000000 THEN CAST(started_at AS BIGINT) ELSE CAST(started_at AS BIGINT) * 1000 END
    WHEN regexp_matches(started_at, '^\d{4}-\d\d-\d\d$') THEN epoch_ms(CAST(started_at AS TIMESTAMP))
    WHEN regexp_matches(started_at, '^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d{1,6})?(Z|[+-]\d\d:\d\d)$') THEN epoch_us(TRY_CAST(started_at AS TIMESTAMPTZ)) // 1000 END AS ms FROM sessions)
  SELECT row_id, ms, CASE WHEN ms = 0 THEN '-' ELSE strftime(make_timestamp(ms // 1000 * 1000000), '%Y-%m-%dT%H:%M:%SZ') END AS written FROM m WHERE ms BETWEEN 0 AND 253402300799999"""


def payload_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Contents given as JSON blocks, as the text they say; contents without any text aside."""
    m = table(spark, sf, "omp").select("rec_id", "message.content").where(F.exists("content", lambda x: F.coalesce(x["text"] != "", F.lit(False))))
    return m.select("rec_id", T.payload_text(F.to_json("content")).alias("payload"))


SQL["payload_texts"] = "SELECT rec_id, array_to_string(list_transform(list_filter(message.content, lambda x: x.text IS NOT NULL), lambda x: x.text), chr(10)) AS payload FROM omp WHERE len(list_filter(message.content, lambda x: x.text <> '')) > 0"

QUERIES = {f.__name__: f for f in (memory_sections, memory_search, memory_search_filtered, unified_search, labels, snippets, match_spans, path_names, stamp_functions, payload_texts)}
