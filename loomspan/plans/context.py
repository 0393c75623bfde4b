"""Context, paging, reading budgets and evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.operators import context, evaluate, ranking
from loomspan.plans.adapters import RECORDS_SQL, records
from loomspan.plans.retrieval import _bm25_sql, document_index
from loomspan.session import table

SQL: dict[str, str] = {}
_O = f"WITH {RECORDS_SQL}, o AS (SELECT *, row_number() OVER (PARTITION BY source, session_id, source_path ORDER BY turn_id, ts, doc_id) - 1 AS pos, count(*) OVER (PARTITION BY source, session_id, source_path) AS total FROM records)"
_SAME = "o.source = a.source AND o.session_id = a.session_id AND o.source_path = a.source_path"


def _anchors(spark: SparkSession, sf: str) -> DataFrame:
    """The stated query set: every record whose id is divisible by 50."""
    return records(spark, sf).where("doc_id % 50 = 0").select("doc_id")


def context_window(spark: SparkSession, sf: str) -> DataFrame:
    """The records around anchors with their signed distance."""
    return context.neighbourhood(records(spark, sf), _anchors(spark, sf), 3, 4).select("anchor", "doc_id", "distance")


SQL["context_window"] = f"{_O} SELECT a.doc_id AS anchor, o.doc_id, o.pos - a.pos AS distance FROM o JOIN o a ON {_SAME} WHERE a.doc_id % 50 = 0 AND o.pos - a.pos BETWEEN -3 AND 4"


def context_interactions(spark: SparkSession, sf: str) -> DataFrame:
    """The window and the records that share a tool with it."""
    r = records(spark, sf)
    return context.with_interactions(context.neighbourhood(r, _anchors(spark, sf), 1, 1), r, "tool_name")


SQL["context_interactions"] = f"""{_O}, w AS (SELECT a.doc_id AS anchor, o.* FROM o JOIN o a ON {_SAME} WHERE a.doc_id % 50 = 0 AND o.pos - a.pos BETWEEN -1 AND 1)
  SELECT anchor, doc_id FROM w UNION SELECT a.anchor, o.doc_id FROM o JOIN w a ON {_SAME} AND o.tool_name = a.tool_name"""


def context_page(spark: SparkSession, sf: str) -> DataFrame:
    """Pages of ten with an anchor in the middle."""
    return context.pages_around(records(spark, sf), _anchors(spark, sf), 10)


SQL["context_page"] = f"""{_O}, b AS (SELECT *, least(pos, 5) AS f FROM o WHERE doc_id % 50 = 0), c AS (SELECT *, least(total - pos, 10 - f) AS behind FROM b), a AS (SELECT *, least(pos, 10 - behind) AS ahead FROM c)
  SELECT a.doc_id AS anchor, o.doc_id, o.pos, a.pos - ahead AS "offset", o.total FROM o JOIN a ON {_SAME} WHERE o.pos >= a.pos - ahead AND o.pos < a.pos + behind"""


def session_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Several pages of sessions at once."""
    r = records(spark, sf)
    wanted = r.where("doc_id % 50 = 0").select(F.col("doc_id").alias("request_id"), *context.SCOPE, (F.col("doc_id") % 4).alias("offset"), F.lit(3).alias("limit"))
    return context.pages(r, wanted)


SQL["session_pages"] = f"{_O} SELECT a.doc_id AS request_id, o.doc_id, o.pos, o.total FROM o JOIN o a ON {_SAME} WHERE a.doc_id % 50 = 0 AND o.pos >= a.doc_id % 4 AND o.pos < a.doc_id % 4 + 3"


def without_repeats(spark: SparkSession, sf: str) -> DataFrame:
    """Records that don't say what the one before said."""
    return context.without_repeats(records(spark, sf), F.col("text")).select("doc_id")


_W = "OVER (PARTITION BY source, session_id, source_path ORDER BY turn_id, ts, doc_id)"
SQL["without_repeats"] = f"WITH {RECORDS_SQL}, q AS (SELECT *, role || chr(31) || trim(regexp_replace(text, '\\s+', ' ', 'g')) AS said FROM records) SELECT doc_id FROM (SELECT doc_id, said, lag(said) {_W} AS before FROM q) WHERE said IS DISTINCT FROM before"


def last_user_turns(spark: SparkSession, sf: str) -> DataFrame:
    """Each session from its second last user record on."""
    return context.last_user_turns(records(spark, sf), 2).select("doc_id")


SQL["last_user_turns"] = f"WITH {RECORDS_SQL} SELECT doc_id FROM (SELECT doc_id, role, sum(CAST(role = 'user' AS INT)) OVER (PARTITION BY source, session_id, source_path ORDER BY turn_id DESC, ts DESC, doc_id DESC ROWS UNBOUNDED PRECEDING) AS k FROM records) WHERE k < 2 OR (k = 2 AND role = 'user')"


def read_budget(spark: SparkSession, sf: str) -> DataFrame:
    """Texts of a session until 600 characters are used."""
    b = context.budgeted(records(spark, sf), 600)
    return b.select("doc_id", F.length("shown").alias("n_shown"), F.md5(F.col("shown")).alias("shown_md5"), F.coalesce("next_offset", F.lit(-1)).cast("bigint").alias("next_offset"))


SQL["read_budget"] = f"""WITH {RECORDS_SQL}, b AS (SELECT doc_id, text, length(text) AS n, CAST(greatest(0, 600 - coalesce(sum(length(text)) OVER (PARTITION BY source, session_id, source_path ORDER BY turn_id, ts, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS BIGINT) AS room FROM records)
  SELECT doc_id, CAST(least(n, room) AS INT) AS n_shown, md5(substring(text, 1, room)) AS shown_md5, CASE WHEN n > room THEN room ELSE -1 END AS next_offset FROM b"""


def collapsed_exchanges(spark: SparkSession, sf: str) -> DataFrame:
    """What is left when repeated exchanges are folded, and how often each came again."""
    return context.collapse_exchanges(records(spark, sf))


SQL["collapsed_exchanges"] = f"""WITH {RECORDS_SQL}, q AS (SELECT *, role || chr(31) || text AS said, row_number() {_W} AS n FROM records), a AS (SELECT *, coalesce(lag(said, 2) {_W} = said, false) AS again FROM q),
  b AS (SELECT *, sum(CAST(NOT again AS INT)) {_W} AS run FROM a), r AS (SELECT source, session_id, source_path, run, min(n) AS first, count(*) - count(*) % 2 AS gone FROM b WHERE again GROUP BY ALL HAVING count(*) >= 4)
  SELECT doc_id, CAST(CASE WHEN n = first - 1 THEN gone // 2 ELSE 0 END AS BIGINT) AS repeats FROM b LEFT JOIN r USING (source, session_id, source_path, run) WHERE first IS NULL OR n < first OR n >= first + gone"""


_CASES = [(1, "refresh task"), (2, "segment merger"), (3, "query planner"), (4, "path resolver"), (5, "vector store")]


def evaluation(spark: SparkSession, sf: str) -> DataFrame:
    """Five questions, each relevant where a document says both words in a row."""
    docs = table(spark, sf, "documents").where("text is not null").select("doc_id", "text", "source")
    hits = document_index(spark, sf).search_each(dict(_CASES)).withColumn("score", F.round("score", 6))
    top = ranking.capped(hits, ["case"], 50, F.desc("score"), "doc_id")
    results = ranking.ranked(top, F.desc("score"), "doc_id", by=["case"]).select(F.col("case").alias("case_id"), "rank", F.col("doc_id").alias("key"), F.col("source").alias("session"))
    said = F.array(*[F.when(F.lower("text").contains(words), F.lit(case)) for case, words in _CASES])
    qrels = docs.select(F.explode(F.filter(said, lambda c: c.isNotNull())).alias("case_id"), F.col("doc_id").alias("key"), (1 + F.col("doc_id") % 3).alias("relevance"))
    e = evaluate.evaluate(results, qrels, 20)
    return e.select("case_id", *[F.round(c, 6).alias(c) for c in ("recall", "mrr", "ndcg")], "unique_sessions")


_RES = " UNION ALL ".join(f"(WITH {_bm25_sql(w.split(), source='documents', cols='source')} SELECT {c} AS case_id, row_number() OVER (ORDER BY round(score, 6) DESC, doc_id) AS rank, doc_id AS key, source AS session FROM hits ORDER BY rank LIMIT 50)" for c, w in _CASES)
_REL = " UNION ALL ".join(f"SELECT {c} AS case_id, doc_id AS key, 1 + doc_id % 3 AS relevance FROM documents WHERE contains(lower(text), '{w}')" for c, w in _CASES)
SQL["evaluation"] = f"""WITH res AS ({_RES}), rel AS ({_REL}), t AS (SELECT * FROM res WHERE rank <= 20),
  h AS (SELECT case_id, count(*) AS found, min(rank) AS best, sum((pow(2.0, relevance) - 1) / log2(rank + 1)) AS dcg FROM t JOIN rel USING (case_id, key) GROUP BY case_id),
  i AS (SELECT case_id, count(*) AS relevant, sum((pow(2.0, relevance) - 1) / log2(rank + 1)) FILTER (WHERE rank <= 20) AS idcg FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY relevance DESC, key) AS rank FROM rel) GROUP BY case_id),
  s AS (SELECT case_id, count(DISTINCT session) AS n FROM t GROUP BY case_id)
  SELECT i.case_id, round(coalesce(found / relevant, 0), 6) AS recall, round(coalesce(1 / best, 0), 6) AS mrr, round(coalesce(dcg / idcg, 0), 6) AS ndcg, coalesce(s.n, 0) AS unique_sessions FROM i LEFT JOIN h USING (case_id) LEFT JOIN s USING (case_id)"""

QUERIES = {
    f.__name__: f for f in (context_window, context_interactions, context_page, session_pages, without_repeats, last_user_turns, read_budget, collapsed_exchanges, evaluation)
}
