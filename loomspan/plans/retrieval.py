"""Ranked retrieval over records, documents and vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomspan.operators import lexical, ranking
from loomspan.operators.index import FORMAT, Index, fingerprint, resident
from loomspan.operators.vectors import VectorIndex
from loomspan.plans.adapters import RECORDS_SQL, records, vectors
from loomspan.session import Scratch, shared_dir, table

NOW = 1_793_000_000_000
WORDS = ["refresh", "segment", "query"]
SCOPE = ["source", "session_id", "source_path"]


KEPT = ("source", "session_id", "source_path", "project", "ts", "role", "conversation_kind")


def record_index(spark: SparkSession, sf: str, stemmed: bool = False) -> Index:
    """The written index of the records, made at the first search of a state of the table."""
    return resident(spark, "records", f"{sf}/session_message.parquet", records(spark, sf), "doc_id", "text", KEPT, stemmed)


def document_index(spark: SparkSession, sf: str) -> Index:
    docs = table(spark, sf, "documents").where("text is not null").select("doc_id", "text", "source", "kind")
    return resident(spark, "documents", f"{sf}/documents.parquet", docs, "doc_id", "text", ("source", "kind"))


def _hits(spark: SparkSession, sf: str, query: lexical.Query | str = "refresh segment query") -> DataFrame:
    return record_index(spark, sf).search(query)


def search_bm25(spark: SparkSession, sf: str) -> DataFrame:
    """The best 50 records for some words."""
    return lexical.top(_hits(spark, sf).select("doc_id", F.round("score", 6).alias("score")), 50, "doc_id")


def _bm25_sql(words: list[str], source: str = "records", key: str = "doc_id", text: str = "text", where: str = "", cols: str = "") -> str:
    """CTEs up to ``hits``: key, cols and score of the rows that have a word."""
    tf = ", ".join(f"len(list_filter(t, lambda x: x = '{w}')) AS tf{i}" for i, w in enumerate(words))
    df = ", ".join(f"ln(1 + (count(*) - count_if(tf{i} > 0) + 0.5) / (count_if(tf{i} > 0) + 0.5)) AS idf{i}" for i in range(len(words)))
    score = " + ".join(f"idf{i} * tf{i} * 2.2 / (tf{i} + 1.2 * (0.25 + 0.75 * n / avgn))" for i in range(len(words)))
    some = " OR ".join(f"tf{i} > 0" for i in range(len(words)))
    more = "".join(f", {c}" for c in cols.split(", ") if c)
    return (
        f"tk AS (SELECT {key}{more}, list_filter(regexp_split_to_array(lower({text}), '[^\\p{{L}}\\p{{M}}\\p{{N}}]+'), lambda x: x <> '') AS t FROM {source} WHERE {text} IS NOT NULL), "
        f"tf AS (SELECT {key}{more}, t, len(t) AS n, {tf} FROM tk), st AS (SELECT avg(n) AS avgn, {df} FROM tf), "
        f"hits AS (SELECT {key}{more}, {score} AS score FROM tf, st WHERE ({where or some}))"
    )


_BASE = f"WITH {RECORDS_SQL}, {_bm25_sql(WORDS, cols='source, session_id, source_path, project, ts, role, conversation_kind')}"
SQL: dict[str, str] = {"search_bm25": f"{_BASE} SELECT doc_id, round(score, 6) AS score FROM hits ORDER BY round(score, 6) DESC, doc_id LIMIT 50"}


def search_grammar(spark: SparkSession, sf: str) -> DataFrame:
    """Required and excluded words, a phrase and a boost."""
    hits = _hits(spark, sf, '+segment -vector "last segment" query^2')
    return hits.select("doc_id", F.round("score", 6).alias("score"))


SQL["search_grammar"] = (
    f"WITH {RECORDS_SQL}, "
    + _bm25_sql(["query", "segment", "last"], where="list_contains(t, 'segment') AND NOT list_contains(t, 'vector') AND contains(' ' || array_to_string(t, ' ') || ' ', ' last segment ')").replace("idf0 * tf0", "2 * idf0 * tf0")
    + " SELECT doc_id, round(score, 6) AS score FROM hits"
)


def search_scripts(spark: SparkSession, sf: str) -> DataFrame:
    """Words of other scripts and with accents, over the documents."""
    return document_index(spark, sf).search("versión für année").select("doc_id", F.round("score", 6).alias("score"))


SQL["search_scripts"] = "WITH " + _bm25_sql(["versión", "für", "année"], source="documents") + " SELECT doc_id, round(score, 6) AS score FROM hits"


def search_scan(spark: SparkSession, sf: str) -> DataFrame:
    """The same search without an index, over the texts."""
    hits = lexical.bm25(records(spark, sf), "text", "refresh segment query")
    return lexical.top(hits.select("doc_id", F.round("score", 6).alias("score")), 50, "doc_id")


SQL["search_scan"] = SQL["search_bm25"]


def index_append(spark: SparkSession, sf: str) -> DataFrame:
    """B1, B2: an index to which documents are added, of which some are replaced and some removed, and merged; searched in the end."""
    docs = table(spark, sf, "documents").where("text is not null").select("doc_id", "text", "source")
    path = Scratch(spark, "index").path
    late = docs.where("doc_id % 50 = 0")
    index = Index(spark, path).create(docs.where("doc_id % 50 <> 0").unionByName(late.withColumn("text", F.lit("refresh task"))), "doc_id", "text", ("source",))
    index.append(late)
    index.remove(docs.where("doc_id % 50 = 1").select("doc_id"))
    index.merge(whole=True)
    return index.search("refresh task").select("doc_id", "source", F.round("score", 6).alias("score"))


SQL["index_append"] = "WITH d AS (SELECT * FROM documents WHERE text IS NOT NULL AND doc_id % 50 <> 1), " + _bm25_sql(["refresh", "task"], source="d", cols="source") + " SELECT doc_id, source, round(score, 6) AS score FROM hits"


def search_match_all(spark: SparkSession, sf: str) -> DataFrame:
    """A blank query matches everything."""
    return lexical.bm25(records(spark, sf), "text", "  ").groupBy("source").agg(F.count("*").alias("n"), F.sum("score").alias("score"))


SQL["search_match_all"] = f"WITH {RECORDS_SQL} SELECT source, count(*) AS n, CAST(count(*) AS DOUBLE) AS score FROM records GROUP BY source"


def search_by_time(spark: SparkSession, sf: str) -> DataFrame:
    """The matches in time order, newest first."""
    return _hits(spark, sf).select("doc_id", "ts").orderBy(F.desc("ts"), F.desc("doc_id")).limit(40)


SQL["search_by_time"] = f"{_BASE} SELECT doc_id, ts FROM hits ORDER BY ts DESC, doc_id DESC LIMIT 40"


def recent_records(spark: SparkSession, sf: str) -> DataFrame:
    """Newest records of some sources within inclusive bounds of time."""
    r = records(spark, sf).where(F.col("source").isin("claude", "codex") & (F.col("role") == "assistant") & F.col("ts").between(1_760_000_000_000, NOW))
    return r.select("doc_id", "source", "ts").orderBy(F.desc("ts"), "doc_id").limit(60)


SQL["recent_records"] = f"WITH {RECORDS_SQL} SELECT doc_id, source, ts FROM records WHERE source IN ('claude', 'codex') AND role = 'assistant' AND ts BETWEEN 1760000000000 AND {NOW} ORDER BY ts DESC, doc_id LIMIT 60"


def search_recency(spark: SparkSession, sf: str) -> DataFrame:
    """The best 50 by words, then boosted by age and put in order again."""
    best = lexical.top(_hits(spark, sf).select("doc_id", "ts", F.round("score", 9).alias("score")), 50, "doc_id")
    return ranking.with_recency(best, NOW).select("doc_id", F.round("score", 6).alias("score"))


SQL["search_recency"] = (
    f"{_BASE}, b AS (SELECT doc_id, ts, round(score, 9) AS score FROM hits ORDER BY round(score, 9) DESC, doc_id LIMIT 50) "
    f"SELECT doc_id, round(CASE WHEN ts > 0 THEN score * (1 + exp(-ln(2.0) * greatest(0, {NOW} - ts) / 86400000.0 / 30)) ELSE score END, 6) AS score FROM b"
)


def search_min_score(spark: SparkSession, sf: str) -> DataFrame:
    """Hits from a score on."""
    return _hits(spark, sf).withColumn("score", F.round("score", 6)).where("score >= 3").select("doc_id", "score")


SQL["search_min_score"] = f"{_BASE} SELECT doc_id, round(score, 6) AS score FROM hits WHERE round(score, 6) >= 3"


def search_top_per_session(spark: SparkSession, sf: str) -> DataFrame:
    """At most two hits of each session."""
    hits = _hits(spark, sf).withColumn("score", F.round("score", 6))
    return ranking.capped(hits, ["source", "session_id"], 2, F.desc("score"), "doc_id").select("doc_id", "session_id", "score")


SQL["search_top_per_session"] = f"{_BASE} SELECT doc_id, session_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY source, session_id ORDER BY round(score, 6) DESC, doc_id) AS n FROM hits) WHERE n <= 2"


def search_session_groups(spark: SparkSession, sf: str) -> DataFrame:
    """The hits rolled up by session, with main as the kind if any hit says so."""
    hits = _hits(spark, sf).withColumn("score", F.round("score", 6))
    return ranking.session_groups(hits, SCOPE).fillna({"kind": "-"})


SQL["search_session_groups"] = f"""{_BASE}, h AS (SELECT *, round(score, 6) AS r FROM hits)
  SELECT source, session_id, source_path, count(*) AS hit_count, max(ts) AS last_ts, max(r) AS score, arg_max(doc_id, (r, ts, doc_id)) AS doc_id,
    coalesce(CASE WHEN bool_or(coalesce(conversation_kind = 'main', false)) THEN 'main' ELSE arg_min(conversation_kind, doc_id) FILTER (WHERE conversation_kind IS NOT NULL) END, '-') AS kind
  FROM h GROUP BY source, session_id, source_path"""


def search_sessions_page(spark: SparkSession, sf: str) -> DataFrame:
    """One best hit for each session, the third page of 20, and whether there are more."""
    best = ranking.capped(_hits(spark, sf).withColumn("score", F.round("score", 6)), SCOPE, 1, F.desc("score"), "doc_id")
    page = best.orderBy(F.desc("score"), "doc_id").offset(40).limit(21)
    rows = ranking.ranked(page, F.desc("score"), "doc_id")
    return rows.withColumn("has_more", F.count("*").over(Window.partitionBy()) > 20).where("rank <= 20").select("doc_id", "score", "has_more")


SQL["search_sessions_page"] = f"""{_BASE}, h AS (SELECT *, round(score, 6) AS r FROM hits), b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source, session_id, source_path ORDER BY r DESC, doc_id) AS n FROM h) WHERE n = 1),
  p AS (SELECT *, row_number() OVER (ORDER BY r DESC, doc_id) AS k, count(*) OVER () AS c FROM b) SELECT doc_id, r AS score, c > 60 AS has_more FROM p WHERE k BETWEEN 41 AND 60"""


def search_multi_query(spark: SparkSession, sf: str) -> DataFrame:
    """Three views of a question, fused by reciprocal ranks."""
    hits = record_index(spark, sf).search_each({0: "refresh task", 1: "segment merger", 2: "query planner"})
    fused = ranking.rrf_cases(hits.withColumn("score", F.round("score", 6)), ["doc_id"], 100)
    return fused.select("doc_id", F.round("score", 9).alias("score"))


SQL["search_multi_query"] = (
    f"WITH {RECORDS_SQL}, "
    + ", ".join(
        f"v{k} AS (WITH {_bm25_sql(w)} SELECT doc_id, row_number() OVER (ORDER BY round(score, 6) DESC, doc_id) AS rank FROM hits ORDER BY rank LIMIT 100)"
        for k, w in enumerate([["refresh", "task"], ["segment", "merger"], ["query", "planner"]])
    )
    + " SELECT doc_id, round(sum(1.0 / (60 + rank)), 9) AS score FROM (SELECT * FROM v0 UNION ALL SELECT * FROM v1 UNION ALL SELECT * FROM v2) GROUP BY doc_id"
)


def search_federated(spark: SparkSession, sf: str) -> DataFrame:
    """The lists of the machines in one; sources stand in for machines here."""
    hits = _hits(spark, sf).withColumn("score", F.round("score", 6)).withColumn("machine", F.col("source"))
    return ranking.federated(ranking.capped(hits, ["machine"], 30, F.desc("score"), F.desc("ts"), "doc_id"), 2).select("machine", "doc_id", F.round("score", 9).alias("score"))


SQL["search_federated"] = f"{_BASE} SELECT source AS machine, doc_id, round(1.0 / (60 + n), 9) AS score FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY round(score, 6) DESC, ts DESC, doc_id) AS n FROM hits) WHERE n <= 30"


def _query_vector(spark: SparkSession, sf: str) -> list[float]:
    return list(vectors(spark, sf).where("doc_id = 7").first()["embedding"])


def vector_knn(spark: SparkSession, sf: str) -> DataFrame:
    """The 25 nearest vectors and their semantic scores."""
    return ranking.nearest(vectors(spark, sf), _query_vector(spark, sf), 25).select("doc_id", F.round("score", 5).alias("score"))


_COS = "list_dot_product(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) / (sqrt(list_dot_product(CAST(e.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[]))) * sqrt(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[]))))"
_KNN = f"SELECT e.vec_id AS doc_id, e.label, 1 - {_COS} AS distance FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 7) q"
SQL["vector_knn"] = f"SELECT doc_id, round(1 / (1 + distance), 5) AS score FROM ({_KNN}) ORDER BY distance, doc_id LIMIT 25"


def vector_knn_filtered(spark: SparkSession, sf: str) -> DataFrame:
    """The nearest among those that pass a filter; the filter comes first."""
    return ranking.nearest(vectors(spark, sf).where("label % 2 = 1"), _query_vector(spark, sf), 25).select("doc_id", F.round("score", 5).alias("score"))


SQL["vector_knn_filtered"] = f"SELECT doc_id, round(1 / (1 + distance), 5) AS score FROM ({_KNN}) WHERE label % 2 = 1 ORDER BY distance, doc_id LIMIT 25"


def vector_knn_set(spark: SparkSession, sf: str) -> DataFrame:
    """The 25 nearest vectors of every vector whose id is divisible by 50."""
    v = vectors(spark, sf)
    return ranking.nearest_each(v, v.where("doc_id % 50 = 0"), 25).select("query_id", "doc_id", F.round("score", 5).alias("score"))


def vector_knn_filtered_set(spark: SparkSession, sf: str) -> DataFrame:
    """The same among those that pass a filter."""
    v = vectors(spark, sf)
    return ranking.nearest_each(v.where("label % 2 = 1"), v.where("doc_id % 50 = 0"), 25).select("query_id", "doc_id", F.round("score", 5).alias("score"))


def _knn_set_sql(where: str) -> str:
    pairs = f"SELECT q.vec_id AS query_id, e.vec_id AS doc_id, 1 - {_COS} AS distance FROM embeddings e, embeddings q WHERE q.vec_id % 50 = 0 AND {where}"
    return f"SELECT query_id, doc_id, round(1 / (1 + distance), 5) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, doc_id) AS n FROM ({pairs})) WHERE n <= 25"


SQL["vector_knn_set"] = _knn_set_sql("true")
SQL["vector_knn_filtered_set"] = _knn_set_sql("e.label % 2 = 1")


def vector_index(spark: SparkSession, sf: str) -> VectorIndex:
    """The written index of the vectors, made at the first search of a state of the table."""
    index = VectorIndex(spark, f"{shared_dir(spark)}/indexes-{FORMAT}/vectors-{fingerprint(spark, f'{sf}/embeddings.parquet')}")
    return index if index.manifest else index.create(vectors(spark, sf))


def vector_index_set(spark: SparkSession, sf: str) -> DataFrame:
    """The nearest of every vector whose id is divisible by 50 by the written index, in all of its cells, which makes it exact."""
    q = vectors(spark, sf).where("doc_id % 50 = 0")
    return vector_index(spark, sf).nearest_each(q, 25, probes=16).select("query_id", "doc_id", F.round("score", 5).alias("score"))


SQL["vector_index_set"] = SQL["vector_knn_set"]


def vector_index_recall(spark: SparkSession, sf: str) -> DataFrame:
    """Which share of the exact answers the index finds in the cells that it looks at by default; no SQL, held to 0.9 by a test."""
    v = vectors(spark, sf)
    q = v.where("doc_id % 50 = 0")
    exact = ranking.nearest_each(v, q, 25).select("query_id", "doc_id")
    found = vector_index(spark, sf).nearest_each(q, 25).select("query_id", "doc_id", F.lit(True).alias("hit"))
    return exact.join(found, ["query_id", "doc_id"], "left").agg(F.count("*").alias("answers"), F.round(F.count("hit") / F.count("*"), 4).alias("recall"))


def search_hybrid(spark: SparkSession, sf: str) -> DataFrame:
    """Words and vectors fused by ranks; documents and vectors share ids."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    n = ranking.candidates(20)
    words = ranking.ranked(lexical.top(document_index(spark, sf).search("refresh segment query").withColumn("score", F.round("score", 6)), n, "doc_id"), F.desc("score"), "doc_id")
    near = ranking.ranked(ranking.nearest(vectors(spark, sf), _query_vector(spark, sf), n), "distance", "doc_id")
    fused = ranking.rrf([words, near], ["doc_id"]).join(docs.select("doc_id"), "doc_id")
    return lexical.top(fused.select("doc_id", F.round("score", 9).alias("score")), 20, "doc_id")


SQL["search_hybrid"] = (
    f"WITH {_bm25_sql(WORDS, source='documents')}, w AS (SELECT doc_id, row_number() OVER (ORDER BY round(score, 6) DESC, doc_id) AS rank FROM hits ORDER BY rank LIMIT 100), "
    f"v AS (SELECT doc_id, row_number() OVER (ORDER BY distance, doc_id) AS rank FROM ({_KNN}) ORDER BY rank LIMIT 100) "
    "SELECT f.doc_id, round(score, 9) AS score FROM (SELECT doc_id, sum(1.0 / (60 + rank)) AS score FROM (SELECT * FROM w UNION ALL SELECT * FROM v) GROUP BY doc_id) f JOIN documents d USING (doc_id) ORDER BY round(score, 9) DESC, doc_id LIMIT 20"
)


def vector_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """Records that should have a vector and have none."""
    wanted = records(spark, sf).where("role in ('user', 'assistant') and trim(text) <> ''")
    return wanted.join(vectors(spark, sf), "doc_id", "left_anti").groupBy("source").agg(F.count("*").alias("missing"))


SQL["vector_coverage"] = f"WITH {RECORDS_SQL} SELECT source, count(*) AS missing FROM records WHERE role IN ('user', 'assistant') AND trim(text) <> '' AND doc_id NOT IN (SELECT vec_id FROM embeddings) GROUP BY source"


def scope_ambiguity(spark: SparkSession, sf: str) -> DataFrame:
    """The session ids that stand for several identities; in these tables none has two paths, so the working directory tells them apart here."""
    ids = table(spark, sf, "sessions").where("cwd is not null").select("session_id", "source", "cwd").distinct()
    return ids.groupBy("session_id").agg(F.count("*").alias("identities")).where("identities > 1")


SQL["scope_ambiguity"] = "SELECT session_id, count(*) AS identities FROM (SELECT DISTINCT session_id, source, cwd FROM sessions WHERE cwd IS NOT NULL) GROUP BY session_id HAVING count(*) > 1"


def search_scope_join(spark: SparkSession, sf: str) -> DataFrame:
    """Records in the sessions below a directory, found by a semi join on the three-part identity."""
    s = table(spark, sf, "sessions").where("cwd = '/work/amber-pier' or startswith(cwd, '/work/amber-pier/') or git_root = '/work/amber-pier'").select(*SCOPE)
    return records(spark, sf).join(s, SCOPE, "left_semi").select("doc_id", "source", "session_id")


SQL["search_scope_join"] = f"WITH {RECORDS_SQL} SELECT doc_id, source, session_id FROM records r WHERE EXISTS (SELECT 1 FROM sessions s WHERE s.source = r.source AND s.session_id = r.session_id AND s.source_path = r.source_path AND (s.cwd = '/work/amber-pier' OR starts_with(s.cwd, '/work/amber-pier/') OR s.git_root = '/work/amber-pier'))"


def query_exists(spark: SparkSession, sf: str) -> DataFrame:
    """Sessions that have both a match and a user row."""
    hits = _hits(spark, sf).select(*SCOPE).distinct()
    return hits.join(records(spark, sf).where("role = 'user'"), SCOPE, "left_semi")


SQL["query_exists"] = f"{_BASE} SELECT source, session_id, source_path FROM hits INTERSECT SELECT source, session_id, source_path FROM records WHERE role = 'user'"


def index_postings(spark: SparkSession, sf: str) -> DataFrame:
    """B1, D3: the inverted index of the memories, summed up by term."""
    p = lexical.postings(table(spark, sf, "documents").where("text is not null"), "doc_id", "text")
    return p.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"), F.max(F.element_at("positions", -1)).alias("last_position"))


SQL["index_postings"] = (
    "WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{M}\\p{N}]+'), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL), e AS (SELECT doc_id, unnest(w) AS term, generate_subscripts(w, 1) - 1 AS pos FROM t) "
    "SELECT term, count(DISTINCT doc_id) AS df, count(*) AS cf, CAST(max(pos) AS INT) AS last_position FROM e GROUP BY term"
)

def search_stemmed(spark: SparkSession, sf: str) -> DataFrame:
    """Words by their stems; no SQL, tested by itself."""
    return lexical.top(record_index(spark, sf, True).search("refreshing segments queried").select("doc_id", F.round("score", 6).alias("score")), 50, "doc_id")


QUERIES = {
    f.__name__: f
    for f in (
        search_bm25, search_scripts, search_scan, index_append, search_stemmed, search_grammar, search_match_all, search_by_time, recent_records, search_recency, search_min_score, search_top_per_session, search_session_groups, search_sessions_page,
        search_multi_query, search_federated, vector_knn, vector_knn_filtered, vector_knn_set, vector_knn_filtered_set, vector_index_set, vector_index_recall, search_hybrid, vector_coverage, scope_ambiguity, search_scope_join, query_exists, index_postings,
    )
}
