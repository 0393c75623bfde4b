"""The engine's surface: search, catalogue, context, usage, activity and evaluation over its tables.

Calls return DataFrames; requests are checked when they are made. A search by
words runs small jobs before it returns, for the counts of its words.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomspan.functions import text as T
from loomspan.operators import activity, catalog, context, evaluate, lexical, memory, prepare, ranking, usage
from loomspan.operators.index import Index
from loomspan.operators.vectors import VectorIndex
from loomspan.schemas import stored_labels

SCOPE = catalog.SCOPE
MOST_VIEWS = memory.MOST_VIEWS
# The columns of the two sets of fields that a request may name instead of columns.
FIELD_SETS = {"compact": ("source", "session_id", "doc_id", "ts", "role", "score"), "full": ("source", "session_id", "source_path", "project", "doc_id", "turn_id", "ts", "role", "tool_name", "text", "score")}


@dataclass(frozen=True)
class SearchRequest:
    """What to search for. since and until both count; several queries are fused; a vector makes the search semantic, and hybrid with ``hybrid``."""

    queries: tuple[str, ...] = ("",)
    source: str | None = None
    project: str | None = None
    role: str | None = None
    tool: str | None = None
    session_id: str | None = None
    since: int | None = None
    until: int | None = None
    vector: tuple[float, ...] | None = None
    model: str | None = None
    hybrid: bool = False
    stemmed: bool = True
    recency_weight: float = 0.0
    half_life_days: float = 30.0
    now_ms: int = 0
    min_score: float | None = None
    per_session: int | None = None
    kind: str = "all"
    sort: str = "score"
    fields: tuple[str, ...] | str = "compact"
    limit: int = 20

    @property
    def views(self) -> list[str]:
        """The different queries; a blank one if there is no other."""
        return list(dict.fromkeys(v.strip() for v in self.queries)) or [""]

    @property
    def columns(self) -> tuple[str, ...]:
        return FIELD_SETS[self.fields] if isinstance(self.fields, str) else self.fields

    def check(self) -> None:
        if len(self.views) > MOST_VIEWS:
            raise ValueError(f"more than {MOST_VIEWS} different queries")
        if any(len(v) > 4096 for v in self.views):
            raise ValueError("a query is longer than 4,096 characters")
        if not 1 <= self.limit <= 500:
            raise ValueError("limit must lie between 1 and 500")
        for name in ("recency_weight", "half_life_days"):
            v = getattr(self, name)
            if not math.isfinite(v) or v < 0:
                raise ValueError(f"{name} must be a finite number from 0 on")
        if isinstance(self.fields, str) and self.fields not in FIELD_SETS:
            raise ValueError("unknown set of fields")
        if self.kind not in ("all", "regular", "primary", "subagent") or self.sort not in ("score", "ts"):
            raise ValueError("unknown kind or sort")
        if self.per_session is not None and self.per_session < 1:
            raise ValueError("per_session must be at least 1")
        if self.recency_weight and self.now_ms <= 0:
            raise ValueError("recency needs now_ms")


@dataclass
class Engine:
    """records as ``schemas.RECORD`` or a part of it; the other tables are needed by what uses them alone.

    index: the written index of the records; searches then read no texts. It must
    keep the columns that requests filter by and ts. vector_model: the name of the
    model that made the vectors; a request by a vector of another one is an error.
    """

    spark: SparkSession
    records: DataFrame
    sessions: DataFrame | None = None
    usage_events: DataFrame | None = None
    vectors: DataFrame | None = None
    sections: DataFrame | None = None
    rates: DataFrame | None = None
    index: Index | None = None
    vector_model: str | None = None
    failures: list[str] = field(default_factory=list)

    def _filtered(self, q: SearchRequest, rows: DataFrame) -> DataFrame:
        for column, value in (("project", q.project), ("role", q.role), ("tool_name", q.tool), ("session_id", q.session_id)):
            if value is not None:
                rows = rows.where(F.col(column) == value)
        if q.source is not None:
            rows = rows.where(F.col("source").isin(stored_labels(q.source)))
        if q.since is not None:
            rows = rows.where(F.col("ts") >= q.since)
        if q.until is not None:
            rows = rows.where(F.col("ts") <= q.until)
        if q.kind != "all":
            kinds = self.sessions.select(*SCOPE, F.col("conversation_kind").alias("_kind"))
            rows = rows.join(kinds, SCOPE, "left").where(catalog.of_kind(F.col("_kind"), q.kind)).drop("_kind")
        return rows

    def _index_for(self, stemmed: bool) -> Index | None:
        m = self.index.manifest if self.index is not None else None
        return self.index if m and m["stemmed"] == stemmed else None

    def _by_words(self, q: SearchRequest) -> list[DataFrame]:
        """The hits of each view with the columns that filters need: all views that have words in one pass over postings or texts."""
        parsed = {i: lexical.parse(v) for i, v in enumerate(q.views)}
        asked = {i: p for i, p in parsed.items() if p.scored}
        out = [lexical.bm25(self.records, "text", p, q.stemmed) for i, p in parsed.items() if i not in asked]
        if not asked:
            return out
        if self._index_for(q.stemmed) is not None:
            each = self.index.search_each(asked)
        else:
            each = lexical.bm25_each(self.records, "text", asked, q.stemmed)
        return [*out, *(each.where(F.col("case") == i).drop("case") for i in asked)]

    def search(self, q: SearchRequest) -> DataFrame:
        """Ranked records. Filters come after the statistics and before every limit; semantic search without vectors falls back to words."""
        q.check()
        wide = ranking.candidates(q.limit)
        semantic = q.vector is not None and self.vectors is not None and not self.vectors.isEmpty()
        if semantic and q.model is not None and self.vector_model is not None and q.model != self.vector_model:
            raise ValueError(f"the vectors are of {self.vector_model}, not of {q.model}")
        # what the index keeps beside its words needs no look into the records
        wanted = list(dict.fromkeys(["doc_id", "ts", "source", "session_id", *(c for c in q.columns if c != "score")]))
        covered = not semantic and self._index_for(q.stemmed) is not None and set(wanted) <= {"doc_id", *self.index.manifest["keep"]}
        carried = wanted if covered else ["doc_id", "ts"]
        lists = []
        if q.hybrid or not semantic:
            lists += [lexical.top(self._filtered(q, hits).select(*carried, "score"), wide, "doc_id") for hits in self._by_words(q)]
        if semantic:
            inside = self._filtered(q, self.records).select("doc_id", "ts")
            lists.append(ranking.nearest(self.vectors.join(inside, "doc_id"), list(q.vector), wide).select("doc_id", "ts", "score"))
        if len(lists) == 1:
            hits = lists[0]
        else:
            hits = ranking.rrf([ranking.ranked(x, F.desc("score"), "doc_id") for x in lists], carried)
        if q.recency_weight:
            hits = ranking.with_recency(hits, q.now_ms, q.recency_weight, q.half_life_days)
        if q.min_score is not None:
            hits = hits.where(F.col("score") >= q.min_score)
        if not covered:
            hits = hits.select("doc_id", "score").join(self.records, "doc_id")
        order = [F.desc("score"), F.desc("ts"), "doc_id"] if q.sort == "score" else [F.desc("ts"), "doc_id"]
        if q.per_session is not None:
            hits = ranking.capped(hits, ["source", "session_id"], q.per_session, *order)
        return hits.orderBy(*order).limit(q.limit).select(*q.columns)

    def search_memories(self, queries: list[str], limit: int = 20, per_document: int = 2) -> DataFrame:
        return memory.search(self.sections, queries, limit, per_document)

    def session_list(self, project: str | None = None, below: str | None = None, kind: str = "regular", since: int | None = None, limit: int = 50) -> DataFrame:
        s = self.sessions.where(catalog.of_kind(F.col("conversation_kind"), kind))
        if project is not None:
            s = s.where(F.coalesce("repo_project", "project") == project)
        if below is not None:
            s = s.where(catalog.below(F.col("cwd"), F.col("git_root"), below))
        if since is not None:
            s = s.where(F.col("last_at") >= since)
        return s.orderBy(F.desc("last_at"), *SCOPE).limit(limit)

    def projects(self) -> DataFrame:
        return catalog.project_summaries(self.sessions).orderBy(F.desc_nulls_last("last_at"), "project")

    def show(self, doc_id: int | None = None, event_id: str | None = None, record_id: str | None = None) -> DataFrame:
        """The record with an id, an event id or a canonical id (``text.record_id``); exactly one must have it."""
        by = F.col("doc_id") == doc_id if doc_id is not None else F.col("event_id") == event_id if event_id is not None else T.record_id() == record_id
        rows = self.records.where(by)
        n = len(rows.select("doc_id").take(2))
        if n != 1:
            raise LookupError("no record has this id" if not n else "several records have this id")
        return rows

    def show_field(self, column: str, offset: int = 0, length: int = 4000, **one: object) -> DataFrame:
        """(doc_id, value, next_offset): a part of a text column of the record that ``show`` finds, and where to go on; null at the end."""
        rows, text = self.show(**one), F.col(column)
        return rows.select("doc_id", F.substring(text, offset + 1, length).alias("value"), F.when(F.length(text) > offset + length, F.lit(offset + length)).alias("next_offset"))

    def lookup(self, source: str | None = None, session_id: str | None = None, source_path: str | None = None) -> DataFrame:
        """The records of a source, a session or a file, or what these have in common, in session order."""
        rows = self.records
        for column, value in (("session_id", session_id), ("source_path", source_path)):
            if value is not None:
                rows = rows.where(F.col(column) == value)
        if source is not None:
            rows = rows.where(F.col("source").isin(stored_labels(source)))
        return rows.orderBy(*SCOPE, *context.ORDER)

    def context(self, doc_id: int, before: int = 5, after: int = 5) -> DataFrame:
        anchor = self.show(doc_id).select("doc_id")
        near = context.neighbourhood(self.records, anchor, before, after)
        return near.select("doc_id", "role", "text", "distance", F.when(F.col("distance") == 0, "anchor").when(F.col("distance") < 0, "before").otherwise("after").alias("relation")).orderBy("distance")

    def pages(self, requests: DataFrame) -> DataFrame:
        return context.pages(self.records, requests)

    def usage(self, since: int | None = None, until: int | None = None) -> DataFrame:
        e = self.usage_events.where(usage.within(since, until))
        e = usage.with_rates(e, self.rates).withColumn("cost_nanos", usage.cost_nanos()) if self.rates is not None else e.withColumn("cost_nanos", F.lit(None).cast("bigint"))
        return usage.report(e)

    def activity(self, since: int, now: int, unit: int = activity.DAY) -> DataFrame:
        points = self.sessions.select("source", F.col("last_at").alias("ts"))
        return activity.regrid(activity.buckets(points, unit), since, now, unit)

    def evaluate(self, cases: DataFrame, k: int = 10, limit: int = 50, stemmed: bool = True) -> DataFrame:
        """cases: case_id, queries array<string>, relevant array<struct<doc_id, relevance>>; see ``read_cases``. The views of all cases are searched in passes of many at a time and fused by case."""
        listed = cases.select("case_id", "queries").collect()  # a dataset of questions, made by hand
        views = {i: (c["case_id"], v) for i, (c, v) in enumerate((c, v) for c in listed for v in dict.fromkeys(q.strip() for q in c["queries"]) if v)}
        asked = {i: v for i, (_, v) in views.items()}
        if self._index_for(stemmed) is not None:
            hits = self.index.search_each(asked)
        else:
            blocks = [dict(list(asked.items())[k : k + 200]) for k in range(0, len(asked), 200)]
            hits = reduce(DataFrame.unionByName, [lexical.bm25_each(self.records, "text", b, stemmed).select("case", "doc_id", "score", "session_id", "ts") for b in blocks])
        own = ranking.ranked(hits, F.desc("score"), F.desc("ts"), "doc_id", by=["case"]).where(F.col("rank") <= ranking.candidates(limit))
        names = self.spark.createDataFrame([(i, case) for i, (case, _) in views.items()], f"case int, case_id {dict(cases.dtypes)['case_id']}")
        fused = own.join(names, "case").groupBy("case_id", "doc_id").agg(F.sum(F.lit(1.0) / (ranking.RRF_K + F.col("rank"))).alias("score"), F.first("session_id").alias("session"), F.first("ts").alias("ts"))
        results = ranking.ranked(fused, F.desc("score"), F.desc("ts"), "doc_id", by=["case_id"]).where(F.col("rank") <= limit).select("case_id", "rank", F.col("doc_id").alias("key"), "session")
        qrels = cases.select("case_id", F.explode("relevant").alias("r")).select("case_id", F.col("r.doc_id").alias("key"), F.col("r.relevance").alias("relevance"))
        return evaluate.evaluate(results, qrels, k)

    def stats(self) -> DataFrame:
        return self.records.agg(F.count("*").alias("records"), F.countDistinct(*SCOPE).alias("sessions"), F.countDistinct("source").alias("sources"))

    def needing_vectors(self) -> DataFrame:
        """Records of user and assistant with text and without a vector."""
        wanted = self.records.where("role in ('user', 'assistant') and trim(text) <> ''")
        return wanted if self.vectors is None else wanted.join(self.vectors.select("doc_id"), "doc_id", "left_anti")

    def backfill(self, index: VectorIndex, model: Callable[[list[str]], np.ndarray], dims: int, name: str | None = None) -> VectorIndex:
        """Make the vectors that records lack and file them; the index is made if it isn't there, and refused if another model made it."""
        m = index.manifest
        if m and name is not None and m["model"] is not None and m["model"] != name:
            raise ValueError(f"the vectors are of {m['model']}, not of {name}")
        lacking = Engine(self.spark, self.records, vectors=index.stored() if m else None).needing_vectors()
        new = prepare.embed(lacking, model, dims)
        return index.add(new) if m else index.create(new, model=name)

    def titles(self) -> DataFrame:
        """(scope, title) of every session: its label, else its first prompt as a label."""
        first = catalog.roll_up(self.records, T.label(F.col("text"))).select(*SCOPE, "label_text")
        own = self.sessions.select(*SCOPE, "label") if self.sessions is not None else first.select(*SCOPE, F.lit(None).cast("string").alias("label"))
        return first.join(own, SCOPE, "left").select(*SCOPE, F.coalesce(F.nullif(F.trim("label"), F.lit("")), "label_text").alias("title"))


def federate(lists: dict[str, DataFrame | Exception]) -> tuple[DataFrame | None, list[str]]:
    """The ranked lists of several machines in one, and the machines that failed."""
    good = {m: x for m, x in lists.items() if isinstance(x, DataFrame)}
    merged = None
    for m, x in good.items():
        x = x.withColumn("machine", F.lit(m))
        merged = x if merged is None else merged.unionByName(x)
    return merged if merged is None else ranking.federated(merged, len(good)), sorted(m for m in lists if m not in good)


def add_vectors(stored: DataFrame, new: DataFrame, dims: int) -> DataFrame:
    """stored with the vectors of ids that it lacks; a vector of other dimensions is an error."""
    checked = new.withColumn("embedding", F.when(F.size("embedding") == dims, F.col("embedding")).otherwise(F.raise_error(F.lit(f"a vector doesn't have {dims} dimensions"))))
    return stored.unionByName(checked.dropDuplicates(["doc_id"]).join(stored.select("doc_id"), "doc_id", "left_anti").select(*stored.columns))


def retain_vectors(stored: DataFrame, ids: DataFrame) -> DataFrame:
    return stored.join(ids.select("doc_id").distinct(), "doc_id", "left_semi")


CASES = "id string, query string, queries array<string>, cwd string, relevant array<struct<machine:string,source:string,session_id:string,source_path:string,doc_id:bigint,record_id:string,relevance:float>>"


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation cases from JSON lines: case_id, queries, relevant. Lines without any query or relevant record, and ids given twice, are errors."""
    raw = spark.read.schema(CASES).option("mode", "FAILFAST").json(path)
    c = raw.withColumn("queries", F.filter(F.coalesce("queries", F.array("query")), lambda q: F.trim(q) != "")).withColumn("case_id", F.coalesce("id", F.md5(F.to_json(F.struct("queries")))))
    relevant = F.transform("relevant", lambda r: r.withField("relevance", F.coalesce(r["relevance"], F.lit(1.0).cast("float"))))
    c = c.withColumn("relevant", relevant).withColumn("_n", F.count("*").over(Window.partitionBy("case_id")))
    bad = (F.size("queries") == 0) | F.col("relevant").isNull() | (F.size("relevant") == 0) | (F.col("_n") > 1)
    return c.withColumn("queries", F.when(bad, F.raise_error(F.concat(F.lit("a case is empty or given twice: "), "case_id"))).otherwise(F.col("queries"))).select("case_id", "queries", "relevant")


def append_trace(trace: DataFrame, path: str) -> None:
    """Add rows that say how a search was answered, without texts, as JSON lines."""
    trace.drop("text", "snippet").write.mode("append").json(path)


def referenced(sections: DataFrame, documents: DataFrame) -> DataFrame:
    """(doc_id, ref, target): the references of sections to documents (doc_id, path), relative to the path of their own document."""
    own = documents.select("doc_id", F.regexp_replace("path", r"[^/]+$", "").alias("dir"))
    refs = sections.select("doc_id", F.explode("refs").alias("ref")).join(own, "doc_id")
    clean = F.regexp_replace(F.regexp_replace("ref", r"(#.*|:\d+)$", ""), r"^\./", "")
    refs = refs.withColumn("path", F.when(clean.startswith("/"), clean).otherwise(F.concat("dir", clean)))
    return refs.join(documents.select("path", F.col("doc_id").alias("target")), "path").select("doc_id", "ref", "target").distinct()
