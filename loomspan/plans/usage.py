"""Token usage, cost, cache waste and activity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.functions.stamps import wall_us
from loomspan.operators import activity, usage
from loomspan.plans.adapters import SESSIONS_SQL, USAGE_SQL, sessions, usage_events
from loomspan.session import table

_U = f"WITH {USAGE_SQL}"
SQL: dict[str, str] = {}
SINCE, UNTIL = 1_770_000_000_000, 1_785_000_000_000
TOTAL = "uncached_input + cache_read + cache_write + output"
# invented rates for the invented models of the test data
RATES = [("northbeam", "quill-large-2", 3000, 300, 3750, 15000), ("northbeam", "quill-mini-2", 250, 25, 0, 2000), ("orrery", "sable-7", 5000, 500, 6250, 25000)]


def _rates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RATES, "provider string, model string, input bigint, cache_read bigint, cache_write bigint, output bigint")


_RATES = "r(provider, model, r_input, r_cache_read, r_cache_write, r_output) AS (VALUES " + ", ".join(str(r) for r in RATES) + ")"
_SUMS = ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in usage.BUCKETS)
_COST = "CAST(floor((uncached_input * r_input + cache_read * r_cache_read + cache_write * r_cache_write + output * r_output) / 1000000) AS BIGINT)"
_PRICED = f"{_U}, {_RATES}, p AS (SELECT u.*, {_COST.replace('/ 1000000', '// 1000000')} AS cost_nanos FROM u LEFT JOIN r ON r.model = regexp_replace(lower(trim(u.model)), '-20[0-9-]*$', '') AND (u.provider IS NULL OR contains(lower(u.provider), r.provider)))"


def _priced(spark: SparkSession, sf: str) -> DataFrame:
    return usage.with_rates(usage_events(spark, sf), _rates(spark)).withColumn("cost_nanos", usage.cost_nanos())


def usage_report(spark: SparkSession, sf: str) -> DataFrame:
    """Totals, known cost and unknown models within a time."""
    e = _priced(spark, sf).where(usage.within(SINCE, UNTIL)).withColumn("source", F.coalesce("provider", F.lit("-")))
    return usage.report(e).fillna({"cost_nanos": 0})


SQL["usage_report"] = f"{_PRICED} SELECT coalesce(provider, '-') AS source, count(*) AS events, {_SUMS}, CAST(sum({TOTAL}) AS BIGINT) AS tokens, count_if(model IS NULL) AS unknown_model, count(cost_nanos) AS priced, count(*) - count(cost_nanos) AS unpriced, coalesce(CAST(sum(cost_nanos) AS BIGINT), 0) AS cost_nanos FROM p WHERE timestamp_ms >= {SINCE} AND timestamp_ms < {UNTIL} GROUP BY 1"


def usage_cost_by_event(spark: SparkSession, sf: str) -> DataFrame:
    """the cost of each priced event."""
    return _priced(spark, sf).where("cost_nanos is not null").select("row_idx", "cost_nanos")


SQL["usage_cost_by_event"] = f"{_PRICED} SELECT row_idx, cost_nanos FROM p WHERE cost_nanos IS NOT NULL"


def usage_dedup_requests(spark: SparkSession, sf: str) -> DataFrame:
    """one event for each request, main chains before sidechains."""
    return usage.keep_best_request(usage_events(spark, sf)).select("row_idx")


SQL["usage_dedup_requests"] = f"""{_U}, k AS (SELECT *, CASE WHEN message_id IS NOT NULL AND request_id IS NOT NULL THEN message_id || chr(31) || request_id ELSE chr(30) || row_idx END AS key FROM u),
  o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source, key ORDER BY sidechain, contains(source_path, '/subagents/'), {TOTAL} DESC, source_order DESC, row_idx) AS n FROM k) WHERE n = 1)
  SELECT row_idx FROM o WHERE NOT sidechain OR message_id IS NULL OR message_id NOT IN (SELECT message_id FROM o WHERE NOT sidechain AND message_id IS NOT NULL)"""


def usage_dedup_counts(spark: SparkSession, sf: str) -> DataFrame:
    """the first of equal records with equal counts."""
    return usage.keep_first(usage_events(spark, sf), ["session_id", "source_record_id", *usage.BUCKETS], ["session_id", "source_record_id"]).select("row_idx")


_FIRST = "row_number() OVER (PARTITION BY {} ORDER BY timestamp_ms, source_path, source_order, row_idx) AS n"
SQL["usage_dedup_counts"] = f"{_U} SELECT row_idx FROM (SELECT *, {_FIRST.format('session_id, source_record_id, ' + ', '.join(usage.BUCKETS))} FROM u) WHERE n = 1 OR session_id IS NULL OR source_record_id IS NULL"


def usage_dedup_records(spark: SparkSession, sf: str) -> DataFrame:
    """the first of each record id; events without one stay."""
    return usage.keep_first(usage_events(spark, sf), ["source_record_id"], ["source_record_id"]).select("row_idx")


SQL["usage_dedup_records"] = f"{_U} SELECT row_idx FROM (SELECT *, {_FIRST.format('source_record_id')} FROM u) WHERE n = 1 OR source_record_id IS NULL"


def usage_cache_waste(spark: SparkSession, sf: str) -> DataFrame:
    """F16, G1: prompts that should have come from the cache, by reason."""
    return usage.cache_misses(usage_events(spark, sf)).groupBy("source", "why").agg(F.count("*").alias("misses"), F.sum("missed").alias("missed"))


SQL["usage_cache_waste"] = f"""{_U}, a AS (SELECT *, sum(CAST(chain_break AS INT)) OVER (PARTITION BY source, session_id, source_path ORDER BY timestamp_ms, source_order, row_idx ROWS UNBOUNDED PRECEDING) AS seg,
    uncached_input + cache_read + cache_write AS prompt FROM u WHERE NOT sidechain AND session_id IS NOT NULL),
  b AS (SELECT *, lag(prompt) OVER w AS before, lag(coalesce(provider, '') || chr(31) || coalesce(model, '')) OVER w AS model_before, lag(timestamp_ms) OVER w AS ts_before,
    max(CAST(cache_read + cache_write > 0 AS INT)) OVER (PARTITION BY source, session_id, source_path, seg ORDER BY timestamp_ms, source_order, row_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reported
    FROM a WHERE NOT chain_break AND prompt > 0 WINDOW w AS (PARTITION BY source, session_id, source_path, seg ORDER BY timestamp_ms, source_order, row_idx)),
  c AS (SELECT *, greatest(0, least(before, prompt) - cache_read) AS missed FROM b WHERE before IS NOT NULL)
  SELECT source, CASE WHEN coalesce(provider, '') || chr(31) || coalesce(model, '') <> model_before THEN 'switch' WHEN timestamp_ms - ts_before >= 300000 THEN 'idle' ELSE 'other' END AS why,
    count(*) AS misses, CAST(sum(missed) AS BIGINT) AS missed FROM c WHERE (cache_read > 0 OR reported = 1) AND prompt * 2 >= before AND missed > 1024 GROUP BY 1, 2"""


def usage_in_sessions(spark: SparkSession, sf: str) -> DataFrame:
    """Usage of the sessions of a project, by semi join."""
    s = sessions(spark, sf).where(usage.project_matches(F.col("project"), "Amber-Pier")).select("source", "session_id").distinct()
    e = usage_events(spark, sf).where(usage.within(SINCE, None)).join(s, ["source", "session_id"], "left_semi")
    return e.groupBy("session_id").agg(F.count("*").alias("events"), F.sum(usage.total()).alias("tokens"))


SQL["usage_in_sessions"] = f"WITH {USAGE_SQL}, {SESSIONS_SQL} SELECT session_id, count(*) AS events, CAST(sum({TOTAL}) AS BIGINT) AS tokens FROM u WHERE timestamp_ms >= {SINCE} AND (source, session_id) IN (SELECT source, session_id FROM s WHERE lower(project) = 'amber-pier' OR ends_with(lower(project), '/amber-pier')) GROUP BY session_id"


def usage_cumulative(spark: SparkSession, sf: str) -> DataFrame:
    """Counters that grow within a file, as what each event adds."""
    d = usage.cumulative_deltas(usage_events(spark, sf), ["source_path"], ["source_order", "row_idx"], ["raw_input", "output"])
    return d.select("row_idx", "raw_input_delta", "output_delta")


_BEFORE = "OVER (PARTITION BY source_path ORDER BY source_order, row_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
SQL["usage_cumulative"] = f"{_U} SELECT row_idx, greatest(0, raw_input - coalesce(max(raw_input) {_BEFORE}, 0)) AS raw_input_delta, greatest(0, output - coalesce(max(output) {_BEFORE}, 0)) AS output_delta FROM u"


def usage_fork_baseline(spark: SparkSession, sf: str) -> DataFrame:
    """What a fork inherits: the maxima of its parent's counters at the time of the fork."""
    forks = sessions(spark, sf).where("parent_session_id is not null").groupBy(F.col("session_id").alias("child"), F.col("parent_session_id").alias("parent")).agg(F.max("last_at").alias("fork_ts"))
    return usage.inherited_baseline(forks, usage_events(spark, sf), ["raw_input", "output"])


SQL["usage_fork_baseline"] = f"""WITH {USAGE_SQL}, {SESSIONS_SQL}, f AS (SELECT session_id AS child, parent_session_id AS parent, max(last_at) AS fork_ts FROM s WHERE parent_session_id IS NOT NULL GROUP BY 1, 2)
  SELECT child, parent, fork_ts, coalesce(max(raw_input), 0) AS raw_input, coalesce(max(output), 0) AS output FROM f LEFT JOIN u ON u.session_id = f.parent AND u.timestamp_ms <= f.fork_ts GROUP BY 1, 2, 3"""


def usage_residual(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of a session capped to its total, and the rest as a row of its own; the total here is half of each event, so every session has a cap that some rows exceed."""
    e = usage_events(spark, sf).where("session_id is not null")
    totals = e.groupBy("session_id").agg(F.sum(F.floor(F.col("output") / 2) + F.col("row_idx") % 7).alias("output"))
    return usage.residual(e, totals, "session_id", ["timestamp_ms", "row_idx"], "output").groupBy("session_id", "is_residual").agg(F.sum("used").alias("used"))


SQL["usage_residual"] = f"""{_U}, t AS (SELECT session_id, sum(output // 2 + row_idx % 7) AS total FROM u WHERE session_id IS NOT NULL GROUP BY session_id),
  c AS (SELECT u.session_id, greatest(0, least(output, total - coalesce(sum(output) OVER (PARTITION BY u.session_id ORDER BY timestamp_ms, row_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS used, total FROM u JOIN t USING (session_id)),
  g AS (SELECT session_id, sum(used) AS used, any_value(total) AS total FROM c GROUP BY session_id)
  SELECT session_id, false AS is_residual, CAST(used AS BIGINT) AS used FROM g UNION ALL SELECT session_id, true, CAST(total - used AS BIGINT) FROM g WHERE total > used"""


def usage_volume_groups(spark: SparkSession, sf: str) -> DataFrame:
    """models by volume, the largest first."""
    e = usage_events(spark, sf).groupBy(F.coalesce("model", F.lit("-")).alias("model")).agg(F.sum(usage.total()).alias("tokens"))
    return e.orderBy(F.desc("tokens"), "model")


SQL["usage_volume_groups"] = f"{_U} SELECT coalesce(model, '-') AS model, CAST(sum({TOTAL}) AS BIGINT) AS tokens FROM u GROUP BY 1"


def usage_canonical_order(spark: SparkSession, sf: str) -> DataFrame:
    """H6, H7: the first events in report order."""
    return usage_events(spark, sf).orderBy("timestamp_ms", "source_path", "source_order", "row_idx").limit(100).select("row_idx")


SQL["usage_canonical_order"] = f"{_U} SELECT row_idx FROM u ORDER BY timestamp_ms, source_path, source_order, row_idx LIMIT 100"


def _points(spark: SparkSession, sf: str) -> DataFrame:
    return sessions(spark, sf).select("source", F.col("last_at").alias("ts"))


def activity_buckets(spark: SparkSession, sf: str) -> DataFrame:
    """sessions by day and source."""
    return activity.buckets(_points(spark, sf), activity.DAY)


_B = f"WITH {SESSIONS_SQL}, b AS (SELECT last_at - last_at % 86400000 AS bucket, source, count(*) AS value FROM s WHERE last_at > 0 GROUP BY 1, 2)"
SQL["activity_buckets"] = f"{_B} SELECT * FROM b"


def activity_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """Tokens by hour and model."""
    p = usage_events(spark, sf).select(F.col("timestamp_ms").alias("ts"), F.coalesce("model", F.lit("-")).alias("source"), usage.total().alias("tokens"))
    return activity.buckets(p, activity.HOUR, F.col("tokens"))


SQL["activity_tokens"] = f"{_U} SELECT timestamp_ms - timestamp_ms % 3600000 AS bucket, coalesce(model, '-') AS source, CAST(sum({TOTAL}) AS BIGINT) AS value FROM u WHERE timestamp_ms > 0 GROUP BY 1, 2"


def activity_regrid(spark: SparkSession, sf: str) -> DataFrame:
    """the days laid on at most 60 columns, empty columns too."""
    on = activity.regrid(activity.buckets(_points(spark, sf), activity.DAY), SINCE, UNTIL, activity.DAY)
    every = activity.grid(spark, SINCE, UNTIL, activity.DAY)
    return every.join(on, "bucket", "left").select("bucket", F.coalesce("source", F.lit("-")).alias("source"), F.coalesce("value", F.lit(0)).alias("value"))


_START, _END = SINCE // activity.DAY * activity.DAY, UNTIL // activity.DAY * activity.DAY
_STEP = activity.step_of(_START, _END, activity.DAY)
SQL["activity_regrid"] = f"{_B}, g AS (SELECT {_START} + (bucket - {_START}) // {_STEP} * {_STEP} AS bucket, source, CAST(sum(value) AS BIGINT) AS value FROM b WHERE bucket BETWEEN {_START} AND {_END} GROUP BY 1, 2), k AS (SELECT unnest(generate_series({_START}, {_END}, {_STEP})) AS bucket) SELECT k.bucket, coalesce(source, '-') AS source, coalesce(value, 0) AS value FROM k LEFT JOIN g USING (bucket)"


def activity_histogram(spark: SparkSession, sf: str) -> DataFrame:
    """sessions in 40 equal parts of a time."""
    return activity.histogram(_points(spark, sf), "ts", SINCE, UNTIL, 40)


SQL["activity_histogram"] = f"WITH {SESSIONS_SQL} SELECT CAST(least((last_at - {SINCE}) * 40 // {UNTIL - SINCE}, 39) AS INT) AS idx, count(*) AS n FROM s WHERE last_at BETWEEN {SINCE} AND {UNTIL} GROUP BY 1"


def activity_events(spark: SparkSession, sf: str) -> DataFrame:
    """F26 over the event stream's table: values by hour and type."""
    p = table(spark, sf, "events").select(F.floor(wall_us(F.col("ts")) / 1000).alias("ts"), F.col("event_type").alias("source"), "value")
    return activity.buckets(p, activity.HOUR, F.col("value")).withColumn("value", F.round("value", 4))


SQL["activity_events"] = "SELECT epoch_ms(ts) - epoch_ms(ts) % 3600000 AS bucket, event_type AS source, round(sum(value), 4) AS value FROM events GROUP BY 1, 2"

QUERIES = {
    f.__name__: f
    for f in (
        usage_report, usage_cost_by_event, usage_dedup_requests, usage_dedup_counts, usage_dedup_records, usage_cache_waste, usage_in_sessions, usage_cumulative, usage_fork_baseline, usage_residual,
        usage_volume_groups, usage_canonical_order, activity_buckets, activity_tokens, activity_regrid, activity_histogram, activity_events,
    )
}
