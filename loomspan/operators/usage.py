"""Token usage: buckets, deduplication, cost from a given rate table, cache waste, reports.

Rates are input, never part of the library: (provider, model, input, cache_read,
cache_write, output) in billionths of a dollar for a million tokens.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = ["raw_input", "uncached_input", "cache_read", "cache_write", "output"]
ALL_BUCKETS = [*BUCKETS, "cache_write_1h", "reasoning"]
BY_SESSION = ("opencode",)
NOISE_FLOOR = 1024
TTL_MS = 300_000


def subset_buckets(input_: Column, cached: Column, output: Column) -> Column:
    """Buckets of a provider whose input includes the cached part."""
    read = F.least(cached, input_)
    return F.struct(input_.alias("raw_input"), (input_ - read).alias("uncached_input"), read.alias("cache_read"), F.lit(0).cast("bigint").alias("cache_write"), output.alias("output"))


def disjoint_buckets(input_: Column, read: Column, write: Column, output: Column) -> Column:
    """Buckets of a provider that counts each token once."""
    return F.struct(input_.alias("raw_input"), input_.alias("uncached_input"), read.alias("cache_read"), write.alias("cache_write"), output.alias("output"))


def total() -> Column:
    return F.col("uncached_input") + F.col("cache_read") + F.col("cache_write") + F.col("output")


def within(since: int | None, until: int | None) -> Column:
    """since counts, until doesn't."""
    t = F.col("timestamp_ms")
    return (F.lit(True) if since is None else t >= since) & (F.lit(True) if until is None else t < until)


def project_matches(column: Column, wanted: str) -> Column:
    """The same name whatever its case, or a path that ends in it."""
    return (F.lower(column) == wanted.lower()) | F.lower(column).endswith("/" + wanted.lower())


def keep_best_request(events: DataFrame) -> DataFrame:
    """One event for each (message_id, request_id), then no sidechain event whose message another event has outside of one.

    Of equals the main chain comes first, then paths outside of subagents, the
    larger total, and the later source_order, the earlier row at last. Events
    without message or request id stay in the first step.
    """
    complete = F.col("message_id").isNotNull() & F.col("request_id").isNotNull()
    key = F.when(complete, F.concat_ws("\x1f", "message_id", "request_id")).otherwise(F.concat(F.lit("\x1e"), F.col("row_idx")))
    first = Window.partitionBy("source", "_key").orderBy("sidechain", F.col("source_path").contains("/subagents/"), F.desc(total()), F.desc("source_order"), "row_idx")
    once = events.withColumn("_key", key).withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n", "_key")
    main = once.where("not sidechain and message_id is not null").select("source", "message_id").distinct()
    side = once.where("sidechain and message_id is not null").join(main, ["source", "message_id"], "left_anti")
    return once.where("not sidechain or message_id is null").unionByName(side.select(once.columns))


def keep_first(events: DataFrame, keys: list[str], required: list[str]) -> DataFrame:
    """The first event of each combination of keys by order of arrival; events in which a required key is null all stay."""
    known = F.lit(True)
    for k in required:
        known = known & F.col(k).isNotNull()
    w = Window.partitionBy(*keys).orderBy("timestamp_ms", "source_path", "source_order", "row_idx")
    first = events.where(known).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    return first.unionByName(events.where(~known))


def reconcile(events: DataFrame) -> DataFrame:
    """events without those that a source wrote more than once, each source by its own rule; sources without a rule keep all.

    claude: one for each request. codex: the first of each record with equal
    counts in all buckets there are. cursor: the first of
    each record with equal input and output. copilot and
    opencode: the first of each record.
    """
    of = lambda *s: events.where(F.col("source").isin(*s))
    counts = [c for c in ALL_BUCKETS if c in events.columns]
    parts = [
        keep_best_request(of("claude")), keep_first(of("codex"), ["session_id", "source_record_id", *counts], ["session_id", "source_record_id"]),
        keep_first(of("cursor"), ["source_record_id", "raw_input", "output"], ["source_record_id"]), keep_first(of("copilot", "opencode"), ["source", "source_record_id"], ["source_record_id"]),
        events.where(~F.coalesce(F.col("source").isin("claude", "codex", "cursor", "copilot", "opencode"), F.lit(False))),
    ]
    return reduce(DataFrame.unionByName, [p.select(events.columns) for p in parts])


def with_rates(events: DataFrame, rates: DataFrame) -> DataFrame:
    """events with r_input and so on where the table has the model; a dated snapshot has the rates of its model, an event without provider those of any."""
    base = F.regexp_replace(F.lower(F.trim("model")), r"-20[0-9-]*$", "")
    names = ("input", "cache_read", "cache_write", "output")
    r = rates.groupBy(F.lower("model").alias("_base"), F.lower("provider").alias("provider")).agg(*[F.min(c).alias(c) for c in names])
    # a model has few providers; the longest name that fits an event's provider is the closest
    offers = F.sort_array(F.collect_list(F.struct((-F.length("provider")).alias("rank"), "provider", *names)))
    j = events.withColumn("_base", base).join(r.groupBy("_base").agg(offers.alias("_offers")), "_base", "left")
    fit = F.get(F.filter("_offers", lambda o: F.col("provider").isNull() | F.lower("provider").contains(o["provider"])), F.lit(0))
    return j.select(*events.columns, *[fit[c].alias(f"r_{c}") for c in names])


def cost_nanos() -> Column:
    """Billionths of a dollar, rounded down for each event; null where rates are unknown. Exact in decimals."""
    part = lambda tokens, rate: F.col(tokens).cast("decimal(19,0)") * F.col(rate).cast("decimal(18,0)")
    whole = part("uncached_input", "r_input") + part("cache_read", "r_cache_read") + part("cache_write", "r_cache_write") + part("output", "r_output")
    return F.floor(whole / F.lit(1_000_000).cast("decimal(10,0)")).cast("bigint")


def report(events: DataFrame) -> DataFrame:
    """Totals by source; with cost_nanos, priced events and the known cost too."""
    return events.groupBy("source").agg(
        F.count("*").alias("events"), *[F.sum(c).alias(c) for c in BUCKETS], F.sum(total()).alias("tokens"), F.count_if(F.col("model").isNull()).alias("unknown_model"),
        F.count("cost_nanos").alias("priced"), F.count_if(F.col("cost_nanos").isNull()).alias("unpriced"), F.sum("cost_nanos").alias("cost_nanos"),
    )


def cache_misses(events: DataFrame) -> DataFrame:
    """The events whose prompt should have been cached and wasn't, with ``missed`` tokens and the reason (switch, idle, other).

    Chains are the events of a session's file in order of time, and of the whole
    session where the source writes a file for each message (``BY_SESSION``). Sidechains and
    events without session are no part of them; chain_break events start a new
    segment; events without a prompt are passed over. A prompt under half of the
    one before starts anew without a miss.
    """
    prompt = F.col("uncached_input") + F.col("cache_read") + F.col("cache_write")
    chain = Window.partitionBy("source", "session_id", "_stream").orderBy("timestamp_ms", "source_order", "row_idx")
    stream = F.when(~F.col("source").isin(*BY_SESSION), F.col("source_path")).otherwise("")
    e = events.where("not sidechain and session_id is not null").withColumn("_stream", stream).withColumn("_seg", F.sum(F.col("chain_break").cast("int")).over(chain))
    e = e.where("not chain_break").withColumn("_prompt", prompt).where("_prompt > 0")
    seg = Window.partitionBy("source", "session_id", "_stream", "_seg").orderBy("timestamp_ms", "source_order", "row_idx")
    model = F.struct(F.coalesce("provider", F.lit("")), F.coalesce("model", F.lit("")))
    e = e.withColumn("_model", model).select(
        "*", F.lag("_prompt").over(seg).alias("_before"), F.lag("_model").over(seg).alias("_model_before"), F.lag("timestamp_ms").over(seg).alias("_ts_before"),
        F.max((F.col("cache_read") + F.col("cache_write") > 0).cast("int")).over(seg.rowsBetween(Window.unboundedPreceding, -1)).alias("_reported"),
    )
    missed = F.greatest(F.lit(0), F.least("_before", "_prompt") - F.col("cache_read"))
    hit = F.col("_before").isNotNull() & ((F.col("cache_read") > 0) | (F.col("_reported") == 1)) & (F.col("_prompt") * 2 >= F.col("_before")) & (missed > NOISE_FLOOR)
    why = F.when(F.col("_model") != F.col("_model_before"), "switch").when(F.col("timestamp_ms") - F.col("_ts_before") >= TTL_MS, "idle").otherwise("other")
    return e.where(hit).select(*events.columns, missed.alias("missed"), why.alias("why"))


def cumulative_deltas(snapshots: DataFrame, keys: list[str], order: list[str], counters: list[str]) -> DataFrame:
    """Counters that only grow, as what each snapshot adds: the part above the running maximum so far. Repeated and out-of-date snapshots add nothing."""
    before = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return snapshots.select("*", *[F.greatest(F.lit(0), F.col(c) - F.coalesce(F.max(c).over(before), F.lit(0))).alias(f"{c}_delta") for c in counters])


def inherited_baseline(forks: DataFrame, snapshots: DataFrame, counters: list[str]) -> DataFrame:
    """forks (child, parent, fork_ts) with each counter's maximum in the parent's snapshots (session_id, timestamp_ms) at or before the fork; 0 without any."""
    s = snapshots.select(F.col("session_id").alias("parent"), "timestamp_ms", *counters)
    j = forks.join(s, (forks["parent"] == s["parent"]) & (s["timestamp_ms"] <= forks["fork_ts"]), "left").drop(s["parent"])
    return j.groupBy("child", "parent", "fork_ts").agg(*[F.coalesce(F.max(c), F.lit(0)).alias(c) for c in counters])


def residual(rows: DataFrame, totals: DataFrame, key: str, order: list[str], counter: str) -> DataFrame:
    """rows capped in order so that together they don't exceed the key's total, and one more row (``is_residual``) for what they leave of it."""
    before = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    t = totals.select(key, F.col(counter).alias("_total"))
    j = rows.join(t, key).withColumn("_before", F.coalesce(F.sum(counter).over(before), F.lit(0)))
    used = j.withColumn("used", F.greatest(F.lit(0), F.least(F.col(counter), F.col("_total") - F.col("_before"))))
    left = used.groupBy(key).agg(F.sum("used").alias("_sum"))
    rest = t.join(left, key, "left").select(key, (F.col("_total") - F.coalesce("_sum", F.lit(0))).alias("used"), F.lit(True).alias("is_residual")).where("used > 0")
    return used.select(key, *order, "used", F.lit(False).alias("is_residual")).unionByName(rest, allowMissingColumns=True)
