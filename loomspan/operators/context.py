"""Neighbourhoods, pages and reading budgets over ordered sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SCOPE = ["source", "session_id", "source_path"]
ORDER = ["turn_id", "ts", "doc_id"]


def ordered(records: DataFrame) -> DataFrame:
    """records with ``pos`` from 0 in session order, and the session's ``total``."""
    w = Window.partitionBy(*SCOPE).orderBy(*ORDER)
    return records.withColumn("pos", F.row_number().over(w) - 1).withColumn("total", F.count("*").over(Window.partitionBy(*SCOPE)))


def neighbourhood(records: DataFrame, anchors: DataFrame, before: int = 5, after: int = 5) -> DataFrame:
    """The records around each anchor (doc_id): anchor, doc_id, distance, which is negative before the anchor. More than 1,000 either way are an error."""
    if not (0 <= before <= 1000 and 0 <= after <= 1000):
        raise ValueError("a context has at most 1,000 records either way")
    # only the sessions that have an anchor are put in order
    scopes = records.join(anchors.select(F.col("doc_id").alias("anchor")), F.col("doc_id") == F.col("anchor")).select("anchor", *SCOPE)
    o = ordered(records.join(scopes.select(*SCOPE).distinct(), SCOPE, "left_semi"))
    at = scopes.join(o.select(*SCOPE, F.col("doc_id").alias("anchor"), F.col("pos").alias("anchor_pos")), [*SCOPE, "anchor"])
    near = o.join(at, SCOPE).withColumn("distance", F.col("pos") - F.col("anchor_pos"))
    return near.where(F.col("distance").between(-before, after))


def with_interactions(near: DataFrame, records: DataFrame, link: str) -> DataFrame:
    """(anchor, doc_id) of a neighbourhood and of the records outside that share a link value with it in the same session."""
    inside = near.select("anchor", *SCOPE, link).where(F.col(link).isNotNull()).distinct()
    more = records.select(*SCOPE, link, "doc_id").join(inside, [*SCOPE, link]).select("anchor", "doc_id")
    return near.select("anchor", "doc_id").unionByName(more).distinct()


def pages_around(records: DataFrame, anchors: DataFrame, limit: int) -> DataFrame:
    """For each anchor (doc_id) a page of ``limit`` records with the anchor in the middle where the session allows, its offset and the session's total."""
    o = ordered(records)
    a = o.join(anchors.select("doc_id"), "doc_id", "left_semi").select(*SCOPE, F.col("doc_id").alias("anchor"), F.col("pos").alias("at"), "total")
    first = F.least(F.col("at"), F.lit(limit // 2))
    behind = F.least(F.col("total") - F.col("at"), limit - first)
    ahead = F.least(F.col("at"), limit - behind)
    a = a.select(*SCOPE, "anchor", (F.col("at") - ahead).alias("offset"), (ahead + behind).alias("n"))
    return o.join(a, SCOPE).where((F.col("pos") >= F.col("offset")) & (F.col("pos") < F.col("offset") + F.col("n"))).select("anchor", "doc_id", "pos", "offset", "total")


def pages(records: DataFrame, requests: DataFrame) -> DataFrame:
    """The pages of requests (request_id, scope, offset, limit): request_id, doc_id, pos, total. A request for more than 500 rows is an error."""
    limit = F.when(F.col("limit") > 500, F.raise_error(F.lit("a page has at most 500 records"))).otherwise(F.col("limit"))
    o = ordered(records.join(requests.select(*SCOPE).distinct(), SCOPE, "left_semi"))
    return o.join(requests, SCOPE).where((F.col("pos") >= F.col("offset")) & (F.col("pos") < F.col("offset") + limit)).select("request_id", "doc_id", "pos", "total")


def without_repeats(records: DataFrame, text: Column) -> DataFrame:
    """records without those that say the same as the one before in their session, by role and text with white space evened out."""
    said = F.concat_ws("\x1f", "role", F.trim(F.regexp_replace(text, r"\s+", " ")))
    w = Window.partitionBy(*SCOPE).orderBy(*ORDER)
    return records.withColumn("_said", said).withColumn("_before", F.lag("_said").over(w)).where(~F.col("_said").eqNullSafe(F.col("_before"))).drop("_said", "_before")


def last_user_turns(records: DataFrame, n: int) -> DataFrame:
    """Each session from its n-th last user record on."""
    back = Window.partitionBy(*SCOPE).orderBy(*[F.desc(c) for c in ORDER])
    left = F.sum((F.col("role") == "user").cast("int")).over(back.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return records.withColumn("_left", left).where((F.col("_left") < n) | ((F.col("_left") == n) & (F.col("role") == "user"))).drop("_left")


def budgeted(records: DataFrame, budget: int) -> DataFrame:
    """Texts of a session in order until ``budget`` characters are used: shown, next_offset (where to go on; null if all was shown). What comes after the budget shows nothing and goes on at 0."""
    w = Window.partitionBy(*SCOPE).orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, -1)
    n = F.length("text")
    room = F.greatest(F.lit(0), budget - F.coalesce(F.sum(n).over(w), F.lit(0)))
    r = records.withColumn("_room", room)
    shown = F.substring(F.col("text"), F.lit(1), F.col("_room").cast("int"))
    return r.withColumn("shown", shown).withColumn("next_offset", F.when(n > F.col("_room"), F.col("_room"))).drop("_room")


def collapse_exchanges(records: DataFrame, least: int = 3) -> DataFrame:
    """(doc_id, repeats) of the records that stay when a pair of records that follows itself ``least`` times or more is kept once; repeats says how often the pair that a record ends comes again, for a note in its place.

    A record repeats if it says what the record two before says; runs of such
    records are islands, so no session is gathered beyond its ordered window.
    """
    w = Window.partitionBy(*SCOPE).orderBy(*ORDER)
    r = records.withColumn("_said", F.concat_ws("\x1f", "role", "text")).withColumn("_n", F.row_number().over(w))
    r = r.withColumn("_again", F.coalesce(F.lag("_said", 2).over(w) == F.col("_said"), F.lit(False)))
    r = r.withColumn("_run", F.sum((~F.col("_again")).cast("int")).over(w))
    runs = r.where("_again").groupBy(*SCOPE, "_run").agg(F.min("_n").alias("_first"), F.count("*").alias("_length")).where(F.col("_length") >= 2 * (least - 1))
    runs = runs.select(*SCOPE, "_run", "_first", (F.col("_length") - F.col("_length") % 2).alias("_drop"))
    gone = (F.col("_n") >= F.col("_first")) & (F.col("_n") < F.col("_first") + F.col("_drop"))
    repeats = F.when(F.col("_n") == F.col("_first") - 1, (F.col("_drop") / 2).cast("bigint"))
    return r.join(runs, [*SCOPE, "_run"], "left").where(~F.coalesce(gone, F.lit(False))).select("doc_id", F.coalesce(repeats, F.lit(0)).alias("repeats"))
