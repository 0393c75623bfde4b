"""Message rows to ordered conversations with speakers.

Rows are an event log: a row creates a message, or edits, repeats, retries or
deletes one that another row brought. The events of a message are told by the
identifiers they share and fold, by version, into its final turn or into nothing.
The table is read once, into narrow events. The parent links of what is left are laid
out by ``hierarchy``, whose depth is the place in the line, so that no session
has to be gathered in one task. Whether a session is one line, and whether each
user row gets its reply, follows from counts over blocks of places.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspan.operators.hierarchy import hierarchy
from loomspan.operators.identifiers import identifier_array, superseded, versions
from loomspan.session import cut

# Spellings of the speakers, after lower-casing and dropping all but letters.
SPEAKERS = {
    "user": "user", "human": "user", "assistant": "assistant", "agent": "assistant", "model": "assistant", "ai": "assistant", "bot": "assistant",
    "tool": "tool", "toolresult": "tool", "tooloutput": "tool", "function": "tool", "system": "system", "developer": "system",
}
DELETING = ("delete", "deletion", "message_delete", "message_deleted", "tombstone")
LAST = 2**63 - 1  # the version of a deletion
BLOCK = 50_000
HOUR = 3_600_000


def speaker(role: Column) -> Column:
    known = F.create_map(*[x for k, v in SPEAKERS.items() for x in (F.lit(k), F.lit(v))])
    return F.try_element_at(known, F.regexp_replace(F.lower(role), "[^a-z]", ""))


def message_events(omp: DataFrame) -> DataFrame:
    """(rec_id, batch_id, session, id, parent, line_no, speaker, says, calls, deletes, output, idents) of omp rows.

    says: an item of text that isn't blank; calls: a toolCall item. session is
    null where it can't be told. output is the version of the event; that of a
    deletion is the last.
    """
    from_path = F.nullif(F.regexp_extract("source_path", r"_([^_/]+)\.jsonl$", 1), F.lit(""))
    item = F.coalesce(F.col("message.content"), F.array().cast(omp.schema["message"].dataType["content"].dataType))
    deletes = F.coalesce(F.col("type").isin(*DELETING), F.lit(False))
    return omp.select(
        "rec_id", "batch_id", F.coalesce("session_id", from_path).alias("session"), "id", F.col("parentid").alias("parent"), "line_no",
        F.when(F.col("type") == "message", speaker(F.col("message.role"))).alias("speaker"),
        F.exists(item, lambda x: F.coalesce((x["type"] == "text") & (F.trim(F.regexp_replace(x["text"], r"\s+", " ")) != ""), F.lit(False))).alias("says"),
        F.exists(item, lambda x: F.coalesce(x["type"] == "toolCall", F.lit(False))).alias("calls"),
        deletes.alias("deletes"), F.when(deletes, F.lit(LAST)).otherwise(F.col("message.usage.output")).alias("output"), identifier_array(omp).alias("idents"),
    )


def folded(events: DataFrame, shared: DataFrame) -> DataFrame:
    """The rows of the final version of each message; a message whose last version is a deletion has none, nor has a deletion of nothing."""
    return events.join(superseded(shared), "rec_id", "left_anti").where("not deletes").drop("deletes", "output", "idents")


def event_kinds(events: DataFrame, shared: DataFrame) -> DataFrame:
    """(rec_id, message, kind) of all events: create, the first row of a message; of the others delete, copy (the create's version), edit (another version under the create's id) or retry (under another id)."""
    told = events.select("rec_id", "id", "deletes", "output").join(shared.select("rec_id", "message"), "rec_id", "left").withColumn("message", F.coalesce("message", "rec_id"))
    creates = told.select(F.col("rec_id").alias("message"), F.col("id").alias("c_id"), F.col("output").alias("c_output"))
    kind = (
        F.when(F.col("deletes"), "delete").when(F.col("rec_id") == F.col("message"), "create")
        .when(F.col("output").eqNullSafe(F.col("c_output")), "copy").when(F.col("id").eqNullSafe(F.col("c_id")), "edit").otherwise("retry")
    )
    return told.join(creates, "message").select("rec_id", "message", kind.alias("kind"))


def event_counts(omp: DataFrame) -> DataFrame:
    """(kind, events) of the event log."""
    events = cut(message_events(omp))
    return event_kinds(events, versions(events)).groupBy("kind").agg(F.count("*").alias("events"))


def placed_rows(rows: DataFrame, session_message: DataFrame) -> DataFrame:
    """rows of the sessions that are one line, with ``place``, whose order within the session is the line's."""
    linked = rows.groupBy("session").agg(F.count("*").alias("n"), F.count("parent").alias("n_parents"))
    rows = cut(rows.join(linked, "session"))
    by_link = rows.where("n_parents > 0 or n = 1")
    key = lambda c: F.concat_ws("\x1f", "session", c)
    # a row without id can be no one's parent, so its own number serves as its node
    node = F.when(F.col("id").isNull(), F.concat(F.lit("\x1e"), F.col("rec_id"))).otherwise(F.col("id"))
    nodes = by_link.withColumn("node", key(node)).withColumn("up", F.when(F.col("parent").isNotNull(), key("parent")))
    depth = hierarchy(nodes, "node", "up", F.col("session"), F.col("line_no")).select("node", "depth")
    deep = cut(nodes.join(depth, "node").drop("node", "up"))
    lines = deep.groupBy("session").agg(
        F.max("n").alias("n"), F.count("*").alias("rows"), F.sum((F.col("depth") == 0).cast("int")).alias("tops"),
        F.sum(F.col("parent").isNull().cast("int")).alias("parentless"), F.min("depth").alias("low"), F.max("depth").alias("high"),
    )
    lines = lines.where("tops = 1 and parentless = 1 and low = 0 and high = n - 1 and rows = n").select("session")
    linear = deep.join(lines, "session").withColumn("place", F.col("depth").cast("bigint")).drop("depth")
    by_time = rows.where("n_parents = 0 and n > 1")
    times = session_message.where("source = 'omp' and ts > 0").groupBy(F.col("record_id").alias("id")).agg(F.min("ts").alias("place"))
    timed = cut(by_time.join(times, "id", "left"))
    unplaced = timed.where("place is null and speaker is not null").select("session")
    tied = timed.where("place is not null").groupBy("session", "place").count().where("count > 1").select("session")
    timed = timed.join(unplaced.unionByName(tied).distinct(), "session", "left_anti").where("place is not null")
    return linear.withColumn("block", F.floor(F.col("place") / BLOCK)).unionByName(timed.withColumn("block", F.floor(F.col("place") / HOUR)), allowMissingColumns=True)


def conversations(omp: DataFrame, session_message: DataFrame) -> DataFrame:
    """(session_id, turn_no, id, speaker) of the conversations to keep.

    A session is dropped if its rows, each message in its final version, aren't one line by their
    parents; if no user or assistant row says anything; or if a user row gets no
    reply before the next user row or the end. Sessions without any parent are
    ordered by session_message.ts; they count as broken if a row with a speaker has
    no time or two rows share one. Rows without a speaker hold their place but are
    no turn; a turn whose row has no id is counted and left out, as it can't be
    named. Null messages and contents say nothing. Empty tables give no turns.
    """
    events = cut(message_events(omp))
    rows = placed_rows(folded(events, versions(events)).where("session is not null"), session_message).where("speaker is not null")
    rows = cut(rows.select("session", "block", "place", "id", "speaker", "says", "calls"))
    mark = F.when(F.col("speaker") == "user", "U").when((F.col("speaker") == "assistant") & (F.col("says") | F.col("calls")), "R")
    marks = rows.select("session", "block", "place", mark.alias("mark")).where("mark is not null")
    within = Window.partitionBy("session", "block").orderBy("place")
    after = marks.withColumn("next", F.lead("mark").over(within))
    unanswered = after.where("mark = 'U' and next = 'U'").select("session")
    ends = marks.groupBy("session", "block").agg(F.min_by("mark", "place").alias("first"), F.max_by("mark", "place").alias("last"))
    blocks = Window.partitionBy("session").orderBy("block")
    open_ends = ends.withColumn("next", F.lead("first").over(blocks)).where("last = 'U' and (next is null or next = 'U')").select("session")
    speaking = rows.where("says and speaker in ('user', 'assistant')").select("session").distinct()
    good = speaking.join(unanswered.unionByName(open_ends).distinct(), "session", "left_anti")
    rows = rows.join(good, "session")
    counts = rows.groupBy("session", "block").count()
    before = counts.select("session", "block", (F.sum("count").over(blocks) - F.col("count")).alias("before"))
    numbered = rows.withColumn("at", F.row_number().over(within)).join(before, ["session", "block"])
    return numbered.where("id is not null").select(F.col("session").alias("session_id"), (F.col("before") + F.col("at")).cast("int").alias("turn_no"), "id", "speaker")
