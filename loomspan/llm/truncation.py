"""Texts that aren't the whole of what was produced, and how often each source cuts.

Field limits show as lengths at which far more texts end than at the lengths
around. The hazard of a length is the share of a source's texts ending there
among those at least as long; it is tested against the hazards of neighbouring
lengths, with the false-discovery rate held by the Benjamini-Hochberg rule in
each source. Only the histogram of lengths is windowed, never the texts. A text of a
significant length is cut if its ending is incomplete there: all but the end of a
sentence or of an output, or with a note for a part left out. What no length can
show comes from the row itself: its own word, a note, or an ending that breaks off
anywhere, where signs that may close a text, and short remarks, are whole. Each row
is given the first reason that holds, so the share of each source of knowledge shows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspan.session import cut

# What notes for a part left out say.
_LEFT_OUT = r"(?:elided|omitted|truncated|not shown|skipped|removed|hidden|left out|clipped|snipped)"
_UNITS = r"(?:more |further |other )?(?:bytes|chars?|characters|lines|results|rows|matches|entries|tokens|words|items)"
NOTE = rf"(?i)(?:[\[<({{…]|\.\.\.|---?)\s*(?:\.\.\.|…)?\s*[\d,.]+ {_UNITS} {_LEFT_OUT}|(?:[\[<({{…]|\.\.\.)\s*{_LEFT_OUT}:? [\d,.]+ {_UNITS}"
SHORT = 60  # a remark without any sentence end, away from the lengths found, may be this long
TIMES = 8  # a significant length is a limit if so many times the texts end there that the lengths around lead to expect, though most run on past it


def incomplete_ending(text: Column) -> Column:
    """Whether a text breaks off: inside a character, or after a letter, digit or opening sign that ends no sentence, with or without a blank behind it.

    Short remarks without any sentence end or blank behind them are whole, as are
    outputs closed by an exit code, and texts that end in a closing sign or
    symbol. Null and blank texts don't break off.
    """
    r = F.regexp_replace(text, r"\s+$", "")
    tail = F.substring(r, -40, 40)
    last = tail.rlike(r"(?:[\p{L}\p{N}\p{M}]|[,:;/_(\[{<=+*\\&@#$%-])$")
    closed = tail.rlike(r"(?i)exit (?:code|status):? -?\d+$")
    structured = (F.length(r) < F.length(text)) | (F.length(r) >= SHORT) | r.rlike(r"[.?!]\s|[。！？].|\n")
    return F.coalesce(tail.endswith("�") | (last & ~closed & structured), F.lit(False))


def open_ending(text: Column) -> Column:
    """Whether a text doesn't end with a sentence or a closed output; the stricter measure for lengths at which texts are cut. A blank before the last sign, as in French, makes no difference."""
    ended = F.substring(text, -60, 60).rlike(r"[^\s.][.?!。！？…]$|[\p{L}\p{N}][ \u00a0\u202f]+[.?!]$|(?i)exit (?:code|status):? -?\d+$|</[A-Za-z_]+>$")
    return F.coalesce(~ended, F.lit(False))


def length_hazards(texts: DataFrame, width: int = 40, rate: float = 0.01) -> DataFrame:
    """(source, measure, len, n, hazard, times) of the significant lengths of texts (source, measure, len, mark).

    mark tells different texts apart; repeats of a text count once. width is the
    number of lengths to either side that a length is tested against, times how
    many times n is what those lead to expect, rate the
    false-discovery rate. All lengths are tested, and all different texts counted.
    """
    hist = texts.select("source", "measure", "len", "mark").distinct().groupBy("source", "measure", "len").agg(F.count("mark").alias("n"))
    own = Window.partitionBy("source", "measure")
    h = hist.withColumn("risk", F.sum("n").over(own.orderBy(F.desc("len"))))
    near = own.orderBy("len").rangeBetween(-width, width)
    around, risk = F.sum("n").over(near) - F.col("n"), F.max("risk").over(near)
    h = h.withColumn("expected", F.greatest(F.lit(0.5), F.col("risk") * around / (F.lit(2.0 * width) * risk)))
    # Chernoff's bound on the logarithm of the Poisson tail
    h = h.withColumn("log_p", F.when(F.col("n") > F.col("expected"), F.col("n") - F.col("expected") - F.col("n") * F.log(F.col("n") / F.col("expected"))).otherwise(F.lit(0.0)))
    h = h.withColumn("rank", F.row_number().over(own.orderBy("log_p", "len"))).withColumn("tests", F.count("*").over(own))
    h = h.withColumn("passes", F.col("log_p") <= F.log(F.lit(rate) * F.col("rank") / F.col("tests")))
    h = h.withColumn("up_to", F.max(F.when(F.col("passes"), F.col("rank"))).over(own))
    return h.where((F.col("rank") <= F.col("up_to"))).select("source", "measure", "len", "n", (F.col("n") / F.col("risk")).alias("hazard"), (F.col("n") / F.col("expected")).alias("times"))


def message_texts(session_message: DataFrame) -> DataFrame:
    """(table_name, row_id, source, text, says_cut) of session_message."""
    says = F.coalesce(F.col("truncated"), F.lit(False)) | F.coalesce(F.col("content_bytes") > F.octet_length("content"), F.lit(False))
    return session_message.select(F.lit("session_message").alias("table_name"), "row_id", "source", F.col("content").alias("text"), says.alias("says_cut"))


def step_texts(transcript: DataFrame) -> DataFrame:
    """(table_name, row_id, source, text, says_cut) of transcript, source being the step type, whose limits differ.

    A line that begins as an object and isn't whole JSON counts as cut; lines that never were JSON don't.
    """
    begun = F.coalesce(F.ltrim("raw").startswith("{"), F.lit(False))
    m = F.from_json("raw", "map<string,string>", {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false"})
    steps = transcript.where(begun).select("line_id", F.inline(F.array(F.struct(m.alias("m"), F.col("raw").rlike(r"\}\s*$").alias("closed")))))
    whole = F.col("m").isNotNull() & F.col("closed")
    named = F.try_element_at("m", F.lit("truncated_fields"))
    says = ~whole | F.coalesce(F.length(F.regexp_replace(named, r"[\[\]\s\"]|null", "")) > 0, F.lit(False))
    text = F.when(whole, F.try_element_at("m", F.lit("content")))
    return steps.select(F.lit("transcript").alias("table_name"), F.col("line_id").alias("row_id"), F.coalesce(F.when(whole, F.try_element_at("m", F.lit("type"))), F.lit("")).alias("source"), text.alias("text"), says.alias("says_cut"))


def judged(texts: DataFrame) -> DataFrame:
    """texts (table_name, row_id, source, text, says_cut) with reason: why the row counts as cut, or null.

    The reasons are limit, marked, noted and broken, the first that holds. Blank texts are whole. A row
    without source is tested together with the others without one.
    """
    chars, octets = F.length("text"), F.octet_length("text")
    facts = cut(
        texts.select(
            "table_name", "row_id", F.concat_ws("/", "table_name", "source").alias("source"), "says_cut", chars.alias("chars"), octets.alias("octets"), F.xxhash64("text").alias("mark"),
            F.coalesce(F.col("text").rlike(NOTE), F.lit(False)).alias("noted"), incomplete_ending(F.col("text")).alias("broken"), open_ending(F.col("text")).alias("open"), (F.col("text").isNotNull() & (F.trim("text") != "")).alias("filled"),
        )
    )
    tested = facts.where("filled").select("source", "mark", F.inline(F.array(F.struct(F.lit("chars").alias("measure"), F.col("chars").alias("len")), F.struct(F.lit("octets").alias("measure"), F.col("octets").alias("len")))))
    limits = cut(length_hazards(tested))
    # one row for each source: a source has few significant lengths, as each needs its own spike
    by_source = limits.groupBy("source").agg(
        F.collect_set(F.when((F.col("measure") == "chars") & (F.col("times") >= TIMES), F.col("len"))).alias("char_limits"),
        F.collect_set(F.when((F.col("measure") == "octets") & (F.col("times") >= TIMES), F.col("len"))).alias("octet_limits"),
    )
    j = facts.join(F.broadcast(by_source) if by_source.limit(10_001).count() <= 10_000 else by_source, "source", "left")
    # a limit in bytes that falls inside a character leaves up to three bytes unused
    inside = F.exists("octet_limits", lambda x: (x - F.col("octets")).between(1, 3)) & (F.col("octets") > F.col("chars"))
    at = F.array_contains("char_limits", F.col("chars")) | F.array_contains("octet_limits", F.col("octets")) | inside
    limit = F.coalesce(at, F.lit(False)) & F.col("filled") & (F.col("open") | F.col("noted"))
    reason = F.when(limit, "limit").when(F.col("says_cut"), "marked").when(F.col("noted"), "noted").when(F.col("broken"), "broken")
    return j.select("table_name", "row_id", "source", reason.alias("reason"))


def cut_rows(session_message: DataFrame, transcript: DataFrame) -> DataFrame:
    """(table_name, row_id) of the rows that aren't whole, each once."""
    both = message_texts(session_message).unionByName(step_texts(transcript))
    return judged(both).where("reason is not null").select("table_name", "row_id").distinct()


def cut_rates(session_message: DataFrame, transcript: DataFrame) -> DataFrame:
    """(source, rows, cut_rows, marked, noted, at_limit, broken) for each source of both tables."""
    both = judged(message_texts(session_message).unionByName(step_texts(transcript)))
    of = lambda r: F.sum(F.coalesce((F.col("reason") == r).cast("int"), F.lit(0)))
    return both.groupBy("source").agg(F.count("*").alias("rows"), F.count("reason").alias("cut_rows"), of("marked").alias("marked"), of("noted").alias("noted"), of("limit").alias("at_limit"), of("broken").alias("broken"))
