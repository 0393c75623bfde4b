"""Stamps in many written forms to UTC, with the zones of local clocks estimated from the data.

Stamps without a zone are aligned with the time their row was taken in. A
histogram of (machine, local day, lag) is all that the estimate needs: for each
machine and candidate zone it counts the rows that would have been taken in
before they were written, or long after, and how far their lags are from those of
stamps that have a zone. The zone's whole offset history counts, as the lag is
judged for each day. The declared zone of a machine is one of the candidates and
stays unless another explains the data clearly better; where none is declared, or
none fits, every history of offsets that some zone has is tried.
"""

from __future__ import annotations

from collections.abc import Iterable
from datetime import datetime, timedelta
from zoneinfo import ZoneInfo, ZoneInfoNotFoundError

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.functions.stamps import PLAIN, clock_parts, region_ids, resolve_clock, stamp_parts, to_utc_us, wall_us
from loomspan.session import cut

STEP_FIELDS = ["step_index", "source", "type", "status", "created_at", "content", "thinking", "tool_calls", "truncated_fields"]
QUARTER = 900_000_000
DAY = 86_400_000_000


def parsed_stamps(stamps: DataFrame, machines: DataFrame) -> DataFrame:
    """stamps (field, row_id, machine, text, seen) with utc_us, local_us and zone; see ``stamp_parts``."""
    regions = region_ids(stamps.sparkSession)
    own = machines.select("machine", "date_order").groupBy("machine").agg(F.first("date_order").alias("date_order"))
    rows = stamps.join(F.broadcast(own) if _small(own) else own, "machine", "left")
    own_columns = ["field", "row_id", "machine", "text", "seen"]
    # inline of one struct keeps the optimizer from copying an expression into each place that uses it
    split = rows.select(*own_columns, F.inline(F.array(stamp_parts(F.col("text"), F.col("date_order")))))
    clock = split.select(*own_columns, F.inline(F.array(clock_parts(F.struct("p", "epoch"), regions))))
    return clock.select(*own_columns, F.inline(F.array(resolve_clock(F.struct("epoch", "local", "offset", "region", "unknown")))))


def _small(df: DataFrame, rows: int = 10_000) -> bool:
    return len(df.limit(rows + 1).take(rows + 1)) <= rows


def distinct_zones(regions: Iterable[str], first: datetime, last: datetime, prefer: Iterable[str] = ()) -> list[str]:
    """One zone for each history of offsets that some zone has between two days; preferred zones stand for theirs."""
    days = [first + timedelta(days=7 * k) for k in range((last - first).days // 7 + 2)]
    found: dict[tuple, str] = {}
    for z in [*sorted(prefer), *sorted(regions)]:
        try:
            own = ZoneInfo(z)
        except (ValueError, OSError, ZoneInfoNotFoundError):
            continue
        found.setdefault(tuple(d.replace(tzinfo=own).utcoffset() for d in days), z)
    return sorted(found.values())


def _scores(hist: DataFrame, zones: list[str], typical: int, late: float) -> DataFrame:
    """(machine, zone, rows, violations, spread) of each zone for each machine of a histogram (machine, quarter, lag, count)."""
    each = hist.withColumn("zone", F.explode(F.array(*[F.lit(z) for z in zones]).cast("array<string>")))
    start = F.col("quarter") * QUARTER
    lag = F.col("lag") * QUARTER + start - to_utc_us(start, F.col("zone"))
    broken = (lag < -QUARTER) | (lag > late * QUARTER)
    return each.groupBy("machine", "zone").agg(F.sum("count").alias("rows"), F.sum(F.when(broken, F.col("count")).otherwise(0)).alias("violations"), F.sum(F.abs(lag / QUARTER - typical) * F.col("count")).alias("spread"))


def estimate_zones(parsed: DataFrame, machines: DataFrame, candidates: list[str] | None = None, late_hours: float | None = None, doubt: float = 0.02) -> DataFrame:
    """(machine, declared, zone, violations, declared_violations, rows): the zone to read each machine's local stamps in.

    A zone is judged by the stamps that would have been taken in before they were
    written or long after, and then by how far their lag is from that of stamps with
    a zone of their own. candidates: the zones to try; by default those that machines
    declare, and for machines that none of these fits in all but a share of
    ``doubt``, or that declare none, one zone for each history of offsets there
    is. Machines without usable rows keep what they declare, and get null if that
    is missing. late_hours: a row taken in so much later than written counts against a
    zone; by default later than all but a thousandth of the stamps with a zone are,
    or 24 hours if there are none.
    """
    spark = parsed.sparkSession
    regions = set(region_ids(spark))
    declared = machines.select("machine", F.when(F.col("zone").isin(sorted(regions)), F.col("zone")).alias("declared")).groupBy("machine").agg(F.first("declared").alias("declared"))
    zones = candidates or sorted(r[0] for r in declared.select("declared").distinct().collect() if r[0])
    hist = cut(
        parsed.where("local_us is not null and zone is null and seen is not null").groupBy(
            "machine", F.floor(F.col("local_us") / QUARTER).alias("quarter"), F.floor((F.col("seen") - F.col("local_us")) / QUARTER).alias("lag")
        ).count()
    )
    lags = parsed.where("utc_us is not null and seen is not null").agg(F.percentile_approx(F.floor((F.col("seen") - F.col("utc_us")) / QUARTER), [0.5, 0.999])).first()[0]
    typical, high = lags or (0, None)
    late = late_hours * 4 if late_hours is not None else 96 if high is None else high + 1
    score = _scores(hist, zones, typical, late)
    if candidates is None:
        ends = hist.agg(F.min("quarter"), F.max("quarter")).first()
        best = score.groupBy("machine").agg((F.min("violations") > doubt * F.max("rows")).alias("bad"))
        known = declared.where("declared is not null").select("machine", F.lit(True).alias("known"))
        doubted = hist.select("machine").distinct().join(best, "machine", "left").join(known, "machine", "left").where("coalesce(bad, true) or known is null").select("machine")
        open_hist = hist.join(doubted, "machine", "left_semi")
        if ends[0] is not None and open_hist.take(1):
            day = lambda q: datetime(1970, 1, 1) + timedelta(microseconds=q * QUARTER)
            more = [z for z in distinct_zones(regions, day(ends[0]), day(ends[1]), zones) if z not in zones]
            score = score.unionByName(_scores(open_hist, more, typical, late))
    score = score.join(declared, "machine", "full_outer")
    best = score.groupBy("machine").agg(
        F.first("declared").alias("declared"), F.max("rows").alias("rows"),
        F.min(F.struct("violations", "spread", "zone")).alias("best"), F.min(F.when(F.col("zone") == F.col("declared"), F.col("violations"))).alias("declared_violations"),
    )
    clearly = (F.col("declared_violations") > 2 * F.col("best.violations")) & (F.col("declared_violations") - F.col("best.violations") > 0.25 * F.col("rows"))
    zone = F.when(F.col("declared").isNull() | F.coalesce(clearly, F.lit(False)), F.col("best.zone")).otherwise(F.col("declared"))
    return best.select("machine", "declared", zone.alias("zone"), F.col("best.violations").alias("violations"), "declared_violations", "rows")


def normalised_stamps(stamps: DataFrame, machines: DataFrame) -> DataFrame:
    """(field, row_id, text, utc_ms) of every stamp that denotes an instant.

    A stamp without zone is local time of the row's machine. Null, blank and
    damaged stamps give no row, nor do local ones of a machine whose zone is
    neither declared nor to be estimated. Repeated rows stay repeated.
    """
    parsed = cut(parsed_stamps(stamps, machines))
    zones = estimate_zones(parsed, machines).select("machine", F.col("zone").alias("machine_zone"))
    zones = cut(zones)
    j = parsed.join(F.broadcast(zones) if _small(zones) else zones, "machine", "left")
    utc = F.coalesce("utc_us", to_utc_us(F.col("local_us"), F.coalesce("zone", "machine_zone")))
    return j.select("field", "row_id", "text", F.floor(utc / 1000).cast("bigint").alias("utc_ms")).where("utc_ms is not null")


def transcript_stamp(raw_map: F.Column) -> F.Column:
    """A step's stamp from its top-level values: created_at, else the first unknown field that looks like a stamp."""
    others = F.map_filter(raw_map, lambda k, v: ~k.isin(STEP_FIELDS) & v.rlike(r"^\s*(\d{9,}|\d+\.\d+([eE]\+?\d+)?|\d{1,4}[-/.]\d{1,2}[-/.]\d{1,4}[ T,].*|\d{8}T\d{6}.*|([A-Za-z]{3,9},? )?\d{1,2} [A-Za-z]{3,9} \d{4} .*)\s*$"))
    first = F.map_values(others)
    return F.when(F.array_contains(F.map_keys(raw_map), "created_at"), F.try_element_at(raw_map, F.lit("created_at"))).when(F.size(first) > 0, first[0])


def transcript_stamps(spark: SparkSession, omp: DataFrame, transcript: DataFrame, sessions: DataFrame) -> DataFrame:
    """All stamps of the transcript store as (field, row_id, machine, text, seen), seen being the microsecond at which the row was taken in."""
    whole = F.col("raw").rlike(r"(?s)^\s*\{.*\}\s*$")
    steps = transcript.where(whole).select("line_id", "machine", "written_at", F.from_json("raw", "map<string,string>", {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false"}).alias("m"))
    return (
        omp.select(F.explode(F.array(F.struct(F.lit("omp.timestamp").alias("field"), F.col("timestamp").alias("text")), F.struct(F.lit("omp.message.timestamp").alias("field"), F.col("message.timestamp").alias("text")))).alias("s"), F.col("rec_id").alias("row_id"), "machine", wall_us(F.col("received_at")).alias("seen"))
        .select("s.field", "row_id", "machine", "s.text", "seen")
        .unionByName(steps.where("m is not null").select(F.lit("transcript.created_at").alias("field"), F.col("line_id").alias("row_id"), "machine", transcript_stamp(F.col("m")).alias("text"), wall_us(F.col("written_at")).alias("seen")))
        .unionByName(sessions.select(F.lit("sessions.started_at").alias("field"), "row_id", "machine", F.col("started_at").alias("text"), F.lit(None).cast("bigint").alias("seen")))
        .where("text is not null")
    )


def foreign_stamps(spark: SparkSession, omp: DataFrame, transcript: DataFrame, sessions: DataFrame, machines: DataFrame) -> DataFrame:
    """(field, row_id, utc_ms) of the stamps that denote an instant and aren't written as yyyy-MM-ddTHH:mm:ss.SSSZ already."""
    stamps = transcript_stamps(spark, omp, transcript, sessions).where(~F.col("text").rlike(PLAIN))
    return normalised_stamps(stamps, machines).select("field", "row_id", "utc_ms").distinct()
