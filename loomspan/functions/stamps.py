"""Reading written time stamps with built-in expressions only."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# Zone abbreviations and their offsets in minutes.
ABBREVIATIONS = {
    "Z": 0, "UTC": 0, "GMT": 0, "WET": 0, "WEST": 60, "BST": 60, "CET": 60, "CEST": 120, "EET": 120, "EEST": 180, "MSK": 180, "IST": 330, "JST": 540, "KST": 540,
    "AEST": 600, "AEDT": 660, "ACST": 570, "ACDT": 630, "AWST": 480, "NZST": 720, "NZDT": 780, "EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "MST": -420,
    "MDT": -360, "PST": -480, "PDT": -420, "BRT": -180, "BRST": -120, "ART": -180, "HST": -600, "AKST": -540, "AKDT": -480,
}
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]

_ZONE = r"\s*(Z|[A-Za-z]{2,5}|[A-Za-z]+(?:/[A-Za-z0-9_+-]+)+|[+-]\d\d(?::?\d\d)?)?(?:\[[\w/+-]+\])?"
ISO = r"^(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})[Tt ](\d{1,2}):(\d\d)(?::(\d\d)(?:[.,](\d+))?)?" + _ZONE + "$"
COMPACT = r"^(\d{4})(\d\d)(\d\d)[Tt]?(\d\d)(\d\d)(\d\d)(?:[.,](\d+))?" + _ZONE + "$"
DIGITS = r"^(\d{1,2})[-/.](\d{1,2})[-/.](\d{4}),? (\d{1,2}):(\d\d)(?::(\d\d)(?:[.,](\d+))?)?(?: ?([AaPp][Mm])\b)?" + _ZONE + "$"
NAMED = r"^(?:[A-Za-z]{3,9},? )?(\d{1,2})[ -]([A-Za-z]{3})[A-Za-z]*[ -](\d{4}) (\d{1,2}):(\d\d)(?::(\d\d)(?:[.,](\d+))?)?" + _ZONE + "$"
NUMBER = r"^\d+(?:\.\d+)?(?:[eE]\+?\d+)?$"
PLAIN = r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d\.\d{3}Z$"


def region_ids(spark: SparkSession) -> list[str]:
    """The zone ids that this JVM knows; others would end a job."""
    return sorted(x for x in spark.sparkContext._jvm.java.time.ZoneId.getAvailableZoneIds())


def stamp_parts(text: Column, date_order: Column) -> Column:
    """struct(p, epoch): the pieces of a written stamp (year to zone), or the microseconds that a number stands for.

    Both are null where the text denotes no instant: null, blank, words, a
    number below 100,000,000, dates that don't exist, dates without a time.
    Numbers count as seconds, milli-, micro- or nanoseconds by their size.
    date_order (ymd, dmy, mdy) tells how a date like 03/04/2026 is meant; an
    unknown order counts as dmy.
    """
    s = F.trim(text)
    mdy = F.coalesce(date_order, F.lit("dmy")) == "mdy"
    month = F.concat_ws("", *[F.when(F.lower(F.regexp_extract(s, NAMED, 2)) == m, F.lit(str(i + 1))) for i, m in enumerate(MONTHS)])
    number = s.rlike(NUMBER) & ~s.rlike(r"^\d{14}$")
    flat = (
        F.when(number, F.lit(None).cast("string"))
        .when(s.rlike(ISO), F.regexp_replace(s, ISO, "$1|$2|$3|$4|$5|$6|$7||$8"))
        .when(s.rlike(DIGITS), F.when(mdy, F.regexp_replace(s, DIGITS, "$3|$1|$2|$4|$5|$6|$7|$8|$9")).otherwise(F.regexp_replace(s, DIGITS, "$3|$2|$1|$4|$5|$6|$7|$8|$9")))
        .when(s.rlike(NAMED), F.concat(F.regexp_replace(s, NAMED, "$3|"), month, F.regexp_replace(s, NAMED, "|$1|$4|$5|$6|$7||$8")))
        .when(s.rlike(COMPACT), F.regexp_replace(s, COMPACT, "$1|$2|$3|$4|$5|$6|$7||$8"))
    )
    value = F.when(number, s).try_cast("decimal(38,9)")
    unit = F.when(value < 100_000_000, None).when(value < 10**11, 1_000_000).when(value < 10**14, 1000).when(value < 10**17, 1)
    epoch = F.when(value < 10**17, F.floor(value * unit)).otherwise(F.floor(value / 1000)).cast("bigint")
    return F.struct(F.split(flat, r"\|", -1).alias("p"), epoch.alias("epoch"))


def clock_parts(parts: Column, regions: list[str]) -> Column:
    """struct(epoch, local, offset, region, unknown) of what ``stamp_parts`` gave: the clock time in microseconds and its zone, in minutes or as an id."""
    p = parts["p"]
    num = lambda i: F.nullif(p[i], F.lit("")).try_cast("int")
    hour = F.when(p[7] == "", num(3)).when(num(3).between(1, 12), num(3) % 12 + F.when(F.lower(p[7]) == "pm", 12).otherwise(0))
    made = F.try_make_timestamp(num(0), num(1), num(2), hour, num(4), F.coalesce(num(5), F.lit(0)).cast("decimal(8,6)"), F.lit("UTC"))
    fraction = F.rpad(F.substring(p[6], 1, 6), 6, "0").try_cast("bigint")
    zone = F.nullif(p[8], F.lit(""))
    digits = F.regexp_replace(zone, r"[^\d]", "")
    minutes = F.substring(digits, 1, 2).try_cast("int") * 60 + F.coalesce(F.substring(digits, 3, 2).try_cast("int"), F.lit(0))
    offset = F.when(zone.rlike(r"^[+-]\d"), F.when(zone.startswith("-"), -minutes).otherwise(minutes))
    known = F.create_map(*[x for k, v in ABBREVIATIONS.items() for x in (F.lit(k), F.lit(v))])
    region = F.when(zone.isin(regions), zone)
    offset = F.coalesce(offset, F.try_element_at(known, F.upper(zone)))
    return F.struct(
        parts["epoch"].alias("epoch"), (F.unix_micros(made) + F.coalesce(fraction, F.lit(0))).alias("local"), offset.cast("bigint").alias("offset"), region.alias("region"), zone.isNotNull().alias("unknown")
    )


def resolve_clock(c: Column) -> Column:
    """struct(utc_us, local_us, zone): the instant where the text fixes it, else the local time with the zone id if it names one; an unknown zone word denotes no instant."""
    utc = F.coalesce(c["epoch"], c["local"] - c["offset"] * 60_000_000)
    readable = ~c["unknown"] | c["region"].isNotNull()
    return F.struct(utc.alias("utc_us"), F.when(utc.isNull() & readable, c["local"]).alias("local_us"), F.when(utc.isNull(), c["region"]).alias("zone"))


def to_utc_us(local_us: Column, zone: Column) -> Column:
    """A local time as UTC; of two instants with that local time the earlier, and a skipped one moves on by the gap."""
    return F.unix_micros(F.to_utc_timestamp(F.timestamp_micros(local_us), zone))


def wall_us(stamp: Column) -> Column:
    """A stamp column of UTC wall time in microseconds since 1970, whatever the session's time zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), stamp.cast("timestamp_ntz"))
