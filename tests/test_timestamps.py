import datetime as dt
from zoneinfo import ZoneInfo

import pytest

from loomspan.operators.timestamps import estimate_zones, foreign_stamps, normalised_stamps, parsed_stamps
from tests.conftest import omp_row

MACHINES = [("utc", "UTC", "ymd"), ("ber", "Europe/Berlin", "dmy"), ("nyc", "America/New_York", "mdy"), ("lost", None, None)]
STAMPS = "field string, row_id long, machine string, text string, seen long"


def ms(*a, zone="UTC", micro=0):
    return int(dt.datetime(*a, tzinfo=ZoneInfo(zone)).timestamp() * 1000) + micro


CASES = [
    ("utc", "2026-03-01T10:11:12.345678Z", ms(2026, 3, 1, 10, 11, 12) + 345), ("utc", "2026-03-01T10:11:12.9999999Z", ms(2026, 3, 1, 10, 11, 12) + 999), ("ber", "2026-03-01 10:11:12", ms(2026, 3, 1, 9, 11, 12)),
    ("ber", "2026-10-25 02:30:00", ms(2026, 10, 25, 0, 30)), ("ber", "2026-10-25T02:30:00+01:00[Europe/Berlin]", ms(2026, 10, 25, 1, 30)), ("nyc", "03/04/2026 05:06:07 PM", ms(2026, 3, 4, 22, 6, 7)),
    ("ber", "03/04/2026 05:06:07", ms(2026, 4, 3, 3, 6, 7)), ("ber", "03.04.2026 05:06:07", ms(2026, 4, 3, 3, 6, 7)), ("nyc", "12/31/2025 12:00:01 AM", ms(2025, 12, 31, 5, 0, 1)),
    ("utc", "1758411275404", 1758411275404), ("utc", "1758411275", 1758411275000), ("utc", "1758411275.404", 1758411275404), ("utc", "1.758411275404E12", 1758411275404), ("utc", "1758411275404123", 1758411275404),
    ("ber", "20260301T101112Z", ms(2026, 3, 1, 10, 11, 12)), ("utc", "Wed, 01 Jul 2026 18:09:02 +0200", ms(2026, 7, 1, 16, 9, 2)), ("utc", "01 Jul 2026 18:09:02 CEST", ms(2026, 7, 1, 16, 9, 2)),
    ("utc", "2026-07-01 18:09:02 Europe/Berlin", ms(2026, 7, 1, 16, 9, 2)), ("utc", "2026-07-01T18:09:02-0330", ms(2026, 7, 1, 21, 39, 2)),
]
NONE = ["", " ", "-", "n/a", "pending", "0", "17", "2026-13-01T00:00:00Z", "2026-02-30 10:00:00", "2026-03-01", "2026-03-01 10:00:00 Mars/Olympus", "x" * 200_000, "31/12/2025 25:00:00"]


@pytest.mark.parametrize("zone", ["UTC", "Asia/Tokyo"])
def test_forms(spark, zone):
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        rows = [("f", i, m, t, None) for i, (m, t, _) in enumerate(CASES)] + [("f", 1000 + i, "ber", t, None) for i, t in enumerate(NONE)] + [("f", 5000, "ber", None, None), ("f", 5001, "lost", "2026-03-01 10:11:12", None), ("f", 5002, None, "2026-03-01 10:11:12", None)]
        df = normalised_stamps(spark.createDataFrame(rows, STAMPS), spark.createDataFrame(MACHINES, "machine string, zone string, date_order string"))
        assert {r["row_id"]: r["utc_ms"] for r in df.collect()} == {i: want for i, (_, _, want) in enumerate(CASES)}
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_zone_of_an_undeclared_machine(spark):
    machines = spark.createDataFrame([("a", None, "ymd"), ("b", "UTC", "ymd")], "machine string, zone string, date_order string")
    rows = []
    for k in range(60):
        utc = dt.datetime(2026, 1 + k % 12, 3, 12, 0, tzinfo=dt.UTC)
        for m, z in (("a", "America/New_York"), ("b", "Asia/Tokyo")):
            rows.append(("f", len(rows), m, utc.astimezone(ZoneInfo(z)).strftime("%Y-%m-%d %H:%M:%S"), int(utc.timestamp() * 1e6) + 90_000_000))
    parsed = parsed_stamps(spark.createDataFrame(rows, STAMPS), machines)
    got = {r["machine"]: r for r in estimate_zones(parsed, machines, ["UTC", "Europe/Berlin", "America/New_York", "Asia/Tokyo"]).collect()}
    assert got["a"]["zone"] == "America/New_York" and got["a"]["violations"] == 0
    assert got["b"]["declared"] == "UTC" and got["b"]["zone"] == "Asia/Tokyo"


def test_zones_that_no_machine_declares(spark):
    """Every history of offsets is tried for a machine without a zone, and for one whose zone fits nothing; lags are held against those of stamps with a zone."""
    machines = spark.createDataFrame([("a", None, "ymd"), ("b", "UTC", "ymd"), ("c", "Europe/Berlin", "ymd")], "machine string, zone string, date_order string")
    true, rows = {"a": "Asia/Kathmandu", "b": "America/St_Johns", "c": "Europe/Berlin"}, []
    for k in range(120):
        utc = dt.datetime(2025, 1, 1, 12, 0, tzinfo=dt.UTC) + dt.timedelta(days=4 * k)
        seen = int(utc.timestamp() * 1e6) + 7_200_000_000
        rows += [("f", 3 * k + j, m, utc.astimezone(ZoneInfo(z)).strftime("%Y-%m-%d %H:%M:%S"), seen) for j, (m, z) in enumerate(true.items())]
        rows.append(("f", 1000 + k, "c", utc.strftime("%Y-%m-%dT%H:%M:%SZ"), seen))
    parsed = parsed_stamps(spark.createDataFrame(rows, STAMPS), machines).persist()
    got = {r["machine"]: r for r in estimate_zones(parsed, machines).collect()}
    days = [dt.datetime(2025, 1, 1) + dt.timedelta(days=d) for d in range(0, 480, 7)]
    for m, z in true.items():
        assert all(d.replace(tzinfo=ZoneInfo(got[m]["zone"])).utcoffset() == d.replace(tzinfo=ZoneInfo(z)).utcoffset() for d in days), (m, got[m])
    assert got["c"]["zone"] == "Europe/Berlin" and got["a"]["declared"] is None


def test_transcript_names_and_empty_tables(spark, omp):
    t = spark.createDataFrame(
        [(1, "p", 0, "ber", None, '{"created_at":1758411275404}'), (2, "p", 1, "ber", None, '{"time":"2026-03-01 10:11:12","step_index":5}'), (3, "p", 2, "ber", None, '{"created_at":"2026-03-01 10:11:1'), (4, "p", 3, "ber", None, None),
         (5, "p", 4, "ber", None, '{"created_at":null,"when":"1758411275404"}'), (6, "p", 5, "ber", None, '{"created_at":"2026-03-01T10:11:12.000Z"}')],
        "line_id long, source_path string, line_no int, machine string, written_at timestamp_ntz, raw string",
    )
    s = spark.createDataFrame([(9, "ber", "2026-03-01T10:11:12Z")], "row_id long, machine string, started_at string")
    m = spark.createDataFrame(MACHINES, "machine string, zone string, date_order string")
    got = {(r[0], r[1], r[2]) for r in foreign_stamps(spark, omp([omp_row(7, timestamp="1758411275", stamp="pending", machine="utc")]), t, s, m).collect()}
    assert got == {("transcript.created_at", 1, 1758411275404), ("transcript.created_at", 2, ms(2026, 3, 1, 9, 11, 12)), ("sessions.started_at", 9, ms(2026, 3, 1, 10, 11, 12)), ("omp.timestamp", 7, 1758411275000)}
    assert foreign_stamps(spark, omp([]), t.limit(0), s.limit(0), m.limit(0)).collect() == []
