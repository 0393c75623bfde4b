import json
import os
import time

from pyspark.sql import functions as F

from loomspan.sources import logs
from loomspan.streaming.ingest import LISTING, DeliverOnce, Store, changes, list_files, read_facts, refresh, refresh_lines, refresh_usage, stream_files, windowed_counts
from tests.conftest import OMP, item, omp_row


def test_changes(spark):
    before = [("same", 1, 1, "h", 1), ("grown", 1, 1, "h", 1), ("other", 1, 1, "h", 1), ("gone", 1, 1, "h", 1), ("parser", 1, 1, "h", 1), ("shorter", 5, 1, "h", 1)]
    now = [("same", 1, 1, "h", 1), ("grown", 2, 2, "h", 1), ("other", 2, 2, "x", 1), ("parser", 1, 1, "h", 2), ("shorter", 4, 2, "h", 1), ("new", 1, 1, "h", 1)]
    got = {r[0]: r[1] for r in changes(spark.createDataFrame(now, LISTING), spark.createDataFrame(before, LISTING)).collect()}
    assert got == {"same": "unchanged", "grown": "appended", "other": "replaced", "gone": "gone", "parser": "parser_changed", "shorter": "replaced", "new": "new"}


def test_refresh_reads_changed_files_alone(spark, tmp_path):
    src, store = tmp_path / "logs", Store(spark, str(tmp_path / "store"))
    src.mkdir()
    line = lambda t: json.dumps({"type": "user", "sessionId": "s", "message": {"content": t}}) + "\n"
    (src / "a.jsonl").write_text(line("one"))
    (src / "b.jsonl").write_text(line("two"))
    asked = []

    def parse(paths):
        asked.append(sorted(os.path.basename(r[0]) for r in paths.collect()))
        return logs.records(logs.read_lines(spark, [str(src)]).join(paths, "source_path", "left_semi")).select("source_path", "text")

    run = lambda: refresh(store, list_files(spark, [str(src)], "*.jsonl"), parse, "source_path string, text string")
    assert run() == "publish" and run() == "unchanged"
    first = store.current
    (src / "a.jsonl").write_text(line("one") + line("more"))
    (src / "b.jsonl").unlink()
    (src / "c.jsonl").write_text(line("three"))
    assert run() == "publish" and asked == [["a.jsonl", "b.jsonl"], ["a.jsonl", "c.jsonl"]]
    assert sorted(r["text"] for r in store.read("records").collect()) == ["more", "one", "three"]
    store.compact("records")
    assert store.read("records").count() == 3 and store.read("files").count() == 2
    assert first in store.collect_garbage() and store.read("records").count() == 3


def test_each_message_once_over_batches(spark, omp, tmp_path):
    src = tmp_path / "in"
    for k, rows in enumerate([[omp_row(1, id="a"), omp_row(2, id="a"), omp_row(3, id="b")], [omp_row(4, id="b"), omp_row(5, id="c", items=[item("toolCall", id="t")]), omp_row(6, message=False)], [omp_row(7, items=[item("toolCall", id="t")]), omp_row(8, id="d")]]):
        omp(rows).coalesce(1).write.parquet(f"{src}/part{k}")
        time.sleep(0.05)
    target = DeliverOnce(spark, str(tmp_path / "out"), str(tmp_path / "index"), merge_every=2)
    q = stream_files(spark, str(src), OMP, target, str(tmp_path / "cp"), files=1)
    q.awaitTermination(120)
    kept = sorted(r["rec_id"] for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert q.exception() is None and kept == [1, 3, 5, 6, 8] and len(target.index.runs()) < 3


def test_a_batch_delivered_again_changes_nothing(spark, omp, tmp_path):
    out, index = str(tmp_path / "out"), str(tmp_path / "index")
    kept = lambda: sorted(r["rec_id"] for r in spark.read.parquet(out).collect())
    one, two = omp([omp_row(1, id="a"), omp_row(2, id="b")]), omp([omp_row(3, id="b"), omp_row(4, id="c")])
    DeliverOnce(spark, out, index)(one, 0)
    DeliverOnce(spark, out, index)(one, 0)
    assert kept() == [1, 2]
    for _ in range(2):
        DeliverOnce(spark, out, index)(two, 1)
        assert kept() == [1, 2, 4]
    DeliverOnce(spark, out, index)(omp([omp_row(5, id="a"), omp_row(6, id="d")]), 2)
    assert kept() == [1, 2, 4, 6]


def test_grown_files_are_read_from_where_they_ended(spark, tmp_path):
    src, store = tmp_path / "logs", Store(spark, str(tmp_path / "store"))
    src.mkdir()
    (src / "a.jsonl").write_bytes(b"one\ntwo\nthr")
    (src / "b.jsonl").write_bytes(b"x\n")
    asked = []

    def parse(lines):
        asked.append(sorted(r["raw"] for r in lines.collect()))
        return lines

    run = lambda: refresh_lines(store, list_files(spark, [str(src)], head_bytes=8), parse, "source_path string, line_no bigint, offset bigint, raw string")
    assert run() == "publish" and run() == "unchanged"
    (src / "a.jsonl").write_bytes(b"one\ntwo\nthree\nfour\n")
    (src / "b.jsonl").write_bytes(b"y\nz\n")
    assert run() == "publish"
    assert asked == [["one", "two", "x"], ["four", "three", "y", "z"]]
    got = sorted((r["line_no"], r["offset"], r["raw"]) for r in store.read("records").where("source_path like '%a.jsonl'").collect())
    assert got == [(0, 0, "one"), (1, 4, "two"), (2, 8, "three"), (3, 14, "four")]
    assert store.read("records").count() == 6


def test_usage_facts_are_kept(spark, tmp_path):
    """Facts of unchanged files are neither read nor written again; an equal listing ends at once."""
    store, schema = Store(spark, str(tmp_path / "store")), "source string, source_path string, timestamp_ms long, source_order long, row_idx long, output long"
    made = {"/a": 10, "/b": 20}
    asked = []

    def parse(paths):
        own = sorted(r[0] for r in paths.collect())
        asked.append(own)
        return spark.createDataFrame([("pi", p, made[p], 0, 0, made[p]) for p in own], schema)

    def listing(**sizes):
        return spark.createDataFrame([(f"/{k}", v, v, "h", 1) for k, v in sizes.items()], LISTING)

    run = lambda **sizes: refresh_usage(store, listing(**sizes), parse)
    assert run(a=1, b=1) == "publish" and run(b=1, a=1) == "unchanged"
    made["/b"] = 25
    assert run(a=1, b=2) == "publish" and asked == [["/a", "/b"], ["/b"]]
    assert [r["output"] for r in read_facts(store, schema).collect()] == [10, 25] and [r["output"] for r in read_facts(store, schema, 11, 26, "pi").collect()] == [25]
    assert run(b=2) == "publish" and [r["output"] for r in read_facts(store, schema).collect()] == [25]


def test_recovery_and_leases(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    rows = lambda *x: spark.createDataFrame([(v,) for v in x], "source_path string")
    first = store.publish({"records": rows("a")})
    held, give_back = store.lease()
    store.publish({"records": rows("b")})
    assert store.collect_garbage() == [] and [r[0] for r in store.read("records", manifest=held).collect()] == ["a"]
    give_back()
    assert store.collect_garbage() == [first]
    (tmp_path / "store" / "INTENT").write_text("gen-x")
    (tmp_path / "store" / "gen-x").mkdir()
    assert store.recover() == "gen-x" and not (tmp_path / "store" / "gen-x").exists() and store.recover() is None


def test_windowed_counts(spark, tmp_path):
    rows = [(f"2026-01-01 0{h}:10:00", "a") for h in range(4)] * 2
    spark.createDataFrame(rows, "t string, k string").select(F.to_timestamp("t").alias("t"), "k").write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema("t timestamp, k string").parquet(str(tmp_path / "in"))
    q = windowed_counts(s, "t", "k").writeStream.outputMode("complete").format("memory").queryName("windowed").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r["n"] for r in spark.table("windowed").collect()) == [2, 2, 2, 2]
