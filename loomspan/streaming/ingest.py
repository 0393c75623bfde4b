"""Incremental building of the engine's tables.

A table is a list of segments, and a manifest names the current ones. A refresh
compares the files that are there with those of the last one, reads the changed
ones alone (of grown ones what was added), writes their records as one new
segment, and publishes by putting one manifest in place of the other, so a crash
leaves the old state and a repeated run does the same again. Records of files
that changed or are gone are left out by their path when the table is read, until
``compact`` writes it anew.
"""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loomspan.operators import usage
from loomspan.operators.identifiers import IdentifierIndex, message_identifiers
from loomspan.operators.prepare import listing_fingerprint
from loomspan.session import delete_path, list_names, read_text, ship, write_text

LISTING = "source_path string, size bigint, mtime bigint, head string, parser int"
LINES = "source_path string, line_no bigint, offset bigint, raw string"


def _open(path: str) -> pa.NativeFile:
    fs, at = pafs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))
    return fs.open_input_file(at)


def _heads(head_bytes: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            heads = []
            for path in b["source_path"].to_pylist():
                with _open(path) as f:
                    heads.append(hashlib.sha256(f.read(head_bytes)).hexdigest())
            yield pa.RecordBatch.from_arrays([b["source_path"], b["size"], b["mtime"], pa.array(heads, pa.string()), b["parser"]], names=[c.split()[0] for c in LISTING.split(", ")])

    return run


def list_files(spark: SparkSession, roots: list[str], glob: str = "*", head_bytes: int = 4096, parser: int = 1) -> DataFrame:
    """(source_path, size, mtime, head, parser) of the files below the roots; head is a hash of their first bytes, and no more than those are read."""
    ship(spark)
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(roots)
    return f.select(F.col("path").alias("source_path"), F.col("length").alias("size"), F.unix_micros("modificationTime").alias("mtime"), F.lit(parser).alias("parser")).mapInArrow(_heads(head_bytes), LISTING)


def _tail_lines(chunk: int = 1 << 20) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in LINES.split(", ")]
        for b in batches:
            for path, at, n in zip(b["source_path"].to_pylist(), b["offset"].to_pylist(), b["lines"].to_pylist(), strict=True):
                with _open(path) as f:
                    f.seek(at)
                    rest = b""
                    while got := f.read(chunk):
                        *lines, rest = (rest + got).split(b"\n")
                        offsets = []
                        for x in lines:
                            offsets.append(at)
                            at += len(x) + 1
                        numbers = range(n, n + len(lines))
                        n += len(lines)
                        yield pa.RecordBatch.from_arrays([pa.array([path] * len(lines), pa.string()), pa.array(numbers, pa.int64()), pa.array(offsets, pa.int64()), pa.array([x.decode(errors="replace") for x in lines], pa.string())], names=names)

    return run


def read_tails(paths: DataFrame) -> DataFrame:
    """(source_path, line_no, offset, raw) of the whole lines of files (source_path, offset, lines) from an offset on.

    lines is the number of lines before the offset. What follows the last line
    end is a torn line and not read; ``resume_points`` says where to go on.
    """
    ship(paths.sparkSession)
    return paths.select("source_path", F.col("offset").cast("bigint").alias("offset"), F.col("lines").cast("bigint").alias("lines")).mapInArrow(_tail_lines(), LINES)


def resume_points(paths: DataFrame, tails: DataFrame) -> DataFrame:
    """(source_path, offset, lines) for the next ``read_tails``: behind the last whole line."""
    last = tails.groupBy("source_path").agg(F.max_by(F.col("offset") + F.octet_length("raw") + 1, "line_no").alias("to"), (F.max("line_no") + 1).alias("n"))
    return paths.join(last, "source_path", "left").select("source_path", F.coalesce("to", "offset").alias("offset"), F.coalesce("n", "lines").alias("lines"))


def changes(now: DataFrame, before: DataFrame) -> DataFrame:
    """(source_path, change) by a full outer join: new, unchanged, appended, replaced, parser_changed or gone."""
    n = now.select("source_path", F.struct("size", "mtime", "head", "parser").alias("n"))
    b = before.select("source_path", F.struct("size", "mtime", "head", "parser").alias("b"))
    j = n.join(b, "source_path", "full_outer")
    c = F.col
    change = (
        F.when(c("n").isNull(), "gone").when(c("b").isNull(), "new").when(c("n.parser") != c("b.parser"), "parser_changed")
        .when((c("n.size") == c("b.size")) & (c("n.mtime") == c("b.mtime")), "unchanged").when((c("n.size") > c("b.size")) & (c("n.head") == c("b.head")), "appended").otherwise("replaced")
    )
    return j.select("source_path", change.alias("change"))


def decision(changed: DataFrame) -> str:
    """unchanged or publish."""
    kinds = {r["change"] for r in changed.select("change").distinct().collect()}
    return "publish" if kinds - {"unchanged"} else "unchanged"


class Store:
    """Tables of segments under a folder of any file system that all executors reach; one writer at a time.

    The file INTENT names a generation while it is being written; ``recover``
    removes what a crash left of it. Readers that need more than one look at the
    same state hold a lease, which keeps its segments from ``collect_garbage``.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    @property
    def manifest(self) -> dict:
        text = read_text(self.spark, f"{self.path}/CURRENT")
        return json.loads(text) if text else {"generation": None, "tables": {}, "gone": {}}

    @property
    def current(self) -> str | None:
        return self.manifest["generation"]

    def read(self, table: str, schema: str | None = None, manifest: dict | None = None) -> DataFrame:
        m = manifest or self.manifest
        segments = m["tables"].get(table)
        if not segments:
            if schema is None:
                raise FileNotFoundError(table)
            return self.spark.createDataFrame([], schema)
        gone = m["gone"].get(table, [])
        if not gone:
            return self.spark.read.parquet(*[f"{self.path}/{s}" for s in segments])
        parts = [self.spark.read.parquet(f"{self.path}/{s}").withColumn("_segment", F.lit(k)) for k, s in enumerate(segments)]
        lost = [self.spark.read.parquet(f"{self.path}/{g}").withColumn("_upto", F.lit(n)) for g, n in gone]
        rows, paths = parts[0], lost[0]
        for x in parts[1:]:
            rows = rows.unionByName(x)
        for x in lost[1:]:
            paths = paths.unionByName(x)
        paths = paths.groupBy("source_path").agg(F.max("_upto").alias("_upto"))
        return rows.join(paths, "source_path", "left").where(F.col("_upto").isNull() | (F.col("_segment") >= F.col("_upto"))).select(*[c for c in rows.columns if c != "_segment"])

    def _commit(self, write: Callable[[str, dict], None]) -> str:
        m, g = self.manifest, f"gen-{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
        write_text(self.spark, f"{self.path}/INTENT", g)
        write(g, m)
        m["generation"] = g
        write_text(self.spark, f"{self.path}/CURRENT", json.dumps(m))
        delete_path(self.spark, f"{self.path}/INTENT")
        return g

    def publish(self, tables: dict[str, DataFrame], partition_by: dict[str, str] | None = None, more: dict[str, DataFrame] | None = None, gone: dict[str, DataFrame] | None = None, told: dict[str, str] | None = None) -> str:
        """Write tables anew, and of ``more`` one segment each beside those there; ``gone`` names the source_paths whose older rows no longer count; ``told`` goes into the manifest. All of it shows at once."""

        def write(g: str, m: dict) -> None:
            for name, df in tables.items():
                w = df.write.mode("overwrite")
                (w.partitionBy(partition_by[name]) if partition_by and name in partition_by else w).parquet(f"{self.path}/{g}/{name}")
                m["tables"][name], m["gone"][name] = [f"{g}/{name}"], []
            for name, df in (gone or {}).items():
                df.select("source_path").distinct().write.mode("overwrite").parquet(f"{self.path}/{g}/gone-{name}")
                m["gone"].setdefault(name, []).append([f"{g}/gone-{name}", len(m["tables"].get(name, []))])
            for name, df in (more or {}).items():
                df.write.mode("overwrite").parquet(f"{self.path}/{g}/{name}")
                m["tables"].setdefault(name, []).append(f"{g}/{name}")
            m |= told or {}

        return self._commit(write)

    def recover(self) -> str | None:
        """Remove what an interrupted publication left; the name of its generation, or None."""
        g = read_text(self.spark, f"{self.path}/INTENT")
        if g is None:
            return None
        if not any(s.startswith(f"{g}/") for own in self.manifest["tables"].values() for s in own):
            delete_path(self.spark, f"{self.path}/{g}")
        delete_path(self.spark, f"{self.path}/INTENT")
        return g

    def lease(self) -> tuple[dict, Callable[[], None]]:
        """The current manifest for several reads, and a function that gives it back."""
        m, name = self.manifest, f"LEASE-{uuid.uuid4().hex}"
        write_text(self.spark, f"{self.path}/{name}", json.dumps(m))
        return m, lambda: delete_path(self.spark, f"{self.path}/{name}")

    def collect_garbage(self, keep: int = 1) -> list[str]:
        """Remove generations that neither the current manifest nor a lease needs, but the ``keep`` - 1 latest of them."""
        names = list_names(self.spark, self.path)
        held = [self.manifest, *(json.loads(read_text(self.spark, f"{self.path}/{n}") or "{}") for n in names if n.startswith("LEASE-") and not n.endswith(".crc"))]
        used = {s.split("/")[0] for m in held for s in [*(x for own in m.get("tables", {}).values() for x in own), *(x[0] for own in m.get("gone", {}).values() for x in own)]}
        old = sorted((d for d in names if d.startswith("gen-") and d not in used), reverse=True)[max(0, keep - 1) :]
        for d in old:
            delete_path(self.spark, f"{self.path}/{d}")
        return old

    def compact(self, table: str, rows_per_file: int = 1_000_000, least: int = 2) -> bool:
        """Write a table of at least ``least`` segments as one, without the rows that no longer count."""
        if len(self.manifest["tables"].get(table, [])) < least:
            return False
        df = self.read(table)
        self.publish({table: df.repartition(max(1, -(-df.count() // rows_per_file)))})
        return True


def refresh(store: Store, listing: DataFrame, parse: Callable[[DataFrame], DataFrame], record_schema: str, compact_from: int = 16) -> str:
    """Bring store up to date with listing; parse makes records (with source_path) from a frame of paths. Returns what was done.

    The records of changed files become a new segment; the others are neither
    read nor written. From ``compact_from`` segments on the table is written anew.
    """
    store.recover()
    before = store.read("files", LISTING)
    changed = changes(listing, before).persist()
    try:
        what = decision(changed)
        if what == "publish":
            stale = changed.where("change not in ('unchanged', 'new')").select("source_path")
            new = parse(changed.where("change not in ('unchanged', 'gone')").select("source_path"))
            gone = {"records": stale} if store.manifest["tables"].get("records") else {}
            store.publish({"files": listing}, more={"records": new}, gone=gone)
            store.compact("records", least=compact_from)
        return what
    finally:
        changed.unpersist()


def refresh_usage(store: Store, listing: DataFrame, parse: Callable[[DataFrame], DataFrame]) -> str:
    """``refresh`` for usage facts (with source_path), kept in the table ``facts``; a fingerprint of the listing shows with them, and an equal one ends the refresh at once."""
    store.recover()
    own = listing_fingerprint(listing)
    before = store.manifest.get("fingerprint")
    if own == before:
        return "unchanged"
    changed = changes(listing, store.read("files", LISTING)).persist()
    try:
        stale = changed.where("change not in ('unchanged', 'new')").select("source_path")
        new = parse(changed.where("change not in ('unchanged', 'gone')").select("source_path"))
        gone = {"facts": stale} if store.manifest["tables"].get("facts") else {}
        store.publish({"files": listing}, more={"facts": new}, gone=gone, told={"fingerprint": own})
        store.compact("facts", least=16)
        return "publish"
    finally:
        changed.unpersist()


def read_facts(store: Store, fact_schema: str, since: int | None = None, until: int | None = None, source: str | None = None) -> DataFrame:
    """The kept facts of a source and time (since counts, until doesn't) in the order of reports; the filters reach the scan."""
    f = store.read("facts", fact_schema).where(usage.within(since, until))
    f = f if source is None else f.where(F.col("source") == source)
    return f.orderBy("timestamp_ms", "source_path", "source_order", "row_idx")


def refresh_lines(store: Store, listing: DataFrame, parse: Callable[[DataFrame], DataFrame], record_schema: str) -> str:
    """``refresh`` for logs whose lines are records of their own: of a grown file the added lines alone are read.

    parse makes records from (source_path, line_no, offset, raw). Where each file
    is to go on is kept in the table ``resume``; a torn last line is read once its
    end is there.
    """
    store.recover()
    changed = changes(listing, store.read("files", LISTING)).persist()
    try:
        what = decision(changed)
        if what == "publish":
            points = store.read("resume", "source_path string, offset bigint, lines bigint")
            start = changed.where("change not in ('unchanged', 'gone')").join(points, "source_path", "left")
            grown = F.col("change") == "appended"
            start = start.select("source_path", F.when(grown, F.coalesce("offset", F.lit(0))).otherwise(F.lit(0)).alias("offset"), F.when(grown, F.coalesce("lines", F.lit(0))).otherwise(F.lit(0)).alias("lines"))
            tails = read_tails(start).persist()
            stale = changed.where("change in ('replaced', 'parser_changed', 'gone')").select("source_path")
            gone = {"records": stale} if store.manifest["tables"].get("records") else {}
            kept = points.join(changed.where("change <> 'unchanged'").select("source_path"), "source_path", "left_anti")
            store.publish({"files": listing, "resume": kept.unionByName(resume_points(start, tails))}, more={"records": parse(tails)}, gone=gone)
            tails.unpersist()
        return what
    finally:
        changed.unpersist()


def stream_files(spark: SparkSession, path: str, schema: str, batch: Callable[[DataFrame, int], None], checkpoint: str, files: int = 1000) -> StreamingQuery:
    """New files of a folder as micro-batches, all that are there, then stop; ``files`` bounds a batch."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).option("recursiveFileLookup", "true").parquet(path)
    return rows.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class DeliverOnce:
    """A foreachBatch target: appends the rows of a batch that bring a message not seen before, by the identifier index.

    Each batch writes a folder and an index run named by its number, and is looked
    up in the runs of the batches before it alone. So a batch delivered again, also
    to a new instance after a crash, replaces what it wrote by the same. Of the rows
    of a message within a batch the first stays; rows without identifier all stay.
    Later copies that carry more are the business of ``redundant_rows``, which sees
    all rows. Batch numbers must grow, as those of a streaming query do.
    """

    def __init__(self, spark: SparkSession, out: str, index: str, per_prefix: int = 50_000, merge_every: int = 8):
        self.out, self.index = out, IdentifierIndex(spark, index, per_prefix, merge_every)

    def __call__(self, rows: DataFrame, batch_id: int) -> None:
        rows = rows.persist()
        tagged = message_identifiers(rows)
        novel = self.index.add(tagged, batch_id)
        found = tagged.join(novel, "ident", "left")
        known = found.where("first_row is null or rec_id <> first_row").select("rec_id").distinct()
        rows.join(known, "rec_id", "left_anti").write.mode("overwrite").parquet(f"{self.out}/batch={batch_id}")
        rows.unpersist()


def windowed_counts(stream: DataFrame, time: str, key: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts by window and key of a stream; rows later than ``late`` are left out. An addition: the engine itself has no event-time windows."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width), key).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), key, "n")
