"""Exactly one copy of each message that was delivered at least once.

Identifiers seen so far lie in immutable runs. A run holds, for each hash
prefix, one sorted array of identifiers with the row that brought each first.
Prefixes don't depend on each other, so all batches of a table go through the
index in one pass: each prefix takes its batches in order, a load of small
batches at a time, removes repeats within the load, looks the rest up in its
runs by binary search, links known identifiers to their first row, makes a run
of the novel ones, and merges its runs periodically. Repeats inside an Arrow
batch are linked before the shuffle, so an identifier that a third of all rows
carry reaches its prefix once for each such batch. Only rows that share
something give links, and only those go through the component search.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.session import Scratch, cut, delete_path, list_names

RUN = "prefix int, h array<bigint>, ident array<string>, first_row array<bigint>, first_output array<bigint>"
LINK = "rec_id long, output long, first_row long, first_output long"
LOCAL = f"ident string, batch_id long, {LINK}"
UNKNOWN = -(2**63)  # an output that isn't given, less than any number
LOAD = 4096
MERGE_EVERY = 8
_RUN_NAME = re.compile(r"run-(\d+)-(\d+)-(\d+)$")


def identifier_array(rows: DataFrame) -> Column:
    """The identifiers of a row: its id if it isn't null, message.id and the ids of toolCall items if they aren't blank. Null messages, contents and items carry none."""
    content = F.coalesce(F.col("message.content"), F.array().cast(rows.schema["message"].dataType["content"].dataType))
    calls = F.filter(content, lambda x: (x["type"] == "toolCall") & (F.trim(x["id"]) != ""))
    idents = F.concat(
        F.array(
            F.concat(F.lit("r:"), F.col("id")),
            F.when(F.trim(F.col("message.id")) != "", F.concat(F.lit("m:"), F.col("message.id"))),
        ),
        F.transform(calls, lambda x: F.concat(F.lit("c:"), x["id"])),
    )
    return F.array_distinct(F.filter(idents, lambda x: x.isNotNull()))


def tagged_rows(rows: DataFrame) -> DataFrame:
    """(rec_id, output, batch_id, idents) of omp rows."""
    return rows.select("rec_id", F.col("message.usage.output").alias("output"), "batch_id", identifier_array(rows).alias("idents"))


def message_identifiers(rows: DataFrame) -> DataFrame:
    """(rec_id, output, batch_id, ident) for each identifier that a row carries; rows without any give no row."""
    return tagged_rows(rows).select("rec_id", "output", "batch_id", F.explode("idents").alias("ident"))


class Runs:
    """The runs of one prefix while its loads come in, newest last."""

    def __init__(self) -> None:
        self.runs: list[tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]] = []

    def find(self, h: np.ndarray, ident: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Whether each identifier is known, its first row and that row's output, by binary search in each run; equal hashes are told apart by the identifier itself."""
        known, first, output = np.zeros(len(h), bool), np.zeros(len(h), np.int64), np.zeros(len(h), np.int64)
        for sorted_h, names, rows, outputs in self.runs:
            at = np.searchsorted(sorted_h, h)
            left = np.flatnonzero((at < len(sorted_h)) & ~known)
            while len(left):
                left = left[sorted_h[at[left]] == h[left]]
                if not len(left):
                    break
                same = pc.equal(ident.take(pa.array(left)), names.take(pa.array(at[left]))).to_numpy(zero_copy_only=False)
                hit = left[same]
                known[hit], first[hit], output[hit] = True, rows[at[hit]], outputs[at[hit]]
                left = left[~same]
                at[left] += 1
                left = left[at[left] < len(sorted_h)]
        return known, first, output

    def add(self, h: np.ndarray, ident: pa.Array, rows: np.ndarray, outputs: np.ndarray) -> None:
        if len(h):
            self.runs.append((h, ident, rows, outputs))
        if len(self.runs) >= MERGE_EVERY:
            self.merge()

    def merge(self) -> None:
        if len(self.runs) > 1:
            h = np.concatenate([r[0] for r in self.runs])
            order = np.argsort(h, kind="stable")
            ident = pa.concat_arrays([r[1] for r in self.runs]).take(pa.array(order))
            self.runs = [(h[order], ident, *(np.concatenate([r[k] for r in self.runs])[order] for k in (2, 3)))]


def _firsts(key: np.ndarray, *order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions of the first row of each key, for each position that of its key's first) by the given order."""
    by = np.lexsort((*order[::-1], key))
    new = np.r_[True, key[by][1:] != key[by][:-1]] if len(by) else np.zeros(0, bool)
    first = by[new]
    of = np.empty(len(by), np.int64)
    of[by] = first[np.cumsum(new) - 1] if len(by) else first
    return first, of


def _local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each identifier of an Arrow batch, by its earliest row, and links of the other rows to that."""
    names = [c.split()[0] for c in LOCAL.split(", ")]
    for b in batches:
        of = pc.list_parent_indices(b["idents"]).to_numpy()
        ident = pc.list_flatten(b["idents"])
        rec, batch, out = (b[c].to_numpy()[of] for c in ("rec_id", "batch_id", "output"))
        first, head = _firsts(ident.dictionary_encode().indices.to_numpy(), batch, rec)
        nothing = np.full(len(first), 0)
        seen = [ident.take(pa.array(first)), *(pa.array(x) for x in (batch[first], rec[first], out[first], nothing, nothing))]
        yield pa.RecordBatch.from_arrays(seen, names=names)
        more = np.flatnonzero(rec != rec[head])
        if len(more):
            links = [pa.nulls(len(more), pa.string()), *(pa.array(x) for x in (batch[more], rec[more], out[more], rec[head[more]], out[head[more]]))]
            yield pa.RecordBatch.from_arrays(links, names=names)


_OUT = pa.schema([("rec_id", pa.int64()), ("output", pa.int64()), ("first_row", pa.int64()), ("first_output", pa.int64()), ("prefix", pa.int32()), *((n, pa.list_(t)) for n, t in (("h", pa.int64()), ("ident", pa.string()), ("rows", pa.int64()), ("outputs", pa.int64())))])
_INDEXED = f"{LINK}, prefix int, h array<bigint>, ident array<string>, rows array<bigint>, outputs array<bigint>"


def _links(*columns: np.ndarray) -> pa.RecordBatch:
    n = len(columns[0])
    return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns), *(pa.nulls(n, t.type) for t in list(_OUT)[4:])], schema=_OUT)


def _take_in(prefix: int, t: pa.Table, load: int) -> Iterator[pa.RecordBatch]:
    """The links of one prefix whose rows (h, ident, batch_id, rec_id, output) come in order of batch, and its merged run."""
    runs, batch, ident = Runs(), t["batch_id"].to_numpy(), t["ident"].combine_chunks()
    h, rec, out = (t[c].to_numpy() for c in ("h", "rec_id", "output"))
    ends = np.flatnonzero(np.r_[batch[1:] != batch[:-1], True]) + 1
    at = 0
    while at < len(batch):
        end = int(ends[np.searchsorted(ends, min(at + load, len(batch)))])
        own = slice(at, end)
        names = ident.slice(at, end - at)
        code = names.dictionary_encode().indices.to_numpy()
        first, head = _firsts(code, batch[own], rec[own])
        first = first[np.argsort(h[own][first], kind="stable")]
        known, row, output = runs.find(h[own][first], names.take(pa.array(first)))
        root, root_out = rec[own].copy(), out[own].copy()
        root[first[known]], root_out[first[known]] = row[known], output[known]
        root, root_out = root[head], root_out[head]
        more = np.flatnonzero(root != rec[own])
        if len(more):
            yield _links(rec[own][more], out[own][more], root[more], root_out[more])
        new = first[~known]
        runs.add(h[own][new], names.take(pa.array(new)), rec[own][new], out[own][new])
        at = end
    runs.merge()
    for run in runs.runs:
        lists = [pa.array([c.tolist() if isinstance(c, np.ndarray) else c.to_pylist()], _OUT.field(n).type) for n, c in zip(("h", "ident", "rows", "outputs"), run, strict=True)]
        yield pa.RecordBatch.from_arrays([*(pa.nulls(1, pa.int64()) for _ in range(4)), pa.array([prefix], pa.int32()), *lists], schema=_OUT)


def _index(load: int):
    """Rows in order of (prefix, batch_id) to links and runs, one prefix in memory at a time; links pass through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        prefix = None
        for b in batches:
            is_link = pc.is_null(b["ident"])
            if pc.any(is_link).as_py():
                links = b.filter(is_link)
                yield _links(*(links[c].to_numpy() for c in ("rec_id", "output", "first_row", "first_output")))
                b = b.filter(pc.invert(is_link))
            p = b["prefix"].to_numpy()
            bounds = [0, *(np.flatnonzero(p[1:] != p[:-1]) + 1), len(p)]
            for s, e in zip(bounds, bounds[1:], strict=False):
                if e > s:
                    if held and p[s] != prefix:
                        yield from _take_in(prefix, pa.Table.from_batches(held), load)
                        held = []
                    prefix = int(p[s])
                    held.append(b.slice(s, e - s))
        if held:
            yield from _take_in(prefix, pa.Table.from_batches(held), load)

    return run


def write_links(tagged: DataFrame, n: int, path: str, per_prefix: int = 50_000, load: int = LOAD) -> DataFrame:
    """Take all batches of tagged (rec_id, output, batch_id, idents; some n rows) in, write links and index under path, and return the links.

    A link (rec_id, output, first_row, first_output) ties a row to an earlier one
    that carries an identifier of it; rows whose identifiers are all their own
    give none. A batch of unknown number counts as the first.
    """
    prefixes = max(1, -(-2 * n // per_prefix))
    unknown = F.lit(UNKNOWN).cast("bigint")
    rows = tagged.where("rec_id is not null and size(idents) > 0").select(F.col("rec_id").cast("bigint").alias("rec_id"), F.coalesce("output", unknown).alias("output"), F.coalesce("batch_id", F.lit(-1)).cast("bigint").alias("batch_id"), "idents")
    local = rows.mapInArrow(_local, LOCAL)
    h = F.xxhash64("ident")
    prefix = F.pmod(F.coalesce(F.when(F.col("ident").isNotNull(), h), F.xxhash64("rec_id")), F.lit(prefixes)).cast("int")
    split = local.select("*", h.alias("h"), prefix.alias("prefix")).repartition(max(min(prefixes, 64), -(-prefixes // 8)), "prefix")
    split.sortWithinPartitions("prefix", "batch_id").mapInArrow(_index(load), _INDEXED).write.mode("overwrite").parquet(path)
    return rows.sparkSession.read.schema(_INDEXED).parquet(path).where("rec_id is not null").select("rec_id", "output", "first_row", "first_output")


def components(edges: DataFrame, limit: int = 60) -> DataFrame:
    """(node, comp): comp is the smallest node that (a, b) edges tie a node to.

    Alternates large-star and small-star steps, each of them joins against one
    pre-aggregated minimum for each node, so no neighbourhood is collected.
    """
    e = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    sign = None
    for _ in range(limit):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        e = cut(small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == sign or now[0] == 0:
            break
        sign = now
    else:
        raise RuntimeError("the component search did not settle")
    pairs = e.select(F.col("u").alias("node"), F.col("v").alias("comp"))
    return pairs.unionByName(pairs.select(F.col("comp").alias("node"), "comp").distinct())


def versions(tagged: DataFrame, n: int | None = None, per_prefix: int = 50_000, load: int = LOAD) -> DataFrame:
    """(rec_id, message, output) of the rows that share a message with another row; message is its smallest rec_id.

    tagged has rec_id, output, batch_id and idents. Rows are copies if they share
    an identifier, also through further rows. Rows that aren't here are messages
    of their own. An unknown output is the smallest bigint.
    """
    scratch = Scratch(tagged.sparkSession, "identifiers")
    links = write_links(tagged, tagged.count() if n is None else n, scratch.path, per_prefix, load)
    comp = components(links.select(F.col("rec_id").alias("a"), F.col("first_row").alias("b")))
    own = links.select("rec_id", "output").unionByName(links.select(F.col("first_row").alias("rec_id"), F.col("first_output").alias("output"))).distinct()
    out = cut(own.join(comp.select(F.col("node").alias("rec_id"), F.col("comp").alias("message")), "rec_id").select("rec_id", "message", "output"))
    scratch.close()
    return out


def superseded(shared: DataFrame) -> DataFrame:
    """(rec_id) of all ``versions`` of a message but the one with the largest output, among equals the smallest rec_id."""
    best = shared.groupBy("message").agg(F.max_by("rec_id", F.struct("output", -F.col("rec_id"))).alias("best"))
    return shared.join(best, "message").where("rec_id <> best").select("rec_id").distinct()


def redundant_rows(rows: DataFrame, **options: int) -> DataFrame:
    """(rec_id) of the rows to drop so that one row of each message stays.

    rows has rec_id, batch_id, id and message. The copy with the largest
    usage.output stays, null being less than any number; among equals the
    smallest rec_id. Rows without identifiers always stay. An empty table gives
    an empty result. Exactly repeated rec_ids count as one row.
    """
    return superseded(versions(tagged_rows(rows), rows.count(), **options))


def kept_rows(rows: DataFrame, **options: int) -> DataFrame:
    """rows without the copies that ``redundant_rows`` names."""
    return rows.join(redundant_rows(rows, **options), "rec_id", "left_anti")


class IdentifierIndex:
    """Identifiers of batches as they come, as immutable runs in a folder: sorted arrays by hash prefix.

    A run is named by the first and the last batch it covers and its number of
    prefixes, which follows from its size, so an array stays at about
    ``per_prefix`` identifiers however long the index grows. Finished runs are
    found again by a new instance. Eight runs of one size class become one of the
    next; a merged run makes those it covers void at the moment it is finished.
    """

    def __init__(self, spark: SparkSession, path: str, per_prefix: int = 50_000, merge_every: int = MERGE_EVERY):
        self.spark, self.path, self.per_prefix, self.merge_every = spark, path, per_prefix, merge_every

    def runs(self, before: int | None = None) -> list[tuple[int, int, int, str]]:
        """(first batch, last batch, prefixes, path) of the runs that count, of those before a batch only."""
        found = []
        for name in list_names(self.spark, self.path):
            m = _RUN_NAME.match(name)
            if m and "_SUCCESS" in list_names(self.spark, f"{self.path}/{name}"):
                found.append((*map(int, m.groups()), f"{self.path}/{name}"))
        found = [r for r in found if before is None or r[1] < before]
        covered = lambda r: any(o is not r and o[0] <= r[0] and r[1] <= o[1] and (o[0], o[1]) != (r[0], r[1]) for o in found)
        return sorted(r for r in found if not covered(r))

    def _write(self, firsts: DataFrame, n: int, first: int, last: int) -> str:
        """A run from (ident, first_row, first_output)."""
        prefixes = 1 << max(0, -(-n // self.per_prefix) - 1).bit_length()
        h = F.xxhash64("ident")
        keyed = firsts.select(h.alias("h"), "ident", "first_row", "first_output", F.pmod(h, F.lit(prefixes)).cast("int").alias("prefix"))
        packed = keyed.groupBy("prefix").agg(F.sort_array(F.collect_list(F.struct("h", "ident", "first_row", "first_output"))).alias("s"))
        path = f"{self.path}/run-{first:012d}-{last:012d}-{prefixes}"
        packed.select("prefix", *[F.col(f"s.{c}").alias(c) for c in ("h", "ident", "first_row", "first_output")]).write.mode("overwrite").parquet(path)
        return path

    def _read(self, *paths: str) -> DataFrame:
        z = F.explode(F.arrays_zip("ident", "first_row", "first_output")).alias("z")
        return self.spark.read.schema(RUN).parquet(*paths).select(z).select("z.*")

    def add(self, tagged: DataFrame, batch: int) -> DataFrame:
        """Take in a batch (rec_id, output, ident) and return (ident, first_row) of what it brings that no batch before it had.

        A batch taken in again finds the index as it was before it, and gives the same.
        """
        self.merge(batch)
        out = F.coalesce("output", F.lit(UNKNOWN).cast("bigint"))
        novel = tagged.groupBy("ident").agg(F.min("rec_id").alias("first_row"), F.min_by(out, "rec_id").alias("first_output")).withColumn("h", F.xxhash64("ident"))
        before = self.runs(batch)
        for p in sorted({r[2] for r in before}):
            there = self.spark.read.schema(RUN).parquet(*[r[3] for r in before if r[2] == p])
            keyed = novel.withColumn("prefix", F.pmod("h", F.lit(p)).cast("int"))
            novel = keyed.groupBy("prefix").cogroup(there.groupBy("prefix")).applyInArrow(_novel, "ident string, first_row bigint, first_output bigint, h bigint")
        novel = novel.persist()
        for r in self.runs():
            if r[:2] == (batch, batch):
                delete_path(self.spark, r[3])
        path = self._write(novel.select("ident", "first_row", "first_output"), novel.count(), batch, batch)
        novel.unpersist()
        return self._read(path).select("ident", "first_row")

    def merge(self, before: int) -> None:
        """Merge runs of batches before one, which are known to be delivered, once there are enough of a size class."""
        runs = self.runs(before)
        while len(runs) >= self.merge_every and len({self._tier(r) for r in runs[-self.merge_every :]}) == 1:
            own = runs[-self.merge_every :]
            whole = self._read(*[r[3] for r in own])
            self._write(whole, whole.count(), own[0][0], own[-1][1])
            for r in own:
                delete_path(self.spark, r[3])
            runs = self.runs(before)

    def _tier(self, run: tuple[int, int, int, str]) -> int:
        """How often a run has been merged, by the batches it spans."""
        span, tier = run[1] - run[0] + 1, 0
        while span >= self.merge_every:
            span, tier = span // self.merge_every, tier + 1
        return tier


def _novel(batch: pa.Table, runs: pa.Table) -> pa.Table:
    """The batch's identifiers that no run has."""
    have = Runs()
    for k in range(runs.num_rows):
        have.runs.append((np.asarray(runs["h"][k].values), runs["ident"][k].values, np.asarray(runs["first_row"][k].values), np.asarray(runs["first_output"][k].values)))
    known, _, _ = have.find(batch["h"].to_numpy(), batch["ident"].combine_chunks())
    return batch.filter(pa.array(~known)).select(["ident", "first_row", "first_output", "h"])
