"""Documents laid into windows of fixed capacity, by best fit in partitions and a tree of merges.

Each partition packs its own items, largest first, always into the fullest window
that still takes the item. Windows that are nearly full are done. The others go on
as items of their own into fewer, larger-reaching partitions, round by round,
until a round no longer makes them fewer or one partition holds them all. Only
open windows move, one row each; who lies in them is joined on at the end.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.llm import tokens
from loomspan.session import cut

PACKED = "budget_id int, capacity int, item bigint, size int, bin bigint, fill int"


def best_fit(sizes: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """The bin of each item and the fill of each bin, taking items in the given order; every size must be at most capacity.

    The bins with each amount of room are kept as stacks, and the amounts that
    occur as the bits of one number, so the best fit is its lowest bit from the size on.
    """
    bins: list[int] = []
    fills: list[int] = []
    by_room: dict[int, list[int]] = {}
    rooms = 0
    for size in sizes:
        fitting = rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            stack = by_room[room]
            b = stack.pop()
            if not stack:
                rooms ^= 1 << room
        else:
            b, room = len(fills), capacity
            fills.append(0)
        fills[b] += size
        room -= size
        stack = by_room.setdefault(room, [])
        if not stack:
            rooms |= 1 << room
        stack.append(b)
        bins.append(b)
    return bins, fills


def _pack(level: int):
    """Pack all items of a partition, each budget for itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        got = [b for b in batches if b.num_rows]
        if not got:
            return
        t = pa.Table.from_batches(got)
        part = TaskContext.get().partitionId()
        columns = {c: t[c].to_numpy() for c in ("budget_id", "capacity", "item", "size")}
        base = (level << 56) | (part << 32)
        for budget in np.unique(columns["budget_id"]):
            own = np.flatnonzero(columns["budget_id"] == budget)
            own = own[np.lexsort((columns["item"][own], -columns["size"][own]))]
            capacity = int(columns["capacity"][own[0]])
            bins, fills = best_fit(columns["size"][own].tolist(), capacity)
            bins = np.array(bins, np.int64)
            out = {c: columns[c][own] for c in columns}
            out |= {"bin": base + bins, "fill": np.array(fills, np.int32)[bins]}
            base += len(fills)
            schema = pa.schema([("budget_id", pa.int32()), ("capacity", pa.int32()), ("item", pa.int64()), ("size", pa.int32()), ("bin", pa.int64()), ("fill", pa.int32())])
            yield from pa.table(out, schema=schema).to_batches(max_chunksize=50_000)

    return run


def packed(items: DataFrame, full: float = 0.99, fan_in: int = 8, partition_items: int = 200_000) -> DataFrame:
    """items (budget_id, capacity, item, size) with ``bin``, the window each item lies in.

    item must be unique within a budget, size between 0 and capacity. full: a
    window filled to this share is done. fan_in: how many partitions' open windows
    meet in the next round. partition_items: the most items that one partition packs.
    """
    n = items.count()
    parts = max(1, -(-n // partition_items))
    layer = cut(items.repartition(parts, F.xxhash64("item")).select("budget_id", "capacity", "item", "size").mapInArrow(_pack(0), PACKED))
    placed = layer.select("budget_id", "capacity", "item", "size", "bin")
    final = None  # (budget_id, bin, to): where the open windows of the first round ended up
    level, open_count = 0, None
    while parts > 1:
        level += 1
        bins = layer.groupBy("budget_id", "bin").agg(F.first("capacity").alias("capacity"), F.first("fill").alias("size"))
        still = cut(bins.where(F.col("size") < F.floor(full * F.col("capacity"))).select("budget_id", "capacity", F.col("bin").alias("item"), "size"))
        now = still.count()
        if not now or (open_count is not None and now > 0.9 * open_count and parts <= -(-now // partition_items)):
            break
        open_count = now
        parts = max(1, -(-parts // fan_in), -(-now // partition_items))
        layer = cut(still.repartition(parts, F.xxhash64("item")).mapInArrow(_pack(level), PACKED))
        step = layer.select("budget_id", F.col("item").alias("from"), F.col("bin").alias("next"))
        if final is None:
            final = step.select("budget_id", F.col("from").alias("bin"), F.col("next").alias("to"))
        else:
            final = cut(final.join(step.withColumnRenamed("from", "to"), ["budget_id", "to"], "left").select("budget_id", "bin", F.coalesce("next", "to").alias("to")))
    if final is None:
        return placed
    return placed.join(final, ["budget_id", "bin"], "left").select("budget_id", "capacity", "item", "size", F.coalesce("to", "bin").alias("bin"))


def pieces(counts: DataFrame, budgets: DataFrame) -> DataFrame:
    """(budget_id, capacity, doc_id, piece_no, first_token, size) of counts (doc_id, n_tokens) for each budget.

    A document that exceeds the capacity is split into full pieces and a rest; all
    others, those without tokens too, are one piece. Budgets without a positive
    capacity get none.
    """
    own = budgets.where("capacity > 0 and budget_id is not null").select(F.col("budget_id").cast("int").alias("budget_id"), F.col("capacity").cast("int").alias("capacity")).distinct()
    listed = [F.struct(F.lit(r["budget_id"]).alias("budget_id"), F.lit(r["capacity"]).alias("capacity")) for r in own.toLocalIterator()]
    blocks = [listed[k : k + 500] for k in range(0, max(1, len(listed)), 500)]  # budgets go along with the rows, so many at a time
    each = [counts.select("doc_id", "n_tokens", F.explode(F.array(*b).cast("array<struct<budget_id:int,capacity:int>>")).alias("b")) for b in blocks]
    wide = reduce(DataFrame.unionByName, each).select("b.budget_id", "b.capacity", "doc_id", "n_tokens")
    last = F.greatest(F.lit(0), F.ceil(F.col("n_tokens") / F.col("capacity")) - 1)
    cutup = wide.withColumn("piece_no", F.explode(F.sequence(F.lit(0).cast("bigint"), last.cast("bigint"))))
    first = F.col("piece_no") * F.col("capacity")
    return cutup.select("budget_id", "capacity", "doc_id", F.col("piece_no").cast("int").alias("piece_no"), first.cast("bigint").alias("first_token"), F.least(F.col("capacity"), F.col("n_tokens") - first).cast("int").alias("size"))


def windows(documents: DataFrame, budgets: DataFrame, path: str = tokens.TOKENIZER, **options: float) -> DataFrame:
    """(budget_id, window_id, doc_id, piece_no, first_token, n_tokens): the window of each document or piece, for each budget.

    A row of documents is an item of its own; doc_id must be unique. Null and
    empty texts have no tokens and lie in some window with the others. Empty
    tables give no windows.
    """
    counts = cut(tokens.token_counts(documents, path))
    p = pieces(counts, budgets)
    keyed = cut(p.withColumn("item", F.monotonically_increasing_id()))
    laid = packed(keyed.select("budget_id", "capacity", "item", "size"), **options).select("budget_id", "item", F.col("bin").alias("window_id"))
    return keyed.join(laid, ["budget_id", "item"]).select("budget_id", "window_id", "doc_id", "piece_no", "first_token", F.col("size").alias("n_tokens"))


def fill_rates(laid: DataFrame, budgets: DataFrame) -> DataFrame:
    """(budget_id, windows, tokens, fill): how many windows there are and which share of their room is used."""
    each = laid.groupBy("budget_id", "window_id").agg(F.sum("n_tokens").alias("fill"))
    sums = each.groupBy("budget_id").agg(F.count("*").alias("windows"), F.sum("fill").alias("tokens"))
    return sums.join(budgets.select("budget_id", "capacity"), "budget_id").select("budget_id", "windows", "tokens", F.round(F.col("tokens") / (F.col("windows") * F.col("capacity")), 6).alias("fill"))
