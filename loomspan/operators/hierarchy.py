"""Parent-child rows to full hierarchies: root, depth, path and descendants of every node.

Nodes are laid into partitions by locality. Within a partition each chain of
parents is contracted to the point where it leaves the partition (its exit), ends
in a root, or runs into a cycle. The exits form a much smaller quotient forest,
which is solved the same way with coarser partitions and lies in one partition in
the end; its answers then expand those of the level above. A quotient that no
longer shrinks, and nodes of which too many share one locality and position, are
solved by pointer doubling with joins instead, so no shape of the forest and no
hot group gathers more than about a partition's rows in a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspan.session import cut

BLOCK = 8192
LEVEL = "node string, loc bigint, pos bigint, top string, exit string, dist bigint, low string, cyc string, root string, rdepth bigint, seg string"
_TYPES = pa.schema([(n, pa.int64() if t == "bigint" else pa.string()) for n, t in (x.split() for x in LEVEL.split(", "))])


def _contract(paths: bool):
    """Contract the parent chains of one partition; rows are (node, parent, w, low, root, rdepth, seg, loc, pos)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        t = pa.Table.from_batches(got).to_pandas()
        n = len(t)
        idx = pd.Index(t["node"])
        p = idx.get_indexer(t["parent"]) if t["parent"].notna().any() else np.full(n, -1)
        p = np.where(t["parent"].isna(), -1, p)
        rank = t["low"].rank(method="dense").to_numpy().astype(np.int64)
        names = pd.Series(t["low"].to_numpy(), index=rank).groupby(level=0).first()
        me = np.arange(n)
        jump, moving = np.where(p < 0, me, p), p >= 0
        dist = np.where(moving, t["w"].to_numpy(), 0)
        low = rank.copy()  # smallest id from the node to just before jump
        low_all = rank.copy()
        for _ in range(int(n).bit_length() + 1):
            dist = dist + dist[jump]
            low = np.minimum(low, low[jump])
            low_all = low
            jump = jump[jump]
        ended = p[jump] < 0
        cyc = np.where(ended, -1, low_all[jump])
        exit_ = t["parent"].to_numpy()[jump]
        out = pd.DataFrame({"node": t["node"], "loc": t["loc"], "pos": t["pos"]})
        out["top"] = np.where(ended, t["node"].to_numpy()[jump], None)
        out["exit"] = np.where(ended, exit_, None)
        w_top = np.where(ended & pd.notna(exit_), t["w"].to_numpy()[jump], 0)
        out["dist"] = np.where(ended, dist + w_top, -1)
        out["low"] = np.where(ended, names.reindex(low).to_numpy(), None)
        out["cyc"] = np.where(ended, None, names.reindex(cyc).to_numpy())
        out["root"] = np.where(ended, t["root"].to_numpy()[jump], None)
        out["rdepth"] = np.where(ended, t["rdepth"].to_numpy()[jump], -1)
        out["seg"] = None
        if paths:
            seg, own = [None] * n, t["seg"].to_numpy()
            for i in np.argsort(np.where(ended, dist, np.iinfo(np.int64).max), kind="stable"):
                if ended[i]:
                    seg[i] = own[i] if p[i] < 0 else seg[p[i]] + own[i]
            out["seg"] = seg
        out["rdepth"] = out["rdepth"].fillna(0).astype("int64")
        yield from pa.Table.from_pandas(out[_TYPES.names], schema=_TYPES, preserve_index=False).to_batches(max_chunksize=20_000)

    return run


def _fragment(level: int) -> Column:
    """What is near at a level: a block of positions of one locality."""
    return F.xxhash64("loc", F.shiftright("pos", 13 * (level + 1)))


def _crowded(nodes: DataFrame, level: int, rows: int) -> bool:
    """Whether one fragment alone holds more than two partitions are meant to."""
    return (nodes.groupBy(_fragment(level)).count().agg(F.max("count")).first()[0] or 0) > 2 * rows


def _level(nodes: DataFrame, n: int, level: int, rows: int, paths: bool) -> DataFrame:
    parts = max(1, -(-n // rows))
    return nodes.repartition(parts, _fragment(level)).select("node", "parent", "w", "low", "root", "rdepth", "seg", "loc", "pos").mapInArrow(_contract(paths), LEVEL)


def _double(nodes: DataFrame) -> DataFrame:
    """(node, top, depth, cyc, path) of a quotient by pointer doubling; a round is one join on a hashed key."""
    e = cut(nodes.select("node", F.col("parent").alias("to"), "w", "low", "root", "rdepth", "seg"))
    n = e.count()
    for _ in range(n.bit_length() + 1):
        far = e.select(F.col("node").alias("to"), F.col("to").alias("to2"), F.col("w").alias("w2"), F.col("low").alias("low2"), F.col("root").alias("root2"), F.col("rdepth").alias("rdepth2"), F.col("seg").alias("seg2"))
        live = F.col("to").isNotNull()
        e = cut(
            e.join(far, "to", "left").select(
                "node", F.col("to2").alias("to"), F.when(live, F.col("w") + F.coalesce("w2", F.lit(0))).otherwise(F.col("w")).alias("w"),
                F.least("low", "low2").alias("low"), F.when(live, F.col("root2")).otherwise(F.col("root")).alias("root"),
                F.when(live, F.col("rdepth2")).otherwise(F.col("rdepth")).alias("rdepth"), F.concat(F.coalesce("seg2", F.lit("")), F.col("seg")).alias("seg"),
            )
        )
        if not e.where("to is not null").take(1):
            break
    on = e.select(F.col("node").alias("to"), F.col("low").alias("cyc"))
    e = e.join(on, "to", "left")
    ended = F.col("to").isNull()
    return e.select("node", F.when(ended, F.col("root")).alias("root"), F.when(ended, F.col("w") + F.col("rdepth")).otherwise(F.lit(-1)).alias("depth"), F.when(~ended, F.col("cyc")).alias("cyc"), F.when(ended, F.col("seg")).alias("path"))


def _solve(nodes: DataFrame, n: int, level: int, rows: int, paths: bool) -> DataFrame:
    """(node, root, depth, cyc, path) for (node, parent, w, low, root, rdepth, seg, loc, pos).

    A parentless node carries its own root and rdepth. A node whose parent isn't
    a node is the root of what hangs below it.
    """
    if n > rows and _crowded(nodes, level, rows):  # a fragment is too large for one task
        there = nodes.select(F.col("node").alias("parent"), F.lit(True).alias("there"))
        own = nodes.join(there, "parent", "left")
        up = F.when(F.col("there"), F.col("parent"))
        return _double(own.select("node", up.alias("parent"), F.when(F.col("there"), F.col("w")).otherwise(F.lit(0).cast("bigint")).alias("w"), "low", F.coalesce("root", "node").alias("root"), "rdepth", F.coalesce("seg", F.lit("")).alias("seg")))
    c = _level(nodes, n, level, rows, paths)
    if n <= rows:  # one partition: what leaves it leads nowhere
        top = F.when(F.col("exit").isNotNull(), F.col("top")).otherwise(F.coalesce("root", "top"))
        return _answer(c, top, F.when(F.col("exit").isNotNull(), F.col("dist") - 1).otherwise(F.col("dist") + F.col("rdepth")))
    c = cut(c)
    exits = c.where("exit is not null").select("exit").distinct()
    x = exits.join(c.withColumnRenamed("exit", "far"), exits["exit"] == c["node"], "inner").select("node", "far", "top", "dist", "low", "cyc", "root", "rdepth", "seg", "loc", "pos")
    x = cut(x)
    alive = x.select(F.col("node").alias("far"), F.lit(True).alias("there"))
    x = x.join(alive, "far", "left")
    there = F.coalesce("there", F.lit(False))
    cyclic = F.col("cyc").isNotNull()
    lost = F.col("far").isNotNull() & ~there
    q = cut(
        x.select(
            "node", F.when(there, F.col("far")).alias("parent"), F.when(there, F.col("dist")).otherwise(F.lit(0)).alias("w"), F.coalesce("low", "node").alias("low"),
            F.when(cyclic, F.concat(F.lit("\x00"), "cyc")).when(lost, F.col("top")).otherwise(F.coalesce("root", "top")).alias("root"),
            F.when(cyclic, F.lit(-1)).when(lost, F.col("dist") - 1).otherwise(F.col("dist") + F.col("rdepth")).alias("rdepth"), F.coalesce("seg", F.lit("")).alias("seg"), "loc", "pos",
        )
    )
    m = q.count()
    solved = _double(q) if m > rows and m > n // 2 else _solve(q, m, level + 1, rows, paths)
    solved = solved.select(F.col("node").alias("exit"), F.col("root").alias("qroot"), F.col("depth").alias("qdepth"), F.col("cyc").alias("qcyc"), F.col("path").alias("qpath"))
    j = c.join(solved, "exit", "left")
    marked = F.col("qroot").startswith("\x00")
    cyc = F.coalesce("cyc", "qcyc", F.when(marked, F.substring("qroot", 2, 1 << 30)))
    through = F.col("qroot").isNotNull() & ~marked
    root = F.when(through, F.col("qroot")).when(F.col("exit").isNotNull(), F.col("top")).otherwise(F.coalesce("root", "top"))
    depth = F.when(through, F.col("dist") + F.col("qdepth")).when(F.col("exit").isNotNull(), F.col("dist") - 1).otherwise(F.col("dist") + F.col("rdepth"))
    return _answer(j, root, depth, cyc, F.concat(F.coalesce("qpath", F.lit("")), "seg"))


def _answer(c: DataFrame, root: Column, depth: Column, cyc: Column | None = None, path: Column | None = None) -> DataFrame:
    cyc = F.col("cyc") if cyc is None else cyc
    path = F.col("seg") if path is None else path
    return c.select("node", F.when(cyc.isNull(), root).alias("root"), F.when(cyc.isNull(), depth).otherwise(F.lit(-1)).alias("depth"), cyc.alias("cyc"), F.when(cyc.isNull(), path).alias("path"))


def hierarchy(rows: DataFrame, node: str, parent: str, locality: Column | None = None, position: Column | None = None, paths: bool = False, partition_rows: int = 100_000) -> DataFrame:
    """(node, root, depth, path) of each distinct non-null node.

    A node without parent, or whose parent isn't a node, is a root of depth 0. Of
    several parents named in a node's rows the smallest counts. On a cycle and
    below it depth is -1, root the smallest id on the cycle, and path null.
    path holds the ids from the root to the node, each after a slash, and only if
    ``paths`` is set; in it ~ is written ~0 and / is written ~1. An empty table gives an empty result; blank ids are ids.

    locality and position tell which rows are near each other (a file and its
    line, say): chains that stay near are contracted without a further shuffle.
    """
    loc = F.xxhash64(node) if locality is None else F.xxhash64(locality)
    pos = F.lit(0) if position is None else F.coalesce(position, F.lit(0))
    src = rows.where(F.col(node).isNotNull()).select(F.col(node).alias("node"), F.col(parent).alias("parent"), loc.alias("loc"), pos.cast("bigint").alias("pos"))
    base = cut(src.groupBy("node").agg(F.min("parent").alias("parent"), F.min("loc").alias("loc"), F.min("pos").alias("pos")))
    n = base.count()
    nodes = base.select(
        "node", "parent", F.lit(1).cast("bigint").alias("w"), F.col("node").alias("low"), F.lit(None).cast("string").alias("root"), F.lit(0).cast("bigint").alias("rdepth"),
        (F.concat(F.lit("/"), F.replace(F.replace("node", F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))) if paths else F.lit(None).cast("string")).alias("seg"), "loc", "pos",
    )
    done = _solve(nodes, n, 0, partition_rows, paths)
    return done.select("node", F.coalesce("root", "cyc").alias("root"), F.col("depth").cast("int").alias("depth"), "path")


def descendants(paths: DataFrame) -> DataFrame:
    """(ancestor, node, distance) for each node below another, from the paths of ``hierarchy``."""
    ids = F.slice(F.split("path", "/"), F.lit(2), F.col("depth"))
    each = paths.where("depth > 0").select("node", "depth", F.posexplode(ids).alias("at", "ancestor"))
    return each.select(F.replace(F.replace("ancestor", F.lit("~1"), F.lit("/")), F.lit("~0"), F.lit("~")).alias("ancestor"), "node", (F.col("depth") - F.col("at")).alias("distance"))
