"""A written keyword index that grows by segments and that searches read instead of texts.

A segment holds postings by a hash of their term, sorted by term within a bucket,
with the columns of the document that rankings and filters need beside them; a
search reads the buckets of its words, of these the row groups that may hold
them, and no text. Buckets are split by document too, so a word that stands in a
third of all documents is no single task's. New documents become a new segment;
documents that are replaced or removed are told to the segments before by their
keys. Small segments merge once there are many. One manifest names what counts, and
is put in place of the former in one step.
"""

from __future__ import annotations

import json
import math
import time
import uuid
from functools import reduce

import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.functions.stem import stems
from loomspan.operators.lexical import K1, B, Query, parse, stemmed_query, tokens
from loomspan.session import delete_path, list_names, modified_ms, read_text, shared_dir, write_text

FORMAT = 2  # of what lies in the shared folder; another one is another folder
CASES = 64  # questions that are answered in one pass over their postings


class Index:
    """key: the column that names a document; keep: columns that hits bring along; stemmed: words match by their English stems.

    Documents without a word stay in the statistics, those replaced or removed
    until their segment is merged. Choose the buckets so that one has some 100 million postings, and the splits
    so that the most frequent word's share of them fits a task.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._counts: dict[tuple[str, str], int] = {}

    @property
    def manifest(self) -> dict | None:
        text = read_text(self.spark, f"{self.path}/MANIFEST")
        return json.loads(text) if text else None

    def create(self, docs: DataFrame, key: str, text: str, keep: tuple[str, ...] = (), stemmed: bool = False, buckets: int = 16, splits: int = 4) -> Index:
        """Write the index of docs anew."""
        types = dict(docs.dtypes)
        schema = ", ".join(["term string", "tf bigint", "positions array<int>", "length int", *[f"`{c}` {types[c]}" for c in (key, *keep)]])
        m = {"key": key, "text": text, "keep": list(keep), "stemmed": stemmed, "buckets": buckets, "splits": splits, "schema": schema, "segments": [], "gone": []}
        return self._add(docs, m)

    def append(self, docs: DataFrame, merge_from: int = 8) -> Index:
        """Add documents; those of keys that are there take their place."""
        m = self.manifest
        if m["segments"]:
            self._forget(docs.select(m["key"]), m)
        self._add(docs, m)
        if len(m["segments"]) >= merge_from:
            self.merge()
        return self

    def remove(self, keys: DataFrame) -> None:
        m = self.manifest
        self._forget(keys, m)
        self._commit(m)

    def merge(self, whole: bool = False) -> None:
        """Make one segment of the small ones, or of all once the small ones are half of the largest or ``whole`` is set."""
        m = self.manifest
        by_size = sorted(m["segments"], key=lambda s: s["docs"])
        own = by_size if whole or sum(s["docs"] for s in by_size[:-1]) * 2 >= by_size[-1]["docs"] else by_size[:-1]
        if len(own) < 2 and not (own and m["gone"]):
            return
        rows = self._rows(m, own, range(m["buckets"]), [])
        bucket = F.pmod(F.xxhash64("term"), F.lit(m["buckets"])).cast("int")
        segment = self._write(rows.withColumns({"bucket": bucket, "split": self._split(m)}), m)
        names = {s["name"] for s in own}
        docs, length = sum(s["docs"] for s in own), sum(s["length"] for s in own)
        lost = [g for g in m["gone"] if set(g["segments"]) & {s["name"] for s in own}]
        for s in own if lost else []:
            own_gone = [self.spark.read.parquet(f"{self.path}/{g['name']}") for g in lost if s["name"] in g["segments"]]
            if own_gone:
                there = self._rows(m, [s], range(m["buckets"]), [], forgotten=True).select(m["key"], "length").distinct()
                n = there.join(reduce(DataFrame.union, own_gone), m["key"], "left_semi").agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
                docs, length = docs - int(n[0]), length - int(n[1])
        self._stats(segment, docs, length)
        m["segments"] = [s for s in m["segments"] if s["name"] not in names] + [segment]
        m["gone"] = [g | {"segments": left} for g in m["gone"] if (left := [x for x in g["segments"] if x not in names])]
        self._commit(m)

    @staticmethod
    def _stats(segment: dict, docs: int, length: int) -> None:
        segment["docs"], segment["length"] = docs, length

    def _split(self, m: dict):
        return F.pmod(F.xxhash64(m["key"]), F.lit(m["splits"])).cast("int")

    def _tokenised(self, docs: DataFrame, m: dict) -> DataFrame:
        t = F.coalesce(tokens(F.col(m["text"])), F.array().cast("array<string>"))
        return docs.select(m["key"], *m["keep"], (stems(t) if m["stemmed"] else t).alias("_t"))

    def _write(self, rows: DataFrame, m: dict) -> dict:
        name = f"seg-{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
        rows.repartition("bucket", "split").sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(f"{self.path}/{name}/postings")
        there = [int(x.split("=")[1]) for x in list_names(self.spark, f"{self.path}/{name}/postings") if x.startswith("bucket=")]
        return {"name": name, "buckets": there}

    def _add(self, docs: DataFrame, m: dict) -> Index:
        t = self._tokenised(docs, m)
        bucket = F.pmod(F.xxhash64("term"), F.lit(m["buckets"])).cast("int")
        each = t.select(m["key"], *m["keep"], F.size("_t").alias("length"), F.posexplode("_t").alias("pos", "term")).withColumns({"bucket": bucket, "split": self._split(m)})
        # rows that lie together by bucket and split lie together by term and document, so this is the only shuffle
        grouped = each.repartition("bucket", "split").groupBy("bucket", "split", "term", m["key"]).agg(
            F.count("*").alias("tf"), F.sort_array(F.collect_list("pos")).alias("positions"), F.first("length").alias("length"), *[F.first(c).alias(c) for c in m["keep"]]
        )
        segment = self._write(grouped, m)
        n = t.agg(F.count("*"), F.coalesce(F.sum(F.size("_t")), F.lit(0))).first()
        self._stats(segment, int(n[0]), int(n[1]))
        m["segments"].append(segment)
        self._commit(m)
        return self

    def _forget(self, keys: DataFrame, m: dict) -> None:
        name = f"gone-{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
        keys.select(m["key"]).distinct().write.parquet(f"{self.path}/{name}")
        m["gone"].append({"name": name, "segments": [s["name"] for s in m["segments"]]})

    def _commit(self, m: dict) -> None:
        m["generation"] = uuid.uuid4().hex
        write_text(self.spark, f"{self.path}/MANIFEST", json.dumps(m))

    def collect_garbage(self) -> list[str]:
        """Remove segments and lists of keys that the manifest doesn't name."""
        m = self.manifest
        used = {x["name"] for x in [*m["segments"], *m["gone"]]}
        old = [n for n in list_names(self.spark, self.path) if n.startswith(("seg-", "gone-")) and n not in used]
        for n in old:
            delete_path(self.spark, f"{self.path}/{n}")
        return old

    def _rows(self, m: dict, segments: list[dict], buckets: object, words: list[str], forgotten: bool = False) -> DataFrame:
        """The postings of some buckets (and words) in some segments, without those of documents that no longer count."""
        wanted = set(buckets)
        paths = {s["name"]: [f"{self.path}/{s['name']}/postings/bucket={b}" for b in sorted(wanted & set(s["buckets"]))] for s in segments}
        gone = [g for g in m["gone"] if set(g["segments"]) & set(paths) and not forgotten]
        schema = m["schema"] + ", split int"
        read = lambda ps: self.spark.read.schema(schema).parquet(*ps) if ps else self.spark.createDataFrame([], schema)
        keep = F.col("term").isin(words) if words else F.lit(True)
        if not gone:
            return read([p for ps in paths.values() for p in ps]).where(keep)
        parts = []
        for name, ps in paths.items():
            rows = read(ps).where(keep)
            for g in gone:
                if name in g["segments"]:
                    rows = rows.join(self.spark.read.parquet(f"{self.path}/{g['name']}"), m["key"], "left_anti")
            parts.append(rows.select("term", "tf", "positions", "length", m["key"], *m["keep"], "split"))
        return reduce(DataFrame.unionByName, parts)

    def search_each(self, queries: dict[int, Query | str]) -> DataFrame:
        """(case, key, kept columns, score) of the documents that match each question; scores are those of ``lexical.bm25``. Each needs words that score."""
        m = self.manifest
        parsed = {k: parse(q) if isinstance(q, str) else q for k, q in queries.items()}
        parsed = {k: stemmed_query(q) for k, q in parsed.items()} if m["stemmed"] else parsed
        if not all(q.scored for q in parsed.values()):
            raise ValueError("an index search needs words that score")
        blocks = [dict(list(parsed.items())[i : i + CASES]) for i in range(0, len(parsed), CASES)]
        return reduce(DataFrame.unionByName, [self._block(m, b) for b in blocks])

    def search(self, query: Query | str) -> DataFrame:
        """(key, kept columns, score) of the documents that match."""
        return self.search_each({0: query}).drop("case")

    def _document_counts(self, m: dict, rows: DataFrame, words: list[str]) -> dict[str, int]:
        """How many documents hold each word; remembered for this generation."""
        lacking = [w for w in words if (m["generation"], w) not in self._counts]
        if lacking:
            got = {r["term"]: r["count"] for r in rows.where(F.col("term").isin(lacking)).groupBy("term").count().collect()}
            self._counts |= {(m["generation"], w): got.get(w, 0) for w in lacking}
        return {w: self._counts[m["generation"], w] for w in words}

    def _block(self, m: dict, parsed: dict[int, Query]) -> DataFrame:
        words = list(dict.fromkeys(w for q in parsed.values() for w in q.scored))
        wanted = list(dict.fromkeys([*words, *(w for q in parsed.values() for w in q.must_not)]))
        rows = self._rows(m, m["segments"], {bucket_of(w, m["buckets"]) for w in wanted}, wanted)
        n = sum(s["docs"] for s in m["segments"])
        average = sum(s["length"] for s in m["segments"]) / n if n else 1.0
        counts = self._document_counts(m, rows, words)
        tf = F.col("tf").cast("double")
        part = tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("length") / F.lit(average or 1.0)))
        idf = lambda w, q: math.log(1 + (n - counts[w] + 0.5) / (counts[w] + 0.5)) * q.boosts.get(w, 1.0)
        sums, needed, phrased = [], set(), set()
        for k, q in parsed.items():
            weight = F.lit(None).cast("double")
            for w in q.scored:
                weight = F.when(F.col("term") == w, F.lit(idf(w, q))).otherwise(weight)
            sums.append(F.sum(weight * part).alias(f"_s{k}"))
            needed |= {*q.must, *q.must_not}
            phrased |= {w for p in q.phrases for w in p}
            if q.must_not and q.terms and not (q.must or q.phrases):
                needed |= set(q.terms)
        at = {w: i for i, w in enumerate(wanted)}
        flags = [F.bool_or(F.col("term") == w).alias(f"_h{at[w]}") for w in sorted(needed)]
        places = [F.max(F.when(F.col("term") == w, F.col("positions"))).alias(f"_p{at[w]}") for w in sorted(phrased)]
        hits = rows.groupBy(m["key"]).agg(*[F.first(c).alias(c) for c in m["keep"]], *sums, *flags, *places)
        has = lambda w: F.coalesce(F.col(f"_h{at[w]}"), F.lit(False))
        answers = []
        for k, q in parsed.items():
            hit = F.col(f"_s{k}").isNotNull()
            for w in q.must:
                hit = hit & has(w)
            for w in q.must_not:
                hit = hit & ~has(w)
            for p in q.phrases:
                starts = [F.transform(F.coalesce(F.col(f"_p{at[w]}"), F.array().cast("array<int>")), _shift(i)) for i, w in enumerate(p)]
                hit = hit & (F.size(reduce(F.array_intersect, starts)) > 0)
            answers.append(F.when(hit, F.struct(F.lit(k).alias("case"), F.col(f"_s{k}").alias("score"))))
        each = F.inline(F.filter(F.array(*answers), lambda x: x.isNotNull())) if len(answers) > 1 else F.inline(F.array_compact(F.array(*answers)))
        return hits.select(m["key"], *m["keep"], each).select("case", m["key"], *m["keep"], "score")


def _shift(k: int):
    return lambda p: p - k


def bucket_of(word: str, buckets: int) -> int:
    """The bucket of a word, as the engine's xxhash64 gives it."""
    h = xxhash.xxh64_intdigest(word.encode(), seed=42)
    return (h - (1 << 64) if h >= 1 << 63 else h) % buckets


def fingerprint(spark: SparkSession, path: str) -> str:
    """A hash of the names and times of a table's files."""
    names = list_names(spark, path)
    parts = [path, *(f"{n} {modified_ms(spark, path if path.endswith('/' + n) else path + '/' + n)}" for n in names)]
    return xxhash.xxh3_128_hexdigest("\n".join(parts))


def resident(spark: SparkSession, label: str, source: str, docs: DataFrame, key: str, text: str, keep: tuple[str, ...] = (), stemmed: bool = False) -> Index:
    """The index of docs in the shared folder, written at the first call for the state of the table at source and read from then on."""
    index = Index(spark, f"{shared_dir(spark)}/indexes-{FORMAT}/{label}-{'stem' if stemmed else 'word'}-{fingerprint(spark, source)}")
    return index if index.manifest else index.create(docs, key, text, keep, stemmed)
