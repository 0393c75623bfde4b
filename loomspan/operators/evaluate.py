"""Retrieval quality: recall, reciprocal rank, discounted gain and diversity at k."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def evaluate(results: DataFrame, qrels: DataFrame, k: int) -> DataFrame:
    """One row for each case of qrels: recall, mrr, ndcg, unique_sessions.

    results: case_id, rank (from 1), key, session. qrels: case_id, key, relevance;
    only positive relevance counts, the largest of a key. A key found twice counts
    at its first rank, yet both hold their rank. Cases without results have 0.
    """
    rel = qrels.where("relevance > 0").groupBy("case_id", "key").agg(F.max("relevance").alias("relevance"))
    top = results.where(F.col("rank") <= k)
    first = top.groupBy("case_id", "key").agg(F.min("rank").alias("rank"))
    gain = (F.pow(F.lit(2.0), "relevance") - 1) / F.log2(F.col("rank") + 1)
    hits = first.join(rel, ["case_id", "key"]).groupBy("case_id").agg(F.count("*").alias("found"), F.min("rank").alias("best"), F.sum(gain).alias("dcg"))
    ideal = rel.withColumn("rank", F.row_number().over(Window.partitionBy("case_id").orderBy(F.desc("relevance"), "key")))
    ideal = ideal.groupBy("case_id").agg(F.count("*").alias("relevant"), F.sum(F.when(F.col("rank") <= k, gain)).alias("idcg"))
    sessions = top.groupBy("case_id").agg(F.countDistinct("session").alias("unique_sessions"))
    j = ideal.join(hits, "case_id", "left").join(sessions, "case_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return j.select(
        "case_id", zero(F.col("found") / F.col("relevant")).alias("recall"), zero(1 / F.col("best")).alias("mrr"), zero(F.col("dcg") / F.col("idcg")).alias("ndcg"),
        F.coalesce("unique_sessions", F.lit(0)).alias("unique_sessions"),
    )


def means(cases: DataFrame) -> DataFrame:
    return cases.agg(F.count("*").alias("cases"), *[F.avg(c).alias(c) for c in ("recall", "mrr", "ndcg", "unique_sessions")])
