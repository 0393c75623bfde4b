import json
import random

import pytest
from pyspark.sql import functions as F

from loomspan.llm.truncation import cut_rates, cut_rows, incomplete_ending, judged, length_hazards, message_texts

MESSAGE = "row_id long, source string, role string, content string, content_bytes long, truncated boolean, reason string, noted string"
LINE = "line_id long, source_path string, raw string, noted string"


def messages(spark, rows):
    return spark.createDataFrame([(i, s, "user", t, b, c, "x", "x") for i, s, t, b, c in rows], MESSAGE)


def cuts(spark, rows, raws=()):
    lines = spark.createDataFrame([(i, "p", r, "x") for i, r in enumerate(raws)], LINE)
    return {(r["table_name"], r["row_id"]) for r in cut_rows(messages(spark, rows), lines).collect()}


@pytest.mark.parametrize(
    "text,want",
    [(None, False), ("", False), ("  \n", False), ("ok", False), ("try once more", False), ("It works. It is do", True), ("It works. Done", True), ("Done.\nexit code: 0", False), ("One. Two ", True), ("All done. 👍", False),
     ("これは長い文です。次の文", True), ("これは文です。", False), ("half a char�", True), ("Is it so? Yes!", False), ("A sentence without any end that goes on and on for quite some time now", True), ("x" * 300_000 + ".", False)],
)
def test_endings(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(incomplete_ending(F.col("t"))).first()[0] is want


def test_marks_and_notes(spark):
    rows = [
        (1, "a", "All fine.", None, True), (2, "a", "All fine.", 900, False), (3, "a", "All fine.", 9, False), (4, "a", None, 5, None), (5, "a", "Head [… 120 bytes omitted …] tail.", None, None), (6, "a", "It said that more rows were not shown.", None, None),
        (7, "a", "The output was truncated in the old run, and `truncated_fields` is empty now.", None, None), (8, "a", "Begin <77 bytes elided> end.", None, None), (9, "a", "Begin\n... 72 more lines omitted", None, None), (10, None, "x (...9 more results not shown)", None, None),
        (1, "a", "All fine.", None, True),
    ]
    assert {r for _, r in cuts(spark, rows)} == {1, 2, 5, 8, 9, 10}


def test_lines(spark):
    good = {"type": "T", "content": "Whole."}
    raws = [json.dumps(good), json.dumps(good)[:-4], "not-json", "null", "", None, json.dumps(good | {"truncated_fields": ["content"]}), json.dumps(good | {"truncated_fields": []}), json.dumps(good | {"content": None}), json.dumps(good | {"content": "Cut. In the mid"}), json.dumps(good | {"truncated_fields": None})]
    assert {r for _, r in cuts(spark, [], raws)} == {1, 6, 9}


def test_limits_are_found(spark):
    """A source that cuts at 500 bytes: open endings there are cut, whole texts of that length aren't, nor other lengths."""
    r, rows = random.Random(1), []
    words = lambda n: "".join(r.choice("abcdefgh ij") for _ in range(n))
    for i in range(600):
        n = r.randint(80, 700)
        body = "Start. " + words(n) + "x."
        rows.append((i, "s", body if len(body) < 480 or i % 2 else body[:300] + ".", None, None))
    rows = [(i, s, t if len(t) <= 500 else t[:499] + ")", b, c) for i, s, t, b, c in rows]
    rows += [(1000 + i, "s", ("Start. " + words(492 - i % 3) + "y.")[:498].ljust(499, "z") + ".", None, None) for i in range(3)]
    reasons = {x["row_id"]: x["reason"] for x in judged(message_texts(messages(spark, rows))).collect()}
    at = {i for i, _, t, _, _ in rows if len(t) == 500 and t.endswith(")")}
    assert len(at) > 50 and {i for i, why in reasons.items() if why == "limit"} == at
    assert all(reasons[1000 + i] is None for i in range(3))


def test_two_limits_in_a_source(spark):
    """A limit of one tool shows though most texts of the source run on past it; whole French questions at one length aren't cut."""
    r, rows = random.Random(2), []
    for i in range(2000):
        n = r.randint(80, 2000)
        rows.append((i, "s", ("Start. " + "".join(r.choice("abcdefghij") for _ in range(n)))[: 300 if i % 10 == 0 else 1500], None, None))
    rows = [(i, s, t[:-1] + (")" if len(t) in (300, 1500) else "."), b, c) for i, s, t, b, c in rows]
    rows += [(5000 + i, "s", f"Pourquoi la session s'arrête-t-elle au bout de {1000 + i} petites millisecondes ?", None, None) for i in range(60)]
    reasons = {x["row_id"]: x["reason"] for x in judged(message_texts(messages(spark, rows))).collect()}
    low = {i for i, _, t, _, _ in rows if len(t) == 300 and t.endswith(")")}
    assert len(low) > 100 and {i for i, _, t, _, _ in rows if t.endswith(")")} == {i for i, why in reasons.items() if why == "limit"}
    assert all(reasons[5000 + i] is None for i in range(60))


def test_rates_and_empty(spark):
    got = cut_rates(messages(spark, [(1, "a", "Fine.", None, True), (2, "a", "Fine.", None, None), (3, "b", "Fine. Bu", None, None)]), spark.createDataFrame([], LINE)).collect()
    assert {(r["source"], r["rows"], r["cut_rows"], r["marked"], r["broken"]) for r in got} == {("session_message/a", 2, 1, 1, 0), ("session_message/b", 1, 1, 0, 1)}
    assert cuts(spark, [], []) == set()


def test_lengths_are_counted_exactly(spark):
    rows = spark.range(20_011).select(F.lit("s").alias("source"), F.lit("chars").alias("measure"), F.lit(500).alias("len"), F.xxhash64("id").alias("mark"))
    more = spark.range(5_000).select(F.lit("s").alias("source"), F.lit("chars").alias("measure"), F.lit(700).alias("len"), F.xxhash64(-F.col("id") - 1).alias("mark"))
    got = {r["len"]: (r["n"], r["hazard"]) for r in length_hazards(rows.unionByName(rows).unionByName(more)).collect()}
    assert got == {500: (20_011, 20_011 / 25_011), 700: (5_000, 1.0)}


def test_a_field_limit_of_few_characters_is_found(spark):
    """Texts cut at 24 characters have no sentence before and none is long, yet the length shows."""
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()
    texts = [" ".join(words[(k * 7 + j * (k + 3)) % 10] for j in range(9)) for k in range(60)]
    rows = [(k, "short", t[:24].strip().ljust(24, "x"), None, None) for k, t in enumerate(texts)]
    rows += [(100 + k, "short", "y" * (3 + k % 19) + str(k), None, None) for k in range(40)]
    got = {r["row_id"]: r["reason"] for r in judged(message_texts(messages(spark, rows))).collect()}
    assert all(got[k] == "limit" for k in range(60)) and not any(got[100 + k] == "limit" for k in range(40))


def test_blanks_behind_a_sentence_are_whole(spark):
    df = spark.createDataFrame([("Done. ok. ",), ("All is well.\n",), ("It stops at the ",), ("fix it \n",), ("fine",)], "t string")
    assert [r[0] for r in df.select(incomplete_ending(F.col("t"))).collect()] == [False, False, True, True, False]
