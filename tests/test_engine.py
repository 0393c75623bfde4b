import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomspan.engine import Engine, SearchRequest, add_vectors, append_trace, federate, read_cases, referenced, retain_vectors
from loomspan.operators import context, evaluate, lexical, memory, usage
from loomspan.operators.index import Index

REC = "source string, doc_id long, ts long, project string, session_id string, source_path string, turn_id int, role string, text string, tool_name string, event_id string, conversation_kind string"


def rec(i, text, session="s", role="user", source="pi", ts=None, project="p"):
    return (source, i, 100 * i if ts is None else ts, project, session, f"/x/{session}", i, role, text, None, f"e{i}", None)


@pytest.fixture(scope="module")
def engine(spark):
    rows = [rec(1, "alpha beta"), rec(2, "alpha alpha gamma", role="assistant"), rec(3, "beta delta", "t", source="codex_history"), rec(4, None, "t", source="codex_history"), rec(5, "", "t", source="codex_history"), rec(6, "alpha beta gamma delta", "u", "assistant", project="q")]
    sessions = spark.createDataFrame([("pi", "s", "/x/s", "p", "/w", None, None, 300, 2, None, None), ("codex_history", "t", "/x/t", "p", "/w/z", None, "repo", 0, 3, " ", "guardian_review"), ("pi", "u", "/x/u", "q", "/wx", "/w", None, 600, 1, "Title", "subagent")], "source string, session_id string, source_path string, project string, cwd string, git_root string, repo_project string, last_at long, message_count long, label string, conversation_kind string")
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (6, [0.9, 0.1]), (9, [1.0, 0.0])], "doc_id long, embedding array<float>")
    return Engine(spark, spark.createDataFrame(rows, REC), sessions, vectors=vectors)


def ids(df):
    return [r["doc_id"] for r in df.collect()]


def test_search(engine):
    find = lambda **a: ids(engine.search(SearchRequest(**a)))
    assert find(queries=("alpha",)) == [2, 1, 6] and find(queries=("alpha",), role="user") == [1] and find(queries=("alpha",), until=200, since=200) == [2]
    assert find(queries=("+alpha -gamma",)) == [1] and find(queries=('"beta gamma"',)) == [6] and find(queries=("alpha AND beta",)) == [1, 6] and find(queries=("nothing",)) == []
    assert set(find(queries=("  ",))) == {1, 2, 3, 4, 5, 6} and find(queries=("beta",), source="codex") == [3] and find(queries=("alpha",), sort="ts") == [6, 2, 1]
    assert find(vector=(1.0, 0.0)) == [1, 6, 2] and find(vector=(1.0, 0.0), project="q") == [6] and find(queries=("gamma",), vector=(1.0, 0.0), hybrid=True) == [2, 6, 1]
    assert find(queries=("alpha", "beta", "alpha")) [0] == 1 and find(queries=("alpha",), per_session=1) == [2, 6] and find(queries=("alpha",), kind="subagent") == [6] and find(queries=("beta",), kind="primary") == [1]
    assert find(queries=("alpha",), recency_weight=1.0, now_ms=600, half_life_days=1e-6)[0] == 6
    for bad in ({"limit": 0}, {"recency_weight": -1.0}, {"kind": "x"}, {"recency_weight": 1.0}, {"per_session": 0}):
        with pytest.raises(ValueError):
            find(**bad)


def test_catalogue_and_context(engine, spark):
    assert [r["session_id"] for r in engine.session_list(below="/w").collect()] == ["u", "s"] and {(r["project"], r["last_at"]) for r in engine.projects().collect()} == {("q", 600), ("p", 300)}
    assert [(r["doc_id"], r["distance"], r["relation"]) for r in engine.context(2, 1, 5).collect()] == [(1, -1, "before"), (2, 0, "anchor")]
    with pytest.raises(LookupError):
        engine.show(99)
    assert {r["session_id"]: r["title"] for r in engine.titles().collect()} == {"s": "alpha beta", "t": "beta delta", "u": "Title"} and ids(engine.needing_vectors()) == [3]
    assert engine.stats().first()["sessions"] == 3 and [r["value"] for r in engine.activity(0, 86_400_000).collect()] == [2]


def test_vectors_and_federation(engine, spark):
    more = add_vectors(engine.vectors, spark.createDataFrame([(1, [5.0, 5.0]), (7, [1.0, 1.0]), (7, [1.0, 1.0])], engine.vectors.schema), 2)
    assert sorted(ids(more)) == [1, 2, 6, 7, 9] and ids(retain_vectors(more, spark.createDataFrame([(7,)], "doc_id long"))) == [7]
    with pytest.raises(Exception, match="dimensions"):
        add_vectors(engine.vectors, spark.createDataFrame([(8, [1.0])], engine.vectors.schema), 2).collect()
    a = spark.createDataFrame([(1, 9.0, 5), (2, 1.0, 6)], "doc_id long, score double, ts long")
    merged, failed = federate({"m": a, "n": a, "dead": RuntimeError()})
    assert failed == ["dead"] and sorted(round(r["score"], 6) for r in merged.collect()) == [round(1 / 62, 6)] * 2 + [round(1 / 61, 6)] * 2
    assert [r["score"] for r in federate({"m": a})[0].collect()] == [9.0, 1.0]


def test_evaluation(engine, spark, tmp_path):
    p = tmp_path / "cases.jsonl"
    p.write_text(json.dumps({"id": "a", "query": "alpha", "relevant": [{"doc_id": 2}, {"doc_id": 99}]}) + "\n" + json.dumps({"id": "b", "queries": ["nothing"], "relevant": [{"doc_id": 1, "relevance": 2}]}) + "\n")
    got = {r["case_id"]: r for r in engine.evaluate(read_cases(spark, str(p)), 5).collect()}
    assert (got["a"]["recall"], got["a"]["mrr"], got["a"]["unique_sessions"]) == (0.5, 1.0, 2) and (got["b"]["recall"], got["b"]["ndcg"]) == (0.0, 0.0)
    p.write_text(json.dumps({"id": "a", "query": " ", "relevant": [{"doc_id": 2}]}) + "\n")
    with pytest.raises(Exception, match="empty or given twice"):
        read_cases(spark, str(p)).collect()
    res = spark.createDataFrame([(1, 1, "x", "s"), (1, 2, "x", "s"), (1, 3, "y", "t")], "case_id int, rank int, key string, session string")
    rel = spark.createDataFrame([(1, "x", 1.0), (1, "y", 2.0), (1, "y", 3.0), (1, "z", 0.0)], "case_id int, key string, relevance double")
    e = evaluate.evaluate(res, rel, 3).first()
    assert e["recall"] == 1.0 and e["mrr"] == 1.0 and abs(e["ndcg"] - (1 + 7 / 2) / (7 + 1 / 1.5849625007)) < 1e-6 and e["unique_sessions"] == 2


def test_exchanges_against_brute_force(spark):
    import random

    r = random.Random(5)
    said = [r.choice("ab") for _ in range(30)] + list("xy" * 4) + ["z"] + list("pq" * 2)
    rows = [rec(i, t) for i, t in enumerate(said)]
    want, i = [], 0
    again = [k >= 2 and said[k] == said[k - 2] for k in range(len(said))]
    while i < len(said):
        if again[i]:
            j = i
            while j < len(said) and again[j]:
                j += 1
            n = j - i
            want += list(range(i + (n - n % 2 if n >= 4 else 0), j))
            i = j
        else:
            want.append(i)
            i += 1
    assert sorted(ids(context.collapse_exchanges(spark.createDataFrame(rows, REC)))) == want


def test_memories(spark):
    text = "---\ndate: 2026-01-02\n---\n# Top 2026-03-04\nsee [a](b.md#x) and src/a.rs:12\n````\n# not a heading\n```\n````\n## Top 2026-03-04\n" + "y" * 9000
    s = list(memory.sections(text))
    assert [x["section_id"] for x in s] == ["document", "top-2026-03-04", "top-2026-03-04-2-part-1", "top-2026-03-04-2-part-2"] and s[0]["dates"] == ["2026-01-02"] and s[1]["refs"] == ["b.md#x", "src/a.rs:12"] and "# not a heading" in s[1]["content"]
    assert list(memory.sections("")) == [] and list(memory.sections("\n \n")) == []
    parts = spark.createDataFrame([(1, 0, "alpha one", "", "t"), (1, 1, "alpha two", "alpha", "t"), (1, 2, "alpha three", "", "t"), (2, 0, "beta", "", "t")], "doc_id long, section int, content string, heading string, title string")
    got = memory.search(parts, ["alpha", " ", "alpha"], 10).collect()
    assert [(r["doc_id"], r["section"]) for r in got][0] == (1, 1) and sum(r["doc_id"] == 1 for r in got) == 2 and len(memory.search(parts, ["*"], 10).collect()) == 3
    stored = spark.createDataFrame([("a", "r", "1", "old"), ("b", "r", "1", "old"), ("c", "q", "1", "old")], "path string, root string, version string, text string")
    found = spark.createDataFrame([("a", "r", "2", "new")], stored.schema)
    new = {r["path"]: (r["text"], r["stale"]) for r in memory.refresh(stored, found, spark.createDataFrame([("q",)], "root string")).collect()}
    assert new == {"a": ("new", False), "c": ("old", True)}
    refs = spark.createDataFrame([(1, ["b.md#x", "../no.md", "./b.md:3"])], "doc_id long, refs array<string>")
    docs = spark.createDataFrame([(1, "/m/a.md"), (2, "/m/b.md")], "doc_id long, path string")
    assert {(r["ref"], r["target"]) for r in referenced(refs, docs).collect()} == {("b.md#x", 2), ("./b.md:3", 2)}


def test_usage_rules(spark):
    schema = "source string, source_path string, row_idx long, source_order long, timestamp_ms long, session_id string, provider string, model string, source_record_id string, request_id string, message_id string, raw_input long, uncached_input long, cache_read long, cache_write long, output long, sidechain boolean, chain_break boolean"

    def ev(i, unc=0, read=0, write=0, out=1, t=None, side=False, brk=False, req="r", msg="m", model="x", provider="p"):
        return ("s", "/f", i, i, i * 1000 if t is None else t, "k", provider, model, None, req, msg, unc, unc, read, write, out, side, brk)

    df = lambda *rows: spark.createDataFrame(list(rows), schema)
    best = lambda *rows: sorted(r["row_idx"] for r in usage.keep_best_request(df(*rows)).collect())
    assert best(ev(1, 5), ev(2, 9), ev(3, 99, side=True)) == [2] and best(ev(1, 5), ev(2, 5)) == [2] and best(ev(1, req=None), ev(2, req=None)) == [1, 2] and best(ev(1, side=True, req="a"), ev(2, req="b")) == [2] and best(ev(1, side=True, msg=None), ev(2)) == [1, 2]
    miss = lambda *rows: [(r["row_idx"], r["missed"], r["why"]) for r in usage.cache_misses(df(*rows)).collect()]
    assert miss(ev(1, 10, write=5000), ev(2, 5100)) == [(2, 5010, "other")] and miss(ev(1, 10, write=5000), ev(2, 5100, t=400_000)) == [(2, 5010, "idle")] and miss(ev(1, 10, write=5000), ev(2, 5100, model="y")) == [(2, 5010, "switch")]
    assert miss(ev(1, 5000), ev(2, 5000)) == [] and miss(ev(1, write=5000), ev(2, 900, read=4100)) == [] and miss(ev(1, write=5000), ev(2, 2000)) == [] and miss(ev(1, write=5000), ev(2, 0, out=3, brk=True), ev(3, 5000)) == []
    rates = spark.createDataFrame([("p", "x", 1_000_000, 10, 20, 3)], "provider string, model string, input long, cache_read long, cache_write long, output long")
    cost = lambda e: usage.with_rates(df(e), rates).select(usage.cost_nanos().alias("c")).first()["c"]
    assert cost(ev(1, 2, out=0, model="X-2026-01-02")) == 2 and cost(ev(1, 2, out=0, model="x-mini")) is None and cost(ev(1, 2, out=0, provider=None)) == 2 and cost(ev(1, 2, out=0, provider="zz")) is None and cost(ev(1, 0, out=1)) == 0


def test_parse_and_trace(spark, tmp_path):
    q = lexical.parse('text:one +two -three "four five" six^2.5 a AND b')
    assert q.terms == ("one", "six") and q.must == ("two", "a", "b") and q.must_not == ("three",) and q.phrases == (("four", "five"),) and q.boosts == {"six": 2.5}
    t = spark.createDataFrame([(1, "secret")], "doc_id long, text string")
    append_trace(t, str(tmp_path / "t"))
    append_trace(t, str(tmp_path / "t"))
    assert spark.read.json(str(tmp_path / "t")).columns == ["doc_id"] and spark.read.json(str(tmp_path / "t")).count() == 2


def test_section_ids_differ():
    assert memory.section_ids(["X", "x", "x 2", "x-2-2"], [1, 1, 1, 1]) == [["x"], ["x-2"], ["x-2-2"], ["x-2-2-2"]]
    assert memory.section_ids(["T part 1", "T", None, "!"], [1, 2, 1, 1]) == [["t-part-1"], ["t-part-1-2", "t-part-2"], ["document"], ["document-2"]]
    for text in ("# A\n" + "x" * 8000 + "\n# A-part-1\nl\n", "# A\n1\n# A\n2\n# A-2\n3\n"):
        ids = [x["section_id"] for x in memory.sections(text)]
        assert len(set(ids)) == len(ids)


def test_memory_filters_and_limits(spark):
    rows = [(1, 0, "P", "/w", "a", 10), (2, 0, "q", "/w/z", "b", 20), (3, 0, None, None, "a", 30)]
    d = spark.createDataFrame(rows, "doc_id long, section int, project string, cwd string, source string, mtime long")
    ids = lambda **f: sorted(r["doc_id"] for r in memory.eligible(d, **f).collect())
    assert ids(project="p") == [1] and ids(cwd="/w/z/k") == [1, 2] and ids(cwd="/wz") == [] and ids(source="a", since=10, until=29) == [1] and ids() == [1, 2, 3]
    parts = spark.createDataFrame([(i, 0, "alpha beta", "alpha", "t") for i in (1, 2, 3)], "doc_id long, section int, content string, heading string, title string")
    got = memory.search(parts, ["alpha"], 5, allowed=memory.eligible(d, source="a"), newest_first=True).collect()
    assert [r["doc_id"] for r in got] == [3, 1]
    with pytest.raises(ValueError):
        memory.search(parts, [f"q{i}" for i in range(9)], 5)


def test_search_by_index_and_refusals(spark, tmp_path):
    rows = [(i, "pi", f"s{i % 3}", f"/p{i % 3}", "proj", i * 10, "user" if i % 2 else "assistant", None, "migrations of segment " + "query " * (i % 4)) for i in range(20)]
    r = spark.createDataFrame(rows, "doc_id long, source string, session_id string, source_path string, project string, ts long, role string, tool_name string, text string").withColumn("turn_id", F.col("doc_id").cast("int"))
    ix = Index(spark, str(tmp_path / "ix")).create(r, "doc_id", "text", ("source", "session_id", "source_path", "project", "ts", "role", "tool_name"), stemmed=True, buckets=4)
    for q in (SearchRequest(("query", "migration"), role="user"), SearchRequest(("+segment query",), since=50, fields="full"), SearchRequest(("",)), SearchRequest(("queries",), per_session=1, recency_weight=1.0, now_ms=10**6)):
        told = [[(*x[:-1], round(x[-1], 9)) for x in e.search(q).collect()] for e in (Engine(spark, r, index=ix), Engine(spark, r))]
        assert told[0] == told[1] and told[0]
    fast = Engine(spark, r, index=ix).search(SearchRequest(("query", "segment"), role="user"))
    assert "text" not in fast._jdf.queryExecution().optimizedPlan().toString()
    e = Engine(spark, r, vectors=spark.createDataFrame([(1, [1.0])], "doc_id long, embedding array<double>"), vector_model="m1")
    for bad in (SearchRequest(tuple(f"q{i}" for i in range(9))), SearchRequest(("x" * 5000,)), SearchRequest(fields="some"), SearchRequest(vector=(1.0,), model="m2")):
        with pytest.raises(ValueError):
            e.search(bad)
    with pytest.raises(ValueError):
        e.context(1, before=1001)
    assert e.show_field("text", 3, 4, doc_id=0).collect()[0][1:] == ("rati", 7) and e.lookup(source="pi", source_path="/p1").count() == 7


def test_rates_by_provider(spark):
    """A model that two providers offer has the rates of each."""
    rates = spark.createDataFrame([("one", "m", 1, 0, 0, 0), ("one-cloud", "m", 2, 0, 0, 0), ("two", "m", 3, 0, 0, 0), ("two", "m", 3, 0, 0, 0)], "provider string, model string, input bigint, cache_read bigint, cache_write bigint, output bigint")
    e = spark.createDataFrame([(1, "one", "M-2026-01-02"), (2, "two", "m"), (3, "one-cloud/eu", "m"), (4, None, "m"), (5, "three", "m"), (6, "one", None)], "row_idx long, provider string, model string")
    assert {r["row_idx"]: r["r_input"] for r in usage.with_rates(e, rates).collect()} == {1: 1, 2: 3, 3: 2, 4: 2, 5: None, 6: None}


def test_chains_of_sessions_and_files(spark):
    """One store writes a file for each message, so there the session is the chain; elsewhere the file is."""
    row = lambda i, source, path, prompt, read: (source, path, i, i, i * 1000, "s", "p", "m", prompt, read, 0, False, False)
    cols = "source string, source_path string, row_idx long, source_order long, timestamp_ms long, session_id string, provider string, model string, uncached_input long, cache_read long, cache_write long, sidechain boolean, chain_break boolean"
    rows = [row(i, s, f"{s}{i}", 9000, 5000 if i == 1 else 0) for s in ("opencode", "pi") for i in (1, 2)]
    got = [(r["source"], r["missed"]) for r in usage.cache_misses(spark.createDataFrame(rows, cols)).collect()]
    assert got == [("opencode", 9000)]


def test_reconcile_by_source(spark):
    cols = "source string, source_path string, row_idx long, source_order long, timestamp_ms long, session_id string, source_record_id string, message_id string, request_id string, sidechain boolean, raw_input long, uncached_input long, cache_read long, cache_write long, cache_write_1h long, output long, reasoning long"
    def row(i, source, rid="r", mid="m", req="q", out=1, reasoning=0):
        return (source, "/p", i, i, i, "s", rid, mid, req, False, 1, 1, 0, 0, 0, out, reasoning)
    rows = [row(1, "claude", out=1), row(2, "claude", out=5), row(3, "codex"), row(4, "codex"), row(5, "codex", reasoning=2), row(6, "opencode"), row(7, "opencode", out=9), row(8, "grok"), row(9, "grok")]
    assert sorted(r["row_idx"] for r in usage.reconcile(spark.createDataFrame(rows, cols)).collect()) == [2, 3, 5, 6, 8, 9]


def test_backfill_and_merge(spark, tmp_path):
    from loomspan.operators import activity
    from loomspan.operators.vectors import VectorIndex

    def model(texts):
        return np.array([[len(t), 1.0] for t in texts])

    r = spark.createDataFrame([(1, "user", "a"), (2, "tool", "b"), (3, "assistant", "ccc"), (4, "user", " ")], "doc_id long, role string, text string")
    index = VectorIndex(spark, str(tmp_path / "v"))
    Engine(spark, r.where("doc_id < 3")).backfill(index, model, 2, "m1")
    Engine(spark, r).backfill(index, model, 2, "m1")
    assert sorted(x["doc_id"] for x in index.stored().collect()) == [1, 3]
    with pytest.raises(ValueError):
        Engine(spark, r).backfill(index, model, 2, "m2")
    days = [spark.createDataFrame(x, "bucket long, source string, value long") for x in ([(0, "pi", 2), (5, "pi", 1)], [(0, "pi", 3), (0, "omp", 1)])]
    assert sorted(map(tuple, activity.merged(days).collect())) == [(0, "omp", 1), (0, "pi", 5), (5, "pi", 1)]
