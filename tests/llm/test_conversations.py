from loomspan.llm.conversations import conversations, event_counts, event_kinds, message_events
from loomspan.operators.identifiers import versions
from tests.conftest import item, omp_row

MESSAGE = "record_id string, source string, ts long, content string, place long"
SAY = [item(text="hello")]


def run(spark, omp, rows, messages=()):
    got = conversations(omp(rows), spark.createDataFrame(list(messages), MESSAGE)).collect()
    return sorted((r["session_id"], r["turn_no"], r["id"], r["speaker"]) for r in got)


def line(session, *turns, start=1):
    """Rows in one line; each turn is (role, items)."""
    rows, before = [], None
    for k, (role, items) in enumerate(turns):
        rows.append(omp_row(start + k, id=f"{session}{k}", parent=before, session=session, role=role, items=items))
        before = f"{session}{k}"
    return rows


def test_keeps_and_orders(spark, omp):
    rows = line("a", (" USER", SAY), ("futureRole", SAY), ("Agent", SAY), ("tool_result", None), ("system", []))
    rows[1] = omp_row(2, id="a1", parent="a0", session="a", type="model_change", message=False)
    got = run(spark, omp, rows[::-1])
    assert got == [("a", 1, "a0", "user"), ("a", 2, "a2", "assistant"), ("a", 3, "a3", "tool"), ("a", 4, "a4", "system")]


def test_drops(spark, omp):
    rows = line("fork", ("user", SAY), ("assistant", SAY), start=10) + [omp_row(13, id="forkx", parent="fork0", session="fork", role="assistant", items=SAY)]
    rows += line("lost", ("user", SAY), ("assistant", SAY), start=20) + [omp_row(23, id="lostx", parent="nowhere", session="lost", role="assistant", items=SAY)]
    rows += line("two", ("user", SAY), ("assistant", SAY), start=30) + [omp_row(33, id="twox", session="two", role="assistant", items=SAY)]
    rows += [omp_row(40, id="r0", parent="r1", session="ring", items=SAY), omp_row(41, id="r1", parent="r0", session="ring", role="assistant", items=SAY)]
    rows += line("empty", ("user", [item(text=" \n")]), ("assistant", [item("toolCall", id="c50")]), start=50)
    rows += line("late", ("user", SAY), ("user", SAY), ("assistant", SAY), start=60)
    rows += line("mute", ("user", SAY), ("assistant", [item(text=" ")]), start=70)
    rows += line("open", ("user", SAY), ("assistant", SAY), ("user", SAY), start=80)
    rows += line("call", ("user", SAY), ("assistant", [item("toolCall", id="c90")]), start=90)
    assert {r[0] for r in run(spark, omp, rows)} == {"call"}


def test_copies_fold_first(spark, omp):
    rows = line("a", ("user", SAY), ("assistant", SAY))
    rows.append(omp_row(9, id="a1", parent="a0", session="a", role="assistant", items=[item(text="longer")], output=7))
    assert run(spark, omp, rows) == [("a", 1, "a0", "user"), ("a", 2, "a1", "assistant")]


def test_planted_events_fold_by_version(spark, omp):
    """A turn is edited, one is retried under another id, one is deleted; a deletion of nothing changes nothing."""
    rows = line("a", ("user", SAY), ("assistant", SAY), ("user", SAY))
    rows.append(omp_row(10, id="a1", parent="a0", session="a", role="assistant", items=[item(text="edited")], output=7))
    rows.append(omp_row(11, id="a0-again", session="a", role="user", items=SAY, mid="m0", output=3))
    rows[0] = omp_row(1, id="a0", session="a", role="user", items=SAY, mid="m0", output=5)
    rows.append(omp_row(12, id="a2", session="a", type="message_deleted", message=False))
    rows.append(omp_row(13, id="nothing", session="a", type="delete", message=False))
    assert run(spark, omp, rows) == [("a", 1, "a0", "user"), ("a", 2, "a1", "assistant")]
    events = message_events(omp(rows)).persist()
    kinds = {r["rec_id"]: r["kind"] for r in event_kinds(events, versions(events)).collect()}
    assert kinds == {1: "create", 2: "create", 3: "create", 10: "edit", 11: "retry", 12: "delete", 13: "delete"}
    assert {r["kind"]: r["events"] for r in event_counts(omp([*rows, omp_row(14, id="a1")])).collect()} == {"create": 3, "edit": 1, "retry": 1, "delete": 2, "copy": 1}


def test_order_by_time_without_parents(spark, omp):
    rows = [omp_row(1, id="x", session="t", role="assistant", items=SAY), omp_row(2, id="y", session="t", items=SAY), omp_row(3, id="z", session="t", type="model_change", message=False)]
    stamps = [("x", "omp", 9_000_000, None, 1), ("x", "omp", 9_000_000, None, 1), ("y", "omp", 5, None, 1), ("y", "claude", 1, None, 1)]
    assert run(spark, omp, rows, stamps) == [("t", 1, "y", "user"), ("t", 2, "x", "assistant")]
    assert run(spark, omp, rows, stamps[2:]) == []  # a speaker without time
    assert run(spark, omp, rows, [("x", "omp", 5, None, 1), ("y", "omp", 5, None, 1)]) == []  # two at one time


def test_blocks_of_places(spark, omp, monkeypatch):
    """Numbering and replies across blocks of places."""
    from loomspan.llm import conversations as c

    monkeypatch.setattr(c, "BLOCK", 2)
    turns = [("user", SAY), ("tool", None), ("tool", None), ("tool", None), ("assistant", SAY)] * 2
    got = run(spark, omp, line("a", *turns))
    assert [r[1] for r in got] == list(range(1, 11)) and [r[2] for r in got] == [f"a{k}" for k in range(10)]
    assert run(spark, omp, line("b", *turns[:4], *turns)) == []


def test_edges(spark, omp):
    assert run(spark, omp, []) == []
    long = [item(text="w " * 400_000)]
    assert len(run(spark, omp, line("a", ("user", long), ("assistant", long)))) == 2
    assert run(spark, omp, [omp_row(1, id=None, items=None), omp_row(2, id=None, items=[None])]) == []
