import pytest

from loomspan.llm import pii

DOC = "doc_id long, text string, kind string, start int, known string"


def found(spark, texts, lexicon=()):
    docs = spark.createDataFrame([(i, t, "x", 1, "x") for i, t in enumerate(texts)], DOC)
    lex = spark.createDataFrame(list(lexicon) or [("Ada", "given")], "token string, token_kind string")
    return {(r["doc_id"], r["pii_kind"], r["pii_text"]) for r in pii.distinct_mentions(docs, lex).collect()}


@pytest.mark.parametrize(
    "text,want",
    [("mail ada.b+c@mail.site.example.", ["ada.b+c@mail.site.example"]), ("a_b [at] site [dot] example!", ["a_b [at] site [dot] example"]), ("x(at)site.test", ["x(at)site.test"]), ("ask ada at site dot example now", ["ada at site dot example"]),
     ("git@host.example:team/repo.git", []), ("pinned thing@1.2.3 and row@3.0.1", []), ("索引a@b.example索引", ["a@b.example"]), ("@decorator and a @ b", []), ("", [])],
)
def test_emails(text, want):
    assert [text[s:e] for s, e in pii.emails(text)] == want


@pytest.mark.parametrize(
    "text,want",
    [("call +1 (336) 555-0108 now", "+1 (336) 555-0108"), ("+44 (0)20 7946 0470.", "+44 (0)20 7946 0470"), ("tel:+33 1 99 00 48 78会", "+33 1 99 00 48 78"), ("0049 30 23125219", "0049 30 23125219"), ("+12105550144", "+12105550144"), ("on 192.0.2.17:1849", None),
     ("n=1 636 555 0170 7 of 12", "1 636 555 0170"), ("030/23125-411;", "030/23125-411")],
)
def test_phones(text, want):
    m = pii.PHONE.search(text)
    assert (m and m.group()) == want


@pytest.mark.parametrize(
    "text,want",
    [("at 1301 Old Tannery Street, Port", "1301 Old Tannery Street"), ("853 Saltmarsh Ave., Apt", "853 Saltmarsh Ave."), ("20 bis avenue du Vieux Chêne, 00999", "20 bis avenue du Vieux Chêne"), ("Schmiedberger Gasse 118a, 99", "Schmiedberger Gasse 118a"),
     ("in C/ Fuente Clara 31, 0", "C/ Fuente Clara 31"), ("Mühlrainstr. 183, 9", "Mühlrainstr. 183"), ("Adresse Hollerweg 9 ist zu", "Hollerweg 9"), ("Adresse Schmiedberger Gasse 4 b, 9", "Schmiedberger Gasse 4 b"), ("See 12 Main loop iterations and 404 Fallback Route in docs", None)],
)
def test_streets(text, want):
    m = pii.STREET.search(text)
    assert (m and m.group()) == want


def test_contexts_teach_shapes_and_names(spark):
    lex = [("Ada", "given"), ("Bela", "given"), ("Cleo", "given"), ("Dunmore", "family"), ("Eskrow", "family"), ("Falk", "family")]
    seeds = [f"{g} {f}" for g in ("Ada", "Bela", "Cleo") for f in ("Dunmore", "Eskrow", "Falk")]
    texts = [f"Ask {n} about the index." for n in seeds]
    texts += [f"Ask {n} about the index." for n in ("Grit Harlow", "Grit Falk", "Ada Harlow", "Grit Eskrow", "Cleo Harlow")]
    texts += [f"My desk is +1 212 555 01{k}, any time." for k in range(10, 16)] + ["My desk is 212.555.0177, any time.", "It took 405.008.3005 ticks.", "It took 405.008.3006 ticks."]
    texts += ["Signed by HARLOW, GRIT today", "g. harlow wrote it", "G. Harlow wrote it", "The Merge Policy and the Query Planner disagree.", "Ask Merge Policy nothing", "Dr. Ada D. Falk and ada falk"]
    got = found(spark, texts, lex)
    base = len(seeds) + 5 + 6
    assert {(i, k) for i, k, _ in got if k == "phone" and i >= base} == {(base, "phone")}
    names = {(i, t) for i, k, t in got if k == "name"}
    assert {(i, n) for i, n in enumerate(seeds)} <= names and (len(seeds), "Grit Harlow") in names
    last = base + 3
    assert {(i - last, t) for i, t in names if i >= last} == {(0, "HARLOW, GRIT"), (2, "G. Harlow"), (5, "Ada D. Falk"), (5, "ada falk")}


def test_ids_by_label_and_context(spark):
    texts = [f"Row {k} holds SSN {900 + k}-11-223{k}." for k in range(5)] + ["Row 9 holds 955-44-1234.", "Offset 7, build 535555927.", "Client gave passport no. NK0829792 by chat."]
    got = found(spark, texts)
    assert (5, "id_number", "955-44-1234") in got and (7, "id_number", "NK0829792") in got and not any(i == 6 for i, _, _ in got)


def test_edges(spark):
    assert found(spark, [None, "", "   ", "x" * 300_000]) == set()
    assert found(spark, []) == set()


def test_redaction_and_join_path(spark):
    docs = spark.createDataFrame([(1, "Mail a@b.example or call +1 212 555 0110.", "k", 1, "x"), (2, None, "k", 1, "x"), (3, "nothing", "k", 1, "x")], DOC)
    lex = spark.createDataFrame([("Ada", "given"), ("Falk", "family")], "token string, token_kind string")
    got = {r["doc_id"]: r["text"] for r in pii.redacted(docs, lex).collect()}
    assert got == {1: "Mail [EMAIL] or call [PHONE].", 2: None, 3: "nothing"}
    texts = spark.createDataFrame([(1, "Ada Falk, ADA FALK and Falk, Ada; Émile Falk"), (2, "none")], "doc_id long, text string")
    known = spark.createDataFrame([("ada", "given"), ("falk", "family")], "token string, role string")
    both = [sorted(tuple(r) for r in pii.found_names(texts, known, most).collect()) for most in (100, 1)]
    assert both[0] == both[1] and [r[4] for r in both[0]] == ["Ada Falk", "ADA FALK", "Falk, Ada"]


def test_names_of_a_single_document(spark):
    """A name with new parts is found where a confident pattern vouches for it, in one document only; it isn't spread to other contexts."""
    lex = [("Ada", "given"), ("Bela", "given"), ("Cleo", "given"), ("Dunmore", "family"), ("Eskrow", "family"), ("Falk", "family")]
    texts = [f"Ask {g} {f} about the index." for g in ("Ada", "Bela", "Cleo") for f in ("Dunmore", "Eskrow", "Falk")]
    texts += ["Ask Farid Zeltmark about the index.", "Ask Jolanta Falk about the index. Then Jolanta Falk left.", "Merge Policy waits.", "Ask Merge Policy about the index.", "The Merge Policy fails.", "Merge Policy again."]
    got = {(i - 9, t) for i, k, t in found(spark, texts, lex) if k == "name" and i >= 9}
    assert got == {(0, "Farid Zeltmark"), (1, "Jolanta Falk")}


def test_vouched_names_dont_overlap(spark):
    names = spark.createDataFrame([(1, "name", 0, 8, "Ada Falk"), (2, "name", 0, 8, "Ada Falk")], "doc_id long, kind string, start int, end int, surface string")
    vouched = spark.createDataFrame([(1, 0, 8, "Ada Falk"), (1, 4, 12, "Falk Xyz"), (1, 8, 12, "A Bc"), (3, 0, 5, "Xy Zz"), (3, 3, 9, "Zz Long")], "doc_id long, start int, end int, surface string")
    assert sorted((r["doc_id"], r["start"], r["end"]) for r in pii.with_vouched(names, vouched).collect()) == [(1, 0, 8), (1, 8, 12), (2, 0, 8), (3, 3, 9)]


def test_join_path_reads_words_alike(spark):
    """Quotes, hyphens, decomposed letters and neighbouring letters of other scripts are the same to both ways of looking names up."""
    said = ["'Ada Falk' said", "’Ada Falk’ said", "-Ada Falk- said", "by E\u0301mile Falk here", "by \u00c9mile Falk here", "会Ada Falk会", "Ada Falk's desk", "Ann-Lou O'Falk came", "_Ada Falk_", "x"]
    texts = spark.createDataFrame(list(enumerate(said)), "doc_id long, text string")
    known = spark.createDataFrame([("ada", "given"), ("\u00e9mile", "given"), ("ann-lou", "given"), ("falk", "family"), ("o'falk", "family")], "token string, role string")
    both = [sorted(tuple(r) for r in pii.found_names(texts, known, most).collect()) for most in (100, 1)]
    assert both[0] == both[1] and {r[0] for r in both[0]} >= {0, 2, 3, 4, 5, 7}


def test_anchored_searches_find_what_whole_texts_hold():
    """What is looked for around digits, street words and capitals is what the patterns find in the whole text."""
    import random

    r = random.Random(5)
    pieces = ["Ada", "B.", "Falk,", "12", "Main St", "C/ Fuente Clara 31", "99 chemin de la Brande", "Lindgrubenallee 7a,", "+44 20 7946 0577Call", "030/23125-972", "918/26/84390", "KM8959708.", "555-12-3456", "\n", "; ", "St", "Way Out", "Am Kalten Born 2\n", "会", "e\u0301a", "Dr.", "20 0", "x" * 400, "1.2.3-4", "Jo", "L'Or", "-Ann", " A. Bo-Cy"]
    for _ in range(400):
        t = "".join(r.choice(pieces) + r.choice([" ", "", ", ", "\n"]) for _ in range(r.randint(1, 14)))
        got = list(pii.numbers(t))
        for kind, form in (("phone", pii.PHONE), ("id_number", pii.ID_NUMBER)):
            assert {m.span() for k, m in got if k == kind} == {m.span() for m in form.finditer(t)}, t
        assert [m.span() for m in pii.streets(t)] == [m.span() for m in pii.STREET.finditer(t)], t
        assert [m.span() for m in pii.loose_streets(t)] == [m.span() for m in pii.LOOSE_STREET.finditer(t)], t
        assert set(pii.capitalised_spans(t)) == {x for x in pii.name_spans(t, lambda w: w[0].isupper()) if x[4]}, t


def test_what_follows_without_a_blank(spark):
    got = found(spark, ["user_email: a.b@site.exampleOffset 3", "Contact: c@site.test.Mail <d@site.test> now", "tel:+49 30 23125 123Signed-off", "A@SITE.EXAMPLE"])
    assert got == {(0, "email", "a.b@site.example"), (1, "email", "c@site.test"), (1, "email", "d@site.test"), (2, "phone", "+49 30 23125 123"), (3, "email", "A@SITE.EXAMPLE")}


def test_a_token_may_be_given_and_family(spark):
    lex = [("Falk", "given"), ("Falk", "family"), ("Ada", "given"), ("Eskrow", "family")]
    for order in (lex, lex[::-1]):
        names = {t for _, k, t in found(spark, ["see ada falk there", "see falk eskrow there"], order) if k == "name"}
        assert names == {"ada falk", "falk eskrow"}


def test_other_sentences_say_nothing():
    inside, beyond = pii._context("ask Ada Falk about it", 4, 12, "name"), pii._context("Fine. Ada Falk. The rest", 6, 14, "name")
    assert "name|*|about it" in inside and not any("the" in p or "fine" in p for p in beyond)
    assert not any("y" * 9 in p for p in pii._context("y" * 50 + " Ada Falk", 51, 59, "name"))
