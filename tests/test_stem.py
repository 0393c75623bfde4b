import pytest
from pyspark.sql import functions as F

from loomspan.functions.stem import stem
from loomspan.operators import lexical
from loomspan.operators.index import Index, bucket_of, resident

# from the published sample vocabulary
PAIRS = {
    "consign": "consign", "consigned": "consign", "consigning": "consign", "consignment": "consign", "consist": "consist", "consisted": "consist", "consistency": "consist", "consistent": "consist", "consistently": "consist", "consisting": "consist",
    "consolation": "consol", "consolations": "consol", "consolatory": "consolatori", "console": "consol", "consoled": "consol", "consoles": "consol", "consolidate": "consolid", "consolidated": "consolid", "consolingly": "consol", "consols": "consol",
    "consonant": "conson", "consort": "consort", "conspicuous": "conspicu", "conspicuously": "conspicu", "conspiracy": "conspiraci", "conspirator": "conspir", "constable": "constabl", "constancy": "constanc", "constant": "constant",
    "knack": "knack", "knackeries": "knackeri", "knave": "knave", "knavish": "knavish", "kneaded": "knead", "kneel": "kneel", "knees": "knee", "knew": "knew", "knife": "knife", "knightly": "knight", "knitted": "knit", "knives": "knive", "knocker": "knocker", "knotty": "knotti", "knows": "know",
    "migration": "migrat", "migrations": "migrat", "generate": "generat", "generously": "generous", "hopping": "hop", "hoping": "hope", "happy": "happi", "ties": "tie", "cries": "cri", "gas": "gas", "this": "this", "dying": "die", "succeeded": "succeed", "relational": "relat", "rational": "ration", "y": "y", "by": "by", "say": "say",
}


@pytest.mark.parametrize("word", sorted(PAIRS))
def test_sample(word):
    assert stem(word) == PAIRS[word]


def test_search_by_stem(spark):
    d = spark.createDataFrame([(1, "benchmark database migrations document"), (2, "other"), (3, None)], "doc_id long, text string")
    assert [r["doc_id"] for r in lexical.bm25(d, "text", "migration", True).collect()] == [1] and lexical.bm25(d, "text", "migration").count() == 0


QUESTIONS = ("alpha", "alpha beta^3", "+segment -alpha query", '"last segment"', '"last segment" +query delta', "nowhere", "größe -данные", "alpha -beta", "数据")


def corpus(spark, n=60):
    words = "alpha beta gamma delta last segment query Größe данные 数据".split()
    docs = [(i, f"s{i % 4}", " ".join(words[(i * k + k) % 10] for k in range(1, 3 + i % 9))) for i in range(n)] + [(998, "s0", None), (999, "s1", "")]
    return spark.createDataFrame(docs, "doc_id long, session string, text string")


def scores(df):
    return {r["doc_id"]: round(r["score"], 9) for r in df.collect()}


def test_written_index_scores_alike(spark, tmp_path):
    d = corpus(spark)
    ix = Index(spark, str(tmp_path / "ix")).create(d, "doc_id", "text", ("session",), buckets=5, splits=2)
    each = ix.search_each(dict(enumerate(QUESTIONS))).collect()
    for k, q in enumerate(QUESTIONS):
        want = scores(lexical.bm25(d, "text", q))
        assert scores(ix.search(q)) == want, q
        assert {r["doc_id"]: round(r["score"], 9) for r in each if r["case"] == k} == want, q
    assert {r["session"] for r in ix.search("alpha").collect()} <= {"s0", "s1", "s2", "s3"} and scores(ix.search("größe")) and scores(ix.search("Данные"))
    with pytest.raises(ValueError):
        ix.search("-alpha")


def test_segments_and_removal(spark, tmp_path):
    """Appended, replaced and removed documents; a merge changes no result."""
    d = corpus(spark, 40)
    ix = Index(spark, str(tmp_path / "ix")).create(d.where("doc_id < 20"), "doc_id", "text", buckets=3, splits=2)
    for low in (20, 25, 30, 35):
        ix.append(d.where(f"doc_id >= {low} and doc_id < {low + 5}"), merge_from=100)
    ix.append(d.where("doc_id >= 40"), merge_from=100)
    whole = {q: scores(lexical.bm25(d, "text", q)) for q in QUESTIONS}
    assert len(ix.manifest["segments"]) == 6 and all(scores(ix.search(q)) == whole[q] for q in QUESTIONS)
    ix.append(spark.createDataFrame([(7, "s9", "omega omega")], "doc_id long, session string, text string"), merge_from=100)
    assert 7 not in scores(ix.search("alpha")) and set(scores(ix.search("omega"))) == {7}
    ix.remove(spark.createDataFrame([(8,), (9,)], "doc_id long"))
    before = {q: set(scores(ix.search(q))) for q in QUESTIONS}
    assert before == {q: set(whole[q]) - {7, 8, 9} for q in QUESTIONS}
    ix.merge()
    assert len(ix.manifest["segments"]) == 1 and not ix.manifest["gone"] and {q: set(scores(ix.search(q))) for q in QUESTIONS} == before
    now = d.where("doc_id not in (7, 8, 9)").unionByName(spark.createDataFrame([(7, "s9", "omega omega")], "doc_id long, session string, text string"))
    assert all(scores(ix.search(q)) == scores(lexical.bm25(now, "text", q)) for q in QUESTIONS[:3])
    assert len(ix.collect_garbage()) > 5 and set(scores(ix.search("omega"))) == {7}


def test_resident_index_is_written_once(spark, tmp_path):
    d = corpus(spark, 10)
    d.write.parquet(str(tmp_path / "t.parquet"))
    one = resident(spark, "t", str(tmp_path / "t.parquet"), d, "doc_id", "text", stemmed=True)
    g = one.manifest["generation"]
    assert resident(spark, "t", str(tmp_path / "t.parquet"), d, "doc_id", "text", stemmed=True).manifest["generation"] == g
    assert scores(one.search("segments queries")) == scores(lexical.bm25(d, "text", "segments queries", True))


def test_bucket_is_the_engines(spark):
    for w in ("alpha", "größe", "数据", ""):
        assert spark.range(1).select(F.pmod(F.xxhash64(F.lit(w)), F.lit(16))).first()[0] == bucket_of(w, 16)
