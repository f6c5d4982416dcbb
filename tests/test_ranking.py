import math
import random

import pytest

from foliant.operators import evaluate, index, rank

DOCS = {1: "red fox red den", 2: "red bird nest", 3: "blue bird sky blue bird", 4: "green tree"}


@pytest.fixture(scope="module")
def built(spark):
    corpus = spark.createDataFrame([(d, "description", t) for d, t in DOCS.items()], "doc_id bigint, field string, text string")
    return index.Index(index.postings(corpus, []), corpus.selectExpr("count(distinct doc_id) as n_docs"))


def asked(spark, text="red bird bird"):
    return rank.query_terms(spark.createDataFrame([(7, text)], "query_id bigint, text string"), [])


#: Worked by hand from the definitions.
WANT = {
    "ltn.lnn": {1: 1.173600, 2: 1.866747, 3: 1.987078}, "ltc.lnc": {1: 0.261199, 2: 0.559128, 3: 0.340480}, "bm25": {1: 0.916263, 2: 2.208510, 3: 1.701110},
    "lm_naive": {1: -math.inf, 2: -3.295837, 3: -math.inf}, "lm_bayes": {1: -8.234084, 2: -3.452941, 3: -5.857171}, "lm_mixture": {1: -5.496804, 2: -3.885968, 3: -4.594477},
}


@pytest.mark.parametrize("method", rank.METHODS)
def test_scores_by_hand(spark, built, method):
    got = {r.doc_id: round(r.score, 6) for r in rank.scores(built, asked(spark), method).collect()}
    assert got == pytest.approx(WANT[method], abs=2e-6)


def test_norms_and_lengths(built):
    norms = {r.doc_id: round(r.norm, 6) for r in index.doc_norms(built.postings, built.terms(), built.n_docs).collect()}
    assert norms == {1: 2.284942, 2: 1.697857, 3: 2.967912, 4: pytest.approx(1.386294 * math.sqrt(2), abs=1e-5)}
    assert {r.doc_id: r.dl for r in built.lengths().collect()} == {1: 4, 2: 3, 3: 5, 4: 2}


def test_unknown_terms_and_methods(spark, built):
    odd = asked(spark, "red zebra")
    assert all(r.score == -math.inf for r in rank.scores(built, odd, "lm_bayes").collect())
    assert rank.scores(built, asked(spark, "zebra"), "bm25").count() == 0
    with pytest.raises(ValueError):
        rank.scores(built, odd, "lnc.ltc")
    with pytest.raises(ValueError):
        rank.fuse(rank.scores(built, odd, "bm25"), {"description": -1.0})


def test_ties_go_to_the_smaller_id(spark):
    scored = spark.createDataFrame([(1, d, 0.5 + d * 1e-9) for d in (3, 1, 2)], "query_id int, doc_id int, score double")
    assert [r.doc_id for r in rank.top_k(scored, 2).orderBy("rank").collect()] == [1, 2]
    assert rank.top_k(scored, 0).count() == 3


def literal_tiers(postings, n_docs, lengths, avdl, query, k):
    """Tier by tier, as a loop."""
    fixed = {}
    for tier in (1, 2, 3):
        for field in {p[0] for p in postings}:
            part = [p for p in postings if p[0] == field and p[4] == tier]
            df = {}
            for p in part:
                df[p[1]] = df.get(p[1], 0) + 1
            scores = {}
            for _, term, doc, tf, _ in part:
                if term in query:
                    w = math.log(n_docs / df[term]) * 2.2 * tf / (1.2 * (0.25 + 0.75 * lengths[field, doc] / avdl[field]) + tf)
                    scores[doc] = scores.get(doc, 0) + query[term] * w
            for doc, s in scores.items():
                fixed.setdefault((field, doc), s)
        if 0 < k <= len({d for _, d in fixed}):
            break
    out = {}
    for (field, doc), s in fixed.items():
        out[doc] = out.get(doc, 0) + rank.WEIGHTS[field] * s
    return out


@pytest.mark.parametrize("k", [1, 3, 6, 0])
def test_tiered_search_equals_the_loop(spark, k):
    import random

    rnd = random.Random(k)
    rows = [(d, f, " ".join(rnd.choice("abcdefg") for _ in range(rnd.randint(0, 9)))) for d in range(25) for f in index.TIERS]
    corpus = spark.createDataFrame(rows, "doc_id bigint, field string, text string")
    built = index.Index(index.postings(corpus, []), corpus.selectExpr("count(distinct doc_id) as n_docs"))
    quality = spark.createDataFrame([(d, d % 5 + 0.5) for d in range(25)], "doc_id bigint, quality double")
    tiers = index.tiered(built.postings, quality)
    got = {r.doc_id: r.score for r in rank.search(built, asked(spark, "a b b c"), "bm25", k=k, tiers=tiers).collect()}
    lengths = {(r.field, r.doc_id): r.dl for r in built.lengths().collect()}
    avdl = {r.field: r.avdl for r in built.mean_lengths().collect()}
    postings = [(r.field, r.term, r.doc_id, r.tf, r.tier) for r in tiers.select("field", "term", "doc_id", "tf", "tier").collect()]
    want = literal_tiers(postings, 25, lengths, avdl, {"a": 1, "b": 2, "c": 1}, k)
    best = sorted(((-round(s, 6), d) for d, s in want.items()))[: k or None]
    assert {d: -s for s, d in best} == pytest.approx(got, abs=2e-6)


def test_tier_sizes(spark):
    p = spark.createDataFrame([(f, "t", d, 1) for f in index.TIERS for d in range(20)], "field string, term string, doc_id bigint, tf bigint")
    q = spark.createDataFrame([(d, float(d)) for d in range(20)], "doc_id bigint, quality double")
    n = {(r.field, r.tier): r["count"] for r in index.tiered(p, q).groupBy("field", "tier").count().collect()}
    assert n == {("characters", 1): 3, ("characters", 2): 2, ("characters", 3): 15, ("description", 1): 10, ("description", 2): 5, ("description", 3): 5, ("genres", 1): 1, ("genres", 3): 19}


def test_add_and_remove_give_the_same_index(spark, built):
    extra = spark.createDataFrame([(100, "characters", "sandman robin"), (100, "genres", "mystery crime"), (100, "description", "good red")], "doc_id bigint, field string, text string")
    more = index.add_documents(built.postings, extra, [])
    assert more.where("doc_id = 100").count() == 6 and not index.same_index(more, built.postings)
    assert index.same_index(index.remove_documents(more, extra), built.postings)


def test_index_holds_what_a_scan_finds(built):
    for word in ("red", "bird", "tree", "none"):
        assert {r.doc_id for r in index.posting_list(built.postings, "description", word).collect()} == {d for d, t in DOCS.items() if word in t.split()}


def test_store_and_load(spark, built, tmp_path):
    index.store(built.postings, str(tmp_path / "i"))
    assert index.same_index(index.load(spark, str(tmp_path / "i"), "description"), built.postings)
    assert index.load(spark, str(tmp_path / "i"), "genres").count() == 0
    with pytest.raises(ValueError):
        index.store(built.postings, str(tmp_path / "j"), "authors")


def test_measures_by_equal_texts(spark):
    """The same as by judgements, and no pair is made of a query and a document that it doesn't find."""
    rnd = random.Random(4)
    docs = spark.createDataFrame([(f"d{i:02}", rnd.choice(["a", "a", "b", "c", None])) for i in range(40)], "doc_id string, text string")
    queries = docs.where("text <> 'c' and doc_id < 'd25'").withColumnRenamed("doc_id", "query_id").union(spark.createDataFrame([("x", "nowhere")], "a string, b string"))
    runs = spark.createDataFrame([(f"d{q:02}", r, f"d{d:02}") for q in range(0, 24, 2) for r, d in enumerate(rnd.sample(range(40), 10), 1)], "query_id string, rank bigint, doc_id string").join(queries.select("query_id"), "query_id", "left_semi")
    judged = queries.join(docs, "text").select("query_id", "doc_id")
    by = evaluate.per_query_alike(queries, runs, docs)
    assert sorted(map(tuple, by.collect())) == sorted(map(tuple, evaluate.per_query(queries, runs, judged).collect()))
    assert by.where("precision > 0").count() > 2


def test_measures_by_hand(spark):
    q = spark.createDataFrame([(1,), (2,), (3,)], "query_id bigint")
    runs = spark.createDataFrame([(1, 1, "a"), (1, 2, "x"), (1, 3, "b"), (3, 1, "z")], "query_id bigint, rank bigint, doc_id string")
    judged = spark.createDataFrame([(1, "a"), (1, "b"), (1, "c"), (2, "a")], "query_id bigint, doc_id string")
    by = {r.query_id: r for r in evaluate.per_query(q, runs, judged).collect()}
    r = by[1]
    assert (r.precision, r.recall, r.rr) == (pytest.approx(2 / 3), pytest.approx(2 / 3), 1)
    assert (round(r.ap, 6), round(r.dcg, 6), round(r.ndcg, 6)) == (0.555556, 1.5, 0.703918)
    assert (by[2].precision, by[2].recall, by[2].ndcg) == (0, 0, 0) and (by[3].precision, by[3].recall, by[3].ap) == (0, 1, 0)
    s = evaluate.summary(evaluate.per_query(q, runs, judged)).first()
    assert s.f1 == pytest.approx(2 * s.precision * s.recall / (s.precision + s.recall), abs=1e-5)
