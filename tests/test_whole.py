"""Queries that cover all rows where a checked one beside them is bounded by its SQL."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliant.functions import stemming
from foliant.functions import text as T
from foliant.operators import cluster, features, graph, index, neardup, rank, vectors
from foliant.plans import mining, relational, retrieval
from foliant.sources import books as B


def test_nested_genres_of_an_author_of_many_books(spark):
    """Twelve books by one author and copies of a set: classes and membership give the pairs of brute force, split keys or not."""
    cells = ["a", "a, b", "b,a", "a,b,c", "c", "c,d", "d, d", "a,b,c,d", "e", "e,f", "f,a", "a,b"]
    rows = [(f"b{i:02}", "One", c) for i, c in enumerate(cells)] + [("x1", "Two", "a"), ("x2", "Two", "a,b"), ("x3", " ", "a"), ("x4", None, "a"), ("x5", "Two", None)]
    books = spark.createDataFrame(rows, "bookid string, author string, genres string")
    sets = {i: (a, {g.strip() for g in c.split(",")}) for i, a, c in rows if a and a.strip() and c}
    want = {(i, o) for i in sets for o in sets if i != o and sets[i][0] == sets[o][0] and sets[i][1] <= sets[o][1]}
    classes, members = relational.genre_classes(books)
    head = {r.bookid: r["head"] for r in members.collect()}
    assert set(head) == set(sets)
    for most in (256, 1):
        found = [tuple(r) for r in relational.nested_classes(classes, most).collect()]
        assert len(found) == len(set(found))
        assert {(i, o) for i in head for o in head if i != o and (head[i] == head[o] or (head[i], head[o]) in set(found))} == want


def test_added_records_are_in_all_fields(spark):
    """A record's descriptions, genres and characters get postings, a repeated id counts once."""
    kind = "id string, title string, descriptions array<string>, genres array<string>, characters array<string>"
    rows = [("n1", "Unread", ["red fox", None, "red den"], ["Crime"], ["Ann Lee", "Bo"]), ("n1", "Unread", ["red fox", None, "red den"], ["Crime"], ["Ann Lee", "Bo"]), ("n2", "Unread", None, [], None), (None, "x", ["y"], ["y"], ["y"])]
    old = spark.createDataFrame([("genres", "crime", "b1", 1)], "field string, term string, doc_id string, tf bigint")
    got = {tuple(r) for r in index.add_documents(old, retrieval.record_corpus(spark.createDataFrame(rows, kind)), []).collect()}
    assert got == {("genres", "crime", "b1", 1), ("genres", "crime", "n1", 1), ("characters", "ann", "n1", 1), ("characters", "lee", "n1", 1), ("characters", "bo", "n1", 1)} | {("description", w, "n1", n) for w, n in (("red", 2), ("fox", 1), ("den", 1))}


def test_copies_can_be_found_beside_the_pairs_of_heads(spark, tmp_path):
    """Copies of a record that has neighbours, and of one that has none, are named with their head."""
    common = " ".join(f"w{i}" for i in range(60))
    texts = {"a": common, "b": common + " x", "c": common, "d": "lone red fox", "e": "lone red fox", "f": "one", "g": "other words"}
    spark.createDataFrame([(i, [t]) for i, t in texts.items()], "id string, descriptions array<string>").write.parquet(f"{tmp_path}/lshfakedata.parquet")
    pairs = {(r.doc_a, r.doc_b) for r in retrieval.near_dup_pairs(spark, str(tmp_path)).collect()}
    assert pairs == {("a", "b")}
    head = {r.doc_id: r["head"] for r in retrieval.QUERIES["near_dup_copies"](spark, str(tmp_path)).collect()}
    assert head == {"a": "a", "b": "b", "c": "a", "d": "d", "e": "d", "g": "g"}


@pytest.mark.parametrize("linkage", ["single", "complete", "average"])
def test_hierarchical_clusters_of_all_rows(spark, linkage):
    """Rows outside the sample get the cluster of their group; three well separated groups of 40."""
    rng = np.random.default_rng(1)
    rows = [(g * 40 + i, (np.eye(3)[g] + rng.normal(0, 0.05, 3)).tolist()) for g in range(3) for i in range(40)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = {r.id: r.cluster for r in cluster.hac(df, 3, linkage, sample=20).collect()}
    assert set(got) == set(range(120))
    assert [len({got[g * 40 + i] for i in range(40)}) for g in range(3)] == [1, 1, 1] and len(set(got.values())) == 3


def test_linkage_to_a_cluster():
    """Distances by hand: the nearest member, the farthest one and the mean choose differently."""
    turned = lambda *degrees: np.array([[np.cos(np.radians(a)), np.sin(np.radians(a))] for a in degrees])
    fitted, labels = turned(5, 120, 50, 60), np.array([0, 0, 1, 1])
    assert [cluster.linkage_labels(turned(0), fitted, labels, x)[0] for x in ("single", "complete", "average")] == [0, 1, 1]


def test_pages_of_every_language(spark):
    """Books in languages beyond the first four, in unknown ones and in none are in a column."""
    rows = [("Fantasy", " Russian ", "7"), ("Fantasy", "english", "3"), ("Fantasy", "english", "5"), ("Fantasy", "klingon", "9"), ("Fantasy", "Welsh", "2"), ("Horror", None, "4"), ("Horror", " ", "6"), ("Horror", "dutch", "x"), (None, "dutch", "8")]
    got = {r.label: {k: v for k, v in r.asDict().items() if v is not None and k != "label"} for r in mining.pages_of_languages(spark.createDataFrame(rows, "genres string, languages string, num_pages string")).collect()}
    assert got == {"Fantasy": {"russian": 7, "english": 5, "other": 9}, "Horror": {"none": 6, "dutch": 0}}


KIND = "doc_id string, field string, text string"
TEXTS = [("1", "description", "Running runners ran: relational books, the cats"), ("2", "description", "A runner runs with a cat"), ("3", "genres", "cats"), ("4", "description", ""), ("5", "description", None)]


@pytest.mark.parametrize(("word", "want"), [("running", "run"), ("cats", "cat"), ("ponies", "poni"), ("relational", "relat"), ("hopping", "hop"), ("agreed", "agre"), ("sky", "sky"), ("happy", "happi"), ("is", "is"), ("controlling", "control"), ("generalizations", "gener")])
def test_stems(word, want):
    assert stemming.stem(word) == want


def test_stemmed_index_and_search(spark):
    """Words of one stem are one term with their counts added; queries meet them in any form; an analyser of one's own can be passed."""
    corpus = spark.createDataFrame(TEXTS, KIND)
    stop = ["the", "a", "with"]
    got = {tuple(r) for r in index.postings(corpus, stop, stem=True).collect()}
    want = {}
    for doc, field, text in TEXTS:
        for w in "".join(c for c in (text or "").lower() if c not in T.PUNCTUATION).split():
            if w not in stop:
                key = (field, stemming.stem(w), doc)
                want[key] = want.get(key, 0) + 1
    assert got == {(*k, n) for k, n in want.items()} and ("description", "runner", "1", 1) in got
    built = index.Index.build(corpus, stop, stem=True)
    asked = rank.query_terms(spark.createDataFrame([("q", "Cat!")], "query_id string, text string"), stop, stem=True)
    assert {r.doc_id for r in rank.search(built, asked, "ltn.lnn").collect()} == {"1", "2", "3"}
    letters = lambda text: F.split(F.lower(text), "")
    assert {r.term for r in index.postings(corpus.where("doc_id = '3'"), [], analyser=letters).collect()} >= {"c", "a", "t", "s"}


def test_saved_index(spark, tmp_path):
    """Every method ranks the same over the saved index; one field is read alone; unknown names are refused."""
    corpus, stop = spark.createDataFrame(TEXTS, KIND), ["the", "a"]
    built = index.Index.build(corpus, stop)
    built.save(str(tmp_path), spark.createDataFrame([("1", 3.0), ("2", 4.5)], "doc_id string, quality double"))
    read = index.Index.read(spark, str(tmp_path))
    asked = rank.query_terms(spark.createDataFrame([("q", "runner cats"), ("r", "unseen")], "query_id string, text string"), stop)
    for method in rank.METHODS:
        assert rank.search(read, asked, method).collect() == rank.search(built, asked, method).collect()
    assert all(r.same for r in index.check(read, corpus, stop).collect())
    assert not all(r.same for r in index.check(read, corpus.where("doc_id <> '2'"), stop).collect())
    assert {r.field for r in index.read_table(spark, str(tmp_path), "genres", "lengths").collect()} == {"genres"}
    assert "tier" in index.read_table(spark, str(tmp_path), "genres", "tiered").columns and "tier" not in index.read_table(spark, str(tmp_path), "genres").columns
    for names in (("titles", "postings"), ("genres", "nothing")):
        with pytest.raises(ValueError):
            index.read_table(spark, str(tmp_path), *names)


def test_lookup_and_json_array(spark, tmp_path):
    kind = "bookid string, title string, avg_rating string, loaded_at timestamp"
    rows = spark.createDataFrame([("b1", "Old", "1", None), ("b2", "Other", None, None), (None, "x", None, None)], kind).unionByName(spark.sql("select 'b1' bookid, 'New' title, '2' avg_rating, timestamp'2024-01-01' loaded_at"))
    assert [r.title for r in B.lookup(rows, "b1").collect()] == ["New"]
    assert B.lookup(rows, "b9").count() == B.lookup(rows, None).count() == 0
    path = f"{tmp_path}/books.json"
    for df in (rows.select("bookid", "title"), rows.select("bookid", "title").limit(0)):
        B.write_json_array(df, path)
        assert sorted(map(str, B.read_json_array(spark, path, "bookid string, title string").collect())) == sorted(map(str, df.collect()))


def test_numbers_in_order(spark):
    values = [f"v{i:05}" for i in range(3_000)]
    got = features.numbered(spark.createDataFrame([(v,) for v in reversed(values)], "v string"), "v", "n").collect()
    assert sorted((r.n, r.v) for r in got) == list(enumerate(values))


def brute_dbscan(m, eps, least):
    m = m / np.linalg.norm(m, axis=1, keepdims=True)
    near = np.round(m @ m.T, 6) >= 1 - eps
    core = near.sum(1) >= least
    label = np.full(len(m), -1)
    number = 0
    for i in range(len(m)):
        if core[i] and label[i] < 0:
            todo = [i]
            while todo:
                x = todo.pop()
                if label[x] < 0 and core[x]:
                    label[x] = number
                    todo += np.flatnonzero(near[x] & core & (label < 0)).tolist()
            number += 1
    for i in np.flatnonzero(~core):
        reach = label[np.flatnonzero(near[i] & core)]
        label[i] = reach.min() if len(reach) else -1
    return label


def test_dbscan_against_brute_force(spark):
    """A chain over a third of a circle, clumps and noise; text ids; no limit on rounds."""
    rng = np.random.default_rng(2)
    chain = np.radians(np.linspace(0, 120, 600))
    points = np.concatenate([np.stack([np.cos(chain), np.sin(chain), 0 * chain], 1), rng.normal(0, 0.02, (60, 3)) + [0, 0, 1], rng.normal(0, 0.02, (5, 3)) + [-1, -1, -1], rng.normal(0, 1, (30, 3))])
    df = spark.createDataFrame([(f"p{i:04}", p.tolist()) for i, p in enumerate(points)], "vec_id string, embedding array<double>")
    want = brute_dbscan(points, 0.00002, 3)
    for eps, least in ((0.00002, 3), (0.01, 5), (0.5, 5)):
        got = {r.id: r.cluster for r in cluster.dbscan(df, eps, least).collect()}
        assert [got[f"p{i:04}"] for i in range(len(points))] == brute_dbscan(points, eps, least).tolist()
    assert (want >= 0).any()
    assert cluster.dbscan(df.limit(0)).count() == 0
    counts = {r.a: r.n for r in vectors.neighbour_counts(df, 0.99).collect()}
    unit = points / np.linalg.norm(points, axis=1, keepdims=True)
    assert counts == {f"p{i:04}": n for i, n in enumerate(((np.round(unit @ unit.T, 6) >= 0.99).sum(1) - 1).tolist()) if n}


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1_000, i) for i in range(1_001, 1_200)], "a bigint, b bigint")
    got = {r.node: r["head"] for r in graph.components(links).collect()}
    assert got == {**{i: 0 for i in range(301)}, **{i: 1_000 for i in range(1_000, 1_200)}}


def test_models_are_chosen_on_dev_rows(spark, sf):
    rows = mining.model_leaderboard_all(spark, sf).collect()
    assert {r.model for r in rows} == {"knn", "gaussian_nb", "softmax_regression", "mlp"}
    assert [r.dev_macro_f1 for r in rows] == sorted((r.dev_macro_f1 for r in rows), reverse=True)


def test_pairs_of_a_hot_bucket(spark):
    """A bucket that is cut into parts gives each pair once."""
    rows = [(f"d{i:02}", 0, "hot") for i in range(40)] + [("d00", 1, "cold"), ("d01", 1, "cold"), ("x", 1, "alone")]
    buckets = spark.createDataFrame(rows, "doc_id string, band bigint, bucket string")
    want = {(a, b): 1 for a in (f"d{i:02}" for i in range(40)) for b in (f"d{i:02}" for i in range(40)) if a < b} | {("d00", "d01"): 2}
    for most in (512, 7):
        got = neardup.bucket_pairs(buckets, most).collect()
        assert {(r.doc_a, r.doc_b): r.shared for r in got} == want and len(got) == len(want)
