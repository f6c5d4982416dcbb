import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliant.operators import classify, cluster, embed, features, vectors


def points(spark, n=120, classes=3, dimensions=6, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(classes, dimensions)) * 4
    rows = [(i, [float(x) for x in centres[i % classes] + rng.normal(size=dimensions) * 0.5], i % classes) for i in range(n)]
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")


def test_cluster_measures_by_hand(spark):
    df = spark.createDataFrame(list(zip([0, 0, 1, 1, 1, 1], [0, 0, 0, 1, 1, 1])), "cluster int, label int")
    r = cluster.quality(df).first()
    assert (r.purity, r.nmi, r.rand_index) == (0.833333, 0.478704, 0.666667)
    assert cluster.quality(spark.createDataFrame([(0, 0), (0, 0)], "cluster int, label int")).first().nmi is None


def test_classifiers_learn(spark):
    df = points(spark)
    test, train = df.where("vec_id % 5 = 0"), df.where("vec_id % 5 <> 0")
    truth = {r.vec_id: r.label for r in test.collect()}
    for predicted in (classify.knn(test, train), classify.predict_gaussian(test, *classify.gaussian_nb(train)), classify.softmax_regression(train, test), classify.mlp(train, test, rate=0.05)):
        rows = predicted.collect()
        assert len(rows) == len(truth) and sum(r.predicted == truth[r.id] for r in rows) / len(rows) > 0.9


def test_report_by_hand(spark):
    pairs = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("c", "b")], "label string, predicted string")
    r = {x.label: x for x in classify.class_report(pairs).collect()}
    assert (r["a"].precision, r["a"].recall, r["a"].support) == (1, 0.5, 2) and (r["b"].precision, r["b"].recall) == (pytest.approx(1 / 3), 1) and r["c"].f1 == 0
    o = classify.overall(pairs).first()
    assert o.accuracy == o.micro_f1 == 0.5 and o.macro_recall == 0.5
    assert {(x.label, x.predicted): x.share for x in classify.confusion(pairs).collect()}["a", "b"] == 0.5


def test_neighbours_in_many_blocks(spark):
    df = points(spark, 200, seed=3)
    q = df.where("vec_id % 20 = 0")
    small = {(r.query, r.neighbour, r.similarity, r["rank"]) for r in vectors.nearest(q, df, 4, block=7).collect()}
    assert small == {(r.query, r.neighbour, r.similarity, r["rank"]) for r in vectors.nearest(q, df, 4).collect()} and len(small) == 40
    assert vectors.nearest(q.limit(0), df, 4).count() == 0


def test_join_within_an_angle_is_exact(spark):
    df = points(spark, 150, 5, 4, seed=4)
    m = np.array([r.embedding for r in df.orderBy("vec_id").collect()])
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    s = np.round(m @ m.T, 6)
    want = {(i, j) for i, j in zip(*np.nonzero(s >= 0.9)) if i != j}
    assert {(r.a, r.b) for r in vectors.within_angle(df, 0.9, pivots=6).collect()} == want and want


def test_dbscan_by_hand(spark):
    angle = [0, 2, 4, 6, 8, 60, 62, 64, 66, 120, 14.5]
    rows = [(i, [math.cos(math.radians(a)), math.sin(math.radians(a))]) for i, a in enumerate(angle)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = {r.id: r.cluster for r in cluster.dbscan(df, eps=1 - math.cos(math.radians(7)), min_samples=3).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 0, 4: 0, 5: 1, 6: 1, 7: 1, 8: 1, 9: -1, 10: 0}
    s = cluster.dbscan_summary(spark.createDataFrame(list(got.items()), "id int, cluster int")).first()
    assert (s.n_clusters, s.clustered_points, s.valid) == (2, 10, True)
    assert not cluster.dbscan_summary(spark.createDataFrame([(1, -1), (2, 0), (3, -1)], "id int, cluster int")).first().valid


@pytest.mark.parametrize("linkage", ["single", "complete", "average"])
def test_merging(linkage):
    x = np.array([0.0, 1.0, 1.5, 10.0, 10.4, 30.0])
    labels, merges = cluster.merge_clusters(np.abs(x[:, None] - x[None, :]), 3, linkage)
    assert labels.tolist() == [0, 0, 0, 1, 1, 2] and merges[:2] == pytest.approx([0.4, 0.5])
    assert merges[2] == pytest.approx({"single": 1.0, "complete": 1.5, "average": 1.25}[linkage])
    with pytest.raises(ValueError):
        cluster.merge_clusters(np.zeros((2, 2)), 1, "ward")


def test_clustering_finds_groups(spark):
    df = points(spark)
    truth = df.select(F.col("vec_id").alias("id"), "label")
    for found in (cluster.kmeans(df, 8), cluster.hac(df, 3), cluster.lloyd(df, 3, rounds=6)):
        assert cluster.quality(found.join(truth, "id").select("cluster", "label")).first().purity > 0.9
    widths = cluster.silhouette(df).collect()
    assert all(r.silhouette > 0.5 for r in widths)
    assert cluster.pca_2d(df).agg(F.abs(F.avg("x"))).first()[0] < 1e-9
    assert cluster.silhouette(df.where("label = 0").unionByName(df.where("label = 1").limit(1))).where("cluster = 1").first().silhouette == 0


def test_splits_and_resampling(spark):
    df = spark.createDataFrame([(i, "abc"[min(2, i // 40)]) for i in range(87)] + [(90, "d"), (91, "d"), (92, "d"), (93, "e")], "doc_id int, label string")
    n = {(r.label, r.split): r["count"] for r in features.stratified_split(df).groupBy("label", "split").count().collect()}
    assert n["a", "train"] == 28 and n["a", "dev"] == 6 and n["a", "test"] == 6 and n["d", "train"] == n["d", "dev"] == n["d", "test"] == 1 and n["e", "test"] == 1
    assert features.random_split(df).where("split = 'train'").count() == int(91 * 0.8)
    for strategy, want in (("random_oversample", {40}), ("random_undersample", {1}), ("median_resample", {7})):
        assert {r[0] for r in features.resample(df, strategy).groupBy("label").agg(F.sum("copies")).select("sum(copies)").collect()} == want
    with pytest.raises(ValueError):
        features.resample(df, "smote")
    ranks = features.hash_rank(df.withColumn("g", F.lit(1)), "doc_id", 1, ["g"])
    assert sorted(r["rank"] for r in ranks.collect()) == list(range(91))


def test_genres_and_labels(spark):
    df = spark.createDataFrame([("Romance, Fantasy",), ("Horror,Horror, Fantasy",), ("fantasy",), ("'Art'",), (None,), ("",)], "g string")
    assert [r[0] for r in df.select(features.main_genre(F.col("g"))).collect()] == ["Fantasy", "Horror", None, "Art", None, None]
    ids = features.encode_labels(spark.createDataFrame([("b",), ("a",), (None,), ("b",)], "label string")).collect()
    assert sorted((r.label or "", r.label_id) for r in ids) == [("", None), ("a", 0), ("b", 1), ("b", 1)]


def test_tfidf_limits_and_scaling(spark):
    docs = spark.createDataFrame([(1, "aa bb cc"), (2, "aa bb dd"), (3, "aa ee")], "doc_id int, text string")
    counts, n = features.term_counts(docs), docs.agg(F.count("*").alias("n_docs"))
    v = features.tfidf_vocabulary(counts, n)
    assert {r.term for r in v.collect()} == {"bb", "aa bb"}  # aa is in more than 0.8 of the documents
    assert all(abs(r.n - 1) < 1e-9 for r in features.tfidf_vectors(counts, v).groupBy("doc_id").agg(F.sum(F.col("w") * F.col("w")).alias("n")).collect())
    s = features.standard_scale(spark.createDataFrame([(1, 1.0, 5.0), (2, 3.0, 5.0)], "id int, a double, b double"), ["a", "b"]).orderBy("id").collect()
    assert [(r.a, r.b) for r in s] == [(-1, 0), (1, 0)]


def test_words(spark):
    s = spark.createDataFrame([(["a", "b", "c"],), (["x"],), ([],)], "tokens array<string>")
    assert sorted((r.center, r.context) for r in embed.skip_grams(s, 1).collect()) == [("a", "b"), ("b", "a"), ("b", "c"), ("c", "b")]
    bad = embed.negatives(embed.skip_grams(s, 1), ["a", "b", "c"], 4).collect()
    assert len(bad) == 16 and all(r.negative != r.context for r in bad)
    rng = np.random.default_rng(0)
    royal, fruit = ["king", "queen", "crown", "throne"], ["apple", "pear", "plum", "grape"]
    talk = [([str(w) for w in rng.choice(royal if i % 2 else fruit, 12)],) for i in range(400)]
    learned = {r.word: np.array(r.vec) for r in embed.sgns(spark.createDataFrame(talk, "tokens array<string>"), size=8, epochs=4, rate=0.1).collect()}
    assert set(learned) == {*royal, *fruit} and all(np.isfinite(v).all() for v in learned.values())
    cos = lambda a, b: learned[a] @ learned[b] / np.linalg.norm(learned[a]) / np.linalg.norm(learned[b])
    assert min(cos(a, b) for g in (royal, fruit) for a in g for b in g) > max(cos(a, b) for a in royal for b in fruit)
    assert embed.sgns(s.limit(0)).count() == 0
    groups = spark.createDataFrame([(1, 1, [1.0, 0.0]), (1, 2, [1.0, 0.1]), (1, 3, [0.0, 1.0]), (1, 4, [1.0, 0.05])], "grp int, id int, v array<double>")
    assert vectors.odd_one_out(groups).first().odd == 3
    pooled = vectors.mean_pool(spark.createDataFrame([(1, [1.0, 3.0], 1), (1, [4.0, 0.0], 2)], "g int, v array<double>, w int"), "g", "v", "w")
    assert {r.pos: r.value for r in pooled.collect()} == {0: 3.0, 1: 1.0}
