"""Queries of features, classifiers, clusters and word embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.functions import text as T
from foliant.operators import classify, cluster, embed, features, runs, vectors
from foliant.plans import sql as S
from foliant.session import checkpoint, table, written
from foliant.sources import books as B


def described(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(doc_id, text, label)`` of books with a description and a main genre among the eligible classes."""
    rows = B.books(spark, sf_dir).select(F.col("bookid").alias("doc_id"), F.trim(F.coalesce("description", F.lit(""))).alias("text"), features.main_genre(F.col("genres")).alias("label"))
    rows = rows.where("text <> '' and label is not null")
    return rows.join(F.broadcast(features.eligible_classes(rows).select("label")), "label", "left_semi").select("doc_id", "text", "label")


def _tfidf(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    docs = described(spark, sf_dir)
    counts = written(features.term_counts(docs))
    n_docs = docs.agg(F.count("*").alias("n_docs"))
    vocabulary = checkpoint(features.tfidf_vocabulary(counts, n_docs))
    return docs, features.tfidf_vectors(counts, vocabulary), vocabulary, n_docs


def tfidf_vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tfidf(spark, sf_dir)[2].select("term_id", "term", "tf", "df", F.round("idf", 6).alias("idf"))


def tfidf_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tfidf(spark, sf_dir)[1].select("doc_id", "term", F.round("w", 6).alias("w"))


def tfidf_top_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, v, _, n = _tfidf(spark, sf_dir)
    return features.top_variance(v, n).select("term", F.round("variance", 6).alias("variance"))


def standard_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = B.books(spark, sf_dir).select(F.col("bookid").alias("doc_id"), T.guarded_int(F.col("num_pages")).cast("double").alias("pages"), T.guarded_float(F.col("avg_rating")).alias("rating"))
    return features.standard_scale(rows, ["pages", "rating"]).select("doc_id", F.round("pages", 6).alias("pages"), F.round("rating", 6).alias("rating"))


def main_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.books(spark, sf_dir).select(F.col("bookid").alias("doc_id"), features.main_genre(F.col("genres")).alias("label"))


def label_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.encode_labels(main_category(spark, sf_dir)).select("doc_id", "label", "label_id")


def eligible_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.eligible_classes(main_category(spark, sf_dir))


def class_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = main_category(spark, sf_dir).groupBy("label").agg(F.count("*").alias("n"))
    return n.crossJoin(F.broadcast(n.agg(F.sum("n").alias("t")))).select("label", "n", F.round(F.col("n") / F.col("t"), 6).alias("share"))


def stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.stratified_split(described(spark, sf_dir)).select("doc_id", "label", "split")


def random_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.random_split(described(spark, sf_dir)).select("doc_id", "split")


def split_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes by split, as columns."""
    return features.stratified_split(described(spark, sf_dir)).groupBy("label").pivot("split", ["train", "dev", "test"]).count().na.fill(0)


def resample_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = checkpoint(described(spark, sf_dir).select("doc_id", "label"))
    out = None
    for strategy in features.STRATEGIES:
        part = features.resample(docs, strategy).groupBy("label").agg(F.sum("copies").alias("n"), F.count("*").alias("distinct_rows")).select(F.lit(strategy).alias("strategy"), "label", "n", "distinct_rows")
        out = part if out is None else out.unionByName(part)
    return out


def nb_multinomial(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of the test rows of the stratified split, learned from its train rows; the vocabulary is that of the train rows."""
    split = features.stratified_split(described(spark, sf_dir))
    split = checkpoint(split.select("doc_id", "text", "label", "split"))
    train = split.where("split = 'train'")
    counts = written(features.term_counts(split))
    fitted = checkpoint(features.tfidf_vocabulary(counts.join(train.select("doc_id"), "doc_id", "left_semi"), train.agg(F.count("*").alias("n_docs"))))
    v = written(features.tfidf_vectors(counts, fitted))
    model, prior = classify.multinomial_nb(v, train.select("doc_id", "label"), fitted)
    test = split.where("split = 'test'").select("doc_id", "label")
    return classify.predict_multinomial(v.join(test.select("doc_id"), "doc_id", "left_semi"), model, prior).join(test, "doc_id").select("doc_id", "label", "predicted")


def _embedded(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Embeddings whose id is divisible by 20, and the others."""
    rows = table(spark, sf_dir, "embeddings")
    return rows.where("vec_id % 20 = 0"), rows.where("vec_id % 20 <> 0")


def nb_gaussian(spark: SparkSession, sf_dir: str) -> DataFrame:
    test, train = _embedded(spark, sf_dir)
    return classify.predict_gaussian(test, *classify.gaussian_nb(train)).select("id", "predicted")


def knn_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify.knn(*_embedded(spark, sf_dir))


def _knn_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    test, train = _embedded(spark, sf_dir)
    return classify.knn(test, train).join(test.select(F.col("vec_id").alias("id"), "label"), "id").select("id", "label", "predicted")


def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify.confusion(_knn_pairs(spark, sf_dir))


def classification_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify.class_report(_knn_pairs(spark, sf_dir)).select("label", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")), "support")


def misclassified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _knn_pairs(spark, sf_dir).where("label <> predicted")


def model_leaderboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Models by macro F1 on the test rows, the best first."""
    test, train = _embedded(spark, sf_dir)
    truth = test.select(F.col("vec_id").alias("id"), "label")
    runs = {"knn": classify.knn(test, train), "gaussian_nb": classify.predict_gaussian(test, *classify.gaussian_nb(train))}
    out = None
    for name, predicted in runs.items():
        part = classify.overall(truth.join(predicted, "id").select("label", "predicted")).withColumn("model", F.lit(name))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out.select("model", "accuracy", "macro_f1", "micro_f1").orderBy(F.desc("macro_f1"), "model")


def model_leaderboard_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All models on the embeddings, chosen by macro F1 on dev rows and reported on test rows; the best first."""
    rows = table(spark, sf_dir, "embeddings").withColumn("_part", F.pmod(F.xxhash64("vec_id"), F.lit(20)))
    train, dev, test = checkpoint(rows.where("_part > 5").drop("_part")), rows.where("_part between 3 and 5").drop("_part"), rows.where("_part < 3").drop("_part")
    models = {
        "knn": lambda part: classify.knn(part, train), "gaussian_nb": lambda part: classify.predict_gaussian(part, *classify.gaussian_nb(train)),
        "softmax_regression": lambda part: classify.softmax_regression(train, part), "mlp": lambda part: classify.mlp(train, part),
    }
    parts = []
    for name, predict in models.items():
        scored = []
        for part in (dev, test):
            truth = part.select(F.col("vec_id").alias("id"), "label")
            scored.append(classify.overall(truth.join(predict(part), "id").select("label", "predicted")))
        on_dev = scored[0].select(F.col("macro_f1").alias("dev_macro_f1"))
        parts.append(scored[1].crossJoin(on_dev).select(F.lit(name).alias("model"), "dev_macro_f1", "accuracy", "macro_f1", "micro_f1"))
    return runs.stack(parts).orderBy(F.desc("dev_macro_f1"), "model")


def softmax_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    test, train = _embedded(spark, sf_dir)
    return classify.softmax_regression(train, test)


def mlp_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    test, train = _embedded(spark, sf_dir)
    return classify.mlp(train, test)


def kmeans_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.lloyd(table(spark, sf_dir, "embeddings"))


def spherical_kmeans_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.lloyd(table(spark, sf_dir, "embeddings"), spherical=True)


def kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.kmeans(table(spark, sf_dir, "embeddings"))


def cluster_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    truth = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label")
    return cluster.quality(kmeans_step(spark, sf_dir).join(truth, "id").select("cluster", "label"))


def dbscan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.dbscan(table(spark, sf_dir, "embeddings"), eps=0.7)


def dbscan_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.dbscan_summary(dbscan(spark, sf_dir))


def hac(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.hac(table(spark, sf_dir, "embeddings"))


def silhouette(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.silhouette(table(spark, sf_dir, "embeddings"))


def silhouette_squared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.silhouette(table(spark, sf_dir, "embeddings"), squared=True)


def silhouette_euclidean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Silhouettes of the rows whose id is divisible by 20, against all rows."""
    return cluster.silhouette_euclidean(table(spark, sf_dir, "embeddings"), "vec_id % 20 = 0")


def cluster_representatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.representatives(table(spark, sf_dir, "embeddings"))


def hac_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.hac(table(spark, sf_dir, "embeddings"), linkage="single")


def hac_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.hac(table(spark, sf_dir, "embeddings"), linkage="complete")


def grid_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean measures of each method over its runs."""
    return runs.means(_grid(spark, sf_dir), ["method"], ["purity", "nmi", "rand_index"]).select("method", *(F.round(c, 5).alias(c) for c in ("purity", "nmi", "rand_index")))


def pca_2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.pca_2d(table(spark, sf_dir, "embeddings"))


def cluster_top_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, v, _, _ = _tfidf(spark, sf_dir)
    return cluster.top_terms(v, docs.select("doc_id", F.col("label").alias("cluster")))


def cluster_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    books = B.books(spark, sf_dir)
    labels = books.select(F.col("bookid").alias("doc_id"), F.coalesce(features.main_genre(F.col("genres")), F.lit("none")).alias("cluster"))
    return cluster.profile(labels, books.select(F.col("bookid").alias("doc_id"), F.explode(T.list_items(F.col("genres"))).alias("value")))


def nearest_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries, _ = _embedded(spark, sf_dir)
    return vectors.nearest(queries, table(spark, sf_dir, "embeddings"))


def odd_one_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select(F.expr("vec_id div 4").alias("grp"), F.col("vec_id").alias("id"), vectors.doubles(F.col("embedding")).alias("v"))
    return vectors.odd_one_out(rows)


def mean_pooling(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").withColumn("weight", F.col("vec_id") % 3 + 1)
    return vectors.mean_pool(rows, "label", "embedding", "weight").select("label", F.col("pos").cast("bigint").alias("pos"), F.round("value", 6).alias("value"))


def w2v_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed.corpus(B.books(spark, sf_dir), B.stop_words(spark, sf_dir)).select("doc_id", F.array_join("tokens", " ").alias("tokens"))


def skipgram_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    sentences = embed.corpus(B.books(spark, sf_dir), B.stop_words(spark, sf_dir))
    return embed.skip_grams(sentences).groupBy("center", "context").agg(F.count("*").alias("n"))


def token_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    sentences = embed.corpus(B.books(spark, sf_dir), B.stop_words(spark, sf_dir))
    return sentences.select(F.explode("tokens").alias("word")).groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(100)


def negative_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each of the 100 most frequent words is drawn against a skip-gram pair, five times for each distinct pair and never its context, and against how many contexts."""
    sentences = embed.corpus(B.books(spark, sf_dir), B.stop_words(spark, sf_dir))
    vocabulary = [r["word"] for r in embed.vocabulary(sentences, most=100).select("word").collect()]
    drawn = embed.negatives(embed.skip_grams(sentences).distinct(), vocabulary)
    return drawn.groupBy("negative").agg(F.count("*").alias("n"), F.countDistinct("context").alias("contexts"))


def sgns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word vectors by skip-grams with negative samples, over all sentences."""
    return embed.sgns(embed.corpus(B.books(spark, sf_dir), B.stop_words(spark, sf_dir)), size=32, epochs=3)


def similar_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest of all trained words to each of the 20 most frequent ones."""
    sentences = embed.corpus(B.books(spark, sf_dir), B.stop_words(spark, sf_dir))
    words = checkpoint(embed.word2vec(sentences, size=50, epochs=2))
    return vectors.nearest(words.join(embed.vocabulary(sentences, most=20).select("word"), "word", "left_semi"), words, id_col="word", vector="vec")


def word2vec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed.word2vec(embed.corpus(B.books(spark, sf_dir), B.stop_words(spark, sf_dir)))


def _longest(books: DataFrame) -> DataFrame:
    """``(label, lang, pages)`` of the books that have a class."""
    rows = books.select(features.main_genre(F.col("genres")).alias("label"), F.lower(F.trim("languages")).alias("lang"), T.guarded_int(F.col("num_pages")).alias("pages"))
    return rows.where("label is not null")


def pages_by_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Longest book by class and language, the four most frequent languages as columns; ``pages_by_all_languages`` has all."""
    return _longest(B.books(spark, sf_dir)).groupBy("label").pivot("lang", ["english", "spanish", "french", "german"]).agg(F.max("pages"))


LANGUAGES = ("english", "spanish", "french", "german", "portuguese", "italian", "dutch", "russian")


def pages_of_languages(books: DataFrame) -> DataFrame:
    """Longest book by class and language: languages, ``other`` for any further one and ``none`` for null or blank cells as columns."""
    column = F.when(F.coalesce("lang", F.lit("")) == "", "none").when(F.col("lang").isin(*LANGUAGES), F.col("lang")).otherwise("other")
    return _longest(books).withColumn("lang", column).groupBy("label").pivot("lang", [*LANGUAGES, "other", "none"]).agg(F.max("pages"))


def pages_by_all_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages_of_languages(B.books(spark, sf_dir))


GRID = tuple((method, k) for method in ("euclidean", "spherical") for k in (5, 10, 20))


def _grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of two assignments for each method and number of clusters."""
    rows = table(spark, sf_dir, "embeddings")
    truth = rows.select(F.col("vec_id").alias("id"), "label")
    parts = []
    for method, k in GRID:
        labelled = checkpoint(cluster.lloyd(rows, k, rounds=2, spherical=method == "spherical").join(truth, "id").select("cluster", "label"))
        parts.append(cluster.quality(labelled).select(F.lit(method).alias("method"), F.lit(k).cast("bigint").alias("k"), "purity", "nmi", "rand_index"))
    return runs.stack(parts)


def clustering_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _grid(spark, sf_dir)


def best_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The run of the highest mutual information of each method."""
    return runs.best(_grid(spark, sf_dir), ["method"], "nmi", "k").select("method", "k", "nmi")


def purity_by_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Highest purity by method, numbers of clusters as columns."""
    named = _grid(spark, sf_dir).withColumn("k", F.concat(F.lit("k"), F.col("k").cast("string")))
    return runs.highest(named, "method", "k", ["k5", "k10", "k20"], "purity")


def frequent_confusions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.frequent_confusions(_knn_pairs(spark, sf_dir))


QUERIES = {
    f.__name__: f
    for f in (
        tfidf_vocab, tfidf_vectors, tfidf_top_variance, standard_scale, main_category, label_encode, eligible_classes, class_shares, stratified_split, random_split, split_counts, resample_counts,
        nb_multinomial, nb_gaussian, knn_classify, confusion_matrix, classification_report, misclassified, model_leaderboard, softmax_regression, mlp_classify,
        kmeans_step, spherical_kmeans_step, kmeans, cluster_quality, dbscan, dbscan_summary, hac, silhouette, pca_2d, cluster_top_terms, cluster_profile,
        nearest_neighbors, odd_one_out, mean_pooling, w2v_corpus, skipgram_pairs, token_histogram, word2vec, pages_by_language, pages_by_all_languages,
        clustering_grid, best_runs, purity_by_k, frequent_confusions, silhouette_squared, silhouette_euclidean, cluster_representatives, hac_single, hac_complete, grid_means, negative_samples, sgns, similar_words, model_leaderboard_all,
    )
}

_ITEMS = "list_filter(list_transform(string_split(coalesce({c}, ''), ','), lambda x: trim(x)), lambda x: x <> '')"
_CLEAN = f"list_transform({_ITEMS.format(c='genres')}, lambda g: trim(trim(g, '\"'), ''''))"
_TARGETS = "[" + ", ".join(map(S.quote, features.TARGET_GENRES)) + "]"
MAIN = f"""targets AS (SELECT unnest({_TARGETS}) AS g, generate_subscripts({_TARGETS}, 1) AS p),
own AS (SELECT bookid AS doc_id, unnest({_CLEAN}) AS g FROM books),
labelled AS (SELECT doc_id, g AS label FROM (SELECT doc_id, g, p, count(*) AS n FROM own JOIN targets USING (g) GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, p) = 1),
main AS (SELECT bookid AS doc_id, label FROM books LEFT JOIN labelled ON doc_id = bookid)"""


def _eligible(source: str) -> str:
    return f"""sizes AS (SELECT label, count(*)::BIGINT AS n FROM {source} WHERE label IS NOT NULL GROUP BY 1),
eligible AS (SELECT label, n FROM sizes WHERE n >= CASE WHEN (SELECT count(*) FROM sizes WHERE n >= 100) >= 2 THEN 100 ELSE 5 END ORDER BY n DESC, label LIMIT 10)"""


DESCRIBED = f"""{S.BOOKS}, {MAIN},
texts AS (SELECT doc_id, trim(description) AS text, label FROM main JOIN books ON bookid = doc_id WHERE trim(coalesce(description, '')) <> '' AND label IS NOT NULL),
{_eligible('texts')}, docs AS (SELECT doc_id, text, label FROM texts WHERE label IN (SELECT label FROM eligible))"""
_GRAMS = "list_concat(t, {p})".format(p=S.pairs("t"))
_COUNTS = f"""tk AS (SELECT doc_id, regexp_extract_all(lower(text), {S.quote(T.WORD)}) AS t FROM docs),
counts AS (SELECT doc_id, term, count(*) AS c FROM (SELECT doc_id, unnest(CASE WHEN len(t) > 1 THEN {_GRAMS} ELSE t END) AS term FROM tk) GROUP BY ALL)"""


def _vocabulary(source: str, n: str) -> str:
    return f"""nn AS ({n}),
vocab AS (SELECT row_number() OVER (ORDER BY tf DESC, term)::BIGINT - 1 AS term_id, * FROM (SELECT term, sum(c)::BIGINT AS tf, count(*)::BIGINT AS df, ln((1 + max(n)) / (1 + count(*))) + 1 AS idf FROM {source}, nn GROUP BY term
  HAVING count(*) >= 2 AND count(*) <= floor(max(n) * 0.8) ORDER BY tf DESC, term LIMIT 5000)),
vec AS (SELECT doc_id, term_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS w FROM (SELECT doc_id, term_id, term, (1 + ln(c)) * idf AS w FROM counts JOIN vocab USING (term)))"""


TFIDF = f"{DESCRIBED}, {_COUNTS}, {_vocabulary('counts', 'SELECT count(*) AS n FROM docs')}"
_HASHED = "SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY md5('42:' || doc_id), doc_id) - 1 AS r, count(*) OVER (PARTITION BY {by}) AS n FROM docs"
SPLIT = f"""{DESCRIBED}, hr AS ({_HASHED.format(by='label')}),
cut AS (SELECT *, floor(n * 0.7) AS a0, floor(n * 0.15) AS d0 FROM hr),
cut2 AS (SELECT *, CASE WHEN n >= 3 AND d0 = 0 THEN greatest(1, a0 - 1) ELSE a0 END AS a1, CASE WHEN n >= 3 AND d0 = 0 THEN 1 ELSE d0 END AS d FROM cut),
cut3 AS (SELECT *, CASE WHEN n >= 3 AND n - a0 - d0 = 0 THEN greatest(1, a1 - 1) ELSE a1 END AS a FROM cut2),
split AS (SELECT doc_id, text, label, CASE WHEN r < a THEN 'train' WHEN r < a + d THEN 'dev' ELSE 'test' END AS split FROM cut3)"""
_EMB = "e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings)"
_COS = "round(list_dot_product({a}, {b}) / (sqrt(list_dot_product({a}, {a})) * sqrt(list_dot_product({b}, {b}))), 6)"
_KNN = f"""{_EMB}, near AS (SELECT q.vec_id AS id, t.label, row_number() OVER (PARTITION BY q.vec_id ORDER BY {_COS.format(a='q.v', b='t.v')} DESC, t.vec_id) AS r FROM e q, e t WHERE q.vec_id % 20 = 0 AND t.vec_id % 20 <> 0),
votes AS (SELECT id, label, count(*)::BIGINT AS n FROM near WHERE r <= 5 GROUP BY ALL),
knn AS (SELECT id, label AS predicted, n AS votes FROM votes QUALIFY row_number() OVER (PARTITION BY id ORDER BY n DESC, label) = 1)"""
_GNB = """cells AS (SELECT vec_id, label, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM e),
widest AS (SELECT max(v) AS v FROM (SELECT var_pop(x) AS v FROM cells WHERE vec_id % 20 <> 0 GROUP BY pos)),
st AS (SELECT label, pos, avg(x) AS m, var_pop(x) + CASE WHEN max(v) > 0 THEN max(v) * 1e-9 ELSE 1e-9 END AS var FROM cells, widest WHERE vec_id % 20 <> 0 GROUP BY ALL),
pri AS (SELECT label, ln(count(*) / sum(count(*)) OVER () + 1e-12) AS prior FROM e WHERE vec_id % 20 <> 0 GROUP BY label),
gs AS (SELECT c.vec_id AS id, st.label, sum(-0.5 * (ln(2 * pi() * var) + (x - m) * (x - m) / var)) AS s FROM cells c JOIN st USING (pos) WHERE vec_id % 20 = 0 GROUP BY ALL),
gnb AS (SELECT id, label AS predicted FROM gs JOIN pri USING (label) QUALIFY row_number() OVER (PARTITION BY id ORDER BY round(s + prior, 4) DESC, label) = 1)"""


def _report(name: str, source: str) -> str:
    """CTE ``name`` of ``(label, precision, recall, f1, support)`` over ``source (label, predicted)``."""
    return f"""{name}_l AS (SELECT label FROM {source} UNION SELECT predicted FROM {source}),
{name}_c AS (SELECT l.label, (SELECT count(*) FROM {source} p WHERE p.label = l.label AND p.predicted = l.label) AS tp, (SELECT count(*) FROM {source} p WHERE p.predicted = l.label) AS said, (SELECT count(*) FROM {source} p WHERE p.label = l.label) AS support FROM {name}_l l),
{name} AS (SELECT label, CASE WHEN said = 0 THEN 0.0 ELSE tp / said END AS precision, CASE WHEN support = 0 THEN 0.0 ELSE tp / support END AS recall, CASE WHEN said + support = 0 OR tp = 0 THEN 0.0 ELSE 2 * tp / (said + support) END AS f1, support::BIGINT AS support FROM {name}_c)"""


def _lloyd(spherical: bool, rounds: int = 3, k: int = 10, x: str = "") -> str:
    unit = "list_transform({v}, lambda x: x / sqrt(list_dot_product({v}, {v})))"
    v = unit.format(v="v") if spherical else "v"
    cost = "1 - list_dot_product(p.v, c.c)" if spherical else "list_sum(list_transform(list_zip(p.v, c.c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    out = [] if x else [_EMB]
    out += [f"p{x} AS (SELECT vec_id AS id, {v} AS v FROM e)", f"c{x}0 AS (SELECT row_number() OVER (ORDER BY id) - 1 AS cluster, v AS c FROM (SELECT * FROM p{x} ORDER BY id LIMIT {k}))"]
    for r in range(rounds):
        out.append(f"a{x}{r} AS (SELECT p.id, p.v, c.cluster, round({cost}, 9) AS cost FROM p{x} p, c{x}{r} c QUALIFY row_number() OVER (PARTITION BY p.id ORDER BY round({cost}, 9), c.cluster) = 1)")
        mean = f"(SELECT cluster, list(m ORDER BY pos) AS c FROM (SELECT cluster, pos, avg(x) AS m FROM (SELECT cluster, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM a{x}{r}) GROUP BY ALL) GROUP BY cluster)"
        out.append(f"c{x}{r + 1} AS (SELECT cluster, {unit.format(v='c') if spherical else 'c'} AS c FROM {mean})")
    out.append(f"lloyd{x} AS (SELECT id, cluster::BIGINT AS cluster, round(cost, 6) AS cost FROM a{x}{rounds - 1})")
    return ", ".join(out)


def _quality(source: str) -> str:
    """Purity, mutual information and Rand index of ``source (cluster, label)``, one row."""
    return f"""(WITH n AS (SELECT cluster, label, count(*) AS n FROM {source} GROUP BY ALL), a AS (SELECT cluster, sum(n) AS na, max(n) AS top FROM n GROUP BY 1), b AS (SELECT label, sum(n) AS nb FROM n GROUP BY 1), t AS (SELECT sum(n) AS t FROM n)
SELECT t::BIGINT AS points, round((SELECT sum(top) FROM a) / t, 6) AS purity, round((SELECT sum(n / t * ln(n * t / (na * nb))) FROM n JOIN a USING (cluster) JOIN b USING (label)) / (((SELECT sum(-na / t * ln(na / t)) FROM a) + (SELECT sum(-nb / t * ln(nb / t)) FROM b)) / 2), 6) AS nmi,
round((t * (t - 1) / 2 - ((SELECT sum(na * na) FROM a) + (SELECT sum(nb * nb) FROM b)) / 2 + (SELECT sum(n * n) FROM n)) / (t * (t - 1) / 2), 6) AS rand_index FROM t)"""


def _sql_grid() -> str:
    ctes, parts = [_EMB], []
    for i, (method, k) in enumerate(GRID):
        ctes += [_lloyd(method == "spherical", 2, k, f"g{i}_"), f"x{i} AS (SELECT cluster, label FROM lloydg{i}_ JOIN e ON vec_id = id)"]
        parts.append(f"SELECT '{method}' AS method, {k}::BIGINT AS k, purity, nmi, rand_index FROM {_quality(f'x{i}')}")
    return f"{', '.join(ctes)}, grid AS ({' UNION ALL '.join(parts)})"


_DBSCAN = f"""{_EMB}, near AS (SELECT a.vec_id AS a, b.vec_id AS b FROM e a, e b WHERE a.vec_id <> b.vec_id AND {_COS.format(a='a.v', b='b.v')} >= 0.3),
core AS (SELECT vec_id AS id FROM e LEFT JOIN (SELECT a, count(*) AS n FROM near GROUP BY 1) ON a = vec_id WHERE coalesce(n, 0) + 1 >= 5),
edge AS (SELECT a, b FROM near WHERE a IN (SELECT id FROM core) AND b IN (SELECT id FROM core)),
reach AS (SELECT id, id AS low FROM core UNION SELECT edge.b, reach.low FROM reach JOIN edge ON edge.a = reach.id),
lab AS (SELECT id, min(low) AS low FROM reach GROUP BY 1), num AS (SELECT id, dense_rank() OVER (ORDER BY low) - 1 AS cluster FROM lab),
db AS (SELECT vec_id AS id, coalesce(n.cluster, (SELECT min(m.cluster) FROM near JOIN num m ON m.id = near.b WHERE near.a = vec_id), -1)::BIGINT AS cluster FROM e LEFT JOIN num n ON n.id = vec_id)"""

_W2V = f"""{S.BOOKS}, {S.STOP}, drop_words AS (SELECT term FROM stop UNION SELECT unnest([{', '.join(map(S.quote, embed.DOMAIN_WORDS))}])), dl AS (SELECT list(term) AS l FROM drop_words),
sent AS (SELECT bookid AS doc_id, list_filter({S.words("regexp_replace(lower('title ' || coalesce(title, '') || ' author ' || coalesce(author, '') || ' description ' || coalesce(description, '') || ' genres ' || coalesce(genres, '')), '[^a-z \\t\\r\\n]', ' ', 'g')")}, lambda w: length(w) > 2 AND NOT list_contains(l, w)) AS t FROM books, dl)"""

ORACLE = {
    "tfidf_vocab": f"WITH {TFIDF} SELECT term_id, term, tf, df, round(idf, 6) AS idf FROM vocab",
    "tfidf_vectors": f"WITH {TFIDF} SELECT doc_id, term, round(w, 6) AS w FROM vec",
    "tfidf_top_variance": f"WITH {TFIDF}, s AS (SELECT term_id, term, round(sum(w * w) / max(n) - pow(sum(w) / max(n), 2), 9) AS variance FROM vec, nn GROUP BY ALL) SELECT term, round(variance, 6) AS variance FROM (SELECT * FROM s ORDER BY variance DESC, term_id LIMIT 3000)",
    "standard_scale": f"""WITH {S.BOOKS}, n AS (SELECT bookid AS doc_id, ({S.whole('num_pages')})::DOUBLE AS pages, {S.number('avg_rating')} AS rating FROM books),
s AS (SELECT avg(pages) AS mp, stddev_pop(pages) AS sp, avg(rating) AS mr, stddev_pop(rating) AS sr FROM n)
SELECT doc_id, round((pages - mp) / CASE WHEN sp < 1e-8 THEN 1 ELSE sp END, 6) AS pages, round((rating - mr) / CASE WHEN sr < 1e-8 THEN 1 ELSE sr END, 6) AS rating FROM n, s""",
    "main_category": f"WITH {S.BOOKS}, {MAIN} SELECT * FROM main",
    "label_encode": f"WITH {S.BOOKS}, {MAIN} SELECT m.doc_id, m.label, label_id FROM main m LEFT JOIN (SELECT label, row_number() OVER (ORDER BY label)::BIGINT - 1 AS label_id FROM (SELECT DISTINCT label FROM main WHERE label IS NOT NULL)) i ON i.label = m.label",
    "eligible_classes": f"WITH {S.BOOKS}, {MAIN}, {_eligible('main')} SELECT * FROM eligible",
    "class_shares": f"WITH {S.BOOKS}, {MAIN} SELECT label, count(*)::BIGINT AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM main GROUP BY label",
    "stratified_split": f"WITH {SPLIT} SELECT doc_id, label, split FROM split",
    "random_split": f"WITH {DESCRIBED}, hr AS (SELECT doc_id, row_number() OVER (ORDER BY md5('42:' || doc_id), doc_id) - 1 AS r, count(*) OVER () AS n FROM docs) SELECT doc_id, CASE WHEN r < floor(n * 0.8) THEN 'train' ELSE 'test' END AS split FROM hr",
    "split_counts": f"WITH {SPLIT} SELECT label, count(*) FILTER (split = 'train')::BIGINT AS train, count(*) FILTER (split = 'dev')::BIGINT AS dev, count(*) FILTER (split = 'test')::BIGINT AS test FROM split GROUP BY label",
    "resample_counts": f"""WITH {DESCRIBED}, z AS (SELECT label, count(*) AS n FROM docs GROUP BY 1), t AS (SELECT max(n) AS mx, min(n) AS mn, floor(quantile_cont(n, 0.5)) AS md FROM z)
SELECT 'none' AS strategy, label, n::BIGINT AS n, n::BIGINT AS distinct_rows FROM z UNION ALL SELECT 'random_oversample', label, mx::BIGINT, least(n, mx)::BIGINT FROM z, t UNION ALL SELECT 'random_undersample', label, mn::BIGINT, least(n, mn)::BIGINT FROM z, t UNION ALL SELECT 'median_resample', label, md::BIGINT, least(n, md)::BIGINT FROM z, t""",
    "nb_multinomial": f"""WITH {SPLIT}, {_COUNTS}, {_vocabulary("(SELECT * FROM counts WHERE doc_id IN (SELECT doc_id FROM split WHERE split = 'train'))", "SELECT count(*) AS n FROM split WHERE split = 'train'")},
tr AS (SELECT v.*, s.label FROM vec v JOIN split s USING (doc_id) WHERE split = 'train'), mass AS (SELECT label, term_id, sum(w) AS m FROM tr GROUP BY ALL), tot AS (SELECT label, sum(w) AS t FROM tr GROUP BY 1),
cls AS (SELECT label, ln(count(*) / sum(count(*)) OVER ()) AS prior FROM split WHERE split = 'train' GROUP BY label), vs AS (SELECT count(*) AS v FROM vocab),
model AS (SELECT c.label, o.term_id, ln((coalesce(m, 0) + 1) / (coalesce(t, 0) + v)) AS lp FROM cls c CROSS JOIN vocab o CROSS JOIN vs LEFT JOIN mass ON mass.label = c.label AND mass.term_id = o.term_id LEFT JOIN tot ON tot.label = c.label),
sc AS (SELECT v.doc_id, m.label, sum(w * lp) AS s FROM vec v JOIN split USING (doc_id) JOIN model m USING (term_id) WHERE split = 'test' GROUP BY ALL),
best AS (SELECT doc_id, label AS predicted FROM sc JOIN cls USING (label) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY round(s + prior, 6) DESC, label) = 1)
SELECT doc_id, s.label, predicted FROM best JOIN split s USING (doc_id)""",
    "nb_gaussian": f"WITH {_EMB}, {_GNB} SELECT * FROM gnb",
    "knn_classify": f"WITH {_KNN} SELECT * FROM knn",
    "confusion_matrix": f"WITH {_KNN} SELECT label, predicted, count(*)::BIGINT AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY label), 6) AS share FROM knn JOIN e ON vec_id = id GROUP BY label, predicted",
    "classification_report": f"WITH {_KNN}, kp AS (SELECT label, predicted FROM knn JOIN e ON vec_id = id), {_report('rep', 'kp')} SELECT label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM rep",
    "misclassified": f"WITH {_KNN} SELECT id, label, predicted FROM knn JOIN e ON vec_id = id WHERE label <> predicted",
    "model_leaderboard": f"""WITH {_KNN}, {_GNB}, kp AS (SELECT label, predicted FROM knn JOIN e ON vec_id = id), gp AS (SELECT label, predicted FROM gnb JOIN e ON vec_id = id), {_report('kr', 'kp')}, {_report('gr', 'gp')}
SELECT 'knn' AS model, (SELECT round(avg((label = predicted)::INT), 6) FROM kp) AS accuracy, (SELECT round(avg(f1), 6) FROM kr) AS macro_f1, (SELECT round(avg((label = predicted)::INT), 6) FROM kp) AS micro_f1
UNION ALL SELECT 'gaussian_nb', (SELECT round(avg((label = predicted)::INT), 6) FROM gp), (SELECT round(avg(f1), 6) FROM gr), (SELECT round(avg((label = predicted)::INT), 6) FROM gp)""",
    "kmeans_step": f"WITH {_lloyd(False)} SELECT * FROM lloyd",
    "spherical_kmeans_step": f"WITH {_lloyd(True)} SELECT * FROM lloyd",
    "cluster_quality": f"WITH {_lloyd(False)}, x AS (SELECT cluster, label FROM lloyd JOIN e ON vec_id = id) SELECT * FROM {_quality('x')}",
    "clustering_grid": f"WITH {_sql_grid()} SELECT * FROM grid",
    "best_runs": f"WITH {_sql_grid()} SELECT method, k, nmi FROM grid QUALIFY row_number() OVER (PARTITION BY method ORDER BY nmi DESC, k) = 1",
    "purity_by_k": f"WITH {_sql_grid()} SELECT method, {', '.join(f'max(purity) FILTER (k = {k}) AS k{k}' for k in (5, 10, 20))} FROM grid GROUP BY method",
    "frequent_confusions": f"WITH {_KNN} SELECT label, predicted, count(*)::BIGINT AS n FROM knn JOIN e ON vec_id = id WHERE label <> predicted GROUP BY ALL ORDER BY n DESC, label, predicted LIMIT 10",
    "dbscan": f"WITH RECURSIVE {_DBSCAN} SELECT * FROM db",
    "dbscan_summary": f"WITH RECURSIVE {_DBSCAN}, s AS (SELECT count(DISTINCT cluster) FILTER (cluster >= 0)::BIGINT AS n_clusters, count(*) FILTER (cluster >= 0)::BIGINT AS clustered_points, round(avg((cluster < 0)::INT), 6) AS noise_ratio FROM db) SELECT *, n_clusters >= 2 AND clustered_points >= 2 AND noise_ratio <= 0.5 AS valid FROM s",
    "silhouette": f"""WITH {_EMB}, d AS (SELECT a.vec_id, a.label AS own, b.label AS other, sum(1 - list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v)))) FILTER (a.vec_id <> b.vec_id) AS s, count(*) FILTER (a.vec_id <> b.vec_id) AS n FROM e a, e b GROUP BY ALL),
ab AS (SELECT vec_id, own, max(CASE WHEN own = other AND n > 0 THEN s / n END) AS a, min(CASE WHEN own <> other THEN s / n END) AS b FROM d GROUP BY ALL)
SELECT own AS cluster, count(*)::BIGINT AS points, round(avg(CASE WHEN a IS NULL OR b IS NULL THEN 0.0 ELSE (b - a) / greatest(a, b, 1e-12) END), 6) AS silhouette FROM ab GROUP BY own""",
    "silhouette_squared": f"""WITH {_EMB}, d AS (SELECT a.vec_id, a.label AS own, b.label AS other, sum(pow(list_distance(a.v, b.v), 2)) FILTER (a.vec_id <> b.vec_id) AS s, count(*) FILTER (a.vec_id <> b.vec_id) AS n FROM e a, e b GROUP BY ALL),
ab AS (SELECT vec_id, own, max(CASE WHEN own = other AND n > 0 THEN s / n END) AS a, min(CASE WHEN own <> other THEN s / n END) AS b FROM d GROUP BY ALL)
SELECT own AS cluster, count(*)::BIGINT AS points, round(avg(CASE WHEN a IS NULL OR b IS NULL THEN 0.0 ELSE (b - a) / greatest(a, b, 1e-12) END), 6) AS silhouette FROM ab GROUP BY own""",
    "silhouette_euclidean": f"""WITH {_EMB}, d AS (SELECT a.vec_id, a.label AS own, b.label AS other, sum(list_distance(a.v, b.v)) FILTER (a.vec_id <> b.vec_id) AS s, count(*) FILTER (a.vec_id <> b.vec_id) AS n FROM e a, e b WHERE a.vec_id % 20 = 0 GROUP BY ALL),
ab AS (SELECT vec_id, own, max(CASE WHEN own = other AND n > 0 THEN s / n END) AS a, min(CASE WHEN own <> other THEN s / n END) AS b FROM d GROUP BY ALL)
SELECT vec_id AS id, own AS cluster, round(CASE WHEN a IS NULL OR b IS NULL THEN 0.0 ELSE (b - a) / greatest(a, b, 1e-12) END, 6) AS silhouette FROM ab""",
    "cluster_representatives": f"""WITH {_EMB}, u AS (SELECT vec_id AS id, label AS cluster, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS v FROM e),
c AS (SELECT cluster, list(s ORDER BY pos) AS c FROM (SELECT cluster, pos, sum(x) AS s FROM (SELECT cluster, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM u) GROUP BY ALL) GROUP BY cluster),
n AS (SELECT cluster, id, round(list_dot_product(v, c) / sqrt(list_dot_product(c, c)), 6) AS similarity FROM u JOIN c USING (cluster))
SELECT cluster, row_number() OVER (PARTITION BY cluster ORDER BY similarity DESC, id)::BIGINT AS rank, id, similarity FROM n QUALIFY rank <= 3""",
    "grid_means": f"WITH {_sql_grid()} SELECT method, round(avg(purity), 5) AS purity, round(avg(nmi), 5) AS nmi, round(avg(rand_index), 5) AS rand_index FROM grid GROUP BY method",
    "negative_samples": f"""WITH {_W2V}, w AS (SELECT doc_id, unnest(t) AS word, generate_subscripts(t, 1) AS pos FROM sent WHERE len(t) > 1),
pairs AS (SELECT DISTINCT a.word AS center, b.word AS context FROM w a JOIN w b ON a.doc_id = b.doc_id AND abs(a.pos - b.pos) BETWEEN 1 AND 3),
top AS (SELECT list(word ORDER BY n DESC, word) AS l FROM (SELECT word, count(*) AS n FROM (SELECT unnest(t) AS word FROM sent) GROUP BY word ORDER BY n DESC, word LIMIT 100)),
drawn AS (SELECT center, context, l, ('0x' || substr(md5('42:' || i || ':' || center || ' ' || context), 1, 7))::BIGINT % len(l) AS p FROM pairs, top, range(1, 6) r(i))
SELECT negative, count(*)::BIGINT AS n, count(DISTINCT context)::BIGINT AS contexts FROM (SELECT context, CASE WHEN l[p + 1] = context THEN l[(p + 1) % len(l) + 1] ELSE l[p + 1] END AS negative FROM drawn) GROUP BY 1""",
    "cluster_top_terms": f"WITH {TFIDF}, sz AS (SELECT label, count(*) AS n FROM docs GROUP BY 1), m AS (SELECT d.label AS cluster, term, round(sum(w) / max(sz.n), 6) AS weight FROM vec JOIN docs d USING (doc_id) JOIN sz ON sz.label = d.label GROUP BY ALL) SELECT cluster, row_number() OVER (PARTITION BY cluster ORDER BY weight DESC, term)::BIGINT AS rank, term, weight FROM m QUALIFY rank <= 10",
    "cluster_profile": f"""WITH {S.BOOKS}, {MAIN}, k AS (SELECT doc_id, coalesce(label, 'none') AS cluster FROM main), v AS (SELECT bookid AS doc_id, unnest({_ITEMS.format(c='genres')}) AS value FROM books), n AS (SELECT cluster, value, count(*) AS n FROM k JOIN v USING (doc_id) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY n DESC, value) AS r FROM n) SELECT s.cluster, s.size, coalesce(t.top, '') AS top FROM (SELECT cluster, count(*)::BIGINT AS size FROM k GROUP BY 1) s LEFT JOIN (SELECT cluster, string_agg(value || ' (' || n || ')', ', ' ORDER BY r) AS top FROM r WHERE r <= 5 GROUP BY 1) t USING (cluster)""",
    "nearest_neighbors": f"WITH {_EMB}, s AS (SELECT q.vec_id AS query, t.vec_id AS neighbour, {_COS.format(a='q.v', b='t.v')} AS similarity FROM e q, e t WHERE q.vec_id % 20 = 0 AND q.vec_id <> t.vec_id) SELECT *, row_number() OVER (PARTITION BY query ORDER BY similarity DESC, neighbour)::BIGINT AS rank FROM s QUALIFY rank <= 5",
    "odd_one_out": f"WITH {_EMB}, g AS (SELECT vec_id // 4 AS grp, vec_id AS id, v FROM e), m AS (SELECT x.grp, x.id, round(avg(list_dot_product(x.v, y.v) / (sqrt(list_dot_product(x.v, x.v)) * sqrt(list_dot_product(y.v, y.v)))), 6) AS s FROM g x JOIN g y ON x.grp = y.grp AND x.id <> y.id GROUP BY ALL) SELECT grp, id AS odd, s AS similarity FROM m QUALIFY row_number() OVER (PARTITION BY grp ORDER BY s, id) = 1",
    "mean_pooling": f"WITH {_EMB}, c AS (SELECT label, vec_id % 3 + 1 AS w, unnest(v) AS x, generate_subscripts(v, 1) - 1 AS pos FROM e) SELECT label, pos::BIGINT AS pos, round(sum(x * w) / sum(w), 6) AS value FROM c GROUP BY ALL",
    "w2v_corpus": f"WITH {_W2V} SELECT doc_id, array_to_string(t, ' ') AS tokens FROM sent",
    "skipgram_pairs": f"WITH {_W2V}, w AS (SELECT doc_id, unnest(t) AS word, generate_subscripts(t, 1) AS pos FROM sent WHERE len(t) > 1) SELECT a.word AS center, b.word AS context, count(*)::BIGINT AS n FROM w a JOIN w b ON a.doc_id = b.doc_id AND abs(a.pos - b.pos) BETWEEN 1 AND 3 GROUP BY ALL",
    "token_histogram": f"WITH {_W2V} SELECT word, count(*)::BIGINT AS n FROM (SELECT unnest(t) AS word FROM sent) GROUP BY word ORDER BY n DESC, word LIMIT 100",
    "pages_by_language": f"""WITH {S.BOOKS}, {MAIN}, p AS (SELECT label, lower(trim(languages)) AS lang, {S.whole('num_pages')} AS pages FROM books JOIN main ON doc_id = bookid WHERE label IS NOT NULL)
SELECT label, {', '.join(f"max(pages) FILTER (lang = '{x}') AS {x}" for x in ('english', 'spanish', 'french', 'german'))} FROM p GROUP BY label""",
}
