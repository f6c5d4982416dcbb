"""Classifiers as joins and sums, learners on bounded samples, and classification metrics."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliant.operators import vectors as V


def multinomial_nb(train: DataFrame, labels: DataFrame, vocabulary: DataFrame, alpha: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """``(label, term_id, lp)`` for every class and term, and ``(label, prior)``, from vectors ``(doc_id, term_id, w)``; the prior isn't smoothed."""
    known = train.join(labels, "doc_id")
    mass = known.groupBy("label", "term_id").agg(F.sum("w").alias("m"))
    total = known.groupBy("label").agg(F.sum("w").alias("t"))
    classes = labels.groupBy("label").agg(F.count("*").alias("n"))
    size = vocabulary.agg(F.count("*").alias("v"))
    prior = classes.crossJoin(F.broadcast(classes.agg(F.sum("n").alias("all")))).select("label", F.log(F.col("n") / F.col("all")).alias("prior"))
    # classes x vocabulary, both of bounded size
    grid = classes.select("label").crossJoin(F.broadcast(vocabulary.select("term_id")))
    model = grid.join(mass, ["label", "term_id"], "left").join(F.broadcast(total), "label", "left").crossJoin(F.broadcast(size))
    lp = F.log((F.coalesce("m", F.lit(0.0)) + alpha) / (F.coalesce("t", F.lit(0.0)) + alpha * F.col("v")))
    return model.select("label", "term_id", lp.alias("lp")), prior


def predict_multinomial(vectors: DataFrame, model: DataFrame, prior: DataFrame) -> DataFrame:
    """``(doc_id, predicted, score)``: the class of the greatest score to 6 places, the first by name of several."""
    sums = vectors.join(model, "term_id").groupBy("doc_id", "label").agg(F.sum(F.col("w") * F.col("lp")).alias("s"))
    scored = sums.join(F.broadcast(prior), "label").withColumn("score", F.round(F.col("s") + F.col("prior"), 6))
    return scored.groupBy("doc_id").agg(F.min_by("label", F.struct(-F.col("score"), F.col("label"))).alias("predicted"), F.max("score").alias("score"))


def gaussian_nb(train: DataFrame, label: str = "label", vector: str = "embedding", smoothing: float = 1e-9) -> tuple[DataFrame, DataFrame]:
    """``(label, pos, mean, var)`` and ``(label, prior)``; variances of the population plus a share of the largest."""
    cells = train.select(F.col(label).alias("label"), F.posexplode(V.doubles(F.col(vector))).alias("pos", "x"))
    widest = cells.groupBy("pos").agg(F.var_pop("x").alias("v")).agg(F.max("v").alias("v")).select(F.when(F.col("v") > 0, F.col("v") * smoothing).otherwise(smoothing).alias("eps"))
    stats = cells.groupBy("label", "pos").agg(F.avg("x").alias("mean"), F.var_pop("x").alias("var")).crossJoin(F.broadcast(widest))
    classes = train.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n"))
    prior = classes.crossJoin(F.broadcast(classes.agg(F.sum("n").alias("all")))).select("label", F.log(F.col("n") / F.col("all") + 1e-12).alias("prior"))
    return stats.select("label", "pos", "mean", (F.col("var") + F.col("eps")).alias("var")), prior


def predict_gaussian(data: DataFrame, model: DataFrame, prior: DataFrame, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``(id, predicted, score)``."""
    cells = data.select(F.col(id_col).alias("id"), F.posexplode(V.doubles(F.col(vector))).alias("pos", "x"))
    term = -0.5 * (F.log(2 * np.pi * F.col("var")) + (F.col("x") - F.col("mean")) * (F.col("x") - F.col("mean")) / F.col("var"))
    sums = cells.join(F.broadcast(model), "pos").groupBy("id", "label").agg(F.sum(term).alias("s"))
    scored = sums.join(F.broadcast(prior), "label").withColumn("score", F.round(F.col("s") + F.col("prior"), 4))
    return scored.groupBy("id").agg(F.min_by("label", F.struct(-F.col("score"), F.col("label"))).alias("predicted"), F.max("score").alias("score"))


def knn(queries: DataFrame, train: DataFrame, k: int = 5, id_col: str = "vec_id", label: str = "label", vector: str = "embedding") -> DataFrame:
    """``(id, predicted, votes)``: the majority of the ``k`` nearest, the lowest class of several."""
    near = V.nearest(queries, train, k, id_col, vector)
    votes = near.join(train.select(F.col(id_col).alias("neighbour"), F.col(label).alias("label")), "neighbour").groupBy("query", "label").agg(F.count("*").alias("n"))
    return votes.groupBy("query").agg(F.min_by("label", F.struct(-F.col("n"), F.col("label"))).alias("predicted"), F.max("n").alias("votes")).withColumnRenamed("query", "id")


def softmax_regression(train: DataFrame, test: DataFrame, id_col: str = "vec_id", label: str = "label", vector: str = "embedding", l2: float = 1e-4, rounds: int = 100) -> DataFrame:
    """``(id, predicted)`` by multinomial logistic regression, distributed; ``label`` is a class number from 0."""
    prepared = lambda df: df.select(F.col(id_col).alias("id"), F.col(label).cast("double").alias("y"), array_to_vector(V.doubles(F.col(vector))).alias("x"))
    model = LogisticRegression(featuresCol="x", labelCol="y", family="multinomial", regParam=l2, elasticNetParam=0.0, standardization=False, maxIter=rounds).fit(prepared(train))
    return model.transform(prepared(test)).select("id", F.col("prediction").cast("int").alias("predicted"))


def train_mlp(x: np.ndarray, y: np.ndarray, hidden: int = 128, rate: float = 0.01, epochs: int = 50, batch: int = 128, l2: float = 1e-4, seed: int = 42) -> tuple[np.ndarray, ...]:
    """Weights of a network with one layer of rectified units, by mini-batch gradient descent."""
    rng = np.random.default_rng(seed)
    classes = int(y.max()) + 1
    w1, b1 = rng.normal(0, np.sqrt(2 / x.shape[1]), (x.shape[1], hidden)), np.zeros(hidden)
    w2, b2 = rng.normal(0, np.sqrt(2 / hidden), (hidden, classes)), np.zeros(classes)
    target = np.eye(classes)[y]
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for s in range(0, len(x), batch):
            at = order[s : s + batch]
            h = x[at] @ w1 + b1
            r = np.maximum(h, 0)
            z = r @ w2 + b2
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            d = (p - target[at]) / len(at)
            g = (d @ w2.T) * (h > 0)
            w2, b2 = w2 - rate * (r.T @ d + l2 * w2), b2 - rate * d.sum(0)
            w1, b1 = w1 - rate * (x[at].T @ g + l2 * w1), b1 - rate * g.sum(0)
    return w1, b1, w2, b2


def mlp(train: DataFrame, test: DataFrame, id_col: str = "vec_id", label: str = "label", vector: str = "embedding", sample: int = 20_000, **settings: float) -> DataFrame:
    """``(id, predicted)``: trained on up to ``sample`` rows of the lowest hashes of their content, applied to all rows of ``test`` in Arrow batches."""
    rows = train.select(F.col(label).alias("y"), F.col(vector).alias("x"), F.xxhash64(id_col, label, vector).alias("h")).orderBy("h").limit(sample).toPandas()
    weights = train_mlp(np.stack(rows["x"].to_numpy()).astype(float), rows["y"].to_numpy(int), **settings)

    def apply(batches):
        w1, b1, w2, b2 = weights
        for pdf in batches:
            if len(pdf):
                z = np.maximum(np.stack(pdf["x"].to_numpy()).astype(float) @ w1 + b1, 0) @ w2 + b2
                yield pd.DataFrame({"id": pdf["id"], "predicted": z.argmax(1).astype(np.int32)})

    kind = dict(test.dtypes)[id_col]
    return test.select(F.col(id_col).alias("id"), F.col(vector).alias("x")).mapInPandas(apply, f"id {kind}, predicted int")


def confusion(pairs: DataFrame) -> DataFrame:
    """``(label, predicted, n, share)`` of ``(label, predicted)``; shares are of the row's class."""
    n = pairs.groupBy("label", "predicted").agg(F.count("*").alias("n"))
    return n.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("label")), 6))


def class_report(pairs: DataFrame) -> DataFrame:
    """``(label, precision, recall, f1, support)`` of every class that occurs on either side; 0 where nothing divides."""
    labels = pairs.select("label").union(pairs.select("predicted")).distinct()
    hit = pairs.where(F.col("label") == F.col("predicted")).groupBy("label").agg(F.count("*").alias("tp"))
    true, said = pairs.groupBy("label").agg(F.count("*").alias("support")), pairs.groupBy(F.col("predicted").alias("label")).agg(F.count("*").alias("said"))
    counts = labels.join(hit, "label", "left").join(true, "label", "left").join(said, "label", "left").na.fill(0, ["tp", "support", "said"])
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    p, r = ratio(F.col("tp"), F.col("said")), ratio(F.col("tp"), F.col("support"))
    return counts.select("label", p.alias("precision"), r.alias("recall"), ratio(2 * p * r, p + r).alias("f1"), "support")


def overall(pairs: DataFrame) -> DataFrame:
    """One row: accuracy, macro precision, recall and F1, and micro F1 (which is the accuracy)."""
    report = class_report(pairs).agg(*(F.avg(c).alias(f"macro_{c}") for c in ("precision", "recall", "f1")))
    right = pairs.agg(F.avg((F.col("label") == F.col("predicted")).cast("double")).alias("accuracy"))
    return right.crossJoin(report).select(*(F.round(c, 6).alias(c) for c in ("accuracy", "macro_precision", "macro_recall", "macro_f1")), F.round("accuracy", 6).alias("micro_f1"))
