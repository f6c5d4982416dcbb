"""Clustering and measures of it."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliant.operators import vectors as V
from foliant.operators.features import numbered
from foliant.operators.graph import components
from foliant.session import checkpoint, merging, parallelism


def _points(data: DataFrame, id_col: str, vector: str, spherical: bool) -> DataFrame:
    v = V.doubles(F.col(vector))
    return data.select(F.col(id_col).alias("id"), (V.unit(v) if spherical else v).alias("v"))


def first_centres(data: DataFrame, k: int, id_col: str = "vec_id", vector: str = "embedding", spherical: bool = False) -> DataFrame:
    """``(cluster, c)``: the ``k`` rows of the smallest ids, a deterministic start."""
    rows = _points(data, id_col, vector, spherical).orderBy("id").limit(k)
    return rows.select((F.row_number().over(Window.orderBy("id")) - 1).cast("bigint").alias("cluster"), F.col("v").alias("c"))


def assign(points: DataFrame, centres: DataFrame, spherical: bool = False) -> DataFrame:
    """``(id, v, cluster, cost)``: the nearest of a bounded number of centres, the first of several."""
    all_centres = centres.agg(F.array_sort(F.collect_list(F.struct("cluster", "c"))).alias("_all"))

    def cost(c):
        if spherical:
            return 1 - V.dot(F.col("v"), c["c"])
        return F.aggregate(F.zip_with(F.col("v"), c["c"], lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, d: s + d)

    best = F.array_min(F.transform("_all", lambda c: F.struct(F.round(cost(c), 9).alias("cost"), c["cluster"].alias("cluster"))))
    return points.crossJoin(F.broadcast(all_centres)).select("id", "v", best.alias("_b")).select("id", "v", "_b.cluster", "_b.cost")


def recentre(assigned: DataFrame, spherical: bool = False) -> DataFrame:
    """``(cluster, c)``: means of the clusters, at length 1 for the spherical kind."""
    cells = assigned.select("cluster", F.posexplode("v").alias("pos", "x")).groupBy("cluster", "pos").agg(F.avg("x").alias("m"))
    lists = cells.groupBy("cluster").agg(F.array_sort(F.collect_list(F.struct("pos", "m"))).alias("l")).select("cluster", F.transform("l", lambda p: p["m"]).alias("c"))
    return lists.select("cluster", V.unit(F.col("c")).alias("c")) if spherical else lists


def lloyd(data: DataFrame, k: int = 10, rounds: int = 3, id_col: str = "vec_id", vector: str = "embedding", spherical: bool = False) -> DataFrame:
    """``(id, cluster, cost)`` after ``rounds`` assignments; labels precede the last update."""
    points = _points(data, id_col, vector, spherical)
    centres = first_centres(data, k, id_col, vector, spherical)
    for r in range(rounds):
        assigned = assign(points, centres, spherical)
        if r + 1 < rounds:
            centres = checkpoint(recentre(assigned, spherical))
    return assigned.select("id", "cluster", F.round("cost", 6).alias("cost"))


def kmeans(data: DataFrame, k: int = 20, seed: int = 43, id_col: str = "vec_id", vector: str = "embedding", spherical: bool = False, rounds: int = 40) -> DataFrame:
    """``(id, cluster)`` at convergence from a random start, distributed."""
    rows = data.select(F.col(id_col).alias("id"), array_to_vector(V.doubles(F.col(vector))).alias("features"))
    model = KMeans(k=k, seed=seed, maxIter=rounds, tol=1e-4, initMode="random", distanceMeasure="cosine" if spherical else "euclidean").fit(rows)
    return model.transform(rows).select("id", F.col("prediction").cast("bigint").alias("cluster"))


def dbscan(data: DataFrame, eps: float = 0.35, min_samples: int = 5, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``(id, cluster)`` by cosine distance: clusters numbered by their smallest core, -1 for noise.

    A point counts among its own neighbours; a border point goes to the lowest cluster
    that reaches it. Pairs of near points are counted, and then joined to groups, block
    by block; they are never listed.
    """
    rows = data.select(F.col(id_col).alias("id"), F.col(vector).alias("v"))
    n = V.neighbour_counts(rows, 1 - eps, "id", "v").withColumnRenamed("a", "id")
    flagged = checkpoint(merging(rows, n, "id", "left").select("id", "v", (F.coalesce("n", F.lit(0)) + 1 >= min_samples).alias("core")))
    links = checkpoint(V.forest(flagged, "core", 1 - eps, "id", "v"))
    heads = components(links.where("not border")).withColumnRenamed("node", "id")
    label = checkpoint(merging(flagged.where("core").select("id"), heads, "id", "left").select("id", F.coalesce("head", "id").alias("low")))
    # numbers follow the smallest core: places among the distinct labels
    numbers = numbered(label.select("low").distinct(), "low", "cluster")
    inner = checkpoint(merging(label, numbers, "low").select("id", "cluster"))
    reached = merging(links.where("border"), inner.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("cluster").alias("reach"))
    ids = flagged.select("id")
    return merging(merging(ids, inner, "id", "left"), reached, "id", "left").select("id", F.coalesce("cluster", "reach", F.lit(-1).cast("bigint")).alias("cluster"))


def dbscan_summary(clusters: DataFrame, most_noise: float = 0.5) -> DataFrame:
    """One row: clusters, points in them, share of noise, and whether a score is valid (two clusters and points, not too much noise)."""
    inside = F.col("cluster") >= 0
    s = clusters.agg(F.countDistinct(F.when(inside, F.col("cluster"))).alias("n_clusters"), F.count(F.when(inside, 1)).alias("clustered_points"), F.round(F.avg((~inside).cast("double")), 6).alias("noise_ratio"))
    return s.withColumn("valid", (F.col("n_clusters") >= 2) & (F.col("clustered_points") >= 2) & (F.col("noise_ratio") <= most_noise))


def merge_clusters(distance: np.ndarray, k: int, linkage: str) -> tuple[np.ndarray, list[float]]:
    """Labels at ``k`` clusters and the distances of the merges; of equal distances the first pair merges."""
    if linkage not in ("single", "complete", "average"):
        raise ValueError("linkage must be single, complete or average")
    d = distance.astype(float).copy()
    n = len(d)
    np.fill_diagonal(d, np.inf)
    size, member, alive = np.ones(n), np.arange(n), np.ones(n, bool)
    merges = []
    for _ in range(n - k):
        at = int(np.argmin(np.where(np.triu(np.ones_like(d, bool), 1), d, np.inf)))
        i, j = divmod(at, n)
        merges.append(float(d[i, j]))
        row = {"single": np.minimum(d[i], d[j]), "complete": np.maximum(d[i], d[j]), "average": (size[i] * d[i] + size[j] * d[j]) / (size[i] + size[j])}[linkage]
        row[[i, j]] = np.inf
        row[~alive] = np.inf
        d[i], d[:, i] = row, row
        d[j], d[:, j] = np.inf, np.inf
        size[i] += size[j]
        alive[j] = False
        member[member == j] = i
    return np.unique(member, return_inverse=True)[1], merges


def linkage_labels(points: np.ndarray, fitted: np.ndarray, labels: np.ndarray, linkage: str) -> np.ndarray:
    """The cluster of the smallest cosine distance by ``linkage`` for each row; all rows at length 1; of equal distances the first."""
    d = np.clip(1 - points @ fitted.T, 0, 2)
    to = {"single": np.min, "complete": np.max, "average": np.mean}[linkage]
    return np.argmin(np.stack([to(d[:, labels == c], axis=1) for c in range(labels.max() + 1)], axis=1), axis=1)


def hac(data: DataFrame, k: int = 7, linkage: str = "average", sample: int = 250, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``(id, cluster)`` of all rows.

    The method is sequential and quadratic, so the ``sample`` rows of the lowest
    hashes are merged; every other row goes to the nearest of their clusters by the
    same linkage, row by row. Up to ``sample`` rows the result is that of the method itself.
    """
    kind = dict(data.dtypes)[id_col]
    rows = data.select(F.col(id_col).alias("id"), V.doubles(F.col(vector)).alias("v"))
    unit = lambda v: (m := np.stack(v.to_numpy()).astype(float)) / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
    drawn = rows.withColumn("h", F.xxhash64("id")).orderBy("h", "id").limit(sample).toPandas().sort_values("id")
    if drawn.empty:
        return rows.select("id", F.lit(0).cast("bigint").alias("cluster"))
    fitted = unit(drawn["v"])
    labels, _ = merge_clusters(np.clip(1 - fitted @ fitted.T, 0, 2), min(k, len(fitted)), linkage)
    merged = dict(zip(drawn["id"], labels))

    def run(parts):
        for pdf in parts:
            if len(pdf):
                near = linkage_labels(unit(pdf["v"]), fitted, labels, linkage)
                yield pd.DataFrame({"id": pdf["id"], "cluster": np.array([merged.get(i, c) for i, c in zip(pdf["id"], near)], dtype=np.int64)})

    return rows.repartition(parallelism(data.sparkSession)).mapInPandas(run, f"id {kind}, cluster bigint")


def contingency(labelled: DataFrame) -> DataFrame:
    """``(cluster, label, n)``."""
    return labelled.groupBy("cluster", "label").agg(F.count("*").alias("n"))


def quality(labelled: DataFrame) -> DataFrame:
    """One row: purity, normalised mutual information and Rand index of ``(cluster, label)``, by the contingency table."""
    n_ij = contingency(labelled)
    a = n_ij.groupBy("cluster").agg(F.sum("n").alias("na"), F.max("n").alias("top"))
    b = n_ij.groupBy("label").agg(F.sum("n").alias("nb"))
    total = n_ij.agg(F.sum("n").alias("t"), F.sum(F.col("n") * F.col("n")).alias("nn"))
    share = lambda c: F.col(c) / F.col("t")
    mi = n_ij.join(a, "cluster").join(b, "label").crossJoin(F.broadcast(total)).agg(F.sum(share("n") * F.log(F.col("n") * F.col("t") / (F.col("na") * F.col("nb")))).alias("mi"))
    ha = a.crossJoin(F.broadcast(total)).agg(F.sum(-share("na") * F.log(share("na"))).alias("ha"), F.sum(F.col("na") * F.col("na")).alias("aa"), F.sum("top").alias("tops"))
    hb = b.crossJoin(F.broadcast(total)).agg(F.sum(-share("nb") * F.log(share("nb"))).alias("hb"), F.sum(F.col("nb") * F.col("nb")).alias("bb"))
    row = total.crossJoin(mi).crossJoin(ha).crossJoin(hb)
    pairs = F.col("t") * (F.col("t") - 1) / 2
    half = (F.col("ha") + F.col("hb")) / 2
    return row.select(
        F.col("t").cast("bigint").alias("points"), F.round(F.col("tops") / F.col("t"), 6).alias("purity"), F.round(F.when(half > 0, F.col("mi") / half), 6).alias("nmi"),
        F.round((pairs - (F.col("aa") + F.col("bb")) / 2 + F.col("nn")) / pairs, 6).alias("rand_index"),
    )


def silhouette(labelled: DataFrame, id_col: str = "vec_id", vector: str = "embedding", label: str = "label", squared: bool = False) -> DataFrame:
    """``(cluster, points, silhouette)`` by cosine distance, or by the square of the euclidean one.

    Mean distances of both kinds to a cluster follow from the sum of its vectors (and of
    their squares), so that no pair of rows is formed. A cluster of one has silhouette 0.
    """
    v = V.doubles(F.col(vector))
    points = labelled.select(F.col(id_col).alias("id"), F.col(label).alias("cluster"), (v if squared else V.unit(v)).alias("v"))
    cells = points.select("cluster", F.posexplode("v").alias("pos", "x")).groupBy("cluster", "pos").agg(F.sum("x").alias("s"))
    sums = cells.groupBy("cluster").agg(F.array_sort(F.collect_list(F.struct("pos", "s"))).alias("l")).select("cluster", F.transform("l", lambda p: p["s"]).alias("s"))
    sums = sums.join(points.groupBy("cluster").agg(F.count("*").alias("n"), F.sum(V.dot(F.col("v"), F.col("v"))).alias("q")), "cluster")
    every = sums.agg(F.collect_list(F.struct("cluster", "s", "n", "q")).alias("_all"))
    far = points.crossJoin(F.broadcast(every)).withColumn("vv", V.dot(F.col("v"), F.col("v")))
    total = (lambda c: c["n"] * F.col("vv") + c["q"] - 2 * V.dot(F.col("v"), c["s"])) if squared else (lambda c: c["n"] - V.dot(F.col("v"), c["s"]))
    distance = lambda c: F.when(c["cluster"] == F.col("cluster"), F.try_divide(total(c), c["n"] - 1)).otherwise(total(c) / c["n"])
    met = far.select("cluster", F.transform("_all", lambda c: F.struct((c["cluster"] == F.col("cluster")).alias("own"), distance(c).alias("d"))).alias("_d"))
    a = F.filter("_d", lambda x: x["own"])[0]["d"]
    b = F.array_min(F.transform(F.filter("_d", lambda x: ~x["own"]), lambda x: x["d"]))
    width = met.select("cluster", F.when(a.isNull() | b.isNull(), 0.0).otherwise((b - a) / F.greatest(a, b, F.lit(1e-12))).alias("s"))
    return width.groupBy("cluster").agg(F.count("*").alias("points"), F.round(F.avg("s"), 6).alias("silhouette"))


def silhouette_euclidean(labelled: DataFrame, query: str, id_col: str = "vec_id", vector: str = "embedding", label: str = "label", block: int = 2_048) -> DataFrame:
    """``(id, cluster, silhouette)`` by euclidean distance, of the rows that the condition ``query`` picks, against all rows in blocks.

    Sums of euclidean distances do not follow from sums of vectors; each block of rows
    is one matrix product with each block of queries, which leaves a sum for a query and a cluster.
    """
    kind, cluster = dict(labelled.dtypes)[id_col], dict(labelled.dtypes)[label]
    rows = checkpoint(labelled.select(F.col(id_col).alias("id"), F.col(label).alias("cluster"), V.doubles(F.col(vector)).alias("v"), F.expr(query).alias("asked")).where("v is not null and cluster is not null"))
    asked = rows.where("asked")
    nq, nd = (max(1, -(-df.count() // block)) for df in (asked, rows))
    q = asked.select("id", "cluster", "v", F.pmod(F.xxhash64("id"), F.lit(nq)).alias("qb"), F.explode(F.sequence(F.lit(0), F.lit(nd - 1)).cast("array<bigint>")).alias("db"))
    d = rows.select("id", "cluster", "v", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(nd)).alias("db"), F.explode(F.sequence(F.lit(0), F.lit(nq - 1)).cast("array<bigint>")).alias("qb"))

    def sums(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({c: pd.Series(dtype=object) for c in ("id", "own", "cluster", "s", "n")})
        x, y = (np.stack(df["v"].to_numpy()).astype(float) for df in (left, right))
        apart = np.sqrt(np.maximum(0, (x * x).sum(1)[:, None] + (y * y).sum(1) - 2 * x @ y.T))
        same = left["id"].to_numpy()[:, None] == right["id"].to_numpy()[None, :]
        apart[same] = 0
        parts = []
        for value, at in right.groupby("cluster").indices.items():
            parts.append(pd.DataFrame({"id": left["id"], "own": left["cluster"], "cluster": value, "s": apart[:, at].sum(1), "n": len(at) - same[:, at].sum(1)}))
        return pd.concat(parts)

    met = q.groupBy("qb", "db").cogroup(d.groupBy("qb", "db")).applyInPandas(sums, f"id {kind}, own {cluster}, cluster {cluster}, s double, n bigint")
    mean = met.groupBy("id", "own", "cluster").agg(F.try_divide(F.sum("s"), F.sum("n")).alias("d"))
    ab = mean.groupBy("id", "own").agg(F.max(F.when(F.col("own") == F.col("cluster"), F.col("d"))).alias("a"), F.min(F.when(F.col("own") != F.col("cluster"), F.col("d"))).alias("b"))
    width = F.when(F.col("a").isNull() | F.col("b").isNull(), 0.0).otherwise((F.col("b") - F.col("a")) / F.greatest("a", "b", F.lit(1e-12)))
    return ab.select("id", F.col("own").alias("cluster"), F.round(width, 6).alias("silhouette"))


def representatives(labelled: DataFrame, k: int = 3, id_col: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """``(cluster, rank, id, similarity)``: the ``k`` rows of each cluster nearest by cosine to the sum of its unit vectors, the smaller id first of several."""
    points = labelled.select(F.col(id_col).alias("id"), F.col(label).alias("cluster"), V.unit(V.doubles(F.col(vector))).alias("v"))
    centre = recentre(points, spherical=True).withColumnRenamed("c", "centre")
    near = points.join(centre, "cluster").select("cluster", "id", F.round(V.dot(F.col("v"), F.col("centre")), 6).alias("similarity"))
    rank = F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc("similarity"), "id"))
    return near.withColumn("rank", rank.cast("bigint")).where(F.col("rank") <= k).select("cluster", "rank", "id", "similarity")


def pca_2d(data: DataFrame, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``(id, x, y)``: the two first principal components of the centred rows; signs are arbitrary."""
    rows = data.select(F.col(id_col).alias("id"), array_to_vector(V.doubles(F.col(vector))).alias("f"))
    model = PCA(k=2, inputCol="f", outputCol="p").fit(rows)
    out = model.transform(rows).select("id", vector_to_array("p").alias("p")).select("id", F.col("p")[0].alias("x"), F.col("p")[1].alias("y"))
    centre = out.agg(F.avg("x").alias("mx"), F.avg("y").alias("my"))
    return out.crossJoin(F.broadcast(centre)).select("id", (F.col("x") - F.col("mx")).alias("x"), (F.col("y") - F.col("my")).alias("y"))


def top_terms(vectors: DataFrame, clusters: DataFrame, k: int = 10) -> DataFrame:
    """``(cluster, rank, term, weight)``: terms of the highest mean weight over all documents of a cluster."""
    sizes = clusters.groupBy("cluster").agg(F.count("*").alias("n"))
    sums = vectors.join(clusters, "doc_id").groupBy("cluster", "term").agg(F.sum("w").alias("s")).join(F.broadcast(sizes), "cluster")
    mean = sums.withColumn("weight", F.round(F.col("s") / F.col("n"), 6))
    rank = F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc("weight"), "term"))
    return mean.withColumn("rank", rank.cast("bigint")).where(F.col("rank") <= k).select("cluster", "rank", "term", "weight")


def profile(clusters: DataFrame, attributes: DataFrame, k: int = 5) -> DataFrame:
    """``(cluster, size, top)``: sizes, and the ``k`` most frequent values of ``(doc_id, value)`` as ``value (n)``."""
    sizes = clusters.groupBy("cluster").agg(F.count("*").alias("size"))
    counts = clusters.join(attributes, "doc_id").groupBy("cluster", "value").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc("n"), "value"))
    best = counts.withColumn("r", rank).where(F.col("r") <= k).groupBy("cluster").agg(F.array_sort(F.collect_list(F.struct("r", F.format_string("%s (%d)", F.col("value"), F.col("n")).alias("t")))).alias("l"))
    return sizes.join(best, "cluster", "left").select("cluster", "size", F.coalesce(F.array_join(F.transform("l", lambda x: x["t"]), ", "), F.lit("")).alias("top"))
