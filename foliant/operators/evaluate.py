"""Precision, recall, F1, MAP, DCG, NDCG and MRR of runs against judgements.

``runs`` is ``(query_id, rank, doc_id)`` with ranks from 1, ``judged`` is
``(query_id, doc_id)``; ``queries`` names all queries, so that empty runs and empty
judgements count: without predictions precision is 0, without judgements recall is 1.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def per_query(queries: DataFrame, runs: DataFrame, judged: DataFrame) -> DataFrame:
    """``(query_id, precision, recall, ap, dcg, ndcg, rr)``."""
    relevant = judged.select("query_id", "doc_id").distinct().withColumn("hit", F.lit(1))
    marked = runs.join(relevant, ["query_id", "doc_id"], "left").select("query_id", "rank", F.coalesce("hit", F.lit(0)).alias("hit"))
    sizes = judged.groupBy("query_id").agg(F.count("*").alias("na"), F.countDistinct("doc_id").alias("nd"))
    return _measures(queries, marked, sizes)


def per_query_alike(queries: DataFrame, runs: DataFrame, docs: DataFrame) -> DataFrame:
    """``per_query`` where the documents ``(doc_id, text)``, one row each, with the text of a query ``(query_id, text)`` are those judged relevant.

    No row is made for a query and a document of its text, of which there are as many as the square of a text's repetitions.
    """
    own = queries.select("query_id", F.col("text").alias("_q"))
    met = runs.join(own, "query_id").join(docs.select("doc_id", F.col("text").alias("_d")), "doc_id", "left")
    marked = met.select("query_id", "rank", F.coalesce(F.col("_q") == F.col("_d"), F.lit(False)).cast("int").alias("hit"))
    n = docs.groupBy("text").agg(F.count("*").alias("na"))
    return _measures(queries, marked, queries.join(n, "text").select("query_id", "na", F.col("na").alias("nd")))


def _measures(queries: DataFrame, marked: DataFrame, sizes: DataFrame) -> DataFrame:
    """The measures of ``(query_id, rank, hit)`` and ``(query_id, na, nd)``, the numbers of judgements and of judged documents."""
    lists = marked.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "hit"))).alias("l"), F.count("*").alias("np"), F.sum("hit").alias("h"), F.sum(F.col("hit") / F.log2(F.col("rank") + 1)).alias("dcg"), F.min(F.when(F.col("hit") == 1, F.col("rank"))).alias("first"))
    # hits so far at each hit, over its rank
    state = F.aggregate("l", F.struct(F.lit(0).alias("n"), F.lit(0.0).alias("s")), lambda a, x: F.struct((a["n"] + x["hit"]).alias("n"), (a["s"] + F.when(x["hit"] == 1, (a["n"] + 1) / x["rank"]).otherwise(0.0)).alias("s")))
    runs_by = lists.select("query_id", "np", "h", "dcg", "first", state["s"].alias("aps"))
    q = queries.select("query_id").distinct().join(runs_by, "query_id", "left").join(sizes, "query_id", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.least(zero("na"), zero("np")), F.lit(1))), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1))
    has = (zero("na") > 0) & (zero("np") > 0)
    return q.select(
        "query_id",
        F.coalesce(F.try_divide(zero("h"), zero("np")), F.lit(0.0)).alias("precision"),
        F.when(zero("na") == 0, 1.0).otherwise(F.try_divide(zero("h"), zero("na"))).alias("recall"),
        F.coalesce(F.try_divide(F.coalesce("aps", F.lit(0.0)), zero("nd")), F.lit(0.0)).alias("ap"),
        F.coalesce("dcg", F.lit(0.0)).alias("dcg"),
        F.when(has, F.coalesce("dcg", F.lit(0.0)) / ideal).otherwise(0.0).alias("ndcg"),
        F.coalesce(F.try_divide(F.lit(1), F.col("first")), F.lit(0.0)).alias("rr"),
    )


def summary(by_query: DataFrame) -> DataFrame:
    """One row of means; F1 is of the mean precision and the mean recall."""
    m = by_query.agg(F.avg("precision").alias("p"), F.avg("recall").alias("r"), *(F.avg(c).alias(c) for c in ("ap", "dcg", "ndcg", "rr")))
    f1 = F.coalesce(F.try_divide(2 * F.col("p") * F.col("r"), F.col("p") + F.col("r")), F.lit(0.0))
    names = {"p": "precision", "r": "recall", "ap": "map", "dcg": "dcg", "ndcg": "ndcg", "rr": "mrr"}
    return m.select(*(F.round(c, 6).alias(n) for c, n in names.items()), F.round(f1, 6).alias("f1"))
