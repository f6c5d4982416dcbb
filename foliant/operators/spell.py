"""Spelling correction by character bigrams, without comparing every word with the lexicon."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions import text as T


def lexicon(texts: DataFrame, column: str = "text") -> DataFrame:
    """``(word, cnt, n_grams)``: lower-cased words without punctuation at their ends."""
    words = texts.select(F.explode(T.split_words(F.lower(column))).alias("word")).select(T.strip_edges(F.col("word")).alias("word")).where("word <> ''")
    return words.groupBy("word").agg(F.count("*").alias("cnt")).withColumn("n_grams", F.size(T.char_grams(F.col("word"))))


def save_lexicon(lexicon: DataFrame, path: str) -> None:
    lexicon.write.mode("overwrite").parquet(path)


def candidates(words: DataFrame, lexicon: DataFrame, k: int = 5) -> DataFrame:
    """``(word, candidate, jaccard, cnt, rank)``: the ``k`` nearest words by Jaccard similarity, ranked anew by similarity times count.

    Only words that share a bigram can be near. A first join over each word's two
    rarest bigrams gives ``k`` words and with the last of them a bound; a word at least
    that near must share one of the rarest bigrams, of which the bound says how many,
    so that common bigrams are rarely joined. A word of the lexicon has no rows.
    """
    right = lexicon.select(F.col("word").alias("candidate"), "cnt", T.char_grams(F.col("word")).alias("cg")).withColumn("g", F.explode("cg"))
    often = right.groupBy("g").agg(F.count("*").alias("f"))
    asked = words.select("word").where("word <> ''").distinct().join(lexicon.select("word"), "word", "left_anti")
    grams = asked.select("word", F.explode(T.char_grams(F.col("word"))).alias("g")).join(often, "g", "left")
    ordered = grams.groupBy("word").agg(F.transform(F.array_sort(F.collect_list(F.struct(F.coalesce("f", F.lit(0)).alias("f"), F.col("g").alias("g")))), lambda x: x["g"]).alias("wg"))

    def near(left: DataFrame) -> DataFrame:
        """Left has ``(word, wg, g)``; the ``k`` nearest that share a ``g``."""
        shared = F.size(F.array_intersect("wg", "cg"))
        met = left.join(right, "g").select("word", "candidate", "cnt", (shared / (F.size("wg") + F.size("cg") - shared)).alias("jaccard")).distinct()
        order = Window.partitionBy("word").orderBy(F.desc("jaccard"), "candidate")
        return met.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k)

    bound = near(ordered.select("word", "wg", F.explode(F.slice("wg", 1, 2)).alias("g"))).groupBy("word").agg(F.when(F.count("*") >= k, F.min("jaccard")).otherwise(0.0).alias("t"))
    n = F.size("wg")
    first = ordered.join(bound, "word", "left").withColumn("_p", F.least(n, n - F.ceil(n * F.coalesce("t", F.lit(0.0)) - 1e-9) + 1).cast("int"))
    best = near(first.select("word", "wg", F.explode(F.slice("wg", F.lit(1), F.col("_p"))).alias("g")))
    again = F.row_number().over(Window.partitionBy("word").orderBy(F.desc(F.round(F.col("jaccard") * F.col("cnt"), 9)), "candidate"))
    return best.select("word", "candidate", F.round("jaccard", 6).alias("jaccard"), "cnt", again.cast("bigint").alias("rank"))


def correct(queries: DataFrame, lexicon: DataFrame, k: int = 5) -> DataFrame:
    """``(query_id, corrected, changed)`` of ``(query_id, text)``; words without any near word stay."""
    words = queries.select("query_id", F.posexplode(T.split_words(F.lower("text"))).alias("pos", "raw")).withColumn("word", T.strip_edges(F.col("raw")))
    best = candidates(words, lexicon, k).where("rank = 1").select("word", "candidate")
    fixed = words.join(best, "word", "left").withColumn("out", F.coalesce("candidate", "word"))
    lists = fixed.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("pos", "out"))).alias("l"), F.max((F.col("out") != F.col("word")).cast("int")).alias("c"))
    return lists.select("query_id", F.array_join(F.transform("l", lambda x: x["out"]), " ").alias("corrected"), (F.col("c") == 1).alias("changed"))
