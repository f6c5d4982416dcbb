"""Text for word embeddings, skip-gram pairs, trainers and queries on word vectors."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.feature import Word2Vec
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.functions import text as T
from foliant.session import checkpoint, parallelism

#: Words of the domain that mean nothing here; names of sites come by parameter.
DOMAIN_WORDS = (
    "title", "titl", "author", "description", "descript", "genre", "genres", "genr", "place", "places", "page", "pages",
    "book", "books", "edition", "editions", "isbn", "cover", "paperback", "hardcover", "kindle", "ebook",
)


def sentence_tokens(text: Column, stop: list[str]) -> Column:
    """Words of the letters a to z only, longer than two, without stop words."""
    plain = F.regexp_replace(F.lower(text), r"[^a-z \t\r\n]", " ")
    return F.filter(T.split_words(plain), lambda w: (F.length(w) > 2) & ~w.isin(stop))


def corpus(books: DataFrame, stop: list[str], sites: tuple[str, ...] = ()) -> DataFrame:
    """``(doc_id, tokens)`` of title, author, description and genres with literal prefixes, which go again as domain words."""
    text = T.joined_text(*((f"{c} ", F.col(c)) for c in ("title", "author", "description", "genres")))
    return books.select(F.col("bookid").alias("doc_id"), sentence_tokens(text, sorted({*stop, *sites, *DOMAIN_WORDS})).alias("tokens"))


def skip_grams(sentences: DataFrame, window: int = 3) -> DataFrame:
    """``(center, context)``: pairs of words at most ``window`` apart, for sentences of more than one word."""
    words = sentences.where(F.size("tokens") > 1)
    shifted = [F.zip_with("tokens", F.slice("tokens", d + 1, 1_000_000_000), lambda a, b: F.when(b.isNotNull(), F.array(F.struct(a.alias("center"), b.alias("context")), F.struct(b.alias("center"), a.alias("context"))))) for d in range(1, window + 1)]
    every = F.flatten(F.filter(F.concat(*shifted), lambda p: p.isNotNull()))
    return words.select(F.explode(every).alias("p")).select("p.center", "p.context")


def vocabulary(sentences: DataFrame, most: int = 20_000) -> DataFrame:
    """``(word, n)`` of the ``most`` most frequent words."""
    return sentences.select(F.explode("tokens").alias("word")).groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(most)


def negatives(pairs: DataFrame, vocabulary: list[str], k: int = 5, seed: int = 42) -> DataFrame:
    """``(center, context, negative)``: ``k`` words of a bounded vocabulary by hash, none the context itself."""
    words = F.array(*(F.lit(w) for w in vocabulary))
    n = len(vocabulary)
    at = lambda i: (F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), i.cast("string"), F.lit(":"), F.col("center"), F.lit(" "), F.col("context"))), 1, 7), 16, 10).cast("bigint") % n).cast("int")
    drawn = F.transform(F.sequence(F.lit(1), F.lit(k)), lambda i: F.when(F.element_at(words, at(i) + 1) == F.col("context"), F.element_at(words, (at(i) + 1) % n + 1)).otherwise(F.element_at(words, at(i) + 1)))
    return pairs.withColumn("negative", F.explode(drawn))


def sgns(sentences: DataFrame, size: int = 100, window: int = 3, k: int = 5, rate: float = 0.025, epochs: int = 5, most: int = 20_000, seed: int = 42) -> DataFrame:
    """``(word, vec)``: skip-grams with negative samples over all sentences, for the ``most`` most frequent words.

    Every task trains a copy of the vectors on its own sentences; after each pass the
    copies are averaged, each word by the pairs that a task had of it. Size and words
    bound what is sent: 2 x ``most`` x ``size`` numbers.
    """
    spark = sentences.sparkSession
    words = [r["word"] for r in vocabulary(sentences, most).select("word").collect()]
    rng = np.random.default_rng(seed)
    inner, outer = rng.normal(0, 0.01, (len(words), size)), np.zeros((len(words), size))
    rows = checkpoint(sentences.select("tokens").where(F.size("tokens") > 1).repartition(parallelism(spark), F.xxhash64("tokens")))
    for epoch in range(epochs if len(words) > 1 else 0):
        held = spark.sparkContext.broadcast((words, inner, outer))

        def train(batches, epoch=epoch, held=held):
            known, v, u = held.value
            number = {w: i for i, w in enumerate(known)}
            v, u, rng = v.copy(), u.copy(), np.random.default_rng(seed + 1 + epoch)
            seen = np.zeros((2, len(known)))
            for pdf in batches:
                for tokens in pdf["tokens"]:
                    at = np.array([number[w] for w in tokens if w in number], np.int64)
                    for d in range(1, min(window, len(at) - 1) + 1):
                        for c, o in ((at[:-d], at[d:]), (at[d:], at[:-d])):
                            bad = rng.integers(0, len(known), (len(c), k))
                            bad = np.where(bad == o[:, None], (bad + 1) % len(known), bad)
                            to = np.concatenate([o[:, None], bad], 1)
                            g = 1 / (1 + np.exp(-np.einsum("id,ijd->ij", v[c], u[to])))
                            g[:, 0] -= 1
                            move, back = np.einsum("ij,ijd->id", g, u[to]), g[:, :, None] * v[c][:, None, :]
                            np.add.at(v, c, -rate * move)
                            np.add.at(u, to, -rate * back)
                            np.add.at(seen[0], c, 1)
                            np.add.at(seen[1], to, 1)
            for kind, table in ((0, v), (1, u)):
                met = np.flatnonzero(seen[kind])
                yield pd.DataFrame({"kind": kind, "n": met, "w": seen[kind][met], "x": list(table[met])})

        moved = rows.mapInPandas(train, "kind int, n bigint, w double, x array<double>")
        cells = moved.select("kind", "n", "w", F.posexplode("x").alias("pos", "v")).groupBy("kind", "n", "pos").agg((F.sum(F.col("v") * F.col("w")) / F.sum("w")).alias("v"))
        for r in cells.groupBy("kind", "n").agg(F.array_sort(F.collect_list(F.struct("pos", "v"))).alias("l")).select("kind", "n", F.transform("l", lambda p: p["v"]).alias("x")).toLocalIterator():
            (inner, outer)[r["kind"]][r["n"]] = r["x"]
        held.unpersist()
    return spark.createDataFrame([(w, inner[i].tolist()) for i, w in enumerate(words)], "word string, vec array<double>")


def word2vec(sentences: DataFrame, size: int = 100, window: int = 3, epochs: int = 5, least: int = 5, seed: int = 42) -> DataFrame:
    """``(word, vec)``, trained over all sentences by the distributed skip-gram of Spark ML."""
    model = Word2Vec(vectorSize=size, windowSize=window, maxIter=epochs, minCount=least, seed=seed, inputCol="tokens", outputCol="v").fit(sentences)
    return model.getVectors().select("word", vector_to_array("vector").alias("vec"))


def save_vectors(words: DataFrame, path: str) -> None:
    words.write.mode("overwrite").parquet(path)


def load_vectors(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
