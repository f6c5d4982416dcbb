"""Features and labels: TF-IDF, scaling, encoding, splits and resampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions import text as T
from foliant.session import checkpoint, parallelism

#: Target genres by priority.
TARGET_GENRES = (
    "Fantasy", "Romance", "Mystery", "Thriller", "Science Fiction", "Historical Fiction", "Young Adult", "Classics", "Fiction", "Nonfiction", "History", "Biography", "Memoir", "Horror",
    "Children's", "Science", "Business", "Psychology", "Self Help", "Poetry", "Graphic Novels", "Comics", "Travel", "Sports", "Christian", "Cookbooks", "Music", "Art",
)
STRATEGIES = ("none", "random_oversample", "random_undersample", "median_resample")


def n_grams(text: Column) -> Column:
    """Words of two or more characters and pairs of them, repetitions kept."""
    return T.let(T.word_tokens(text), lambda words: F.concat(words, T.pairs(words)))


def term_counts(docs: DataFrame) -> DataFrame:
    """``(doc_id, term, c)`` of ``(doc_id, text)``."""
    return docs.select("doc_id", F.explode(n_grams(F.col("text"))).alias("term")).groupBy("doc_id", "term").agg(F.count("*").alias("c"))


def tfidf_vocabulary(counts: DataFrame, n_docs: DataFrame, min_df: int | float = 2, max_df: int | float = 0.8, features: int = 5_000) -> DataFrame:
    """``(term_id, term, tf, df, idf)``: the ``features`` most frequent terms within the limits, numbered in that order.

    Limits are counts if whole numbers, else shares of documents, rounded up and down.
    """
    n = F.col("n_docs")
    low = F.lit(min_df) if isinstance(min_df, int) else F.ceil(n * min_df)
    high = F.lit(max_df) if isinstance(max_df, int) else F.floor(n * max_df)
    terms = counts.groupBy("term").agg(F.sum("c").alias("tf"), F.count("*").alias("df")).crossJoin(F.broadcast(n_docs))
    kept = terms.where((F.col("df") >= low) & (F.col("df") <= high)).orderBy(F.desc("tf"), "term").limit(features)
    number = F.row_number().over(Window.orderBy(F.desc("tf"), "term")) - 1  # over at most ``features`` rows
    return kept.select(number.cast("bigint").alias("term_id"), "term", "tf", "df", (F.log((1 + n) / (1 + F.col("df"))) + 1).alias("idf"))


def tfidf_vectors(counts: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """``(doc_id, term_id, term, w)``: (1 + ln c) idf, each document's vector of length 1."""
    raw = counts.join(F.broadcast(vocabulary), "term").select("doc_id", "term_id", "term", ((1 + F.log("c")) * F.col("idf")).alias("_w"))
    norms = raw.groupBy("doc_id").agg(F.sqrt(F.sum(F.col("_w") * F.col("_w"))).alias("_n"))
    return raw.join(norms, "doc_id").select("doc_id", "term_id", "term", (F.col("_w") / F.col("_n")).alias("w"))


def top_variance(vectors: DataFrame, n_docs: DataFrame, most: int = 3_000) -> DataFrame:
    """``(term_id, term, variance)`` of the columns that vary most; absent terms count as 0."""
    sums = vectors.groupBy("term_id", "term").agg(F.sum("w").alias("s"), F.sum(F.col("w") * F.col("w")).alias("q")).crossJoin(F.broadcast(n_docs))
    mean = F.col("s") / F.col("n_docs")
    return sums.select("term_id", "term", F.round(F.col("q") / F.col("n_docs") - mean * mean, 9).alias("variance")).orderBy(F.desc("variance"), "term_id").limit(most)


def standard_scale(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns less their mean, over their population deviation (1 if next to none)."""
    stats = df.agg(*(F.avg(c).alias(f"_m_{c}") for c in columns), *(F.stddev_pop(c).alias(f"_s_{c}") for c in columns))
    deviation = lambda c: F.when(F.col(f"_s_{c}") < 1e-8, 1.0).otherwise(F.col(f"_s_{c}"))
    return df.crossJoin(F.broadcast(stats)).select(*(x for x in df.columns if x not in columns), *(((F.col(c) - F.col(f"_m_{c}")) / deviation(c)).alias(c) for c in columns))


def numbered(values: DataFrame, column: str, number: str) -> DataFrame:
    """``values`` with the place of each in the order of ``column``, from 0: ranges are numbered apart and put together by their sizes, so that no task sorts all."""
    parts = 2 * parallelism(values.sparkSession)
    placed = checkpoint(values.repartitionByRange(parts, column).withColumn("_p", F.spark_partition_id()))
    sizes = placed.groupBy("_p").agg(F.count("*").alias("_n"))  # at most ``parts`` rows
    starts = sizes.select("_p", (F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).alias("_s"))
    inner = F.row_number().over(Window.partitionBy("_p").orderBy(column)) - 1
    return placed.withColumn("_r", inner).join(F.broadcast(starts), "_p").withColumn(number, (F.col("_s") + F.col("_r")).cast("bigint")).drop("_p", "_r", "_s")


def encode_labels(df: DataFrame, column: str = "label") -> DataFrame:
    """``df`` with ``label_id``: the place of the label among the sorted distinct ones, from 0; null stays null. Any number of labels."""
    labels = df.select(column).where(F.col(column).isNotNull()).distinct()
    return df.join(numbered(labels, column, "label_id"), column, "left")


def main_genre(cell: Column) -> Column:
    """The target genre that a comma list names most often, the first by priority of several."""
    items = F.transform(T.list_items(cell), lambda g: F.btrim(F.btrim(g, F.lit('"')), F.lit("'")))
    best = F.array_max(F.transform(F.lit(list(TARGET_GENRES)), lambda g, i: F.struct(F.size(F.filter(items, lambda x: x == g)).alias("n"), (-i).alias("p"), g.alias("genre"))))
    return F.when(best["n"] > 0, best["genre"])


def eligible_classes(df: DataFrame, label: str = "label", least: int = 100, fallback: int = 5, most: int = 10) -> DataFrame:
    """``(label, n)``: the ``most`` largest classes of at least ``least`` rows; if fewer than two are, of at least ``fallback``."""
    counts = df.where(F.col(label).isNotNull()).groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n"))
    enough = counts.agg(F.count(F.when(F.col("n") >= least, 1)).alias("_k"))
    floor = F.when(F.col("_k") >= 2, F.lit(least)).otherwise(F.lit(fallback))
    return counts.crossJoin(F.broadcast(enough)).where(F.col("n") >= floor).orderBy(F.desc("n"), "label").limit(most).select("label", "n")


def hash_rank(df: DataFrame, id_col: str, seed: int, by: list[str]) -> DataFrame:
    """``df`` with ``rank`` (from 0) of the hash md5(seed:id) within ``by``, and ``n``, the group's rows.

    Groups are ranked in 256 parts by the hash's first two digits and put together by
    the counts of the parts, so that a group of any size is sorted by many tasks.
    """
    h = F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")))
    keyed = df.withColumn("_h", h).withColumn("_p", F.substring("_h", 1, 2))
    parts = keyed.groupBy(*by, "_p").agg(F.count("*").alias("_c"))
    before = Window.partitionBy(*by).orderBy("_p")
    starts = parts.select(*by, "_p", (F.sum("_c").over(before) - F.col("_c")).alias("_s"), F.sum("_c").over(Window.partitionBy(*by)).alias("n"))
    inner = Window.partitionBy(*by, "_p").orderBy("_h", id_col)
    ranked = keyed.withColumn("_r", F.row_number().over(inner)).join(starts, [*by, "_p"])
    return ranked.withColumn("rank", F.col("_s") + F.col("_r") - 1).drop("_h", "_p", "_s", "_r")


def stratified_split(df: DataFrame, id_col: str = "doc_id", label: str = "label", train: float = 0.7, dev: float = 0.15, seed: int = 42) -> DataFrame:
    """``df`` with ``split``: train, dev and test of each class by hash order; classes of three or more have all of them."""
    ranked = hash_rank(df, id_col, seed, [label])
    n = F.col("n")
    n_train, n_dev = F.floor(n * train), F.floor(n * dev)
    n_test = n - n_train - n_dev
    short_dev, short_test = (n >= 3) & (n_dev == 0), (n >= 3) & (n_test == 0)
    t1 = F.when(short_dev, F.greatest(F.lit(1), n_train - 1)).otherwise(n_train)
    t2 = F.when(short_test, F.greatest(F.lit(1), t1 - 1)).otherwise(t1)
    d = F.when(short_dev, 1).otherwise(n_dev)
    return ranked.withColumn("split", F.when(F.col("rank") < t2, "train").when(F.col("rank") < t2 + d, "dev").otherwise("test")).drop("rank", "n")


def random_split(df: DataFrame, id_col: str = "doc_id", share: float = 0.8, seed: int = 42) -> DataFrame:
    """``df`` with ``split``: the first share of all rows by hash order is train."""
    ranked = hash_rank(df.withColumn("_all", F.lit(1)), id_col, seed, ["_all"])
    return ranked.withColumn("split", F.when(F.col("rank") < F.floor(F.col("n") * share), "train").otherwise("test")).drop("rank", "n", "_all")


def resample(df: DataFrame, strategy: str, id_col: str = "doc_id", label: str = "label", seed: int = 42) -> DataFrame:
    """``df`` with ``copies`` of each row after resampling; rows of no copies are left out.

    The target is the largest, smallest or median class; rows are taken in turn by
    hash order, again from the start where the target is above the class.
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"strategy must be one of {', '.join(STRATEGIES)}")
    if strategy == "none":
        return df.withColumn("copies", F.lit(1).cast("bigint"))
    ranked = hash_rank(df.where(F.col(label).isNotNull()), id_col, seed, [label])
    sizes = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("_n"))
    how = {"random_oversample": F.max("_n"), "random_undersample": F.min("_n"), "median_resample": F.floor(F.percentile("_n", F.lit(0.5)))}[strategy]
    target = sizes.agg(how.cast("bigint").alias("_t"))
    out = ranked.crossJoin(F.broadcast(target)).withColumn("copies", F.when(F.col("rank") < F.col("_t"), F.floor((F.col("_t") - F.col("rank") - 1) / F.col("n")) + 1).otherwise(0).cast("bigint"))
    return out.where("copies > 0").drop("rank", "n", "_t")
