"""Classes of equal records, and pairs of ids from links between classes.

A join first folds records with equal content into a class named by its smallest
id, so that copies cost one row each; links are found between classes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.session import checkpoint, merging, parallelism

#: Fixed value: white space of any script, as Python's str.split has it.
WHITE = r"[\s\x1c-\x1f\x85\xa0  -     　]+"


def normal_form(value: Column) -> Column:
    """Lower case, no white space at the ends, inner runs of it as one blank."""
    return F.trim(F.regexp_replace(F.lower(value), WHITE, " "))


def value_set(values: Column) -> Column:
    """Sorted distinct normal forms of an array without null and blank elements; an empty array for null."""
    clean = F.filter(F.transform(values, normal_form), lambda x: x.isNotNull() & (x != ""))
    return F.coalesce(F.array_sort(F.array_distinct(clean)), F.array().cast("array<string>"))


def content_key(*columns: str) -> Column:
    """128 bits that stand for the content of columns of arrays."""
    return F.md5(F.to_json(F.struct(*columns)))


def set_key(*columns: str) -> Column:
    """128 bits that stand for the content of columns of arrays without null elements."""
    sized = [x for c in columns for x in (F.size(c), F.col(c))]
    return F.struct(F.xxhash64(F.lit(1), *sized).alias("h"), F.xxhash64(F.lit(2), *sized).alias("l"))


def fold(df: DataFrame, content: list[str]) -> tuple[DataFrame, DataFrame]:
    """``df`` has ``id`` and columns of arrays without null elements; gives members ``(id, class)`` and classes ``(class, *content, n)``.

    Repeated ids count once: the row with the smallest content key stands. Class
    names reach the members by a join on the content key that ships only keys.
    """
    keyed = df.where("id is not null").withColumn("_key", set_key(*content))
    once = checkpoint(keyed.groupBy("id").agg(F.min_by(F.struct("_key", *content), "_key").alias("r")).select("id", "r.*"))
    named = once.groupBy("_key").agg(F.min("id").alias("class"), F.count("*").alias("n"), *(F.any_value(c).alias(c) for c in content))
    members = merging(once.select("id", "_key"), named.select("_key", "class"), "_key").select("id", "class")
    return members, named.select("class", *content, "n")


def expand(members: DataFrame, links: DataFrame) -> DataFrame:
    """``(id_a, id_b)``, the smaller first, of all members of linked classes ``(a, b)`` and of one class."""
    a = members.select(F.col("id").alias("x"), F.col("class").alias("a"))
    b = members.select(F.col("id").alias("y"), F.col("class").alias("b"))
    across = merging(merging(links.select("a", "b"), a, "a"), b, "b").select("x", "y")
    within = merging(a, b, (F.col("a") == F.col("b")) & (F.col("x") < F.col("y"))).select("x", "y")
    return across.unionByName(within).select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))


def link_counts(members: DataFrame, links: DataFrame) -> DataFrame:
    """``(id, class, n_copies, n_links)``: members of the class besides the record, and linked records of other classes."""
    size = members.groupBy("class").agg(F.count("*").alias("n"))
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    linked = merging(both, size.withColumnRenamed("class", "b"), "b").groupBy("a").agg(F.sum("n").alias("n_links"))
    per_class = merging(size, linked, size["class"] == linked["a"], "left").select("class", (F.col("n") - 1).alias("n_copies"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    return merging(members, per_class, "class").select("id", "class", "n_copies", "n_links")


def spread(df: DataFrame, rows_each: int = 20_000) -> DataFrame:
    """``df`` written to the checkpoint folder in enough parts for CPU-bound work over it, each of a bounded number of rows."""
    saved = checkpoint(df)
    return checkpoint(saved.repartition(max(2 * parallelism(df.sparkSession), -(-saved.count() // rows_each))))
