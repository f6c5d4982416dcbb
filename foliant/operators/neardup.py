"""MinHash signatures and banded buckets over word shingles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions import text as T
from foliant.session import written

#: The permutations are x -> (a x + b) mod PRIME over 31-bit values of x.
PRIME = 2_147_483_647


def permutations(n: int) -> list[tuple[int, int]]:
    """Fixed pairs (a, b), 0 < a < PRIME, from a linear congruential sequence."""
    out, state = [], 20_240_229
    for _ in range(n):
        a = state = (1_103_515_245 * state + 12_345) % PRIME
        b = state = (1_103_515_245 * state + 12_345) % PRIME
        out.append((max(1, a), b))
    return out


def shingle_sets(texts: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, shingles)``: distinct pairs of successive words; texts of fewer than two words are left out."""
    sets = texts.select(F.col(id_col).alias("doc_id"), T.let(T.analyse(F.col(text_col)), lambda words: F.array_distinct(T.pairs(words))).alias("shingles"))
    return sets.where(F.size("shingles") > 0)


def shingle_value(shingle: Column) -> Column:
    """28 bits of the shingle's md5."""
    return F.conv(F.substring(F.md5(shingle), 1, 7), 16, 10).cast("bigint")


def signatures(sets: DataFrame, n: int = 100) -> DataFrame:
    """``(doc_id, signature ARRAY<BIGINT>)``, row by row without a shuffle."""
    values = sets.select("doc_id", F.transform("shingles", shingle_value).alias("x"))
    params = F.array(*(F.struct(F.lit(a).cast("bigint").alias("a"), F.lit(b).cast("bigint").alias("b")) for a, b in permutations(n)))
    # one pass over the shingles: a transform inside the permutations would hash each shingle anew for every one of them
    least = F.aggregate("x", F.array_repeat(F.lit(PRIME).cast("bigint"), n), lambda low, x: F.zip_with(low, params, lambda m, p: F.least(m, (p["a"] * x + p["b"]) % F.lit(PRIME))))
    return values.select("doc_id", least.alias("signature"))


def buckets(signatures: DataFrame, bands: int = 25, n: int = 100) -> DataFrame:
    """``(doc_id, band, bucket)``; the key is the band's part of the signature itself, so that nothing collides."""
    if n % bands:
        raise ValueError("the number of hashes must be a multiple of the number of bands")
    rows = n // bands
    parts = F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda i: F.struct(i.cast("bigint").alias("band"), F.array_join(F.slice("signature", i * rows + 1, rows).cast("array<string>"), "-").alias("bucket")))
    return signatures.select("doc_id", F.explode(parts).alias("p")).select("doc_id", "p.band", "p.bucket")


def bucket_pairs(buckets: DataFrame, most: int = 512) -> DataFrame:
    """``(doc_a, doc_b, shared)``: pairs that share buckets, and how many. Fold equal sets before, so that copies make no pairs.

    A bucket of over ``most`` rows is cut by a hash into parts of about that size, and
    each two parts meet under a key of their own, so that no task gets it whole.
    """
    sizes = buckets.groupBy("band", "bucket").agg(F.ceil(F.count("*") / most).alias("_n")).where("_n > 1")
    cut = buckets.join(sizes, ["band", "bucket"], "left").withColumn("_n", F.coalesce("_n", F.lit(1))).withColumn("own", F.pmod(F.xxhash64("doc_id"), "_n"))
    placed = cut.withColumn("_o", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_n") - 1))).select("doc_id", "band", "bucket", "own", F.least("own", "_o").alias("lo"), F.greatest("own", "_o").alias("hi"))
    x, y = placed.alias("x"), placed.alias("y")
    same = F.lit(True)
    for c in ("band", "bucket", "lo", "hi"):
        same &= F.col(f"x.{c}") == F.col(f"y.{c}")
    met = x.join(y, same & (F.col("x.doc_id") < F.col("y.doc_id")) & ((F.col("x.lo") == F.col("x.hi")) | (F.col("x.own") != F.col("y.own"))))
    return met.groupBy(F.col("x.doc_id").alias("doc_a"), F.col("y.doc_id").alias("doc_b")).agg(F.count("*").alias("shared"))


def fold_equal(sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sets with one row for each distinct set, and ``(doc_id, head)`` of all documents."""
    keyed = sets.withColumn("_k", F.md5(F.array_join(F.array_sort("shingles"), "\u0001")))
    heads = keyed.groupBy("_k").agg(F.min("doc_id").alias("head"), F.any_value("shingles").alias("shingles"))
    return heads.select(F.col("head").alias("doc_id"), "shingles"), keyed.select("doc_id", "_k").join(heads.select("_k", "head"), "_k").select("doc_id", "head")


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all values, 0 if both are empty."""
    shared = F.size(F.array_intersect(a, b))
    return F.coalesce(F.try_divide(shared, F.size(a) + F.size(b) - shared), F.lit(0.0))


def near_pairs(sets: DataFrame, n: int = 100, bands: int = 25) -> DataFrame:
    """``(doc_a, doc_b, shared, jaccard)`` of heads of equal sets that share buckets."""
    folded = written(fold_equal(sets)[0])
    met = bucket_pairs(written(buckets(signatures(folded, n), bands, n)))
    left = folded.select(F.col("doc_id").alias("doc_a"), F.col("shingles").alias("sa"))
    right = folded.select(F.col("doc_id").alias("doc_b"), F.col("shingles").alias("sb"))
    return met.join(left, "doc_a").join(right, "doc_b").select("doc_a", "doc_b", "shared", F.round(jaccard(F.col("sa"), F.col("sb")), 6).alias("jaccard"))


def quality(pairs: DataFrame, sets: DataFrame, others: int = 5) -> DataFrame:
    """``(n_pairs, n_good, share)``: pairs nearer than each of ``others`` documents drawn by a hash is to the first of the pair.

    The draw numbers all documents by a hash once and takes, for the document at place p, those at p + 1, p + 2, ... of its bucket.
    """
    ring = sets.select("doc_id", "shingles", F.md5(F.col("doc_id").cast("string")).alias("h"))
    part = F.substring("h", 1, 1)
    ring = ring.withColumn("part", part).withColumns({"p": F.row_number().over(Window.partitionBy("part").orderBy("h", "doc_id")), "n": F.count("*").over(Window.partitionBy("part"))})
    drawn = pairs.join(ring.select(F.col("doc_id").alias("doc_a"), "part", "p", "n", F.col("shingles").alias("sa")), "doc_a")
    drawn = drawn.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(others)))).withColumn("p", (F.col("p") + F.col("step") - 1) % F.col("n") + 1)
    met = drawn.join(ring.select("part", "p", F.col("doc_id").alias("other"), F.col("shingles").alias("so")), ["part", "p"])
    rival = F.when((F.col("other") == F.col("doc_a")) | (F.col("other") == F.col("doc_b")), F.lit(0.0)).otherwise(F.round(jaccard(F.col("sa"), F.col("so")), 6))
    judged = met.groupBy("doc_a", "doc_b").agg(F.max(rival).alias("rival"), F.any_value("jaccard").alias("j"))
    total = judged.agg(F.count("*").alias("n_pairs"), F.coalesce(F.sum((F.col("j") > F.col("rival")).cast("bigint")), F.lit(0)).alias("n_good"))
    return total.withColumn("share", F.round(F.coalesce(F.try_divide(F.col("n_good"), F.col("n_pairs")), F.lit(0.0)), 6))
