"""All pairs of records with similar sets of values, by the size-aware overlap join.

Two sets of sizes s and r with a Jaccard similarity of at least t share at least
o = ceil(t / (1 + t) * (s + r)) values. Sets of up to ``SMALL`` values enumerate,
for each size that a partner may have, their subsets of o values: two small sets
are similar exactly if they share a subset under the key of their two sizes. Pairs
with a larger set meet in inverted lists, of which each set is in those of its
rarest values only: as many as it may lack of a partner's, and one more.

A record must be similar in two sets. Keys are made of the first; a key that more
than ``HOT`` records share is split by the keys of the second set, so that no list
of records with one popular value is joined with itself. All pairs that meet are
compared exactly.

Defined results: values are normal forms; null and blank elements and repetitions
count for nothing; a record with an empty set in either column has no pairs;
repeated ids count once; an empty table gives no rows. The result is exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import ceil, floor

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.llm.classes import fold, spread, value_set
from foliant.llm.partenum import SKETCH_BITS, feature_counts
from foliant.session import checkpoint, merging

SMALL = 8
HOT = 256
_MASK = (1 << 64) - 1


def overlap(s: int, r: int, t: float) -> int:
    """Values that sets of sizes ``s`` and ``r`` must share."""
    return max(1, ceil(t / (1 + t) * (s + r) - 1e-9))


def _mix(h: int, x: int) -> int:
    h = ((h ^ (x & _MASK)) * 0x9E3779B97F4A7C15) & _MASK
    return h ^ h >> 31


def set_keys(values: list[int], counts: np.ndarray | None, t: float, small: int = SMALL) -> tuple[list[int], list[int]]:
    """Subset keys and list keys of a set; list keys count only where one of the two sets is larger than ``small``."""
    s = len(values)
    subsets: list[int] = []
    if s <= small:
        ordered = sorted(values)
        for r in range(ceil(t * s - 1e-9), min(small, floor(s / t + 1e-9)) + 1):
            base = _mix(_mix(17, min(s, r)), max(s, r))
            for subset in combinations(ordered, overlap(s, r, t)):
                h = base
                for x in subset:
                    h = _mix(h, x)
                subsets.append(h)
    lists: list[int] = []
    if floor(s / t + 1e-9) > small:
        mask = (1 << SKETCH_BITS) - 1
        ordered = sorted(values, key=lambda x: (int(counts[x & mask]) if counts is not None else 0, x))
        lists = [_mix(23, x) for x in ordered[: s - ceil(t * s - 1e-9) + 1]]
    return subsets, lists


def _signed(values: list[int]) -> pa.Array:
    return pa.array(np.array(values, np.uint64).view(np.int64))


def _keys(classes: DataFrame, column: str, counts: np.ndarray, t: float, refine: bool) -> DataFrame:
    """A row for each key; ``refine`` mixes it with the key that the row has already."""
    head = ["key", "class", "na", "nb", "list"] if refine else ["class", "na", "nb"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 2_000):
                batch = whole.slice(start, 2_000)
                at, keys, lists = [], [], []
                before = batch.column(0).to_pylist() if refine else None
                for i, values in enumerate(batch.column(len(head)).to_pylist()):
                    a, b = set_keys(values, counts, t)
                    if refine:
                        a, b = [_mix(before[i], k) for k in a], [_mix(before[i] + 1, k) for k in b]
                    keys += a
                    keys += b
                    at += [i] * (len(a) + len(b))
                    lists += [False] * len(a)
                    lists += [True] * len(b)
                index = pa.array(at, pa.int64())
                take = lambda c: batch.column(head.index(c)).take(index)
                flags = pa.array(lists, pa.bool_())
                first = take("list") if refine else flags
                second = flags if refine else pa.array([False] * len(at), pa.bool_())
                yield pa.RecordBatch.from_arrays([_signed(keys), take("class"), take("na"), take("nb"), first, second], names=["key", "class", "na", "nb", "list", "list_b"])

    return classes.select(*head, column).mapInArrow(run, "key bigint, class string, na int, nb int, list boolean, list_b boolean")


def _jaccard(x: Column, y: Column, shared: Column) -> Column:
    return shared / (F.size(x) + F.size(y) - shared)


def similar_records(classes: DataFrame, t_a: float, t_b: float, hot: int = HOT) -> DataFrame:
    """``(a, b, similarity_a, similarity_b)`` of classes ``(class, set_a, set_b)`` (arrays of hashes), each pair once, a < b."""
    sets = classes.where("size(set_a) > 0 and size(set_b) > 0").select("class", F.size("set_a").alias("na"), F.size("set_b").alias("nb"), "set_a", "set_b")
    counts_a = feature_counts(sets.select(F.col("set_a").alias("features")))
    counts_b = feature_counts(sets.select(F.col("set_b").alias("features")))
    first = checkpoint(_keys(sets, "set_a", counts_a, t_a, refine=False))
    crowded = first.groupBy("key").agg(F.count("*").alias("_n")).where(F.col("_n") > hot).select("key")
    cold = merging(first, crowded, "key", "left_anti")
    busy = merging(merging(first, crowded, "key", "left_semi"), sets.select("class", "set_b"), "class")
    keys = cold.unionByName(_keys(busy, "set_b", counts_b, t_b, refine=True))

    def near(x: str, y: str, t: float) -> Column:
        return F.least(x, y) >= F.greatest(x, y) * F.lit(t) - 1e-9

    def large_enough(flag: str, size: str) -> Column:
        return ~F.col(f"x.{flag}") | (F.greatest(f"x.{size}", f"y.{size}") > SMALL)

    met = merging(
        keys.alias("x"), keys.alias("y"),
        (F.col("x.key") == F.col("y.key")) & (F.col("x.class") < F.col("y.class")) & (F.col("x.list") == F.col("y.list")) & (F.col("x.list_b") == F.col("y.list_b"))
        & near("x.na", "y.na", t_a) & near("x.nb", "y.nb", t_b) & large_enough("list", "na") & large_enough("list_b", "nb"),
    ).select(F.col("x.class").alias("a"), F.col("y.class").alias("b")).distinct()
    left = sets.select(F.col("class").alias("a"), F.col("set_a").alias("xa"), F.col("set_b").alias("xb"))
    right = sets.select(F.col("class").alias("b"), F.col("set_a").alias("ya"), F.col("set_b").alias("yb"))
    both = merging(merging(met, left, "a"), right, "b")
    ja = _jaccard(F.col("xa"), F.col("ya"), F.size(F.array_intersect("xa", "ya")))
    jb = _jaccard(F.col("xb"), F.col("yb"), F.size(F.array_intersect("xb", "yb")))
    return both.select("a", "b", ja.alias("similarity_a"), jb.alias("similarity_b")).where((F.col("similarity_a") >= t_a - 1e-9) & (F.col("similarity_b") >= t_b - 1e-9))


def hashed_set(values: str) -> Column:
    return F.array_sort(F.array_distinct(F.transform(value_set(F.col(values)), lambda x: F.xxhash64(x))))


def similar_value_sets(df: DataFrame, id_col: str = "id", set_a: str = "characters", set_b: str = "genres", t_a: float = 0.6, t_b: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """Members ``(id, class)`` of classes of equal sets, and links between classes."""
    sets = df.select(F.col(id_col).alias("id"), hashed_set(set_a).alias("set_a"), hashed_set(set_b).alias("set_b"))
    members, classes = fold(sets, ["set_a", "set_b"])
    classes = spread(classes.where("size(set_a) > 0 and size(set_b) > 0"))
    members = checkpoint(merging(members, classes.select("class"), "class", "left_semi").select("id", "class"))
    return members, similar_records(classes, t_a, t_b)
