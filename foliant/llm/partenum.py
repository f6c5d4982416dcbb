"""Near-duplicate texts by PartEnum signatures over sets of word pairs.

Two sets of sizes a <= b with a Jaccard similarity of at least t share at least
t / (1 + t) * (a + b) features; so the smaller has at most d of its own, and the
larger at most e. Sets are put into narrow bands of size, and for each band a hash
partitions the domain of features into groups. Of the groups, at most d hold a
feature of the smaller set only and at most e // 2 two or more of the larger only.
Among any d + e // 2 + 1 groups there is one in which the larger set has all
features of the smaller and at most one more.

So a set is indexed in its own band under every group: under the subset of all its
features there, and under each subset that leaves out one. It probes, in its own
and the larger bands, under the subset of all its features, and only in as many
groups as the bound asks for, those with the rarest features (any choice will do;
there are ``EXTRA`` groups to choose from). Feature counts come from a sketch of
fixed size that never counts too low; features of which it is sure that one record
has them leave the domain and shorten the bound. Matches are first held against a
parity bitmap (its Hamming distance is never more than the sets'), then compared
exactly. All joins are sort-merge joins: sizes of signature tables are guessed far
too low by the planner, and they must never be broadcast.

Defined results: null titles and descriptions are empty, null elements count for
nothing; sets below ``least`` have no pairs; repeated ids count once; an empty
table gives no rows. The result is exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.llm.classes import fold, spread
from foliant.session import checkpoint, merging

EXTRA = 10
SKETCH_BITS = 20
_GOLD, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def shingles(text: Column, words: int = 2) -> Column:
    """Distinct hashes of runs of ``words`` successive words (longest runs of letters and digits, lower case)."""
    tokens = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    runs = F.transform(tokens, lambda w: F.xxhash64(w))
    for k in range(1, words):  # zipped, not indexed: an index would find the tokens anew for each element
        later = F.slice(tokens, k + 1, 1_000_000_000)
        runs = F.zip_with(runs, later, lambda h, w: F.when(h.isNotNull() & w.isNotNull(), F.xxhash64(h, w)))
    return F.sort_array(F.array_distinct(F.filter(runs, lambda h: h.isNotNull())))


def record_text(title: str = "title", descriptions: str = "descriptions") -> Column:
    """The title, a blank, and the elements of the descriptions joined by a blank."""
    return F.concat(F.coalesce(F.col(title), F.lit("")), F.lit(" "), F.coalesce(F.array_join(descriptions, " "), F.lit("")))


def _mixed(x: np.ndarray, salt: int) -> np.ndarray:
    x = (x.astype(np.uint64) + np.uint64(salt)) * _GOLD
    x ^= x >> np.uint64(29)
    x *= _MIX
    return x ^ (x >> np.uint64(32))


def bands(least: int, ratio: float, most: int) -> list[tuple[int, int]]:
    """Closed ranges of sizes from ``least`` to beyond ``most``."""
    out, low = [], max(1, least)
    while not out or out[-1][1] < most:
        high = max(low, int(low * ratio))
        out.append((low, high))
        low = high + 1
    return out


def difference_bound(a: np.ndarray | int, b: np.ndarray | int, threshold: float) -> np.ndarray:
    return np.floor((1 - threshold) / (1 + threshold) * (np.asarray(a) + b) + 1e-9).astype(np.int64)


class Signer:
    """Signatures of sets under the scheme of a band."""

    def __init__(self, threshold: float, counts: np.ndarray | None, records: int, ratio: float = 1.35):
        self.threshold, self.counts, self.records, self.ratio = threshold, counts, max(1, records), ratio

    def need(self, own: np.ndarray, low: int, high: int, dropped: np.ndarray | int = 0) -> np.ndarray:
        """Groups that sets of sizes ``own`` must probe to meet all similar ones that are as large or larger and in the band; 0 where there can be none."""
        share = self.threshold / (1 + self.threshold)
        own = np.asarray(own, float)
        first, last = np.maximum(low, own), np.minimum(high, np.floor(own / self.threshold + 1e-9))

        def bad(b: np.ndarray) -> np.ndarray:
            return own - share * (own + b) - dropped + (b - share * (own + b)) / 2

        possible = (last >= first) & (own - share * (own + first) - dropped >= -1e-9)
        # linear in the partner's size: greatest at an end
        return np.where(possible, np.floor(np.maximum(0, np.maximum(bad(first), bad(last))) + 1e-9) + 1, 0).astype(np.int64)

    def groups(self, high: int) -> int:
        return int(self.need(np.array([high]), high, high)[0]) + EXTRA

    def sign(self, sets: list[np.ndarray], low: int, high: int, number: int, probe: bool) -> tuple[np.ndarray, np.ndarray]:
        """Signatures of the sets and the set that each belongs to."""
        sizes = np.array([len(s) for s in sets], np.int64)
        owner = np.repeat(np.arange(len(sets)), sizes)
        flat = np.concatenate(sets) if sets else np.zeros(0, np.int64)
        count = self.counts[flat & ((1 << SKETCH_BITS) - 1)] if self.counts is not None else np.full(len(flat), 2)
        alone = count <= 1
        dropped = np.bincount(owner[alone], minlength=len(sets))
        owner, flat, count = owner[~alone], flat[~alone], count[~alone]
        n, g = len(sets), self.groups(high)
        cell = owner * g + (_mixed(flat, number * 7919 + 13) % np.uint64(g)).astype(np.int64)
        order = np.argsort(cell, kind="stable")
        cell, count, weight = cell[order], count[order], _mixed(flat[order], 1)
        start = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]]) if len(cell) else np.zeros(0, np.int64)
        total = np.zeros(n * g, np.uint64)
        place = np.tile(_mixed(np.arange(g), number + 1), n)
        if len(start):
            total[cell[start]] = np.add.reduceat(weight, start)
        whole = total + place
        if not probe:
            lacking = whole[cell] - weight
            return np.concatenate([_mixed(whole, 5), _mixed(lacking, 9)]), np.concatenate([np.repeat(np.arange(n), g), cell // g])
        cost = np.full(n * g, 2 * self.records, np.int64)
        if len(start):
            cost[cell[start]] = np.minimum.reduceat(count, start)
        need = self.need(sizes, low, high, dropped)
        rank = np.argsort(cost.reshape(n, g), axis=1, kind="stable")
        row, at = np.nonzero(np.arange(g)[None, :] < need[:, None])
        taken = whole.reshape(n, g)[row, rank[row, at]]
        return np.concatenate([_mixed(taken, 5), _mixed(taken, 9)]), np.concatenate([row, row])


def parity(sets: list[np.ndarray]) -> np.ndarray:
    """256 bits of each set, as four numbers: bit i is the parity of the features hashed to i."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    flat = np.concatenate(sets) if sets else np.zeros(0, np.int64)
    bit = (_mixed(flat, 77) >> np.uint64(56)).astype(np.int64)
    odd = (np.bincount(owner * 256 + bit, minlength=len(sets) * 256) & 1).astype(np.uint8)
    return np.packbits(odd.reshape(-1, 256), axis=1).view(">i8").astype(np.int64).reshape(-1, 4)


WORDS = ("p0", "p1", "p2", "p3")
SIGNED = "key bigint, n bigint, size int, p0 bigint, p1 bigint, p2 bigint, p3 bigint"


def _rows(keys: list[np.ndarray], at: list[np.ndarray], names: pa.Array, sizes: np.ndarray, words: np.ndarray) -> pa.RecordBatch:
    key = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
    i = np.concatenate(at) if at else np.zeros(0, np.int64)
    order = np.argsort(i, kind="stable")  # rows of one set stand together, so that what they share compresses
    key, i = key[order], i[order]
    return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), names.take(pa.array(i)), pa.array(sizes[i].astype(np.int32)), *(pa.array(words[i, w]) for w in range(4))], names=["key", "n", "size", *WORDS])


def _signed(sets: DataFrame, signer: Signer, least: int, probe: bool, chunk: int = 1_000) -> DataFrame:
    t = signer.threshold

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, chunk):
                batch = whole.slice(start, chunk)
                names = batch.column(0)
                lists = batch.column(1)
                flat, ends = lists.flatten().to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
                ends = ends - ends[0]
                every = [flat[ends[i] : ends[i + 1]] for i in range(batch.num_rows)]
                size = np.diff(ends).astype(np.int64)
                if not len(size):
                    continue
                words = parity(every)
                keys, at = [], []
                for number, (low, high) in enumerate(bands(least, signer.ratio, int(size.max() / t) + 1 if probe else int(size.max()))):
                    band = np.flatnonzero((size <= high) & (size >= np.ceil(t * low - 1e-9))) if probe else np.flatnonzero((size >= low) & (size <= high))
                    step = max(1, 400_000 // signer.groups(high))  # sets of thousands of features go a few at a time
                    for here in (band[s : s + step] for s in range(0, len(band), step)):
                        if sum(map(len, keys)) > 1_000_000:
                            yield _rows(keys, at, names, size, words)
                            keys, at = [], []
                        key, of = signer.sign([every[i] for i in here], low, high, number, probe)
                        keys.append(key)
                        at.append(here[of])
                yield _rows(keys, at, names, size, words)

    return sets.mapInArrow(run, SIGNED)


def feature_counts(sets: DataFrame) -> np.ndarray:
    """A sketch of how many sets hold each feature: 2^20 counters, whatever the data."""
    bucket = F.col("f").bitwiseAND(F.lit((1 << SKETCH_BITS) - 1))
    rows = sets.select(F.explode("features").alias("f")).groupBy(bucket.alias("b")).agg(F.count("*").alias("n")).select(F.col("b").cast("int"), "n").toPandas()
    out = np.zeros(1 << SKETCH_BITS, np.int64)
    out[rows["b"].to_numpy().astype(np.int64)] = rows["n"].to_numpy().astype(np.int64)
    return np.minimum(out, 2**31 - 1).astype(np.int32)


def similar_sets(classes: DataFrame, threshold: float, least: int) -> DataFrame:
    """``(a, b, similarity)`` of classes ``(class, features)`` with a Jaccard similarity of at least ``threshold``, each pair once, a < b."""
    sets = checkpoint(classes.where(F.size("features") >= least).select(F.monotonically_increasing_id().alias("n"), "class", "features"))
    signer = Signer(threshold, feature_counts(sets), sets.count())
    numbered = sets.select("n", "features")
    x, y = _signed(numbered, signer, least, probe=True).alias("x"), _signed(numbered, signer, least, probe=False).alias("y")
    bits = sum((F.bit_count(F.col(f"x.{w}").bitwiseXOR(F.col(f"y.{w}"))) for w in WORDS), F.lit(0))
    apart = F.floor((F.col("x.size") + F.col("y.size")) * F.lit((1 - threshold) / (1 + threshold)) + 1e-9)
    ordered = (F.col("x.size") < F.col("y.size")) | ((F.col("x.size") == F.col("y.size")) & (F.col("x.n") < F.col("y.n")))
    met = merging(x, y, (F.col("x.key") == F.col("y.key")) & ordered & (F.col("x.size") >= F.col("y.size") * F.lit(threshold) - 1e-9) & (bits <= apart))
    met = met.select(F.col("x.n").alias("i"), F.col("y.n").alias("j")).distinct()
    left = sets.select(F.col("n").alias("i"), F.col("class").alias("ca"), F.col("features").alias("fa"))
    right = sets.select(F.col("n").alias("j"), F.col("class").alias("cb"), F.col("features").alias("fb"))
    both = merging(merging(met, left, "i"), right, "j").withColumn("_s", F.size(F.array_intersect("fa", "fb")))
    similarity = F.col("_s") / (F.size("fa") + F.size("fb") - F.col("_s"))
    return both.select(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b"), similarity.alias("similarity")).where(F.col("similarity") >= threshold - 1e-9)


def near_duplicates(df: DataFrame, id_col: str = "id", title: str = "title", descriptions: str = "descriptions", threshold: float = 0.6, least: int = 20, words: int = 2) -> tuple[DataFrame, DataFrame]:
    """Members ``(id, class)`` of classes of equal sets, and links ``(a, b, similarity)`` between classes."""
    sets = df.select(F.col(id_col).alias("id"), shingles(record_text(title, descriptions), words).alias("features"))
    members, classes = fold(sets.where(F.size("features") >= least), ["features"])
    members, classes = checkpoint(members), spread(classes)
    return members, similar_sets(classes, threshold, least)
