"""Most similar vectors for every vector by NN-descent.

Vectors get a code of random hyperplane signs, whose Hamming distance estimates the
angle. Neighbour lists start from windows over several sorted orders of sampled code
bits and are improved by joining neighbours of neighbours: every vector's list is a
group in which all pairs are compared by code, and each vector keeps the ``k_graph``
nearest that it has met. Finally the graph's pairs are compared exactly: labels
spread along the graph's edges put the vectors of a neighbourhood into one block, so
that each full vector is shipped about once. ``search`` answers queries by greedy
search over such a graph.

Equal vectors are folded into one; their books stand for each other at cosine 1.
Lists and blocks have bounded sizes whatever the data. Recall is measured against
brute force in the tests and the README.

Defined results: cells that are no JSON list of ``dimensions`` finite numbers, or all
zero, have no neighbours; repeated ids count once (the smallest content); null ids
are left out; ties go to the smaller id.
"""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliant.session import checkpoint, merging, parallelism

WORDS = 6  # of 64 bits
CODE = tuple(f"c{w}" for w in range(WORDS))
BITS = 64 * WORDS
_SCALES = ((1e4, np.int16), (1e6, np.int32), (1e8, np.int32))


def read_vector(cell: str | None, dimensions: int) -> np.ndarray | None:
    """The numbers of a cell, or None if it isn't usable."""
    if not cell:
        return None
    try:
        values = json.loads(cell)
    except (ValueError, RecursionError):
        return None
    if not isinstance(values, list) or len(values) != dimensions or not {*map(type, values)} <= {int, float}:
        return None
    try:
        out = np.array(values, np.float64)
    except (OverflowError, ValueError):
        return None
    return out if np.isfinite(out).all() and out.any() else None


def pack_vector(v: np.ndarray) -> bytes:
    """The vector without loss, decimals of few places as small integers."""
    for number, (scale, kind) in enumerate(_SCALES):
        whole = np.rint(v * scale)
        if np.abs(whole).max() <= np.iinfo(kind).max and np.array_equal(whole / scale, v):
            return bytes([number]) + whole.astype(kind).tobytes()
    return bytes([len(_SCALES)]) + v.tobytes()


def unpack_vector(data: bytes) -> np.ndarray:
    if data[0] == len(_SCALES):
        return np.frombuffer(data, np.float64, offset=1)
    scale, kind = _SCALES[data[0]]
    return np.frombuffer(data, kind, offset=1) / scale


@lru_cache(maxsize=2)
def _planes(dimensions: int) -> np.ndarray:
    return np.random.default_rng(20_240_229).standard_normal((dimensions, BITS)).astype(np.float32)


def codes_of(vectors: np.ndarray) -> np.ndarray:
    """Signs by random hyperplanes, packed."""
    return np.packbits(vectors.astype(np.float32) @ _planes(vectors.shape[1]) > 0, axis=1).view(np.uint64)


def angle_bits(cosine: float) -> int:
    """Expected differing bits of two vectors at ``cosine``."""
    return round(math.acos(cosine) / math.pi * BITS)


def usable_vectors(df: DataFrame, id_col: str, vector_col: str, dimensions: int) -> DataFrame:
    """``(id, digest, vector, c0..)`` of usable cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 512):
                batch = whole.slice(start, 512)
                parsed = [read_vector(cell, dimensions) for cell in batch.column(1).to_pylist()]
                keep = [i for i, v in enumerate(parsed) if v is not None]
                if not keep:
                    continue
                codes = codes_of(np.stack([parsed[i] / np.abs(parsed[i]).max() for i in keep])).view(np.int64)
                packed = [pack_vector(parsed[i]) for i in keep]
                digest = [hashlib.md5(p, usedforsecurity=False).hexdigest() for p in packed]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(keep, pa.int64())).cast(pa.string()), pa.array(digest), pa.array(packed, pa.binary()), *(pa.array(codes[:, w]) for w in range(WORDS))],
                    names=["id", "digest", "vector", *CODE],
                )

    kinds = ", ".join(f"{c} bigint" for c in CODE)
    return df.where(F.col(id_col).isNotNull()).select(id_col, vector_col).mapInArrow(run, f"id string, digest string, vector binary, {kinds}")


def _matrix(batch: pa.RecordBatch, first: int) -> np.ndarray:
    return np.stack([batch.column(first + w).to_numpy() for w in range(WORDS)], 1).view(np.uint64)


def _partitions(df: DataFrame, rows: int, rows_each: int = 200_000) -> int:
    return max(2 * parallelism(df.sparkSession), -(-rows // rows_each))


def first_pairs(codes: DataFrame, count: int, tables: int = 24, window: int = 3, far: int = BITS, bits: int | None = None) -> DataFrame:
    """``(u, v, h)``, u < v: rows near one another in orders sorted by sampled code bits.

    Each of ``tables`` orders groups rows by about log2(count) - 1 bits, sorts a group
    by 48 more bits, and pairs each row with the next ``window`` ones: a group of any
    size takes time in proportion to it.
    """
    bits = max(6, min(28, round(math.log2(max(2, count))) - 1)) if bits is None else bits
    rng = np.random.default_rng(7)
    picks = [rng.permutation(BITS)[: bits + 48] for _ in range(tables)]

    def spread_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = (np.uint64(1) << np.arange(62, -1, -1, dtype=np.uint64))
        for batch in batches:
            matrix = _matrix(batch, 1)
            flat = np.unpackbits(matrix.view(np.uint8).reshape(len(matrix), -1), axis=1)
            for t, pick in enumerate(picks):
                key = (flat[:, pick[:bits]] * weight[-bits:]).sum(1, dtype=np.uint64) * np.uint64(64) + np.uint64(t)
                tie = (flat[:, pick[bits:]] * weight[-48:]).sum(1, dtype=np.uint64)
                yield pa.RecordBatch.from_arrays([pa.array(key.astype(np.int64)), pa.array(tie.astype(np.int64)), *batch.columns], names=["key", "tie", "n", *CODE])

    def pair_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None
        for batch in batches:
            key, n, matrix = batch.column(0).to_numpy(), batch.column(2).to_numpy(), _matrix(batch, 3)
            old = 0
            if tail is not None:
                old = len(tail[0])
                key, n, matrix = np.concatenate([tail[0], key]), np.concatenate([tail[1], n]), np.concatenate([tail[2], matrix])
            out = []
            for w in range(1, window + 1):
                left = np.arange(max(0, old - w), len(key) - w)
                left = left[(key[left] == key[left + w]) & (n[left] != n[left + w])]
                h = np.bitwise_count(matrix[left] ^ matrix[left + w]).sum(1)
                left, h = left[h <= far], h[h <= far]
                out.append(np.stack([np.minimum(n[left], n[left + w]), np.maximum(n[left], n[left + w]), h.astype(np.int64)], 1))
            tail = key[-window:], n[-window:], matrix[-window:]
            yield _pair_batch(np.unique(np.concatenate(out), axis=0))

    kinds = ", ".join(f"{c} bigint" for c in CODE)
    rows = codes.select("n", *CODE).mapInArrow(spread_rows, f"key bigint, tie bigint, n bigint, {kinds}")
    ordered = rows.repartition(_partitions(codes, tables * count), "key").sortWithinPartitions("key", "tie", "n")
    return ordered.mapInArrow(pair_rows, PAIR)


PAIR = "u bigint, v bigint, h int"


def _pair_batch(rows: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(rows[:, 0]), pa.array(rows[:, 1]), pa.array(rows[:, 2].astype(np.int32))], names=["u", "v", "h"])


def nearest(pairs: DataFrame, k: int) -> DataFrame:
    """The ``k`` nearest that each vector has met, from pairs met any number of times."""
    both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"), "h"))
    met = both.repartition("u").dropDuplicates(["u", "v"])
    order = Window.partitionBy("u").orderBy("h", "v")
    return met.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k).drop("_r")


def join_neighbours(graph: DataFrame, codes: DataFrame, count: int, k: int, far: int) -> DataFrame:
    """Pairs of neighbours of each vector that are near enough to enter the list of one of them."""
    full = graph.groupBy("u").agg(F.count("*").alias("_c"), F.max("h").alias("_m")).select(F.col("u").alias("v"), F.when(F.col("_c") >= k, F.col("_m")).otherwise(far).cast("int").alias("worst"))
    known = merging(codes.withColumnRenamed("n", "v"), full, "v").select("v", "worst", *CODE)
    rows = merging(graph.select("u", "v"), known, "v").select("u", "v", "worst", *CODE)
    rows = rows.repartition(_partitions(graph, k * count), "u").sortWithinPartitions("u", "v")

    def compare(u: np.ndarray, v: np.ndarray, worst: np.ndarray, matrix: np.ndarray) -> np.ndarray:
        start = np.flatnonzero(np.r_[True, u[1:] != u[:-1]])
        size = np.diff(np.r_[start, len(u)])
        out = [np.zeros((0, 3), np.int64)]
        for width in np.unique(size[size > 1]):
            i, j = np.triu_indices(int(width), 1)
            every = start[size == width]
            step = max(1, 400_000 // len(i))
            for s in range(0, len(every), step):
                at = every[s : s + step, None]
                a, b = (at + i).ravel(), (at + j).ravel()
                h = np.bitwise_count(matrix[a] ^ matrix[b]).sum(1).astype(np.int64)
                keep = h <= np.minimum(far, np.maximum(worst[a], worst[b]))
                out.append(np.stack([v[a[keep]], v[b[keep]], h[keep]], 1))
        return np.unique(np.concatenate(out), axis=0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def flush(upto: int | None) -> pa.RecordBatch:
            nonlocal held, size
            parts = [np.concatenate(x) for x in zip(*held, strict=True)]
            cut = len(parts[0]) if upto is None else upto
            out = compare(*(p[:cut] for p in parts))
            held = [tuple(p[cut:] for p in parts)] if cut < len(parts[0]) else []
            size = len(parts[0]) - cut
            return _pair_batch(out)

        for batch in batches:
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_numpy(), _matrix(batch, 3)))
            size += batch.num_rows
            if size >= 100_000:
                u = np.concatenate([x[0] for x in held])
                last = np.flatnonzero(u != u[-1])
                upto = int(last[-1]) + 1 if len(last) else 0
                if upto:
                    yield flush(upto)
        if held:
            yield flush(None)

    return rows.mapInArrow(run, PAIR)


def build_graph(codes: DataFrame, count: int, k_graph: int = 20, rounds: int | None = None, far: int | None = None, tables: int = 16, window: int = 3, settled: float = 0.02) -> DataFrame:
    """``(u, v, h)``: the neighbour lists after joins of neighbours of neighbours, repeated until they hardly improve.

    What lists have come nearer than ``far``, summed over all, never falls; the joins
    end when a round adds less than the share ``settled`` to it, or after ``rounds``.
    """
    far = angle_bits(0.5) if far is None else far
    graph = checkpoint(nearest(first_pairs(codes, count, tables, window, far), k_graph))
    near, done = _nearness(graph, far), 0
    while done != rounds:
        met = join_neighbours(graph, codes, count, k_graph, far)
        graph = checkpoint(nearest(met.unionByName(graph.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), "h")), k_graph))
        before, near, done = near, _nearness(graph, far), done + 1
        if near <= before * (1 + settled):
            break
    return graph


def _nearness(graph: DataFrame, far: int) -> int:
    return graph.agg(F.coalesce(F.sum(far + 1 - F.col("h")), F.lit(0))).first()[0]


def _labels(pairs: DataFrame, rounds: int = 2) -> DataFrame:
    """``(n, label)``: the smallest vector within a few edges, where edges are short."""
    near = pairs.where(F.col("h") <= angle_bits(0.75)).select("u", "v")
    both = near.unionByName(near.select(F.col("v").alias("u"), F.col("u").alias("v")))
    label = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("n"), F.least("u", "m").alias("label"))
    for _ in range(rounds):
        heard = merging(both, label.withColumnRenamed("n", "v"), "v").groupBy("u").agg(F.min("label").alias("m"))
        label = checkpoint(merging(label, heard, label["n"] == heard["u"]).select("n", F.least("label", "m").alias("label")))
    return label


def exact_pairs(pairs: DataFrame, vectors: DataFrame, count: int, block: int = 2_048) -> DataFrame:
    """``(u, v, cosine)`` of ``(u, v, h)``, cosines rounded to 6 places.

    Each pair goes to the block of its first vector's label; blocks with more than
    ``block`` vectors are split by the first vector.
    """
    label = _labels(pairs)
    placed = merging(pairs, label.withColumnRenamed("n", "u"), "u", "left").withColumn("label", F.coalesce("label", "u"))
    crowd = placed.groupBy("label").agg(F.count("*").alias("_c")).select("label", F.greatest(F.lit(1), F.ceil(F.col("_c") / (4 * block))).alias("_s"))
    placed = checkpoint(merging(placed, crowd, "label").select(F.xxhash64("label", F.pmod(F.xxhash64("u"), F.col("_s"))).alias("block"), "u", "v"))
    needed = placed.select("block", F.col("u").alias("n")).unionByName(placed.select("block", F.col("v").alias("n"))).distinct()
    shipped = merging(needed, vectors, "n").select("block", F.lit(0).alias("kind"), F.col("n").alias("u"), F.lit(0).cast("bigint").alias("v"), "vector")
    asked = placed.select("block", F.lit(1).alias("kind"), "u", "v", F.lit(None).cast("binary").alias("vector"))
    rows = shipped.unionByName(asked).repartition(_partitions(pairs, 16 * count), "block").sortWithinPartitions("block", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: dict[tuple[int, int], int] = {}
        last, kept = None, np.zeros((0, 0))
        for whole in batches:
            for begin in range(0, whole.num_rows, 2_000):
                batch = whole.slice(begin, 2_000)
                block_of, kind = batch.column(0).to_numpy(), batch.column(1).to_numpy()
                u, v = batch.column(2).to_numpy(), batch.column(3).to_numpy()
                new = np.flatnonzero(kind == 0)
                # vectors of the block that goes on from the last batch stay
                carry = [(key, row) for key, row in at.items() if key[0] == block_of[0]] if last == block_of[0] else []
                base = kept[[row for _, row in carry]] if carry else np.zeros((0, kept.shape[1]))
                at = {key: i for i, (key, _) in enumerate(carry)}
                if len(new):
                    fresh = np.stack([unpack_vector(x) for x in batch.column(4).take(pa.array(new)).to_pylist()]).astype(np.float64)
                    fresh /= np.linalg.norm(fresh, axis=1)[:, None]
                    for i, r in enumerate(new):
                        at[(int(block_of[r]), int(u[r]))] = len(carry) + i
                    base = np.concatenate([base, fresh]) if len(carry) else fresh
                kept, last = base, block_of[-1]
                ask = np.flatnonzero(kind == 1)
                if len(ask):
                    a = np.array([at[(int(block_of[r]), int(u[r]))] for r in ask])
                    b = np.array([at[(int(block_of[r]), int(v[r]))] for r in ask])
                    cosine = np.concatenate([np.einsum("ij,ij->i", kept[a[s : s + 500]], kept[b[s : s + 500]]) for s in range(0, len(a), 500)])
                    yield pa.RecordBatch.from_arrays([pa.array(u[ask]), pa.array(v[ask]), pa.array(np.round(cosine, 6))], names=["u", "v", "cosine"])

    return rows.mapInArrow(run, "u bigint, v bigint, cosine double")


class Collection:
    """Vectors of a table, numbered and written once; equal vectors share a number."""

    def __init__(self, df: DataFrame, id_col: str = "bookid", vector_col: str = "description_emb", dimensions: int = 1_024):
        heavy = usable_vectors(df, id_col, vector_col, dimensions).withColumn("row", F.monotonically_increasing_id())
        heavy = checkpoint(heavy)
        light = heavy.select("id", "digest", "row")
        once = light.groupBy("id").agg(F.min_by("row", F.struct("digest", "row")).alias("row"), F.min("digest").alias("digest"))
        first = once.groupBy("digest").agg(F.min("row").alias("n"))
        self.members = checkpoint(merging(once, first, "digest").select("id", "n"))
        numbers = self.members.select("n").distinct()
        self.codes = checkpoint(merging(heavy.select(F.col("row").alias("n"), *CODE), numbers, "n", "left_semi").repartition(2 * parallelism(df.sparkSession)))
        self.vectors = heavy.select(F.col("row").alias("n"), "vector")
        self.count = self.codes.count()


def nearest_ids(collection: Collection, exact: DataFrame, k: int, least: float) -> DataFrame:
    """``(id, neighbour, cosine)``: up to ``k`` ids for each, by cosine and then by id."""
    few = Window.partitionBy("n").orderBy("id")
    # of a class of equal vectors, k + 1 ids are enough for anyone's list
    heads = collection.members.withColumn("_r", F.row_number().over(few)).where(F.col("_r") <= k + 1).select("n", "id")
    close = exact.where(F.col("cosine") >= least)
    edges = close.select(F.col("u").alias("a"), F.col("v").alias("n"), "cosine").unionByName(close.select(F.col("v").alias("a"), F.col("u").alias("n"), "cosine"))
    own = heads.select(F.col("n").alias("a"), F.col("id").alias("neighbour"), F.lit(1.0).alias("cosine"))
    others = merging(edges.distinct(), heads.withColumnRenamed("id", "neighbour"), "n").select("a", "neighbour", "cosine")
    best = Window.partitionBy("a").orderBy(F.desc("cosine"), "neighbour")
    lists = own.unionByName(others).withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= k + 1)
    mine = merging(collection.members.select("id", F.col("n").alias("a")), lists, "a").where("id <> neighbour")
    rank = Window.partitionBy("id").orderBy("_r")
    return mine.withColumn("_k", F.row_number().over(rank)).where(F.col("_k") <= k).select("id", "neighbour", "cosine")


def neighbours(df: DataFrame, id_col: str = "bookid", vector_col: str = "description_emb", dimensions: int = 1_024, k: int = 5, least: float = 0.6, **graph: int) -> DataFrame:
    """``(id, neighbour, cosine)`` for every usable vector of ``df``."""
    collection = Collection(df, id_col, vector_col, dimensions)
    lists = build_graph(collection.codes, collection.count, **graph)
    # an estimate may fall short of the cosine by some deviations of the code
    slack = round(3 * math.sqrt(BITS * 0.25))
    pairs = lists.where(F.col("h") <= angle_bits(least) + slack).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), "h").distinct()
    return nearest_ids(collection, exact_pairs(pairs, collection.vectors, collection.count), k, least)


def search(graph: DataFrame, codes: DataFrame, queries: DataFrame, count: int, beam: int = 24, rounds: int = 8, far: int | None = None) -> DataFrame:
    """``(q, v, h)``: up to ``beam`` near vectors for each query ``(q, c0..)``, q < 0, by greedy search over the graph.

    A query enters the graph at rows near it in the sorted orders of code bits. Each
    round opens the nearest vectors of every beam that are not yet opened and compares
    their neighbours; a query is done when its beam holds opened ones only.
    """
    far = angle_bits(0.3) if far is None else far
    both = codes.select("n", *CODE).unionByName(queries.select(F.col("q").alias("n"), *CODE))
    met = first_pairs(both, count, far=far).where("u < 0 and v >= 0").select(F.col("u").alias("q"), "v", "h").distinct()
    order = Window.partitionBy("q").orderBy("h", "v")
    keep = lambda df: df.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= beam).drop("_r")
    asked = queries.select("q", *(F.col(c).alias(f"q{c}") for c in CODE))
    best = checkpoint(keep(met.withColumn("opened", F.lit(False))))
    for _ in range(rounds):
        fresh = best.where("not opened").select("q", F.col("v").alias("u"))
        reached = merging(merging(fresh, graph.select("u", "v"), "u").select("q", "v").distinct(), best.select("q", "v"), ["q", "v"], "left_anti")
        with_codes = merging(merging(reached, codes.withColumnRenamed("n", "v").select("v", *CODE), "v"), asked, "q")
        h = sum((F.bit_count(F.col(c).bitwiseXOR(F.col(f"q{c}"))) for c in CODE), F.lit(0))
        compared = with_codes.select("q", "v", h.cast("int").alias("h"), F.lit(False).alias("opened")).where(F.col("h") <= far)
        best = checkpoint(keep(best.withColumn("opened", F.lit(True)).unionByName(compared)))
        if best.where("not opened").isEmpty():
            break
    return best.select("q", "v", "h")


def search_ids(df: DataFrame, is_query: str, id_col: str = "bookid", vector_col: str = "description_emb", dimensions: int = 1_024, k: int = 5, least: float = 0.6, **graph: int) -> DataFrame:
    """``(id, neighbour, cosine)`` for the rows that the condition ``is_query`` (over ``id``) picks, against all rows, by graph search."""
    collection = Collection(df, id_col, vector_col, dimensions)
    lists = build_graph(collection.codes, collection.count, **graph)
    numbers = collection.members.where(is_query).select("n").distinct()
    queries = merging(collection.codes, numbers, "n", "left_semi").select((-F.col("n") - 1).alias("q"), *CODE)
    found = search(lists, collection.codes, queries, collection.count)
    own = (-F.col("q") - 1).alias("n")
    slack = round(3 * math.sqrt(BITS * 0.25))
    near = found.where(F.col("h") <= angle_bits(least) + slack).select(own, "v", "h").where("n <> v")
    pairs = near.select(F.least("n", "v").alias("u"), F.greatest("n", "v").alias("v"), F.col("h")).distinct()
    exact = exact_pairs(pairs, collection.vectors, collection.count)
    return nearest_ids(collection, exact, k, least).where(is_query)


def neighbour_pairs(found: DataFrame) -> DataFrame:
    return found.select(F.least("id", "neighbour").alias("bookid_a"), F.greatest("id", "neighbour").alias("bookid_b")).distinct()
