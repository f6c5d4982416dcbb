"""Arithmetic on vectors in arrays, nearest neighbours of a query set in blocks, and joins within an angle."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.session import checkpoint


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def unit(v: Column) -> Column:
    """The vector at length 1; one of next to no length stays."""
    n = norm(v)
    return F.transform(v, lambda x: x / F.when(n < 1e-12, F.lit(1.0)).otherwise(n))


def cosine(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(dot(a, b), norm(a) * norm(b)), F.lit(0.0))


def softmax(v: Column) -> Column:
    """Exponentials over their sum, shifted by the largest value."""
    e = F.transform(v, lambda x: F.exp(x - F.array_max(v)))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda s, y: s + y))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def one_hot(place: Column, size: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.when(i == place, 1.0).otherwise(0.0))


def _rows(values: pd.Series) -> np.ndarray:
    m = np.stack(values.to_numpy()).astype(np.float64)
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(n < 1e-12, 1.0, n)


def nearest(queries: DataFrame, data: DataFrame, k: int = 5, id_col: str = "vec_id", vector: str = "embedding", block: int = 4_096, itself: bool = False) -> DataFrame:
    """``(query, neighbour, similarity, rank)``: the ``k`` rows of ``data`` with the highest cosine to each row of a stated query set.

    Both sides are cut into blocks of a bounded number of rows; each pair of blocks is
    one matrix product that keeps ``k`` rows for a query, and the best of those are taken.
    """
    nq, nd = max(1, -(-queries.count() // block)), max(1, -(-data.count() // block))
    kind = dict(data.dtypes)[id_col]
    q = queries.select(F.col(id_col).alias("id"), F.col(vector).alias("v"), F.pmod(F.xxhash64(id_col), F.lit(nq)).alias("qb")).withColumn("db", F.explode(F.sequence(F.lit(0), F.lit(nd - 1)).cast("array<bigint>")))
    d = data.select(F.col(id_col).alias("id"), F.col(vector).alias("v"), F.pmod(F.xxhash64(id_col, F.lit(1)), F.lit(nd)).alias("db")).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(nq - 1)).cast("array<bigint>")))

    def best(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"query": pd.Series(dtype=left["id"].dtype), "neighbour": pd.Series(dtype=left["id"].dtype), "similarity": pd.Series(dtype=float)})
        if left.empty or right.empty:
            return empty
        s = np.round(np.clip(_rows(left["v"]) @ _rows(right["v"]).T, -1, 1), 6) + 0.0
        ids = right["id"].to_numpy()
        if not itself:
            s[left["id"].to_numpy()[:, None] == ids[None, :]] = -2.0
        keep = min(k, s.shape[1])
        edge = -np.partition(-s, keep - 1, axis=1)[:, keep - 1 : keep]
        order = np.empty((len(s), keep), np.int64)
        for r in range(len(s)):  # sorts only what reaches the k-th similarity
            at = np.flatnonzero(s[r] >= edge[r])
            order[r] = at[np.lexsort((ids[at], -s[r, at]))[:keep]]
        rows = np.repeat(np.arange(len(left)), order.shape[1])
        out = pd.DataFrame({"query": left["id"].to_numpy()[rows], "neighbour": ids[order.ravel()], "similarity": s[rows, order.ravel()]})
        return out[out["similarity"] > -1.5]

    met = q.groupBy("qb", "db").cogroup(d.groupBy("qb", "db")).applyInPandas(best, f"query {kind}, neighbour {kind}, similarity double")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("similarity"), "neighbour"))
    return met.withColumn("rank", rank.cast("bigint")).where(F.col("rank") <= k)


def _pairs(sim: np.ndarray, guests: pd.DataFrame, homes: pd.DataFrame, least: float) -> pd.DataFrame:
    i, j = np.nonzero(sim >= least)
    a, b = guests["g_id"].to_numpy()[i], homes["id"].to_numpy()[j]
    keep = a != b
    return pd.DataFrame({"a": a[keep], "b": b[keep], "similarity": sim[i, j][keep]})


def _counts(sim: np.ndarray, guests: pd.DataFrame, homes: pd.DataFrame, least: float) -> pd.DataFrame:
    near = (sim >= least) & (guests["g_id"].to_numpy()[:, None] != homes["id"].to_numpy()[None, :])
    return pd.DataFrame({"a": guests["g_id"].to_numpy(), "n": near.sum(1)})


def _forest(sim: np.ndarray, guests: pd.DataFrame, homes: pd.DataFrame, least: float) -> pd.DataFrame:
    """Links that join what the block joins: of a block's flagged rows to the first of their group, and of the others to each group that they touch."""
    flagged, dense = guests["g_flag"].to_numpy(bool), np.flatnonzero(homes["flag"].to_numpy(bool))
    near = sim[:, dense] >= least
    ids, label = homes["id"].to_numpy()[dense], np.arange(len(dense))
    core = near[flagged]
    core = core[core.any(1)]
    while len(core):
        low = np.where(core, label, len(dense)).min(1)  # of each guest, and then of each home, the lowest that it touches
        new = np.minimum(label, np.where(core, low[:, None], len(dense)).min(0))
        if (new == label).all():
            break
        label = new
    out = [(ids, ids[label], np.zeros(len(ids), bool))] if len(ids) else []
    for row in np.flatnonzero(near.any(1)):
        touched = np.unique(label[near[row]])
        at = touched[:1] if flagged[row] else touched
        out.append((np.repeat(guests["g_id"].to_numpy()[row], len(at)), ids[at], np.full(len(at), not flagged[row])))
    a, b, border = (np.concatenate(x) for x in zip(*out)) if out else ([], [], [])
    frame = pd.DataFrame({"a": a, "b": b, "border": border})
    return frame[frame["a"] != frame["b"]].drop_duplicates()


def within_angle(data: DataFrame, least: float, id_col: str = "vec_id", vector: str = "embedding", pivots: int = 32) -> DataFrame:
    """``(a, b, similarity)``: all ordered pairs of different rows with a cosine of at least ``least``, exactly."""
    return _blocks(data.withColumn("_f", F.lit(False)), least, id_col, vector, pivots, _pairs, "a {kind}, b {kind}, similarity double")


def neighbour_counts(data: DataFrame, least: float, id_col: str = "vec_id", vector: str = "embedding", pivots: int = 32) -> DataFrame:
    """``(a, n)``: other rows with a cosine of at least ``least``, for rows that have any; no pair is kept."""
    parts = _blocks(data.withColumn("_f", F.lit(False)), least, id_col, vector, pivots, _counts, "a {kind}, n bigint")
    return parts.groupBy("a").agg(F.sum("n").alias("n")).where("n > 0")


def forest(data: DataFrame, flag: str, least: float, id_col: str = "vec_id", vector: str = "embedding", pivots: int = 32) -> DataFrame:
    """``(a, b, border)``: links with the same connected components as all pairs of flagged rows with a cosine of at least ``least``, and (``border``) of other rows to each component that they touch.

    A block of rows gives no more links than it has rows, whatever the pairs in it.
    """
    return _blocks(data.withColumn("_f", F.col(flag)), least, id_col, vector, pivots, _forest, "a {kind}, b {kind}, border boolean").distinct()


def _blocks(data: DataFrame, least: float, id_col: str, vector: str, pivots: int, reduce, schema: str) -> DataFrame:
    """Rows that ``reduce`` makes of the similarities of each pair of blocks.

    Rows live in the cell of their nearest pivot (a bounded sample of rows) and visit
    cells that an angle of arccos(least) can reach: a pair is met in the second row's
    cell. Cells of many rows are split by a hash, with all visitors to each part.
    """
    kind = dict(data.dtypes)[id_col]
    schema = schema.format(kind=kind)
    rows = data.select(F.col(id_col).alias("id"), F.col(vector).alias("v"), F.col("_f").alias("flag"))
    chosen = rows.select("id", "v").orderBy(F.xxhash64("id"), "id").limit(pivots).collect()
    if not chosen:
        return data.sparkSession.createDataFrame([], schema)
    P = np.stack([np.asarray(r["v"], float) for r in chosen])
    P /= np.maximum(np.linalg.norm(P, axis=1, keepdims=True), 1e-12)
    reach = float(np.arccos(np.clip(least, -1, 1))) + 1e-6

    def cells(batches):
        for pdf in batches:
            if pdf.empty:
                continue
            angle = np.arccos(np.clip(_rows(pdf["v"]) @ P.T, -1, 1))
            home = angle.argmin(1)
            near = angle.min(1)
            for c in range(len(P)):
                mine = home == c
                visit = angle[:, c] - near <= 2 * reach
                for flag, pick in ((True, mine), (False, visit)):
                    if pick.any():
                        yield pdf.loc[pick, ["id", "v", "flag"]].assign(cell=c, home=flag, angle=angle[pick, c])

    placed = checkpoint(rows.mapInPandas(cells, f"id {kind}, v array<double>, flag boolean, cell int, home boolean, angle double"))
    wide = placed.where("home").groupBy("cell").agg(F.max("angle").alias("radius"), F.count("*").alias("n")).withColumn("parts", F.ceil(F.col("n") / 2_048).cast("int"))
    fit = placed.join(wide, "cell").where(F.col("home") | (F.col("angle") <= F.col("radius") + reach))
    # homes and visitors of a cell are both cut into parts of a bounded size
    seen = fit.where("not home").groupBy("cell").agg(F.ceil(F.count("*") / 8_192).cast("int").alias("vparts"))
    fit = fit.join(seen, "cell")
    own, other = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"), F.pmod(F.xxhash64("id", F.lit(2)), F.col("vparts")).cast("int")
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    cut = fit.withColumn("part", F.explode(F.when(F.col("home"), F.array(own)).otherwise(every("parts"))))
    cut = cut.withColumn("vpart", F.explode(F.when(F.col("home"), every("vparts")).otherwise(F.array(other)))).select("id", "v", "flag", "cell", "home", "part", "vpart")

    def compare(homes: pd.DataFrame, guests: pd.DataFrame) -> pd.DataFrame:
        out = []
        if not homes.empty and not guests.empty:
            H = _rows(homes["v"])
            for s in range(0, len(guests), 2_048):
                block = guests.iloc[s : s + 2_048]
                out.append(reduce(np.round(_rows(block["g_v"]) @ H.T, 6), block, homes, least))
        # as objects: text columns put together are in chunks, which the transfer doesn't take
        return pd.concat(out).astype(object) if out else pd.DataFrame({c.split()[0]: pd.Series(dtype=object) for c in schema.split(", ")})

    guests = cut.where("not home").select(*(F.col(c).alias(f"g_{c}") for c in ("id", "v", "flag", "cell", "part", "vpart")))
    return cut.where("home").groupBy("cell", "part", "vpart").cogroup(guests.groupBy("g_cell", "g_part", "g_vpart")).applyInPandas(compare, schema)


def odd_one_out(groups: DataFrame) -> DataFrame:
    """``(grp, odd, similarity)`` of ``(grp, id, v)``: the member of each group with the lowest mean cosine to the others, the first by id of several."""
    x, y = groups.alias("x"), groups.alias("y")
    met = x.join(y, (F.col("x.grp") == F.col("y.grp")) & (F.col("x.id") != F.col("y.id")))
    mean = met.groupBy(F.col("x.grp").alias("grp"), F.col("x.id").alias("id")).agg(F.round(F.avg(cosine(F.col("x.v"), F.col("y.v"))), 6).alias("s"))
    return mean.groupBy("grp").agg(F.min_by("id", F.struct("s", "id")).alias("odd"), F.min("s").alias("similarity"))


def mean_pool(df: DataFrame, by: str, vector: str, weight: str) -> DataFrame:
    """``(by, pos, value)``: the weighted mean vector of each group, one row for each place."""
    cells = df.select(by, F.col(weight).alias("_w"), F.posexplode(doubles(F.col(vector))).alias("pos", "x"))
    return cells.groupBy(by, "pos").agg((F.sum(F.col("x") * F.col("_w")) / F.sum("_w")).alias("value"))
