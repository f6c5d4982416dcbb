"""Ranking by vector space, BM25 and language models, over one index or tier by tier, as joins and sums.

A score is a sum over query terms of the documents that hold at least one of them.
Terms that a document lacks are not joined in: what they add to a language model's
score depends on the query and the document's length only and is added in closed form.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions import stemming
from foliant.functions import text as T
from foliant.operators import blocks
from foliant.operators.index import Analyser, Index

#: Default weights of the fields, and parameters of BM25.
WEIGHTS = {"characters": 0.3, "genres": 0.3, "description": 0.4}
K1, B = 1.2, 0.75
METHODS = ("ltn.lnn", "ltc.lnc", "bm25", "lm_naive", "lm_bayes", "lm_mixture")
MINUS_INFINITY = float("-inf")
#: Terms of queries that are sent as a list at most.
SHORT = 20_000


def query_terms(queries: DataFrame, stop: list[str], analyser: Analyser = T.analyse, stem: bool = False) -> DataFrame:
    """``(query_id, term, qtf)`` of ``(query_id, text)``, by the analyser of the index."""
    words = queries.select("query_id", F.explode(analyser(F.col("text"))).alias("term")).where(~F.col("term").isin(stop))
    words = words.withColumn("term", stemming.porter("term")) if stem else words
    return words.groupBy("query_id", "term").agg(F.count("*").alias("qtf"))


def of_terms(postings: DataFrame, queries: DataFrame) -> DataFrame:
    """The postings of the terms that are asked for."""
    return postings.join(queries.select("term").distinct(), "term", "left_semi")


def _parts(df: DataFrame) -> list[str]:
    return [c for c in ("field", "tier") if c in df.columns]


def scores(index: Index, queries: DataFrame, method: str, alpha: float = 0.5, lamda: float = 0.5, postings: DataFrame | None = None, counts: DataFrame | None = None) -> DataFrame:
    """``(query_id, field[, tier], doc_id, score)`` for all documents with a query term.

    Counts come from ``postings`` (by field, and by tier if it has one); the number of
    documents and lengths are those of ``index``. A query term that no document of the
    part holds makes every score of a language model minus infinity. ``counts``
    ``(field, tier, term, df)`` is for ``postings`` that lack documents without a query term.
    """
    if method not in METHODS:
        raise ValueError(f"method must be one of {', '.join(METHODS)}")
    whole = index.postings if postings is None else postings
    parts = _parts(whole)
    p = of_terms(whole, queries)
    terms = index.terms() if "terms" in index.stored and parts == ["field"] else p.groupBy(*parts, "term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))
    asked = queries.join(terms, "term").crossJoin(F.broadcast(index.n_docs)).withColumn("idf", F.log(F.col("n_docs") / F.col("df")))
    if method in ("ltn.lnn", "ltc.lnc"):
        hits = p.join(asked, [*parts, "term"])
        score = F.sum((1 + F.log("tf")) * F.col("idf") * (1 + F.log("qtf")))
        raw = hits.groupBy("query_id", *parts, "doc_id").agg(score.alias("score"))
        if method == "ltn.lnn":
            return raw
        if parts == ["field"]:
            norms = index.norms().withColumnRenamed("norm", "dn")
        else:
            df = whole.groupBy(*parts, "term").agg(F.count("*").alias("df")) if counts is None else counts
            w = (1 + F.log("tf")) * F.log(F.col("n_docs") / F.col("df"))
            norms = whole.join(df, [*parts, "term"]).crossJoin(F.broadcast(index.n_docs)).groupBy(*parts, "doc_id").agg(F.sqrt(F.sum(w * w)).alias("dn"))
        qn = queries.groupBy("query_id").agg(F.sqrt(F.sum((1 + F.log("qtf")) * (1 + F.log("qtf")))).alias("qn"))
        both = raw.join(norms, [*parts, "doc_id"]).join(qn, "query_id")
        return both.select("query_id", *parts, "doc_id", F.coalesce(F.try_divide(F.col("score"), F.col("dn") * F.col("qn")), F.lit(0.0)).alias("score"))
    lengths = index.lengths()
    if method == "bm25":
        tf = F.col("tf")
        weight = F.col("idf") * (K1 + 1) * tf / (K1 * ((1 - B) + B * F.col("dl") / F.col("avdl")) + tf)
        hits = p.join(asked, [*parts, "term"]).join(lengths, ["field", "doc_id"]).join(F.broadcast(index.mean_lengths()), "field")
        return hits.groupBy("query_id", *parts, "doc_id").agg(F.sum(F.col("qtf") * weight).alias("score"))
    total = index.totals() if parts == ["field"] else whole.groupBy(*parts).agg(F.sum("tf").alias("c"))
    share = F.col("cf") / F.col("c")
    qsize = queries.groupBy("query_id").agg(F.count("*").alias("nt"), F.sum("qtf").alias("qlen"))
    known = asked.join(F.broadcast(total), parts)
    smooth = F.lit(alpha) * share if method == "lm_bayes" else F.lit(1 - lamda) * share
    base = known.groupBy("query_id", *parts).agg(F.count("*").alias("found"), F.sum(F.col("qtf") * F.log(smooth)).alias("base"))
    hits = p.join(known, [*parts, "term"]).join(lengths, ["field", "doc_id"])
    tf, dl = F.col("tf"), F.col("dl")
    present = {"lm_naive": F.log(tf / dl), "lm_bayes": F.log(tf + smooth) - F.log(smooth), "lm_mixture": F.log(F.lit(lamda) * tf / dl + smooth) - F.log(smooth)}[method]
    met = hits.groupBy("query_id", *parts, "doc_id").agg(F.sum(F.col("qtf") * present).alias("sum"), F.count("*").alias("have"), F.max("dl").alias("dl"))
    full = met.join(base, ["query_id", *parts]).join(qsize, "query_id")
    if method == "lm_naive":
        score = F.when(F.col("have") < F.col("nt"), F.lit(MINUS_INFINITY)).otherwise(F.col("sum"))
    else:
        shrink = F.col("qlen") * F.log(F.col("dl") + alpha) if method == "lm_bayes" else F.lit(0.0)
        score = F.when(F.col("found") < F.col("nt"), F.lit(MINUS_INFINITY)).otherwise(F.col("base") + F.col("sum") - shrink)
    return full.select("query_id", *parts, "doc_id", score.alias("score"))


def fuse(scored: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """``(query_id, doc_id, score)``: weighted sum over fields; a field without the document adds nothing."""
    weights = WEIGHTS if weights is None else weights
    if any(w < 0 for w in weights.values()):
        raise ValueError("weights must not be negative")
    used = {f: w for f, w in weights.items() if w > 0}
    table = F.create_map(*(F.lit(x) for pair in used.items() for x in pair))
    return scored.where(F.col("field").isin(list(used))).groupBy("query_id", "doc_id").agg(F.sum(table[F.col("field")] * F.col("score")).alias("score"))


def top_k(scored: DataFrame, k: int = 10) -> DataFrame:
    """The best ``k`` documents of each query (all for k <= 0) by score to 6 places and id, with ``rank``."""
    rounded = scored.withColumn("score", F.round("score", 6))
    ranked = rounded.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")))
    ranked = ranked.where(F.col("rank") <= k) if k > 0 else ranked
    return ranked.select("query_id", "doc_id", "score", F.col("rank").cast("bigint").alias("rank"))


def _only(index: Index, weights: dict[str, float]) -> Index:
    """The index with the fields of positive weight, so that others are not read."""
    used = F.col("field").isin([f for f, w in weights.items() if w > 0])
    return Index(index.postings.where(used), index.n_docs, {name: df.where(used) for name, df in index.stored.items()})


def search_placed(docs: DataFrame, placed: DataFrame, n_docs: DataFrame, sizes: DataFrame, queries: DataFrame, method: str, weights: dict[str, float] | None = None, k: int = 10, counts: DataFrame | None = None, keep=lambda df: df) -> DataFrame:
    """``search`` by tiers for k > 0, of documents with all asked terms, and their postings of the first two tiers.

    The third tier, with almost all postings, is scored for the queries alone that the
    first two don't fill. ``ltc.lnc`` needs all terms in ``docs`` and ``placed``, and their
    counts ``(field, term, df)``. ``keep`` writes what is read several times.
    """
    weights = {f: w for f, w in (WEIGHTS if weights is None else weights).items() if w > 0}
    used = F.col("field").isin(list(weights))
    placed = placed.where(used)
    shaped = lambda p: p.select("field", "term", "doc_id", "tf", "tier")
    stats = sizes.where(used)

    def scored(part: DataFrame, asked: DataFrame, df: DataFrame | None = None) -> DataFrame:
        metadata = stats.select("field", F.col("avdl").alias("avg_having"), F.col("avdl").alias("avg_all"))
        needed = part if method == "ltc.lnc" else of_terms(part, asked)
        index = Index(shaped(needed), n_docs, {"lengths": needed.select("field", "doc_id", "dl").distinct(), "metadata": metadata})
        return scores(index, asked, method, postings=shaped(needed), counts=df)

    def first_of(rows: DataFrame) -> DataFrame:
        return rows.withColumn("_r", F.row_number().over(Window.partitionBy("query_id", "field", "doc_id").orderBy("tier"))).where("_r = 1").drop("_r")

    early = keep(first_of(scored(placed, queries)))
    n = early.groupBy("query_id", "doc_id").agg(F.min("tier").alias("t")).groupBy("query_id").agg(F.count(F.when(F.col("t") <= 1, 1)).alias("n1"), F.count("*").alias("n2"))
    stop = n.select("query_id", F.when(F.col("n1") >= k, 1).when(F.col("n2") >= k, 2).otherwise(3).alias("stop"))
    rest = keep(queries.join(stop.where("stop < 3"), "query_id", "left_anti"))
    some = [] if rest.isEmpty() else [r[0] for r in rest.select("term").distinct().limit(SHORT + 1).collect()]
    found = blocks.third(docs, placed, counts, n_docs, some, keep=keep) if method == "ltc.lnc" and counts is not None and "quality" in docs.columns and 0 < len(some) <= SHORT else None
    if found:
        # the third tier's best of all fields, and its scores of the few documents that the first two found in some
        docs3, left = found
        left = keep(left.join(rest.select("term").distinct(), "term", "left_semi"))
        pairs = keep(early.join(rest.select("query_id").distinct(), "query_id", "left_semi").select("query_id", "doc_id").distinct())
        more = blocks.best(docs3.where(F.size("fields") > 0), rest, left.withColumn("cf", F.lit(0).cast("bigint")), stats, n_docs, method, weights, 2 * k)
        of = docs3.join(pairs.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", F.explode("fields").alias("f")).where(F.col("f.field").isin(list(weights)))
        words = of.select("doc_id", "f.field", "f.norm", F.explode(F.arrays_zip(F.col("f.terms").alias("term"), F.col("f.tfs").alias("tf"))).alias("t")).select("doc_id", "field", "norm", "t.term", "t.tf")
        hits = pairs.join(words, "doc_id").join(rest, ["query_id", "term"]).join(left, ["field", "term"]).crossJoin(F.broadcast(n_docs))
        raw = hits.groupBy("query_id", "field", "doc_id", "norm").agg(F.sum((1 + F.log("tf")) * F.log(F.col("n_docs") / F.col("df")) * (1 + F.log("qtf"))).alias("score"))
        qn = rest.groupBy("query_id").agg(F.sqrt(F.sum((1 + F.log("qtf")) * (1 + F.log("qtf")))).alias("qn"))
        late = raw.join(qn, "query_id").select("query_id", "field", F.lit(3).cast("bigint").alias("tier"), "doc_id", F.coalesce(F.try_divide(F.col("score"), F.col("norm") * F.col("qn")), F.lit(0.0)).alias("score"))
        early = first_of(early.unionByName(late))
        best = early.join(stop, "query_id", "left").where(F.col("tier") <= F.coalesce("stop", F.lit(3)))
        return top_k(fuse(best.drop("stop"), weights).unionByName(more.join(pairs, ["query_id", "doc_id"], "left_anti")), k)
    if some:
        holds = docs.select("doc_id", "fields", F.explode("fields").alias("f")).where(F.col("f.field").isin(list(weights))).select("doc_id", "fields", F.explode(F.array_distinct("f.terms")).alias("term"))
        met = docs.select("doc_id", "fields").join(holds.select("doc_id", "term").join(rest.select("term").distinct(), "term", "left_semi").select("doc_id").distinct(), "doc_id", "left_semi")
        kept = met.select("doc_id", F.explode("fields").alias("f")).where(F.col("f.field").isin(list(weights))).select("doc_id", "f.field", "f.dl", F.explode("f.terms").alias("term"))
        kept = kept if method == "ltc.lnc" else of_terms(kept, rest)
        third = kept.groupBy("field", "term", "doc_id", "dl").agg(F.count("*").cast("bigint").alias("tf")).join(placed.select("field", "term", "doc_id"), ["field", "term", "doc_id"], "left_anti").withColumn("tier", F.lit(3).cast("bigint"))
        third = keep(third.select("field", "term", "doc_id", "tf", "dl", "tier"))
        df = None
        if counts is not None and method == "ltc.lnc":
            had = placed.groupBy("field", "term").agg(F.count("*").alias("_p"))
            df = counts.join(had, ["field", "term"], "left").select("field", F.lit(3).cast("bigint").alias("tier"), "term", (F.col("df") - F.coalesce("_p", F.lit(0))).alias("df")).where("df > 0")
        early = first_of(early.unionByName(scored(third, rest, df)))
    best = early.join(stop, "query_id", "left").where(F.col("tier") <= F.coalesce("stop", F.lit(3)))
    return top_k(fuse(best.drop("stop"), weights), k)


def search(index: Index, queries: DataFrame, method: str = "bm25", weights: dict[str, float] | None = None, k: int = 10, tiers: DataFrame | None = None, **smoothing: float) -> DataFrame:
    """Ranked results of ``(query_id, term, qtf)``: over the full index, or tier by tier if ``tiers`` is given.

    Tier by tier, a field's first tier with a document fixes its score, and a query
    stops after the tier by which ``k`` documents are scored.
    """
    weights = WEIGHTS if weights is None else weights
    if tiers is None:
        return top_k(fuse(scores(_only(index, weights), queries, method, **smoothing), weights), k)
    used = tiers.where(F.col("field").isin([f for f, w in weights.items() if w > 0]))
    index = _only(index, weights)
    scored = scores(index, queries, method, postings=used, **smoothing)
    by_doc = Window.partitionBy("query_id", "field", "doc_id").orderBy("tier")
    first = scored.withColumn("_r", F.row_number().over(by_doc)).where("_r = 1").drop("_r")
    if k > 0:
        reached = first.groupBy("query_id", "doc_id").agg(F.min("tier").alias("t")).groupBy("query_id").agg(*(F.count(F.when(F.col("t") <= n, 1)).alias(f"n{n}") for n in (1, 2)))
        stop = reached.select("query_id", F.when(F.col("n1") >= k, 1).when(F.col("n2") >= k, 2).otherwise(3).alias("stop"))
        first = first.join(stop, "query_id").where(F.col("tier") <= F.col("stop"))
    return top_k(fuse(first, weights), k)
