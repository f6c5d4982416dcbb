"""The fielded inverted index in long form, ``(field, term, doc_id, tf)``, and what derives from it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from dataclasses import field as dataclass_field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliant.functions import stemming
from foliant.functions import text as T

#: Sizes of the first and second tier by field.
TIERS = {"characters": (3, 2), "description": (10, 5), "genres": (1, 0)}


Analyser = Callable[[Column], Column]


def tokens(corpus: DataFrame, stop: list[str], analyser: Analyser = T.analyse) -> DataFrame:
    """``(doc_id, field, term)``, one row for each token that ``analyser`` makes of a text."""
    return corpus.select("doc_id", "field", F.explode(analyser(F.col("text"))).alias("term")).where(~F.col("term").isin(stop))


def forward(corpus: DataFrame, stop: list[str], terms: list[str] | None = None, stem: bool = False, analyser: Analyser = T.analyse) -> DataFrame:
    """``(doc_id, fields)``: each document's fields that have tokens, as ``(field, dl, terms)``, of a corpus ``(doc_id, texts)`` of ``(field, text)``.

    ``terms`` keeps the tokens of a short list only; lengths are of all. Other columns stay.
    """
    own = lambda t: T.analyse_without(t, stop) if analyser is T.analyse else T.without(analyser(t), stop)
    words = F.transform("texts", lambda x: F.struct(x["field"].alias("field"), own(x["text"]).alias("terms")))
    other = [c for c in corpus.columns if c not in ("doc_id", "texts")]
    docs = corpus.select("doc_id", *other, words.alias("f"))
    if stem:
        docs = docs.withColumn("f", F.arrays_zip(F.col("f.field").alias("field"), stemming.porter_lists(F.col("f.terms")).alias("terms")))
    kept = lambda w: w if terms is None else F.filter(w, lambda t: t.isin(terms))
    sized = F.transform("f", lambda x: F.struct(x["field"].alias("field"), F.size(x["terms"]).cast("bigint").alias("dl"), kept(x["terms"]).alias("terms")))
    return docs.select("doc_id", *other, F.filter(sized, lambda x: x["dl"] > 0).alias("fields"))


def stemmed(postings: DataFrame) -> DataFrame:
    """Postings by stem: each distinct term is stemmed once, and what falls together is summed."""
    stems = stemming.stem_terms(postings)
    keys = [c for c in postings.columns if c not in ("term", "tf")]
    return postings.join(stems, "term").groupBy(*keys, F.col("stem").alias("term")).agg(F.sum("tf").alias("tf")).select(postings.columns)


def postings(corpus: DataFrame, stop: list[str], analyser: Analyser = T.analyse, stem: bool = False) -> DataFrame:
    """``(field, term, doc_id, tf)``; with ``stem`` of stems in place of words (stop words are words)."""
    counted = tokens(corpus, stop, analyser).groupBy("field", "term", "doc_id").agg(F.count("*").alias("tf"))
    return stemmed(counted) if stem else counted


def doc_lengths(postings: DataFrame) -> DataFrame:
    return postings.groupBy("field", "doc_id").agg(F.sum("tf").alias("dl"))


def corpus_stats(lengths: DataFrame, n_docs: DataFrame) -> DataFrame:
    """``(field, avg_all, avg_having, n_docs)``: mean length over all documents, and over those with the field."""
    per = lengths.groupBy("field").agg(F.sum("dl").alias("_s"), F.count("*").alias("_c"))
    return per.crossJoin(F.broadcast(n_docs)).select("field", (F.col("_s") / F.col("n_docs")).alias("avg_all"), (F.col("_s") / F.col("_c")).alias("avg_having"), "n_docs")


def term_stats(postings: DataFrame) -> DataFrame:
    """``(field, term, df, cf)``."""
    return postings.groupBy("field", "term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def doc_norms(postings: DataFrame, terms: DataFrame, n_docs: DataFrame) -> DataFrame:
    """``(field, doc_id, norm)``: length of a document's vector of (1 + ln tf) ln(N / df) over all its terms."""
    weighed = postings.join(terms, ["field", "term"]).crossJoin(F.broadcast(n_docs))
    w = (1 + F.log("tf")) * F.log(F.col("n_docs") / F.col("df"))
    return weighed.groupBy("field", "doc_id").agg(F.sqrt(F.sum(w * w)).alias("norm"))


def tiered(postings: DataFrame, quality: DataFrame) -> DataFrame:
    """Postings with ``tier``: by tf x quality of the document, the first a, the next b, the rest."""
    graded = postings.join(quality, "doc_id", "left").withColumn("_g", F.col("tf") * F.coalesce("quality", F.lit(0.0)))
    rank = F.row_number().over(Window.partitionBy("field", "term").orderBy(F.desc("_g"), "doc_id"))
    first = F.create_map(*(F.lit(x) for f, (a, _) in TIERS.items() for x in (f, a)))
    second = F.create_map(*(F.lit(x) for f, (a, b) in TIERS.items() for x in (f, a + b)))
    # a bounded number of places a term: tasks drop the rest of a common term's list before it is brought together
    top = graded.withColumn("_r", rank).where(F.col("_r") <= max(a + b for a, b in TIERS.values()))
    tier = F.when(F.col("_r") <= first[F.col("field")], 1).when(F.col("_r") <= second[F.col("field")], 2)
    placed = top.select("field", "term", "doc_id", tier.cast("bigint").alias("tier")).where("tier is not null")
    return postings.join(placed, ["field", "term", "doc_id"], "left").select("field", "term", "doc_id", "tf", F.coalesce("tier", F.lit(3).cast("bigint")).alias("tier"))


def add_documents(postings: DataFrame, corpus: DataFrame, stop: list[str]) -> DataFrame:
    """The index with further documents, by the same analyser."""
    delta = tokens(corpus, stop).groupBy("field", "term", "doc_id").agg(F.count("*").alias("tf"))
    return postings.unionByName(delta).groupBy("field", "term", "doc_id").agg(F.sum("tf").alias("tf"))


def remove_documents(postings: DataFrame, ids: DataFrame) -> DataFrame:
    """The index without documents; terms without postings vanish."""
    return postings.join(ids.select("doc_id").distinct(), "doc_id", "left_anti").select("field", "term", "doc_id", "tf")


def posting_list(postings: DataFrame, field: str, word: str) -> DataFrame:
    return postings.where((F.col("field") == field) & (F.col("term") == word)).select("doc_id")


def same_index(a: DataFrame, b: DataFrame) -> bool:
    """Whether two indexes hold the same rows."""
    columns = ["field", "term", "doc_id", "tf"]
    a, b = a.select(columns), b.select(columns)
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def store(postings: DataFrame, path: str, field: str | None = None) -> None:
    """One folder for each field (and tier), sorted by term, so that a search reads few row groups; ``field`` restricts to one."""
    if field is not None and field not in TIERS:
        raise ValueError(f"no index named {field}")
    parts = ["field", "tier"] if "tier" in postings.columns else ["field"]
    rows = postings if field is None else postings.where(F.col("field") == field)
    rows.repartitionByRange(*parts, "term").sortWithinPartitions(*parts, "term").write.mode("overwrite").partitionBy(*parts).parquet(path)


def load(spark: SparkSession, path: str, field: str | None = None) -> DataFrame:
    """A stored index; one field reads one folder."""
    df = spark.read.parquet(path)
    return df if field is None else df.where(F.col("field") == field)


#: Names of the tables of a stored index: postings with their tiers, counts of terms, lengths and norms of documents, and the metadata of the fields.
TABLES = ("postings", "terms", "lengths", "metadata")


@dataclass
class Index:
    """The tables that ranking needs; what is not given follows from the postings."""

    postings: DataFrame
    n_docs: DataFrame
    stored: dict[str, DataFrame] = dataclass_field(default_factory=dict)

    @classmethod
    def build(cls, corpus: DataFrame, stop: list[str], analyser: Analyser = T.analyse, stem: bool = False) -> Index:
        return cls(postings(corpus, stop, analyser, stem), corpus.agg(F.countDistinct("doc_id").alias("n_docs")))

    @classmethod
    def read(cls, spark: SparkSession, path: str, field: str | None = None) -> Index:
        """An index as ``save`` wrote it; one field reads one folder of each table."""
        stored = {name: load(spark, f"{path}/{name}", field) for name in TABLES}
        return cls(stored["postings"].select("field", "term", "doc_id", "tf"), spark.read.parquet(f"{path}/n_docs"), stored)

    def save(self, path: str, quality: DataFrame) -> None:
        """All tables of the index below ``path``, each computed once."""
        store(tiered(self.postings, quality), f"{path}/postings")
        self.n_docs.write.mode("overwrite").parquet(f"{path}/n_docs")
        kept = load(self.postings.sparkSession, f"{path}/postings")
        terms = term_stats(kept)
        store(terms, f"{path}/terms")
        norms = doc_norms(kept, load(kept.sparkSession, f"{path}/terms"), self.n_docs)
        doc_lengths(kept).join(norms, ["field", "doc_id"]).write.mode("overwrite").partitionBy("field").parquet(f"{path}/lengths")
        lengths = load(kept.sparkSession, f"{path}/lengths")
        total = lengths.groupBy("field").agg(F.sum("dl").alias("c"))
        corpus_stats(lengths, self.n_docs).join(total, "field").write.mode("overwrite").partitionBy("field").parquet(f"{path}/metadata")

    def lengths(self) -> DataFrame:
        return self.stored["lengths"].select("field", "doc_id", "dl") if "lengths" in self.stored else doc_lengths(self.postings)

    def terms(self) -> DataFrame:
        return self.stored["terms"] if "terms" in self.stored else term_stats(self.postings)

    def norms(self) -> DataFrame:
        kept = self.stored.get("lengths")
        return kept.select("field", "doc_id", "norm") if kept is not None and "norm" in kept.columns else doc_norms(self.postings, self.terms(), self.n_docs)

    def totals(self) -> DataFrame:
        """``(field, c)``: tokens of all documents."""
        return self.stored["metadata"].select("field", "c") if "metadata" in self.stored else self.lengths().groupBy("field").agg(F.sum("dl").alias("c"))

    def mean_lengths(self) -> DataFrame:
        """``(field, avdl)``: of descriptions over documents that have one, else over all."""
        s = self.stored["metadata"] if "metadata" in self.stored else corpus_stats(self.lengths(), self.n_docs)
        return s.select("field", F.when(F.col("field") == "description", F.col("avg_having")).otherwise(F.col("avg_all")).alias("avdl"))


def read_table(spark: SparkSession, path: str, field: str, kind: str = "postings") -> DataFrame:
    """One table of a stored index by the field's name and the kind: postings (``tiered`` with their tiers), terms, lengths or metadata."""
    if field not in TIERS or kind not in (*TABLES, "tiered"):
        raise ValueError(f"no {kind} named {field}")
    df = load(spark, f"{path}/{'postings' if kind == 'tiered' else kind}", field)
    return df.drop("tier") if kind == "postings" else df


def check(index: Index, corpus: DataFrame, stop: list[str]) -> DataFrame:
    """``(name, same)``: whether the index's postings, counts of terms and lengths are those of ``corpus`` indexed anew."""
    fresh = Index.build(corpus, stop)
    tables = {"postings": (index.postings, fresh.postings), "terms": (index.terms(), fresh.terms()), "lengths": (index.lengths(), fresh.lengths())}
    spark = index.postings.sparkSession
    rows = []
    for name, (a, b) in tables.items():
        b = b.select(*(F.col(c).cast(t) for c, t in b.dtypes))
        a = a.select(b.columns)
        rows.append((name, a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()))
    return spark.createDataFrame(rows, "name string, same boolean")
