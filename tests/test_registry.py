import duckdb
import pytest

import __spark_entry__ as entry
from foliant.plans import registry
from foliant.session import ensure_checkpoint_dir
from foliant.sources import books as B
from foliant.streaming import index_stream

TABLES = "region nation customer supplier part orders lineitem events documents embeddings books_csv lshfakedata embedding_csv stopwords language_names short_names".split()


@pytest.fixture(scope="module")
def oracle(sf):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "%.6g" % v
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return str(v)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query_against_sql(spark, sf, oracle, name):
    df = registry.queries()[name](spark, sf)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert got
        return
    result = oracle.execute(sql)
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    assert got == sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in result.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0 and set(registry.queries()) <= set(entry.queries())


def test_checkpoint_folder_is_that_of_the_session(spark):
    ensure_checkpoint_dir(spark)
    assert spark.sparkContext.getCheckpointDir()


def test_index_of_a_stream(spark, sf, tmp_path):
    """Two batches of documents, the second arriving later, give the index of all."""
    corpus = B.corpus(B.books(spark, sf))
    half = corpus.where("hash(doc_id) % 2 = 0"), corpus.where("hash(doc_id) % 2 <> 0")
    source, out, state = (str(tmp_path / d) for d in ("in", "out", "state"))
    for part in half:
        part.coalesce(1).write.mode("append").parquet(source)
        index_stream.maintain(spark.readStream.schema(corpus.schema).parquet(source), [], out, state).awaitTermination()
    from foliant.operators import index

    assert index.same_index(index_stream.current(spark, out), index.postings(corpus, []))


def test_windowed_counts_of_a_stream(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    stream = spark.readStream.schema(events.schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    q = index_stream.windowed_counts(stream).writeStream.format("memory").queryName("counted").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination()
    assert spark.table("counted").selectExpr("sum(n)").first()[0] == events.count()
