"""Readers, writers and views of the book corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliant.functions import text as T
from foliant.session import parallelism, table, written

CSV_SCHEMA = "bookId string, title string, author string, description string, genres string, characters string, languages string, publish_date string, num_pages string, avg_rating string"
FIELDS = ("description", "genres", "characters")


def require_columns(df: DataFrame, names: list[str]) -> DataFrame:
    """``df``, or an error that names the missing columns."""
    if missing := [n for n in names if n not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV of books: header, quotes doubled, line breaks within cells; malformed rows become nulls."""
    return spark.read.schema(CSV_SCHEMA).csv(path, header=True, quote='"', escape='"', multiLine=True, mode="PERMISSIVE")


def read_json_array(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A file that holds one JSON array of records."""
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def write_json(df: DataFrame, path: str) -> None:
    """One JSON record a line."""
    df.write.mode("overwrite").json(path)


def write_json_array(df: DataFrame, path: str) -> None:
    """One file with one JSON array, streamed row by row through one writer; for results of a size that one file can hold."""
    rows = df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value"))
    with open(path, "w", encoding="utf-8") as out:
        out.write("[")
        for i, row in enumerate(rows.toLocalIterator()):
            out.write((",\n" if i else "\n") + row[0])
        out.write("\n]\n")


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def project_books(raw: DataFrame, id_col: str = "bookid") -> DataFrame:
    """Cells trimmed and typed: lists as arrays, pages and rating as numbers with defaults."""
    text = lambda c: F.trim(F.coalesce(F.col(c), F.lit("")))
    return raw.select(
        F.col(id_col).alias("id"), text("title").alias("title"), text("author").alias("author"), text("description").alias("description"),
        *(T.list_items(F.col(c)).alias(c) for c in ("genres", "characters", "languages")),
        text("publish_date").alias("publish_date"), T.guarded_int(F.col("num_pages")).alias("num_pages"), T.guarded_float(F.col("avg_rating")).alias("avg_rating"),
    )


def last_wins(df: DataFrame, id_col: str = "bookid", spread: bool = True) -> DataFrame:
    """One row for each id: the one loaded last, of those the one with the greatest rating text."""
    spark = df.sparkSession
    if spread:  # one shuffle by id serves the window; its explicit width keeps the text analysis after it spread out
        df = df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * parallelism(spark)), id_col)
    order = Window.partitionBy(id_col).orderBy(F.desc("loaded_at"), F.desc(F.coalesce("avg_rating", F.lit(""))))
    return df.where(F.col(id_col).isNotNull()).withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def lookup(df: DataFrame, wanted: str | None, id_col: str = "bookid") -> DataFrame:
    """The row of one id, the one loaded last; no row for an unknown or null id. The filter reaches the scan, so that row groups are skipped."""
    return last_wins(df.where(F.col(id_col) == F.lit(wanted)), id_col)


def books(spark: SparkSession, sf_dir: str) -> DataFrame:
    return last_wins(table(spark, sf_dir, "books_csv"))


#: Buckets of ids that are sent at most, and how many there are for an id that is repeated.
BUCKETS, SPARSE = 2**18, 32


def last_in_place(df: DataFrame, id_col: str = "bookid") -> DataFrame:
    """``last_wins`` that moves only the rows whose id falls in a bucket with a repeated one; all others stay where they were read.

    A table that lies in few parts is moved whole, so that what is done with its rows is spread out.
    """
    sizes = [r[1] for r in df.groupBy(F.spark_partition_id()).count().collect()]
    if max(sizes, default=0) * parallelism(df.sparkSession) > 1.5 * sum(sizes):
        return last_wins(df, id_col)
    again = written(df.where(F.col(id_col).isNotNull()).groupBy(id_col).count().where("count > 1").select(id_col))
    n = min(BUCKETS, 2 ** (SPARSE * max(again.count(), 32)).bit_length())
    bucket = F.pmod(F.xxhash64(id_col), F.lit(n))
    met = F.broadcast(again.select(bucket.alias("_b")).distinct())
    rows = df.where(F.col(id_col).isNotNull()).withColumn("_b", bucket)
    alone, others = (rows.join(met, "_b", how).select(df.columns) for how in ("left_anti", "left_semi"))
    return alone.unionByName(last_wins(others, id_col, spread=False))


def books_in_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``books`` for reading their texts."""
    return last_in_place(table(spark, sf_dir, "books_csv"))


def corpus(books: DataFrame, used: tuple[str, ...] = FIELDS) -> DataFrame:
    """``(doc_id, field, text)`` of each book; columns of fields that aren't used are not read."""
    fields = F.array(*(F.struct(F.lit(f).alias("field"), F.coalesce(F.col(f) if f == "description" else F.translate(f, ",", " "), F.lit("")).alias("text")) for f in used))
    return books.select(F.col("bookid").alias("doc_id"), F.explode(fields).alias("f")).select("doc_id", "f.field", "f.text")


def texts(books: DataFrame, used: tuple[str, ...] = FIELDS, others: tuple[str, ...] = ()) -> DataFrame:
    """``(doc_id, texts)`` of each book: its ``corpus`` in one row, and other columns."""
    fields = (F.struct(F.lit(f).alias("field"), F.coalesce(F.col(f) if f == "description" else F.replace(F.col(f), F.lit(","), F.lit(" ")), F.lit("")).alias("text")) for f in used)
    return books.select(F.col("bookid").alias("doc_id"), F.array(*fields).alias("texts"), *others)


def title_queries(books: DataFrame) -> DataFrame:
    """``(query_id, text)``: the titles of books whose number is divisible by 20."""
    return books.where("cast(substring(bookid, 3) as bigint) % 20 = 0 and title is not null").select(F.col("bookid").alias("query_id"), F.col("title").alias("text"))


def stop_words(spark: SparkSession, sf_dir: str, most: int = 20_000) -> list[str]:
    """The stop-word table and the analyser's own list; a fixed table, refused beyond ``most`` rows."""
    rows = table(spark, sf_dir, "stopwords").select("word").where("word is not null").distinct().limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} stop words")
    return sorted({r[0] for r in rows} | set(T.STOP_WORDS))
