"""Queries of projections, predicates, aggregates and scalar functions over the book tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.functions import text as T
from foliant.operators import neardup, vectors
from foliant.plans import sql as S
from foliant.session import table, written
from foliant.sources import books as B


def books_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed books, all rows of the raw table."""
    return B.project_books(table(spark, sf_dir, "books_csv")).select("id", "title", "author", F.array_join("genres", "|").alias("genres"), F.array_join("characters", "|").alias("characters"), "num_pages", "avg_rating")


def last_loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.books(spark, sf_dir).select("bookid", "title", "avg_rating")


def top_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten most frequent titles."""
    titles = B.books(spark, sf_dir).where("title is not null").groupBy("title").agg(F.count("*").alias("n"))
    return titles.orderBy(F.desc("n"), "title").limit(10)


def books_of_top_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.books(spark, sf_dir).join(F.broadcast(top_titles(spark, sf_dir).select("title")), "title", "left_semi").select("bookid", "title")


def book_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Point lookup: the book of one id, here the smallest of a book with a title."""
    books = B.books(spark, sf_dir)
    wanted = books.where("title is not null").agg(F.min("bookid")).first()[0]
    return B.lookup(table(spark, sf_dir, "books_csv"), wanted).select("bookid", "title", "author")


def joined_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = T.joined_text(("title ", F.col("title")), ("author ", F.col("author")))
    return B.books(spark, sf_dir).select("bookid", text.alias("text"), T.shorten(F.coalesce("description", F.lit(""))).alias("short"))


def parsed_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of numbers as arrays; what does not parse is null."""
    v = F.from_json("description_emb", "array<double>")
    rows = table(spark, sf_dir, "embedding_csv").where(F.col("description_emb").rlike(r"^\[[-+0-9.eE, \t\r\n]+\]$"))
    return rows.select("bookid", F.size(v).cast("bigint").alias("dimensions"), F.round(vectors.norm(v), 4).alias("norm")).where("dimensions > 0")


def event_main_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most frequent event type of each user, the first by priority of several."""
    priority = F.create_map(*(F.lit(x) for i, t in enumerate(("purchase", "signup", "click", "view", "error")) for x in (t, i)))
    n = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    best = n.groupBy("user_id").agg(F.min_by("event_type", F.struct(-F.col("n"), F.coalesce(priority[F.col("event_type")], F.lit(9)), F.col("event_type"))).alias("main_type"))
    return best


def event_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums by a key within JSON."""
    k = F.from_json("props", "k bigint")["k"]
    return table(spark, sf_dir, "events").groupBy(k.alias("k")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))


def event_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by five minutes and type: what the stream counts, in one batch."""
    w = F.window("ts", "5 minutes")
    return table(spark, sf_dir, "events").groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total")).select(F.date_format("w.start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "n", "total")


def title_char_grams(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = B.books(spark, sf_dir).select(F.explode(T.split_words(F.lower("title"))).alias("word")).distinct()
    return words.select("word", F.array_join(T.char_grams(F.col("word")), ",").alias("grams"))


def shingle_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    sets = neardup.shingle_sets(B.books(spark, sf_dir).where("description is not null"), "bookid", "description")
    return sets.select("doc_id", F.size("shingles").cast("bigint").alias("n"))


def all_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of both catalogues by name, missing columns null."""
    a = B.books(spark, sf_dir).select(F.col("bookid").alias("id"), "title", "num_pages")
    b = table(spark, sf_dir, "lshfakedata").select("id", "title", F.size("descriptions").cast("bigint").alias("parts"))
    return a.unionByName(b, allowMissingColumns=True)


def new_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles of the other catalogue that no book has."""
    a = table(spark, sf_dir, "lshfakedata").select("title").where("title is not null")
    return a.distinct().join(B.books(spark, sf_dir).select("title"), "title", "left_anti")


def genre_classes(books: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(author, g, head)``, one row for each distinct set of genres of an author, and ``(bookid, head)`` of all books with both."""
    sets = books.where("author is not null and trim(author) <> ''").select("bookid", "author", F.array_sort(F.array_distinct(T.list_items(F.col("genres")))).alias("g")).where("size(g) > 0")
    classes = sets.groupBy("author", "g").agg(F.min("bookid").alias("head"))
    return classes, sets.join(classes, ["author", "g"]).select("bookid", "head")


def nested_classes(classes: DataFrame, most: int = 256) -> DataFrame:
    """``(inner_head, outer_head)``: classes of one author of which one's set lies within the other's, exact.

    An inner set meets its author's sets that hold its rarest genre; keys of over
    ``most`` inner sets are split by hash of the inner set, so that no task gets an author whole.
    """
    items = classes.select("author", "head", "g", F.explode("g").alias("genre"))
    counts = items.groupBy("author", "genre").agg(F.count("*").alias("n"))
    inner = items.join(counts, ["author", "genre"]).groupBy("author", "head").agg(F.min_by("genre", F.struct("n", "genre")).alias("genre"), F.any_value("g").alias("g"))
    parts = inner.groupBy("author", "genre").agg(F.ceil(F.count("*") / most).alias("parts"))
    x = inner.join(parts, ["author", "genre"]).withColumn("part", F.pmod(F.xxhash64("head"), "parts")).alias("x")
    y = items.join(parts, ["author", "genre"]).withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1))).alias("y")
    same = (F.col("x.author") == F.col("y.author")) & (F.col("x.genre") == F.col("y.genre")) & (F.col("x.part") == F.col("y.part"))
    inside = (F.size("x.g") < F.size("y.g")) & (F.size(F.array_except("x.g", "y.g")) == 0)
    return x.join(y, same & inside).select(F.col("x.head").alias("inner_head"), F.col("y.head").alias("outer_head"))


def nested_genres(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Books by one author of which one's genres lie within the other's, as pairs of heads of equal sets, for authors of any number of books; ``nested_genres_members`` names the books of each."""
    return nested_classes(written(genre_classes(B.books(spark, sf_dir))[0]))


def nested_genres_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The head of each book's class: books of one head have the same author and genres, so each lies within the others."""
    return genre_classes(B.books(spark, sf_dir))[1]


QUERIES = {
    f.__name__: f
    for f in (books_projection, last_loaded, top_titles, books_of_top_titles, joined_text, parsed_vectors, event_main_type, event_props, event_counts, title_char_grams, shingle_counts, all_titles, new_titles, nested_genres, nested_genres_members, book_by_id)
}

_LIST = "list_filter(list_transform(string_split(coalesce({c}, ''), ','), lambda x: trim(x)), lambda x: x <> '')"
_TOP = "top AS (SELECT title, count(*)::BIGINT AS n FROM books WHERE title IS NOT NULL GROUP BY 1 ORDER BY n DESC, title LIMIT 10)"
_CLASSES = f"""{S.BOOKS}, n AS (SELECT bookid, author, list_sort(list_distinct({_LIST.format(c='genres')})) AS g FROM books WHERE trim(coalesce(author, '')) <> '' AND len({_LIST.format(c='genres')}) > 0),
c AS (SELECT author, g, min(bookid) AS head FROM n GROUP BY ALL)"""
ORACLE = {
    "books_projection": f"""SELECT bookid AS id, trim(coalesce(title, '')) AS title, trim(coalesce(author, '')) AS author, array_to_string({_LIST.format(c='genres')}, '|') AS genres, array_to_string({_LIST.format(c='characters')}, '|') AS characters,
{S.whole('num_pages')} AS num_pages, {S.number('avg_rating')} AS avg_rating FROM books_csv""",
    "last_loaded": f"WITH {S.BOOKS} SELECT bookid, title, avg_rating FROM books",
    "top_titles": f"WITH {S.BOOKS}, {_TOP} SELECT * FROM top",
    "books_of_top_titles": f"WITH {S.BOOKS}, {_TOP} SELECT bookid, title FROM books WHERE title IN (SELECT title FROM top)",
    "joined_text": f"WITH {S.BOOKS} SELECT bookid, 'title ' || coalesce(title, '') || ' author ' || coalesce(author, '') AS text, CASE WHEN length(coalesce(description, '')) > 35 THEN substr(description, 1, 35) || '...' ELSE coalesce(description, '') END AS short FROM books",
    "parsed_vectors": "SELECT bookid, len(v)::BIGINT AS dimensions, round(sqrt(list_dot_product(v, v)), 4) AS norm FROM (SELECT bookid, TRY_CAST(description_emb AS DOUBLE[]) AS v FROM embedding_csv WHERE regexp_full_match(description_emb, '\\[[-+0-9.eE, \t\r\n]+\\]')) WHERE len(v) > 0",
    "event_main_type": "SELECT user_id, event_type AS main_type FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, coalesce(list_position(['purchase', 'signup', 'click', 'view', 'error'], event_type), 10), event_type) = 1",
    "event_props": "SELECT CAST(json_extract(props, '$.k') AS BIGINT) AS k, count(*)::BIGINT AS n, round(sum(value), 2) AS total FROM events GROUP BY 1",
    "event_counts": "SELECT strftime(time_bucket(INTERVAL 5 MINUTE, ts), '%Y-%m-%d %H:%M') AS start, event_type, count(*)::BIGINT AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL",
    "title_char_grams": f"WITH {S.BOOKS}, w AS (SELECT DISTINCT unnest({S.words('lower(title)')}) AS word FROM books), g AS (SELECT word, range(1, length(word) + 2) AS r FROM w) SELECT word, array_to_string(list_transform(list_filter(r, lambda i: list_position(list_transform(r, lambda j: substr('$' || word || '$', j, 2)), substr('$' || word || '$', i, 2)) = i), lambda i: substr('$' || word || '$', i, 2)), ',') AS grams FROM g",
    "shingle_counts": f"WITH {S.BOOKS}, t AS (SELECT bookid AS doc_id, {S.analysed('description')} AS t FROM books WHERE description IS NOT NULL) SELECT doc_id, len(list_distinct({S.pairs('t')}))::BIGINT AS n FROM t WHERE len(t) > 1",
    "all_titles": f"WITH {S.BOOKS} SELECT bookid AS id, title, num_pages, NULL::BIGINT AS parts FROM books UNION ALL SELECT id, title, NULL, CASE WHEN descriptions IS NULL THEN NULL ELSE len(descriptions) END FROM lshfakedata",
    "new_titles": f"WITH {S.BOOKS} SELECT DISTINCT title FROM lshfakedata WHERE title IS NOT NULL AND title NOT IN (SELECT title FROM books WHERE title IS NOT NULL)",
    "nested_genres": f"WITH {_CLASSES} SELECT x.head AS inner_head, y.head AS outer_head FROM c x JOIN c y ON x.author = y.author AND len(x.g) < len(y.g) AND len(list_intersect(x.g, y.g)) = len(x.g)",
    "nested_genres_members": f"WITH {_CLASSES} SELECT bookid, head FROM n JOIN c USING (author, g)",
    "book_by_id": f"WITH {S.BOOKS} SELECT bookid, title, author FROM books WHERE bookid = (SELECT min(bookid) FROM books WHERE title IS NOT NULL)",
}
