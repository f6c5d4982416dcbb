import pytest
from pyspark.sql import functions as F

from foliant.functions import stemming
from foliant.functions import text as T
from foliant.operators import neardup, snippet, spell
from foliant.sources import books as B


def one(spark, expression, value):
    return spark.createDataFrame([(value,)], "x string").select(expression(F.col("x"))).first()[0]


def test_analyser(spark):
    text = "See http://a.b/c or WWW.x and mail me@home.org: It's sci-fi!\n  www.z  Ends."
    assert one(spark, T.analyse, text) == ["see", "or", "wwwx", "and", "mail", "its", "scifi", "ends"]
    assert one(spark, T.analyse, None) == [] and one(spark, T.analyse, " \n") == []


@pytest.mark.parametrize(("cell", "number", "rating"), [("42", 42, 42.0), (" 7 ", 7, 7.0), ("4,5", 0, 0.0), ("3.75", 0, 3.75), ("", 0, 0.0), (None, 0, 0.0), ("12 pages", 0, 0.0), ("99999999999", 99999999999, 99999999999.0), ("9" * 30, 0, 1e30), ("-4", 0, -4.0), ("+1.5", 0, 1.5), (".5", 0, 0.5), ("1e3", 0, 1000.0), ("1.", 0, 1.0), ("nan", 0, 0.0), ("-1", 0, -1.0)])
def test_guarded_numbers(spark, cell, number, rating):
    assert one(spark, T.guarded_int, cell) == number and one(spark, T.guarded_float, cell) == rating


def test_small_functions(spark):
    assert one(spark, T.list_items, " a , ,b,") == ["a", "b"] and one(spark, T.list_items, None) == []
    assert one(spark, T.char_grams, "abab") == ["$a", "ab", "ba", "b$"] and one(spark, T.char_grams, "") == ["$$"]
    assert one(spark, T.strip_edges, "--it's!") == "it's"
    assert one(spark, lambda x: T.pairs(T.split_words(x)), "a b b a") == ["a b", "b b", "b a"] and one(spark, lambda x: T.pairs(T.split_words(x)), "a") == []
    assert one(spark, T.word_tokens, "Étude naïve a_b x 42") == ["étude", "naïve", "a_b", "42"]
    assert one(spark, T.shorten, "x" * 40) == "x" * 35 + "..." and one(spark, T.shorten, "short") == "short"


#: Pairs from the published description of the algorithm.
@pytest.mark.parametrize(
    ("word", "stem"),
    [("caresses", "caress"), ("ponies", "poni"), ("cats", "cat"), ("agreed", "agre"), ("plastered", "plaster"), ("motoring", "motor"), ("hopping", "hop"), ("falling", "fall"), ("filing", "file"), ("happy", "happi"), ("sky", "sky"), ("relational", "relat"), ("conditional", "condit"), ("vietnamization", "vietnam"), ("triplicate", "triplic"), ("hopefulness", "hope"), ("revival", "reviv"), ("adjustment", "adjust"), ("adoption", "adopt"), ("probate", "probat"), ("controll", "control"), ("roll", "roll"), ("is", "is")],
)
def test_stems(word, stem):
    assert stemming.stem(word) == stem


def test_stems_of_a_column(spark):
    df = spark.createDataFrame([("ponies",), ("ponies",), (None,)], "term string")
    assert [(r.term, r.stem) for r in stemming.stem_terms(df).collect()] == [("ponies", "poni")]


def test_spelling_by_hand(spark):
    lex = spell.lexicon(spark.createDataFrame([("red fox red den",), ("red bird nest",), (None,)], "text string"))
    words = spark.createDataFrame([("brid",), ("red",), ("zzz",), ("",)], "word string")
    got = {r.candidate: r for r in spell.candidates(words, lex).collect()}
    assert got["bird"].jaccard == 0.25 and got["red"].jaccard == 0.125 and got["red"].cnt == 3 and "den" not in got
    assert (got["red"].rank, got["bird"].rank) == (1, 2)  # 0.375 before 0.25
    q = spark.createDataFrame([(1, "brid, RED zzz"), (2, "red den")], "query_id int, text string")
    assert {(r.query_id, r.corrected, r.changed) for r in spell.correct(q, lex).collect()} == {(1, "red red zzz", True), (2, "red den", False)}


def test_snippets_by_hand(spark):
    docs = spark.createDataFrame([(1, 1, "a b c d e f g h K j"), (1, 2, "K z"), (1, 3, "none of it"), (1, 4, ""), (2, 1, "K a b c d e f g h i j K. l m")], "query_id int, doc_id int, text string")
    terms = spark.createDataFrame([(1, "k"), (2, "k"), (2, "x")], "query_id int, term string")
    got = {(r.query_id, r.doc_id): r.snippet for r in snippet.snippets(docs, terms).collect()}
    assert got[1, 1] == "d e f g h ***K*** j" and got[1, 2] == "***K*** z" and got[1, 3] == "" and got[1, 4] == ""
    assert got[2, 1] == "***K*** a b c d e f g h i j ***K.*** l m"
    assert {(r.query_id, r.doc_id, r.term) for r in snippet.missing_terms(docs, terms).collect()} == {(1, 3, "k"), (1, 4, "k"), (2, 1, "x")}
    html = docs.limit(1).select(snippet.highlight_html("text", ["k", "a.b"])).first()[0]
    assert html.endswith('<span style="color: orange">K</span> j')


def test_minhash_estimates_similarity(spark):
    texts = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(60))), (2, " ".join(f"w{i}" for i in range(54)) + " x y z"), (3, "one"), (4, None), (5, " ".join(f"w{i}" for i in range(60)))], "doc_id int, text string")
    sets = neardup.shingle_sets(texts)
    sig = {r.doc_id: r.signature for r in neardup.signatures(sets).collect()}
    assert set(sig) == {1, 2, 5} and sig[1] == sig[5] and len(sig[1]) == 100
    near = neardup.near_pairs(sets).collect()
    assert [(r.doc_a, r.doc_b) for r in near] == [(1, 2)] and near[0].jaccard == pytest.approx(53 / 62, abs=1e-6)
    assert abs(sum(a == b for a, b in zip(sig[1], sig[2])) / 100 - 53 / 62) < 0.2
    with pytest.raises(ValueError):
        neardup.buckets(neardup.signatures(sets, 30), 25, 30)
    assert neardup.quality(neardup.near_pairs(sets), sets).first().n_pairs == 1


def test_readers_and_writers(spark, tmp_path):
    path = tmp_path / "b.csv"
    path.write_text('bookId,title,author,description,genres,characters,languages,publish_date,num_pages,avg_rating\n1,"A ""q"" title",X,"two\nlines"," a , b",,English,May 2001,12,4.5\n2,,,,,,,,x,\n')
    raw = B.read_csv(spark, str(path))
    rows = {r.id: r for r in B.project_books(raw, "bookId").collect()}
    assert rows["1"].title == 'A "q" title' and rows["1"].genres == ["a", "b"] and rows["1"].num_pages == 12 and rows["1"].avg_rating == 4.5 and "\n" in rows["1"].description
    assert rows["2"].title == "" and rows["2"].characters == [] and rows["2"].num_pages == 0
    B.write_json(B.project_books(raw, "bookId"), str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 2
    B.write_csv(raw, str(tmp_path / "c"))
    assert spark.read.csv(str(tmp_path / "c"), header=True, multiLine=True, escape='"').count() == 2
    (tmp_path / "a.json").write_text('[{"id": "1", "n": 1}, {"id": "2"}]')
    assert B.read_json_array(spark, str(tmp_path / "a.json")).count() == 2
    with pytest.raises(ValueError, match="nowhere"):
        B.require_columns(raw, ["title", "nowhere"])


def test_last_row_of_an_id_stands(spark):
    rows = [("a", "old", "1", 1), ("a", "new", "2", 2), ("a", "new", "3", 2), ("b", "x", None, 1), (None, "y", None, 1)]
    df = spark.createDataFrame(rows, "bookid string, title string, avg_rating string, t int").withColumn("loaded_at", F.timestamp_seconds("t"))
    assert {(r.bookid, r.title, r.avg_rating) for r in B.last_wins(df).collect()} == {("a", "new", "3"), ("b", "x", None)}


def test_words_without_stop_words_in_one_filter(spark):
    """The same words as by the analyser and a filter after it; characters are not looked up one by one."""
    odd = ["", " ", "a\tb\r\nc  d", "The THIS, that's\n-- x@y.org http://q w", "\x0b\x0cé ü z", "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~¡§", "İstanbul ΣΑΣ", None]
    df = spark.createDataFrame([(t,) for t in odd], "t string")
    both = df.select(T.analyse_without(F.col("t"), ["this", "b"]).alias("a"), T.without(T.analyse(F.col("t")), ["this", "b"]).alias("b"))
    assert all(r.a == r.b for r in both.collect()) and both.where("size(a) > 0").count() == 4
    assert "translate(" not in both._jdf.queryExecution().optimizedPlan().toString()


def test_last_rows_stay_in_place_where_an_id_stands_once(spark, tmp_path):
    """Only rows of repeated ids are moved, and what is kept is what a shuffle of all keeps; a table in one part is moved whole."""
    rows = [(None if i % 40 == 5 else f"b{i % 400:03}", f"t{i}", i % 7, str(i % 3)) for i in range(440)]
    df = spark.createDataFrame(rows, "bookid string, title string, loaded_at int, avg_rating string")
    df.repartition(8).write.parquet(f"{tmp_path}/many")
    spark.conf.set("spark.sql.files.openCostInBytes", "64m")
    many = spark.read.parquet(f"{tmp_path}/many")
    try:
        for part in (many, many.coalesce(1)):
            assert sorted(B.last_in_place(part).collect()) == sorted(B.last_wins(part).collect())
        plan = lambda x: x._jdf.queryExecution().optimizedPlan().toString()
        assert "Union" in plan(B.last_in_place(many)) and "Union" not in plan(B.last_in_place(many.coalesce(1)))
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
