import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from foliant.llm import langid as li
from foliant.session import table

EN = "When the old lighthouse disappears from the village, only a young baker seems to care about it."
FR = "Quand le vieux phare disparaît du village, seule une jeune femme semble avoir le courage de le chercher."
DE = "Als der alte Turm aus dem Dorf verschwindet, wagt nur eine junge Frau die Suche nach ihm."


@settings(max_examples=60, deadline=None)
@given(st.text("ab ", max_size=30), st.text("abc ", max_size=20))
def test_phrases_are_the_longest_matches(sample, text):
    count, at = 1, 0
    i = 0
    while i < len(text):
        if text[at : i + 1] in sample:
            i += 1
            continue
        if text[i] in sample:
            count, at = count + 1, i
            i += 1
        else:
            count += 1
            i += 1
            at = i
    assert li.SuffixAutomaton(sample).phrases(text) == count


@pytest.fixture(scope="module")
def inputs(spark):
    sf = "/root/testdata/sf0.01"
    return [table(spark, sf, t) for t in ("language_names", "stopwords", "books_csv")]


def languages(spark, inputs, rows):
    df = spark.createDataFrame(rows, "id string, descriptions array<string>, languages array<string>, lang string, words int")
    records = table(spark, "/root/testdata/sf0.01", "lshfakedata").select("id", "descriptions", "languages", F.lit(None).cast("string").alias("lang"), F.lit(1).alias("words"))
    return li.record_languages(df.unionByName(records), *inputs).where("id like 't_'")


def test_records(spark, inputs):
    rows = [
        ("t1", [EN], ["English"], None, None), ("t2", [FR], ["English"], None, None), ("t3", [EN + " " + FR, "", None, "four words only here", DE], None, None, None), ("t4", [EN, FR], ["english ", "Français", "junk"], None, None),
        ("t5", [EN.replace("lighthouse", "Schloss")], ["en"], None, None), ("t6", [FR.upper()], ["-"], None, None), ("t7", [], None, None, None), ("t8", None, ["en"], None, None), ("t2", [FR], ["English"], None, None),
        ("t9", [DE.replace(",", "").replace(".", "") + " " + EN.replace(",", "").replace(".", "")], ["German"], None, None),
    ]
    out = languages(spark, inputs, rows)
    got = {}
    for r in out.collect():
        got.setdefault(r.id, set()).add((r.seg_no, r.lang))
        assert 0.5 <= r.confidence <= 1 and r.words > 0
    assert got == {"t1": {(0, "en")}, "t2": {(0, "fr")}, "t3": {(0, "en"), (0, "fr"), (4, "de")}, "t4": {(0, "en"), (1, "fr")}, "t5": {(0, "en")}, "t6": {(0, "fr")}, "t9": {(0, "de"), (0, "en")}}
    wrong = {(r.id, r.seg_no, r.lang) for r in li.mislabelled(out).collect()}
    assert wrong == {("t2", 0, "fr"), ("t3", 0, "en"), ("t3", 0, "fr"), ("t3", 4, "de"), ("t6", 0, "fr"), ("t9", 0, "de"), ("t9", 0, "en")}


def test_empty_tables(spark, inputs):
    df = spark.createDataFrame([], "id string, descriptions array<string>, languages array<string>")
    assert li.record_languages(df, *inputs[:2]).count() == 0
    assert li.record_languages(df, inputs[0].limit(0), inputs[1].limit(0)).count() == 0
    one = spark.createDataFrame([("a", [EN], ["English"])], df.schema)
    assert li.record_languages(one, inputs[0].limit(0), inputs[1]).count() == 0


def test_held_out_accuracy(spark, inputs):
    """Documents of which the label is right by their common words, none of them in the sample."""
    labels = li.label_map(inputs[0])
    labelled = inputs[2].select(F.col("description").alias("text"), F.try_element_at(li._as_map(labels), li.normal_form(F.col("languages"))).alias("lang"))
    samples = li.training_samples(labelled, inputs[1])
    assert set(samples) == {"en", "es", "fr", "de", "it", "pt", "nl", "ru"} and all(len(s) <= 30_000 for s in samples.values())
    model = li.LanguageModel(samples)
    documents = table(spark, "/root/testdata/sf0.01", "documents").where("lang in ('en','es','fr','de','it','pt','nl','ru') and length(text) > 200").select("text", "lang").collect()
    right = sum(max(model.segments(r.text), key=lambda s: s[1], default=("", 0, 0))[0] == r.lang for r in documents)
    assert right / len(documents) > 0.75  # labels of lists, tables and junk mean nothing, and some others are wrong


def test_long_and_odd_texts():
    model = li.LanguageModel({"en": li.clean(EN), "fr": li.clean(FR)})
    assert model.segments("") == [] and model.segments("12 34 !!!") == [] and li.LanguageModel({}).segments(EN) == []
    assert model.segments((EN + " ") * 500)[0][0] == "en"


def test_places_of_segments(spark, inputs):
    """Runs cover the words of an element in order, and their places cut out text of one language."""
    mixed = f"<b>{EN}</b>\n{FR}\n\n{DE}"
    out = li.record_languages(spark.createDataFrame([("t1", [mixed, None, "", EN], ["English"]), ("t2", None, None)], "id string, descriptions array<string>, languages array<string>").unionByName(table(spark, "/root/testdata/sf0.01", "lshfakedata").select("id", "descriptions", "languages")), *inputs, runs=True)
    got = sorted(tuple(r) for r in out.where("id like 't_'").collect())
    assert [(r[1], r[4]) for r in got] == [(0, "en"), (0, "fr"), (0, "de"), (3, "en")]
    assert [mixed[r[2] : r[3]] for r in got[:3]] == [EN, FR, DE] and EN[got[3][2] : got[3][3]] == EN
    assert all(0.5 <= r[6] <= 1 for r in got)


@settings(max_examples=60, deadline=None)
@given(st.text("ab .;!\n\u00a0<", max_size=80))
def test_units_hold_every_word(text):
    places = li.cut(text)
    assert all(a < b for a, b in places) and all(p[1] <= q[0] for p, q in zip(places, places[1:]))
    assert "".join(text[a:b] for a, b in places).split() == [] or "".join("".join(text[a:b].split()) for a, b in places) == "".join(w for part in li._ENDS.split(text) for w in part.split())


def test_confidence_is_calibrated(spark, inputs):
    """On texts that neither the samples nor the calibration saw, runs of six words: what is said to be sure at p is right in about p of cases."""
    labels = li.label_map(inputs[0])
    labelled = inputs[2].select(F.col("description").alias("text"), F.try_element_at(li._as_map(labels), li.normal_form(F.col("languages"))).alias("lang"))
    held = {}
    model = li.LanguageModel(li.training_samples(labelled, inputs[1], letters=3_000, held_out=held))
    model.calibrate({k: v[::2] for k, v in held.items()})
    said, right = [], []
    for lang, texts in held.items():
        for text in texts[1::2]:
            run = " ".join(text.split()[6:12])
            found = max(model.segments(run), key=lambda s: s[1], default=None)
            if found:
                said.append(found[2])
                right.append(found[0] == lang)
    assert len(said) > 50 and abs(sum(said) / len(said) - sum(right) / len(right)) < 0.1


def test_large_tables_of_common_words_are_refused(spark, inputs):
    with pytest.raises(ValueError, match="common words"):
        li.training_samples(inputs[2].selectExpr("description text", "'en' lang"), inputs[1], most=5)
