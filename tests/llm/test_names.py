import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from foliant.llm import names as nm

SHORT = [("Ben", "Benedict"), ("Kate", "Katherine"), ("Dora", "Dorothea"), ("Nate", "Ignatius"), ("Jon", "Jonathan"), ("Vin", "Vincent")]


@pytest.fixture(scope="module")
def given_names():
    return nm.GivenNames(SHORT)


@pytest.mark.parametrize(
    ("name", "want"),
    [
        ("katherine drafecur", ("drafecur", "katherine", "k", "", "")), ("drafecur, kate", ("drafecur", "katherine", "k", "", "")), ("k. drafecur", ("drafecur", "", "k", "", "")),
        ("drafécur, k. m.", ("drafecur", "", "k", "m", "")), ("dr. katherine m. drafecur", ("drafecur", "katherine", "k", "m", "doctor")), ("katherine drafecur, ph.d.", ("drafecur", "katherine", "k", "", "")),
        ("by katherine drafecur", ("drafecur", "katherine", "k", "", "")), ("katherine von drafecur [ed.]", ("drafecur", "katherine", "k", "", "")), ("de la drafecur, k", ("drafecur", "", "k", "", "")),
        ("kahterine drafecur", ("drafecur", "katherine", "k", "", "")), ("captain drafecur", ("drafecur", "", "", "", "captain")), ("capt. kate drafecur", ("drafecur", "katherine", "k", "", "captain")),
        ("b.j. o'neil-smith", ("oneilsmith", "", "b", "j", "")),
    ],
)
def test_parsing(given_names, name, want):
    assert nm.parse(name, given_names) == want


@pytest.mark.parametrize("name", ["", " ", "narrator", "...", ",", "(author)", "dr.", "漢字"])
def test_no_full_names(given_names, name):
    assert nm.parse(name, given_names) is None


def lcs_by_table(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], before + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


@given(st.text("abcd", max_size=70), st.text("abcd", max_size=70))
def test_common_subsequence_against_the_table(a, b):
    assert nm.common_letters(a, b) == lcs_by_table(a, b)
    assert nm.lcs_ratio(a, b) == (2 * lcs_by_table(a, b) / (len(a) + len(b)) if a and b else 0)


@given(st.text("abcdefgh", min_size=5, max_size=12), st.data())
def test_one_slip_is_alike(word, data):
    slip = data.draw(st.sampled_from(sorted(nm.slips(word))))
    assert nm.alike(word, slip) == (nm.lcs_ratio(word, slip) >= 0.8)


def test_ratio():
    assert nm.lcs_ratio("drafecur", "drafecer") == 14 / 16 and nm.lcs_ratio("", "x") == 0 and nm.lcs_ratio("abc", "abc") == 1
    assert nm.alike("dostoyevsky", "dostoevskij") and not nm.alike("loskefraquist", "noskecaquist") and not nm.alike("skofujoquist", "skajofoquist")


@given(st.text("abcij", min_size=1, max_size=7))
@settings(max_examples=25, deadline=None)
def test_letters_left_out(spark, word):
    one = {word[:i] + word[i + 1 :] for i in range(len(word))}
    row = spark.range(1).select(nm.letters_left_out(nm.F.lit(word)).alias("one"), nm._consonants(nm.F.lit(word)).alias("consonants")).first()
    assert set(row.one) == one | {word} and len(row.one) == len(set(row.one)) and row.consonants == nm.consonants(word)


def frame(spark, authors, characters=()):
    rows = [(a, None, 1) for a in authors] + [(None, list(c), 2) for c in characters]
    return spark.createDataFrame(rows, "author string, characters array<string>, name int"), spark.createDataFrame(SHORT, "short_name string, given_name string")


def test_persons(spark):
    one = ["Katherine Drafecur", "KATE  Drafecur", "Drafecur, K.", "Dr. Katherine Maria Drafecur", "Katherine Drafecru", "Kahterine Drafecur", "Katherine Dráfecur"]
    other = ["Benedict Drafecur", "Ben Drafecur", "B. Drafecur"]
    odd = [None, "", "  ", "Unknown", "Various Authors", "Katherine Drafecur", "x" * 5_000]
    df, short = frame(spark, one + other + odd, [[None, "", "Captain Vin Holmest", "Capt. Holmest", "Vincent Holmest"], [], None or ["Vincent Holmest"]])
    got = {(r.field, r.name_a, r.name_b) for r in nm.variant_pairs(nm.variants(df, short)).collect()}
    norm = lambda names: sorted({" ".join(n.lower().split()) for n in names})
    want = {("author", a, b) for group in (norm(one), norm(other)) for a in group for b in group if a < b}
    cast = norm(["Captain Vin Holmest", "Capt. Holmest", "Vincent Holmest"])
    want |= {("characters", a, b) for a in cast for b in cast if a < b}
    assert got == want
    assert nm.variants(df.limit(0), short).count() == 0


def test_common_suffixes_still_meet(spark):
    names = [f"Katherine {a}{b}quist" for a in ("Dra", "Bre", "Klo", "Stu", "Pli") for b in ("fen", "gal", "mor", "rus", "zit", "hop", "pab", "dyx", "wec", "kuv")]
    slip = "Katherine Drfaenquist"
    df, short = frame(spark, [*names, slip])
    assert {(r.name_a, r.name_b) for r in nm.variant_pairs(nm.variants(df, short)).collect()} == {("katherine drafenquist", "katherine drfaenquist")}
    words = ["drafequist", "drfaequist", *(f"{c}{d}quist" for c in "abcdefgh" for d in "pqrstuv")]
    units = spark.createDataFrame([(f"author|{w}|k", "author", w, "k") for w in words], "unit string, field string, surname string, initial string")
    assert ("author|drafequist|k", "author|drfaequist|k", False) in {tuple(r) for r in nm.similar_surnames(units, common=5).collect()}


def linked(spark, names):
    df, short = frame(spark, [], [names])
    return {(r.name_a, r.name_b) for r in nm.variant_pairs(nm.variants(df, short)).collect()}


def test_a_crowd_loses_no_link(spark):
    """A title with a misspelled surname finds its person among any number of names that begin alike, with or without an initial."""
    pair = ["Captain Katherine Drafenquist", "Captain Drafenqist"]
    want = {("captain drafenqist", "captain katherine drafenquist")}
    assert linked(spark, pair) == want
    ends = [f"{a}o{b}u{b}{a}" for a in "bcdfghklm" for b in "prstvzxn"]
    for first in ("Katherine", "Vincent", "K."):
        crowd = [f"{first} Drafenq{end}" for end in ends]
        assert len(crowd) == 72 and linked(spark, pair + crowd) == want


def test_transliterations(spark):
    assert linked(spark, ["Fyodor Dostoyevsky", "Fyodor Dostoevskij", "Vincent Dostoevskij"]) == {("fyodor dostoevskij", "fyodor dostoyevsky")}


def test_given_names_of_one_surname_stay_apart(spark):
    """A surname that hundreds share: only spellings of one given name are linked, and an initial joins those it fits."""
    letters = "abcdefghijklmnop"
    names = [f"{c}{d}w{c}{d}o Smithson" for c in letters for d in letters]
    got = linked(spark, [*names, "Abwabo Smithsonn", "Z. Smithson", "Captain Smithson"])
    assert got == {("abwabo smithson", "abwabo smithsonn")}


def test_no_join_broadcasts_a_table_that_grows(spark):
    units = spark.createDataFrame([(f"author|drafen{c}{d}|k", "author", f"drafen{c}{d}", "k") for c in "abcd" for d in "efgh"], "unit string, field string, surname string, initial string")
    assert "Broadcast" not in nm.similar_surnames(units, common=3)._jdf.queryExecution().executedPlan().toString()


def test_components(spark):
    links = spark.createDataFrame([(f"n{i:02}", f"n{i + 1:02}") for i in range(12)] + [("x", "y")], "a string, b string")
    got = {r.form: r.person for r in nm.components(links).collect()}
    assert set(got.values()) == {"n00", "x"} and got["n12"] == "n00" and got["y"] == "x"


def test_components_of_a_long_chain_and_a_star(spark):
    links = spark.createDataFrame([(f"n{i:03}", f"n{i + 1:03}") for i in range(0, 150)] + [("s000", f"s{i:03}") for i in range(1, 200)], "a string, b string")
    got = {r.form: r.person for r in nm.components(links).collect()}
    assert len(got) == 351 and set(got.values()) == {"n000", "s000"} and all(k[0] == v[0] for k, v in got.items())
    assert nm.components(links.limit(0)).count() == 0
