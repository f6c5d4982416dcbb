import numpy as np
import pytest

from foliant.llm import quality as q
from foliant.session import table

PROSE = "When the market disappears from the village, only a young baker seems to care about it. She has never seen the sea, and yet she knows what it is for. " * 3
LIST = "\n".join(f"- The {a} Compass" for a in ("Old", "New", "Lost", "Pale", "Grey", "Cold", "Bright", "Quiet", "Narrow"))
TABLE = "\n".join(f"{i}\t{i * 3.5}\t{i + 100}\t{i * 7}" for i in range(12))
JUNK = "buy books online cheap " * 30
ALIKE = "Когда пустой дом исчезает, только она решается найти то, что было в нём до войны и после неё. Никто не знает, почему это так."


@pytest.fixture(scope="module")
def common(spark, sf):
    return q.common_words(table(spark, sf, "stopwords"))


@pytest.fixture(scope="module")
def model(spark, common):
    return q.fit(table(spark, "/root/testdata/sf0.01", "documents"), common)


def shares(spark, model, common, texts):
    df = spark.createDataFrame([(i, t, "x", 1.0) for i, t in enumerate(texts)], "doc_id bigint, text string, words string, junk double")
    return {r.doc_id: r for r in q.text_quality(df, model, common).collect()}


def test_kinds_of_text(spark, model, common):
    got = shares(spark, model, common, [PROSE, LIST, TABLE, JUNK, ALIKE, PROSE + "\n" + LIST, PROSE.upper(), PROSE.lower().replace(".", "").replace(",", ""), "}{}@$? =\\} $+@|={ -]$&& " * 9])
    prose = [got[i].prose > 0.5 for i in range(9)]
    assert prose == [True, False, False, False, True, True, True, True, False]
    assert got[1].list > 0.9 and got[2].table > 0.9 and got[3].junk > 0.9 and 0 < got[5].list < 0.5


def test_statistics_by_hand(spark, model, common):
    r = shares(spark, model, common, ["The cat sat.\nNo end: 42"])[0]
    assert (r.words, r.lines, r.chars) == (6, 2, 22)
    assert r.mean_word_length == pytest.approx((3 + 3 + 3 + 2 + 3 + 2) / 6)
    assert r.symbol_ratio == pytest.approx(2 / 22) and r.punctuated_lines == 0.5
    assert r.prose + r.list + r.table + r.junk == pytest.approx(1)


def test_defined_results(spark, model, common):
    got = shares(spark, model, common, [None, "", " \n\t ", "<p></p>", "word " * 30_000, "\x00", "a" * 100_000])
    for i in (0, 1, 2):
        assert got[i].words == got[i].lines == got[i].chars == 0 and got[i].prose is None and got[i].symbol_ratio is None
    assert got[4].words == 30_000 and got[6].junk == 1.0
    df = spark.createDataFrame([(1, PROSE), (1, PROSE)], "doc_id bigint, text string")
    assert q.text_quality(df, model, common).count() == 2
    assert q.text_quality(df.limit(0), model, common).count() == 0


def test_fit_without_rows(spark, common):
    empty = spark.createDataFrame([(1, None)], "doc_id bigint, text string")
    m = q.fit(empty, common)
    assert np.allclose(m.move.sum(1), 1) and np.isclose(m.start.sum(), 1)


def test_posteriors_equal_brute_force():
    rng = np.random.default_rng(0)
    n = len(q.LABEL_OF)
    m = q.LineModel(rng.dirichlet(np.ones(n)), rng.dirichlet(np.ones(n), n), tuple(rng.dirichlet(np.ones(s), n) for s in q.SIZES))
    codes = np.stack([rng.integers(0, s, 9) for s in q.SIZES], 1).astype(np.int8)
    starts = np.array([0, 4, 4, 6, 9])
    post, moves = m.posterior(codes, starts)
    like = m.likelihood(codes)
    want, seen = np.zeros_like(post), 0
    for a, b in zip(starts, starts[1:]):
        for path in np.ndindex(*(n,) * (b - a)):
            p = 1.0
            for i, s in enumerate(path):
                p *= like[a + i, s] * (m.start[s] if i == 0 else m.move[path[i - 1], s])
            for i, s in enumerate(path):
                want[a + i, s] += p
        seen += max(0, b - a - 1)
    assert np.allclose(post, want / want.sum(1, keepdims=True)) and np.isclose(moves.sum(), seen)


def test_long_lines_lose_no_words():
    text = "One sentence ends here. Another one? \"Yes!\" " * 40
    assert " ".join(q.units(text)).split() == text.replace('" ', " ").split() or "".join(" ".join(q.units(text)).split()).replace('"', "") == "".join(text.split()).replace('"', "")


def test_rules_serve_for_fitting_only(model, common, monkeypatch):
    """Lines are labelled without them, and natural prose that looks odd stays prose: long without marks, with numbers, with stray marks."""
    monkeypatch.setattr(q, "seed", None)
    odd = [
        "a new novel about the letter is expected next spring and when not writing the author likes to bury the letter and to read about the sea " * 2, "The debut was written in the winter of 1998 and it is about a man of 40 who has never seen the sea.",
        "It's slow, it's odd, and it made me <|endoftext|> think about the empire for days.", "click to read more " * 20, "pydrwetrd ad ougagyas wweeiliy rj i qqyfu up wuipjjjqft qkhpyy",
    ]
    codes, _, _, starts = q._analyse(odd, common)
    label = model.label(codes, starts)
    assert [set(label[a:b]) == {q.PROSE} for a, b in zip(starts, starts[1:])] == [True, True, True, False, False]


def test_long_documents_are_sampled_at_any_place(spark, common):
    """A table that follows hundreds of lines of prose can be in the sample."""
    rows = [(i, "\n".join([PROSE] * 300 + [TABLE] * 300)) for i in range(12)]
    m = q.fit(spark.createDataFrame(rows, "doc_id bigint, text string"), common, sample_lines=50)
    codes, _, _, starts = q._analyse([TABLE], common)
    assert set(m.label(codes, starts)) == {q.TABLE} and m.start[q.LABEL_OF == q.TABLE].sum() > 0.2
