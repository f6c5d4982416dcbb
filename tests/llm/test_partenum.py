import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from foliant.llm import partenum as pe
from foliant.llm.classes import expand, link_counts
from foliant.session import table

SCHEMA = "id string, title string, descriptions array<string>, class string, features string, n int"


def pairs_of(text):
    words = re.findall(r"[^\W_]+", text.lower())
    return set(zip(words, words[1:]))


def brute(rows, threshold=0.6, least=20):
    sets = {}
    for i, title, parts, *_ in rows:
        if i is not None:
            s = pairs_of((title or "") + " " + " ".join(p for p in parts or [] if p is not None))
            if len(s) >= least:
                sets[i] = s
    ids = sorted(sets)
    return {(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]) - 1e-12}


def found(spark, rows, **settings):
    df = spark.createDataFrame(rows, SCHEMA)
    out = expand(*pe.near_duplicates(df, **settings)).collect()
    got = {(r.id_a, r.id_b) for r in out}
    assert len(got) == len(out)
    return got


def words(rng, n, vocabulary=400):
    return [f"w{rng.integers(vocabulary)}" for _ in range(n)]


def test_edited_copies_against_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = []
    for base in range(25):
        text = words(rng, int(rng.integers(15, 150)))
        for copy in range(4):
            edited = list(text)
            for _ in range(int(rng.integers(0, max(2, len(text) // 4)))):
                at, kind = int(rng.integers(len(edited))), rng.integers(3)
                edited[at : at + 1] = [[f"n{rng.integers(50)}"], [], [edited[at], "extra"]][kind]
            rows.append((f"r{base:02}{copy}", "Title one", [" ".join(edited)], None, None, None))
    want = brute(rows)
    assert len(want) > 20
    assert found(spark, rows) == want


def test_tables_against_brute_force(spark):
    rows = [(*r, None, None, None) for r in table(spark, "/root/testdata/sf0.01", "lshfakedata").select("id", "title", "descriptions").dropDuplicates(["id"]).collect()]
    want = brute(rows)
    assert want and found(spark, rows) == want


def test_defined_results(spark):
    text = "this is a rather long sentence of more than twenty words so that it counts as a record of its own in this small test of odd rows"
    rows = [
        ("a", None, [text], "x", "y", 1), ("a", None, [text], "x", "y", 2), ("b", text, None, None, None, None), ("c", "", [None, text, None], None, None, None),
        ("d", "short", ["text"], None, None, None), ("e", None, None, None, None, None), ("f", None, [], None, None, None), (None, None, [text], None, None, None),
        ("g", " ".join(f"Wört{i}" for i in range(20_000)), [text], None, None, None), ("h", None, [text.upper() + "!!!"], None, None, None),
    ]
    assert found(spark, rows) == {(x, y) for x in "abch" for y in "abch" if x < y}
    assert found(spark, rows[:0]) == set()
    df = spark.createDataFrame(rows, SCHEMA)
    counts = {r.id: (r.n_copies, r.n_links) for r in link_counts(*pe.near_duplicates(df)).collect()}
    assert counts["a"] == (3, 0) and "d" not in counts


def test_a_third_of_rows_alike(spark):
    rng = np.random.default_rng(5)
    base = words(rng, 60)
    rows = [(f"h{i:03}", None, [" ".join(base + ["tail"] * (i % 3))], None, None, None) for i in range(60)] + [(f"o{i:03}", None, [" ".join(words(rng, 60))], None, None, None) for i in range(120)]
    assert found(spark, rows) == brute(rows)


@settings(max_examples=80, deadline=None)
@given(st.data())
def test_similar_sets_share_a_signature_under_any_choice_of_groups(data):
    a = data.draw(st.lists(st.integers(0, 10**6), min_size=20, max_size=60, unique=True))
    keep = data.draw(st.integers(int(np.ceil(0.8 * len(a))), len(a)))
    b = a[:keep] + data.draw(st.lists(st.integers(2 * 10**6, 3 * 10**6), max_size=max(0, int(keep / 0.6) - len(a)), unique=True))
    union = len(set(a) | set(b))
    if keep < 0.6 * union or len(b) < 20:
        return
    signer = pe.Signer(0.6, None, 10)
    small, large = sorted((np.array(sorted(a)), np.array(sorted(b))), key=len)
    met = 0
    for number, (low, high) in enumerate(pe.bands(20, signer.ratio, len(large))):
        if low <= len(large) <= high:
            met += 1
            need, groups = int(signer.need(np.array([len(small)]), low, high)[0]), signer.groups(high)
            assert 0 < need <= groups - pe.EXTRA
            every = pe.Signer(0.6, None, 10)
            every.need = lambda own, *_: np.full(len(own), groups)  # probe all groups, to see in how many they meet
            index, probe = set(every.sign([large], low, high, number, False)[0].tolist()), every.sign([small], low, high, number, True)[0]
            assert sum(k in index for k in probe.tolist()) > groups - need
    assert met == 1


@settings(max_examples=200, deadline=None)
@given(st.integers(20, 300), st.integers(0, 60), st.integers(0, 200), st.integers(0, 30))
def test_bound_on_groups_that_differ(small, own, other, dropped):
    """Whatever the sizes, ``need`` exceeds the groups that the differences can spoil."""
    shared = small - own
    large = shared + other
    if shared < 0 or large < small or shared < 0.6 * (small + other) or dropped > own:
        return
    signer = pe.Signer(0.6, None, 10)
    for low, high in pe.bands(20, signer.ratio, large):
        if low <= large <= high:
            assert int(signer.need(np.array([small]), low, high, np.array([dropped]))[0]) > own - dropped + other // 2


def test_no_join_broadcasts_a_table_that_grows(spark):
    """The planner takes signatures and exploded keys for small; no plan may rely on that."""
    rows = [(f"r{i}", None, [" ".join(f"w{i}x{j % 40}" for j in range(30))], None, None, None) for i in range(50)]
    members, links = pe.near_duplicates(spark.createDataFrame(rows, SCHEMA))
    for df in (links, expand(members, links), link_counts(members, links)):
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()


@settings(max_examples=50, deadline=None)
@given(st.sets(st.integers(-(2**63), 2**63 - 1), max_size=80), st.sets(st.integers(-(2**63), 2**63 - 1), max_size=80))
def test_parity_never_exceeds_the_difference(a, b):
    p = pe.parity([np.array(sorted(a), np.int64), np.array(sorted(b), np.int64)]).view(np.uint64)
    assert int(np.bitwise_count(p[0] ^ p[1]).sum()) <= len(a ^ b)


@pytest.mark.parametrize("words_each", [1, 2, 5])
def test_shingles_of_any_length(spark, words_each):
    text = spark.createDataFrame([("One two, two THREE four two two",), ("",), (None,), ("one",)], "t string")
    sizes = [r[0] for r in text.select(pe.F.size(pe.shingles(pe.F.col("t"), words_each))).collect()]
    w = ["one", "two", "two", "three", "four", "two", "two"]
    assert sizes[0] == len({tuple(w[i : i + words_each]) for i in range(len(w) - words_each + 1)})
    assert sizes[1] in (0, -1) and sizes[3] == (1 if words_each == 1 else 0)
