from itertools import combinations

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from foliant.llm import overlap as ov
from foliant.llm.classes import expand
from foliant.session import table

SCHEMA = "id string, characters array<string>, genres array<string>, class string, key bigint, n int"


def normal(values):
    return frozenset(y for y in (" ".join(x.lower().split()) for x in values or [] if x is not None) if y)


def brute(rows, ta=0.6, tb=0.5):
    sets = {i: (normal(c), normal(g)) for i, c, g, *_ in rows if i is not None}
    ids = sorted(i for i, s in sets.items() if s[0] and s[1])
    near = lambda x, y, t: len(x & y) >= t * len(x | y) - 1e-12
    return {(a, b) for a, b in combinations(ids, 2) if near(sets[a][0], sets[b][0], ta) and near(sets[a][1], sets[b][1], tb)}


def found(spark, rows, hot=None):
    df = spark.createDataFrame(rows, SCHEMA)
    if hot is None:
        out = expand(*ov.similar_value_sets(df)).collect()
    else:
        sets = df.select("id", ov.hashed_set("characters").alias("set_a"), ov.hashed_set("genres").alias("set_b"))
        members, classes = ov.fold(sets, ["set_a", "set_b"])
        keep = classes.where("size(set_a) > 0 and size(set_b) > 0")
        out = expand(members.join(keep.select("class"), "class", "left_semi").select("id", "class"), ov.similar_records(keep, 0.6, 0.5, hot=hot)).collect()
    got = {(r.id_a, r.id_b) for r in out}
    assert len(got) == len(out)
    return got


def make(rng, n, most_a=20, most_b=14, pool=30):
    return [(f"r{i:04}", [f"v{x}" for x in rng.integers(0, pool, rng.integers(0, most_a))], [f"g{x}" for x in rng.integers(0, 18, rng.integers(0, most_b))], None, None, None) for i in range(n)]


def test_small_and_large_sets_against_brute_force(spark):
    rng = np.random.default_rng(1)
    rows = make(rng, 120)
    for i in range(120):  # neighbours of each
        a, g = list(rows[i][1]), list(rows[i][2])
        if a:
            a[0] = f"v{rng.integers(30)}"
        rows.append((f"s{i:04}", a, g[: max(1, len(g) - 1)], None, None, None))
    want = brute(rows)
    assert len(want) > 50
    assert found(spark, rows) == want
    assert found(spark, rows, hot=2) == want


def test_one_popular_value(spark):
    rng = np.random.default_rng(2)
    rows = [(f"p{i:04}", ["Everyone"], [f"g{x}" for x in rng.integers(0, 40, 6)], None, None, None) for i in range(300)] + make(rng, 100)
    assert found(spark, rows, hot=16) == brute(rows)


def test_tables_against_brute_force(spark):
    rows = [(*r, None, None, None) for r in table(spark, "/root/testdata/sf0.01", "lshfakedata").select("id", "characters", "genres").dropDuplicates(["id"]).collect()]
    want = brute(rows)
    assert want and found(spark, rows) == want


def test_defined_results(spark):
    rows = [
        ("a", [" Ann  Lee ", "ann lee", None, ""], ["Crime"], "c", 1, 2), ("a", [" Ann  Lee ", "ann lee", None, ""], ["Crime"], "c", 1, 3), ("b", ["ANN LEE"], ["crime", " "], None, None, None),
        ("c", [], ["Crime"], None, None, None), ("d", None, ["Crime"], None, None, None), ("e", ["Ann Lee"], None, None, None, None), ("f", ["Ann Lee"], [None, "  "], None, None, None),
        (None, ["Ann Lee"], ["Crime"], None, None, None), ("g", [f"long {i}" for i in range(3_000)], ["x"], None, None, None), ("h", [f"long {i}" for i in range(2_990)], ["x"], None, None, None),
    ]
    assert found(spark, rows) == {("a", "b"), ("g", "h")}
    assert found(spark, rows[:0]) == set()


@settings(max_examples=100, deadline=None)
@given(st.sets(st.integers(0, 40), min_size=1, max_size=14), st.sets(st.integers(0, 40), min_size=1, max_size=14), st.sampled_from([0.5, 0.6, 0.8]))
def test_similar_sets_share_a_key(a, b, t):
    if len(a & b) < t * len(a | b):
        return
    (sa, la), (sb, lb) = ov.set_keys(sorted(a), None, t), ov.set_keys(sorted(b), None, t)
    if max(len(a), len(b)) <= ov.SMALL:
        assert set(sa) & set(sb)
    else:
        assert set(la) & set(lb)
