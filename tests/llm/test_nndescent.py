import json

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from foliant.llm import nndescent as nd

SCHEMA = "bookid string, description_emb string, n int, vector string, id string, u bigint"


def brute(vectors, k=5, least=0.6):
    ids = sorted(vectors)
    m = np.stack([vectors[i] for i in ids])
    m = m / np.linalg.norm(m, axis=1, keepdims=True)
    c = np.round(m @ m.T, 6)
    out = set()
    for i, a in enumerate(ids):
        near = sorted((-c[i, j], b) for j, b in enumerate(ids) if j != i and c[i, j] >= least)[:k]
        out |= {(min(a, b), max(a, b)) for _, b in near}
    return out


def clusters(rng, groups, size, dimensions=64, noise=0.35):
    out = {}
    for g in range(groups):
        centre = rng.normal(size=dimensions)
        for i in range(int(rng.integers(1, size))):
            out[f"b{g:03}{i:03}"] = np.round(centre + noise * rng.normal(size=dimensions), 4)
    return out


def found(spark, rows, **settings):
    df = spark.createDataFrame(rows, SCHEMA)
    return {(r.bookid_a, r.bookid_b) for r in nd.neighbour_pairs(nd.neighbours(df, dimensions=64, **settings)).collect()}


def as_rows(vectors):
    return [(i, json.dumps(list(v)), 1, "x", "y", 2) for i, v in vectors.items()]


def test_recall_against_brute_force(spark):
    vectors = clusters(np.random.default_rng(0), 120, 16)
    want, got = brute(vectors), found(spark, as_rows(vectors))
    assert len(want & got) / len(want) >= 0.97 and len(want & got) / len(got) >= 0.99


def test_rounds_of_joins_improve_the_lists(spark):
    vectors = clusters(np.random.default_rng(1), 60, 24, noise=0.5)
    want = brute(vectors)
    recall = [len(want & found(spark, as_rows(vectors), tables=2, window=1, rounds=r)) / len(want) for r in (0, 3)]
    assert recall[1] > recall[0] + 0.1


def test_search_against_brute_force(spark):
    vectors = clusters(np.random.default_rng(2), 120, 16)
    df = spark.createDataFrame(as_rows(vectors), SCHEMA)
    asked = "cast(substring(id, 2) as bigint) % 20 = 0"
    got = {(r.id, r.neighbour) for r in nd.search_ids(df, asked, dimensions=64).collect()}
    ids = sorted(vectors)
    m = np.stack([vectors[i] for i in ids])
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    want = set()
    for i, a in enumerate(ids):
        if int(a[1:]) % 20 == 0:
            c = np.round(m @ m[i], 6)
            want |= {(a, b) for _, b in sorted((-c[j], b) for j, b in enumerate(ids) if j != i and c[j] >= 0.6)[:5]}
    assert want and len(want & got) / len(want) >= 0.95 and {a for a, _ in got} <= {a for a, _ in want}


def test_equal_vectors_and_ties(spark):
    rng = np.random.default_rng(4)
    base, other = rng.normal(size=64).round(3), rng.normal(size=64).round(3)
    vectors = {f"b{i:03}": base for i in range(200)} | {"c1": other, "c2": 2 * other, "c3": np.round(other + 0.01, 3)}
    assert found(spark, as_rows(vectors)) == brute(vectors)


@pytest.mark.parametrize(
    "cell",
    [None, "", " ", "null", "[]", "{}", "[1, 2", "[1, 2]", json.dumps([0.0] * 64), json.dumps([1.0] * 63), json.dumps([1.0] * 65), json.dumps(["1"] * 64), json.dumps([True] * 64), json.dumps([[1.0]] * 64), json.dumps([float("nan")] * 64), json.dumps([1e400] * 64), json.dumps([None] * 64), "[" * 100_000, json.dumps([1] * 63 + [10**400])],
)
def test_unusable_cells(cell):
    assert nd.read_vector(cell, 64) is None


def test_usable_cells_and_lossless_packing():
    for v in (np.arange(64.0), np.linspace(-1, 1, 64).round(4), np.linspace(-1, 1, 64).round(6), np.linspace(-1, 1, 64) / 3, np.full(64, 1e-300), np.full(64, 1e300)):
        assert np.array_equal(nd.read_vector(json.dumps(list(v)), 64), v)
        assert np.array_equal(nd.unpack_vector(nd.pack_vector(v)), v)
    assert nd.read_vector(" [1, 2.5e-1 , -3E0]\n", 3).tolist() == [1, 0.25, -3]


def test_defined_results(spark):
    v, w = [1.0] + [0.0] * 63, [1.0, 0.5] + [0.0] * 62
    rows = [("a", json.dumps(v), 1, "x", "y", 2), ("a", json.dumps(v), 1, "z", "y", 2), ("b", json.dumps(w), None, None, None, None), ("c", None, None, None, None, None), (None, json.dumps(v), None, None, None, None), ("d", "[1, 2", None, None, None, None)]
    assert found(spark, rows) == {("a", "b")}
    assert found(spark, rows[:0]) == set() and found(spark, rows[3:4]) == set()


@settings(max_examples=30, deadline=None)
@given(st.integers(2, 40), st.integers(0, 10**6))
def test_codes_estimate_angles(dimensions, seed):
    rng = np.random.default_rng(seed)
    a, b = rng.normal(size=(2, dimensions))
    h = int(np.bitwise_count(np.bitwise_xor(*nd.codes_of(np.stack([a, b])))).sum())
    cosine = a @ b / np.linalg.norm(a) / np.linalg.norm(b)
    assert abs(h - np.arccos(cosine) / np.pi * nd.BITS) < 6 * np.sqrt(nd.BITS * 0.25)
