import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from foliant.llm import packing, tokenizer
from foliant.session import table


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 50), st.integers(0, 50)), max_size=60))
def test_blocks_keep_all_limits(items):
    tokens = np.array([t for t, _ in items], int)
    loss = np.minimum(np.array([x for _, x in items], int), tokens) if items else np.zeros(0, int)
    loss = np.minimum(loss, 40)
    slot = packing.pack_block(tokens, loss, 50, 4, 40)
    assert len(slot) == len(items)
    for s in set(slot):
        at = slot == s
        assert tokens[at].sum() <= 50 and at.sum() <= 4 and loss[at].sum() <= 40


def test_loss_limit_is_a_dimension_of_its_own():
    slot = packing.pack_block(np.full(8, 10), np.full(8, 10), 100, 100, 20)
    assert np.bincount(slot).tolist() == [2, 2, 2, 2]


def check(rows, sizes, capacity, segments):
    by = {}
    for r in rows:
        if r.container is None:
            assert r.tokens == 0
            continue
        by.setdefault(r.container, []).append(r)
    for items in by.values():
        assert sum(r.tokens for r in items) <= capacity and len(items) <= segments
        assert sorted(r.position for r in items) == list(range(len(items)))
    whole = {}
    for r in rows:
        whole.setdefault(r.doc_id, []).append(r)
    for doc, parts in whole.items():
        if len(set(sizes[doc])) == 1 and len(sizes[doc]) == 1:
            size = sizes[doc][0]
            assert sum(p.tokens for p in parts) == size
            assert len(parts) == max(1, -(-size // capacity))
    return by


def test_frame_with_odd_rows(spark):
    texts = [None, "", "  ", "one", "two words", "head\nbody of the text", "long " * 700, "long " * 64, None]
    rows = [(i, t, 1, "c") for i, t in enumerate(texts)] + [(3, "one", 2, "c")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, tokens int, container string")
    out = packing.pack_texts(df, capacity=64, segments=4, block=4)
    got = out.collect()
    m = tokenizer.machine()
    sizes = {}
    for i, t, *_ in rows:
        sizes.setdefault(i, []).append(len(m.encode(t)))
    check(got, sizes, 64, 4)
    assert sum(r.tokens for r in got) == sum(map(sum, sizes.values()))
    assert {r.doc_id for r in got if r.container is None} == {0, 1, 8}
    head = next(r for r in got if r.doc_id == 5)
    assert head.loss == head.tokens - len(m.encode("head"))
    cut = sorted((r for r in got if r.doc_id == 6), key=lambda r: r.piece)
    assert [r.first_token for r in cut] == [64 * i for i in range(len(cut))]
    assert packing.pack_texts(df.limit(0)).count() == 0


def test_whole_documents_leave_little_room(spark, sf):
    df = table(spark, "/root/testdata/sf0.01", "documents")
    out = packing.pack_texts(df, block=256).where("container is not null")
    fill = out.groupBy("container").agg(F.sum("tokens").alias("t"))
    n, total, most = fill.agg(F.count("*"), F.sum("t"), F.max("t")).first()
    assert most <= packing.CAPACITY and total / (n * packing.CAPACITY) > 0.97
    assert out.groupBy("container").count().agg(F.max("count")).first()[0] <= packing.SEGMENTS


def test_a_limit_on_loss_cuts_nothing_below_the_capacity(spark):
    """Containers of several pieces keep all three limits; a piece beyond the limit on loss stands alone and whole."""
    texts = ["word " * n for n in (5, 9, 12, 20, 31, 40, 55, 60, 63, 70, 150)] + ["head " * 30 + "\nbody " * 10] * 4
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = packing.pack_texts(df, capacity=64, segments=3, loss_limit=40).collect()
    m = tokenizer.machine()
    by = check(got, {i: [len(m.encode(t))] for i, t in enumerate(texts)}, 64, 3)
    for items in by.values():
        assert sum(r.loss for r in items) <= 40 or len(items) == 1
    assert any(len(items) == 1 and items[0].loss > 40 for items in by.values())
    row = packing.fill(spark.createDataFrame(got), 64, 3, 40).first()
    assert row.containers == len(by) and row.tokens == sum(r.tokens for r in got) and 0 < row.segments_full <= 1 and row.tokens_full == row.tokens / (64 * len(by))
    assert packing.fill(packing.pack_texts(df.limit(0)), 64).first().containers == 0


def first_fit_decreasing(tokens, loss, capacity, segments, loss_limit):
    """Containers needed by the plainest heuristic that keeps the same limits."""
    left = []
    for t, x in sorted(zip(tokens.tolist(), loss.tolist()), reverse=True):
        for c in left:
            if c[0] >= t and c[1] >= 1 and c[2] >= x:
                break
        else:
            left.append(c := [capacity, segments, loss_limit])
        c[0], c[1], c[2] = c[0] - t, c[1] - 1, c[2] - x
    return len(left)


def test_no_more_containers_than_first_fit_decreasing():
    """Where all three limits bind, the dot product needs at most as many containers, within one in fifty."""
    rng = np.random.default_rng(4)
    for loss_share in (0.3, 0.6, 1.0):
        tokens = np.minimum(2_000, rng.lognormal(5, 1.1, 1_500).astype(int) + 1)
        loss = np.minimum((tokens * rng.uniform(0, 2 * loss_share, len(tokens))).astype(int), np.minimum(tokens, 1_200))
        ours = packing.pack_block(tokens, loss, 2_048, 12, 1_200).max() + 1
        assert ours <= 1.02 * first_fit_decreasing(tokens, loss, 2_048, 12, 1_200)
