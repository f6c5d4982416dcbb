import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from foliant.llm import tokenizer as tk
from foliant.session import table

ODD = ["", " ", "\n\n\t ", "<|endoftext|>", "a" * 20_000, "é" * 3_000, "שלום 👩‍🚀 漢字  ﻿", "it's we'LL 've", "x\x00y", "1234567890" * 50, "  two  blanks   end  ", "́̂combining", "\r\nline\r\n"]


@pytest.fixture(scope="module")
def reference():
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(f"{tk.TOKENIZER_DIR}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", ODD)
def test_odd_texts_as_the_library_has_them(reference, text):
    assert tk.machine().encode(text) == reference(text)


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_any_text_as_the_library_has_it_and_back(reference, text):
    ids = tk.machine().encode(text)
    assert ids == reference(text)
    assert "".join(tk.decode_stream(ids, tk.machine().bytes_of)) == text


def test_small_memories_change_nothing():
    small = tk.Transducer(tk.read_ranks(f"{tk.TOKENIZER_DIR}/{tk.BYTE_BPE}"), states_kept=50, words_kept=5)
    for text in ODD + ["The quick brown fox jumps over the lazy dog, antidisestablishmentarianism!"]:
        assert small.encode(text) == tk.machine().encode(text)


def test_transducer_equals_the_merges_by_definition():
    m = tk.machine()
    for word in (b" unbelievable", b"lllllllll", b"\xff\xfe\x80", b"aAaAaAaA", "naïveté".encode()):
        assert list(m.encode_word(word)) == m.merge(word)


def test_output_lags_less_than_the_longest_token():
    m = tk.machine()
    longest = max(map(len, m.ranks))
    assert all(sum(len(m.bytes_of[t]) for t in tokens) <= longest for _, threads in m.states for tokens, _ in threads)


def test_decoding_of_broken_bytes():
    s = tk.Utf8Stream()
    assert s.feed(b"\xe2\x82") == "" and s.feed(b"\xac!") == "€!" and s.feed(b"\xe2(") == "�(" and s.feed(b"\xf0\x9f") == "" and s.close() == "�"


def test_frame(spark, reference):
    rows = [(i, t, "x", i) for i, t in enumerate([*ODD, None])] + [(0, "again", None, None), (None, "no id", None, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids string, n bigint")
    out = tk.encode_texts(df)
    assert out.columns == ["doc_id", "ids"] and dict(out.dtypes)["ids"] == "array<int>"
    got = [(r.doc_id, list(r.ids)) for r in out.collect()]
    assert sorted(got, key=str) == sorted([(r[0], reference(r[1]) if r[1] else []) for r in rows], key=str)
    assert tk.encode_texts(df.limit(0)).count() == 0
    back = {(r.doc_id, r.text) for r in tk.decode_texts(out).collect()}
    assert back == {(r[0], r[1] or "") for r in rows}
    assert tk.decode_texts(spark.createDataFrame([(1, None)], "doc_id bigint, ids array<int>")).first().text is None


def test_whole_documents(spark, sf, reference):
    rows = tk.encode_texts(table(spark, sf, "documents")).join(table(spark, sf, "documents").select("doc_id", "text"), "doc_id").collect()
    assert len(rows) == 100
    assert all(list(r.ids) == (reference(r.text) if r.text else []) for r in rows)


def test_counts(spark):
    df = spark.createDataFrame([([1, 2],), ([],), (None,)], "ids array<int>")
    assert [r[0] for r in df.select(tk.token_count(F.col("ids"))).collect()] == [2, 0, 0]
