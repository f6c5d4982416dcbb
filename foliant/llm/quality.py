"""Text quality statistics per document, with lines labelled by a hidden Markov model.

Every line (a long line: every sentence-like stretch of it) is described by a
few categorical features. A hidden Markov model over the lines of a document has
the states prose, list, table and junk; a feature's values are independent given
the state. It is fitted by expectation-maximisation on a bounded sample of
documents, with lines of which plain rules are sure held at their label; each
document's lines are then labelled by their posterior.

Defined results: null, empty and blank texts have no lines; their counts are 0,
their shares null, and they are never found. Repeated rows stay one to one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LABELS = ("prose", "list", "table", "junk")
PROSE, LIST, TABLE, JUNK = range(4)
#: The label of each state: sentences, bullets, runs of items, tables, repetitions, garbled lines, markup, text decoded wrongly, prose with numbers, prose without an end, rows of numbers.
LABEL_OF = np.array([PROSE, LIST, LIST, TABLE, JUNK, JUNK, JUNK, JUNK, PROSE, PROSE, TABLE])

#: Sizes of the categorical features, in the order of ``line_codes``.
SIZES = (5, 5, 4, 4, 3, 2, 3, 3, 3, 2, 3, 2, 2)
_NW, _COMMON, _TITLE, _DIGIT, _DELIM, _END, _BULLET, _LETTER, _REPEAT, _LONG, _TAG, _ITEMS, _WRONG = range(13)

_TAGS = re.compile(r"</?[a-zA-Z!][^<>]*>")
_BULLETS = re.compile(r"\s*(?:[-*•·–—▪‣]\s|\(?\d{1,3}[.)]\s)").match
_KEYS = re.compile(r"\s*[^\W\d]{2,14}(?: ?[:=]\s| [-–—] )").match
_ITEM_MARKS = re.compile(r"[,;*•|]\s|\s[-–—]\s").findall
_LATIN1 = re.compile("[\x80-\xff]").findall
_GAPS = re.compile(r"\S( {2,})(?=\S)")
_SENTENCES = re.compile(r"(?<=[.!?…])[\"'”’»)]*\s+")
_ENDS = frozenset(".!?…\"”’»)")
_STRIP = " \t\r\n.,;:!?…\"'“”‘’«»()[]{}¿¡-–—*"


def units(text: str, long_line: int = 400) -> list[str]:
    """Non-blank lines; lines over ``long_line`` characters fall apart at ends of sentences. No character of a word is lost."""
    out: list[str] = []
    for line in text.splitlines():
        if len(line) > long_line:
            out += (s for s in _SENTENCES.split(line) if s and not s.isspace())
        elif line and not line.isspace():
            out.append(line)
    return out


def line_codes(line: str, common: frozenset[str]) -> tuple[tuple[int, ...], tuple[int, int, int, int, int]]:
    """Feature values of a line, and its words, letters in words, common words, symbols and sentence end."""
    text = line
    tag = 0
    if "<" in line and (tags := _TAGS.findall(line)):
        text = _TAGS.sub(" ", line)
        inside = sum(map(len, tags))
        tag = 2 if inside > 0.6 * len(line) else 1
    words = text.split()
    nw = len(words)
    solid = sum(map(len, words))
    if not nw:
        return (0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 2 if tag else 0, 0, 0), (0, 0, 0, len(line), 0)
    low = [w.strip(_STRIP) for w in text.lower().split()]
    n_common = sum(map(common.__contains__, low))
    letters = sum(map(str.isalpha, text))
    digits = sum(map(str.isdigit, text)) if letters < solid else 0
    initials = "".join([w[0] for w in words])
    alpha = sum(map(str.isalpha, initials))
    if text.isupper():
        title = 3 if nw > 1 else 0
    else:
        share = sum(map(str.isupper, initials)) / alpha if alpha else 0.0
        title = 0 if share < 0.35 else 1 if share < 0.6 else 2
    delims = text.count("\t") + text.count("|") + text.count(";") + text.count(" / ")
    if "  " in text:
        gaps = len(_GAPS.findall(text))
        delims += gaps if gaps < 0.6 * (nw - 1) or digits > 0.3 * solid else 0
    if not delims and text.count(",") >= 2 and text.count(", ") < text.count(","):
        delims = text.count(",") - text.count(", ")
    c = n_common / nw
    d = digits / solid
    tail = text.rstrip()
    end = tail[-1] in _ENDS
    r = letters / solid
    distinct = len(set(zip(low, low[1:]))) / (nw - 1) if nw > 1 else 1.0  # of pairs: words come again in any long sentence
    wrong = int(not text.isascii() and len(_LATIN1(text)) > 0.4 * letters)  # as of texts decoded by a wrong table
    items = 0
    if nw >= 6 and not end:
        marks = len(_ITEM_MARKS(text))
        items = int(marks >= 4 and nw <= 3.5 * (marks + 1))
    codes = (
        0 if nw < 3 else 1 if nw < 6 else 2 if nw < 9 else 3 if nw < 15 else 4,
        0 if c == 0 else 1 if c < 0.12 else 2 if c < 0.22 else 3 if c < 0.35 else 4,
        title,
        0 if d == 0 else 1 if d < 0.14 else 2 if d < 0.3 else 3,
        0 if not delims else 1 if delims < 2 else 2,
        int(end),
        1 if _BULLETS(text) else 2 if _KEYS(text) else 0,
        0 if r < 0.5 else 1 if r < 0.78 else 2,
        0 if nw < 6 or distinct >= 0.7 else 1 if distinct >= 0.25 else 2,
        int(max(map(len, words)) > 35),
        tag,
        items,
        wrong,
    )
    return codes, (nw, sum(map(len, low)), n_common, solid - letters - digits, int(end))


def seed(codes: np.ndarray) -> np.ndarray:
    """The state of lines of which plain rules are sure, else -1; for fitting only."""
    f = codes.T
    out = np.full(len(codes), -1, np.int64)
    plain = (f[_BULLET] == 0) & (f[_TAG] < 2) & (f[_REPEAT] <= 1) & (f[_DIGIT] <= 1) & (f[_DELIM] < 2) & (f[_TITLE] != 2)
    worded = (f[_COMMON] >= 3) | (f[_COMMON] == 2) & (f[_END] == 1) | (f[_COMMON] == 1) & (f[_END] == 1) & (f[_LETTER] >= 1) & (f[_REPEAT] == 0)
    prose = plain & worded & (f[_NW] >= 1)
    out[prose] = 0
    out[prose & (f[_DIGIT] > 0)] = 8
    out[prose & (f[_END] == 0)] = 9
    bare = (f[_END] == 0) & (f[_DELIM] < 2) & (f[_TAG] < 2)
    out[bare & ((f[_BULLET] == 1) & (f[_NW] <= 3) | (f[_BULLET] == 2) & (f[_NW] <= 2))] = 1
    out[bare & (f[_BULLET] == 0) & (f[_DIGIT] == 0) & (f[_LETTER] == 2) & (f[_LONG] == 0) & ((f[_NW] <= 1) | (f[_NW] == 2) & (f[_TITLE] == 2))] = 1
    out[(f[_ITEMS] == 1) & (f[_LETTER] == 2) & (f[_DIGIT] <= 1) & (f[_REPEAT] == 0)] = 2
    out[(f[_DELIM] == 2) & (f[_COMMON] <= 2) & (f[_BULLET] == 0) | (f[_DELIM] > 0) & (f[_DIGIT] == 3)] = 3
    out[(f[_LETTER] == 0) & (f[_DIGIT] >= 2) & (f[_NW] >= 2)] = 10
    out[(f[_LONG] == 1) & (f[_NW] < 3) | (f[_LETTER] == 0) & (f[_DIGIT] <= 1) | (f[_NW] >= 1) & (f[_COMMON] == 0) & (f[_TITLE] != 2) & (f[_DELIM] == 0) & (f[_DIGIT] == 0) & (f[_BULLET] == 0)] = 5
    out[f[_REPEAT] == 2] = 4
    out[f[_TAG] == 2] = 6
    out[f[_WRONG] == 1] = 7
    return out


def evidence(codes: np.ndarray, doubt: float) -> np.ndarray:
    """Lines x states: 1, but ``doubt`` for states of other labels than that of which a plain rule is sure."""
    sure = seed(codes)
    return np.where((sure >= 0)[:, None] & (LABEL_OF[np.maximum(sure, 0)][:, None] != LABEL_OF), doubt, 1.0)


@dataclass(frozen=True)
class LineModel:
    start: np.ndarray
    move: np.ndarray
    emit: tuple[np.ndarray, ...]  # state x value, one for each feature

    def likelihood(self, codes: np.ndarray) -> np.ndarray:
        """Lines x states, scaled to at most 1 a line."""
        log = np.zeros((len(codes), len(self.start)))
        for k, table in enumerate(self.emit):
            log += np.log(table)[:, codes[:, k]].T
        return np.exp(log - log.max(1, keepdims=True))

    def label(self, codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """The likeliest label of each line, by the sum over its states."""
        states = self.posterior(codes, starts)[0]
        return np.stack([states[:, LABEL_OF == label].sum(1) for label in range(len(LABELS))], 1).argmax(1)

    def posterior(self, codes: np.ndarray, starts: np.ndarray, like: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Posterior of each line's state, and expected moves. ``starts``: first line of each document, and the end."""
        like = self.likelihood(codes) if like is None else like
        length = np.diff(starts)
        order = np.argsort(-length, kind="stable")
        first, length = starts[:-1][order], length[order]
        steps = int(length[0]) if len(length) else 0
        ahead, back = np.empty_like(like), np.ones_like(like)
        active = np.searchsorted(-length, -np.arange(steps), side="left")
        for t in range(steps):
            at = first[: active[t]] + t
            a = like[at] * (self.start if t == 0 else ahead[at - 1] @ self.move)
            ahead[at] = a / a.sum(1, keepdims=True)
        moves = np.zeros_like(self.move)
        for t in range(steps - 1, 0, -1):
            at = first[: active[t]] + t
            right = like[at] * back[at]
            pair = ahead[at - 1][:, :, None] * self.move * right[:, None, :]
            moves += (pair / pair.sum((1, 2), keepdims=True)).sum(0)
            b = right @ self.move.T
            back[at - 1] = b / b.sum(1, keepdims=True)
        both = ahead * back
        return both / both.sum(1, keepdims=True), moves


def fit_model(codes: np.ndarray, starts: np.ndarray, rounds: int = 2) -> LineModel:
    """Expectation-maximisation from the states of the sure lines, which keep their label."""
    n = len(LABEL_OF)
    sure = seed(codes)
    clamp = evidence(codes, 1e-6)

    def maximise(weight: np.ndarray, moves: np.ndarray) -> LineModel:
        emit = []
        for k, size in enumerate(SIZES):
            table = np.full((n, size), 0.02)
            for v in range(size):
                table[:, v] += weight[codes[:, k] == v].sum(0)
            emit.append(table / table.sum(1, keepdims=True))
        head = weight[starts[:-1]].sum(0) + 1 if len(starts) > 1 else np.ones(n)
        return LineModel(head / head.sum(), moves / moves.sum(1, keepdims=True), tuple(emit))

    weight = (sure[:, None] == np.arange(n)).astype(float)
    model = maximise(weight, np.ones((n, n)) + 12 * np.eye(n))
    for _ in range(rounds):
        weight, moves = model.posterior(codes, starts, model.likelihood(codes) * clamp)
        model = maximise(weight, moves + np.ones((n, n)) + 2 * np.eye(n))
    return model


def _analyse(texts: list[str | None], common: frozenset[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Codes and sums of all lines, their characters, and the first line of each text."""
    codes, sums, chars, starts = [], [], [], [0]
    for text in texts:
        for line in units(text) if text else ():
            c, s = line_codes(line, common)
            codes.append(c)
            sums.append(s)
            chars.append(len(line.strip()))
        starts.append(len(codes))
    return np.array(codes, np.int8).reshape(-1, len(SIZES)), np.array(sums, np.int64).reshape(-1, 5), np.array(chars, np.int64), np.array(starts, np.int64)


def fit(df: DataFrame, common: frozenset[str], id_col: str = "doc_id", text_col: str = "text", sample_rows: int = 2_000, sample_lines: int = 200) -> LineModel:
    """The model fitted on up to ``sample_rows`` documents, those with the lowest hashes of id and text, and of each on a run of up to ``sample_lines`` lines at a place that the hash picks.

    One pass without a shuffle of texts: only documents under a bound on the hash, a little more than the sample, are read by Python.
    """
    total = df.count()
    bound = min(2**63 - 1, -(2**63) + int(1.5 * sample_rows / max(1, total) * 2**64))
    few = df.select(F.xxhash64(id_col, text_col).alias("_h"), F.col(text_col).alias("_text")).where((F.col("_h") <= bound) & (F.length(F.trim("_text")) > 0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for h, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                lines = units(text)
                at = h % (len(lines) - sample_lines + 1) if len(lines) > sample_lines else 0
                rows.append(np.array([line_codes(u, common)[0] for u in lines[at : at + sample_lines]], np.int8).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.binary())], names=["_h", "codes"])

    sample = few.mapInArrow(run, "_h bigint, codes binary").groupBy("_h").agg(F.min("codes").alias("codes")).orderBy("_h").limit(sample_rows)
    rows = [m for r in sample.collect() if len(m := np.frombuffer(r["codes"], np.int8).reshape(-1, len(SIZES)))]
    codes = np.concatenate(rows) if rows else np.zeros((0, len(SIZES)), np.int8)
    return fit_model(codes, np.cumsum([0, *map(len, rows)]))


SCHEMA = (
    "words bigint, mean_word_length double, symbol_ratio double, lines bigint, punctuated_lines double, common_words double, "
    "chars bigint, prose double, list double, table double, junk double"
)


def text_quality(df: DataFrame, model: LineModel, common: frozenset[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Statistics of each row's text, in one pass without a shuffle.

    ``words``, ``lines`` and ``chars`` (without white space around lines) are
    counts; ``mean_word_length`` leaves out punctuation around words;
    ``symbol_ratio`` is the share of non-blank characters that are neither letters
    nor digits; ``punctuated_lines`` and ``common_words`` are shares of lines and
    words; ``prose``, ``list``, ``table`` and ``junk`` are shares of characters.
    """
    kind = dict(df.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, sums, chars, starts = _analyse(batch.column(1).to_pylist(), common)
            label = model.label(codes, starts) if len(codes) else np.zeros(0, int)

            def total(v: np.ndarray) -> np.ndarray:
                return np.diff(np.concatenate([[0], np.cumsum(v)])[starts]).astype(float)

            words, size, lines = total(sums[:, 0]), total(chars), np.diff(starts).astype(float)
            letters = total(sums[:, 1])

            def ratio(a: np.ndarray, b: np.ndarray) -> pa.Array:
                ok = b > 0
                return pa.array(np.divide(a, b, out=np.zeros(len(a)), where=ok), mask=~ok)

            columns = [
                pa.array(words.astype(np.int64)), ratio(letters, words), ratio(total(sums[:, 3]), size), pa.array(lines.astype(np.int64)),
                ratio(total(sums[:, 4]), lines), ratio(total(sums[:, 2]), words), pa.array(size.astype(np.int64)),
                *(ratio(total(chars * (label == s)), size) for s in range(len(LABELS))),
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=[id_col, *(c.split()[0] for c in SCHEMA.split(", "))])

    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, {SCHEMA}")


def common_words(stopwords: DataFrame, most: int = 20_000) -> frozenset[str]:
    """The fixed list of common words of all languages, refused beyond ``most`` rows."""
    rows = stopwords.select(F.lower(F.trim("word"))).where("word is not null").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} common words")
    return frozenset(r[0] for r in rows if r[0])
