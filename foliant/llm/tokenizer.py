"""Encoding of texts with a public byte-level BPE by a lazily determinised transducer.

The merges are compiled into a trie of the tokens' bytes. Reading a word byte by
byte, a *thread* is a start position whose bytes so far are a prefix of some
token; it carries the tokens that precede it. The last token of the encoding of
every prefix is unique: it is the one that may stand after the tokens before it
(two neighbouring tokens may stand side by side if merging their bytes gives
just the two of them). The set of threads, with the tokens that they do not yet
agree on, is a state of a subsequential transducer. A transition is simulated
thread by thread when it is first asked for, made and kept when it is asked for
again; what all threads agree on is emitted at once, so that output lags the input
by less than the longest token.

Defined results: a null or an empty text has no tokens; strings of special
tokens are ordinary text; a text is never cut.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Folder of the vocabulary files; the environment or a parameter may name another.
TOKENIZER_DIR = os.environ.get("FOLIANT_TOKENIZERS", "/opt/tokenizers")
BYTE_BPE = "byte_bpe_50k.tiktoken"

#: Fixed value: the pattern that splits a text into words before the merges.
WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class Transducer:
    """Byte-level BPE of single words; ``states_kept`` and ``words_kept`` bound what is remembered, not what is encoded."""

    def __init__(self, ranks: dict[bytes, int], states_kept: int = 100_000, words_kept: int = 150_000):
        self.ranks = ranks
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.states_kept = states_kept
        self.words = _Words(self, words_kept)
        self.split = regex.compile(WORDS).findall
        # trie: node * 256 + byte -> node; the root is 0
        self.child: dict[int, int] = {}
        self.token_at: dict[int, int] = {}
        for token, rank in ranks.items():
            node = 0
            for byte in token:
                key = node << 8 | byte
                nxt = self.child.get(key)
                if nxt is None:
                    nxt = self.child[key] = len(self.child) + 1
                node = nxt
            self.token_at[node] = rank
        self.side: dict[int, bool] = {}
        self._forget()

    def _forget(self) -> None:
        self.state_of: dict[tuple, int] = {}
        self.states: list[tuple] = []
        self.step: dict[int, tuple[int, tuple[int, ...]]] = {}
        self.asked: set[int] = set()
        self.start = self._state((-1, (((), 0),)))

    def _state(self, state: tuple) -> int:
        number = self.state_of.get(state)
        if number is None:
            number = self.state_of[state] = len(self.states)
            self.states.append(state)
        return number

    def merge(self, word: bytes) -> list[int]:
        """The merges applied as defined, lowest rank first."""
        parts = [word[i : i + 1] for i in range(len(word))]
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                rank = self.ranks.get(parts[i] + parts[i + 1])
                if rank is not None and (best is None or rank < best):
                    best, at = rank, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def may_follow(self, before: int, token: int) -> bool:
        key = (before + 1) << 32 | token
        known = self.side.get(key)
        if known is None:
            if len(self.side) > 500_000:
                self.side.clear()
            want = [token] if before < 0 else [before, token]
            known = self.side[key] = self.merge(b"".join(self.bytes_of[t] for t in want)) == want
        return known

    def _determinise(self, number: int, byte: int) -> tuple[int, tuple[int, ...]]:
        base, threads = self.states[number]
        child, token_at, side = self.child.get, self.token_at.get, self.side.get
        alive, ended = [], None
        for tokens, node in threads:
            node = child(node << 8 | byte)
            if node is None:
                continue
            alive.append((tokens, node))
            if ended is None:
                token = token_at(node)
                if token is not None:
                    before = tokens[-1] if tokens else base
                    fits = side((before + 1) << 32 | token)
                    if fits or fits is None and self.may_follow(before, token):
                        ended = (*tokens, token)
        if ended is None:
            raise ValueError("the vocabulary lacks a byte")
        alive.append((ended, 0))
        agreed = alive[0][0]  # the earliest start has the fewest tokens before it
        if agreed:
            agreed = os.path.commonprefix([agreed, *(tokens for tokens, _ in alive[1:])]) if len(alive) > 1 else agreed
            if n := len(agreed):
                base, alive = agreed[-1], [(tokens[n:], node) for tokens, node in alive]
        out = self.step[number << 8 | byte] = (self._state((base, tuple(alive))), agreed)
        return out

    def encode_word(self, word: bytes) -> tuple[int, ...]:
        whole = self.ranks.get(word)
        if whole is not None and self.may_follow(-1, whole):
            return (whole,)
        if len(self.states) > self.states_kept or len(self.asked) > 4 * self.states_kept:
            self._forget()
        ids: list[int] = []
        state, step, asked = self.start, self.step, self.asked
        for at, byte in enumerate(word):
            key = state << 8 | byte
            move = step.get(key)
            if move is None:
                if key not in asked:
                    asked.add(key)
                    return (*ids, *self._simulate(state, word[at:]))
                move = self._determinise(state, byte)
            state = move[0]
            if move[1]:
                ids += move[1]
        return (*ids, *self.states[state][1][-1][0])

    def _simulate(self, number: int, rest: bytes) -> list[int]:
        """The tokens that follow a state for the rest of a word, thread by thread, without making states."""
        base, threads = self.states[number]
        child, token_at, side = self.child.get, self.token_at.get, self.side.get
        # a path is (path before, token), or (None, tokens) at its root
        live = [((None, tokens), tokens[-1] if tokens else base, node) for tokens, node in threads]
        for byte in rest:
            moved, ended = [], None
            for path, before, node in live:
                node = child(node << 8 | byte)
                if node is None:
                    continue
                moved.append((path, before, node))
                if ended is None:
                    token = token_at(node)
                    if token is not None:
                        fits = side((before + 1) << 32 | token)
                        if fits or fits is None and self.may_follow(before, token):
                            ended = (path, token)
            if ended is None:
                raise ValueError("the vocabulary lacks a byte")
            moved.append((ended, ended[1], 0))
            live = moved
        path, out = live[-1][0], []
        while path[0] is not None:
            out.append(path[1])
            path = path[0]
        return [*path[1], *reversed(out)]

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        return list(chain.from_iterable(map(self.words.__getitem__, self.split(text))))


class _Words(dict):
    """Outputs of whole words, made by the transducer at first use."""

    def __init__(self, machine: Transducer, kept: int):
        super().__init__()
        self.machine, self.kept = machine, kept

    def __missing__(self, word: str) -> tuple[int, ...]:
        ids = self.machine.encode_word(word.encode("utf-8", "surrogatepass"))
        if len(word) <= 40:
            if len(self) >= self.kept:
                self.clear()
            self[word] = ids
        return ids


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


_MACHINES: dict[str, Transducer] = {}


def machine(vocabulary: str = BYTE_BPE, folder: str = TOKENIZER_DIR) -> Transducer:
    """The transducer of a rank file, one per Python worker."""
    path = os.path.join(folder, vocabulary)
    if path not in _MACHINES:
        _MACHINES[path] = Transducer(read_ranks(path))
    return _MACHINES[path]


def encode_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = BYTE_BPE, folder: str = TOKENIZER_DIR) -> DataFrame:
    """``(id, ids ARRAY<INT>)`` for each row of ``df``, in one pass without a shuffle.

    Rows stay one to one, repeated ids included; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = machine(vocabulary, folder)
        words, split = m.words.__getitem__, m.split
        for batch in batches:
            values: list[np.ndarray] = []
            ends = np.zeros(batch.num_rows + 1, np.int64)
            for i, text in enumerate(batch.column(1).to_pylist()):
                if text:
                    values.append(row := np.fromiter(chain.from_iterable(map(words, split(text))), np.int32))
                    ends[i + 1] = len(row)
            np.cumsum(ends, out=ends)
            flat = np.concatenate(values) if values else np.zeros(0, np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=[id_col, "ids"])

    kind = dict(df.dtypes)[id_col]
    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")


class Utf8Stream:
    """Incremental UTF-8 decoding by a state machine over bytes.

    State 0 waits for a first byte; otherwise it holds how many continuation
    bytes are missing and the range of the next one. A wrong or missing byte
    gives U+FFFD, as far as ``close`` is concerned too.
    """

    def __init__(self) -> None:
        self.missing, self.low, self.high, self.point = 0, 0x80, 0xBF, 0

    def feed(self, data: bytes) -> str:
        out: list[str] = []
        for byte in data:
            if self.missing:
                if self.low <= byte <= self.high:
                    self.point = self.point << 6 | byte & 0x3F
                    self.missing -= 1
                    self.low, self.high = 0x80, 0xBF
                    if not self.missing:
                        out.append(chr(self.point))
                    continue
                out.append("�")
                self.missing, self.low, self.high = 0, 0x80, 0xBF
            if byte < 0x80:
                out.append(chr(byte))
            elif 0xC2 <= byte <= 0xDF:
                self.missing, self.point = 1, byte & 0x1F
            elif 0xE0 <= byte <= 0xEF:
                self.missing, self.point = 2, byte & 0x0F
                self.low, self.high = 0xA0 if byte == 0xE0 else 0x80, 0x9F if byte == 0xED else 0xBF
            elif 0xF0 <= byte <= 0xF4:
                self.missing, self.point = 3, byte & 0x07
                self.low, self.high = 0x90 if byte == 0xF0 else 0x80, 0x8F if byte == 0xF4 else 0xBF
            else:
                out.append("�")
        return "".join(out)

    def close(self) -> str:
        rest, self.missing = "�" * bool(self.missing), 0
        return rest


def decode_stream(tokens: Iterable[int], bytes_of: dict[int, bytes]) -> Iterator[str]:
    """The text of ``tokens``, given out as soon as characters are whole."""
    stream = Utf8Stream()
    for token in tokens:
        if piece := stream.feed(bytes_of[token]):
            yield piece
    if rest := stream.close():
        yield rest


def decode_texts(df: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", vocabulary: str = BYTE_BPE, folder: str = TOKENIZER_DIR) -> DataFrame:
    """``(id, text)`` of lists of token ids; a null list gives a null text, an empty one the empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bytes_of = machine(vocabulary, folder).bytes_of
        for batch in batches:
            texts = [None if row is None else "".join(decode_stream(row, bytes_of)) for row in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[id_col, "text"])

    kind = dict(df.dtypes)[id_col]
    return df.select(id_col, ids_col).mapInArrow(run, f"`{id_col}` {kind}, text string")


def token_count(ids: Column | str) -> Column:
    """Number of tokens of an id list, 0 for null."""
    return F.coalesce(F.size(ids), F.lit(0))
