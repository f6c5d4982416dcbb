"""Languages of texts and of their segments by cross-parsing entropy.

For each language, a suffix automaton holds all substrings of a bounded sample of
labelled text. A text is parsed greedily into the longest phrases that the sample
holds; the fewer phrases for its length, the closer the text is to the language
(phrases x log2(sample) / characters estimates the cross entropy). A text is cut at
ends of sentences and lines, and long stretches every few words; the cheapest
sequence of languages over these units, at a price for every change, gives the
segments, so that names and single foreign words make no segment of their own.

Labels of the sample are checked against common words of the languages, as labels
may be wrong. Defined results: null elements and elements below ``least_words``
words have no language; an empty table gives no rows; repeated ids count once.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.llm.classes import content_key, normal_form
from foliant.session import checkpoint, parallelism

_TAGS = re.compile(r"<[^<>]{1,80}>")
_ENDS = re.compile(r"(?<=[.!?…])[\"'”’»)\]]*\s+|\s*\n\s*|(?<=;)\s+")
_WORD = re.compile(r"\S+")
_OTHER = re.compile(r"[\W\d_]+")


class SuffixAutomaton:
    """All substrings of a text; ``phrases`` parses another text by it."""

    def __init__(self, text: str):
        self.size = len(text)
        link, length, moves = [-1], [0], [{}]
        last = 0
        for c in text:
            new = len(length)
            length.append(length[last] + 1)
            link.append(0)
            moves.append({})
            p = last
            while p >= 0 and c not in moves[p]:
                moves[p][c] = new
                p = link[p]
            if p >= 0:
                q = moves[p][c]
                if length[q] == length[p] + 1:
                    link[new] = q
                else:
                    clone = len(length)
                    length.append(length[p] + 1)
                    link.append(link[q])
                    moves.append(dict(moves[q]))
                    while p >= 0 and moves[p].get(c) == q:
                        moves[p][c] = clone
                        p = link[p]
                    link[q] = link[new] = clone
            last = new
        self.moves = moves

    def phrases(self, text: str) -> int:
        """Longest-match phrases that ``text`` falls into; a letter that the sample lacks is one."""
        moves = self.moves
        root = state = moves[0]
        count = 1
        for c in text:
            nxt = state.get(c)
            if nxt is None:
                count += 1
                nxt = root.get(c)
                if nxt is None:
                    state = root
                    continue
            state = moves[nxt]
        return count


def clean(text: str) -> str:
    """Lower case, letters only, single blanks."""
    return _OTHER.sub(" ", _TAGS.sub(" ", text).lower()).strip()


def cut(text: str, long_unit: int = 14, chunk: int = 6) -> list[tuple[int, int]]:
    """Places of the sentence-like units of a text; units over ``long_unit`` words fall into chunks."""
    out: list[tuple[int, int]] = []
    at = 0
    ends = [m.span() for m in _ENDS.finditer(text)]
    for stop, after in [*ends, (len(text), len(text))]:
        words = [m.span() for m in _WORD.finditer(text, at, stop)]
        n = 1 if len(words) <= long_unit else max(1, round(len(words) / chunk))
        for i in range(n):
            part = words[len(words) * i // n : len(words) * (i + 1) // n]
            if part:
                out.append((part[0][0], part[-1][1]))
        at = after
    return out


class LanguageModel:
    def __init__(self, samples: dict[str, str]):
        self.langs = sorted(samples)
        self.machines = [SuffixAutomaton(f" {samples[lang]} ") for lang in self.langs]
        self.bits = [math.log2(max(4, m.size)) for m in self.machines]
        self.slope = 0.05

    def calibrate(self, held_out: dict[str, list[str]], words: int = 6) -> None:
        """Fit how sure a margin in bits makes, on runs of ``words`` words of labelled texts that are in no sample: the slope with the least logarithmic loss."""
        margins: list[tuple[float, bool]] = []
        for lang, texts in held_out.items():
            for text in texts:
                run = text.split()[:words]
                if lang in self.langs and len(self.langs) > 1 and len(run) == words:
                    costs = self.costs(" ".join(run))
                    low, second = sorted(costs)[:2]
                    margins.append((second - low, costs[self.langs.index(lang)] == low))
        if margins:
            margins.append((sum(m for m, _ in margins) / len(margins), False))  # never quite sure
            self.slope = min((0.01 * 1.15**i for i in range(50)), key=lambda k: sum(math.log1p(math.exp(-k * m)) if ok else math.log1p(math.exp(min(700.0, k * m))) for m, ok in margins))

    def costs(self, text: str) -> list[float]:
        """Cross entropy of the text by each language, in bits for the whole of it."""
        padded = f" {text} "
        return [m.phrases(padded) * b for m, b in zip(self.machines, self.bits, strict=True)]

    def segments(self, text: str, change: float = 60.0) -> list[tuple[str, int, float, int, int]]:
        """``(lang, words, confidence, start, stop)`` of the runs of units in one language; the confidence is the logistic of the margin to the next language."""
        if not self.langs:
            return []
        rows, places = [], []
        flat = _TAGS.sub(lambda m: "\n".ljust(len(m[0])), text)
        for start, stop in cut(flat):
            unit = flat[start:stop]
            plain = clean(unit)
            if plain:
                rows.append((self.costs(plain), plain.count(" ") + 1, _in_prose(unit)))
                places.append((start, stop))
        if not rows:
            return []
        n = len(self.langs)
        best, back = list(rows[0][0]), []
        for cost, _, _ in rows[1:]:
            low = min(range(n), key=best.__getitem__)
            turn = best[low] + change
            step, nxt = [], []
            for k in range(n):
                stay = best[k] <= turn
                step.append(k if stay else low)
                nxt.append((best[k] if stay else turn) + cost[k])
            back.append(step)
            best = nxt
        at = min(range(n), key=best.__getitem__)
        path = [at]
        for step in reversed(back):
            path.append(at := step[at])
        path.reverse()
        out: list[tuple[str, int, float, int, int]] = []
        i = 0
        while i < len(path):
            j = i
            while j < len(path) and path[j] == path[i]:
                j += 1
            total = [sum(rows[u][0][k] for u in range(i, j)) for k in range(n)]
            own = total[path[i]]
            margin = min((total[k] for k in range(n) if k != path[i]), default=math.inf) - own
            words = sum(rows[u][1] for u in range(i, j) if rows[u][2])
            out.append((self.langs[path[i]], words, 1 / (1 + math.exp(-self.slope * max(0.0, margin))), places[i][0], places[j - 1][1]))
            i = j
        return out


def _in_prose(unit: str) -> bool:
    """Whether a unit is more than names and titles: not most of its words are capitalised, unless all are in capitals."""
    words = [w for w in unit.split() if w[:1].isalpha()]
    if not words:
        return False
    upper = sum(w[0].isupper() for w in words)
    return upper < 0.7 * len(words) or unit.upper() == unit or len(words) < 3


_MODELS: dict[int, LanguageModel] = {}


def _model(samples: dict[str, str], slope: float) -> LanguageModel:
    key = hash((slope, *sorted(samples.items())))
    if key not in _MODELS:
        _MODELS.clear()
        _MODELS[key] = LanguageModel(samples)
        _MODELS[key].slope = slope
    return _MODELS[key]


def label_map(language_names: DataFrame, most: int = 20_000) -> dict[str, str]:
    """The fixed table of language labels, refused beyond ``most`` rows."""
    rows = language_names.select(normal_form(F.col("label")), F.col("lang")).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} labels")
    return {r[0]: r[1] for r in rows if r[0] and r[1]}


def _as_map(labels: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for pair in labels.items() for x in pair)) if labels else F.create_map().cast("map<string,string>")


def named_languages(languages: Column, labels: dict[str, str]) -> Column:
    """Codes that the elements of an array of labels stand for."""
    known = _as_map(labels)
    codes = F.transform(languages, lambda x: F.try_element_at(known, normal_form(x)))
    return F.coalesce(F.array_sort(F.array_distinct(F.filter(codes, lambda c: c.isNotNull()))), F.array().cast("array<string>"))


def training_samples(labelled: DataFrame, stopwords: DataFrame, texts: int = 400, letters: int = 30_000, held_out: dict[str, list[str]] | None = None, most: int = 20_000) -> dict[str, str]:
    """Up to ``texts`` texts and ``letters`` letters of each language, from ``(text, lang)`` with lowest hashes.

    A text counts only if the common words of its labelled language outnumber those of
    every other one in it (where the language has any in the table). Texts beyond the
    letters go to ``held_out``. The table of common words is refused beyond ``most`` rows.
    """
    common: dict[str, set[str]] = {}
    words = stopwords.select(F.lower("word"), "lang").where("word is not null and lang is not null").limit(most + 1).collect()
    if len(words) > most:
        raise ValueError(f"more than {most} common words")
    for word, lang in words:
        common.setdefault(lang, set()).add(word)

    # the hash is salted over a fixed number of parts, so that no language's rows meet in one task
    order = F.xxhash64("text")
    parted = labelled.where("text is not null and lang is not null and length(text) > 40").withColumns({"_h": order, "_s": F.pmod(F.xxhash64("text", F.lit(7)), F.lit(64))})
    few = parted.withColumn("_r", F.row_number().over(Window.partitionBy("lang", "_s").orderBy("_h", "text"))).where(F.col("_r") <= texts // 16)
    few = few.withColumn("_r", F.row_number().over(Window.partitionBy("lang").orderBy("_h", "text"))).where(F.col("_r") <= texts)
    by_lang: dict[str, list[str]] = {}
    for lang, text in few.select("lang", "text").orderBy("lang", "_r").collect():
        plain = clean(text)
        words = plain.split()
        votes = {k: sum(w in v for w in words) for k, v in common.items()}
        if lang in votes and votes[lang] <= max((n for k, n in votes.items() if k != lang), default=0):
            continue
        by_lang.setdefault(lang, []).append(plain)
    out = {}
    for lang, plain in by_lang.items():
        kept, size = [], 0
        for number, text in enumerate(plain):
            if size and size + len(text) + 1 > letters:
                if held_out is not None:
                    held_out[lang] = plain[number:]
                break
            kept.append(text[:letters])
            size += len(text) + 1
        out[lang] = " ".join(kept)
    return out


SEGMENTS = "seg_no bigint, lang string, words bigint, confidence double, unnamed boolean"
RUNS = "seg_no bigint, start bigint, stop bigint, lang string, words bigint, confidence double"


def _by_row(df: DataFrame, id_col: str, texts: str, named: str, schema: str, samples: dict[str, str], slope: float, rows_of: Callable[[LanguageModel, list, list], list[tuple]]) -> DataFrame:
    """The rows that ``rows_of`` (model, elements, names) makes of each row; one pass without a shuffle."""
    kind = dict(df.dtypes)[id_col]
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = [{"bigint": pa.int64(), "string": pa.string(), "double": pa.float64(), "boolean": pa.bool_()}[c.split()[1]] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(samples, slope)
        for batch in batches:
            at, rows = [], []
            for i, (elements, known) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                own = rows_of(model, elements or [], known or [])
                rows += own
                at += [i] * len(own)
            columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=[id_col, *names])

    return df.select(id_col, texts, named).mapInArrow(run, f"`{id_col}` {kind}, {schema}")


def segment_languages(df: DataFrame, samples: dict[str, str], id_col: str = "id", texts: str = "descriptions", named: str = "named", least_words: int = 5, slope: float = 0.05) -> DataFrame:
    """``(id, seg_no, lang, words, confidence, unnamed)``: languages of the elements of an array of texts.

    ``unnamed`` says that the row's array ``named`` lacks one of the languages of its elements.
    """

    def rows_of(model: LanguageModel, elements: list, known: list) -> list[tuple]:
        own: list[tuple] = []
        for number, text in enumerate(elements):
            if text is None or len(text.split()) < least_words:
                continue
            found: dict[str, list[float]] = {}
            for lang, words, confidence, _, _ in model.segments(text):
                entry = found.setdefault(lang, [0, 0, 0.0])
                entry[0] = max(entry[0], words)
                entry[1] += words
                entry[2] += words * confidence
            for lang, (longest, words, weight) in found.items():
                if longest >= least_words or len(found) == 1:
                    own.append((number, lang, words, weight / words if words else 0.5))
        unnamed = not {r[1] for r in own} <= set(known)
        return [(*r, unnamed) for r in own]

    return _by_row(df, id_col, texts, named, SEGMENTS, samples, slope, rows_of)


def segment_runs(df: DataFrame, samples: dict[str, str], id_col: str = "id", texts: str = "descriptions", named: str = "named", least_words: int = 5, slope: float = 0.05) -> DataFrame:
    """``(id, seg_no, start, stop, lang, words, confidence)``: every run of one language in the elements, as places of characters; short runs too."""

    def rows_of(model: LanguageModel, elements: list, known: list) -> list[tuple]:
        long = ((number, text) for number, text in enumerate(elements) if text is not None and len(text.split()) >= least_words)
        return [(number, start, stop, lang, words, confidence) for number, text in long for lang, words, confidence, start, stop in model.segments(text)]

    return _by_row(df, id_col, texts, named, RUNS, samples, slope, rows_of)


def once_per_id(df: DataFrame, columns: list[str], id_col: str = "id") -> DataFrame:
    keyed = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), *columns).withColumn("_key", content_key(*columns))
    return keyed.groupBy("id").agg(F.min_by(F.struct(*columns), "_key").alias("r")).select("id", "r.*")


def record_languages(df: DataFrame, language_names: DataFrame, stopwords: DataFrame, books: DataFrame | None = None, least_words: int = 5, runs: bool = False) -> DataFrame:
    """``(id, seg_no, lang, words, confidence, unnamed)`` of records, held against the codes that the record's labels stand for; or their ``segment_runs``.

    Samples come from records and ``books`` that name just one language; the
    confidence is calibrated on texts of these that are in no sample.
    """
    labels = label_map(language_names)
    once = once_per_id(df, ["descriptions", "languages"])
    records = checkpoint(once.select("id", "descriptions", named_languages(F.col("languages"), labels).alias("named")).repartition(2 * parallelism(df.sparkSession)))
    labelled = records.where("size(named) = 1").select(F.array_join("descriptions", " ").alias("text"), F.col("named")[0].alias("lang"))
    if books is not None:
        known = _as_map(labels)
        labelled = labelled.unionByName(books.select(F.col("description").alias("text"), F.try_element_at(known, normal_form(F.col("languages"))).alias("lang")))
    held_out: dict[str, list[str]] = {}
    samples = training_samples(labelled, stopwords, held_out=held_out)
    model = LanguageModel(samples)
    model.calibrate(held_out)
    return (segment_runs if runs else segment_languages)(records, samples, least_words=least_words, slope=model.slope)


def mislabelled(languages: DataFrame) -> DataFrame:
    """``(id, seg_no, lang)`` of records that do not name all languages they are written in."""
    return languages.where("unnamed").select("id", "seg_no", "lang")
