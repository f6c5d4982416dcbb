"""Porter's suffix stripping (1980) as an Arrow UDF; apply it to distinct terms and join back."""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType


def _consonant(w: str, i: int) -> bool:
    return w[i] not in "aeiou" and (w[i] != "y" or i == 0 or not _consonant(w, i - 1))


def _measure(w: str) -> int:
    shape = "".join("c" if _consonant(w, i) else "v" for i in range(len(w)))
    return sum(a == "v" and b == "c" for a, b in zip(shape, shape[1:]))


def _vowel(w: str) -> bool:
    return any(not _consonant(w, i) for i in range(len(w)))


def _double(w: str) -> bool:
    return len(w) > 1 and w[-1] == w[-2] and _consonant(w, len(w) - 1)


def _cvc(w: str) -> bool:
    n = len(w)
    return n > 2 and _consonant(w, n - 3) and not _consonant(w, n - 2) and _consonant(w, n - 1) and w[-1] not in "wxy"


#: The suffix tables of steps 2, 3 and 4 of the published algorithm.
_STEP2 = (("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"))
_STEP3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
_STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def stem(w: str) -> str:
    """The stem of a lower-case word; words of one or two letters stay."""
    if len(w) < 3:
        return w
    for end, to in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
        if w.endswith(end):
            w = w[: len(w) - len(end)] + to
            break
    if w.endswith("eed"):
        if _measure(w[:-3]) > 0:
            w = w[:-1]
    else:
        for end in ("ed", "ing"):
            if w.endswith(end) and _vowel(w[: -len(end)]):
                w = w[: -len(end)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif _double(w) and w[-1] not in "lsz":
                    w = w[:-1]
                elif _measure(w) == 1 and _cvc(w):
                    w += "e"
                break
    if w.endswith("y") and _vowel(w[:-1]):
        w = w[:-1] + "i"
    for table in (_STEP2, _STEP3):
        for end, to in sorted(table, key=lambda x: -len(x[0])):
            if w.endswith(end):
                if _measure(w[: -len(end)]) > 0:
                    w = w[: -len(end)] + to
                break
    for end in sorted(_STEP4, key=len, reverse=True):
        if w.endswith(end):
            base = w[: -len(end)]
            if _measure(base) > 1 and (end != "ion" or base.endswith(("s", "t"))):
                w = base
            break
    if w.endswith("e"):
        m = _measure(w[:-1])
        if m > 1 or m == 1 and not _cvc(w[:-1]):
            w = w[:-1]
    if w.endswith("ll") and _measure(w) > 1:
        w = w[:-1]
    return w


@F.pandas_udf(StringType())
def porter(words: pd.Series) -> pd.Series:
    return words.map(lambda w: w if w is None else stem(w))


_STEMS: dict[str, str] = {}


@F.arrow_udf(ArrayType(ArrayType(StringType())))
def porter_lists(lists: pa.Array) -> pa.Array:
    """Stems of the words in lists of lists; each distinct word of a batch is stemmed once, and some are remembered."""
    words = lists.flatten().flatten().dictionary_encode()
    if len(_STEMS) > 200_000:
        _STEMS.clear()
    stems = pa.array([_STEMS.get(w) or _STEMS.setdefault(w, stem(w)) for w in words.dictionary.to_pylist()], pa.string()).take(words.indices)
    inner = lists.flatten()
    ends = lambda x: pa.array([0, *pc.cumulative_sum(pc.list_value_length(x)).to_pylist()], pa.int32())
    return pa.ListArray.from_arrays(ends(lists), pa.ListArray.from_arrays(ends(inner), stems))


def stem_terms(terms: DataFrame, column: str = "term") -> DataFrame:
    """Distinct terms with their stems."""
    return terms.select(column).where(F.col(column).isNotNull()).distinct().withColumn("stem", porter(column))
