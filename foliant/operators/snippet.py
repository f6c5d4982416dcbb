"""Query-biased snippets: best windows of words, merged, hits marked."""

from __future__ import annotations

from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from foliant.functions import text as T


def best_windows(hits: list[int], width: int) -> list[tuple[int, int]]:
    """``(start, end)`` of all windows of ``width`` words with the most hits, overlapping or touching ones merged; none without hits."""
    n = len(hits)
    sums = [0, *accumulate(hits)]
    counts = [sums[i + width] - sums[i] for i in range(n - width + 1)] if n >= width else [sums[-1]]
    best, out = max(counts, default=0), []
    if best == 0:
        return out
    for i, c in enumerate(counts):
        if c == best:
            end = min(i + width, n)
            if out and i <= out[-1][1]:
                out[-1] = (out[-1][0], end)
            else:
                out.append((i, end))
    return out


def snippets(docs: DataFrame, query_terms: DataFrame, n_side: int = 5) -> DataFrame:
    """``(query_id, doc_id, snippet)`` of ``(query_id, doc_id, text)``: all windows of ``n_side + 1`` words with the most hits, overlapping or touching ones merged.

    Words match by their lower case without punctuation at the ends. A shorter document
    is one window; a document without hits has an empty snippet. A text's words stay in its row.
    """
    width = n_side + 1
    kind = StringType()

    @F.pandas_udf(kind)
    def shown(words: pd.Series, hits: pd.Series) -> pd.Series:
        def one(w, h):
            return " ... ".join(" ".join(f"***{w[i]}***" if h[i] else w[i] for i in range(a, b)) for a, b in best_windows(h.tolist(), width))

        return pd.Series([one(w, h) for w, h in zip(words, hits)], dtype=object)

    asked = query_terms.groupBy("query_id").agg(F.collect_set("term").alias("_q"))
    words = docs.join(asked, "query_id", "left").select("query_id", "doc_id", "_q", T.split_words(F.col("text")).alias("_w"))
    hit = F.transform("_w", lambda w: F.coalesce(F.array_contains("_q", T.strip_edges(F.lower(w))), F.lit(False)).cast("int"))
    return words.select("query_id", "doc_id", shown("_w", hit).alias("snippet"))


def missing_terms(docs: DataFrame, query_terms: DataFrame) -> DataFrame:
    """``(query_id, doc_id, term)``: query terms that the document's text lacks."""
    have = docs.select("query_id", "doc_id", F.explode(T.split_words(F.col("text"))).alias("raw")).select("query_id", "doc_id", T.strip_edges(F.lower("raw")).alias("term"))
    asked = docs.select("query_id", "doc_id").join(query_terms.select("query_id", "term").distinct(), "query_id")
    return asked.join(have.distinct(), ["query_id", "doc_id", "term"], "left_anti").select("query_id", "doc_id", "term")


def highlight_html(text: str, terms: list[str], colour: str = "orange"):
    """A text column with whole words of ``terms`` wrapped in a coloured span, whatever their case."""
    out = F.col(text)
    for term in terms:
        quoted = "\\Q" + term.replace("\\E", "") + "\\E"
        out = F.regexp_replace(out, rf"(?i)\b({quoted})\b", f'<span style="color: {colour}">$1</span>')
    return out
