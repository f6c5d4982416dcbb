"""Text analysis as column expressions: cleaning, tokens, grams, guarded casts, formatting."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words with addresses (matched before lower-casing) and the ASCII punctuation characters.
ADDRESS = r"\S*http\S*|\S*www\S*|\S+\.ir\S*|\S+\.com\S*|\S+\.org\S*|\S*@\S*"
ADDRESS_PARTS = ("http", "www", ".ir", ".com", ".org", "@")
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: The stop words of the analyser.
STOP_WORDS = ("this", "that", "about", "whom", "being", "where", "why", "had", "should", "each")

SPACES = r"[ \t\r\n]+"
NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]{1,2})?$"
WORD = r"[\p{L}\p{N}_]{2,}"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` found once, however often it is used: as the variable of a lambda it isn't inlined."""
    return F.transform(F.array(value), use)[0]


def strip_addresses(text: Column) -> Column:
    """URLs, hosts and mail addresses deleted; case matters. The pattern, slow on words that don't match, is tried only where one of its literals is."""
    may = reduce(lambda a, b: a | b, (F.contains(text, F.lit(x)) for x in ADDRESS_PARTS))
    return F.when(may, F.regexp_replace(text, ADDRESS, "")).otherwise(text)


def depunctuate(text: Column) -> Column:
    """ASCII punctuation deleted, so that ``it's`` becomes ``its``."""
    return F.regexp_replace(text, r"\p{Punct}+", "")  # those of ASCII; `translate` looks each character up in a map


def split_words(text: Column) -> Column:
    """Words between white space, no empty ones; an empty array for null."""
    return F.coalesce(F.filter(F.split(text, SPACES), lambda w: w != ""), F.array().cast("array<string>"))


def analyse(text: Column) -> Column:
    """The analyser without stop words and stemming: addresses off, lower case, punctuation off, words."""
    return split_words(depunctuate(F.lower(strip_addresses(text))))


def without(words: Column, stop: list[str]) -> Column:
    """Words outside a short fixed list; repetitions stay."""
    return F.filter(words, lambda w: ~w.isin(stop)) if stop else words


def analyse_without(text: Column, stop: list[str]) -> Column:
    """``without(analyse(text), stop)`` with words split at a literal blank and filtered once."""
    plain = depunctuate(F.lower(strip_addresses(text)))
    for space in "\t\r\n":
        plain = F.replace(plain, F.lit(space), F.lit(" "))
    return F.coalesce(F.filter(F.split(plain, " "), lambda w: ~w.isin(["", *stop])), F.array().cast("array<string>"))


def word_tokens(text: Column) -> Column:
    """Runs of two or more letters, digits or underscores of the lower-cased text."""
    return F.coalesce(F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def pairs(words: Column, glue: str = " ") -> Column:
    """Successive words joined, repetitions kept."""
    joined = F.zip_with(words, F.slice(words, 2, 1_000_000_000), lambda a, b: F.when(a.isNotNull() & b.isNotNull(), F.concat(a, F.lit(glue), b)))
    return F.filter(joined, lambda g: g.isNotNull())


def char_grams(word: Column, k: int = 2) -> Column:
    """Distinct character k-grams of ``$word$``."""
    framed = F.concat(F.lit("$"), word, F.lit("$"))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(framed) - (k - 1)), lambda i: F.substring(framed, i, k)))


def strip_edges(word: Column) -> Column:
    """Punctuation at the ends of a word removed."""
    return F.btrim(word, F.lit(PUNCTUATION))


def list_items(cell: Column) -> Column:
    """Items of a comma list, trimmed, without empty ones."""
    items = F.transform(F.split(F.coalesce(cell, F.lit("")), ","), lambda x: F.trim(x))
    return F.filter(items, lambda x: x != "")


def guarded_int(cell: Column) -> Column:
    """Digits as a number of 64 bits, anything else (a sign or a larger number too) 0."""
    value = F.trim(F.coalesce(cell, F.lit("")))
    return F.coalesce(F.when(value.rlike("^[0-9]+$"), value.try_cast("bigint")), F.lit(0).cast("bigint"))


def guarded_float(cell: Column) -> Column:
    """A finite decimal number, also with a sign, an exponent or a bare point; a blank cell or text 0.0."""
    value = F.trim(F.coalesce(cell, F.lit("")))
    return F.coalesce(F.when(value.rlike(NUMBER), value.try_cast("double")), F.lit(0.0))


def shorten(text: Column, n: int = 35) -> Column:
    """The first ``n`` characters and dots, if there are more."""
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("..."))).otherwise(text)


def joined_text(*parts: tuple[str, Column]) -> Column:
    """Columns with a literal before each, nulls empty, joined by blanks."""
    return F.concat_ws(" ", *(F.concat(F.lit(prefix), F.coalesce(c, F.lit(""))) for prefix, c in parts))
