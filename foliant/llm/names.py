"""Variant spellings of names, linked by suffix blocking and longest common subsequences.

A name is read as titles, given name, middle names and surname in either order
("Given Middle Surname" or "Surname, Given Middle"), without accents. A given name
is brought to its full form by the table of short names, slips of one letter
included; an initial stands for every full given name that begins with it.

Blocking is over units, the distinct (surname, initial) of a field, so that many
spellings and given names of one surname cost no more than its initials. Every suffix
of a surname of at least ``shortest`` letters is a key, and every prefix as a suffix of
the surname read backwards, so that a slip anywhere leaves some keys equal. Two
surnames are taken at their longest common suffix only. A suffix that is common is
refined by the initial; a unit without one (a title and a surname) goes along with
every initial that occurs under the suffix. What is still common after that is
discarded as a suffix: its units meet under their surname with a letter left out, and
under its consonants, which all that can match share; so do those of surnames too
short to keep a suffix beside a slip.

Comparison: the longest common subsequence decides between surnames. It must have 0.8
of their letters, and lack at most one letter of the longer surname, or else hold all
consonants of both (surnames of two persons often share more than 0.8 by chance). The
ratio is 1 for equal surnames, which meet under the whole surname as a suffix.
Given names match by full form (one slip where one of them is not in the table), or
by initial. Spellings with a full given name are joined to persons over links between
them; spellings without join the persons of the same surname, or where it has none,
those of similar ones; a title with a surname joins the persons who have that title,
or the only one.

Defined results: null and blank values have no row; names of one word and
collective names match only themselves; the smaller spelling stands first.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.llm.classes import normal_form, spread
from foliant.operators import graph
from foliant.session import checkpoint, merging, written

#: Words around a name that are no part of it, and words that belong to a surname.
TITLES = frozenset("by dr doctor prof professor capt captain sgt sergeant rev reverend lt lieutenant col colonel insp inspector mr mrs ms miss sir lady lord dame phd ph.d md jr sr author ed trans editor translator".split())
LONG_TITLES = {"dr": "doctor", "prof": "professor", "capt": "captain", "sgt": "sergeant", "rev": "reverend", "lt": "lieutenant", "col": "colonel", "insp": "inspector"}
PARTICLES = frozenset("de la von van der den del della da di du le ter ten zu zur".split())

_NOTES = re.compile(r"\([^()]*\)|\[[^\[\]]*\]|,?\s*\b(?:ph\.?\s?d|m\.?d|jr|sr)\b\.?")
_INITIALS = re.compile(r"(?:[^\W\d_]\.?-?){1,3}")
_SPECIAL = str.maketrans({"ø": "o", "ł": "l", "ß": "ss", "æ": "ae", "œ": "oe", "đ": "d", "ð": "d", "þ": "th", "ı": "i", "’": "'", "‘": "'", "`": "'"})


def fold_accents(text: str) -> str:
    text = unicodedata.normalize("NFKD", text.translate(_SPECIAL))
    return "".join(c for c in text if not unicodedata.combining(c))


def slips(word: str) -> set[str]:
    """All words one slip away: a letter left out, added, changed, or two swapped."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    cuts = [(word[:i], word[i:]) for i in range(len(word) + 1)]
    out = {a + b[1:] for a, b in cuts if b} | {a + b[1] + b[0] + b[2:] for a, b in cuts if len(b) > 1}
    out |= {a + c + b[1:] for a, b in cuts if b for c in letters} | {a + c + b for a, b in cuts for c in letters}
    return out - {word}


class GivenNames:
    """Full forms of given names; slips count where they can mean one name only."""

    def __init__(self, short: Iterable[tuple[str, str]]):
        pairs = [(fold_accents(s.lower().strip()), fold_accents(g.lower().strip())) for s, g in short if s and g]
        self.full = {g: g for _, g in pairs} | dict(pairs)
        self.full |= {g: g for _, g in pairs}
        self.slip: dict[str, str | None] = {}
        for word, given in self.full.items():
            if len(word) >= 4:
                for s in slips(word):
                    if s not in self.full and len(s) >= 3:
                        self.slip[s] = given if self.slip.get(s, given) == given else None

    def canonical(self, word: str) -> str | None:
        return self.full.get(word) or self.slip.get(word)


def parse(name: str, given_names: GivenNames) -> tuple[str, str, str, str, str] | None:
    """``(surname, given, initial, middle initials, title)``.

    ``given`` is empty for an initial, ``initial`` too for a title with a surname
    only. None for what is no full name.
    """
    text = _NOTES.sub(" ", fold_accents(name.lower()))
    text = re.sub(r"\s+", " ", text).strip(" .;:,")
    backward = "," in text
    last, _, first = text.partition(",")
    words, tail = (first.replace(",", " ").split(), last.split()) if backward else (text.split(), [])
    titles = [w.strip(".") for w in words + tail if w.strip(".") in TITLES]
    title = next((LONG_TITLES.get(t, t) for t in titles if LONG_TITLES.get(t, t) in LONG_TITLES.values()), "")
    words = [w for w in words if w.strip(".") not in TITLES]
    tail = [w for w in tail if w.strip(".") not in TITLES]
    if not backward:
        if not words or len(words) == 1 and not title:
            return None
        at = len(words) - 1
        while at > (0 if title else 1) and words[at - 1].strip(".") in PARTICLES:
            at -= 1
        words, tail = words[:at], words[at:]
    surname = re.sub(r"[^\w]", "", "".join(w for w in tail if w.strip(".") not in PARTICLES))
    if len(surname) < 2:
        return None
    parts: list[str] = []
    for w in words:
        if _INITIALS.fullmatch(w) and ("." in w or len(w) == 1):
            parts += [c for c in w if c.isalpha()]
        elif w := re.sub(r"[^\w]", "", w):
            parts.append(w)
    if not parts:
        return (surname, "", "", "", title) if title else None
    head, rest = parts[0], parts[1:]
    if len(head) == 1:
        given, initial = "", head
    else:
        given = given_names.canonical(head) or head
        initial = given[0]
    middle = "".join((given_names.canonical(w) or w)[0] for w in rest)
    return surname, given, initial, middle, title


def common_letters(a: str, b: str) -> int:
    """Length of the longest common subsequence."""
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full = state = (1 << len(a)) - 1
    for c in b:
        met = state & where.get(c, 0)
        state = (state + met | state - met) & full
    return len(a) - state.bit_count()


def lcs_ratio(a: str, b: str) -> float:
    """Twice the length of the longest common subsequence over the sum of lengths."""
    return 2 * common_letters(a, b) / (len(a) + len(b)) if a and b else 0.0


def consonants(word: str) -> str:
    """What spellings of one sound share: no vowels, no ``ij``, doubled letters once."""
    word = word.replace("ij", "i")
    return "".join(c for i, c in enumerate(word) if c not in "aeiouy" and c != word[i - 1 : i])


def alike(a: str, b: str, ratio: float = 0.8) -> bool:
    """Whether surnames are spellings of one: their common subsequence has ``ratio`` of the letters and lacks at most one of the longer, or all their consonants."""
    shared = common_letters(a, b)
    return 2 * shared >= ratio * (len(a) + len(b)) - 1e-9 and (shared >= max(len(a), len(b)) - 1 or consonants(a) == consonants(b))


FORM = "field string, name string, surname string, given string, initial string, title string, known boolean"


def parsed(names: DataFrame, short: list[tuple[str, str]]) -> DataFrame:
    """``(field, name)`` with the parts of each name; rows that are no full name are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given_names = GivenNames(short)
        for batch in batches:
            rows = []
            for field, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if (p := parse(name, given_names)) is not None:
                    rows.append((field, name, *p[:3], p[4], p[1] in given_names.full))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns[:6]] + [pa.array(columns[6], pa.bool_())], names=[c.split()[0] for c in FORM.split(", ")])

    return names.mapInArrow(run, FORM)


UNIT = ("unit", "field", "surname", "initial")


def _suffix_keys(units: DataFrame, shortest: int) -> DataFrame:
    """Units under the suffixes of their surname and of the surname read backwards; ``before``: the letter that a longer suffix would have, '' if there is none."""
    n = F.length("surname")
    suffix = lambda i: F.struct(F.substring("surname", i, n).alias("piece"), F.lit(">").alias("side"), F.when(i > 1, F.substring("surname", i - 1, F.lit(1))).otherwise("").alias("before"))
    prefix = lambda i: F.struct(F.substring("surname", F.lit(1), i).alias("piece"), F.lit("<").alias("side"), F.substring("surname", i + 1, F.lit(1)).alias("before"))
    both = F.concat(F.transform(F.sequence(F.lit(1), F.greatest(n - shortest + 1, F.lit(1))), suffix), F.transform(F.sequence(F.least(F.lit(shortest), n), n), prefix))
    return units.select(*UNIT, F.explode(both).alias("k")).select(F.xxhash64("field", "k.side", "k.piece").alias("key"), "k.before", "unit", "initial")


def letters_left_out(word: Column) -> Column:
    """``word`` and all that is left of it without one letter."""
    out = F.transform(F.sequence(F.lit(1), F.length(word)), lambda i: F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, F.length(word))))
    return F.array_distinct(F.concat(F.array(word), out))


def _consonants(word: Column) -> Column:
    """``consonants`` as an expression."""
    return F.regexp_replace(F.regexp_replace(F.replace(word, F.lit("ij"), F.lit("i")), r"(.)\1+", "$1"), "[aeiouy]", "")


def _by_initial(keyed: DataFrame) -> DataFrame:
    """Keys refined by the initial; units without one go along with each that their key has."""
    initials = keyed.where("initial <> ''").select("key", F.col("initial").alias("_i")).distinct()
    nameless = keyed.where("initial = ''")
    every = keyed.withColumn("_i", F.col("initial")).unionByName(merging(nameless, initials, "key"))
    return every.withColumn("key", F.xxhash64("key", "_i")).drop("_i")


def candidates(units: DataFrame, shortest: int = 4, common: int = 40) -> DataFrame:
    """``(key, before, unit, initial)``: units under suffixes that are not common, or not once refined, or with a letter left out."""

    def shared(keyed: DataFrame) -> DataFrame:
        """Keys of more than one unit, with their number."""
        return merging(keyed, keyed.groupBy("key").agg(F.count("*").alias("_n")).where("_n > 1"), "key")

    suffixes = checkpoint(shared(_suffix_keys(units, shortest)))
    rare = suffixes.where(F.col("_n") <= common).drop("_n")
    refined = checkpoint(shared(_by_initial(suffixes.where(F.col("_n") > common).drop("_n"))))
    refined, rest = refined.where(F.col("_n") <= common).drop("_n"), refined.where(F.col("_n") > common)
    # a slip, or two letters swapped, can leave a surname less than ``shortest`` on both sides
    lacking = checkpoint(merging(units, rest.select("unit").distinct(), "unit", "left_semi").unionByName(units.where(F.length("surname") <= 2 * shortest)).distinct())
    without = lacking.select(F.explode(letters_left_out(F.col("surname"))).alias("_w"), *UNIT).select(F.xxhash64("field", F.lit("-"), "_w").alias("key"), F.lit(None).cast("string").alias("before"), "unit", "initial")
    skeleton = _by_initial(lacking.select(F.xxhash64("field", F.lit("~"), _consonants(F.col("surname"))).alias("key"), F.lit(None).cast("string").alias("before"), "unit", "initial"))
    return rare.unionByName(refined).unionByName(without).unionByName(skeleton)


def similar_surnames(units: DataFrame, ratio: float = 0.8, common: int = 40) -> DataFrame:
    """``(a, b, equal)``: units, a < b, whose surnames are alike or ``equal``, and whose initials are the same or lacking."""
    keyed = written(candidates(units, common=common))
    x, y = keyed.alias("x"), keyed.alias("y")
    sx, sy = (F.split_part(f"{t}.unit", F.lit("|"), F.lit(2)) for t in "xy")
    longest = F.col("x.before").isNull() | (F.col("x.before") != F.col("y.before")) | (F.col("x.before") == "")
    initial = (F.col("x.initial") == F.col("y.initial")) | (F.col("x.initial") == "") | (F.col("y.initial") == "")
    # letters to leave out and to add are no fewer than letters to change, add and leave out
    met = merging(x, y, (F.col("x.key") == F.col("y.key")) & (F.col("x.unit") < F.col("y.unit")) & longest & initial & (F.levenshtein(sx, sy) <= (1 - ratio) * (F.length(sx) + F.length(sy)) + 1e-9))
    met = met.select(F.col("x.unit").alias("a"), F.col("y.unit").alias("b"), sx.alias("sa"), sy.alias("sb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = list(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True))
            keep = [alike(a, b, ratio) for a, b in pairs]
            equal = pa.array([a == b for a, b in pairs], pa.bool_())
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], equal], names=["a", "b", "equal"]).filter(pa.array(keep, pa.bool_()))

    return met.mapInArrow(run, "a string, b string, equal boolean").distinct()


def full_links(forms: DataFrame, near: DataFrame) -> DataFrame:
    """``(a, b)``: forms with full given names that match, of units with similar surnames."""
    near = near.where("not equal").select("a", "b")
    full = forms.where("given <> ''").select("unit", "form", "given", "known")
    keys = F.explode(letters_left_out(F.col("given"))).alias("key")
    x = merging(near, full.withColumnRenamed("unit", "a"), "a").select("a", "b", "form", "given", "known", keys).alias("x")
    y = merging(near, full.withColumnRenamed("unit", "b"), "b").select("a", "b", "form", "given", "known", keys).alias("y")
    fits = (F.col("x.given") == F.col("y.given")) | (~(F.col("x.known") & F.col("y.known")) & (F.levenshtein("x.given", "y.given", 2) >= 0))
    same = (F.col("x.a") == F.col("y.a")) & (F.col("x.b") == F.col("y.b")) & (F.col("x.key") == F.col("y.key"))
    return merging(x, y, same & fits).select(F.col("x.form").alias("a"), F.col("y.form").alias("b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """``(form, person)``: the smallest form that each linked form reaches."""
    return graph.components(links).select(F.col("node").alias("form"), F.col("head").alias("person"))


def spellings(df: DataFrame, short_names: DataFrame, author: str = "author", characters: str = "characters") -> DataFrame:
    """``(field, name)``: distinct normal forms of both fields, blanks left out."""
    a = df.select(F.lit("author").alias("field"), normal_form(F.col(author)).alias("name"))
    c = df.select(F.lit("characters").alias("field"), F.explode(F.col(characters)).alias("name")).select("field", normal_form(F.col("name")).alias("name"))
    return a.unionByName(c).where("name <> ''").distinct()


def short_name_rows(short_names: DataFrame, most: int = 20_000) -> list[tuple[str, str]]:
    """The fixed table of short names, refused beyond ``most`` rows."""
    rows = short_names.select("short_name", "given_name").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} short names")
    return [(r[0], r[1]) for r in rows]


def variants(df: DataFrame, short_names: DataFrame, author: str = "author", characters: str = "characters") -> DataFrame:
    """``(field, name, person)``: spellings and the persons they can mean, more than one only for ambiguous initials."""
    names = parsed(spellings(df, short_names, author, characters), short_name_rows(short_names))
    # no part of a name holds the mark
    unit = F.concat_ws("|", "field", "surname", "initial")
    form = F.concat_ws("|", "unit", "given", F.when(F.col("initial") == "", F.col("title")).otherwise(""))
    names = spread(names.withColumn("unit", unit).withColumn("form", form))
    forms = checkpoint(names.groupBy("form").agg(*(F.any_value(c).alias(c) for c in (*UNIT, "given", "known", "title"))))
    near = checkpoint(similar_surnames(checkpoint(forms.select(*UNIT).distinct())))
    brief = forms.where("given = ''").select("form", "unit", "initial", F.when(F.col("initial") == "", F.col("title")).alias("title"))

    # spellings without a full given name are linked to each other too, for those that no person takes
    u, v = brief.alias("u"), brief.alias("v")
    slipped = merging(merging(near.where("not equal"), u, F.col("a") == F.col("u.unit")), v, (F.col("b") == F.col("v.unit")) & (F.col("u.initial") == F.col("v.initial")) & F.col("u.title").eqNullSafe(F.col("v.title")))
    label = components(checkpoint(full_links(forms, near)).unionByName(slipped.select(F.col("u.form").alias("a"), F.col("v.form").alias("b"))))
    full = forms.where("given <> ''").select("form", "unit")
    person = written(merging(full, label, "form", "left").select("form", "unit", F.coalesce("person", "form").alias("person")))

    # where a spelling may find its person: under its own surname, or if nobody has it, under similar ones
    members = person.select(F.col("unit").alias("at"), "person").distinct()
    count = members.groupBy("at").agg(F.count("*").alias("n"), F.min("person").alias("one"))
    ways = near.select(F.col("a").alias("unit"), F.col("b").alias("at"), "equal").unionByName(near.select(F.col("b").alias("unit"), F.col("a").alias("at"), "equal"))
    ways = ways.unionByName(brief.select("unit", F.col("unit").alias("at"), F.lit(True).alias("equal")).distinct())
    places = merging(merging(brief, ways, "unit"), count, "at")
    own = Window.partitionBy("form")  # the units of one surname, and of those like it: an initial each
    places = checkpoint(places.withColumn("_best", F.max("equal").over(own)).where("equal = _best").select("form", "initial", "title", "at", "n", "one"))
    initialled = merging(places.where("initial <> ''").select("form", "at"), members, "at").select("form", "person").distinct()
    titles = merging(names.where("title <> ''").select("form", "title"), person, "form").select(F.col("unit").alias("at"), "person", "title").distinct()
    titled = merging(places.where("initial = ''").select("form", "at", "title"), titles, ["at", "title"]).select("form", "person").distinct()
    single = places.where("initial = ''").groupBy("form").agg(F.when((F.max("n") == 1) & (F.min("one") == F.max("one")), F.min("one")).alias("person")).where("person is not null")
    attached = written(initialled.unionByName(titled).unionByName(merging(single, titled.select("form").distinct(), "form", "left_anti").select("form", "person")))
    alone = merging(merging(brief.select("form"), attached.select("form").distinct(), "form", "left_anti"), label, "form", "left").select("form", F.coalesce("person", "form").alias("person"))
    persons = person.select("form", "person").unionByName(attached).unionByName(alone)
    return checkpoint(merging(names.select("field", "name", "form"), persons, "form").select("field", "name", "person").distinct())


def variant_pairs(persons: DataFrame) -> DataFrame:
    """``(field, name_a, name_b)``: spellings of one person, the smaller first."""
    x, y = persons.alias("x"), persons.alias("y")
    met = merging(x, y, (F.col("x.person") == F.col("y.person")) & (F.col("x.field") == F.col("y.field")) & (F.col("x.name") < F.col("y.name")))
    return met.select("x.field", F.col("x.name").alias("name_a"), F.col("y.name").alias("name_b")).distinct()
