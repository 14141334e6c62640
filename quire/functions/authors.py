"""Names of authors in text, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions.scoring import last_name

_LABEL = r"(?im)^\s*author(?:s|\(s\))?\s*:[^\S\n]*(\S.*)$"
_TOKEN = r"(\p{Lu}[\p{Ll}'’-]+(-\p{Lu}\p{Ll}+)?|\p{Lu}{2,}|\p{Lu}\.)"


def labelled_authors(text: Column) -> Column:
    """The names after an 'Author(s):' label, split at semicolons, commas and words for and; distinct, in their order."""
    line = F.regexp_extract(text, _LABEL, 1)
    names = F.transform(F.split(line, r"\s*(?:;|,|\sand\s|&)\s*"), lambda x: F.trim(x))
    return F.array_distinct(F.filter(names, lambda x: x != ""))


def shaped(names: Column) -> Column:
    """The names of two to four capitalised tokens; all of them if none is."""
    good = F.filter(names, lambda x: x.rlike(rf"^{_TOKEN}(\s+{_TOKEN}){{1,3}}$"))
    return F.when(F.size(good) > 0, good).otherwise(names)


def without_known(names: Column, known: Column) -> Column:
    """Names that a list does not have, without regard to case."""
    low = F.transform(known, F.lower)
    return F.filter(names, lambda x: ~F.array_contains(low, F.lower(x)))


def spoken(text: Column) -> Column:
    """A text as its words alone, in lower case between single blanks, so that whole words are found as parts of it."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " ")), F.lit(" "))


def in_text(names: Column, body: Column) -> Column:
    """The names whose surname stands as a word in ``body``, which is ``spoken``."""
    return F.filter(names, lambda x: (F.trim(spoken(last_name(x))) != "") & F.contains(body, spoken(last_name(x))))


def validated(names: Column, text: Column, printed: Column) -> Column:
    """The names that the text confirms; the printed ones where it confirms none or is empty and there are any. Without
    text and printed names the names stay."""
    body = spoken(text)
    own = F.coalesce(names, F.array().cast("array<string>"))
    known, others = in_text(own, body), F.coalesce(printed, F.array().cast("array<string>"))
    return F.when(F.trim(body) == "", F.when(F.size(others) > 0, others).otherwise(own)).when((F.size(known) == 0) & (F.size(others) > 0), others).otherwise(known)


def near_each_other(name: Column, text: Column, letters: int = 40) -> Column:
    """Whether the first and the last word of a name stand within some letters of each other."""
    words = F.split(F.trim(spoken(name)), " ")
    a, b = F.get(words, F.lit(0)), F.get(words, F.size(words) - 1)
    beside = lambda x, y: F.rlike(F.lower(text), F.concat(F.lit(r"(?s)\b\Q"), x, F.lit(rf"\E\b.{{0,{letters}}}\b\Q"), y, F.lit(r"\E\b")))
    return F.coalesce(beside(a, b) | beside(b, a), F.lit(False))


#: Two to four capitalised words, initials among them.
NAME = r"(\p{Lu}[\p{Ll}'’-]+(?:[ \t]+\p{Lu}\.){0,2}(?:[ \t]+\p{Lu}[\p{Ll}'’-]+){1,2})"
#: Words that begin or are part of what is no person.
NO_NAMES = "the an university department institute school college press journal society committee association abstract introduction january february march april may june july august september october november december".split()


def names_in(text: Column) -> Column:
    """The distinct names in a text by their shape, without those that hold a word that no person's name has."""
    found = F.regexp_extract_all(text, F.lit(NAME), 1)
    odd = lambda x: F.arrays_overlap(F.split(F.lower(x), r"\s+"), F.array(*map(F.lit, NO_NAMES)))
    return F.array_distinct(F.filter(found, lambda x: ~odd(x)))
