"""Normal forms and similarity scores of titles, names and records, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Weights of a composite score, and the scores from which a match is taken or looked at.
WEIGHTS = {"title": 0.45, "authors": 0.30, "year": 0.15, "type": 0.10, "language": 0.05}
ACCEPT, REVIEW, LANGUAGE_SURE = 0.85, 0.75, 0.9


def normal_title(c: Column) -> Column:
    """Lower-case letters and digits with single blanks."""
    return F.trim(F.regexp_replace(F.lower(c), r"[^a-z0-9]+", " "))


def words(c: Column) -> Column:
    """The distinct words of a normal form."""
    return F.array_distinct(F.filter(F.split(normal_title(c), " "), lambda w: w != ""))


def normal_author(c: Column) -> Column:
    """'Last, First' as 'First Last', without punctuation, its tokens sorted."""
    turned = F.when(F.contains(c, F.lit(",")), F.concat(F.regexp_extract(c, r",(.*)$", 1), F.lit(" "), F.regexp_extract(c, r"^([^,]*),", 1))).otherwise(c)
    plain = F.trim(F.regexp_replace(F.regexp_replace(F.lower(turned), r"[^a-z0-9\s]", ""), r"\s+", " "))
    return F.array_join(F.array_sort(F.split(plain, " ")), " ")


def overlap(a: Column, b: Column) -> Column:
    """Shared elements over the larger array; 0 if either is empty."""
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.greatest(F.size(a), F.size(b))).otherwise(0.0)


def year_of(c: Column) -> Column:
    """The first year in a date of any format."""
    return F.regexp_extract(c, r"(1[5-9]\d\d|20\d\d)", 1).try_cast("int")


def year_score(a: Column, b: Column) -> Column:
    """1 for the same year, a half for neighbours."""
    gap = F.abs(a - b)
    return F.when(gap == 0, 1.0).when(gap == 1, 0.5).otherwise(0.0)


def language_score(a: Column, b: Column, sure: Column) -> Column:
    """Null, and so without weight, if the candidate has no language or is unsure of it."""
    return F.when(b.isNull() | (F.trim(b) == "") | (sure < LANGUAGE_SURE), None).otherwise(F.when(F.lower(F.trim(a)) == F.lower(F.trim(b)), 1.0).otherwise(0.0))


def clean_title(c: Column) -> Column:
    """Lower case with single blanks, as titles are compared letter by letter."""
    return F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))


def type_score(a: Column, b: Column) -> Column:
    """1 for the same type whatever its spelling, a little for journal article and conference paper, 0 for unknown ones."""
    x, y = (F.regexp_replace(F.lower(F.trim(F.coalesce(t, F.lit("")))), "[^a-z0-9]", "") for t in (a, b))
    like = F.array(F.lit("journalarticle"), F.lit("conferencepaper"))
    near = F.array_contains(like, x) & F.array_contains(like, y)
    return F.when((x == "") | (y == ""), 0.0).when(x == y, 1.0).when(near, 0.3).otherwise(0.0)


def composite(title: Column, authors: Column, year: Column, kind: Column, language: Column) -> Column:
    """The weighted mean of the scores that are known."""
    total = WEIGHTS["title"] * title + WEIGHTS["authors"] * authors + WEIGHTS["year"] * year + WEIGHTS["type"] * kind
    known = F.when(language.isNull(), 1.0).otherwise(1.0 + WEIGHTS["language"])
    return (total + F.coalesce(WEIGHTS["language"] * language, F.lit(0.0))) / known


def decision(match: Column, conflict: Column, score: Column, accept: float = ACCEPT, review: float = REVIEW) -> Column:
    """What to do with a candidate, by its identifiers and else by its score."""
    return F.when(match, "auto_accept").when(conflict, F.when(score >= accept, "manual_review").otherwise("reject")).when(score >= accept, "auto_accept").when(score >= review, "manual_review").otherwise("reject")


def last_name(c: Column) -> Column:
    """The surname of 'Last, First' and of 'First Last'."""
    return F.when(F.contains(c, F.lit(",")), F.trim(F.regexp_extract(c, r"^([^,]*),", 1))).otherwise(F.regexp_extract(F.trim(c), r"(\S+)$", 1))
