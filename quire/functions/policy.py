"""Deciding on a candidate for a record, planning what it fills, applying and shrinking plans; all as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions import scoring as sc

#: The fields that a plan covers, and the rule of each.
FIELD_RULES = {
    "title": "manual", "authors": "manual", "year": "manual", "document_type": "manual", "doi": "manual_on_conflict", "isbn": "manual_on_conflict", "issn": "auto_if_missing", "journal": "auto_if_missing",
    "publicationTitle": "auto_if_missing", "volume": "auto_if_missing", "issue": "auto_if_missing", "pages": "auto_if_missing", "publisher": "auto_if_missing", "url": "auto_if_missing", "abstract": "auto_if_missing",
    "language": "auto_if_missing_with_confidence", "tags": "manual",
}


def _set(x: Column) -> Column:
    return F.coalesce(x, F.lit("")) != ""


def identifier_states(ours: list[Column], theirs: list[Column]) -> tuple[Column, Column]:
    """(whether any identifier is the same on both sides, whether any is another), where both sides have it."""
    low = lambda x: F.coalesce(F.lower(F.trim(x)), F.lit(""))
    both = [((low(a) != "") & (low(b) != ""), low(a) == low(b)) for a, b in zip(ours, theirs)]
    same, other = F.lit(False), F.lit(False)
    for known, equal in both:
        same, other = same | (known & equal), other | (known & ~equal)
    return same, other


def reason(match: Column, conflict: Column, score: Column, accept: float = sc.ACCEPT, review: float = sc.REVIEW) -> Column:
    """Why ``sc.decision`` decides as it does."""
    by_score = F.when(score >= accept, "strong_composite").when(score >= review, "weak_composite").otherwise("weak_match")
    return F.when(match, "identifier_match").when(conflict, "identifier_conflict").otherwise(by_score)


def plan(ours: dict[str, Column], theirs: dict[str, Column], sure: Column) -> tuple[Column, Column]:
    """(map of the fields to fill, array of the fields to look at) by FIELD_RULES; absent fields count as missing."""
    fills, looks = [], []
    for field, rule in FIELD_RULES.items():
        o, t = ours.get(field, F.lit(None).cast("string")), theirs.get(field, F.lit(None).cast("string"))
        gap, differs = ~_set(o) & _set(t), _set(t) & ~t.eqNullSafe(o)
        fill, look = F.lit(False), F.lit(False)
        if rule == "manual":
            look = differs
        elif rule == "manual_on_conflict":
            fill, look = gap, differs & _set(o)
        elif rule == "auto_if_missing":
            fill = gap
        else:
            known = F.coalesce(sure >= sc.LANGUAGE_SURE, F.lit(True))
            fill, look = gap & known, gap & ~known
        fills.append(F.when(fill, F.struct(F.lit(field).alias("k"), t.alias("v"))))
        looks.append(F.when(look, F.lit(field)))
    return F.map_from_entries(F.array_compact(F.array(*fills))), F.array_compact(F.array(*looks))


def apply(record: Column, updates: Column, overwrite: Column, candidate: Column) -> tuple[Column, Column]:
    """(the record with the updates and the fields to overwrite, the names of those applied). Fields that are updates
    already are not overwritten again; tags, joined by commas, are only ever added to."""
    more = F.map_filter(candidate, lambda k, v: F.array_contains(overwrite, k) & ~F.array_contains(F.map_keys(updates), k) & _set(v))
    tags = lambda x: F.filter(F.split(F.coalesce(x, F.lit("")), ","), lambda t: t != "")
    added = F.transform_values(more, lambda k, v: F.when(k == "tags", F.array_join(F.array_union(tags(F.try_element_at(record, F.lit("tags"))), tags(v)), ",")).otherwise(v))
    new = F.map_concat(updates, added)
    kept = F.map_filter(record, lambda k, v: ~F.array_contains(F.map_keys(new), k))
    return F.map_concat(kept, new), F.map_keys(new)


def shrink(updates: Column, manual: Column, applied: Column) -> tuple[Column, Column]:
    """A plan without the fields that are applied."""
    return F.map_filter(updates, lambda k, v: ~F.array_contains(applied, k)), F.array_except(manual, applied)
