"""The grammar of page plans, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _ends(part: Column) -> tuple[Column, Column]:
    bare = F.regexp_replace(part, "^-", "")
    return F.substring_index(bare, "-", 1).try_cast("int"), F.substring_index(bare, "-", -1).try_cast("int")


def _pages(part: Column) -> Column:
    first, last = _ends(part)
    return F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))


def page_plan(plan: Column, pages: Column) -> Column:
    """struct(kept array of arrays of pages, dropped pages, keep_only, error) of a plan for a number of pages.

    Parts stand between semicolons: '7' or '1-12' is an output, '-13' or '-13-15' is dropped. Two semicolons in a row
    make a plan that drops all that it does not name; a plan that only drops keeps the runs between. A part that can't
    be read, pages out of range or named twice, and uncovered pages of other plans are errors, and then nothing is kept."""
    parts = F.filter(F.transform(F.split(plan, ";"), lambda x: F.trim(x)), lambda x: x != "")
    good = F.forall(parts, lambda x: x.rlike(r"^-?\d{1,9}(-\d{1,9})?$") & (_ends(x)[0] <= _ends(x)[1]) & (_ends(x)[0] >= 1) & (_ends(x)[1] <= pages))
    safe = F.when(good, parts).otherwise(F.array().cast("array<string>"))
    outs, dropped = F.transform(F.filter(safe, lambda x: ~x.startswith("-")), _pages), F.flatten(F.transform(F.filter(safe, lambda x: x.startswith("-")), _pages))
    keep_only = F.contains(plan, F.lit(";;")) & (F.size(outs) > 0)
    every = F.when(pages >= 1, F.sequence(F.lit(1), pages)).otherwise(F.array().cast("array<int>"))
    edges = F.concat(F.array(F.lit(0)), F.array_sort(dropped), F.array(pages + 1))
    gaps = F.filter(F.transform(F.slice(edges, F.lit(2), F.size(edges) - 1), lambda x, i: F.struct(F.get(edges, i).alias("a"), x.alias("b"))), lambda g: g.b - g.a > 1)
    between = F.transform(gaps, lambda g: F.sequence(g.a + 1, g.b - 1))
    kept = F.when(F.size(outs) > 0, outs).otherwise(between)
    named = F.concat(F.flatten(kept), dropped)
    rest = F.array_except(every, named)
    error = (
        F.when(~good | plan.isNull() | pages.isNull(), "unreadable part or page out of range").when(F.size(parts) == 0, "no parts")
        .when(F.size(named) != F.size(F.array_distinct(named)), "page named twice").when(~keep_only & (F.size(rest) > 0), "uncovered pages")
    )
    fine = error.isNull()
    none = F.array().cast("array<int>")
    return F.struct(
        F.when(fine, kept).otherwise(F.array().cast("array<array<int>>")).alias("kept"), F.when(fine, F.array_sort(F.concat(dropped, F.when(keep_only, rest).otherwise(none)))).otherwise(none).alias("dropped"),
        keep_only.alias("keep_only"), error.alias("error"),
    )


def plan_text(kept: Column, dropped: Column) -> Column:
    """A plan in words: the outputs by their first and last page, then the dropped pages."""
    span = lambda x: F.concat(F.array_min(x).cast("string"), F.lit("-"), F.array_max(x).cast("string"))
    return F.concat(F.array_join(F.transform(kept, span), ";"), F.lit(" without "), F.array_join(F.transform(dropped, lambda x: x.cast("string")), ","))
