"""The best representative of each group of records, and the best value of each field.

One aggregation per group takes the least ordering key, as a whole and among the rows whose field is good. It combines
on the map side, so a group with a third of all rows moves one partial result per task and never meets in one place.

Rows without a time are ordered by currency. From the rows with times, each attribute's values per group are put in
the order they were last seen, and the steps between neighbours are counted; a step that goes one way clearly more
often than the other is a precedence, and their transitive closure, without values that come after each other, a partial
order of the values. A row is current in an attribute if no value of its group comes after its own, and the rows current
in most attributes are the latest. Learning works on one row per group, attribute and value, so no group is large there
either; steps, precedences and closure are tables, of any number of values, and never reach the driver.

Defined results: unknown confidence (null, NaN, negative, over 100) comes last; unknown sources come after all known
ones; ties fall to the smallest id; rows without a group are left out; repeated rows count each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.leakage import LOOKS
from quire.session import settle

#: A step must have been seen so often, and so many times as often as its reverse, to be a precedence.
LEAST_STEPS, ODDS = 5, 3.0
#: Least words of an abstract, and the share of its words in the title that makes it the title again.
LEAST_WORDS, TITLE_SHARE = 8, 0.6


# full-width letters, look-alikes of Latin ones and special spaces, and what they stand for
_FROM = "".join(map(chr, range(0xFF41, 0xFF5B))) + "".join(map(chr, LOOKS)) + "\u3000\u00a0\u2009\u202f\u2007"
_TO = "abcdefghijklmnopqrstuvwxyz" + "".join(map(chr, LOOKS.values())) + " " * 5


def common_confidence(c: Column) -> Column:
    """Confidence on the scale of 0-100; null if unknown."""
    known = c.isNotNull() & ~F.isnan(c) & (c >= 0) & (c <= 100)
    return F.when(known, F.round(F.when(c <= 1, c * 100).otherwise(c), 6))


def source_name(c: Column) -> Column:
    """A source's name without case, blanks and the word API."""
    return F.regexp_replace(F.lower(F.trim(c)), r"[\s_-]*api$", "")


def full_abstract(abstract: Column, title: Column) -> Column:
    """Whether the text is the work's own abstract to its end: running sentences, closed, other than the title."""
    plain = F.trim(F.regexp_replace(F.regexp_replace(abstract, r"<[^<>]{1,60}>", " "), r"\s+", " "))
    plain = F.regexp_replace(plain, r"^\p{Lu}\p{L}+: ?", "")
    words = lambda c: F.array_distinct(F.filter(F.split(F.regexp_replace(F.translate(F.lower(c), _FROM, _TO), r"[^a-z\s]", ""), r"\s+"), lambda x: F.length(x) > 0))
    own = words(plain)
    again = F.size(F.array_intersect(own, words(F.coalesce(F.regexp_replace(title, "<[^<>]{1,60}>", " "), F.lit(""))))) >= F.size(own) * TITLE_SHARE
    ended = plain.rlike(r"[.!?。]['\"”’»)\]]*$") & ~plain.rlike(r"(\.\.\.|…)[\])]*$")
    opened, closed = F.regexp_count(abstract, F.lit(r"<[a-zA-Z][\w:]*[^<>/]*>")), F.regexp_count(abstract, F.lit(r"</[\w:]+>"))
    enough = F.size(F.split(plain, " ")) >= LEAST_WORDS
    return F.coalesce(ended & enough & (opened == closed) & ~again, F.lit(False))


def _values(df: DataFrame, group: str, attributes: list[str], *more: Column) -> DataFrame:
    """(g, more, attribute, value) of every row with a group and a value."""
    each = F.explode(F.array(*(F.struct(F.lit(a).alias("attribute"), F.col(a).cast("string").alias("value")) for a in attributes)))
    out = df.where(F.col(group).isNotNull()).select(F.col(group).alias("g"), *more, each.alias("v"))
    return out.select("g", *out.columns[1:-1], "v.attribute", "v.value").where("value IS NOT NULL")


def learn_precedence(df: DataFrame, group: str, time: str, attributes: list[str]) -> DataFrame:
    """(attribute, value, after): every value that comes after a value, by steps seen in the rows with times."""
    last = _values(df.where(F.col(time).isNotNull()), group, attributes, F.col(time).alias("t")).groupBy("g", "attribute", "value").agg(F.max("t").alias("t"))
    order = Window.partitionBy("g", "attribute").orderBy("t", "value")
    steps = last.withColumn("after", F.lead("value").over(order)).where("after IS NOT NULL")
    counted = settle(steps.groupBy("attribute", "value", "after").agg(F.count("*").alias("n")))
    back = counted.select("attribute", F.col("value").alias("after"), F.col("after").alias("value"), F.col("n").alias("m"))
    clear = (F.col("n") >= LEAST_STEPS) & (F.col("n") > ODDS * F.coalesce("m", F.lit(0)))
    known = settle(counted.join(back, ["attribute", "value", "after"], "left").where(clear).select("attribute", "value", "after"))
    size = known.count()
    while size:  # paths of twice the length in each round
        step = known.select("attribute", F.col("value").alias("after"), F.col("after").alias("further"))
        known = settle(known.unionAll(known.join(step, ["attribute", "after"]).select("attribute", "value", F.col("further").alias("after"))).distinct())
        before, size = size, known.count()
        if size == before:
            break
    circles = known.select("attribute", F.col("value").alias("after"), F.col("after").alias("value"))
    return known.join(circles, ["attribute", "value", "after"], "left_anti")


def currency(df: DataFrame, group: str, time: str, attributes: list[str], id_col: str) -> DataFrame:
    """(id, currency) of every row without a time: the attributes in which no value of its group comes after its own."""
    after = learn_precedence(df, group, time, attributes)
    missing = df.where(F.col(time).isNull() & F.col(group).isNotNull())
    own = _values(missing, group, attributes).distinct()
    held = _values(df, group, attributes).distinct().withColumnRenamed("value", "after")
    outdated = own.join(after, ["attribute", "value"]).join(held, ["g", "attribute", "after"], "left_semi").select("g", "attribute", "value").distinct()
    current = own.join(outdated, ["g", "attribute", "value"], "left_anti")
    rows = _values(missing, group, attributes, F.col(id_col).alias("id")).join(current, ["g", "attribute", "value"])
    count = rows.groupBy(F.col("id").alias(id_col)).agg(F.count("*").cast("int").alias("n"))
    return missing.select(id_col).join(count, id_col, "left").select(id_col, F.coalesce("n", F.lit(0)).alias("currency"))


def ordering(df: DataFrame, trust: DataFrame, id_col: str, group: str, time: str, attributes: list[str]) -> DataFrame:
    """``df`` with ``key``, a struct whose least value is the group's best row."""
    ranked = trust.groupBy(source_name(F.col("source")).alias("source_name")).agg(F.min("trust_rank").alias("trust"))
    out = df.withColumn("source_name", source_name(F.col("source"))).join(ranked, "source_name", "left")
    if not df.where(F.col(time).isNull() & F.col(group).isNotNull()).select(id_col).isEmpty():
        out = out.join(currency(df, group, time, attributes, id_col), id_col, "left")
    else:
        out = out.withColumn("currency", F.lit(None).cast("int"))
    return out.withColumn("key", F.struct(
        F.coalesce(-common_confidence(F.col("confidence")), F.lit(1.0)).alias("c"),
        F.coalesce("trust", F.lit(2**31 - 1)).alias("t"),
        F.coalesce(-F.unix_micros(time), F.lit(2**63 - 1)).alias("f"),
        (-F.coalesce("currency", F.lit(0))).alias("u"),
        F.col(id_col).alias("id"),
    ))


def survivors(df: DataFrame, trust: DataFrame, id_col: str = "result_id", group: str = "request_id", time: str = "fetched_at") -> DataFrame:
    """(group, field_name, id): 'record' for each group of two rows or more, 'abstract' where one is full."""
    narrow = df.select(id_col, group, "source", "confidence", time, "language", full_abstract(F.col("abstract"), F.col("title")).alias("full"))
    keyed = ordering(narrow, trust, id_col, group, time, ["language"]).where(F.col(group).isNotNull())
    best = keyed.groupBy(group).agg(
        F.count("*").alias("rows"), F.min("key").alias("record"), F.min(F.when(F.col("full"), F.col("key"))).alias("abstract")
    ).where(F.col("rows") >= 2)
    fields = F.explode(F.array(*(F.struct(F.lit(n).alias("field_name"), F.col(f"{n}.id").alias("id")) for n in ("record", "abstract"))))
    return best.select(group, fields.alias("x")).select(group, "x.field_name", F.col("x.id").alias(id_col)).where(F.col(id_col).isNotNull())


def merged_records(df: DataFrame, trust: DataFrame, id_col: str = "result_id", group: str = "request_id", time: str = "fetched_at") -> DataFrame:
    """One built record per group: every field from the first row, by the same order, that has a good value."""
    good = {
        "title": F.trim("title") != "",
        "abstract": full_abstract(F.col("abstract"), F.col("title")),
        "publication_date": F.col("publication_date").rlike(r"\d{4}"),
        "language": ~F.lower(F.trim("language")).isin("", "und", "unknown", "xx", "??", "n/a"),
        "authors": F.size("authors") > 0,
    }
    narrow = df.select(id_col, group, "source", "confidence", time, *good)
    keyed = ordering(narrow, trust, id_col, group, time, ["language"]).where(F.col(group).isNotNull())
    return keyed.groupBy(group).agg(
        F.count("*").alias("rows"), F.min_by(id_col, "key").alias(id_col),
        *(F.min_by(F.when(ok, F.col(n)), F.when(ok, F.col("key"))).alias(n) for n, ok in good.items()),
    )
