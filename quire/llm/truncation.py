"""Texts cut off by field limits or in transfer, and how often each source cuts.

Lengths: for every source, in characters and in bytes, the hazard of length L is the share of the texts of at least L
that end at L. Window functions give the texts at risk and the hazard of the lengths around L, which is all texts that
end there over all that could have; an exact Poisson tail tests the one hazard against the other, and
Benjamini-Hochberg holds the false discoveries among all tests of a source down. A limit in one unit shows in the other
as well (texts cut at 1800 characters gather at 1800 to 1806 bytes), so each text counts for the more significant of its
two lengths, and a length stays a limit only if the texts that count for it pass alone.

Endings: each text's last paragraph is read by its form as 'complete', 'closing' (reference, date line, address and
the like), 'open' (inside a word or sentence) or 'doubtful' (an ellipsis, or capitalised words alone). At a limit both
open and doubtful endings are cut; elsewhere, where only a broken transfer cuts, open ones alone.

Only lengths are aggregated, so the shuffle is a few rows per source and length and no source's rows ever meet in one
task. Defined results: null and blank texts are never cut and not counted; a null source is one of its own; repeated
rows count each; extra columns do not matter.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from quire.session import settle

#: Lengths on each side that a hazard is held against, false-discovery rate, and least texts at a limit.
NEIGHBOURS, FDR, LEAST = 40, 0.01, 5

_CLOSING_LINE = "|".join([
    r"^[–—-]?\s*\d{1,4}\s*[–—-]?$",  # page number
    r"^(©|\(c\)|Copyright\b)",
    r"^\p{Lu}\p{L}+:\s",  # a labelled list
    r"\b\d{1,2}\.? \p{L}+ \d{4}$|\b\d{4}-\d{2}-\d{2}$",  # a date
    r"\bvol\. ?\d+(, no\. ?\d+)?$",
    r"\(\d{4}\p{Ll}?\)\..*\d+[–-]\d+$",  # a reference
    r"(https?://|doi:)\S+$",
])
_MARK = r"(&#?\w{0,7}|\x{FFFD}|\p{L}[-\x{00AD}])$"  # broken entity, broken byte sequence, broken word
_ELLIPSIS = r"(…|\.\.\.|\[…\]|\[\.\.\.\])$"
_COMPLETE = r"[.!?。]['\"”’»)\]]*$"


def ending(line: Column, para: Column) -> Column:
    """'complete', 'closing', 'open' or 'doubtful', by the last line and the last paragraph of a text."""
    caps = lambda c: F.size(F.regexp_extract_all(c, F.lit(r"(?<![\p{L}'’-])(\p{Lu})"), 1))
    small = lambda c: F.size(F.regexp_extract_all(c, F.lit(r"(?<![\p{L}'’-])(\p{Ll})"), 1))
    sentences = para.rlike(r"(\p{Ll}{2}|[)\]\d])[.!?]\s")
    lines = F.split(para, "\n")
    address = (F.size(lines) > 1) & ~sentences & F.forall(lines, lambda x: x.rlike(r"^\p{Lu}") & (caps(x) >= small(x)))
    bare = ~sentences & (F.size(lines) == 1) & (small(para) == 0) & (caps(para) > 3)
    tip = F.right(line, F.lit(12))
    return (
        F.when(tip.rlike(_MARK), "open")
        .when(tip.rlike(_ELLIPSIS), F.when(tip.rlike(r"\[(…|\.\.\.)\]$"), "open").otherwise("doubtful"))
        .when(line.rlike(_CLOSING_LINE), "closing")
        .when(tip.rlike(_COMPLETE), "complete")
        .when(address, "closing")
        .when(bare, "doubtful")
        .otherwise("open")
    )


def endings(df: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """(id, source, ending, chars, bytes) of every text that is not blank; narrow, so cheap to keep."""
    blank = F.lit(" \n\t\r\f\v\u00a0\u2028\u2029")
    cut = df.select(
        F.col(id_col),
        F.col(source_col).cast("string").alias("source"),
        F.char_length(text_col).alias("chars"),
        F.octet_length(text_col).alias("bytes"),
        F.rtrim(F.substring_index(F.rtrim(F.replace(F.col(text_col), F.lit("\r"), F.lit("")), blank), "\n\n", -1), blank).alias("para"),
    ).where(F.length("para") > 0)
    cut = cut.withColumn("line", F.substring_index("para", "\n", -1))
    return cut.select(id_col, "source", ending(F.col("line"), F.col("para")).alias("ending"), "chars", "bytes")


@F.pandas_udf(DoubleType())
def _poisson_tail(seen: pd.Series, expected: pd.Series) -> pd.Series:
    """P(X >= seen) for a Poisson X with the expected mean."""

    def tail(k: float, mean: float) -> float:
        if k <= mean:
            return 1.0
        total, term = 0.0, math.exp(k * math.log(mean) - mean - math.lgamma(k + 1))
        while term > total * 1e-12 and k < 1e12:
            total += term
            k += 1
            term *= mean / k
        return min(1.0, total)

    return pd.Series([tail(float(k), max(float(m), 1e-9)) for k, m in zip(seen, expected)])


def _lengths(unit: str) -> Column:
    return F.struct(F.lit(unit).alias("unit"), F.col(unit).cast("long").alias("length"))


def length_tests(ends: DataFrame, neighbours: int = NEIGHBOURS) -> DataFrame:
    """(source, unit, length, texts, at_risk, hazard, near_hazard, p_value) of every length at which a text ends."""
    counted = ends.groupBy("source", "chars", "bytes").agg(F.count("*").alias("k"))  # one row per pair of lengths from here on
    counted = counted.select("source", F.explode(F.array(_lengths("chars"), _lengths("bytes"))).alias("u"), "k").groupBy("source", "u.unit", "u.length").agg(F.sum("k").alias("texts"))
    group = Window.partitionBy("source", "unit").orderBy("length")
    around = group.rangeBetween(-neighbours, neighbours)
    total = F.sum("texts").over(Window.partitionBy("source", "unit"))
    at_risk = total - F.sum("texts").over(group.rowsBetween(Window.unboundedPreceding, Window.currentRow)) + F.col("texts")
    beyond = total - F.sum("texts").over(group.rangeBetween(Window.unboundedPreceding, neighbours))
    # each text is at risk at the lengths of the range up to its own
    exposed = beyond * (2 * neighbours + 1) + F.sum(F.col("texts") * F.col("length")).over(around) + F.sum("texts").over(around) * (neighbours + 1 - F.col("length"))
    out = counted.withColumn("at_risk", at_risk).withColumn("near", F.sum("texts").over(around) - F.col("texts")).withColumn("exposed", exposed - F.col("at_risk"))
    # half a text more, so that a lone length among none is not taken for one
    out = out.withColumn("hazard", F.col("texts") / F.col("at_risk")).withColumn("near_hazard", (F.col("near") + 0.5) / F.greatest("exposed", F.lit(1)))
    out = out.withColumn("p_value", _poisson_tail(F.col("texts").cast("double"), F.col("at_risk") * F.col("near_hazard")))
    return out.select("source", "unit", "length", "texts", "at_risk", "hazard", "near_hazard", "p_value")


def length_limits(ends: DataFrame, neighbours: int = NEIGHBOURS, fdr: float = FDR, least: int = LEAST) -> DataFrame:
    """(source, unit, length, texts, hazard, near_hazard, p_value): lengths at which a source ends far too many texts."""
    group = Window.partitionBy("source", "unit")
    ranked = length_tests(ends, neighbours).withColumn("rank", F.row_number().over(group.orderBy("p_value", "length"))).withColumn("tests", F.count("*").over(group))
    held = F.when(F.col("p_value") * F.col("tests") <= F.col("rank") * fdr, F.col("rank"))
    passed = settle(ranked.withColumn("last", F.max(held).over(group)).where((F.col("rank") <= F.col("last")) & (F.col("texts") >= least)))
    # each text for the more significant of its two lengths
    pairs = ends.groupBy("source", "chars", "bytes").agg(F.count("*").alias("k"))
    for unit in ("chars", "bytes"):
        one = passed.where(F.col("unit") == unit).select(F.col("source").alias("s"), F.col("length").alias("l"), F.struct("p_value", -F.col("texts"), F.lit(unit == "bytes")).alias(f"{unit}_p"))
        pairs = pairs.join(one, F.col("source").eqNullSafe(F.col("s")) & (F.col(unit) == F.col("l")), "left").drop("s", "l")
    own = F.when(F.col("chars_p") <= F.coalesce("bytes_p", "chars_p"), _lengths("chars")).otherwise(_lengths("bytes"))
    kept = pairs.where(F.coalesce("chars_p", "bytes_p").isNotNull()).select("source", own.alias("u"), "k").groupBy("source", "u.unit", "u.length").agg(F.sum("k").alias("own"))
    kept = kept.select(F.col("source").alias("s"), F.col("unit").alias("v"), F.col("length").alias("l"), "own")
    out = passed.join(kept, F.col("source").eqNullSafe(F.col("s")) & (F.col("unit") == F.col("v")) & (F.col("length") == F.col("l"))).where(F.col("own") >= least)
    alone = _poisson_tail(F.col("own").cast("double"), F.col("at_risk") * F.col("near_hazard"))
    out = out.withColumn("alone", alone).where(F.col("alone") * F.col("tests") <= F.col("last") * fdr)
    return out.select("source", "unit", "length", "texts", "hazard", "near_hazard", "p_value")


def truncated(ends: DataFrame, limits: DataFrame, id_col: str) -> DataFrame:
    """(id, source, ending, rule) of every cut text; rule 'limit' or 'transfer'."""
    at = ends.where(F.col("ending").isin("open", "doubtful"))
    for unit in ("chars", "bytes"):
        one = limits.where(F.col("unit") == unit).select(F.col("source").alias("s"), F.col("length").alias("l"), F.lit(True).alias(f"by_{unit}")).distinct()
        at = at.join(one, F.col("source").eqNullSafe(F.col("s")) & (F.col(unit) == F.col("l")), "left").drop("s", "l")
    limit = F.coalesce("by_chars", "by_bytes", F.lit(False))
    return at.where(limit | (F.col("ending") == "open")).select(id_col, "source", "ending", F.when(limit, "limit").otherwise("transfer").alias("rule"))


def source_report(ends: DataFrame, cut: DataFrame, id_col: str) -> DataFrame:
    """(source, texts, cut, at_limit, cut_share) of every source."""
    rules = cut.groupBy("source").agg(F.count("*").alias("cut"), F.count_if(F.col("rule") == "limit").alias("at_limit"))
    total = ends.groupBy("source").agg(F.count("*").alias("texts"))
    rules = rules.withColumnRenamed("source", "s")
    out = total.join(rules, F.col("source").eqNullSafe(F.col("s")), "left").drop("s").na.fill(0, ["cut", "at_limit"])
    return out.withColumn("cut_share", F.col("cut") / F.col("texts"))


def measured(df: DataFrame, id_col: str, text_col: str, source_col: str) -> tuple[DataFrame, DataFrame]:
    """The kept endings of all texts, and the cut ones; the texts are read once."""
    ends = settle(endings(df, id_col, text_col, source_col))
    return ends, truncated(ends, length_limits(ends), id_col)
