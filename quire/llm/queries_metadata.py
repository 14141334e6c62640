"""Queries over the sources' answers and library items."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from quire.llm import encoding, linkage, lookalike, names, survivor
from quire.sources.tables import table


def p1_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate pairs of library items and source answers, with the confidence that they are about one work."""
    items = table(spark, sf_dir, "search_results").select(F.col("search_id").alias("id"), "title", "authors", F.col("year").alias("date"))
    answers = table(spark, sf_dir, "metadata_results").select(F.col("result_id").alias("id"), "title", "authors", F.col("publication_date").alias("date"))
    return linkage.matched(items, answers).withColumnsRenamed({"a_id": "search_id", "b_id": "result_id"})


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Library items and source answers about the same work."""
    return p1_confidence(spark, sf_dir).where("confidence >= 0.5").select("search_id", "result_id").distinct()


def _titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    metadata = table(spark, sf_dir, "metadata_results").select(F.lit("metadata").alias("record_kind"), F.col("result_id").alias("record_id"), "title")
    return metadata.unionAll(table(spark, sf_dir, "search_results").select(F.lit("search"), "search_id", "title"))


def p3_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every title in one consistent form."""
    titles = _titles(spark, sf_dir)
    return lookalike.consistent(titles, "title", lookalike.string_counts(titles, "title"))


@F.pandas_udf(BooleanType())
def _garbled(texts: pd.Series) -> pd.Series:
    return texts.map(lambda x: bool(x) and encoding.repair(x)[0]).astype(bool)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every title that is rewritten, and was not decoded wrongly."""
    titles = _titles(spark, sf_dir)
    counts = lookalike.string_counts(titles, "title")
    if all(not k.isascii() for k in lookalike.representatives(counts)):
        titles = titles.where(F.col("title").rlike(r"[^\x00-\x7F]"))  # no other title can change
    changed = lookalike.consistent(titles, "title", counts).where("plain <> title")
    return changed.where(~_garbled("title")).select("record_kind", "record_id").distinct()


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The surviving row of every request, and the row that has its best abstract."""
    return survivor.survivors(table(spark, sf_dir, "metadata_results"), table(spark, sf_dir, "source_trust"))


def p4_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One record built field by field for every request."""
    return survivor.merged_records(table(spark, sf_dir, "metadata_results"), table(spark, sf_dir, "source_trust"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every title and list of authors with a wrongly decoded value."""
    return p5_restored(spark, sf_dir).select("result_id", "field_name").distinct()


def p5_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every wrongly decoded value with what it was, as far as it can be restored."""
    return encoding.repaired(table(spark, sf_dir, "metadata_results"), ["result_id"], encoding.title_and_authors())


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every author that means a catalogue entry under another spelling."""
    mentions = None
    for kind, name, key in (("metadata", "metadata_results", "result_id"), ("search", "search_results", "search_id"), ("identifiers", "paper_identifiers", "request_id")):
        each = table(spark, sf_dir, name).select(F.lit(kind).alias("record_kind"), F.col(key).alias("record_id"), F.posexplode("authors").alias("pos", "name"))
        each = each.where(F.col("name").isNotNull()).select("record_kind", "record_id", (F.col("pos") + 1).alias("author_no"), "name")
        mentions = each if mentions is None else mentions.unionAll(each)
    return names.linked(mentions, table(spark, sf_dir, "author_catalogue")).select("record_kind", "record_id", "author_no", "author_id").distinct()


QUERIES = {"p1_found": p1_found, "p1_confidence": p1_confidence, "p6_found": p6_found, "p3_found": p3_found, "p3_titles": p3_titles, "p5_found": p5_found, "p5_restored": p5_restored, "p4_found": p4_found, "p4_records": p4_records}
_W = "list_distinct(list_filter(string_split_regex(regexp_replace(translate(lower({0}), '" + survivor._FROM + "', '" + survivor._TO + r"'), '[^a-z\s]', '', 'g'), '\s+'), lambda w: w <> ''))"
_PLAIN = r"regexp_replace(trim(regexp_replace(regexp_replace(abstract, '<[^<>]{1,60}>', ' ', 'g'), '\s+', ' ', 'g')), '^\p{Lu}\p{L}+: ?', '')"
_TITLE = "coalesce(regexp_replace(title, '<[^<>]{1,60}>', ' ', 'g'), '')"
_FULL = rf"""coalesce(regexp_matches({_PLAIN}, '[.!?。][''"”’»)\]]*$') AND NOT regexp_matches({_PLAIN}, '(\.\.\.|…)[\])]*$') AND len(string_split({_PLAIN}, ' ')) >= {survivor.LEAST_WORDS}
 AND len(regexp_extract_all(abstract, '<[a-zA-Z][\w:]*[^<>/]*>')) = len(regexp_extract_all(abstract, '</[\w:]+>')) AND len(list_intersect({_W.format(_PLAIN)}, {_W.format(_TITLE)})) < {survivor.TITLE_SHARE} * len({_W.format(_PLAIN)}), false)"""
_NAME = r"regexp_replace(lower(trim({0})), '[\s_-]*api$', '')"

ORACLE: dict[str, str] = {
    "p4_found": f"""WITH t AS (SELECT {_NAME.format('source')} AS s, min(trust_rank) AS r FROM source_trust GROUP BY 1),
 m AS (SELECT request_id, result_id, CASE WHEN confidence >= 0 AND confidence <= 100 THEN round(CASE WHEN confidence <= 1 THEN confidence * 100 ELSE confidence END, 6) END AS c, coalesce(t.r, 2147483647) AS r, fetched_at, {_FULL} AS whole
  FROM metadata_results LEFT JOIN t ON {_NAME.format('source')} = t.s WHERE request_id IS NOT NULL),
 k AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY c DESC NULLS LAST, r, fetched_at DESC NULLS LAST, result_id) AS k, count(*) OVER (PARTITION BY request_id) AS n FROM m)
 SELECT request_id, 'record' AS field_name, result_id FROM k WHERE k = 1 AND n > 1 UNION ALL SELECT request_id, 'abstract', arg_min(result_id, k) FROM k WHERE whole AND n > 1 GROUP BY 1""",
}
