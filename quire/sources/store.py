"""An entity-attribute-value library store over the test tables: items, their fields, creators and attachments.

Items are the scans of paper_identifiers; every field of an item is a row of item_data; creators keep their order;
attachments are the files that the scan log stored. Items read with a confidence under 0.1 count as deleted.
The same tables as SQL are in STORE_SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.sources.tables import table

#: Field names of the store and the columns they come from.
FIELDS = {"title": "title", "DOI": "doi", "publicationTitle": "journal", "date": "year", "language": "language"}


def scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "paper_identifiers")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item_id, item_type, key): the type follows from what is known of the item."""
    kind = F.when(F.col("journal").isNotNull(), "journalArticle").when(F.col("doi").isNotNull(), "conferencePaper").otherwise("bookSection")
    return scans(spark, sf_dir).select(F.col("request_id").alias("item_id"), kind.alias("item_type"), F.col("original_filename").alias("file_key"), "confidence")


def deleted_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items(spark, sf_dir).where("confidence < 0.1").select("item_id")


def item_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item_id, field_name, value): one row per field that an item has."""
    pairs = F.array(*(F.struct(F.lit(n).alias("field_name"), F.col(c).alias("value")) for n, c in FIELDS.items()))
    each = scans(spark, sf_dir).select(F.col("request_id").alias("item_id"), F.explode(pairs).alias("d"))
    return each.select("item_id", "d.field_name", "d.value").where(F.col("value").isNotNull())


def creators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item_id, order_index, name)."""
    return scans(spark, sf_dir).select(F.col("request_id").alias("item_id"), F.posexplode("authors").alias("order_index", "name")).where(F.col("name").isNotNull())


def attachments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item_id, attachment_key, path): the distinct files that successful runs stored for an item."""
    log = table(spark, sf_dir, "scan_log").where("final_filename is not null and zotero_item_code is not null")
    return log.join(items(spark, sf_dir), log.original_filename == F.col("file_key")).select("item_id", F.col("zotero_item_code").alias("attachment_key"), F.col("final_filename").alias("path")).distinct()


STORE_SQL = """
items AS (SELECT request_id AS item_id, CASE WHEN journal IS NOT NULL THEN 'journalArticle' WHEN doi IS NOT NULL THEN 'conferencePaper' ELSE 'bookSection' END AS item_type,
  original_filename AS file_key, confidence FROM paper_identifiers),
deleted_items AS (SELECT item_id FROM items WHERE confidence < 0.1),
item_data AS (SELECT request_id AS item_id, 'title' AS field_name, title AS value FROM paper_identifiers WHERE title IS NOT NULL
  UNION ALL SELECT request_id, 'DOI', doi FROM paper_identifiers WHERE doi IS NOT NULL
  UNION ALL SELECT request_id, 'publicationTitle', journal FROM paper_identifiers WHERE journal IS NOT NULL
  UNION ALL SELECT request_id, 'date', year FROM paper_identifiers WHERE year IS NOT NULL
  UNION ALL SELECT request_id, 'language', language FROM paper_identifiers WHERE language IS NOT NULL),
creators AS (SELECT item_id, order_index, name FROM (SELECT request_id AS item_id, unnest(range(len(authors))) AS order_index, unnest(authors) AS name FROM paper_identifiers) WHERE name IS NOT NULL),
attachments AS (SELECT DISTINCT i.item_id, l.zotero_item_code AS attachment_key, l.final_filename AS path FROM scan_log l JOIN items i ON l.original_filename = i.file_key
  WHERE l.final_filename IS NOT NULL AND l.zotero_item_code IS NOT NULL)
"""
