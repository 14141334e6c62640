"""Delimited logs: the schemas they are read with, and how they are written."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.session import own_folder

SCAN_LOG = "timestamp string, original_filename string, status string, final_filename string, split string, borders string, trim string, zotero_item_code string"


def place(spark: SparkSession, name: str) -> str:
    """A new path of this application in the folder that all executors share."""
    return f"{own_folder(spark)}/{name}-{uuid.uuid4().hex}"


def write_scan_log(df: DataFrame, path: str, mode: str = "append") -> None:
    """Semicolons, every field quoted; appending never reads what is there."""
    df.write.mode(mode).csv(path, sep=";", quoteAll=True, escape='"', header=True, emptyValue="")


def read_scan_log(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """The log with its schema given, never inferred; timestamps that can't be read are null. Files split unless fields
    may hold line breaks (``multi_line``)."""
    raw = spark.read.csv(path, sep=";", quote='"', escape='"', header=True, schema=SCAN_LOG, multiLine=multi_line)
    return raw.withColumn("ts", F.try_to_timestamp("timestamp"))


def read_pipe_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A log with bars, its comment lines skipped and its fields trimmed."""
    raw = spark.read.csv(path, sep="|", comment="#", schema=schema)
    return raw.select(*(F.trim(c).alias(c) for c in raw.columns))


def upsert(old: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """Rows of both by key, the last by ``order`` wins: one partial maximum per key before the shuffle."""
    both = old.unionByName(new)
    rest = [x for x in both.columns if x != key]
    return both.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(order)).alias("r")).select(key, "r.*")
