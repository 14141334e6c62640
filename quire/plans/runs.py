"""Queries over delimited logs and streams, names in text, ratios and page profiles."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.functions import authors as au
from quire.functions.ratio import matching_ratio
from quire.functions.scoring import normal_title
from quire.plans.book import Book
from quire.sources import logs
from quire.sources.tables import table
from quire.streaming import runs

book = Book()
c = F.col

_LOG = ["original_filename", "status", "final_filename", "split", "borders", "trim", "zotero_item_code"]


@book.add("SELECT original_filename, count(*) AS runs, strftime(max(date_trunc('second', scanned_ts)), '%Y-%m-%d %H:%M:%S') AS last_run FROM scan_log WHERE coalesce(original_filename, '') <> '' GROUP BY 1")
def csv_log_roundtrip(spark, sf):
    """The log written with semicolons and quotes, and read again with its schema."""
    path = logs.place(spark, "scan-log")
    rows = table(spark, sf, "scan_log").select(F.date_format("scanned_ts", "yyyy-MM-dd HH:mm:ss").alias("timestamp"), *_LOG)
    logs.write_scan_log(rows, path)
    back = logs.read_scan_log(spark, path).where("original_filename IS NOT NULL AND original_filename <> ''")
    return back.groupBy("original_filename").agg(F.count("*").alias("runs"), F.date_format(F.max("ts"), "yyyy-MM-dd HH:mm:ss").alias("last_run"))


@book.add("SELECT s_suppkey AS key, s_name AS name FROM supplier")
def pipe_log_scan(spark, sf):
    """A log with bars whose comment lines are skipped; here one stands before each row."""
    path = logs.place(spark, "pipe-log")
    row = F.concat(c("s_suppkey").cast("string"), F.lit(" | "), c("s_name"))
    table(spark, sf, "supplier").select(F.explode(F.array(F.concat(F.lit("# next: "), row), row)).alias("line")).write.text(path)
    return logs.read_pipe_log(spark, path, "key string, name string").select(c("key").cast("long").alias("key"), "name")


@book.add("SELECT original_filename, day, status FROM (SELECT original_filename, coalesce(strftime(scanned_ts, '%Y-%m-%d %H:%M:%S.%f'), '') || coalesce(status, '') AS o, strftime(scanned_ts, '%Y-%m-%d') AS day, status FROM scan_log WHERE original_filename IS NOT NULL) QUALIFY row_number() OVER (PARTITION BY original_filename ORDER BY o DESC) = 1")
def keyed_upsert(spark, sf):
    """Old rows of a log, then new ones: the last per key stays."""
    log = table(spark, sf, "scan_log").where("original_filename IS NOT NULL")
    rows = log.select("original_filename", F.date_format("scanned_ts", "yyyy-MM-dd").alias("day"), "status", F.concat(F.coalesce(F.date_format("scanned_ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.lit("")), F.coalesce("status", F.lit(""))).alias("o"))
    cut = "2023-01-01"
    return logs.upsert(rows.where(F.coalesce("day", F.lit("")) < cut), rows.where(c("day") >= cut), "original_filename", "o").select("original_filename", "day", "status")


@book.add("SELECT original_filename AS scan, final_filename AS target, count(*) AS n FROM scan_log WHERE original_filename IS NOT NULL AND final_filename IS NOT NULL GROUP BY 1, 2")
def sessionized_lines(spark, sf):
    """Lines of a text log, where 'Moved to' lines belong to the last 'New scan' line before them."""
    log = table(spark, sf, "scan_log").where("original_filename IS NOT NULL").withColumn("run", F.monotonically_increasing_id())
    moved = F.when(c("final_filename").isNotNull(), F.concat(F.lit("Moved to "), c("final_filename")))
    lines = log.select("run", F.posexplode(F.array_compact(F.array(F.concat(F.lit("New scan: "), c("original_filename")), moved))).alias("no", "line"), F.pmod(F.hash("original_filename"), F.lit(8192)).alias("file"))
    scan = F.regexp_extract("line", "^New scan: (.*)$", 1)
    seen = F.last(F.when(scan != "", scan), ignorenulls=True).over(W.partitionBy("file").orderBy("run", "no").rowsBetween(W.unboundedPreceding, 0))
    return lines.withColumn("scan", seen).where("line LIKE 'Moved to %'").groupBy("scan", F.regexp_replace("line", "^Moved to ", "").alias("target")).agg(F.count("*").alias("n"))


@book.add("SELECT DISTINCT original_filename FROM scan_log")
def stream_first_sight(spark, sf):
    """A stream of log rows, each file written once however often it comes."""
    path = f"{sf}/scan_log.parquet"
    stream = runs.arriving(spark, path, spark.read.parquet(path).schema)
    seen = runs.first_sight(stream.withColumn("scanned_ts", F.coalesce("scanned_ts", F.lit("2000-01-01").cast("timestamp"))), "original_filename", "scanned_ts")
    return runs.settle_stream(seen.select("original_filename"), "first-sight")


@book.add("SELECT original_filename AS key, count(*) FILTER (WHERE lower(trim(status)) = 'failed') AS failures, CASE WHEN count(*) FILTER (WHERE lower(trim(status)) = 'success') > 0 THEN 'done' WHEN count(*) FILTER (WHERE lower(trim(status)) = 'failed') >= 3 THEN 'permanently_failed' ELSE 'retry' END AS state FROM scan_log WHERE original_filename IS NOT NULL GROUP BY 1")
def stream_retry_states(spark, sf):
    """Attempts of every file kept as state of a stream; the last state of each is the result."""
    path = f"{sf}/scan_log.parquet"
    states = runs.settle_stream(runs.retry_states(runs.arriving(spark, path, spark.read.parquet(path).schema), "original_filename", "status"), "retry", "update")
    return states.groupBy("key").agg(F.max_by(F.struct("failures", "state"), "batch").alias("s")).select("key", "s.*")


@book.add("SELECT event_type, strftime(time_bucket(INTERVAL '1 day', ts), '%Y-%m-%d') AS day, count(*) AS n FROM events GROUP BY 1, 2")
def stream_windows(spark, sf):
    """Daily counts of a stream with a watermark; the windows still open at the end are taken from the last update."""
    path = f"{sf}/events.parquet"
    stream = runs.arriving(spark, path, spark.read.parquet(path).schema).withColumn("ts", c("ts").cast("timestamp"))
    counts = runs.settle_stream(runs.windowed(stream, "ts", "1 day", "3650 days", "event_type"), "windows", "update")
    return counts.groupBy("event_type", F.date_format("window.start", "yyyy-MM-dd").alias("day")).agg(F.max("n").alias("n"))


@book.add()
def labelled_authors(spark, sf):
    """Names after an author label of every row with authors, split at commas and 'and', each once."""
    text = F.concat(F.lit("Title\nAuthor(s): "), F.array_join("authors", "; "), F.lit("\nBody"))
    return table(spark, sf, "paper_identifiers").where("authors IS NOT NULL").select("request_id", F.array_join(au.shaped(au.labelled_authors(text)), "; ").alias("authors"))


@book.add()
def title_ratio(spark, sf):
    """Ratio of matching blocks of each request's title and its candidates', of 80 and more; each distinct pair is compared once."""
    p = table(spark, sf, "paper_identifiers").where("title IS NOT NULL").select("request_id", normal_title(c("title")).alias("a"))
    m = table(spark, sf, "metadata_results").where("title IS NOT NULL").select("request_id", "result_id", normal_title(c("title")).alias("b"))
    pairs = p.join(m, "request_id")
    scores = pairs.select("a", "b").distinct().withColumn("ratio", F.round(matching_ratio("a", "b") * 100, 6)).where("ratio >= 80")
    return pairs.join(scores, ["a", "b"]).select("request_id", "result_id", "ratio")


_BAND = "(SELECT vec_id, embedding AS e, len(embedding) AS n FROM embeddings)"


@book.add(f"SELECT vec_id, CAST(list_position(e, list_min(e[n * 2 // 5 + 1 : n * 3 // 5])) AS BIGINT) AS gutter, round(len(list_filter(e, lambda x: x < 0)) / CAST(n AS DOUBLE), 6) AS density FROM {_BAND}")
def profile_gutter(spark, sf):
    """Of a profile of brightness: the place of the least value in the middle fifth, and the share of dark places."""
    n = F.size("embedding")
    band = F.slice("embedding", F.floor(n * 2 / 5).cast("int") + 1, F.floor(n * 3 / 5).cast("int") - F.floor(n * 2 / 5).cast("int"))
    dark = F.size(F.filter("embedding", lambda x: x < 0)) / n
    return table(spark, sf, "embeddings").select("vec_id", F.array_position("embedding", F.array_min(band)).alias("gutter"), F.round(dark, 6).alias("density"))


@book.add("SELECT label, count(*) AS pages, round(min(m) FILTER (WHERE m > 0) * 0.9, 6) AS border, round(stddev_pop(m) / (avg(m) + 1e-6), 6) AS cv FROM (SELECT label, CAST(list_max(embedding) AS DOUBLE) AS m FROM embeddings) GROUP BY 1")
def border_consensus(spark, sf):
    """A common border of many pages: nine tenths of the least one, and how much they differ."""
    m = F.array_max("embedding").cast("double")
    return table(spark, sf, "embeddings").select("label", m.alias("m")).groupBy("label").agg(F.count("*").alias("pages"), F.round(F.min(F.when(c("m") > 0, c("m"))) * 0.9, 6).alias("border"), F.round(F.stddev_pop("m") / (F.avg("m") + 1e-6), 6).alias("cv"))


QUERIES, ORACLE = book.queries, book.oracle
