"""Queries over processing logs and event streams: filters, upserts, latest states, counters, windows."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.operators import ordered
from quire.plans.book import Book
from quire.sources.tables import table

book = Book()
#: Width of a bucket of event time, in microseconds.
DAY = 86_400_000_000
c = F.col

_STATUS = "regexp_replace(lower(trim(status)), '[^a-z]+', '_', 'g')"


def status(x):
    """A status without case and punctuation."""
    return F.regexp_replace(F.lower(F.trim(x)), "[^a-z]+", "_")


@book.add(f"SELECT original_filename, zotero_item_code, strftime(scanned_ts, '%Y-%m-%d') AS day FROM scan_log WHERE {_STATUS} = 'success' AND zotero_item_code IS NOT NULL AND final_filename IS NOT NULL AND scanned_ts >= TIMESTAMP '2023-01-01'")
def log_filter(spark, sf):
    """Successful, stored runs since a day; pushed down to the scan as far as they are plain predicates."""
    ok = (status(c("status")) == "success") & c("zotero_item_code").isNotNull() & c("final_filename").isNotNull() & (c("scanned_ts") >= F.lit("2023-01-01").cast("timestamp"))
    return table(spark, sf, "scan_log").where(ok).select("original_filename", "zotero_item_code", F.date_format("scanned_ts", "yyyy-MM-dd").alias("day"))


@book.add(f"SELECT original_filename, {_STATUS} AS last_status, final_filename FROM (SELECT DISTINCT * FROM scan_log) WHERE original_filename IS NOT NULL QUALIFY row_number() OVER (PARTITION BY original_filename ORDER BY scanned_ts DESC NULLS LAST, logged_at DESC NULLS LAST, status, final_filename NULLS LAST) = 1")
def latest_status(spark, sf):
    """The last run of every file wins: one partial maximum per file before the shuffle, however often it ran."""
    far = F.lit("0001-01-01").cast("timestamp")
    key = F.struct((-F.unix_micros(F.coalesce("scanned_ts", far))).alias("a"), (-F.unix_micros(F.coalesce("logged_at", far))).alias("b"), F.coalesce("status", F.lit("￿")).alias("c"), F.coalesce("final_filename", F.lit("￿")).alias("d"))
    best = table(spark, sf, "scan_log").where("original_filename IS NOT NULL").groupBy("original_filename").agg(F.min_by(F.struct("status", "final_filename"), key).alias("m"))
    return best.select("original_filename", status(c("m.status")).alias("last_status"), "m.final_filename")


@book.add(f"SELECT action, count(*) AS n FROM (SELECT CASE {_STATUS} WHEN 'success' THEN 'done' WHEN 'failed' THEN 'failed' WHEN 'skipped' THEN 'skipped' ELSE 'other' END AS action FROM scan_log) GROUP BY 1")
def action_counters(spark, sf):
    """Runs by kind of outcome."""
    s = status(c("status"))
    action = F.when(s == "success", "done").when(s == "failed", "failed").when(s == "skipped", "skipped").otherwise("other")
    return table(spark, sf, "scan_log").groupBy(action.alias("action")).agg(F.count("*").alias("n"))


@book.add(f"SELECT count(*) FILTER (WHERE {_STATUS} = 'success') AS success, count(*) FILTER (WHERE {_STATUS} = 'failed') AS failed, count(*) FILTER (WHERE {_STATUS} NOT IN ('success', 'failed')) AS others, count(*) AS total FROM scan_log WHERE status IS NOT NULL")
def queue_stats(spark, sf):
    s = status(c("status"))
    return table(spark, sf, "scan_log").where("status IS NOT NULL").agg(F.count_if(s == "success").alias("success"), F.count_if(s == "failed").alias("failed"), F.count_if(~s.isin("success", "failed")).alias("others"), F.count("*").alias("total"))


@book.add(f"SELECT original_filename, attempts, failures, CASE WHEN successes > 0 THEN 'done' WHEN failures >= 3 THEN 'permanently_failed' ELSE 'retry' END AS state FROM (SELECT original_filename, count(*) AS attempts, count(*) FILTER (WHERE {_STATUS} = 'failed') AS failures, count(*) FILTER (WHERE {_STATUS} = 'success') AS successes FROM (SELECT DISTINCT * FROM scan_log) WHERE original_filename IS NOT NULL GROUP BY 1)")
def retry_state(spark, sf):
    """Attempts of every file, and whether it may be tried again."""
    s = status(c("status"))
    g = table(spark, sf, "scan_log").distinct().where("original_filename IS NOT NULL").groupBy("original_filename")
    g = g.agg(F.count("*").alias("attempts"), F.count_if(s == "failed").alias("failures"), F.count_if(s == "success").alias("ok"))
    state = F.when(c("ok") > 0, "done").when(c("failures") >= 3, "permanently_failed").otherwise("retry")
    return g.select("original_filename", "attempts", "failures", state.alias("state"))


@book.add("SELECT count(*) AS rows, count(DISTINCT original_filename) AS files, (SELECT count(*) FROM (SELECT DISTINCT * FROM scan_log)) AS distinct_rows FROM scan_log")
def log_dedup(spark, sf):
    """Exact duplicates of the log, counted in one pass over its distinct rows."""
    log = table(spark, sf, "scan_log")
    each = log.groupBy(*log.columns).agg(F.count("*").alias("k"))
    return each.agg(F.sum("k").alias("rows"), F.countDistinct("original_filename").alias("files"), F.count("*").alias("distinct_rows"))


@book.add("SELECT request_id, original_filename FROM paper_identifiers p WHERE NOT EXISTS (SELECT 1 FROM scan_log l WHERE l.original_filename = p.original_filename AND l.final_filename IS NOT NULL)")
def insert_if_absent(spark, sf):
    """Files that the log has not stored yet: what an idempotent append would write."""
    return table(spark, sf, "paper_identifiers").select("request_id", "original_filename").join(table(spark, sf, "scan_log").where("final_filename IS NOT NULL").select("original_filename"), "original_filename", "left_anti")


@book.add(f"WITH late AS (SELECT original_filename, max(final_filename) AS stored FROM scan_log WHERE {_STATUS} = 'success' GROUP BY 1) SELECT p.request_id, CASE WHEN l.original_filename IS NULL THEN 'keep' WHEN l.stored IS NULL THEN 'no_file' ELSE 'update' END AS action, coalesce(l.stored, p.original_filename) AS filename FROM paper_identifiers p LEFT JOIN late l ON l.original_filename = p.original_filename")
def keyed_update(spark, sf):
    """An update by key without inserts: rows that have a later value take it, the rest stay."""
    late = table(spark, sf, "scan_log").where(status(c("status")) == "success").groupBy("original_filename").agg(F.max("final_filename").alias("stored"), F.lit(True).alias("hit"))
    action = F.when(c("hit").isNull(), "keep").when(c("stored").isNull(), "no_file").otherwise("update")
    return table(spark, sf, "paper_identifiers").join(late, "original_filename", "left").select("request_id", action.alias("action"), F.coalesce("stored", "original_filename").alias("filename"))


@book.add("""WITH a AS (SELECT original_filename AS k, max(final_filename) AS f FROM scan_log WHERE split IS NOT NULL AND split <> '' GROUP BY 1), b AS (SELECT original_filename AS k, max(final_filename) AS f FROM scan_log WHERE trim IS NOT NULL AND trim <> '' GROUP BY 1)
 SELECT coalesce(a.k, b.k) AS original_filename, CASE WHEN a.k IS NOT NULL THEN a.f ELSE b.f END AS final_filename, CASE WHEN a.k IS NOT NULL THEN 'a' ELSE 'b' END AS origin FROM a FULL JOIN b ON a.k = b.k WHERE coalesce(a.k, b.k) IS NOT NULL""")
def override_union(spark, sf):
    """Two sets of entries by key, where those of the first replace those of the second as a whole."""
    log = table(spark, sf, "scan_log")
    a = log.where("split IS NOT NULL AND split <> ''").groupBy(c("original_filename").alias("k")).agg(F.struct(F.max("final_filename").alias("f"), F.lit("a").alias("origin")).alias("a"))
    b = log.where("trim IS NOT NULL AND trim <> ''").groupBy(c("original_filename").alias("k")).agg(F.struct(F.max("final_filename").alias("f"), F.lit("b").alias("origin")).alias("b"))
    return a.join(b, "k", "full").where("k IS NOT NULL").select(c("k").alias("original_filename"), F.coalesce("a", "b").alias("x")).select("original_filename", c("x.f").alias("final_filename"), "x.origin")


@book.add(r"""SELECT file_key, base || CASE WHEN k = 1 THEN '' ELSE '_' || k END || '.pdf' AS target FROM (SELECT original_filename AS file_key, base, CAST(row_number() OVER (PARTITION BY base ORDER BY original_filename) AS VARCHAR) AS k FROM (SELECT original_filename, regexp_replace(original_filename, '(_\d+)?\.pdf$', '') AS base FROM paper_identifiers))""".replace("WHEN k = 1", "WHEN k = '1'"))
def collision_suffix(spark, sf):
    """Target names with a number where several files would have the same."""
    base = F.regexp_replace("original_filename", r"(_\d+)?\.pdf$", "")
    df = table(spark, sf, "paper_identifiers").select(c("original_filename").alias("file_key"), base.alias("base"))
    return ordered.numbered(df, "base", ["file_key"], "k").select("file_key", F.concat("base", F.when(c("k") == 1, "").otherwise(F.concat(F.lit("_"), c("k").cast("string"))), F.lit(".pdf")).alias("target"))


@book.add("SELECT strftime(date_trunc('month', scanned_ts), '%Y-%m') AS month, count(*) AS runs, count(DISTINCT original_filename) AS files, round(avg(epoch_us(logged_at) - epoch_us(scanned_ts)) / 1e6, 3) AS mean_delay_s FROM scan_log WHERE scanned_ts IS NOT NULL AND logged_at IS NOT NULL GROUP BY 1")
def runs_per_month(spark, sf):
    log = table(spark, sf, "scan_log").where("scanned_ts IS NOT NULL AND logged_at IS NOT NULL")
    delay = F.unix_micros("logged_at") - F.unix_micros("scanned_ts")
    return log.groupBy(F.date_format("scanned_ts", "yyyy-MM").alias("month")).agg(F.count("*").alias("runs"), F.countDistinct("original_filename").alias("files"), F.round(F.avg(delay) / 1e6, 3).alias("mean_delay_s"))


@book.add("SELECT event_type, count(*) AS n, round(stddev_pop(value) / (avg(value) + 1e-6), 6) AS cv, round(min(value) FILTER (WHERE value > 0) * 0.9, 6) AS low_bound, round(median(value), 6) AS median_value FROM events GROUP BY 1")
def spread_per_type(spark, sf):
    """Coefficient of variation, nine tenths of the least positive value, and median of each kind."""
    v = c("value")
    return table(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.stddev_pop(v) / (F.avg(v) + 1e-6), 6).alias("cv"), F.round(F.min(F.when(v > 0, v)) * 0.9, 6).alias("low_bound"), F.round(F.median(v), 6).alias("median_value"))


@book.add("SELECT collection_key, lang AS winner, n, total FROM (SELECT collection_key, lang, count(*) AS n, CAST(sum(count(*)) OVER (PARTITION BY collection_key) AS BIGINT) AS total FROM documents GROUP BY 1, 2) WHERE 2 * n > total AND lang <> 'en'")
def majority_vote(spark, sf):
    """The label that more than half of a collection's documents have, where it is not the usual one."""
    g = table(spark, sf, "documents").groupBy("collection_key", "lang").agg(F.count("*").alias("n"))
    return g.withColumn("total", F.sum("n").over(W.partitionBy("collection_key"))).where("2 * n > total AND lang <> 'en'").select("collection_key", c("lang").alias("winner"), "n", "total")


@book.add("SELECT event_type, strftime(time_bucket(INTERVAL '1 hour', ts), '%Y-%m-%d %H') AS hour, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def tumbling_counts(spark, sf):
    """Events in windows of an hour."""
    g = table(spark, sf, "events").groupBy("event_type", F.window("ts", "1 hour").alias("w"))
    return g.agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select("event_type", F.date_format("w.start", "yyyy-MM-dd HH").alias("hour"), "n", "total")


@book.add("SELECT user_id, count(*) AS sessions, CAST(max(n) AS BIGINT) AS longest FROM (SELECT user_id, sess, count(*) AS n FROM (SELECT user_id, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS sess FROM (SELECT user_id, ts, event_id, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS NULL OR epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) > 21600000000 THEN 1 ELSE 0 END AS fresh FROM events)) GROUP BY 1, 2) GROUP BY 1")
def sessions(spark, sf):
    """Sessions of each user, parted by six hours without an event; found per day, then joined over the days."""
    events = table(spark, sf, "events").withColumn("us", F.unix_micros(c("ts").cast("timestamp")))
    found = ordered.sessions(events, "user_id", "us", 21_600_000_000, DAY)
    return found.groupBy("user_id").agg(F.count("*").alias("sessions"), F.max("n").alias("longest"))


@book.add("SELECT e.event_id, p.event_id AS previous_view FROM events e ASOF JOIN (SELECT * FROM events WHERE event_type = 'view') p ON e.user_id = p.user_id AND e.ts > p.ts WHERE e.event_type <> 'view'")
def previous_view(spark, sf):
    """The last view of the same user before each other event: an as-of join per day, with what the day before left."""
    e = table(spark, sf, "events").withColumn("us", F.unix_micros(c("ts").cast("timestamp")))
    seen = ordered.last_before(e, "user_id", "us", c("event_type") == "view", "event_id", DAY, "previous_view")
    return seen.where("event_type <> 'view' AND previous_view IS NOT NULL").select("event_id", "previous_view")


QUERIES, ORACLE = book.queries, book.oracle
