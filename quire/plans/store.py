"""Queries over the library store: scans, projections, joins and aggregates."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.plans.book import Book
from quire.sources import store
from quire.sources.store import STORE_SQL
from quire.sources.tables import table

book = Book()
WITH = f"WITH {STORE_SQL}"


def wide(spark, sf, fields=store.FIELDS):
    """One row per item with its fields as columns: one shuffle for all fields, deleted items out."""
    data = store.item_data(spark, sf).join(store.deleted_items(spark, sf), "item_id", "left_anti")
    return data.groupBy("item_id").agg(*(F.max(F.when(F.col("field_name") == n, F.col("value"))).alias(n.lower()) for n in fields))


_WIDE = WITH + """, wide AS (SELECT item_id, max(CASE WHEN field_name='title' THEN value END) AS title, max(CASE WHEN field_name='DOI' THEN value END) AS doi,
 max(CASE WHEN field_name='publicationTitle' THEN value END) AS publicationtitle, max(CASE WHEN field_name='date' THEN value END) AS date, max(CASE WHEN field_name='language' THEN value END) AS language
 FROM item_data WHERE item_id NOT IN (SELECT item_id FROM deleted_items) GROUP BY item_id)"""


@book.add(_WIDE + " SELECT * FROM wide")
def eav_pivot(spark, sf):
    """Entity-attribute-value rows to one wide row per item, without the deleted ones."""
    return wide(spark, sf)


@book.add(WITH + " SELECT i.* EXCLUDE (confidence, file_key) FROM items i WHERE item_id NOT IN (SELECT item_id FROM deleted_items)")
def soft_delete(spark, sf):
    """Items that are not deleted, by a null-safe anti join."""
    return store.items(spark, sf).join(store.deleted_items(spark, sf), "item_id", "left_anti").select("item_id", "item_type")


@book.add(_WIDE + """ SELECT w.item_id, CASE item_type WHEN 'journalArticle' THEN 'Journal' WHEN 'conferencePaper' THEN 'Conference' WHEN 'bookSection' THEN 'Book' END AS label,
 CASE item_type WHEN 'journalArticle' THEN publicationtitle END AS value FROM wide w JOIN items i USING (item_id)""")
def container_info(spark, sf):
    """The container of each item by its type: label and name."""
    kind = F.col("item_type")
    label = F.when(kind == "journalArticle", "Journal").when(kind == "conferencePaper", "Conference").when(kind == "bookSection", "Book")
    return wide(spark, sf).join(store.items(spark, sf), "item_id").select("item_id", label.alias("label"), F.when(kind == "journalArticle", F.col("publicationtitle")).alias("value"))


@book.add(WITH + " SELECT field_name, value, count(*) AS items FROM item_data JOIN items USING (item_id) WHERE field_name IN ('publicationTitle','language') AND item_type = 'journalArticle' GROUP BY 1, 2")
def field_values_by_type(spark, sf):
    """How often each value of a field stands in items of one type."""
    data = store.item_data(spark, sf).where(F.col("field_name").isin("publicationTitle", "language"))
    return data.join(store.items(spark, sf).where("item_type = 'journalArticle'"), "item_id").groupBy("field_name", "value").agg(F.count("*").alias("items"))


@book.add(WITH + " SELECT DISTINCT item_id, item_type FROM creators JOIN items USING (item_id) WHERE name ILIKE '%strom%' OR name ILIKE '%gard%'")
def author_like(spark, sf):
    """Items with an author whose name holds one of several parts, in any case."""
    hit = store.creators(spark, sf).where(F.col("name").ilike("%strom%") | F.col("name").ilike("%gard%"))
    return store.items(spark, sf).join(hit, "item_id", "left_semi").select("item_id", "item_type")


def search_items(spark, sf, year_from=None, year_to=None, types=None):
    """Items by optional year and type filters, chained only where given."""
    df = wide(spark, sf).join(store.items(spark, sf), "item_id").withColumn("year", F.expr("try_cast(regexp_extract(date, '(\\\\d{4})', 1) AS int)"))
    if year_from is not None:
        df = df.where(F.col("year") >= year_from)
    if year_to is not None:
        df = df.where(F.col("year") <= year_to)
    if types:
        df = df.where(F.col("item_type").isin(*types))
    return df


@book.add(_WIDE + """ SELECT item_id, title, CAST(year AS BIGINT) AS year FROM (SELECT w.*, item_type, try_cast(regexp_extract(date, '(\\d{4})', 1) AS INT) AS year FROM wide w JOIN items i USING (item_id))
 WHERE year >= 1990 AND year <= 2010 AND item_type IN ('journalArticle','conferencePaper')""")
def optional_filters(spark, sf):
    return search_items(spark, sf, 1990, 2010, ["journalArticle", "conferencePaper"]).select("item_id", "title", F.col("year").cast("long").alias("year"))


@book.add(WITH + " SELECT item_id, count(*) AS attachments, count(*) FILTER (WHERE lower(path) LIKE '%.pdf') AS pdfs FROM items LEFT JOIN attachments a USING (item_id) WHERE a.path IS NOT NULL GROUP BY 1")
def attachment_children(spark, sf):
    """Attachments of each parent item."""
    return store.items(spark, sf).join(store.attachments(spark, sf), "item_id").groupBy("item_id").agg(F.count("*").alias("attachments"), F.count_if(F.lower("path").endswith(".pdf")).alias("pdfs"))


@book.add(WITH + """ SELECT i.item_id, coalesce(string_agg(name, '; ' ORDER BY order_index), '') AS authors, max(CASE WHEN a.item_id IS NOT NULL THEN 1 ELSE 0 END) = 1 AS has_attachment
 FROM items i LEFT JOIN creators c ON c.item_id = i.item_id LEFT JOIN (SELECT DISTINCT item_id FROM attachments) a ON a.item_id = i.item_id GROUP BY 1""")
def item_side_tables(spark, sf):
    """Ordered authors and attachment flag of every item, from side tables aggregated once instead of look-ups per item."""
    names = store.creators(spark, sf).groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct("order_index", "name"))).alias("c"))
    names = names.select("item_id", F.array_join("c.name", "; ").alias("authors"))
    files = store.attachments(spark, sf).select("item_id").distinct().withColumn("has_attachment", F.lit(True))
    out = store.items(spark, sf).select("item_id").join(names, "item_id", "left").join(files, "item_id", "left")
    return out.select("item_id", F.coalesce("authors", F.lit("")).alias("authors"), F.coalesce("has_attachment", F.lit(False)).alias("has_attachment"))


@book.add(WITH + " SELECT item_type, count(*) AS items, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS pct FROM items GROUP BY 1")
def items_per_type(spark, sf):
    """Items and their share by type."""
    counted = store.items(spark, sf).groupBy("item_type").agg(F.count("*").alias("items"))
    return counted.withColumn("pct", F.round(F.lit(100.0) * F.col("items") / F.sum("items").over(W.partitionBy()), 6))


@book.add(_WIDE + """ SELECT item_type, round(avg(CASE WHEN doi IS NOT NULL AND doi <> '' THEN 100.0 ELSE 0.0 END), 6) AS doi_pct, round(avg(CASE WHEN date IS NOT NULL AND date <> '' THEN 100.0 ELSE 0.0 END), 6) AS date_pct,
 round(avg(CASE WHEN language IS NOT NULL AND language <> '' THEN 100.0 ELSE 0.0 END), 6) AS language_pct FROM wide JOIN items USING (item_id) GROUP BY 1""")
def completeness(spark, sf):
    """Share of items of each type that have each field."""
    has = lambda c: F.round(F.avg(F.when(F.col(c).isNotNull() & (F.col(c) != ""), 100.0).otherwise(0.0)), 6)
    return wide(spark, sf).join(store.items(spark, sf), "item_id").groupBy("item_type").agg(has("doi").alias("doi_pct"), has("date").alias("date_pct"), has("language").alias("language_pct"))


@book.add(WITH + " SELECT name, count(*) AS papers FROM creators WHERE item_id NOT IN (SELECT item_id FROM deleted_items) GROUP BY 1")
def papers_per_author(spark, sf):
    return store.creators(spark, sf).join(store.deleted_items(spark, sf), "item_id", "left_anti").groupBy("name").agg(F.count("*").alias("papers"))


@book.add(_WIDE + " SELECT publicationtitle AS journal, lower(trim(publicationtitle)) AS normalized, count(*) AS papers FROM wide JOIN items USING (item_id) WHERE item_type = 'journalArticle' AND trim(publicationtitle) <> '' GROUP BY 1, 2")
def papers_per_journal(spark, sf):
    df = wide(spark, sf).join(store.items(spark, sf), "item_id").where("item_type = 'journalArticle' AND trim(publicationtitle) <> ''")
    return df.groupBy(F.col("publicationtitle").alias("journal"), F.lower(F.trim("publicationtitle")).alias("normalized")).agg(F.count("*").alias("papers"))


@book.add(WITH + " SELECT value, count(*) AS n FROM item_data WHERE field_name = 'publicationTitle' GROUP BY 1 ORDER BY n DESC, value LIMIT 25")
def most_common_values(spark, sf):
    """The most frequent values of a field: a top-N report."""
    return store.item_data(spark, sf).where("field_name = 'publicationTitle'").groupBy("value").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value").limit(25)


@book.add(WITH + " SELECT lpad(CAST(n AS VARCHAR), 4, ' ') || ' | ' || value AS line FROM (SELECT value, count(*) AS n FROM item_data WHERE field_name = 'language' GROUP BY 1)")
def count_report_lines(spark, sf):
    """Fixed-width lines of a count report."""
    counted = store.item_data(spark, sf).where("field_name = 'language'").groupBy("value").agg(F.count("*").alias("n"))
    return counted.select(F.format_string("%4d | %s", "n", "value").alias("line"))


@book.add(_WIDE + """ SELECT item_id, title, date, rank FROM (SELECT item_id, title, date, publicationtitle, row_number() OVER (PARTITION BY publicationtitle ORDER BY date DESC NULLS LAST, item_id) AS rank FROM wide WHERE publicationtitle IS NOT NULL) WHERE rank <= 5""")
def newest_per_journal(spark, sf):
    """The five newest items of each journal, by the text of their date."""
    rank = F.row_number().over(W.partitionBy("publicationtitle").orderBy(F.desc_nulls_last("date"), "item_id"))
    return wide(spark, sf).where("publicationtitle IS NOT NULL").withColumn("rank", rank.cast("long")).where("rank <= 5").select("item_id", "title", "date", "rank")


@book.add(WITH + """, p AS (SELECT *, replace(lower(path), '/', '\\') AS norm FROM attachments) SELECT item_id, attachment_key, regexp_extract(path, '([^/\\\\]+)$', 1) AS base,
 norm = 'p:\\papers\\' || lower(regexp_extract(path, '([^/\\\\]+)$', 1)) OR ends_with(norm, '\\' || lower(regexp_extract(path, '([^/\\\\]+)$', 1))) AS path_matches FROM p""")
def path_match(spark, sf):
    """Base name of each stored path, and whether the path is the expected one under either kind of slash."""
    df = store.attachments(spark, sf).withColumn("base", F.regexp_extract("path", r"([^/\\]+)$", 1)).withColumn("norm", F.translate(F.lower("path"), "/", "\\"))
    match = (F.col("norm") == F.concat(F.lit("p:\\papers\\"), F.lower("base"))) | F.col("norm").endswith(F.concat(F.lit("\\"), F.lower("base")))
    return df.select("item_id", "attachment_key", "base", match.alias("path_matches"))


@book.add(WITH + r""", v AS (SELECT DISTINCT original_filename AS f, unnest([original_filename, replace(original_filename, '_scanned', ''), regexp_replace(replace(original_filename, 'scan_', ''), '_\d+\.pdf$', '.pdf')]) AS variant,
  unnest([0, 1, 2]) AS priority FROM scan_log), names AS (SELECT attachment_key, regexp_extract(path, '([^/\\]+)$', 1) AS base FROM attachments)
 SELECT f AS original_filename, attachment_key FROM (SELECT f, attachment_key, row_number() OVER (PARTITION BY f ORDER BY priority, attachment_key) AS k FROM v JOIN names ON lower(base) = lower(variant)) WHERE k = 1""")
def path_variants(spark, sf):
    """The attachment of each logged file by the first variant of its name that a stored file has."""
    f = F.col("original_filename")
    variants = F.array(*(F.struct(F.lit(i).alias("priority"), v.alias("variant")) for i, v in enumerate((f, F.replace(f, F.lit("_scanned"), F.lit("")), F.regexp_replace(F.replace(f, F.lit("scan_"), F.lit("")), r"_\d+\.pdf$", ".pdf")))))
    each = table(spark, sf, "scan_log").select(f).distinct().select(f, F.inline(variants))
    names = store.attachments(spark, sf).select("attachment_key", F.lower(F.regexp_extract("path", r"([^/\\]+)$", 1)).alias("base"))
    hit = each.join(names, F.lower("variant") == F.col("base"))
    return hit.groupBy("original_filename").agg(F.min(F.struct("priority", "attachment_key")).alias("m")).select("original_filename", "m.attachment_key")


@book.add(WITH + """ SELECT item_type, title_len, count(*) AS items FROM (SELECT item_type, CAST(floor(len(value) / 20) * 20 AS BIGINT) AS title_len FROM item_data JOIN items USING (item_id) WHERE field_name = 'title') GROUP BY 1, 2""")
def title_length_histogram(spark, sf):
    data = store.item_data(spark, sf).where("field_name = 'title'").join(store.items(spark, sf), "item_id")
    return data.groupBy("item_type", (F.floor(F.char_length("value") / 20) * 20).cast("long").alias("title_len")).agg(F.count("*").alias("items"))


@book.add(WITH + """ SELECT name, last_name, first_name FROM (SELECT DISTINCT name, CASE WHEN contains(name, ',') THEN trim(regexp_extract(name, '^([^,]*),', 1)) ELSE regexp_extract(trim(name), '(\\S+)$', 1) END AS last_name,
 CASE WHEN contains(name, ',') THEN trim(regexp_extract(name, ',(.*)$', 1)) ELSE trim(regexp_extract(trim(name), '^(.*)\\s\\S+$', 1)) END AS first_name FROM creators)""")
def split_author_names(spark, sf):
    """Last and first name of every author, with or without a comma."""
    n = F.col("name")
    last = F.when(F.contains(n, F.lit(",")), F.trim(F.regexp_extract(n, r"^([^,]*),", 1))).otherwise(F.regexp_extract(F.trim(n), r"(\S+)$", 1))
    first = F.when(F.contains(n, F.lit(",")), F.trim(F.regexp_extract(n, r",(.*)$", 1))).otherwise(F.trim(F.regexp_extract(F.trim(n), r"^(.*)\s\S+$", 1)))
    return store.creators(spark, sf).select(n).distinct().select(n, last.alias("last_name"), first.alias("first_name"))


@book.add("SELECT r.request_id, m.result_id, m.source, m.confidence FROM paper_identifiers r JOIN metadata_results m ON r.request_id = m.request_id WHERE m.confidence > 0 QUALIFY row_number() OVER (PARTITION BY r.request_id ORDER BY m.confidence DESC, m.result_id) = 1")
def best_candidate(spark, sf):
    """The best answer to each request: highest confidence, the first on ties; partial maxima before the shuffle."""
    m = table(spark, sf, "metadata_results").where("confidence > 0")
    best = m.groupBy("request_id").agg(F.max_by(F.struct("result_id", "source", "confidence"), F.struct("confidence", -F.col("result_id"))).alias("b"))
    return store.scans(spark, sf).select("request_id").join(best, "request_id").select("request_id", "b.*")


@book.add("SELECT item_key, search_id, similarity_score FROM search_results WHERE similarity_score IS NOT NULL QUALIFY row_number() OVER (PARTITION BY item_key ORDER BY similarity_score DESC, search_id) = 1")
def dedup_keep_best(spark, sf):
    """One match per library item, the one with the highest similarity."""
    s = table(spark, sf, "search_results").where("similarity_score IS NOT NULL")
    return s.groupBy("item_key").agg(F.max_by(F.struct("search_id", "similarity_score"), F.struct("similarity_score", -F.col("search_id"))).alias("b")).select("item_key", "b.*")


@book.add("""SELECT request_id, string_agg(tag, ',' ORDER BY tag) AS tags FROM (SELECT DISTINCT request_id, unnest(list_concat(coalesce(tags, []), coalesce(subjects, []))) AS tag FROM metadata_results) WHERE tag IS NOT NULL GROUP BY 1""")
def tag_union(spark, sf):
    """All tags and subjects that any source gives a request."""
    empty = F.array().cast("array<string>")
    each = table(spark, sf, "metadata_results").select("request_id", F.explode(F.concat(F.coalesce("tags", empty), F.coalesce("subjects", empty))).alias("tag")).where("tag IS NOT NULL")
    return each.groupBy("request_id").agg(F.array_join(F.array_sort(F.collect_set("tag")), ",").alias("tags"))


@book.add("""SELECT c.collection_key, c.name, p.name AS parent_name, count(d.doc_id) AS documents FROM collection_list c LEFT JOIN collection_list p ON c.parent_key = p.collection_key LEFT JOIN documents d ON d.collection_key = c.collection_key GROUP BY 1, 2, 3""")
def collection_tree(spark, sf):
    """Documents of every collection, with its parent; counted before the join, so the hot collection moves one row per task."""
    c = table(spark, sf, "collection_list")
    counted = table(spark, sf, "documents").groupBy("collection_key").agg(F.count("*").alias("documents"))
    up = c.select(F.col("collection_key").alias("parent_key"), F.col("name").alias("parent_name"))
    return c.join(up, "parent_key", "left").join(counted, "collection_key", "left").select("collection_key", "name", "parent_name", F.coalesce("documents", F.lit(0).cast("long")).alias("documents"))


QUERIES, ORACLE = book.queries, book.oracle
