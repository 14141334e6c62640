"""Queries that parse printed records, route and merge answers, and check small grammars."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.functions.scoring import normal_title
from quire.plans.book import Book
from quire.sources.tables import table

book = Book()
c = F.col
s = lambda x: x.cast("string")


# --- printed records -------------------------------------------------------------------------------------------------

_FRONT = "title || chr(10) || 'Author(s): ' || coalesce(authors[1], '') || chr(10) || 'Source: ' || coalesce(journal, '') || ', Vol. ' || (request_id % 40) || ', No. 2 (' || coalesce(year, '') || '), pp. 1-9'"


def _front(spark, sf):
    first = F.coalesce(F.get("authors", F.lit(0)), F.lit(""))
    text = F.concat(c("title"), F.lit("\nAuthor(s): "), first, F.lit("\nSource: "), F.coalesce("journal", F.lit("")), F.lit(", Vol. "), s(c("request_id") % 40), F.lit(", No. 2 ("), F.coalesce("year", F.lit("")), F.lit("), pp. 1-9"))
    return table(spark, sf, "paper_identifiers").where("title IS NOT NULL").select("request_id", text.alias("text"))


@book.add(rf"""SELECT request_id, trim(regexp_extract(text, '([^\n]*)\nAuthor\(s\):', 1)) AS title, trim(regexp_replace(regexp_replace(regexp_extract(text, '\nSource: ([^\n]*)', 1), '(?i),\s*(vol\.|volume|no\.|number|issue|\(|pp\.|pages).*$', ''), '\s+', ' ', 'g')) AS journal, regexp_extract(text, 'Vol\. (\d+)', 1) AS volume, regexp_extract(text, 'No\. (\d+)', 1) AS issue, regexp_extract(text, 'pp\. (\d+-\d+)', 1) AS pages FROM (SELECT request_id, {_FRONT} AS text FROM paper_identifiers WHERE title IS NOT NULL)""")
def title_and_source(spark, sf):
    """Title above the author line; journal, volume, issue and pages from the source line."""
    t = c("text")
    source = F.regexp_replace(F.regexp_extract(t, r"\nSource: ([^\n]*)", 1), r"(?i),\s*(vol\.|volume|no\.|number|issue|\(|pp\.|pages).*$", "")
    get = lambda p: F.regexp_extract(t, p, 1)
    return _front(spark, sf).select("request_id", F.trim(get(r"([^\n]*)\nAuthor\(s\):")).alias("title"), F.trim(F.regexp_replace(source, r"\s+", " ")).alias("journal"), get(r"Vol\. (\d+)").alias("volume"), get(r"No\. (\d+)").alias("issue"), get(r"pp\. (\d+-\d+)").alias("pages"))


@book.add(r"""SELECT k, coalesce(nullif(regexp_extract(h, 'href="https://doi\.org/(10\.[^"]+)"', 1), ''), nullif(regexp_extract(h, 'name="citation_doi" content="(10\.[^"]+)"', 1), ''), nullif(regexp_extract(h, '"doi": ?"(10\.[^"]+)"', 1), ''), nullif(regexp_extract(h, '(10\.\d{4,}/[^\s<"]+)', 1), '')) AS doi
 FROM (SELECT p_partkey AS k, CASE p_partkey % 5 WHEN 0 THEN '<a href="https://doi.org/10.5555/a' || p_partkey || '">' WHEN 1 THEN '<meta name="citation_doi" content="10.5555/b' || p_partkey || '">' WHEN 2 THEN '{"doi": "10.5555/c' || p_partkey || '"}' WHEN 3 THEN '<p>10.5555/d' || p_partkey || '</p>' ELSE '<p>none</p>' END AS h FROM part)""")
def doi_of_page(spark, sf):
    """The DOI of a page by the first place that has one: link, meta tag, embedded data, text."""
    k = c("p_partkey")
    kind = k % 5
    h = F.when(kind == 0, F.concat(F.lit('<a href="https://doi.org/10.5555/a'), s(k), F.lit('">'))).when(kind == 1, F.concat(F.lit('<meta name="citation_doi" content="10.5555/b'), s(k), F.lit('">'))).when(kind == 2, F.concat(F.lit('{"doi": "10.5555/c'), s(k), F.lit('"}')))
    h = h.when(kind == 3, F.concat(F.lit("<p>10.5555/d"), s(k), F.lit("</p>"))).otherwise("<p>none</p>")
    forms = [r'href="https://doi\.org/(10\.[^"]+)"', r'name="citation_doi" content="(10\.[^"]+)"', r'"doi": ?"(10\.[^"]+)"', r'(10\.\d{4,}/[^\s<"]+)']
    return table(spark, sf, "part").select(k.alias("k"), h.alias("h")).select("k", F.coalesce(*(F.nullif(F.regexp_extract("h", p, 1), F.lit("")) for p in forms)).alias("doi"))


@book.add(r"""SELECT attachment, '/mnt/' || lower(substr(attachment, 1, 1)) || replace(substr(attachment, 3), '\', '/') AS unix_path, starts_with(lower(replace(attachment, '\', '/')), 'p:/papers/') AS under_base, regexp_matches(lower(attachment), '_double\.pdf$') AS two_up FROM (SELECT DISTINCT final_filename AS attachment FROM scan_log WHERE regexp_matches(final_filename, '^[A-Za-z]:'))""")
def path_conversion(spark, sf):
    """Windows paths as Unix ones, and whether they lie under a folder."""
    p = c("attachment")
    df = table(spark, sf, "scan_log").select(c("final_filename").alias("attachment")).where(p.rlike("^[A-Za-z]:")).distinct()
    unix = F.concat(F.lit("/mnt/"), F.lower(F.substring(p, 1, 1)), F.translate(F.regexp_replace(p, "^..", ""), "\\", "/"))
    return df.select("attachment", unix.alias("unix_path"), F.translate(F.lower(p), "\\", "/").startswith("p:/papers/").alias("under_base"), F.lower(p).rlike(r"_double\.pdf$").alias("two_up"))


@book.add(r"""SELECT request_id, CASE WHEN length(t) <= 40 THEN t WHEN regexp_matches(substr(t, 21, 20), '_') THEN regexp_replace(substr(t, 1, 40), '_[^_]*$', '') ELSE substr(t, 1, 40) END AS short, replace(replace(coalesce(doi, ''), '/', '_'), ':', '_') AS doi_safe FROM (SELECT request_id, doi, regexp_replace(title, '\s+', '_', 'g') AS t FROM paper_identifiers WHERE title IS NOT NULL)""")
def filename_limit(spark, sf):
    """Titles cut to a length, at the last word end if that is past the half."""
    t = F.regexp_replace("title", r"\s+", "_")
    cut = F.substring("t", 1, 40)
    short = F.when(F.char_length("t") <= 40, c("t")).when(F.contains(F.substring("t", 21, 20), F.lit("_")), F.regexp_replace(cut, "_[^_]*$", "")).otherwise(cut)
    return table(spark, sf, "paper_identifiers").where("title IS NOT NULL").select("request_id", "doi", t.alias("t")).select("request_id", short.alias("short"), F.translate(F.coalesce("doi", F.lit("")), "/:", "__").alias("doi_safe"))


@book.add("""WITH p AS (SELECT l_orderkey, max(l_linenumber) AS n, '1-' || min(l_linenumber) || ';-' || (min(l_linenumber) + 1) || CASE WHEN max(l_linenumber) > min(l_linenumber) + 1 THEN ';' || (min(l_linenumber) + 2) || '-' || max(l_linenumber) ELSE '' END AS plan, min(l_linenumber) AS a FROM lineitem GROUP BY 1)
 SELECT l_orderkey, plan, CASE WHEN n >= a + 1 THEN a || CASE WHEN n > a + 1 THEN ';' || (n - a - 1) ELSE '' END ELSE 'error' END AS sizes FROM p""")
def page_plan(spark, sf):
    """Plans such as '1-5;-6;7-10': sizes of the kept parts, or an error where parts and dropped pages do not make up all pages."""
    a, n = F.min("l_linenumber"), F.max("l_linenumber")
    g = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(a.alias("a"), n.alias("n"))
    plan = F.concat(F.lit("1-"), s(c("a")), F.lit(";-"), s(c("a") + 1), F.when(c("n") > c("a") + 1, F.concat(F.lit(";"), s(c("a") + 2), F.lit("-"), s(c("n")))).otherwise(""))
    end = lambda x, i: F.element_at(F.split(F.regexp_replace(x, "^-", ""), "-"), i).try_cast("int")
    pages = lambda x: F.sequence(end(x, 1), F.greatest(end(x, -1), end(x, 1)))
    parts = F.split("plan", ";")
    kept, dropped = F.filter(parts, lambda x: ~x.startswith("-")), F.filter(parts, lambda x: x.startswith("-"))
    df = g.withColumn("plan", plan).withColumn("kept", F.transform(kept, pages)).withColumn("dropped", F.flatten(F.transform(dropped, pages)))
    whole = (F.array_sort(F.concat(F.flatten("kept"), "dropped")) == F.sequence(F.lit(1), c("n")))
    return df.select("l_orderkey", "plan", F.when(whole, F.array_join(F.transform("kept", lambda x: s(F.size(x))), ";")).otherwise("error").alias("sizes"))


@book.add("SELECT result_id, strftime(coalesce(try_strptime(d, '%Y-%m-%d'), try_strptime(d, '%d.%m.%Y'), try_strptime(d, '%Y/%m/%d')), '%Y-%m-%d') AS day FROM (SELECT result_id, substr(publication_date, 1, 10) AS d FROM metadata_results WHERE regexp_matches(publication_date, '^\\d{4}-\\d{2}-\\d{2}|^\\d{2}\\.\\d{2}\\.\\d{4}$|^\\d{4}/\\d{1,2}/\\d{1,2}$'))")
def parse_dates(spark, sf):
    """Days in several formats; what can't be read is null."""
    d = F.substring("publication_date", 1, 10)
    m = table(spark, sf, "metadata_results").where(c("publication_date").rlike(r"^\d{4}-\d{2}-\d{2}|^\d{2}\.\d{2}\.\d{4}$|^\d{4}/\d{1,2}/\d{1,2}$"))
    day = F.coalesce(*(F.try_to_timestamp(d, F.lit(f)) for f in ("yyyy-MM-dd", "dd.MM.yyyy", "yyyy/M/d")))
    return m.select("result_id", F.date_format(day, "yyyy-MM-dd").alias("day"))


# --- routing, union and merging of answers ---------------------------------------------------------------------------

_SRC = "regexp_replace(lower(trim(source)), '[\\s_-]*api$', '')"


@book.add(f"SELECT kind, source, rank FROM (SELECT kind, source, row_number() OVER (PARTITION BY kind ORDER BY trust_rank, source) AS rank FROM source_trust)")
def priority_order(spark, sf):
    """Sources of each kind in the order of their trust."""
    rank = F.row_number().over(W.partitionBy("kind").orderBy("trust_rank", "source"))
    return table(spark, sf, "source_trust").select("kind", "source", rank.cast("long").alias("rank"))


@book.add(f"SELECT coalesce(kind, 'unknown') AS kind, count(*) AS answers, round(avg(CASE WHEN confidence > 1 THEN confidence WHEN confidence >= 0 THEN confidence * 100 END), 6) AS mean_confidence FROM metadata_results m LEFT JOIN source_trust t ON {_SRC.replace('source', 'm.source')} = t.source GROUP BY 1")
def answers_per_kind(spark, sf):
    """Answers and their mean confidence by the kind of their source, whatever the spelling of its name."""
    m = table(spark, sf, "metadata_results").select(F.regexp_replace(F.lower(F.trim("source")), r"[\s_-]*api$", "").alias("source"), "confidence")
    scale = F.when(c("confidence") > 1, c("confidence")).when(c("confidence") >= 0, c("confidence") * 100)
    return m.join(table(spark, sf, "source_trust"), "source", "left").groupBy(F.coalesce("kind", F.lit("unknown")).alias("kind")).agg(F.count("*").alias("answers"), F.round(F.avg(scale), 6).alias("mean_confidence"))


@book.add(f"SELECT request_id, result_id, k FROM (SELECT request_id, result_id, row_number() OVER (PARTITION BY request_id ORDER BY trust_rank NULLS LAST, result_id) AS k FROM metadata_results m LEFT JOIN source_trust t ON {_SRC.replace('source', 'm.source')} = t.source) WHERE k <= 5")
def union_candidates(spark, sf):
    """The first five candidates of each request over all sources, in the order of the sources; the sort stops at five per task."""
    m = table(spark, sf, "metadata_results").select("request_id", "result_id", F.regexp_replace(F.lower(F.trim("source")), r"[\s_-]*api$", "").alias("source"))
    k = F.row_number().over(W.partitionBy("request_id").orderBy(F.asc_nulls_last("trust_rank"), "result_id"))
    return m.join(table(spark, sf, "source_trust"), "source", "left").withColumn("k", k.cast("long")).where("k <= 5").select("request_id", "result_id", "k")


@book.add("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY confidence DESC NULLS LAST, result_id) AS k FROM metadata_results) SELECT a.request_id, a.result_id, coalesce(nullif(a.title, ''), b.title) AS title, coalesce(nullif(a.abstract, ''), b.abstract) AS abstract, coalesce(nullif(a.publication_date, ''), b.publication_date) AS published FROM (SELECT * FROM r WHERE k = 1) a LEFT JOIN (SELECT * FROM r WHERE k = 2) b ON a.request_id = b.request_id""")
def merge_two_best(spark, sf):
    """The best answer with its gaps filled from the second."""
    m = table(spark, sf, "metadata_results").where("request_id IS NOT NULL")
    key = F.struct(F.coalesce(-c("confidence"), F.lit(1e300)).alias("conf"), c("result_id").alias("id"))
    # only keys are sorted, the texts come to the two that are taken
    k = F.row_number().over(W.partitionBy("request_id").orderBy("key"))
    two = m.select("request_id", key.alias("key")).withColumn("k", k).where("k <= 2").select(c("key.id").alias("result_id"), "k")
    rows = m.select("request_id", "result_id", "title", "abstract", "publication_date").join(two, "result_id")
    two = rows.groupBy("request_id").agg(*(F.max(F.when(c("k") == i, F.struct("result_id", "title", "abstract", "publication_date"))).alias(f"r{i}") for i in (1, 2)))
    fill = lambda n: F.coalesce(F.nullif(c(f"r1.{n}"), F.lit("")), c(f"r2.{n}"))
    return two.select("request_id", c("r1.result_id").alias("result_id"), fill("title").alias("title"), fill("abstract").alias("abstract"), fill("publication_date").alias("published"))


@book.add("SELECT item_key, search_id FROM search_results QUALIFY row_number() OVER (PARTITION BY item_key ORDER BY CASE WHEN isbn IS NULL THEN 1 ELSE 0 END, search_id) = 1")
def prefer_isbn(spark, sf):
    """One hit per library item: one with an ISBN if there is any, else the first."""
    return table(spark, sf, "search_results").groupBy("item_key").agg(F.min(F.struct(c("isbn").isNull().alias("bare"), c("search_id"))).alias("m")).select("item_key", "m.search_id")


@book.add("SELECT request_id, CASE WHEN coalesce(doi, '') <> '' THEN 'doi' WHEN regexp_matches(coalesce(title, ''), '\\d{4}\\.\\d{4,5}') THEN 'arxiv' WHEN len(authors) > 0 AND coalesce(title, '') <> '' THEN 'search' WHEN coalesce(title, '') <> '' THEN 'title' ELSE 'manual' END AS method FROM paper_identifiers")
def method_cascade(spark, sf):
    """The first way of looking a record up that its fields allow."""
    has = lambda x: F.coalesce(c(x), F.lit("")) != ""
    method = F.when(has("doi"), "doi").when(F.coalesce("title", F.lit("")).rlike(r"\d{4}\.\d{4,5}"), "arxiv").when((F.size("authors") > 0) & has("title"), "search").when(has("title"), "title").otherwise("manual")
    return table(spark, sf, "paper_identifiers").select("request_id", method.alias("method"))


@book.add(r"""SELECT request_id, concat_ws(' AND ', CASE WHEN title IS NOT NULL THEN 'title:"' || title || '"' END, CASE WHEN authors[1] IS NOT NULL THEN 'author:' || regexp_extract(trim(authors[1]), '(\S+)$', 1) END, CASE WHEN coalesce(year, '') <> '' THEN 'year:' || year END) AS query FROM paper_identifiers""")
def query_strings(spark, sf):
    """Search terms of each record, of the fields that it has."""
    a = F.get("authors", F.lit(0))
    q = F.concat_ws(" AND ", F.when(c("title").isNotNull(), F.concat(F.lit('title:"'), c("title"), F.lit('"'))), F.when(a.isNotNull(), F.concat(F.lit("author:"), F.regexp_extract(F.trim(a), r"(\S+)$", 1))), F.when(F.coalesce("year", F.lit("")) != "", F.concat(F.lit("year:"), c("year"))))
    return table(spark, sf, "paper_identifiers").select("request_id", q.alias("query"))


@book.add("SELECT result_id, array_to_string(subjects[1:10], ',') AS top_subjects, len(subjects) AS n FROM metadata_results WHERE subjects IS NOT NULL")
def top_slices(spark, sf):
    """The first ten subjects of each answer."""
    return table(spark, sf, "metadata_results").where("subjects IS NOT NULL").select("result_id", F.array_join(F.slice("subjects", 1, 10), ",").alias("top_subjects"), F.size("subjects").cast("long").alias("n"))


@book.add("SELECT a.doc_id AS doc_id, b.first_id AS first_id FROM documents a JOIN (SELECT md5(text) AS h, n_chars, min(doc_id) AS first_id, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY 1, 2) b ON md5(a.text) = b.h AND a.n_chars = b.n_chars WHERE b.n > 1 AND a.doc_id <> b.first_id")
def identical_files(spark, sf):
    """Documents whose whole text another one has, with the first of them; texts are reduced to their hash before the shuffle."""
    d = table(spark, sf, "documents").where("text IS NOT NULL").select("doc_id", F.md5("text").alias("h"), "n_chars")
    first = d.groupBy("h", "n_chars").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")).where("n > 1")
    return d.join(first, ["h", "n_chars"]).where("doc_id <> first_id").select("doc_id", "first_id")


_N = "trim(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g'))"


@book.add("SELECT DISTINCT n.name, a.author_id, a.paper_count FROM (SELECT unnest(authors) AS name FROM paper_identifiers) n JOIN author_catalogue a ON lower(trim(n.name)) = lower(a.name)")
def catalogue_lookup(spark, sf):
    """Catalogue entries of names by their lower case."""
    n = table(spark, sf, "paper_identifiers").select(F.explode("authors").alias("name")).distinct().withColumn("k", F.lower(F.trim("name")))
    return n.join(table(spark, sf, "author_catalogue").select("author_id", "paper_count", F.lower(c("name")).alias("k")), "k").select("name", "author_id", "paper_count").distinct()


@book.add("""WITH k AS (SELECT DISTINCT lower(name) AS n FROM author_catalogue) SELECT request_id, array_to_string(list_filter(authors, lambda x: list_contains(known, lower(x))), '; ') AS strict, array_to_string(list_concat(list_filter(authors, lambda x: list_contains(known, lower(x))), list_filter(authors, lambda x: NOT list_contains(known, lower(x)))[1:2]), '; ') AS balanced FROM paper_identifiers, (SELECT list(n) AS known FROM k) WHERE authors IS NOT NULL""")
def author_filter(spark, sf):
    """Authors that the catalogue knows, alone or with two unknown ones; the catalogue meets exploded names, not every list."""
    k = table(spark, sf, "author_catalogue").select(F.lower("name").alias("low")).distinct().withColumn("known", F.lit(True))
    p = table(spark, sf, "paper_identifiers").where("authors IS NOT NULL").select("request_id", F.posexplode_outer("authors").alias("pos", "name")).withColumn("low", F.lower("name"))
    g = p.join(k, "low", "left").groupBy("request_id").agg(F.array_sort(F.collect_list(F.when(c("name").isNotNull(), F.struct("pos", "name", F.coalesce("known", F.lit(False)).alias("known"))))).alias("x"))
    names = lambda ok: F.transform(F.filter("x", lambda e: e.known if ok else ~e.known), lambda e: e["name"])
    return g.select("request_id", F.array_join(names(True), "; ").alias("strict"), F.array_join(F.concat(names(True), F.slice(names(False), 1, 2)), "; ").alias("balanced"))


_J = "SELECT lower(trim(journal)) AS j, count(*) AS n FROM paper_identifiers WHERE journal IS NOT NULL GROUP BY 1"


# --- pages and lines -------------------------------------------------------------------------------------------------


@book.add("SELECT doc_id, length(p[1]) + CASE WHEN length(p[1]) < 400 AND len(p) > 1 THEN length(p[2]) ELSE 0 END + CASE WHEN length(p[1]) < 400 AND len(p) > 2 AND length(p[2]) < 400 THEN length(p[3]) ELSE 0 END AS chars FROM (SELECT doc_id, string_split(text, chr(10) || chr(10)) AS p FROM documents WHERE text IS NOT NULL)")
def front_matter(spark, sf):
    """Letters of the first block, and of the second and third while those before are short."""
    n = lambda i: F.coalesce(F.char_length(F.get("p", F.lit(i))), F.lit(0))
    total = n(0) + F.when(n(0) < 400, n(1)).otherwise(0) + F.when((n(0) < 400) & (n(1) < 400), n(2)).otherwise(0)
    return table(spark, sf, "documents").where("text IS NOT NULL").select("doc_id", F.split("text", "\n\n").alias("p")).select("doc_id", total.cast("long").alias("chars"))


@book.add("""WITH l AS (SELECT doc_id, no, length(trim(line)) AS n FROM (SELECT doc_id, unnest(range(1, len(a) + 1)) AS no, unnest(a) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents WHERE text IS NOT NULL))), w AS (SELECT *, avg(n) OVER f AS mean, min(n) OVER f AS low, max(n) OVER f AS high, count(*) OVER f AS k FROM l WINDOW f AS (PARTITION BY doc_id ORDER BY no ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING))
 SELECT doc_id, count(*) AS runs, min(no) AS first_line FROM w WHERE k = 3 AND mean >= 20 AND high <= 1.15 * mean AND low >= 0.85 * mean GROUP BY 1""")
def body_text_runs(spark, sf):
    """Places where three lines in a row are of about one length: body text."""
    d = table(spark, sf, "documents").where("text IS NOT NULL").select("doc_id", F.transform(F.split("text", "\n"), lambda x: F.char_length(F.trim(x))).alias("n"))
    d = d.where(F.size("n") > 2)
    three = F.transform(F.slice("n", F.lit(1), F.size("n") - 2), lambda x, i: F.array(x, F.get("n", i + 1), F.get("n", i + 2)))
    mean = lambda t: (t[0] + t[1] + t[2]) / 3
    body = lambda t: (mean(t) >= 20) & (F.array_max(t) <= 1.15 * mean(t)) & (F.array_min(t) >= 0.85 * mean(t))
    at = F.array_compact(F.transform(three, lambda t, i: F.when(body(t), i + 1)))
    return d.select("doc_id", at.alias("at")).where(F.size("at") > 0).select("doc_id", F.size("at").cast("long").alias("runs"), F.get("at", F.lit(0)).cast("long").alias("first_line"))


@book.add("SELECT l_orderkey, l_linenumber AS page FROM (SELECT l_orderkey, l_linenumber, max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS near FROM (SELECT l_orderkey, l_linenumber, max(l_returnflag) AS l_returnflag FROM lineitem GROUP BY 1, 2)) WHERE near = 1")
def separator_neighbours(spark, sf):
    """Separator pages and the pages beside them."""
    w = W.partitionBy("l_orderkey").orderBy("l_linenumber").rowsBetween(-1, 1)
    near = F.max(F.when(c("l_returnflag") == "R", 1).otherwise(0)).over(w)
    pages = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_returnflag").alias("l_returnflag"))
    return pages.withColumn("near", near).where("near = 1").select("l_orderkey", c("l_linenumber").alias("page"))


@book.add("SELECT k, CASE WHEN k % 3 = 0 THEN 2 WHEN k % 3 = 1 THEN 1 ELSE 0 END AS created, CASE WHEN k % 3 < 2 THEN 'K' || k END AS first_key FROM (SELECT p_partkey AS k FROM part)")
def create_responses(spark, sf):
    """Keys created, from answers that hold them as a map or as a list."""
    k = c("p_partkey")
    text = F.when(k % 3 == 0, F.format_string('{"successful": {"0": {"key": "K%d"}, "1": {"key": "L"}}}', k)).when(k % 3 == 1, F.format_string('{"successful": [{"key": "K%d"}]}', k)).otherwise('"no object"')
    v = F.try_parse_json("t")
    as_map, as_list = F.try_variant_get(v, "$.successful", "map<string,struct<key:string>>"), F.try_variant_get(v, "$.successful", "array<struct<key:string>>")
    keys = F.coalesce(F.transform(F.array_sort(F.map_entries(as_map)), lambda e: e.value.key), F.transform(as_list, lambda e: e.key))
    return table(spark, sf, "part").select(k.alias("k"), text.alias("t")).select("k", keys.alias("keys")).select("k", F.coalesce(F.size("keys"), F.lit(0)).alias("created"), F.get("keys", F.lit(0)).alias("first_key"))


# --- markup ----------------------------------------------------------------------------------------------------------


def _texts(path: str, sep: str = "; "):
    """The texts at a path of the XML column x."""
    return F.array_join(F.xpath("x", F.lit(f"{path}/text()")), sep)


@book.add("SELECT c_custkey, c_name AS title, 'Doe ' || c_custkey || '; Roe ' || c_nationkey AS authors, CASE c_nationkey % 3 WHEN 0 THEN 'journal_article' WHEN 1 THEN 'book_chapter' ELSE 'unknown' END AS kind FROM customer")
def tei_records(spark, sf):
    """Header fields of TEI documents: authors of the header alone, not those of its bibliography; kind by the first sign of one."""
    x = F.format_string(
        "<TEI><teiHeader><title>%s</title><sourceDesc><author>Doe %d</author><author>Roe %d</author><monogr level='%s'/></sourceDesc></teiHeader><text><listBibl><author>Ghost</author></listBibl></text></TEI>",
        "c_name", "c_custkey", "c_nationkey", F.when(c("c_nationkey") % 3 == 0, "j").when(c("c_nationkey") % 3 == 1, "m").otherwise("x"),
    )
    level = F.xpath_string("x", F.lit("TEI/teiHeader/sourceDesc/monogr/@level"))
    kind = F.when(level == "j", "journal_article").when(level == "m", "book_chapter").otherwise("unknown")
    return table(spark, sf, "customer").select("c_custkey", x.alias("x")).select("c_custkey", F.xpath_string("x", F.lit("TEI/teiHeader/title")).alias("title"), _texts("TEI/teiHeader/sourceDesc/author").alias("authors"), kind.alias("kind"))


@book.add("SELECT c_custkey, printf('2301.%05d', c_custkey) AS arxiv_id, c_name AS title, 'A ' || c_custkey || '; B' AS authors, '2023' AS year FROM customer")
def atom_records(spark, sf):
    """Entries of an Atom feed: number, title, authors, year."""
    x = F.format_string("<feed><entry><id>http://arxiv.org/abs/2301.%05dv2</id><title>%s</title><published>2023-01-05T00:00:00Z</published><author><name>A %d</name></author><author><name>B</name></author></entry></feed>", "c_custkey", "c_name", "c_custkey")
    at = lambda p: F.xpath_string("x", F.lit(f"feed/entry/{p}"))
    df = table(spark, sf, "customer").select("c_custkey", x.alias("x"))
    return df.select("c_custkey", F.regexp_extract(at("id"), r"abs/([^v]+)", 1).alias("arxiv_id"), at("title").alias("title"), _texts("feed/entry/author/name").alias("authors"), F.substring(at("published"), 1, 4).alias("year"))


@book.add("SELECT s_suppkey, 'Aim ' || s_suppkey || ' Result ' || s_nationkey AS abstract, 'M1; M2' AS mesh, 'journal_article' AS kind FROM supplier")
def citation_records(spark, sf):
    """Records with an abstract in parts, headings and publication types."""
    x = F.format_string("<r><Abstract><t>Aim %d</t><t>Result %d</t></Abstract><Mesh><d>M1</d><d>M2</d></Mesh><Type>Journal Article</Type></r>", "s_suppkey", "s_nationkey")
    kind = F.replace(F.lower(F.xpath_string("x", F.lit("r/Type"))), F.lit(" "), F.lit("_"))
    return table(spark, sf, "supplier").select("s_suppkey", x.alias("x")).select("s_suppkey", _texts("r/Abstract/t", " ").alias("abstract"), _texts("r/Mesh/d").alias("mesh"), kind.alias("kind"))


QUERIES, ORACLE = book.queries, book.oracle
