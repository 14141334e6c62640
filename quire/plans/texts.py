"""Queries that clean, cut and build text: lines, pages, names of files, small grammars, nested fields."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.plans.book import Book
from quire.plans.enrich import opened
from quire.sources.tables import table

book = Book()
c = F.col


def _documents(spark, sf):
    return table(spark, sf, "documents").where("text IS NOT NULL")


@book.add(r"SELECT doc_id, md5(trim(regexp_replace(array_to_string(list_filter(string_split(text, chr(10)), lambda l: NOT regexp_matches(l, '^– \d+ –$|^Keywords:|^Received ')), chr(10)), '\n{3,}', chr(10) || chr(10), 'g'), chr(10))) AS text_md5 FROM documents WHERE text IS NOT NULL")
def ignore_lines(spark, sf):
    """Texts without the lines that match ignore patterns, runs of blank lines collapsed."""
    kept = F.filter(F.split("text", "\n"), lambda x: ~x.rlike(r"^– \d+ –$|^Keywords:|^Received "))
    return _documents(spark, sf).select("doc_id", F.md5(F.trim(F.regexp_replace(F.array_join(kept, "\n"), r"\n{3,}", "\n\n"), F.lit("\n"))).alias("text_md5"))


@book.add("SELECT doc_id, round(list_avg(list_transform(p[1:2], lambda x: length(trim(x)))), 6) AS mean_chars, list_avg(list_transform(p[1:2], lambda x: length(trim(x)))) < 200 AS sparse FROM (SELECT doc_id, string_split(text, chr(10) || chr(10)) AS p FROM documents WHERE text IS NOT NULL)")
def sparse_pages(spark, sf):
    """Documents whose first two blocks hold little text."""
    sizes = F.transform(F.slice(F.split("text", "\n\n"), 1, 2), lambda x: F.char_length(F.trim(x)))
    mean = F.aggregate(sizes, F.lit(0), lambda a, x: a + x) / F.size(sizes)
    return _documents(spark, sf).select("doc_id", F.round(mean, 6).alias("mean_chars"), (mean < 200).alias("sparse"))


@book.add(r"""WITH l AS (SELECT doc_id, unnest(range(1, len(a) + 1)) AS no, unnest(a) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents WHERE text IS NOT NULL)), g AS (SELECT *, sum(CASE WHEN trim(line) = '' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY no ROWS UNBOUNDED PRECEDING) AS island FROM l)
 SELECT doc_id, min(no) AS first_line, count(*) AS lines FROM g WHERE trim(line) <> '' GROUP BY doc_id, island HAVING count(*) > 5""")
def body_islands(spark, sf):
    """Runs of more than five lines with text, between the blank lines of each text; nothing is shuffled."""
    gap = F.array_compact(F.transform("l", lambda x, i: F.when(F.trim(x) == "", i)))
    d = _documents(spark, sf).select("doc_id", F.split("text", "\n").alias("l")).select("doc_id", F.concat(F.array(F.lit(-1)), gap, F.array(F.size("l"))).alias("g"))
    runs = F.transform(F.slice("g", F.lit(2), F.size("g") - 1), lambda x, i: F.struct((F.get("g", i) + 2).cast("long").alias("first_line"), (x - F.get("g", i) - 1).cast("long").alias("lines")))
    return d.select("doc_id", F.inline(F.filter(runs, lambda r: r.lines > 5)))


@book.add("SELECT l_orderkey, min(l_linenumber) AS first_page, max(l_linenumber) AS last_page, count(*) AS pages FROM (SELECT *, l_linenumber - row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS seg FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag <> 'R')) GROUP BY l_orderkey, seg")
def page_segments(spark, sf):
    """Runs of successive pages that are kept."""
    pages = table(spark, sf, "lineitem").where("l_returnflag <> 'R'").select("l_orderkey", "l_linenumber").distinct()
    seg = c("l_linenumber") - F.row_number().over(W.partitionBy("l_orderkey").orderBy("l_linenumber"))
    return pages.withColumn("seg", seg).groupBy("l_orderkey", "seg").agg(F.min("l_linenumber").alias("first_page"), F.max("l_linenumber").alias("last_page"), F.count("*").alias("pages")).drop("seg")


@book.add(r"""WITH s AS (SELECT request_id, title, year, CASE WHEN authors IS NULL OR len(authors) = 0 THEN 'Unknown' WHEN len(authors) = 1 THEN l1 WHEN len(authors) = 2 THEN l1 || '_' || l2 ELSE l1 || '_et_al' END AS who FROM (SELECT *, regexp_extract(trim(regexp_replace(authors[1], ',.*$', '')), '(\S+)$', 1) AS l1, regexp_extract(trim(regexp_replace(authors[2], ',.*$', '')), '(\S+)$', 1) AS l2 FROM paper_identifiers WHERE title IS NOT NULL))
 SELECT request_id, who || '_' || coalesce(nullif(year, ''), 'nd') || '_' || substr(regexp_replace(regexp_replace(replace(title, '&', 'and'), '[<>:"/\\|?*,\s]+', '_', 'g'), '_+', '_', 'g'), 1, 100) || '_scan.pdf' AS filename FROM s""")
def filename_build(spark, sf):
    """File names from authors (one, two, or et al.), year and title."""
    last = lambda i: F.regexp_extract(F.trim(F.regexp_replace(F.get("authors", F.lit(i)), ",.*$", "")), r"(\S+)$", 1)
    n = F.size("authors")
    who = F.when(c("authors").isNull() | (n == 0), "Unknown").when(n == 1, last(0)).when(n == 2, F.concat(last(0), F.lit("_"), last(1))).otherwise(F.concat(last(0), F.lit("_et_al")))
    title = F.substring(F.regexp_replace(F.regexp_replace(F.replace(c("title"), F.lit("&"), F.lit("and")), r'[<>:"/\\|?*,\s]+', "_"), "_+", "_"), 1, 100)
    year = F.when(F.coalesce("year", F.lit("")) != "", c("year")).otherwise("nd")
    return table(spark, sf, "paper_identifiers").where("title IS NOT NULL").select("request_id", F.concat(who, F.lit("_"), year, F.lit("_"), title, F.lit("_scan.pdf")).alias("filename"))


@book.add("SELECT result_id, nullif(regexp_extract(publication_date, '(1[5-9]\\d\\d|20\\d\\d)', 1), '') AS year, CASE WHEN regexp_matches(publication_date, '^\\d{4}-\\d{2}-\\d{2}') THEN 'day' WHEN regexp_matches(publication_date, '^\\d{4}-\\d{2}$') THEN 'month' WHEN regexp_matches(publication_date, '^\\d{4}$') THEN 'year' WHEN publication_date IS NULL OR publication_date = '' THEN 'missing' ELSE 'other' END AS precision FROM metadata_results")
def date_parts(spark, sf):
    """Year and precision of dates of any format."""
    d = c("publication_date")
    year = F.regexp_extract(d, r"(1[5-9]\d\d|20\d\d)", 1)
    p = F.when(d.rlike(r"^\d{4}-\d{2}-\d{2}"), "day").when(d.rlike(r"^\d{4}-\d{2}$"), "month").when(d.rlike(r"^\d{4}$"), "year").when(d.isNull() | (d == ""), "missing").otherwise("other")
    return table(spark, sf, "metadata_results").select("result_id", F.when(year != "", year).alias("year"), p.alias("precision"))


@book.add("SELECT result_id, trim(regexp_replace(abstract, '<[^>]+>', '', 'g')) AS plain FROM metadata_results WHERE abstract LIKE '%<%'")
def strip_tags(spark, sf):
    return table(spark, sf, "metadata_results").where("abstract LIKE '%<%'").select("result_id", F.trim(F.regexp_replace("abstract", "<[^>]+>", "")).alias("plain"))


@book.add("""SELECT k, array_to_string(list_sort(list_distinct(list_filter(flatten(list_transform(string_split(spec, ','), lambda p: CASE WHEN regexp_matches(trim(p), '^\\d+$') THEN [CAST(trim(p) AS BIGINT)] WHEN regexp_matches(trim(p), '^\\d+-\\d+$') THEN range(least(CAST(string_split(trim(p), '-')[1] AS BIGINT), CAST(string_split(trim(p), '-')[2] AS BIGINT)), greatest(CAST(string_split(trim(p), '-')[1] AS BIGINT), CAST(string_split(trim(p), '-')[2] AS BIGINT)) + 1) ELSE CAST([] AS BIGINT[]) END)), lambda i: i BETWEEN 1 AND 50))), ',') AS chosen
 FROM (SELECT p_partkey AS k, (p_partkey % 9) || ',' || (p_partkey % 13) || '-' || (p_partkey % 7) || ', x, ' || (p_partkey % 60) AS spec FROM part)""")
def index_selection(spark, sf):
    """Choices such as '1,3-5' as a sorted set: reversed ranges hold, other text and numbers out of range do not."""
    k = c("p_partkey")
    s = lambda n: (k % n).cast("string")
    spec = F.concat(s(9), F.lit(","), s(13), F.lit("-"), s(7), F.lit(", x, "), s(60))
    number = lambda p, i: F.element_at(F.split(F.trim(p), "-"), i).try_cast("bigint")
    one = lambda p: F.when(F.trim(p).rlike(r"^\d+$"), F.array(F.trim(p).try_cast("bigint"))).when(F.trim(p).rlike(r"^\d+-\d+$"), F.sequence(F.least(number(p, 1), number(p, -1)), F.greatest(number(p, 1), number(p, -1)))).otherwise(F.array().cast("array<bigint>"))
    chosen = F.array_sort(F.array_distinct(F.filter(F.flatten(F.transform(F.split("spec", ","), one)), lambda i: i.between(1, 50))))
    return table(spark, sf, "part").select(k.alias("k"), spec.alias("spec")).select("k", F.array_join(chosen, ",").alias("chosen"))


@book.add("""SELECT k, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(spec, '(?:^|\\s)add:(\\S+)', 1), lambda x: x))), ' ') AS added, array_to_string(list_sort(list_distinct(regexp_extract_all(spec, '(?:^|\\s)remove:(\\S+)', 1))), ' ') AS removed
 FROM (SELECT p_partkey AS k, 'add:' || p_brand || ' remove:' || replace(p_type, ' ', '_') || ' add:size' || p_size AS spec FROM part)""")
def tag_groups(spark, sf):
    """Edits such as 'add:a remove:b' as what is added and what is removed."""
    spec = F.concat(F.lit("add:"), c("p_brand"), F.lit(" remove:"), F.replace(c("p_type"), F.lit(" "), F.lit("_")), F.lit(" add:size"), c("p_size").cast("string"))
    group = lambda word: F.array_join(F.array_sort(F.array_distinct(F.regexp_extract_all(spec, F.lit(rf"(?:^|\s){word}:(\S+)"), 1))), " ")
    return table(spark, sf, "part").select(c("p_partkey").alias("k"), group("add").alias("added"), group("remove").alias("removed"))


@book.add("""SELECT result_id, array_to_string(list_sort(list_distinct(list_filter(coalesce(tags, []), lambda t: NOT list_contains(coalesce(subjects, []), t)))), ',') AS only_tags, array_to_string(list_sort(list_distinct(list_filter(coalesce(subjects, []), lambda t: NOT list_contains(coalesce(tags, []), t)))), ',') AS only_subjects,
 array_to_string(list_sort(list_distinct(list_concat(coalesce(tags, []), coalesce(subjects, [])))), ',') AS either, len(list_distinct(list_intersect(coalesce(tags, []), coalesce(subjects, [])))) AS shared FROM metadata_results""")
def tag_differences(spark, sf):
    """Differences both ways, union and intersection of two tag sets."""
    empty = F.array().cast("array<string>")
    t, s = F.coalesce("tags", empty), F.coalesce("subjects", empty)
    join = lambda x: F.array_join(F.array_sort(x), ",")
    return table(spark, sf, "metadata_results").select("result_id", join(F.array_except(t, s)).alias("only_tags"), join(F.array_except(s, t)).alias("only_subjects"), join(F.array_union(t, s)).alias("either"), F.size(F.array_intersect(t, s)).cast("long").alias("shared"))


@book.add("""WITH u AS (SELECT r.request_id, 0 AS origin, o AS pos, name FROM (SELECT request_id, unnest(range(len(authors))) AS o, unnest(authors) AS name FROM paper_identifiers) r UNION ALL SELECT request_id, 1, o, name FROM (SELECT request_id, result_id, unnest(range(len(authors))) AS o, unnest(authors) AS name FROM metadata_results) WHERE name IS NOT NULL),
 d AS (SELECT request_id, lower(name) AS low, min((origin, pos)) AS place FROM u WHERE name IS NOT NULL GROUP BY 1, 2) SELECT request_id, string_agg(low, '; ' ORDER BY place, low) AS authors FROM d GROUP BY 1""")
def author_merge(spark, sf):
    """Own authors first, then those of all answers, distinct without regard to case; the order is by the first place."""
    p = table(spark, sf, "paper_identifiers").select("request_id", F.lit(0).alias("origin"), F.posexplode("authors").alias("pos", "name"))
    m = table(spark, sf, "metadata_results").select("request_id", F.lit(1), F.posexplode("authors").alias("pos", "name"))
    d = p.unionAll(m).where("name IS NOT NULL").groupBy("request_id", F.lower("name").alias("low")).agg(F.min(F.struct("origin", "pos")).alias("at"))
    return d.groupBy("request_id").agg(F.array_sort(F.collect_list(F.struct("at", "low"))).alias("x")).select("request_id", F.array_join("x.low", "; ").alias("authors"))


@book.add("SELECT event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events GROUP BY 1, 2")
def json_path(spark, sf):
    """A value inside of a JSON column, by its path."""
    return table(spark, sf, "events").groupBy("event_type", F.get_json_object("props", "$.k").try_cast("bigint").alias("k")).agg(F.count("*").alias("n"))


_OPENED = "SELECT result_id, CASE WHEN json_type(j) = 'VARCHAR' THEN CASE WHEN json_valid(j ->> '$') THEN CAST(j ->> '$' AS JSON) END ELSE j END AS j FROM (SELECT result_id, CASE WHEN json_valid(raw_data) THEN CAST(raw_data AS JSON) END AS j FROM metadata_results)"
_VALID = f"SELECT result_id, j FROM ({_OPENED}) WHERE json_type(j) = 'OBJECT'"


@book.add(f"""SELECT result_id, json_extract_string(j, '$.message.title[0]') AS title, CAST(json_extract_string(j, '$.message.published.date-parts[0][0]') AS BIGINT) AS year, json_extract_string(j, '$.message.language') AS language, CAST(json_array_length(j, '$.message.author') AS BIGINT) AS authors FROM ({_VALID}) WHERE json_extract(j, '$.message') IS NOT NULL AND json_type(j, '$.message') = 'OBJECT'""")
def parse_message_records(spark, sf):
    """Answers in the shape of a message: title, first date part, language, number of authors; unreadable ones have no row."""
    v = opened(c("raw_data"))
    df = table(spark, sf, "metadata_results").select("result_id", v.alias("v")).where("v IS NOT NULL AND schema_of_variant(v) LIKE 'OBJECT%' AND schema_of_variant(variant_get(v, '$.message')) LIKE 'OBJECT%'")
    get = lambda p, t="string": F.try_variant_get("v", p, t)
    authors = F.try_variant_get("v", "$.message.author", "array<variant>")
    return df.select("result_id", get("$.message.title[0]").alias("title"), get("$.message.published['date-parts'][0][0]", "bigint").alias("year"), get("$.message.language").alias("language"), F.when(authors.isNotNull(), F.size(authors).cast("bigint")).alias("authors"))


@book.add(f"""SELECT result_id, json_extract_string(j, '$.display_name') AS title, CAST(json_extract_string(j, '$.publication_year') AS BIGINT) AS year, json_extract_string(j, '$.authorships[0].author.display_name') AS first_author FROM ({_VALID}) WHERE json_extract_string(j, '$.display_name') IS NOT NULL""")
def parse_work_records(spark, sf):
    """Answers in the shape of a work: title, year, first author."""
    v = opened(c("raw_data"))
    df = table(spark, sf, "metadata_results").select("result_id", v.alias("v")).where("v IS NOT NULL AND schema_of_variant(v) LIKE 'OBJECT%'")
    get = lambda p, t="string": F.try_variant_get("v", p, t)
    return df.select("result_id", get("$.display_name").alias("title"), get("$.publication_year", "bigint").alias("year"), get("$.authorships[0].author.display_name").alias("first_author")).where("title IS NOT NULL")


@book.add("SELECT s_suppkey, s_name AS title, CAST(s_nationkey AS VARCHAR) AS nation, CASE WHEN s_acctbal < 0 THEN 'owing' ELSE 'owed' END AS state FROM supplier")
def xml_fields(spark, sf):
    """Fields of XML records, by their paths."""
    xml = F.format_string('<r><t n="%s">%s</t><s>%s</s></r>', c("s_nationkey").cast("string"), c("s_name"), F.when(c("s_acctbal") < 0, "owing").otherwise("owed"))
    path = lambda p: F.xpath_string("x", F.lit(p))
    return table(spark, sf, "supplier").select("s_suppkey", xml.alias("x")).select("s_suppkey", path("r/t").alias("title"), path("r/t/@n").alias("nation"), path("r/s").alias("state"))


@book.add("SELECT c_custkey, c_name AS author, 'x' || c_custkey AS token, CAST(c_nationkey AS VARCHAR) AS place FROM customer")
def html_and_cookies(spark, sf):
    """A meta tag of a page and the values of a cookie header."""
    html = F.format_string('<html><meta name="author" content="%s"></html>', "c_name")
    cookie = F.format_string("token=x%s; place=%s", c("c_custkey").cast("string"), c("c_nationkey").cast("string"))
    jar = F.str_to_map(cookie, F.lit("; *"), F.lit("="))
    return table(spark, sf, "customer").select("c_custkey", F.regexp_extract(html, r'<meta name="author" content="([^"]*)"', 1).alias("author"), jar["token"].alias("token"), jar["place"].alias("place"))


@book.add("SELECT o_orderkey, json_extract_string(j, '$.status') AS status, CAST(json_extract_string(j, '$.n') AS BIGINT) AS n FROM (SELECT o_orderkey, '{\"status\": \"' || o_orderstatus || '\", \"n\": ' || o_custkey || '}' AS j FROM orders)")
def json_in_prose(spark, sf):
    """The JSON object inside of other text, from its first to its last brace."""
    text = F.format_string('Sure: {"status": "%s", "n": %d} done', "o_orderstatus", "o_custkey")
    v = F.try_parse_json(F.regexp_extract("t", r"(?s)(\{.*\})", 1))
    return table(spark, sf, "orders").select("o_orderkey", text.alias("t")).select("o_orderkey", F.try_variant_get(v, "$.status", "string").alias("status"), F.try_variant_get(v, "$.n", "bigint").alias("n"))


@book.add("""SELECT k, CASE WHEN a IN ('0', '999') THEN a ELSE array_to_string(list_filter(string_split(a, ''), lambda x: x BETWEEN '1' AND '9'), ',') END AS actions, CASE WHEN try_cast(o AS INT) >= 1 THEN try_cast(o AS INT) - 1 END AS page_offset, length(t) <= 200 AND len(string_split_regex(trim(t), '\\s+')) <= 50 AND contains(upper(t), 'STEEL') AS separator
 FROM (SELECT p_partkey AS k, CASE p_partkey % 7 WHEN 0 THEN '0' WHEN 1 THEN '999' ELSE CAST(p_partkey % 1000 AS VARCHAR) END AS a, CASE WHEN p_size % 5 = 0 THEN 'x' || p_size ELSE CAST(p_size - 3 AS VARCHAR) END AS o, p_type AS t FROM part)""")
def small_parsers(spark, sf):
    """Choices typed as digits, page numbers as offsets, and whether a page's text is that of a separator."""
    k = c("p_partkey")
    a = F.when(k % 7 == 0, "0").when(k % 7 == 1, "999").otherwise((k % 1000).cast("string"))
    o = F.when(c("p_size") % 5 == 0, F.concat(F.lit("x"), c("p_size").cast("string"))).otherwise((c("p_size") - 3).cast("string"))
    digits = F.array_join(F.filter(F.split("a", ""), lambda x: x.between("1", "9")), ",")
    offset = F.when(c("o").try_cast("int") >= 1, c("o").try_cast("int") - 1)
    separator = (F.char_length("t") <= 200) & (F.size(F.split(F.trim("t"), r"\s+")) <= 50) & F.contains(F.upper("t"), F.lit("STEEL"))
    df = table(spark, sf, "part").select(k.alias("k"), a.alias("a"), o.alias("o"), c("p_type").alias("t"))
    return df.select("k", F.when(c("a").isin("0", "999"), c("a")).otherwise(digits).alias("actions"), offset.alias("page_offset"), separator.alias("separator"))


QUERIES, ORACLE = book.queries, book.oracle
