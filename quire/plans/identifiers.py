"""Queries over identifiers in fields and in texts."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.functions import identifiers as ids
from quire.functions import years
from quire.plans.book import Book
from quire.sources.tables import table

book = Book()
c = F.col

_NORM_DOI = r"""CASE WHEN trim(coalesce(doi, '')) <> '' THEN trim(regexp_replace(trim(regexp_replace(trim(regexp_replace(trim(regexp_replace(trim(doi), '(?i)^doi:', '')), '(?i)^https://doi\.org/', '')), '(?i)^http://dx\.doi\.org/', '')), '(?i)^http://doi\.org/', '')) END"""


@book.add(f"SELECT request_id, {_NORM_DOI} AS doi_norm FROM paper_identifiers")
def doi_normalize(spark, sf):
    return table(spark, sf, "paper_identifiers").select("request_id", ids.normalize_doi(c("doi")).alias("doi_norm"))


@book.add(rf"SELECT valid, count(*) AS n FROM (SELECT CASE WHEN d IS NULL THEN true ELSE NOT regexp_matches(d, '^10\.(1234|9999)/') AND regexp_matches(d, '^10\.\d{{4,}}/\S+$') END AS valid FROM (SELECT {_NORM_DOI} AS d FROM paper_identifiers)) GROUP BY 1")
def doi_validate(spark, sf):
    return table(spark, sf, "paper_identifiers").groupBy(ids.valid_doi(c("doi")).alias("valid")).agg(F.count("*").alias("n"))


@book.add(rf"SELECT doi_norm, count(*) AS requests FROM (SELECT lower({_NORM_DOI}) AS doi_norm FROM paper_identifiers) WHERE doi_norm IS NOT NULL GROUP BY 1")
def requests_per_doi(spark, sf):
    """Requests of each DOI, whatever its decoration and case."""
    df = table(spark, sf, "paper_identifiers").select(F.lower(ids.normalize_doi(c("doi"))).alias("doi_norm"))
    return df.where("doi_norm IS NOT NULL").groupBy("doi_norm").agg(F.count("*").alias("requests"))


_ISBN = r"regexp_replace(upper(regexp_replace(isbn, '\s*\([^)]*\)', '', 'g')), '[^0-9X]', '', 'g')"
_CLEAN = f"CASE WHEN length({_ISBN}) IN (10, 13) THEN {_ISBN} ELSE '' END"
_SUM13 = " + ".join(f"CAST(substr(x, {i}, 1) AS INT) * {1 if i % 2 else 3}" for i in range(1, 13))
_SUM10 = " + ".join(f"CAST(substr(x, {i}, 1) AS INT) * {11 - i}" for i in range(1, 10))
_CHECK = rf"""CASE WHEN isbn IS NULL OR trim(isbn) = '' THEN true WHEN regexp_matches(x, '^978123456789[0-9X]?$') THEN false
 WHEN regexp_matches(x, '^\d{{13}}$') THEN CAST((10 - ({_SUM13}) % 10) % 10 AS VARCHAR) = substr(x, 13, 1)
 WHEN regexp_matches(x, '^\d{{9}}[\dX]$') THEN (CASE (11 - ({_SUM10}) % 11) % 11 WHEN 10 THEN 'X' ELSE CAST((11 - ({_SUM10}) % 11) % 11 AS VARCHAR) END) = substr(x, 10, 1) ELSE false END"""


@book.add(f"SELECT search_id, isbn, {_CHECK} AS valid, CASE length(x) WHEN 13 THEN substr(x, 4, 9) WHEN 10 THEN substr(x, 1, 9) END AS core FROM (SELECT search_id, isbn, {_CLEAN} AS x FROM search_results WHERE isbn IS NOT NULL)")
def isbn_validate(spark, sf):
    """Check digit and core of every ISBN."""
    return table(spark, sf, "search_results").where("isbn IS NOT NULL").select("search_id", "isbn", ids.valid_isbn(c("isbn")).alias("valid"), ids.isbn_core(c("isbn")).alias("core"))


_GROUPS = " ".join(f"WHEN starts_with(b, '{g}') THEN '{g}'" for g in ids.ISBN_GROUPS)


@book.add(f"SELECT isbn_group, count(*) AS n FROM (SELECT CASE {_GROUPS} ELSE '' END AS isbn_group FROM (SELECT CASE WHEN length(x) = 13 AND substr(x, 1, 3) IN ('978', '979') THEN substr(x, 4) ELSE x END AS b FROM (SELECT {_CLEAN} AS x FROM search_results WHERE isbn IS NOT NULL))) GROUP BY 1")
def isbn_groups(spark, sf):
    return table(spark, sf, "search_results").where("isbn IS NOT NULL").groupBy(ids.isbn_group(c("isbn")).alias("isbn_group")).agg(F.count("*").alias("n"))


@book.add(f"SELECT core, count(*) AS items, count(DISTINCT item_key) AS keys, min(title) AS first_title FROM (SELECT *, CASE length(x) WHEN 13 THEN substr(x, 4, 9) WHEN 10 THEN substr(x, 1, 9) END AS core FROM (SELECT item_key, title, {_CLEAN} AS x FROM search_results)) WHERE core IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def isbn_duplicates(spark, sf):
    """Items of one book, by the core that both forms of its ISBN share."""
    df = table(spark, sf, "search_results").withColumn("core", ids.isbn_core(c("isbn"))).where("core IS NOT NULL")
    return df.groupBy("core").agg(F.count("*").alias("items"), F.countDistinct("item_key").alias("keys"), F.min("title").alias("first_title")).where("items > 1")


_ISSN = "lpad(CAST((r_id % 10000) AS VARCHAR), 4, '0') || '-' || lpad(CAST((r_id // 10000 % 1000) AS VARCHAR), 3, '0') || CASE WHEN r_id % 13 = 0 THEN 'X' ELSE CAST(r_id % 10 AS VARCHAR) END"
_ISSN_SUM = " + ".join(f"CAST(substr(y, {i}, 1) AS INT) * {9 - i}" for i in range(1, 8))


@book.add(f"SELECT r_id AS result_id, issn, CASE WHEN issn = '1234-5678' THEN false WHEN substr(y, 8, 1) = 'X' THEN true ELSE (11 - ({_ISSN_SUM}) % 11) % 11 < 10 AND CAST((11 - ({_ISSN_SUM}) % 11) % 11 AS VARCHAR) = substr(y, 8, 1) END AS valid FROM (SELECT r_id, issn, replace(issn, '-', '') AS y FROM (SELECT r_id, {_ISSN} AS issn FROM (SELECT result_id AS r_id FROM metadata_results)))")
def issn_validate(spark, sf):
    """Check digits of ISSNs made from the ids, right and wrong ones."""
    i = c("result_id")
    last = F.when(i % 13 == 0, "X").otherwise((i % 10).cast("string"))
    issn = F.concat(F.lpad((i % 10000).cast("string"), 4, "0"), F.lit("-"), F.lpad((F.floor(i / 10000) % 1000).cast("string"), 3, "0"), last)
    return table(spark, sf, "metadata_results").select("result_id", issn.alias("issn")).withColumn("valid", ids.valid_issn(c("issn")))


@book.add(r"""SELECT token, bool_or(regexp_matches(token, '^https?://[^/\s?#]+')) AS valid_url, bool_or(regexp_matches(x, '^\d{4}\.\d{4,5}(v\d+)?$') OR regexp_matches(x, '^[a-z-]+(\.[A-Z]{2})?/\d{7}(v\d+)?$')) AS valid_arxiv, count(*) AS n
 FROM (SELECT *, trim(regexp_replace(token, '(arXiv|arxiv):', '', 'g')) AS x FROM (SELECT unnest(regexp_extract_all(text, '([^\s()<>]*(?:://|[Aa]r[Xx]iv:|www\.)[^\s()<>]*)', 1)) AS token FROM documents)) GROUP BY 1""")
def url_arxiv_validate(spark, sf):
    """What looks like a link or an arXiv number in the documents, whether it is a valid one, and how often it stands there."""
    found = F.regexp_extract_all("text", F.lit(r"([^\s()<>]*(?:://|[Aa]r[Xx]iv:|www\.)[^\s()<>]*)"), 1)
    n = table(spark, sf, "documents").select(F.explode(found).alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    return n.select("token", ids.valid_url(c("token")).alias("valid_url"), ids.valid_arxiv(c("token")).alias("valid_arxiv"), "n")


_PRINTED = r"list_transform(regexp_extract_all(text, '\b(10\.\d{4,}[/)][^\s)]+)', 1), lambda x: regexp_replace(regexp_replace(x, '^(10\.\d{4,})\)', '\1/'), '[.,;:\s]+$', ''))"


@book.add(f"SELECT doc_id, array_to_string(list_transform(list_filter(range(1, len(d) + 1), lambda i: list_position(d, d[i]) = i), lambda i: d[i]), ' ') AS dois FROM (SELECT doc_id, {_PRINTED} AS d FROM documents WHERE text IS NOT NULL) WHERE len(d) > 0")
def extract_dois(spark, sf):
    """All DOIs printed in each document."""
    df = table(spark, sf, "documents").select("doc_id", ids.extract_dois(c("text")).alias("d"))
    return df.where(F.size("d") > 0).select("doc_id", F.array_join("d", " ").alias("dois"))


_TEXT = "'ISSN: 1234-567' || (o_orderkey % 10) || CASE o_orderkey % 3 WHEN 0 THEN ' (online), ' WHEN 1 THEN ' (print), ' ELSE '; ' END || 'ISSN 2049-36' || lpad(CAST(o_orderkey % 100 AS VARCHAR), 2, '0') || ' Journal. See https://www.jstor.org/stable/' || o_custkey || ' and http://x.org/a?b=' || o_custkey || '. arXiv:2' || (100 + o_orderkey % 900) || '.0' || (1000 + o_orderkey % 9000) || ' ISBN ' || CASE WHEN o_orderkey % 2 = 0 THEN '978-0-262-03384-8' ELSE '0262033841' END || '.'"


def _printed(spark, sf):
    k = c("o_orderkey")
    s = lambda x: x.cast("string")
    mark = F.when(k % 3 == 0, " (online), ").when(k % 3 == 1, " (print), ").otherwise("; ")
    isbn = F.when(k % 2 == 0, "978-0-262-03384-8").otherwise("0262033841")
    text = F.concat(F.lit("ISSN: 1234-567"), s(k % 10), mark, F.lit("ISSN 2049-36"), F.lpad(s(k % 100), 2, "0"), F.lit(" Journal. See https://www.jstor.org/stable/"), s(c("o_custkey")), F.lit(" and http://x.org/a?b="), s(c("o_custkey")), F.lit(". arXiv:2"), s(100 + k % 900), F.lit(".0"), s(1000 + k % 9000), F.lit(" ISBN "), isbn, F.lit("."))
    return table(spark, sf, "orders").select(k, text.alias("text"))


@book.add(rf"""WITH t AS (SELECT o_orderkey, {_TEXT} AS text FROM orders) SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN '1234-567' || (o_orderkey % 10) || ' ' ELSE '1234-567' || (o_orderkey % 10) || ' ' END || regexp_extract(text, 'ISSN (2049-\d{{4}})', 1) AS issns,
 array_to_string(regexp_extract_all(text, 'jstor\.org/stable/(\d+)', 1), ' ') AS jstor, regexp_extract(text, '(http://x.org/a\?b=\d+)', 1) AS urls, regexp_extract(text, 'arXiv:(\d{{4}}\.\d{{4,5}})', 1) AS arxiv, CASE WHEN o_orderkey % 2 = 0 THEN '9780262033848' ELSE '' END AS isbns FROM t""")
def extract_bundle(spark, sf):
    """ISSNs (online ones first), JSTOR numbers, URLs, arXiv numbers and valid ISBNs of a printed line."""
    t = c("text")
    join = lambda x: F.array_join(x, " ")
    return _printed(spark, sf).select("o_orderkey", join(ids.extract_issns(t)).alias("issns"), join(ids.extract_jstor_ids(t)).alias("jstor"), join(ids.extract_urls(t)).alias("urls"), join(ids.extract_arxiv_ids(t)).alias("arxiv"), join(ids.extract_isbns(t)).alias("isbns"))


@book.add(r"""SELECT doc_id, array_to_string(list_sort(list_distinct(list_filter(list_concat(regexp_extract_all(text, '\((\d{4})\)', 1), regexp_extract_all(text, '[\s©](\d{4})\b', 1)), lambda y: CAST(y AS INT) BETWEEN 1900 AND 2100))), ' ') AS years FROM documents WHERE text IS NOT NULL""")
def extract_years(spark, sf):
    """The distinct years of each document, in any of the printed forms."""
    return table(spark, sf, "documents").where("text IS NOT NULL").select("doc_id", F.array_join(F.array_sort(ids.extract_years(c("text"))), " ").alias("years"))


@book.add()
def best_year(spark, sf):
    """The likeliest year of publication among all years of each document, by form, place, words nearby and recency."""
    df = table(spark, sf, "documents").where("text IS NOT NULL").select("doc_id", years.best_year(c("text")).alias("b"))
    return df.select("doc_id", "b.*").where("best_year IS NOT NULL")


@book.add("SELECT original_filename, nullif(regexp_extract(upper(original_filename), '^(NO|EN|DE|FI|SV)_', 1), '') AS lang FROM paper_identifiers")
def filename_language(spark, sf):
    return table(spark, sf, "paper_identifiers").select("original_filename", ids.filename_language(c("original_filename")).alias("lang"))


@book.add(r"SELECT doc_id, regexp_extract(text, '^\s*([^\n]+)', 1) AS title, regexp_extract(text, '(10\.\d{4,9}/\S+)', 1) AS doi, CASE WHEN regexp_matches(text, '10\.\d{4,9}/\S+') THEN 30 ELSE 0 END AS confidence FROM documents WHERE text IS NOT NULL")
def first_page_guess(spark, sf):
    """Title and DOI as the first line and the first number of a page suggest them."""
    doi = F.regexp_extract("text", r"(10\.\d{4,9}/\S+)", 1)
    return table(spark, sf, "documents").where("text IS NOT NULL").select("doc_id", F.regexp_extract("text", r"^\s*([^\n]+)", 1).alias("title"), doi.alias("doi"), F.when(doi != "", 30).otherwise(0).alias("confidence"))


@book.add(r"""SELECT doc_id, sparse + keyword + place + bare AS score, sparse + keyword + place + bare >= 4 AS conference FROM (SELECT doc_id, CASE WHEN len(regexp_extract_all(text, '\S+')) < 100 THEN 3 ELSE 0 END AS sparse, CASE WHEN regexp_matches(text, '(?i)conference|proceedings|symposium|workshop|committee') THEN 2 ELSE 0 END AS keyword,
 CASE WHEN regexp_matches(text, '(?i)\d{1,2} (January|February|March|April|May|June|July|August|September|October|November|December)') THEN 2 ELSE 0 END AS place, CASE WHEN NOT regexp_matches(text, '(?i)doi|issn|isbn') THEN 2 ELSE 0 END AS bare FROM documents WHERE text IS NOT NULL)""")
def conference_score(spark, sf):
    """Points that speak for a conference paper."""
    t = c("text")
    score = F.when(F.size(F.regexp_extract_all(t, F.lit(r"(\S+)"), 1)) < 100, 3).otherwise(0) + F.when(t.rlike("(?i)conference|proceedings|symposium|workshop|committee"), 2).otherwise(0)
    score = score + F.when(t.rlike(r"(?i)\d{1,2} (January|February|March|April|May|June|July|August|September|October|November|December)"), 2).otherwise(0) + F.when(~t.rlike("(?i)doi|issn|isbn"), 2).otherwise(0)
    return table(spark, sf, "documents").where("text IS NOT NULL").select("doc_id", score.alias("score")).withColumn("conference", c("score") >= 4)


@book.add(f"SELECT d.doc_id, p.request_id FROM (SELECT DISTINCT doc_id, unnest(list_transform({_PRINTED}, lambda x: lower(x))) AS printed FROM documents) d JOIN (SELECT request_id, {_NORM_DOI} AS doi FROM paper_identifiers) p ON d.printed = lower(p.doi)")
def printed_doi_join(spark, sf):
    """Requests whose DOI stands printed in a document, in whatever form."""
    d = table(spark, sf, "documents").select("doc_id", F.explode(F.array_distinct(F.transform(ids.extract_dois(c("text")), F.lower))).alias("k"))
    p = table(spark, sf, "paper_identifiers").select("request_id", F.lower(ids.normalize_doi(c("doi"))).alias("k"))
    return d.join(p, "k").select("doc_id", "request_id")


@book.add(rf"""SELECT request_id, CASE WHEN d IS NULL THEN true ELSE NOT regexp_matches(d, '^10\.(1234|9999)/') AND regexp_matches(d, '^10\.\d{{4,}}/\S+$') END AS valid_doi, CASE WHEN regexp_matches(d, '^10\.\d{{4,}}/\S+$') AND NOT regexp_matches(d, '^10\.(1234|9999)/') THEN d END AS cleaned_doi, CASE WHEN NOT valid_doi THEN 1 ELSE 0 END AS flags FROM (SELECT request_id, {_NORM_DOI} AS d FROM paper_identifiers)""")
def validate_records(spark, sf):
    """All checks of the identifiers of every request in one select."""
    p = table(spark, sf, "paper_identifiers")
    v = ids.validated({"doi": c("doi"), "issn": F.try_element_at("extras", F.lit("issn")), "isbn": F.try_element_at("extras", F.lit("isbn"))})
    return p.select("request_id", *(x.alias(n) for n, x in v.items())).select("request_id", "valid_doi", "cleaned_doi", F.size("confidence_flags").alias("flags"))


_CASES = [
    ("doi", "10.1038/s42256-025-01072-0", True, "10.1038/s42256-025-01072-0"), ("doi", "doi:10.1038/nature12345", True, "10.1038/nature12345"), ("doi", "https://doi.org/10.1038/nature12345", True, "10.1038/nature12345"), ("doi", "10.1234/fake", False, None), ("doi", "not-a-doi", False, None), ("doi", None, True, None),
    ("issn", "0028-0836", True, "0028-0836"), ("issn", "1234-567X", True, "1234-567X"), ("issn", "1234-5678", False, None), ("issn", "12345678", False, None), ("issn", None, True, None),
    ("isbn", "9780262033848", True, "9780262033848"), ("isbn", "0262033844", True, "0262033844"), ("isbn", "978-0-262-03384-8", True, "9780262033848"), ("isbn", "978123456789", False, None), ("isbn", "9780262033841", False, None), ("isbn", None, True, None),
]
_SQL = lambda x: "NULL" if x is None else str(x).lower() if isinstance(x, bool) else f"'{x}'"


@book.add("SELECT * FROM (VALUES " + ", ".join(f"({i}, {', '.join(map(_SQL, x))}, {0 if x[2] else 1})" for i, x in enumerate(_CASES)) + ") t(no, kind, raw, valid, cleaned, flags)")
def validation_cases(spark, sf):
    """The published cases of identifier checks, each run as a record of its own through all checks."""
    df = spark.createDataFrame([(i, k, r) for i, (k, r, _, _) in enumerate(_CASES)], "no int, kind string, raw string")
    v = ids.validated({k: F.when(c("kind") == k, c("raw")) for k in ("doi", "issn", "isbn")})
    df = df.select("no", "kind", "raw", *(x.alias(n) for n, x in v.items()))
    valid = F.expr("valid_doi AND valid_issn AND valid_isbn")
    return df.select("no", "kind", "raw", valid.alias("valid"), F.coalesce("cleaned_doi", "cleaned_issn", "cleaned_isbn").alias("cleaned"), F.size("confidence_flags").alias("flags"))


QUERIES, ORACLE = book.queries, book.oracle
