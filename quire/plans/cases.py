"""Queries over the published cases of grammars and checks, and the same functions over the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions import authors as au
from quire.functions import identifiers as ids
from quire.functions import pages
from quire.plans.book import Book
from quire.sources.tables import table

book = Book()
c = F.col

_PLANS = [
    ("1-12;-13;14-31", 31, "1-12;14-31 without 13", False, None), ("1-5;-6;7-10;-11;12-31", 31, "1-5;7-10;12-31 without 6,11", False, None), (";-13;", 31, "1-12;14-31 without 13", False, None),
    ("1-12;;14-31", 31, "1-12;14-31 without 13", True, None), ("1-3;-4", 10, " without ", False, "uncovered pages"), ("1-12;12-20", 20, " without ", False, "page named twice"),
    ("1-x", 9, " without ", False, "unreadable part or page out of range"), ("1-12", 9, " without ", False, "unreadable part or page out of range"), ("", 3, " without ", False, "no parts"), ("5", 5, " without ", False, "uncovered pages"),
]


def _sql(x) -> str:
    return "NULL" if x is None else str(x).lower() if isinstance(x, bool) else str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'"


def _values(rows: list[tuple], names: str) -> str:
    return "SELECT * FROM (VALUES " + ", ".join(f"({', '.join(map(_sql, r))})" for r in rows) + f") t({names})"


@book.add(_values(_PLANS, "plan, n, result, keep_only, error"))
def page_plan_cases(spark, sf):
    """The published page plans and faulty ones: outputs and dropped pages in words, or the error."""
    df = spark.createDataFrame([r[:2] for r in _PLANS], "plan string, n int").withColumn("p", pages.page_plan(c("plan"), c("n")))
    return df.select("plan", "n", pages.plan_text(c("p.kept"), c("p.dropped")).alias("result"), "p.keep_only", "p.error")


@book.add(r"""WITH w AS (SELECT p.request_id, p.authors, ' ' || trim(regexp_replace(lower(coalesce(d.text, '')), '[^\p{L}\p{N}]+', ' ', 'g')) || ' ' AS body FROM paper_identifiers p JOIN documents d USING (doc_id) WHERE p.authors IS NOT NULL),
 k AS (SELECT *, list_filter(list_transform(authors, lambda a: struct_pack(a := a, l := ' ' || trim(regexp_replace(lower(CASE WHEN contains(a, ',') THEN trim(regexp_extract(a, '^([^,]*),', 1)) ELSE regexp_extract(trim(a), '(\S+)$', 1) END), '[^\p{L}\p{N}]+', ' ', 'g')) || ' ')), lambda s: trim(s.l) <> '' AND contains(body, s.l)) AS hits FROM w)
 SELECT request_id, array_to_string(CASE WHEN trim(body) = '' THEN authors ELSE list_transform(hits, lambda s: s.a) END, '; ') AS authors FROM k""")
def authors_validated(spark, sf):
    """The authors of each record that its document confirms by whole words; without text they stay."""
    d = table(spark, sf, "documents").select("doc_id", "text")
    p = table(spark, sf, "paper_identifiers").where("authors IS NOT NULL").select("request_id", "doc_id", "authors")
    return p.join(d, "doc_id").select("request_id", F.array_join(au.validated(c("authors"), c("text"), F.array().cast("array<string>")), "; ").alias("authors"))


_AUTHORS = [("Smith, John|Doe, Jane", "Abstract by John Smith on research.", "", "Smith, John", True), ("Ghost, Author", "", "Alice Johnson", "Alice Johnson", False), ("Bodei, Remo", "This essay by Georg Simmel explores the stranger.", "Georg Simmel", "Georg Simmel", False), ("Lone, Anna", "", "", "Lone, Anna", False)]


@book.add(_values(_AUTHORS, "authors, text, printed, result, near"))
def author_text_cases(spark, sf):
    """The published cases of checking authors against a text, and whether the first one's names stand together in it."""
    parts = lambda x: F.filter(F.split(x, r"\|"), lambda y: y != "")
    df = spark.createDataFrame([r[:3] for r in _AUTHORS], "authors string, text string, printed string")
    result = F.array_join(au.validated(parts(c("authors")), c("text"), parts(c("printed"))), "|")
    return df.select("authors", "text", "printed", result.alias("result"), au.near_each_other(F.get(parts(c("authors")), F.lit(0)), c("text")).alias("near"))


_EXTRACTED = [("Authors: Jane Doe and John Smith\nDepartment of Something", "Jane Doe|John Smith"), ("Author(s): Alice Johnson, Bob Miller", "Alice Johnson|Bob Miller"), ("No label here", "")]


@book.add(_values(_EXTRACTED, "text, authors"))
def author_label_cases(spark, sf):
    """The published cases of reading authors behind a label."""
    df = spark.createDataFrame([r[:1] for r in _EXTRACTED], "text string")
    return df.select("text", F.array_join(F.array_sort(au.labelled_authors(c("text"))), "|").alias("authors"))


@book.add(rf"""SELECT doc_id, len(list_distinct(list_filter(regexp_extract_all(text, '{au.NAME.replace("'", "''")}', 1), lambda x: len(list_intersect(string_split_regex(lower(x), '\s+'), [{', '.join(f"'{w}'" for w in au.NO_NAMES)}])) = 0))) AS names FROM documents WHERE text IS NOT NULL""")
def names_in_text(spark, sf):
    """How many distinct names each whole document holds, by their shape."""
    return table(spark, sf, "documents").where("text IS NOT NULL").select("doc_id", F.size(au.names_in(c("text"))).cast("long").alias("names"))


_X = r"regexp_replace(upper(regexp_replace(isbn, '\s*\([^)]*\)', '', 'g')), '[^0-9X]', '', 'g')"


@book.add("SELECT search_id, isbn, CASE WHEN length(x) = 13 AND substr(x, 1, 3) IN ('978', '979') THEN CASE " + " ".join(f"WHEN substr(x, 4, 3) = '{k}' THEN '{v}'" for k, v in ids.COUNTRIES.items()) + " " + " ".join(f"WHEN starts_with(substr(x, 4, 3), '{k}') THEN '{v}'" for k, v in ids.COUNTRIES.items()) + f" END END AS country FROM (SELECT search_id, isbn, {_X} AS x FROM search_results WHERE isbn IS NOT NULL)")
def isbn_countries(spark, sf):
    """The country that an ISBN's registration group tells."""
    return table(spark, sf, "search_results").where("isbn IS NOT NULL").select("search_id", "isbn", ids.isbn_country(c("isbn")).alias("country"))


_PAIRS = [("9780262033848", "0262033844", True), ("978-0-262-03384-8", "0-262-03384-4", True), ("9780262033848", "9780262033841", True), ("0262033844", "0306406152", False), ("9780306406157", "0306406152", True), (None, "0306406152", False), ("", "", False)]


@book.add(_values(_PAIRS, "a, b, same"))
def isbn_probe_cases(spark, sf):
    """Whether two ISBNs of either form are of one book, by the core that both forms share."""
    df = spark.createDataFrame([r[:2] for r in _PAIRS], "a string, b string")
    return df.select("a", "b", F.coalesce(ids.isbn_core(c("a")) == ids.isbn_core(c("b")), F.lit(False)).alias("same"))


_ARXIV = [("see arXiv:2301.12345v2 and 2302.11111", "2301.12345|2302.11111"), ("arXiv: hep-th/9901001.", "hep-th/9901001"), ("arxiv cs.AI/0001001", ""), ("math/0309136 (arXiv)", "math/0309136"), ("page 2301.12345", "")]


@book.add(_values(_ARXIV, "text, numbers"))
def arxiv_cases(spark, sf):
    """arXiv numbers of both forms, which count beside the word alone."""
    df = spark.createDataFrame([r[:1] for r in _ARXIV], "text string")
    return df.select("text", F.array_join(ids.extract_arxiv_ids(c("text")), "|").alias("numbers"))


_LINKS = [("https://a.org/1", True, False), ("ftp://a.org", False, False), ("http://", False, False), ("arXiv:2301.01234", False, True), ("cs.AI/0001001", False, True), ("math.GT/0309136", False, True), ("2301.12345v2", False, True), ("23.1", False, False), ("HTTP://a.org", False, False), ("", True, True), (None, True, True)]


@book.add(_values(_LINKS, "raw, valid_url, valid_arxiv"))
def link_cases(spark, sf):
    """Links and arXiv numbers, valid and not; what is missing counts as valid."""
    df = spark.createDataFrame([r[:1] for r in _LINKS], "raw string")
    return df.select("raw", ids.valid_url(c("raw")).alias("valid_url"), ids.valid_arxiv(c("raw")).alias("valid_arxiv"))


@book.add("SELECT doc_id, len(list_filter(u, lambda x: regexp_matches(lower(x), '" + "|".join(h.replace(".", r"\.") for h in ids.INSTITUTIONS) + "'))) AS institutional, len(u) AS urls FROM (SELECT doc_id, list_distinct(list_filter(list_transform(regexp_extract_all(text, '" + ids.URL.replace("'", "''") + r"', 1), lambda x: regexp_replace(x, '[.,;:!?)]+$', '')), lambda x: NOT contains(lower(x), 'jstor.org'))) AS u FROM documents WHERE text IS NOT NULL)")
def institutional_urls(spark, sf):
    """URLs of each document, and those of universities and repositories."""
    d = table(spark, sf, "documents").where("text IS NOT NULL").select("doc_id", ids.extract_urls(c("text")).alias("u"))
    return d.select("doc_id", F.size(F.filter("u", ids.institutional)).cast("long").alias("institutional"), F.size("u").cast("long").alias("urls"))


@book.add(r"SELECT zotero_item_code, count(*) AS rows, count(*) FILTER (WHERE lower(final_filename) LIKE '%.pdf') AS pdf, count(*) FILTER (WHERE coalesce(regexp_extract(lower(trim(final_filename)), '\.([a-z0-9]+)$', 1), '') <> 'pdf') AS other FROM scan_log WHERE zotero_item_code IS NOT NULL GROUP BY 1")
def linked_files(spark, sf):
    """Files linked to each stored attachment: those whose base name ends in .pdf, and those of another kind or none."""
    low = F.lower("final_filename")
    kind = F.coalesce(F.regexp_extract(F.trim(low), r"\.([a-z0-9]+)$", 1), F.lit(""))
    return table(spark, sf, "scan_log").where("zotero_item_code IS NOT NULL").groupBy("zotero_item_code").agg(F.count("*").alias("rows"), F.count_if(low.endswith(".pdf")).alias("pdf"), F.count_if(kind != "pdf").alias("other"))


@book.add("SELECT DISTINCT original_filename FROM scan_log l WHERE lower(trim(status)) = 'success' AND trim(coalesce(final_filename, '')) <> '' AND zotero_item_code IS NULL AND original_filename IS NOT NULL")
def undecided_files(spark, sf):
    """Files that were read with success and that nobody has decided on."""
    done = (F.lower(F.trim("status")) == "success") & (F.trim(F.coalesce("final_filename", F.lit(""))) != "") & c("zotero_item_code").isNull()
    return table(spark, sf, "scan_log").where(done & c("original_filename").isNotNull()).select("original_filename").distinct()


QUERIES, ORACLE = book.queries, book.oracle
