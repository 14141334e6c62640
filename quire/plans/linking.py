"""Queries that match records, names and journals, score candidates and plan what to enrich."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.functions import scoring as sc
from quire.plans.book import Book
from quire.sources.tables import table

book = Book()
c = F.col

_NT = "trim(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g'))"
_WORDS = "list_sort(list_distinct(list_filter(string_split(" + _NT + ", ' '), lambda w: w <> '')))"
_LAST = r"CASE WHEN contains({0}, ',') THEN trim(regexp_extract({0}, '^([^,]*),', 1)) ELSE regexp_extract(trim({0}), '(\S+)$', 1) END"
_AUTHOR = r"array_to_string(list_sort(string_split(trim(regexp_replace(regexp_replace(lower(CASE WHEN contains({0}, ',') THEN regexp_extract({0}, ',(.*)$', 1) || ' ' || regexp_extract({0}, '^([^,]*),', 1) ELSE {0} END), '[^a-z0-9\s]', '', 'g'), '\s+', ' ', 'g')), ' ')), ' ')"
_YEAR = r"try_cast(regexp_extract({0}, '(1[5-9]\d\d|20\d\d)', 1) AS INT)"


@book.add(f"SELECT search_id, {_NT.format('title')} AS norm FROM search_results")
def title_normalize(spark, sf):
    return table(spark, sf, "search_results").select("search_id", sc.normal_title(c("title")).alias("norm"))


@book.add(f"SELECT DISTINCT name, {_AUTHOR.format('name')} AS norm FROM (SELECT unnest(authors) AS name FROM search_results)")
def author_normalize(spark, sf):
    return table(spark, sf, "search_results").select(F.explode("authors").alias("name")).distinct().select("name", sc.normal_author(c("name")).alias("norm"))


def _pairs(spark, sf):
    """Requests with their candidates: an equi-join, one row per answer."""
    p = table(spark, sf, "paper_identifiers").select("request_id", c("title").alias("p_title"), c("authors").alias("p_authors"), c("year").alias("p_year"), c("language").alias("p_lang"))
    m = table(spark, sf, "metadata_results").select("request_id", "result_id", "title", "authors", "publication_date", "language", "confidence")
    return p.join(m, "request_id")


_PAIRS = "pairs AS (SELECT p.request_id, m.result_id, p.title AS p_title, m.title, p.authors AS p_authors, m.authors, p.year AS p_year, m.publication_date, p.language AS p_lang, m.language, m.confidence FROM paper_identifiers p JOIN metadata_results m ON p.request_id = m.request_id)"


@book.add(f"WITH {_PAIRS} SELECT request_id, result_id, CAST(levenshtein(a, b) AS INT) AS distance FROM (SELECT request_id, result_id, {_NT.format('p_title')} AS a, {_NT.format('title')} AS b FROM pairs WHERE p_title IS NOT NULL AND title IS NOT NULL)")
def title_distance(spark, sf):
    """Edit distance of the normal titles of each request and its candidates."""
    pairs = _pairs(spark, sf).where("p_title IS NOT NULL AND title IS NOT NULL")
    return pairs.select("request_id", "result_id", F.levenshtein(sc.normal_title(c("p_title")), sc.normal_title(c("title"))).alias("distance"))


_OV = "CASE WHEN len({0}) > 0 AND len({1}) > 0 THEN len(list_intersect({0}, {1})) / CAST(greatest(len({0}), len({1})) AS DOUBLE) ELSE 0.0 END"


@book.add(f"""WITH {_PAIRS} SELECT request_id, result_id, round({_OV.format('ta', 'tb')}, 6) AS word_overlap, round({_OV.format('na', 'nb')}, 6) AS author_score, CASE abs(ya - yb) WHEN 0 THEN 1.0 WHEN 1 THEN 0.5 ELSE 0.0 END AS year_score,
 CASE WHEN language IS NULL OR trim(language) = '' OR sure < 0.9 THEN NULL WHEN lower(trim(p_lang)) = lower(trim(language)) THEN 1.0 ELSE 0.0 END AS language_score FROM (SELECT *, {_WORDS.format("coalesce(p_title, '')")} AS ta, {_WORDS.format("coalesce(title, '')")} AS tb,
 list_distinct(list_filter(list_transform(coalesce(p_authors, []), lambda x: {_AUTHOR.format('x')}), lambda x: x <> '')) AS na, list_distinct(list_filter(list_transform(coalesce(authors, []), lambda x: {_AUTHOR.format('x')}), lambda x: x <> '')) AS nb, {_YEAR.format('p_year')} AS ya, {_YEAR.format('publication_date')} AS yb,
 coalesce(CASE WHEN confidence > 1 THEN confidence / 100 ELSE confidence END, 1.0) AS sure FROM pairs)""")
def component_scores(spark, sf):
    """Shared words, authors, year and language of every request and answer, all inside the JVM."""
    empty = F.array().cast("array<string>")
    norm = lambda x: F.array_distinct(F.filter(F.transform(F.coalesce(x, empty), sc.normal_author), lambda n: n != ""))
    sure = F.coalesce(F.when(c("confidence") > 1, c("confidence") / 100).otherwise(c("confidence")), F.lit(1.0))
    words = lambda x: sc.words(F.coalesce(c(x), F.lit("")))
    return _pairs(spark, sf).select(
        "request_id", "result_id",
        F.round(sc.overlap(words("p_title"), words("title")), 6).alias("word_overlap"),
        F.round(sc.overlap(norm(c("p_authors")), norm(c("authors"))), 6).alias("author_score"),
        sc.year_score(sc.year_of(c("p_year")), sc.year_of(c("publication_date"))).alias("year_score"),
        sc.language_score(c("p_lang"), c("language"), sure).alias("language_score"),
    )


@book.add(f"""WITH {_PAIRS}, r AS (SELECT request_id, result_id, CASE WHEN a = b AND ya = yb THEN 0 WHEN a = b THEN 1 WHEN ya = yb THEN 2 ELSE 3 END AS tier, b FROM (SELECT request_id, result_id, {_NT.format('p_title')} AS a, {_NT.format('title')} AS b, {_YEAR.format('p_year')} AS ya, {_YEAR.format('publication_date')} AS yb FROM pairs))
 SELECT request_id, result_id, tier, row_number() OVER (PARTITION BY request_id ORDER BY tier, b NULLS LAST, result_id) AS rank FROM r QUALIFY rank <= 5""")
def tiered_rank(spark, sf):
    """Candidates in tiers (title and year, title, year, rest), then by title; the rank comes before the cut."""
    a, b = sc.normal_title(c("p_title")), sc.normal_title(c("title"))
    ya, yb = sc.year_of(c("p_year")), sc.year_of(c("publication_date"))
    tier = F.when((a == b) & (ya == yb), 0).when(a == b, 1).when(ya == yb, 2).otherwise(3)
    df = _pairs(spark, sf).select("request_id", "result_id", tier.alias("tier"), b.alias("b"))
    rank = F.row_number().over(W.partitionBy("request_id").orderBy("tier", F.asc_nulls_last("b"), "result_id"))
    return df.withColumn("rank", rank.cast("long")).where("rank <= 5").select("request_id", "result_id", "tier", "rank")


@book.add(f"""WITH {_PAIRS}, pos AS (SELECT request_id, result_id, list_filter(list_transform(coalesce(p_authors, []), lambda x: list_position(list_transform(coalesce(authors, []), lambda y: {_AUTHOR.format('y')}), {_AUTHOR.format('x')})), lambda i: i > 0) AS ats, len(p_authors) AS n FROM pairs)
 SELECT request_id, result_id, CASE WHEN len(ats) = 0 THEN 0 WHEN len(ats) = n AND ats = range(1, n + 1) THEN 100 WHEN ats = list_sort(ats) THEN 50 + 10 * len(ats) ELSE 10 + 5 * len(ats) END AS order_score FROM pos""")
def author_order_score(spark, sf):
    """100 for the same authors in the same places, less for the same order, least for any that are shared."""
    empty = F.array().cast("array<string>")
    theirs = F.transform(F.coalesce("authors", empty), sc.normal_author)
    at = F.filter(F.transform(F.coalesce("p_authors", empty), lambda x: F.array_position(theirs, sc.normal_author(x))), lambda i: i > 0)
    df = _pairs(spark, sf).select("request_id", "result_id", at.alias("at"), F.size("p_authors").alias("n"))
    k = F.size("at").cast("long")
    same = (F.size("at") == c("n")) & (c("at") == F.sequence(F.lit(1).cast("long"), F.greatest(c("n"), F.lit(1)).cast("long")))
    score = F.when(k == 0, 0).when(same, 100).when(c("at") == F.array_sort("at"), 50 + 10 * k).otherwise(10 + 5 * k)
    return df.select("request_id", "result_id", score.cast("long").alias("order_score"))


@book.add(f"SELECT DISTINCT n.name, a.author_id FROM (SELECT DISTINCT unnest(authors) AS name FROM search_results) n JOIN author_catalogue a ON lower({_LAST.format('n.name')}) = lower(a.last_name) WHERE n.name IS NOT NULL")
def catalogue_by_last_name(spark, sf):
    """Catalogue entries with the surname of each author; the catalogue is small enough for the optimiser to broadcast."""
    n = table(spark, sf, "search_results").select(F.explode("authors").alias("name")).distinct().withColumn("k", F.lower(sc.last_name(c("name"))))
    a = table(spark, sf, "author_catalogue").select("author_id", F.lower("last_name").alias("k"))
    return n.join(a, "k").select("name", "author_id").distinct()


@book.add(f"""WITH n AS (SELECT search_id, unnest(authors) AS name FROM search_results), k AS (SELECT search_id, n.name, max(CASE WHEN a.author_id IS NOT NULL THEN 1 ELSE 0 END) AS known FROM n LEFT JOIN author_catalogue a ON lower({_LAST.format('n.name')}) = lower(a.last_name) GROUP BY 1, 2)
 SELECT search_id, round(100.0 * sum(known) / count(*), 6) AS coverage_pct, CASE WHEN sum(known) = count(*) THEN 'HIGH' WHEN 2 * sum(known) >= count(*) THEN 'MEDIUM' ELSE 'LOW' END AS confidence FROM k GROUP BY 1""")
def author_coverage(spark, sf):
    """Share of a record's authors whose surname the catalogue knows."""
    n = table(spark, sf, "search_results").select("search_id", F.explode("authors").alias("name")).distinct().withColumn("k", F.lower(sc.last_name(c("name"))))
    a = table(spark, sf, "author_catalogue").select(F.lower("last_name").alias("k")).distinct().withColumn("known", F.lit(1))
    g = n.join(a, "k", "left").groupBy("search_id").agg(F.sum(F.coalesce("known", F.lit(0))).alias("s"), F.count("*").alias("n"))
    label = F.when(c("s") == c("n"), "HIGH").when(2 * c("s") >= c("n"), "MEDIUM").otherwise("LOW")
    return g.select("search_id", F.round(F.lit(100.0) * c("s") / c("n"), 6).alias("coverage_pct"), label.alias("confidence"))


_FOLDNAME = "regexp_replace(lower({0}), '[^a-z]', '', 'g')"


@book.add("""WITH j AS (SELECT lower(trim(journal)) AS k, count(*) AS papers FROM paper_identifiers WHERE journal IS NOT NULL GROUP BY 1) SELECT p.request_id, j.papers, CASE WHEN j.k IS NULL THEN 'none' ELSE 'exact' END AS match FROM paper_identifiers p LEFT JOIN j ON lower(trim(p.journal)) = j.k""")
def journal_match(spark, sf):
    """Each item's journal in the catalogue of journals, by its normal name."""
    p = table(spark, sf, "paper_identifiers").withColumn("k", F.lower(F.trim("journal")))
    j = p.where("journal IS NOT NULL").groupBy("k").agg(F.count("*").alias("papers"))
    return p.join(j, "k", "left").select("request_id", "papers", F.when(c("papers").isNull(), "none").otherwise("exact").alias("match"))


@book.add("""WITH b AS (SELECT request_id, title, publication_date, language FROM metadata_results WHERE confidence > 0 QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY confidence DESC, result_id) = 1),
 f AS (SELECT request_id, unnest(['title', 'year', 'language']) AS field, unnest([p.title, p.year, p.language]) AS ours, unnest([b.title, b.publication_date, b.language]) AS theirs FROM paper_identifiers p JOIN b USING (request_id))
 SELECT field, CASE WHEN ours IS NULL AND theirs IS NULL THEN 'both_missing' WHEN ours IS NULL THEN 'only_theirs' WHEN theirs IS NULL THEN 'only_ours' WHEN ours = theirs THEN 'same' ELSE 'different' END AS state, count(*) AS n FROM f GROUP BY 1, 2""")
def field_diff_report(spark, sf):
    """How the fields of records and of their best answers compare."""
    m = table(spark, sf, "metadata_results").where("confidence > 0")
    b = m.groupBy("request_id").agg(F.max_by(F.struct(c("title").alias("t"), c("publication_date").alias("d"), c("language").alias("l")), F.struct("confidence", -c("result_id"))).alias("b"))
    pairs = [("title", "title", "b.t"), ("year", "year", "b.d"), ("language", "language", "b.l")]
    each = table(spark, sf, "paper_identifiers").join(b, "request_id").select(F.explode(F.array(*(F.struct(F.lit(n).alias("field"), c(x).alias("ours"), c(y).alias("theirs")) for n, x, y in pairs))).alias("f")).select("f.*")
    state = F.when(c("ours").isNull() & c("theirs").isNull(), "both_missing").when(c("ours").isNull(), "only_theirs").when(c("theirs").isNull(), "only_ours").when(c("ours") == c("theirs"), "same").otherwise("different")
    return each.groupBy("field", state.alias("state")).agg(F.count("*").alias("n"))


@book.add("""SELECT result_id, CASE WHEN coalesce(title, '') <> '' THEN 10 ELSE 0 END + CASE WHEN len(authors) > 0 THEN 10 ELSE 0 END + CASE WHEN coalesce(publication_date, '') <> '' THEN 5 ELSE 0 END + CASE WHEN coalesce(abstract, '') <> '' THEN 15 ELSE 0 END + CASE WHEN len(tags) > 0 THEN 10 ELSE 0 END + CASE WHEN coalesce(language, '') <> '' THEN 2 ELSE 0 END AS score FROM metadata_results""")
def metadata_completeness(spark, sf):
    has = lambda x, n: F.when(F.coalesce(c(x), F.lit("")) != "", n).otherwise(0)
    score = has("title", 10) + F.when(F.size("authors") > 0, 10).otherwise(0) + has("publication_date", 5) + has("abstract", 15) + F.when(F.size("tags") > 0, 10).otherwise(0) + has("language", 2)
    return table(spark, sf, "metadata_results").select("result_id", score.alias("score"))


@book.add(f"""SELECT p.request_id, len(list_filter({_WORDS.format('p.title')}, lambda w: length(w) > 3 AND contains({_NT.format('d.text')}, w))) AS hits FROM paper_identifiers p JOIN documents d ON p.doc_id = d.doc_id WHERE p.title IS NOT NULL AND d.text IS NOT NULL""")
def title_in_text(spark, sf):
    """How many long words of a record's title stand in its document."""
    d = table(spark, sf, "documents").where("text IS NOT NULL").select("doc_id", sc.normal_title(c("text")).alias("body"))
    p = table(spark, sf, "paper_identifiers").where("title IS NOT NULL").select("request_id", "doc_id", sc.words(c("title")).alias("w"))
    hits = F.filter("w", lambda w: (F.length(w) > 3) & F.contains(c("body"), w))
    return p.join(d, "doc_id").select("request_id", F.size(hits).cast("long").alias("hits"))


@book.add(f"""SELECT request_id, array_to_string(list_filter(authors, lambda x: contains(lower(text), lower({_LAST.format('x')}))), '; ') AS confirmed FROM paper_identifiers p JOIN documents d ON p.doc_id = d.doc_id WHERE authors IS NOT NULL AND text IS NOT NULL""")
def authors_in_text(spark, sf):
    """The authors of a record whose surname stands in its document."""
    d = table(spark, sf, "documents").where("text IS NOT NULL").select("doc_id", F.lower("text").alias("body"))
    p = table(spark, sf, "paper_identifiers").where("authors IS NOT NULL").select("request_id", "doc_id", "authors")
    return p.join(d, "doc_id").select("request_id", F.array_join(F.filter("authors", lambda x: F.contains(c("body"), F.lower(sc.last_name(x)))), "; ").alias("confirmed"))


QUERIES, ORACLE = book.queries, book.oracle
