"""Queries that join titles, names and journals that are alike but not equal."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.functions import identifiers as ids
from quire.functions import scoring as sc
from quire.functions.ratio import matching_ratio
from quire.operators.near import alike_titles, titles_of_ratio, within_edits
from quire.plans.book import Book
from quire.plans.enrich import answers
from quire.plans.policy import doi_of
from quire.session import settle
from quire.sources.tables import table

book = Book()
c = F.col

#: Least ratios of the fuzzy title search, of duplicates and of the staged search, with its stop rule; the
#: hits listed per query; least ratios of a suggestion, with the surname equal and without.
FUZZY, DUPLICATE, STAGED, ENOUGH, SURE, LISTED, SAME_SURNAME, ANY_NAME = 0.80, 0.85, 0.80, 3, 0.9, 5, 0.7, 0.8


def _hits(spark, sf, least: float):
    """(request_id, search_id, ratio, ...): requests and library items of alike titles; distinct titles are compared once."""
    p = table(spark, sf, "paper_identifiers").select("request_id", sc.normal_title(c("title")).alias("a"), c("authors").alias("p_authors"), sc.year_of(c("year")).alias("p_year"))
    s = table(spark, sf, "search_results").select("search_id", sc.normal_title(c("title")).alias("b"), c("authors").alias("s_authors"), sc.year_of(c("year")).alias("s_year"))
    alike = settle(titles_of_ratio(p.select("a"), s.select("b"), least))
    return p.join(alike, "a").join(s, "b")


@book.add()
def fuzzy_title_join(spark, sf):
    """The five library items whose titles are most like a request's: ratio of matching blocks of 80 and more, ten more for
    a shared author, five for the same year, a hundred at most."""
    theirs = F.lower(F.array_join("s_authors", " "))
    author = F.exists(F.coalesce("p_authors", F.array().cast("array<string>")), lambda x: (F.trim(x) != "") & F.contains(theirs, F.lower(F.trim(x))))
    score = F.least(F.lit(100.0), c("ratio") * 100 + F.when(author, 10).otherwise(0) + F.when(c("p_year") == c("s_year"), 5).otherwise(0))
    hits = _hits(spark, sf, FUZZY).select("request_id", "search_id", F.round(score, 6).alias("score"))
    k = F.row_number().over(W.partitionBy("request_id").orderBy(F.desc("score"), "search_id"))  # each task keeps five of a request
    return hits.withColumn("k", k).where(c("k") <= LISTED).drop("k")


@book.add()
def duplicate_probe(spark, sf):
    """Whether a request's work is held: by an answer to another request with its DOI, else by the library title most like
    its own, of a ratio of 0.85 and more. ``stage`` says by which; requests that nothing is found for have no row."""
    p = table(spark, sf, "paper_identifiers").select("request_id", F.lower(ids.normalize_doi(c("doi"))).alias("doi"))
    known = answers(spark, sf, ["request_id", "result_id"]).select(c("request_id").alias("other"), "result_id", F.lower(doi_of(c("v"))).alias("doi"))
    known = known.groupBy("doi").agg(F.min_by(F.struct("result_id", "other"), "result_id").alias("x"), F.min("other").alias("low"), F.max("other").alias("high"))
    by_doi = p.join(known.where("low <> high OR low IS NOT NULL"), "doi").where("low <> request_id OR high <> request_id").select("request_id", F.lit("doi").alias("stage"), c("x.result_id").alias("hit"), F.lit(1.0).alias("ratio"))
    by_doi = settle(by_doi)  # read twice below
    titles = _hits(spark, sf, DUPLICATE).groupBy("request_id").agg(F.max_by("search_id", F.struct("ratio", -c("search_id"))).alias("hit"), F.max("ratio").alias("ratio"))
    rest = titles.join(by_doi.select("request_id"), "request_id", "left_anti").select("request_id", F.lit("title").alias("stage"), "hit", F.round("ratio", 6).alias("ratio"))
    return by_doi.unionByName(rest)


@book.add()
def staged_search(spark, sf):
    """Three searches for each request: its title with its first author, with its year, alone. Hits of a ratio over 0.8;
    a search with three hits, or one of over 0.9, is the last. ``stage`` is that search, ``hits`` what all up to it found."""
    last = F.coalesce(F.lower(sc.last_name(F.get("authors", F.lit(0)))), F.lit(""))
    p = table(spark, sf, "paper_identifiers").select("request_id", sc.normal_title(c("title")).alias("a"), last.alias("first"), F.coalesce(sc.year_of(c("year")), F.lit(0)).alias("p_year"))
    s = table(spark, sf, "search_results").select(sc.normal_title(c("title")).alias("b"), F.lower(F.array_join("authors", " ")).alias("theirs"), sc.year_of(c("year")).alias("s_year"))
    # requests that ask the same have one answer, items that say the same are one with their number
    asked, held = p.select("a", "first", "p_year").where("a <> ''").distinct(), s.where("b <> ''").groupBy("b", "theirs", "s_year").agg(F.count("*").alias("n"))
    alike = settle(alike_titles(p.select("a"), s.select("b"), STAGED))
    hits = asked.join(alike.where(c("ratio") > STAGED), "a").join(held, "b").withColumn("s1", F.coalesce((c("first") != "") & F.contains("theirs", "first"), F.lit(False))).withColumn("s2", F.coalesce(c("p_year") == c("s_year"), F.lit(False)))
    n, best = lambda ok: F.sum(F.when(ok, c("n")).otherwise(0)), lambda ok: F.max(F.when(ok, c("ratio")))
    each = [c("s1"), c("s2"), F.lit(True)]
    g = hits.groupBy("a", "first", "p_year").agg(
        *(n(ok).alias(f"n{i}") for i, ok in enumerate(each)), *(best(ok).alias(f"m{i}") for i, ok in enumerate(each)), n(c("s1") | c("s2")).alias("n01"), F.round(F.max("ratio"), 6).alias("best")
    )
    stop = lambda i: (c(f"n{i}") >= ENOUGH) | (F.coalesce(f"m{i}", F.lit(0.0)) > SURE)
    stage = F.when(stop(0), 1).when(stop(1), 2).otherwise(3)
    found = g.select("a", "first", "p_year", stage.alias("stage"), F.when(stage == 1, c("n0")).when(stage == 2, c("n01")).otherwise(c("n2")).alias("hits"), "best")
    return p.join(found, ["a", "first", "p_year"]).select("request_id", "stage", "hits", "best")


_FOLDNAME = "regexp_replace(lower({0}), '[^a-z]', '', 'g')"
_LAST = r"CASE WHEN contains({0}, ',') THEN trim(regexp_extract({0}, '^([^,]*),', 1)) ELSE regexp_extract(trim({0}), '(\S+)$', 1) END"


@book.add(f"""WITH n AS (SELECT DISTINCT name, {_FOLDNAME.format(_LAST.format('name'))} AS l FROM (SELECT unnest(authors) AS name FROM search_results)), a AS (SELECT author_id, {_FOLDNAME.format('last_name')} AS l FROM author_catalogue WHERE first_name IS NOT NULL),
 d AS (SELECT x.l, y.l AS m, levenshtein(x.l, y.l) AS distance FROM (SELECT DISTINCT l FROM n) x, (SELECT DISTINCT l FROM a) y WHERE x.l <> '' AND y.l <> '' AND x.l <> y.l AND abs(length(x.l) - length(y.l)) <= 2)
 SELECT name, author_id, CAST(distance AS INT) AS distance FROM n JOIN d USING (l) JOIN a ON a.l = d.m WHERE distance <= 2""")
def surname_suggestions(spark, sf):
    """Catalogue surnames within two edits of an author's, wherever the edits are; the SQL compares all with all."""
    fold = lambda x: F.regexp_replace(F.lower(x), "[^a-z]", "")
    n = table(spark, sf, "search_results").select(F.explode("authors").alias("name")).distinct().withColumn("a", fold(sc.last_name(c("name"))))
    a = table(spark, sf, "author_catalogue").where("first_name IS NOT NULL").select("author_id", fold(c("last_name")).alias("b"))
    near = within_edits(n.select("a"), a.select("b"), 2).where("distance > 0")
    return n.join(near, "a").join(a, "b").select("name", "author_id", "distance")


@book.add()
def author_suggestions(spark, sf):
    """The catalogue name that an author's may be a misspelling of: within two edits, of a ratio over 0.7 with the same
    surname, else over 0.8; the best ratio wins, then the smaller id."""
    n = table(spark, sf, "search_results").select(F.explode("authors").alias("name")).where("name IS NOT NULL").distinct().withColumn("a", F.lower("name"))
    a = table(spark, sf, "author_catalogue").select("author_id", F.lower("name").alias("b"), F.lower("last_name").alias("last"), "paper_count")
    near = within_edits(n.select("a"), a.select("b"), 2).withColumn("ratio", F.round(matching_ratio("a", "b"), 6))
    met = n.join(near, "a").join(a, "b").withColumn("own", F.lower(sc.last_name(c("name"))) == c("last"))
    met = met.where((c("ratio") > ANY_NAME) | c("own") & (c("ratio") > SAME_SURNAME))
    best = met.groupBy("name").agg(F.max_by(F.struct("author_id", "distance", "ratio", "paper_count"), F.struct("own", "ratio", -c("author_id"))).alias("b"))
    return best.select("name", "b.*")


@book.add("""WITH w AS (SELECT DISTINCT name, unnest(list_filter(string_split_regex(replace(lower(name), ',', ' '), '\\s+'), lambda x: length(x) >= 2)) AS word FROM (SELECT unnest(authors) AS name FROM search_results)),
 k AS (SELECT DISTINCT w.word, a.author_id FROM (SELECT DISTINCT word FROM w) w JOIN author_catalogue a ON contains(lower(a.name), w.word)) SELECT name, count(DISTINCT author_id) AS partial FROM w JOIN k USING (word) GROUP BY 1""")
def any_word_matches(spark, sf):
    """How many catalogue names hold any word of an author's name, also inside a word: weak evidence. The catalogue's
    substrings, of a number bounded by the lengths of its names, are the keys of an equi-join."""
    n = table(spark, sf, "search_results").select(F.explode("authors").alias("name")).distinct()
    words = n.select("name", F.explode(F.filter(F.split(F.regexp_replace(F.lower("name"), ",", " "), r"\s+"), lambda x: F.length(x) >= 2)).alias("word")).distinct()
    subs = F.expr("explode(array_distinct(flatten(transform(sequence(1, length(low)), i -> transform(sequence(1, length(low) - i + 1), m -> substring(low, i, m))))))")
    held = table(spark, sf, "author_catalogue").select("author_id", F.lower("name").alias("low")).where("low <> ''").select("author_id", subs.alias("word")).where("length(word) >= 2")
    return words.join(held, "word").groupBy("name").agg(F.countDistinct("author_id").alias("partial"))


_J = "SELECT lower(trim(journal)) AS j, count(*) AS n FROM paper_identifiers WHERE trim(journal) <> '' GROUP BY 1"


@book.add(f"WITH j AS ({_J}) SELECT a.j AS journal, b.j AS like_journal, CAST(levenshtein(a.j, b.j) AS INT) AS distance FROM j a JOIN j b ON a.j < b.j WHERE levenshtein(a.j, b.j) <= 2")
def journal_neighbours(spark, sf):
    """Journals whose names are within two edits, wherever the edits are; the SQL compares all with all."""
    j = table(spark, sf, "paper_identifiers").where("trim(journal) <> ''").select(F.lower(F.trim("journal")).alias("j")).distinct()
    return within_edits(j, j, 2).where("a < b").select(c("a").alias("journal"), c("b").alias("like_journal"), "distance")


@book.add()
def journal_validation(spark, sf):
    """Each item's journal in the catalogue of journals that two items and more name: exact, else fuzzy (within two edits
    and of a ratio over 0.8, the best), else none."""
    p = table(spark, sf, "paper_identifiers").select("request_id", F.lower(F.trim("journal")).alias("a"))
    j = p.where("a <> ''").groupBy(c("a").alias("b")).agg(F.count("*").alias("papers"))
    known = j.where("papers > 1")
    odd = j.where("papers = 1").select(c("b").alias("a"))
    near = within_edits(odd, known.select("b"), 2).withColumn("ratio", matching_ratio("a", "b")).where(c("ratio") > ANY_NAME)
    fuzzy = near.groupBy("a").agg(F.max_by("b", F.struct("ratio", "b")).alias("fuzzy"))
    out = p.join(known.select(c("b").alias("a"), c("b").alias("exact")), "a", "left").join(fuzzy, "a", "left")
    return out.select("request_id", F.coalesce("exact", "fuzzy").alias("journal"), F.when(c("exact").isNotNull(), "exact").when(c("fuzzy").isNotNull(), "fuzzy").otherwise("none").alias("match"))


QUERIES, ORACLE = book.queries, book.oracle
