"""Queries that decide on candidates, plan what they fill, and apply and shrink the plans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions import identifiers as ids
from quire.functions import policy
from quire.functions import scoring as sc
from quire.functions.ratio import matching_ratio
from quire.plans.book import Book
from quire.plans.enrich import SHAPES, answers
from quire.sources.tables import table

book = Book()
c = F.col

KINDS = ("doi", "isbn", "issn")


def evaluated(pairs: DataFrame, accept: float = sc.ACCEPT, review: float = sc.REVIEW) -> DataFrame:
    """``pairs`` with the component scores, the composite, status and reason.

    A record's fields are p_title, p_authors, p_year, p_type, p_language, p_doi, p_isbn and p_issn, the candidate's the
    same without p_, and ``sure``, how sure its language is. Missing titles and authors score 0; a missing language of
    the candidate has no weight."""
    empty = F.array().cast("array<string>")
    norm = lambda x: F.array_distinct(F.filter(F.transform(F.coalesce(x, empty), sc.normal_author), lambda a: a != ""))
    a, b = (F.coalesce(sc.clean_title(c(x)), F.lit("")) for x in ("p_title", "title"))
    same, other = policy.identifier_states([c(f"p_{k}") for k in KINDS], [c(k) for k in KINDS])
    out = pairs.withColumns({
        "title_score": F.round(F.when((a != "") & (b != ""), matching_ratio(a, b)).otherwise(0.0), 6),
        "author_score": F.round(sc.overlap(norm(c("p_authors")), norm(c("authors"))), 6),
        "year_score": sc.year_score(sc.year_of(c("p_year")), sc.year_of(c("year"))),
        "type_score": sc.type_score(c("p_type"), c("type")),
        "language_score": sc.language_score(c("p_language"), c("language"), F.coalesce("sure", F.lit(1.0))),
        "match": same, "conflict": other,
    })
    out = out.withColumn("score", F.round(sc.composite(*(c(f"{x}_score") for x in ("title", "author", "year", "type", "language"))), 6))
    return out.withColumn("status", sc.decision(c("match"), c("conflict"), c("score"), accept, review)).withColumn("reason", policy.reason(c("match"), c("conflict"), c("score"), accept, review))


_RECORD = "p_doi string, p_isbn string, p_issn string, p_title string, p_authors array<string>, p_year string, p_type string, p_language string"
_PAIR = f"name string, {_RECORD}, {_RECORD.replace('p_', '')}, sure double"


def _pair(name, doi, title, authors, year, other_doi, other_title, other_authors, other_year, language=None, sure=None, kinds=(None, None)):
    return (name, doi, None, None, title, authors, year, kinds[0], None, other_doi, None, None, other_title, other_authors, other_year, kinds[1], language, sure)


@book.add("""SELECT * FROM (VALUES ('same doi', 'auto_accept', 'identifier_match'), ('other doi', 'manual_review', 'identifier_conflict'), ('nothing alike', 'reject', 'weak_match'), ('unsure language', 'auto_accept', 'strong_composite'),
 ('types spelled apart', 'auto_accept', 'strong_composite'), ('all missing', 'reject', 'weak_match')) t(name, status, reason)""")
def policy_cases(spark, sf):
    """The published cases of the match policy, with their thresholds, and two of our own."""
    default = [
        _pair("same doi", "10.1234/abc", "Sample Paper", ["Doe, John"], "2020", "10.1234/abc", "Sample Paper", ["John Doe"], "2020"),
        _pair("unsure language", None, "Gamma", ["Doe"], "2020", None, "Gamma", ["Doe"], "2020", "en", 0.5),
        _pair("types spelled apart", None, "Delta Paper", ["Doe"], "2019", None, "Delta Papers", ["Doe"], "2020", kinds=("journalArticle", "journal-article")),
        _pair("all missing", None, None, None, None, None, None, None, None),
    ]
    frames = [
        evaluated(spark.createDataFrame(default, _PAIR)),
        evaluated(spark.createDataFrame([_pair("other doi", "10.1234/old", "Sample", None, "2020", "10.1234/new", "Sample", None, "2020")], _PAIR), accept=0.5),
        evaluated(spark.createDataFrame([_pair("nothing alike", None, "Alpha", ["Doe"], "2010", None, "Beta", ["Smith"], "2000")], _PAIR), accept=0.8, review=0.6),
    ]
    return frames[0].unionAll(frames[1]).unionAll(frames[2]).select("name", "status", "reason")


@book.add("""SELECT * FROM (VALUES ('gaps', 'doi,language,pages', '', 'doi,language,pages', 'doi=10.1234/abc;language=en;pages=10-20'), ('conflict', '', 'doi', 'doi', 'doi=10.555/xyz'),
 ('overwrite', 'pages', 'doi,tags', 'doi,pages,tags', 'doi=10.555/xyz;pages=1-2;tags=z,a,b'), ('unsure', '', 'language', '', '')) t(name, updates, manual_fields, applied, record)""")
def planner_cases(spark, sf):
    """The published cases of planning, applying and overwriting, tags added to and never replaced, and an unsure language."""
    rows = [
        ("gaps", {}, {"doi": "10.1234/abc", "pages": "10-20", "language": "en"}, 0.95, []),
        ("conflict", {"doi": "10.1111/existing"}, {"doi": "10.555/xyz"}, None, ["doi"]),
        ("overwrite", {"doi": "10.1111/existing", "tags": "z"}, {"doi": "10.555/xyz", "tags": "a,b", "pages": "1-2"}, None, ["doi", "tags"]),
        ("unsure", {}, {"language": "en"}, 0.5, []),
    ]
    df = spark.createDataFrame(rows, "name string, ours map<string,string>, theirs map<string,string>, sure double, overwrite array<string>")
    side = lambda s: {f: F.try_element_at(s, F.lit(f)) for f in policy.FIELD_RULES}
    updates, manual = policy.plan(side("ours"), side("theirs"), c("sure"))
    df = df.withColumn("u", updates).withColumn("manual", manual)
    record, applied = policy.apply(c("ours"), c("u"), c("overwrite"), c("theirs"))
    join = lambda x, s=",": F.array_join(F.array_sort(x), s)
    entries = F.transform(F.map_entries(record), lambda e: F.concat(e.key, F.lit("="), e.value))
    return df.select("name", join(F.map_keys("u")).alias("updates"), join(c("manual")).alias("manual_fields"), join(applied).alias("applied"), join(entries, ";").alias("record"))


def requests_with_answers(spark, sf) -> DataFrame:
    """Requests with the fields of each of their answers; DOIs from the answers' payloads of any shape. Payloads are
    reduced to their DOI before the join."""
    p = table(spark, sf, "paper_identifiers").select(
        "request_id", c("title").alias("p_title"), c("authors").alias("p_authors"), c("year").alias("p_year"), F.when(c("journal").isNotNull(), "journalArticle").alias("p_type"), c("language").alias("p_language"),
        ids.normalize_doi(c("doi")).alias("p_doi"), F.lit(None).cast("string").alias("p_isbn"), F.lit(None).cast("string").alias("p_issn"), c("journal").alias("p_journal"), F.try_element_at("extras", F.lit("pages")).alias("p_pages"),
    )
    kept = ["result_id", "request_id", "title", "authors", "publication_date", "abstract", "language", "tags", "confidence"]
    m = answers(spark, sf, kept).select(
        "request_id", "result_id", "title", "authors", c("publication_date").alias("year"), F.lit(None).cast("string").alias("type"), "language", doi_of(c("v")).alias("doi"), F.lit(None).cast("string").alias("isbn"),
        F.lit(None).cast("string").alias("issn"), "abstract", "tags", "confidence", F.coalesce(F.when(c("confidence") > 1, c("confidence") / 100).otherwise(c("confidence")), F.lit(1.0)).alias("sure"),
    )
    return p.join(m, "request_id")


def doi_of(v):
    """The first DOI among an answer's identifiers, in whichever of the configured places."""
    each = [F.try_variant_get(v, p["identifiers"], "array<struct<type string, value string>>") for p in SHAPES.values()]
    dois = F.filter(F.coalesce(*each), lambda x: F.lower(x["type"]) == "doi")
    return ids.normalize_doi(F.get(dois, F.lit(0))["value"])


@book.add()
def match_policy(spark, sf):
    """Every answer judged for its request: component scores, composite, status and reason."""
    return evaluated(requests_with_answers(spark, sf)).select("request_id", "result_id", "title_score", "author_score", "year_score", "type_score", "language_score", "match", "conflict", "score", "status", "reason")


@book.add()
def composite_score(spark, sf):
    """Composite of every request and answer: matching-blocks ratio of the titles, shared authors, year, type, language."""
    return evaluated(requests_with_answers(spark, sf)).select("request_id", "result_id", "title_score", "author_score", "score")


@book.add()
def best_match_decision(spark, sf):
    """The best answer of each request, an equal identifier before any score, and what to do with it."""
    df = evaluated(requests_with_answers(spark, sf)).select("request_id", "result_id", "match", "score", "status")
    best = df.groupBy("request_id").agg(F.max_by(F.struct("result_id", "score", "status"), F.struct("match", "score", -c("result_id"))).alias("b"))
    return best.select("request_id", "b.*")


_NORM = r"CASE WHEN trim(coalesce({0}, '')) <> '' THEN trim(regexp_replace(trim(regexp_replace(trim(regexp_replace(trim(regexp_replace(trim({0}), '(?i)^doi:', '')), '(?i)^https://doi\.org/', '')), '(?i)^http://dx\.doi\.org/', '')), '(?i)^http://doi\.org/', '')) END"
_OPEN = "SELECT *, CASE WHEN json_type(j) = 'VARCHAR' THEN CASE WHEN json_valid(j ->> '$') THEN CAST(j ->> '$' AS JSON) END ELSE j END AS o FROM (SELECT *, CASE WHEN json_valid(raw_data) THEN CAST(raw_data AS JSON) END AS j FROM metadata_results)"
_LISTS = "coalesce(" + ", ".join(f"CASE WHEN json_type(o, '{p['identifiers'].replace("['alternative-id']", '."alternative-id"')}') = 'ARRAY' THEN CAST(json_extract(o, '{p['identifiers'].replace("['alternative-id']", '."alternative-id"')}') AS JSON[]) END" for p in SHAPES.values()) + ", [])"
_DOI = f"list_filter({_LISTS}, lambda x: lower(x ->> '$.type') = 'doi')[1] ->> '$.value'"


@book.add(f"""SELECT request_id, result_id, coalesce(a <> '' AND b <> '' AND a = b, false) AS match, coalesce(a <> '' AND b <> '' AND a <> b, false) AS conflict FROM (SELECT p.request_id, m.result_id, lower(trim(coalesce({_NORM.format('p.doi')}, ''))) AS a, lower(trim(coalesce({_NORM.format('m.d')}, ''))) AS b
 FROM paper_identifiers p JOIN (SELECT request_id, result_id, {_DOI} AS d FROM ({_OPEN})) m USING (request_id))""")
def identifier_states(spark, sf):
    """Whether request and answer have the same DOI, or two."""
    same, other = policy.identifier_states([c(f"p_{k}") for k in KINDS], [c(k) for k in KINDS])
    return requests_with_answers(spark, sf).select("request_id", "result_id", same.alias("match"), other.alias("conflict"))


def _best(df: DataFrame) -> DataFrame:
    """The answer of known confidence with the most of it, per request."""
    return df.where("confidence > 0").groupBy("request_id").agg(F.max_by(F.struct(*df.columns), F.struct("confidence", -c("result_id"))).alias("b")).select("b.*")


def _sides(df: DataFrame) -> tuple[dict, dict]:
    ours = {"title": c("p_title"), "authors": F.array_join("p_authors", "; "), "year": c("p_year"), "document_type": c("p_type"), "doi": c("p_doi"), "journal": c("p_journal"), "pages": c("p_pages"), "language": c("p_language")}
    theirs = {"title": c("title"), "authors": F.array_join("authors", "; "), "year": c("year"), "doi": c("doi"), "abstract": c("abstract"), "language": c("language"), "tags": F.array_join("tags", ",")}
    return ours, theirs


_BEST = f"""b AS (SELECT request_id, title, array_to_string(authors, '; ') AS authors, publication_date AS year, {_NORM.format('(' + _DOI + ')')} AS doi, abstract, language, array_to_string(tags, ',') AS tags, coalesce(CASE WHEN confidence > 1 THEN confidence / 100 ELSE confidence END, 1.0) AS sure
 FROM ({_OPEN}) WHERE confidence > 0 QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY confidence DESC, result_id) = 1),
 a AS (SELECT request_id, title, array_to_string(authors, '; ') AS authors, year, {_NORM.format('doi')} AS doi, language FROM paper_identifiers)"""
_DIFF = "CASE WHEN coalesce(b.{0}, '') <> '' AND b.{0} IS DISTINCT FROM {1} THEN '{0}' END"
_GAP = "coalesce(a.{0}, '') = '' AND coalesce(b.{0}, '') <> ''"


@book.add(f"""WITH {_BEST} SELECT request_id, concat_ws(',', CASE WHEN coalesce(b.abstract, '') <> '' THEN 'abstract' END, CASE WHEN {_GAP.format('doi')} THEN 'doi' END, CASE WHEN {_GAP.format('language')} AND sure >= 0.9 THEN 'language' END) AS updates,
 concat_ws(',', {_DIFF.format('authors', 'a.authors')}, CASE WHEN coalesce(a.doi, '') <> '' AND coalesce(b.doi, '') <> '' AND a.doi <> b.doi THEN 'doi' END, CASE WHEN {_GAP.format('language')} AND sure < 0.9 THEN 'language' END, {_DIFF.format('tags', 'NULL')}, {_DIFF.format('title', 'a.title')}, {_DIFF.format('year', 'a.year')}) AS manual_fields FROM a JOIN b USING (request_id)""")
def enrichment_plan(spark, sf):
    """Of the 17 planned fields, those that a request's best answer fills and those that need a look."""
    df = _best(requests_with_answers(spark, sf))
    updates, manual = policy.plan(*_sides(df), c("sure"))
    return df.select("request_id", F.array_join(F.array_sort(F.map_keys(updates)), ",").alias("updates"), F.array_join(F.array_sort(manual), ",").alias("manual_fields"))


@book.add(f"""WITH {_BEST} SELECT request_id, concat_ws(',', CASE WHEN coalesce(b.abstract, '') <> '' THEN 'abstract' END, CASE WHEN {_GAP.format('language')} AND sure >= 0.9 THEN 'language' END) AS left_updates,
 concat_ws(',', {_DIFF.format('authors', 'a.authors')}, CASE WHEN {_GAP.format('language')} AND sure < 0.9 THEN 'language' END, {_DIFF.format('tags', 'NULL')}, {_DIFF.format('title', 'a.title')}, {_DIFF.format('year', 'a.year')}) AS left_manual FROM a JOIN b USING (request_id)""")
def plan_shrink(spark, sf):
    """What is left of each plan once its DOI is settled."""
    df = _best(requests_with_answers(spark, sf))
    updates, manual = policy.shrink(*policy.plan(*_sides(df), c("sure")), F.array(F.lit("doi")))
    return df.select("request_id", F.array_join(F.array_sort(F.map_keys(updates)), ",").alias("left_updates"), F.array_join(F.array_sort(manual), ",").alias("left_manual"))


QUERIES, ORACLE = book.queries, book.oracle
