"""Queries that read nested answers by configured paths, and fill, edit and route records."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.plans.book import Book
from quire.sources.tables import table

book = Book()
c = F.col

_OPENED = "SELECT result_id, CASE WHEN json_type(j) = 'VARCHAR' THEN CASE WHEN json_valid(j ->> '$') THEN CAST(j ->> '$' AS JSON) END ELSE j END AS j FROM (SELECT result_id, CASE WHEN json_valid(raw_data) THEN CAST(raw_data AS JSON) END AS j FROM metadata_results)"
_VALID = f"SELECT result_id, j FROM ({_OPENED}) WHERE json_type(j) = 'OBJECT'"

#: Where each shape of answer keeps its title, year, language and identifiers: a configuration, compiled to Columns.
SHAPES = {
    "message": {"title": "$.message.title[0]", "year": "$.message.published['date-parts'][0][0]", "language": "$.message.language", "identifiers": "$.message['alternative-id']"},
    "work": {"title": "$.display_name", "year": "$.publication_year", "language": "$.language", "identifiers": "$.ids"},
    "items": {"title": "$._embedded.items[0].metadata.title", "year": "$._embedded.items[0].metadata.originInfo.issued", "language": "$._embedded.items[0].metadata.languages[0].code", "identifiers": "$._embedded.items[0].metadata.identifiers"},
    "instance": {"title": "$.hasTitle[0].mainTitle", "year": "$.publication[0].year", "language": "$.instanceOf.language[0].code", "identifiers": "$.identifiedBy"},
}


def opened(raw):
    """A payload as a variant; a JSON string that itself holds JSON is opened once."""
    v = F.try_parse_json(raw)
    return F.when(F.schema_of_variant(v) == "STRING", F.try_parse_json(F.try_variant_get(v, "$", "string"))).otherwise(v)


def answers(spark, sf, kept=("result_id",)):
    """Answers with ``v``, their payload; null where it can't be read."""
    return table(spark, sf, "metadata_results").select(*kept, opened(c("raw_data")).alias("v"))


def _answers(spark, sf):
    return answers(spark, sf).where("v IS NOT NULL AND schema_of_variant(v) LIKE 'OBJECT%'")


def projected(v, field: str, kind: str = "string"):
    """The first of the configured paths of a field that an answer has."""
    return F.coalesce(*(F.try_variant_get(v, p[field], kind) for p in SHAPES.values()))


_P = lambda f: ", ".join("json_extract_string(j, '" + p[f].replace("['date-parts']", '."date-parts"') + "')" for p in SHAPES.values())


@book.add("SELECT result_id, coalesce(" + _P("title") + ") AS title, coalesce(" + _P("language") + f") AS language FROM ({_VALID})")
def configured_projection(spark, sf):
    """Title and language of answers of any shape, by configured paths."""
    return _answers(spark, sf).select("result_id", projected("v", "title").alias("title"), projected("v", "language").alias("language"))


#: Where each shape keeps its authors, and where these keep their names.
AUTHORS = {"$.message.author": ["$.name"], "$.authorships": ["$.author.display_name"], "$._embedded.items[0].metadata.creators": ["$.name"], "$.instanceOf.contribution": ["$.agent.label", "$.agent"]}
_LIST = "CASE WHEN coalesce(json_type(j, '{0}'), 'NULL') = 'NULL' THEN NULL WHEN json_type(j, '{0}') = 'ARRAY' THEN CAST(json_extract(j, '{0}') AS JSON[]) ELSE [json_extract(j, '{0}')] END"
_TEXT = "CASE WHEN json_type(x, '{0}') = 'VARCHAR' THEN x ->> '{0}' END"
_NAMED = "list_filter(list_transform(" + _LIST + ", lambda x: CASE WHEN json_type(x) = 'VARCHAR' THEN x ->> '$' ELSE coalesce({1}, nullif(trim(concat_ws(' ', x ->> '$.given', x ->> '$.family')), '')) END), lambda n: trim(n) <> '')"


@book.add("SELECT result_id, array_to_string(authors, '; ') AS authors FROM (SELECT result_id, coalesce(" + ", ".join(_NAMED.format(k, ", ".join(_TEXT.format(n) for n in ns)) for k, ns in AUTHORS.items()) + f") AS authors FROM ({_VALID})) WHERE authors IS NOT NULL")
def coerced_authors(spark, sf):
    """Names of all authors of answers of every shape, from objects of any of the shapes and from plain strings; a lone
    author counts as a list of one."""
    text = lambda x, p: F.when(F.schema_of_variant(F.try_variant_get(x, p, "variant")) == "STRING", F.try_variant_get(x, p, "string"))
    whole = lambda x: F.nullif(F.trim(F.concat_ws(" ", text(x, "$.given"), text(x, "$.family"))), F.lit(""))

    def names(path, places):
        one = F.try_variant_get("v", path, "variant")
        each = F.when(F.schema_of_variant(one).startswith("ARRAY"), F.try_variant_get("v", path, "array<variant>")).when(F.schema_of_variant(one) != "VOID", F.array(one))
        return F.filter(F.transform(each, lambda x: F.coalesce(text(x, "$"), *(text(x, p) for p in places), whole(x))), lambda n: F.trim(n) != "")

    return _answers(spark, sf).select("result_id", F.coalesce(*(names(k, ns) for k, ns in AUTHORS.items())).alias("a")).where("a IS NOT NULL").select("result_id", F.array_join("a", "; ").alias("authors"))


@book.add(f"""SELECT result_id, kind, count(*) AS n FROM (SELECT result_id, json_extract_string(x, '$.type') AS kind FROM (SELECT result_id, unnest(CAST(json_extract(j, '$.ids[*]') AS JSON[])) AS x FROM ({_VALID}) WHERE json_type(j, '$.ids') = 'ARRAY')) WHERE kind IS NOT NULL GROUP BY 1, 2""")
def identifiers_by_type(spark, sf):
    """Identifiers of each type of an answer: a list of objects taken apart and filtered by a field."""
    a = F.try_variant_get("v", "$.ids", "array<struct<type string, value string>>")
    each = _answers(spark, sf).select("result_id", F.explode(a).alias("x")).select("result_id", c("x.type").alias("kind")).where("kind IS NOT NULL")
    return each.groupBy("result_id", "kind").agg(F.count("*").alias("n"))


@book.add("""WITH b AS (SELECT request_id, title, publication_date, language FROM metadata_results WHERE confidence > 0 QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY confidence DESC, result_id) = 1)
 SELECT request_id, coalesce(nullif(trim(p.title), ''), b.title) AS title, coalesce(nullif(trim(p.year), ''), b.publication_date) AS year, CASE WHEN coalesce(b.language, '') <> '' AND b.language IS DISTINCT FROM p.language THEN b.language ELSE p.language END AS language FROM paper_identifiers p LEFT JOIN b USING (request_id)""")
def fill_and_overwrite(spark, sf):
    """Empty fields filled from the best answer; the language taken from it where it is there and differs."""
    m = table(spark, sf, "metadata_results").where("confidence > 0")
    b = m.groupBy("request_id").agg(F.max_by(F.struct(c("title").alias("t"), c("publication_date").alias("d"), c("language").alias("l")), F.struct("confidence", -c("result_id"))).alias("b"))
    p = table(spark, sf, "paper_identifiers").join(b, "request_id", "left")
    fill = lambda own, other: F.coalesce(F.nullif(F.trim(c(own)), F.lit("")), c(other))
    new = (F.coalesce("b.l", F.lit("")) != "") & ~c("b.l").eqNullSafe(c("language"))
    return p.select("request_id", fill("title", "b.t").alias("title"), fill("year", "b.d").alias("year"), F.when(new, c("b.l")).otherwise(c("language")).alias("language"))


@book.add("SELECT request_id, array_to_string(list_sort(list_transform(map_entries(m), lambda e: e.key || '=' || e.value)), '; ') AS record FROM (SELECT request_id, map_concat(coalesce(extras, MAP {}), MAP {'journal': coalesce(journal, '')}) AS m FROM paper_identifiers)")
def apply_updates(spark, sf):
    """A map of updates laid over a record's own map."""
    own = F.coalesce("extras", F.create_map().cast("map<string,string>"))
    keep = F.map_filter(own, lambda k, v: k != "journal")
    entries = F.transform(F.map_entries(F.map_concat(keep, F.create_map(F.lit("journal"), F.coalesce("journal", F.lit(""))))), lambda e: F.concat(e.key, F.lit("="), e.value))
    return table(spark, sf, "paper_identifiers").select("request_id", F.array_join(F.array_sort(entries), "; ").alias("record"))


@book.add("""SELECT result_id, array_to_string(list_sort(list_distinct(list_concat(list_filter(coalesce(tags, []), lambda t: lower(t) <> 'ocr'), CASE WHEN list_contains(list_transform(coalesce(tags, []), lambda t: lower(t)), 'checked') THEN CAST([] AS VARCHAR[]) ELSE ['checked'] END))), ',') AS tags FROM metadata_results""")
def tag_edit(spark, sf):
    """Tags with one taken out and one put in, without regard to case."""
    t = F.coalesce("tags", F.array().cast("array<string>"))
    add = F.when(F.array_contains(F.transform(t, F.lower), "checked"), F.array().cast("array<string>")).otherwise(F.array(F.lit("checked")))
    return table(spark, sf, "metadata_results").select("result_id", F.array_join(F.array_sort(F.array_union(F.filter(t, lambda x: F.lower(x) != "ocr"), add)), ",").alias("tags"))


_KINDS = {"journalArticle": ["journal", "revue", "tidsskrift", "zeitschrift", "annals", "acta"], "bookSection": ["cuadernos", "review"]}


@book.add("SELECT kind, count(*) AS n FROM (SELECT CASE " + " ".join(f"WHEN {' OR '.join(f"contains(lower(journal), '{w}')" for w in ws)} THEN '{k}'" for k, ws in _KINDS.items()) + " ELSE 'other' END AS kind FROM paper_identifiers WHERE journal IS NOT NULL) GROUP BY 1")
def type_heuristics(spark, sf):
    """Kinds of items by words in the name of what they appeared in."""
    low = F.lower("journal")
    kind = F.lit("other")
    for k, ws in reversed(_KINDS.items()):
        kind = F.when(F.exists(F.array(*map(F.lit, ws)), lambda w: F.contains(low, w)), k).otherwise(kind)
    return table(spark, sf, "paper_identifiers").where("journal IS NOT NULL").groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


@book.add("WITH r AS (SELECT unnest(['no', 'sv', 'fi', 'en']) AS lang, unnest(['norwegian', 'swedish', 'finnish', 'openalex']) AS source, unnest([1, 2, 3, 9]) AS priority) SELECT p.request_id, coalesce(r.source, 'openalex') AS library FROM paper_identifiers p LEFT JOIN r ON lower(substr(p.language, 1, 2)) = r.lang")
def library_routing(spark, sf):
    """The library that answers for a record's language, a default for the rest: a literal table, joined."""
    r = spark.createDataFrame([("no", "norwegian"), ("sv", "swedish"), ("fi", "finnish"), ("en", "openalex")], "lang string, source string")
    p = table(spark, sf, "paper_identifiers").select("request_id", F.lower(F.substring("language", 1, 2)).alias("lang"))
    return p.join(r, "lang", "left").select("request_id", F.coalesce("source", F.lit("openalex")).alias("library"))


@book.add("SELECT m AS method, count(*) AS n, CAST(count(*) FILTER (WHERE doi IS NOT NULL) AS BIGINT) AS with_doi FROM (SELECT coalesce(extras['method'], 'none') AS m, doi FROM paper_identifiers) GROUP BY 1")
def method_counts(spark, sf):
    """Records and those with a DOI by the method in their map of extras."""
    m = F.coalesce(F.try_element_at("extras", F.lit("method")), F.lit("none"))
    return table(spark, sf, "paper_identifiers").groupBy(m.alias("method")).agg(F.count("*").alias("n"), F.count_if(c("doi").isNotNull()).alias("with_doi"))


@book.add("SELECT original_filename, count(*) AS late_rows FROM scan_log WHERE epoch_us(logged_at) - epoch_us(scanned_ts) > 24 * 3600000000 AND original_filename IS NOT NULL GROUP BY 1")
def late_rows(spark, sf):
    """Rows of each file that came more than a day late."""
    late = F.unix_micros("logged_at") - F.unix_micros("scanned_ts") > 24 * 3_600_000_000
    return table(spark, sf, "scan_log").where(late & c("original_filename").isNotNull()).groupBy("original_filename").agg(F.count("*").alias("late_rows"))


@book.add("SELECT zotero_item_code, min(final_filename) AS first_path, count(DISTINCT final_filename) AS paths FROM scan_log l WHERE zotero_item_code IS NOT NULL AND NOT EXISTS (SELECT 1 FROM search_results s WHERE s.item_key = l.zotero_item_code) GROUP BY 1")
def missing_file_report(spark, sf):
    """Stored attachments that no library item has as its key, each once."""
    log = table(spark, sf, "scan_log").where("zotero_item_code IS NOT NULL")
    known = table(spark, sf, "search_results").select(c("item_key").alias("zotero_item_code"))
    return log.join(known, "zotero_item_code", "left_anti").groupBy("zotero_item_code").agg(F.min("final_filename").alias("first_path"), F.countDistinct("final_filename").alias("paths"))


@book.add("SELECT lang, CAST(percentile AS BIGINT) AS percentile, value FROM (SELECT lang, unnest([10, 50, 90]) AS percentile, unnest([quantile_disc(n_chars, 0.1), quantile_disc(n_chars, 0.5), quantile_disc(n_chars, 0.9)]) AS value FROM documents WHERE text IS NOT NULL GROUP BY lang)")
def length_percentiles(spark, sf):
    """Exact percentiles of text lengths by label: the lengths are counted first, so a large label moves its distinct lengths only."""
    n = table(spark, sf, "documents").where("text IS NOT NULL").groupBy("lang", "n_chars").agg(F.count("*").alias("k"))
    ps = [10, 50, 90]
    w = W.partitionBy("lang").orderBy("n_chars")
    run = n.withColumn("cum", F.sum("k").over(w)).withColumn("total", F.sum("k").over(W.partitionBy("lang")))
    want = F.explode(F.array(*(F.struct(F.lit(p).cast("long").alias("percentile")) for p in ps))).alias("p")
    hit = run.select("lang", "n_chars", "cum", "total", want).where(c("cum") * 100 >= c("total") * c("p.percentile"))
    return hit.groupBy("lang", c("p.percentile").alias("percentile")).agg(F.min("n_chars").alias("value"))


QUERIES, ORACLE = book.queries, book.oracle
