"""Queries over the documents' texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import language, leakage, packing, survivor, truncation
from quire.session import settle
from quire.sources.tables import table


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(record_kind, record_id, doc_id, label, lang, confidence, passages) of documents and long abstracts."""
    documents, metadata = table(spark, sf_dir, "documents"), table(spark, sf_dir, "metadata_results")
    model = language.fit(documents, "doc_id", "text", "lang")
    texts = documents.select(F.lit("document").alias("record_kind"), F.col("doc_id").alias("record_id"), language.canonical(F.col("lang")).alias("label"), "text")
    abstracts = metadata.where(F.char_length("abstract") >= 100).select(F.lit("metadata"), "result_id", language.canonical(F.col("language")), "abstract")
    return language.languages(texts.unionAll(abstracts), ["record_kind", "record_id", "label"], "text", model)


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts whose label is missing, empty or wrong, and documents of two languages."""
    second = language.second_language(F.col("passages"), F.col("lang"))
    judged = settle(_judged(spark, sf_dir).select("record_kind", "record_id", "label", "lang", second.alias("second")))
    wrong = F.col("label").isNull() | (F.col("label") != F.col("lang"))
    mixed = (F.col("record_kind") == "document") & F.col("second").isNotNull()
    own = judged.where(wrong | mixed).select("record_kind", "record_id", F.explode(F.when(mixed, F.array("lang", "second")).otherwise(F.array("lang"))).alias("lang"))
    documents = judged.where("record_kind = 'document'").select(F.col("record_id").alias("doc_id"), "lang")
    requests = table(spark, sf_dir, "paper_identifiers").select("request_id", "doc_id", language.canonical(F.col("language")).alias("label"))
    scans = requests.join(documents, "doc_id").where(wrong).select(F.lit("identifiers"), "request_id", "lang")
    return own.unionAll(scans).distinct()


def p7_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language and confidence of every text."""
    return _judged(spark, sf_dir).select("record_kind", "record_id", "lang", "confidence")


def p7_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language and confidence of every passage of the documents."""
    found = _judged(spark, sf_dir).where("record_kind = 'document'")
    return found.select(F.col("record_id").alias("doc_id"), F.posexplode("passages").alias("passage_no", "p")).select("doc_id", "passage_no", "p.*")


def p8_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text in containers of each capacity."""
    return packing.pack(*_sizes(spark, sf_dir))


def p8_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers used for each capacity, against the least possible."""
    sizes, key, capacities = _sizes(spark, sf_dir)
    return packing.fill_report(packing.pack(sizes, key, capacities), capacities)


def _sizes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, str, dict[str, int]]:
    capacities = {r["size_name"]: r["capacity_tokens"] for r in table(spark, sf_dir, "pack_sizes").collect()}
    return settle(packing.token_counts(table(spark, sf_dir, "documents"), "doc_id", "text")), "doc_id", capacities


def _leaks(spark: SparkSession, sf_dir: str, fields: dict[str, bool]) -> DataFrame:
    return leakage.leaked(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "eval_items"), "item_id", fields)


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that holds a passage of a held-out item."""
    return _leaks(spark, sf_dir, {"text": False}).select("doc_id", "item_id").distinct()


def p9_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where passages, whole questions and passages of answers stand in the documents."""
    return _leaks(spark, sf_dir, {"text": False, "question": True, "answer": False})


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document whose text was cut inside a sentence or word."""
    _, cut = truncation.measured(table(spark, sf_dir, "documents"), "doc_id", "text", "source")
    return cut.select("doc_id").distinct()


def p10_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each source cuts its texts."""
    ends, cut = truncation.measured(table(spark, sf_dir, "documents"), "doc_id", "text", "source")
    return truncation.source_report(ends, cut, "doc_id")


def p10_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lengths at which each source cuts."""
    ends = settle(truncation.endings(table(spark, sf_dir, "documents"), "doc_id", "text", "source"))
    return truncation.length_limits(ends).select("source", "unit", "length", "texts")


QUERIES = {"p7_found": p7_found, "p7_labels": p7_labels, "p7_passages": p7_passages, "p8_pack": p8_pack, "p8_fill": p8_fill, "p9_found": p9_found, "p9_spans": p9_spans, "p10_found": p10_found, "p10_sources": p10_sources, "p10_limits": p10_limits}
# every twelve successive words, reduced, of documents and items, joined as they are: brute force
_FORM = r"regexp_replace(translate(strip_accents(lower(replace(replace(x, 'ﬁ', 'fi'), 'ﬂ', 'fl'))), 'FROM', 'TO'), '[^\p{L}\p{N}]', '', 'g')".replace("FROM", survivor._FROM.rstrip()).replace("TO", survivor._TO.rstrip())
_VISIBLE = r"regexp_replace(regexp_replace(text, '[\x{200B}-\x{200F}\x{2060}\x{FEFF}\x{00AD}]', '', 'g'), '([\p{L}\p{N}])[-‐]\s*\n\s*([\p{L}\p{N}])', '\1\2', 'g')"
_WORDS = rf"list_filter(list_transform(string_split_regex({_VISIBLE}, '[\s\x{{00A0}}\x{{3000}}\x{{2000}}-\x{{200A}}\x{{202F}}]+'), lambda x: {_FORM}), lambda x: x <> '')"


def _grams(key: str, name: str) -> str:
    return f"SELECT DISTINCT {key}, array_to_string(w[i:i + 11], ' ') AS g FROM (SELECT {key}, w, unnest(range(1, len(w) - 10)) AS i FROM (SELECT {key}, {_WORDS} AS w FROM {name} WHERE text IS NOT NULL))"


_T = truncation
_QUOTED = lambda x: x.replace("'", "''")
_STARTS = lambda kind, x: rf"len(regexp_extract_all({x}, '(?:^|[^\p{{L}}''’-])(\p{{{kind}}})', 1))"
_ENDING = rf"""CASE WHEN regexp_matches(tip, '{_QUOTED(_T._MARK)}') THEN 'open' WHEN regexp_matches(tip, '{_QUOTED(_T._ELLIPSIS)}') THEN CASE WHEN regexp_matches(tip, '\[(…|\.\.\.)\]$') THEN 'open' ELSE 'doubtful' END
 WHEN regexp_matches(line, '{_QUOTED(_T._CLOSING_LINE)}') THEN 'closing' WHEN regexp_matches(tip, '{_QUOTED(_T._COMPLETE)}') THEN 'complete'
 WHEN NOT running AND len(lines) > 1 AND len(list_filter(lines, lambda x: NOT (regexp_matches(x, '^\p{{Lu}}') AND {_STARTS('Lu', 'x')} >= {_STARTS('Ll', 'x')}))) = 0 THEN 'closing'
 WHEN NOT running AND len(lines) = 1 AND {_STARTS('Ll', 'para')} = 0 AND {_STARTS('Lu', 'para')} > 3 THEN 'doubtful' ELSE 'open' END"""
_BLANK = "' ' || chr(10) || chr(9) || chr(13) || chr(12) || chr(11) || chr(160) || chr(8232) || chr(8233)"
_TAIL = "CASE WHEN texts <= expected THEN 1.0 ELSE least(1.0, list_sum(list_transform(range(texts, texts + 300), lambda i: exp(i * ln(expected) - expected - lgamma(i + 1))))) END"

_N = _T.NEIGHBOURS
_CUT = rf"""WITH a AS (SELECT doc_id, source, length(text) AS chars, strlen(text) AS bytes, rtrim(string_split(rtrim(replace(text, chr(13), ''), {_BLANK}), chr(10) || chr(10))[-1], {_BLANK}) AS para FROM documents WHERE text IS NOT NULL),
 b AS (SELECT *, string_split(para, chr(10)) AS lines, string_split(para, chr(10))[-1] AS line, right(string_split(para, chr(10))[-1], 12) AS tip, regexp_matches(para, '(\p{{Ll}}{{2}}|[)\]\d])[.!?]\s') AS running FROM a WHERE para <> ''),
 f AS (SELECT doc_id, source, chars, bytes, {_ENDING} AS ending FROM b),
 n AS (SELECT source, unit, len, count(*) AS texts FROM (SELECT source, unnest(['chars', 'bytes']) AS unit, unnest([chars, bytes]) AS len FROM f) GROUP BY ALL),
 x AS (SELECT n.*, (SELECT count(*) FROM (SELECT CASE n.unit WHEN 'chars' THEN chars ELSE bytes END AS z, source AS y FROM f) WHERE y IS NOT DISTINCT FROM n.source AND z >= n.len) AS at_risk,
  (SELECT sum(greatest(0, least(z, n.len + {_N}) - (n.len - {_N}) + 1)) FROM (SELECT CASE n.unit WHEN 'chars' THEN chars ELSE bytes END AS z, source AS y FROM f) WHERE y IS NOT DISTINCT FROM n.source) AS exposed,
  sum(texts) OVER (PARTITION BY source, unit ORDER BY len RANGE BETWEEN {_N} PRECEDING AND {_N} FOLLOWING) - texts AS near FROM n),
 m AS (SELECT *, at_risk * (near + 0.5) / greatest(exposed - at_risk, 1) AS expected FROM x),
 p AS (SELECT *, {_TAIL} AS p_value FROM m), r AS (SELECT *, row_number() OVER (PARTITION BY source, unit ORDER BY p_value, len) AS k, count(*) OVER (PARTITION BY source, unit) AS tests FROM p),
 g AS (SELECT *, max(CASE WHEN p_value * tests <= k * {_T.FDR} THEN k END) OVER (PARTITION BY source, unit) AS last FROM r QUALIFY k <= last AND texts >= {_T.LEAST}),
 o AS (SELECT f.source, CASE WHEN (c.p_value, -c.texts) <= (coalesce(q.p_value, c.p_value), coalesce(-q.texts, -c.texts)) THEN 'chars' ELSE 'bytes' END AS unit, chars, bytes FROM f LEFT JOIN g c ON c.source IS NOT DISTINCT FROM f.source AND c.unit = 'chars' AND c.len = chars LEFT JOIN g q ON q.source IS NOT DISTINCT FROM f.source AND q.unit = 'bytes' AND q.len = bytes WHERE c.len IS NOT NULL OR q.len IS NOT NULL),
 w AS (SELECT source, unit, CASE unit WHEN 'chars' THEN chars ELSE bytes END AS len, count(*) AS own FROM o GROUP BY ALL),
 l AS (SELECT g.source, g.unit, g.len, g.texts FROM g JOIN w ON w.source IS NOT DISTINCT FROM g.source AND w.unit = g.unit AND w.len = g.len WHERE own >= {_T.LEAST} AND {_TAIL.replace('texts', 'own')} * tests <= last * {_T.FDR}),
 e AS (SELECT f.*, EXISTS (SELECT 1 FROM l WHERE l.source IS NOT DISTINCT FROM f.source AND (l.unit = 'chars' AND l.len = f.chars OR l.unit = 'bytes' AND l.len = f.bytes)) AS at_limit FROM f)"""

ORACLE: dict[str, str] = {
    "p9_found": f"WITH d AS ({_grams('doc_id', 'documents')}), i AS ({_grams('item_id', 'eval_items')}) SELECT DISTINCT doc_id, item_id FROM d JOIN i USING (g)",
    "p10_found": f"{_CUT} SELECT DISTINCT doc_id FROM e WHERE ending = 'open' OR ending = 'doubtful' AND at_limit",
    "p10_sources": f"{_CUT}, c AS (SELECT *, ending = 'open' OR ending = 'doubtful' AND at_limit AS is_cut FROM e) SELECT source, count(*) AS texts, count(*) FILTER (WHERE is_cut) AS cut, count(*) FILTER (WHERE is_cut AND at_limit) AS at_limit, count(*) FILTER (WHERE is_cut) / count(*) AS cut_share FROM c GROUP BY 1",
    "p10_limits": f"{_CUT} SELECT source, unit, len AS length, CAST(texts AS BIGINT) AS texts FROM l",
}
