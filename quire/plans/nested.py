"""Queries over the nested answers of the sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators.shred import leaf_levels, nested_entities
from quire.sources.tables import table


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every nested entity of every readable raw_data, linked to its parent."""
    return nested_entities(table(spark, sf_dir, "metadata_results"), "result_id", "raw_data")


def p2_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with the scalar fields of each entity, as one sorted text of name=value pairs."""
    found = nested_entities(table(spark, sf_dir, "metadata_results"), "result_id", "raw_data", values=True)
    pairs = F.transform(F.array_sort(F.map_entries("fields")), lambda e: F.concat(e.key, F.lit("="), e.value))
    return found.withColumn("fields", F.array_join(pairs, "; "))


def p2_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries, values and deepest levels of every leaf path of the shredded form."""
    levels = leaf_levels(table(spark, sf_dir, "metadata_results"), "result_id", "raw_data")
    return levels.groupBy("path").agg(
        F.count("*").alias("entries"), F.count("value").alias("present"), F.max("repetition").alias("max_repetition"), F.max("definition").alias("max_definition")
    )


QUERIES = {"p2_found": p2_found, "p2_entities": p2_entities, "p2_levels": p2_levels}


def _array(x: str) -> str:
    """A value as a list without nulls; a lone one as a list of one."""
    return f"list_filter(CASE json_type({x}) WHEN 'ARRAY' THEN CAST({x} AS JSON[]) ELSE [{x}] END, lambda e: e IS NOT NULL AND json_type(e) <> 'NULL')"


def _arrays(x: str, *paths: str) -> str:
    out = [f"coalesce({_array(f"json_extract({x}, '{p}')")}, [])" for p in paths]
    return out[0] if len(out) == 1 else "list_concat(" * (len(out) - 1) + out[0] + "".join(f", {o})" for o in out[1:])


_ITEMS = _arrays("j", "$._embedded.items")
_PEOPLE = f"list_concat(list_concat({_arrays('j', '$.message.author', '$.authorships')}, flatten(list_transform({_ITEMS}, lambda i: {_arrays('i', '$.metadata.creators')}))), {_arrays('j', '$.instanceOf.contribution')})"
_IDS = f"list_concat(list_concat({_arrays('j', '$.message."alternative-id"', '$.ids')}, flatten(list_transform({_ITEMS}, lambda i: {_arrays('i', '$.metadata.identifiers')}))), {_arrays('j', '$.identifiedBy')})"

ORACLE = {
    "p2_found": f"""WITH r AS (SELECT result_id, CASE WHEN json_type(raw_data) = 'VARCHAR' THEN CASE WHEN json_valid(json_extract_string(raw_data, '$')) THEN CAST(json_extract_string(raw_data, '$') AS JSON) END ELSE CAST(raw_data AS JSON) END AS j FROM metadata_results WHERE json_valid(raw_data)),
 o AS (SELECT * FROM r WHERE json_type(j) = 'OBJECT'),
 p AS (SELECT result_id, unnest(range(1, len(l) + 1)) AS no, unnest(l) AS x FROM (SELECT result_id, {_PEOPLE} AS l FROM o)),
 a AS (SELECT result_id, parent, x, row_number() OVER (PARTITION BY result_id ORDER BY parent, i) AS no FROM (SELECT result_id, no AS parent, unnest(range(1, len(l) + 1)) AS i, unnest(l) AS x FROM (SELECT result_id, no, {_arrays('x', '$.affiliation', '$.institutions', '$.affiliations', '$.agent.affiliation')} AS l FROM p))),
 d AS (SELECT result_id, parent, row_number() OVER (PARTITION BY result_id ORDER BY parent, i) AS no FROM (SELECT result_id, no AS parent, unnest(range(1, len(l) + 1)) AS i FROM (SELECT result_id, no, {_arrays('x', '$.ids')} AS l FROM a))),
 k AS (SELECT result_id, unnest(range(1, len(l) + 1)) AS no FROM (SELECT result_id, {_IDS} AS l FROM o))
 SELECT result_id, 'contributor' AS entity, 0::INT AS parent_no, no::INT AS entity_no FROM p UNION ALL SELECT result_id, 'affiliation', parent::INT, no::INT FROM a UNION ALL SELECT result_id, 'affiliation_id', parent::INT, no::INT FROM d UNION ALL SELECT result_id, 'identifier', 0, no::INT FROM k""",
}
