import json

from pyspark.sql import functions as F

from quire.operators.shred import KINDS, Node, Striper, assemble, leaf_levels, library_tree, nested_entities, read_json
from quire.sources.tables import table


def many(v):
    return [x for x in (v if isinstance(v, list) else [v]) if x is not None]


def get(v, *path):
    for p in path:
        v = v.get(p) if isinstance(v, dict) else None
    return v


def brute(record):
    """Walks the record itself, without levels."""
    value = read_json(record)
    if not isinstance(value, dict):
        return []
    people, rows, n_aff, n_id = [], [], 0, 0
    ids = []
    for top, inner in value.items():
        if top == "message" and isinstance(inner, dict):
            for k, v in inner.items():
                if k == "author":
                    people += many(v)
                elif k == "alternative-id":
                    ids += many(v)
        elif top == "authorships":
            people += many(inner)
        elif top in ("ids", "identifiedBy"):
            ids += many(inner)
        elif top == "_embedded":
            for item in many(get(inner, "items")):
                people += many(get(item, "metadata", "creators"))
                ids += many(get(item, "metadata", "identifiers"))
        elif top == "instanceOf":
            people += many(get(inner, "contribution"))
    for p, person in enumerate(people, 1):
        rows.append(("contributor", 0, p))
        if not isinstance(person, dict):
            continue
        places = []
        for k, v in person.items():
            if k in ("affiliation", "institutions", "affiliations"):
                places += many(v)
            elif k == "agent":
                places += many(get(v, "affiliation"))
        for place in places:
            n_aff += 1
            rows.append(("affiliation", p, n_aff))
            for _ in many(get(place, "ids")):
                n_id += 1
                rows.append(("affiliation_id", n_aff, n_id))
    rows += [("identifier", 0, i) for i in range(1, len(ids) + 1)]
    return rows


CASES = [
    None, "", "{", "null", "[]", "3", '"x"', "NaN", '{"a": NaN}',
    json.dumps({"message": {"author": {"family": "A", "affiliation": {"name": "B", "ids": {"value": 1}}}}}),
    json.dumps(json.dumps({"authorships": ["plain", None, {"institutions": [None, {"ids": [None, 1, "x"]}], "affiliation": "lone"}], "ids": "one"})),
    json.dumps({"_embedded": {"items": [{"metadata": {"creators": [{}, ""]}}, {"metadata": None}, {"metadata": {"creators": "x", "identifiers": [1, 2]}}]}}),
    json.dumps({"instanceOf": {"contribution": [{"agent": {"affiliation": [{"ids": []}, {"ids": [1]}]}}, {"agent": "x"}]}, "identifiedBy": [{}], "message": {"author": ["z"]}}),
    json.dumps({"message": [], "authorships": None, "_embedded": 3, "instanceOf": {"contribution": None}}),
]


def test_levels_rebuild_every_table(spark):
    rows = [(i, x) for i, x in enumerate(CASES)] + [(7, CASES[10])]
    df = spark.createDataFrame(rows, "id long, raw string").withColumn("entity", F.lit("clash"))
    got = sorted(tuple(r) for r in nested_entities(df, "id", "raw").collect())
    assert got == sorted((i, *r) for i, raw in rows for r in brute(raw))


def test_whole_table_equals_brute_force(spark, sf):
    df = table(spark, sf, "metadata_results")
    want = sorted((r.result_id, *x) for r in df.select("result_id", "raw_data").collect() for x in brute(r.raw_data))
    assert sorted(tuple(r) for r in nested_entities(df, "result_id", "raw_data").collect()) == want


def test_published_level_sequences():
    """Three levels deep, with a missing branch in between: levels as the columnar format defines them."""
    striper = Striper(library_tree())
    striper.stripe({"authorships": [{"institutions": [{"ids": [1, 2]}, {"ids": []}]}, {}, {"institutions": [{"ids": [3]}]}]}, 0)
    column = next(c for c in striper.columns if c.path == "authorships[].institutions[].ids[]")
    assert column.reps == [0, 3, 2, 1, 1]
    assert column.defs == [3, 3, 2, 1, 3]
    assert assemble(striper, KINDS)["affiliation_id"]["parent"].tolist() == [1, 1, 3]


def test_empty_table_and_fields(spark):
    empty = spark.createDataFrame([], "id long, raw string")
    assert nested_entities(empty, "id", "raw").count() == leaf_levels(empty, "id", "raw").count() == 0
    df = spark.createDataFrame([(1, CASES[9])], "id long, raw string")
    got = {r.entity: r.fields for r in nested_entities(df, "id", "raw", values=True).collect()}
    assert got["contributor"] == {"family": "A"} and got["affiliation_id"] == {"value": "1"}


def test_a_record_beside_a_value_that_is_too_deep_is_read():
    deep = '{"message": {"author": [{"family": "Doe"}], "other": ' + "[" * 20000 + "1" + "]" * 20000 + ', "n": "]}"}}'
    value = read_json(deep)
    assert value["message"]["author"] == [{"family": "Doe"}] and value["message"]["n"] == "]}"
    assert read_json('{"a": ' + "[" * 20000 + "}" * 20000 + "}") is None


def test_entities_of_another_tree(spark):
    tree = Node("", [Node("orders", [Node("lines", [Node("sku")], True, "line")], True, "order")])
    df = spark.createDataFrame([(1, '{"orders": [{"lines": [{"sku": "a"}, {"sku": "b"}]}, {"lines": {"sku": "c"}}]}'), (2, "{}"), (3, None)], "id long, raw string")
    got = {tuple(r) for r in nested_entities(df, "id", "raw", tree=tree).collect()}
    assert got == {(1, "order", 0, 1), (1, "order", 0, 2), (1, "line", 1, 1), (1, "line", 1, 2), (1, "line", 2, 3)}
