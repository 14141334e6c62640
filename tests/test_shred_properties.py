import json

from hypothesis import given, settings
from hypothesis import strategies as st

from quire.operators.shred import KINDS, Striper, assemble, leaf_fields, library_tree, read_json
from tests.test_shred import brute

leaf = st.none() | st.integers(-3, 3) | st.sampled_from(["", "x", "é"])
lists = lambda x: st.lists(x, max_size=3) | x | st.none()
ids = lists(st.fixed_dictionaries({}, optional={"type": leaf, "value": leaf}) | leaf)
place = st.fixed_dictionaries({}, optional={"name": leaf, "ids": ids, "place": st.fixed_dictionaries({}, optional={"city": leaf})}) | leaf
person = st.fixed_dictionaries({}, optional={"affiliation": lists(place), "institutions": lists(place), "agent": st.fixed_dictionaries({}, optional={"affiliation": lists(place), "label": leaf}) | leaf, "name": leaf}) | leaf
record = st.fixed_dictionaries({}, optional={
    "message": st.fixed_dictionaries({}, optional={"author": lists(person), "alternative-id": ids}) | leaf,
    "authorships": lists(person),
    "ids": ids,
    "_embedded": st.fixed_dictionaries({}, optional={"items": lists(st.fixed_dictionaries({}, optional={"metadata": st.fixed_dictionaries({}, optional={"creators": lists(person), "identifiers": ids}) | leaf}))}) | leaf,
    "instanceOf": st.fixed_dictionaries({}, optional={"contribution": lists(person)}) | leaf,
})


@settings(max_examples=150, deadline=None)
@given(st.lists(record, min_size=1, max_size=4))
def test_any_records(records):
    """Tables from the level sequences equal a walk of the records, for many records in one batch; every leaf column
    has an entry for each instance of its ancestor."""
    striper = Striper(library_tree(True))
    for n, r in enumerate(records):
        striper.stripe(read_json(json.dumps(r)), n)
    got, tables = [], assemble(striper, KINDS)
    for kind, t in tables.items():
        got += zip(t["record"].tolist(), [kind] * len(t["record"]), t["parent"].tolist(), t["no"].tolist())
        for c in t["parts"]:
            assert len(leaf_fields(striper, c)) == sum(d >= c.def_level for d in c.defs)
    want = [(n, *x) for n, r in enumerate(records) for x in brute(json.dumps(r))]
    assert sorted(got) == sorted(want)


@settings(max_examples=150, deadline=None)
@given(record)
def test_levels_are_well_formed(r):
    striper = Striper(library_tree(True))
    striper.stripe(r, 0)
    for c in striper.columns:
        assert c.reps[0] == 0 and all(0 < x <= c.rep_level for x in c.reps[1:])
        assert all(0 <= d <= c.def_level for d in c.defs)
        assert all((v is None) or d == c.def_level for v, d in zip(c.values, c.defs))
