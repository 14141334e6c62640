"""Columnar shredding of nested records into flat, linked tables.

Each record is striped over a declared tree of fields: every leaf column gets one entry per value or per missing
branch, with its repetition level (at which repeated ancestor the value repeats) and its definition level (how much
of its path is there). Tables of any repeated ancestor are then rebuilt from the level sequences alone, for whole
Arrow batches with numpy: an entry starts a new instance of the ancestor at repetition depth k iff its repetition
level is at most k and its definition level reaches the ancestor.

No shuffle: a record never leaves its partition, so the cost is linear and independent of key skew.

Defined results: a null, empty, damaged or non-JSON record has no entities; a JSON string that holds JSON is opened
once; a lone value where an array is expected is an array of one; nulls are no entities, empty objects and strings
are; rows with repeated ids are shredded each on their own.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass
class Node:
    """A field of the tree: ``repeated`` fields coerce a lone value to an array of one; ``entity`` names the table
    that instances of a repeated field belong to; a node without children is a scalar leaf."""

    name: str
    children: list["Node"] = field(default_factory=list)
    repeated: bool = False
    entity: str | None = None


@dataclass
class Column:
    """Levels of one leaf path. ``presence`` columns of repeated fields hold the document position as their value."""

    path: str
    rep_level: int
    def_level: int
    owner: "Column | None"
    entity: str | None = None
    presence: bool = False
    records: list = field(default_factory=list)
    reps: list = field(default_factory=list)
    defs: list = field(default_factory=list)
    values: list = field(default_factory=list)


class Striper:
    """Stripes records over a tree; the columns grow until ``clear``."""

    def __init__(self, root: Node) -> None:
        self.columns: list[Column] = []
        self.root = self._compile(root, "", 0, 0, None)
        self.position = 0

    def _compile(self, node: Node, path: str, rep: int, deep: int, owner: Column | None) -> dict:
        path = f"{path}.{node.name}" if path else node.name
        deep += bool(path)
        out: dict = {"name": node.name, "repeated": node.repeated, "rep": rep + node.repeated, "def": deep, "presence": None, "value": None, "kids": {}}
        first = len(self.columns)
        if node.repeated:
            path += "[]"
            owner = Column(path, rep + 1, deep, owner, node.entity, True)
            self.columns.append(owner)
            out["presence"] = owner
        if node.children:
            for kid in node.children:
                out["kids"][kid.name] = self._compile(kid, path, out["rep"], deep, owner)
        if not node.children or node.repeated and node.entity:
            out["value"] = Column(path + ".$value" * bool(node.children), out["rep"], deep + 1, owner)
            self.columns.append(out["value"])
        out["below"] = self.columns[first:]
        return out

    @staticmethod
    def _absent(columns: Iterable[Column], record: int, rep: int, deep: int) -> None:
        for c in columns:
            c.records.append(record)
            c.reps.append(rep)
            c.defs.append(deep)
            c.values.append(None)

    def _put(self, column: Column, record: int, rep: int, deep: int, value) -> None:
        column.records.append(record)
        column.reps.append(rep)
        column.defs.append(deep)
        column.values.append(value)

    def _inside(self, node: dict, value, record: int, rep: int) -> None:
        """``value`` is there, an element of ``node`` if that is repeated."""
        if node["presence"] is not None:
            self.position += 1
            self._put(node["presence"], record, rep, node["def"], self.position)
        own = node["value"]
        if own is not None:
            if isinstance(value, (dict, list)):
                self._put(own, record, rep, node["def"], None)
            else:
                self._put(own, record, rep, node["def"] + 1, value if isinstance(value, str) else json.dumps(value))
        kids = node["kids"]
        if not kids:
            return
        if isinstance(value, dict):
            seen = 0
            for key, inner in value.items():  # in document order
                kid = kids.get(key)
                if kid is not None:
                    self._field(kid, inner, record, rep, node["def"])
                    seen += 1
            if seen < len(kids):
                for key, kid in kids.items():
                    if key not in value:
                        self._absent(kid["below"], record, rep, node["def"])
        else:
            for kid in kids.values():
                self._absent(kid["below"], record, rep, node["def"])

    def _field(self, node: dict, value, record: int, rep: int, deep: int) -> None:
        if not node["repeated"]:
            if value is None:
                self._absent(node["below"], record, rep, deep)
            else:
                self._inside(node, value, record, rep)
            return
        here = rep
        for element in value if isinstance(value, list) else (value,):
            if element is not None:
                self._inside(node, element, record, here)
                here = node["rep"]
        if here == rep:
            self._absent(node["below"], record, rep, deep)

    def stripe(self, value, record: int) -> None:
        """Add one record, numbered in the order given."""
        self.position = 0
        self._inside(self.root, value if isinstance(value, dict) else {}, record, 0)

    def clear(self) -> None:
        for c in self.columns:
            c.records, c.reps, c.defs, c.values = [], [], [], []


def _reject(name: str):
    raise ValueError(name)


def read_json(text: str | None):
    """The value of ``text``, of the JSON in it if it is a JSON string; None if it is not readable."""
    if not text:
        return None
    try:
        value = _load(text)
        return _load(value) if isinstance(value, str) else value
    except ValueError:
        return None


def _load(text: str):
    try:
        return json.loads(text, parse_constant=_reject)
    except RecursionError:  # far deeper than any path that is read
        return json.loads(_shallow(text), parse_constant=_reject)


#: Levels that a value too deep for the parser is read down to; no path of a schema reaches so far.
DEEPEST = 500
_TOKEN = re.compile(r'"(?:[^"\\]|\\.)*"|[\[\]{}]', re.S)


def _shallow(text: str) -> str:
    """JSON text with null for what lies more than DEEPEST levels down; of that only the brackets are looked at."""
    out, open_, at = [], [], 0
    for m in _TOKEN.finditer(text):
        c = m.group()
        if c in "[{":
            open_.append(c)
            if len(open_) == DEEPEST + 1:
                out += text[at : m.start()], "null"
        elif c in "]}":
            if not open_ or open_.pop() + c not in ("[]", "{}"):
                raise ValueError(c)
            if len(open_) == DEEPEST:
                at = m.end()
    if open_:
        raise ValueError("unclosed")
    return "".join(out) + text[at:]


def assemble(striper: Striper, kinds: list[str]) -> dict[str, dict]:
    """Tables of the repeated ancestors of each kind, from the level sequences of their presence columns.

    Every table has ``record``, ``parent`` (number of the parent entity, 0 at the top), ``no`` (number in the record,
    in document order over all paths of the kind, from 1) and ``fields`` (a list of (path, value) per instance).
    """
    numbers: dict[int, np.ndarray] = {}  # of the instances of each presence column, in its own order
    out = {}
    for kind in kinds:  # parents come before their children
        parts = []
        for c in (c for c in striper.columns if c.presence and c.entity == kind):
            deep = np.asarray(c.defs, np.int16)
            there = deep >= c.def_level
            if not there.any():
                numbers[id(c)] = np.zeros(0, np.int32)
                continue
            up = c.owner
            while up is not None and up.entity is None:
                up = up.owner
            if up is None:
                parent = np.zeros(int(there.sum()), np.int32)
            else:
                begins = (np.asarray(c.reps, np.int16) <= up.rep_level) & (deep >= up.def_level)
                parent = numbers[id(up)][np.cumsum(begins)[there] - 1]
            where = np.flatnonzero(there)
            parts.append((c, np.asarray(c.records, np.int64)[where], np.asarray([c.values[i] for i in where], np.int64), parent))
        if not parts:
            out[kind] = {"record": np.zeros(0, np.int64), "parent": np.zeros(0, np.int32), "no": np.zeros(0, np.int32), "parts": [], "order": np.zeros(0, np.int64)}
            continue
        record, position = np.concatenate([p[1] for p in parts]), np.concatenate([p[2] for p in parts])
        order = np.lexsort((position, record))
        starts = np.r_[True, np.diff(record[order]) != 0]
        first = np.maximum.accumulate(np.where(starts, np.arange(len(order)), 0))
        no = np.empty(len(order), np.int32)
        no[order] = np.arange(len(order)) - first + 1
        at = 0
        for c, rec, _, _ in parts:
            numbers[id(c)] = no[at : at + len(rec)]
            at += len(rec)
        out[kind] = {"record": record, "parent": np.concatenate([p[3] for p in parts]), "no": no, "parts": [p[0] for p in parts]}
    return out


def leaf_fields(striper: Striper, owner: Column) -> list[list[tuple[str, str]]]:
    """The (relative path, value) pairs of every instance of ``owner``, from leaves with no repetition in between."""
    found: list[list[tuple[str, str]]] = []
    for c in striper.columns:
        if c.presence or c.owner is not owner:
            continue
        name = c.path[len(owner.path) + 1 :]
        at = [i for i, d in enumerate(c.defs) if d >= owner.def_level]
        found = found or [[] for _ in at]
        for instance, i in zip(found, at):
            if c.values[i] is not None:
                instance.append((name, c.values[i]))
    return found


#: Fields of the sources' answers, as fixed by the data: where each kind of entity stands.
def library_tree(values: bool = False) -> Node:
    """The tree of raw_data; ``values`` adds the scalar leaves of every entity."""
    leaf = lambda *names: [Node(n) for n in names] if values else []
    place = [Node("place", [Node("city"), Node("geo", [Node("grid")])])] if values else []
    code = lambda: [*leaf("type", "value")]

    def affiliation(name: str) -> Node:
        return Node(name, [*leaf("name"), *place, Node("ids", code(), True, "affiliation_id")], True, "affiliation")

    def contributor(name: str) -> Node:
        agent = Node("agent", [*leaf("label"), affiliation("affiliation")])
        person = [Node("author", leaf("display_name"))] if values else []
        return Node(name, [*leaf("name", "given", "family", "sequence", "author_position"), *person, affiliation("affiliation"), affiliation("institutions"), affiliation("affiliations"), agent], True, "contributor")

    def identifier(name: str) -> Node:
        return Node(name, code(), True, "identifier")

    return Node("", [
        Node("message", [contributor("author"), identifier("alternative-id")]),
        contributor("authorships"),
        identifier("ids"),
        Node("_embedded", [Node("items", [Node("metadata", [contributor("creators"), identifier("identifiers")])], True)]),
        Node("instanceOf", [contributor("contribution")]),
        identifier("identifiedBy"),
    ])


KINDS = ["contributor", "affiliation", "affiliation_id", "identifier"]


def kinds(tree: Node) -> list[str]:
    """The entities of a tree, parents before their children."""
    found = [tree.entity] if tree.entity else []
    return list(dict.fromkeys([*found, *(k for child in tree.children for k in kinds(child))]))


def nested_entities(df: DataFrame, id_col: str, json_col: str, values: bool = False, tree: Node | None = None) -> DataFrame:
    """(id, entity, parent_no, entity_no[, fields map]) for every nested entity of every readable record.

    ``tree`` says where the entities stand, that of the sources' answers unless another is given."""
    tree = tree or library_tree(values)
    source = df.select(F.col(id_col).alias("id"), F.col(json_col).alias("raw"))
    id_type = source.schema["id"].dataType.simpleString()
    schema = f"id {id_type}, entity string, parent_no int, entity_no int" + (", fields map<string,string>" if values else "")

    def shred(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        striper = Striper(tree)
        for batch in batches:
            striper.clear()
            for n, text in enumerate(batch.column(1).to_pylist()):
                value = read_json(text)
                if isinstance(value, dict):
                    striper.stripe(value, n)
            for kind, t in assemble(striper, kinds(tree)).items():
                if not len(t["record"]):
                    continue
                columns = [batch.column(0).take(pa.array(t["record"])), pa.array([kind] * len(t["record"]), pa.string()), pa.array(t["parent"], pa.int32()), pa.array(t["no"], pa.int32())]
                names = ["id", "entity", "parent_no", "entity_no"]
                if values:
                    pairs = [x for c in t["parts"] for x in leaf_fields(striper, c)]
                    columns.append(pa.array(pairs, pa.map_(pa.string(), pa.string())))
                    names.append("fields")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return source.mapInArrow(shred, schema).withColumnRenamed("id", id_col)


def leaf_levels(df: DataFrame, id_col: str, json_col: str) -> DataFrame:
    """The shredded form itself: (id, path, ordinal, repetition, definition, value) of every entry of every leaf."""
    source = df.select(F.col(id_col).alias("id"), F.col(json_col).alias("raw"))
    id_type = source.schema["id"].dataType.simpleString()

    def shred(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        striper = Striper(library_tree(True))
        for batch in batches:
            striper.clear()
            for n, text in enumerate(batch.column(1).to_pylist()):
                value = read_json(text)
                if isinstance(value, dict):
                    striper.stripe(value, n)
            for c in striper.columns:
                rec = np.asarray(c.records, np.int64)
                if not len(rec):
                    continue
                begin = np.maximum.accumulate(np.where(np.r_[True, np.diff(rec) != 0], np.arange(len(rec)), 0))
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).take(pa.array(rec)), pa.array([c.path] * len(rec), pa.string()), pa.array((np.arange(len(rec)) - begin).astype(np.int32)),
                    pa.array(np.asarray(c.reps, np.int32)), pa.array(np.asarray(c.defs, np.int32)), pa.array([None if v is None else str(v) for v in c.values], pa.string()),
                ], names=["id", "path", "ordinal", "repetition", "definition", "value"])

    return source.mapInArrow(shred, f"id {id_type}, path string, ordinal int, repetition int, definition int, value string").withColumnRenamed("id", id_col)
