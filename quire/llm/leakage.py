"""Passages of held-out items that stand in the corpus, found by one Aho-Corasick automaton.

Texts and items are reduced to their letters and digits alone: compatibility forms, case, accents, look-alike letters,
spaces, punctuation, line-break hyphens and invisible characters vanish alike on both sides. The items' words are kept
as positions in that reduced text.

Any ``words`` successive words hold a whole aligned block of ``words // 2`` words of the item, so the automaton
carries one pattern per block (two per 12 words, not one per word); questions are patterns as a whole. Each text is
scanned once; each hit is then extended letter by letter in both directions and holds if whole words of the item at
either end make at least ``words``. Offsets are mapped back to the original text only for the texts that were hit.

One narrow pass over the corpus without any shuffle of texts. Items are sent to the executors in blocks of bounded
size (``block_chars``), one pass each, so a larger test set costs passes and not memory. Defined results: null, blank
and short texts match nothing; repeated documents and items count each; items of under ``words`` words can't leak.
"""

from __future__ import annotations

import re
import unicodedata
import uuid
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Successive words that make a leak, and the bound on the reduced letters of the items in one automaton.
WORDS, BLOCK_CHARS = 12, 4_000_000

# Greek and Cyrillic letters whose small or capital form looks like a Latin letter, each above that.
LOOKS = str.maketrans(
    "аеорсухіјѕԁһӏԛԝвкмнтαορνικτυχβεζημϲ",
    "aeopcyxijsdhlqwbkmhtaopviktuxbezhmc",
)
_NOT_WORD = re.compile(r"[\W_]+")


_MARKS = re.compile(r"[\u0300-\u036f\u1ab0-\u1aff\u20d0-\u20ff\ufe20-\ufe2f]+")
_OTHER = re.compile(r"[\u0370-\u052f]")


def reduce_text(text: str) -> str:
    """The letters and digits of ``text`` in one form."""
    if not text.isascii():
        text = _MARKS.sub("", unicodedata.normalize("NFKD", text.casefold()))
        if _OTHER.search(text):
            text = text.translate(LOOKS)
        return _NOT_WORD.sub("", text)
    return _NOT_WORD.sub("", text.lower())


def reduce_mapped(text: str) -> tuple[str, list[int]]:
    """The reduced text, and for each of its letters the offset in ``text``."""
    out, at = [], []
    for i, c in enumerate(text):
        for x in reduce_text(c):
            out.append(x)
            at.append(i)
    return "".join(out), at


class Items:
    """Patterns of one block of items and their automaton."""

    def __init__(self, items: list[tuple], words: int) -> None:
        self.words, self.texts, self.ends = words, [], []
        patterns: dict[str, list[tuple[int, int]]] = {}
        for n, (_, _, text, whole) in enumerate(items):
            tokens = [x for x in map(reduce_text, (text or "").split()) if x]
            starts, at = [], 0
            for x in tokens:
                starts.append(at)
                at += len(x)
            starts.append(at)
            self.texts.append("".join(tokens))
            self.ends.append(starts)
            step = len(tokens) if whole else words // 2
            if len(tokens) < (1 if whole else words):
                continue
            for b in range(0, len(tokens) - step + 1, max(1, step)):
                patterns.setdefault(self.texts[-1][starts[b] : starts[b + step]], []).append((n, starts[b]))
        self.keys = [(x[0], x[1], x[3]) for x in items]
        self.automaton = ahocorasick.Automaton()
        for p, where in patterns.items():
            self.automaton.add_word(p, (len(p), where))
        if patterns:
            self.automaton.make_automaton()
        self.any = bool(patterns)

    def spans(self, text: str | None) -> list[tuple]:
        """(item key, field, words, start, end) of every leaked stretch of ``text``, by original offsets."""
        if not text or not self.any:
            return []
        plain, at = reduce_text(text), None
        found: list[tuple] = []
        last: dict[tuple, int] = {}  # where the last stretch of an item on an alignment ends, in reduced letters
        for end, (length, where) in self.automaton.iter(plain):
            first = end + 1 - length
            for n, offset in where:
                if end < last.get((n, first - offset), 0):
                    continue  # the same stretch, met at another of its blocks
                item, starts, (key, field, whole) = self.texts[n], self.ends[n], self.keys[n]
                least = len(starts) - 1 if whole else self.words
                a, i = first, offset
                while i and a and item[i - 1] == plain[a - 1]:
                    a, i = a - 1, i - 1
                b, j = end + 1, offset + length
                while j < len(item) and b < len(plain) and item[j] == plain[b]:
                    b, j = b + 1, j + 1
                left, right = bisect_left(starts, i), bisect_right(starts, j) - 1
                if right - left < least:
                    continue
                if at is None:
                    mapped, at = reduce_mapped(text)
                    if mapped != plain:  # composed across characters: offsets by the nearest of the same share
                        at = [at[k * len(at) // len(plain)] for k in range(len(plain))]
                # the text's words must end where the item's do
                if starts[left] == i and a and at[a] == at[a - 1] + 1:
                    left += 1
                if starts[right] == j and b < len(at) and at[b] == at[b - 1] + 1:
                    right -= 1
                if right - left >= least:
                    last[(n, first - offset)] = b
                    found.append((key, field, right - left, at[a + starts[left] - i], at[a + starts[right] - i - 1] + 1))
        return found


_BUILT: dict[str, Items] = {}  # a worker builds the automaton of a block once


def _blocks(items: DataFrame, key: str, fields: dict[str, bool], block_chars: int) -> Iterator[list[tuple]]:
    """The items, in blocks of bounded size; one block at a time is held by the driver."""
    block, size = [], 0
    for row in items.select(key, *fields).toLocalIterator():
        for name, whole in fields.items():
            if row[name]:
                block.append((row[key], name, row[name], whole))
                size += len(row[name])
        if size > block_chars:
            yield block
            block, size = [], 0
    if block:
        yield block


def leaked(df: DataFrame, id_col: str, text_col: str, items: DataFrame, key: str, fields: dict[str, bool], words: int = WORDS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(id, key, field, words, start, end): every stretch of a text that holds ``words`` successive words of an item's
    field, or the whole of it where ``fields`` says True."""
    spark = df.sparkSession
    source = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = f"id {source.schema['id'].dataType.simpleString()}, key {items.schema[key].dataType.simpleString()}, field string, words int, start int, end int"
    found = None
    for block in _blocks(items, key, fields, block_chars):
        sent, mark = spark.sparkContext.broadcast(block), uuid.uuid4().hex

        def scan(batches: Iterator[pa.RecordBatch], sent=sent, mark=mark) -> Iterator[pa.RecordBatch]:
            if mark not in _BUILT:
                _BUILT.clear()
                _BUILT[mark] = Items(sent.value, words)
            own = _BUILT[mark]
            for batch in batches:
                ids, rows = batch.column(0), []
                for n, text in enumerate(batch.column(1).to_pylist()):
                    rows += [(n, *x) for x in own.spans(text)]
                cols = list(zip(*rows)) or [[]] * 6
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(cols[0], pa.int64())), pa.array(cols[1], pa_key), pa.array(cols[2], pa.string()), *(pa.array(c, pa.int32()) for c in cols[3:])],
                    names=["id", "key", "field", "words", "start", "end"],
                )

        pa_key = pa.int64() if schema.split("key ")[1].startswith("bigint") else pa.string()
        part = source.mapInArrow(scan, schema)
        found = part if found is None else found.unionAll(part)
    if found is None:
        found = spark.createDataFrame([], schema)
    return found.withColumnsRenamed({"id": id_col, "key": key})
