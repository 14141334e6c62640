"""Records of one work in two tables without a common key, matched with a confidence, by a label model.

Preparing: titles are repaired, brought to one form and cut into tokens, main title, part number; years and names are
read from their many formats. Rows that then say the same become one representative, so copies cost nothing later.

Candidates: every token, and every word of a name, is led to its most frequent neighbour within one edit (by shared
deletions, so without comparing all of them). Two representatives are candidates if their years, where both are known,
are no more than two apart, and either

- the rarest token of one title, whole or before a subtitle, is among those that hold half of the other's information,
  and where both name people, names of the two begin or end alike; or
- their titles share more than half of their tokens, what they do not share looks damaged, and they share a word of a
  name, or both lack names.

What is not known rules nothing out in the first way. Words that one record in a hundred has in a name tell nobody apart
and do not count. One equi-join of hashed keys finds all of them; no key is bounded or cut, at any size. Of one title,
those without authors are one representative per year and those without a year one per list of authors, so a title of
any number of people and years does not meet itself in full.

Label model: nine matching functions vote yes, no or nothing on each candidate. The counts of the vote patterns (at
most 3 to the 9) go to the driver, where expectation maximisation fits a generative model of the votes: a prior and,
for each function, its accuracy given the truth and, along the tree of the strongest conditional correlations, given
the vote of another function. The posterior of a pattern is the confidence of its candidates.

Defined results: null and empty titles match nothing; unknown years and missing authors say nothing; repeated rows all
match; parts that differ or years more than two apart are other works whatever the votes.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest, xxh3_128_digest

from quire.llm.encoding import repair
from quire.llm.leakage import reduce_text
from quire.llm.names import spellings, within_one
from quire.session import settle

#: Tokens that count as a title's rarest in the vote on them; letters from which on a token is led to any more frequent
#: neighbour, and the times that a shorter one's neighbour in titles must be as frequent (short words have neighbours by chance);
#: years that one work's records may differ by; share of the records from which on a word of names
#: is common; rounds of the model's fitting.
KEYS, LONG, OFTEN, YEARS, COMMON, ROUNDS = 3, 9, 3, 2, 0.01, 60
#: Words of the vocabulary up to which it is sent to all executors, some 20 MB; a larger one is joined by shuffling.
BROADCAST = 200_000
#: Numbers that a worker holds at once; of no effect on the result.
AT_ONCE = 500_000

_UNSEEN = re.compile("[\u00ad\u061c\u180e\u200b-\u200f\u202a-\u202e\u2060-\u206f\ufeff\ufff9-\ufffb]+")
_TAG, _NOTE = re.compile(r"<[^<>]*>"), re.compile(r"\[[^\]]*\]")
_CUT = re.compile(r"\s*:\s+|\s+[-–—/]\s+|(?<=\w{3})\.\s+")
_PART = re.compile(r"[,.(]\s*[^\W\d]{1,8}\.?\s+(\d{1,3})(?=\s*(?:[:.,;)/\-–—]|$))")
_UMLAUT = re.compile("(a)[ae]|([ou])e")
_YEAR = re.compile(r"(?<!\d)(1[5-9]\d\d|20\d\d)(?!\d)")


#: Words and names that a worker remembers the form of; of no effect on the result.
REMEMBERED = 200_000
_reduced = lru_cache(REMEMBERED)(reduce_text)


@lru_cache(REMEMBERED)
def _name_words(name: str) -> str:
    """The words of a name, umlauts and double letters for them as the plain letter."""
    words = re.findall(r"[^\W\d_]+", spellings(repair(name)[1])[-1])
    return " ".join(dict.fromkeys(_UMLAUT.sub(r"\1\2", w) for w in words if len(w) > 2))


def read_title(title: str | None) -> tuple[list[str], list[int], str]:
    """(tokens, numbers of them before each subtitle, part number)."""
    if not title:
        return [], [], ""
    if not title.isascii():
        title = _UNSEEN.sub("", unicodedata.normalize("NFKC", repair(title)[1]))
    if "<" in title:
        title = _TAG.sub("", title)
    if "[" in title:
        title = _NOTE.sub(" ", title)
    title = title.strip(" /.")
    part = _PART.search(title)
    if part:
        title = title[: part.start()] + " " + title[part.end() :] if title[part.end() : part.end() + 1] == " " else title[: part.start()] + title[part.end() :]
    words = [[x for x in map(_reduced, p.replace("&", " ").split()) if x] for p in _CUT.split(title)]
    if any(len(w) > 3 for p in words for w in p):
        words = [[w for w in p if len(w) > 3 or w.isdigit()] for p in words]  # articles and conjunctions come and go
    ends, at = [], 0
    for w in words[:-1]:
        at += len(w)
        ends.append(at)
    return [w for p in words for w in p], ends, part.group(1).lstrip("0") if part else ""


def read_year(text: str | None) -> int | None:
    """The year in a date of any format."""
    found = _YEAR.search(text) if text else None
    return int(found.group(1)) if found else None


def read_names(authors: list[str | None] | None) -> list[str]:
    """The words of each author, in one way of writing umlauts."""
    return sorted({_name_words(a) for a in authors or [] if a} - {""})


def prepared(df: DataFrame) -> DataFrame:
    """(id, rep, tokens, ends, part, year, names) of a table with (id, title, authors, date); no row for empty titles.

    ``rep`` is a 128-bit hash of the rest, by which rows that say the same are one representative."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows = [], []
            for n, (title, date, authors) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("title", "date", "authors")))):
                tokens, ends, part = read_title(title)
                if tokens:
                    ids.append(n)
                    rows.append((tokens, ends, part, read_year(date), read_names(authors)))
            cols = list(zip(*rows)) or [[]] * 5
            kinds = (pa.list_(pa.string()), pa.list_(pa.int32()), pa.string(), pa.int32(), pa.list_(pa.string()))
            reps = pa.array([xxh3_128_digest("\x1e".join(map("\x1f".join, (t, map(str, e), (p, str(y)), n)))) for t, e, p, y, n in rows], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(ids, pa.int64())), reps, *map(pa.array, cols, kinds)], names=["id", "rep", "tokens", "ends", "part", "year", "names"])

    source = df.select("id", "title", "authors", "date").where(F.col("title").isNotNull())
    return source.mapInArrow(read, "id bigint, rep binary, tokens array<string>, ends array<int>, part string, year int, names array<string>")


def _deletions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(code, cut): hashes of each word (code, kind, token) and of what is left of it without any one of its letters."""
    codes, cuts = [], []
    for batch in batches:
        for code, kind, token in zip(*(batch.column(c).to_pylist() for c in ("code", "kind", "token"))):
            own = {xxh3_64_intdigest(token, kind), *(xxh3_64_intdigest(token[:i] + token[i + 1 :], kind) for i in range(len(token)))}
            codes.append(np.full(len(own), code))
            cuts.extend(own)
            if len(cuts) >= AT_ONCE:
                yield _numbers(codes, cuts)
                codes, cuts = [], []
    if cuts:
        yield _numbers(codes, cuts)


def _numbers(codes: list[np.ndarray], cuts: list[int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(codes)), pa.array(np.array(cuts, np.uint64).view(np.int64))], names=["code", "cut"])


def canonical_tokens(counts: DataFrame) -> DataFrame:
    """(kind, token, canonical): the most frequent token of the kind within one edit, followed to its end; ``counts`` is
    (kind, token, n). Words meet by hashed deletions and numbers that order them, so only numbers are sorted; the words
    themselves are then compared."""
    code = F.call_function("shiftleft", F.col("n"), F.lit(32)).bitwiseOR(F.xxhash64("kind", "token").bitwiseAND(F.lit(2**32 - 1)))
    known = settle(counts.where(F.length("token") >= 5).withColumn("code", code))
    keyed = known.select("code", "kind", "token").mapInArrow(_deletions, "code bigint, cut bigint")
    best = keyed.withColumn("best", F.max("code").over(Window.partitionBy("cut")))  # one shuffle; a block is the words that share a deletion
    met = best.where(F.col("best") > F.col("code")).select("code", "best").distinct()
    other = known.select(F.col("code").alias("best"), F.col("kind").alias("k"), F.col("token").alias("t"), F.col("n").alias("m"))
    both = met.join(known, "code").join(other, "best").where(F.col("kind") == F.col("k"))
    swapped = (F.length("token") == F.length("t")) & (F.sort_array(F.split("token", "")) == F.sort_array(F.split("t", "")))
    near = ((F.levenshtein("token", "t", 1) >= 0) | swapped) & ((F.col("kind") == 1) | (F.length("token") >= LONG) | (F.col("m") >= OFTEN * F.col("n")))
    up = settle(both.where(near).groupBy("kind", "token").agg(F.max(F.struct("m", "t")).alias("best")).select("kind", "token", F.col("best.t").alias("canonical")))
    for _ in range(2):  # a neighbour's neighbour, up to four steps
        step = up.select("kind", F.col("token").alias("canonical"), F.col("canonical").alias("next"))
        up = up.join(step, ["kind", "canonical"], "left").select("kind", "token", F.coalesce("next", "canonical").alias("canonical"))
    return up


def ranked(reps: DataFrame) -> DataFrame:
    """``reps`` (side, rep, tokens, ends, part, year, names) with

    - ``t``, the canonical tokens of the title, the rarest first;
    - ``first``, the rarest of the whole title and of what stands before a subtitle;
    - ``n``, the canonical words of each author;
    - ``bits``, a set of 64 that holds each token's hash; ``telling`` and ``who``, ``rarer`` and ``words``, the hashes by which
      it meets the other side's (see ``_keys``); and a number, ``no``, that holds once the result is written.

    Frequencies are summed over the vocabulary, so the words are joined once, by the word that they have: in the worker,
    without a shuffle, where the vocabulary is small enough to be sent there."""
    each = F.concat(
        F.transform("tokens", lambda x, i: F.struct(F.lit(0).alias("kind"), i.alias("at"), x.alias("token"))),
        F.flatten(F.transform("names", lambda x, i: F.transform(F.split(x, " "), lambda w: F.struct(F.lit(1).alias("kind"), i.alias("at"), w.alias("token"))))),
    )
    total = max(1, reps.count())
    counts = settle(reps.select("tokens", "names").mapInArrow(_counted, "kind int, token string, n bigint").groupBy("kind", "token").agg(F.sum("n").alias("n")))
    named = counts.join(canonical_tokens(counts), ["kind", "token"], "left").withColumn("canonical", F.coalesce("canonical", "token"))
    totals = named.groupBy("kind", "canonical").agg(F.sum("n").alias("n"))
    looked = settle(named.drop("n").join(totals, ["kind", "canonical"]).select("kind", "token", "n", "canonical"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in reps.schema.fields) + ", t array<string>, first array<string>, n array<array<string>>, bits bigint, telling array<bigint>, who array<bigint>, rarer array<bigint>, words array<bigint>"
    if looked.count() <= BROADCAST:
        table = looked.toArrow()
        known = reps.sparkSession.sparkContext.broadcast([_vocabulary(table.filter(pc.equal(table["kind"], k))) for k in (0, 1)])
        out = reps.mapInArrow(lambda batches: _rank(batches, total, known.value), schema)
    else:
        of = lambda kind: F.collect_list(F.when(F.col("kind") == kind, F.struct("at", "n", "canonical"))).alias(f"w{kind}")
        found = reps.select("rep", F.inline(each)).join(looked, ["kind", "token"]).groupBy("rep").agg(of(0), of(1))
        out = reps.join(found, "rep").select(*reps.columns, "w0", "w1").mapInArrow(lambda batches: _rank(batches, total), schema)
    return out.withColumn("no", F.monotonically_increasing_id())


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(kind, token, n): how often each batch has the words of titles, kind 0, and of names, kind 1."""
    for batch in batches:
        for kind, words in enumerate((batch.column("tokens").flatten(), pc.split_pattern(batch.column("names").flatten(), " ").flatten())):
            counts = words.value_counts()
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(counts), kind, np.int32)), *counts.flatten()], names=["kind", "token", "n"])


class Words(NamedTuple):
    """Canonical words in their order; ``hash``: of each, of its first and of its last three letters; ``token``, ``n``,
    ``code``: the words that lead to them, how often their canonical ones occur and the numbers of these."""

    words: pa.Array
    hash: np.ndarray
    token: pa.Array
    n: np.ndarray
    code: np.ndarray


def _coded(canonical: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The different words in their order, and the number there of each of ``canonical``."""
    coded = canonical.dictionary_encode()
    order = pc.sort_indices(coded.dictionary).to_numpy()
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return coded.dictionary.take(pa.array(order)), place[coded.indices.to_numpy(zero_copy_only=False)]


def _hashes(words: pa.Array) -> np.ndarray:
    return np.array([(xxh3_64_intdigest(w), xxh3_64_intdigest("<" + w[:3]), xxh3_64_intdigest(">" + w[-3:])) for w in words.to_pylist()], np.uint64).reshape(-1, 3)


def _vocabulary(table: pa.Table) -> Words:
    """Of (token, n, canonical) of one kind."""
    words, code = _coded(table["canonical"].combine_chunks())
    return Words(words, _hashes(words), table["token"].combine_chunks(), table["n"].to_numpy(), code)


def _sizes(lists: pa.ListArray) -> np.ndarray:
    return pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)


def _lists(row: np.ndarray, values: pa.Array, rows: int) -> pa.ListArray:
    """The values of each row; ``row`` ascends."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.bincount(row, minlength=rows))]).astype(np.int32)), values)


def _first_of(row: np.ndarray, code: np.ndarray) -> np.ndarray:
    """Where each code is for the first time in its row."""
    _, first = np.unique(row * (code.max(initial=0) + 1) + code, return_index=True)
    return np.sort(first)


def _rank(batches: Iterator[pa.RecordBatch], total: int, known: list[Words] | None = None) -> Iterator[pa.RecordBatch]:
    """What ``ranked`` adds, for many representatives at once. ``known``: the vocabulary of titles and of names; without
    it ``w0`` and ``w1`` hold (at, n, canonical) of the words of each."""
    for whole in batches:
        work = np.cumsum(_sizes(whole.column("tokens")) * (_sizes(whole.column("ends")) + _sizes(whole.column("names")) + 1)) // AT_ONCE
        for start, end in zip(*(lambda at: (at, [*at[1:], len(work)]))([0, *(np.flatnonzero(np.diff(work)) + 1)] if len(work) else [])):
            batch = whole.slice(start, end - start)
            rows, each = len(batch), []
            names = batch.column("names")
            for kind in (0, 1):
                if known is None:
                    lists = batch.column(f"w{kind}")
                    at, n, canonical = (lists.flatten().field(c) for c in range(3))
                    words, code = _coded(canonical)
                    each.append((np.repeat(np.arange(rows), _sizes(lists)), at.to_numpy(), n.to_numpy(), code, words, _hashes(words)))
                    continue
                lists = pc.split_pattern(names.flatten(), " ") if kind else batch.column("tokens")
                outer = np.repeat(np.arange(rows), _sizes(names)) if kind else np.arange(rows)
                inner = np.repeat(np.arange(len(lists)), _sizes(lists))
                found = pc.index_in(lists.flatten(), value_set=known[kind].token).to_numpy(zero_copy_only=False)
                own = _sizes(names) if kind else _sizes(lists)  # authors or tokens of a row, numbered from 0 in each
                at = np.arange(own.sum()) - np.repeat(np.cumsum(own) - own, own)
                each.append((outer[inner], at[inner] if kind else at, known[kind].n[found], known[kind].code[found], known[kind].words, known[kind].hash))
            titles, chosen = _title_ranks(rows, batch.column("ends"), total, *each[0])
            n, who = _name_ranks(rows, total, *each[1])
            keys = _keys(rows, pc.equal(batch.column("side"), "a").to_numpy(zero_copy_only=False), chosen, *who)
            columns = {c: x for c, x in zip(batch.schema.names, batch.columns) if c not in ("w0", "w1")}
            columns |= {"t": titles["t"], "first": titles["first"], "n": n, "bits": titles["bits"]} | keys
            yield pa.RecordBatch.from_arrays([*columns.values()], names=[*columns])


Chosen = tuple[np.ndarray, np.ndarray]


def _title_ranks(rows: int, ends: pa.ListArray, total: int, row: np.ndarray, at: np.ndarray, n: np.ndarray, code: np.ndarray, words: pa.Array, hashes: np.ndarray) -> tuple[dict[str, pa.Array], dict[str, Chosen]]:
    """The columns of titles; and (row, hash) of their rarest words, ``first``, of those that hold half of the information of
    the whole title or of what stands before a subtitle, ``telling``, ``rest`` without ``first``, and of the rarer half of
    either, ``rarer``."""
    order = np.lexsort((code, n, row))
    row, at, n, code = row[order], at[order], n[order], code[order]
    # a cut of a row is the whole title or what stands before a subtitle
    end, of = ends.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(rows), _sizes(ends))
    of, end = np.concatenate([np.arange(rows), of[end > 0]]), np.concatenate([np.bincount(row, minlength=rows), end[end > 0]])
    order = np.argsort(of, kind="stable")
    order = order[_first_of(of[order], end[order])]
    of, end = of[order], end[order]
    cuts = np.bincount(of, minlength=rows)
    begin = np.cumsum(cuts) - cuts
    # each word in all cuts that hold it; equals stand together and count once
    k = cuts[row]
    word = np.repeat(np.arange(len(row)), k)
    cut = begin[row[word]] + np.arange(len(word)) - np.repeat(np.cumsum(k) - k, k)
    inside = at[word] < end[cut]
    word, cut = word[inside], cut[inside]
    order = np.argsort(cut, kind="stable")
    word, cut = word[order], cut[order]
    once = np.ones(len(word), bool)
    once[1:] = (cut[1:] != cut[:-1]) | (code[word[1:]] != code[word[:-1]])
    word, cut = word[once], cut[once]
    size = np.bincount(cut, minlength=len(of))
    start = np.cumsum(size) - size
    place = np.arange(len(cut)) - start[cut]
    # the information of the words before each, summed in their order
    weight = np.maximum(0.0, np.log(total / n[word]))
    before, some = np.zeros(len(word)), np.flatnonzero(size > 1)
    for i in range(1, size.max(initial=0)):
        some = some[size[some] > i]
        before[start[some] + i] = before[start[some] + i - 1] + weight[start[some] + i - 1]
    half = np.zeros(len(of))
    last = (start + size - 1)[size > 0]
    half[size > 0] = (before[last] + weight[last]) / 2
    code, row = code[word], of[cut]
    out, hashed, number, whole = {}, {}, {}, cut == begin[row]
    for name, chosen in (("t", whole), ("first", place == 0), ("telling", before <= half[cut]), ("rarer", place * 2 < size[cut])):
        r, c = row[chosen], code[chosen]
        once = _first_of(r, c)
        r, c = r[once], c[once]
        hashed[name], number[name] = (r, hashes[c, 0]), r * len(words) + c
        if name in ("t", "first"):
            out[name] = _lists(r, words.take(pa.array(c)), rows)
    rest = ~np.isin(number["telling"], number["first"])
    hashed["rest"] = tuple(x[rest] for x in hashed["telling"])
    bits = np.zeros(rows, np.uint64)
    np.bitwise_or.at(bits, row[whole], np.uint64(1) << (hashes[code[whole], 0] % np.uint64(64)))
    return out | {"bits": pa.array(bits.view(np.int64))}, hashed


def _name_ranks(rows: int, total: int, row: np.ndarray, at: np.ndarray, n: np.ndarray, code: np.ndarray, words: pa.Array, hashes: np.ndarray) -> tuple[pa.ListArray, tuple[Chosen, Chosen]]:
    """The words of each author; and (row, hash) of those that are not common and of their beginnings and ends."""
    order = np.lexsort((at, code, n, row))
    row, at, n, code = row[order], at[order], n[order], code[order]
    rare = n <= COMMON * total
    once = np.flatnonzero(rare)[_first_of(row[rare], code[rare])]
    known = row[once], hashes[code[once], 0]
    of, affix = np.repeat(row[once], 2), hashes[code[once], 1:].ravel()
    order = np.lexsort((affix, of))
    of, affix = of[order], affix[order]
    once = np.ones(len(of), bool)
    once[1:] = (of[1:] != of[:-1]) | (affix[1:] != affix[:-1])
    # authors in the order of their rarest words
    _, first, author = np.unique(row * (at.max(initial=0) + 1) + at, return_index=True, return_inverse=True)
    place = np.empty(len(first), np.int64)
    place[np.argsort(first)] = np.arange(len(first))
    author = place[author]
    order = np.argsort(author, kind="stable")
    author, code = author[order], code[order]
    new = np.ones(len(code), bool)
    new[1:] = (author[1:] != author[:-1]) | (code[1:] != code[:-1])
    each = _lists(author[new], words.take(pa.array(code[new])), len(first))
    return _lists(row[np.sort(first)], each, rows), (known, (of[once], affix[once]))


def _joined(*parts: Chosen) -> Chosen:
    row, value = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(row, kind="stable")
    return row[order], value[order]


def _keys(rows: int, a: np.ndarray, titles: dict[str, Chosen], known: Chosen, affixes: Chosen) -> dict[str, pa.ListArray]:
    """The hashes by which the representatives of one side meet those of the other; ``a``: which are of side a. A key is one of
    ``telling`` with one of ``who`` or one of ``rarer`` with one of ``words``.

    Way 0: the rarest token of a's is among b's telling ones; 1: b's among a's, without those of way 0; both with how a name
    begins or ends. 2: the rarer tokens, with a word of a name; the last bit of these is 1, of others 0. Where one lacks
    authors, the other side's representatives meet it by the sign for that: both sides have the sign for a lack of the other
    side, and their own where they lack them themselves."""
    nobody = np.bincount(known[0], minlength=rows) == 0
    sign = lambda which, text: (at := np.flatnonzero(which), np.full(len(at), xxh3_64_intdigest(text), np.uint64))
    of = lambda x, which: (x[0][which[x[0]]], x[1][which[x[0]]])
    mixed = lambda x, way: (x[0], (x[1] ^ x[1] >> np.uint64(31)) * np.uint64((0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)[way]) & ~np.uint64(1) | np.uint64(way == 2))
    even = lambda x: (x[0], x[1] & ~np.uint64(1))
    parts = {
        "telling": _joined(*(mixed(of(titles[t], which), way) for t, which, way in (("first", a, 0), ("telling", ~a, 0), ("rest", a, 1), ("first", ~a, 1)))),
        "who": even(_joined(affixes, sign(nobody & a | ~nobody & ~a, "\x1fna"), sign(a | nobody, "\x1fnb"))),
        "rarer": mixed(titles["rarer"], 2),
        "words": even(_joined(known, sign(nobody, "\x1fn"))),
    }
    return {c: _lists(row, pa.array(value.view(np.int64)), rows) for c, (row, value) in parts.items()}


def keyed(titles: DataFrame, side: str) -> DataFrame:
    """(side, side_year, side_bits, side_size, key) of the representatives of one side, 'a' or 'b'."""
    own = [F.col("no").alias(side), F.col("year").alias(f"{side}_year"), F.col("bits").alias(f"{side}_bits"), F.size("t").alias(f"{side}_size")]
    of = titles.where(F.col("side") == side)
    met = lambda tokens, people: of.select(*own, F.explode(tokens).alias("token"), people).withColumn("person", F.explode(people)).drop(people)
    return met("telling", "who").unionByName(met("rarer", "words")).withColumn("key", F.col("token").bitwiseXOR(F.col("person"))).drop("token", "person")


def candidates(titles: DataFrame) -> DataFrame:
    """(a, b): the pairs of representatives of the two sides that share a key and are no more than YEARS apart, without
    those met by tokens of which more than half of the smaller title's are not in the other, as their bits show;
    ``titles`` as of ``ranked``."""
    close = F.coalesce(F.abs(F.col("a_year") - F.col("b_year")) <= YEARS, F.lit(True))
    missing = lambda p, q: F.bit_count(F.col(f"{p}_bits").bitwiseAND(F.bitwise_not(F.col(f"{q}_bits")))) * 2 < F.col(f"{p}_size")
    most = F.when(F.col("a_size") <= F.col("b_size"), missing("a", "b")).otherwise(missing("b", "a"))
    by_most = F.col("key").bitwiseAND(1) == 1
    met = keyed(titles, "a").join(keyed(titles, "b"), "key").where(close & (~by_most | most))
    return met.select("a", "b").distinct()


def rarest(p: Column, q: Column) -> Column:
    """Whether the rarest token of one title is among the rarest of the other."""
    first = lambda u, v: F.array_contains(F.slice(u, 1, KEYS), F.get(v, F.lit(0)))
    return first(p, q) | first(q, p)


def damaged(p: Column, q: Column) -> Column:
    """Whether the tokens that two titles do not share look damaged."""
    like = lambda u, v: F.levenshtein(u, v) * 3 <= F.greatest(F.length(u), F.length(v))
    all_like = lambda few, many: F.forall(few, lambda u: F.exists(many, lambda v: like(u, v)))
    r, s = F.array_except(p, q), F.array_except(q, p)
    return F.when(F.size(r) <= F.size(s), all_like(r, s)).otherwise(all_like(s, r))


FUNCTIONS = ("main", "tokens", "letters", "year", "names", "part", "end", "words", "rare")


def _same(x: str, y: str) -> bool:
    return x == y or len(x) > 3 and len(y) > 3 and within_one(x, y)


def _matched(x: list[str], y: list[str]) -> int:
    """Tokens that two lists share, those within one edit of each other too."""
    rest, odd, n = list(y), [], 0
    for w in x:
        if w in rest:
            rest.remove(w)
            n += 1
        else:
            odd.append(w)
    for w in odd:
        near = next((v for v in rest if _same(w, v)), None)
        if near is not None:
            rest.remove(near)
            n += 1
    return n


def _grams(text: str) -> set[str]:
    return {text[i : i + 3] for i in range(max(1, len(text) - 2))}


def votes(a: dict, b: dict, rare: int) -> list[int]:
    """1, -1 or 0 of each of FUNCTIONS for two representatives; ``rare`` is 1 where the rarest token of one is among the
    rarest of the other, else 0."""
    x, y = a["tokens"], b["tokens"]
    bare = len(x) < len(y) and len(x) in b["ends"] or len(y) < len(x) and len(y) in a["ends"]  # one has no subtitle
    least = min(len(x), len(y))
    cut_a, cut_b = (least, least) if bare else ((a["ends"] or [len(x)])[0], (b["ends"] or [len(y)])[0])
    mx, my = x[:cut_a], y[:cut_b]
    out = []
    if mx == my and (bare or x == y):
        out += [1, 1, 1]
    elif len(set(x) & set(y)) * 3 < min(len(set(x)), len(set(y))):
        out += [-1, -1, -1]  # far off; nothing below could change that
    else:
        n = _matched(mx, my)
        out.append(1 if n == len(mx) == len(my) else -1 if n < 0.8 * min(len(mx), len(my)) else 0)
        common = n if bare else _matched(x, y)
        share = common / max(1, least if bare else len(x) + len(y) - common)
        out.append(1 if share >= 0.85 else -1 if share < 0.7 else 0)
        s, t = ("".join(mx), "".join(my)) if bare else ("".join(x), "".join(y))
        p, q = _grams(s), _grams(t)
        ratio = 1.0 if s == t else 2 * len(p & q) / (len(p) + len(q))
        out.append(1 if ratio >= 0.8 else -1 if ratio < 0.65 else 0)
    gap = abs(a["year"] - b["year"]) if a["year"] is not None and b["year"] is not None else None
    out.append(0 if gap is None or gap == YEARS else 1 if gap < YEARS else -1)
    p, q = a["n"], b["n"]
    hits = sum(any(_same(u, v) for j in q for u in i[:2] for v in j[:2]) for i in p)
    out.append(0 if not p or not q else 1 if hits >= 0.5 * min(len(p), len(q)) else -1 if not hits else 0)
    out.append(-1 if a["part"] != b["part"] else 1 if a["part"] else 0)
    u, v = x[-1], y[-1]
    out.append(0 if bare else 1 if _same(u, v) or min(len(u), len(v)) > 3 and (u.startswith(v) or v.startswith(u)) else -1)
    longest = lambda w: max(w, key=lambda z: (len(z), z))
    la, lb = longest(mx or x), longest(my or y)
    out.append(1 if any(_same(la, w) for w in y) and any(_same(lb, w) for w in x) else -1)
    return [*out, rare]


class LabelModel:
    """A generative model of correlated votes, fitted by expectation maximisation on the counts of their patterns."""

    def __init__(self, patterns: np.ndarray, counts: np.ndarray, rounds: int = ROUNDS) -> None:
        self.v = patterns.astype(int) + 1  # 0 no, 1 nothing, 2 yes
        self.n = counts.astype(float)
        k = self.v.shape[1]
        agree = patterns.sum(axis=1)
        post = 1 / (1 + np.exp(-np.clip(agree - 0.25 * k, -20, 20) * 1.5))  # the majority to begin with
        self.parent = [-1] * k
        for r in range(rounds):
            if r == rounds // 3:
                self.parent = self._tree(post)  # the correlations, once the classes stand apart
            self._fit(post)
            post = self.posterior(self.v)
        self.post = post

    def _table(self, weight: np.ndarray, j: int, y: int) -> np.ndarray:
        """P(vote j | vote of its parent), smoothed."""
        p = self.parent[j]
        # what a function is for, worth a fiftieth of all candidates: its vote is right nine times of ten
        table = np.tile(np.array([0.1, 1.0, 0.9] if y else [0.9, 1.0, 0.1]) * (0.02 * self.n.sum() + 1), (3, 1)) / 2
        np.add.at(table, (self.v[:, p] if p >= 0 else np.zeros(len(self.v), int), self.v[:, j]), weight)
        if p < 0:
            table[:] = table[0]
        return table / table.sum(axis=1, keepdims=True)

    def _fit(self, post: np.ndarray) -> None:
        w = np.stack([self.n * (1 - post), self.n * post])
        self.prior = (w.sum(axis=1) + 1) / (w.sum() + 2)
        self.tables = [[self._table(w[y], j, y) for j in range(self.v.shape[1])] for y in (0, 1)]

    def posterior(self, v: np.ndarray) -> np.ndarray:
        logs = []
        for y in (0, 1):
            total = np.full(len(v), np.log(self.prior[y]))
            for j, p in enumerate(self.parent):
                total += np.log(self.tables[y][j][v[:, p] if p >= 0 else 0, v[:, j]])
            logs.append(total)
        return 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -500, 500)))

    def _tree(self, post: np.ndarray) -> list[int]:
        """The maximum spanning tree of the mutual information of the votes, given the truth."""
        k, info = self.v.shape[1], {}
        for i in range(k):
            for j in range(i):
                total = 0.0
                for w in (self.n * (1 - post), self.n * post):
                    joint = np.full((3, 3), 0.1)
                    np.add.at(joint, (self.v[:, i], self.v[:, j]), w)
                    share, joint = joint.sum(), joint / joint.sum()
                    total += share * (joint * np.log(joint / joint.sum(axis=1, keepdims=True) / joint.sum(axis=0, keepdims=True))).sum()
                info[i, j] = total / self.n.sum()
        parent, inside = [-1] * k, {0}
        while len(inside) < k:
            gain, i, j = max((g, *((a, b) if a not in inside else (b, a))) for (a, b), g in info.items() if (a in inside) != (b in inside))
            if gain > 0.005:
                parent[i] = j
            inside.add(i)
        return parent


def matched(a: DataFrame, b: DataFrame) -> DataFrame:
    """(a_id, b_id, confidence) of the rows of two tables (id, title, authors, date) that are candidates of one work
    and that no hard rule parts."""
    spark = a.sparkSession
    rows = {s: settle(prepared(df)) for s, df in (("a", a), ("b", b))}
    content = ["tokens", "ends", "part", "year", "names"]
    one = [df.groupBy("rep").agg(*(F.any_value(c).alias(c) for c in content)).withColumn("side", F.lit(s)) for s, df in rows.items()]
    flat = F.concat_ws("\x1f", F.array_join("tokens", " "), F.array_join(F.col("ends").cast("array<string>"), " "), "part", F.coalesce(F.col("year").cast("string"), F.lit("")), F.array_join(F.transform("n", lambda w: F.array_join(F.slice(w, 1, 2), " ")), ","))
    titles = ranked(settle(one[0].unionByName(one[1])))
    titles = settle(titles.select("no", "side", "rep", "year", "part", "t", "bits", "telling", "who", "rarer", "words", flat.alias("flat")))
    side = {s: titles.where(F.col("side") == s).select(F.col("no").alias(s), F.col("flat").alias(f"x_{s}"), F.col("year").alias(f"year_{s}"), F.col("part").alias(f"part_{s}"), F.col("t").alias(f"t_{s}")) for s in "ab"}
    pairs = candidates(titles).join(side["a"], "a").join(side["b"], "b")
    most = F.size(F.array_intersect("t_a", "t_b")) * 2 > F.least(F.size("t_a"), F.size("t_b"))
    rare = rarest(F.col("t_a"), F.col("t_b"))
    # in this order, so that each is asked for once, and letters are compared only where nothing else decides
    pairs = pairs.where(rare | most & damaged(F.col("t_a"), F.col("t_b"))).withColumn("rare", rare.cast("int"))
    far = F.abs(F.col("year_a") - F.col("year_b")) > YEARS
    other = F.coalesce(far, F.lit(False)) | (F.col("part_a") != F.col("part_b"))

    def read(flat: str) -> dict:
        tokens, ends, part, year, names = flat.split("\x1f")
        return {"tokens": tokens.split(" "), "ends": [int(e) for e in ends.split()], "part": part, "year": int(year) if year else None, "n": [n.split(" ") for n in names.split(",") if n]}

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [votes(read(x), read(y), r) for x, y, r in zip(*(batch.column(c).to_pylist() for c in ("x_a", "x_b", "rare")))]
            code = [sum((v + 1) * 3**j for j, v in enumerate(x)) for x in found]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), batch.column("other"), pa.array(code, pa.int32())], names=["a", "b", "other", "pattern"])

    voted = settle(pairs.withColumn("other", other).select("a", "b", "x_a", "x_b", "rare", "other").mapInArrow(judge, "a bigint, b bigint, other boolean, pattern int"))
    counts = voted.groupBy("pattern").agg(F.count("*").alias("n")).orderBy("pattern").collect()
    schema = "pattern int, confidence double"
    if not counts:
        return spark.createDataFrame([], "a_id bigint, b_id bigint, confidence double")
    grid = np.array([[r["pattern"] // 3**j % 3 - 1 for j in range(len(FUNCTIONS))] for r in counts])
    model = LabelModel(grid, np.array([r["n"] for r in counts]))
    known = spark.createDataFrame(pd.DataFrame({"pattern": np.array([r["pattern"] for r in counts], np.int32), "confidence": model.post}), schema)
    linked = voted.where(~F.col("other")).join(F.broadcast(known), "pattern")  # at most 3 ** 9 patterns
    ids = {s: df.select("rep", F.col("id").alias(f"{s}_id")).join(titles.where(F.col("side") == s).select("rep", F.col("no").alias(s)), "rep").drop("rep") for s, df in rows.items()}
    return linked.join(ids["a"], "a").join(ids["b"], "b").select("a_id", "b_id", F.round("confidence", 6).alias("confidence"))
