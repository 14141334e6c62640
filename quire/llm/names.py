"""Variant spellings of names linked to the entries of a catalogue, by a trie join.

The catalogue's surnames and organisations are kept in tries, one per shard of the alphabet of lengths; a Levenshtein
automaton (with neighbouring letters swapped as one edit) walks each trie and enumerates the surnames within the
bound. The orders that the tokens of a mention can stand in (given name first or last, with or without a comma,
particles on either side) are then checked against the given names: equal, an initial, a nickname or within the bound,
with no initial against another.

Only distinct spellings are resolved, each once, after a pre-aggregation that takes a hot name out; the result is
joined back to the mentions. The catalogue goes to the executors in blocks of bounded size, one pass each, and a
mention takes the best entry of all blocks. Defined results: null and empty names, and names that fit two entries
equally well, mean nobody; empty catalogues match nothing; repeated rows come out alike; long names are read whole.
"""

from __future__ import annotations

import re
import unicodedata
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.encoding import repair

#: Edits in each part of a name (surname, given name), least letters of a part that may hold one, entries of one
#: catalogue block.
EDITS, LEAST_LETTERS, BLOCK = 1, 4, 100_000

# Given names and their short forms.
_NICK = {
    "albert": "al bert bertie", "aleksander": "alex sasha sascha aleks", "alexander": "alex sascha", "antonia": "toni tonia", "barbara": "barb babs barbie", "charles": "charlie chuck chas carl",
    "christina": "chris tina", "dolores": "lola dolly", "eleanor": "nell ellie nora ellen", "elisabeth": "lisa beth betty liz elsa lisbeth eliza", "elizabeth": "lisa beth betty liz eliza",
    "francisco": "paco pancho frank cisco", "fredrik": "fred freddie rik fritz", "frederick": "fred freddie", "gabriel": "gabe", "helene": "lena nell helen", "henrietta": "etta hetty hettie",
    "ingrid": "inga inger", "james": "jim jimmy", "johannes": "hans hannes jo johan", "john": "jack johnny", "jorg": "jorgen", "josefina": "fina josie pepa josy", "katherine": "kate kathy katie kat", "kristina": "kris tina stina kirsti",
    "ludovic": "ludo", "margaret": "peggy maggie meg greta", "maximilian": "max", "michael": "mike mick mikey", "nikolaus": "klaus niko nick nico", "oskar": "ossi", "quentin": "quent",
    "richard": "dick rick richie rich", "robert": "bob rob bobby bert bertie", "rut": "ruth", "susanna": "sanna sue susie suse", "theodore": "ted theo teddy", "thomas": "tom tommy", "ulla": "ulrika",
    "victoria": "vicky vicki tori", "viggo": "vig", "wilhelmina": "mina minna willa wilma", "william": "bill will willy billy liam", "xavier": "xavi", "inaki": "ignacio",
}
_LONG: dict[str, set[str]] = {}
for _full, _all in _NICK.items():
    for _s in _all.split():
        _LONG.setdefault(_s, set()).add(_full)

_FOLD = str.maketrans({"ø": "o", "æ": "ae", "œ": "oe", "ß": "ss", "đ": "d", "ł": "l", "ð": "d", "þ": "th", "ı": "i"})
#: Titles, roles and years beside a name. Two capitals without a stop behind a surname are initials, not a role.
_ROLE = re.compile(
    r"^(?:(?i:prof(?:essor)?|dr|fil|sir|mr|mrs|ms|dipl)\.?\s+(?:(?i:dr|phil|med)\.?\s+)*)+"
    r"|(?:^|(?<=[\s,;(]))(?:[Pp]rof(?:essor)?\.?|[Dd]r\.|Dr|[Ff]il\.\s*dr\.?|[Pp]h\.?\s?[Dd]\.?|[Jj]r\.?|[Ss]r\.?|Dipl\.|[Hh]rsg\.?|\(?[Ee]ds?\.\)?|\([Ee]ds?\)|\(?[Rr]ed\.\)?|e\.\s?[Vv]\.?"
    r"|\(?[Pp]ubl\.?\)?|\(author\)|\(?[Uu]tg\.\)?|\(?[Hh]g\.\)?|\d{4}\s*[-–]\s*(?:\d{4})?)(?=$|[\s,;)])\)?"
)
_SMALL = {"the", "of", "on", "in", "and", "for", "f", "a", "an", "at"}
_ABBREVIATED = {"univ": "university", "inst": "institute", "dept": "department", "dep": "department", "assoc": "association", "soc": "society", "res": "research", "ctr": "centre", "center": "centre", "natl": "national", "nat": "national", "comm": "committee", "coll": "college", "pr": "press", "stud": "studies", "her": "heritage", "roy": "royal", "ass": "association"}


def fold(text: str) -> str:
    """Lower case without accents."""
    if text.isascii():
        return text.lower()
    text = unicodedata.normalize("NFKD", text.casefold()).translate(_FOLD)
    return "".join(c for c in text if not unicodedata.combining(c) and unicodedata.category(c) != "Cf")


_SPELT = str.maketrans({"ä": "ae", "ö": "oe", "ü": "ue", "ø": "oe", "å": "aa"})


def spellings(text: str) -> list[str]:
    """The folded forms of a name, with its umlauts as plain letters and as two."""
    low = unicodedata.normalize("NFC", text.casefold())
    return list(dict.fromkeys((fold(low), fold(low.translate(_SPELT)))))


def edits(a: str, b: str, most: int) -> int:
    """Edit distance with swapped neighbours as one; ``most`` + 1 if it is more."""
    if a == b:
        return 0
    if most == 1:
        return 1 if within_one(a, b) else 2
    if abs(len(a) - len(b)) > most:
        return most + 1
    two, one = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            d = min(one[j] + 1, now[-1] + 1, one[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, two[j - 2] + 1)
            now.append(d)
        if min(now) > most:
            return most + 1
        two, one = one, now
    return min(one[-1], most + 1)


def within_one(a: str, b: str) -> bool:
    """Whether two strings are at most one edit apart, a swap of neighbours being one."""
    if a == b:
        return True
    n, m = len(a), len(b)
    if not -2 < n - m < 2:
        return False
    i, least = 0, min(n, m)
    while i < least and a[i] == b[i]:
        i += 1
    if n == m:
        return a[i + 1 :] == b[i + 1 :] or a[i : i + 2] == b[i : i + 2][::-1] and a[i + 2 :] == b[i + 2 :]
    return a[i + 1 :] == b[i:] if n > m else a[i:] == b[i + 1 :]


class Trie:
    """Keys with a walk that enumerates those within some edits."""

    def __init__(self, keys: Iterator[str]) -> None:
        self.root: dict = {}
        for key in keys:
            node = self.root
            for c in key:
                node = node.setdefault(c, {})
            node[""] = key

    def near(self, word: str, most: int) -> list[tuple[int, str]]:
        """(edits, key) of the keys within ``most`` edits of ``word``.

        The automaton's state is the set of (letters read, edits) that are still within the bound."""
        found: dict[str, int] = {}
        n = len(word)
        start = {i: i for i in range(min(most, n) + 1)}
        stack = [(self.root, start, None, "")]
        while stack:
            node, state, before, last = stack.pop()
            if "" in node and (d := state.get(n)) is not None:
                found[node[""]] = min(d, found.get(node[""], d))
            for c, child in node.items():
                if not c:
                    continue
                new: dict[int, int] = {}
                for i, d in state.items():
                    if i < n and word[i] == c and d < new.get(i + 1, 99):
                        new[i + 1] = d
                    if d < most:
                        if d + 1 < new.get(i, 99):
                            new[i] = d + 1  # a letter more in the key
                        if i < n and d + 1 < new.get(i + 1, 99):
                            new[i + 1] = d + 1
                if before is not None:
                    for i, d in before.items():
                        if d < most and i + 1 < n and word[i] == c and word[i + 1] == last and d + 1 < new.get(i + 2, 99):
                            new[i + 2] = d + 1
                for i in sorted(new):  # letters of the word that the key lacks
                    d = new[i]
                    if d < most and i < n and d + 1 < new.get(i + 1, 99):
                        new[i + 1] = d + 1
                if new:
                    stack.append((child, new, state, c))
        return [(d, k) for k, d in found.items()]


def parts(given: str) -> list[str]:
    """Tokens of a folded given name."""
    return [x for x in re.split(r"[\s.,;]+", given) if x and x != "-"]


def initials(tokens: list[str]) -> list[str]:
    return [p[0] for t in tokens for p in t.split("-") if p]


def given_cost(mention: list[str], entry: list[str], block: str) -> int | None:
    """Edits between two given names; None if they are different. ``block`` is the mention's given name as written."""
    if not mention or not entry:
        return None
    first = mention[0].strip("-")
    if not first:
        return None
    short = all(len(p) == 1 for t in mention for p in t.split("-") if p) or (len(mention) == 1 and len(first) <= 3 and block.isupper() and first != entry[0])
    own = initials(entry)
    if short:
        letters = [c for t in mention for c in t if c.isalpha()]
        firsts = len([p for p in entry[0].split("-") if p])
        if not letters or not own or letters[0] != own[0]:
            return None
        if len(letters) == 1:
            return 0
        for k in {1, firsts}:  # with or without the second half of a double name
            rest, known = letters[k:], own[firsts:]
            if letters[:k] == own[:k] and all(a == b for a, b in zip(rest, known)):
                return 0
        return None
    rest, known = [t[0] for t in mention[1:]], [t[0] for t in entry[1:]]
    if rest and known and rest[0] != known[0]:
        return None
    if len(rest) > 1:
        return None
    if any(len(t) > 1 for t in mention[1:]) and (not entry[1:] or len(entry[1]) > 1) and mention[1:] != entry[1:]:
        return None
    a, b = first, entry[0]
    if a == b or b in _LONG.get(a, ()) or "-" in b and "-" not in a and b.split("-")[0] in _LONG.get(a, ()):
        return 0
    if "-" in a and "-" in b and a.split("-")[1] == b.split("-")[1] and b.split("-")[0] in _LONG.get(a.split("-")[0], ()):
        return 0
    d = edits(a, b, EDITS)
    return d if d <= EDITS and min(len(a), len(b)) >= LEAST_LETTERS - 1 else None


class Catalogue:
    """Entries of one block: (author_id, name, last_name, first_name)."""

    def __init__(self, entries: list[tuple]) -> None:
        self.people: dict[str, list[tuple]] = {}
        self.bodies: dict[str, set] = {}
        for key, name, last, first in entries:
            if first:
                for surname in {self.surname(x) for x in spellings(last or "")}:
                    self.people.setdefault(surname, []).extend((key, parts(x)) for x in spellings(first))
            elif name:
                for form in self.forms(name):
                    self.bodies.setdefault(form, set()).add(key)
        self.shards = [Trie(k for k in self.people if len(k) % 4 == r) for r in range(4)]
        self.body_trie = Trie(k for k in self.bodies if "|" not in k)
        self.remembered: dict[str, list] = {}

    @staticmethod
    def surname(folded: str) -> str:
        return re.sub(r"[^\w]", "", folded)

    @staticmethod
    def words(name: str) -> list[str]:
        return [_ABBREVIATED.get(w, w) for w in re.findall(r"\w+", fold(name))]

    @classmethod
    def body(cls, name: str) -> str:
        """An organisation's words in their order, without the small ones."""
        return "".join(w for w in cls.words(name) if w not in _SMALL)

    @classmethod
    def forms(cls, name: str) -> set[str]:
        """Keys of an organisation: its words in order, in any order, and its initials with one of its words."""
        every = cls.words(name)
        words = [w for w in every if w not in _SMALL]
        out = {"".join(words), "|".join(sorted(words))}
        for short in {"".join(w[0] for w in words), "".join(w[0] for w in every)}:
            out |= {f"{short}|{w}" for w in words if len(w) > 4}
        return out

    def near(self, surname: str) -> list[tuple[int, str]]:
        """Surnames within the bound, from the shards of the lengths that can hold them."""
        if surname not in self.remembered:
            lengths = {(len(surname) + d) % 4 for d in range(-EDITS, EDITS + 1)}
            self.remembered[surname] = [x for r in lengths for x in self.shards[r].near(surname, EDITS)]
        return self.remembered[surname]

    def _splits(self, text: str) -> list[tuple[str, list[str], str]]:
        """(surname, given tokens, given as written) in every order that the tokens allow."""
        text = " ".join(text.split())
        if "," in text:
            left, right = (x.strip() for x in text.split(",", 1))
            right = right.strip(" ,")
            out = [(self.surname(fold(left)), parts(fold(right)), right)]
            words = right.split(" ")
            if len(words) > 1 and words[-1].islower():  # a particle behind the given name
                out.append((self.surname(fold(words[-1] + left)), parts(fold(" ".join(words[:-1]))), " ".join(words[:-1])))
            return out
        words = text.split(" ")
        out = []
        for i in range(1, len(words)):
            for last, given in ((words[i:], words[:i]), (words[:i], words[i:])):
                if any(len(w.strip(".")) < 2 and (w.endswith(".") or not w.islower()) for w in last):
                    continue  # an initial is no part of a surname
                g = " ".join(given)
                out.append((self.surname(fold("".join(last))), parts(fold(g)), g))
        return out

    def resolve(self, name: str | None) -> tuple[int, object] | None:
        """(edits, author_id) of the entry that the name means; None if it means nobody or two."""
        if not name or not name.strip():
            return None
        text = _ROLE.sub(" ", unicodedata.normalize("NFKC", name)).strip(" ,;()")
        if not text:
            return None
        words = [w for w in self.words(text) if w not in _SMALL]
        body = "".join(words)
        for form in (body, "|".join(sorted(words)), "|".join(words) if len(words) == 2 else ""):
            if form in self.bodies:
                return self._only([(0, k) for k in self.bodies[form]])
        splits = [x for x in self._splits(text) if x[0] and x[1]]
        found = [(g, key) for last, given, block in splits for key, entry in self.people.get(last, ()) if (g := given_cost(given, entry, block)) is not None]
        if not found:
            for last, given, block in splits:
                if len(last) >= LEAST_LETTERS:
                    for d, near in self.near(last):
                        found += [(d + g, key) for key, entry in self.people[near] if (g := given_cost(given, entry, block)) is not None]
        if not found and len(body) >= 15:
            found = [(d, k) for d, near in self.body_trie.near(body, EDITS) for k in self.bodies[near]]
        return self._only(found)

    @staticmethod
    def _only(found: list[tuple]) -> tuple | None:
        if not found:
            return None
        least = min(d for d, _ in found)
        keys = {k for d, k in found if d == least}
        return (least, keys.pop()) if len(keys) == 1 else (least, None)


def _blocks(catalogue: DataFrame, size: int) -> Iterator[list[tuple]]:
    block = []
    for r in catalogue.select("author_id", "name", "last_name", "first_name").toLocalIterator():
        block.append(tuple(r))
        if len(block) >= size:
            yield block
            block = []
    if block:
        yield block


_BUILT: dict[str, Catalogue] = {}  # a worker builds the tries of a block once


def resolved(names: DataFrame, catalogue: DataFrame, block: int = BLOCK) -> DataFrame:
    """(name, author_id) of every distinct spelling in ``names`` (one column, name) that means a catalogue entry and is
    not garbled. Names are taken once."""
    spark = names.sparkSession
    # spread anew: spellings are few bytes and much work, which sizes of partitions do not show
    distinct = names.where(F.col("name").isNotNull()).distinct().repartition(2 * spark.sparkContext.defaultParallelism)
    found = None
    for entries in _blocks(catalogue, block):
        sent, mark = spark.sparkContext.broadcast(entries), uuid.uuid4().hex

        def link(batches: Iterator[pa.RecordBatch], sent=sent, mark=mark) -> Iterator[pa.RecordBatch]:
            if mark not in _BUILT:
                _BUILT.clear()
                _BUILT[mark] = Catalogue(sent.value)
            own = _BUILT[mark]
            for batch in batches:
                rows = [(x, *r) for x in batch.column(0).to_pylist() if (r := own.resolve(x)) and not repair(x)[0]]
                cols = list(zip(*rows)) or [[]] * 3
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int64())], names=["name", "edits", "author_id"])

        part = distinct.mapInArrow(link, "name string, edits int, author_id bigint")
        found = part if found is None else found.unionAll(part)
    if found is None:
        return spark.createDataFrame([], "name string, author_id bigint")
    best = found.groupBy("name").agg(F.min(F.struct("edits", "author_id")).alias("a"), F.max_by("author_id", F.struct(-F.col("edits"), "author_id")).alias("b"), F.count("*").alias("n"))
    return best.where(F.col("a.author_id") == F.col("b")).select("name", F.col("a.author_id").alias("author_id"))


def linked(mentions: DataFrame, catalogue: DataFrame, block: int = BLOCK) -> DataFrame:
    """``mentions`` (any columns, name) with author_id, of those that mean an entry but are not its name to the letter.

    A column author_id that is there already is replaced."""
    mentions = mentions.drop("author_id")
    own = catalogue.select(F.col("name")).where(F.col("name").isNotNull()).distinct()
    variants = mentions.join(own, "name", "left_anti")
    return variants.join(resolved(variants.select("name"), catalogue, block), "name")
