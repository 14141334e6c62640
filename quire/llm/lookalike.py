"""Text that looks the same brought to one form of characters.

Look-alike classes are computed by union-find over code points and strings: a compatibility form and what it stands
for, a letter with combining accents and the letter in one piece, letters of other scripts and the Latin letters they
look like, special spaces and the plain one, invisible characters and nothing. The classes are transitive; each is
represented by its member that is most frequent over all texts. All other members are the patterns of one
Aho-Corasick automaton, which rewrites each text from left to right, the longest first.

Letters of another script are rewritten only inside words that also hold letters of the representative's script; a
word wholly in one script is what it seems. Curly quotes, dashes and accented letters in one piece are plain.

The frequencies are summed per batch before one shuffle of a row per character; what reaches the driver is a row per
distinct character or accented cluster, bounded by Unicode and not by the corpus. Defined results: null stays null,
empty stays empty; long texts are rewritten whole; repeated rows come out alike.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Letters of other scripts, and the Latin letters that they look like, in pairs.
_ALIKE = (
    "аa вb еe ёë іi їï јj кk оo рp сc тt уy хx һh ѕs ԁd ԛq ԝw ӏl "
    "АA ВB ЕE ЁË ІI ЇÏ ЈJ КK МM НH ОO РP СC ТT УY ХX ЅS ЗЗ ҮY ԌG ԚQ ԜW ӀI "
    "αa γy ιi κk νv οo ρp τt υu χx ωw ϲc ϳj "
    "ΑA ΒB ΕE ΖZ ΗH ΙI ΚK ΜM ΝN ΟO ΡP ΤT ΥY ΧX ϹC "
    "ɑa ɡg ɩi ʟL ӕæ ӔÆ օo սu ոn հh ցg ՏS ՍU ՕO"
)
_MARKED = re.compile(r"[^\W_][̀-ͯ]+")
_TAGS = ("<wide>", "<narrow>", "<font>", "<noBreak>", "<compat>", "<isolated>", "<initial>", "<medial>", "<final>")


def plain_form(c: str) -> str | None:
    """What a code point or accented cluster stands for if a reader can't tell it from that; else None."""
    if len(c) > 1:
        joined = unicodedata.normalize("NFC", c)
        return joined if joined != c else None
    kind = unicodedata.category(c)
    if kind == "Cf" or c in "͏ᅟᅠ឴឵ㅤﾠ" or 0xFE00 <= ord(c) <= 0xFE0F:
        return ""
    if kind == "Zs":
        return " " if c != " " else None
    parts = unicodedata.decomposition(c).split()
    if not parts or kind == "Pd":
        return None
    if parts[0][0] != "<":
        return unicodedata.normalize("NFC", c) if len(parts) == 1 else None  # a copy of another letter
    if parts[0] not in _TAGS:
        return None
    form = unicodedata.normalize("NFKC", c)
    if parts[0] == "<compat>" and not form.isalpha():
        return None  # an ellipsis, a free-standing accent and the like
    return form


#: What the compatibility letters of several letters stand for, such as the ligatures.
_JOINED = sorted({f for c in map(chr, (*range(0x100, 0x2200), *range(0xFB00, 0xFB07))) if (f := plain_form(c)) and len(f) > 1 and f.isascii()})


class Classes:
    """Union-find over strings."""

    def __init__(self) -> None:
        self.up: dict[str, str] = {}

    def find(self, x: str) -> str:
        self.up.setdefault(x, x)
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def join(self, x: str, y: str) -> None:
        self.up[self.find(x)] = self.find(y)

    def members(self) -> dict[str, list[str]]:
        out: dict[str, list[str]] = {}
        for x in list(self.up):
            out.setdefault(self.find(x), []).append(x)
        return out


def script(c: str) -> str:
    """The script of a letter, by its name; '' for all else."""
    return unicodedata.name(c, "").split(" ")[0] if c.isalpha() else ""


def representatives(counts: dict[str, int]) -> dict[str, str]:
    """Pattern -> representative, for every observed member of every class that is not its representative."""
    classes = Classes()
    for pair in _ALIKE.split():
        if len(pair) == 2:
            classes.join(pair[0], pair[1])
    for s in counts:
        form = plain_form(s)
        if form is not None:
            classes.join(s, form)
            if len(form) == 1 and plain_form(form) is not None:
                classes.join(form, plain_form(form))
    out = {}
    for members in classes.members().values():
        # nothing at all is more frequent than anything; then the corpus decides, then the lower code point
        best = "" if "" in members else min(members, key=lambda m: (-counts.get(m, 0), len(m), m))
        out |= {m: best for m in members if m != best and counts.get(m)}
    return out


class Rewriter:
    """Rewrites texts with the automaton of the patterns."""

    def __init__(self, forms: dict[str, str]) -> None:
        self.forms = {k: v for k, v in forms.items() if k}
        self.plain = all(not k.isascii() for k in self.forms)  # no ASCII letter is rewritten, as is usual
        self.automaton = ahocorasick.Automaton()
        for k, v in self.forms.items():
            p, q = (unicodedata.normalize("NFKC", x) for x in (k, v))
            cross = len(p) == 1 and len(q) == 1 and script(p) != script(q)
            self.automaton.add_word(k, (len(k), v, script(v) if cross else ""))
        if self.forms:
            self.automaton.make_automaton()

    def __call__(self, text: str | None) -> str | None:
        """The one form of ``text``."""
        if not text or not self.forms or self.plain and text.isascii():
            return text
        out, at = [], 0
        for end, (length, form, other) in self.automaton.iter_long(text):
            start = end + 1 - length
            if other and not self._mixed(text, start, other):
                continue
            out.append(text[at:start])
            out.append(form)
            at = end + 1
        return "".join(out) + text[at:] if out else text

    def _mixed(self, text: str, at: int, other: str) -> bool:
        """Whether the word around ``at`` also holds letters of the other script."""
        a = b = at
        while a and (text[a - 1].isalpha() or plain_form(text[a - 1]) == "" or unicodedata.combining(text[a - 1])):
            a -= 1
        while b < len(text) and (text[b].isalpha() or plain_form(text[b]) == "" or unicodedata.combining(text[b])):
            b += 1
        return any(script(c) == other for c in text[a:b])


def string_counts(df: DataFrame, text_col: str) -> dict[str, int]:
    """How often each character, accented cluster and pair of letters that has a ligature stands in the texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = "\n".join(x for x in batch.column(0).to_pylist() if x)
            seen = Counter(text)
            seen.update(_MARKED.findall(text))
            seen.update({f: n for f in _JOINED if (n := text.count(f))})
            yield pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], names=["s", "n"])

    counted = df.select(F.col(text_col).cast("string")).mapInArrow(count, "s string, n bigint").groupBy("s").agg(F.sum("n").alias("n"))
    return {r["s"]: r["n"] for r in counted.collect()}


def consistent(df: DataFrame, text_col: str, counts: dict[str, int], out_col: str = "plain") -> DataFrame:
    """``df`` with the one form of its texts as another column, in place of one of that name."""
    forms = representatives(counts)
    df = df.drop(out_col) if out_col != text_col else df
    names = [f.name for f in df.schema.fields]
    at = names.index(text_col)

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Rewriter(forms)
        for batch in batches:
            plain = pa.array([own(x) for x in batch.column(at).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, plain], names=[*names, out_col])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInArrow(rewrite, f"{schema}, `{out_col}` string")
