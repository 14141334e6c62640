"""Text that was decoded with the wrong character encoding: found, and restored where it still can be.

Multibyte: for each legacy encoding the characters are mapped back to the bytes they stand for, and a byte-structure
automaton (the well-formed UTF-8 sequences of two to four bytes, as one regular expression) finds the maximal spans
that are multibyte text; those spans alone are decoded, everything around them stays. Spans must give plausible
characters. It is done again on the result, so text garbled twice is restored too.

Single-byte: bytes of a DOS code page read as Windows-1252 leave symbols where letters belong. A value with such a
symbol inside a word, at the end of a word without the opening quotation mark it would need, or with a control
character, is mapped back and its symbols inside words are decoded.

What holds U+FFFD afterwards can't be restored; it is reported as found all the same.

One narrow pass; values of plain ASCII never leave the JVM. Defined results: null values and null names are not
found; empty and long texts are scanned whole; each row is judged on its own, repeated ones alike.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Encodings that UTF-8 may have been read as, in the order they are tried; the one with most spans is taken.
LEGACY = ("cp1252", "mac_roman", "cp437", "cp850", "cp1251")
#: The code page whose single bytes may have been read as Windows-1252, and rounds of decoding.
DOS, ROUNDS = "cp850", 3


def _back(codec: str) -> dict[int, int]:
    """Character code -> byte of the encoding; undefined bytes stand for the control characters of their number."""
    table = {i: 0x100 for i in range(0x80, 0x100)} if codec != "cp1252" else {}
    for b in range(0x80, 0x100):
        try:
            table[ord(bytes([b]).decode(codec))] = b
        except UnicodeDecodeError:
            table[b] = b
        if codec == "cp1252":
            table.setdefault(b, b)  # Latin-1 has control characters there
    if table.get(0xA0, 0) >= 0xC2:
        del table[0xA0]  # a space begins no letter
    return table


_TABLES = {c: _back(c) for c in LEGACY}
_SPAN = re.compile(
    "(?:[\xc2-\xdf][\x80-\xbf]|\xe0[\xa0-\xbf][\x80-\xbf]|[\xe1-\xec\xee\xef][\x80-\xbf]{2}|\xed[\x80-\x9f][\x80-\xbf]"
    "|\xf0[\x90-\xbf][\x80-\xbf]{2}|[\xf1-\xf3][\x80-\xbf]{3}|\xf4[\x80-\x8f][\x80-\xbf]{2})+"
)


def _class(table: dict[int, int], low: int, high: int) -> str:
    return "[" + "".join(re.escape(chr(k)) for k, b in table.items() if low <= b <= high) + "]"


#: A byte that begins a span and one that goes on with it; without these a text holds no span.
_BEGINS = {c: re.compile(_class(t, 0xC2, 0xF4) + _class(t, 0x80, 0xBF)) for c, t in _TABLES.items()}


def _plausible(text: str) -> bool:
    for c in text:
        n = ord(c)
        if n < 0xA0 and not 0x80 <= n:
            return False
        kind = unicodedata.category(c)
        if kind[0] == "M" and text == c or kind in ("Cn", "Co", "Cs"):
            return False
        if n not in (0x192, 0x2C6, 0x2DC) and not (n < 0x180 or 0x386 <= n < 0x3D0 or 0x401 <= n < 0x460 or 0x1E00 <= n < 0x2C00 or 0x3000 <= n < 0xA000 or 0xAC00 <= n < 0xD7B0 or 0xFB00 <= n or n >= 0x1D400):
            return False
    return True


class _Bytes(dict):
    """For str.translate: one character below 0x100 for each, its byte; 0 for what the encoding does not have."""

    def __missing__(self, n: int) -> int:
        return n if n < 0x80 else 0


_MAPPED = {c: _Bytes({k: b if b < 0x100 else 0 for k, b in t.items() if k >= 0x80}) for c, t in _TABLES.items()}


def spans(text: str, codec: str) -> list[tuple[int, int, str]]:
    """(start, end, decoded) of the maximal well-formed multibyte spans under ``codec``."""
    if not _BEGINS[codec].search(text):
        return []
    found = []
    for m in _SPAN.finditer(text.translate(_MAPPED[codec])):
        decoded = m.group().encode("latin-1").decode("utf-8")
        if len(decoded) == 1 and 0x400 <= ord(decoded) < 0x530:
            continue  # look-alike letters or a dash before an accent, not one garbled letter
        if codec == "cp1251" and len(decoded) == 1 and not decoded.isalpha() and text[m.start() : m.end()].isalpha():
            continue  # two letters of which a sign would come
        if len(decoded) == 1 and text[m.end() - 1] in "\xa0\xad" and text[m.start()] not in "ÃÂГВ":
            continue  # a capital letter before a special space or a soft hyphen
        if _plausible(decoded):
            found.append((m.start(), m.end(), decoded))
    return found


_SYMBOLS = {chr(k): bytes([b]).decode(DOS) for k, b in _TABLES["cp1252"].items()}
#: Symbols for letters of either case; and small letters for capital ones, which show inside capitals only.
_LETTERS = {chr(k): _SYMBOLS[chr(k)] for k, b in _TABLES["cp1252"].items() if (b <= 0xA5 or b in (0xB5, 0xB7)) and _SYMBOLS[chr(k)].isalpha()}
_CAPITALS = {k: v for k, v in _SYMBOLS.items() if k.islower() and v.isupper() and k not in _LETTERS}
_ODD = "ˆƒ" + "".join(re.escape(k) for k in _LETTERS if not k.isalpha() and k not in "‘’“”–—…·\xa0" and k >= "\xa1")
_INSIDE = re.compile(rf"[^\W\d_ˆƒ][{_ODD}“”]+[^\W\d_]")
_CONTROL = re.compile("[\x80-\x9f]")
_CASE = re.compile(r"[a-zà-ÿ][ŠŽŒŸ][a-zà-ÿ]|[A-ZÀ-Þ][šžœ][A-ZÀ-Þ]|[A-ZÀ-Þ]{2}[à-ÿµ][A-ZÀ-Þ]|(?<!\w)[šžœµ][A-ZÀ-Þ]{2}")
_EDGE = re.compile(rf"[^\W\d_]([{_ODD}”]+)(?![\w“”])|(?<!\w)([{_ODD}”]+)[^\W\d_]")
_OPENS = {"”": "“„”\"", "›": "‹", "»": "«", "‹": "›", "„": "", "‚": ""}


def _unpaired(text: str) -> bool:
    for m in _EDGE.finditer(text):
        at = m.start(1) if m.group(1) else m.start(2)
        c = text[at]
        if c in "„‚" and m.group(2):
            if not re.search("[“”‘’\"]", text[at + 1 :]):
                return True
        elif c in "„‚":
            return True  # low quotation marks open words, they don't end them
        elif c in "”›" and m.group(1):
            if not any(o in text[:at] for o in _OPENS[c]):
                return True
        elif c in "”" and m.group(2):
            if "”" not in text[at + 1 :]:
                return True
        elif c in "†‡ˆ‰˜•" and m.group(1) or c in "ˆ‰˜" or c in "¥¤™" and m.group(2):
            return True
    return False


_CUT = re.compile(r"[^\W\d_][Ã├√╨╬╧]$|(?<!\w)Ã(?!\w)|[a-z]Ã(?=\s)")


def dos_evidence(text: str) -> bool:
    """Whether symbols stand where letters belong, or half of a garbled letter at the end."""
    return bool(_CUT.search(text) or _CONTROL.search(text) or _INSIDE.search(text) or _CASE.search(text) or _unpaired(text))


#: What a text that ``repair`` changes has: two characters side by side, of which a span could be, or one that a rule of
#: ``dos_evidence`` needs.
_DOUBT = re.compile(rf"[^\x00-\x7f]{{2}}|[{_ODD}“”Ã├√╨╬╧\x80-\x9fŠŽŒŸšžœµ�]|[A-ZÀ-Þ]{{2}}[à-ÿ][A-ZÀ-Þ]")


def dos_restored(text: str) -> str:
    """``text`` with the symbols of its words decoded; quotation marks in pairs and free-standing dashes stay."""
    out = list(text)
    for i, c in enumerate(text):
        if c in _CAPITALS and text[i - 1 : i].isupper() and (text[i + 1 : i + 2].isupper() or not text[i + 1 : i + 2].isalpha()):
            out[i] = _CAPITALS[c]
        if c not in _LETTERS:
            continue
        left, right = text[i - 1 : i].isalpha() or text[i - 1 : i] in _LETTERS, text[i + 1 : i + 2].isalpha() or text[i + 1 : i + 2] in _LETTERS
        if "\x80" <= c <= "\x9f" or left and right or (left or right) and c not in "‘’“\xa0…–—" or c in "…·" and text[i - 1 : i + 2] == f" {c} ":
            out[i] = _LETTERS[c]
    return "".join(out)


def repair(text: str) -> tuple[bool, str, str]:
    """(found, restored text, what was wrong) of one value; found with U+FFFD left means it can't be restored whole."""
    if text.isascii() or not _DOUBT.search(text):
        return False, text, ""
    now, wrong = text, []
    for _ in range(ROUNDS):
        best = max(((sum(e - s for s, e, _ in x), -n, c, x) for n, c in enumerate(LEGACY) if (x := spans(now, c))), default=None)
        if best is None:
            break
        for start, end, decoded in reversed(best[3]):
            now = now[:start] + decoded + now[end:]
        wrong.append(best[2])
    if not wrong and "�" not in now and dos_evidence(now):
        now = dos_restored(now)
        wrong.append(f"{DOS} as cp1252")  # other damage than UTF-8 as the DOS page, which is named by that alone
    if "�" in now:
        wrong.append("lost")
    return bool(wrong), now, "+".join(wrong)


def repaired(df: DataFrame, keys: list[str], values: Column) -> DataFrame:
    """(keys, field_name, no, original, restored, wrong) of every garbled value; ``values`` is an array of structs
    (field_name, no, original)."""
    each = df.select(*keys, F.explode(values).alias("v")).select(*keys, "v.field_name", "v.no", "v.original").where(F.col("original").rlike(r"[^\x00-\x7F]"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, *r[1:]) for i, x in enumerate(batch.column("original").to_pylist()) if (r := repair(x))[0]]
            kept = batch.take(pa.array([r[0] for r in rows], pa.int64()))
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.string())], names=[*kept.schema.names, "restored", "wrong"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in each.schema.fields)
    return each.mapInArrow(scan, f"{schema}, restored string, wrong string")


def title_and_authors(title: str = "title", authors: str = "authors") -> Column:
    """The values of a record that are judged, with the position of each name."""
    one = F.array(F.struct(F.lit("title").alias("field_name"), F.lit(0).alias("no"), F.col(title).alias("original")))
    names = F.transform(F.coalesce(F.col(authors), F.array().cast("array<string>")), lambda x, i: F.struct(F.lit("authors").alias("field_name"), (i + 1).alias("no"), x.alias("original")))
    return F.concat(one, names)
