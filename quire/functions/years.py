"""The likeliest year of publication of a whole text; Arrow batches, as Spark's matches have no places."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructType

#: The weights of a year in parentheses, behind a copyright sign, a comma and a blank, words that speak for
#: a publication, letters around a year in which 'accessed' makes it another date.
WEIGHTS = {"(": 10, "©": 9, ",": 8, " ": 7}
_YEAR = re.compile(r"([(©,]|(?=\s))\s*(\d{4})(?!\w)(\))?")
KEYWORDS = ("published", "publication", "copyright", "©", "vol", "issue", "journal", "article", "paper")
ACCESSED = 20


def body_regions(text: str) -> list[tuple[int, int]]:
    """(start, end) of runs of three and more lines of about one length that end before the last tenth of the text."""
    if len(text.split()) < 50:
        return []
    lines = text.split("\n")
    lengths, starts, out = [len(x.strip()) for x in lines], [0], []
    for x in lines:
        starts.append(starts[-1] + len(x) + 1)
    for i in range(len(lines) - 2):
        three = lengths[i : i + 3]
        mean = sum(three) / 3
        if not all(three) or mean < 20 or any(abs(n - mean) / mean > 0.15 for n in three):
            continue
        end = i + 2
        for j in range(i + 3, len(lines)):
            if lengths[j] and abs(lengths[j] - mean) / mean > 0.15:
                break
            end = j if lengths[j] else end
        if starts[end + 1] / len(text) < 0.9:
            out.append((starts[i], starts[end + 1]))
    return out


def _weight(m: re.Match) -> int | None:
    """The weight of what stands before a year; None if that is no sign of one."""
    lead, spaced = m.group(1), m.group(0)[len(m.group(1)) : 1 + len(m.group(1))].isspace()
    if lead == "(" and not (m.group(3) and not spaced):
        return WEIGHTS[" "] if spaced else None  # a parenthesis that holds more
    if lead == "," and not spaced:
        return None
    return WEIGHTS[lead or " "]


def place_bonus(share: float) -> float:
    return 8 * (1 - share / 0.15) if share <= 0.15 else 4 * (1 - (share - 0.15) / 0.15) if share <= 0.3 else 2 * (1 - (share - 0.3) / 0.2) if share <= 0.5 else 0.0


def best_year_of(text: str | None) -> tuple[str, float] | None:
    """(year, score): of all years of 1900 to 2100 in any form, by form, place, words nearby, and ten for the latest year;
    those in body text and dates of access don't count."""
    found = [(m.start(), m.group(2), w) for m in _YEAR.finditer(text or "") if 1900 <= int(m.group(2)) <= 2100 and (w := _weight(m))]
    regions = body_regions(text) if found else []
    scored = []
    for at, year, weight in found:
        if any(a <= at <= b for a, b in regions) or "accessed" in text[max(0, at - ACCESSED) : at + ACCESSED].lower():
            continue
        near = text[max(0, at - 50) : at + 100].lower()
        scored.append((weight + place_bonus(at / len(text)) + 3 * any(k in near for k in KEYWORDS), at, year))
    if not scored:
        return None
    latest = max(int(y) for _, _, y in scored)
    score, _, year = min(((s + 10 * (int(y) == latest), at, y) for s, at, y in scored), key=lambda x: (-x[0], x[1]))
    return year, round(score, 6)


@F.pandas_udf(StructType().add("best_year", StringType()).add("score", DoubleType()))
def best_year(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([best_year_of(x) or (None, None) for x in texts], columns=["best_year", "score"]).astype({"score": "float64"})
