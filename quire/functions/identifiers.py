"""Identifiers: normalising, checking and extracting, as Column expressions that stay inside the JVM's code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def blank(c: Column) -> Column:
    return c.isNull() | (F.trim(c) == "")


def normalize_doi(c: Column) -> Column:
    """A DOI without prefixes, stripped one after the other; null for null and empty input."""
    out = F.trim(c)
    for prefix in (r"doi:", r"https://doi\.org/", r"http://dx\.doi\.org/", r"http://doi\.org/"):
        out = F.trim(F.regexp_replace(out, f"(?i)^{prefix}", ""))
    return F.when(~blank(c), out)


def valid_doi(c: Column) -> Column:
    """True for a missing DOI; false for made-up and malformed ones."""
    doi = normalize_doi(c)
    return F.when(blank(c), True).otherwise(~doi.rlike(r"^10\.(1234|9999)/") & doi.rlike(r"^10\.\d{4,}/\S+$"))


def valid_issn(c: Column) -> Column:
    """True for a missing ISSN; mod-11 check digit, any X as check digit accepted."""
    x = F.upper(F.trim(c))
    digits = F.replace(x, F.lit("-"), F.lit(""))
    weights = F.aggregate(F.sequence(F.lit(1), F.lit(7)), F.lit(0), lambda a, i: a + F.coalesce(F.substring(digits, i, F.lit(1)).try_cast("int"), F.lit(0)) * (9 - i))
    want = F.pmod(-weights, F.lit(11))
    check = F.substring(digits, 8, 1)
    good = F.when(check == "X", True).otherwise((want < 10) & (check == want.cast("string")))
    return F.when(blank(c), True).otherwise((x != "1234-5678") & x.rlike(r"^\d{4}-\d{3}[0-9X]$") & good)


def clean_isbn(c: Column) -> Column:
    """The digits (and X) of an ISBN of 10 or 13 places without remarks in parentheses; '' if there is none."""
    digits = F.regexp_replace(F.upper(F.regexp_replace(c, r"\s*\([^)]*\)", "")), r"[^0-9X]", "")
    return F.when(F.length(digits).isin(10, 13), digits).otherwise("")


def isbn13_check(isbn: Column) -> Column:
    total = F.aggregate(F.sequence(F.lit(1), F.lit(12)), F.lit(0), lambda a, i: a + F.substring(isbn, i, F.lit(1)).try_cast("int") * F.when(i % 2 == 1, 1).otherwise(3))
    return F.pmod(-total, F.lit(10)).cast("string") == F.substring(isbn, 13, 1)


def isbn10_check(isbn: Column) -> Column:
    total = F.aggregate(F.sequence(F.lit(1), F.lit(9)), F.lit(0), lambda a, i: a + F.substring(isbn, i, F.lit(1)).try_cast("int") * (11 - i))
    want = F.pmod(-total, F.lit(11))
    return F.when(want == 10, "X").otherwise(want.cast("string")) == F.substring(isbn, 10, 1)


def valid_isbn(c: Column) -> Column:
    """True for a missing ISBN; made-up ones and wrong check digits are false."""
    x = clean_isbn(c)
    good = F.when(x.rlike(r"^\d{13}$"), isbn13_check(x)).when(x.rlike(r"^\d{9}[\dX]$"), isbn10_check(x)).otherwise(False)
    return F.when(blank(c), True).otherwise(~x.rlike(r"^978123456789[0-9X]?$") & good)


def isbn_core(c: Column) -> Column:
    """The nine digits that the ten- and the thirteen-digit form of an ISBN share; null without one."""
    x = clean_isbn(c)
    return F.when(F.length(x) == 13, F.substring(x, 4, 9)).when(F.length(x) == 10, F.substring(x, 1, 9))


#: Registration groups known to the library routing.
ISBN_GROUPS = ["950", "951", "952", "958", "959", "968", "970", "972", "980", "987", "989", "82", "84", "85", "87", "91", "93", "0", "1", "2", "3"]


def isbn_group(c: Column) -> Column:
    """The longest known registration group that the ISBN begins with; '' without one."""
    x = clean_isbn(c)
    body = F.when((F.length(x) == 13) & x.rlike("^97[89]"), F.substring(x, 4, 10)).otherwise(x)
    return F.coalesce(*(F.when(body.startswith(g), g) for g in ISBN_GROUPS), F.lit(""))


#: The country of a registration group.
COUNTRIES = {"82": "NO", "951": "FI", "91": "SE", "87": "DK", "0": "US", "1": "US", "2": "FR", "3": "DE", "4": "JP", "5": "RU", "7": "CN"}


def isbn_country(c: Column) -> Column:
    """The country of a thirteen-digit ISBN's group, a whole group of three digits before one that they begin with."""
    x = clean_isbn(c)
    group = F.when((F.length(x) == 13) & x.rlike("^97[89]"), F.substring(x, 4, 3))
    return F.coalesce(*(F.when(group == k, v) for k, v in COUNTRIES.items()), *(F.when(group.startswith(k), v) for k, v in COUNTRIES.items()))


#: What URLs of universities and repositories hold.
INSTITUTIONS = [".edu", ".ac.", "university", "college", "institute", "ssrn.com", "arxiv.org", "repec.org"]


def institutional(url: Column) -> Column:
    low = F.lower(url)
    return F.exists(F.array(*map(F.lit, INSTITUTIONS)), lambda h: F.contains(low, h))


def valid_url(c: Column) -> Column:
    return F.when(blank(c), True).otherwise(F.trim(c).rlike(r"^https?://[^/\s?#]+"))


def valid_arxiv(c: Column) -> Column:
    x = F.trim(F.regexp_replace(F.trim(c), "(arXiv|arxiv):", ""))
    return F.when(blank(c), True).otherwise(x.rlike(r"^\d{4}\.\d{4,5}(v\d+)?$") | x.rlike(r"^[a-z-]+(\.[A-Z]{2})?/\d{7}(v\d+)?$"))


#: A DOI is a registrant, a stroke (or the bracket that it is read as) and a suffix up to a blank or bracket, whatever
#: link, label or nothing stands before it.
REGISTRANT, SUFFIX = r"10\.\d{4,}", r"[^\s)]+"
DOI = rf"\b({REGISTRANT}[/)]{SUFFIX})"


def extract_dois(text: Column) -> Column:
    """Distinct DOIs by place; a bracket read for a stroke is put right."""
    found = F.regexp_extract_all(text, F.lit(DOI), 1)
    tidy = F.transform(found, lambda x: F.regexp_replace(F.regexp_replace(x, rf"^({REGISTRANT})\)", "$1/"), r"[.,;:\s]+$", ""))
    return F.array_distinct(tidy)


def extract_issns(text: Column) -> Column:
    """Distinct ISSNs, those marked as online within twenty characters first."""
    pairs = F.regexp_extract_all(text, F.lit(r"(?is)\bISSN[:\s]*(?=(\d{4}-\d{3}[0-9X]\b.{0,20}))"), 1)
    number = lambda x: F.upper(F.regexp_extract(x, r"(?i)(\d{4}-\d{3}[0-9X])", 1))
    online = lambda x: x.rlike(r"(?i)^[\d-]+x?\W*(online|electronic|e-?issn)") | x.rlike(r"(?i)online|electronic|e-?issn") & ~x.rlike(r"(?i)^[\d-]+x?\W*(print|p-?issn)")
    return F.array_distinct(F.concat(F.transform(F.filter(pairs, online), number), F.transform(F.filter(pairs, lambda x: ~online(x)), number)))


def extract_isbns(text: Column) -> Column:
    """Distinct ISBNs with a right check digit."""
    found = F.concat(F.regexp_extract_all(text, F.lit(r"(?i)ISBN[-:\s0-9]*?[:\s]*([0-9][0-9Xx\- ]{8,16}[0-9Xx])"), 1), F.regexp_extract_all(text, F.lit(r"\b(97[89][\- ]?[0-9][0-9\- ]{7,12}[0-9])\b"), 1))
    clean = F.transform(found, lambda x: F.regexp_replace(F.upper(x), r"[^0-9X]", ""))
    return F.array_distinct(F.filter(clean, lambda x: F.length(x).isin(10, 13) & valid_isbn(x)))


#: The characters that a URL is made of, but for square brackets and the apostrophe, which rather end it.
URL = r"(https?://[A-Za-z0-9._~:/?#@!$&()*+,;=%-]+)"


def extract_urls(text: Column) -> Column:
    """Distinct URLs without closing punctuation, JSTOR's left out."""
    found = F.transform(F.regexp_extract_all(text, F.lit(URL), 1), lambda x: F.regexp_replace(x, r"[.,;:!?)]+$", ""))
    return F.array_distinct(F.filter(found, lambda x: ~F.lower(x).contains("jstor.org")))


def extract_jstor_ids(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?i)jstor\.org/stable/(\d+)"), 1))


#: The archives whose old numbers are known.
ARCHIVES = "astro-ph cond-mat gr-qc hep-ex hep-lat hep-ph hep-th math math-ph nlin nucl-ex nucl-th physics quant-ph cs q-bio q-fin stat".split()


def extract_arxiv_ids(text: Column) -> Column:
    """Distinct arXiv numbers, new ones and then those of the old form with a known archive, with the word arXiv within
    twenty characters."""
    new = _beside_arxiv(text, r"\d{4}\.\d{4,5}(?!\d)")
    old = F.filter(_beside_arxiv(text, r"[a-z]+(?:-[a-z]+)?/\d{7}(?!\d)"), lambda x: F.array_contains(F.array(*map(F.lit, ARCHIVES)), F.lower(F.substring_index(x, "/", 1))))
    return F.array_distinct(F.concat(new, old))


def _beside_arxiv(text: Column, number: str) -> Column:
    """The matches of ``number`` with the word arXiv within twenty characters on either side."""
    alone = rf"(?<![\w.-])({number})"
    return F.concat(F.regexp_extract_all(text, F.lit(rf"(?is)(?<=arxiv.{{0,20}}){alone}"), 1), F.regexp_extract_all(text, F.lit(rf"(?is){alone}(?=.{{0,20}}arxiv)"), 1))


#: Where four digits can be a year: in parentheses, and behind a blank or a copyright sign.
YEARS = (r"\((\d{4})\)", r"[\s©](\d{4})\b")


def extract_years(text: Column) -> Column:
    """Distinct years from 1900 to 2100, those in parentheses first."""
    found = F.concat(*(F.regexp_extract_all(text, F.lit(p), 1) for p in YEARS))
    return F.array_distinct(F.filter(found, lambda y: y.cast("int").between(1900, 2100)))


def filename_language(name: Column) -> Column:
    """The language that a scan's name is marked with; null if none."""
    code = F.regexp_extract(F.upper(name), r"^(NO|EN|DE|FI|SV)_", 1)
    return F.when(code != "", code)


def validated(record: dict[str, Column]) -> dict[str, Column]:
    """All checks of a record's doi, issn, isbn, url and arxiv in one select: valid_*, cleaned_* (null where it is missing
    or not valid), the flags of those that are not, and whether there are any."""
    checks = {"doi": (valid_doi, normalize_doi), "issn": (valid_issn, lambda x: F.upper(F.trim(x))), "isbn": (valid_isbn, clean_isbn), "url": (valid_url, F.trim), "arxiv": (valid_arxiv, F.trim)}
    valid = {k: F.coalesce(check(record[k]), F.lit(False)) for k, (check, _) in checks.items() if k in record}
    out = {f"valid_{k}": v for k, v in valid.items()}
    out |= {f"cleaned_{k}": F.when(v & ~blank(record[k]), checks[k][1](record[k])) for k, v in valid.items()}
    flags = F.array_compact(F.array(*(F.when(~v, F.lit(f"invalid_{k}")) for k, v in valid.items())))
    return out | {"confidence_flags": flags, "has_hallucinations": F.size(flags) > 0}
