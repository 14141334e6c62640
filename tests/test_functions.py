import difflib
import random

from pyspark.sql import functions as F

from quire.functions import identifiers as ids
from quire.functions import scoring as sc
from quire.functions.authors import labelled_authors
from quire.functions.ratio import matching_ratio
from quire.functions.years import best_year_of
from quire.sources import logs


def one(spark, rows, column):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "i int, x string")
    return [r.v for r in df.select("i", column.alias("v")).orderBy("i").collect()]


def test_dois(spark):
    rows = ["10.1038/s42256-025-01072-0", "doi:10.1038/nature12345", "https://doi.org/10.1038/nature12345", "10.1234/fake", "not-a-doi", None, ""]
    assert one(spark, rows, ids.valid_doi(F.col("x"))) == [True, True, True, False, False, True, True]
    assert one(spark, rows, ids.normalize_doi(F.col("x")))[1:3] == ["10.1038/nature12345"] * 2


def test_issns(spark):
    assert one(spark, ["0028-0836", "1234-567X", "1234-5678", "12345678", None], ids.valid_issn(F.col("x"))) == [True, True, False, False, True]


def test_isbns(spark):
    rows = ["9780262033848", "0262033844", "978-0-262-03384-8", "978123456789", "9780262033841", None, "0-8044-2957-X (pbk.)"]
    assert one(spark, rows, ids.valid_isbn(F.col("x"))) == [True, True, True, False, False, True, True]
    assert one(spark, rows[:2], ids.isbn_core(F.col("x"))) == ["026203384", "026203384"]


def test_extractors(spark):
    text = "Online ISSN: 1234-5679 (print), ISSN 2049-3630 (online). DO!: 10.5555/a.b, doi:10.5555)c arXiv:2301.12345 (1998) http://x.org/a."
    assert one(spark, [text], ids.extract_issns(F.col("x"))) == [["2049-3630", "1234-5679"]]
    assert one(spark, [text], ids.extract_dois(F.col("x"))) == [["10.5555/a.b", "10.5555/c"]]
    assert one(spark, [text], ids.extract_arxiv_ids(F.col("x"))) == [["2301.12345"]]
    assert one(spark, [text], ids.extract_years(F.col("x"))) == [["1998", "2049"]]
    assert one(spark, [text], ids.extract_urls(F.col("x"))) == [["http://x.org/a"]]


def test_authors(spark):
    assert one(spark, ["T\nAuthors: Jane Doe and John Smith\nX", "Author(s): Alice Johnson, Bob Miller", "none", None], labelled_authors(F.col("x"))) == [["Jane Doe", "John Smith"], ["Alice Johnson", "Bob Miller"], [], None]
    assert one(spark, ["Doe, Jane", "Jane  Doe."], sc.normal_author(F.col("x"))) == ["doe jane"] * 2


def test_composite_without_type_and_language(spark):
    row = spark.range(1).select(sc.composite(F.lit(1.0), F.lit(1.0), F.lit(1.0), F.lit(0.0), F.lit(None).cast("double")).alias("s"))
    row = row.select("s", sc.decision(F.lit(False), F.lit(False), F.col("s")).alias("d")).first()
    assert abs(row.s - 0.9) < 1e-9 and row.d == "auto_accept"


def test_ratio_is_the_library_one(spark):
    random.seed(1)
    pairs = [("".join(random.choices("abc d", k=9)), "".join(random.choices("abc d", k=12))) for _ in range(50)] + [(None, "a"), ("tide", "diet"), ("diet", "tide"), ("", "")]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a string, b string")
    got = [r.v for r in df.select("i", matching_ratio("a", "b").alias("v")).orderBy("i").collect()]
    assert got == [None if a is None else difflib.SequenceMatcher(None, a, b).ratio() for a, b in pairs]


def test_upsert_keeps_the_last_of_both(spark):
    old = spark.createDataFrame([("a", 1, "x"), ("b", 1, "x")], "k string, t int, v string")
    new = spark.createDataFrame([("b", 2, "y"), ("c", 1, "z")], "k string, t int, v string")
    assert sorted(tuple(r) for r in logs.upsert(old, new, "k", "t").collect()) == [("a", 1, "x"), ("b", 2, "y"), ("c", 1, "z")]


def test_all_years_of_a_text_compete(spark):
    from quire.plans import registry

    assert best_year_of("Old (1950), new (1999)")[0] == "1999"  # the second match of one form
    assert best_year_of(None) is best_year_of("") is best_year_of("no year (1234)") is None
    assert best_year_of("x" * 60 + " Accessed: 3 May (2020), " + "x" * 40 + ", 1987")[0] == "1987"
    body = "\n".join(["The survey of the valley was made in (2005) by them"] * 6)
    assert best_year_of(f"Journal (1971)\n{body}\n" + "end\n" * 40)[0] == "1971"
    df = spark.createDataFrame([(1, "Old (1950), new (1999)"), (2, None), (3, "none")], "doc_id long, text string")
    df.write.mode("overwrite").parquet("/tmp/quire-years/documents.parquet")
    assert [(r.doc_id, r.best_year) for r in registry.QUERIES["best_year"](spark, "/tmp/quire-years").collect()] == [(1, "1999")]


def test_labelled_authors_rows(spark):
    from quire.plans import registry

    rows = [(1, ["Jane Doe and John Roe"]), (2, ["Jane Doe, John Roe"]), (3, ["Jane Doe", "Jane Doe"]), (4, ["Ann Poe"]), (5, None)]
    spark.createDataFrame(rows, "request_id long, authors array<string>").write.mode("overwrite").parquet("/tmp/quire-authors/paper_identifiers.parquet")
    got = {r.request_id: r.authors for r in registry.QUERIES["labelled_authors"](spark, "/tmp/quire-authors").collect()}
    assert got == {1: "Jane Doe; John Roe", 2: "Jane Doe; John Roe", 3: "Jane Doe", 4: "Ann Poe"}
