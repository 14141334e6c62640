import random
import time
from collections import Counter
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from quire.functions import blocks
from quire.functions import scoring as sc
from quire.operators import near
from quire.operators.near import alike_titles, titles_of_ratio, within_edits
from quire.plans.fuzzy import duplicate_probe, fuzzy_title_join, staged_search
from quire.sources.tables import table


def distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def strings(spark, rows):
    return spark.createDataFrame([(x,) for x in rows], "s string")


def test_within_edits_equals_brute_force(spark):
    random.seed(3)
    words = ["".join(random.choice("abc") for _ in range(random.randint(0, 9))) for _ in range(150)]
    a, b = words[:80], words[80:]
    for k in (0, 1, 2):
        want = {(x, y, distance(x, y)) for x in a for y in b if x and y and distance(x, y) <= k}
        assert {tuple(r) for r in within_edits(strings(spark, [*a, *a, None]), strings(spark, [*b, ""]), k).collect()} == want


def test_errors_anywhere_link(spark):
    """A typo in the first letter, in the last, and a swapped pair."""
    got = within_edits(strings(spark, ["ostrom", "rostron", "rsotrom", "rostrom"]), strings(spark, ["rostrom"]), 2)
    assert {(r.a, r.distance) for r in got.collect()} == {("ostrom", 1), ("rostron", 1), ("rsotrom", 2), ("rostrom", 0)}
    assert within_edits(strings(spark, []), strings(spark, ["x"]), 2).count() == 0


def test_alike_titles_against_brute_force(spark, sf):
    """Recall of every pair of at least 0.8 among a tenth of the requests' titles and all library titles."""
    norm = lambda t: [r[0] for r in table(spark, sf, t).select(sc.normal_title(F.col("title"))).distinct().collect() if r[0]]
    a, b = sorted(norm("paper_identifiers"))[::4], norm("search_results")
    found = {(r.a, r.b): r.ratio for r in alike_titles(strings(spark, a), strings(spark, b), 0.8).collect()}
    want = {}
    for x in a:
        for y in b:
            m = SequenceMatcher(None, x, y)
            if m.real_quick_ratio() >= 0.8 and m.quick_ratio() >= 0.8 and m.ratio() >= 0.8:
                want[x, y] = m.ratio()
    assert all(abs(want[p] - r) < 1e-9 for p, r in found.items())
    assert len(found) >= 0.95 * len(want) and want


def test_titles_of_few_words_and_none(spark):
    got = alike_titles(strings(spark, ["introduction", "", None, "two words"]), strings(spark, ["introductions", "introduction", "two words", "words two"]), 0.8)
    assert ("introduction", "introduction") in {(r.a, r.b) for r in got.collect()}


def test_tiles_of_common_words_find_what_the_definition_says(spark, monkeypatch):
    """Every pair that shares two of its rarer words, once, however a block is cut into tiles and whichever blocks it is in."""
    monkeypatch.setattr(near, "TILE", 3)
    random.seed(5)
    make = lambda: " ".join(["notes", "harbour", "law", *("".join(random.choice("abcd") for _ in range(random.randint(1, 6))) for _ in range(random.randint(1, 5)))])
    a, b = sorted({make() for _ in range(40)}), sorted({make() for _ in range(40)}) + ["notes harbour law " + "word " * 45 + "end"]
    rows = [(r.a, r.b, r.ratio) for r in alike_titles(strings(spark, a), strings(spark, b), 0.5).collect()]
    n = Counter(w for t in {*a} for w in {*t.split()}) + Counter(w for t in {*b} for w in {*t.split()})
    rarer = lambda t: set((r := sorted({*t.split()}, key=lambda w: (n[w], w)))[: len(r) - -(-len(r) // 2) + 2])
    want = {(x, y) for x in a for y in b if len(rarer(x) & rarer(y)) >= 2 and SequenceMatcher(None, x, y).ratio() >= 0.5}
    assert len(rows) == len({r[:2] for r in rows}) and {r[:2] for r in rows} == want and want
    assert all(r == SequenceMatcher(None, x, y).ratio() for x, y, r in rows)


def test_a_block_of_thousands_is_met_without_rows_of_pairs(spark):
    """Nine million pairs share two common words and no more; as rows with an edit distance each they took minutes."""
    random.seed(7)
    make = lambda: "harbour law " + " ".join("".join(random.choice("abcdefghiklmnoprstu") for _ in range(9)) for _ in range(2)) + " x"
    a, b = ([make() for _ in range(3000)] for _ in range(2))
    began = time.monotonic()
    got = {tuple(r) for r in alike_titles(strings(spark, [*a, b[0]]), strings(spark, b), 0.9).collect()}
    assert (b[0], b[0], 1.0) in got and time.monotonic() - began < 90


def test_ratios_equal_difflib():
    random.seed(9)
    for letters in ("ab ", "abcdefgh ", "aé漢\U0001f600 "):
        some = sorted({"".join(random.choice(letters) for _ in range(random.choice((1, 7, 30, 63, 64, 65, 90, 126, 127, 128, 129, 199, 200, 260)))) for _ in range(90)})
        s, a, b = blocks.Strings(some), *(np.array(x) for x in zip(*((random.randrange(len(some)), random.randrange(len(some))) for _ in range(400))))
        for least in (0.3, 0.6, 0.8):
            at, value = blocks.ratios(s, a, b, least)
            want = {k: r for k, (x, y) in enumerate(zip(a, b)) if (r := SequenceMatcher(None, some[x], some[y]).ratio()) >= least}
            assert dict(zip(at.tolist(), value.tolist())) == want
    s = blocks.Strings(["".join(map(chr, range(500, 900))), "".join(map(chr, range(500, 560)))])
    assert blocks.ratios(s, np.array([0, 1]), np.array([0, 1]), 0.8)[0].tolist() == [0, 1]
    assert [len(x) for x in blocks.ratios(s, np.array([], int), np.array([], int), 0.8)] == [0, 0]


def test_staged_search_counts_every_hit_of_a_common_block(spark, tmp_path):
    """Titles that differ in one word are all hits of the search by title alone, however many; the old join made a row of each pair."""
    name = lambda k: "".join("bdfgklmnpr"[int(d)] for d in f"{k:03d}")
    spark.createDataFrame([(k, f"Parish economies after {name(k)}: notes from the harbour", None, None) for k in range(60)], "request_id long, title string, authors array<string>, year string").write.parquet(f"{tmp_path}/paper_identifiers.parquet")
    spark.createDataFrame([(k, f"Parish economies after {name(999 - k)}: notes from the harbour", None, None) for k in range(70)], "search_id long, title string, authors array<string>, year string").write.parquet(f"{tmp_path}/search_results.parquet")
    got = staged_search(spark, str(tmp_path)).collect()
    assert len(got) == 60 and {(r.stage, r.hits) for r in got} == {(3, 70)}


def test_matrices_find_what_pairs_find(monkeypatch):
    """A tile met as a matrix and one met pair by pair give the pairs that share no word before the block's, long titles too."""
    random.seed(13)
    make = lambda: {"s": "".join(random.choice("abc ") for _ in range(random.choice((3, 9, 40, 70, 130, 260)))), "before": random.sample(range(9), random.randint(0, 3))}
    tiles = [([make() for _ in range(random.randint(1, 30))], [make() for _ in range(random.randint(1, 30))]) for _ in range(5)]
    side = pa.list_(pa.struct([("s", pa.string()), ("before", pa.list_(pa.int64()))]))
    batch = pa.record_batch([pa.array([t[k] for t in tiles], side) for k in (0, 1)], ["xs", "ys"])
    want = sorted((x["s"], y["s"], r) for xs, ys in tiles for x in xs for y in ys if not {*x["before"]} & {*y["before"]} and (r := SequenceMatcher(None, x["s"], y["s"]).ratio()) >= 0.6)
    for matrix in (1, 200, 1 << 40):
        monkeypatch.setattr(near, "MATRIX", matrix)
        assert sorted(tuple(r.values()) for b in near._met(batch, 0.6) for r in b.to_pylist()) == want and want


def test_staged_search_does_not_multiply_copies(spark, tmp_path):
    """40,000 requests for a title that 40,000 items have; as rows these are 1,600,000,000 hits."""
    title = "Parish economies after Kirfol: notes from the harbour"
    spark.range(40_000).selectExpr("id AS request_id", f"'{title}' AS title", "array('Ann Lee') AS authors", "'1999' AS year").write.parquet(f"{tmp_path}/paper_identifiers.parquet")
    spark.range(40_000).selectExpr("id AS search_id", f"'{title}' AS title", "if(id % 4 = 0, array('Lee, Ann'), null) AS authors", "if(id % 2 = 0, '1999', null) AS year").write.parquet(f"{tmp_path}/search_results.parquet")
    began = time.monotonic()
    got = staged_search(spark, str(tmp_path)).groupBy("stage", "hits", "best").count().collect()
    assert [tuple(r) for r in got] == [(1, 10_000, 1.0, 40_000)] and time.monotonic() - began < 60


def damaged(text: str, part: float) -> str:
    """With letters left out, and others put in."""
    return "".join("" if r < part / 2 else x + random.choice("abc ") if r > 1 - part / 2 else x for x in text for r in [random.random()])


def test_titles_of_ratio_are_all_that_brute_force_finds(spark, monkeypatch):
    """Whatever is damaged, of one letter or of hundreds, once each, however many tiles the titles are cut into."""
    random.seed(21)
    for letters in ("ab ", "abcdefghijklmno ", "aé漢\U0001f600 "):
        a = ["".join(random.choice(letters) for _ in range(random.choice((1, 2, 3, 7, 30, 64, 65, 127, 128, 192, 199, 200, 260)))) for _ in range(40)]
        b = [damaged(x, random.choice((0, 0.05, 0.15, 0.3))) for x in a for _ in range(2)]
        for side in (30, 1 << 14):
            monkeypatch.setattr(near, "SIDE", side)
            rows = [tuple(r) for r in titles_of_ratio(strings(spark, [*a, *a, None, ""]), strings(spark, [*b, *b, None, ""]), 0.8).collect()]
            want = {(x, y, r) for x in {*a} for y in {*b} - {""} if (r := SequenceMatcher(None, x, y).ratio()) >= 0.8}
            assert len(rows) == len(want) > 40 and {*rows} == want
    assert titles_of_ratio(strings(spark, []), strings(spark, ["x"]), 0.8).count() == 0


def test_matrices_of_letters_leave_no_pair_out(monkeypatch):
    """In the process itself, where the sides of a matrix can be set: all pairs of a ratio, of every length."""
    random.seed(22)
    whole = ["".join(random.choice("abcdefg ") for _ in range(random.choice((1, 5, 40, 90, 150, 230)))) for _ in range(18)]
    some = sorted({damaged(x, part) for x in whole for part in (0, 0.1, 0.3)} - {""})
    every = np.arange(len(some))
    for rows, wide, left in ((2, 3, 5), (512, 4096, 1 << 17)):
        for k, v in (("ROWS", rows), ("WIDE", wide), ("LEFT", left)):
            monkeypatch.setattr(blocks, k, v)
        for least in (0.5, 0.8, 0.85):
            s, got = blocks.Strings(some), []
            for i, j in blocks.alike_in_letters(s, every, every, least):
                at, value = blocks.ratios(s, i, j, least, bounded=True)
                got += zip(i[at].tolist(), j[at].tolist(), value.tolist())
            assert sorted(got) == [(i, j, r) for i, x in enumerate(some) for j, y in enumerate(some) if (r := SequenceMatcher(None, x, y).ratio()) >= least]


#: Titles of which every word is damaged, and two whose words run together: of a ratio of 0.85 and more, with no word shared.
DAMAGED = {
    "Letter writing in the northern valley": "Leter writng inthe norhern valey",
    "Soil chemistry and reading habits in Lomzir: a study": "Soill chemisstry andd readding habbits inn Lomzzir: aa sttudy",
    "Harbour notes": "Harbournotes",
}


def test_fuzzy_title_join_finds_titles_that_share_no_word(spark, tmp_path):
    """With ten for the shared author of the first, five for the year of the second; none for a title below the ratio."""
    columns = "{} long, title string, authors array<string>, year string"
    requests = [(k, t, ["Ann Lee"] if k == 0 else None, "1999") for k, t in enumerate([*DAMAGED, "Glacier retreat", None, ""])]
    items = [(k + 10, t, ["Lee, Ann", "Ann Lee"], "1999" if k == 1 else None) for k, t in enumerate([*DAMAGED.values(), "Glaciology in retreat", None, ""])]
    spark.createDataFrame(requests, columns.format("request_id")).write.parquet(f"{tmp_path}/paper_identifiers.parquet")
    spark.createDataFrame(items, columns.format("search_id")).write.parquet(f"{tmp_path}/search_results.parquet")
    got = {tuple(r) for r in fuzzy_title_join(spark, str(tmp_path)).select("request_id", "search_id", "score").collect()}
    assert got == {(0, 10, 100.0), (1, 11, 96.891892), (2, 12, 96.0)}


def test_duplicate_probe_finds_titles_that_share_no_word(spark, tmp_path):
    spark.createDataFrame([*enumerate([*DAMAGED, "Glacier retreat", None, ""])], "request_id long, title string").selectExpr("*", "cast(null AS string) AS doi", "cast(null AS array<string>) AS authors", "cast(null AS string) AS year").write.parquet(f"{tmp_path}/paper_identifiers.parquet")
    spark.createDataFrame([(k + 10, t) for k, t in enumerate([*DAMAGED.values(), None, ""])], "search_id long, title string").selectExpr("*", "cast(null AS array<string>) AS authors", "cast(null AS string) AS year").write.parquet(f"{tmp_path}/search_results.parquet")
    spark.createDataFrame([], "request_id long, result_id long, raw_data string").write.parquet(f"{tmp_path}/metadata_results.parquet")
    got = {tuple(r) for r in duplicate_probe(spark, str(tmp_path)).collect()}
    assert got == {(0, "title", 10, 0.927536), (1, "title", 11, 0.918919), (2, "title", 12, 0.96)}
