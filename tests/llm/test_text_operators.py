import random

import pytest
from pyspark.sql import functions as F

from quire.llm import language, leakage, packing, truncation


# --- packing ---------------------------------------------------------------------------------------------------------


def subset_best(counts, room):
    sums = {0}
    for length, n in counts.items():
        for _ in range(n):
            sums |= {s + length for s in sums if s + length <= room}
    return max(sums)


def test_fullest_is_the_best_subset():
    random.seed(1)
    for _ in range(200):
        counts = {random.randint(1, 30): random.randint(1, 4) for _ in range(random.randint(0, 6))}
        room = random.randint(0, 60)
        taken = packing.fullest(counts, room)
        assert all(k <= counts[x] for x, k in taken)
        assert sum(x * k for x, k in taken) == subset_best(counts, room)


def test_plan_places_every_length_once():
    random.seed(2)
    for cap in (20, 64):
        histogram = {n: random.randint(1, 50) for n in range(1, cap // 2)}
        slots, bins = packing.plan(histogram, cap)
        assert bins >= -(-sum(n * k for n, k in histogram.items()) // cap)
        assert bins <= 1.05 * sum(n * k for n, k in histogram.items()) / cap + 2


def test_pack_is_whole_and_fits(spark):
    random.seed(3)
    rows = [(i, random.choice([0, 1, 7, 31, 32, 33, 64, 100, random.randint(1, 70)])) for i in range(800)] + [(1000 + i, 20) for i in range(400)]
    sizes = spark.createDataFrame(rows, "doc_id long, n_tokens long").cache()
    caps = {"s": 32, "m": 64}
    got = packing.pack(sizes, "doc_id", caps).collect()
    for name, cap in caps.items():
        own = [r for r in got if r.size_name == name]
        fill = {}
        for r in own:
            fill[r.container_id] = fill.get(r.container_id, 0) + r.n_tokens
        assert max(fill.values()) <= cap
        back = {}
        for r in own:
            back.setdefault(r.doc_id, []).append((r.start_token, r.n_tokens))
        assert {d: sum(n for _, n in x) for d, x in back.items()} == dict(rows)
        assert all(len(x) == max(1, -(-dict(rows)[d] // cap)) for d, x in back.items())
    assert packing.pack(sizes.limit(0), "doc_id", caps).count() == 0


def test_token_counts_equal_the_tokenizer(spark):
    texts = ["", " ", "Hello world", "naïve café\n\n  x", "a" * 5000, "1234 567 <|endoftext|>", None, "日本語 text"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("n_tokens", F.lit(-1))
    got = {r.doc_id: r.n_tokens for r in packing.token_counts(df, "doc_id", "text").collect()}
    coder = packing.TokenCounter(packing.TOKENIZERS, packing.VOCABULARY).coder
    assert got == {i: len(coder.encode_ordinary(t)) for i, t in enumerate(texts) if t is not None}


# --- leakage ---------------------------------------------------------------------------------------------------------

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omikron pi rho sigma".split()


def brute_leaks(text, item, n=12):
    reduce = lambda t: [w for w in map(leakage.reduce_text, (t or "").split()) if w]
    a, b = reduce(text), reduce(item)
    grams = {tuple(b[i : i + n]) for i in range(len(b) - n + 1)}
    return any(tuple(a[i : i + n]) in grams for i in range(len(a) - n + 1))


def test_leaks_equal_brute_force(spark):
    random.seed(4)
    items = [(i, " ".join(random.choices(WORDS, k=random.randint(8, 40)))) for i in range(30)]
    docs = []
    for d in range(200):
        body = random.choices(WORDS, k=random.randint(0, 30))
        w = random.choice(items)[1].split()
        k, at = random.randint(9, 15), random.randint(0, 10)
        docs.append((d, " ".join(body[:10] + w[at : at + k] + body[10:])))
    docs += [(900, None), (901, ""), (902, docs[3][1]), (903, " ".join(["x"] * 20_000) + " " + items[0][1])]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit(0))
    it = spark.createDataFrame([*items, (99, None)], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in leakage.leaked(df, "doc_id", "text", it, "item_id", {"text": False}).collect()}
    assert got == {(d, i) for d, t in docs for i, x in items if brute_leaks(t, x)}
    small = {(r.doc_id, r.item_id) for r in leakage.leaked(df, "doc_id", "text", it, "item_id", {"text": False}, block_chars=200).collect()}
    assert small == got
    assert leakage.leaked(df, "doc_id", "text", it.limit(0), "item_id", {"text": False}).count() == 0


@pytest.mark.parametrize("change", [str.upper, lambda t: t.replace(" ", "\n"), lambda t: t.replace("gamma", "gam-\nma"), lambda t: t.replace("a", "а"), lambda t: t.replace("e", "e​"), lambda t: t.replace(" ", ", ")])
def test_leaks_ignore_the_form(change):
    item = " ".join(WORDS)
    text = "before this. " + change(item) + " after it"
    found = leakage.Items([(1, "text", item, False)], 12).spans(text)
    assert [x[0] for x in found] == [1] and found[0][2] == len(WORDS)
    assert text[found[0][3] : found[0][4]] == change(item)


def test_every_stretch_of_one_alignment_is_given():
    words = [f"{x}{y}word" for x in "abcdefgh" for y in "abcde"]
    item = " ".join(words)
    text = "so " + " ".join([*words[:18], "zzword", *words[19:]]) + " end"  # a difference of equal length in the middle
    found = leakage.Items([(1, "text", item, False)], 12).spans(text)
    assert [(x[2], text[x[3] : x[4]]) for x in found] == [(18, " ".join(words[:18])), (21, " ".join(words[19:]))]
    assert len(leakage.Items([(1, "text", item, False)], 12).spans(item)) == 1


def test_eleven_words_do_not_leak():
    items = leakage.Items([(1, "text", " ".join(WORDS), False)], 12)
    assert not items.spans("x " + " ".join(WORDS[:11]) + "y z") and items.spans("x " + " ".join(WORDS[2:14]) + " y")


# --- truncation ------------------------------------------------------------------------------------------------------

ENDS = {
    "It was so.": "complete", "Was it so?": "complete", 'He said "no."': "complete", "It was [3].": "complete", "It was the": "open", "It was th": "open", "One was. And th": "open", "One was seen. The &#82": "open", "One was s�": "open",
    "So it ended [...]": "open", "So it ended…": "doubtful", "One was.\n\n– 12 –": "closing", "One was.\n\n© 1990 Some Press": "closing", "One was.\n\nKeywords: a; b": "closing", "One was.\n\nReceived 1 May 1990 / Accepted 2 June 1991": "closing",
    "References\nDoe, J. (1999). Things. Journal, 2(1), pp. 3–9": "closing", "One was.\n\nAnna B. Doe\nDepartment of Things\nSomeburg": "closing", "One was.\n\nJournal of Things, vol. 3, no. 2": "closing", "One was.\n\nThe": "open", "The sample of\nhouseholds was": "open",
}


def test_endings(spark):
    df = spark.createDataFrame([(i, t, "s") for i, t in enumerate(ENDS)] + [(90, None, "s"), (91, " \n ", "s"), (92, "Cut he", None)], "doc_id long, text string, source string").withColumn("ending", F.lit(1))
    got = {r.doc_id: r.ending for r in truncation.endings(df, "doc_id", "text", "source").collect()}
    assert {t: got.get(i) for i, t in enumerate(ENDS)} == ENDS
    assert 90 not in got and 91 not in got and got[92] == "open"


def test_limits_are_found_and_others_are_not(spark):
    random.seed(5)
    rows = [(i, "a" if i % 2 else "b", "complete", random.randint(100, 3000)) for i in range(4000)]
    rows += [(9000 + i, "a", "open", 1500) for i in range(60)] + [(9500, "b", "open", 777), (9501, "a", "doubtful", 1500), (9502, "b", "doubtful", 778)]
    ends = spark.createDataFrame(rows, "doc_id long, source string, ending string, chars int").withColumn("bytes", F.col("chars"))
    limits = truncation.length_limits(ends)
    assert {(r.source, r.length) for r in limits.collect()} == {("a", 1500)}
    cut = {r.doc_id: r.rule for r in truncation.truncated(ends, limits, "doc_id").collect()}
    assert cut[9000] == "limit" and cut[9500] == "transfer" and cut[9501] == "limit" and 9502 not in cut
    assert len(cut) == 62
    report = {r.source: (r.texts, r.cut) for r in truncation.source_report(ends, spark.createDataFrame([(9500, "b", "open", "transfer")], "doc_id long, source string, ending string, rule string"), "doc_id").collect()}
    assert report["b"][1] == 1 and report["a"][1] == 0
    assert truncation.length_limits(ends.limit(0)).count() == 0


# --- language --------------------------------------------------------------------------------------------------------


def test_automaton_counts_substrings():
    words = {"banana": 2, "ananas": 1, "nab": 3}
    a = language.SuffixAutomaton(words)
    for piece in ("a", "an", "ana", "nan", " n", "s ", "banana", "na"):
        state = 0
        for ch in piece:
            state = a.next[state][ch]
        want = sum(n * sum(f" {w} ".startswith(piece, i) for i in range(len(w) + 2)) for w, n in words.items())
        assert a.count[state] == want
    assert a.parse("banana") < a.parse("xyzzy")


def test_held_out_accuracy_and_passages(spark, sf):
    """Trained on half of the clearly labelled documents, judged on the abstracts, which it has not seen."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumn("passages", F.lit(0))
    model = language.fit(docs, "doc_id", "text", "lang", rows=10)
    held = spark.read.parquet(f"{sf}/metadata_results.parquet").where("char_length(abstract) > 100").withColumn("label", language.canonical(F.col("language"))).where("label not in ('other')")
    got = language.languages(held, ["result_id", "label"], "abstract", model).collect()
    assert sum(r.lang == r.label for r in got) > 0.85 * len(got)  # some labels are wrong
    en = "The archive shows a slow change. The sample of households covers the whole period. The printed edition follows from it. "
    de = "Das Archiv zeigt einen langsamen Wandel. Die Stichprobe der Haushalte umfasst den ganzen Zeitraum. Der Lesesaal wurde selten genutzt. "
    rows = [(1, en * 3 + de), (2, en * 3 + de.split(". ")[0] + ". " + en), (3, None), (4, "  "), (5, "12 34"), (6, en * 500), (6, en * 500)]
    out = language.languages(spark.createDataFrame(rows, "id long, text string"), ["id"], "text", model)
    out = out.withColumn("second", language.second_language(F.col("passages"), F.col("lang"))).collect()
    assert {(r.id, r.lang, r.second) for r in out} == {(1, "en", "de"), (2, "en", None), (6, "en", None)}
    assert len(out) == 4


def test_labels(spark):
    rows = ["en", "EN-gb", "eng", "English", "nb-NO", "nob", "norsk bokmål", "sv_SE", "suomi", "Deutsch", "nl", "", None, "und", "n/a", "??", "xx"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "i int, x string")
    got = [r.v for r in df.select("i", language.canonical(F.col("x")).alias("v")).orderBy("i").collect()]
    assert got == ["en"] * 4 + ["no"] * 3 + ["sv", "fi", "de", "other"] + [None] * 6
