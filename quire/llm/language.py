"""The language of texts and of passages, by cross-parsing entropy.

For each language the words of a bounded sample of labelled texts go into a suffix automaton that counts how often
every piece of a word occurs. A text is parsed against each language into the longest pieces that the automaton knows;
each piece (phrase) costs the logarithm of its rarity, so many short or rare phrases cost much. The language with the
least cost per letter wins. Phrases end at word ends, so the costs of a word are computed once per worker.

A sentence gets a language if it has enough running words and the margin is clear; others join their neighbours.
Three or more successive sentences of one other language are a passage of their own.

One narrow pass over the texts; the model is a few thousand words per language, bounded by the sample. Defined
results: texts that are null, blank or have no letters have no language; long texts are parsed whole; repeated rows
come out alike; a label that says nothing is null.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LANGS = ("en", "de", "no", "sv", "fr", "es", "fi")
#: Labelled texts per language that the model is fitted on (the bound of the sample), and letters taken of them all.
SAMPLE_ROWS, SAMPLE_CHARS = 200, 300_000
#: Least words, and running ones (not capitalised) among them, and least margin (bits per letter) of a sentence with a
#: language; sentences of a passage.
LEAST_WORDS, LEAST_RUNNING, MARGIN, PASSAGE = 5, 3, 0.25, 3
#: What a capitalised word counts, which is often a name of no language.
NAMES = 0.25
REMEMBERED = 300_000

# Codes and names of the languages.
_NAMES = {
    "en": "en eng english englisch engelsk engelska anglais inglés englanti",
    "de": "de deu ger german deutsch tysk tyska allemand alemán saksa",
    "no": "no nor nob nb norwegian norsk norwegisch norska bokmål bokmal norvégien noruego norja",
    "sv": "sv swe swedish svenska svensk schwedisch suédois sueco ruotsi",
    "fr": "fr fra fre french français francais französisch fransk franska francés ranska",
    "es": "es spa spanish español espanol castellano spanisch spansk spanska espagnol espanja",
    "fi": "fi fin finnish suomi finnisch finsk finska finnois finlandés finés",
}


def canonical(label: Column) -> Column:
    """The code of a label; null if it says nothing, 'other' for other languages."""
    pairs = [F.lit(x) for code, names in _NAMES.items() for name in names.split() for x in (name, code)]
    first = F.regexp_extract(F.lower(F.trim(label)), r"^(\p{L}+)", 1)
    nothing = F.coalesce(first, F.lit("")).isin("", "und", "unknown", "xx", "zxx", "mul", "mis", "none", "null", "n", "na", "unspecified", "other")
    return F.when(nothing, None).otherwise(F.coalesce(F.element_at(F.create_map(*pairs), first), F.lit("other")))


class SuffixAutomaton:
    """All pieces of weighted words, with their number of occurrences."""

    def __init__(self, words: dict[str, int]) -> None:
        self.next: list[dict[str, int]] = [{}]
        self.link, self.length, self.count = [-1], [0], [0]
        for word, weight in words.items():
            last = 0
            for c in f" {word} ":
                last = self._extend(last, c)
                self.count[last] += weight
        for s in sorted(range(1, len(self.length)), key=self.length.__getitem__, reverse=True):
            self.count[self.link[s]] += self.count[s]
        self.total = max(1, sum(w * (len(x) + 2) for x, w in words.items()))
        self.cost = [math.log2(2 * self.total / max(n, 0.5)) for n in self.count]

    def _clone(self, p: int, c: str, q: int) -> int:
        if self.length[q] == self.length[p] + 1:
            return q
        k = len(self.length)
        self.next.append(dict(self.next[q]))
        self.link.append(self.link[q])
        self.length.append(self.length[p] + 1)
        self.count.append(0)
        self.link[q] = k
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = k
            p = self.link[p]
        return k

    def _extend(self, last: int, c: str) -> int:
        q = self.next[last].get(c)
        if q is not None:
            return self._clone(last, c, q)
        new = len(self.length)
        self.next.append({})
        self.link.append(0)
        self.length.append(self.length[last] + 1)
        self.count.append(0)
        p = last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p >= 0:
            self.link[new] = self._clone(p, c, self.next[p][c])
        return new

    def parse(self, word: str) -> float:
        """The cost of the phrases that `` word `` falls into, each the longest known piece from where the last ended."""
        text, at, total, state, nexts = f" {word} ", 0, 0.0, 0, self.next
        n = len(text)
        while at < n:
            state, start = 0, at
            while at < n and (s := nexts[state].get(text[at])) is not None:
                state, at = s, at + 1
            if at == start:
                total += math.log2(4 * self.total)  # a letter the language lacks
                at += 1
            else:
                total += self.cost[state]
        return total


_WORD = re.compile(r"[^\W\d_]+")
_BREAK = re.compile(r"(?<=\w)[-­]\n\s*(?=[a-zà-ÿ])")
_SENTENCE = re.compile(r"(?<=[.!?…])[\"'”’»)\]]*\s+(?=[\"'“‘«(\[]*[^\W\d_a-zà-öø-ÿ])|\n\s*\n")


class Parser:
    """Costs of words under every language, remembered."""

    def __init__(self, model: dict[str, dict[str, int]]) -> None:
        self.automata = [SuffixAutomaton(model.get(x, {})) for x in LANGS]
        self.reset()

    def reset(self) -> None:
        self.number: dict[str, int] = {}
        self.costs: list[list[float]] = []
        self.sizes: list[int] = []

    def _learn(self, word: str) -> int:
        low = word.lower()
        n = self.number[word] = len(self.costs)
        self.costs.append([a.parse(low) for a in self.automata])
        self.sizes.append(len(word) if word[0].islower() else -len(word))  # negative: not a running word
        return n

    def sentences(self, texts: list[str | None]) -> tuple[np.ndarray, ...]:
        """(text number, letters, running words, words, costs per language, start, end) of every sentence that has words."""
        if len(self.costs) > REMEMBERED:
            self.reset()
        ids: list[int] = []
        owner, starts, begin, end = [], [], [], []
        number, learn, find = self.number, self._learn, _WORD.findall
        for n, text in enumerate(texts):
            if not text:
                continue
            if "\n" in text:
                text = _BREAK.sub("", text)
            at = 0
            for stop in [*(m.start() for m in _SENTENCE.finditer(text)), len(text)]:
                words = find(text, at, stop)
                if words:
                    owner.append(n)
                    starts.append(len(ids))
                    begin.append(at)
                    end.append(stop)
                    for w in words:
                        k = number.get(w)
                        ids.append(learn(w) if k is None else k)
                at = stop
        if not ids:
            zero = np.zeros(0, np.int64)
            return zero, zero, zero, zero, np.zeros((0, len(LANGS))), zero, zero
        where, first = np.asarray(ids), np.asarray(starts)
        sizes = np.asarray(self.sizes)[where]
        weight = np.where(sizes > 0, 1.0, NAMES)
        costs = np.add.reduceat(np.asarray(self.costs)[where] * weight[:, None], first, axis=0)
        letters = np.add.reduceat(np.abs(sizes) * weight, first)
        running = np.add.reduceat((sizes > 0).astype(np.int64), first)
        counts = np.diff(np.r_[first, len(where)])
        return np.asarray(owner), letters, running, counts, costs, np.asarray(begin), np.asarray(end)

    def judge(self, texts: list[str | None]) -> list[dict]:
        """For each text with letters: its number, language, confidence, and runs (language, sentences, letters,
        first sentence's start, last one's end, confidence)."""
        owner, letters, running, words, costs, begin, end = self.sentences(texts)
        if not len(owner):
            return []
        two = np.partition(costs, 1, axis=1)
        clear = (words >= LEAST_WORDS) & (running >= LEAST_RUNNING) & (running * 2 >= words) & ((two[:, 1] - two[:, 0]) >= MARGIN * letters)
        best = np.argmin(costs, axis=1)
        out, edges = [], np.flatnonzero(np.diff(owner, prepend=-1, append=-1))
        for a, b in zip(edges[:-1], edges[1:]):
            known = [i for i in range(a, b) if clear[i]]
            shares = np.zeros(len(LANGS))
            runs: list[list] = []
            for i in range(a, b):
                if not clear[i]:
                    if runs and runs[-1][0] == best[i] and running[i] >= LEAST_RUNNING:
                        runs[-1][1] += 1  # an unclear sentence amid its like
                    continue
                shares[best[i]] += letters[i]
                if runs and runs[-1][0] == best[i]:
                    runs[-1][1] += 1
                    runs[-1][2] += letters[i]
                    runs[-1][4] = end[i]
                    runs[-1][5] += costs[i]
                else:
                    runs.append([best[i], 1, letters[i], begin[i], end[i], costs[i].copy()])
            total = costs[a:b].sum(axis=0)
            main = int(np.argmax(shares)) if known else int(np.argmin(total))
            basis = sum((costs[i] for i in known if best[i] == main), np.zeros(len(LANGS))) if known else total
            size = sum(letters[i] for i in known if best[i] == main) if known else letters[a:b].sum()
            out.append({"n": int(owner[a]), "lang": main, "confidence": confidence(basis, size, main), "runs": [(int(r[0]), r[1], round(r[2]), int(r[3]), int(r[4]), confidence(r[5], r[2], int(r[0]))) for r in runs]})
        return out


def confidence(costs: np.ndarray, letters: float, lang: int) -> float:
    """Share of the language among all, by their costs; sharper the longer the text, up to some sentences."""
    per = (costs - costs.min()) / max(1, letters) * min(letters, 200.0) / 8
    weights = np.exp2(-per)
    return round(float(weights[lang] / weights.sum()), 6)


def fit(df: DataFrame, id_col: str, text_col: str, label_col: str, rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS) -> dict[str, dict[str, int]]:
    """Word counts per language of a bounded sample of the labelled texts.

    The sample is the ``rows`` labelled ids of each language with the least hash, found without reading any text.
    Labels may be wrong; words are weighed by their number, so a language's own words outweigh strays.
    """
    labels = df.select(F.col(id_col).alias("id"), canonical(F.col(label_col)).alias("lang")).where(F.col("lang").isin(*LANGS))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id")
    chosen = labels.withColumn("k", F.row_number().over(order)).where(F.col("k") <= rows).select("id", "lang").distinct()
    texts = df.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    counts: dict[str, Counter] = {x: Counter() for x in LANGS}
    used = Counter()
    for r in sorted(texts.join(F.broadcast(chosen), "id").collect(), key=lambda r: (r["lang"], r["id"], r["text"])):  # at most rows * languages ids
        if used[r["lang"]] < chars:
            counts[r["lang"]].update(w for w in _WORD.findall(_BREAK.sub("", r["text"]).lower()))
            used[r["lang"]] += len(r["text"])
    return {x: dict(c) for x, c in counts.items()}


_PARSERS: dict[str, Parser] = {}


def languages(df: DataFrame, keys: list[str], text_col: str, model: dict[str, dict[str, int]]) -> DataFrame:
    """(keys, lang, confidence, passages) of every text with letters; passages are the runs of sentences in one
    language as structs (lang, sentences, letters, start, end, confidence)."""
    sent, key = df.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex  # a worker fits its parser once
    source = df.select(*keys, F.col(text_col).alias("text")).where(F.col("text").isNotNull())
    names = list(keys)
    run = pa.struct([("lang", pa.string()), ("sentences", pa.int32()), ("letters", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("confidence", pa.float64())])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _PARSERS:
            _PARSERS.clear()
            _PARSERS[key] = Parser(sent.value)
        parser = _PARSERS[key]
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                found = parser.judge(part.column("text").to_pylist())
                kept = part.take(pa.array([x["n"] for x in found], pa.int64()))
                runs = [[dict(zip(("lang", "sentences", "letters", "start", "end", "confidence"), (LANGS[r[0]], *r[1:]))) for r in x["runs"]] for x in found]
                yield pa.RecordBatch.from_arrays(
                    [*(kept.column(k) for k in names), pa.array([LANGS[x["lang"]] for x in found], pa.string()), pa.array([x["confidence"] for x in found], pa.float64()), pa.array(runs, pa.list_(run))],
                    names=[*names, "lang", "confidence", "passages"],
                )

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in source.schema.fields if f.name != "text")
    return source.mapInArrow(judge, f"{fields}, lang string, confidence double, passages array<struct<lang:string,sentences:int,letters:bigint,start:bigint,end:bigint,confidence:double>>")


def second_language(passages: Column, lang: Column, least: int = PASSAGE) -> Column:
    """The other language with the longest passage of at least ``least`` sentences; null if there is none."""
    others = F.filter(passages, lambda p: (p.lang != lang) & (p.sentences >= least))
    return F.array_max(F.transform(others, lambda p: F.struct(p.sentences.alias("s"), p.letters.alias("l"), p.lang.alias("lang")))).lang
