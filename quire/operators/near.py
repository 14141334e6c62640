"""Joins of strings that are alike, without rows of all pairs.

``within_edits`` finds every pair within k edits: a string cut into k + 1 even segments has one that stands untouched in
any string within k edits, at most k places off. Segments are the keys of an equi-join, so no beginning, bucket or length
is preferred and nothing is cut. ``alike_titles`` finds pairs of titles by the matching-blocks ratio among those that share
two of their rarer words (the one, in titles of up to two). A block's titles are met in tiles, so that pairs are never
rows before they are found, and a block of common words is spread over many tasks; bounds that no ratio exceeds come
before the ratio. ``titles_of_ratio`` finds every pair by the ratio alone, whatever words are shared or damaged: all
titles meet all in tiles, most pairs as products of matrices only.

All take distinct strings, so copies cost nothing; the rows are joined back by the caller. Defined results: null and
empty strings are like nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions.blocks import Strings, alike_in_letters, enough_letters, ratios
from quire.session import settle

c = F.col

#: Titles on a side of a tile, about; pairs, and titles, that a task meets, about; pairs of small tiles met at once, and cells
#: of their words; pairs from which on a tile is met as a matrix, and pairs left of such tiles that are compared at once.
TILE, PAIRS, TITLES, AT_ONCE, CELLS, MATRIX, LEFT = 1024, 1 << 22, 1 << 17, 1 << 17, 1 << 20, 1 << 12, 1 << 17

#: Of ``titles_of_ratio``: titles on a side of a tile, at most; tasks a core, where tiles are enough; pairs from which on there are
#: more of them, and tasks, at most.
SIDE, SHARE, MANY, TASKS = 1 << 14, 8, 1 << 26, 1 << 13


def _segments(side: str, k: int) -> str:
    """Hashes of the segments that a string is cut into ('index'), or of the places where another's could stand ('probe')."""
    size, start = f"(div((i + 1) * m, {k + 1}) - div(i * m, {k + 1}))", f"div(i * m, {k + 1})"
    size, start = (x.replace("div(", "floor(").replace(f", {k + 1})", f" / {k + 1})") for x in (size, start))
    if side == "index":
        return f"transform(sequence(0, {k}), i -> transform(array(length(s)), m -> xxhash64(m, i, substring(s, cast({start} as int) + 1, cast({size} as int))))[0])"
    low, high = f"cast(greatest(0, {start} - {k}) as int)", f"cast(least({start} + {k}, length(s) - {size}) as int)"
    places = f"if({low} <= {high}, sequence({low}, {high}), cast(array() as array<int>))"
    each = f"transform({places}, p -> xxhash64(m, i, substring(s, p + 1, cast({size} as int))))"
    return f"flatten(transform(sequence(greatest(0, length(s) - {k}), length(s) + {k}), m -> flatten(transform(sequence(0, {k}), i -> {each}))))"


def within_edits(a: DataFrame, b: DataFrame, k: int) -> DataFrame:
    """(a, b, distance): every pair of a string of ``a`` and one of ``b``, both one column, within ``k`` edits."""
    strings = lambda df, n: df.select(c(df.columns[0]).alias("s")).where("s <> ''").distinct().select(c("s").alias(n), "s")
    x = strings(a, "a").select("a", F.explode(F.array_distinct(F.expr(_segments("probe", k)))).alias("key"))
    y = strings(b, "b").select("b", F.explode(F.array_distinct(F.expr(_segments("index", k)))).alias("key"))
    met = x.join(y, "key").where(F.abs(F.length("a") - F.length("b")) <= k).withColumn("distance", F.levenshtein("a", "b", k)).where("distance >= 0")
    return met.select("a", "b", "distance").distinct()


def _blocked(df: DataFrame, counts: DataFrame) -> DataFrame:
    """(s, key, before): each title with its blocks, pairs of the rarer words of which two titles that share half have one;
    ``before`` are the other words up to the pair's, rarest first."""
    words = F.array_distinct(F.filter(F.split("s", " "), lambda w: w != ""))
    each = df.select("s", F.explode(words).alias("w")).join(counts, "w").groupBy("s").agg(F.array_sort(F.collect_list(F.struct("n", "w"))).alias("r"))
    n = F.size("r")
    rarer = F.transform(F.slice("r", F.lit(1), F.least(n, n - F.ceil(n / 2).cast("int") + 2)), lambda x: x.w)
    pairs = "flatten(transform(p, (x, i) -> transform(slice(p, i + 2, size(p)), (y, k) -> struct(xxhash64(x, y) AS key, concat(slice(h, 1, i), slice(h, i + 2, k)) AS before))))"
    single = "transform(p, x -> struct(xxhash64(x) AS key, cast(array() AS array<bigint>) AS before))"
    of = each.select("s", n.alias("n"), rarer.alias("p")).withColumn("h", F.transform("p", lambda x: F.xxhash64(x)))
    return of.select("s", F.explode(F.expr(f"if(n > 3, {pairs}, concat({pairs}, {single}))")).alias("x")).select("s", "x.*")


def _met(batch: pa.RecordBatch, least: float) -> Iterator[pa.RecordBatch]:
    """The pairs of ``least`` ratio and more of a batch of tiles. A pair in several blocks is taken in the one of its rarest
    shared words: where no word before the block's is shared."""
    sides = [batch.column(k).flatten().flatten() for k in (0, 1)]
    each = pa.chunked_array([sides[0][0], sides[1][0]]).combine_chunks().dictionary_encode()
    ids, strings = each.indices.to_numpy(zero_copy_only=False).astype(np.int64), Strings(each.dictionary.to_pylist())
    n, m = (pc.list_value_length(batch.column(k)).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 1))
    x, y = ids[: n.sum()], ids[n.sum() :]
    for i, j in _new_pairs(sides, n, m, lambda i, j: enough_letters(strings, x[i], y[j], least)):
        at, value = ratios(strings, x[i], y[j], least)
        yield pa.record_batch([each.dictionary.take(pa.array(x[i[at]])), each.dictionary.take(pa.array(y[j[at]])), pa.array(value)], ["a", "b", "ratio"])


def _new_pairs(sides, n: np.ndarray, m: np.ndarray, enough) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The pairs of the tiles, of ``n`` and ``m`` titles, that share no word before the block's; of large tiles only those
    that ``enough`` leaves."""
    large = n * m >= MATRIX
    words = [(_starts(side[1]), side[1].flatten().to_numpy(zero_copy_only=False).astype(np.int64)) for side in sides]
    left, size = [], 0
    for k in np.flatnonzero(large):
        x, y = (slice(int(e[k] - c[k]), int(e[k])) for c, e in ((n, np.cumsum(n)), (m, np.cumsum(m))))
        i, j = np.nonzero(enough(x, y) & ~_sharing(*(_words_of(*w, at) for w, at in zip(words, (x, y)))))
        left.append((i + x.start, j + y.start))
        size += len(i)
        if size >= LEFT:
            yield tuple(map(np.concatenate, zip(*left)))
            left, size = [], 0
    if size:
        yield tuple(map(np.concatenate, zip(*left)))
    (words_x, bits_x), (words_y, bits_y) = (_padded(side[1], pad) for pad, side in enumerate(sides))
    partners, first = np.repeat(np.where(large, 0, m), n), np.repeat(np.cumsum(m) - m, n)
    ends = np.cumsum(partners)
    lo = 0
    while lo < len(partners):
        done = ends[lo] - partners[lo]
        hi = max(lo + 1, int(np.searchsorted(ends, done + AT_ONCE, "right")))
        i = np.repeat(np.arange(lo, hi), partners[lo:hi])
        j = np.arange(ends[hi - 1] - done) + np.repeat(first[lo:hi] - (ends[lo:hi] - partners[lo:hi] - done), partners[lo:hi])
        both = np.flatnonzero(bits_x[i] & bits_y[j])
        new = np.ones(len(i), bool)
        for at in np.array_split(both, len(both) * words_x.shape[1] * words_y.shape[1] // CELLS + 1):
            new[at] = ~(words_x[i[at], :, None] == words_y[j[at], None, :]).any(axis=(1, 2))
        if new.any():
            yield i[new], j[new]
        lo = hi


def _starts(lists: pa.ListArray) -> np.ndarray:
    size = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    return np.concatenate([[0], np.cumsum(size)])


def _words_of(starts: np.ndarray, words: np.ndarray, at: slice) -> tuple[int, np.ndarray, np.ndarray]:
    """How many titles stand at ``at``, their words, and the title that each is of."""
    size = np.diff(starts[at.start : at.stop + 1])
    return len(size), words[starts[at.start] : starts[at.stop]], np.repeat(np.arange(len(size)), size)


def _sharing(x: tuple[int, np.ndarray, np.ndarray], y: tuple[int, np.ndarray, np.ndarray]) -> np.ndarray:
    """Which titles of ``x`` and ``y`` share a word, as a matrix: word by word, those that hold it on either side."""
    out = np.zeros((x[0], y[0]), bool)
    both = np.intersect1d(x[1], y[1])
    held = []
    for _, words, owner in (x, y):
        at = np.searchsorted(both, words)
        at[at == len(both)] = 0
        kept = np.flatnonzero(both[at] == words) if len(both) else at[:0]
        kept = kept[np.argsort(at[kept], kind="stable")]
        held.append(np.split(owner[kept], np.searchsorted(at[kept], np.arange(1, len(both)))))
    for i, j in zip(*held) if len(both) else ():
        out[i[:, None], j] = True
    return out


def _padded(lists: pa.ListArray, pad: int) -> tuple[np.ndarray, np.ndarray]:
    """The words of each title in a row, and as bits of which two titles that share a word share one."""
    size = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    words, owner = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.repeat(np.arange(len(size)), size)
    rows, bits = np.full((len(size), max(1, int(size.max(initial=0)))), pad, np.int64), np.zeros(len(size), np.uint64)
    rows[owner, np.arange(len(words)) - np.repeat(np.cumsum(size) - size, size)] = words
    np.bitwise_or.at(bits, owner, np.uint64(1) << (words & 63).astype(np.uint64))
    return rows, bits


def alike_titles(a: DataFrame, b: DataFrame, least: float) -> DataFrame:
    """(a, b, ratio): pairs of a title of ``a`` and one of ``b``, both one column of normal titles, of ``least`` ratio of
    matching blocks and more, that share half of their words."""
    spark = a.sparkSession
    a, b = (settle(df.select(c(df.columns[0]).alias("s")).where("s <> ''").distinct()) for df in (a, b))
    words = a.unionAll(b).select(F.explode(F.array_distinct(F.split("s", " "))).alias("w")).where("w <> ''")
    counts = settle(words.groupBy("w").agg(F.count("*").alias("n")))
    x, y = (settle(_blocked(df, counts)) for df in (a, b))
    sizes = settle(x.groupBy("key").agg(F.count("*").alias("n")).join(y.groupBy("key").agg(F.count("*").alias("m")), "key"))
    pairs, titles = sizes.agg(F.sum(c("n") * c("m")), F.sum(c("n") + c("m"))).first()
    tasks = max(2 * spark.sparkContext.defaultParallelism, (pairs or 0) // PAIRS, (titles or 0) // TITLES)

    def tiled(df: DataFrame, n: str, place: str, side: str) -> DataFrame:
        at = F.pmod(F.xxhash64("s"), F.ceil(c(n) / TILE)).alias(place)
        return df.join(sizes.select("key", n), "key").select("key", at, F.struct("s", "before").alias("t")).groupBy("key", place).agg(F.collect_list("t").alias(side))

    tiles = tiled(x, "n", "i", "xs").join(tiled(y, "m", "j", "ys"), "key").repartition(tasks, "key", "i", "j").select("xs", "ys")
    compare = lambda batches: (found for batch in batches if batch.num_rows for found in _met(batch, least))
    return tiles.mapInArrow(compare, "a string, b string, ratio double").distinct()


def _all_met(batch: pa.RecordBatch, least: float) -> Iterator[pa.RecordBatch]:
    """The pairs of ``least`` ratio and more of each tile of a batch, all with all."""
    for xs, ys in zip(batch.column(0), batch.column(1)):
        each = pa.chunked_array([xs.values, ys.values]).combine_chunks().dictionary_encode()
        ids, strings = each.indices.to_numpy(zero_copy_only=False).astype(np.int64), Strings(each.dictionary.to_pylist())
        for i, j in alike_in_letters(strings, ids[: len(xs.values)], ids[len(xs.values) :], least):
            at, value = ratios(strings, i, j, least, bounded=True)
            yield pa.record_batch([each.dictionary.take(pa.array(i[at])), each.dictionary.take(pa.array(j[at])), pa.array(value)], ["a", "b", "ratio"])


def titles_of_ratio(a: DataFrame, b: DataFrame, least: float) -> DataFrame:
    """(a, b, ratio): every pair of a title of ``a`` and one of ``b``, both one column, of ``least`` ratio of matching blocks
    and more."""
    a, b = (settle(df.select(c(df.columns[0]).alias("s")).where("s <> ''").distinct()) for df in (a, b))
    n, m = a.count(), b.count()
    least_tasks = SHARE * a.sparkSession.sparkContext.defaultParallelism
    side = min(SIDE, 1 + int((n * m / least_tasks) ** 0.5))
    rows, columns = n // side + 1, m // side + 1
    tasks = min(rows * columns, max(least_tasks, n * m // MANY), TASKS)
    tiled = lambda df, k, place, titles: df.groupBy(F.pmod(F.xxhash64("s"), F.lit(k)).alias(place)).agg(F.collect_list("s").alias(titles))
    met = tiled(a, rows, "i", "xs").crossJoin(tiled(b, columns, "j", "ys")).repartitionById(tasks, F.pmod(c("i") * columns + c("j"), F.lit(tasks)).cast("int"))
    compare = lambda batches: (found for batch in batches for found in _all_met(batch, least))
    return met.select("xs", "ys").mapInArrow(compare, "a string, b string, ratio double")
