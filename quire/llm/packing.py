"""Filling containers of fixed capacity with texts, by minimum bin slack on the histogram of their lengths.

Each text is counted in tokens once: its pre-tokens are split as the tokenizer splits them, and the number of tokens
of each distinct pre-token is remembered, which is exact as byte-pair merges never cross pre-tokens. A text longer
than the capacity is cut into pieces of the full capacity and a rest.

The plan needs only the histogram of lengths, at most ``capacity`` numbers however large the corpus. For each bin the
longest length left is taken, and a bitset subset-sum programme over all lengths left, with their multiplicities,
finds the fullest feasible combination. As long as the counts allow, the same combination stays the fullest, so it is
taken many times at once: every round uses some length up, which bounds the rounds by the capacity and not the corpus.

Texts are then numbered within their length, over salted windows (length, shard) and the shards' totals, and the
number gives the container by binary search in the plan. No length's texts meet in one task.

Defined results: null texts have no row; empty texts have 0 tokens and fill container 0; ties are numbered by id.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Folder of the public tokenizers' files, and the vocabulary that sizes are counted in.
TOKENIZERS, VOCABULARY = "/opt/tokenizers", "byte_bpe_50k.tiktoken"
#: Distinct pre-tokens that a worker remembers before it starts afresh; of no effect on the counts.
REMEMBERED = 400_000


class TokenCounter:
    """Numbers of tokens of texts."""

    def __init__(self, folder: str, vocabulary: str) -> None:
        import public_tokenizers
        import regex
        import tiktoken

        with open(f"{folder}/{vocabulary}", "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.coder = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.split = regex.compile(public_tokenizers.PATTERN).findall
        self.known: dict[str, int] = {}

    def __call__(self, text: str) -> int:
        known, total = self.known, 0
        words = self.split(text)
        try:
            return sum(map(known.__getitem__, words))
        except KeyError:
            pass
        if len(known) > REMEMBERED:
            known.clear()
        for w in words:
            n = known.get(w)
            if n is None:
                n = known[w] = len(self.coder.encode_ordinary(w)) if len(w) > 1 or not w.isascii() else 1
            total += n
        return total


#: Shards that the texts of one length are numbered in (fixed, so that containers do not depend on the session), and the
#: bound on capacities.
SHARDS, WIDEST = 256, 1 << 20


def token_counts(df: DataFrame, id_col: str, text_col: str, folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """(id, n_tokens) of every text that is not null."""
    source = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.col("text").isNotNull())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = TokenCounter(folder, vocabulary)
        for batch in batches:
            sizes = pa.array([counter(x) for x in batch.column(1).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), sizes], names=["id", "n_tokens"])

    return source.mapInArrow(count, f"id {source.schema['id'].dataType.simpleString()}, n_tokens bigint").withColumnRenamed("id", id_col)


def fullest(counts: dict[int, int], room: int) -> list[tuple[int, int]]:
    """The fullest combination of the lengths with their counts that fits into ``room``, as (length, times)."""
    bits, steps, mask = 1, [], (1 << (room + 1)) - 1
    for length in sorted((x for x in counts if 0 < x <= room and counts[x]), reverse=True):
        left, k = min(counts[length], room // length), 1
        while left:
            k = min(k, left)
            steps.append((length, k, bits))
            bits |= (bits << (length * k)) & mask
            left -= k
            k *= 2
        if bits >> room & 1:
            break
    target, taken = bits.bit_length() - 1, {}
    for length, k, before in reversed(steps):
        if not before >> target & 1:
            target -= length * k
            taken[length] = taken.get(length, 0) + k
    return list(taken.items())


def plan(histogram: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int]], int]:
    """((length, first number, first container, times per container), ...) and the number of containers."""
    counts, used, slots, bins = dict(histogram), {}, [], 0
    lengths = sorted((x for x in counts if x > 0), reverse=True)
    for seed in lengths:
        while counts[seed]:
            counts[seed] -= 1
            taken = dict(fullest(counts, capacity - seed))
            counts[seed] += 1
            taken[seed] = taken.get(seed, 0) + 1
            times = min(counts[x] // k for x, k in taken.items())
            for x, k in taken.items():
                slots.append((x, used.get(x, 0), bins, k))
                used[x] = used.get(x, 0) + k * times
                counts[x] -= k * times
            bins += times
    return slots, bins


def pack(sizes: DataFrame, id_col: str, capacities: dict[str, int]) -> DataFrame:
    """(size_name, container_id, id, piece_no, n_tokens, start_token): every piece of every text in one container of
    each capacity. ``sizes`` has (id, n_tokens) and must read the same each time, as a written table does."""
    spark = sizes.sparkSession
    if any(not 0 < int(x) < WIDEST for x in capacities.values()):
        raise ValueError(f"capacities must be from 1 to {WIDEST - 1}")
    caps = F.array(*(F.struct(F.lit(n).alias("size_name"), F.lit(int(c)).cast("long").alias("capacity")) for n, c in sorted(capacities.items())))
    each = sizes.select(F.col(id_col).alias("id"), "n_tokens", F.explode(caps).alias("c")).select("id", "n_tokens", "c.*")
    last = F.greatest(F.ceil(F.col("n_tokens") / F.col("capacity")).cast("int"), F.lit(1))
    pieces = each.select("*", F.explode(F.sequence(F.lit(1), last)).alias("piece_no")).withColumn("start_token", (F.col("piece_no") - 1) * F.col("capacity"))
    pieces = pieces.withColumn("n", F.least("capacity", F.col("n_tokens") - F.col("start_token")))
    pieces = pieces.withColumn("shard", F.pmod(F.xxhash64("id", "piece_no"), F.lit(SHARDS)).cast("int"))
    counted = pieces.groupBy("size_name", "n", "shard").agg(F.count("*").alias("rows"))
    totals = counted.groupBy("size_name", "n").agg(F.sum("rows").alias("rows")).collect()  # at most the capacities' sum of rows
    keys, firsts, bins, times = [], [], [], []
    order = {name: i for i, name in enumerate(sorted(capacities))}
    wide = 1 << 36  # numbers within one length
    for name, i in order.items():
        slots, _ = plan({r["n"]: r["rows"] for r in totals if r["size_name"] == name}, int(capacities[name]))
        for length, first, container, k in slots:
            keys.append((length + i * WIDEST) * wide + first)
            firsts.append(first)
            bins.append(container)
            times.append(k)
    at = np.argsort(np.asarray(keys, np.int64), kind="stable")
    sent = spark.sparkContext.broadcast(tuple(np.asarray(x, np.int64)[at] for x in (keys, firsts, bins, times)))
    number = {name: i * WIDEST for name, i in order.items()}
    before = F.sum("rows").over(Window.partitionBy("size_name", "n").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counted.select("size_name", "n", "shard", F.coalesce(before, F.lit(0)).alias("offset"))
    inside = F.row_number().over(Window.partitionBy("size_name", "n", "shard").orderBy("id", "piece_no")) - 1
    ranked = pieces.withColumn("inside", inside).join(offsets, ["size_name", "n", "shard"])
    ranked = ranked.select("size_name", F.col("id"), "piece_no", F.col("n").alias("n_tokens"), "start_token", (F.col("inside") + F.col("offset")).alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, firsts, bins, times = sent.value
        for batch in batches:
            size = np.asarray([number[x] for x in batch.column(0).to_pylist()], np.int64)
            n, rank = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            container = np.zeros(len(n), np.int64)
            some = n > 0
            if some.any():
                where = np.searchsorted(keys, (n[some] + size[some]) * wide + rank[some], side="right") - 1
                container[some] = bins[where] + (rank[some] - firsts[where]) // times[where]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(container), *(batch.column(i) for i in range(1, 5))], names=["size_name", "container_id", "id", "piece_no", "n_tokens", "start_token"])

    kind = ranked.schema["id"].dataType.simpleString()
    return ranked.mapInArrow(place, f"size_name string, container_id bigint, id {kind}, piece_no int, n_tokens bigint, start_token bigint").withColumnRenamed("id", id_col)


def fill_report(packed: DataFrame, capacities: dict[str, int]) -> DataFrame:
    """(size_name, capacity_tokens, containers, tokens, least_containers, fill_share) of each capacity."""
    caps = F.create_map(*(x for n, c in capacities.items() for x in (F.lit(n), F.lit(int(c)))))
    per = packed.groupBy("size_name", "container_id").agg(F.sum("n_tokens").alias("tokens"))
    out = per.groupBy("size_name").agg(F.count("*").alias("containers"), F.sum("tokens").alias("tokens"), F.max("tokens").alias("fullest"))
    out = out.withColumn("capacity_tokens", caps[F.col("size_name")])
    least = F.ceil(F.col("tokens") / F.col("capacity_tokens"))
    return out.withColumn("least_containers", least).withColumn("fill_share", F.col("tokens") / (F.col("containers") * F.col("capacity_tokens")))
