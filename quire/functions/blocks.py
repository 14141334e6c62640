"""Ratios of matching blocks of many pairs of strings at once, by numpy: upper bounds that no ratio exceeds, then the ratio itself.

The ratio is difflib's, to the letter: the longest matching block, the first in ``a`` and then in ``b`` among equals, and
the same to its left and right. Pairs are bounded first by the letters they share, then by the pairs of neighbouring
letters, then by their longest common subsequence (64 letters a machine word). Strings for which difflib leaves out popular
letters (200 and more) are compared by difflib itself, after the same bounds.
"""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import cached_property

import numpy as np

#: Longest string for the arrays of bytes; pairs compared at once, by subsequences and by blocks; classes that letters are
#: counted in, and the count of one up to which each has its bit.
LONGEST, AT_ONCE, COLUMNS, CLASSES, MOST = 199, 1 << 14, 1 << 12, 64, 32
#: Bits of neighbouring letters; kinds of them that are ranked; strings on the sides of a matrix, and pairs given on at once.
TWOS, KINDS, ROWS, WIDE, LEFT = 512, 1 << 20, 512, 4096, 1 << 17


class Strings:
    """Distinct strings as codes of one alphabet, with their lengths, letter counts and positions."""

    def __init__(self, strings: list[str]):
        self.strings = strings
        self.length = np.fromiter(map(len, strings), np.int64, len(strings))
        points = np.frombuffer("".join(strings).encode("utf-32-le", "surrogatepass"), np.uint32)
        alphabet, codes = np.unique(points, return_inverse=True)
        self.letters = len(alphabet)
        self.start = np.concatenate([[0], np.cumsum(self.length)])
        self.codes = codes.reshape(-1)
        owner = np.repeat(np.arange(len(strings)), self.length)
        self.long = self.length > LONGEST
        self.plain = self.letters < 250
        self.bits = self._unary(owner)
        if self.plain:
            width = int(self.length[~self.long].max(initial=0))
            self.table = np.full((len(strings), width), 255, np.uint8)
            short = ~self.long[owner]
            self.table[owner[short], (np.arange(len(owner)) - self.start[owner])[short]] = self.codes[short]

    def _unary(self, owner: np.ndarray) -> np.ndarray:
        """Each class's count as so many set bits, so that bits two strings share count letters they may share; ``over``
        are those beyond the bits."""
        count = np.bincount(owner * CLASSES + self.codes % CLASSES, minlength=len(self.strings) * CLASSES).reshape(-1, CLASSES)
        self.over = np.maximum(count - MOST, 0).sum(axis=1)
        most = np.minimum(count.max(axis=0, initial=0), MOST)
        unary = np.concatenate([np.arange(m) < count[:, [k]] for k, m in enumerate(most)], axis=1)
        packed = np.packbits(unary, axis=1)
        packed = np.pad(packed, ((0, 0), (0, -packed.shape[1] % 8)))
        return np.ascontiguousarray(np.ascontiguousarray(packed).view(np.uint64).T)

    @cached_property
    def twos(self) -> tuple[np.ndarray, np.ndarray]:
        """The neighbouring letters of each string, its ends among them, as set bits, the commonest with bits apart; and how
        many are beyond the bits."""
        n, size = len(self.strings), self.letters + 2
        owner, at = np.repeat(np.arange(n), self.length), np.arange(len(self.codes))
        first, second = np.full(len(at) + n, size - 2, np.int64), np.full(len(at) + n, size - 1, np.int64)
        first[at + owner + 1], second[at + owner] = self.codes, self.codes
        key = np.sort((np.repeat(np.arange(n), self.length + 1) * size + first) * size + second)
        begins = np.flatnonzero(np.diff(key, prepend=-1))
        again = np.minimum(np.arange(len(key)) - np.repeat(begins, np.diff(begins, append=len(key))), 63)
        kind = (key % size**2 * 64 + again) % min(KINDS, size**2 * 64)
        rank = np.argsort(np.argsort(-np.bincount(kind), kind="stable"))
        has = np.zeros((n, TWOS), bool)
        has[key // size**2, rank[kind] % TWOS] = True
        return np.ascontiguousarray(np.packbits(has, axis=1).view(np.uint64).T), self.length + 1 - has.sum(axis=1)


def enough_letters(s: Strings, a: np.ndarray, b: np.ndarray, least: float) -> np.ndarray:
    """Which pairs of a string of ``a`` and one of ``b`` may share the letters that a ratio of ``least`` needs, as a matrix:
    the letters that two share are the product of their bits, exact in single precision."""
    half = least / 2 * s.length - s.over
    spread = lambda at: np.unpackbits(np.ascontiguousarray(s.bits[:, at].T).view(np.uint8), axis=1).astype(np.float32)
    return spread(a) @ spread(b).T >= np.float32(half[a])[:, None] + (np.float32(least / 2 * s.length[b]) - np.float32(0.01))


def alike_in_letters(s: Strings, a: np.ndarray, b: np.ndarray, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The pairs of all strings of ``a`` with all of ``b`` whose lengths and letters a ratio of ``least`` allows, many at a
    time. As in ``enough_letters``, with the letters that are needed as two more columns of the product."""
    a, b = (x[np.argsort(s.length[x], kind="stable")] for x in (a, b))
    lengths, far = s.length[a], (2 - least) / least
    spread = lambda at: np.unpackbits(np.ascontiguousarray(s.bits[:, at].T).view(np.uint8), axis=1).astype(np.float32)
    column = lambda x: np.asarray(x, np.float32)[:, None]
    slack = np.float32(-0.01 - 1e-6 * s.length.max(initial=0))
    left, size = [], 0
    for y in np.split(b, range(WIDE, len(b), WIDE)):
        if not len(y):
            continue
        theirs = np.hstack([spread(y), column(np.ones(len(y))), column(-least / 2 * s.length[y])]).T
        low, high = np.searchsorted(lengths, [s.length[y[0]] / far - 1e-6, s.length[y[-1]] * far + 1e-6])
        for x in np.split(a[low:high], range(ROWS, high - low, ROWS)):
            ours = np.hstack([spread(x), column(s.over[x] - least / 2 * s.length[x]), column(np.ones(len(x)))])
            at = np.flatnonzero((ours @ theirs).reshape(-1) >= slack)
            for some in np.array_split(at, len(at) // LEFT + 1):
                left.append((x[some // len(y)], y[some % len(y)]))
                size += len(some)
                if size >= LEFT:
                    yield tuple(map(np.concatenate, zip(*left)))
                    left, size = [], 0
    if size:
        yield tuple(map(np.concatenate, zip(*left)))


def enough_twos(s: Strings, a: np.ndarray, b: np.ndarray, least: float) -> np.ndarray:
    """Which pairs share the neighbouring letters that a ratio of ``least`` needs. Of M letters that match in k blocks, M - k
    neighbours do; between two blocks a letter is unmatched, so k is at most 1 more than all letters less 2 M; and the
    ends of the strings match."""
    bits, over = s.twos
    n = np.minimum(over[a], over[b])
    for word in bits:
        n += np.bitwise_count(word[a] & word[b])
    return n >= (1.5 * least - 1) * (s.length[a] + s.length[b]) + 1 - 1e-6


def shared_letters(s: Strings, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """No fewer than the letters that the pairs share, wherever they stand."""
    n = np.minimum(s.over[a], s.over[b])
    for word in s.bits:
        n += np.bitwise_count(word[a] & word[b])
    return n


def common_subsequence(s: Strings, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Lengths of the longest common subsequences of pairs of short strings: one bit a letter of the shorter one."""
    swap = s.length[a] > s.length[b]
    x, y = np.where(swap, b, a), np.where(swap, a, b)  # x is not longer
    out = np.zeros(len(a), np.int64)
    each = np.maximum(s.length[x] + 63, 64) // 64
    for words in range(1, int(each.max(initial=0)) + 1):
        for at in np.array_split(own := np.flatnonzero(each == words), len(own) // AT_ONCE + 1):
            if len(at):
                at = at[np.argsort((LONGEST - s.length[y[at]]).astype(np.uint8), kind="stable")]
                out[at] = _subsequence(s, x[at], y[at], words)
    return out


def _subsequence(s: Strings, x: np.ndarray, y: np.ndarray, words: int) -> np.ndarray:
    place = np.zeros(len(s.length), np.int64)
    place[x] = 1
    own = np.flatnonzero(place)
    place[own] = np.arange(len(own))
    x = place[x]
    masks = np.zeros((words, len(own) * s.letters), np.uint64)
    for t in range(min(64 * words, s.table.shape[1])):
        has = np.flatnonzero(s.length[own] > t)
        masks[t // 64, has * s.letters + s.table[own[has], t]] |= np.uint64(1 << t % 64)
    base, v = x * s.letters, [np.full(len(x), ~np.uint64(0)) for _ in range(words)]
    letters = np.ascontiguousarray(s.table[y].T)
    left = np.searchsorted(-s.length[y], -np.arange(s.table.shape[1]), "left")  # y falls in length: how many are longer than t
    for t in range(s.table.shape[1]):
        if not (n := left[t]):
            break
        at, carry = base[:n] + letters[t, :n], None
        for k in range(words):
            w = v[k][:n]
            u = w & masks[k].take(at)
            total = w + u
            if k + 1 < words:
                over = total < w
            if carry is not None:
                total += carry
            if k + 1 < words:
                carry = over if carry is None else over | (total < carry)
            v[k][:n] = total | (w - u)
    size = s.length[own][x]
    out = np.zeros(len(x), np.int64)
    for k in range(words):
        n = np.clip(size - 64 * k, 0, 64)
        keep = np.where(n == 64, ~np.uint64(0), (np.uint64(1) << np.minimum(n, 63).astype(np.uint64)) - np.uint64(1))
        out += np.bitwise_count(~v[k] & keep)
    return out


def matching_letters(s: Strings, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Letters in difflib's matching blocks of pairs of short strings. Every round takes the longest block of each open
    pair of stretches; what stands left and right of it are the stretches of the next."""
    out = np.zeros(len(a), np.int64)
    pair, a0, a1, b0, b1 = np.arange(len(a)), np.zeros(len(a), np.int64), s.length[a], np.zeros(len(a), np.int64), s.length[b]
    while len(pair):
        i, j, size = (np.zeros(len(pair), np.int64) for _ in range(3))
        order = np.lexsort((a1 - a0, b1 - b0))
        for some in np.array_split(order, len(order) // COLUMNS + 1):
            i[some], j[some], size[some] = _longest(s.table, a[pair[some]], b[pair[some]], a0[some], a1[some], b0[some], b1[some])
        np.add.at(out, pair, size)
        hit = size > 0
        pair, a0, a1, b0, b1, i, j, size = (x[hit] for x in (pair, a0, a1, b0, b1, i, j, size))
        pair, a0, a1, b0, b1 = (np.concatenate(x) for x in ((pair, pair), (a0, i + size), (i, a1), (b0, j + size), (j, b1)))
        open_ = (a0 < a1) & (b0 < b1)
        pair, a0, a1, b0, b1 = (x[open_] for x in (pair, a0, a1, b0, b1))
    return out


def _longest(table, a, b, a0, a1, b0, b1):
    """First longest common block of a[a0:a1] and b[b0:b1], a column a pair: where it begins and its length."""
    width, high = int((b1 - b0).max()), int((a1 - a0).max())
    cols = np.minimum(b0[None, :] + np.arange(width)[:, None], table.shape[1] - 1)
    mine = table[b[None, :], cols]
    mine[np.arange(width)[:, None] >= (b1 - b0)[None, :]] = 254
    rows = np.minimum(a0[None, :] + np.arange(high)[:, None], table.shape[1] - 1)
    theirs = table[a[None, :], rows]
    theirs[np.arange(high)[:, None] >= (a1 - a0)[None, :]] = 255
    run, best = np.zeros((width + 1, len(a)), np.uint8), np.zeros(len(a), np.uint8)
    i, j, new = np.zeros(len(a), np.int64), np.zeros(len(a), np.int64), np.empty_like(run)
    new[0] = 0
    for t in range(high):
        same = mine == theirs[t]
        np.add(run[:-1], 1, out=new[1:])
        new[1:] *= same
        run, new = new, run
        top = run.max(axis=0)
        if len(more := np.flatnonzero(top > best)):
            best[more], i[more] = top[more], t
            j[more] = run[:, more].argmax(axis=0)  # the first place
    size = best.astype(np.int64)
    return a0 + i + 1 - size, b0 + j - size, size


def _long_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence of two strings of any length: a bit a letter of ``a``."""
    places: dict[str, int] = {}
    for k, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << k
    v = every = (1 << len(a)) - 1
    for y in b:
        u = v & places.get(y, 0)
        v = ((v + u) | (v - u)) & every
    return len(a) - v.bit_count()


def ratios(s: Strings, a: np.ndarray, b: np.ndarray, least: float, bounded: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Which of the pairs have ``least`` ratio of matching blocks and more, and these ratios; ``bounded`` by letters already."""
    total = s.length[a] + s.length[b]
    enough = lambda n, at: 2.0 * n / total[at] >= least
    at = np.flatnonzero(2 * np.minimum(s.length[a], s.length[b]) >= least * total - 1e-9)
    if not bounded:
        at = at[enough(shared_letters(s, a[at], b[at]), at)]
    at = at[enough_twos(s, a[at], b[at], least)]
    odd = (s.long[a[at]] | s.long[b[at]]) if s.plain else np.ones(len(at), bool)
    long, at = at[odd], at[~odd]
    at = at[enough(common_subsequence(s, a[at], b[at]), at)]
    value = 2.0 * matching_letters(s, a[at], b[at]) / total[at]
    at, value = at[value >= least], value[value >= least]
    pairs = [(s.strings[x], s.strings[y]) for x, y in zip(a[long].tolist(), b[long].tolist())]
    slow = np.array([SequenceMatcher(None, x, y).ratio() if 2.0 * _long_subsequence(x, y) / (len(x) + len(y)) >= least else -1.0 for x, y in pairs], np.float64)
    return np.concatenate([at, long[slow >= least]]), np.concatenate([value, slow[slow >= least]])
