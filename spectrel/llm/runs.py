"""Periodic runs of words, by internal pattern matching.

A run is a stretch of consecutive words with smallest period q (words q apart are equal) of at least max(`least`, `times` * q) words,
`times` 4 or more, that no neighbouring word extends. A period q between 2^(k-1) and 2^k shows in an aligned block of 2^k words: a run
holds one whole, and the block's nearest other occurrence in the run, after or before it, is exactly q words away. So for each
aligned block the nearest occurrences in its neighbouring windows are asked of a wavelet tree over the suffix array of the batch
(range successor and predecessor in the block's interval); the difference, the step of the progression that these occurrences form,
is the candidate period, and the maximal stretch around it is compared word by word.

Words are `[^\\x20\\x09-\\x0D]+`, numbered from 0. Texts are read in batches of about a megabyte of whole texts, each longer text in a
batch of its own; nothing is shuffled. Null text has no words; empty tables give no rows; repeated rows are rows of their own; other
columns are not looked at. Within a batch words are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from spectrel.llm import common

_WORDS = bytes(32 if c == 32 or 9 <= c <= 13 else c for c in range(256))
_BELOW = (np.uint64(1) << np.arange(64, dtype=np.uint64)) - np.uint64(1)


class WaveletTree:
    """Over values below 2**bits: counts and order statistics of ranges of places, for arrays of queries.

    One level for each bit, from the highest; values are dealt stably into those with the bit unset, then those with it set. A level is
    its bits in words of 64 and the count before each word.
    """

    def __init__(self, values: np.ndarray, bits: int):
        self.bits, self.size, self.levels = bits, len(values), []
        for b in range(bits - 1, -1, -1):
            one = (values >> b) & 1 == 1
            packed = np.packbits(one, bitorder="little")
            words = np.zeros(len(values) // 64 + 1, dtype=np.uint64)
            words.view(np.uint8)[: len(packed)] = packed
            before = np.zeros(len(words), dtype=np.int64)
            np.cumsum(np.bitwise_count(words[:-1]), out=before[1:])
            self.levels.append((b, words, before, len(values) - int(one.sum())))
            values = np.concatenate([values[~one], values[one]])

    @staticmethod
    def _ones(words, before, place):
        at = place >> 6
        return before[at] + np.bitwise_count(words[at] & _BELOW[place & 63]).astype(np.int64)

    def below(self, lo: np.ndarray, hi: np.ndarray, value: np.ndarray) -> np.ndarray:
        """How many values at places lo to hi (exclusive) are below value (at most 2**bits - 1)."""
        count = np.zeros(len(lo), dtype=np.int64)
        for b, words, before, zeros in self.levels:
            one_lo, one_hi = self._ones(words, before, lo), self._ones(words, before, hi)
            up = (value >> b) & 1 == 1
            count += np.where(up, (hi - lo) - (one_hi - one_lo), 0)
            lo, hi = np.where(up, zeros + one_lo, lo - one_lo), np.where(up, zeros + one_hi, hi - one_hi)
        return count

    def smallest(self, lo: np.ndarray, hi: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The k-th smallest (from 0) value at places lo to hi (exclusive)."""
        value = np.zeros(len(lo), dtype=np.int64)
        for b, words, before, zeros in self.levels:
            one_lo, one_hi = self._ones(words, before, lo), self._ones(words, before, hi)
            low = (hi - lo) - (one_hi - one_lo)
            up = k >= low
            k = np.where(up, k - low, k)
            value += np.where(up, 1 << b, 0)
            lo, hi = np.where(up, zeros + one_lo, lo - one_lo), np.where(up, zeros + one_hi, hi - one_hi)
        return value


def suffix_blocks(letters: np.ndarray, most: int):
    """The suffix array by prefix doubling, as far as `most` letters tell suffixes apart, and the intervals of blocks on the way.

    Yields (k, rank, ends) after letters 2^k are sorted, k from 1: rank[i] is the first place of the suffixes that share 2^k letters with
    i, ends[rank] the place after the last; last of all ("array", places, None). letters: not negative.
    """
    n = len(letters)
    order = np.argsort(letters, kind="stable")
    rank, ends = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)

    def regroup(sorted_keys, members, slots):
        new = np.flatnonzero(np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]]))
        size = np.diff(np.append(new, len(members)))
        first = slots[new]
        rank[members] = np.repeat(first, size)
        ends[first] = first + size
        return np.repeat(size > 1, size)

    slots = np.arange(n)
    kept = regroup(letters[order], order, slots)
    active, slots = order[kept], slots[kept]
    length, k = 1, 0
    while length <= most and len(active):
        second = np.zeros(len(active), dtype=np.int64)
        inside = active + length < n
        second[inside] = rank[active[inside] + length] + 1
        keys = rank[active] * (n + 1) + second
        by = np.argsort(keys, kind="stable")
        members = active[by]
        order[slots] = members
        kept = regroup(keys[by], members, slots)
        active, slots = members[kept], slots[kept]
        length, k = 2 * length, k + 1
        yield k, rank, ends
    yield "array", order, None


def _extended(letters: np.ndarray, lo: np.ndarray, hi: np.ndarray, d: np.ndarray, start: np.ndarray, end: np.ndarray):
    """The maximal stretches with period d around lo to hi (exclusive), within start to end: lo, hi."""
    lo, hi = lo.copy(), hi.copy()
    for i in range(len(lo)):
        a, b, q, first, last = int(lo[i]), int(hi[i]), int(d[i]), int(start[i]), int(end[i])
        step = 8
        while a > first:
            n = min(step, a - first)
            wrong = np.flatnonzero(letters[a - n : a] != letters[a - n + q : a + q])
            a -= n if not len(wrong) else n - 1 - int(wrong[-1])
            if len(wrong):
                break
            step *= 4
        step = 8
        while b < last:
            n = min(step, last - b)
            wrong = np.flatnonzero(letters[b : b + n] != letters[b - q : b - q + n])
            b += n if not len(wrong) else int(wrong[0])
            if len(wrong):
                break
            step *= 4
        lo[i], hi[i] = a, b
    return lo, hi


def runs_of(letters: np.ndarray, sizes: np.ndarray, least: int = 6, times: int = 4) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts (in the batch), lengths and periods of all runs of texts of `sizes` words; letters: word ids, one text after the other.
    Sorted by start, then period."""
    none = np.zeros(0, dtype=np.int64)
    if times < 4 or least < 5:
        raise ValueError("times is 4 or more, least 5 or more")
    n = len(letters)
    if not n or sizes.max() < least:
        return none, none, none
    ends_of = np.repeat(np.cumsum(sizes), sizes)
    starts_of = ends_of - np.repeat(sizes, sizes)
    # a word of another text is another letter
    _, letter = np.unique(starts_of * (int(letters.max()) + 1) + letters, return_inverse=True)
    asked, places = [], None
    longest = int(sizes.max())
    for k, rank, ends in suffix_blocks(letter.astype(np.int64), max(1, longest // 4)):
        if k == "array":
            places = rank
            break
        at = np.arange(0, n, 1 << k)
        lo = rank[at]
        hi = ends[lo]
        often = (hi - lo > 1) & (at + (1 << k) <= ends_of[at])
        asked.append((np.full(int(often.sum()), k), at[often], lo[often], hi[often]))
    k, at, lo, hi = (np.concatenate(x) for x in zip(*asked, strict=True)) if asked else (none,) * 4
    if not len(k):
        return none, none, none
    # only the places that some block's interval covers are in the tree
    covered = np.zeros(n + 1, dtype=np.int64)
    np.add.at(covered, lo, 1)
    np.add.at(covered, hi, -1)
    covered = np.cumsum(covered)[:-1] > 0
    place = np.concatenate([[0], np.cumsum(covered)])
    tree = WaveletTree(places[covered], n.bit_length())
    lo, hi = place[lo], place[hi]
    count = tree.below(lo, hi, at + 1)  # itself included
    after, before = count < hi - lo, count > 1
    step_after = tree.smallest(lo[after], hi[after], count[after]) - at[after]
    step_before = at[before] - tree.smallest(lo[before], hi[before], count[before] - 2)
    block = np.concatenate([k[after], k[before]])
    d = np.concatenate([step_after, step_before])
    first = np.concatenate([at[after], at[before] - step_before])
    near = (d <= 1 << block) & ((2 * d > 1 << block) | (block == 1))
    block, d, first = block[near], d[near], first[near]
    if not len(d):
        return none, none, none
    # stretches with one period that overlap by the period are one
    by = np.lexsort((first, d))
    d, lo, hi = d[by], first[by], (first + d + (1 << block))[by]
    high = np.maximum.accumulate(hi + d * (2 * n)) - d * (2 * n)  # the farthest end so far, of one period
    new = np.concatenate([[True], (d[1:] != d[:-1]) | (lo[1:] + d[1:] > high[:-1])])
    head = np.flatnonzero(new)
    lo, d, hi = lo[head], d[head], np.maximum.reduceat(hi, head)
    lo, hi = _extended(letter, lo, hi, d, starts_of[lo], ends_of[lo])
    long = hi - lo >= np.maximum(least, times * d)
    found = np.unique(np.stack([lo[long], d[long], hi[long]], axis=1), axis=0)
    return found[:, 0], found[:, 2] - found[:, 0], found[:, 1]


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
SCHEMA = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


def find(documents: DataFrame, rewrite: Callable[[int | None, int], np.ndarray | None] | None = None, least: int = 6, times: int = 4) -> DataFrame:
    """Per row of documents(doc_id, text): doc_id, n_words, runs (by start, then period) and collapsed: the words that stay when of each
    run only its first period's are kept (a word goes if any run drops it), joined by one blank.

    rewrite(doc_id, n) may give the numbers of the original words that stand in the text instead, or None; then all is of that text.
    """

    def spot(batches):
        for batch in common.parts(batches, 1):
            ids, texts = batch.column(0).to_pylist(), [t or b"" for t in batch.column(1).to_pylist()]
            _, _, _, hashes, counts = common.byte_words(texts, _WORDS)
            ends = np.cumsum(counts)
            _, letters = np.unique(hashes, return_inverse=True)
            order = {}
            for i, (doc_id, n) in enumerate(zip(ids, counts.tolist(), strict=True)):
                if rewrite and (put := rewrite(doc_id, n)) is not None:
                    order[i] = put
                    letters[ends[i] - n : ends[i]] = letters[ends[i] - n + put]
            start, length, period = runs_of(letters, counts, least, times)
            text = np.searchsorted(ends, start, side="right")
            bounds = np.searchsorted(text, np.arange(len(texts) + 1))
            fresh = start - (ends - counts)[text]
            drop = np.zeros(len(letters) + 1, dtype=np.int64)
            np.add.at(drop, start + period, 1)
            np.add.at(drop, start + length, -1)
            stays = np.cumsum(drop)[:-1] == 0
            changed = set(order) | set(text.tolist())
            collapsed = []
            for i, t in enumerate(texts):
                words = t.translate(_WORDS).split()
                if i in changed:
                    kept = stays[ends[i] - counts[i] : ends[i]]
                    words = [words[j] for j in (order[i] if i in order else np.arange(counts[i]))[kept].tolist()]
                collapsed.append(b" ".join(words))
            rows = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (fresh, length, period)], fields=list(_RUN))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(counts, pa.int64()), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), rows), pa.array(collapsed, pa.binary()).cast(pa.string())],
                names=["doc_id", "n_words", "runs", "collapsed"],
            )

    return documents.selectExpr("CAST(doc_id AS long) AS doc_id", "CAST(text AS binary) AS text").mapInArrow(spot, SCHEMA)
