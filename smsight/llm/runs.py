"""Periodic runs of words, seeded by uniting suffix classes in the order of falling common prefixes.

1. The suffixes of every text are sorted by prefix doubling over word numbers, many texts at a time; only classes of more
   than one suffix are sorted again. The ranks of all doublings give the common prefix (LCP) of neighbours in that order.
2. As in Kruskal's algorithm, neighbours are united by falling LCP: a union-find holds one ordered list of positions for each
   class, and the smaller list goes into the larger one.
3. Where a union makes positions i < j neighbours in their list and their distance is within the LCP, the text from i to
   j + LCP has period j - i. It is a run if it is long enough and no word before i continues it. With an exponent of three or
   more, both positions meet in a union of exactly their LCP with no position of the class between them, so every run is
   seeded once, with its smallest period.

Unions below the least LCP that a run needs are left out. Everything stays inside one text: memory and time follow the slice
of texts at hand, n log n for a text of n words.

Defined results: a null or empty text has no words, no runs and the empty text as what is left; words are told apart by case,
and compared by 64-bit hashes; runs are in the order of start, then period; repeated rows are treated alike; an empty table
gives an empty one. Columns other than id and text are not read and not returned.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from smsight.llm.frames import by_slices
from smsight.llm.words import SPACED, Alphabet, Words, mix

WHITE = r"[\x20\x09-\x0D]+"


class _Exact(Alphabet):
    """Words between white space, upper and lower case apart."""

    def __init__(self):
        super().__init__(separators=b"\x20\x09\x0a\x0b\x0c\x0d")
        self.inside = SPACED.inside.copy()
        self.code = mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))


EXACT = _Exact()


def suffix_neighbours(symbols: np.ndarray, stop: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Neighbours (i, j) in the sorted order of all suffixes whose common prefix has ``least`` symbols or more, and its length.

    ``symbols`` are numbers that differ between texts; suffix i ends at ``stop[i]``, the end of its text.
    """
    n = len(symbols)
    order = np.argsort(symbols, kind="stable")
    ranked = symbols[order]
    new = np.concatenate([[True], ranked[1:] != ranked[:-1]])
    rank = np.full(n + 1, -1, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    levels = [rank.astype(np.int32)]
    step = 1
    while True:
        first = rank[order]
        size = np.diff(np.append(np.flatnonzero(new), n))
        slots = np.flatnonzero(np.repeat(size > 1, size))  # places in the order whose suffixes aren't told apart yet
        if not len(slots):
            break
        open_ = order[slots]
        next_ = open_ + step
        follow = np.where(next_ < stop[open_], rank[np.minimum(next_, n)] + 1, 0)
        by = np.argsort(first[slots] * (n + 2) + follow, kind="stable")  # stays inside each class, as classes are in order
        open_, follow, head = open_[by], follow[by], first[slots][by]
        order[slots] = open_
        apart = np.concatenate([[True], (head[1:] != head[:-1]) | (follow[1:] != follow[:-1])])
        new[slots] = apart
        rank[open_] = np.maximum.accumulate(np.where(apart, slots, 0))
        levels.append(rank.astype(np.int32))
        step *= 2
    i, j = order[:-1], order[1:]
    floor = min(len(levels) - 1, max(0, least.bit_length() - 1))  # 2 ** floor <= least, so equal ranks there are needed
    near = levels[floor][i] == levels[floor][j]
    i, j = i[near], j[near]
    at, to, length = i.copy(), j.copy(), np.zeros(len(i), np.int64)
    for level in reversed(range(len(levels))):
        same = levels[level][at] == levels[level][to]
        length += same << level
        at += same << level
        to += same << level
    keep = length >= least
    return i[keep], j[keep], length[keep]


def seeded_runs(symbols: np.ndarray, begin: np.ndarray, stop: np.ndarray, min_length: int, exponent: int) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs, by positions in ``symbols``; ``begin`` and ``stop`` bound the text of each position."""
    # a run of period q has an LCP of at least (exponent - 1) q and min_length - q
    least = min(max((exponent - 1) * q, min_length - q) for q in range(1, min_length + 1))
    left, right, lcp = suffix_neighbours(symbols, stop, least)
    falling = np.argsort(-lcp, kind="stable")
    parent: dict[int, int] = {}
    places: dict[int, list[int]] = {}
    runs = []

    def find(x: int) -> int:
        if x not in parent:
            parent[x] = x
            places[x] = [x]
            return x
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    def seed(i: int, j: int, common: int) -> None:
        q = j - i
        if (exponent - 1) * q <= common and common + q >= min_length and (i == begin[i] or symbols[i - 1] != symbols[j - 1]):
            runs.append((i, common + q, q))

    for i, j, common in zip(left[falling].tolist(), right[falling].tolist(), lcp[falling].tolist()):
        large, small = find(i), find(j)
        if len(places[large]) < len(places[small]):
            large, small = small, large
        parent[small] = large
        into, moved = places[large], places.pop(small)
        before = -1
        at = 0
        for k, x in enumerate(moved):
            at = bisect_left(into, x, at)
            if at and into[at - 1] > before:
                seed(into[at - 1], x, common)
            if at < len(into) and (k + 1 == len(moved) or moved[k + 1] > into[at]):
                seed(x, into[at], common)
            before = x
        if len(moved) * 8 < len(into):
            for x in moved:
                if x > into[-1]:
                    into.append(x)
                else:
                    into.insert(bisect_left(into, x), x)
        else:
            into += moved
            into.sort()  # two ordered stretches: merged in linear time
    return runs


def _collapsed(words: Words, kept: np.ndarray) -> pa.Array:
    """The kept words of every text, joined by one space."""
    size = len(words.data)
    edge = np.zeros(size + 1, np.int8)
    edge[words.starts[kept]] += 1
    edge[words.ends[kept]] -= 1  # words are apart, but two may touch where a text ends
    inside = np.cumsum(edge[:-1], dtype=np.int8).astype(bool)
    text = words.text_of_word()[kept]
    follows = np.flatnonzero(np.append(text[1:] == text[:-1], False)) if len(text) else np.zeros(0, np.int64)
    gaps = words.ends[kept][follows]  # a separator stands there, as another word of the text follows
    data = words.data.copy()
    data[gaps] = 32
    inside[gaps] = True
    offsets = np.concatenate([[0], np.cumsum(inside)])[words.offsets].astype(np.int64)
    return pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data[inside].tobytes())).cast(pa.string())


def periodic_runs(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = 6, exponent: int = 4) -> DataFrame:
    """(id, ``n_words``, ``runs``, ``collapsed``) of every row.

    A run is a stretch of words with smallest period ``period``, of at least ``min_length`` words and ``exponent`` periods, that
    no neighbouring word continues. ``collapsed`` is the text without the words that some run holds after its first period.
    """
    if exponent < 4 or min_length < 1:
        raise ValueError("runs have four periods or more")
    texts = documents.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        words = Words(batch.column("text"), EXACT)
        text = words.text_of_word()
        _, number = np.unique(words.hashes(), return_inverse=True) if len(words) else (None, np.zeros(0, np.int64))
        begin, stop = words.first[:-1][text], words.first[1:][text]
        symbols = text.astype(np.int64) * (len(words) + 1) + number
        found = np.array(sorted(seeded_runs(symbols, begin, stop, min_length, exponent), key=lambda r: (r[0], r[2])), np.int64).reshape(-1, 3) \
            if len(words) else np.zeros((0, 3), np.int64)
        cover = np.zeros(len(words) + 1, np.int64)
        np.add.at(cover, found[:, 0] + found[:, 2], 1)
        np.add.at(cover, found[:, 0] + found[:, 1], -1)
        kept = np.flatnonzero(np.cumsum(cover[:-1]) == 0)
        ends = np.searchsorted(found[:, 0], words.first)
        start = found[:, 0] - words.first[text[found[:, 0]]] if len(found) else found[:, 0]
        runs = pa.StructArray.from_arrays([pa.array(start), pa.array(found[:, 1].copy()), pa.array(found[:, 2].copy())], ["start", "length", "period"])
        return pa.record_batch({
            "id": batch.column("id"), "n_words": pa.array(words.counts().astype(np.int64)),
            "runs": pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), runs), "collapsed": _collapsed(words, kept)})

    kind = texts.schema["id"].dataType.simpleString()
    return by_slices(texts, "text", work, f"id {kind}, n_words bigint, runs array<struct<start: bigint, length: bigint, period: bigint>>, "
                     "collapsed string").withColumnRenamed("id", id_col)


def runs_text(runs: Column) -> Column:
    """``start,length,period`` of every run, each on a line of its own."""
    line = F.transform(runs, lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")))
    return F.array_join(F.transform(line, lambda x: F.concat(x, F.lit("\n"))), "")


def longest(runs: Column) -> Column:
    """The run of greatest length, of those the one with the smallest start, then period; null without runs."""
    best = F.array_max(F.transform(runs, lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    return F.when(best.isNotNull(), F.struct((-best["start"]).alias("start"), best["length"].alias("length"), (-best["period"]).alias("period")))
