"""Benchmark decontamination: a prefix-filtered containment join of item windows against whole documents.

A window is ``window`` consecutive words of a benchmark item (an item of fewer words is one window). Each window is a
sequence of tokens, runs of up to three words. Containment asks for all of them, so one necessary token is enough to
find every occurrence: the one that the corpus has least often. Documents are looked up by those tokens only; the offset
of the token inside its window gives where the window would begin, which must fit into the document, and the words there
are compared one by one, as 64-bit hashes.

Windows, their tokens and the choice of the rarest are tables: the benchmark is cut by tasks, a bitmap of its tokens (at
most 2^30 bits) tells which tokens of documents are counted, and the counts are joined to the tokens of the windows. A
window with a token that no document has is left out. What remains is dealt by hash into blocks of about ``block_words``
words, however long an item is and however many items share a window; only those blocks pass through the driver, to be
broadcast. The documents are read once for the counts and once for the lookups of up to four blocks; no document is moved.

Defined results: a null or empty text has no words and no hits; an item without words matches nothing; repeated documents
are judged row by row; repeated items count once; a null item id stands as the empty string. Other columns are untouched.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from smsight.llm.frames import Scratch, by_slices, lists, written
from smsight.llm.words import ALPHANUMERIC, Words, shingles, slices

WINDOW = 10
TOKEN = 3
BLOCK_WORDS = 1 << 23
STAGE_BLOCKS = 4  # blocks that one stage holds at a time; beyond them the documents found so far are written
CUT_ROWS = 1 << 14  # windows in one Arrow batch
FILTER_BITS = 22, 30  # least and greatest size of the bitmap of tokens, as powers of 2
_LOOKUP_BITS = 22
_MAP_BITS = 15  # Spark's bitmap functions keep 2^15 bits in a row


class Lookup:
    """Sorted tokens behind a bitmap that turns most others away."""

    def __init__(self, tokens: np.ndarray):
        self.tokens = np.sort(tokens)
        self.bitmap = np.zeros(1 << _LOOKUP_BITS, bool)
        self.bitmap[self.tokens >> np.uint64(64 - _LOOKUP_BITS)] = True

    def find(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where values hold a token, and the number of that token."""
        at = np.flatnonzero(self.bitmap[values >> np.uint64(64 - _LOOKUP_BITS)])
        number = np.searchsorted(self.tokens, values[at])
        number[number == len(self.tokens)] = 0
        same = self.tokens[number] == values[at] if len(self.tokens) else np.zeros(len(at), bool)
        return at[same], number[same]


def _runs(hashes: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Runs of exactly ``size`` words: their hashes and the number of the word they begin with."""
    value, begins = shingles(hashes, first, size)
    counts = np.diff(first)
    full = counts >= size
    text = np.repeat(np.arange(len(counts)), np.diff(begins))
    start = first[text] + np.arange(len(value)) - begins[text]
    keep = full[text]
    return value[keep] + np.uint64(size), start[keep]


class Block:
    """Some windows: their words, the items that have them, and the token that each is looked up by."""

    def __init__(self, rows: pa.Table):
        words = rows.column("words").combine_chunks()
        flat = words.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
        tokens = rows.column("token").to_numpy().view(np.uint64)
        order = np.argsort(tokens, kind="stable")
        counts = words.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        begins = np.concatenate([[0], np.cumsum(counts)[:-1]])[order]
        self.lengths = counts[order]
        self.word_first = np.concatenate([[0], np.cumsum(self.lengths)])
        self.words = flat[np.repeat(begins - self.word_first[:-1], self.lengths) + np.arange(len(flat))]
        self.offset = rows.column("offset").to_numpy().astype(np.int64)[order]
        self.owners = rows.column("item").combine_chunks().dictionary_encode().take(pa.array(order))
        self.sizes = sorted({min(TOKEN, n) for n in np.unique(counts).tolist()})
        self.lookup = Lookup(np.unique(tokens))
        self.token_first = np.searchsorted(tokens[order], np.append(self.lookup.tokens, 0))
        self.token_first[-1] = len(tokens)

    def owner(self, window: int) -> str:
        return self.owners[window].as_py()

    def occurrences(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """Verified occurrences: number of the first word, number of the window."""
        hashes, text = words.hashes(), None
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for start, number in _known(words, self.sizes, self.lookup):
            if not len(start):
                continue
            text = words.text_of_word() if text is None else text
            n = self.token_first[number + 1] - self.token_first[number]
            window = np.repeat(self.token_first[number] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
            begin, owner = np.repeat(start, n) - self.offset[window], np.repeat(text[start], n)
            fits = (begin >= words.first[owner]) & (begin + self.lengths[window] <= words.first[owner + 1])
            begin, window = begin[fits], window[fits]
            for step in range(int(self.lengths[window].max()) if len(window) else 0):
                inside = step < self.lengths[window]
                same = ~inside
                same[inside] = hashes[begin[inside] + step] == self.words[self.word_first[window[inside]] + step]
                begin, window = begin[same], window[same]
            found.append((begin, window))
        return np.concatenate([b for b, _ in found]), np.concatenate([w for _, w in found])


def _known(words: Words, sizes: list[int], lookup: Lookup) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Where documents have a token of the lookup, for each size of tokens: number of its first word, number of the token."""
    hashes = words.hashes()
    for size in sizes:
        value, start = _runs(hashes, words.first, size)
        at, number = lookup.find(value)
        yield start[at], number


def item_windows(benchmark: DataFrame, item_col: str, text_col: str, window: int) -> DataFrame:
    """(item, words, tokens): every window of every item, as hashes of its words and of its tokens in order."""
    part = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).cast("string").alias("text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            words = Words(batch.column("text"), ALPHANUMERIC)
            hashes, names = words.hashes().view(np.int64), batch.column("item").fill_null("")
            for i, (begin, end) in enumerate(zip(words.first[:-1].tolist(), words.first[1:].tolist())):
                if begin == end:
                    continue
                size = min(window, end - begin)
                token, _ = _runs(hashes[begin:end].view(np.uint64), np.array([0, end - begin]), min(TOKEN, size))
                for first in range(0, end - begin - size + 1, CUT_ROWS):
                    rows = min(CUT_ROWS, end - begin - size + 1 - first)
                    columns = [np.lib.stride_tricks.sliding_window_view(x[first:first + rows + k - 1], k) for x, k in
                               ((hashes[begin:end], size), (token.view(np.int64), size - min(TOKEN, size) + 1))]
                    yield pa.record_batch({"item": pa.repeat(names[i], rows)} | {
                        c: lists(x.ravel(), np.arange(rows + 1) * x.shape[1], pa.int64()) for c, x in zip(("words", "tokens"), columns)})

    return part.mapInArrow(cut, "item string, words array<bigint>, tokens array<bigint>")


def token_bitmap(tokens: DataFrame) -> np.ndarray:
    """Which values the highest bits of the tokens have, 8 bits for each token within bounds: at most 128 MB."""
    n = tokens.agg(F.approx_count_distinct("token").alias("n")).first()["n"]
    bits = min(max(math.ceil(math.log2(8 * n + 1)), FILTER_BITS[0]), FILTER_BITS[1])
    high = F.shiftrightunsigned("token", 64 - bits)
    maps = tokens.select(F.shiftright(high, _MAP_BITS).alias("part"), high.bitwiseAND(F.lit((1 << _MAP_BITS) - 1)).alias("bit"))
    out = np.zeros(1 << bits, bool)
    for row in maps.groupBy("part").agg(F.bitmap_construct_agg("bit").alias("map")).toLocalIterator():
        begin = row.part << _MAP_BITS
        out[begin:begin + (1 << _MAP_BITS)] = np.unpackbits(np.frombuffer(row.map, np.uint8), bitorder="little")
    return np.packbits(out)


def token_counts(documents: DataFrame, text_col: str, bitmap: np.ndarray, sizes: list[int]) -> DataFrame:
    """(token, n): how often documents have the tokens that the bitmap knows, some others among them."""
    sent = documents.sparkSession.sparkContext.broadcast(bitmap)
    shift = np.uint64(64 - (8 * len(bitmap)).bit_length() + 1)

    def tally(batch: pa.RecordBatch) -> pa.RecordBatch:
        words, held = Words(batch.column(0), ALPHANUMERIC), sent.value
        found = [np.zeros(0, np.uint64)]
        for size in sizes:
            value, _ = _runs(words.hashes(), words.first, size)
            high = value >> shift
            found.append(value[(held[high >> np.uint64(3)] << (high & np.uint64(7)).astype(np.uint8)) & np.uint8(128) != 0])
        token, n = np.unique(np.concatenate(found), return_counts=True)
        return pa.record_batch({"token": pa.array(token.view(np.int64)), "n": pa.array(n, pa.int64())})

    rows = by_slices(documents.select(F.col(text_col).cast("string").alias("text")), "text", tally, "token bigint, n bigint")
    return rows.groupBy("token").agg(F.sum("n").alias("n"))


def rarest_tokens(windows: DataFrame, counts: DataFrame) -> DataFrame:
    """(item, words, offset, token): every window by the token that documents have least often (ties: the first one).

    Windows with a token that no document has can't occur and are left out.
    """
    tokens = windows.select("item", "words", F.posexplode("tokens").alias("offset", "token"))
    counted = tokens.join(counts, "token", "left")
    least = F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "offset", "token")).alias("least")
    return counted.groupBy("item", "words").agg(least).where("least.n > 0").select("item", "words", "least.offset", "least.token")


def _blocks(documents: DataFrame, benchmark: DataFrame, text_col: str, item_col: str, item_text_col: str, window: int,
            block_words: int) -> Iterator[Block]:
    scratch = Scratch(documents.sparkSession)
    try:
        windows = scratch.keep(item_windows(benchmark, item_col, item_text_col, window).dropDuplicates(["item", "words"]), "windows")
        lengths = windows.select(F.least(F.size("words"), F.lit(TOKEN)).alias("n")).distinct()
        sizes = sorted(r["n"] for r in lengths.collect())  # at most three
        if not sizes:
            return
        bitmap = token_bitmap(windows.select(F.explode("tokens").alias("token")))
        chosen = scratch.keep(rarest_tokens(windows, token_counts(documents, text_col, bitmap, sizes)), "chosen")
        total = chosen.agg(F.sum(F.size("words")).alias("n")).first()["n"] or 0
        blocks = -(-total // block_words)
        for number in range(blocks):
            rows = chosen.where(F.pmod(F.xxhash64("words", "item"), F.lit(blocks)) == number).toArrow()
            if rows.num_rows:
                yield Block(rows)
    finally:
        scratch.drop()


def benchmark_hits(documents: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id",
                   item_text_col: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The documents with ``n_words``, ``hit_words`` (numbers of the words inside occurring windows) and ``hit_items``."""
    if window < 1:
        raise ValueError("a window has at least one word")
    spark = documents.sparkSession
    added = {"n_words": "bigint", "hit_words": "array<int>", "hit_items": "array<string>"}
    own = [c for c in documents.columns if c not in added]
    out = documents.select(*own)
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in out.schema] + [f"{k} {v}" for k, v in added.items()])

    def scan(block, begun: bool):
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            words = Words(batch.column(text_col).cast(pa.string()), ALPHANUMERIC)
            hit, items = defaultdict(set), defaultdict(set)
            if block is not None:
                begin, number = block.value.occurrences(words)
                text = words.text_of_word()
                for b, w in zip(begin.tolist(), number.tolist()):
                    at = int(text[b])
                    items[at].add(block.value.owner(w))
                    b -= int(words.first[at])
                    hit[at].update(range(b, b + int(block.value.lengths[w])))
            if begun:
                for i, (h, n) in enumerate(zip(batch.column("hit_words").to_pylist(), batch.column("hit_items").to_pylist())):
                    hit[i].update(h)
                    items[i].update(n)
            columns = {c: batch.column(c) for c in own} | {
                "n_words": pa.array(words.counts(), pa.int64()),
                "hit_words": pa.array([sorted(hit.get(i, ())) for i in range(batch.num_rows)], pa.list_(pa.int32())),
                "hit_items": pa.array([sorted(items.get(i, ())) for i in range(batch.num_rows)], pa.list_(pa.string()))}
            return pa.record_batch(columns)
        return work

    passes = 0
    for block in _blocks(documents, benchmark, text_col, item_col, item_text_col, window, block_words):
        if passes and passes % STAGE_BLOCKS == 0:
            out = written(out, "hits")
        out = by_slices(out, text_col, scan(spark.sparkContext.broadcast(block), passes > 0), schema)
        passes += 1
    return out if passes else by_slices(out, text_col, scan(None, False), schema)


def items_digest(items: Column) -> Column:
    return F.sha2(F.concat_ws(",", F.sort_array(items)), 256)
