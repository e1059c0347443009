"""Near copies by 64-bit SimHash fingerprints, compared as bit planes.

1. A fingerprint bit is one where more than half of a text's shingle hashes have it (XXH64 of the space-joined words, seed 42,
   repeats included). Texts are grouped by fingerprint first, so copies cost one comparison together.
2. Fingerprints within ``radius`` bits agree in one of ``radius + 1`` parts of the word. Each part is a bucket key. A bucket of
   more than ``bucket_rows`` members is cut by the same argument over the bits it doesn't fix, up to LEVELS times; then so few
   bits are free (14 at radius 2) that a bucket can't hold more than 2 ** 14 fingerprints. Nothing is dropped on the way.
3. Inside buckets the fingerprints are stored vertically: plane p holds bit p of 64 fingerprints to a machine word. One
   fingerprint is compared with a whole word: planes are XORed with its bit, two at a time, into carry-save counters, 64
   distances at once. Words of which every distance has passed the radius are abandoned every few planes.
4. Matches are united inside the batch, so a bucket gives at most one link for each member, and components are found by Spark.

Defined results: a null or empty text, or one of white space, has fingerprint zero and is linked like any other; a text with
fewer words than a shingle is one shingle of all its words; a tie of ones and zeros gives a zero; repeated rows are copies; a
null id never becomes a component id unless all ids of the component are null. An empty table gives an empty one. Columns
other than id and text are not read and not returned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from smsight.llm.components import components
from smsight.llm.frames import Scratch, by_slices
from smsight.llm.words import SPACED, Words

SEED = 42
LEVELS = 4
BUCKET_ROWS = 8192
BATCH_ROWS = 1 << 16  # members of complete buckets that one comparison holds
ITEMS = 1 << 16  # comparisons of a fingerprint with a word of 64 that are updated together
_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
# four 16-bit counters for the four bits of a nibble
_SPREAD = np.array([sum((n >> b & 1) << (16 * b) for b in range(4)) for n in range(16)], np.uint64)
_HASHED = 1 << 16  # shingles hashed at a time
_COUNTED = 1 << 15  # most shingles that 16-bit counters add up


def _shingle_hashes(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of every shingle of a slice's texts, and where each text's begin, with the end."""
    keep = words.alphabet.inside[words.data]
    after = words.ends[words.ends < len(keep)]
    keep[after] = True  # one separator stays behind every word
    at = np.cumsum(keep)
    text = np.where(words.alphabet.inside[words.data], _LOWER[words.data], np.uint8(32))[keep].tobytes()
    starts = at[words.starts] - 1
    ends = starts + (words.ends - words.starts)
    counts = words.counts()
    made = np.where(counts >= size, counts - size + 1, (counts > 0).astype(counts.dtype))
    begins = np.concatenate([[0], np.cumsum(made)])
    first = np.repeat(words.first[:-1] - begins[:-1], made) + np.arange(begins[-1])
    last = first + np.repeat(np.minimum(counts, size), made) - 1
    hashes = np.zeros(begins[-1], np.uint64)
    digest = xxhash.xxh64_intdigest
    for i in range(0, len(hashes), _HASHED):
        part = slice(i, i + _HASHED)
        spans = zip(starts[first[part]].tolist(), ends[last[part]].tolist())
        some = [digest(text[s:e], SEED) for s, e in spans]
        hashes[part] = np.array(some, np.uint64)
    return hashes, begins


def _majority(hashes: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """For each text the word of bits that are set in over half of its hashes."""
    total = np.diff(begins)
    out = np.zeros(len(total), np.uint64)
    some = np.flatnonzero(total)
    if not len(some):
        return out
    pieces = -(-total[some] // _COUNTED)
    owner = np.repeat(np.arange(len(some)), pieces)
    within = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    cuts = begins[:-1][some][owner] + within * _COUNTED
    for nibble in range(16):
        lanes = np.add.reduceat(_SPREAD[(hashes >> np.uint64(4 * nibble)) & np.uint64(15)], cuts)
        for b in range(4):
            ones = np.bincount(owner, ((lanes >> np.uint64(16 * b)) & np.uint64(65535)).astype(np.float64)).astype(np.int64)
            out[some] |= (2 * ones > total[some]).astype(np.uint64) << np.uint64(4 * nibble + b)
    return out


def fingerprints(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3) -> DataFrame:
    """(id, fp, n_shingles) of every row; ``fp`` is the fingerprint as a signed 64-bit number."""
    texts = documents.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        hashes, begins = _shingle_hashes(Words(batch.column("text"), SPACED), size)
        return pa.record_batch({"id": batch.column("id"), "fp": pa.array(_majority(hashes, begins).view(np.int64)),
                                "n_shingles": pa.array(np.diff(begins).astype(np.int64))})

    return by_slices(texts, "text", work, f"id {texts.schema['id'].dataType.simpleString()}, fp bigint, n_shingles bigint")


def _parts(mask: int, n: int) -> list[int]:
    """``mask`` with each of ``n`` equal parts of the bits it doesn't fix added."""
    free = [b for b in range(64) if not mask >> b & 1]
    return [mask | sum(1 << b for b in part.tolist()) for part in np.array_split(np.array(free, object), n) if len(part)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _united(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``parent`` (every entry a root) after joining a[i] with b[i]; roots are the least members."""
    while True:
        a, b = parent[a], parent[b]
        apart = a != b
        if not apart.any():
            return parent
        a, b = np.minimum(a[apart], b[apart]), np.maximum(a[apart], b[apart])
        parent[b] = a
        while True:
            up = parent[parent]
            if np.array_equal(up, parent):
                break
            parent = up


def near_in_buckets(prints: np.ndarray, starts: np.ndarray, fixed: int, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i < j) of fingerprints of one bucket within ``radius`` bits, a bounded batch at a time.

    ``prints`` are sorted by bucket, ``starts`` says where buckets begin; the bits of ``fixed`` are equal inside a bucket.
    """
    n = len(prints)
    words = -(-n // 64)
    lanes = np.zeros(words * 64, np.uint64)
    lanes[:n] = prints
    bits = np.unpackbits(lanes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    planes = np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view(np.uint64)
    free = [b for b in range(64) if not fixed >> b & 1]
    stop = np.repeat(np.append(starts[1:], n), np.diff(np.append(starts, n)))  # end of each one's bucket
    here = np.arange(n)
    low = (here + 1) >> 6
    count = np.where(here + 1 < stop, ((stop - 1) >> 6) - low + 1, 0)
    done = np.concatenate([[0], np.cumsum(count)])
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(done, done[at] + ITEMS, "right")) - 1)
        owner = np.repeat(np.arange(at, to), count[at:to])
        word = low[owner] + (np.arange(len(owner)) - np.repeat(done[at:to] - done[at], count[at:to]))
        at = to
        if len(owner):
            yield _compared(prints, planes, free, owner, word, stop, radius)


def _compared(prints, planes, free, owner, word, stop, radius) -> tuple[np.ndarray, np.ndarray]:
    begin = np.maximum(owner + 1 - word * 64, 0).astype(np.uint64)
    end = np.minimum(stop[owner] - word * 64, 64).astype(np.uint64)  # 1..64
    over = ~((_ALL >> (np.uint64(64) - end)) & (_ALL << begin))  # lanes outside the bucket, or not behind the owner, are done
    digits = [np.zeros(len(owner), np.uint64) for _ in range(max(1, radius.bit_length()))]
    value = prints[owner]

    def plane(b: int) -> np.ndarray:
        return planes[b][word] ^ (np.uint64(0) - ((value >> np.uint64(b)) & np.uint64(1)))

    dead = over
    for k in range(0, len(free), 2):
        x = plane(free[k])
        half = digits[0] ^ x
        carry = digits[0] & x
        if k + 1 < len(free):
            y = plane(free[k + 1])
            carry |= half & y
            half = half ^ y
        digits[0] = half
        for d in range(1, len(digits)):
            digits[d], carry = digits[d] ^ carry, digits[d] & carry
        over = over | carry
        if k % 8 == 6 or k + 2 >= len(free):
            above, same = np.zeros(len(over), np.uint64), np.full(len(over), _ALL)
            for d in reversed(range(len(digits))):
                if radius >> d & 1:
                    same &= digits[d]
                else:
                    above |= same & digits[d]
                    same &= ~digits[d]
            dead = over | above
            left = dead != _ALL
            if not left.any():
                return np.zeros(0, np.int64), np.zeros(0, np.int64)
            if left.mean() < 0.8:
                owner, word, value, over, dead = owner[left], word[left], value[left], over[left], dead[left]
                digits = [d[left] for d in digits]
    lanes = np.unpackbits((~dead).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    item, lane = np.nonzero(lanes)
    return owner[item], word[item] * 64 + lane


def _links(members: DataFrame, radius: int) -> DataFrame:
    """(a, b): every member linked inside its bucket, with the least of those it is united with there."""
    dealt = members.repartition("mask", "value").sortWithinPartitions("mask", "value", "fp")

    def linked(mask: int, value: np.ndarray, prints: np.ndarray) -> pa.RecordBatch | None:
        starts = np.flatnonzero(np.concatenate([[True], value[1:] != value[:-1]]))
        parent = np.arange(len(prints))
        for a, b in near_in_buckets(prints.view(np.uint64), starts, mask, radius):
            parent = _united(parent, a, b)
        some = np.flatnonzero(parent != np.arange(len(prints)))
        return pa.record_batch({"a": pa.array(prints[some]), "b": pa.array(prints[parent[some]])}) if len(some) else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
            for mask in np.unique(rows[0]):
                own = rows[:, rows[0] == mask]
                out = linked(int(mask) % (1 << 64), own[1], np.ascontiguousarray(own[2]))
                if out is not None:
                    yield out

        for batch in batches:
            held.append(np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("mask", "value", "fp")]))
            if sum(x.shape[1] for x in held) >= BATCH_ROWS:
                rows = np.concatenate(held, axis=1)
                last = np.flatnonzero((rows[0] != rows[0, -1]) | (rows[1] != rows[1, -1]))
                whole = last[-1] + 1 if len(last) else 0  # the last bucket may go on
                if whole:
                    yield from flush(rows[:, :whole])
                held = [rows[:, whole:]]
        if held:
            yield from flush(np.concatenate(held, axis=1))

    return dealt.mapInArrow(run, "a bigint, b bigint")


def near_links(distinct: DataFrame, keep, radius: int = 2, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Links (a, b) whose components are those of all pairs of ``distinct`` (fp) within ``radius`` bits."""
    masks = _parts(0, radius + 1)
    level = distinct.select("fp", F.explode(F.array(*(F.lit(_signed(m)) for m in masks))).alias("mask"))
    found = None
    for depth in range(LEVELS):
        level = level.withColumn("value", F.col("fp").bitwiseAND(F.col("mask")))
        sizes = keep(level.groupBy("mask", "value").agg(F.count(F.lit(1)).alias("k")).where("k > 1"), "sizes")
        more = depth + 1 < LEVELS and not sizes.where(F.col("k") > bucket_rows).isEmpty()
        own = sizes.where(F.col("k") <= bucket_rows) if more else sizes
        part = keep(_links(level.join(own.select("mask", "value"), ["mask", "value"]), radius), "near")
        found = part if found is None else found.unionByName(part)
        if not more:
            break
        children = {m: _parts(m, radius + 1) for m in masks}
        table = F.create_map(*(x for m, c in children.items() for x in (F.lit(_signed(m)), F.array(*(F.lit(_signed(y)) for y in c)))))
        large = level.join(sizes.where(F.col("k") > bucket_rows).select("mask", "value"), ["mask", "value"])
        level = keep(large.select("fp", F.explode(table[F.col("mask")]).alias("mask")), "level")
        masks = [y for c in children.values() for y in c]
    return found


def simhash_components(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, radius: int = 2,
                       bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(id, ``fp``, ``n_shingles``, ``component_id``) for every row: the component of texts whose fingerprints link."""
    if size < 1 or not 0 <= radius < 16 or bucket_rows < 1:
        raise ValueError("a shingle has at least one word, the radius lies in 0..15, a bucket holds a row")
    spark = documents.sparkSession
    scratch, result = Scratch(spark), Scratch(spark)
    keep = scratch.keep
    rows = keep(fingerprints(documents, id_col, text_col, size), "fingerprints")
    distinct = keep(rows.groupBy("fp").agg(F.min("id").alias("least")), "distinct")
    label = components(near_links(distinct.select("fp"), keep, radius, bucket_rows), keep)
    linked = keep(distinct.join(label, distinct.fp == label.node).select("fp", "least", "label"), "linked")
    least = linked.groupBy("label").agg(F.min("least").alias("component_id"))
    known = keep(linked.join(least, "label").select("fp", "component_id"), "known")
    alone = distinct.join(known, "fp", "left_anti").select("fp", F.col("least").alias("component_id"))
    out = result.keep(rows.join(known.unionByName(alone), "fp").select(F.col("id").alias(id_col), "fp", "n_shingles", "component_id"), "components")
    scratch.drop()
    return out
