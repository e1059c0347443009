"""Language identification by prediction by partial matching over bytes.

For every language a tree of byte contexts up to ``MAX_ORDER`` is counted on labelled texts and then frozen. A byte seen
after a context c times of n, with d different ones, has probability c / (n + d) there; else the escape d / (n + d) is paid
and the context shortened by its oldest byte, down to equal probabilities over all symbols. The code length of a text under a
language is the sum over its bytes, and the language with the shortest one is predicted.

Bytes become symbols first: A-Z as a-z, digits, spaces and other ASCII characters as one separator, runs of separators as
one. Since statistics are frozen, the code length of a byte after its context is a number that can be worked out before:
dense tables hold it for contexts up to order 2, and for every context of order 3 that was seen in any language.

Training reads ``PER_LANGUAGE`` different rows of each language (those with the least hashes) as whole texts; contexts are
counted text by text and summed by Spark, so the counts don't depend on batches or partitions. Scoring reads every whole text.

Defined results: a null text, or one without a letter, is ``und`` with score 0; equal code lengths go to the lesser name;
repeated rows repeat; without labelled rows everything is ``und``. score is the share of the predicted language when code
lengths (in bits per symbol, times the square root of the number of symbols) are turned into probabilities.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from smsight.llm.frames import by_slices, lists
from smsight.llm.words import text_bytes

PER_LANGUAGE = 400
SEPARATOR = 0

#: symbol of every byte: 0 separator, 1..26 letters, then the bytes of characters beyond ASCII
SYMBOL = np.zeros(256, np.int32)
SYMBOL[97:123] = SYMBOL[65:91] = np.arange(1, 27)
SYMBOL[128:192] = np.arange(27, 91)
SYMBOL[0xC2:0xF5] = np.arange(91, 142)
SIZE = 142


def symbols(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all texts, each begun by a separator, and where each text's begin, with the end."""
    value = SYMBOL[data]
    keep = np.ones(len(value), bool)
    keep[1:] = (value[1:] != SEPARATOR) | (value[:-1] != SEPARATOR)
    begins = offsets[:-1][offsets[:-1] < len(value)]
    keep[begins] = value[begins] != SEPARATOR
    counts = np.concatenate([[0], np.cumsum(keep)])[offsets]
    out = np.insert(value[keep], counts[:-1], SEPARATOR)
    return out, counts + np.arange(len(counts))


def contexts(value: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Positions of the symbols after each text's first one, and the three symbols before them (separators before a text)."""
    inside = np.ones(len(value), bool)
    inside[begins[:-1]] = False
    at = np.flatnonzero(inside)
    before = np.zeros((3, len(value)), np.int32)
    for k in (1, 2, 3):
        before[k - 1, k:] = value[:-k]
        for j in range(k):  # the first k symbols of a text look back into the one before
            edge = begins[:-1] + j
            edge = edge[edge < begins[1:]]
            before[k - 1, edge] = SEPARATOR
    return at, before[0][at], before[1][at], before[2][at]


@dataclass
class Model:
    """Code lengths in bits: ``short[c2, c1, symbol]`` and, where ``node[c3, c2, c1]`` is above 0, ``long[node, symbol]``."""

    languages: list[str]
    node: np.ndarray
    short: np.ndarray
    long: np.ndarray


def code_lengths(count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tables of one language from its counts[c3, c2, c1, symbol] in sparse form: rows of (code, n), code = mixed radix.

    Returns the order 2 table and, for every context of order 3, its code and its row of code lengths.
    """
    code, n = count[:, 0], count[:, 1].astype(float)
    symbol = code % SIZE
    floor = np.full(SIZE, 1.0 / SIZE)

    def refine(key: np.ndarray, lower) -> tuple[np.ndarray, np.ndarray]:
        """Probabilities after each context in ``key``, which escape to ``lower(contexts)``."""
        pair, inverse = np.unique(key * SIZE + symbol, return_inverse=True)
        total = np.bincount(inverse, weights=n)
        of, row = np.unique(pair // SIZE, return_inverse=True)
        seen = np.zeros((len(of), SIZE))
        seen[row, pair % SIZE] = total
        different = (seen > 0).sum(1, keepdims=True)
        whole = seen.sum(1, keepdims=True) + different
        return of, np.where(seen > 0, seen / whole, different / whole * lower(of))

    _, order0 = refine(np.zeros(len(code), np.int64), lambda of: floor[None])
    order1 = np.repeat(order0, SIZE, 0)
    of, p = refine(code // SIZE % SIZE, lambda of: order0[np.zeros(len(of), int)])
    order1[of] = p
    order2 = np.tile(order1, (SIZE, 1))  # row c2 * SIZE + c1 escapes to row c1
    of, p = refine(code // SIZE % SIZE ** 2, lambda of: order1[of % SIZE])
    order2[of] = p
    of, p = refine(code // SIZE, lambda of: order2[of % SIZE ** 2])
    return -np.log2(order2), of, -np.log2(p)


def train(documents: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
          per_language: int = PER_LANGUAGE) -> Model:
    """Count contexts of labelled rows for which ``learn`` holds and freeze them."""
    lang, text = F.col(lang_col).cast("string"), F.col(text_col).cast("string")
    rows = documents.where(learn & lang.isNotNull() & text.isNotNull()).select(
        lang.alias("lang"), F.xxhash64(F.col(id_col).cast("string"), text).alias("h"), text.alias("text"))
    # every task keeps its own least hashes of each language before they meet
    place = F.dense_rank().over(Window.partitionBy("lang").orderBy("h"))
    least = rows.select("lang", "h").withColumn("place", place).where(F.col("place") <= per_language).groupBy("lang").agg(F.max("h").alias("up_to"))
    limits = {r.lang: r.up_to for r in least.collect()}  # a row for each language
    languages = sorted(limits)
    if not languages:
        return Model([], np.zeros(1, np.int32), np.zeros((1, 1), np.float32), np.zeros((1, 1), np.float32))
    up_to = F.create_map(*(F.lit(x) for item in limits.items() for x in item))
    sample = rows.where(F.col("h") <= up_to[F.col("lang")]).groupBy("h", "lang").agg(F.first("text").alias("text"))
    number = {name: i for i, name in enumerate(languages)}

    def tally(batch: pa.RecordBatch) -> pa.RecordBatch:
        value, begins = symbols(*text_bytes(batch.column("text")))
        at, c1, c2, c3 = contexts(value, begins)
        text_of = np.searchsorted(begins, at, "right") - 1
        lang_of = np.array([number[x] for x in batch.column("lang").to_pylist()], np.int64)[text_of]
        code = (((lang_of * SIZE + c3) * SIZE + c2) * SIZE + c1) * SIZE + value[at]
        edges = np.searchsorted(text_of, np.arange(batch.num_rows + 1))
        codes, counts, ends = [], [], [0]
        for a, b in zip(edges, edges[1:]):
            own, n = np.unique(code[a:b], return_counts=True)
            codes.append(own)
            counts.append(n)
            ends.append(ends[-1] + len(own))
        return pa.record_batch({"code": lists(np.concatenate(codes), ends, pa.int64()), "n": lists(np.concatenate(counts), ends, pa.int64())})

    by_text = by_slices(sample.select("lang", "text"), "text", tally, "code array<bigint>, n array<bigint>")
    pairs = by_text.select(F.explode(F.arrays_zip("code", "n")).alias("x")).select("x.code", "x.n")
    counts = pairs.groupBy("code").agg(F.sum("n").alias("n")).toPandas().to_numpy(np.int64)  # contexts of a bounded sample
    short, long, seen = [], [], []
    for i in range(len(languages)):
        own = counts[counts[:, 0] // SIZE ** 4 == i]
        own = np.stack([own[:, 0] % SIZE ** 4, own[:, 1]], 1)
        table, of, rows3 = code_lengths(own)
        short.append(table)
        long.append((of, rows3))
        seen.append(of)
    nodes = np.unique(np.concatenate(seen))
    node = np.zeros(SIZE ** 3, np.int32)
    node[nodes] = np.arange(1, len(nodes) + 1)
    long_table = np.zeros((len(nodes) + 1, SIZE, len(languages)), np.float32)
    for i, (of, rows3) in enumerate(long):
        long_table[1:, :, i] = short[i][nodes % SIZE ** 2]  # contexts that this language has not seen escape for nothing
        at = np.searchsorted(of, nodes)
        at[at == len(of)] = 0
        has = of[at] == nodes
        long_table[1:][has, :, i] = rows3[at[has]]
    return Model(languages, node, np.stack(short, -1).astype(np.float32).reshape(SIZE ** 3, -1), long_table.reshape(-1, len(languages)))


def predict(documents: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The documents with ``lang_pred`` and ``score``."""
    own = [c for c in documents.columns if c not in ("lang_pred", "score")]
    out = documents.select(*own)
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in out.schema] + ["lang_pred string", "score double"])
    sent = documents.sparkSession.sparkContext.broadcast(model)

    def score(batch: pa.RecordBatch) -> pa.RecordBatch:
        m, column = sent.value, batch.column(text_col).cast(pa.string())
        names, share = np.full(batch.num_rows, "und", object), np.zeros(batch.num_rows)
        if m.languages:
            data, offsets = text_bytes(column)
            value, begins = symbols(data, offsets)
            at, c1, c2, c3 = contexts(value, begins)
            pair = c2 * SIZE + c1
            node = m.node[c3 * SIZE ** 2 + pair]
            bits = m.short[pair * SIZE + value[at]]
            deep = np.flatnonzero(node)
            bits[deep] = m.long[node[deep] * SIZE + value[at[deep]]]
            sums = np.concatenate([np.zeros((1, len(m.languages))), np.cumsum(bits, 0, dtype=np.float64)])
            edges = np.searchsorted(at, begins)
            total, n = sums[edges[1:]] - sums[edges[:-1]], np.maximum(np.diff(edges), 1)
            best = total.argmin(1)
            odds = (total - total.min(1, keepdims=True)) / np.sqrt(n)[:, None]
            certain = 1 / np.exp2(-np.minimum(odds, 60)).sum(1)
            letters = np.add.reduceat(np.concatenate([value, [0]]) > 0, begins[:-1]) > 0
            plain = np.concatenate([[0], np.cumsum((SYMBOL[data] > 0) & (data < 128))])
            for i in np.flatnonzero(letters & (plain[offsets[1:]] == plain[offsets[:-1]])):  # signs beyond ASCII may be no letters
                letters[i] = any(c.isalpha() for c in column[int(i)].as_py() or "")
            names[letters], share[letters] = np.array(m.languages, object)[best[letters]], certain[letters]
        return pa.record_batch({c: batch.column(c) for c in own} | {"lang_pred": pa.array(names, pa.string()), "score": pa.array(share)})

    return by_slices(out, text_col, score, schema)
