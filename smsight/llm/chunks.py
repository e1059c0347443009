"""Content-defined chunking of payloads, with one stored copy of each chunk.

A text becomes a payload: its UTF-8 bytes and bytes 0 up to a positive multiple of 64, taken as 8-bit samples. A gear hash
rolls over it, and a chunk ends where the lowest bits of the hash are 0, but not before ``least`` and not after ``most``
bytes. Since the hash sees the last 32 bytes only, equal passages get equal chunks wherever they stand.

Each row keeps its ordered chunk list, the recipe. Chunks are joined by digest: the store holds every digest once, with its
samples compressed losslessly. Reading joins recipes with the store, puts the chunks in order and verifies the payload digest.

Stored form of a payload: the columns of its recipe as 4 bytes ``CDC1``, the payload's length and the number of chunks (64 bits
each, little endian), then for each chunk its length (32 bits) and digest (32 bytes); after it the compressed samples of its
chunks in order, byte for byte as the store holds them. ``media_bytes`` and ``media_sha256`` are those of this form.

Defined results: a null text is the empty one, whose payload is 64 bytes 0; equal texts have equal payloads, recipes and
features, and share one rebuilt payload; repeated rows repeat; an empty table gives an empty one.
"""

from __future__ import annotations

import bz2
import hashlib
import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from smsight.llm.frames import by_slices, release, written
from smsight.llm.words import mix
from smsight.session import scratch_path

UNIT = 64
LEAST, MASK_BITS, MOST = 2048, 13, 65536  # chunks of about 10 KB in long payloads
HOT_PLACES = 10_000  # a chunk in more places is joined apart, where Spark may split its rows
_GEAR = (mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32)


def gear(data: np.ndarray) -> np.ndarray:
    """The gear hash after each byte: the sum over the last 32 bytes of code << distance, built by doubling."""
    out = _GEAR[data]
    for step in (1, 2, 4, 8, 16):
        more = out.copy()
        more[step:] += out[:-step] << np.uint32(step)
        out = more
    return out


def cuts(data: np.ndarray, least: int = LEAST, mask_bits: int = MASK_BITS, most: int = MOST) -> list[int]:
    """Where chunks end."""
    marks = np.flatnonzero((gear(data) & np.uint32((1 << mask_bits) - 1)) == 0) + 1
    out, at, n = [], 0, len(data)
    while at < n:
        k = int(np.searchsorted(marks, at + least))
        end = min(int(marks[k]) if k < len(marks) else n, at + most, n)
        out.append(end)
        at = end
    return out


def padded(text: bytes) -> bytes:
    return text + bytes(max(UNIT, -(-len(text) // UNIT) * UNIT) - len(text))


def recipe_bytes(payload_bytes: int, lengths: list[int], digests: list[bytes]) -> bytes:
    head = b"CDC1" + struct.pack("<QQ", payload_bytes, len(lengths))
    return head + b"".join(struct.pack("<I", n) + d for n, d in zip(lengths, digests))


def _chunks(text: bytes) -> tuple[bytes, list[bytes]]:
    data = padded(text)
    ends = cuts(np.frombuffer(data, np.uint8))
    return data, [data[a:b] for a, b in zip([0, *ends[:-1]], ends)]


def store_media(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Recipes (id, payload_sha256, n_bytes, lengths, digests) of all rows and the store (digest, samples): written tables.

    The store is bucketed by digest, so reading it for a join moves none of its samples. Texts are cut twice, once for the
    recipes and once for the store, which is cheaper than carrying samples beside recipes.
    """
    spark = documents.sparkSession
    rows = documents.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def recipe(batch: pa.RecordBatch) -> pa.RecordBatch:
        columns: list[list] = [[] for _ in range(4)]
        for text in pc.fill_null(batch.column("text").cast(pa.binary()), b"").to_pylist():
            data, parts = _chunks(text)
            for column, value in zip(columns, (hashlib.sha256(data).digest(), len(text), [len(p) for p in parts],
                                               [hashlib.sha256(p).digest() for p in parts])):
                column.append(value)
        return pa.record_batch({
            "id": batch.column("id"), "payload_sha256": pa.array(columns[0], pa.binary()), "n_bytes": pa.array(columns[1], pa.int64()),
            "lengths": pa.array(columns[2], pa.list_(pa.int32())), "digests": pa.array(columns[3], pa.list_(pa.binary()))})

    def samples(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = {}
        for text in pc.fill_null(batch.column("text").cast(pa.binary()), b"").to_pylist():
            for part in _chunks(text)[1]:
                digest = hashlib.sha256(part).digest()
                if digest not in own:
                    own[digest] = bz2.compress(part)
        return pa.record_batch({"digest": pa.array(list(own), pa.binary()), "samples": pa.array(list(own.values()), pa.binary())})

    recipes = written(by_slices(rows, "text", recipe, f"id {kind}, payload_sha256 binary, n_bytes bigint, lengths array<int>, "
                                                      "digests array<binary>"), "recipes")
    store = by_slices(rows, "text", samples, "digest binary, samples binary").dropDuplicates(["digest"])
    name = f"chunk_store_{os.urandom(6).hex()}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    store.write.format("parquet").bucketBy(buckets, "digest").option("path", scratch_path(spark, "store")).saveAsTable(name)
    kept = spark.table(name)
    kept.schema  # resolved: the name is not needed any more, the files stay
    spark.sql(f"DROP TABLE {name}")
    release(spark)
    return recipes, kept


FEATURES = "payload_sha256 binary, payload_bytes bigint, read_sha256 string, tail_crc32 bigint, media_bytes bigint, " \
           "media_sha256 string, feature string, n_chunks int"


def read_media(recipes: DataFrame, store: DataFrame, hot_places: int = HOT_PLACES) -> DataFrame:
    """Features of every distinct payload, computed on the bytes that the store gives back; a wrong payload is an error.

    feature: samples' sum, number of zero samples, and mean absolute step between neighbours in thousandths, joined by ``:``.
    """
    payloads = written(recipes.drop("id").dropDuplicates(["payload_sha256"]), "payloads")
    places = payloads.select("payload_sha256", F.size("digests").alias("n_chunks"), F.posexplode("digests").alias("place", "digest"))
    hot = written(places.groupBy("digest").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") > hot_places).select("digest"), "hot")
    apart = store.join(hot, "digest", "left_semi").repartition("digest")
    found = places.join(hot, "digest", "left_anti").join(store, "digest").unionByName(
        places.join(hot, "digest", "left_semi").join(apart, "digest"), allowMissingColumns=False).select(
        "payload_sha256", "n_chunks", F.struct("place", "samples").alias("part"))
    # most payloads are one chunk, and are complete where the store has it
    alone = found.where("n_chunks = 1").select("payload_sha256", F.array("part").alias("parts"))
    several = found.where("n_chunks > 1").groupBy("payload_sha256").agg(F.array_sort(F.collect_list("part")).alias("parts"))
    whole = alone.unionByName(several).select("payload_sha256", F.col("parts.samples").alias("samples"))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in FEATURES.split(", ")]
        for batch in batches:
            out: list[list] = [[] for _ in names]
            for i in range(batch.num_rows):
                sha, samples = (batch.column(c)[i].as_py() for c in ("payload_sha256", "samples"))
                parts = [bz2.decompress(x) for x in samples]
                data = b"".join(parts)
                if hashlib.sha256(data).digest() != sha:
                    raise ValueError(f"payload {sha.hex()} can't be rebuilt")
                recipe = recipe_bytes(len(data), [len(p) for p in parts], [hashlib.sha256(p).digest() for p in parts])
                values = np.frombuffer(data, np.uint8).astype(np.int64)
                step = int(np.abs(np.diff(values)).sum() * 1000 // (len(values) - 1))
                media = hashlib.sha256(recipe)
                for part in samples:
                    media.update(part)
                for column, value in zip(out, (sha, len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-UNIT:]), len(recipe) + sum(map(len, samples)),
                                               media.hexdigest(), f"{int(values.sum())}:{int((values == 0).sum())}:{step}", len(parts))):
                    column.append(value)
            types = (pa.binary(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32())
            yield pa.record_batch({c: pa.array(v, t) for c, v, t in zip(names, out, types)})

    return whole.mapInArrow(verify, FEATURES)


def media_features(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store every text as chunks, read it back and return one row of features for each row of ``documents``."""
    recipes, store = store_media(documents, id_col, text_col)
    features = read_media(recipes, store)
    return recipes.select("id", "payload_sha256", "n_bytes").join(features, "payload_sha256").select(
        F.col("id").alias(id_col), "n_bytes", "payload_bytes", F.col("read_sha256").alias("payload_sha256"), "tail_crc32", "media_bytes",
        "media_sha256", "feature", "n_chunks")
