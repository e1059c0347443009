"""SimHash components against a plain version: every pair compared, every hash counted."""

import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from smsight.llm import simhash
from smsight.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"


def plain_fingerprint(text, size=3):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x20\x09-\x0D]+", lower)
    parts = [" ".join(words[i:i + size]) for i in range(len(words) - size + 1)] if len(words) >= size else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints, radius=2):
    """id -> least id reachable, by a walk over all pairs of fingerprints."""
    values = sorted(set(prints.values()))
    seen, of = set(), {}
    for v in values:
        if v in seen:
            continue
        group, todo = {v}, [v]
        while todo:
            x = todo.pop()
            near = [y for y in values if y not in group and (x ^ y).bit_count() <= radius]
            group.update(near)
            todo += near
        seen |= group
        ids = [i for i, p in prints.items() if p in group]
        of.update({i: min(ids) for i in ids})
    return of


def test_query_equals_the_plain_version(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()}
    prints = {i: plain_fingerprint(t) for i, t in docs.items()}
    want = plain_components(prints)
    rows = QUERIES["op11_simhash_dedup"](spark, FOLDER).collect()
    assert len(rows) == len(docs)
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in rows} == {i: (f"{p:016x}", want[i]) for i, p in prints.items()}


def test_odd_texts(spark):
    long = " ".join(random.Random(3).choices("abcdefghij", k=70_000))  # more shingles than a 16-bit counter holds
    texts = [None, "", " \t\n", "One", "one", "a b", "A\u000bB", "a b c", "Ünï ÇÖDE x y z", long, "a  b\n\nc d", "tie x y z", None]
    rows = [(i, t, f"c{i}", 7) for i, t in enumerate(texts)] + [(None, "a b", "n", 1), (None, "nobody else says this at all", "n", 1), (4, "one", "c4", 7)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, fp string, mask int")
    got = simhash.simhash_components(df).collect()
    assert len(got) == len(rows)
    by_id = {r.doc_id: r for r in got if r.doc_id is not None}
    assert {i: r.fp % (1 << 64) for i, r in by_id.items()} == {i: plain_fingerprint(t) for i, t in enumerate(texts)}
    assert by_id[0].component_id == by_id[1].component_id == by_id[2].component_id == by_id[12].component_id == 0
    assert by_id[4].component_id == 3 and by_id[6].component_id == 5
    assert sorted(r.component_id is None for r in got if r.doc_id is None) == [False, True]
    assert simhash.simhash_components(df.limit(0)).collect() == []


@pytest.mark.parametrize("radius,bucket_rows", [(1, 16), (2, 8192), (2, 8), (5, 40)])
def test_links_have_all_components(spark, radius, bucket_rows):
    rng = random.Random(radius)
    seeds = [rng.getrandbits(64) for _ in range(40)]
    values = set(seeds)
    for s in seeds[:10]:  # balls of many near fingerprints, and chains that leave them
        for _ in range(60):
            x = s
            for _ in range(rng.randint(1, 4)):
                x ^= 1 << rng.randrange(64)
            values.add(x)
    values |= {0, (1 << 64) - 1, 1, 3, 7, 15, 1 << 63}
    kept = simhash.Scratch(spark)
    df = spark.createDataFrame([(simhash._signed(v),) for v in values], "fp bigint")
    links = [(r.a % (1 << 64), r.b % (1 << 64)) for r in simhash.near_links(df, kept.keep, radius, bucket_rows).collect()]
    want = plain_components({v: v for v in values}, radius)
    got = {v: v for v in values}

    def root(v):
        while got[v] != v:
            v = got[v]
        return v
    for a, b in links:
        a, b = root(a), root(b)
        got[max(a, b)] = min(a, b)
    assert {v: root(v) for v in values} == want
    kept.drop()


def test_hot_bucket_gives_no_more_links_than_members(spark):
    df = spark.range(1 << 12).select(F.col("id").alias("fp"))  # all within twelve bits
    kept = simhash.Scratch(spark)
    links = simhash.near_links(df, kept.keep, 2, 256)
    assert links.count() < 40 * (1 << 12)
    kept.drop()
