"""Periodic runs against a plain scan over all periods."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from smsight.llm import runs
from smsight.llm.queries import QUERIES, looped


def plain_runs(words, min_length=6, exponent=4):
    n, least = len(words), {}
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(min_length, exponent * q):
                least.setdefault((i, j - i + q), q)
            i = max(i + 1, j)
    return sorted(((s, length, q) for (s, length), q in least.items()), key=lambda r: (r[0], r[2]))


def plain_collapsed(words, found):
    gone = {k for s, length, q in found for k in range(s + q, s + length)}
    return " ".join(w for k, w in enumerate(words) if k not in gone)


@pytest.mark.parametrize("min_length,exponent", [(6, 4), (1, 4), (9, 5), (20, 4)])
def test_seeds_are_all_runs(min_length, exponent):
    rng = random.Random(min_length)
    for _ in range(500):
        n, k = rng.randint(1, 60), rng.randint(1, 4)
        words = [rng.randrange(k) for _ in range(n)]
        if rng.random() < 0.6:
            a, p = rng.randrange(n), rng.randint(1, 5)
            words = words[:a] + [words[a + (i - a) % p] if a + (i - a) % p < n else 0 for i in range(a, n)]
        got = runs.seeded_runs(np.array(words), np.zeros(n, int), np.full(n, n), min_length, exponent)
        assert sorted(got, key=lambda r: (r[0], r[2])) == plain_runs(words, min_length, exponent)


def test_texts(spark):
    rng = random.Random(5)
    texts = [None, "", " \n\t ", "one", "a a a a a", "a a a a a a", "A a A a A a A a", "x " * 30_000, "na\u000bna  na\nna na na Ünd Ünd",
             "a b a b a b a b c a b a b a b a b", " ".join(rng.choices("abc", k=400)), "é è " * 40 + "end"]
    rows = [(i, t, "clash", 1) for i, t in enumerate(texts)] + [(None, "b b b b b b b", "clash", 1), (5, "a a a a a a", "clash", 1)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, runs string, n_words int")
    got = runs.periodic_runs(df).collect()
    assert len(got) == len(rows)
    for r in got:
        words = re.findall("[^\x20\x09-\x0D]+", ("b b b b b b b" if r.doc_id is None else texts[r.doc_id]) or "")
        want = [(0, 30_000, 1)] if r.doc_id == 7 else plain_runs(words)
        assert (r.n_words, [tuple(x) for x in r.runs], r.collapsed) == (len(words), want, plain_collapsed(words, want))
    assert runs.periodic_runs(df.limit(0)).collect() == []


def test_words_repeat_from_a_place_on(spark):
    rows = [(i, " ".join(f"w{k}" for k in range(i % 40))) for i in range(300)] + [(None, "a b"), (14, None)]
    for r in looped(spark.createDataFrame(rows, "doc_id bigint, text string")).collect():
        if r.doc_id is None or r.text is None:
            assert r.doc_id in (None, 14)
            continue
        words = [f"w{k}" for k in range(r.doc_id % 40)]
        n, h = len(words), zlib.crc32(str(r.doc_id).encode())
        if h % 10 == 0 and n:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        assert r.text.split() == words


def test_query_digests(spark):
    rows = {r.doc_id: r for r in QUERIES["op12_periodic_runs"](spark, "/root/testdata/sf0.001").collect()}
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    some = 0
    for d in looped(docs).collect():
        words = re.findall("[^\x20\x09-\x0D]+", d.text or "")
        found, r = plain_runs(words) if len(words) < 1500 else None, rows[d.doc_id]
        if found is None:
            continue
        some += len(found)
        assert r.n_runs == len(found)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in found).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(plain_collapsed(words, found).encode()).hexdigest()
        best = max(found, key=lambda x: (x[1], -x[0], -x[2]), default=(None, None, None))
        assert (r.start, r.length, r.period) == best
        assert r.exponent_milli == (best[0] is not None and 1000 * best[1] // best[2] or None)
    assert some
