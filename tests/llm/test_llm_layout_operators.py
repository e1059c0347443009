"""Media chunks, chat formatting, mixing, and the pipeline."""

import bz2
import hashlib
import random
import struct
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from smsight.llm import chat, chunks, mixing
from smsight.llm.frames import written


def test_gear_hash_is_the_rolling_sum():
    data = np.random.default_rng(1).integers(0, 256, 300).astype(np.uint8)
    value, expected = 0, []
    for byte in data:
        value = (value * 2 + int(chunks._GEAR[byte])) % 2 ** 32
        expected.append(value)
    assert chunks.gear(data).tolist() == expected


def test_cuts_keep_bounds_and_move_with_the_content():
    data = np.random.default_rng(2).integers(0, 256, 300_000).astype(np.uint8)
    ends = chunks.cuts(data)
    sizes = np.diff([0, *ends])
    assert ends[-1] == len(data) and sizes[:-1].min() >= chunks.LEAST and sizes.max() <= chunks.MOST
    moved = chunks.cuts(np.concatenate([data[:5000], data[4000:]]))
    assert len({e - 1000 for e in moved} & set(ends)) > 0.8 * len(ends)


def test_media_is_rebuilt_from_shared_chunks(spark):
    rnd = random.Random(3)
    shared = "".join(rnd.choice("abcdefgh é") for _ in range(60_000))
    texts = [shared, "x" * 3000 + shared, shared + "end", None, "", "", "ü" * 32, "a" * 64, "a" * 65, shared]
    frame = spark.createDataFrame([(i, t, "old") for i, t in enumerate(texts)] + [(None, "a", "old"), (1, texts[1], "old")], "doc_id long, text string, feature string")
    recipes, store = chunks.store_media(frame)
    assert recipes.select(F.explode("digests")).count() > store.count()
    assert store.count() == store.select("digest").distinct().count()
    listed, stored = recipes.collect(), {bytes(r.digest): bytes(r.samples) for r in store.collect()}
    rows = chunks.media_features(frame).collect()
    assert len(rows) == len(texts) + 2
    plain = {i: (t or "").encode() for i, t in enumerate(texts)} | {None: b"a"}
    for r in rows:
        data = plain[r.doc_id]
        payload = data + bytes(max(64, -(-len(data) // 64) * 64) - len(data))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (
            len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        # the stored form and the features, from the store's rows and plain numbers
        mine = next(x for x in listed if x.payload_sha256 == hashlib.sha256(payload).digest())
        form = b"CDC1" + struct.pack("<QQ", len(payload), len(mine.digests))
        form += b"".join(struct.pack("<I", n) + bytes(d) for n, d in zip(mine.lengths, mine.digests)) + b"".join(stored[bytes(d)] for d in mine.digests)
        assert (r.media_bytes, r.media_sha256) == (len(form), hashlib.sha256(form).hexdigest())
        assert b"".join(bz2.decompress(stored[bytes(d)]) for d in mine.digests) == payload
        steps = sum(abs(a - b) for a, b in zip(payload, payload[1:])) * 1000 // (len(payload) - 1)
        assert r.feature == f"{sum(payload)}:{payload.count(0)}:{steps}"
    by_text = {}
    for r in rows:
        by_text.setdefault(plain[r.doc_id], set()).add((r.media_bytes, r.media_sha256, r.feature))
    assert all(len(x) == 1 for x in by_text.values())
    hot = chunks.read_media(recipes, store, hot_places=1).select("payload_sha256", "media_sha256", "feature")
    assert sorted(map(tuple, hot.collect())) == sorted(map(tuple, chunks.read_media(recipes, store).select(*hot.columns).collect()))
    assert chunks.media_features(frame.limit(0)).count() == 0


@pytest.mark.parametrize("text", ["", "<|im_end|>", "<\\|x", "<\\\\|", "<<|", "a<", "|", "<\\", "<|" * 5])
def test_escape_can_be_taken_back(text):
    assert chat.unescape(chat.escape(text)) == text and "<|" not in chat.escape(text)


def test_conversations_are_read_back(spark):
    rnd = random.Random(6)
    pieces = ["<|im_end|>", "<|im_start|>assistant\n", "é", "<", "\\", "|", "ok", "\n"]
    turns = []
    for conv in [*range(30), None]:
        for turn in range(rnd.randint(1, 9)):
            text = None if rnd.random() < 0.1 else "".join(rnd.choice(pieces) for _ in range(rnd.randint(0, 8)))
            turns.append((conv, turn, rnd.choice(["user", "assistant", "assistant", "system", None, "<|x"]), text))
    turns += [turns[0], (3, None, "user", "first"), (40, 0, "user", "x" * 200_000), (40, 1, "assistant", "y" * 200_000), (41, 1, "user", "q"), (41, 2, "assistant", "a")]
    shuffled = list(turns)
    rnd.shuffle(shuffled)
    frame = spark.createDataFrame([(*t, 1) for t in shuffled], "conv_id long, turn long, role string, text string, part int")
    rows = {r.conv_id: r for r in chat.read_back(chat.format_conversations(frame)).collect()}
    assert set(rows) == {t[0] for t in turns}
    for conv, r in rows.items():
        own = sorted(((-1 if t[1] is None else t[1]), t[2] or "", t[3] or "") for t in turns if t[0] == conv)
        whole = "".join(f"{role}\n{text}\n" for _, role, text in own)
        loss = "".join(text for _, role, text in own if role == "assistant")
        formatted = "".join(f"<|im_start|>{chat.escape(role)}\n{chat.escape(text)}<|im_end|>\n" for _, role, text in own)
        assert (r.n_turns, r.turns_sha256) == (len(own), hashlib.sha256(whole.encode()).hexdigest())
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert r.formatted_chars == len(formatted)
    assert rows[41].complete and rows[40].complete and not rows[None].complete
    assert chat.read_back(chat.format_conversations(frame.limit(0))).count() == 0


def test_machine_counts_roles_out_of_order(spark):
    turns = [(1, 0, "assistant", "a"), (1, 1, "user", "b"), (1, 2, "user", "c"), (1, 3, "assistant", "d"), (2, 0, "system", "s"), (2, 1, "user", "u")]
    frame = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    rows = {r.conv_id: (r.n_errors, r.complete) for r in chat.read_back(chat.format_conversations(frame)).collect()}
    assert rows == {1: (2, False), 2: (0, False)}


@pytest.mark.parametrize("parts", [{"a": 512, "b": 300, "c": 212}, {"a": 1, "b": 1023}, {s: 64 for s in "abcdefghijklmnop"}, {"a": 1024}])
def test_a_frame_deviates_by_less_than_a_block(parts):
    order, given = mixing.frame_order(parts), Counter()
    size = sum(parts.values())
    for slot, s in enumerate(order):
        given[s] += 1
        assert all(abs(given[x] - q * (slot + 1) / size) < 1 for x, q in parts.items())
    assert given == Counter(parts)


def test_quotas_are_near_their_weights():
    out = mixing.quotas({"a": 0.5, "b": 0.3, "c": 0.2, "d": 1e-9}, 1024)
    assert sum(out.values()) == 1024 and min(out.values()) >= 1
    assert all(abs(out[s] - 1024 * w) < 3 for s, w in {"a": 0.5, "b": 0.3, "c": 0.2}.items())
    with pytest.raises(ValueError):
        mixing.quotas({"a": 0.0}, 8)


@pytest.mark.parametrize("max_streams", [100, 3])
def test_every_row_is_mixed_once(spark, max_streams):
    rnd = random.Random(9)
    rows = [(i, rnd.choices(["big", "mid", "low", "x", "y", None], [60, 20, 10, 5, 4, 1])[0], 1) for i in range(3000)] + [(None, "big", 1)] * 40 + [(5, "low", 1)]
    frame = spark.createDataFrame(rows, "doc_id long, source string, block int")
    out = mixing.mix(frame, block_rows=16, max_streams=max_streams).collect()
    assert sorted(r.position for r in out) == list(range(len(rows)))
    assert Counter((r.doc_id, r.source) for r in out) == Counter((a, b) for a, b, _ in rows)
    out.sort(key=lambda r: r.position)
    assert all(a.slot <= b.slot for a, b in zip(out, out[1:])) and all(r.release <= r.slot < r.deadline for r in out)
    assert max(Counter(r.slot for r in out).values()) <= 16
    plan = mixing.plan({"a": 100, "b": 33, "c": 1}, {"a": 0.5, "b": 0.25, "c": 0.25}, block_rows=10)
    slots = sorted(p.begin + i // p.quota * p.frame + p.places[i % p.quota] for p in plan for i in range(p.last - p.first))
    assert slots == list(range(10 + 4 + 1))


@pytest.mark.parametrize("weights", [{"hot": 0.9, **{f"s{k:02d}": 0.1 / 19 for k in range(19)}},
                                     {"hot": (1 / 3) ** 0.5, **{f"s{k:02d}": (2 / 57) ** 0.5 for k in range(19)}}, {"a": 0.3, "b": 0.3, "c": 0.3, "d": 0.1}])
def test_many_frames_deviate_by_less_than_a_block_from_the_weights(weights):
    total = sum(map(Fraction, weights.values()))
    exact = {s: Fraction(w) / total for s, w in weights.items()}
    slots, n = {}, 20 * 64
    for p in mixing.plan({s: int(10 * n * w) + 1 for s, w in exact.items()}, weights, block_rows=1, frame=64):
        slots |= {p.begin + place: p.stream for place in p.places}
    given = Counter()
    for t in range(10 * n):
        given[slots[t]] += 1
        assert all(abs(given[s] - w * (t + 1)) < 1 for s, w in exact.items())


def test_streams_end_in_the_fluid_mix_and_every_source_is_one(spark):
    fluid = mixing.Fluid({"a": 40, "b": 9, "c": 1, "d": 17}, {"a": 0.2, "b": 0.5, "c": 0.01, "d": 0.29})
    rows = list(mixing.schedule(fluid, [0] * 4, 0, 67))
    assert all(release <= slot < deadline for _, _, slot, release, deadline in rows)
    assert sorted((k, i) for k, i, *_ in rows) == [(k, i) for k, n in enumerate((40, 9, 1, 17)) for i in range(n)]
    assert [x for begin, ahead in mixing.frame_states(fluid, 8)[0] for x in mixing.one_frame(fluid, 8, begin, ahead)] == rows
    frame = spark.range(3000).selectExpr("id AS doc_id", "concat('s', id % 1500) AS source")
    out = mixing.mix(frame, block_rows=1).collect()
    assert sorted(r.position for r in out) == list(range(3000))
    assert Counter((r.source, r.block) for r in out) == Counter((f"s{k}", i) for k in range(1500) for i in range(2))


def test_columns_of_a_mix_like_working_names_stay(spark):
    names = ["hash_", "stream_", "bits_", "bucket_", "place_", "rank_", "is_row_", "row_", "key_", "before_", "n", "missing", "a.b"]
    plain = spark.range(300).selectExpr("id AS doc_id", "concat('s', id % 3) AS source")
    odd = plain.select("*", *(F.lit(c).alias(c) for c in names), F.lit("old").alias("SLOT"))
    out = mixing.mix(odd, block_rows=8)
    results = ["block", "slot", "release", "deadline", "position"]
    assert out.columns == ["doc_id", "source", *names, *results]
    assert {tuple(r)[2:-5] for r in out.collect()} == {tuple(names)}
    key = ["doc_id", "source", *results]
    assert sorted(map(tuple, out.select(*key).collect())) == sorted(map(tuple, mixing.mix(plain, block_rows=8).select(*key).collect()))
    assert mixing.mix(odd.limit(0)).columns == out.columns and mixing.mix(odd.limit(0)).count() == 0


def test_mixing_an_empty_table(spark):
    assert mixing.mix(spark.createDataFrame([], "doc_id long, source string")).count() == 0


def test_pipeline_stages(spark):
    folder = "/root/testdata/sf0.001"
    documents = spark.read.parquet(f"{folder}/documents.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (-1, "", "en", "src1", 0), (-2, None, "en", None, None)], documents.schema)
    copies = documents.where("doc_id < 5")
    docs, kept = documents.unionByName(odd).unionByName(copies), []
    for _, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, folder), "test-stage")
        kept.append(docs)
    assert [d.columns for d in kept[:-1]] == [corpus_pipeline.COLUMNS] * 4
    assert kept[1].count() < kept[0].count() and kept[3].count() == kept[2].count() == kept[4].count()
    assert kept[1].where("doc_id < 5").groupBy("doc_id").count().where("count > 1").isEmpty()
    assert {r.doc_id for r in kept[4].collect()} >= {None, -1, -2}


def test_pipeline_stages_of_an_empty_table_with_extra_columns(spark):
    folder = "/root/testdata/sf0.001"
    names = ["hash_", "stream_", "place_", "markov", "spans", "base", "score", "hit_words", "n_hit", "component_id", "tkey", "key"]
    documents = spark.read.parquet(f"{folder}/documents.parquet").select("*", *(F.lit(c).alias(c) for c in names)).limit(0)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, documents, folder)
        assert set(corpus_pipeline.COLUMNS) <= set(out.columns) and out.count() == 0


def test_pipeline_stages_give_the_same_rows_beside_extra_columns(spark):
    folder = "/root/testdata/sf0.001"
    names = ["hash_", "stream_", "row_", "place_", "markov", "spans", "base", "score", "predicted", "hit_words", "n_words", "tkey", "key", "first"]
    odd = [(None, None, None, None, None), (-1, "", "en", "src1", 0), (-1, "", "en", "src1", 0), (-2, "password = hunter2hunter2", None, "src1", 25)]
    documents = spark.read.parquet(f"{folder}/documents.parquet")
    documents = written(documents.where("doc_id < 60").unionByName(spark.createDataFrame(odd, documents.schema)), "test-few")
    wide = documents.select("*", *(F.lit(c).alias(c) for c in names))
    for name, stage in corpus_pipeline.STAGES:
        columns = corpus_pipeline.COLUMNS + (["source", "block"] if name == "mixing" else [])  # places inside a block fall to identical rows in any order
        found = [Counter(map(str, stage(spark, d, folder).select(*columns).collect())) for d in (documents, wide)]
        assert found[0] == found[1] and found[0].total() > 0, name


def test_one_row_of_a_component_stays_whatever_its_id(spark):
    words = lambda name, n=40: " ".join(f"{name}{i}" for i in range(n))
    near = lambda name: words(name) + " changed"
    rows = [(5, words("a")), (5, near("a")),  # near copies of one id
            (3, words("b")), (9, words("c")), (9, near("b")),  # a copy of 3 by an id that leads its own component
            (None, words("d")), (None, near("d")), (None, words("e")), (None, near("b")), (None, near("c")),  # null ids
            (None, ""), (None, ""), (None, " "), (None, None), (7, ""), (7, None), (8, words("f")), (8, words("f"))]
    documents = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    out = [(r.doc_id, r.text) for r in corpus_pipeline.drop_near_copies(spark, documents, "").collect()]
    assert Counter(x for x in out if not (x[1] or "").strip()) == Counter(x for x in rows if not (x[1] or "").strip())
    kept = Counter(x for x in out if (x[1] or "").strip())
    assert kept.pop((3, words("b"))) == kept.pop((9, words("c"))) == kept.pop((None, words("e"))) == kept.pop((8, words("f"))) == 1
    assert sorted((str(i), t[0]) for i, t in kept.elements()) == [("5", "a"), ("None", "d")]
