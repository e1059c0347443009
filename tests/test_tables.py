import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from smsight.operators import bandit, campaigns as K, contacts as P, encoding as E, evaluation as Q, ranks, recommender as R, routing
from smsight.plans import fixtures as X
from smsight.sources import tables


def test_loo(spark):
    df = spark.createDataFrame([(1, "a", 1), (2, "a", 0), (3, "a", 1), (4, "b", 1)], "sms_id int, msisdn string, engaged int")
    out = {r.sms_id: r.loo_rate for r in E.loo_rate(df, "msisdn").collect()}
    assert out == {1: 0.5, 2: 1.0, 3: 0.5, 4: 0.75}
    enc = {r.sms_id: r.msisdn_target_loo for r in E.target_encoding(df, ["msisdn"]).collect()}
    assert enc == out
    published = {r.sms_id: r.msisdn_target_loo for r in E.target_encoding(df, ["msisdn"], reference_formula=True).collect()}
    assert published[1] == (3 * 2 - 1) / 2


def test_quantiles_and_tiers(spark):
    rng = random.Random(3)
    values = sorted(rng.choice([0.1, 0.2, 0.25, rng.random()]) for _ in range(501))
    df = spark.createDataFrame([(v,) for v in values], "r double")
    row = ranks.exact_quantiles(df, "r", [0.33, 0.5, 1.0, 0.0], buckets=16).first()
    at = lambda p: (lambda x, i: values[i] + (values[min(i + 1, 500)] - values[i]) * (x - i))(p * 500, int(p * 500))
    assert [row.q0, row.q1, row.q2, row.q3] == pytest.approx([at(0.33), at(0.5), values[-1], values[0]])
    same = spark.createDataFrame([(0.5,)] * 10 + [(0.9,)], "r double")
    assert sorted(r.t for r in E.with_tier(same, "r", "t").collect()) == [0] * 10 + [1]


def test_buckets_follow_the_number_of_rows(spark):
    df = spark.range(40_000).select((F.col("id") * 7919 % 40_000 - 500).alias("v"))
    found = ranks.with_buckets(df, "v", buckets=4, bucket_rows=500).groupBy("_bucket").agg(
        F.min("v").alias("low"), F.max("v").alias("high"), F.count("*").alias("n")).orderBy("_bucket").collect()
    assert len(found) == 80 and max(r.n for r in found) < 600
    assert all(a.high < b.low for a, b in zip(found, found[1:]))
    odd = spark.createDataFrame([(None,), (float("nan"),), (float("inf"),), (float("-inf"),), (1.0,), (1.0,)], "v double")
    for part, n in ((odd, 6), (odd.where("v IS NULL"), 1), (odd.limit(0), 0)):
        assert ranks.with_buckets(part, "v").count() == n


def test_messages_last_day_with_a_busy_recipient(spark):
    rng = random.Random(5)
    base = dt.datetime(2024, 1, 1)
    rows = [(i, "hot" if i % 3 else f"u{i % 7}", base + dt.timedelta(seconds=rng.choice([0, 60, 86400, rng.randrange(300000)]))) for i in range(400)]
    df = spark.createDataFrame(rows, "sms_id int, msisdn string, send_datetime timestamp_ntz")
    out = {r.sms_id: r.sms_last_24h for r in E.messages_last_day(df).collect()}
    day = dt.timedelta(hours=24)
    assert out == {i: sum(1 for j, m2, t2 in rows if m2 == m and t - day <= t2 < t) for i, m, t in rows}


def test_folds_are_even(spark):
    df = spark.range(1000).select(F.col("id").alias("sms_id"), (F.col("id") % 10 == 0).cast("int").alias("engaged"))
    counts = {(r.engaged, r.fold): r.n for r in ranks.stratified_folds(df, "engaged", "sms_id", 5).groupBy("engaged", "fold").agg(F.count("*").alias("n")).collect()}
    assert set(counts.values()) == {20, 180} and len(counts) == 10


def test_bandit_replay_matches_a_loop(spark):
    rng = random.Random(11)
    rows, expected = [], {}
    for i in range(3000):
        key = ("hot" if rng.random() < 0.7 else f"c{rng.randrange(5)}", rng.choice([9, 10]))
        rows.append((key[0], key[1], dt.datetime(2024, 1, 1) + dt.timedelta(seconds=rng.randrange(5000)), i, rng.random() < 0.3))
    for key, hour, _, _, hit in sorted(rows, key=lambda r: (r[2], r[3])):
        a, b = expected.get((key, hour), (1.0, 1.0))
        a, b = max(1.0, 0.98 * a), max(1.0, 0.98 * b)
        expected[key, hour] = (a + 1, b) if hit else (a, b + 1)
    df = spark.createDataFrame(rows, "context_key string, hour int, at timestamp_ntz, id long, engaged boolean")
    out = bandit.replay_bandit(df, partitions=7).collect()
    assert len(out) == len(expected)
    for r in out:
        assert (r.alpha, r.beta) == pytest.approx(expected[r.context_key, r.hour], rel=1e-12)
    early, late = df.where("at < timestamp_ntz'2024-01-01 00:30:00'"), df.where("at >= timestamp_ntz'2024-01-01 00:30:00'")
    for r in bandit.replay_bandit(late, bandit.replay_bandit(early)).collect():
        assert (r.alpha, r.beta) == pytest.approx(expected[r.context_key, r.hour], rel=1e-12)


def test_bandit_choice(spark):
    contexts = spark.createDataFrame([("c", "OTP")], "context_key string, nlp_type string")
    state = spark.createDataFrame([("c", 12, 9.0, 1.0, 8)], "context_key string, hour int, alpha double, beta double, n_updates long")
    scores = spark.createDataFrame([("OTP", 20, 0.5)], "nlp_type string, hour int, ml_score double")
    r = bandit.choose_hours(contexts, state, scores, seed=None).first()
    assert (r.hour, r.method, r.mixed_score) == (12, "ts_ml_hybrid", 0.6)
    many = spark.range(400).select(F.col("id").cast("string").alias("context_key"), F.lit("OTP").alias("nlp_type"))
    drawn = bandit.choose_hours(many, state, scores, seed=1).collect()
    explored = sum(r.method == "explore" for r in drawn)
    assert len(drawn) == 400 and 15 <= explored <= 75 and all(7 <= r.hour <= 23 for r in drawn)


def test_curve_areas(spark):
    rng = random.Random(2)
    rows = [(rng.choice([0.1, 0.4, round(rng.random(), 2)]), int(rng.random() < 0.4)) for _ in range(300)]
    df = spark.createDataFrame(rows, "score double, engaged int")
    out = Q.curve_areas(Q.pr_curve(df)).first()
    pos, neg = [s for s, e in rows if e], [s for s, e in rows if not e]
    wins = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg)
    assert out.auc_roc == pytest.approx(wins / len(pos) / len(neg))
    at = {t: sum(s >= t for s in pos) for t, _ in rows}
    ap = sum(sum(s == t for s in pos) / len(pos) * at[t] / sum(s >= t for s, _ in rows) for t in at)
    assert out.pr_auc == pytest.approx(ap)


def test_routes(spark):
    messages = spark.createDataFrame(
        [(1, "G1", "BANK", "+21620000000"), (2, "G3", "SHOP", "+44"), (3, "G9", "X", "+44"), (4, "G2", "BANK", "+21621000000"), (5, "G9", "X", "+331")],
        "message_id long, group_id string, alpha_header string, destination string")
    out = routing.match_routes(messages, X.routes(spark))
    assert {r.message_id: r.route_id for r in out.collect()} == {1: "r2", 2: "r5", 3: "r8", 4: "r3", 5: "r7"}


def test_downtime_runs_across_days(spark):
    ups = [True, False, False, False, True, False]
    rows = [(i, "c", dt.datetime(2024, 1, 1, 22) + dt.timedelta(hours=i), up) for i, up in enumerate(ups)]
    df = spark.createDataFrame(rows, "probe_id int, connector_id string, probed_at timestamp_ntz, available boolean")
    out = {r.probe_id: r.unavailable_minutes for r in routing.connector_downtime(df).collect()}
    assert out == {0: None, 1: 0, 2: 5, 3: 10, 4: None, 5: 0}


def test_import_file(spark, tmp_path):
    path = tmp_path / "contacts.csv"
    path.write_text("phone,first,last,email\n+216 20-000-001, A ,B, a@b \nbad,C\n\n+21620000001,D\n+21620000002\n , ,\n")
    rows = tables.read_contact_rows(spark, str(path), 1)
    known = spark.createDataFrame([(1, "+21620000002")], "user_id int, phone string")
    found = {r.row_number: r for r in P.import_contacts(rows, known).collect()}
    assert {n: (r.outcome, r.country) for n, r in found.items()} == {
        2: ("accepted", "TN"), 3: ("error", None), 4: ("error", None), 5: ("duplicate", "TN"), 6: ("duplicate", "TN"), 7: ("error", None)}
    assert (found[2].first_name, found[2].email) == ("A", "a@b")
    assert [found[n].reason for n in (3, 4, 7)] == ["Invalid phone number format: bad", "Empty row", "Empty row"]


def test_audience_sizes_equal_the_list(spark):
    contacts = spark.createDataFrame([(1, 1, ["a"]), (2, 1, ["a", "b"]), (3, 1, ["c"]), (4, 2, ["a"])], "contact_id long, user_id long, tags array<string>")
    camps = spark.createDataFrame([(7, 1, [3, 2], ["a", "b"]), (8, 2, [1], ["z"]), (9, 1, [1], [])], "campaign_id long, user_id long, contact_ids array<long>, contact_tags array<string>")
    listed = {r.campaign_id: r["count"] for r in K.audience(camps, contacts).groupBy("campaign_id").count().collect()}
    sizes = {r.campaign_id: r.audience_size for r in K.audience_sizes(camps, contacts).collect()}
    assert listed == {7: 3, 9: 1} and sizes == {7: 3, 8: 0, 9: 1}


def test_user_filter(spark):
    schema = "first_name string, last_name string, active boolean, is_viewer boolean, is_superadmin boolean, roles array<struct<group:string,role:string>>"
    df = spark.createDataFrame([("Ann", "X", True, False, False, [("G1", "Admin")]), ("Bob", "Y", False, True, False, [])], schema)
    names = lambda **kw: [r.first_name for r in K.filter_users(df, **kw).collect()]
    assert names(group="g1") == ["Ann"] and names(role="admin") == ["Ann"] and names(role="visionneur") == ["Bob"]
    assert names(active=False) == ["Bob"] and names(first_name="AN") == ["Ann"]


def test_recommender(spark):
    texts = ["rendez vous demain", "rendez vous ici", "rendez vous la", "votre colis est la", "votre colis est ici", "livraison livraison 12"]
    df = spark.createDataFrame([(i, t, False, "light") for i, t in enumerate(texts + texts[:2])], "doc_id int, text string, is_spam boolean, noise_level string")
    docs = R.clean_corpus(df)
    assert docs.count() == len(texts)
    words = R.lexicon(docs)
    assert {r.word: r.freq for r in words.collect()} == {"rendez": 3, "vous": 3, "ici": 2, "la": 2, "votre": 2, "colis": 2, "est": 2, "livraison": 2}
    model = R.count_ngrams(docs, R.named_entities(docs))
    asked = spark.createDataFrame([(1, "rendez "), (2, "mon coli"), (3, "lovr"), (4, "xivraison"), (5, "votre colis est ")], "request_id int, partial_text string")
    out = {}
    for r in R.recommend(asked, words, model).collect():
        out.setdefault(r.request_id, []).append((r["rank"], r.word))
    assert out[1] == [(1, "vous")] and out[2] == [(1, "colis")] and out[3] == [(None, None)] and out[4] == [(1, "livraison")]
    assert sorted(out[5]) == [(1, "ici"), (2, "la")]
    german = spark.createDataFrame([(1, "ich und der die das rendez ", "vous", "e1")], "id int, partial_text string, selected_word string, event_id string")
    raised = {(r.lang, r.word): r.freq for r in R.apply_feedback(words.where("lang = 'fr'"), german).collect()}
    assert {lang for lang, _ in raised} == {"fr"} and raised["fr", "vous"] > 3


def test_names_are_masked_and_leaks_dropped(spark):
    texts = ["Bonjour Karim merci", "bonjour Zorro merci", "merci Zorro encore", "votre code merci"]
    docs = R.clean_corpus(spark.createDataFrame([(i, t, False, "x") for i, t in enumerate(texts)], "doc_id int, text string, is_spam boolean, noise_level string"))
    names = R.named_entities(docs)
    assert sorted(r.word for r in names.collect()) == ["karim", "zorro"]
    bigrams = {(r.w1, r.w2): r.n for r in R.count_ngrams(docs, names).bigrams.collect()}
    assert bigrams[("bonjour", "@prenom")] == 2 and bigrams[("votre", "merci")] == 1


def test_facts_need_columns(spark, tmp_path):
    path = tmp_path / "facts.csv"
    path.write_text("send_hour,msisdn\n1,2\n")
    with pytest.raises(ValueError, match="missing columns"):
        tables.read_sms_facts(spark, str(path))


def test_timing_results_files(spark, tmp_path):
    one = {"timing_results": [{"camp_type": "CLASSIC", "operateur": "Orange", "nlp_type": "OTP", "best_hour": 9, "hourly_curve": [{"hour": 0, "time_score_raw": 0.1}]}]}
    (tmp_path / "r.json").write_text(json.dumps(one))
    df = tables.read_timing_results(spark, str(tmp_path / "missing"), str(tmp_path / "r.json"))
    assert [(r.nlp_type, r.best_hour, r.hourly_curve[0].hour) for r in df.collect()] == [("OTP", 9, 0)]
    tables.write_timing_results(df, str(tmp_path / "out"))
    assert tables.read_timing_results(spark, str(tmp_path / "out")).count() == 1
    assert tables.read_timing_results(spark, str(tmp_path / "none")).count() == 0


def test_state_versions(spark, tmp_path):
    path = str(tmp_path / "state")
    assert tables.load_bandit_state(spark, path) is None
    for version in (0, 1, 1):
        df = spark.createDataFrame([("c", 9, 1.0 + version, 1.0, version)], "context_key string, hour int, alpha double, beta double, n_updates int")
        tables.save_bandit_state(df, path, version)
    assert [r.alpha for r in tables.load_bandit_state(spark, path).collect()] == [2.0]


def test_bulk_selection_of_any_size(spark):
    df = spark.createDataFrame([(1, 1), (1, 4000), (2, 1), (None, 1)], "user_id int, contact_id int")
    asked = spark.range(1, 5000).selectExpr("1 AS user_id", "CAST(id AS INT) AS contact_id")
    assert P.select_contacts(df, asked).count() == 2 and P.select_contacts(df, asked, keep=False).count() == 2


def test_recommender_is_saved_by_language(spark, tmp_path):
    rows = [(1, "le chat est la", False, "x"), (2, "le chat est ici", False, "x"), (3, "the cat is in the house", False, "x")]
    docs = R.clean_corpus(spark.createDataFrame(rows, "doc_id int, text string, is_spam boolean, noise_level string"))
    names = R.named_entities(docs)
    model = R.count_ngrams(docs, names)
    tables.save_recommender(str(tmp_path / "m"), R.lexicon(docs), names, model)
    words, loaded = tables.load_recommender(spark, str(tmp_path / "m"))
    rows_of = lambda df, cols: sorted(tuple(r[c] for c in cols) for r in df.collect())
    assert rows_of(loaded.bigrams, ["lang", "w1", "w2", "n"]) == rows_of(model.bigrams, ["lang", "w1", "w2", "n"])
    assert rows_of(loaded.continuation, ["lang", "word", "n"]) == rows_of(model.continuation, ["lang", "word", "n"])
    assert {r.lang for r in words.collect()} == {"fr", "en"}


def test_expired_decisions_are_purged(spark):
    df = spark.createDataFrame([(1,)], "sms_id int")
    now = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    log = bandit.log_decisions(df, now)
    assert log.first().expires_at == dt.datetime(2024, 3, 31)
    assert bandit.purge_expired(log, now + F.expr("INTERVAL 89 DAYS")).count() == 1
    assert bandit.purge_expired(log, now + F.expr("INTERVAL 90 DAYS")).count() == 0


@pytest.mark.parametrize("split", ["128m", "37b"])
def test_contact_files_are_numbered_across_files_splits_and_quotes(spark, tmp_path, split):
    import csv
    import io
    rows = [[f"+2162000{i:04d}", f'say "{i}"' if i % 3 == 0 else "plain", "a\n\nb,\nc" if i % 4 == 0 else "x", ""] for i in range(40)]
    for name, part in (("a.csv", rows[:13]), ("b.csv", []), ("c.csv", rows[13:])):
        text = io.StringIO()
        csv.writer(text, lineterminator="\n").writerows([["phone", "first", "last", "email"], *part])
        (tmp_path / name).write_text(text.getvalue())
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        got = tables.read_contact_rows(spark, str(tmp_path), 5).orderBy("row_number").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [(r.row_number, r.phone, r.first_name, r.last_name) for r in got] == [(i + 2, *row[:3]) for i, row in enumerate(rows)]


def test_longest_prefix(spark):
    from smsight.operators.prefixes import CALLING_CODES, longest_prefix
    table = spark.createDataFrame([("2", "short"), ("216", "TN"), ("21698", "Tunis"), ("21698", "Ariana"), ("", "all"), (None, "none"), ("9" * 30, "long")], "p string, v string")
    rows = spark.createDataFrame([("21698000000", 1, "k"), ("21620", 2, "k"), ("2", 3, "k"), ("30", 4, "k"), (None, 5, "k"), ("", 6, "k"), ("21620", 7, "k"), ("9" * 31, 8, "k")],
                                 "number string, i int, _value string")
    out = {r.i: (r.country, r["_value"]) for r in longest_prefix(rows, "number", table, "p", "v", "country").collect()}
    assert out == {1: ("Ariana", "k"), 2: ("TN", "k"), 3: ("short", "k"), 4: (None, "k"), 5: (None, "k"), 6: (None, "k"), 7: ("TN", "k"), 8: ("long", "k")}
    assert longest_prefix(rows, "number", table.limit(0), "p", "v", "country").where("country IS NOT NULL").count() == 0
    names = spark.createDataFrame([("+12425551234",), ("+14155551234",), ("+77011234567",), ("+79161234567",), ("+999123456",), ("216",)], "n string")
    assert [r[0] for r in names.select(P.country_of(F.col("n"))).collect()] == ["BS", "US", "KZ", "RU", "UNKNOWN", "UNKNOWN"]
    assert len(CALLING_CODES) > 220 and len(set(CALLING_CODES)) == len(CALLING_CODES)


def test_recommender_is_trained_once_for_the_same_files(spark, tmp_path):
    from smsight.plans import queries as Q
    texts = ["le train de paris part le matin", "le train de lyon part le soir"] * 3
    rows = [(i, f"{t} {i}", "fr", "s", len(t)) for i, t in enumerate(texts)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    frame.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    before = len(Q._TRAINED)
    words, model = Q._trained(spark, str(tmp_path))
    assert {r.word for r in words.collect()} >= {"le", "train", "part"} and model.bigrams.count() > 0
    Q._trained(spark, str(tmp_path))
    assert len(Q._TRAINED) == before + 1
    frame.coalesce(1).write.mode("append").parquet(str(tmp_path / "documents.parquet"))
    Q._trained(spark, str(tmp_path))
    assert len(Q._TRAINED) == before + 2
    last = list(Q._TRAINED.values())[-1]
    tables.delete_folder(spark, last)
    assert Q._trained(spark, str(tmp_path))[0].count() > 0 and last not in Q._TRAINED.values()
