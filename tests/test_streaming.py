import datetime as dt

import pytest
from smsight.operators import bandit
from smsight.sources import tables
from smsight.streaming import jobs, state

T0 = dt.datetime(2024, 1, 1)


def files(spark, path, batches, schema):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{path}/part={i}")
    return [f"{path}/part={i}" for i in range(len(batches))]


def test_bandit_stream_equals_batch_over_several_batches(spark, tmp_path):
    schema = "context_key string, hour int, at timestamp, id long, engaged boolean"
    rows = [(f"c{i % 3}", 9 + i % 2, T0 + dt.timedelta(minutes=i), i, i % 4 == 0) for i in range(120)]
    state, check, source = (str(tmp_path / n) for n in ("state", "check", "in"))
    for part in (rows[:50], rows[50:90], rows[90:]):  # one restart per file
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
        stream = jobs.read_stream(spark, source, spark.read.parquet(source).schema)
        jobs.start_bandit_updates(stream, state, check, every=None).awaitTermination()
    got = {(r.context_key, r.hour): (r.alpha, r.beta, r.n_updates) for r in tables.load_bandit_state(spark, state).collect()}
    want = {(r.context_key, r.hour): (r.alpha, r.beta, r.n_updates) for r in bandit.replay_bandit(spark.createDataFrame(rows, schema)).collect()}
    assert got.keys() == want.keys()
    for key in want:
        assert got[key] == pytest.approx(want[key])


def test_feedback_between_streams(spark, tmp_path):
    f, d = str(tmp_path / "f"), str(tmp_path / "d")
    spark.createDataFrame([(1, 10, T0 + dt.timedelta(hours=1)), (2, 99, T0 + dt.timedelta(hours=2)), (3, 11, T0 + dt.timedelta(days=400))],
                          "feedback_id long, sms_id long, received_at timestamp").coalesce(1).write.parquet(f)
    spark.createDataFrame([(10, "c", 9, T0), (12, "c", 9, T0 + dt.timedelta(days=400))],
                          "sms_id long, context_key string, recommended_hour int, decided_at timestamp").coalesce(1).write.parquet(d)
    read = lambda p: jobs.read_stream(spark, p, spark.read.parquet(p).schema)
    out = jobs.run_available(jobs.feedback_status_streams(read(f), read(d)))
    assert {r.feedback_id: r.status for r in out.collect()} == {1: "updated", 2: "not_found"}


def test_requests_once_per_bucket(spark, tmp_path):
    p = str(tmp_path / "r")
    rows = [("k", T0), ("k", T0 + dt.timedelta(minutes=5)), ("k", T0 + dt.timedelta(minutes=65)), ("j", T0)]
    spark.createDataFrame(rows, "request_key string, requested_at timestamp").coalesce(1).write.parquet(p)
    out = jobs.run_available(jobs.distinct_requests(jobs.read_stream(spark, p, spark.read.parquet(p).schema)))
    assert sorted((r.request_key, r.bucket.hour) for r in out.collect()) == [("j", 0), ("k", 0), ("k", 1)]


FEEDBACK = "context_key string, hour int, at timestamp, id long, engaged boolean"


def arrivals(spark, tmp_path, name, parts, schema):
    folder = tables.make_folder(spark, str(tmp_path / name))
    frames = [spark.createDataFrame(rows, schema) for rows in parts]
    return jobs.read_stream(spark, folder, frames[0].schema), {folder: frames}


def test_bandit_state_follows_event_time(spark, tmp_path):
    rows = [(f"c{i % 3}", 9 + i % 2, T0 + dt.timedelta(minutes=i), i, i % 4 == 0) for i in range(90)] + [("c0", 9, None, 500, True)]
    late = [r for r in rows if r[3] % 7 == 0]  # come in one part later than their time
    parts = [[r for r in rows[:40] if r not in late], [r for r in rows[40:] if r not in late] + late[:8], late[8:]]
    stream, feeds = arrivals(spark, tmp_path, "in", parts, FEEDBACK)
    got = jobs.run_arrivals(state.bandit_updates(stream, delay="1 hour"), feeds, ["context_key", "hour"])
    want = bandit.replay_bandit(spark.createDataFrame([r for r in rows if r[2]], FEEDBACK))
    as_map = lambda df: {(r.context_key, r.hour): pytest.approx((r.alpha, r.beta, r.n_updates)) for r in df.collect()}
    assert {k: tuple(v.expected) for k, v in as_map(got).items()} == as_map(want)


def test_bandit_state_is_compacted_and_runs_on_a_timer(spark, tmp_path):
    source, path, check = (str(tmp_path / n) for n in ("in", "state", "check"))
    rows = [(f"c{i % 3}", 9, T0 + dt.timedelta(minutes=i), i, i % 4 == 0) for i in range(60)]
    parts = [rows[i:i + 15] for i in range(0, 60, 15)]
    spark.createDataFrame(parts[0], FEEDBACK).coalesce(1).write.mode("append").parquet(source)
    stream = jobs.read_stream(spark, source, spark.read.parquet(source).schema)
    query = jobs.start_bandit_state(stream, path, check, every="1 second", compact_every=2)
    try:
        for part in [*parts[1:], None]:
            query.processAllAvailable()
            if part:
                spark.createDataFrame(part, FEEDBACK).coalesce(1).write.mode("append").parquet(source)
        assert query.lastProgress is not None
    finally:
        query.stop()
    want = {(r.context_key, r.hour): (round(r.alpha, 9), r.n_updates) for r in bandit.replay_bandit(spark.createDataFrame(rows, FEEDBACK)).collect()}
    assert {(r.context_key, r.hour): (round(r.alpha, 9), r.n_updates) for r in jobs.read_bandit_state(spark, path).collect()} == want
    names = tables.folder_names(spark, path)
    bases = [n for n in names if n.startswith("base=")]
    assert len(bases) == 1
    upto = int(bases[0].split("=")[1])
    assert all(int(n.split("=")[1]) > upto for n in tables.folder_names(spark, f"{path}/changes"))
    last = max([upto, *(int(n.split("=")[1]) for n in tables.folder_names(spark, f"{path}/changes"))])
    jobs.compact_bandit_state(spark, path, last)
    jobs.compact_bandit_state(spark, path, last)  # a repeated batch changes nothing
    assert tables.folder_names(spark, f"{path}/changes") == []
    assert {(r.context_key, r.hour): (round(r.alpha, 9), r.n_updates) for r in jobs.read_bandit_state(spark, path).collect()} == want


def test_no_state_yet(spark, tmp_path):
    assert jobs.read_bandit_state(spark, str(tmp_path / "nothing")).collect() == []


def test_decisions_expire_once(spark, tmp_path):
    day = lambda n: T0 + dt.timedelta(days=n)
    decisions, given = arrivals(spark, tmp_path, "d", [
        [(1, "a", day(0)), (2, None, day(0)), (1, "again", day(0.5)), (None, "x", day(0)), (3, "c", day(1))], [(4, "d", day(30)), (5, "e", day(59))]],
        "sms_id long, context_key string, decided_at timestamp")
    feedback, answers = arrivals(spark, tmp_path, "f", [[(1, day(1)), (1, day(2)), (9, day(2)), (3, None)], [(3, day(12)), (4, day(31))], [(5, day(60))]],
                                 "sms_id long, received_at timestamp")
    out = jobs.run_arrivals(state.closed_decisions(decisions, feedback, ttl_days=10, delay="1 day"), given | answers)
    assert sorted((r.sms_id, r.context_key, r.n_feedback, r.status) for r in out.collect()) == [
        (1, "a", 2, "answered"), (2, "", 0, "expired"), (3, "c", 0, "expired"), (4, "d", 1, "answered")]


def test_sliding_counts_close_behind_the_watermark(spark, tmp_path):
    hour = lambda n: T0 + dt.timedelta(hours=n)
    stream, feeds = arrivals(spark, tmp_path, "m", [[("a", hour(0.5)), ("a", hour(0.6)), ("b", hour(1.5))], [("a", hour(2.5)), ("a", hour(9))]],
                             "msisdn string, send_datetime timestamp")
    out = jobs.run_arrivals(jobs.sliding_volume(stream, "3 hours", "1 hour", "1 hour"), feeds)
    got = {(r.msisdn, r.span.end.hour): r.n for r in out.collect()}
    assert got == {("a", 1): 2, ("a", 2): 2, ("a", 3): 3, ("a", 4): 1, ("a", 5): 1, ("b", 2): 1, ("b", 3): 1, ("b", 4): 1}


MESSAGES = "msisdn string, send_datetime timestamp"


def sliding_by_hand(parts, span, delay):
    """Messages of the ``span`` hours before each full hour that the watermark has passed; rows of closed hours are late."""
    hours, watermark = {}, dt.datetime.min
    for rows in parts:
        for who, at in rows:
            hour = at.replace(minute=0, second=0, microsecond=0)
            if hour + dt.timedelta(hours=1) > watermark:
                hours[who, hour] = hours.get((who, hour), 0) + 1
        watermark = max([watermark, *(at - dt.timedelta(hours=delay) for _, at in rows)])
    out = {}
    for (who, hour), n in hours.items():
        for k in range(1, span + 1):
            if (end := hour + dt.timedelta(hours=k)) <= watermark:
                out[who, end] = out.get((who, end), 0) + n
    return out


def test_sliding_counts_over_several_arrivals(spark, tmp_path):
    at = lambda hours: T0 + dt.timedelta(hours=hours)
    names = [None, "", *(f"p{i}" for i in range(30))]
    rows = [(names[i * i % 32], at(i * 0.37 % 20)) for i in range(150)]
    parts = [
        [r for r in rows if r[1] < at(8)] + [("clock", at(8))],
        [r for r in rows if at(8) <= r[1] < at(14)] + [("p1", at(7.2)), ("p2", at(1)), ("clock", at(15))],  # 7.2: its hour is open still; 1: late
        [("clock", at(16))],  # the watermark falls on a full hour, other recipients have no rows
        [r for r in rows if r[1] >= at(16)] + [("clock", at(60))],
        [("p3", at(70)), ("p3", at(70.5)), ("clock", at(74))],
    ]
    stream, feeds = arrivals(spark, tmp_path, "m", parts, MESSAGES)
    out = jobs.run_arrivals(jobs.sliding_volume(stream, "5 hours", "1 hour", "1 hour"), feeds)
    got = [((r.msisdn, r.span.end), r.n) for r in out.collect()]
    assert len(got) == len(dict(got)) and dict(got) == sliding_by_hand(parts, 5, 1)
    assert out.where("span.end - span.start <> INTERVAL '5' HOUR").count() == 0


def test_sliding_counts_keep_no_row_per_span(spark, tmp_path):
    people = 60
    folder, check, result = (str(tmp_path / n) for n in ("in", "state", "out"))
    rows = [(f"p{i}", T0 + dt.timedelta(minutes=i)) for i in range(people)] + [("clock", T0 + dt.timedelta(hours=40))]
    spark.createDataFrame(rows, MESSAGES).coalesce(1).write.parquet(folder)
    stream = jobs.sliding_volume(jobs.read_stream(spark, folder, spark.read.parquet(folder).schema))
    query = stream.writeStream.format("parquet").option("path", result).option("checkpointLocation", check).trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.read.parquet(result).count() == people * 24
    assert sum(op["numRowsUpdated"] for p in query.recentProgress for op in p["stateOperators"]) < people * 12


def expiry_by_hand(parts, ttl, delay):
    """Decisions that ran out, with their feedback, and the number left open; ``parts`` are (decisions, feedback) with times in hours."""
    held, out, watermark = {}, [], -1e9
    for decisions, feedback in parts:
        for at, answers, context, key in sorted([(at, False, c or "", k) for k, c, at in decisions] + [(at, True, "", k) for k, at in feedback]):
            if at <= watermark:
                continue  # late
            if answers and key in held and held[key][1] <= at <= held[key][1] + ttl:
                held[key][2] += 1
            elif not answers:
                held.setdefault(key, [context, at, 0])
        watermark = max([watermark, *(d[2] - delay for d in decisions), *(f[1] - delay for f in feedback)])
        for key in [k for k, (_, at, _) in held.items() if at + ttl <= watermark]:
            context, _, n = held.pop(key)
            out.append((key, context, n, "answered" if n else "expired"))
    return sorted(out), len(held)


def test_decisions_of_many_keys_share_a_state(spark, tmp_path):
    hour = lambda n: T0 + dt.timedelta(hours=n)
    parts = [
        ([(i, ["a", None, "b"][i % 3], i * 0.25 % 10) for i in range(80)] + [(5, "later", 9), (7, "z", 1.75), (7, "y", 1.75)], [(i, i * 0.25 % 10 + i % 4) for i in range(0, 90, 2)]),
        ([(i, "again", 11 + i % 3) for i in range(0, 120, 3)], [(i, 10.5 + i % 5) for i in range(120)] + [(3, 2.0)]),
        ([(200, None, 30)], []),  # most run out without rows of their own
        ([(i, "new", 30 + i % 2) for i in range(0, 40, 4)], [(i, 31) for i in range(0, 40, 8)]),
        ([], [(999, 80)]),
    ]
    decisions, given = arrivals(spark, tmp_path, "d", [[(k, c, hour(at)) for k, c, at in d] for d, _ in parts], "sms_id long, context_key string, decided_at timestamp")
    feedback, answers = arrivals(spark, tmp_path, "f", [[(k, hour(at)) for k, at in f] for _, f in parts], "sms_id long, received_at timestamp")
    out = jobs.run_arrivals(state.closed_decisions(decisions, feedback, ttl_days=1, delay="1 hour", buckets=4), given | answers)
    want, left = expiry_by_hand(parts, 24, 1)
    assert sorted((r.sms_id, r.context_key, r.n_feedback, r.status) for r in out.collect()) == want and left == 0 and len(want) == 100
