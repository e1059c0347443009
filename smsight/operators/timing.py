"""When to send: hour scores, send windows, scenarios, timing answers, rates, forecasts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from smsight.functions import scoring, vocab as V
from smsight.functions.calendar import period_of_day


def _literals(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def time_score_matrix(df: DataFrame, label: str = "nlp_type_reel", target: str = "engaged", hour: str = "send_hour") -> DataFrame:
    """Smoothed engagement per hour and type, all 24 hours of every type.

    ``(engaged + m * g) / (sent + m)`` with the overall rate ``g``; an hour without messages
    scores ``g``.  One pass over the rows: the grouped cells of a type become one row, the overall
    rate is a window over those rows (one for each type), and each is spread over the 24 hours.
    Rows without a type are a type of their own; other hours and none count for ``g`` only.
    """
    cells = df.groupBy(F.col(hour).cast("int").alias("send_hour"), F.col(label).alias("nlp_type")).agg(
        F.sum(target).alias("n_eng"), F.count("*").alias("n_obs"))
    cell = F.when(F.col("send_hour").between(0, 23), F.struct("send_hour", F.struct("n_eng", "n_obs")))
    types = cells.groupBy("nlp_type").agg(  # collect_list leaves out nulls
        F.map_from_entries(F.collect_list(cell)).alias("_hours"), F.sum("n_eng").alias("_eng"), F.sum("n_obs").alias("_obs"))
    every = W.partitionBy(F.lit(0))
    rate = F.sum("_eng").over(every) / F.sum("_obs").over(every).cast("double")
    weight = F.when(F.col("nlp_type").isin(V.RARE_TYPES), V.PRIOR_WEIGHT_RARE).otherwise(V.PRIOR_WEIGHT)
    grid = types.withColumn("global_rate", rate).withColumn("send_hour", F.explode(F.sequence(F.lit(0), F.lit(23))))
    found = F.try_element_at("_hours", F.col("send_hour"))
    scored = grid.select(
        "nlp_type", "send_hour", F.coalesce(found["n_eng"], F.lit(0)).alias("n_eng"), F.coalesce(found["n_obs"], F.lit(0)).alias("n_obs"), "global_rate")
    smoothed = (F.col("n_eng") + weight * F.col("global_rate")) / (F.col("n_obs") + weight)
    return scored.withColumn(
        "time_score", F.when(F.col("n_obs") > 0, smoothed).otherwise(F.col("global_rate")))


def score_table(matrix: DataFrame, types: list[str]) -> DataFrame:
    """The matrix as 24 rows with one column per type."""
    return matrix.groupBy("send_hour").pivot("nlp_type", types).agg(F.first("time_score"))


def hybrid_curve(matrix: DataFrame, alpha: float = V.HYBRID_ALPHA, model_score: Column | None = None) -> DataFrame:
    """Normalised time score combined with a model score (1 unless given)."""
    model = F.lit(1.0) if model_score is None else model_score
    norm = F.col("time_score") / F.col("global_rate")
    return matrix.withColumn("time_norm", norm).withColumn(
        "hybrid", F.pow(model, F.lit(alpha)) * F.pow(F.greatest("time_norm", F.lit(V.SCORE_FLOOR)), F.lit(1 - alpha)))


def peak_hours(matrix: DataFrame) -> DataFrame:
    """First best and first worst hour per type."""
    best = F.struct(F.col("time_score"), -F.col("send_hour"))
    worst = F.struct(F.col("time_score"), F.col("send_hour"))
    return matrix.groupBy("nlp_type").agg(
        F.max_by("send_hour", best).alias("peak_hour"), F.min_by("send_hour", worst).alias("trough_hour"),
        F.max("time_score").alias("peak_score"), F.min("time_score").alias("trough_score"),
    )


def optimal_windows(curve: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Best hour and send window per type (and per any further key columns).

    A flat curve takes the fallback window of its type; otherwise the peak of the allowed
    range is widened symmetrically to the hours within 95 % of it.  All windows are
    partitioned by the same keys, 24 rows each.
    """
    keys = keys or ["nlp_type"]
    hour, score, kind = F.col("send_hour"), F.col("hybrid"), F.col("nlp_type")
    morning, evening = kind.isin(V.MORNING_TYPES), kind.isin(V.EVENING_TYPES)
    bound = lambda i: (
        F.when(morning, V.MORNING[i]).when(evening, V.EVENING[i]).otherwise(V.ALLOWED_HOURS[i]))
    fallback = lambda i: scoring.lookup(
        kind, {t: w[i] for t, w in V.FALLBACK_WINDOWS.items()}, V.FALLBACK_WINDOW_DEFAULT[i])
    per_key = W.partitionBy(*keys)
    first_max = lambda inside: F.max(F.when(inside, F.struct(score.alias("s"), (-hour).alias("h"), F.col("time_norm").alias("n")))).over(per_key)

    curve = curve.withColumns({
        "_lo": bound(0), "_hi": bound(1), "_flo": fallback(0), "_fhi": fallback(1)})
    curve = curve.withColumns({
        "_allowed": first_max(hour.between(*V.ALLOWED_HOURS)),
        "_range": first_max(hour.between(F.col("_lo"), F.col("_hi"))),
        "_flat": first_max(hour.between(F.col("_flo"), F.col("_fhi"))),
    })
    peak = -F.col("_range.h")
    eligible = hour.between(F.col("_lo"), F.col("_hi")) & (score >= F.col("_range.s") * F.lit(V.WINDOW_THRESHOLD))
    curve = curve.withColumn("_radius", F.greatest(
        peak - F.min(F.when(eligible, hour)).over(per_key), F.max(F.when(eligible, hour)).over(per_key) - peak))
    is_flat = F.col("_allowed.n") < V.FLAT_CURVE
    start = F.greatest(F.col("_lo"), peak - F.col("_radius"))
    end = F.least(F.col("_hi"), peak + F.col("_radius"))
    gap, half = end - start, V.MAX_GAP // 2
    wide = gap > V.MAX_GAP
    start_fixed = F.when(wide, F.greatest(F.col("_lo"), peak - half)).otherwise(start)
    end_fixed = F.when(wide, F.least(F.col("_hi"), peak + (V.MAX_GAP - half))).when(
        gap < V.MIN_GAP, F.least(F.col("_hi"), start + V.MIN_GAP)).otherwise(end)
    flat_peak = -F.col("_flat.h")
    best = F.when(is_flat, flat_peak).otherwise(peak)
    return curve.where(hour == best).select(
        *keys, best.cast("int").alias("best_hour"),
        F.when(is_flat, F.col("_flo")).otherwise(start_fixed).cast("int").alias("window_start"),
        F.when(is_flat, F.col("_fhi")).otherwise(end_fixed).cast("int").alias("window_end"),
        F.when(is_flat, "fallback_posthoc").when(morning, "morning_priority")
        .when(evening, "evening_priority").otherwise("hybrid_norm").alias("method"),
        F.col("_allowed.n").alias("norm_peak"), score.alias("hybrid_score_peak"),
    )


def timing_scenarios(
    matrix: DataFrame, campaign_types=V.CAMPAIGN_TYPES, operators=tuple(V.OPERATORS), types=V.SCENARIO_TYPES,
    model_scores: DataFrame | None = None,
) -> DataFrame:
    """Every campaign type x operator x message type with its window and 24-point curve.

    ``model_scores(camp_type, operateur, nlp_type, model_score_raw)`` is reported beside the
    window; the window itself depends on the time score only.
    """
    curve = hybrid_curve(matrix)
    windows = optimal_windows(curve)
    point = F.struct(
        F.col("send_hour").alias("hour"), F.round("time_score", 4).alias("time_score_raw"),
        F.round("time_norm", 4).alias("time_score_norm"), F.round("hybrid", 4).alias("hybrid_score_norm"))
    curves = curve.groupBy("nlp_type").agg(F.array_sort(F.collect_list(point)).alias("hourly_curve"))
    asked = matrix.agg(F.max("global_rate").alias("_g")).select(
        "_g", F.explode(_literals(types)).alias("nlp_type"))
    flat_point = lambda h: F.struct(
        h.alias("hour"), F.round("_g", 4).alias("time_score_raw"),
        F.lit(1.0).alias("time_score_norm"), F.lit(1.0).alias("hybrid_score_norm"))
    flat = lambda i: scoring.lookup(
        F.col("nlp_type"), {t: w[i] for t, w in V.FALLBACK_WINDOWS.items()}, V.FALLBACK_WINDOW_DEFAULT[i])
    answered = asked.join(windows, "nlp_type", "left").join(curves, "nlp_type", "left").select(
        "nlp_type", F.coalesce("best_hour", flat(0)).alias("best_hour"),
        F.coalesce("window_start", flat(0)).alias("window_start"),
        F.coalesce("window_end", flat(1)).alias("window_end"),
        F.coalesce("method", F.lit("fallback_posthoc")).alias("method"),
        F.round(F.coalesce("norm_peak", F.lit(1.0)), 4).alias("norm_peak"),
        F.round(F.coalesce("hybrid_score_peak", F.lit(1.0)), 4).alias("hybrid_score_peak"),
        F.coalesce("hourly_curve", F.transform(F.sequence(F.lit(0), F.lit(23)), flat_point)).alias("hourly_curve"),
    )
    grid = answered.withColumn("camp_type", F.explode(_literals(campaign_types))).withColumn(
        "operateur", F.explode(_literals(operators)))
    if model_scores is not None:
        grid = grid.join(model_scores, ["camp_type", "operateur", "nlp_type"], "left")
    else:
        grid = grid.withColumn("model_score_raw", F.lit(None).cast("double"))
    return grid.select(
        "camp_type", "operateur", "nlp_type", "best_hour", "window_start", "window_end",
        scoring.hour_label(F.col("window_start"), F.col("window_end")).alias("window_label"),
        "method", "model_score_raw", "norm_peak", "hybrid_score_peak",
        F.lit(V.HYBRID_ALPHA).alias("alpha"), F.lit(V.WINDOW_THRESHOLD).alias("threshold_pct"),
        F.lit("{}h–{}h".format(*V.ALLOWED_HOURS)).alias("allowed_hours"), "hourly_curve",
    )


def coherence(windows: DataFrame) -> DataFrame:
    """Does the window of each type lie in the expected part of the day?"""
    found = (
        F.when(F.col("window_end") <= V.MORNING[1], "morning")
        .when(F.col("window_start") >= V.EVENING[0], "evening").otherwise("afternoon"))
    return windows.where(F.col("nlp_type").isin(list(V.EXPECTED_PERIOD))).select(
        "nlp_type", found.alias("found_period"),
        scoring.lookup(F.col("nlp_type"), V.EXPECTED_PERIOD).alias("expected_period"),
    ).withColumn("ok", (F.col("found_period") == F.col("expected_period")).cast("int"))


def posthoc_rates(df: DataFrame, label: str = "nlp_type_reel", target: str = "engaged", hour: str = "send_hour") -> DataFrame:
    """Observed rate per type and part of the day, for types with at least 30 rows."""
    rate = lambda span: F.avg(F.when(F.col(hour).between(*span), F.col(target))) * 100
    rates = df.where(F.col(label).isin(V.POSTHOC_TYPES)).groupBy(F.col(label).alias("nlp_type")).agg(
        F.count("*").alias("n"), rate(V.MORNING).alias("morning_pct"),
        rate(V.AFTERNOON).alias("afternoon_pct"), rate(V.EVENING).alias("evening_pct"),
    ).where(F.col("n") >= V.POSTHOC_MIN_ROWS)
    columns = ["morning_pct", "afternoon_pct", "evening_pct"]
    top = F.greatest(*columns)
    return rates.withColumns({
        "delta": top - F.least(*columns),
        "peak_period": F.when(F.col("morning_pct") == top, "morning")
        .when(F.col("evening_pct") == top, "evening").otherwise("afternoon"),
    })


def default_curve(best_hour: Column) -> Column:
    """Bell curve around the default hour."""
    return F.transform(F.sequence(F.lit(0), F.lit(23)), lambda h: F.struct(
        h.alias("hour"),
        scoring.round_half_up(
            F.lit(1.0) + F.lit(0.1) * F.exp(F.lit(-0.5) * F.pow(h - best_hour, F.lit(2))), 3).alias("hybrid_score"),
        F.lit(False).alias("in_window")))


def predict_timing(requests: DataFrame, results: DataFrame, nlp_type: str = "nlp_type") -> DataFrame:
    """Timing answer per request: exact scenario, else the first of the type, else the default.

    ``results`` is the scenario table (campaign types x operators x types, a few dozen rows).
    "First" is the smallest campaign type, then operator.
    """
    lower = lambda c: F.lower(F.col(c))
    answer = F.struct(
        "best_hour", "window_start", "window_end", "window_label", "method", "hybrid_score_peak", "hourly_curve")
    keyed = results.select(
        lower("camp_type").alias("_c"), lower("operateur").alias("_o"), lower("nlp_type").alias("_t"), answer.alias("_a"))
    exact = keyed.groupBy("_c", "_o", "_t").agg(F.min_by("_a", F.struct("_c", "_o")).alias("_exact"))
    by_type = keyed.groupBy("_t").agg(F.min_by("_a", F.struct("_c", "_o")).alias("_by_type"))
    asked = requests.withColumns({
        "_c": lower("campaign_type"), "_o": lower("operateur"), "_t": lower(nlp_type)})
    joined = asked.join(F.broadcast(exact), ["_c", "_o", "_t"], "left").join(F.broadcast(by_type), "_t", "left")
    joined = joined.withColumns({
        "_a": F.coalesce("_exact", "_by_type"),
        "_default": scoring.lookup(F.col(nlp_type), V.DEFAULT_HOURS, V.DEFAULT_HOUR),
    })
    field = lambda name, default: F.coalesce(F.col(f"_a.{name}"), default)
    out = joined.withColumns({
        "best_hour": field("best_hour", F.col("_default")),
        "window_start": field("window_start", F.col("_default") - 1),
        "window_end": field("window_end", F.col("_default") + 1),
        "prediction_score": field("hybrid_score_peak", F.lit(V.DEFAULT_SCORE)),
        "method": field("method", F.lit("fallback_default")),
    })
    in_window = lambda p: F.struct(
        p.hour.alias("hour"), p.hybrid_score_norm.alias("hybrid_score"),
        p.hour.between(F.col("window_start"), F.col("window_end")).alias("in_window"))
    rate = F.least(F.lit(95.0), F.col("prediction_score") * 75.0 + 20.0)
    return out.withColumns({
        "window_label": field("window_label", F.concat(
            F.col("window_start").cast("string"), F.lit("h–"), F.col("window_end").cast("string"), F.lit("h"))),
        "predicted_engagement_rate": scoring.round_half_up(rate, 1),
        "hourly_scores": F.coalesce(
            F.transform(F.col("_a.hourly_curve"), in_window), default_curve(F.col("_default"))),
    }).drop("_a", "_c", "_o", "_t", "_exact", "_by_type", "_default")


def predict_rate(requests: DataFrame, matrix: DataFrame, nlp_type: str = "nlp_type", hour: str = "chosen_hour") -> DataFrame:
    """Base rate of the type scaled by the chosen hour, and the best hour of the matrix.

    A missing hour (no or unreadable date) keeps the full score.
    """
    peaks = peak_hours(matrix).select(F.col("nlp_type").alias("_t"), "peak_hour")
    h, kind = F.col(hour), F.col(nlp_type)
    banded = lambda span, s: F.when(h.between(*span), s[0]).when(h.between(*V.AFTERNOON), s[1]).otherwise(s[2])
    score = (
        F.when(h.isNull(), V.HOUR_SCORE_DEFAULT)
        .when(kind.isin(V.MORNING_TYPES), banded(V.MORNING, V.HOUR_SCORES_MORNING))
        .when(kind.isin(V.EVENING_TYPES), banded(V.EVENING, V.HOUR_SCORES_EVENING))
        .otherwise(V.HOUR_SCORE_DEFAULT))
    best = F.coalesce("peak_hour", F.when(kind.isin(V.MORNING_TYPES), 10).otherwise(19))
    out = requests.join(F.broadcast(peaks), kind == F.col("_t"), "left").withColumns({
        "chosen_hour_score": score.cast("int"), "best_hour": best.cast("int"),
        "base_rate": scoring.lookup(kind, V.BASE_RATES, V.BASE_RATE_DEFAULT),
    })
    return out.withColumns({
        "predicted_engagement_rate": F.bround(F.col("base_rate") * (F.col("chosen_hour_score") / F.lit(100.0)), 1),
        "best_window": F.when(F.col("best_hour") <= V.MORNING[1], "Matin")
        .when(F.col("best_hour") >= V.EVENING[0], "Soir").otherwise("Après-midi"),
    }).withColumn("recommendation", F.format_string(
        "Le meilleur moment est %sh (%s).", F.col("best_hour").cast("string"), F.col("best_window"))
    ).drop("_t", "peak_hour", "base_rate")


# --- forecast of a campaign ---------------------------------------------------------------------

def with_window_rates(df: DataFrame, start: str = "start", end: str = "end", scores: str = "scores") -> DataFrame:
    """Per sending window: ``_n_<window>`` active hours, ``_rate_<window>`` and ``_peak_<window>``.

    Counts days instead of listing hours.  The first active hour is ``start`` rounded up and
    moved into the window; the last day of each hour follows from the end, however long the
    campaign is.  Without an active hour the whole window is averaged.
    """
    first_full = F.to_date(start).cast("timestamp_ntz") + F.make_dt_interval(hours=F.hour(start))
    df = df.withColumn("_floor", first_full).withColumn("_begin", F.when(
        F.col(start) > F.col("_floor"), F.col("_floor") + F.expr("INTERVAL 1 HOUR")).otherwise(F.col("_floor")))
    df = df.withColumns({"_h": F.hour("_begin"), "_day": F.to_date("_begin"), "_eh": F.hour(end), "_eday": F.to_date(end)})
    stages: list[dict[str, Column]] = [{}, {}, {}, {}]
    for name, (lo, hi) in V.WINDOW_HOURS.items():
        length = hi - lo + 1
        late, days, from_hour = (f"_{k}_{name}" for k in ("late", "days", "from"))
        stages[0] |= {
            late: (F.col("_h") > hi).cast("int"),
            from_hour: F.when(F.col("_h") > hi, lo).otherwise(F.greatest(F.col("_h"), F.lit(lo))),
        }
        stages[1] |= {days: F.datediff("_eday", "_day") - F.col(late)}

        def count(h: Column) -> Column:
            last_day = F.col(days) - (h > F.col("_eh")).cast("int")
            return F.greatest(last_day - (h < F.col(from_hour)).cast("int") + 1, F.lit(0))

        counts, part = f"_c_{name}", F.slice(F.col(scores), lo + 1, length)
        stages[2] |= {
            counts: F.transform(F.sequence(F.lit(lo), F.lit(hi)), count),
            f"_s_{name}": part,
        }
        whole = F.aggregate(f"_s_{name}", F.lit(0.0), lambda x, y: x + y) / F.lit(float(length))
        weighted = F.aggregate(
            F.zip_with(counts, f"_s_{name}", lambda n, s: n * s), F.lit(0.0), lambda x, y: x + y)
        total = F.aggregate(counts, F.lit(0), lambda x, y: x + y)
        stages[3] |= {
            f"_n_{name}": total,
            f"_mean_{name}": F.coalesce(F.try_divide(weighted, total.cast("double")), whole),
            f"_peak_{name}": (F.array_position(f"_s_{name}", F.array_max(f"_s_{name}")) + (lo - 1)).cast("int"),
        }
    for stage in stages:
        df = df.withColumns(stage)
    # nine digits, so that the order of summation cannot decide between equal windows
    df = df.withColumns({f"_rate_{w}": F.round(scoring.score_to_rate(F.col(f"_mean_{w}")), 9) for w in V.WINDOW_HOURS})
    helpers = ["_floor", "_begin", "_h", "_day", "_eh", "_eday"]
    helpers += [f"_{k}_{w}" for k in ("late", "days", "from", "c", "s", "mean") for w in V.WINDOW_HOURS]
    return df.drop(*helpers)


def with_reference_curve(df: DataFrame, nlp_type: str, fallback_score: Column | None = None) -> DataFrame:
    """Attach ``scores``, 24 hour scores of the type; an unknown type gets a flat curve."""
    flat = F.array_repeat(F.lit(1.0) if fallback_score is None else fallback_score, 24)
    return df.withColumn("scores", scoring.lookup(
        F.col(nlp_type), {t: _literals(curve) for t, curve in V.REFERENCE_CURVES.items()}, flat))


def forecast_engagement(requests: DataFrame, window: str = "sending_window", keep: int = 2) -> DataFrame:
    """Expected rate of the chosen window and start hour, the best windows, and advice.

    Needs ``start``, ``end``, ``scores`` (24 hour scores) and optionally ``best_hour`` /
    ``best_window`` from the timing answer.  An end before the start becomes start + 24 h.
    Everything is computed inside the row: no shuffle.
    """
    for missing, kind in (("best_hour", "int"), ("best_window", "string")):
        if missing not in requests.columns:
            requests = requests.withColumn(missing, F.lit(None).cast(kind))
    start, windows = F.col("start"), list(V.WINDOW_HOURS)
    df = requests.withColumns({
        "_window": F.when(F.col(window).isin(windows), F.col(window)).otherwise("ALL_DAY"),
        "end": F.when(F.col("end") < start, start + F.expr("INTERVAL 24 HOURS")).otherwise(F.col("end")),
    })
    df = with_window_rates(df)
    chosen = lambda kind: scoring.lookup(F.col("_window"), {w: F.col(f"_{kind}_{w}") for w in windows})
    # equal rates keep the order of WINDOW_HOURS
    entries = F.array(*[F.struct(
        (-F.col(f"_rate_{w}")).alias("loss"), F.lit(i).alias("order"), F.lit(w).alias("window"),
        F.col(f"_peak_{w}").alias("peak_hour")) for i, w in enumerate(windows)])
    df = df.withColumns({
        "engagement_rate": chosen("rate"), "active_hours": chosen("n"),
        "chosen_hour_rate": scoring.score_to_rate(F.element_at("scores", F.hour(start) + 1)),
        "top_windows": F.transform(F.slice(F.array_sort(entries), 1, keep), lambda e: F.struct(
            e["window"].alias("window"), (-e["loss"]).alias("rate"), e["peak_hour"].alias("peak_hour"))),
    })
    helpers = [f"_{kind}_{w}" for kind in ("n", "rate", "peak") for w in windows]
    return df.withColumn("recommendation", recommendation()).drop("_window", *helpers)


def recommendation() -> Column:
    """Advice text of a forecast (French, as shown to the sender)."""
    rate, hour_rate = F.col("engagement_rate"), F.col("chosen_hour_rate")
    best = F.element_at("top_windows", 1)
    one_decimal = lambda c: F.format_string("%.1f", F.round(c, 1))
    label = lambda w: scoring.lookup(w, V.WINDOW_LABELS, V.WINDOW_LABELS["ALL_DAY"])
    band = (
        F.when(rate >= 75, "Excellent potentiel d'engagement ! ")
        .when(rate >= 60, "Bon potentiel d'engagement. ")
        .when(rate >= 45, "Potentiel d'engagement modere. ")
        .otherwise("Potentiel d'engagement faible. "))
    mean = F.concat(
        F.lit("Taux moyen sur "), F.col("active_hours").cast("string"), F.lit(" creneaux actifs ("),
        label(F.col("_window")), F.lit(") : "), one_decimal(rate), F.lit("%. "))
    hour = F.col("best_hour").cast("string")
    peak = (
        F.when(F.col("best_hour").isNull(), "")
        .when(F.col("best_window").isNotNull(), F.concat(
            F.lit("Pic optimal ML : "), hour, F.lit("h00 ("), F.col("best_window"), F.lit("). ")))
        .otherwise(F.concat(F.lit("Pic optimal ML : "), hour, F.lit("h00. "))))
    advice = F.when((best.window != F.col("_window")) & (best.rate > rate + 5), F.concat(
        F.lit("Conseil : passer a « "), label(best.window), F.lit(" » pourrait augmenter votre taux a "),
        one_decimal(best.rate), F.lit("%."))).otherwise("")
    opening = (
        F.when(hour_rate >= 80, " L'heure de debut est excellente !")
        .when(hour_rate >= 60, " L'heure de debut est correcte mais pas au pic.")
        .when(F.col("best_hour").isNotNull(), F.concat(
            F.lit(" Deplacez l'heure de debut vers "), hour, F.lit("h pour plus d'impact.")))
        .otherwise(""))
    return F.concat(band, mean, peak, advice, opening)


def with_fallback_prediction(df: DataFrame, answered: Column) -> DataFrame:
    """Historical averages for the rows a model did not answer; failure is a state of the row."""
    columns = {name: F.coalesce(F.col(name), F.lit(None)) if name in df.columns else F.lit(None) for name in V.FALLBACK_PREDICTION}
    return df.withColumns({
        name: F.when(answered, columns[name]).otherwise(F.lit(default)) for name, default in V.FALLBACK_PREDICTION.items()
    }).withColumn("source", F.when(answered, "model").otherwise("fallback"))


# --- profiles and series -----------------------------------------------------------------------------

def profile_grid(df: DataFrame, types=V.SCENARIO_TYPES) -> DataFrame:
    """Neutral feature row per campaign type, operator and message type.

    The only data-driven parts are the median hour, the overall rate and the mean recipient
    rate of ``df`` (which has ``msisdn_engagement_rate``).
    """
    neutral = df.agg(
        F.floor(F.median("send_hour")).cast("int").alias("send_hour"), F.avg("engaged").alias("global_mean"),
        F.avg("msisdn_engagement_rate").alias("msisdn_engagement_rate"))
    grid = neutral.withColumn("camp_type", F.explode(_literals(V.CAMPAIGN_TYPES))).withColumn(
        "smsc_name", F.explode(_literals(V.OPERATORS))).withColumn("nlp_type", F.explode(_literals(types)))
    h, kind = F.col("send_hour"), F.col("nlp_type")
    flag = lambda condition: condition.cast("int")
    grid = grid.withColumns({
        "send_month": F.lit(10), "day_of_month": F.lit(15), "week_of_month": F.lit(3), "quarter": F.lit(4),
        "is_salary_period": F.lit(0), "is_rentree": F.lit(1), "is_mid_week": F.lit(1),
        "is_peak_morning": flag(h.between(*V.PEAK_MORNING)), "is_peak_evening": flag(h.between(*V.PEAK_EVENING)),
        "period": period_of_day(h),
        "schedule_h_start": F.lit(7), "schedule_h_end": F.lit(21),
        "schedule_position": F.greatest(F.lit(0.0), (h - 7) / F.lit(14.0)),
        "operateur_failure_rate": scoring.lookup(F.col("smsc_name"), {k: v[0] for k, v in V.OPERATORS.items()}, 0.15),
        "smsc_id": scoring.lookup(F.col("smsc_name"), {k: v[1] for k, v in V.OPERATORS.items()}, 1),
        "campaign_type_enc": flag(F.col("camp_type") == "TRANSACTIONAL"),
        "message_lenth": F.lit(80), "nbr_page": F.lit(1), "groupe_id": F.lit(1), "encoding_enc": F.lit(0),
        "msisdn_tier": F.lit(1.0), "msisdn_sms_count": F.lit(5.0), "msisdn_cold_start": F.lit(0),
        "nlp_proba_max": F.lit(0.85),
        "nlp_text_mult": scoring.lookup(kind, V.TEXT_MULTIPLIER, 1.0),
        "urgency_score": scoring.lookup(kind, V.URGENCY_OF_TYPE, V.URGENCY_DEFAULT),
        "is_otp": flag(kind == "OTP"), "is_alert": flag(kind == "Alerte"), "is_promo": flag(kind == "Promotion"),
        "is_financial": flag(kind == "Transaction"), "is_livraison_kw": flag(kind == "Livraison"),
        "is_reminder": flag(kind == "Rappel"),
        "nlp_domaine": F.when(kind == "Promotion", "Marketing")
        .when(F.col("camp_type") == "TRANSACTIONAL", "Banque").otherwise("Marketing"),
    })
    return grid.withColumns({
        "is_urgent_high": flag(F.col("urgency_score") > 0.7),
        "is_sensitive": flag((F.col("is_otp") == 1) | (F.col("is_alert") == 1)),
        "is_marketing": flag((F.col("is_promo") == 1) & (F.col("urgency_score") < 0.4)),
        "is_transactional": flag((F.col("is_financial") == 1) | (F.col("is_otp") == 1)),
        "urgent_x_hour": F.col("urgency_score") * (h / F.lit(23.0)),
        "msisdn_rate_x_type": F.col("msisdn_engagement_rate") * F.col("campaign_type_enc"),
    })


def serving_features(requests: DataFrame) -> DataFrame:
    """Model row of a timing request, with the serving defaults for what a request lacks."""
    t, kind = F.col("scheduled"), F.col("nlp_type")
    h, flag = F.hour(t), lambda condition: F.coalesce(condition.cast("int"), F.lit(0))
    sensitive, morning = kind.isin("OTP", "Alerte"), h.between(*V.PEAK_MORNING)
    return requests.withColumns({
        "send_hour": h, "send_month": F.month(t), "send_day_of_week": F.weekday(t), "day_of_month": F.dayofmonth(t),
        "is_morning": flag(h.between(*V.MORNING)), "is_afternoon": flag(h.between(*V.AFTERNOON)),
        "is_evening": flag(h.between(*V.EVENING)), "is_peak_morning": flag(morning),
        "is_peak_evening": flag(h.between(*V.PEAK_EVENING)), "is_salary_period": flag(F.dayofmonth(t) <= 5),
        "campaign_type_enc": flag(F.col("campaign_type") == "TRANSACTIONAL"),
        "encoding_enc": flag(F.col("encoding") == "UCS2"), "nbr_pages": F.coalesce("nbr_pages", F.lit(1)),
        "smsc_name_enc": scoring.lookup(F.lower("operateur"), {"orange": 0, "ooredoo": 1, "telecom": 2}, 0),
        "operateur_failure_rate": F.coalesce("operateur_failure_rate", F.lit(0.15)),
        "urgency_score": scoring.lookup(kind, V.URGENCY_OF_TYPE, V.URGENCY_DEFAULT),
        "msisdn_engagement_rate": F.coalesce("msisdn_engagement_rate", F.lit(0.30)),
        "msisdn_tier": F.lit(1.0), "msisdn_cold_start": F.lit(0), "nlp_proba_max": F.lit(0.85),
        "sensitive_x_morning": flag(sensitive & morning).cast("double"),
        "marketing_x_evening": flag((kind == "Promotion") & h.between(*V.PEAK_EVENING)).cast("double"),
        "transact_x_morning": flag((kind == "Transaction") & morning).cast("double"),
        "smsc_name_target_loo": F.lit(0.30), "campaign_type_target_loo": F.lit(0.30), "nlp_type_target_loo": F.lit(0.30),
    })


def curve_series(scenarios: DataFrame) -> DataFrame:
    """Dashboard series: the normalised hour curve per type (first scenario of each type)."""
    first = scenarios.groupBy("nlp_type").agg(
        F.min_by("hourly_curve", F.struct("camp_type", "operateur")).alias("curve"))
    return first.select("nlp_type", F.explode("curve").alias("p")).select(
        "nlp_type", F.col("p.hour").alias("hour"), F.col("p.time_score_norm").alias("time_score_norm"))
