"""SQL counterpart of each registered query, for DuckDB over the same parquet tables."""

from __future__ import annotations

from smsight.functions import vocab as V
from smsight.operators.prefixes import CALLING_CODES
from smsight.plans import fixtures as X
from smsight.plans.oracle_tables import (
    ARABIC, PAGES, _flag, case, has_phrase, language, strings, text, tokens, with_tables,
)

SQL: dict[str, str] = {}

# --- calendar and profile features ------------------------------------------------------------------


def _calendar(ts: str, periods) -> str:
    ramadan = " OR ".join(f"{ts} BETWEEN TIMESTAMP '{a}' AND TIMESTAMP '{b}'" for a, b in periods)
    return f"""CAST(day({ts}) AS INTEGER) AS day_of_month, {_flag(f'day({ts}) <= 5')} AS is_salary_period,
  CAST((day({ts}) - 1) // 7 + 1 AS INTEGER) AS week_of_month, CAST(quarter({ts}) AS INTEGER) AS quarter, {_flag(ramadan)} AS is_ramadan,
  {_flag(f'month({ts}) IN (7, 8)')} AS is_summer, {_flag(f'month({ts}) IN (9, 10)')} AS is_rentree, {_flag(f'month({ts}) IN (12, 1)')} AS is_winter"""


SQL["calendar_features"] = f"SELECT sms_id, {_calendar('send_datetime', [('2024-01-10', '2024-01-20'), *V.RAMADAN_PERIODS])} FROM sms_log"
SQL["campaign_calendar"] = f"SELECT campaign_id, * EXCLUDE (campaign_id, is_salary_period) FROM (SELECT campaign_id, {_calendar('planned_start', [('1997-03-01', '1997-03-30')])} FROM campaigns)"
_HOURS = f"""{_flag('send_hour BETWEEN 8 AND 12')} AS is_peak_morning, {_flag('send_hour BETWEEN 17 AND 22')} AS is_peak_evening,
  {_flag('send_hour BETWEEN 8 AND 12 OR send_hour BETWEEN 17 AND 22')} AS is_peak"""
_PERIOD = "CASE WHEN send_hour BETWEEN 7 AND 11 THEN 'morning' WHEN send_hour BETWEEN 12 AND 16 THEN 'afternoon' WHEN send_hour BETWEEN 17 AND 22 THEN 'evening' ELSE 'night' END"
SQL["schedule_features"] = f"""
SELECT sms_id, greatest(send_hour - schedule_h_start, 0) AS hour_in_schedule, greatest(schedule_h_end - schedule_h_start, 1) AS schedule_duration,
  round(greatest(send_hour - schedule_h_start, 0) / greatest(schedule_h_end - schedule_h_start, 1), 6) AS schedule_position, {_HOURS},
  {_flag(f"{_PERIOD} = 'morning'")} AS is_morning, {_flag(f"{_PERIOD} = 'afternoon'")} AS is_afternoon,
  {_flag(f"{_PERIOD} = 'evening'")} AS is_evening, {_flag(f"{_PERIOD} = 'night'")} AS is_night,
  {_flag('send_day_of_week = 0')} AS is_monday, {_flag('send_day_of_week = 4')} AS is_friday,
  {_flag('send_day_of_week >= 5')} AS is_weekend, {_flag('send_day_of_week IN (1, 2, 3)')} AS is_mid_week, {_PERIOD} AS period
FROM sms_log"""
_COARSE = f"""SELECT *, {case('nlp_type', V.DOMAIN_OF_TYPE, text(V.DOMAIN_DEFAULT))} AS nlp_domaine, CAST(0.75 AS DOUBLE) AS nlp_proba_max
FROM (SELECT *, {case('nlp_type_reel', V.COARSE_TYPE, text(V.COARSE_TYPE_DEFAULT))} AS nlp_type FROM sms_log)"""
SQL["coarse_labels"] = f"SELECT sms_id, nlp_type, nlp_domaine, nlp_proba_max FROM ({_COARSE})"
SQL["type_counts"] = f"SELECT nlp_type AS value, count(*) AS n FROM ({_COARSE}) GROUP BY 1"
SQL["one_hot_types"] = "SELECT sms_id, " + ", ".join(
    [f'{_flag(f"nlp_type = {text(t)}")} AS "type_{t}"' for t in V.MESSAGE_TYPES]
    + [f'{_flag(f"nlp_domaine = {text(x)}")} AS "domain_{x}"' for x in V.DOMAINS]) + f" FROM ({_COARSE})"
SQL["label_encode"] = f"""
SELECT sms_id, CAST(dense_rank() OVER (ORDER BY smsc_name) - 1 AS INTEGER) AS smsc_name_enc,
  CAST(dense_rank() OVER (ORDER BY campaign_type) - 1 AS INTEGER) AS campaign_type_enc,
  {_flag("encoding = 'UCS2'")} AS encoding_enc, coalesce(groupe_id, 0) AS groupe_id FROM sms_log"""
SQL["group_stats"] = """
SELECT smsc_name, campaign_type, sum(engaged)::BIGINT AS n_eng, count(*) AS n_obs, round(avg(engaged), 6) AS rate,
  round(stddev_samp(engaged), 6) AS rate_std FROM sms_log GROUP BY 1, 2"""


def _loo(key: str, rows: str = "sms_log") -> str:
    return (f"CASE WHEN count(*) OVER (PARTITION BY {key}) > 1 THEN (sum(engaged) OVER (PARTITION BY {key}) - engaged) "
            f"/ (count(*) OVER (PARTITION BY {key}) - 1) ELSE avg(engaged) OVER () END")


SQL["loo_rate"] = f"SELECT sms_id, msisdn, round({_loo('msisdn')}, 6) AS loo_rate FROM sms_log"
_KEYS = ["smsc_name", "campaign_type", "nlp_type", "nlp_domaine"]
SQL["loo_target_encoding"] = "SELECT sms_id, " + ", ".join(
    f"round({_loo(k)}, 6) AS {k}_target_loo" for k in _KEYS) + f" FROM ({_COARSE})"
SQL["loo_target_encoding_published"] = """
SELECT sms_id, round((sum(s) OVER (PARTITION BY smsc_name) - engaged) / (c - 1), 6) AS smsc_name_target_loo
FROM sms_log JOIN (SELECT smsc_name, sum(engaged) AS s, count(*) AS c FROM sms_log GROUP BY 1) USING (smsc_name)"""
SQL["msisdn_features"] = f"""
SELECT sms_id, round(r, 6) AS msisdn_engagement_rate, round(r - g, 6) AS msisdn_rate_vs_global,
  round(ln(1 + n::DOUBLE), 6) AS msisdn_sms_count_log, round(r * r, 6) AS msisdn_rate_squared,
  round(r * CASE WHEN campaign_type = 'TRANSACTIONAL' THEN 1 ELSE 0 END, 6) AS msisdn_rate_x_type,
  n AS msisdn_sms_count, {_flag('n = 1')} AS msisdn_cold_start
FROM (SELECT sms_id, campaign_type, {_loo('msisdn')} AS r, count(*) OVER (PARTITION BY msisdn) AS n, avg(engaged) OVER () AS g FROM sms_log)"""
_TIERED = f"""(WITH l AS (SELECT *, {_loo('msisdn')} AS r FROM sms_log),
  q AS (SELECT quantile_cont(r, 0.33) AS a, quantile_cont(r, 0.66) AS b, quantile_cont(r, 0.5) AS m FROM l)
  SELECT l.*, CASE WHEN a = b THEN {_flag('r > m')} WHEN r <= a THEN 0 WHEN r <= b THEN 1 ELSE 2 END AS tier FROM l, q)"""
SQL["msisdn_tier"] = f"SELECT sms_id, CAST(tier AS INTEGER) AS msisdn_tier FROM {_TIERED}"
SQL["rate_quantiles"] = f"""
SELECT round(quantile_cont(r, 0.33), 6) AS q0, round(quantile_cont(r, 0.66), 6) AS q1, round(quantile_cont(r, 0.5), 6) AS q2
FROM (SELECT {_loo('msisdn')} AS r FROM sms_log)"""
SQL["tier_engagement"] = f"""
SELECT CAST(tier AS INTEGER) AS tier, count(*) AS n, round(avg(engaged) * 100, 6) AS rate_pct,
  {case('tier', V.TIER_LABELS, "'other'")} AS label FROM {_TIERED} GROUP BY tier"""
SQL["fatigue_24h"] = """
SELECT sms_id, count(*) OVER (PARTITION BY msisdn ORDER BY send_datetime
  RANGE BETWEEN INTERVAL 24 HOURS PRECEDING AND INTERVAL 1 MICROSECOND PRECEDING) AS sms_last_24h FROM sms_log"""

# --- text ---------------------------------------------------------------------------------------------------
_re = lambda pattern: pattern.replace(r"\d", r"\p{Nd}").replace(r"dt\b", r"dt(?:$|[^\p{L}\p{N}_])").replace("'", "''")
_SIGNALS = ", ".join(f"{_flag(f'regexp_matches(low, {text(_re(p))})')} AS {n}" for n, p in V.SIGNAL_PATTERNS.items())


def _signals(rows: str, keep: str) -> str:
    return f"""SELECT *, {_flag('urgency_score > 0.7')} AS is_urgent_high, {_flag('is_otp = 1 OR is_alert = 1')} AS is_sensitive,
  {_flag('is_promo = 1 AND urgency_score < 0.4')} AS is_marketing, {_flag('is_financial = 1 OR is_otp = 1')} AS is_transactional
FROM (SELECT {keep}, least(len(regexp_extract_all(low, {text(V.URGENCY_PATTERN)})), 4) / 4.0::DOUBLE AS urgency_score, {_SIGNALS}
  FROM (SELECT *, lower(message) AS low FROM ({rows})))"""


SQL["text_signals"] = _signals("SELECT * FROM messages", "message_id")
SQL["interactions"] = f"""
SELECT sms_id, is_sensitive * pm::DOUBLE AS sensitive_x_morning, is_marketing * pe::DOUBLE AS marketing_x_evening,
  round(is_marketing * pe * p, 6) AS marketing_x_evening_strong, is_transactional * pm::DOUBLE AS transact_x_morning,
  is_livraison_kw * pe::DOUBLE AS livraison_x_evening, is_urgent_high * pm::DOUBLE AS urgent_x_morning,
  (is_financial * {_flag('day(send_datetime) <= 5')})::DOUBLE AS financial_x_salary, round(urgency_score * (send_hour / 23.0::DOUBLE), 6) AS urgent_x_hour,
  (is_otp * {_flag("campaign_type = 'TRANSACTIONAL'")})::DOUBLE AS otp_x_campaign_type, p * pm AS proba_x_morning, p * pe AS proba_x_evening,
  round(is_marketing * pe * r, 6) AS marketing_x_msisdn
FROM (SELECT *, {_flag('send_hour BETWEEN 8 AND 12')} AS pm, {_flag('send_hour BETWEEN 17 AND 22')} AS pe, 0.75::DOUBLE AS p
  FROM ({_signals(f"SELECT *, {_loo('msisdn')} AS r FROM sms_log", "* EXCLUDE (low)")}))"""
SQL["normalize_messages"] = "SELECT message_id, clean FROM clean_messages"
_words = "CASE WHEN clean = '' THEN 0 ELSE len(string_split(clean, ' ')) END"
_count = lambda column, pattern: f"len(regexp_extract_all({column}, '{pattern}'))"
_brand = lambda names: _flag(" OR ".join(f"contains(low, {text(n)})" for n in names))
_m = lambda pattern: f"regexp_matches(clean, {text(pattern)})"
_FLAGS = ", ".join(f"{_flag(f'contains(clean, {text(t)})')} AS {n}" for n, t in V.TOKEN_FLAGS.items())
_DERIVED = {
    "immo_strong": "num_immo_kw >= 2", "immo_montant": "has_immo_kw = 1 AND has_montant = 1",
    "immo_rdv": f"has_immo_kw = 1 AND (has_heure = 1 OR {_m(V.VISIT_PATTERN)})",
    "immo_contrat": f"has_immo_kw = 1 AND {_m(V.CONTRACT_PATTERN)}", "immo_darija": f"has_immo_kw = 1 AND {_m(V.DARIJA_HOME_PATTERN)}",
    "immo_not_log": f"has_immo_kw = 1 AND NOT {_m(V.PARCEL_PATTERN)}", "immo_not_install": f"has_immo_kw = 1 AND NOT {_m(V.INSTALL_PATTERN)}",
    "telecom_context": "has_code = 1 AND has_tel_kw = 1", "telecom_strong": "num_tel_kw >= 2",
    "telecom_recharge": f"has_tel_kw = 1 AND {_m(V.TOPUP_PATTERN)}", "telecom_install": f"has_tel_kw = 1 AND {_m(V.INSTALL_PATTERN)}",
    "telecom_brand": "has_telecom_brand = 1", "bank_context": "has_code = 1 AND has_bank_kw = 1",
    "bank_transaction": "has_montant = 1 AND has_bank_kw = 1", "bank_brand": "has_bank_brand = 1",
    "log_context": "has_log_kw = 1 AND has_montant = 1", "sante_context": "has_sante_kw = 1 AND has_heure = 1",
    "promo_signal": "has_mkt_kw = 1 AND num_exclamation >= 1",
}
SQL["manual_text_features"] = f"""
SELECT message_id, * EXCLUDE (message_id, clean), {', '.join(f'{_flag(c)} AS {n}' for n, c in _DERIVED.items())}
FROM (SELECT message_id, clean, length(clean)::INTEGER AS len_chars, ({_words})::INTEGER AS len_words,
  round(CASE WHEN {_words} = 0 THEN 0.0 ELSE (length(clean) - ({_words} - 1)) / ({_words})::DOUBLE END, 6) AS avg_word_len, {_FLAGS},
  {_count('message', '\\p{Lu}')}::INTEGER AS num_uppercase, {_count('message', '!')}::INTEGER AS num_exclamation, {_count('message', '\\?')}::INTEGER AS num_question,
  {_count('clean', 'IMMO_KW')}::INTEGER AS num_immo_kw, {_count('clean', 'TEL_KW')}::INTEGER AS num_tel_kw,
  {_brand(V.BANK_BRANDS)} AS has_bank_brand, {_brand(V.TELECOM_BRANDS)} AS has_telecom_brand,
  0 AS is_darija, 0 AS is_arabe, 0 AS is_anglais, 0 AS is_ambiguous, 0 AS num_candidates FROM clean_messages)"""
SQL["classify_messages"] = "SELECT message_id, split_part(answer, '/', 1) AS nlp_type, split_part(answer, '/', 2) AS nlp_domaine FROM cascade"


def _substrings(column: str, rules: dict) -> str:
    whens = " ".join("WHEN " + " OR ".join(f"contains({column}, {text(w)})" for w in words) + f" THEN {text(kind)}" for kind, words in rules.items())
    return f"CASE {whens} ELSE 'Information' END"


SQL["classify_basic"] = f"SELECT message_id, {_substrings('lower(message)', V.BASIC_RULES)} AS nlp_type FROM messages"
SQL["classify_campaign"] = f"SELECT message_id, {_substrings('lower(message)', V.CAMPAIGN_RULES)} AS nlp_type FROM messages"
_WORD_CASE = " ".join(f"WHEN {has_phrase('low_marked', words)} THEN {text(kind)}" for kind, words in V.WORD_RULES.items())
SQL["classify_words"] = rf"""
SELECT message_id, CASE WHEN regexp_matches(low, '[\n\r\x{{85}}\x{{2028}}\x{{2029}}]') THEN 'Information' {_WORD_CASE} ELSE 'Information' END AS nlp_type
FROM clean_messages"""
SQL["sms_pages"] = f"""
SELECT message_id, ({PAGES.format('message')}) AS pages, CAST(ceil(length(message) / 160.0) AS INTEGER) AS pages_160,
  CASE WHEN regexp_matches(message, '{ARABIC}') THEN 'UCS2' ELSE 'UTF-8' END AS encoding FROM messages"""
SQL["template_variables"] = """
SELECT message_id, coalesce(array_to_string(list_filter(v, lambda x, i: list_position(v, x) = i), ','), '') AS variables
FROM (SELECT message_id, regexp_extract_all(message, '@[A-Za-z0-9_]+') AS v FROM messages)"""
_CAMPAIGN_TYPE = _substrings("lower(message)", V.CAMPAIGN_RULES)
SQL["request_dedup"] = f"""
SELECT campaign_type, operateur, nlp_type, count(*) AS n_requests, count(DISTINCT trim(lower(message))) AS n_distinct
FROM (SELECT *, {_CAMPAIGN_TYPE} AS nlp_type FROM campaigns) GROUP BY ALL"""

# --- timing -------------------------------------------------------------------------------------------------------
SQL["time_score_matrix"] = "SELECT nlp_type, send_hour, n_eng, n_obs, round(time_score, 6) AS time_score, round(global_rate, 6) AS global_rate FROM matrix"
SQL["score_table"] = "SELECT send_hour, " + ", ".join(
    f'round(max(time_score) FILTER (WHERE nlp_type = {text(t)}), 6) AS "{t}"' for t in V.MESSAGE_TYPES) + " FROM matrix GROUP BY 1"
SQL["hybrid_curve"] = "SELECT nlp_type, send_hour, round(time_norm, 6) AS time_norm, round(hybrid, 6) AS hybrid FROM curve"
SQL["peak_hours"] = """
SELECT nlp_type, arg_min(send_hour, rank_best) AS peak_hour, arg_min(send_hour, rank_worst) AS trough_hour,
  round(max(time_score), 6) AS peak_score, round(min(time_score), 6) AS trough_score
FROM (SELECT *, row_number() OVER (PARTITION BY nlp_type ORDER BY time_score DESC, send_hour) AS rank_best,
  row_number() OVER (PARTITION BY nlp_type ORDER BY time_score, send_hour) AS rank_worst FROM matrix) GROUP BY 1"""
SQL["optimal_windows"] = "SELECT * EXCLUDE (norm_peak, hybrid_score_peak), round(norm_peak, 6) AS norm_peak, round(hybrid_score_peak, 6) AS hybrid_score_peak FROM windows"
_LABEL = "printf('%02dh–%02dh', window_start, window_end)"
_SCENARIOS = f"""SELECT camp_type, operateur, w.nlp_type, best_hour, {_LABEL} AS window_label, method, send_hour AS hour,
  round(time_norm, 4) AS time_score_norm, round(hybrid, 4) AS hybrid_score_norm
FROM (SELECT unnest({strings(V.CAMPAIGN_TYPES)}) AS camp_type), (SELECT unnest({strings(V.OPERATORS)}) AS operateur),
  windows w JOIN curve c ON c.nlp_type = w.nlp_type WHERE list_contains({strings(V.SCENARIO_TYPES)}, w.nlp_type)"""
SQL["timing_scenarios"] = _SCENARIOS
SQL["curve_series"] = f"SELECT nlp_type, send_hour AS hour, round(time_norm, 4) AS time_score_norm FROM curve WHERE list_contains({strings(V.SCENARIO_TYPES)}, nlp_type)"
SQL["coherence"] = f"""
SELECT *, {_flag('found_period = expected_period')} AS ok FROM (SELECT nlp_type,
  CASE WHEN window_end <= 11 THEN 'morning' WHEN window_start >= 17 THEN 'evening' ELSE 'afternoon' END AS found_period,
  {case('nlp_type', V.EXPECTED_PERIOD)} AS expected_period FROM windows) WHERE expected_period IS NOT NULL"""
SQL["posthoc_rates"] = f"""
SELECT nlp_type, n, round(m, 6) AS morning_pct, round(a, 6) AS afternoon_pct, round(e, 6) AS evening_pct,
  round(greatest(m, a, e) - least(m, a, e), 6) AS delta,
  CASE WHEN m = greatest(m, a, e) THEN 'morning' WHEN e = greatest(m, a, e) THEN 'evening' ELSE 'afternoon' END AS peak_period
FROM (SELECT nlp_type_reel AS nlp_type, count(*) AS n, avg(engaged) FILTER (WHERE send_hour BETWEEN 7 AND 11) * 100 AS m,
  avg(engaged) FILTER (WHERE send_hour BETWEEN 12 AND 16) * 100 AS a, avg(engaged) FILTER (WHERE send_hour BETWEEN 17 AND 22) * 100 AS e
  FROM sms_log WHERE list_contains({strings(V.POSTHOC_TYPES)}, nlp_type_reel) GROUP BY 1 HAVING count(*) >= 30)"""
SQL["timing_lookup"] = f"""
SELECT sms_id, nlp_type, CAST(best_hour AS INTEGER) AS best_hour, CAST(window_start AS INTEGER) AS window_start, CAST(window_end AS INTEGER) AS window_end,
  window_label, method, score AS prediction_score, floor(least(95.0::DOUBLE, score * 75.0::DOUBLE + 20.0::DOUBLE) * 10 + 0.5) / 10.0::DOUBLE AS predicted_engagement_rate,
  found AND send_hour BETWEEN window_start AND window_end AS in_window
FROM (SELECT s.sms_id, s.send_hour, s.nlp_type, w.nlp_type IS NOT NULL AS found, coalesce(w.best_hour, d) AS best_hour,
    coalesce(w.window_start, d - 1) AS window_start, coalesce(w.window_end, d + 1) AS window_end,
    coalesce({_LABEL}, (d - 1) || 'h–' || (d + 1) || 'h') AS window_label, coalesce(w.method, 'fallback_default') AS method,
    coalesce(round(w.hybrid_score_peak, 4), 1.05::DOUBLE) AS score
  FROM (SELECT l.sms_id, l.send_hour, split_part(c.answer, '/', 1) AS nlp_type, {case("split_part(c.answer, '/', 1)", V.DEFAULT_HOURS, '10')} AS d
    FROM sms_log l JOIN cascade c ON c.message_id = 'e' || CAST(l.sms_id AS VARCHAR)) s
  LEFT JOIN (SELECT * FROM windows WHERE list_contains({strings(V.SCENARIO_TYPES)}, nlp_type)) w ON w.nlp_type = s.nlp_type)"""
_BASE = case("nlp_type", V.BASE_RATES, "16.0")
SQL["rate_engine"] = f"""
SELECT campaign_id, nlp_type, printf('%.1f', base * (score / 100.0::DOUBLE))::DOUBLE AS predicted_engagement_rate, best_hour,
  CASE WHEN best_hour <= 11 THEN 'Matin' WHEN best_hour >= 17 THEN 'Soir' ELSE 'Après-midi' END AS best_window, score AS chosen_hour_score
FROM (SELECT campaign_id, c.nlp_type, ({_BASE.replace('nlp_type', 'c.nlp_type')})::DOUBLE AS base,
  CAST(coalesce(p.peak_hour, CASE WHEN c.nlp_type IN ('OTP', 'Transaction', 'Alerte') THEN 10 ELSE 19 END) AS INTEGER) AS best_hour,
  CASE WHEN h IS NULL THEN 100
    WHEN c.nlp_type IN ('OTP', 'Transaction', 'Alerte') THEN CASE WHEN h BETWEEN 7 AND 11 THEN 95 WHEN h BETWEEN 12 AND 16 THEN 60 ELSE 35 END
    WHEN c.nlp_type IN ('Promotion', 'Livraison') THEN CASE WHEN h BETWEEN 17 AND 22 THEN 92 WHEN h BETWEEN 12 AND 16 THEN 70 ELSE 45 END
    ELSE 100 END AS score
  FROM (SELECT campaign_id, {_substrings('lower(message)', V.BASIC_RULES)} AS nlp_type, CASE WHEN campaign_id % 13 <> 0 THEN hour(planned_start) END AS h FROM campaigns) c
  LEFT JOIN ({SQL['peak_hours']}) p ON p.nlp_type = c.nlp_type)"""
_CURVES = " UNION ALL ".join(
    f"SELECT {text(t)} AS nlp_type, CAST([{', '.join(map(str, c))}] AS DOUBLE[]) AS scores" for t, c in V.REFERENCE_CURVES.items())
# the walk over hours, listed: every visited hour and every jump to the next day is one step
_ACTIVE = f"""
  requests AS (SELECT campaign_id, sending_window, planned_start AS t0, message, r.nlp_type, scores, best_hour, best_window,
      CASE WHEN end_date < planned_start THEN planned_start + INTERVAL 24 HOURS ELSE end_date END AS t1
    FROM (SELECT *, {_CAMPAIGN_TYPE} AS nlp_type FROM campaigns) r JOIN ({_CURVES}) k ON k.nlp_type = r.nlp_type
    LEFT JOIN (SELECT nlp_type AS wt, best_hour, {_LABEL} AS best_window FROM windows) ON wt = CASE r.nlp_type WHEN 'Reminder' THEN 'Rappel' ELSE r.nlp_type END),
  defs AS (SELECT * FROM (VALUES ('BUSINESS_HOURS', 8, 18, 0), ('EVENING', 18, 22, 1), ('ALL_DAY', 0, 23, 2)) AS v(w, lo, hi, ord)),
  cursors AS (SELECT campaign_id, w, lo, hi, t1, CASE WHEN hour(c) < lo THEN date_trunc('day', c) + to_hours(lo) ELSE c END AS c0
    FROM (SELECT *, date_trunc('hour', t0) + CASE WHEN t0 > date_trunc('hour', t0) THEN INTERVAL 1 HOUR ELSE INTERVAL 0 HOUR END AS c FROM requests, defs)),
  walked AS (SELECT campaign_id, w, hour(h) AS hh
    FROM (SELECT campaign_id, w, lo, hi, c0, unnest(generate_series(c0, t1, INTERVAL 1 HOUR)) AS h FROM cursors)
    WHERE hour(h) BETWEEN lo AND hi),
  act AS (SELECT campaign_id, w, hh, count(*) AS n FROM walked GROUP BY ALL),
  rated AS (SELECT r.campaign_id, d.w, d.ord, d.lo, d.hi, coalesce(max(n_act), 0) AS n_act,
      round(least(95.0::DOUBLE, greatest(30.0::DOUBLE, 30.0::DOUBLE + (coalesce(max(mean_act), list_avg(any_value(scores)[d.lo + 1 : d.hi + 1])) - 0.5::DOUBLE) / 0.8::DOUBLE * 65.0::DOUBLE)), 9) AS rate
    FROM requests r CROSS JOIN defs d
    LEFT JOIN (SELECT a.campaign_id, a.w, sum(n) AS n_act, sum(n * scores[hh + 1]) / sum(n) AS mean_act
      FROM act a JOIN requests q ON q.campaign_id = a.campaign_id GROUP BY ALL) m ON m.campaign_id = r.campaign_id AND m.w = d.w
    GROUP BY r.campaign_id, d.w, d.ord, d.lo, d.hi),
  peak AS (SELECT campaign_id, w, CAST(arg_min(hh, k) AS INTEGER) AS peak_hour FROM (
      SELECT campaign_id, w, hh, row_number() OVER (PARTITION BY campaign_id, w ORDER BY scores[hh + 1] DESC, hh) AS k
      FROM requests, defs, (SELECT range AS hh FROM range(24)) WHERE hh BETWEEN lo AND hi) GROUP BY 1, 2),
  tops AS (SELECT r.campaign_id, w, rate, peak_hour, row_number() OVER (PARTITION BY r.campaign_id ORDER BY rate DESC, ord) AS rank
    FROM rated r JOIN peak USING (campaign_id, w))"""


def _with_active(sql: str) -> str:
    # the derived tables come first; _ACTIVE continues the same WITH list
    base = with_tables(f"SELECT 1 FROM campaigns, windows")
    return base.replace("\nSELECT 1 FROM campaigns, windows", f",{_ACTIVE}\n{sql}")


FULL: dict[str, str] = {}
FULL["top_windows"] = _with_active(
    "SELECT campaign_id, CAST(rank AS INTEGER) AS rank, w AS window, rate, peak_hour FROM tops WHERE rank <= 2")
_WLABEL = lambda w: case(w, V.WINDOW_LABELS)
FULL["engagement_forecast"] = _with_active(f"""
SELECT campaign_id, nlp_type, CAST(n_act AS INTEGER) AS active_hours, rate AS engagement_rate, round(hrate, 9) AS chosen_hour_rate,
  CASE WHEN rate >= 75 THEN 'Excellent potentiel d''engagement ! ' WHEN rate >= 60 THEN 'Bon potentiel d''engagement. '
    WHEN rate >= 45 THEN 'Potentiel d''engagement modere. ' ELSE 'Potentiel d''engagement faible. ' END
  || 'Taux moyen sur ' || n_act || ' creneaux actifs (' || {_WLABEL('w')} || ') : ' || printf('%.1f', round(rate, 1)) || '%. '
  || CASE WHEN best_hour IS NULL THEN '' ELSE 'Pic optimal ML : ' || best_hour || 'h00 (' || best_window || '). ' END
  || CASE WHEN tw <> w AND trate > rate + 5 THEN 'Conseil : passer a « ' || {_WLABEL('tw')} || ' » pourrait augmenter votre taux a ' || printf('%.1f', round(trate, 1)) || '%.' ELSE '' END
  || CASE WHEN hrate >= 80 THEN ' L''heure de debut est excellente !' WHEN hrate >= 60 THEN ' L''heure de debut est correcte mais pas au pic.'
    WHEN best_hour IS NOT NULL THEN ' Deplacez l''heure de debut vers ' || best_hour || 'h pour plus d''impact.' ELSE '' END AS recommendation
FROM (SELECT q.campaign_id, q.nlp_type, q.best_hour, q.best_window, r.w, r.rate, CAST(r.n_act AS BIGINT) AS n_act, t.w AS tw, t.rate AS trate,
    least(95.0::DOUBLE, greatest(30.0::DOUBLE, 30.0::DOUBLE + (scores[hour(t0) + 1] - 0.5::DOUBLE) / 0.8::DOUBLE * 65.0::DOUBLE)) AS hrate
  FROM requests q JOIN rated r ON r.campaign_id = q.campaign_id AND r.w = q.sending_window
  JOIN tops t ON t.campaign_id = q.campaign_id AND t.rank = 1)""")
SQL["profile_grid"] = f"""
SELECT camp_type, smsc_name, nlp_type, h AS send_hour, round(g, 6) AS global_mean, round(r, 6) AS msisdn_engagement_rate,
  CASE WHEN h BETWEEN 7 AND 11 THEN 'morning' WHEN h BETWEEN 12 AND 16 THEN 'afternoon' WHEN h BETWEEN 17 AND 22 THEN 'evening' ELSE 'night' END AS period,
  round(greatest(0, (h - 7) / 14.0::DOUBLE), 6) AS schedule_position,
  {case('smsc_name', {k: v[0] for k, v in V.OPERATORS.items()})}::DOUBLE AS operateur_failure_rate, {case('smsc_name', {k: v[1] for k, v in V.OPERATORS.items()})} AS smsc_id,
  {_flag("camp_type = 'TRANSACTIONAL'")} AS campaign_type_enc, {case('nlp_type', V.TEXT_MULTIPLIER, '1.0')}::DOUBLE AS nlp_text_mult,
  u AS urgency_score, {_flag("nlp_type IN ('OTP', 'Alerte')")} AS is_sensitive, {_flag("nlp_type = 'Promotion'")} AS is_marketing,
  {_flag("nlp_type IN ('OTP', 'Transaction')")} AS is_transactional,
  CASE WHEN nlp_type <> 'Promotion' AND camp_type = 'TRANSACTIONAL' THEN 'Banque' ELSE 'Marketing' END AS nlp_domaine, round(u * (h / 23.0::DOUBLE), 6) AS urgent_x_hour
FROM (SELECT *, {case('nlp_type', V.URGENCY_OF_TYPE, '0.2')}::DOUBLE AS u FROM
  (SELECT CAST(floor(median(send_hour)) AS INTEGER) AS h, avg(engaged) AS g, avg(r) AS r FROM (SELECT send_hour, engaged, {_loo('msisdn')} AS r FROM sms_log)),
  (SELECT unnest({strings(V.CAMPAIGN_TYPES)}) AS camp_type), (SELECT unnest({strings(V.OPERATORS)}) AS smsc_name), (SELECT unnest({strings(V.SCENARIO_TYPES)}) AS nlp_type))"""
SQL["serving_features"] = f"""
SELECT sms_id, send_hour, send_month, send_day_of_week, CAST(day(send_datetime) AS INTEGER) AS day_of_month,
  {_flag('send_hour BETWEEN 7 AND 11')} AS is_morning, {_flag('send_hour BETWEEN 12 AND 16')} AS is_afternoon, {_flag('send_hour BETWEEN 17 AND 22')} AS is_evening,
  {_flag('day(send_datetime) <= 5')} AS is_salary_period, {_flag("campaign_type = 'TRANSACTIONAL'")} AS campaign_type_enc,
  {case('smsc_name', {'Orange': 0, 'Ooredoo': 1, 'Telecom': 2})} AS smsc_name_enc, {_flag("encoding = 'UCS2'")} AS encoding_enc, coalesce(nullif(nbr_page, 1), 1) AS nbr_pages,
  CASE WHEN sms_id % 2 = 0 THEN operateur_failure_rate ELSE 0.15::DOUBLE END AS operateur_failure_rate,
  {case('nlp_type_reel', V.URGENCY_OF_TYPE, '0.2')}::DOUBLE AS urgency_score, 0.3::DOUBLE AS msisdn_engagement_rate,
  ({_flag("nlp_type_reel IN ('OTP', 'Alerte') AND send_hour BETWEEN 8 AND 12")})::DOUBLE AS sensitive_x_morning,
  ({_flag("nlp_type_reel = 'Promotion' AND send_hour BETWEEN 17 AND 22")})::DOUBLE AS marketing_x_evening,
  ({_flag("nlp_type_reel = 'Transaction' AND send_hour BETWEEN 8 AND 12")})::DOUBLE AS transact_x_morning
FROM sms_log"""

# --- campaigns -------------------------------------------------------------------------------------------------------
_n = lambda states: f"count(*) FILTER (WHERE l.status IN ({', '.join(text(s) for s in states)}))"
_STATS = f"""SELECT campaign_id, any_value(group_id) AS group_id, any_value(status) AS status, any_value(test_completed) AS test_completed,
  count(ls) AS total_recipients, count(*) FILTER (WHERE ls IN ('DELIVERED', 'SENDING')) AS sent_count, count(*) FILTER (WHERE ls = 'DELIVERED') AS delivered_count,
  count(*) FILTER (WHERE ls IN ('FAILED', 'NOT_SENT')) AS failed_count,
  count(*) FILTER (WHERE ls IN ('PENDING_OPERATOR', 'IN_PROGRESS', 'NOT_PROCESSED')) AS pending_count, coalesce(sum(pages), 0)::BIGINT AS total_pages
FROM (SELECT c.*, l.status AS ls, l.pages FROM campaigns c LEFT JOIN sms_logs l ON l.campaign_id = c.campaign_id) GROUP BY 1"""
SQL["campaign_stats"] = f"""
SELECT campaign_id, group_id, status, total_recipients, sent_count, delivered_count, failed_count, pending_count, total_pages,
  round(CASE WHEN total_recipients = 0 THEN 0 ELSE delivered_count * 100.0::DOUBLE / total_recipients END, 6) AS delivery_rate,
  round(CASE WHEN total_recipients = 0 THEN 0 ELSE (sent_count + failed_count) * 100.0::DOUBLE / total_recipients END, 6) AS progress,
  CAST(total_pages * 0.05 AS DOUBLE) AS actual_cost FROM ({_STATS})"""
SQL["campaign_cost"] = """
SELECT campaign_id, 102 AS estimated_recipients, CAST(ceil(length(message) / 160.0) AS INTEGER) AS pages,
  CAST(0.05 * (102 * CAST(ceil(length(message) / 160.0) AS INTEGER)) AS DOUBLE) AS estimated_cost, CAST(floor(102 * 0.045 + 0.5) AS BIGINT) AS sender_estimate FROM campaigns"""
_NOW = f"TIMESTAMP '{X.CAMPAIGN_NOW}'"
SQL["campaign_progress"] = f"""
SELECT campaign_id, CAST(CASE WHEN status = 'COMPLETED' THEN 100 WHEN {_NOW} >= end_date THEN 100 WHEN {_NOW} <= start_date THEN 0
  ELSE floor((epoch_us({_NOW}) - epoch_us(start_date)) * 100.0::DOUBLE / (epoch_us(end_date) - epoch_us(start_date)) + 0.5) END AS INTEGER) AS progress_pct FROM campaigns"""
SQL["status_counts"] = f"SELECT status, count(*) AS n, {case('status', V.CAMPAIGN_STATUS_LABELS, 'status')} AS label FROM campaigns GROUP BY status"
SQL["log_status_counts"] = f"""
SELECT campaign_id, status, count(*) AS n, {case('status', {k: v[0] for k, v in V.SMS_STATUS.items()})} AS status_code,
  {case('status', {k: v[1] for k, v in V.SMS_STATUS.items()})} AS status_label FROM sms_logs GROUP BY campaign_id, status"""
SQL["budget_ledger"] = f"""
SELECT group_id, budget::DOUBLE AS budget, used::DOUBLE AS used, (budget - used)::DOUBLE AS remaining,
  CAST(CASE WHEN budget = 0 THEN 100 ELSE least(100, round(used::DOUBLE * 100 / budget::DOUBLE)) END AS INTEGER) AS percent_used, (budget - used) >= 100 AS affordable
FROM (SELECT b.group_id, b.budget, coalesce(u.used, 0)::DECIMAL(18,4) AS used FROM budgets b
  LEFT JOIN (SELECT group_id, sum(total_pages * 0.05) AS used FROM ({_STATS}) GROUP BY 1) u ON u.group_id = b.group_id)"""
SQL["due_campaigns"] = f"SELECT campaign_id, status FROM campaigns WHERE status = 'PENDING_VALIDATION' AND start_date < {_NOW}"
SQL["campaign_actions"] = f"""
SELECT campaign_id, status IN ('DRAFT', 'PENDING_VALIDATION') AS can_edit, status = 'PENDING_VALIDATION' AND test_completed AS can_validate,
  status = 'RUNNING' AND (total_recipients = 0 OR (sent_count + failed_count) * 100.0 / nullif(total_recipients, 0) < 90) AS can_stop, 'SCHEDULED' AS submit_status,
  CASE WHEN status = 'PENDING_VALIDATION' THEN 'IN_MODIFICATION' ELSE status END AS edit_status FROM ({_STATS})"""
SQL["audience"] = """
SELECT DISTINCT c.campaign_id, k.contact_id FROM campaigns c JOIN contacts k ON k.user_id = c.user_id
  AND (list_contains(c.contact_ids, k.contact_id) OR list_has_any(c.contact_tags, k.tags))"""
SQL["audience_sizes"] = f"SELECT campaign_id, count(a.contact_id) AS audience_size FROM campaigns c LEFT JOIN ({SQL['audience']}) a USING (campaign_id) GROUP BY 1"
SQL["org_roles"] = """
SELECT organization_id, s_suppkey AS user_id, list_extract(['ADMIN', 'AGENT', 'SUPERVISOR'], CAST(s_suppkey % 3 AS INTEGER) + 1) AS role, coalesce(n_name, 'Unknown') AS name
FROM (SELECT *, s_nationkey + CASE WHEN s_suppkey % 9 = 0 THEN 100 ELSE 0 END AS organization_id FROM supplier) LEFT JOIN nation ON n_nationkey = organization_id"""
SQL["page_query"] = "SELECT campaign_id, status, user_id FROM campaigns ORDER BY campaign_id DESC LIMIT 25 OFFSET 50"
SQL["page_totals"] = "SELECT count(*) AS total_rows, CAST(ceil(count(*) / 25.0) AS BIGINT) AS total_pages FROM campaigns"
SQL["parsed_dates"] = f"""
SELECT campaign_id, strftime(CASE campaign_id % 5 WHEN 0 THEN planned_start WHEN 1 THEN planned_start WHEN 2 THEN date_trunc('day', planned_start)::TIMESTAMP
  ELSE {_NOW} + INTERVAL 1 HOUR END, '%Y-%m-%d %H:%M:%S') AS parsed FROM campaigns"""

SQL["campaign_labels"] = f"""
SELECT campaign_id, {case('status', V.CAMPAIGN_STATUS_LABELS, 'status')} AS status_label, {case('sending_window', V.SENDING_WINDOW_LABELS, 'sending_window')} AS window_label FROM campaigns"""
SQL["user_filter"] = """
SELECT c_custkey AS user_id, split_part(c_name, '#', 2) AS last_name FROM customer
WHERE contains(split_part(c_name, '#', 2), '7') AND c_acctbal > 0 AND (c_custkey % 4 = 1 OR (c_custkey % 2 = 1 AND (c_custkey + 2) % 4 = 1))"""
SQL["template_filter"] = """
SELECT campaign_id, campaign_type AS type FROM campaigns
WHERE (contains('modele ' || campaign_id, 'code') OR contains(lower(message), 'code')) AND test_completed AND contains(lower(campaign_type), 'classic')"""
SQL["templates_of_type"] = """
SELECT 'TRANSACTIONAL' AS asked, campaign_type AS type, count(*) AS n FROM campaigns WHERE test_completed AND campaign_type = 'TRANSACTIONAL' GROUP BY 2
UNION ALL SELECT 'OTHER', campaign_type, count(*) FROM campaigns WHERE test_completed GROUP BY 2"""
SQL["prediction_rates"] = """
SELECT sms_id, round(CASE WHEN p IS NULL THEN 65.0 WHEN p <= 2.0 THEN least(95.0::DOUBLE, p * 75.0::DOUBLE + 20.0::DOUBLE) ELSE p END, 6) AS rate,
  round(least(95.0::DOUBLE, greatest(30.0::DOUBLE, 30.0::DOUBLE + (score * 1.5::DOUBLE - 0.5::DOUBLE) / 0.8::DOUBLE * 65.0::DOUBLE)), 6) AS window_rate
FROM (SELECT sms_id, score, CASE WHEN sms_id % 17 <> 0 THEN score * 2.6::DOUBLE END AS p FROM sms_log)"""
SQL["engagement_fallback"] = """
SELECT sms_id, CASE WHEN sms_id % 4 <> 0 THEN round(score, 6) ELSE 0.285 END AS engagement_rate,
  CASE WHEN sms_id % 4 <> 0 THEN 'model' ELSE 'fallback' END AS source, CASE WHEN sms_id % 4 <> 0 THEN '' ELSE '09h-12h' END AS best_window FROM sms_log"""

# --- contacts and routes -----------------------------------------------------------------------------------------------
_PHONES = r"""SELECT *, CASE WHEN regexp_full_match(compact, '\+[1-9][0-9]{7,14}') THEN compact END AS e164
FROM (SELECT *, regexp_replace(trim(phone), '[ \t\n().\-/]', '', 'g') AS compact FROM contact_rows)"""
_COUNTRY = "CASE " + " ".join(
    f"WHEN starts_with(e164, '+{c}') THEN '{CALLING_CODES[c]}'" for c in sorted(CALLING_CODES, key=len, reverse=True)) + " ELSE 'UNKNOWN' END"
SQL["phone_e164"] = f"SELECT row_number, coalesce(e164, '') AS e164, {_COUNTRY} AS country FROM ({_PHONES})"
_IMPORT = f"""SELECT p.row_number, p.user_id, coalesce(e164, '') AS phone,
  CASE WHEN e164 IS NULL THEN 'error' WHEN k.phone IS NOT NULL OR row_number() OVER (PARTITION BY p.user_id, e164 ORDER BY p.row_number) > 1 THEN 'duplicate' ELSE 'accepted' END AS outcome
FROM ({_PHONES}) p LEFT JOIN (SELECT DISTINCT user_id, phone FROM contacts) k ON k.user_id = p.user_id AND k.phone = p.e164"""
SQL["contact_import"] = f"SELECT * FROM ({_IMPORT})"
SQL["import_summary"] = f"""
SELECT user_id, count(*) AS total_rows, count(*) FILTER (WHERE outcome = 'accepted') AS success_count,
  count(*) FILTER (WHERE outcome = 'duplicate') AS duplicate_count, count(*) FILTER (WHERE outcome = 'error') AS error_count FROM ({_IMPORT}) GROUP BY 1"""
_CODES = ", ".join(f"('{c}', '{n}')" for c, n in CALLING_CODES.items())
SQL["phone_countries"] = f"""
SELECT country, count(*) AS n FROM (
  SELECT c_custkey, max_by(name, length(code)) AS country FROM customer
  LEFT JOIN (VALUES {_CODES}) AS t(code, name) ON starts_with(CAST(1 + (c_custkey * 7919) % 9999 AS VARCHAR) || '5550' || c_custkey, code) GROUP BY 1)
GROUP BY 1"""
SQL["contact_file"] = """
SELECT row_number() OVER (ORDER BY o_orderkey) + 1 AS row_number, CAST(o_custkey AS VARCHAR) AS phone,
  CASE WHEN o_orderkey % 3 = 0 THEN 'a "quoted" name' ELSE 'plain' END AS first_name,
  CASE WHEN o_orderkey % 5 = 0 THEN 'two' || chr(10) || chr(10) || 'lines, ' || o_orderkey ELSE 'one' END AS last_name FROM orders"""
SQL["contact_search"] = "SELECT contact_id, phone, last_name FROM contacts WHERE user_id = 3 AND (contains(phone, '03') OR contains(first_name, '03') OR contains(last_name, '03'))"
SQL["contact_tags"] = """
SELECT contact_id, array_to_string(list_sort(CASE WHEN list_has_any(tags, ['BUILDING', 'NATION_3'])
  THEN list_filter(list_distinct(tags || ['vip', 'BUILDING']), lambda t: t <> 'NATION_3') ELSE tags END), ',') AS tags FROM contacts"""
SQL["contact_selection"] = """
SELECT user_id, CASE WHEN user_id = 0 AND contact_id < 40 THEN 'chosen' ELSE 'kept' END AS part, count(*) AS n FROM contacts GROUP BY 1, 2"""
SQL["route_match"] = """
SELECT m.message_id, coalesce(arg_min(r.route_id, r.priority), (SELECT route_id FROM routes WHERE is_default)) AS route_id
FROM routed_messages m LEFT JOIN routes r ON r.active AND r.group_id IN ('ALL', m.group_id) AND r.alpha_header IN ('*', m.alpha_header)
  AND (r.destination_pattern IS NULL OR regexp_full_match(m.destination, r.destination_pattern)) GROUP BY m.message_id"""
SQL["connector_downtime"] = """
SELECT probe_id, CASE WHEN up THEN -1 ELSE (sum(1) OVER (PARTITION BY connector_id, run, up ORDER BY probed_at, probe_id) - 1) * 5 END::BIGINT AS unavailable_minutes
FROM (SELECT *, sum(CASE WHEN up THEN 1 ELSE 0 END) OVER (PARTITION BY connector_id ORDER BY probed_at, probe_id) AS run
  FROM (SELECT event_id AS probe_id, user_id % 40 AS connector_id, ts AS probed_at, event_type IN ('click', 'signup') AS up FROM events))"""

# --- recommender ----------------------------------------------------------------------------------------------------------
SQL["clean_corpus"] = "SELECT doc_id, lang, length(text)::INTEGER AS n_chars, len(tokens)::INTEGER AS n_tokens FROM docs"
SQL["language_bucket"] = "SELECT lang, count(*) AS n FROM docs GROUP BY 1"
SQL["lexicon"] = "SELECT lang, word, freq FROM lexicon"
SQL["named_entities"] = "SELECT lang, word, total, capitalised FROM names"
SQL["unigrams"] = "SELECT lang, w1, n FROM unigrams"
SQL["bigrams"] = "SELECT lang, w1, w2, n FROM bigrams"
SQL["trigrams"] = "SELECT lang, w1, w2, w3, n FROM trigrams"
SQL["continuation"] = "SELECT lang, word, n FROM continuation"
SQL["continuation_distinct"] = "SELECT lang, w2 AS word, count(DISTINCT w1) AS n FROM bigrams GROUP BY 1, 2"
SQL["recommender_model"] = " UNION ALL ".join(
    f"SELECT '{name}' AS name, lang, count(*) AS rows, CAST(sum({n}) AS BIGINT) AS total FROM {name} GROUP BY lang"
    for name, n in (("lexicon", "freq"), ("unigrams", "n"), ("bigrams", "n"), ("trigrams", "n"), ("continuation", "n")))
SQL["typing_context"] = "SELECT request_id, mode, lang, current_word, coalesce(prev1, '') AS prev1, coalesce(prev2, '') AS prev2 FROM typed"
SQL["prefix_completion"] = "SELECT lang, prefix, word, freq, rank::INTEGER AS rank FROM exact_hits"
SQL["fuzzy_completion"] = """
SELECT lang, prefix, word, freq, 0 AS dist, rank::INTEGER AS rank FROM exact_hits
UNION ALL SELECT lang, prefix, word, freq, dist::INTEGER, rank::INTEGER FROM fuzzy_hits"""
SQL["next_word"] = "SELECT lang, coalesce(prev2, '') AS prev2, coalesce(prev1, '') AS prev1, level, word, round(prob, 6) AS prob FROM predictions"
_RANKED = """
SELECT mode, lang, current_word, coalesce(prev2, '') AS prev2, coalesce(prev1, '') AS prev1, word, score,
  row_number() OVER (PARTITION BY mode, lang, current_word, prev2, prev1 ORDER BY score DESC, word) AS rank
FROM (SELECT x.mode, x.lang, x.current_word, x.prev2, x.prev1, x.word, round(coalesce(max(a), 0) + coalesce(max(b), 0) + coalesce(0.3::DOUBLE * max(f.boost), 0), 9) AS score FROM (
    SELECT c.mode, c.lang, c.current_word, c.prev2, c.prev1, h.word, 0.4::DOUBLE * (freq / max(freq) OVER (PARTITION BY c.mode, c.lang, c.current_word, c.prev2, c.prev1)) AS a, NULL::DOUBLE AS b
    FROM contexts c JOIN (SELECT lang, prefix, word, freq FROM exact_hits UNION ALL SELECT lang, prefix, word, freq FROM fuzzy_hits) h ON h.lang = c.lang AND h.prefix = c.current_word
    WHERE c.mode = 'autocomplete' AND c.current_word <> ''
    UNION ALL
    SELECT c.mode, c.lang, c.current_word, c.prev2, c.prev1, p.word, NULL, 0.6::DOUBLE * p.prob
    FROM contexts c JOIN predictions p ON p.lang = c.lang AND p.prev2 IS NOT DISTINCT FROM c.prev2 AND p.prev1 IS NOT DISTINCT FROM c.prev1
    WHERE c.mode = 'next_word' OR c.current_word = '' OR (c.prev1 IS NOT NULL AND starts_with(p.word, c.current_word))) x
  LEFT JOIN feedback_boosts f ON f.word = x.word GROUP BY ALL)
WHERE score >= 0.001 QUALIFY rank <= 5"""
SQL["rank_suggestions"] = f"SELECT * EXCLUDE (score, rank), rank::INTEGER AS rank, round(score, 4) AS score FROM ({_RANKED})"
SQL["recommend"] = f"""
SELECT t.request_id, t.mode, t.lang, coalesce(rank, 0)::INTEGER AS rank, coalesce(r.word, '') AS word, coalesce(round(r.score, 4), 0) AS score
FROM typed t LEFT JOIN ({_RANKED}) r ON r.mode = t.mode AND r.lang = t.lang AND r.current_word = t.current_word
  AND r.prev2 = coalesce(t.prev2, '') AND r.prev1 = coalesce(t.prev1, '')"""
SQL["feedback_decay"] = "SELECT word, round(boost, 6) AS boost, n_events FROM feedback_boosts"
SQL["recent_feedback"] = "SELECT selected_word, count(*) AS n FROM word_feedback WHERE created_at > TIMESTAMP '2024-01-03' GROUP BY 1"
SQL["top_recent_words"] = "SELECT word, round(boost, 6) AS score FROM feedback_boosts ORDER BY round(boost, 6) DESC, word LIMIT 10"
SQL["apply_feedback"] = f"""
SELECT lang, word, sum(freq)::BIGINT AS freq FROM (SELECT lang, word, freq FROM lexicon
  UNION ALL SELECT CASE WHEN l IN (SELECT lang FROM lexicon) THEN l ELSE 'fr' END, selected_word, 2
  FROM (SELECT {language('partial_text')} AS l, selected_word FROM word_feedback)) GROUP BY 1, 2"""
SQL["recommender_eval"] = f"""
SELECT count(*) AS total, round(avg(coalesce(1.0::DOUBLE / rank, 0)), 6) AS mrr, round(count(rank) / count(*), 6) AS precision_at_k,
  CASE WHEN avg(coalesce(1.0::DOUBLE / rank, 0)) > 0.5 THEN 'excellent' WHEN avg(coalesce(1.0::DOUBLE / rank, 0)) > 0.3 THEN 'bon' ELSE 'faible' END AS verdict
FROM (
  SELECT t.*, coalesce(r3.rank, r2.rank, r1.rank) AS rank FROM (
    SELECT lang, CASE WHEN i > 1 THEN toks[i - 1] END AS p2, toks[i] AS p1, toks[i + 1] AS truth
    FROM (SELECT lang, toks, unnest(range(1, len(toks))) AS i FROM (SELECT {language('text')} AS lang, {tokens('text')} AS toks FROM conversations))) t
  LEFT JOIN (SELECT DISTINCT lang, w1, w2 FROM trigrams) h3 ON h3.lang = t.lang AND h3.w1 = t.p2 AND h3.w2 = t.p1
  LEFT JOIN (SELECT DISTINCT lang, w1 FROM bi_ranked) h2 ON h2.lang = t.lang AND h2.w1 = t.p1
  LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY lang, w1, w2 ORDER BY round(0.6::DOUBLE * prob, 9) DESC, word) AS top3 FROM tri_ranked WHERE round(0.6::DOUBLE * prob, 9) >= 0.001 QUALIFY top3 <= 5) r3
    ON h3.lang IS NOT NULL AND r3.lang = t.lang AND r3.w1 = t.p2 AND r3.w2 = t.p1 AND r3.word = t.truth
  LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY lang, w1 ORDER BY round(0.6::DOUBLE * prob, 9) DESC, word) AS top2 FROM bi_ranked WHERE round(0.6::DOUBLE * prob, 9) >= 0.001 QUALIFY top2 <= 5) r2
    ON h3.lang IS NULL AND r2.lang = t.lang AND r2.w1 = t.p1 AND r2.word = t.truth
  LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY round(0.6::DOUBLE * prob, 9) DESC, word) AS top1 FROM uni_ranked WHERE round(0.6::DOUBLE * prob, 9) >= 0.001 QUALIFY top1 <= 5) r1
    ON h3.lang IS NULL AND h2.lang IS NULL AND r1.lang = t.lang AND r1.word = t.truth)"""

# --- bandit -------------------------------------------------------------------------------------------------------------------
# a parameter after n steps is the largest of "floor of 1 applied last at step i, then decayed hits"
_REPLAY = lambda key: f"""
  SELECT context_key, hour, max(pow(0.98::DOUBLE, r) + ta) AS alpha, max(pow(0.98::DOUBLE, r) + tb) AS beta, count(*) AS n_updates FROM (
    SELECT context_key, hour, r, sum(pow(0.98::DOUBLE, r) * e) OVER w AS ta, sum(pow(0.98::DOUBLE, r) * (1 - e)) OVER w AS tb FROM (
      SELECT {key} AS context_key, recommended_hour AS hour, CAST(engaged AS INTEGER) AS e,
        row_number() OVER (PARTITION BY {key}, recommended_hour ORDER BY decided_at DESC, sms_id DESC) - 1 AS r
      FROM decisions WHERE engaged IS NOT NULL)
    WINDOW w AS (PARTITION BY context_key, hour ORDER BY r)) GROUP BY 1, 2"""
SQL["bandit_replay"] = f"SELECT context_key, hour, round(alpha, 6) AS alpha, round(beta, 6) AS beta, n_updates FROM ({_REPLAY('context_key')})"
SQL["bandit_size"] = "SELECT count(DISTINCT context_key) AS n_contexts, count(*) AS n_updates FROM decisions WHERE engaged IS NOT NULL"


def _drift(key: str) -> str:
    return f"""SELECT {key} AS context_key, count(*) AS n,
  avg(CAST(engaged AS INTEGER)) FILTER (WHERE decided_at > TIMESTAMP '{X.NOW}' - INTERVAL 7 DAYS) AS recent_rate,
  avg(CAST(engaged AS INTEGER)) FILTER (WHERE decided_at <= TIMESTAMP '{X.NOW}' - INTERVAL 7 DAYS) AS older_rate
FROM decisions WHERE engaged IS NOT NULL AND decided_at >= TIMESTAMP '{X.NOW}' - INTERVAL 30 DAYS GROUP BY 1"""


_HIT = "coalesce(n >= 100 AND recent_rate < older_rate * 0.80::DOUBLE, FALSE)"
SQL["bandit_drift"] = f"""
SELECT context_key, n, round(coalesce(recent_rate, -1), 6) AS recent_rate, round(coalesce(older_rate, -1), 6) AS older_rate, {_HIT} AS drift
FROM ({_drift("campaign_type || '_' || operateur")})"""
_K3 = "campaign_type || '_' || operateur || '_' || nlp_type"
SQL["bandit_reset"] = f"""
SELECT s.context_key, hour, CASE WHEN drift THEN 1.0 ELSE round(alpha, 6) END AS alpha, CASE WHEN drift THEN 1.0 ELSE round(beta, 6) END AS beta, n_updates
FROM ({_REPLAY(_K3)}) s LEFT JOIN (SELECT context_key, {_HIT} AS drift FROM ({_drift(_K3)})) d ON d.context_key = s.context_key"""
SQL["bandit_choice"] = f"""
SELECT context_key, nlp_type, CAST(hour AS INTEGER) AS hour, round(ml_score, 6) AS ml_score, round(mixed, 6) AS mixed_score, 'ts_ml_hybrid' AS method FROM (
  SELECT g.context_key, g.nlp_type, g.hour, coalesce(c.hybrid, 0.3) AS ml_score,
    round(0.5::DOUBLE * (coalesce(alpha, 1) / (coalesce(alpha, 1) + coalesce(beta, 1))) + 0.5::DOUBLE * coalesce(c.hybrid, 0.3::DOUBLE), 9) AS mixed
  FROM (SELECT *, unnest(range(7, 24)) AS hour FROM (SELECT DISTINCT context_key, nlp_type FROM decisions)) g
  LEFT JOIN ({_REPLAY('context_key')}) s ON s.context_key = g.context_key AND s.hour = g.hour
  LEFT JOIN curve c ON c.nlp_type = g.nlp_type AND c.send_hour = g.hour)
QUALIFY row_number() OVER (PARTITION BY context_key, nlp_type ORDER BY mixed DESC, hour) = 1"""
SQL["decision_feedback"] = """
SELECT f.feedback_id, f.sms_id, CASE WHEN d.sms_id IS NULL THEN 'not_found' ELSE 'updated' END AS status, coalesce(d.context_key, '') AS context_key
FROM feedback_events f LEFT JOIN decisions d ON d.sms_id = f.sms_id"""
SQL["latest_feedback"] = "SELECT sms_id, feedback_id, engaged FROM feedback_events QUALIFY row_number() OVER (PARTITION BY sms_id ORDER BY received_at DESC, feedback_id DESC) = 1"
SQL["first_clicks"] = "SELECT sms_id, feedback_id FROM feedback_events WHERE engaged QUALIFY row_number() OVER (PARTITION BY sms_id ORDER BY received_at, feedback_id) = 1"
SQL["decision_log"] = """
SELECT sms_id, strftime(decided_at + INTERVAL 90 DAYS, '%Y-%m-%d %H:%M:%S') AS expires_at FROM decisions
WHERE decided_at + INTERVAL 90 DAYS > TIMESTAMP '2024-04-10 00:00:00'"""
SQL["pending_decisions"] = "SELECT context_key, count(*) AS n FROM decisions WHERE engaged IS NULL AND decided_at >= TIMESTAMP '2024-01-20' GROUP BY 1"

# --- quality of scores ---------------------------------------------------------------------------------------------------------
SQL["threshold_metrics"] = """
SELECT threshold, tp, fp, fn, tn, round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision,
  round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1
FROM (SELECT threshold, count(*) FILTER (WHERE engaged = 1 AND score >= threshold) AS tp, count(*) FILTER (WHERE engaged = 0 AND score >= threshold) AS fp,
  count(*) FILTER (WHERE engaged = 1 AND score < threshold) AS fn, count(*) FILTER (WHERE engaged = 0 AND score < threshold) AS tn
  FROM sms_log, (SELECT unnest([0.3, 0.5, 0.6, 0.75])::DOUBLE AS threshold) GROUP BY 1)"""


def _curve(group: str = "") -> str:
    part = f"PARTITION BY {group}" if group else ""
    lead = f"{group}, " if group else ""
    return f"""SELECT *, tp / n AS precision, coalesce(tp / nullif(positives, 0), 0) AS recall,
  coalesce(2 * (tp / n) * coalesce(tp / nullif(positives, 0), 0) / nullif(tp / n + coalesce(tp / nullif(positives, 0), 0), 0), 0) AS f1
FROM (SELECT {lead}threshold, pos, rws, sum(pos) OVER ({part} ORDER BY threshold DESC)::BIGINT AS tp, sum(rws) OVER ({part} ORDER BY threshold DESC)::BIGINT AS n,
  sum(pos) OVER ({part})::BIGINT AS positives, sum(rws) OVER ({part})::BIGINT AS total
  FROM (SELECT {lead}score AS threshold, sum(engaged) AS pos, count(*) AS rws FROM sms_log GROUP BY ALL))"""


SQL["pr_curve"] = f"SELECT round(threshold, 9) AS threshold, tp, n, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1 FROM ({_curve()})"
SQL["curve_areas"] = f"""
SELECT round(sum(pos::DOUBLE * ((total - positives) - (n - tp) + (rws - pos) / 2.0::DOUBLE)) / (max(positives)::DOUBLE * (max(total) - max(positives))), 6) AS auc_roc,
  round(sum(pos * precision) / max(positives), 6) AS pr_auc, max(total) AS n_rows, max(positives) AS n_positive FROM ({_curve()})"""
_F1 = f"(SELECT threshold FROM ({_curve()}) ORDER BY round(f1, 12) DESC, threshold LIMIT 1)"
SQL["best_thresholds"] = f"""
SELECT round({_F1}, 6) AS f1_best, round(coalesce(min(threshold) FILTER (WHERE precision >= 0.41::DOUBLE), {_F1}), 6) AS precision_41,
  round(coalesce(min(threshold) FILTER (WHERE precision >= 0.7::DOUBLE), {_F1}), 6) AS precision_70 FROM ({_curve()})"""
SQL["adaptive_thresholds"] = f"""
SELECT nlp_type_reel, max(total) AS n_rows, round(coalesce(min(threshold) FILTER (WHERE precision >= 0.42::DOUBLE), {_F1}), 6) AS threshold,
  count(*) FILTER (WHERE precision >= 0.42::DOUBLE) > 0 AS reached FROM ({_curve('nlp_type_reel')}) WHERE total > 50 GROUP BY 1"""
SQL["balanced_training_rows"] = """
SELECT engaged, false AS synthetic, count(*) AS n FROM sms_log GROUP BY 1
UNION ALL SELECT if(2 * p <= total, 1, 0), true, abs(total - 2 * p) FROM (
  SELECT CAST(sum(engaged) AS BIGINT) AS p, count(*) AS total FROM sms_log) WHERE 2 * p <> total"""
SQL["stratified_folds"] = """
SELECT sms_id, engaged, CAST((row_number() OVER (PARTITION BY engaged ORDER BY md5(CAST(sms_id AS VARCHAR) || ':42'), sms_id) - 1) % 5 AS INTEGER) AS fold FROM sms_log"""

_PARTS = """(SELECT *, CASE (row_number() OVER (PARTITION BY engaged ORDER BY md5(CAST(sms_id AS VARCHAR) || ':42'), sms_id) - 1) % 5
  WHEN 0 THEN 'test' WHEN 1 THEN 'validation' ELSE 'train' END AS part,
  count(*) OVER (PARTITION BY msisdn ORDER BY send_datetime
    RANGE BETWEEN INTERVAL 24 HOURS PRECEDING AND INTERVAL 1 MICROSECOND PRECEDING) AS earlier FROM sms_log)"""
SQL["training_split"] = f"""
SELECT part, engaged, count(*) AS n, CAST(sum(earlier) AS BIGINT) AS earlier FROM {_PARTS} GROUP BY 1, 2"""
SQL["class_weights"] = f"""
SELECT count(*) FILTER (engaged = 0) AS negatives, count(*) FILTER (engaged = 1) AS positives,
  round(count(*) FILTER (engaged = 0) / greatest(count(*) FILTER (engaged = 1), 1) * 1.2, 6) AS weight FROM {_PARTS} WHERE part = 'train'"""

# --- streams: the same answers as the batch versions ----------------------------------------------------------------------------
SQL["stream_feedback"] = SQL["decision_feedback"]
SQL["stream_clicks"] = "SELECT DISTINCT event_id - event_id % 3 AS sms_id FROM events WHERE event_type IN ('click', 'purchase')"
SQL["stream_bandit"] = SQL["bandit_replay"]
SQL["stream_drift"] = f"""
SELECT context_key, n, round(coalesce(recent_rate, -1), 6) AS recent_rate, round(coalesce(older_rate, -1), 6) AS older_rate, {_HIT} AS drift FROM (
  SELECT campaign_type || '_' || operateur AS context_key, count(*) AS n,
    avg(CAST(engaged AS INTEGER)) FILTER (WHERE decided_at >= TIMESTAMP '{X.NOW}' - INTERVAL 7 DAYS) AS recent_rate,
    avg(CAST(engaged AS INTEGER)) FILTER (WHERE decided_at < TIMESTAMP '{X.NOW}' - INTERVAL 7 DAYS) AS older_rate
  FROM decisions WHERE engaged IS NOT NULL AND decided_at >= TIMESTAMP '{X.NOW}' - INTERVAL 30 DAYS AND decided_at < TIMESTAMP '{X.NOW}' GROUP BY 1)"""
SQL["stream_volume"] = "SELECT msisdn, strftime(send_datetime, '%Y-%m-%d') AS day, count(*) AS n FROM sms_log GROUP BY 1, 2"
SQL["stream_selections"] = SQL["apply_feedback"]

SQL["stream_bandit_state"] = SQL["bandit_replay"]
SQL["stream_expiry"] = """
SELECT sms_id, context_key, n_feedback, CASE WHEN n_feedback > 0 THEN 'answered' ELSE 'expired' END AS status FROM (
  SELECT d.sms_id, d.context_key, count(f.sms_id) AS n_feedback FROM decisions d LEFT JOIN feedback_events f
    ON f.sms_id = d.sms_id AND f.received_at BETWEEN d.decided_at AND d.decided_at + INTERVAL 10 DAYS
  WHERE d.decided_at + INTERVAL 10 DAYS < (SELECT max(received_at) - INTERVAL 6 HOURS FROM feedback_events) GROUP BY 1, 2)"""
SQL["stream_feedback_join"] = """
SELECT feedback_id, CASE WHEN d.sms_id IS NULL THEN 'not_found' ELSE 'updated' END AS status, coalesce(context_key, '') AS context_key
FROM feedback_events f LEFT JOIN decisions d ON f.sms_id = d.sms_id AND f.received_at BETWEEN d.decided_at AND d.decided_at + INTERVAL 3 DAYS
WHERE d.sms_id IS NOT NULL OR f.received_at < (SELECT max(decided_at) - INTERVAL 2 DAYS FROM decisions)"""
SQL["stream_sliding_volume"] = """
SELECT msisdn, strftime(until, '%Y-%m-%d %H') AS until, CAST(sum(n) AS BIGINT) AS n FROM (
  SELECT msisdn, h + to_hours(k) AS until, n FROM (
    SELECT msisdn, date_trunc('hour', send_datetime) AS h, count(*) AS n FROM sms_log GROUP BY 1, 2), range(1, 25) AS g(k))
WHERE until <= (SELECT max(send_datetime) - INTERVAL 1 HOUR FROM sms_log) GROUP BY 1, 2"""

SQL["training_facts_file"] = """
SELECT campaign_type, encoding, count(*) AS n, CAST(sum(engaged) AS BIGINT) AS engaged, CAST(sum(send_hour) AS BIGINT) AS hours, count(groupe_id) AS grouped,
  CAST(sum(length(message)) AS BIGINT) AS chars, strftime(max(send_datetime), '%Y-%m-%d %H:%M') AS newest FROM sms_log GROUP BY 1, 2"""
SQL["corpus_file"] = r"""
SELECT is_spam, noise_level, count(*) AS n, CAST(sum(length(regexp_replace(text, '[ \t\n\v\f\r]', '', 'g'))) AS BIGINT) AS chars FROM corpus GROUP BY 1, 2"""
SQL["collection_files"] = """
SELECT 'sms_logs' AS name, status AS part, count(*) AS n FROM sms_logs GROUP BY 2
UNION ALL SELECT 'decisions', operateur, count(*) FROM decisions GROUP BY 2"""


def all_sql() -> dict[str, str]:
    return {name: with_tables(sql) for name, sql in SQL.items()} | FULL
