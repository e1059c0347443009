"""The derived tables of ``plans/fixtures.py`` as SQL common table expressions."""

from __future__ import annotations

from smsight.functions import vocab as V
from smsight.plans import fixtures as X


def text(value: str) -> str:
    """SQL string literal."""
    return "'" + value.replace("'", "''") + "'"


def strings(values) -> str:
    return "[" + ", ".join(text(v) for v in values) + "]"


def case(key: str, table: dict, default: str = "NULL") -> str:
    show = lambda v: text(v) if isinstance(v, str) else str(v)
    whens = " ".join(f"WHEN {show(k)} THEN {show(v)}" for k, v in table.items())
    return f"(CASE {key} {whens} ELSE {default} END)"


def pick(values, index: str) -> str:
    return f"list_extract({strings(values)}, CAST(({index}) % {len(values)} AS INTEGER) + 1)"


def filled_template(number: str, value: str) -> str:
    return (f"replace(replace({pick(X.TEMPLATES, number)}, '{{id}}', CAST({number} AS VARCHAR)), "
            f"'{{v}}', CAST({value} AS VARCHAR))")


ARABIC = "[؀-ۿ]"
PAGES = (f"CASE WHEN {{0}} = '' THEN 0 ELSE CAST(ceil(length({{0}}) / (CASE WHEN regexp_matches({{0}}, '{ARABIC}') "
         "THEN 70.0 ELSE 160.0 END)) AS INTEGER) END")
OPERATOR_IDS = {k: v[1] for k, v in V.OPERATORS.items()}
OPERATOR_RATES = {k: v[0] for k, v in V.OPERATORS.items()}

TABLES: dict[str, str] = {}

TABLES["event_rows"] = f"""
SELECT event_id, ts, user_id, event_type, value,
  CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
  {pick(list(V.OPERATORS), 'event_id')} AS smsc_name,
  {filled_template('event_id', 'value')} AS message
FROM events"""

TABLES["sms_log"] = f"""
SELECT event_id AS sms_id, ts AS send_datetime,
  CAST(hour(ts) AS INTEGER) AS send_hour, CAST(month(ts) AS INTEGER) AS send_month,
  CAST(isodow(ts) - 1 AS INTEGER) AS send_day_of_week,
  '+216' || CAST(20000000 + user_id AS VARCHAR) AS msisdn, smsc_name,
  {case('smsc_name', OPERATOR_IDS)} AS smsc_id, CAST({case('smsc_name', OPERATOR_RATES)} AS DOUBLE) AS operateur_failure_rate,
  {pick(V.CAMPAIGN_TYPES, 'event_id')} AS campaign_type, message, CAST(length(message) AS INTEGER) AS message_lenth,
  {PAGES.format('message')} AS nbr_page,
  CASE WHEN regexp_matches(message, '{ARABIC}') THEN 'UCS2' ELSE 'UTF-8' END AS encoding,
  CAST(6 + event_id % 5 AS INTEGER) AS schedule_h_start,
  CAST(6 + event_id % 5 + event_id % 14 AS INTEGER) AS schedule_h_end,
  CAST(nullif(event_id % 5, 0) AS INTEGER) AS groupe_id,
  {pick(V.MESSAGE_TYPES, 'k')} AS nlp_type_reel,
  CAST(1.0 AS DOUBLE) + CAST(k % 5 AS DOUBLE) * CAST(0.05 AS DOUBLE) AS nlp_text_mult,
  CASE WHEN event_type IN ('click', 'purchase') THEN 1 ELSE 0 END AS engaged,
  value / (value + 20.0) AS score, k
FROM event_rows"""

TABLES["messages"] = """
SELECT 'e' || CAST(event_id AS VARCHAR) AS message_id, message FROM event_rows
UNION ALL SELECT 'd' || CAST(doc_id AS VARCHAR), text FROM documents"""

TABLES["corpus"] = """
SELECT d.doc_id, d.text, coalesce(toxic = 1, FALSE) AS is_spam,
  CASE WHEN quality = 0 THEN 'heavy' ELSE 'light' END AS noise_level
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"""

TABLES["typing_requests"] = r"""
SELECT CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR) AS request_id,
  CASE turn % 3 WHEN 0 THEN bare || ' ' WHEN 1 THEN bare
    ELSE substring(bare, 1, greatest(length(bare) - 2, 1)) END AS partial_text
FROM (SELECT *, regexp_replace(text, '[ \t\n\r\f\v.]+$', '') AS bare FROM conversations)"""

TABLES["decisions"] = """
SELECT sms_id, nlp_type_reel AS nlp_type, smsc_name AS operateur, campaign_type,
  send_day_of_week AS day_of_week,
  campaign_type || '_' || smsc_name || '_' || nlp_type_reel || '_' || CAST(send_day_of_week AS VARCHAR) AS context_key,
  CAST(greatest(7, send_hour) AS INTEGER) AS recommended_hour, score AS ml_score, send_datetime AS decided_at,
  CASE WHEN k % 10 <> 0 THEN engaged = 1 END AS engaged
FROM sms_log"""

TABLES["feedback_events"] = """
SELECT event_id AS feedback_id,
  CASE WHEN event_id % 7 = 0 THEN -event_id - 1 ELSE event_id - event_id % 3 END AS sms_id,
  event_type IN ('click', 'purchase') AS engaged, ts + INTERVAL 1 HOUR AS received_at
FROM events"""

TABLES["campaigns"] = f"""
SELECT o_orderkey AS campaign_id, o_custkey // 100 AS user_id, o_custkey % 50 AS group_id,
  {case('o_orderstatus', X.CAMPAIGN_STATES, "'DRAFT'")} AS status, o_orderdate AS start_date,
  o_orderdate + to_days(CAST(o_orderkey % 40 AS INTEGER)) + to_hours(o_orderkey % 23) AS end_date,
  o_orderdate + to_hours(o_orderkey % 24) + to_minutes(o_orderkey % 4 * 15) AS planned_start,
  {pick(X.SENDING_WINDOWS, 'o_orderkey')} AS sending_window,
  {pick(V.CAMPAIGN_TYPES, 'o_custkey')} AS campaign_type, {pick(list(V.OPERATORS), 'o_custkey')} AS operateur,
  {filled_template('o_orderkey', 'o_totalprice')} AS message, o_orderkey % 3 <> 0 AS test_completed,
  [o_custkey, o_custkey - o_custkey % 100 + (o_custkey + o_orderkey) % 100] AS contact_ids,
  [o_orderpriority, {pick(X.SEGMENTS, 'o_orderkey')}] AS contact_tags
FROM orders"""

TABLES["sms_logs"] = f"""
SELECT l_orderkey AS campaign_id, {case('l_returnflag || l_linestatus', X.SMS_STATES, "'NOT_PROCESSED'")} AS status,
  l_linenumber % 3 + 1 AS pages
FROM lineitem"""

TABLES["contacts"] = """
SELECT c_custkey AS contact_id, c_custkey // 100 AS user_id, '+216' || CAST(20000000 + c_custkey AS VARCHAR) AS phone,
  split_part(c_name, '#', 1) AS first_name, split_part(c_name, '#', 2) AS last_name,
  CASE WHEN c_mktsegment = coalesce(n_name, 'NONE') THEN [c_mktsegment] ELSE [c_mktsegment, coalesce(n_name, 'NONE')] END AS tags
FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey"""

TABLES["contact_rows"] = """
SELECT o_orderkey + 2 AS row_number, o_custkey // 100 AS user_id,
  CASE o_orderkey % 11 WHEN 0 THEN 'not a number'
    WHEN 1 THEN ' +216 ' || substring(digits, 1, 2) || '-' || substring(digits, 3, 6)
    WHEN 2 THEN '' WHEN 3 THEN '+336' || digits ELSE '+216' || digits END AS phone
FROM (SELECT *, CAST(20000000 + o_custkey + CASE WHEN o_orderkey % 2 = 0 THEN 50000000 ELSE 0 END AS VARCHAR) AS digits FROM orders)"""

TABLES["routed_messages"] = f"""
SELECT o_orderkey AS message_id, 'G' || CAST(o_custkey % 5 AS VARCHAR) AS group_id,
  {pick(['BANK', 'SHOP', 'NEWS'], 'o_orderkey')} AS alpha_header,
  {pick(['+216', '+216', '+216', '+33', '+44'], 'o_orderkey')} || CAST(20000000 + o_custkey * 7919 % 60000000 AS VARCHAR) AS destination
FROM orders"""

_route = lambda r: "(" + ", ".join(
    "NULL" if v is None else text(v) if isinstance(v, str) else str(v).upper() if isinstance(v, bool) else str(v) for v in r) + ")"
TABLES["routes"] = (
    "SELECT * FROM (VALUES " + ", ".join(_route(r) for r in X.ROUTES)
    + ") AS t(route_id, group_id, alpha_header, destination_pattern, priority, active, is_default)")

TABLES["budgets"] = """
SELECT c_custkey % 50 AS group_id, CAST(greatest(sum(CAST(c_acctbal AS DECIMAL(18,4))), 0) AS DECIMAL(18,4)) AS budget
FROM customer GROUP BY 1"""

# --- text helpers: a mark before and after every run of word characters stands for \b ----------
MARK = "\x01"
WORD_RUN = r"([\p{L}\p{N}_]+)"
WS = r"[\s\x0B\x1C-\x1F\x{85}\p{Z}]"
NOT_WS = r"[^\s\x0B\x1C-\x1F\x{85}\p{Z}]"


def marked(expr: str) -> str:
    return f"regexp_replace({expr}, '{WORD_RUN}', '{MARK}\\1{MARK}', 'g')"


def unmarked(expr: str) -> str:
    return f"replace({expr}, '{MARK}', '')"


def _escape(piece: str) -> str:
    return "".join("\\" + c if c in r"\.[]{}()*+-?^$|%" and c != "%" else c for c in piece)


def marked_literal(words: str) -> str:
    """A literal phrase with the marks around each of its word runs, without the outer two."""
    out, inside = [], None
    for c in words:
        word = c.isalnum() or c == "_"
        if inside is not None and word != inside:
            out.append(MARK)
        out.append(_escape(c))
        inside = word
    return "".join(out)


def marked_phrase(phrase: str) -> str:
    """A vocabulary phrase over marked text, the outer boundaries included."""
    special = {
        "code.*verif": f"{MARK}code.*verif{MARK}",
        r"code.*\d{4,6}": f"{MARK}code.*\\p{{Nd}}{{4,6}}{MARK}",
        r"pin.*\d": f"{MARK}pin.*\\p{{Nd}}{MARK}",
        r"-\d+%": f"{MARK}-{MARK}\\p{{Nd}}+{MARK}%{MARK}",
        r"jusqu'à \d+%": f"{MARK}jusqu{MARK}''{MARK}à{MARK} {MARK}\\p{{Nd}}+{MARK}%{MARK}",
    }
    if phrase in special:
        return special[phrase]
    return f"{MARK}{marked_literal(phrase)}{MARK}".replace("'", "''")


def has_phrase(column: str, phrases) -> str:
    return f"regexp_matches({column}, '{'|'.join(marked_phrase(p) for p in phrases)}')"


def normalized(message: str, darija: bool = True) -> str:
    """Nested replacements that mirror the normalisation rules over marked text."""
    hosts = "|".join(f"{_escape(h)}/{NOT_WS}+" for h in V.SHORT_LINK_HOSTS)
    t = f"lower(coalesce({message}, ''))"
    t = f"regexp_replace({t}, 'https?://{NOT_WS}+|www\\.{NOT_WS}+|{hosts}', ' URL ', 'g')"
    t = f"regexp_replace({t}, '\\p{{Nd}}+[.,]?\\p{{Nd}}*{WS}*{V.MONEY_UNITS}', ' MONTANT ', 'g')"
    t = marked(t)
    t = f"regexp_replace({t}, '{MARK}\\p{{Nd}}{{4,8}}{MARK}', ' CODE ', 'g')"
    t = f"regexp_replace({marked(unmarked(t))}, '{MARK}(?:216)?[2459]\\p{{Nd}}{{7}}{MARK}', ' TEL ', 'g')"
    for token, words in V.KEYWORD_FAMILIES.items():
        options = "|".join(marked_literal(w) for w in words)
        t = f"regexp_replace({marked(unmarked(t))}, '{MARK}(?:{options}){MARK}', ' {token} ', 'g')"
    if darija:
        t = marked(unmarked(t))
        for word, target in V.DARIJA_NORMAL.items():
            t = f"replace({t}, '{MARK}{word}{MARK}', '{MARK}{target}{MARK}')"
    t = unmarked(t)
    t = f"regexp_replace({t}, '[^\\p{{L}}\\p{{N}}_\\s\\x0B\\x1C-\\x1F\\x{{85}}\\p{{Z}}؀-ۿ]', ' ', 'g')"
    return f"regexp_replace(regexp_replace({t}, '{WS}+', ' ', 'g'), '^ | $', '', 'g')"


TABLES["clean_messages"] = f"""
SELECT message_id, message, lower(coalesce(message, '')) AS low,
  {marked("lower(coalesce(message, ''))")} AS low_marked, {normalized('message')} AS clean
FROM messages"""

_flag = lambda condition: f"CASE WHEN {condition} THEN 1 ELSE 0 END"

TABLES["cascade"] = f"""
SELECT message_id, message,
  CASE WHEN {has_phrase('low_marked', V.OTP_PHRASES)} AND NOT {has_phrase('low_marked', V.MONEY_MOVED_PHRASES)} THEN 'OTP/Banque'
    WHEN {has_phrase('low_marked', V.ALERT_PHRASES)} THEN 'Alerte/Banque'
    WHEN (contains(clean, ' BANK_KW ') OR contains(clean, ' MONTANT ')) AND {has_phrase('low_marked', V.TRANSACTION_PHRASES)} THEN 'Transaction/Banque'
    WHEN contains(clean, ' MONTANT ') AND {has_phrase('low_marked', V.AMOUNT_PHRASES)} THEN 'Transaction/Banque'
    WHEN contains(clean, ' LOG_KW ') OR {has_phrase('low_marked', V.PARCEL_PHRASES)} THEN 'Livraison/Logistique'
    WHEN {has_phrase('low_marked', V.PROMOTION_PHRASES)} THEN 'Promotion/Marketing'
    WHEN {has_phrase('low_marked', V.REMINDER_PHRASES)} THEN
      CASE WHEN {has_phrase('low_marked', V.HEALTH_PHRASES)} THEN 'Rappel/Santé' ELSE 'Rappel/Administration' END
    WHEN {has_phrase('low_marked', V.WISHES_PHRASES)} THEN 'Felicitation/Marketing'
    WHEN contains(clean, ' TEL_KW ') THEN 'Information/Télécom'
    WHEN contains(clean, ' IMMO_KW ') THEN 'Information/Immobilier'
    WHEN contains(clean, ' ADMIN_KW ') THEN 'Information/Administration'
    ELSE 'Information/Support' END AS answer
FROM clean_messages"""

# --- language, tokens ---------------------------------------------------------------------------
NOT_TOKEN = r"[^\p{L}\p{N}_؀-ۿ]+"


def tokens(column: str) -> str:
    return f"list_filter(string_split_regex(lower({column}), '{NOT_TOKEN}'), lambda t: t <> '')"


def language(column: str) -> str:
    words = f"string_split_regex(lower({column}), '{WS}+')"
    votes = lambda items: f"len(list_filter({words}, lambda w: list_contains({strings(items)}, w)))"
    return (
        f"CASE WHEN len(regexp_extract_all({column}, '{ARABIC}')) > length({column}) * 0.15 "
        f"OR list_has_any({words}, {strings(V.DARIJA_WORDS)}) THEN 'ar' "
        f"WHEN {votes(V.ENGLISH_STOP_WORDS)} > {votes(V.FRENCH_STOP_WORDS)} THEN 'en' ELSE 'fr' END")


TABLES["docs"] = f"""
SELECT doc_id, text, {language('text')} AS lang, {tokens('text')} AS tokens FROM (
  SELECT min(doc_id) AS doc_id, text FROM (
    SELECT doc_id, regexp_replace(regexp_replace(text, '^{WS}+', ''), '{WS}+$', '') AS text
    FROM corpus WHERE NOT is_spam AND noise_level <> 'heavy')
  WHERE length(text) >= 3 GROUP BY text)"""

TABLES["lexicon"] = r"""
SELECT lang, word, count(*) AS freq FROM (SELECT lang, unnest(tokens) AS word FROM docs)
WHERE NOT regexp_full_match(word, '\p{Nd}+') AND length(word) >= 2 GROUP BY ALL HAVING count(*) >= 2"""

TABLES["names"] = rf"""
SELECT lang, lower(token) AS word, count(*) AS total,
  count(*) FILTER (WHERE pos > 1 AND regexp_matches(token, '^\p{{Lu}}')) AS capitalised
FROM (SELECT lang, unnest(raw) AS token, generate_subscripts(raw, 1) AS pos
  FROM (SELECT lang, regexp_extract_all(text, '[\p{{L}}\p{{N}}_؀-ۿ]+') AS raw FROM docs))
GROUP BY 1, 2
HAVING (total >= 2 AND capitalised / total >= 0.8) OR list_contains({strings(V.FIRST_NAMES)}, word)"""

TABLES["masked"] = f"""
SELECT d.doc_id, d.lang, list(CASE WHEN n.word IS NOT NULL THEN '{V.NAME_TOKEN}' ELSE d.token END ORDER BY d.pos) AS tokens
FROM (SELECT doc_id, lang, unnest(tokens) AS token, generate_subscripts(tokens, 1) AS pos FROM docs) d
LEFT JOIN names n ON n.lang = d.lang AND n.word = d.token
WHERE NOT (d.lang = 'fr' AND n.word IS NULL AND list_contains({strings(V.LEAKED_ENGLISH)}, d.token))
GROUP BY 1, 2"""


def grams(n: int) -> str:
    words = ", ".join(f"tokens[i + {k}] AS w{k + 1}" for k in range(n))
    names = ", ".join(f"w{k + 1}" for k in range(n))
    return (f"SELECT lang, {names}, count(*) AS n FROM (SELECT lang, {words} FROM masked, "
            f"LATERAL (SELECT unnest(range(1, len(tokens) + 1 - {n - 1})) AS i)) GROUP BY ALL")


TABLES["unigrams"] = grams(1)
TABLES["bigrams"] = grams(2)
TABLES["trigrams"] = grams(3)
TABLES["continuation"] = "SELECT lang, w2 AS word, sum(n)::BIGINT AS n FROM bigrams GROUP BY 1, 2"

TABLES["tri_ranked"] = """
SELECT lang, w1, w2, w3 AS word, n / sum(n) OVER (PARTITION BY lang, w1, w2) AS prob,
  row_number() OVER (PARTITION BY lang, w1, w2 ORDER BY n DESC, w3) AS rank
FROM trigrams QUALIFY rank <= 10"""
TABLES["bi_scored"] = """
SELECT b.lang, b.w1, b.w2 AS word,
  greatest(b.n - 0.75::DOUBLE, 0) / total + (0.75::DOUBLE * kinds / total) * (coalesce(c.n, 0) / all_cont) AS prob
FROM (SELECT *, sum(n) OVER w AS total, count(*) OVER w AS kinds FROM bigrams WINDOW w AS (PARTITION BY lang, w1)) b
LEFT JOIN continuation c ON c.lang = b.lang AND c.word = b.w2
JOIN (SELECT lang, sum(n) AS all_cont FROM continuation GROUP BY 1) t ON t.lang = b.lang
WHERE b.n / total >= 0.05"""
TABLES["bi_ranked"] = """
SELECT lang, w1, word, prob, row_number() OVER (PARTITION BY lang, w1 ORDER BY prob DESC, word) AS rank
FROM bi_scored
QUALIFY rank <= 10 AND (max(prob) OVER (PARTITION BY lang, w1) >= 0.7 OR count(*) OVER (PARTITION BY lang, w1) >= 2)"""
TABLES["uni_ranked"] = """
SELECT lang, word, n / sum(n) OVER (PARTITION BY lang) AS prob,
  row_number() OVER (PARTITION BY lang ORDER BY n DESC, word) AS rank
FROM continuation QUALIFY rank <= 10"""

TABLES["typed"] = f"""
SELECT request_id, partial_text, mode, lang,
  CASE WHEN mode = 'autocomplete' AND len(toks) > 0 THEN toks[len(toks)] ELSE '' END AS current_word,
  CASE WHEN before >= 1 THEN toks[before] END AS prev1, CASE WHEN before >= 2 THEN toks[before - 1] END AS prev2
FROM (SELECT *, CASE WHEN mode = 'autocomplete' THEN greatest(len(toks) - 1, 0) ELSE len(toks) END AS before FROM (
  SELECT request_id, partial_text, {tokens('partial_text')} AS toks,
    CASE WHEN regexp_full_match(partial_text, '{WS}*') OR suffix(partial_text, ' ') THEN 'next_word' ELSE 'autocomplete' END AS mode,
    CASE WHEN regexp_full_match(partial_text, '{WS}*') THEN 'fr' ELSE {language('partial_text')} END AS lang
  FROM typing_requests))"""

TABLES["contexts"] = "SELECT DISTINCT mode, lang, current_word, prev2, prev1 FROM typed"
TABLES["predictions"] = """
SELECT c.lang, c.prev2, c.prev1, 'trigram' AS level, word, prob
FROM asked c JOIN tri_ranked t ON t.lang = c.lang AND t.w1 = c.prev2 AND t.w2 = c.prev1
UNION ALL
SELECT c.lang, c.prev2, c.prev1, 'bigram', word, prob
FROM asked c JOIN bi_ranked b ON b.lang = c.lang AND b.w1 = c.prev1
WHERE NOT EXISTS (SELECT 1 FROM trigrams t WHERE t.lang = c.lang AND t.w1 = c.prev2 AND t.w2 = c.prev1)
UNION ALL
SELECT c.lang, c.prev2, c.prev1, 'unigram', word, prob
FROM asked c JOIN uni_ranked u ON u.lang = c.lang
WHERE NOT EXISTS (SELECT 1 FROM trigrams t WHERE t.lang = c.lang AND t.w1 = c.prev2 AND t.w2 = c.prev1)
  AND NOT EXISTS (SELECT 1 FROM bi_ranked b WHERE b.lang = c.lang AND b.w1 = c.prev1)"""
TABLES["asked"] = "SELECT DISTINCT lang, prev2, prev1 FROM contexts"
TABLES["prefixes"] = "SELECT DISTINCT lang, current_word AS prefix FROM contexts WHERE mode = 'autocomplete' AND current_word <> ''"
TABLES["exact_hits"] = """
SELECT p.lang, p.prefix, word, freq, row_number() OVER (PARTITION BY p.lang, p.prefix ORDER BY freq DESC, word) AS rank
FROM prefixes p JOIN lexicon l ON l.lang = p.lang AND starts_with(l.word, p.prefix) QUALIFY rank <= 10"""
# the built-in distance counts bytes, so it only preselects; one edit is then tested by characters
_CUT = lambda c: f"substring({c}, 1, i - 1) || substring({c}, i + 1)"
TABLES["fuzzy_hits"] = f"""
SELECT lang, prefix, word, freq, dist, row_number() OVER (PARTITION BY lang, prefix ORDER BY dist, freq DESC, word) AS rank
FROM (SELECT *, CASE WHEN prefix = head THEN 0
    WHEN len(list_filter(range(1, greatest(length(prefix), length(head)) + 1), lambda i:
      (length(prefix) = length(head) AND {_CUT('prefix')} = {_CUT('head')}) OR {_CUT('prefix')} = head OR {_CUT('head')} = prefix)) > 0 THEN 1 ELSE 2 END AS dist
  FROM (SELECT p.lang, p.prefix, l.word, l.freq, substring(l.word, 1, length(p.prefix) + 1) AS head
    FROM (SELECT * FROM prefixes ANTI JOIN exact_hits USING (lang, prefix)) p
    JOIN lexicon l ON l.lang = p.lang AND abs(length(l.word) - length(p.prefix)) <= 3)
  WHERE levenshtein(prefix, head) <= 4)
WHERE dist <= 1 QUALIFY rank <= 10"""
TABLES["feedback_boosts"] = f"""
SELECT selected_word AS word, sum(exp(-0.01::DOUBLE * (epoch_us(TIMESTAMP '{X.NOW}') - epoch_us(created_at)) / 86400000000.0)) AS boost,
  count(*) AS n_events FROM word_feedback GROUP BY 1"""
TABLES["word_feedback"] = f"""
SELECT CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR) AS event_id, text AS partial_text, list_last({tokens('text')}) AS selected_word,
  TIMESTAMP '{X.FEEDBACK_START}' + to_hours(conv_id % 100 + turn) AS created_at
FROM conversations WHERE len({tokens('text')}) > 0"""

# --- timing ---------------------------------------------------------------------------------------------
TABLES["cells"] = "SELECT send_hour, nlp_type_reel AS nlp_type, sum(engaged)::BIGINT AS n_eng, count(*) AS n_obs FROM sms_log GROUP BY 1, 2"
TABLES["matrix"] = f"""
SELECT t.nlp_type, h.send_hour, coalesce(n_eng, 0) AS n_eng, coalesce(n_obs, 0) AS n_obs, g AS global_rate,
  CASE WHEN n_obs IS NULL THEN g ELSE (n_eng + m * g) / (n_obs + m) END AS time_score
FROM (SELECT DISTINCT nlp_type, CASE WHEN list_contains({strings(V.RARE_TYPES)}, nlp_type) THEN 15 ELSE 30 END AS m FROM cells) t
CROSS JOIN (SELECT CAST(range AS INTEGER) AS send_hour FROM range(24)) h
CROSS JOIN (SELECT sum(n_eng) / sum(n_obs) AS g FROM cells)
LEFT JOIN cells c ON c.nlp_type = t.nlp_type AND c.send_hour = h.send_hour"""
TABLES["curve"] = "SELECT *, time_score / global_rate AS time_norm, sqrt(greatest(time_score / global_rate, 1e-9)) AS hybrid FROM matrix"
_fallbacks = lambda i: case("nlp_type", {t: w[i] for t, w in V.FALLBACK_WINDOWS.items()}, str(V.FALLBACK_WINDOW_DEFAULT[i]))
TABLES["ranges"] = f"""
SELECT DISTINCT nlp_type,
  CASE WHEN nlp_type IN ('OTP', 'Transaction', 'Alerte') THEN 7 WHEN nlp_type IN ('Promotion', 'Livraison') THEN 17 ELSE 7 END AS lo,
  CASE WHEN nlp_type IN ('OTP', 'Transaction', 'Alerte') THEN 11 WHEN nlp_type IN ('Promotion', 'Livraison') THEN 22 ELSE 23 END AS hi,
  {_fallbacks(0)} AS flo, {_fallbacks(1)} AS fhi FROM curve"""
TABLES["peaks"] = """
SELECT r.*, p.send_hour AS peak, p.hybrid AS peak_value, a.time_norm AS norm_peak, f.send_hour AS flat_peak
FROM ranges r
JOIN (SELECT c.* FROM curve c JOIN ranges USING (nlp_type) WHERE send_hour BETWEEN lo AND hi
  QUALIFY row_number() OVER (PARTITION BY nlp_type ORDER BY hybrid DESC, send_hour) = 1) p ON p.nlp_type = r.nlp_type
JOIN (SELECT * FROM curve WHERE send_hour BETWEEN 7 AND 23
  QUALIFY row_number() OVER (PARTITION BY nlp_type ORDER BY hybrid DESC, send_hour) = 1) a ON a.nlp_type = r.nlp_type
JOIN (SELECT c.* FROM curve c JOIN ranges USING (nlp_type) WHERE send_hour BETWEEN flo AND fhi
  QUALIFY row_number() OVER (PARTITION BY nlp_type ORDER BY hybrid DESC, send_hour) = 1) f ON f.nlp_type = r.nlp_type"""
TABLES["spans"] = """
SELECT p.*, greatest(lo, peak - radius) AS s, least(hi, peak + radius) AS e FROM (
  SELECT p.nlp_type, lo, hi, flo, fhi, peak, norm_peak, flat_peak,
    greatest(peak - min(send_hour), max(send_hour) - peak) AS radius
  FROM peaks p JOIN curve c ON c.nlp_type = p.nlp_type AND c.send_hour BETWEEN lo AND hi AND c.hybrid >= peak_value * 0.95
  GROUP BY p.nlp_type, lo, hi, flo, fhi, peak, norm_peak, flat_peak) p"""
TABLES["windows"] = """
SELECT w.nlp_type, CAST(best_hour AS INTEGER) AS best_hour, CAST(window_start AS INTEGER) AS window_start,
  CAST(window_end AS INTEGER) AS window_end, method, norm_peak, c.hybrid AS hybrid_score_peak
FROM (SELECT nlp_type, norm_peak,
    CASE WHEN norm_peak < 1.05 THEN flat_peak ELSE peak END AS best_hour,
    CASE WHEN norm_peak < 1.05 THEN flo WHEN e - s > 4 THEN greatest(lo, peak - 2) ELSE s END AS window_start,
    CASE WHEN norm_peak < 1.05 THEN fhi WHEN e - s > 4 THEN least(hi, peak + 2) WHEN e - s < 1 THEN least(hi, s + 1) ELSE e END AS window_end,
    CASE WHEN norm_peak < 1.05 THEN 'fallback_posthoc' WHEN hi = 11 THEN 'morning_priority'
      WHEN lo = 17 THEN 'evening_priority' ELSE 'hybrid_norm' END AS method FROM spans) w
JOIN curve c ON c.nlp_type = w.nlp_type AND c.send_hour = w.best_hour"""


def _needs(sql: str, found: list[str]) -> list[str]:
    import re
    for name in TABLES:
        if name not in found and re.search(rf"\b{name}\b", re.sub(r"'(?:[^']|'')*'", "''", sql)):
            _needs(TABLES[name], found)
            if name not in found:
                found.append(name)
    return found


def with_tables(sql: str) -> str:
    """Prefix a query with the derived tables it names, in dependency order."""
    names = _needs(sql, [])
    if not names:
        return sql
    ctes = ",\n".join(f"{n} AS MATERIALIZED ({TABLES[n]})" for n in names)
    return f"WITH {ctes}\n{sql}"
