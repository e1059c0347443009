"""Message text: normalisation, signals, manual features, SMS pages, tokens, language."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from smsight.functions import vocab as V
from smsight.functions.regex import (
    ARABIC, ARABIC_CHARS, NOT_SPACE, SPACE, WORD_CHARS, literal, python_like, whole_word,
)

URL_PATTERN = "|".join(
    [rf"https?://{NOT_SPACE}+", rf"www\.{NOT_SPACE}+"]
    + [rf"{literal(host)}/{NOT_SPACE}+" for host in V.SHORT_LINK_HOSTS]
)
MONEY_PATTERN = r"\p{Nd}+[.,]?\p{Nd}*" + SPACE + "*" + V.MONEY_UNITS
CODE_RUN = r"^\p{Nd}{4,8}$"
PHONE_RUN = r"^(?:216)?[2459]\p{Nd}{7}$"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _replace_where(text: Column, signs: list[str], pattern: str, token: str) -> Column:
    """Replace ``pattern``, which only texts with one of the ``signs`` can have; others aren't searched."""
    return _let(text, lambda t: F.when(
        reduce(or_, [t.contains(s) for s in signs]), F.regexp_replace(t, pattern, token)).otherwise(t))


def normalize_message(message: Column | str, darija: bool = True) -> Column:
    """Replace URLs, amounts, codes, phones and keyword families by tokens, drop punctuation.

    The order of the rules matters: an 8-digit phone number is a code, and a word of two
    families belongs to the first.  The text is cut into runs of word characters once, and
    each run is looked up in hashed word sets, instead of one scan per family.  Only texts with
    Arabic signs between words need what lies between the runs.
    """
    text = F.lower(F.coalesce(_col(message), F.lit("")))
    text = _replace_where(text, ["/", "www."], URL_PATTERN, " URL ")
    text = F.regexp_replace(text, MONEY_PATTERN, " MONTANT ")
    single, spanning = {}, {}
    for token, words in V.KEYWORD_FAMILIES.items():
        for word in words:
            (single if word.replace("_", "a").isalnum() else spanning).setdefault(word, token)
    for token in dict.fromkeys(spanning.values()):
        words = [w for w, t in spanning.items() if t == token]
        text = _replace_where(text, words, whole_word(words), f" {token} ")
    normal = {w: t for w, t in V.DARIJA_NORMAL.items() if w not in single} if darija else {}

    def token(run: Column, blank: str = "") -> Column:
        out = F.when(~(run.isin([*single, *normal]) | (run.rlike(r"^\p{Nd}") & (run.rlike(CODE_RUN) | run.rlike(PHONE_RUN)))), run)
        out = out.when(run.rlike(CODE_RUN), f"{blank}CODE{blank}").when(run.rlike(PHONE_RUN), f"{blank}TEL{blank}")
        for family in V.KEYWORD_FAMILIES:
            out = out.when(run.isin([w for w, t in single.items() if t == family]), f"{blank}{family}{blank}")
        for target in dict.fromkeys(normal.values()):
            out = out.when(run.isin([w for w, t in normal.items() if t == target]), target)
        return out.otherwise(run)

    def tokens(t: Column) -> Column:
        between = F.regexp_extract_all(t, F.lit(f"[{WORD_CHARS}]+|[^{WORD_CHARS}]+"), F.lit(0))
        runs = F.split(F.regexp_replace(t, f"[^{WORD_CHARS}]+", " "), " ")
        spaced = F.array_join(F.transform(between, lambda run: token(run, " ")), "")
        signs = t.rlike(f"[{ARABIC_CHARS}&&[^{WORD_CHARS}]]")
        return F.when(signs, F.regexp_replace(spaced, f"[^{WORD_CHARS}{ARABIC_CHARS}]+", " ")).otherwise(
            F.array_join(F.transform(runs, lambda run: token(run)), " "))

    return F.trim(_let(text, tokens))


def text_signals(df: DataFrame, message: str = "message") -> DataFrame:
    """Urgency score, keyword flags and the composite flags built from them."""
    df = df.withColumn("_lower", F.lower(F.coalesce(_col(message), F.lit(""))))
    hits = F.regexp_count("_lower", F.lit(python_like(V.URGENCY_PATTERN)))
    df = df.withColumns(
        {"urgency_score": F.least(hits, F.lit(4)) / F.lit(4.0)}
        | {
            name: F.col("_lower").rlike(python_like(p)).cast("int")
            for name, p in V.SIGNAL_PATTERNS.items()
        }
    )
    flag = lambda condition: condition.cast("int")
    return df.withColumns({
        "is_urgent_high": flag(F.col("urgency_score") > 0.7),
        "is_sensitive": flag((F.col("is_otp") == 1) | (F.col("is_alert") == 1)),
        "is_marketing": flag((F.col("is_promo") == 1) & (F.col("urgency_score") < 0.4)),
        "is_transactional": flag((F.col("is_financial") == 1) | (F.col("is_otp") == 1)),
    }).drop("_lower")


def manual_text_features(df: DataFrame, clean: str = "message_clean", raw: str = "message") -> DataFrame:
    """The 49 hand-made text features of the message classifier."""
    c = F.col(clean)
    lower = F.lower(F.coalesce(F.col(raw), F.lit("")))
    count = lambda c, sign: ((F.length(c) - F.length(F.replace(c, F.lit(sign), F.lit("")))) / len(sign)).cast("int")
    words = F.when(c == "", F.lit(0)).otherwise(count(c, " ") + 1)
    has = lambda token: c.contains(token).cast("int")
    matches = lambda pattern: c.rlike(pattern.replace(".", r"[^\n]"))
    brand = lambda names: F.greatest(*[lower.contains(n) for n in names]).cast("int")
    df = df.withColumns({
        "len_chars": F.length(c),
        "len_words": words,
        "avg_word_len": F.when(words == 0, F.lit(0.0)).otherwise(
            (F.length(c) - (words - 1)) / words.cast("double")),
        **{name: has(token) for name, token in V.TOKEN_FLAGS.items()},
        "num_uppercase": F.regexp_count(raw, F.lit(r"\p{Lu}")),
        "num_exclamation": count(F.col(raw), "!"),
        "num_question": count(F.col(raw), "?"),
        "num_immo_kw": count(c, "IMMO_KW"),
        "num_tel_kw": count(c, "TEL_KW"),
        "has_bank_brand": brand(V.BANK_BRANDS),
        "has_telecom_brand": brand(V.TELECOM_BRANDS),
        **{name: F.lit(0) for name in
           ("is_darija", "is_arabe", "is_anglais", "is_ambiguous", "num_candidates")},
    })
    on = lambda name: F.col(name) == 1
    immo, tel, bank = on("has_immo_kw"), on("has_tel_kw"), on("has_bank_kw")
    conditions = {
        "immo_strong": F.col("num_immo_kw") >= 2,
        "immo_montant": immo & on("has_montant"),
        "immo_rdv": immo & (on("has_heure") | matches(V.VISIT_PATTERN)),
        "immo_contrat": immo & matches(V.CONTRACT_PATTERN),
        "immo_darija": immo & matches(V.DARIJA_HOME_PATTERN),
        "immo_not_log": immo & ~matches(V.PARCEL_PATTERN),
        "immo_not_install": immo & ~matches(V.INSTALL_PATTERN),
        "telecom_context": on("has_code") & tel,
        "telecom_strong": F.col("num_tel_kw") >= 2,
        "telecom_recharge": tel & matches(V.TOPUP_PATTERN),
        "telecom_install": tel & matches(V.INSTALL_PATTERN),
        "telecom_brand": on("has_telecom_brand"),
        "bank_context": on("has_code") & bank,
        "bank_transaction": on("has_montant") & bank,
        "bank_brand": on("has_bank_brand"),
        "log_context": on("has_log_kw") & on("has_montant"),
        "sante_context": on("has_sante_kw") & on("has_heure"),
        "promo_signal": on("has_mkt_kw") & (F.col("num_exclamation") >= 1),
    }
    return df.withColumns({name: cond.cast("int") for name, cond in conditions.items()})


MANUAL_FEATURES = [
    "len_chars", "len_words", "avg_word_len", *V.TOKEN_FLAGS, "num_uppercase", "num_exclamation",
    "num_question", "num_immo_kw", "num_tel_kw", "has_bank_brand", "has_telecom_brand",
    "is_darija", "is_arabe", "is_anglais", "is_ambiguous", "num_candidates", "immo_strong",
    "immo_montant", "immo_rdv", "immo_contrat", "immo_darija", "immo_not_log",
    "immo_not_install", "telecom_context", "telecom_strong", "telecom_recharge",
    "telecom_install", "telecom_brand", "bank_context", "bank_transaction", "bank_brand",
    "log_context", "sante_context", "promo_signal",
]


# --- SMS pages, encoding, template variables -------------------------------------------------

def has_arabic(message: Column | str) -> Column:
    return _col(message).rlike(ARABIC)


def encoding(message: Column | str) -> Column:
    return F.when(has_arabic(message), F.lit("UCS2")).otherwise(F.lit("UTF-8"))


def sms_pages(message: Column | str, arabic_aware: bool = True) -> Column:
    """Pages of 160 characters; with ``arabic_aware``, 70 for Arabic and at least one unless empty."""
    length = F.length(F.coalesce(_col(message), F.lit("")))
    if not arabic_aware:
        return F.ceil(length / F.lit(160)).cast("int")
    per_page = F.when(has_arabic(message), F.lit(70)).otherwise(F.lit(160))
    return F.coalesce(F.ceil(length / per_page).cast("int"), F.lit(0))


def template_variables(message: Column | str) -> Column:
    """Distinct ``@name`` variables in order of appearance (ASCII names)."""
    return F.array_distinct(F.regexp_extract_all(_col(message), F.lit("@[A-Za-z0-9_]+"), F.lit(0)))


# --- tokens and language -----------------------------------------------------------------------

def tokenize(text: Column | str) -> Column:
    """Lower-cased tokens; punctuation separates, Arabic stays."""
    return F.array_remove(F.split(F.lower(_col(text)), f"[^{WORD_CHARS}{ARABIC_CHARS}]+"), "")


def raw_tokens(text: Column | str) -> Column:
    """Tokens with their case, as used to find names."""
    return F.regexp_extract_all(_col(text), F.lit(f"[{WORD_CHARS}{ARABIC_CHARS}]+"), F.lit(0))


def usable_token(token: Column) -> Column:
    """Not purely numeric and at least two characters."""
    return ~token.rlike(r"^\p{Nd}+$") & (F.length(token) >= 2)


def detect_language(text: Column | str) -> Column:
    """``ar`` by share of Arabic characters or a darija word, else a stop-word vote, else ``fr``.

    The text is cut at blanks once and its words are looked up, instead of one scan for each word list.
    """
    text = _col(text)
    arabic = F.regexp_count(text, F.lit(ARABIC)) > F.length(text) * F.lit(V.ARABIC_SHARE)
    listed = [*V.DARIJA_WORDS, *V.ENGLISH_STOP_WORDS, *V.FRENCH_STOP_WORDS]
    found = F.filter(F.split(F.lower(text), SPACE), lambda w: w.isin(listed))
    votes = lambda f, words: F.size(F.filter(f, lambda w: w.isin(words)))
    return _let(found, lambda f: (
        F.when(arabic | (votes(f, V.DARIJA_WORDS) > 0), F.lit("ar"))
        .when(votes(f, V.ENGLISH_STOP_WORDS) > votes(f, V.FRENCH_STOP_WORDS), F.lit("en"))
        .otherwise(F.lit("fr"))))
