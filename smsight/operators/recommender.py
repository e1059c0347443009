"""Text recommender: corpus, lexicon, names, n-grams, completion, next word, ranking."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from smsight.functions import text as T, vocab as V
from smsight.functions.regex import SPACE, SPACES
from smsight.operators.ranks import top_per_group
from smsight.session import written

CANDIDATES = 10  # candidates asked from each source before ranking


def _in(column: Column, words: list[str]) -> Column:
    return column.isin(words)


CODES = 1 << 22  # numbers that keys are hashed to


def _maybe(rows: DataFrame, asked: DataFrame, on: list[str]) -> DataFrame:
    """The rows whose key may be ``asked`` for; an exact join has to follow.

    Keys are compared by one of ``CODES`` numbers, so what goes to every task is bounded however much is asked, and of a
    model that is far larger than the questions little is shuffled. Key columns need the same types on both sides.
    """
    code = F.pmod(F.xxhash64(*on), F.lit(CODES)).alias("_code")
    return rows.select("*", code).join(F.broadcast(asked.select(code).distinct()), "_code", "left_semi").drop("_code")


# --- corpus -----------------------------------------------------------------------------------

def clean_corpus(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Usable distinct texts with their language and tokens.

    Grouping by the text itself drops repeats before the shuffle; the smallest id is kept.
    """
    trimmed = df.where(~F.col("is_spam") & (F.col("noise_level") != "heavy")).select(
        F.col(doc_id).alias("doc_id"),
        F.btrim(text, F.lit(SPACES)).alias("text"),
    ).where(F.length("text") >= 3)
    return trimmed.groupBy("text").agg(F.min("doc_id").alias("doc_id")).withColumn(
        "lang", T.detect_language("text")).withColumn("tokens", T.tokenize("text"))


def lexicon(docs: DataFrame, min_freq: int = 2) -> DataFrame:
    """Words and frequencies per language, without numbers, single characters and rare words."""
    # the outer form keeps the planner from tokenising a second time to filter empty arrays
    words = docs.select("lang", F.explode_outer("tokens").alias("word")).where(T.usable_token(F.col("word")))
    return words.groupBy("lang", "word").agg(F.count("*").alias("freq")).where(F.col("freq") >= min_freq)


def named_entities(
    docs: DataFrame, share: float = V.NAME_SHARE, min_count: int = V.NAME_MIN_COUNT, known: list[str] = V.FIRST_NAMES,
) -> DataFrame:
    """Words that are mostly capitalised away from the start, and known first names that occur."""
    tokens = docs.select("lang", F.posexplode_outer(T.raw_tokens("text")).alias("pos", "token"))
    tokens = tokens.where(F.col("token").isNotNull())
    capital = (F.col("pos") > 0) & F.col("token").rlike(r"^\p{Lu}")
    counts = tokens.groupBy("lang", F.lower("token").alias("word")).agg(
        F.count("*").alias("total"), F.count_if(capital).alias("capitalised"))
    frequent = (F.col("total") >= min_count) & (F.col("capitalised") / F.col("total") >= share)
    return counts.where(frequent | _in(F.col("word"), known))


# --- n-grams ------------------------------------------------------------------------------------

@dataclass
class NgramModel:
    """Count tables per language; ``positions`` holds what the others are summed from."""

    positions: DataFrame     # lang, w1, w2, w3, n
    unigrams: DataFrame      # lang, word, n
    bigrams: DataFrame       # lang, w1, w2, n
    trigrams: DataFrame      # lang, w1, w2, w3, n
    continuation: DataFrame  # lang, word, n


def _mask(rows: DataFrame, names: DataFrame, columns: list[str]) -> DataFrame:
    """Replace names by one token, before anything is counted. ``names`` is a part of the vocabulary and goes to every task."""
    for column in columns:
        side = names.select("lang", F.col("word").alias(column), F.lit(True).alias("_name"))
        rows = rows.join(F.broadcast(side), ["lang", column], "left").withColumn(
            column, F.when(F.col("_name"), V.NAME_TOKEN).otherwise(F.col(column))).drop("_name")
    return rows


def drop_leaked_words(docs: DataFrame, names: DataFrame | None) -> DataFrame:
    """Remove English words that slipped into French texts, unless they are names there.

    Only the fixed word list can be affected, so the exceptions are at most that long.
    """
    leaked = F.array(*[F.lit(w) for w in V.LEAKED_ENGLISH])
    if names is not None:
        spared = names.where((F.col("lang") == "fr") & _in(F.col("word"), V.LEAKED_ENGLISH)).agg(
            F.collect_set("word")).scalar()
        leaked = F.array_except(leaked, F.coalesce(spared, F.array().cast("array<string>")))
    return docs.withColumn("_leaked", leaked).withColumn("tokens", F.when(
        F.col("lang") == "fr", F.filter("tokens", lambda t: ~F.array_contains("_leaked", t))
    ).otherwise(F.col("tokens"))).drop("_leaked")


CHARS_A_TASK = 1 << 24  # of text whose n-grams one task counts: its distinct ones have to fit into its memory


def spread(docs: DataFrame, text: str = "text", chars: int = CHARS_A_TASK) -> DataFrame:
    """Texts dealt over so many tasks that none counts the n-grams of much more than ``chars`` characters.

    Most longer n-grams are rare, so their partial sums are about as many as the words; where a task reads more than it
    can hold, all of them are sorted on disk. Tables with enough splits are left alone.
    """
    total = docs.agg(F.sum(F.length(text).cast("bigint"))).first()[0] or 0
    tasks = -(-total // chars)
    return docs.repartition(tasks) if docs.rdd.getNumPartitions() < tasks else docs


def _grams(docs: DataFrame, names: DataFrame | None, n: int, whole: bool = True) -> DataFrame:
    """Counts of ``n`` consecutive tokens ``w1``, ``w2``, ..; not ``whole``: also of those that a text's end cuts short.

    The counted key is one string, as tokens have no blanks: half as wide as a column for each token.
    """
    tokens = F.col("tokens")
    after = lambda i: F.slice(tokens, i + 1, F.greatest(F.size(tokens) - i, F.lit(0)))
    words = [f"w{i + 1}" for i in range(n)]
    # the outer form keeps the planner from tokenising a second time to filter empty arrays; shorter arrays are filled with nulls
    rows = docs.select("lang", F.explode_outer(F.arrays_zip(*[(after(i) if i else tokens).alias(w) for i, w in enumerate(words)])).alias("g")).select(
        "lang", *[F.col(f"g.{w}").alias(w) for w in words]).where(F.col(words[-1] if whole else "w1").isNotNull())
    if names is not None:
        rows = _mask(rows, names, words)
    counts = rows.groupBy("lang", F.concat_ws(" ", *words).alias("_key")).agg(F.count("*").alias("n"))
    parts = F.split("_key", " ")
    return counts.select("lang", *[F.get(parts, F.lit(i)).alias(w) for i, w in enumerate(words)], "n")


def count_ngrams(docs: DataFrame, names: DataFrame | None = None, drop_leaked: bool = True) -> NgramModel:
    """Unigram, bigram, trigram and continuation counts, each counted from the token arrays with names masked before.

    Nothing is read before a table is asked for, and a table costs one shuffle of its own n-grams.
    """
    if drop_leaked:
        docs = drop_leaked_words(docs, names)
    bigrams = _grams(docs, names, 2)
    # every token but the first of a text follows another one
    later = docs.withColumn("tokens", F.slice("tokens", 2, F.greatest(F.size("tokens") - 1, F.lit(0))))
    return NgramModel(
        _grams(docs, names, 3, whole=False), _grams(docs, names, 1).withColumnRenamed("w1", "word"), bigrams,
        _grams(docs, names, 3), _grams(later, names, 1).withColumnRenamed("w1", "word"))


def ngram_model(positions: DataFrame) -> NgramModel:
    """The count tables from counted positions ``(lang, w1, w2, w3, n)``."""
    total = lambda rows, *by: rows.groupBy("lang", *by).agg(F.sum("n").alias("n"))
    bigrams = total(positions.where(F.col("w2").isNotNull()), "w1", "w2")
    return NgramModel(
        positions, total(positions, F.col("w1").alias("word")), bigrams,
        positions.where(F.col("w3").isNotNull()),
        total(positions.where(F.col("w2").isNotNull()), F.col("w2").alias("word")))


def distinct_continuation(bigrams: DataFrame) -> DataFrame:
    """Variant of the continuation counts: distinct left neighbours instead of occurrences."""
    return bigrams.groupBy("lang", F.col("w2").alias("word")).agg(F.count("*").alias("n"))


def _best_lists(ranked: DataFrame, keys: list[str], k: int) -> DataFrame:
    """At most ``k`` (word, prob) per key as a sorted array."""
    top = top_per_group(ranked, keys, [F.col("prob").desc(), F.col("word").asc()], k)
    entry = F.struct("rank", "word", "prob")
    return top.groupBy(*keys).agg(F.array_sort(F.collect_list(entry)).alias("best"))


def trigram_lists(trigrams: DataFrame, k: int = CANDIDATES) -> DataFrame:
    """Best followers of two words. Within a context the share has the order of the count, so only the ``k`` most frequent
    followers, which Spark picks before the shuffle, meet the context's total."""
    keys = ["lang", "w1", "w2"]
    totals = trigrams.groupBy(*keys).agg(F.sum("n").alias("total"))
    top = top_per_group(trigrams, keys, [F.col("n").desc(), F.col("w3").asc()], k)
    entry = F.struct("rank", F.col("w3").alias("word"), (F.col("n") / F.col("total")).alias("prob"))
    return top.join(totals, keys).groupBy(*keys).agg(F.array_sort(F.collect_list(entry)).alias("best"))


def bigram_lists(bigrams: DataFrame, continuation: DataFrame, k: int = CANDIDATES, discount: float = V.DISCOUNT) -> DataFrame:
    """Discounted scores of the followers that make up at least 5 % of their context.

    A context answers when its first follower dominates or it has two of them.
    """
    totals = bigrams.groupBy("lang", "w1").agg(F.sum("n").alias("total"), F.count("*").alias("kinds"))
    per_lang = continuation.groupBy("lang").agg(F.sum("n").alias("all_cont"))
    reliable = bigrams.join(totals, ["lang", "w1"]).where(F.col("n") / F.col("total") >= V.MIN_CONTEXT_SHARE)
    weights = reliable.join(
        continuation.select("lang", F.col("word").alias("w2"), F.col("n").alias("cont")), ["lang", "w2"], "left",
    ).join(F.broadcast(per_lang), "lang")
    backoff = F.coalesce("cont", F.lit(0)) / F.col("all_cont")
    score = (
        F.greatest(F.col("n") - discount, F.lit(0.0)) / F.col("total")
        + (F.lit(discount) * F.col("kinds") / F.col("total")) * backoff)
    lists = _best_lists(
        weights.select("lang", "w1", F.col("w2").alias("word"), score.alias("prob")), ["lang", "w1"], k)
    first = F.element_at("best", 1).prob
    return lists.where((first >= V.DOMINANT) | (F.size("best") >= 2))


def unigram_lists(continuation: DataFrame, k: int = CANDIDATES) -> DataFrame:
    per_lang = continuation.groupBy("lang").agg(F.sum("n").alias("all_cont"))
    scored = continuation.join(F.broadcast(per_lang), "lang").select(
        "lang", "word", (F.col("n") / F.col("all_cont")).alias("prob"))
    return _best_lists(scored, ["lang"], k)


def predict_next(contexts: DataFrame, model: NgramModel, k: int = CANDIDATES) -> DataFrame:
    """Next words per distinct context ``(lang, prev2, prev1)``.

    Trigram, else reliable bigram, else the most frequent continuations; levels never mix.
    ``prev2`` / ``prev1`` are null where the context is shorter.
    """
    # written first: the joins below would otherwise push their key filters, and with them the
    # tokenising, into several scans of the requests; the planner also learns the real size
    distinct = written(contexts.select("lang", "prev2", "prev1").distinct(), "contexts")
    # only asked contexts are scored: the semi-joins run before the counts are summed and ranked
    pairs = distinct.where(F.col("prev2").isNotNull()).select("lang", F.col("prev2").alias("w1"), F.col("prev1").alias("w2"))
    lasts = distinct.where(F.col("prev1").isNotNull()).select("lang", F.col("prev1").alias("w1")).distinct()
    asked = lambda counts, keys: _maybe(counts, keys, keys.columns).join(keys, keys.columns, "left_semi")
    trigrams, bigrams = asked(model.trigrams, pairs), asked(model.bigrams, lasts)
    tri = trigram_lists(trigrams, k).select(
        "lang", F.col("w1").alias("prev2"), F.col("w2").alias("prev1"), F.col("best").alias("_tri"))
    bi = bigram_lists(bigrams, model.continuation, k).select(
        "lang", F.col("w1").alias("prev1"), F.col("best").alias("_bi"))
    # one short list per language
    uni = F.broadcast(unigram_lists(model.continuation, k).select("lang", F.col("best").alias("_uni")))
    joined = distinct.join(tri, ["lang", "prev2", "prev1"], "left").join(bi, ["lang", "prev1"], "left").join(uni, "lang", "left")
    return joined.select(
        "lang", "prev2", "prev1",
        F.when(F.col("_tri").isNotNull(), "trigram").when(F.col("_bi").isNotNull(), "bigram").otherwise("unigram").alias("level"),
        F.explode(F.coalesce("_tri", "_bi", "_uni")).alias("_p"),
    ).select("lang", "prev2", "prev1", "level", F.col("_p.word").alias("word"), F.col("_p.prob").alias("prob"))


# --- completion -------------------------------------------------------------------------------------

def _asked(prefixes: DataFrame) -> DataFrame:
    """Distinct (lang, prefix), written: the planner learns how few there are, and their lengths are read from there."""
    return written(prefixes.select("lang", "prefix").distinct(), "prefixes")


def _lengths(asked: DataFrame) -> Column:
    """The lengths of the asked prefixes, as an array of a few numbers."""
    return asked.agg(F.sort_array(F.collect_set(F.length("prefix")))).scalar()


def prefix_completions(prefixes: DataFrame, words: DataFrame, k: int = CANDIDATES) -> DataFrame:
    """The ``k`` most frequent words beginning with each distinct ``(lang, prefix)``."""
    return _exact(_asked(prefixes), words, k)


def _exact(asked: DataFrame, words: DataFrame, k: int) -> DataFrame:
    spread = words.withColumn("_n", _lengths(asked)).select("lang", "word", "freq", F.explode(
        F.transform(F.filter("_n", lambda n: (n > 0) & (n <= F.length("word"))), lambda n: F.substring("word", F.lit(1), n))).alias("prefix"))
    hits = _maybe(spread, asked, ["lang", "prefix"]).join(asked, ["lang", "prefix"])
    return top_per_group(hits, ["lang", "prefix"], [F.col("freq").desc(), F.col("word").asc()], k).select(
        "lang", "prefix", "word", "freq", F.lit(0).alias("dist"), "rank")


def _deletions(c: Column) -> Column:
    """A string and every string with one character less."""
    shorter = F.transform(F.sequence(F.lit(1), F.greatest(F.length(c), F.lit(1))), lambda i: F.concat(
        F.substring(c, F.lit(1), i - 1), F.substring(c, i + 1, F.length(c))))
    return F.array_distinct(F.concat(F.array(c), shorter))


def fuzzy_completions(prefixes: DataFrame, words: DataFrame, k: int = CANDIDATES) -> DataFrame:
    """Words whose beginning is within one edit of the prefix (prefixes without an exact hit).

    Two strings within one edit share a string of their deletion neighbourhoods, so candidates
    come from an equi-join; a word is compared by its first ``len(prefix) + 1`` characters and
    only if its length differs by at most 3. Neighbourhoods are made for asked lengths only, and
    only their strings that some prefix may share are shuffled.
    """
    return _fuzzy(_asked(prefixes), words, k)


def _fuzzy(asked: DataFrame, words: DataFrame, k: int) -> DataFrame:
    length = F.length("word")
    fitting = F.filter("_n", lambda n: (n >= F.greatest(length - 3, F.lit(1))) & (n <= length + 3))
    by_head = words.withColumn("_n", _lengths(asked)).select("lang", "word", "freq", F.explode(fitting).alias("_len")).withColumn(
        "_head", F.substring("word", F.lit(1), F.col("_len") + 1))
    on = ["lang", "_len", "_key"]
    wanted = asked.withColumn("_len", F.length("prefix")).withColumn("_key", F.explode(_deletions(F.col("prefix"))))
    heads = _maybe(by_head.select("lang", "_len", "_head", F.explode(_deletions(F.col("_head"))).alias("_key")), wanted, on).distinct()
    near = written(wanted.join(heads, on).select("lang", "_len", "prefix", "_head").distinct().withColumn(
        "dist", F.levenshtein("prefix", "_head", 1)).where(F.col("dist") >= 0), "near")
    return top_per_group(
        near.join(_maybe(by_head, near, ["lang", "_len", "_head"]), ["lang", "_len", "_head"]), ["lang", "prefix"], [F.col("dist").asc(), F.col("freq").desc(), F.col("word").asc()], k,
    ).select("lang", "prefix", "word", "freq", "dist", "rank")


def completions(prefixes: DataFrame, words: DataFrame, k: int = CANDIDATES) -> DataFrame:
    """Exact completions, and fuzzy ones only where there are none."""
    asked = _asked(prefixes)
    exact = written(_exact(asked, words, k), "exact")
    missing = written(asked.join(exact.select("lang", "prefix").distinct(), ["lang", "prefix"], "left_anti"), "missing")
    return exact.unionByName(_fuzzy(missing, words, k))


# --- requests, ranking, feedback ------------------------------------------------------------------------

def typing_context(df: DataFrame, text: str = "partial_text") -> DataFrame:
    """Mode, current word, the two words before it and the language of a half-typed text."""
    c = F.coalesce(F.col(text), F.lit(""))
    blank = F.regexp_replace(c, f"{SPACE}+", "") == ""
    df = df.withColumn("_tokens", F.when(blank, F.array().cast("array<string>")).otherwise(T.tokenize(c)))
    typing = ~(blank | c.endswith(" "))
    n = F.size("_tokens")
    before = F.when(typing, F.greatest(n - 1, F.lit(0))).otherwise(n)
    at = lambda i: F.when(i >= 1, F.try_element_at("_tokens", F.greatest(i, F.lit(1))))
    return df.withColumns({
        "mode": F.when(typing, "autocomplete").otherwise("next_word"),
        "current_word": F.when(typing, F.coalesce(at(n), F.lit(""))).otherwise(""),
        "prev1": at(before), "prev2": at(before - 1),
        "lang": F.when(blank, "fr").otherwise(T.detect_language(c)),
    }).drop("_tokens")


def feedback_scores(feedback: DataFrame, now: Column, decay: float = V.FEEDBACK_LAMBDA) -> DataFrame:
    """Selections per word, each fading with its age in days."""
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    days = (micros(now) - micros(F.col("created_at"))) / F.lit(86_400_000_000.0)
    return feedback.groupBy(F.col("selected_word").alias("word")).agg(
        F.sum(F.exp(F.lit(-decay) * days)).alias("boost"), F.count("*").alias("n_events"))


def recent_feedback(feedback: DataFrame, since: Column) -> DataFrame:
    return feedback.where(F.col("created_at") > since)


def top_recent_words(scores: DataFrame, k: int = 10, reference_formula: bool = False) -> DataFrame:
    """The most selected words lately; ``reference_formula`` counts the sum once per event."""
    total = F.col("boost") * F.col("n_events") if reference_formula else F.col("boost")
    return scores.select("word", total.alias("score")).orderBy(F.col("score").desc(), "word").limit(k)


def served_by(lang: Column, words: DataFrame, languages: list[str] | None = None) -> Column:
    """The language whose model serves ``lang``: itself if it has one (words, or a name in ``languages``), else French."""
    if languages is not None:
        return F.when(lang.isin(languages), lang).otherwise("fr")
    known = words.agg(F.collect_set("lang")).scalar()  # a set of languages, not of words
    return F.when(F.array_contains(known, lang), lang).otherwise("fr")


def apply_feedback(words: DataFrame, feedback: DataFrame, weight: int = V.FEEDBACK_FREQ) -> DataFrame:
    """Lexicon with every selected word's frequency raised; each event id counts once.

    A selection in a language without words raises the French ones.
    """
    events = feedback.groupBy("event_id").agg(F.min(F.struct("partial_text", "selected_word")).alias("_e"))
    raised = events.select(T.detect_language(F.col("_e.partial_text")).alias("_l"), F.col("_e.selected_word").alias("word")).select(
        served_by(F.col("_l"), words).alias("lang"), "word").groupBy("lang", "word").agg(
        (F.count("*") * weight).alias("freq"))
    return words.select("lang", "word", "freq").unionByName(raised).groupBy("lang", "word").agg(F.sum("freq").alias("freq"))


CONTEXT = ["mode", "lang", "current_word", "prev2", "prev1"]


def rank_suggestions(
    contexts: DataFrame, words: DataFrame, model: NgramModel, boosts: DataFrame | None = None, top_k: int = 5,
    languages: list[str] | None = None,
) -> DataFrame:
    """Suggestions per distinct typing context.

    ``0.4 * freq / max freq + 0.6 * probability``, plus ``0.3 * boost`` for selected words;
    scores below 0.001 are dropped.  Ties go to the smaller word.  ``languages`` names those
    with a model (those of ``words`` unless given); others are served by the French one.
    """
    used = served_by(F.col("lang"), words, languages)
    ctx = written(contexts.select(*CONTEXT).distinct(), "contexts").withColumns({"_asked": F.col("lang"), "lang": used}).withColumn(
        "_completing", (F.col("mode") == "autocomplete") & (F.col("current_word") != ""))
    typed = ctx.where("_completing").select(*CONTEXT, "_asked", F.col("current_word").alias("prefix"))
    found = completions(typed, words, CANDIDATES)
    by_word = typed.join(found, ["lang", "prefix"])
    strongest = W.partitionBy(*CONTEXT, "_asked")
    from_words = by_word.select(*CONTEXT, "_asked", "word", (
        F.lit(V.RANK_FREQ) * (F.col("freq") / F.max("freq").over(strongest))).alias("part"), F.lit(0).alias("src"))
    asks = ctx.where(~F.col("_completing") | F.col("prev1").isNotNull())
    predicted = predict_next(asks, model, CANDIDATES).select(
        F.col("lang").alias("_l"), F.col("prev2").alias("_p2"), F.col("prev1").alias("_p1"), "word", "prob")
    same = (
        F.col("lang").eqNullSafe(F.col("_l")) & F.col("prev2").eqNullSafe(F.col("_p2"))
        & F.col("prev1").eqNullSafe(F.col("_p1")))
    from_model = asks.join(predicted, same).where(
        ~F.col("_completing") | F.startswith(F.col("word"), F.col("current_word"))
    ).select(*CONTEXT, "_asked", "word", (F.lit(V.RANK_PROB) * F.col("prob")).alias("part"), F.lit(1).alias("src"))
    parts = from_words.unionByName(from_model).groupBy(*CONTEXT, "_asked", "word").agg(
        F.coalesce(F.max(F.when(F.col("src") == 0, F.col("part"))), F.lit(0.0)).alias("_w"),
        F.coalesce(F.max(F.when(F.col("src") == 1, F.col("part"))), F.lit(0.0)).alias("_m"))
    score = F.col("_w") + F.col("_m")
    if boosts is not None:
        parts = parts.join(boosts.select("word", "boost"), "word", "left")
        score = score + F.coalesce(F.lit(V.RANK_FEEDBACK) * F.col("boost"), F.lit(0.0))
    # nine digits are compared, so that the order of summation cannot decide a tie
    scored = parts.withColumn("score", F.round(score, 9)).where(F.col("score") >= V.RANK_THRESHOLD)
    scored = scored.drop("lang").withColumnRenamed("_asked", "lang")
    top = top_per_group(scored, CONTEXT, [F.col("score").desc(), F.col("word").asc()], top_k)
    return top.select(*CONTEXT, "rank", "word", F.round("score", 4).alias("score"))


def recommend(
    requests: DataFrame, words: DataFrame, model: NgramModel, boosts: DataFrame | None = None, top_k: int = 5,
    languages: list[str] | None = None,
) -> DataFrame:
    """Ranked suggestions per request; equal contexts are ranked once.

    A request without suggestions stays, with rank, word and score null.
    """
    asked = typing_context(requests)
    ranked = rank_suggestions(asked, words, model, boosts, top_k, languages)
    same = F.lit(True)
    for c in CONTEXT:
        same = same & F.col(c).eqNullSafe(F.col(f"_r_{c}"))
    answers = ranked.withColumnsRenamed({c: f"_r_{c}" for c in CONTEXT})
    return asked.join(answers, same, "left").select("request_id", "mode", "lang", "rank", "word", "score")


def evaluate_recommender(texts: DataFrame, model: NgramModel, top_k: int = 5, languages: list[str] | None = None) -> DataFrame:
    """MRR, P@k and verdict of next-word suggestions over every position of ``texts``.

    Positions are grouped by (language, last two words, true word) first, so a frequent
    context is predicted once.  The language is that of the whole text.
    """
    used = T.detect_language("text")
    if languages is not None:
        used = F.when(used.isin(languages), used).otherwise("fr")
    docs = texts.select(used.alias("lang"), T.tokenize("text").alias("tokens"))
    size = F.size("tokens")
    shifted = F.concat(F.array(F.lit(None).cast("string")), F.col("tokens"))
    steps = F.arrays_zip(
        F.slice(shifted, 1, F.greatest(size - 1, F.lit(0))).alias("prev2"),
        F.slice("tokens", 1, F.greatest(size - 1, F.lit(0))).alias("prev1"),
        F.slice("tokens", 2, F.greatest(size - 1, F.lit(0))).alias("truth"))
    cases = written(docs.select("lang", F.explode_outer(steps).alias("s")).where(F.col("s.truth").isNotNull()).groupBy(
        "lang", "s.prev2", "s.prev1", "s.truth").agg(F.count("*").alias("n")), "cases")
    asked = cases.select("lang", "prev2", "prev1").distinct()
    predicted = predict_next(asked, model, CANDIDATES).withColumn("score", F.round(F.lit(V.RANK_PROB) * F.col("prob"), 9))
    kept = top_per_group(
        predicted.where(F.col("score") >= V.RANK_THRESHOLD).withColumn("_p2", F.coalesce("prev2", F.lit(""))),
        ["lang", "_p2", "prev1"], [F.col("score").desc(), F.col("word").asc()], top_k)
    hit = cases.withColumn("_p2", F.coalesce("prev2", F.lit(""))).join(
        kept.select("lang", "_p2", "prev1", F.col("word").alias("truth"), "rank"), ["lang", "_p2", "prev1", "truth"], "left")
    scored = hit.agg(
        F.sum("n").alias("total"),
        (F.sum(F.col("n") * F.coalesce(F.lit(1.0) / F.col("rank"), F.lit(0.0))) / F.sum("n")).alias("mrr"),
        (F.sum(F.when(F.col("rank").isNotNull(), F.col("n")).otherwise(0)) / F.sum("n")).alias("precision_at_k"))
    return scored.withColumn("verdict", F.when(F.col("mrr") > 0.5, "excellent").when(F.col("mrr") > 0.3, "bon").otherwise("faible"))
