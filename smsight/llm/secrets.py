"""Secret scans: fixed patterns, and character Markov models that tell random strings from ordinary identifiers.

Built from column functions only. A pattern's matches with their places come from extracting "what lies before" and "the
match" as two arrays of equal length; running sums of their lengths give code point offsets.

Model: first-order transitions between the characters of an alphabet (anything else is one more), with a begin and an end,
smoothed by ``SMOOTH``. Random strings of six kinds are drawn by hash functions (:func:`random_strings`). Ordinary ones come
from the ``SAMPLE_ROWS`` texts with the least hashes, outside of the patterns' spans: their tokens of fewer than 20
characters, these joined by separators as paths, names and rules are, and numbers, dates and rulings drawn by rule. A
candidate is a run of ``[A-Za-z0-9+/_=-]`` with 20 or more characters, five or more of them different; it is a secret if the
log-likelihood ratio for each of its characters is in the mean above the model's threshold and it does not overlap a span
found by a pattern. The threshold is learned from strings that the transitions were not counted on: the ratio that all but
``FALSE_ALARMS`` of the ordinary ones stay below. Digits alone look like numbers and aren't flagged.

Defined results: a null or empty text has no spans (``spans`` is the empty array); repeated rows repeat; an empty table
gives an empty one. Columns named ``base`` or ``spans`` are replaced, all others are untouched, whatever their names. Offsets
count code points, ends are exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from smsight.llm.frames import least_hash

ASSIGN = r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|""" \
         r"""[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))"""
ACCESS = r"(AKIA[A-Z0-9]+)"
HEX = r"([0-9a-f]+)"
CANDIDATE = r"([A-Za-z0-9+/_=-]{20,})"
KINDS = ["assign", "access", "hex", "markov"]
#: pattern, its quick test on a whole text, the group whose length counts and the least length
PATTERNS = {
    "assign": (ASSIGN, r"[dDtTnNyY][\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9+/_.=-]{8}", 3, 8),
    "access": (ACCESS, r"AKIA[A-Z0-9]{12}", 2, 16),
    "hex": (HEX, r"[0-9a-f]{32}", 2, 32),
}
LEAST_CANDIDATE = 20

ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
SIZE = len(ALPHABET) + 2  # position 0 is every other character, the last one is begin and end
SMOOTH = 0.5
SAMPLE_ROWS = 2000
RANDOM_ROWS = 4000
FALSE_ALARMS = 0.0005
LEAST_DIFFERENT = 5
SEPARATORS = "_-/=+"

SPAN = "array<struct<start:int,end:int,kind:string>>"


def _spans(text: Column, pattern: str, group: int, least: int) -> Column:
    """Places and texts of the matches whose group is long enough."""
    full = F.lit(rf"(?s)(.*?)(?:{pattern}|\z)")  # what follows the last match is one more, empty one: no rescan of the rest
    before, match, counted = (F.regexp_extract_all(text, full, F.lit(i)) for i in (1, 2, group))
    parts = F.arrays_zip(F.transform(before, F.length).alias("before"), match.alias("match"), F.transform(counted, F.length).alias("counted"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,value:string>>").alias("spans"))

    def add(state: Column, x: Column) -> Column:
        begin = state["at"] + x["before"]
        end = begin + F.length(x["match"])
        one = F.array(F.struct(begin.alias("start"), end.alias("end"), x["match"].alias("value")))
        return F.struct(end.alias("at"), F.when(x["counted"] >= least, F.concat(state["spans"], one)).otherwise(state["spans"]).alias("spans"))

    return F.aggregate(parts, start, add)["spans"]


def _of_kind(spans: Column, kind: str) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(kind).alias("kind")))


def base_spans(text: Column) -> Column:
    """Spans of the three patterns, by start, then in the order of KINDS."""
    empty = F.array().cast(SPAN)
    found = [F.when(text.rlike(quick), _of_kind(_spans(text, pattern, group, least), kind)).otherwise(empty)
             for kind, (pattern, quick, group, least) in PATTERNS.items()]
    return _sorted(F.concat(*found))


def _sorted(spans: Column) -> Column:
    order = F.transform(spans, lambda s: F.struct(
        s["start"].alias("start"), F.array_position(F.array(*map(F.lit, KINDS)), s["kind"]).alias("rank"), s["end"].alias("end"), s["kind"].alias("kind")))
    return F.transform(F.array_sort(order), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))


def spans_text(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def _steps(value: Column) -> Column:
    """The transitions of a string as numbers, begin and end included."""
    edge = F.array(F.lit(SIZE - 1))
    place = F.transform(F.filter(F.split(value, ""), lambda c: c != ""), lambda c: F.instr(F.lit(ALPHABET), c))
    return F.zip_with(F.concat(edge, place), F.concat(place, edge), lambda a, b: a * SIZE + b)


def random_strings(spark: SparkSession, rows: int = RANDOM_ROWS) -> DataFrame:
    """(value, kind, held) of random strings of 20 to 43 characters, drawn by hashing row numbers; every fifth is held out."""
    digest = F.sha2(F.concat(F.lit("random-"), F.col("id").cast("string")), 512)
    plain = F.translate(F.base64(F.unhex(digest)), "\r\n=", "")
    kinds = {"hex": digest, "HEX": F.upper(digest), "base64": plain, "base64url": F.translate(plain, "+/", "-_"),
             "upper": F.translate(F.upper(plain), "+/", ""), "lower": F.translate(F.lower(plain), "+/", "")}
    value, kind = F.lit(""), F.lit("")
    for i, (name, drawn) in enumerate(kinds.items()):
        chosen = F.col("id") % len(kinds) == i
        value, kind = F.when(chosen, drawn).otherwise(value), F.when(chosen, name).otherwise(kind)
    length = F.lit(LEAST_CANDIDATE) + F.floor(F.col("id") / len(kinds)).cast("int") % 24
    return spark.range(rows).select(F.substring(value, F.lit(1), length).alias("value"), kind.alias("kind"), (F.floor(F.col("id") / len(kinds)) % 5 == 0).alias("held"))


def ordinary_strings(documents: DataFrame, text_col: str, rows: int = SAMPLE_ROWS) -> DataFrame:
    """(value, held) of the tokens of a bounded sample of rows, alone and joined, and of numbers and rulings."""
    spark = documents.sparkSession
    texts = documents.select(F.col(text_col).cast("string").alias("text")).where("text is not null").withColumn("h", F.xxhash64("text"))
    up_to = least_hash(texts.select("h"), rows)
    some = texts.where(F.col("h") <= F.lit(up_to)).groupBy("h").agg(F.first("text").alias("text"))
    outside = F.regexp_replace(F.regexp_replace("text", ASSIGN, " "), ACCESS, " ")
    tokens = F.filter(F.regexp_extract_all(outside, F.lit(r"([A-Za-z0-9+/_=-]+)"), F.lit(1)), lambda t: F.length(t) < LEAST_CANDIDATE)
    some = some.select("h", tokens.alias("w"))
    later = lambda n: F.slice(F.col("w"), n + 1, 1 << 30)
    camel = F.zip_with("w", later(1), lambda a, b: F.concat(a, F.initcap(b)))
    longer = F.zip_with(F.zip_with("w", later(1), lambda a, b: F.concat(F.initcap(a), F.initcap(b))), later(2), lambda a, b: F.concat(a, F.initcap(b)))
    whole = lambda joined: F.filter(joined, lambda x: x.isNotNull())
    sep_at = lambda i: F.substring(F.lit(SEPARATORS), (i % len(SEPARATORS) + 1).cast("int"), F.lit(1))
    fours = F.transform("w", lambda a, i: F.concat(a, *(x for n in (1, 2, 3) for x in (sep_at(i), F.get("w", i + n)))))
    parts = [F.col("w"), whole(camel), whole(longer), whole(fours)]
    from_texts = some.select((F.pmod("h", F.lit(5)) == 0).alias("held"), F.explode(F.concat(*parts)).alias("value"))
    n = F.col("id")
    digits = F.conv(F.substring(F.sha2(n.cast("string"), 256), 1, 14), 16, 10)
    sep, other = sep_at(F.floor(n / 4)), sep_at(F.floor(n / 20))
    drawn = (F.when(n % 4 == 0, F.concat(digits, F.reverse(digits)))
             .when(n % 4 == 1, F.date_format(F.timestamp_seconds(n * 86413), "yyyy-MM-dd_HH-mm-ss"))
             .when(n % 4 == 2, F.repeat(sep, 20 + (n % 40).cast("int")))
             .otherwise(F.repeat(F.concat(sep, other), 10 + (n % 20).cast("int"))))
    return from_texts.select("value", "held").unionByName(spark.range(rows).select(drawn.alias("value"), (F.pmod(F.xxhash64(n), F.lit(5)) == 0).alias("held")))


def _transitions(strings: DataFrame, name: str) -> DataFrame:
    return strings.select(F.explode(_steps(F.col("value"))).alias("step")).groupBy("step").agg(F.count(F.lit(1)).alias(name))


class Model:
    """The log-likelihood ratio of every transition, random over ordinary, and the mean ratio above which a string is random."""

    def __init__(self, ratios: list[float], threshold: float):
        self.ratios, self.threshold = ratios, threshold

    def column(self) -> Column:
        return F.split(F.lit(",".join(map(str, self.ratios))), ",").cast("array<double>")  # folded to a constant by the optimizer


def mean_ratio(value: Column, model: Column) -> Column:
    return ratio_of(value, model) / F.length(value)


def train(documents: DataFrame, text_col: str = "text", sample_rows: int = SAMPLE_ROWS, random_rows: int = RANDOM_ROWS) -> Model:
    """Transitions of random and ordinary strings, and the threshold from those held out."""
    spark = documents.sparkSession
    odd, plain = random_strings(spark, random_rows), ordinary_strings(documents, text_col, sample_rows)
    counts = spark.range(SIZE * SIZE).select(F.col("id").cast("int").alias("step"))
    counts = counts.join(_transitions(odd.where(~F.col("held")), "odd"), "step", "left").join(
        _transitions(plain.where(~F.col("held")), "plain"), "step", "left").select(
        "step", F.floor(F.col("step") / SIZE).alias("of"), F.coalesce("odd", F.lit(0)).alias("odd"), F.coalesce("plain", F.lit(0)).alias("plain"))
    total = counts.groupBy("of").agg(F.sum("odd").alias("all_odd"), F.sum("plain").alias("all_plain"))
    ratio = F.log((F.col("odd") + SMOOTH) / (F.col("all_odd") + SMOOTH * SIZE)) - F.log((F.col("plain") + SMOOTH) / (F.col("all_plain") + SMOOTH * SIZE))
    model = Model([r.ratio for r in counts.join(total, "of").select("step", F.round(ratio, 6).alias("ratio")).orderBy("step").collect()], 0.0)
    held = plain.where(F.col("held") & (F.length("value") >= LEAST_CANDIDATE)).select(F.round(mean_ratio(F.col("value"), model.column()), 6).alias("ratio"))
    model.threshold = max(0.0, held.agg(F.percentile_approx("ratio", 1 - FALSE_ALARMS, 100_000).alias("q")).first().q or 0.0)
    return model


def ratio_of(value: Column, model: Column) -> Column:
    """Log-likelihood ratio of a string under a model of ``train``."""
    return F.aggregate(_steps(value), F.lit(0.0), lambda total, step: total + F.get(model, step))


def secret_spans(documents: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The documents with ``base`` (spans of the patterns) and ``spans`` (those and the model's)."""
    own = [F.col(f"`{c}`") for c in documents.columns if c not in ("base", "spans")]
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    table = model.column()
    empty = F.array().cast(SPAN)
    places = _spans(text, CANDIDATE, 2, LEAST_CANDIDATE)
    various = lambda value: F.size(F.array_distinct(F.split(value, ""))) >= LEAST_DIFFERENT
    odd = _of_kind(F.filter(places, lambda s: various(s["value"]) & (ratio_of(s["value"], table) > F.lit(model.threshold) * F.length(s["value"]))), "markov")
    both = F.struct(base_spans(text).alias("base"),
                    F.when(text.rlike(rf"[A-Za-z0-9+/_=-]{{{LEAST_CANDIDATE}}}"), odd).otherwise(empty).alias("markov"))
    # a struct named like a result, which no column of the documents is any more
    out = documents.select(*own, both.alias("spans"))
    free = F.filter("spans.markov", lambda s: ~F.exists("spans.base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    return out.select(*own, F.col("spans.base").alias("base"), _sorted(F.concat("spans.base", free)).alias("spans"))


def redact(documents: DataFrame, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """The documents of ``secret_spans`` with every span replaced; overlapping spans become one mark."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("text"))
    text = F.col(text_col)

    def cut(state: Column, s: Column) -> Column:
        plain = F.substring(text, state["at"] + 1, F.greatest(s["start"] - state["at"], F.lit(0)))
        done = F.concat(state["text"], plain, F.when(s["start"] >= state["at"], F.lit(mark)).otherwise(F.lit("")))
        return F.struct(F.greatest(state["at"], s["end"]).alias("at"), done.alias("text"))

    cut_up = F.aggregate("spans", start, cut)
    new = F.concat(cut_up["text"], F.substring(text, cut_up["at"] + 1, F.length(text)))
    return documents.withColumn(text_col, F.when(F.size("spans") > 0, new).otherwise(text)).drop("base", "spans")
