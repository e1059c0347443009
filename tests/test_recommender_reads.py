"""What a query reads of the recommender's tables: little is shuffled of a model that is far larger than the questions."""

import pytest
from pyspark.sql import functions as F

from smsight.functions import text as T
from smsight.functions.regex import SPACE, SPACES
from smsight.operators import recommender as R
from smsight.session import written
from smsight.sources import tables


def shuffles_of(df) -> list[str]:
    """What lies below each exchange, first operator only."""
    lines = df._jdf.queryExecution().executedPlan().toString().split("\n")
    return [lines[i + 1] for i, line in enumerate(lines[:-1]) if "Exchange hashpartitioning" in line]


@pytest.fixture
def unbroadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_maybe_keeps_what_is_asked_and_little_else(spark, unbroadcast):
    rows = spark.range(20000).select(F.lit("fr").alias("lang"), F.concat(F.lit("w"), F.col("id")).alias("word"))
    asked = rows.where("word LIKE 'w1234%'")
    kept = R._maybe(rows, asked, ["lang", "word"])
    assert asked.join(kept, ["lang", "word"], "left_anti").count() == 0 and asked.count() <= kept.count() <= asked.count() + 50
    assert R._maybe(rows, asked.where("false"), ["lang", "word"]).count() == 0


def test_large_tables_are_screened_before_any_shuffle(spark, unbroadcast, tmp_path):
    grams = written(spark.range(50000).selectExpr("'fr' lang", "'a' w1", "concat('b', id) w2", "'c' w3", "id n"), "grams")
    keys = written(spark.createDataFrame([("fr", "a", "b7")], "lang string, w1 string, w2 string"), "keys")
    found = R._maybe(grams, keys, keys.columns).join(keys, keys.columns, "left_semi")
    assert "BroadcastHashJoin" in found._jdf.queryExecution().executedPlan().toString()
    assert found.collect() == [("fr", "a", "b7", "c", 7)]
    words = written(spark.range(3000).selectExpr("'fr' lang", "concat('mot', id) word", "id freq"), "words")
    prefixes = spark.createDataFrame([("fr", "mot12"), ("fr", "mox129"), ("fr", "zzz"), (None, "mot1")], "lang string, prefix string")
    got = [(r.prefix, r.word, r.dist) for r in R.completions(prefixes, words, 2).orderBy("prefix", "rank").collect()]
    assert got == [("mot12", "mot1299", 0), ("mot12", "mot1298", 0), ("mox129", "mot129", 1)]


def test_best_followers_are_picked_before_the_shuffle(spark):
    rows = [("fr", "a", "b", f"w{i:03d}", 1 + i % 7) for i in range(200)] + [("fr", "a", "c", "x", 1), ("ar", "a", "b", "y", 2)]
    trigrams = written(spark.createDataFrame(rows, "lang string, w1 string, w2 string, w3 string, n long"), "trigrams")
    lists = R.trigram_lists(trigrams, 3)
    assert "WindowGroupLimit" in lists._jdf.queryExecution().executedPlan().toString().split("Partial")[0]
    got = {(r.lang, r.w2): [(b.word, b.prob) for b in r.best] for r in lists.collect()}
    total = sum(r[4] for r in rows[:200])
    assert got == {("fr", "b"): [(w, 7 / total) for w in ("w006", "w013", "w020")], ("fr", "c"): [("x", 1.0)], ("ar", "b"): [("y", 1.0)]}


def test_continuation_is_summed_from_saved_bigrams(spark, tmp_path):
    docs = lambda: spark.createDataFrame([("fr", "a b c b"), ("fr", "b"), ("en", "a b")], "lang string, text string")
    tables.extend_recommender(spark, str(tmp_path), docs, ["bigrams", "continuation"])
    read = lambda name: {(r.lang, r.word): r.n for r in tables.load_table(spark, str(tmp_path), name).collect()}
    assert read("continuation") == {("fr", "b"): 2, ("fr", "c"): 1, ("en", "b"): 1}
    assert all(f.name.endswith(".zstd.parquet") for f in tmp_path.glob("bigrams/lang=*/part-*"))


def test_language_and_blanks_as_by_patterns(spark):
    texts = ["", " ", "le la the", "the and le", "the,and of le la les", "wach x", "x wach", "xwach", " the of　", "Le\x1cTHE\x85the",
             "مرحبا", "abc مر", "de\nde\r\nthe the\n", "  a b \x0b ", " x  y ", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", T.detect_language("t").alias("lang"), F.btrim("t", F.lit(SPACES)).alias("cut"),
                       F.regexp_replace("t", f"^{SPACE}+|{SPACE}+$", "").alias("same")).collect():
        words = (r.t or "").lower()
        for c in SPACES:
            words = words.replace(c, "|")
        words = words.split("|")
        votes = lambda of: sum(w in of for w in words)
        arabic = sum("؀" <= c <= "ۿ" for c in r.t or "") > len(r.t or "") * T.V.ARABIC_SHARE
        english = votes(T.V.ENGLISH_STOP_WORDS) > votes(T.V.FRENCH_STOP_WORDS)
        assert r.lang == ("ar" if arabic or votes(T.V.DARIJA_WORDS) else "en" if english else "fr"), r.t
        assert r.cut == r.same
