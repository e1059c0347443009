"""Texts are searched only where a cheap test says that something can be found."""

from pyspark.sql import functions as F

from smsight.functions import text as T
from smsight.functions.regex import any_phrase
from smsight.operators import classify


def test_arabic_signs_between_words_stay(spark):
    given = ["ab،cd 1234،98765432 21698765432", "x 1234567 123456789 12a4 ١٢٣٤", "a—b s+1 e-dinar www.x", "bit.ly/x 50dt", "\n1234", "_1234_", "carte،x", ""]
    df = spark.createDataFrame(list(enumerate(given)), "i int, message string")
    assert [r[0] for r in df.orderBy("i").select(T.normalize_message("message")).collect()] == [
        "ab،cd CODE ، CODE TEL", "x CODE 123456789 12a4 CODE", "a b IMMO_KW BANK_KW URL", "URL MONTANT", "CODE", "_1234_", "BANK_KW ،x", ""]


def test_addresses_are_searched_only_where_signs_of_them_are(spark):
    plan = spark.range(1).select(T.normalize_message(F.col("id").cast("string")))._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "contains(" in plan


def test_one_scan_says_whether_any_rule_has_a_phrase(spark):
    given = ["votre code est", "bonjour", "gratuit-50%x", "suivi colis 12", "rdv chez le médecin", "aid mabrouk", "xcodex", "", "otp"]
    df = spark.createDataFrame([(t,) for t in given], "t string")
    each = F.lit(False)
    for phrases in classify.CASCADE_PHRASES:
        each = each | F.col("t").rlike(any_phrase(phrases))
    rows = df.select(classify.has_phrase(F.col("t")), each).collect()
    assert all(a == b for a, b in rows) and {a for a, _ in rows} == {True, False}


def test_signs_and_words_are_counted(spark):
    df = spark.createDataFrame([("a!!? ؟ ?", "IMMO_KW b IMMO_KW TEL_KW"), ("", ""), (None, "x")], "message string, message_clean string")
    rows = T.manual_text_features(df).select("num_exclamation", "num_question", "num_immo_kw", "num_tel_kw", "len_words").collect()
    assert [tuple(r) for r in rows] == [(2, 2, 2, 1, 4), (0, 0, 0, 0, 0), (None, None, 0, 0, 1)]
