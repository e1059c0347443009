from pyspark.sql import functions as F

from smsight.functions import text as T
from smsight.functions.regex import one_of, whole_word
from smsight.operators import classify


def texts(spark, *values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, message string")


def column(df, expr):
    return [r[0] for r in df.orderBy("i").select(expr).collect()]


def test_normalize(spark):
    df = texts(spark, "Solde: 120,5 DT, code 1234!", "98765432", "Mabrouk lel jami3", "e-dinar s+1 été", None, "بطاقة")
    assert column(df, T.normalize_message("message")) == [
        "BANK_KW MONTANT code CODE", "CODE", "FELICITATIONS lel jami3", "BANK_KW IMMO_KW été", "", "BANK_KW"]


def test_word_borders_are_unicode(spark):
    df = texts(spark, "crédité", "crédit", "dar", "dare", "éa")
    assert column(df, F.col("message").rlike(whole_word(["crédit", "dar", "a"]))) == [False, True, True, False, False]


def test_one_of_keeps_order_inside_a_letter(spark):
    df = texts(spark, "abc", "zx+1", "xx1", "b")
    found = F.regexp_extract("message", one_of(["ab", "abc", "x+1"]), 0)
    assert column(df, found) == ["ab", "x+1", "", ""]


def test_cascade(spark):
    df = texts(
        spark, "Votre code est 1234", "retrait: code 1234", "aid mabrouk", "suivi colis 12", "rdv chez le médecin",
        "bonjour", "gratuit-50%x", "la carte : retrait de 5 dt ok", "", "un forfait bien", "forfait")
    rows = classify.classify_messages(df).orderBy("i").collect()
    assert [(r.nlp_type, r.nlp_domaine) for r in rows] == [
        ("OTP", "Banque"), ("Information", "Support"), ("Felicitation", "Marketing"), ("Livraison", "Logistique"),
        ("Rappel", "Santé"), ("Information", "Support"), ("Promotion", "Marketing"), ("Transaction", "Banque"),
        ("Information", "Support"), ("Information", "Télécom"), ("Information", "Support")]


def test_user_rules(spark):
    df = texts(spark, "HELLO there", "nothing")
    out = classify.classify_messages(df, rules=[("Greeting", lambda c: c.contains("hello"))]).orderBy("i")
    assert [r.nlp_type for r in out.collect()] == ["Greeting", "Information"]


def test_word_rules_need_one_line(spark):
    df = texts(spark, "votre code", "votre\ncode")
    out = classify.classify_messages(df, rules="words").orderBy("i")
    assert [r.nlp_type for r in out.collect()] == ["OTP", "Information"]


def test_pages_and_variables(spark):
    df = texts(spark, "", "a" * 160, "a" * 161, "ع" * 71, "@nom et @nom, @x_1")
    assert column(df, T.sms_pages("message")) == [0, 1, 2, 2, 1]
    assert column(df, T.template_variables("message"))[4] == ["@nom", "@x_1"]


def test_signals(spark):
    row = T.text_signals(texts(spark, "URGENT: code otp, expire maintenant")).first()
    assert (row.urgency_score, row.is_urgent_high, row.is_otp, row.is_sensitive, row.is_promo) == (1.0, 1, 1, 1, 0)


def test_language(spark):
    df = texts(spark, "مرحبا بك", "wach rak", "the cat and the dog", "le chat et la souris", "xyz")
    assert column(df, T.detect_language("message")) == ["ar", "ar", "en", "fr", "fr"]


def test_tokenize(spark):
    df = texts(spark, "L'été, 2 fois!", "", "...")
    assert column(df, T.tokenize("message")) == [["l", "été", "2", "fois"], [], []]
