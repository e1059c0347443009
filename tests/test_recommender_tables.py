"""The recommender's tables: trained one by one, names masked before anything is counted."""

from collections import Counter

from smsight.operators import recommender as R
from smsight.plans import queries as Q
from smsight.sources import tables


def corpus(spark, folder):
    texts = ["le train de Paris part le matin", "le train de Paris part le soir", "la fin", "seul"] * 2
    rows = [(i, f"{t} {i}", "fr", "s", len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")


def test_only_asked_tables_are_trained(spark, tmp_path):
    corpus(spark, tmp_path)
    assert Q.QUERIES["lexicon"](spark, str(tmp_path)).count() > 0
    assert Q._words(spark, str(tmp_path)).count() > 0
    path = Q._TRAINED[list(Q._TRAINED)[-1]]
    assert tables.folder_names(spark, path) == ["lexicon"]
    assert Q.QUERIES["bigrams"](spark, str(tmp_path)).count() > 0
    assert tables.folder_names(spark, path) == ["bigrams", "lexicon", "names", "texts"]
    assert Q._TRAINED[list(Q._TRAINED)[-1]] == path
    words, model = Q._trained(spark, str(tmp_path))
    assert set(tables.folder_names(spark, path)) == {"texts", *tables.RECOMMENDER_TABLES}
    assert words.count() > 0 and model.positions.count() > 0


def test_counts_equal_a_plain_loop(spark):
    texts = ["a Bob b", "a Bob c", "b a Bob", "x", "a b a b a", ""]
    docs = spark.createDataFrame([(None if t == "x" else "fr", t, t.lower().split()) for t in texts], "lang string, text string, tokens array<string>")
    names = spark.createDataFrame([("fr", "bob")], "lang string, word string")
    model = R.count_ngrams(docs, names)
    expected = {n: Counter() for n in (1, 2, 3)}
    continued, positions = Counter(), Counter()
    for t in texts:
        lang = None if t == "x" else "fr"
        words = ["@prenom" if w == "bob" else w for w in t.lower().split()]
        for n in expected:
            expected[n].update((lang, *words[i:i + n]) for i in range(len(words) - n + 1))
        positions.update((lang, *(words + [None, None])[i:i + 3]) for i in range(len(words)))
        continued.update((lang, w) for w in words[1:])
    counted = lambda df, *by: {tuple(r[c] for c in ("lang", *by)): r.n for r in df.collect()}
    assert counted(model.unigrams, "word") == expected[1]
    assert counted(model.bigrams, "w1", "w2") == expected[2]
    assert counted(model.trigrams, "w1", "w2", "w3") == expected[3]
    assert counted(model.continuation, "word") == continued
    assert counted(model.positions, "w1", "w2", "w3") == positions


def test_names_are_masked_before_the_only_shuffle(spark):
    docs = spark.createDataFrame([("fr", "a b c", ["a", "b", "c"])], "lang string, text string, tokens array<string>")
    names = spark.createDataFrame([("fr", "b")], "lang string, word string")
    plan = R.count_ngrams(docs, names, drop_leaked=False).trigrams._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "SortMergeJoin" not in plan


def test_long_texts_are_dealt_over_more_tasks(spark):
    docs = spark.range(100, numPartitions=2).selectExpr("repeat('word ', 100) AS text")
    assert R.spread(docs, chars=5000).rdd.getNumPartitions() == 10 and R.spread(docs).rdd.getNumPartitions() == 2
