"""From raw documents to a mixed training order: filter, de-duplicate, decontaminate, redact, interleave.

Every stage takes what its predecessor kept. All but the last return the columns of ``documents``; the last adds the place
in the mix. No SQL counterpart: classification and scheduling have none, so stages are tested against plain versions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from smsight.llm import decontaminate, jaccard_join, mixing, secrets, toxicity
from smsight.llm.frames import table, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below a half; labels are those of the training rows of op9."""
    docs = docs.select(*COLUMNS)
    learn = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5, F.lit(0)) != 0
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), learn)
    return toxicity.toxicity(docs, model).where("score < 0.5").select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each component at five words and 0.8; documents without words stay.

    Rows that share an id, or have none, are told apart by their texts; of a component one row stays, whose id is the least
    (a null one only where there is no other), and rows with that id and text become one.
    """
    docs = docs.select(*COLUMNS)
    found = jaccard_join.jaccard_components(docs, size=5, percent=80, keys=True)
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))  # of a null id: the empty string, which no id is
    first = found.where("first").select(key.alias("key"), "tkey").distinct()
    wordless = found.where("n_shingles = 0").select("tkey").distinct()
    keyed = docs.withColumn("tkey", F.xxhash64("text"))
    # one exchange of the texts serves the join and the removal of identical rows
    kept = keyed.withColumn("key", key).join(first, ["key", "tkey"], "left_semi").dropDuplicates(["key", "tkey"])
    return kept.select(*COLUMNS).unionByName(keyed.join(wordless, "tkey", "left_semi").select(*COLUMNS))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item."""
    hits = decontaminate.benchmark_hits(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))
    return hits.where(F.size("hit_words") == 0).select(*COLUMNS)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced and ``n_chars`` of the new text where it changed."""
    docs = docs.select(*COLUMNS)
    found = secrets.secret_spans(docs, secrets.train(docs)).withColumn(
        "n_chars", F.when(F.size("spans") > 0, F.lit(None)).otherwise(F.col("n_chars")))
    clean = secrets.redact(found)
    return clean.withColumn("n_chars", F.coalesce("n_chars", F.length("text").cast("bigint"))).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with its place in a mix by square-root weights of the sources."""
    return mixing.mix(docs.select(*COLUMNS))


STAGES = [
    ("toxicity", drop_toxic),
    ("jaccard_join", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("secret_scans", redact_secrets),
    ("mixing", mix_sources),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
