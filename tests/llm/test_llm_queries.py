"""The registered queries over the smallest tables, beside their SQL where there is one."""

import pytest

from oracle_check import compare, connect

from smsight.llm.oracles import SQL
from smsight.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"


def test_one_query_for_each_operator():
    assert [int(name[2:].split("_")[0]) for name in QUERIES] == list(range(1, len(QUERIES) + 1))
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, name):
    assert compare(QUERIES[name](spark, FOLDER).toPandas(), connect(FOLDER).execute(SQL[name]).df()) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_one_row_for_each_input_row(spark, name):
    source = "pages" if name.startswith(("op4", "op6")) else "documents"
    key = "page_id" if source == "pages" else "doc_id"
    ids = [r[0] for r in QUERIES[name](spark, FOLDER).select(key).collect()]
    assert sorted(ids) == sorted(r[0] for r in spark.read.parquet(f"{FOLDER}/{source}.parquet").select(key).collect())
