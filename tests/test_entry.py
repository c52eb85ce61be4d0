import duckdb
import pytest

import __spark_entry__
from veilquery.plans.catalogue import QUERIES
from veilquery.plans.oracle import SQL

NAMES = ["mask_documents", "detect_all", "sentence_segments", "bio_to_spans", "entity_metrics", "run_summary", "surrogate_url", "corpus_shuffle"]


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES) <= set(__spark_entry__.queries())


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("data")
    texts = [f"Text {i}. Mail a{i}@b{i % 3}.com\nor 10.0.{i}.1 and 12345678901{i:03d}. (1) {'(743) 555-3824' * (i % 2)}" for i in range(40)]
    spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)] + [(40, "", "en")], "doc_id long, text string, lang string").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, f"http://www.a{i}.example.com/x?{i}") for i in range(20)], "page_id long, url string").write.parquet(f"{path}/pages.parquet")
    return str(path)


@pytest.mark.parametrize("name", NAMES)
def test_query_agrees_with_sql(spark, small, name):
    c = duckdb.connect()
    for t in ("documents", "pages"):
        c.sql(f"create view {t} as select * from '{small}/{t}.parquet/*.parquet'")
    expected = c.sql(SQL[name]).df()
    got = QUERIES[name](spark, small).toPandas()[list(expected.columns)]
    rows = lambda df: sorted(str(tuple(f"{v:.9g}" if isinstance(v, float) else str(v) for v in r)) for r in df.itertuples(index=False))
    assert rows(got) == rows(expected)
