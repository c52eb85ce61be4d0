import duckdb

from veilquery.operators import detect, labels, tokens
from veilquery.plans.catalogue import QUERIES
from veilquery.plans.oracle import SQL


def test_spans_inside_tokens_come_back(spark, tmp_path):
    texts = ["key 97e25e5c1059743005344d08a6b96 of éa@b.com.", "1234567890123456789012345678901234 and 10.0.0.1", None, "", "x"]
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    c = duckdb.connect()
    c.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    expected = sorted(c.sql(SQL["bio_to_spans"]).fetchall())
    got = QUERIES["bio_to_spans"](spark, str(tmp_path)).select("doc_id", "ann_id", "start", "end", "tag").collect()
    assert sorted(map(tuple, got)) == expected and len(expected) == 5
    cut = tokens.labelled(detect.annotate(docs), "doc_id", {"label": "spans"}, cut=True).orderBy("doc", "i").collect()
    assert "".join(r.text for r in cut if r.doc == 0) == texts[0]
    assert labels.to_spans(tokens.labelled(detect.annotate(docs), "doc_id", {"label": "spans"})).count() < 5
