import pytest
from pyspark.sql import functions as F

from veilquery.functions.draws import key
from veilquery.operators import corpus, detect, evaluate, labels, rewrite, surrogates, tokens

TEXT = "Mail jo@ex.com or é (743) 555-3824, IP 10.0.0.1."


def test_detects_masks_and_moves(spark):
    docs = spark.createDataFrame([(1, TEXT), (2, None), (3, "")], "doc_id long, text string")
    rows = {r.doc_id: r for r in rewrite.mask(detect.annotate(docs)).collect()}
    assert rows[1].masked_text == "Mail [EMAIL] or é [PHONE_FAX], IP [URL_IP]."
    assert all(TEXT[s.start : s.end] == s.text for s in rows[1].spans)
    assert all(rows[1].masked_text[s.start : s.end] == s.text for s in rows[1].masked_spans)
    assert rows[2].spans == [] and rows[3].masked_text == ""


def test_earlier_rule_wins_overlaps(spark):
    docs = spark.createDataFrame([(1, "1.2.3.4@a.b")], "doc_id long, text string")
    assert [s.tag for s in detect.annotate(docs).first().spans] == ["Email"]


def test_surrogate_errors(spark):
    docs = spark.createDataFrame([(1, "on INVALID here")], "doc_id long, text string").withColumn("spans", F.array(F.struct(F.lit(3).alias("start"), F.lit(10).alias("end"), F.lit("Date").alias("tag"), F.lit("INVALID").alias("text"), F.lit("").alias("surrogate"))))
    assert rewrite.apply_surrogates(docs, "ignore").first().rewritten == "on INVALID here"
    out = rewrite.apply_surrogates(docs, "coerce").first()
    assert out.rewritten == "on [Date] here" and len(out.failed) == 1
    with pytest.raises(Exception, match="No surrogate"):
        rewrite.apply_surrogates(docs, "raise").collect()


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(("text", "expected"), [("90 jaar", "89 jaar"), ("190", "89"), ("89", "89"), ("12 of 91", "12 of 89"), ("90 190", "89 89")])
def test_age(spark, text, expected):
    assert one(spark, surrogates.age(F.lit(text))) == expected


def test_generators_keep_shape(spark):
    k = key(1, "doc")
    out = one(spark, surrogates.identifier(F.lit("Ab-12 é"), k))
    assert out[2] == "-" and out[5:] == " é" and out[0].isupper() and out[1].islower() and out[3:5].isdigit()
    assert one(spark, surrogates.email(F.lit("a.b@c.com"), k)).endswith(".com")
    assert one(spark, surrogates.email(F.lit("nodot"), k))[-1] == "t"
    url = one(spark, surrogates.url(F.lit("http://www.site.nl/x"), k))
    assert url.startswith("http://www.") and ".nl/" in url
    assert one(spark, surrogates.phone(F.lit("06-12345678"), k))[:3] == "06-"
    assert one(spark, surrogates.phone(F.lit("12"), k)) is None
    assert one(spark, surrogates.zip_code(F.lit("1234 AB"), F.lit("9999ZZ"))) == "9999 ZZ"
    mapped = one(spark, surrogates.initials(F.lit("J.j."), k))
    assert mapped[0].lower() == mapped[2] and mapped[1] == mapped[3] == "."


def test_dates(spark):
    day = lambda s: F.lit(s).cast("date")
    assert str(one(spark, surrogates.shift_date(day("1921-01-01"), F.lit(85), F.lit(8)))) == "2006-01-09"
    assert str(one(spark, surrogates.shift_date(day("2016-02-29"), F.lit(1), F.lit(0)))) == "2017-02-28"
    assert str(one(spark, surrogates.within_span(day("1915-01-01"), day("2010-06-01")))) == "1921-01-01"
    # a season's last day is the day before the next one starts, so 20 June for spring
    for d, offsets in (("2020-03-22", (1, 90)), ("2018-04-24", (34, 57)), ("2018-07-07", (16, 77)), ("2018-12-21", (0, 89)), ("2019-01-07", (17, 72))):
        assert tuple(one(spark, surrogates.season_offsets(day(d)))) == offsets


def labelled(spark, names):
    return spark.createDataFrame([("d", i, i * 2, i * 2 + 1, n) for i, n in enumerate(names)], "doc string, i int, start int, end int, label string")


def test_biluo_and_repair(spark):
    rows = labels.to_biluo(labelled(spark, ["B-A", "I-A", "O", "B-B", "B-A", "I-A"])).orderBy("i").collect()
    assert [r.biluo for r in rows] == ["B-A", "L-A", "O", "U-B", "B-A", "L-A"]
    rows = labels.repair(labelled(spark, ["I-A", "I-A", "O", "I-B", "I-A"])).orderBy("i").collect()
    assert [r.fixed for r in rows] == ["B-A", "I-A", "O", "B-B", "B-A"]
    spans = labels.to_spans(labelled(spark, ["B-A", "I-A", "O", "B-B"])).orderBy("start").collect()
    assert [tuple(s)[1:] for s in spans] == [("T0", 0, 3, "A"), ("T1", 6, 7, "B")]


def test_tokens_tile_the_text(spark):
    text = "dhr. Jansen (52) kwam 13/01/2020 aan.\n\nGoed. é 漢字!"
    docs = spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")
    for language in ("plain", "nl"):
        rows = tokens.tokenize(docs, "doc_id", language=language).orderBy("i").collect()
        assert "".join(r.text for r in rows) == text
        assert all(text[r.start : r.end] == r.text for r in rows)
    assert {"dhr.", "13/01/2020"} <= {r.text for r in rows}
    shapes = {r.text: r.shape for r in tokens.flags(tokens.tokenize(docs, "doc_id")).collect()}
    assert shapes["Jansen"] == "Aaaaaa" and shapes["52"] == "##" and shapes["("] == "-"


def test_metrics(spark):
    gold = spark.createDataFrame([("a", 0, 2, "X"), ("a", 5, 7, "X"), ("b", 0, 2, "Y")], "doc string, start int, end int, tag string")
    pred = spark.createDataFrame([("a", 0, 2, "X"), ("a", 5, 8, "X"), ("b", 0, 2, "Y")], "doc string, start int, end int, tag string")
    rows = {r.class_name: r for r in evaluate.entity_level(gold, pred).collect()}
    assert (rows["overall"].tp, rows["overall"].fp, rows["overall"].fn) == (2, 1, 1)
    assert (rows["X"].precision, rows["X"].recall, rows["X"].f1) == (0.5, 0.5, 0.5)
    assert rows["overall"].f1 == 0.6667 and rows["overall"].accuracy == 0.5
    known = evaluate.scores(spark.createDataFrame([(3168, 288, 469, 0)], "tp long, fp long, fn long, tn long")).first()
    assert (known.precision, known.recall, known.accuracy, known.f1) == (0.9167, 0.871, 0.8071, 0.8933)
    empty = evaluate.token_blind(spark.createDataFrame([("O", "O")], "gold string, pred string")).first()
    assert (empty.tp, empty.f1) == (0, 0.0)
    same = evaluate.significance(gold, gold, gold, trials=20).collect()
    assert all(r.p_value == 1.0 for r in same)


def test_split_and_shuffle(spark):
    docs = spark.range(50).withColumnRenamed("id", "doc_id")
    parts = [r.part for r in corpus.split(docs, "doc_id").collect()]
    assert [parts.count(p) for p in ("train", "dev", "test")] == [30, 10, 10]
    spans = spark.createDataFrame([("a", "T", "x"), ("a", "T", "y"), ("b", "T", "z"), ("c", "U", "only")], "doc string, tag string, text string")
    rows = {(r.doc, r.text): r.surrogate for r in surrogates.corpus_shuffle(spans, 1).collect()}
    assert rows["a", "x"] == rows["a", "y"] == "z" and rows["b", "z"] in ("x", "y") and rows["c", "only"] == "only"


def test_rewrite_table_and_entries_by_hand(spark):
    spans = "array<struct<start:int,end:int,tag:string,text:string,surrogate:string>>"
    docs = spark.createDataFrame([(1, [(5, 8, "ID", "222", "999"), (0, 3, "Name", "Jan", None)]), (2, [])], f"doc_id long, spans {spans}")
    table = rewrite.rewrite_table(docs, "doc_id")
    found = [(r.doc_id, r.ann_id, r.start, r.text, r.surrogate, r.manual_surrogate, r.checked) for r in table.orderBy("start").collect()]
    assert found == [("1", "T1", 0, "Jan", None, None, False), ("1", "T2", 5, "222", "999", None, False)]
    done = rewrite.manual_first(table.withColumn("manual_surrogate", F.when(F.col("ann_id") == "T1", "Piet"))).orderBy("start").collect()
    assert [r.surrogate for r in done] == ["Piet", "999"]
