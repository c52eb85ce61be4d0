import pytest

from veilquery.sources import standoff
from veilquery.streaming.mask import mask_stream


def corpus(tmp_path):
    for part, files in {"train": {"a.txt": "Jan is\r\nhier", "a.ann": "T1\tName 0 3\tJan\nT2 Date 1 x;2 3 bad\n#note\nT3 Place 8 12 hier\n", "b.txt": "alone"}, "dev": {"c.txt": "", "c.ann": ""}, "test": {"d.txt": "x", "d.ann": ""}}.items():
        (tmp_path / part).mkdir()
        for name, data in files.items():
            (tmp_path / part / name).write_bytes(data.encode())
    return str(tmp_path)


def test_reads_and_writes_standoff(spark, tmp_path):
    rows = {r.doc: r for r in standoff.corpus(spark, corpus(tmp_path)).collect()}
    assert set(rows) == {"a", "c", "d"}
    assert rows["a"].text == "Jan is\r\nhier"
    assert [(s.tag, s.start, s.end, s.text) for s in rows["a"].annotations] == [("Name", 0, 3, "Jan"), ("Place", 8, 12, "hier")]
    assert rows["c"].text == ""
    out = str(tmp_path / "out")
    standoff.write(standoff.corpus(spark, str(tmp_path)), out)
    assert (tmp_path / "out" / "a.ann").read_text() == "T1\tName 0 3\tJan\nT3\tPlace 8 12\thier\n"
    assert (tmp_path / "out" / "a.txt").read_bytes() == b"Jan is\r\nhier"


def test_pairs_must_agree(spark):
    make = lambda *names: spark.createDataFrame([(n,) for n in names], "doc string")
    standoff.check_pairs(make("a", "b"), make("b", "a"))
    for left, right in ((make("a"), make("b")), (make(), make())):
        with pytest.raises(ValueError, match="different"):
            standoff.check_pairs(left, right)


def test_other_formats(spark, tmp_path):
    (tmp_path / "notes").write_text("\nSTART_OF_RECORD=1||||2||||\nSome text\n\n||||END_OF_RECORD\n\nSTART_OF_RECORD=1||||3||||\nMore\n||||END_OF_RECORD\n")
    assert sorted(map(tuple, standoff.notes(spark, str(tmp_path / "notes")).collect())) == [("note-1-2", "Some text"), ("note-1-3", "More")]
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "9.xml").write_text('<deIdi2b2><TEXT><![CDATA[\n 2067-05-03 Jan]]></TEXT><TAGS><DATE id="P0" start="2" end="12" text="2067-05-03" TYPE="DATE" comment=""/></TAGS></deIdi2b2>')
    row = standoff.xml(spark, str(tmp_path / "x")).first()
    assert row.doc == "doc-9" and row.text[2:12] == "2067-05-03"
    assert tuple(row.annotations[0]) == (2, 12, "DATE:DATE", "2067-05-03", "T0")
    assert standoff.config(["[entities]", "A", "!group", "# no", "", "[relations]", "B"]) == {"entities": ["A"], "relations": ["B"]}


def test_masks_a_stream(spark, tmp_path):
    spark.createDataFrame([(1, "jo@ex.com")], "doc_id long, text string").write.parquet(str(tmp_path / "in"))
    query = mask_stream(spark, str(tmp_path / "in"), "doc_id long, text string").writeStream.format("memory").queryName("masked").trigger(availableNow=True).start()
    query.awaitTermination()
    assert [tuple(r) for r in spark.sql("select doc_id, masked_text from masked").collect()] == [(1, "[EMAIL]")]
