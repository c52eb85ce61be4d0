import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from veilquery.operators import corpus, labels, markup, plug, sequence, tagger, tokens
from veilquery.sources import standoff

TEXT = (
    "Dit is stukje tekst met daarin de naam Jan Jansen. De patient J. Jansen (e: j.jnsen@email.com, t: 06-12345678) is 64 jaar oud en woonachtig in Utrecht. "
    "Hij werd op 10 oktober door arts Peter de Visser ontslagen van de kliniek van het UMCU."
)


def spans(rows, column="spans"):
    return [(s.text, s.start, s.end, s.tag) for s in rows.first()[column]]


def test_nine_spans_of_a_note(spark):
    docs = spark.createDataFrame([(1, TEXT)], "id int, text string")
    found = tagger.annotate(docs)
    assert spans(found) == [
        ("Jan Jansen", 39, 49, "PERSOON"),
        ("patient J. Jansen", 54, 71, "PERSOON"),
        ("j.jnsen@email.com", 76, 93, "URL"),
        ("06-12345678", 98, 109, "TELEFOONNUMMER"),
        ("64", 114, 116, "LEEFTIJD"),
        ("Utrecht", 143, 150, "LOCATIE"),
        ("10 oktober", 164, 174, "DATUM"),
        ("Peter de Visser", 185, 200, "PERSOON"),
        ("UMCU", 234, 238, "INSTELLING"),
    ]
    done = found.select(tagger.rewritten(F.col("spans"), F.col("text")).alias("spans"))
    assert spans(done)[1] == ("J. Jansen", 62, 71, "Name")
    assert {t for *_, t in spans(done)} == {"Name", "URL_IP", "Phone_fax", "Age", "Address", "Date", "Named_Location"}


def test_more_kinds_and_odd_texts(spark):
    texts = ["=== Report: 1234567 ===\nMevr. de Groot, 12-03-2020 of 2020-03-12, Kerkstraat 12, 1234 AB Ede, +31 6 12345678, https://a.nl/x.", None, "", "mevr.", "é" * 5000]
    docs = spark.createDataFrame(list(enumerate(texts)), "id int, text string").selectExpr("*", "'x' as spans")
    rows = {r.id: r.spans for r in tagger.annotate(docs).collect()}
    assert [(s.text, s.tag) for s in rows[0]] == [
        ("1234567", "PATIENTNUMMER"), ("Mevr. de Groot", "PERSOON"), ("12-03-2020", "DATUM"), ("2020-03-12", "DATUM"), ("Kerkstraat 12", "LOCATIE"), ("1234 AB", "LOCATIE"), ("Ede", "LOCATIE"),
        ("+31 6 12345678", "TELEFOONNUMMER"), ("https://a.nl/x", "URL"),
    ]
    assert not any(rows[i] for i in (1, 2, 3, 4))
    assert all(texts[0][s.start : s.end] == s.text for s in rows[0])


def test_rewriting(spark):
    text = "=== Answer: 1234567 ===\nDhr. Dhr. Jansen, mevr., nr 7654321"
    at = lambda word, tag: (text.index(word), text.index(word) + len(word), tag, word)
    found = [at("1234567", "PATIENTNUMMER"), at("Dhr. Dhr. Jansen", "PATIENT"), at("mevr.", "PERSOON"), at("7654321", "PATIENTNUMMER")]
    docs = spark.createDataFrame([(text, found)], "text string, spans array<struct<start:int,end:int,tag:string,text:string>>")
    out = docs.select(tagger.rewritten(F.col("spans"), F.col("text")).alias("spans"))
    assert spans(out) == [("Jansen", text.index("Jansen"), text.index("Jansen") + 6, "Name"), ("7654321", text.index("7654321"), text.index("7654321") + 7, "ID")]
    with pytest.raises(PySparkException):
        docs.select(tagger.mapped(F.col("spans"), {"PATIENT": "Name"})).collect()


def test_dictionary_of_institutions(spark):
    docs = spark.createDataFrame([(1, "Naar De Linde, zorgcentrum de  LINDE-hof en De linde."), (2, None), (3, "")], "id int, text string")
    known = spark.createDataFrame([("A", "de linde"), ("B", "zorgcentrum De Linde-hof"), ("C", "?"), ("D", "De Linde")], "tag string, phrase string")
    found = sorted(tuple(r) for r in tagger.dictionary(docs, known, "id").collect())
    assert [(f[1], f[3], f[4]) for f in found] == [(5, "A", "De Linde"), (15, "B", "zorgcentrum de  LINDE-hof"), (44, "A", "De linde")]
    assert tagger.dictionary(docs.limit(0), known, "id").collect() == []


def test_markup(spark):
    rows = [(1, "x <PERSOON <LOCATIE Laverhof >Ondersteuning Thuis> y"), (2, "a < b > c <ID 12>"), (3, None), (4, "<PERSOON >")]
    out = {r.id: r for r in markup.unmark(spark.createDataFrame(rows, "id int, marked string")).collect()}
    assert out[1].text == "x Laverhof Ondersteuning Thuis y"
    assert [tuple(s) for s in out[1].spans] == [(2, 30, "PERSOON", "Laverhof Ondersteuning Thuis")]
    assert (out[2].text, [tuple(s) for s in out[2].spans]) == ("a < b > c 12", [(10, 12, "ID", "12")])
    assert (out[3].text, out[3].spans, out[4].spans) == (None, [], [])


def test_plugged_tagger(spark):
    docs = spark.createDataFrame([(i, f"nr {i} é") for i in range(20)] + [(20, None)], "id int, text string")
    load = lambda: lambda texts: [[(3, 4, "ID")] if t else [] for t in texts]
    out = plug.annotate(docs, load, ["ID"], batch=3).collect()
    assert [[tuple(s) for s in r.spans] for r in sorted(out)] == [[(3, 4, "ID", str(i)[0])] for i in range(20)] + [[]]
    for wrong in (lambda: lambda texts: [], lambda: lambda texts: [[(0, 99, "ID")] for _ in texts], lambda: lambda texts: [[(0, 1, "X")] if t else [] for t in texts]):
        with pytest.raises(PySparkException):
            plug.annotate(docs, wrong, ["ID"]).collect()


def test_named_features():
    words = ["De", "patient", "Ingmar", "Koopal", "(", "t", ":", "06", "-", "16769063", ")"]
    pos = ["DET", "NOUN", "NOUN", "PROPN", "PUNCT", "NOUN", "PUNCT", "NUM", "PUNCT", "NUM", "PUNCT"]
    kinds = [None, None, "PER", "PER", *[None] * 7]
    f = sequence.described(words, pos, kinds)[2]
    assert len(f) == 56
    assert [f[f"bow[-2:2].tri.{k}"] for k in range(3)] == ["de|patient|ingmar", "patient|ingmar|koopal", "ingmar|koopal|("]
    assert [f[f"pos[-2:2].bi.{k}"] for k in range(4)] == ["DET|NOUN", "NOUN|NOUN", "NOUN|PROPN", "PROPN|PUNCT"]
    assert (f["bowpos.w0p-1p1"], f["bowpos.w0p-1p0p1"], f["bowpos.w0p0"]) == ("ingmar|NOUN|PROPN", "ingmar|NOUN|NOUN|PROPN", "ingmar|NOUN")
    assert (f["sent.len(sent)"], f["sent.end_mark"], f["sent.has_unmatched_bracket"]) == (11, False, False)
    assert (f["suffix[-5:]"], f["prefix[:4]"], f["shape.long"], f["shape.short"], f["word.ner_tag"], f["word.pos_tag"]) == ("ngmar", "ingm", "Aaaaaa", "Aa", "PER", "NOUN")
    assert [f[k] for k in ("word.istitle()", "word.isupper()", "word.isdigit()", "word.is_ascii", "word.contains_digit", "word.has_upper_inside", "word.has_punct_inside")] == [True, False, False, True, False, False, False]
    edge = sequence.described_briefly(["A\n", "b "], ["X", "YZW"])
    assert edge[0]["BOS"] is True
    assert (edge[0]["word.lower()"], edge[0]["+1:word.lower()"], edge[0]["+1:pos_tag[:2]"], edge[1]["-1:word.istitle()"]) == ("a#NEWLINE", "b#SPACE", "YZ", True)
    assert edge[1]["EOS"] is True


def test_flags_follow_unicode_case(spark):
    words = ["D'Arc", "Özlem", "McDonald", "ABC", "É", "abc", "12", "a1", "A-B", "漢", "Ab c", "", "ẞa", "x!", "!x"]
    rows = tokens.flags(spark.createDataFrame([(w,) for w in words], "text string")).collect()
    for r in rows:
        assert (r.is_title, r.is_upper, r.is_digit) == (r.text.istitle(), r.text.isupper(), r.text.isdigit()), r.text
        assert r.mark_inside == any(c in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~" for c in r.text[1:])


def test_dutch_tokens(spark):
    texts = ["=== Answer: 1234 ===\ntest a b c d.\n=== Report: 1234 ===\nMw. test etc. x", "GRZ(12-12-2020).", "Groot/Kempers", "13/01/2020", "B.Sc. o.k. O.K. v.d. MW. a.u.b."]
    docs = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    found = {}
    for r in sorted(tokens.tokenize(docs, "id", language="nl").collect()):
        found.setdefault(r.doc, []).append(r.text)
    plain = lambda i: [t for t in found[i] if t != " "]
    assert plain(0) == ["=== Answer: 1234 ===\n", "test", "a", "b", "c", "d.", "\n", "=== Report: 1234 ===\n", "Mw.", "test", "etc.", "x"]
    assert (plain(1), plain(2), plain(3)) == (["GRZ", "(", "12-12-2020", ")", "."], ["Groot", "/", "Kempers"], ["13/01/2020"])
    assert plain(4) == ["B.Sc.", "o.k.", "O.K.", "v.d.", "MW", ".", "a.u.b."]


def test_labels_beside_spans_equal_joined_ones(spark):
    docs = spark.createDataFrame([(1, "Jan Jansen is 64, in Ede"), (2, None), (3, "x")], "id int, text string")
    given = [(1, 0, 10, "Name"), (1, 4, 10, "Other"), (1, 14, 16, "Age"), (1, 21, 23, "Bad"), (3, 0, 1, "Y")]
    rows = spark.createDataFrame(given, "doc int, start int, end int, tag string")
    per = rows.groupBy(F.col("doc").alias("id")).agg(F.collect_list(F.struct("start", "end", "tag")).alias("spans"))
    fast = tokens.labelled(docs.join(per, "id", "left"), "id", {"label": "spans"})
    slow = labels.encode(tokens.tokenize(docs, "id"), rows)
    assert sorted(fast.select("doc", "i", "label").collect()) == sorted(slow.select("doc", "i", "label").collect())
    assert [s.tag for s in sorted(labels.to_spans(fast).collect())] == ["Name", "Age", "Y"]


def test_sentences_that_start_inside_an_entity(spark):
    rows = [(1, i, s, x) for i, (s, x) in enumerate([(0, "O"), (0, "B-A"), (1, "I-A"), (1, "O"), (2, "B-A"), (3, "L-A"), (4, "O")])] + [(2, 0, 0, "I-B"), (2, 1, 1, "O")]
    out = labels.sentences_merged(spark.createDataFrame(rows, "doc int, i int, sent_id int, label string"))
    assert [r.sent_id for r in out.orderBy("doc", "i").collect()] == [0, 0, 0, 0, 1, 1, 2, 0, 0]


def test_spaces_and_escapes(spark):
    rows = spark.createDataFrame([("a b", "B-X"), (" ", "B-X"), ("\n\t", "O"), ("<SPACE>", "I-X")], "text string, label string")
    assert [r[0] for r in rows.select(tokens.space_renamed(F.col("text"))).collect()] == ["a b", "<SPACE>", "<SPACE>", "<SPACE>"]
    assert [r.label for r in tokens.space_forced(rows).collect()] == ["B-X", "O", "O", "O"]
    assert [r[0] for r in rows.select(tokens.escaped(F.col("text"))).collect()] == ["a#SPACEb", "#SPACE", "#NEWLINE#SPACE", "<SPACE>"]


def test_holdout_rounds_up(spark):
    for n in (0, 1, 5, 11):
        rows = corpus.holdout(spark.range(n), "id").collect()
        assert (len(rows), sum(r.part == "dev" for r in rows)) == (n, -(-n // 5))


def test_phrases_of_nursing_notes(spark, tmp_path):
    (tmp_path / "phi.txt").write_text("1 1 3 8 Name Jan de Wit\n1 2 0 4 Date 1999\n\n1 1 0 2 Age 64\n")
    found = standoff.phrases(spark, str(tmp_path / "phi.txt"))
    assert sorted(map(tuple, found.collect())) == [("note-1-1", "T1", "Age", 0, 2, "64"), ("note-1-1", "T2", "Name", 3, 8, "Jan de Wit"), ("note-1-2", "T1", "Date", 0, 4, "1999")]
    docs = spark.createDataFrame([("note-1-1", "x"), ("note-9-9", "y")], "doc string, text string")
    assert {r.doc: len(r.annotations) for r in standoff.with_annotations(docs, found).collect()} == {"note-1-1": 2, "note-9-9": 0}
