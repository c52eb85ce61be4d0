import csv
import glob
import json

import numpy as np
import pytest

from veilquery import cli
from veilquery.operators import sequence

TEXT = "de Jan Bakker was 3 mei 2001 te Groenlo. mail a@b.com"
SPANS = [("T0", "Name", 3, 13), ("T1", "Date", 18, 28), ("T2", "Email", 46, 53)]


def lines(spans, text=TEXT):
    return "".join(f"{i}\t{t} {a} {b}\t{text[a:b]}\n" for i, t, a, b in spans)


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    base = tmp_path_factory.mktemp("cli")
    for part, n in (("train", 6), ("dev", 2), ("test", 2)):
        (base / "corpus" / part).mkdir(parents=True)
        for i in range(n):
            (base / "corpus" / part / f"{part}{i}.txt").write_text(TEXT)
            (base / "corpus" / part / f"{part}{i}.ann").write_text(lines(SPANS))
    (base / "corpus" / "test" / "empty.txt").write_text("niets")
    (base / "corpus" / "test" / "empty.ann").write_text("")
    (base / "gaz").mkdir()
    alphabet = "abcdefghijklmnopqrstuvwxyz"
    (base / "gaz" / "first_names.csv").write_text("name,gender\n" + "".join(f"{c.upper()}ilia,f\n" for c in alphabet))
    (base / "gaz" / "last_names.csv").write_text("prefix,name\n" + "".join(f",{c.upper()}erman\n" for c in alphabet))
    (base / "gaz" / "addresses.csv").write_text("postcode,plaats,straat\n7141DC,Groenlo,Parallelweg\n")
    (base / "gaz" / "countries.csv").write_text("id,value\n1,Nederland\n")
    (base / "pred").mkdir()
    for i in range(2):
        (base / "pred" / f"test{i}.ann").write_text(lines(SPANS[: 2 + i]))
    (base / "pred" / "empty.ann").write_text("")
    return base


def rows(path):
    (name,) = glob.glob(f"{path}/*.csv")
    with open(name, newline="") as f:
        return list(csv.DictReader(f))


def test_evaluate(spark, folder):
    cli.main(["evaluate", f"{folder}/corpus/test", f"{folder}/corpus/test", f"{folder}/pred", f"{folder}/scores"], spark)
    found = {(r["level"], r["class_name"]): r for r in rows(f"{folder}/scores")}
    overall = found["entity", "overall"]
    assert (overall["tp"], overall["fp"], overall["fn"], overall["recall"]) == ("5", "0", "1", "0.8333")
    assert found["entity", "Email"]["f1_score"] == "0.6667" and ("blind", "ENT") in found


def test_surrogates_are_checked_and_written(spark, folder):
    cli.main(["surrogates", f"{folder}/corpus/test", f"{folder}/gaz", f"{folder}/table"], spark)
    table = rows(f"{folder}/table")
    assert len(table) == 6 and all(r["surrogate"] for r in table)
    with pytest.raises(Exception, match="(?i)exist"):
        cli.main(["surrogates", f"{folder}/corpus/test", f"{folder}/gaz", f"{folder}/table"], spark)
    cli.main(["rewrite", f"{folder}/table", f"{folder}/corpus/test", f"{folder}/rewritten"], spark)
    text, new = (folder / "rewritten" / "test0.txt").read_text(), {r["tag"]: r["surrogate"] for r in table if r["doc_id"] == "test0"}
    assert text == f"de {new['Name']} was {new['Date']} te Groenlo. mail {new['Email']}"
    for line in (folder / "rewritten" / "test0.ann").read_text().splitlines():
        _, place, piece = line.split("\t")
        _, start, end = place.split(" ")
        assert text[int(start) : int(end)] == piece
    assert (folder / "rewritten" / "empty.txt").read_text() == "niets"


def test_train_and_tag(spark, folder):
    cli.main(["train", f"{folder}/corpus", f"{folder}/model"], spark)
    cli.main(["tag", f"{folder}/corpus", f"{folder}/model", f"{folder}/tagged"], spark)
    found = spark.read.parquet(f"{folder}/tagged").where("doc = 'test1'").orderBy("start").collect()
    assert [(r.tag, r.text) for r in found][:2] == [("Name", "Jan Bakker"), ("Date", "3 mei 2001")]


def test_split_and_statistics(spark, folder):
    cli.main(["split", f"{folder}/corpus/train", f"{folder}/parts"], spark)
    assert [len(glob.glob(f"{folder}/parts/{p}/*.ann")) for p in ("train", "dev", "test")] == [3, 1, 2]
    cli.main(["statistics", f"{folder}/corpus", f"{folder}/stats"], spark)
    assert {r["tag"]: (r["train"], r["dev"], r["test"]) for r in rows(f"{folder}/stats/phi_distribution")} == {t: ("6", "2", "2") for t in ("Name", "Date", "Email")}
    assert len(rows(f"{folder}/stats/statistics")) == 2


def test_detect_and_significance(spark, folder):
    cli.main(["detect", f"{folder}/corpus", f"{folder}/found"], spark)
    assert spark.read.parquet(f"{folder}/found").where("part = 'train' and tag = 'Email'").count() == 6
    cli.main(["significance", f"{folder}/corpus/test", f"{folder}/pred", f"{folder}/corpus/test", f"{folder}/p", "--trials", "20"], spark)
    assert [r["metric"] for r in rows(f"{folder}/p")] == ["f1", "precision", "recall"]


def test_rule_tagger_and_summary_of_runs(spark, folder):
    (folder / "phrases.csv").write_text("tag,phrase\nNamed_Location,groenlo\n")
    cli.main(["tag-rules", f"{folder}/corpus", f"{folder}/runs/rules", "--phrases", f"{folder}/phrases.csv"], spark)
    found = [line.split("\t") for line in (folder / "runs" / "rules" / "test" / "test0.ann").read_text().splitlines()]
    assert [(a.split(" ")[0], t) for _, a, t in found] == [("Name", "Jan Bakker"), ("Date", "3 mei 2001"), ("Named_Location", "Groenlo"), ("URL_IP", "a@b.com")]
    cli.main(["evaluate-corpus", f"{folder}/corpus", f"{folder}/runs/rules,{folder}/corpus", f"{folder}/summary"], spark)
    (gold, rules) = rows(f"{folder}/summary/summary_test")
    assert (gold["run_id"], gold["entity_f1"], gold["token_macro_f1"]) == ("corpus", "1.0", "1.0")
    assert (rules["run_id"], rules["entity_precision"], rules["entity_recall"]) == ("rules", "0.5", "0.6667")
    assert len(rules) == 13


def test_significance_of_a_config(spark, folder):
    (folder / "sig.json").write_text(json.dumps({"gold": f"{folder}/corpus/test", "runs": [{"run_a": f"{folder}/pred", "run_b": f"{folder}/corpus/test"}, {"run_a": f"{folder}/pred", "run_b": f"{folder}/pred"}]}))
    cli.main(["significance-config", f"{folder}/sig.json", f"{folder}/sig", "--trials", "50"], spark)
    found = rows(f"{folder}/sig")
    assert len(found) == 6
    assert [float(r["p_value"]) for r in found if r["run_b"].endswith("pred")] == [1.0] * 3


def test_notes_flat_and_fine_tags(spark, folder):
    (folder / "notes.txt").write_text("\nSTART_OF_RECORD=1||||1||||\nJan is 64\n||||END_OF_RECORD\n\nSTART_OF_RECORD=1||||2||||\nniets\n||||END_OF_RECORD\n")
    (folder / "phi.txt").write_text("1 1 0 3 Name Jan\n1 1 7 9 Age 64\n")
    cli.main(["convert-notes", f"{folder}/notes.txt", f"{folder}/phi.txt", f"{folder}/notes"], spark)
    assert (folder / "notes" / "note-1-1.ann").read_text() == "T1\tName 0 3\tJan\nT2\tAge 7 9\t64\n"
    assert (folder / "notes" / "note-1-2.ann").read_text() == ""
    (folder / "tags.csv").write_text("fine,coarse\nAge,Number\n")
    cli.main(["flatten", f"{folder}/notes", f"{folder}/tags.csv", f"{folder}/flat"], spark)
    assert "T2\tNumber 7 9\t64" in (folder / "flat" / "note-1-1.ann").read_text()
    cli.main(["unflatten", f"{folder}/flat", f"{folder}/notes", f"{folder}/tags.csv", f"{folder}/fine"], spark)
    assert (folder / "fine" / "note-1-1.ann").read_text() == (folder / "notes" / "note-1-1.ann").read_text()


def test_hold_out(spark, folder):
    for part, n in (("xtrain", 6), ("xtest", 1)):
        (folder / part).mkdir()
        for i in range(n):
            (folder / part / f"{i}.xml").write_text(f'<?xml version="1.0"?>\n<deIdi2b2>\n<TEXT><![CDATA[Jan is {i}]]></TEXT>\n<TAGS>\n<NAME id="P0" start="0" end="3" text="Jan" TYPE="PATIENT" comment="" />\n</TAGS>\n</deIdi2b2>')
    cli.main(["hold-out", f"{folder}/xtrain", f"{folder}/xtest", f"{folder}/held"], spark)
    assert [len(glob.glob(f"{folder}/held/{p}/*.txt")) for p in ("train", "dev", "test")] == [4, 2, 1]


def test_models_are_plain_tables(spark, folder):
    model = sequence.Model(["B-X", "O"], {"a": 0, "b": 1}, np.array([[1.0, 2], [3, 4]]), np.arange(6.0).reshape(3, 2), "wide")
    cli.save_model(spark, model, f"{folder}/plain")
    again = cli.load_model(spark, f"{folder}/plain")
    assert (again.labels, again.rows, again.features) == (model.labels, model.rows, "wide")
    assert np.array_equal(again.weights, model.weights) and np.array_equal(again.pairs, model.pairs)
    with pytest.raises(ValueError, match="No model"):
        spark.range(2).write.parquet(f"{folder}/nothing")
        cli.load_model(spark, f"{folder}/nothing")
