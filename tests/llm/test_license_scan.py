import math
import random
import re

import pytest

from veilquery.llm import license_scan

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def base(text):
    w = words(text)
    return len(w), sorted((i, label) for p, label in license_scan.PHRASES for i in range(len(w)) if w[i : i + len(p.split())] == p.split())


def test_base_places_and_labels_of_the_method(spark):
    mit = license_scan.TEMPLATES[2][1]
    shifted = mit.replace("charge to", "charge kindly and gladly to").replace("software", "Software")
    texts = [None, "", "CC-BY", "cc by cc by", "All rights, reserved? all rights reserved", "gnu general public license general", "é" * 9, f"x {shifted} y", "permission is hereby granted", "by reserved license", "cc " * 3000 + "by"]
    docs = spark.createDataFrame([*enumerate(texts), (3, "cc by cc by")], "doc_id long, text string").selectExpr("*", "1 as words", "2 as tpl")
    rows = {(r.doc_id, r.n_words): r for r in license_scan.scan(docs).collect()}
    assert len(license_scan.scan(docs).collect()) == len(texts) + 1
    for i, t in enumerate(texts):
        n, places = base(t)
        r = rows[i, n]
        starts = [p for p, _ in places]
        assert (r.n_base, r.first_word, r.last_word) == (len(places), min(starts, default=None), max(starts, default=None)), t
        assert r.base_labels == ",".join(sorted({x for _, x in places}))
        assert set(r.base_labels.split(",")) <= set(r.labels.split(",")) | {""}
    assert rows[7, len(words(texts[7]))].labels == "mit"
    assert rows[8, 4].labels == ""


def method(text, templates, gram=3, slack=3, least=0.75):
    """All labels and the best share, over all diagonals that share a gram with a template."""
    w, labels, best = words(text), set(), 0.0
    for label, form in templates:
        f = words(form)
        if not f:
            continue
        stand = math.ceil(len(f) * least - 1e-9)
        k = max(1, min(gram, math.ceil(stand / (len(f) - stand + 1))))
        lines = sorted({i - j for i in range(len(w) - k + 1) for j in range(len(f) - k + 1) if w[i : i + k] == f[j : j + k]})
        parts = [[d] for d in lines[:1]]
        for d in lines[1:]:
            parts[-1].append(d) if d - parts[-1][-1] <= slack else parts.append([d])
        for part in parts:
            share = sum(any(0 <= d + j < len(w) and w[d + j] == x for d in part) for j, x in enumerate(f)) / len(f)
            if share >= least:
                labels.add(label)
                best = max(best, share)
    return labels, best


@pytest.mark.parametrize("as_table", [False, True])
def test_labels_and_score_against_all_diagonals(spark, as_table):
    r = random.Random(9)
    vocabulary = [f"w{i}" for i in range(12)]
    templates = [(f"l{i % 7}", " ".join(r.choice(vocabulary) for _ in range(n))) for i, n in enumerate((1, 2, 3, 4, 5, 8, 8, 13, 20, 30))]
    templates += [("tied", templates[-1][1]), ("empty", "?!"), ("l9", templates[5][1].upper())]
    texts = [" ".join(r.choice(vocabulary + ["x", "y"]) for _ in range(r.randrange(60))) for _ in range(150)]
    for _ in range(100):
        t = r.choice(templates[:-2])[1].split()
        t = [r.choice(vocabulary) if r.random() < 0.2 else x for x in t for _ in range(r.choice((1, 1, 1, 1, 0, 2)))]
        texts.append(" ".join(["x"] * r.randrange(4) + t + ["y"] * r.randrange(4)))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    given = spark.createDataFrame(templates, "label string, text string") if as_table else templates
    found = 0
    for x in license_scan.scan(docs, templates=given).collect():
        labels, best = method(texts[x.doc_id], templates)
        assert (x.labels, round(x.score, 9)) == (",".join(sorted(labels)), round(best, 9)), texts[x.doc_id]
        found += bool(labels)
    assert found > 50


def test_no_templates_and_notices_of_licenses(spark):
    every = license_scan.TEMPLATES[2][1].split()
    gaps = " ".join("other" if i % 4 == 3 else x for i, x in enumerate(every))
    texts = [gaps, "Released under the MIT License.", "cc by", "under the license of the city"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [r.labels for r in sorted(license_scan.scan(docs).collect())] == ["mit", "mit", "cc-by", ""]
    assert [r.labels for r in sorted(license_scan.scan(docs, templates=[]).collect())] == ["", "", "cc-by", ""]


def test_empty(spark):
    assert license_scan.scan(spark.createDataFrame([], "doc_id long, text string")).collect() == []
