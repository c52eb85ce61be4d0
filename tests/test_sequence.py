import random

import numpy as np
import pytest

from veilquery.operators import sequence, tokens


def made(n, seed=1):
    draw, out = random.Random(seed), []
    for _ in range(n):
        words, labels = [], []
        for _ in range(draw.randint(3, 10)):
            k = draw.random()
            if k < 0.2:
                words += [draw.choice(["Jan", "Piet"]), "Bakker"]
                labels += ["B-Name", "I-Name"]
            elif k < 0.4:
                words += [str(draw.randint(1, 31)), draw.choice(["mei", "juni"])]
                labels += ["B-Date", "I-Date"]
            else:
                words.append(draw.choice("de het een op naar was".split()))
                labels.append("O")
        out.append((words, labels))
    return out


def test_expectations_are_the_gradient():
    draw = np.random.default_rng(0)
    emit, pairs, length = draw.normal(size=(2, 4, 3)), draw.normal(size=(4, 3)), np.array([4, 2])
    p, moves, whole = sequence._expectations(emit, pairs, length)
    for at in ((0, 2, 1), (1, 1, 0), (1, 3, 2)):
        more = emit.copy()
        more[at] += 1e-5
        assert (sequence._expectations(more, pairs, length)[2].sum() - whole.sum()) / 1e-5 == pytest.approx(p[at], abs=1e-4)
    for at in ((0, 1), (2, 0)):
        more = pairs.copy()
        more[at] += 1e-5
        assert (sequence._expectations(emit, more, length)[2].sum() - whole.sum()) / 1e-5 == pytest.approx(moves[at], abs=1e-4)


@pytest.mark.parametrize("features", ["wide", "narrow"])
def test_held_out_accuracy(features):
    model = sequence.fit(made(200), features)
    held = made(50, 2)
    assert sequence.flat_f1([y for _, y in held], [model.tag(w) for w, _ in held]) > 0.95


def test_viterbi_finds_the_best_path():
    model = sequence.fit(made(60))
    words = "was Jan Bakker".split()
    emit, n = model.scores(words), len(model.labels)
    score = lambda p: model.pairs[0, p[0]] + emit[0, p[0]] + sum(model.pairs[1 + p[i - 1], p[i]] + emit[i, p[i]] for i in range(1, 3))
    best = max(np.ndindex(n, n, n), key=score)
    assert model.tag(words) == [model.labels[k] for k in best]


def test_metadata_is_neither_learnt_nor_tagged():
    model = sequence.fit([(["===", "Jan"], ["O", "B-Odd"]), *made(20), ([], [])])
    assert "B-Odd" not in model.labels and model.tag(["===", "Jan"]) == ["O", "O"] and model.tag([]) == []
    assert model.marginals(["===", "Jan"])[1]["O"] == 1.0
    assert all(sum(p.values()) == pytest.approx(1) for p in model.marginals(["Jan", "was"]))
    assert len(model.strongest(3)) == 6


def test_documents_to_spans(spark):
    model = sequence.fit(made(200))
    docs = spark.createDataFrame([(1, "de Jan Bakker was 3 mei. het Piet Bakker"), (2, ""), (3, None)], "doc_id long, text string")
    found = sorted((r.doc, r.ann_id, r.start, r.end, r.tag) for r in sequence.annotate(docs, "doc_id", model).collect())
    assert found == [(1, "T0", 3, 13, "Name"), (1, "T1", 18, 23, "Date"), (1, "T2", 29, 40, "Name")]
    rows = tokens.sentences(tokens.tokenize(docs, "doc_id"))
    assert sequence.predict(rows, model).count() == rows.count()


def test_fractions_are_exact_and_nested(spark):
    rows = spark.createDataFrame([(i, 0, ["a"], ["O"]) for i in range(41)], "doc long, sent_id int, words array<string>, labels array<string>")
    few, more = ({r.doc for r in sequence.fraction(rows, s).collect()} for s in (0.25, 0.5))
    assert len(few) == 10 and len(more) == 20 and few < more
    assert sequence.sampled(rows, 5) == [(["a"], ["O"])] * 5


def test_search_and_curve(spark):
    rows = sequence.search(spark, made(40), made(10, 2), 2).collect()
    assert len(rows) == 2 and all(1e-4 <= r.c1 <= 10 and 0 <= r.f1 <= 1 for r in rows)
    curve = sequence.learning_curve(spark, made(40), made(10, 2), (0.25, 1.0), (42,)).orderBy("share").collect()
    assert [r.n for r in curve] == [10, 40]
