import numpy as np

from veilquery.llm import quality

GOOD = "The river runs past {} old mills and the people of the town number {} walk there in the evening to talk about the day."


def corpus():
    rows = []
    for i in range(400):
        text = GOOD.format(f"word{i}", f"n{i * 7}")
        kind = i % 8
        if kind == 1:
            text = text.upper() + "!!"
        elif kind == 2:
            text = " ".join(w + "$$%" for w in text.split())
        elif kind == 3:
            text += " you stupid worthless idiot"
        elif kind == 4:
            text = " ".join([f"spam{i}"] * 30)
        rows.append((i, text, int(kind in (1, 2, 3, 4))))
    return rows


def test_held_out_accuracy(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string").selectExpr("*", "1 as votes", "2 as score", "3 as tk")
    found = {r.doc_id: r.keep for r in quality.classify(docs, sample=200, abuse=["stupid", "worthless", "idiot"]).collect()}
    assert len(found) == len(rows)
    assert np.mean([found[i] != bool(bad) for i, _, bad in rows]) > 0.97


def test_estimates_accuracies():
    rng = np.random.default_rng(1)
    bad = rng.random(5000) < 0.2
    fire = np.where(bad[:, None], rng.random((5000, 7)) < 0.6, rng.random((5000, 7)) < 0.05)
    fire[:, -1] = np.where(bad, rng.random(5000) < 0.1, rng.random(5000) < 0.9)
    keys, n = np.unique(fire @ (1 << np.arange(7)), return_counts=True)
    prior, b, g = quality.accuracies(dict(zip(keys.tolist(), n.tolist(), strict=True)))
    assert abs(prior - 0.2) < 0.03
    assert np.abs(b[:-1] - 0.6).max() < 0.08
    assert np.abs(g[:-1] - 0.05).max() < 0.03


def test_learns_abuse_but_not_from_copies(spark):
    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list("abcdefghij"), 4)) for _ in range(60)]
    rows = [(i, f"{' '.join(rng.choice(words, 25))} {'zorgle' if i % 4 == 0 else 'quiet'}", int(i % 4 == 0)) for i in range(80)]
    rows += [(100 + i, "this one has been copied many times and the copies use the word flimble a lot in their text" + f" c{i}", 1) for i in range(30)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, b) for i, _, b in rows] + [(None, 1), (7, None)], "doc_id long, toxic int")
    found = quality.learned_abuse(docs, labels, "doc_id", "text")
    assert "zorgle" in found
    assert "flimble" not in found


def test_nulls_empty_and_repeated(spark):
    rows = [(1, None), (1, None), (2, ""), (None, "A fine text of a few words."), (3, "a " * 20000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = quality.classify(docs).collect()
    assert len(out) == len(rows)
    assert all(r.keep for r in out if r.doc_id in (1, 2, None))
    assert quality.classify(docs.limit(0)).collect() == []


def test_em_by_pattern_equals_em_by_row():
    """The counts of vote patterns give what a pass over all rows gives."""
    rng = np.random.default_rng(4)
    fire = (rng.random((400, 7)) < rng.choice([0.1, 0.6], 400)[:, None]).astype(int)
    keys, n = np.unique(fire @ (1 << np.arange(7)), return_counts=True)
    got = quality.accuracies(dict(zip(keys.tolist(), n.tolist(), strict=True)), rounds=30)
    bad, good, prior = np.full(7, 0.3), np.full(7, 0.01), 0.15
    bad[-1], good[-1] = 0.05, 0.95
    for _ in range(30):
        p = []
        for row in fire:
            b, g = prior, 1 - prior
            for k, x in enumerate(row):
                b *= bad[k] if x else 1 - bad[k]
                g *= good[k] if x else 1 - good[k]
            p.append(b / (b + g))
        p = np.array(p)
        prior = (p.sum() + 1) / (len(p) + 2)
        bad = (p @ fire + 0.3) / (p.sum() + 1)
        good = ((1 - p) @ fire + 0.01) / ((1 - p).sum() + 1)
    assert np.allclose(got[0], prior)
    assert np.allclose(got[1], bad)
    assert np.allclose(got[2], good)


def test_score_of_the_linear_scorer_and_ties(spark):
    docs = spark.createDataFrame([(i, t) for i, t, _ in corpus()[:80]], "doc_id long, text string").selectExpr("*", "1 as keep", "2 as weak_bad")
    model = quality.train(docs, None, "doc_id", "text", sample=40, epochs=3)
    for r in quality.judge(docs, model, prefix="x_").collect():
        found, _ = quality.features(r.text.encode(), model.abuse)
        z = sum(float(model.weights[k]) for k in found) / len(found) ** 0.5 + model.bias
        assert abs(r.x_score - 1 / (1 + np.exp(-z))) < 1e-6
        assert r.x_keep == (r.x_score < 0.5)
    even = quality.Model(0.5, np.full(7, 0.5), np.full(7, 0.5), np.zeros(1 << quality.BITS, np.float32), 0.0, frozenset())
    assert {(r.x_score, r.x_keep) for r in quality.judge(docs, even, prefix="x_").collect()} == {(0.5, False)}


def test_loops_are_seen_whatever_their_period():
    for period in (200, 201, 202):
        for times, share in ((2, 0.5), (3, 0.67), (4, 0.75)):
            text = " ".join([f"w{i}" for i in range(period)] * times).encode()
            assert abs(quality.measures(text, frozenset())[1][5] - share) < 0.01
            assert quality.votes(quality.measures(text, frozenset())[1]) >> quality.LABELLERS.index("loops") & 1


def test_only_labelled_texts_are_split(spark, monkeypatch):
    """No filter on the words moves below the join with the labelled documents, where it would split every text."""
    plans, real = [], quality.staged
    monkeypatch.setattr(quality, "staged", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or real(df))
    docs = spark.createDataFrame([(i, f"some words {i}") for i in range(20)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(5)], "doc_id long, toxic int")
    quality.learned_abuse(docs, labels, "doc_id", "text")
    assert any("Generate explode" in p for p in plans)
    assert not [line for p in plans for line in p.splitlines() if "Filter" in line and "split(" in line]
