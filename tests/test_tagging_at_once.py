import random

from pyspark.sql import functions as F

from tests.test_sequence import made
from veilquery.operators import detect, sequence, tokens


def test_many_sentences_at_once_are_tagged_alike():
    draw = random.Random(3)
    data = made(120) + [(["|", "|", "a|b", "("], ["B-Name", "I-Name", "O", "O"])] * 3
    model = sequence.fit(data)
    held = [w for w, _ in made(60, 2)] + [["|", "|", "a|b", "Jan", "|", "Bakker"], [], ["===", "Jan"], ["Jan"], ["|"], ["a|b", "("]] + [[draw.choice(["Jan", "Bakker", "3", "mei", "x9", "É", "|", "(", "."]) for _ in range(k)] for k in range(1, 40)]
    assert model.tag_all(held) == [model.tag(w) for w in held]
    for words in held:
        if words:
            assert (model._emissions([words], sequence.np.array([len(words)])) == model.scores(words)).all()


def test_draws_equal_those_from_all_sentences(spark):
    texts = ["\n Mail a@b.com. Then\n\t10.0.0.1 and x! ", "One. Two.Three ?  four\x0b\nfive", None, "", ".\n.\n. ", "key 12345678901234. (743) 555-3824 b", "a_b éa@b.com " * 300 + ". z"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts * 5)], "doc_id long, text string").repartition(3)
    rows = tokens.sentences(tokens.labelled(detect.annotate(docs), "doc_id", {"label": "spans"}))
    for n in (6, 9, 1000):
        assert sequence.drawn(detect.annotate(docs), "doc_id", "spans", n) == sequence.sampled(sequence.sentences(rows), n)


def test_spans_equal_those_of_tokens(spark):
    from veilquery.operators import labels

    model = sequence.fit(made(200))
    texts = ["de Jan Bakker was 3 mei. het Piet Bakker\n3 juni Jan", "", None, "\n Jan. Piet\tBakker", "3 mei Jan Bakker Bakker mei"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    words = sequence.predict(tokens.sentences(tokens.tokenize(docs, "doc_id")), model).where(F.trim(F.regexp_replace("text", r"[\x09-\x0D]", " ")) != "")
    words = words.withColumn("i", F.row_number().over(labels.within()))
    want = labels.to_spans(labels.repair(words).drop("label"), "fixed")
    assert sorted(map(tuple, sequence.annotate(docs, "doc_id", model).collect())) == sorted(map(tuple, want.collect()))


def test_padding_beyond_all_numbers_counts_nothing():
    np = sequence.np
    emit, pairs, length = np.zeros((2, 400, 3)), np.full((4, 3), 5.0), np.array([400, 1])
    p, moves, _ = sequence._expectations(emit, pairs, length)
    assert np.isfinite(p).all() and p.sum() > 400.99 and abs(moves.sum() - 401) < 1e-6
