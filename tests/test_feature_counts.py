from collections import Counter

from veilquery.operators import corpus, sequence, tokens


def test_counts_equal_those_of_all_features(spark):
    texts = ["Jan (B.) woont, in ÉDE 12a\n. A-b É", "x \t y", "", None, "Ein! 3 ...", "   "]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want: Counter = Counter()
    by: dict = {}
    for r in sorted(corpus.counted(tokens.tokenize(docs, "doc_id")).collect()):
        by.setdefault(r.doc, []).append(r.text)
    for words in by.values():
        for f in sequence.described(words, [""] * len(words)):
            want.update((k, v if isinstance(v, str) else str(v).lower()) for k, v in f.items() if v is not None)
    names = list(sequence.described(["a"], [""])[0])
    got = {(r.feature, r.value): r.n for r in sequence.feature_counts(docs, names).collect()}
    assert got == want
    rows = {(r.feature, r.value): r.n for r in sequence.feature_counts(docs, ["sent.end_mark", "shape.short"]).collect()}
    assert rows == {k: n for k, n in want.items() if k[0] in ("sent.end_mark", "shape.short")}
