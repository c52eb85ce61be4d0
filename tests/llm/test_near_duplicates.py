import itertools
import random

from veilquery.llm import simhash_dedup


def grams(text, k=5):
    w = (text or "").lower().split()
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute(rows, similarity=0.8):
    sets = [grams(t) for _, t in rows]
    label = list(range(len(rows)))

    def top(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        if len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j]):
            a, b = sorted((top(i), top(j)))
            label[b] = a
    return [top(i) for i in range(len(rows))]


def corpus(seed):
    r = random.Random(seed)
    vocabulary = [f"{a}{b}{c}" for a in "bdfgk" for b in "aeiou" for c in "lmnrst"]
    text = lambda n: [r.choice(vocabulary) for _ in range(n)]
    common = text(60)
    rows = []
    for _ in range(25):
        base = text(r.randrange(20, 400))
        if r.random() < 0.5:
            base[5:5] = common
        rows.append(" ".join(base))
        for _ in range(r.randrange(4)):
            copy = list(base)
            for _ in range(len(base) // 90):
                copy[r.randrange(len(copy))] = r.choice(vocabulary)
            rows.append(" ".join(copy))
    return list(enumerate([*rows, None, "", "one", "one", "ONE", *rows[3:5]]))


def test_groups_against_brute_force(spark):
    for seed in (1, 2):
        rows = corpus(seed)
        docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as unit", "2 as c")
        kept = {r.doc_id for r in simhash_dedup.without_near_duplicates(docs).collect()}
        groups = {}
        for (key, _), g in zip(rows, brute(rows), strict=True):
            groups.setdefault(g, []).append(key)
        assert kept == {min(g) for g in groups.values()}


def test_repeated_rows_and_empty(spark):
    rows = [(1, "some words here"), (1, "some words here"), (1, "other words there"), (None, "some words here"), (None, "alone")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, simhash_dedup.without_near_duplicates(docs).collect()), key=str) == [(1, "other words there"), (1, "some words here"), (None, "alone")]
    assert simhash_dedup.without_near_duplicates(docs.limit(0)).collect() == []
