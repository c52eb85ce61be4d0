import hashlib
import random
import re

from veilquery.llm import decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items):
    out = []
    for key, text in docs:
        w, hit, names = words(text), set(), set()
        for item, t in items:
            v = words(t)
            n = min(13, len(v))
            grams = {tuple(v[i : i + n]) for i in range(len(v) - n + 1)} if n else set()
            at = [i for i in range(len(w) - n + 1) if tuple(w[i : i + n]) in grams] if n else []
            if at:
                names.add(str(item))
                hit |= {j for i in at for j in range(i, i + n)}
        digest = hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
        out.append((key, len(w), len(hit), len(names), digest, bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def check(spark, docs, items):
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as item", "'x' as span", "3 as len")
    b = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 as words")
    assert sorted(map(tuple, decontaminate.contamination(d, b).collect()), key=str) == brute(docs, items)


def test_against_brute_force(spark):
    r = random.Random(3)
    vocabulary = [f"W{i}é" for i in range(9)] + ["a", "B", "c3"]
    text = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    items = [(i, text(n)) for i, n in enumerate([30, 30, 13, 12, 5, 1, 40, 14])] + [(8, None), (9, " ,. "), (10, "rare"), (2, "again one two")]
    items.append((11, items[0][1]))
    docs = [(0, None), (1, ""), (2, "rare"), (3, "rare, RARE " * 5)]
    for i in range(4, 60):
        k, t = r.choice(items[:8])
        w = t.split()
        a = r.randrange(len(w))
        docs.append((i, f"{' '.join(f'x{r.randrange(99)}' for _ in range(r.randrange(300)))} {'; '.join(w[a : a + r.randrange(11, 30)])} {'y ' * r.randrange(5)}"))
    docs += [(4, docs[5][1]), docs[6], docs[6], (None, items[0][1]), (60, f"{items[0][1]} " * 300)]
    check(spark, docs, items)


def test_empty_tables(spark):
    check(spark, [(1, "a b")], [])
    check(spark, [], [(1, "a b")])
