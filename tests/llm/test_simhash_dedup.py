import itertools

import xxhash

from veilquery.llm import simhash_dedup
from veilquery.llm.common import components

SCHEMA = "doc_id long, text string, fp string, a int"


def fingerprint(text, k=3):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def brute(rows):
    fps = [fingerprint(r[1]) for r in rows]
    label = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for i, j in itertools.combinations(range(len(rows)), 2):
            if (fps[i] ^ fps[j]).bit_count() <= 2 and label[i] != label[j]:
                label[i] = label[j] = min(label[i], label[j])
                changed = True
    groups = {}
    for r, g in zip(rows, label, strict=True):
        groups.setdefault(g, []).append(r[0])
    least = {g: min((x for x in ids if x is not None), default=None) for g, ids in groups.items()}
    return sorted(((r[0], f"{f:016x}", least[g]) for r, f, g in zip(rows, fps, label, strict=True)), key=str)


def check(spark, rows):
    out = simhash_dedup.near_duplicates(spark.createDataFrame([(i, t, "x", 1) for i, t in rows], SCHEMA))
    assert sorted(map(tuple, out.collect()), key=str) == brute(rows)


def test_against_brute_force(spark):
    base = " ".join(f"w{i}" for i in range(400))
    near = [base.replace(f"w{i} ", f"x{i} ") for i in range(3, 390, 9)]
    texts = [None, "", "  \t", "One two", "one TWO", "é É", base, base, base.upper(), *near, *(f"a{i} b c{i} d" for i in range(40)), "long " * 3000]
    check(spark, [(i, t) for i, t in enumerate(texts)] + [(3, "One two"), (None, "One two"), (None, "only without an id")])


def test_empty_table(spark):
    assert simhash_dedup.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []


def test_dense_ball_is_linked(spark):
    centre = 0x0123456789ABCDEF
    values = {centre} | {centre ^ 1 << i for i in range(20)} | {centre ^ 3 << i for i in range(20)} | {centre ^ 0xFFFF << 8}
    nodes = spark.createDataFrame([(v,) for v in values], "fp long")
    found = {r.node: r.component for r in components(simhash_dedup.links(nodes)).collect()}
    assert len(found) == len(values) - 1
    assert len(set(found.values())) == 1


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(100)] + [(200, 201), (201, 200)], "a long, b long")
    found = {r.node: r.component for r in components(edges).collect()}
    assert set(found.values()) == {0, 200}
    assert found[100] == 0
    assert found[201] == 200
