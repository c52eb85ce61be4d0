import hashlib
import itertools
import random

import numpy as np

from veilquery.llm import fingerprints


def test_edits_and_next(spark):
    r = random.Random(2)
    texts = {i * 3: " ".join(r.choice("abcdefgé漢") * r.randrange(1, 5) for _ in range(r.randrange(80))) for i in range(50)}
    texts[9], texts[12], texts[15] = "", "x", texts[18]
    rows = [*texts.items(), (200, None)]
    texts[200] = ""
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as part", "'x' as head")
    out = {x.doc_id: x for x in fingerprints.report(docs).collect()}
    assert len(out) == len(texts)
    ids = sorted(texts, reverse=True)
    for a, b in zip(ids, ids[1:] + ids[:1], strict=True):
        t, half = texts[a], len(texts[a]) // 2
        new = t[: len(t) - half] + texts[b][:half]
        assert out[a].n_chars == len(t)
        assert out[a].edited_sha256 == hashlib.sha256(new.encode()).hexdigest()
        f, g, h = (fingerprints.fingerprint(x) for x in (t, new, texts[b]))
        assert (out[a].fingerprint, out[a].edited_fingerprint) == (f.tobytes().hex(), g.tobytes().hex())
        assert out[a].near_edited == 1 - np.unpackbits(f ^ g).sum() / 128
        assert out[a].near_next == 1 - np.unpackbits(f ^ h).sum() / 128
        assert (out[a].n_near is None) == (a % 50 != 0)
    assert out[15].fingerprint == out[18].fingerprint


def test_ties_nulls_and_small_tables(spark):
    make = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    assert fingerprints.report(make([])).collect() == []
    one = fingerprints.report(make([(5, "ab cd")])).collect()
    assert [r.edited_sha256 for r in one] == [hashlib.sha256(b"ab ab").hexdigest()]
    many = fingerprints.report(make([(5, "b"), (5, "a"), (5, "a"), (None, "zz"), (100, "a")])).collect()
    assert len(many) == 5
    assert [r.n_near for r in many if r.doc_id == 100] == [2]


def test_a_very_long_text(spark):
    r = random.Random(6)
    texts = [" ".join(str(r.randrange(5000)) for _ in range(n)) for n in (300_000, 3)]
    out = fingerprints.report(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    for x in out:
        t, other = texts[x.doc_id], texts[1 - x.doc_id]
        new = t[: len(t) - len(t) // 2] + other[: len(t) // 2]
        assert (x.n_chars, x.edited_sha256) == (len(t), hashlib.sha256(new.encode()).hexdigest())
        assert x.fingerprint == fingerprints.fingerprint(t).tobytes().hex()


def test_search_finds_all(spark):
    r = random.Random(4)
    base = [r.getrandbits(128) for _ in range(30)]
    prints = base + [b ^ sum(1 << k for k in r.sample(range(128), n)) for b in base for n in (1, 2, 3, 4, 6)]
    rows = spark.createDataFrame([(f"{p:032x}",) for p in prints], "fingerprint string")
    found = {(x.fingerprint, x.near, x.distance) for x in fingerprints.neighbours(rows, rows).collect()}
    expected = {(f"{a:032x}", f"{b:032x}", (a ^ b).bit_count()) for a, b in itertools.product(set(prints), repeat=2) if (a ^ b).bit_count() <= 3}
    assert found == expected
