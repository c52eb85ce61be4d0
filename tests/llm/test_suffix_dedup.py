import hashlib
import random
from collections import Counter

import numpy as np

from veilquery.llm import suffix_dedup


def brute(rows, window):
    texts = [(t or "").encode() for _, t in rows]
    seen = Counter(t[i : i + window] for t in texts for i in range(len(t) - window + 1))
    out = []
    for (key, _), t in zip(rows, texts, strict=True):
        gone = bytearray(len(t))
        for i in range(len(t) - window + 1):
            if seen[t[i : i + window]] > 1:
                gone[i : i + window] = b"\1" * window
        spans = len([x for x in bytes(gone).split(b"\0") if x])
        out.append((key, len(t), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(t, gone, strict=True) if not g)).hexdigest()))
    return sorted(out, key=str)


def corpus(window):
    r = random.Random(7)
    text = lambda n: "".join(r.choice("abcdé ") for _ in range(n))
    shared = [text(window + n) for n in (0, 1, 5, 80, 300)]
    rows = [(0, None), (1, ""), (2, "x" * (window - 1)), (3, "x" * window), (4, "y" * window * 3), (5, "ab" * window), (6, text(window))]
    for i in range(7, 60):
        parts = [text(r.randrange(200)) for _ in range(3)]
        rows.append((i, parts[0] + r.choice(shared) + parts[1] + (r.choice(shared)[r.randrange(60) :] if i % 3 else "") + parts[2]))
    rows += [(60, rows[10][1]), rows[11], rows[11], (None, rows[12][1][20:]), (61, rows[13][1] + rows[13][1])]
    rows += [(100 + i, text(30) + shared[3][10:] + text(i % 7) + "tail") for i in range(25)]
    return rows


def check(spark, rows, window, **options):
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as tk", "'x' as data")
    assert sorted(map(tuple, suffix_dedup.repeats(docs, window=window, **options).collect()), key=str) == brute(rows, window)


def test_against_brute_force(spark):
    check(spark, corpus(100), 100)


def test_small_blocks(spark):
    check(spark, corpus(100), 100, block=2000)


def test_many_segments_of_one_anchor(spark):
    check(spark, corpus(100), 100, most=2)
    check(spark, corpus(100), 100, most=1, block=1)


def test_whole_table_at_400_bytes(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert sorted(map(tuple, suffix_dedup.repeats(docs).collect()), key=str) == brute(rows, 400)


def test_a_very_long_text_and_ids_of_text(spark):
    r = random.Random(11)
    part = "".join(r.choice("abcdefgh ") for _ in range(700))
    long = "".join(r.choice("abcdefgh ") for _ in range(400_000))
    rows = [("a", long[:300_000] + part + long[300_000:]), ("b", part), (None, part + "x"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    assert sorted(map(tuple, suffix_dedup.repeats(docs).collect()), key=str) == brute(rows, 400)


def test_anchors_do_not_depend_on_the_pieces():
    data = np.random.default_rng(5).integers(0, 3, 5000).astype(np.uint8)
    place = lambda h, at, first, last: [a for a, x, y in zip(at, first, last, strict=True) for _ in range(x, y + 1)]
    whole = place(*suffix_dedup.anchors(data, 100, 13))
    assert len(whole) == 4901
    for bits in (8, 10):
        h, at, first, last = suffix_dedup.anchors(data, 100, bits)
        assert [x for a, b in zip(first, last, strict=True) for x in range(a, b + 1)] == list(range(4901))
    short = suffix_dedup.anchors(data[1000:1300], 100, 13)
    assert [p + 1000 for p in place(*short)] == whole[1000:1201]


def test_empty(spark):
    check(spark, [], 400)
    check(spark, [(1, "short")], 400)


def test_index():
    r = random.Random(3)
    for _ in range(200):
        texts = ["".join(r.choice("ab") for _ in range(r.randrange(1, 40))).encode() for _ in range(r.randrange(1, 12))]
        index = suffix_dedup.RunLengthIndex(texts)
        for length in (1, 3, 6, 9, 20):
            seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
            marks = index.repeated(length)
            for t, start in zip(texts, index.starts, strict=True):
                assert [bool(marks[start + i]) for i in range(len(t) - length + 1)] == [seen[t[i : i + length]] > 1 for i in range(len(t) - length + 1)]
    copies = [b"the same text again and again" * 20] * 40
    copies = [c + bytes([65 + i]) for i, c in enumerate(copies)]
    index = suffix_dedup.RunLengthIndex(copies)
    assert index.runs < len(index.symbols) / 4
    assert np.all(index.longest <= index.room)
