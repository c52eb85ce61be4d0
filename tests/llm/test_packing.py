import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from veilquery.llm import packing


def test_plan_places_all_and_wastes_little():
    r = random.Random(1)
    for counts in ({}, {5: 3}, {100: 7}, Counter(min(2048, int(r.lognormvariate(6.5, 1)) + 1) for _ in range(20000)), Counter(r.choice([700, 1000, 1348, 2048]) for _ in range(999))):
        slots, used = packing.plan(dict(counts), 2048)
        rows, ranks = defaultdict(list), defaultdict(set)
        for n, rank, sequence, offset, many in slots:
            for k in range(many):
                rows[sequence + k].append((offset, n))
                ranks[n].add(rank + k)
        assert {n: len(x) for n, x in ranks.items()} == dict(counts)
        assert all(max(x) + 1 == len(x) for x in ranks.values())
        assert set(rows) == set(range(used))
        for parts in rows.values():
            at = 0
            for offset, n in sorted(parts):
                assert offset == at
                at += n
            assert at <= 2048
    assert used <= 1.02 * sum(n * c for n, c in counts.items()) / 2048 + 600
    counts = Counter(min(2048, int(r.lognormvariate(6.5, 1)) + 1) for _ in range(20000))
    assert packing.plan(dict(counts), 2048)[1] <= 1.005 * sum(n * c for n, c in counts.items()) / 2048 + 2


def test_round_trip(spark):
    texts = [None, "", "a b c", "a b c", "é 漢字 \n\n  x", "word " * 5000, "<|endoftext|> in a text", "x" * 3000, *("w " * n for n in range(1, 60))]
    docs = spark.createDataFrame(list(enumerate(texts)) + [(2, "a b c")], "doc_id long, text string").selectExpr("*", "1 as length", "2 as part")
    full = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    expected = Counter()
    for key, text in [*enumerate(texts), (2, "a b c")]:
        ids = np.array([*full.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        first = len(ids) if len(ids) <= 64 else len(ids) % 64 or 64
        bounds = [0, *range(first, len(ids) + 1, 64)]
        for k, (i, j) in enumerate(zip(bounds, bounds[1:])):
            expected[key, k, i, j - i, zlib.crc32(ids[i:j].tobytes())] += 1
    rows = packing.pack(docs, size=64).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == expected
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:i]) for i in range(len(parts))]
        assert sum(n for _, n in parts) <= 64
    assert len(by) <= sum(n for p in by.values() for _, n in p) / 64 * 1.1 + 1


def test_empty(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_texts_that_the_fast_encoder_gives_up_on():
    encode, full = packing.encoder("byte_bpe_50k", packing.specials("byte_bpe_50k")), packing.full_encoder("byte_bpe_50k")
    for text in (" " * 1_500_000 + "end", "x" * 300_000, "^" * 100_000, "a b  c\n\n\t d'll 漢字 é\u0301 \u00a0 12345"):
        assert list(encode(text)) == full.encode(text, add_special_tokens=False).ids
