"""Quality classifier: overlapping heuristic labellers, their accuracies by expectation-maximisation, and a hashed linear scorer."""

from __future__ import annotations

import math
import operator
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilquery.llm.common import let, row_key, staged, word_grams

_LETTERS = re.compile(r"[^\W\d_]+")
_TAIL = re.compile(rb"[^\s\w.,;:!?'\")\]}\x80-\xff|-]{2,}(?=\s|$)")
LABELLERS = ("shouting", "symbols", "bars", "repeats", "abuse", "loops", "prose")  #: the last approves, the others object
BITS = 18  #: hashed features: 2 ** BITS weights


def learned_abuse(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, sample: int = 20_000, share: float = 0.8) -> frozenset[str]:
    """The words that give away toxic documents among the labelled ones: `share` of their documents are toxic, and these are so
    many (3 at least) that chance would hardly bring up one such word.

    Fitted on `sample` labelled documents at most, the first by a hash of the id. Of near copies, which share all their words,
    one is counted: documents that agree in the least hash of their word triples, for any of four hash functions.
    """
    rows = labels.select(F.col(id_col).alias("lid"), "toxic").where("toxic is not null").orderBy(F.xxhash64(F.lit(7), "lid"), "lid").limit(sample)
    texts = docs.select(F.col(id_col).alias("lid"), F.xxhash64(text_col).alias("tk"), F.col(text_col).alias("t")).join(F.broadcast(rows), "lid")
    texts = texts.withColumn("words", F.split(F.lower("t"), r"\P{L}+"))
    least_of = let(word_grams(F.col("words"), 3), lambda g: F.array(*(F.array_min(_mixed(g, k)) for k in range(4))))
    single = staged(texts.select("lid", "tk", "toxic", least_of.alias("least")))
    for k in range(4):
        single = single.withColumn("key", F.coalesce(F.get("least", F.lit(k)), "tk")).dropDuplicates(["key"])
    single = staged(single.select("lid", "tk", "toxic"))  # `sample` rows at most, but for repeated ids
    texts = texts.drop("toxic").join(F.broadcast(single), ["lid", "tk"])
    total = single.agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("toxic") == 1).cast("int")).alias("bad")).first()
    words = texts.select("toxic", F.explode(F.array_distinct("words")).alias("w")).where("w <> ''")  # exploded as a column, it would be tested for emptiness before the joins: all texts would be split
    counts = staged(words.groupBy("w").agg(F.sum((F.col("toxic") == 1).cast("int")).alias("bad"), F.count(F.lit(1)).alias("n")).where("n >= 3"))
    wide = {r.n: r.c for r in counts.groupBy("n").agg(F.count(F.lit(1)).alias("c")).collect()}  # `sample` values at most
    least, rate = 3, (total.bad or 0) / max(1, total.n)
    while rate**least * sum(c for n, c in wide.items() if n >= least) > 0.5 and least < 20:
        least += 1
    found = counts.where((F.col("bad") >= least) & (F.col("bad") >= share * F.col("n")))
    return frozenset(r.w for r in found.collect())  # words of a bounded sample


def _mixed(grams, k: int):
    return F.transform(grams, lambda g: F.xxhash64(F.lit(k), g))


def measures(text: bytes, abuse: frozenset[str]) -> tuple[list[bytes], list[float]]:
    """The words, and what the labellers look at: shares of upper-case words, words with a tail of symbols, bars, words equal to the one before; abuse; share of word triples that came before."""
    words = text.split()
    n = max(1, len(words))
    plain = text.decode("utf-8", "replace")
    shouted = sum(map(str.isupper, plain.split()))
    seen = set(zip(words, words[1:], words[2:], strict=False))
    return words, [
        shouted / n,
        len(_TAIL.findall(text)) / n,
        words.count(b"|") / n,
        sum(map(operator.eq, words, words[1:])) / n,
        float(len(abuse.intersection(_LETTERS.findall(plain.lower())))),
        1 - len(seen) / (len(words) - 2) if len(words) > 2 else 0.0,
    ]


#: From which measure on a labeller speaks against a text; of words of abuse it takes two different ones.
THRESHOLDS = (0.3, 0.25, 0.08, 0.25, 2.0, 0.3)


def votes(values: list[float]) -> int:
    """One bit for each labeller that objects, and one for prose: nothing exceeds half of what would draw an objection."""
    found = sum(1 << k for k, (v, t) in enumerate(zip(values, THRESHOLDS, strict=True)) if v >= t)
    return found | all(v <= t / 2 for v, t in zip(values, THRESHOLDS, strict=True)) << len(THRESHOLDS)


def accuracies(patterns: dict[int, int], rounds: int = 200) -> tuple[float, np.ndarray, np.ndarray]:
    """EM over vote patterns and their counts: share of bad texts, and how often each labeller speaks up on bad and on good ones."""
    keys = np.array(list(patterns), np.int64)
    n = np.array(list(patterns.values()), np.float64)
    fired = keys[:, None] >> np.arange(len(LABELLERS)) & 1
    bad, good = np.full(len(LABELLERS), 0.3), np.full(len(LABELLERS), 0.01)
    prior, bad[-1], good[-1] = 0.15, 0.05, 0.95
    for _ in range(rounds):
        p = posterior(fired, prior, bad, good) * n
        q = n - p
        # a few made-up cases keep the shares off 0 and 1
        prior = float((p.sum() + 1) / (n.sum() + 2))
        bad = (p @ fired + 0.3) / (p.sum() + 1)
        good = (q @ fired + 0.01) / (q.sum() + 1)
    return prior, bad, good


def posterior(fired: np.ndarray, prior: float, bad: np.ndarray, good: np.ndarray) -> np.ndarray:
    odds = math.log(prior / (1 - prior)) + fired @ np.log(bad / good) + (1 - fired) @ np.log((1 - bad) / (1 - good))
    return 1 / (1 + np.exp(-np.clip(odds, -50, 50)))


def features(text: bytes, abuse: frozenset[str]) -> tuple[np.ndarray, int]:
    """Sorted distinct hashed features (words, A-Z lowered, and steps of the measures) and the votes."""
    words, values = measures(text, abuse)
    found = set(map(xxhash.xxh32_intdigest, set(text.lower().split())))
    found.update(xxhash.xxh32_intdigest(b"\n%d %d" % (k, step)) for k, v in enumerate(values) for step in range(1 + min(8, int(v / THRESHOLDS[k] * 2))))
    return np.unique(np.fromiter((h & (1 << BITS) - 1 for h in found), np.int32, len(found))), votes(values)


@dataclass
class Model:
    prior: float
    bad: np.ndarray
    good: np.ndarray
    weights: np.ndarray
    bias: float
    abuse: frozenset[str]


def train(docs: DataFrame, labels: DataFrame | None, id_col: str, text_col: str, sample: int = 8192, epochs: int = 40, seed: int = 42, abuse: Iterable[str] = ()) -> Model:
    """Accuracies from the votes on all documents; the scorer from `sample` documents at most, the first by a hash of the row.

    That bound is a parameter: the linear scorer is fitted on the driver. Vote patterns are 2 ** 7 at most. abuse: words (lower case) that the
    caller knows; those that labels give away come on top.
    """
    abuse = frozenset(abuse) | (frozenset() if labels is None else learned_abuse(docs, labels, id_col, text_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [votes(measures(t or b"", abuse)[1]) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found, pa.int32())], ["id", "tk", "votes"])

    rows = docs.select(*row_key(id_col, text_col), F.col(text_col).cast("binary").alias("t")).withColumn("id", F.col("id").cast("long"))
    voted = staged(rows.mapInArrow(run, "id long, tk long, votes int"))
    patterns = {r.votes: r.n for r in voted.groupBy("votes").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not patterns:
        return Model(0.5, np.full(len(LABELLERS), 0.5), np.full(len(LABELLERS), 0.5), np.zeros(1 << BITS, np.float32), 0.0, abuse)
    prior, bad, good = accuracies(patterns)
    order = F.xxhash64(F.lit(seed), "id", "tk")
    chosen = voted.select(order.alias("o")).distinct().orderBy("o").limit(sample)

    def shown(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [features(t or b"", abuse) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([f.tobytes() for f, _ in found], pa.binary()), pa.array([v for _, v in found], pa.int32())], ["f", "v"])

    texts = rows.withColumn("o", order).join(F.broadcast(chosen), "o").dropDuplicates(["o"]).select("t")
    got = texts.mapInArrow(shown, "f binary, v int").collect()  # `sample` rows at most
    sets = [np.frombuffer(r.f, np.int32) for r in got]
    label = posterior(np.array([r.v for r in got])[:, None] >> np.arange(len(LABELLERS)) & 1, prior, bad, good)
    weights, bias = np.zeros(1 << BITS), -1.0
    size, rng = np.zeros(1 << BITS), np.random.default_rng(seed)
    for _ in range(epochs):
        for at in np.array_split(rng.permutation(len(sets)), max(1, len(sets) // 64)):
            idx = np.concatenate([sets[i] for i in at]) if len(at) else np.empty(0, np.int32)
            row = np.repeat(np.arange(len(at)), [len(sets[i]) for i in at])
            scale = np.array([1 / math.sqrt(max(1, len(sets[i]))) for i in at])
            z = np.bincount(row, weights[idx], len(at)) * scale + bias
            gap = (1 / (1 + np.exp(-np.clip(z, -50, 50))) - label[at]) / len(at)
            slope = np.bincount(idx, (gap * scale)[row], 1 << BITS)
            size += slope**2  # AdaGrad
            weights -= 1.0 * slope / (np.sqrt(size) + 1e-6)
            bias -= 0.5 * float(gap.sum())
    return Model(prior, bad, good, weights.astype(np.float32), bias, abuse)


def judge(docs: DataFrame, model: Model, text_col: str = "text", prefix: str = "") -> DataFrame:
    """docs with weak_bad (the labellers' posterior), score (0 good to 1 bad, from the linear scorer; a score of 0.5 is bad) and keep, named with the prefix."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    added = f"{prefix}weak_bad double, {prefix}score double, {prefix}keep boolean"
    schema = ", ".join([*(f"`{c}` {kind}" for c, kind in docs.dtypes), added])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            found = [features((t.as_py() or "").encode(), m.abuse) for t in b.column(b.schema.get_field_index(text_col))]
            z = np.array([m.weights[f].sum(dtype=np.float64) / math.sqrt(max(1, len(f))) + m.bias for f, _ in found])
            score = 1 / (1 + np.exp(-np.clip(z, -50, 50)))
            weak = posterior(np.array([v for _, v in found])[:, None] >> np.arange(len(LABELLERS)) & 1, m.prior, m.bad, m.good) if found else np.empty(0)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(weak), pa.array(score), pa.array(score < 0.5)], [*b.schema.names, f"{prefix}weak_bad", f"{prefix}score", f"{prefix}keep"])

    return docs.mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per document row: id column, weak_bad, score, keep.

    labels (id, toxic), if given, teach the words of abuse that one labeller looks for, from a bounded sample; without them it knows those given as `abuse` only.
    The measures, votes and accuracies cover all documents. Null and empty texts draw no objection. Repeated rows are judged alike. An empty table gives no row; other columns are left out.
    """
    model = train(docs, labels, id_col, text_col, **options)
    return judge(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")), model, "t").select(F.col("id").alias(id_col), "weak_bad", "score", "keep")
