"""Document fingerprints: weighted term hashes vote on signed bits; permuted block tables find near ones."""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilquery.llm.common import staged

BITS = 128


def fingerprint(text: str) -> np.ndarray:
    """128 bits as 16 bytes. Terms are pairs of neighbouring words (a single word stands alone), weighted by 1 + ln of their count."""
    words = text.lower().encode().split()
    terms = Counter(map(b" ".join, zip(words, words[1:], strict=False)) if len(words) > 1 else words)
    if not terms:
        return np.zeros(BITS // 8, np.uint8)
    digest = xxhash.xxh3_128_digest
    bits = np.unpackbits(np.frombuffer(b"".join(map(digest, terms)), np.uint8).reshape(-1, BITS // 8), axis=1)
    counts = np.fromiter(terms.values(), np.float64, len(terms))
    weights = np.ones(len(terms)) if len(words) == len(terms) + 1 else 1 + np.log(counts)
    return np.packbits(weights @ bits * 2 > weights.sum())


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of equal bits."""
    return 1 - int(np.bitwise_count(a ^ b).sum()) / BITS


def edited(text: str, following: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


FIELDS = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _compared(text: str, following: str) -> tuple:
    new = edited(text, following)
    own, its, other = fingerprint(text), fingerprint(new), fingerprint(following)
    return len(text), hashlib.sha256(new.encode()).hexdigest(), own.tobytes().hex(), its.tobytes().hex(), likeness(own, its), likeness(own, other)


def with_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row (id, FIELDS) beside the next in descending id order; equal ids by the text's hash, rows without an id last, and the first follows the last.

    Texts are dealt by ranges of the id and of the text's hash and sorted, once; the sample that finds the ranges holds no text. Within a
    part each row waits for the next; the last of a part waits for the first of the next part, and these few (two for each part) are
    compared apart.
    """
    parts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("h"), text.alias("t"))
    rows = rows.repartitionByRange(parts, F.col("id").desc_nulls_last(), F.col("h"))
    rows = rows.sortWithinPartitions(F.col("id").desc_nulls_last(), F.col("h"), F.col("t")).select("id", "t")
    schema = f"id long, {FIELDS}, part int, head string, tail string"
    types = [pa.int64(), pa.int64(), *[pa.string()] * 3, *[pa.float64()] * 2, pa.int32(), pa.string(), pa.string()]
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, head = TaskContext.get().partitionId(), None, None
        for b in batches:
            out = []
            for key, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                text = text.as_py()
                if last is None:
                    head = text
                else:
                    out.append((last[0], *_compared(last[1], text), None, None, None))
                last = key, text
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)
        if last is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((last[0], *[None] * 6, part, head, last[1]), types, strict=True)], names)

    done = staged(rows.mapInArrow(run, schema))
    ends = done.where("part is not null")
    order = sorted(r.part for r in ends.select("part").collect())  # one number for each part
    if not order:
        return done.drop("part", "head", "tail")
    follows = docs.sparkSession.createDataFrame([(p, order[(i + 1) % len(order)]) for i, p in enumerate(order)], "part int, following int")
    heads = ends.select(F.col("part").alias("following"), F.col("head").alias("h"))
    waiting = ends.select("id", "part", "tail").join(F.broadcast(follows), "part").join(heads, "following").select("id", "tail", "h")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [(key, *_compared(a, c)) for key, a, c in zip(*(x.to_pylist() for x in b.columns), strict=True)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=False)], names[:7])

    return done.where("part is null").drop("part", "head", "tail").union(waiting.mapInArrow(meet, f"id long, {FIELDS}"))


def neighbours(queries: DataFrame, index: DataFrame, radius: int = 3) -> DataFrame:
    """Pairs (fingerprint, near, distance) of distinct fingerprints (32 hex digits) at Hamming distance up to radius: all, none twice.

    The bits are cut into radius + 1 blocks; two fingerprints so near agree in one block at least. Each table holds the index
    with one block moved to the front, and the join is on that block; a pair is taken in the first block that agrees.
    """
    blocks = radius + 1
    if BITS % (4 * blocks):
        raise ValueError("radius + 1 must divide the 32 digits")
    width = BITS // 4 // blocks
    cut = lambda c, k: F.substring(c, k * width + 1, width)
    tables = lambda df, name: df.select(F.col("fingerprint").alias(name)).distinct().select(name, F.posexplode(F.array(*(cut(F.col(name), k) for k in range(blocks)))).alias("block", "front"))
    left, right = tables(queries, "fingerprint"), tables(index, "near")
    first = F.lit(blocks)
    for k in reversed(range(blocks)):
        first = F.when(cut(F.col("fingerprint"), k) == cut(F.col("near"), k), k).otherwise(first)
    half = lambda c, k: F.conv(F.substring(c, 1 + 16 * k, 16), 16, -10).cast("long")
    distance = sum((F.bit_count(half("fingerprint", k).bitwiseXOR(half("near", k))) for k in (0, 1)), F.lit(0))
    return left.join(right, (left["block"] == right["block"]) & (left["front"] == right["front"]) & (first == left["block"]) & (distance <= radius)).select("fingerprint", "near", distance.alias("distance"))


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 3, every: int = 50) -> DataFrame:
    """One row per document row: id column, FIELDS and n_near: how many other rows lie within radius, asked for ids divisible by `every` (else null).

    Null and empty texts have n_chars 0 and fingerprint zero. An empty table gives no row; a single row follows itself. Ids are whole numbers.
    """
    rows = staged(with_edits(docs, id_col, text_col))
    counts = staged(rows.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("rows"), F.max(F.expr(f"coalesce(id % {every} = 0, false)")).alias("asked")))
    pairs = neighbours(counts.where("asked"), counts, radius)
    near = pairs.join(counts.select(F.col("fingerprint").alias("near"), "rows"), "near").groupBy("fingerprint").agg((F.sum("rows") - 1).alias("n_near"))
    asked = rows.where(f"id % {every} = 0").join(near, "fingerprint", "left").select(rows.columns + ["n_near"])
    rest = rows.where(f"coalesce(id % {every} <> 0, true)").withColumn("n_near", F.lit(None).cast("long"))
    return asked.union(rest).withColumnRenamed("id", id_col)
