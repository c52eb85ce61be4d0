"""Helpers that the operators share: tables, staged intermediate results, lower-casing, components."""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_staged: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. Where that is unset, a temporary one if all of Spark is one process, else an error: executors would not share it."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="veilquery-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named


def staged(df: DataFrame) -> DataFrame:
    """Write df as Parquet in the shared folder and read it again: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/veilquery-{uuid.uuid4().hex}"
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(size)
    spark.conf.set(size, str(min(2000, int(was)) if int(was) > 0 else 2000))  # texts can be long: Python workers hold a batch or two
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(size, was)
    _staged.append((spark, path))
    again = spark.read.schema(df.schema).parquet(path)
    again.staged_path = path
    spark._jvm.System.gc()  # the shuffles behind the table are not read again; Spark deletes their files once the driver notices
    return again


def drop_staged(df: DataFrame) -> None:
    """Delete a staged table that nothing reads any more."""
    spark, path = df.sparkSession, df.staged_path
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    _staged.remove((spark, path))


@atexit.register
def _drop_all() -> None:
    for spark, path in list(_staged):
        with contextlib.suppress(Exception):  # the session may have ended
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def ascii_lower(text: Column) -> Column:
    """A-Z lowered and nothing else; texts of ASCII only take the fast path."""
    text = F.coalesce(text, F.lit(""))
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once for each row, however often the lambdas in body read it."""
    return F.transform(F.array(value), body)[0]


def components(edges: DataFrame) -> DataFrame:
    """Connected components of the edges (a, b): (node, component), the component being its smallest node.

    Alternating large-star and small-star rounds; each round is staged, so no link reaches the driver and the lineage stays short.
    """

    def stars(e: DataFrame) -> DataFrame:
        both = e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        pairs = large.join(least, "a")
        return pairs.select("a", F.col("m").alias("b")).union(pairs.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))).distinct()

    def mark(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").bitwiseAND(F.lit((1 << 40) - 1)))).first())

    edges = staged(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    was = mark(edges)
    while was[0]:
        rounds = staged(stars(edges))
        drop_staged(edges)
        edges, now = rounds, mark(rounds)
        if now == was:
            break
        was = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def plain_words(text: Column) -> Column:
    """Words of letters, digits and non-ASCII characters, A-Z lowered; null: none."""
    return F.array_remove(F.split(ascii_lower(text), NOT_WORD), "")


def word_grams(words: Column, size: int) -> Column:
    """gram_hashes of any expression for words."""
    return let(words, lambda w: gram_hashes(w, size))


def gram_hashes(words: Column, size: int) -> Column:
    """64-bit hashes of all word n-grams, by position; words must be a lambda's variable or a column, not an expression."""
    grams = F.transform(F.sequence(F.lit(0), F.size(words) - size), lambda i: F.xxhash64(F.lit(size), *(F.get(words, i + j) for j in range(size))))
    return F.when(F.size(words) >= size, grams).otherwise(F.expr("cast(array() as array<bigint>)"))


def row_key(id_col: str, text_col: str) -> list[Column]:
    """Names a row by id and text, so that repeated ids with other texts stay apart."""
    return [F.col(id_col).alias("id"), F.xxhash64(text_col).alias("tk")]


def join_rows(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    """Join on the row key (id, tk), a null id being equal to itself; only the left key stays."""
    right = right.withColumnsRenamed({"id": "right_id", "tk": "right_tk"})
    return left.join(right, F.col("id").eqNullSafe(F.col("right_id")) & (F.col("tk") == F.col("right_tk")), how).drop("right_id", "right_tk")


def shingles(words: list[bytes], size: int = 5) -> np.ndarray:
    """64-bit hashes of all word shingles by position, mixed from the words' own hashes; fewer words: of the whole sequence; none: empty."""
    w = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    if len(w) == 0:
        return w
    size = min(size, len(w))
    n, p = len(w) - size + 1, np.uint64(0x9E3779B185EBCA87)
    with np.errstate(over="ignore"):
        h = np.full(n, 42, np.uint64)
        for j in range(size):
            h = (h ^ w[j : j + n]) * p
            h ^= h >> np.uint64(31)
    return h


def record(rows: list[tuple], types: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)


def few(keys: DataFrame, most: int = 1_000_000) -> DataFrame:
    """keys marked for broadcast if they are counted to be few, else as they are, for a join that shuffles."""
    return F.broadcast(keys) if keys.limit(most + 1).count() <= most else keys


def narrowed(rows: DataFrame, keys: DataFrame, column: str, most: int = 1_000_000) -> DataFrame:
    """rows whose column is in keys, so that a following join shuffles less: the keys are broadcast if they are few, else nothing is done."""
    keys = keys.select(column).distinct()
    return rows.join(F.broadcast(keys), column, "left_semi") if keys.limit(most + 1).count() <= most else rows


def spread_join(rows: DataFrame, keys: DataFrame, on: list[str], weight: str, by: list[str], how: str = "inner", ways: int = 64, share: float = 1e-3) -> DataFrame:
    """rows joined with keys (distinct in `on`, each with its number of rows as `weight`), hot keys dealt over `ways` tasks by a hash of the columns `by`.

    A key is hot from `share` of all weight on, so 1 / share keys are hot at most: these, and no others, are broadcast to mark the rows.
    """
    total = keys.agg(F.sum(weight)).first()[0] or 0
    hot = F.col(weight) > share * total
    marked = rows.join(F.broadcast(keys.where(hot).select(*on, F.lit(ways).alias("__ways"))), on, "left")
    left = marked.withColumn("__salt", F.pmod(F.xxhash64(*by), F.coalesce("__ways", F.lit(1)).cast("long"))).drop("__ways")
    right = keys.withColumn("__salt", F.explode(F.sequence(F.lit(0).cast("long"), F.when(hot, F.lit(ways - 1)).otherwise(F.lit(0)).cast("long"))))
    return left.join(right, [*on, "__salt"], how).drop("__salt")
