"""Corpora: splits, tag distributions, and statistics of documents and terms."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilquery.functions.draws import key


def split(docs: DataFrame, id_col: str, seed: int = 42, cuts: tuple[float, float] = (0.6, 0.8)) -> DataFrame:
    """(id, part): the documents in order of a hash, cut by share into train, dev and test.

    Exact shares need ranks; they are counted per hash bucket first, so no task sorts more than a bucket, and there are as many buckets as keep
    them to some 100,000 documents.
    """
    ranked = in_hash_order(docs, id_col, seed)
    part = F.when(F.col("rank") <= F.floor(F.col("total") * cuts[0]), "train").when(F.col("rank") <= F.floor(F.col("total") * cuts[1]), "dev").otherwise("test")
    return ranked.select(id_col, part.alias("part"))


def in_hash_order(docs: DataFrame, id_col: str, seed: int, rows_each: int = 100_000) -> DataFrame:
    """(id, rank from 1, total) in order of a hash of seed and id."""
    h = F.md5(key(seed, F.col(id_col)))
    digits = max(1, math.ceil(math.log(max(1, docs.count() / rows_each), 16)))
    rows = docs.select(F.col(id_col), h.alias("h"), F.substring(h, 1, digits).alias("bucket"))
    sizes = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))  # a row for each bucket
    ahead = sizes.select("bucket", F.coalesce(F.sum("n").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("ahead"), F.sum("n").over(Window.partitionBy()).alias("total"))
    rank = F.row_number().over(Window.partitionBy("bucket").orderBy("h", id_col)) + F.col("ahead")
    return rows.join(ahead, "bucket").select(id_col, rank.alias("rank"), "total")


def holdout(docs: DataFrame, id_col: str, share: float = 0.2, seed: int = 42) -> DataFrame:
    """(id, part): `share` of the documents, rounded up, as dev, the first by hash; the others as train."""
    ranked = in_hash_order(docs, id_col, seed)
    return ranked.select(id_col, F.when(F.col("rank") <= F.ceil(F.col("total") * share), "dev").otherwise("train").alias("part"))


def predefined_fold(train: DataFrame, dev: DataFrame) -> DataFrame:
    """Both together with fold: -1 for rows that are only learnt from, 0 for those that every trial is scored on."""
    return train.withColumn("fold", F.lit(-1)).unionByName(dev.withColumn("fold", F.lit(0)))


def distribution(spans: DataFrame) -> DataFrame:
    counts = spans.groupBy("tag").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))


def by_part(spans: DataFrame, parts: DataFrame, id_col: str) -> DataFrame:
    """Tags by part, zeros filled."""
    rows = spans.join(parts.withColumnRenamed(id_col, "doc"), "doc")
    return rows.groupBy("tag").pivot("part", ["train", "dev", "test"]).count().na.fill(0)


def counted(tokens: DataFrame) -> DataFrame:
    """Tokens that count: not blank, no metadata."""
    return tokens.where((F.trim("text") != "") & ~F.col("text").rlike(r"^[\x09-\x0D\x20]+$") & ~F.col("text").startswith("==="))


def terms(tokens: DataFrame) -> DataFrame:
    """(term, tf, df) of lower-cased tokens; counted per document first, so the distinct count needs no second pass."""
    per = counted(tokens).groupBy(F.lower("text").alias("term"), "doc").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("term").agg(F.sum("n").alias("tf"), F.count(F.lit(1)).alias("df"))


def vocabulary(tokens: DataFrame) -> DataFrame:
    per = counted(tokens).groupBy("text").agg(F.lower(F.first("text")).alias("term"))
    return per.agg(F.count(F.lit(1)).alias("raw"), F.countDistinct("term").alias("normalised"))


def statistics(tokens: DataFrame) -> DataFrame:
    """Sum, mean, median and population deviation of tokens and punctuation per document."""
    per = counted(tokens).groupBy("doc").agg(F.count(F.lit(1)).alias("tokens"), F.count_if(F.col("text").rlike(r"^[\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E]+$")).alias("punctuation"))
    measures = [F.struct(F.lit(c).alias("measure"), F.col(c).alias("v")) for c in ("tokens", "punctuation")]
    return per.select(F.explode(F.array(*measures)).alias("x")).groupBy("x.measure").agg(F.sum("x.v").alias("total"), F.avg("x.v").alias("mean"), F.median("x.v").alias("median"), F.stddev_pop("x.v").alias("std"))
