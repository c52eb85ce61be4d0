"""Benchmark decontamination by winnowing: fingerprints of both sides are joined, and hits extended to whole windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilquery.llm.common import gram_hashes, join_rows, let, plain_words, row_key, staged


def winnowed(words: Column, window: int, gram: int) -> Column:
    """The least gram hash of each run of grams that a span of `window` words holds: equal spans share one at least. words: a column or a lambda's variable."""
    run = window - gram + 1
    none = F.expr("cast(array() as array<bigint>)")
    if run == 1:
        return F.array_distinct(gram_hashes(words, gram))
    least = lambda h: F.transform(F.sequence(F.lit(1), F.size(h) - (run - 1)), lambda i: F.array_min(F.slice(h, i, run)))
    return F.when(F.size(words) >= window, let(gram_hashes(words, gram), lambda h: F.array_distinct(least(h)))).otherwise(none)


def spans(words: Column, window: int) -> Column:
    """All runs of `window` words as text, by position."""
    cut = lambda w: F.when(F.size(w) >= window, F.transform(F.sequence(F.lit(1), F.size(w) - (window - 1)), lambda i: F.concat_ws(" ", F.slice(w, i, window))))
    return let(words, cut)


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = 13, gram: int = 5) -> DataFrame:
    """One row per document row: id column, n_words, n_hit, n_items, items_sha256, contaminated.

    A window is `window` consecutive words of an item, or the whole item if it has fewer; every document word inside an
    occurrence is hit. Items without words have no window. Null texts have no words and are clean. Short items are matched through
    grams of their own length (one more pass for each such length, at most window - 1 of them). Repeated rows and ids are
    judged by row; an empty benchmark leaves all documents clean. Only document ids and positions near a shared fingerprint are
    joined; the benchmark's sides are staged, so Spark broadcasts them by their real size or else sorts and merges.
    """
    items = staged(benchmark.select(F.col(item_col).cast("string").alias("item"), plain_words(F.col(item_text)).alias("words")).where("size(words) > 0"))
    items = items.withColumn("len", F.least(F.size("words"), F.lit(window)))
    sizes = sorted(r.len for r in items.select("len").distinct().collect())  # window values at most
    rows = docs.select(*row_key(id_col, text_col), plain_words(F.col(text_col)).alias("words"))
    counts = rows.select("id", "tk", F.size("words").cast("long").alias("n_words"))
    if not sizes:
        return _report(counts, id_col, None, None)
    grams = {n: (gram if n == window else n) for n in sizes}
    prints = staged(_union(items.where(F.col("len") == n).select(F.lit(n).alias("len"), F.explode(winnowed(F.col("words"), n, g)).alias("h")) for n, g in grams.items()).distinct())
    windows = staged(_union(items.where(F.col("len") == n).select(F.lit(n).alias("len"), F.explode(spans(F.col("words"), n)).alias("span"), "item") for n in sizes).distinct())
    # documents that share a fingerprint; the words are cut once for all lengths
    named = lambda n: lambda h: F.struct(F.lit(n).alias("len"), h.alias("h"))
    every = lambda w: F.concat(*(F.transform(winnowed(w, n, g), named(n)) for n, g in grams.items()))
    mine = docs.select(*row_key(id_col, text_col), F.explode(let(plain_words(F.col(text_col)), every)).alias("x")).select("id", "tk", "x.*")
    shared = staged(mine.join(prints, ["len", "h"], "left_semi").select("id", "tk").distinct())
    texts = docs.select(*row_key(id_col, text_col), F.col(text_col).alias("t"))
    texts = join_rows(texts, shared, "left_semi").dropDuplicates(["id", "tk"])
    texts = staged(texts.select("id", "tk", plain_words(F.col("t")).alias("words")))
    # places of shared grams, without the words; then each document's places are extended to the windows around them, which are compared as text
    place = lambda n, g: lambda h, i: F.struct(F.lit(n).alias("len"), F.lit(n - g).alias("back"), i.alias("pos"), h.alias("h"))
    at = texts.select("id", "tk", F.explode(F.concat(*(F.transform(gram_hashes(F.col("words"), g), place(n, g)) for n, g in grams.items()))).alias("x"))
    at = at.select("id", "tk", "x.*").join(prints, ["len", "h"], "left_semi").groupBy("id", "tk").agg(F.collect_list(F.struct("len", "back", "pos")).alias("places"))  # of one document
    low, high = lambda p: F.greatest(F.lit(0), p["pos"] - p["back"]), lambda p: F.least(p["pos"], F.size("words") - p["len"])
    fits = F.filter("places", lambda p: low(p) <= high(p))
    around = F.array_distinct(F.flatten(F.transform(fits, lambda p: F.transform(F.sequence(low(p), high(p)), lambda s: F.struct(p["len"].alias("len"), s.alias("start"))))))
    hits = join_rows(at, texts).select("id", "tk", "words", F.explode(around).alias("x")).select("id", "tk", "x.*", F.concat_ws(" ", F.slice("words", F.col("x.start") + 1, F.col("x.len"))).alias("span"))
    hits = staged(hits.join(windows.select("len", "span").distinct(), ["len", "span"], "left_semi"))
    covered = F.aggregate(
        F.array_sort("runs"),
        F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
        lambda acc, x: F.struct(F.greatest(acc["end"], x["start"] + x["len"]).alias("end"), (acc["n"] + F.greatest(F.lit(0), x["start"] + x["len"] - F.greatest(acc["end"], x["start"]))).alias("n")),
    )["n"]
    covers = hits.groupBy("id", "tk").agg(F.collect_set(F.struct("start", "len")).alias("runs")).select("id", "tk", covered.cast("long").alias("n_hit"))
    found = hits.select("id", "tk", "len", "span").distinct().join(windows, ["len", "span"]).select("id", "tk", "item").distinct()
    found = found.groupBy("id", "tk").agg(F.count(F.lit(1)).alias("n_items"), F.array_join(F.array_sort(F.collect_list("item")), ",").alias("items"))
    return _report(counts, id_col, covers, found)


def _report(counts: DataFrame, id_col: str, covers: DataFrame | None, found: DataFrame | None) -> DataFrame:
    if covers is None:
        out = counts.withColumns({"n_hit": F.lit(0).cast("long"), "n_items": F.lit(0).cast("long"), "items": F.lit("")})
    else:
        out = join_rows(counts, join_rows(covers, found), "left")
    n_hit = F.coalesce("n_hit", F.lit(0))
    return out.select(
        F.col("id").alias(id_col),
        "n_words",
        n_hit.cast("long").alias("n_hit"),
        F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce("items", F.lit("")), 256).alias("items_sha256"),
        ((n_hit > 0) & (n_hit * 20 >= F.col("n_words"))).alias("contaminated"),
    )


def _union(parts) -> DataFrame:
    first, *rest = parts
    for x in rest:
        first = first.union(x)
    return first
