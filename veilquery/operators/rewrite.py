"""Rewriting of texts from spans: masks and surrogates are spliced in, and the spans move along."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def default_mask(span: Column) -> Column:
    return F.concat(F.lit("["), F.upper(span["tag"]), F.lit("]"))


def splice(text: Column, spans: Column, replacement: Callable[[Column], Column]) -> Column:
    """text with each span (sorted, not overlapping) replaced."""
    before = lambda i: F.coalesce(F.get(spans, i - 1)["end"], F.lit(0))
    parts = F.transform(spans, lambda s, i: F.concat(F.substring(text, before(i) + 1, s["start"] - before(i)), replacement(s)))
    end = F.coalesce(F.get(spans, F.size(spans) - 1)["end"], F.lit(0))
    return F.when(F.size(spans) == 0, text).otherwise(F.concat(F.array_join(parts, ""), F.substring(text, end + 1, F.length(text) - end)))


def moved(spans: Column, replacement: Callable[[Column], Column]) -> Column:
    """The spans of the rewritten text: each moves by what the earlier ones grew."""
    shift = lambda i: F.aggregate(F.slice(spans, F.lit(1), i), F.lit(0), lambda acc, s: acc + F.length(replacement(s)) - (s["end"] - s["start"]))
    return F.transform(spans, lambda s, i: F.struct((s["start"] + shift(i)).alias("start"), (s["start"] + shift(i) + F.length(replacement(s))).alias("end"), s["tag"].alias("tag"), replacement(s).alias("text")))


def mask(docs: DataFrame, text_col: str = "text", spans_col: str = "spans", formatter: Callable[[Column], Column] = default_mask) -> DataFrame:
    """docs with masked text and the spans of the masks. formatter: from a span to its mask."""
    text, spans = F.col(text_col), F.array_sort(F.col(spans_col))
    return docs.withColumn("masked_text", splice(text, spans, formatter)).withColumn("masked_spans", moved(spans, formatter))


def apply_surrogates(docs: DataFrame, errors: str = "raise", text_col: str = "text", spans_col: str = "spans") -> DataFrame:
    """docs with rewritten text; spans carry a surrogate, which fails where null or empty.

    errors: raise an error, ignore (the text stays) or coerce (the tag in brackets). `failed` lists the spans that failed.
    """
    text, spans = F.col(text_col), F.array_sort(F.col(spans_col))
    bad = lambda s: F.coalesce(s["surrogate"], F.lit("")) == ""
    fallback = {
        "raise": lambda s: F.raise_error(F.concat(F.lit("No surrogate for "), s["tag"], F.lit(" "), s["text"])).cast("string"),
        "ignore": lambda s: s["text"],
        "coerce": lambda s: F.concat(F.lit("["), s["tag"], F.lit("]")),
    }[errors]
    chosen = lambda s: F.when(bad(s), fallback(s)).otherwise(s["surrogate"])
    return docs.withColumn("rewritten", splice(text, spans, chosen)).withColumn("failed", F.filter(spans, bad))


def rewrite_table(docs: DataFrame, id_col: str, spans_col: str = "spans") -> DataFrame:
    """The table that a person checks: one row per span with its surrogate, by document and start."""
    rows = docs.select(F.col(id_col).cast("string").alias("doc_id"), F.posexplode(F.array_sort(F.col(spans_col))).alias("i", "s"))
    return rows.select("doc_id", F.concat(F.lit("T"), F.col("i") + 1).alias("ann_id"), "s.text", "s.start", "s.end", "s.tag", "s.surrogate", F.lit(None).cast("string").alias("manual_surrogate"), F.lit(False).alias("checked"))


def manual_first(table: DataFrame) -> DataFrame:
    """A surrogate entered by hand wins over the drawn one."""
    return table.withColumn("surrogate", F.coalesce("manual_surrogate", "surrogate"))
