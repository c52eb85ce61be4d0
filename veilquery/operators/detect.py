"""Rule tagger: patterns give spans with code-point offsets; overlaps fall to the earlier rule, then the earlier and longer span."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Tag and pattern in order of priority; plain ASCII classes, so that other regex engines find the same.
RULES = [
    ("Email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"),
    ("URL_IP", r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}"),
    ("Phone_fax", r"\([0-9]{3}\) [0-9]{3}-[0-9]{4}"),
    ("ID", r"[0-9]{13,16}"),
]
SPAN = "struct<start:int,end:int,tag:string,text:string>"


def matches(text: Column, pattern: str, tag: str) -> Column:
    """All matches as an array of spans. Offsets are running lengths of the pieces between matches and the matches themselves."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.arrays_zip(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found)).alias("gap"), found.alias("hit"))
    start = F.struct(F.lit(0).alias("at"), F.expr(f"cast(array() as array<{SPAN}>)").alias("out"))
    step = lambda acc, p: F.struct(
        (acc["at"] + F.length(p["gap"]) + F.length(p["hit"])).alias("at"),
        F.concat(acc["out"], F.array(F.struct((acc["at"] + F.length(p["gap"])).alias("start"), (acc["at"] + F.length(p["gap"]) + F.length(p["hit"])).alias("end"), F.lit(tag).alias("tag"), p["hit"].alias("text")))).alias("out"),
    )
    return F.when(text.rlike(pattern), F.aggregate(pairs, start, step)["out"]).otherwise(F.expr(f"cast(array() as array<{SPAN}>)"))


def resolved(found: list[Column]) -> Column:
    """Spans of all rules in text order, without those that overlap one of an earlier rule."""
    kept = found[0]
    for more in found[1:]:
        kept = _merge(kept, more)
    return F.array_sort(kept)


def _merge(kept: Column, more: Column) -> Column:
    return F.transform(F.array(kept), lambda k: F.concat(k, F.filter(more, lambda s: ~F.exists(k, lambda o: (o["start"] < s["end"]) & (s["start"] < o["end"])))))[0]


def annotate(docs: DataFrame, text_col: str = "text", rules: list[tuple[str, str]] = RULES, output: str = "spans") -> DataFrame:
    """docs with an array of spans; every document stays, null texts have none. Stateless, so it runs on streams as well."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.withColumn(output, resolved([matches(text, p, t) for t, p in rules]))


def spans(docs: DataFrame, id_col: str, text_col: str = "text", rules: list[tuple[str, str]] = RULES) -> DataFrame:
    """One row per span: doc, start, end, tag, text."""
    return annotate(docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("t")), "t", rules).select("doc", F.explode("spans").alias("s")).select("doc", "s.*")
