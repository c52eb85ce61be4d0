"""Surrogates for the spans of a corpus: each tag has its generator, tags without one are shuffled over the corpus."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilquery.operators import dates, locations, names, surrogates

DIRECT = ["ID", "SSN", "Email", "URL_IP", "Phone_fax", "Age", "Initials", "Other"]


@dataclass
class Gazetteers:
    """Tables of names to draw from, and the countries that stay as they are."""

    first_names: DataFrame  #: name, gender (m or f)
    last_names: DataFrame  #: prefix, name
    addresses: DataFrame  #: postcode, plaats, straat
    countries: list[str] = field(default_factory=list)


def surrogate_spans(spans: DataFrame, gazetteers: Gazetteers, seed: int = 42) -> DataFrame:
    """(doc, start, end, tag, text, surrogate) for spans (doc, start, end, tag, text); null where none can be made.

    Spans are read once for each of the five ways, so hand in a table rather than a tagger's plan. Only dates and shuffled tags are shuffled
    by document; the direct ones stay where they are.
    """
    spans = spans.select("doc", "start", "end", "tag", "text")
    of = lambda *tags: spans.where(F.col("tag").isin(*tags))
    whole = F.struct("tag", "text")
    parts = [
        of(*DIRECT).withColumn("surrogate", surrogates.by_tag(whole, F.col("doc"), seed)),
        names.surrogates(of("Name"), gazetteers.first_names, gazetteers.last_names, seed),
        locations.surrogates(of("Address"), gazetteers.addresses, gazetteers.countries, seed),
        dates.surrogates(of("Date"), seed),
    ]
    rest = spans.where(~F.coalesce(F.col("tag").isin(*DIRECT, "Name", "Address", "Date"), F.lit(False)))
    parts.append(rest.join(surrogates.corpus_shuffle(rest, seed), ["doc", "tag", "text"], "left").select(*spans.columns, "surrogate"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def attach(docs: DataFrame, rows: DataFrame, id_col: str, output: str = "spans") -> DataFrame:
    """docs with the rows of surrogate_spans as an array, empty for documents without any; ready for rewrite.apply_surrogates."""
    per = rows.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("start", "end", "tag", "text", "surrogate"))).alias(output))
    none = F.expr("cast(array() as array<struct<start:int,end:int,tag:string,text:string,surrogate:string>>)")
    return docs.join(per, docs[id_col].eqNullSafe(per["doc"]), "left").drop("doc").withColumn(output, F.coalesce(output, none))
