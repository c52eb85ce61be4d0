"""License scans by diagonal voting: k-gram hashes are joined with template places, votes gathered by offset diagonal."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veilquery.llm.common import few, gram_hashes, join_rows, let, plain_words, row_key, staged

#: Phrases whose every place counts, with their labels.
PHRASES = [("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")]
#: Openings of public licenses, with their labels.
TEMPLATES = [
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files to deal in the software without restriction"),
    ("mit", "released under the mit license"),
    ("mit", "licensed under the mit license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("public-domain", "this is free and unencumbered software released into the public domain"),
]


def template_table(spark: SparkSession, templates: DataFrame | list[tuple[str, str]], gram: int, least: float) -> DataFrame:
    """(tpl, label, form, k) of templates (label, text) that have words; equal ones are one.

    k: the gram size. If `least` of n words stand on a diagonal, the m others cut them into m + 1 runs at most, so one run has k words or
    more: each place that can count gets a vote.
    """
    if not isinstance(templates, DataFrame):
        templates = spark.createDataFrame(templates, "label string, text string")
    forms = templates.select("label", plain_words(F.col("text")).alias("form")).where("label is not null and size(form) > 0").distinct()
    stand = F.ceil(F.size("form") * F.lit(least) - F.lit(1e-9))
    k = F.least(F.lit(gram), F.ceil(stand / (F.size("form") - stand + 1)))
    return forms.select(F.xxhash64("label", "form").alias("tpl"), "label", "form", F.greatest(F.lit(1), k).cast("int").alias("k"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: DataFrame | list[tuple[str, str]] = TEMPLATES, gram: int = 3, slack: int = 3, least: float = 0.75) -> DataFrame:
    """One row per document row: id column, n_words, n_base, first_word, last_word, base_labels, labels, score.

    templates: a table or list (label, text); tied templates all give their labels. Votes of a document and a template are gathered by diagonal
    (place in the document less place in the template); diagonals at most `slack` apart merge, so that a few inserted or
    dropped words do no harm; a merged span counts if `least` of the template's words really stand on its diagonals. One vote makes
    a span a candidate, and template_table() tells why no place of a template on one diagonal goes without. score: the largest
    such share, 1 where a base phrase stands, else 0. Null and empty texts have no words and no labels; repeated rows are judged alike.
    Without templates only the base phrases count. The template tables are staged: Spark broadcasts them by their real size or
    sorts and merges. Texts are read again only for documents with votes.
    """
    spark = docs.sparkSession
    forms = staged(template_table(spark, templates, gram, least))
    sizes = sorted(r.k for r in forms.select("k").distinct().collect())  # `gram` values at most
    rows = docs.select(*row_key(id_col, text_col), plain_words(F.col(text_col)).alias("words"))
    none = "array<struct<label:string,share:double>>"
    if sizes:
        places = staged(reduce(DataFrame.union, [forms.where(F.col("k") == k).select("tpl", F.posexplode(gram_hashes(F.col("form"), k)).alias("at", "h")) for k in sizes]))
        place = lambda h, i: F.struct(i.alias("pos"), h.alias("h"))
        grams = lambda w: F.concat(*(F.transform(gram_hashes(w, k), place) for k in sizes))
        votes = docs.select(*row_key(id_col, text_col), F.explode(let(plain_words(F.col(text_col)), grams)).alias("x")).select("id", "tk", "x.*").join(places, "h")
        lines = votes.select("id", "tk", "tpl", (F.col("pos") - F.col("at")).alias("diagonal")).distinct()
        order = Window.partitionBy("id", "tk", "tpl").orderBy("diagonal")
        lines = lines.withColumn("new", (F.col("diagonal") - F.lag("diagonal").over(order) > slack).cast("int")).withColumn("part", F.sum(F.coalesce("new", F.lit(0))).over(order))
        merged = lines.groupBy("id", "tk", "tpl", "part").agg(F.collect_list("diagonal").alias("diagonals")).join(forms.select("tpl", "label", "form"), "tpl")
        spans = staged(merged.groupBy("id", "tk").agg(F.collect_list(F.struct("label", "form", "diagonals")).alias("spans")))  # of one document
        texts = docs.select(*row_key(id_col, text_col), F.col(text_col).alias("t"))
        texts = join_rows(texts, few(spans.select("id", "tk")), "left_semi").dropDuplicates(["id", "tk"]).select("id", "tk", plain_words(F.col("t")).alias("words"))
        on_it = lambda s, j: F.exists(s["diagonals"], lambda d: (d + j >= 0) & (F.get(F.col("words"), d + j) == F.get(s["form"], j)))
        stands = lambda s: F.size(F.filter(F.sequence(F.lit(0), F.size(s["form"]) - 1), lambda j: on_it(s, j)))
        shares = F.transform("spans", lambda s: F.struct(s["label"].alias("label"), (stands(s) / F.size(s["form"])).alias("share")))
        found = join_rows(spans, texts).select("id", "tk", F.filter(shares, lambda s: s["share"] >= least).alias("found")).where("size(found) > 0")
    else:
        found = rows.select("id", "tk", F.expr(f"cast(array() as {none})").alias("found")).limit(0)

    likely = F.lit(False)
    here = lambda w, i, phrase: [F.get(w, i + j) == p for j, p in enumerate(phrase.split())]
    for phrase, _ in PHRASES:
        likely = likely | F.array_contains("words", phrase.split()[-1])
    which = lambda w, i: F.coalesce(*(F.when(_all(here(w, i, phrase)), F.struct(i.alias("at"), F.lit(label).alias("label"))) for phrase, label in PHRASES))
    base = F.when(likely, let(F.col("words"), lambda w: F.array_compact(F.transform(F.sequence(F.lit(0), F.size(w) - 1), lambda i: which(w, i)))))
    own = rows.select("id", "tk", F.size("words").cast("long").alias("n_words"), base.alias("base"))
    out = join_rows(own, found, "left").select("id", "n_words", F.coalesce("base", F.expr("cast(array() as array<struct<at:int,label:string>>)")).alias("base"), F.coalesce("found", F.expr(f"cast(array() as {none})")).alias("found"))
    labels = F.transform("base", lambda x: x["label"])
    extra = F.transform("found", lambda x: x["label"])
    return out.select(
        F.col("id").alias(id_col),
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(F.transform("base", lambda x: x["at"])).cast("long").alias("first_word"),
        F.array_max(F.transform("base", lambda x: x["at"])).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(labels)), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(labels, extra)), ",").alias("labels"),
        F.when(F.size("base") > 0, F.lit(1.0)).otherwise(F.coalesce(F.array_max(F.transform("found", lambda x: x["share"])), F.lit(0.0))).alias("score"),
    )


def _all(conditions):
    first, *rest = conditions
    for c in rest:
        first = first & c
    return first
