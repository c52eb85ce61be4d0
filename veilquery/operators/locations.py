"""Places and addresses: parsed by zip code, house number and street endings; the parts get drawn ones, countries stay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilquery.functions.draws import draw, key, scramble
from veilquery.operators.surrogates import zip_code

#: Formats of zip codes and house numbers, and the endings of street names.
ZIP = r"(?i)[0-9]{4}\s?[a-z]{2}"
NUMBER = r"(?i)(?:[0-9]+-?)+(?:\w|\s\w\b)?"
STREETS = "straat laan hof plein plantsoen gracht kade weg burg strjitte veld steeg pad dijk baan dam dreef markt park singel bolwerk".split()
STREET = r"(?iU)\w*(?:" + "|".join(STREETS) + ")"


def stripped(text: Column) -> Column:
    """Without what is no word character at both ends."""
    return F.regexp_replace(text, r"(?U)^\W+|\W+$", "")


def parse(text: Column, countries: list[str]) -> Column:
    """Struct of country, zip_code, place, street, house_number; parts that aren't there are empty. countries: a short list of single words.

    What precedes the zip code is the street, what follows the place; without one the house number parts them, else the street's ending, and without
    that all is place. The country is the last word of the place that the list holds. Null stays null.
    """
    before = lambda pattern, inside: F.regexp_extract(text, rf"(?s)^(.*?{pattern})" if inside else rf"(?s)^(.*?){pattern}", 1)
    code = F.regexp_extract(text, ZIP, 0)
    left = F.when(code != "", before(ZIP, False)).when(text.rlike(NUMBER), before(NUMBER, True)).when(text.rlike(STREET), before(STREET, True)).otherwise("")
    right = F.substring(text, F.length(left) + F.length(code) + 1, F.length(text))
    number = F.regexp_extract(left, NUMBER, 0)
    street = F.when(number != "", F.replace(left, number, F.lit(""))).otherwise(left)
    known = F.array(*(F.lit(c.lower()) for c in countries)) if countries else F.expr("cast(array() as array<string>)")
    words = F.filter(F.regexp_extract_all(right, F.lit(r"(?U)[\w-]+"), F.lit(0)), lambda w: F.array_contains(known, F.lower(w)))
    country = F.coalesce(F.try_element_at(words, F.lit(-1)), F.lit(""))
    place = F.when(country != "", F.replace(right, country, F.lit(""))).otherwise(right)
    parts = {"country": country, "zip_code": code, "place": place, "street": street, "house_number": number}
    return F.when(text.isNotNull(), F.struct(*(stripped(c).alias(n) for n, c in parts.items())))


def surrogates(spans: DataFrame, gazetteer: DataFrame, countries: list[str], seed: int = 42) -> DataFrame:
    """spans (doc, text, ..) with `surrogate`; equal parts of a document get equal ones, whatever their case, and countries stay.

    gazetteer (postcode, plaats, straat): a table, joined by drawn rank; Spark broadcasts it if it is small. Its columns are drawn one by one, so the
    parts of a surrogate needn't fit. The surrogate is null only for null texts, and where the gazetteer lacks a kind of part.
    """
    kinds = {"zip_code": "postcode", "place": "plaats", "street": "straat"}
    values = gazetteer.select(F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(c).cast("string").alias("value")) for k, c in kinds.items()))).alias("x")).select("x.*").where("value is not null").distinct()
    values = values.withColumn("rank", F.row_number().over(Window.partitionBy("kind").orderBy("value")) - 1)
    sizes = values.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))
    places = spans.select("doc", "text").where("text is not null").distinct().withColumn("p", parse(F.col("text"), countries))
    parts = places.select("doc", "text", F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(f"p.{k}").alias("part")) for k in kinds))).alias("x")).select("doc", "text", "x.*").where("part <> ''")
    # the three sizes ride along by a join on the kind
    drawn = parts.join(sizes, "kind", "left").withColumn("rank", draw(key(seed, F.col("doc"), F.col("kind"), F.lower("part")), F.coalesce("n", F.lit(1))))
    drawn = drawn.join(values, ["kind", "rank"], "left").groupBy("doc", "text").agg(*(F.max(F.when(F.col("kind") == k, F.col("value"))).alias(f"new_{k}") for k in kinds))
    rows = places.join(drawn, ["doc", "text"], "left")
    new = {
        "zip_code": zip_code(F.col("p.zip_code"), F.col("new_zip_code")),
        "place": F.col("new_place"),
        "street": F.col("new_street"),
        "house_number": scramble(F.col("p.house_number"), key(seed, F.col("doc"), F.lit("house"), F.lower("p.house_number"))),
    }
    # marks of private-use characters hold the places, so that no surrogate is replaced again
    out = F.col("text")
    for i, k in enumerate(new):
        out = F.when(F.col(f"p.{k}") != "", F.replace(out, F.col(f"p.{k}"), F.lit(chr(0xE000 + i)))).otherwise(out)
    for i, (k, value) in enumerate(new.items()):
        out = F.when(F.col(f"p.{k}") != "", F.replace(out, F.lit(chr(0xE000 + i)), value)).otherwise(out)
    return spans.join(rows.select("doc", "text", out.alias("surrogate")), ["doc", "text"], "left").select(*spans.columns, "surrogate")
