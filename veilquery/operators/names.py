"""Names of persons: parsed into their parts, whose surrogates start with the letter that the document's drawn mapping gives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilquery.functions.draws import LOWER, draw, key
from veilquery.operators.surrogates import initials, letter_map

#: Prepositions of Dutch last names.
PREPOSITIONS = ["van", "den", "v.d.", "vd", "de", "der", "'t", "ten", "ter", "at", "op"]
TITLES = ["mw", "dhr", "mevr", "mevrouw", "meneer", "mr", "mrs", "ms", "dr", "drs", "ir", "ing", "prof"]
SUFFIXES = [r"ph\.?d\.?", r"m\.?d\.?", r"msc\.?", r"bsc\.?", r"jr\.?", r"sr\.?", "ii", "iii", "iv"]
PREPOSITION = "(?:" + "|".join(p.replace(".", r"\.") for p in PREPOSITIONS) + ")"
TITLE = r"^((?:(?i:" + "|".join(TITLES) + r")\.?(?:\s+|$))*)"
SUFFIX = r"((?:\s*,?\s+(?i:" + "|".join(SUFFIXES) + r"))*\s*)$"
#: First name, gap, middle names, gap, last name from its first preposition on.
PLAIN = rf"^(\S+)(\s+)((?:\S.*?)??)(\s*)((?<=\s)(?:(?i:{PREPOSITION})\s.*|\S+))$"
#: Last name, comma, first name, gap, middle names.
COMMA = r"^([^,]*[^,\s])(\s*,\s*)([^,\s]+)(\s*)([^,]*)$"
#: Accented Latin letters of names and the plain ones they are filed under.
ACCENTED = "àáâãäåāăąçćčďđèéêëēęěğìíîïīįıķĺľłñńňòóôõöøōőŕřśşšșťţțùúûüūůűýÿźżž"
FILED = "aaaaaaaaacccddeeeeeeegiiiiiiiklllnnnoooooooorrsssstttuuuuuuuyyzzz"


def letter(text: Column) -> Column:
    """The plain lower-case letter that a name is filed under; empty if it starts with none."""
    return F.regexp_extract(F.translate(F.lower(F.left(text, F.lit(1))), ACCENTED, FILED), "^[a-z]$", 0)


def without_prepositions(text: Column) -> Column:
    """The name behind its leading prepositions."""
    return F.regexp_replace(text, rf"^(?:(?i:{PREPOSITION})\s+)+", "")


def is_initials(text: Column) -> Column:
    return text.rlike(r"^[A-Z.]+$")


def parse(text: Column) -> Column:
    """Struct of title, first, gap1, middle, gap2, last, suffix and whether the last name comes first; pieces joined give the text.

    A single word is a first name, or the last name behind a title; a text that starts with a preposition is a last name. Null stays null.
    """
    title = F.regexp_extract(text, TITLE, 1)
    rest = F.substring(text, F.length(title) + 1, F.length(text))
    suffix = F.when(rest.rlike(r"^\S+$"), "").otherwise(F.regexp_extract(rest, SUFFIX, 1))
    core = F.substring(rest, F.lit(1), F.length(rest) - F.length(suffix))
    part = lambda pattern, k: F.regexp_extract(core, pattern, k)
    made = lambda turned, *p: F.struct(title.alias("title"), *(x.alias(n) for n, x in zip(("first", "gap1", "middle", "gap2", "last"), p, strict=True)), suffix.alias("suffix"), F.lit(turned).alias("turned"))
    none = F.lit("")
    return (
        F.when(text.isNull(), None)
        .when(core.rlike(COMMA), made(True, part(COMMA, 3), part(COMMA, 2), part(COMMA, 5), part(COMMA, 4), part(COMMA, 1)))
        .when(core.rlike(rf"^(?i:{PREPOSITION})\s") | ((title != "") & core.rlike(r"^\S+$")), made(False, none, none, none, none, core))
        .when(core.rlike(PLAIN), made(False, *(part(PLAIN, k) for k in range(1, 6))))
        .otherwise(made(False, core, none, none, none, none))
    )


def restored(model: Column, text: Column) -> Column:
    """text with the case of the model's first letter."""
    head = F.left(text, F.lit(1))
    return F.concat(F.when(F.left(model, F.lit(1)).rlike(r"^\p{Ll}"), F.lower(head)).otherwise(F.upper(head)), F.substring(text, F.lit(2), F.length(text)))


def mapped(one: Column, letters: Column) -> Column:
    return F.when(one != "", F.substring(letters, F.position(one, F.lit(LOWER)), F.lit(1)))


def surrogates(spans: DataFrame, first_names: DataFrame, last_names: DataFrame, seed: int = 42, maps: tuple[Column, Column] | None = None) -> DataFrame:
    """spans (doc, text, ..) with `surrogate`; equal names of a document get equal ones. Titles and suffixes stay.

    first_names (name, gender m or f; names in no list count as f) and last_names (prefix, name) are tables, joined by letter and drawn rank; Spark
    broadcasts them if they are small. maps: letters for a-z of first and last names in place of the ones drawn for the document. The surrogate is
    null where a part has no letter or no name is listed for its letter, and where nothing changes.
    """
    firsts = maps[0] if maps else letter_map(key(seed, F.col("doc"), F.lit("letters")))
    lasts = maps[1] if maps else letter_map(key(seed, F.col("doc"), F.lit("last letters")))
    names = spans.select("doc", "text").where("text is not null").distinct().withColumn("p", parse(F.col("text")))
    piece = lambda role, i, t: F.struct(F.lit(role).alias("role"), i.alias("i"), t.alias("part"))
    middle = F.filter(F.split("p.middle", r"\s+"), lambda x: x != "")
    pieces = F.concat(F.array(piece("first", F.lit(-1), F.col("p.first")), piece("last", F.lit(-1), F.col("p.last"))), F.transform(middle, lambda x, i: piece("middle", i, x)))
    parts = names.select("doc", "text", F.explode(F.filter(pieces, lambda x: x["part"] != "")).alias("x")).select("doc", "text", "x.*")
    last = F.col("role") == "last"
    bare = F.when(last, without_prepositions(F.col("part"))).otherwise(F.col("part"))
    own = parts.select("doc", "text", "role", "i", "part", bare.alias("bare"), F.lower("part").alias("low"), (~last & is_initials(F.col("part"))).alias("short"))
    own = own.withColumn("letter", F.when(last, mapped(letter(bare), lasts)).otherwise(mapped(letter(bare), firsts)))

    # genders of listed names; a name in both lists is male
    listed = first_names.select(F.lower("name").alias("low"), "gender").groupBy("low").agg(F.max(F.col("gender") == "m").alias("male"))
    own = own.join(listed, "low", "left").withColumn("list", F.when(last, "l").when(F.coalesce("male", F.lit(False)), "m").otherwise("f"))
    given = first_names.select(F.when(F.col("gender") == "m", "m").otherwise("f").alias("list"), F.lit("").alias("prefix"), "name")
    files = given.union(last_names.select(F.lit("l"), F.coalesce("prefix", F.lit("")), "name")).distinct().withColumn("letter", letter(F.col("name"))).where("letter <> ''")
    files = files.withColumn("rank", F.row_number().over(Window.partitionBy("list", "letter").orderBy("name", "prefix")) - 1)
    sizes = files.groupBy("list", "letter").agg(F.count(F.lit(1)).alias("n"))
    own = own.join(sizes, ["list", "letter"], "left").withColumn("rank", draw(key(seed, F.col("doc"), F.col("list"), F.col("low")), F.coalesce("n", F.lit(1))))
    found = own.join(files, ["list", "letter", "rank"], "left")
    chosen = F.when(F.col("short"), initials(F.col("part"), F.lit(""), firsts)).otherwise(F.concat(F.when(F.col("prefix") != "", F.concat("prefix", F.lit(" "))).otherwise(""), restored(F.col("bare"), F.col("name"))))
    per = found.select("doc", "text", F.struct("role", "i", chosen.alias("new")).alias("x")).groupBy("doc", "text").agg(F.array_sort(F.collect_list("x")).alias("all"))
    per = names.join(per, ["doc", "text"], "left")
    of = lambda role: F.filter("all", lambda x: x["role"] == role)
    whole = lambda role: F.when(F.size(of(role)) > 0, F.get(of(role), F.lit(0))["new"]).otherwise("")
    # a null among the middle names makes the whole null
    inner = F.when(F.exists(of("middle"), lambda x: x["new"].isNull()), None).otherwise(F.array_join(F.transform(of("middle"), lambda x: x["new"]), " "))
    p = F.col("p")
    new = F.when(p["turned"], F.concat(p["title"], whole("last"), p["gap1"], whole("first"), p["gap2"], inner, p["suffix"])).otherwise(F.concat(p["title"], whole("first"), p["gap1"], inner, p["gap2"], whole("last"), p["suffix"]))
    made = per.select("doc", "text", F.when(new != F.col("text"), new).alias("surrogate"))
    return spans.join(made, ["doc", "text"], "left").select(*spans.columns, "surrogate")
