"""Surrogates by tag. All draws hash the seed, the document, the tag and the text: equal texts of a document get equal surrogates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilquery.functions.draws import LOWER, UPPER, draw, key, pick, scramble


def identifier(text: Column, k: Column) -> Column:
    return scramble(text, k)


def email(text: Column, k: Column) -> Column:
    """What precedes the last dot is scrambled; without a dot all but the last character is."""
    tail = F.when(text.contains("."), F.regexp_extract(text, r"(\.[^.]*)$", 1)).otherwise(F.right(text, F.lit(1)))
    return F.concat(scramble(F.left(text, F.length(text) - F.length(tail)), k), tail)


#: Parts of an address that stay readable.
KEPT = r"https?|www\.|\.(?:org|com|nl|de|be|co\.uk|gov|net|edu|care)"


def url(text: Column, k: Column) -> Column:
    """Scrambled, but for protocol, www and common endings, which stay in place."""
    gaps, hits = F.split(text, KEPT, -1), F.regexp_extract_all(text, F.lit(KEPT), F.lit(0))
    return F.array_join(F.transform(gaps, lambda g, i: F.concat(scramble(g, F.concat_ws("|", k, i.cast("string"))), F.coalesce(F.get(hits, i), F.lit("")))), "")


def age(text: Column) -> Column:
    """Each number above 89 becomes 89; other text stays. Numbers are judged one by one."""
    return F.regexp_replace(text, r"(?<![0-9])0*(?:9[0-9]|[1-9][0-9]{2,})(?![0-9])", "89")


def letter_map(k: Column) -> Column:
    """A permutation of a-z drawn for k, as text."""
    letters = F.array(*(F.struct(F.md5(F.concat_ws("|", k, F.lit(c))).alias("h"), F.lit(c).alias("c")) for c in LOWER))
    return F.array_join(F.transform(F.array_sort(letters), lambda x: x["c"]), "")


def initials(text: Column, k: Column, letters: Column | None = None) -> Column:
    """Letters mapped by the permutation of k, or by the given one, case kept; all else stays."""
    mapped = letter_map(k) if letters is None else letters
    one = lambda c: F.when(c.rlike("^[a-z]$"), F.substring(mapped, F.position(c, F.lit(LOWER)), F.lit(1))).when(c.rlike("^[A-Z]$"), F.upper(F.substring(mapped, F.position(c, F.lit(UPPER)), F.lit(1)))).otherwise(c)
    return F.array_join(F.transform(F.filter(F.split(text, ""), lambda c: c != ""), one), "")


#: Dutch dial codes.
DIAL_CODES = """
6 10 111 113 114 115 117 118 13 15 161 162 164 165 166 167 168 172 174 180 181 182 183 184 186 187 20 222 223 224 226 227 228 229 23 24 251 252
255 26 294 297 299 30 313 314 315 316 317 318 320 321 33 341 342 343 344 345 346 347 348 35 36 38 40 411 412 413 416 418 43 45 46 475 478 481
485 486 487 488 492 493 495 497 499 50 511 512 513 514 515 516 517 518 519 521 522 523 524 525 527 528 529 53 541 543 544 545 546 547 548 55
561 562 566 570 571 572 573 575 577 578 58 591 592 593 594 595 596 597 598 599 70 71 72 73 74 75 76 77 78 79
""".split()
DIAL = {n: [c for c in DIAL_CODES if len(c) == n] for n in (1, 2, 3)}
#: What a number may be written with; it ends at the first other character.
PHONE_BODY = r"^[+0-9(][0-9()./ -]*"


def phone(text: Column, k: Column) -> Column:
    """Dutch numbers by the numbering plan: country code and trunk 0 stay, the area code becomes a drawn one of its length, the subscriber's digits are drawn, the first not 0.

    All other characters stay where they are, and so does what follows the number. Null where fewer than 7 digits stand at the start.
    """
    body = F.regexp_extract(text, PHONE_BODY, 0)
    digits = F.regexp_replace(body, "[^0-9]", "")
    country = F.when(F.startswith(body, F.lit("+31")), 2).when(F.startswith(body, F.lit("0031")), 4).otherwise(0)
    trunk = country + F.when(F.substring(digits, country + 1, F.lit(1)) == "0", 1).otherwise(0)
    area = F.lit(0)
    code = F.lit("")
    for n, values in DIAL.items():  # of codes that begin alike the longest counts
        fits = F.substring(digits, trunk + 1, F.lit(n)).isin(values)
        area = F.when(fits, n).otherwise(area)
        code = F.when(fits, F.get(F.array(*map(F.lit, values)), draw(F.concat_ws("|", k, F.lit("dial")), len(values)).cast("int"))).otherwise(code)
    own = trunk + area
    drawn = lambda i: F.when(i == own, pick(F.concat_ws("|", k, F.lit("0")), "123456789")).otherwise(pick(F.concat_ws("|", k, (i - own).cast("string")), "0123456789"))
    digit = lambda i, c: F.when(i < trunk, c).when(i < own, F.substring(code, i - trunk + 1, F.lit(1))).otherwise(drawn(i))
    ahead = lambda i: F.length(F.regexp_replace(F.substring(body, F.lit(1), i), "[^0-9]", ""))
    made = F.transform(F.filter(F.split(body, ""), lambda c: c != ""), lambda c, i: F.when(c.rlike("[0-9]"), digit(ahead(i), c)).otherwise(c))
    return F.when(F.length(digits) >= 7, F.concat(F.array_join(made, ""), F.substring(text, F.length(body) + 1, F.length(text))))


def zip_code(text: Column, sample: Column) -> Column:
    """Digits and letters of the sample code in the layout of the text."""
    digits, letters = F.regexp_extract(sample, "[0-9]{4}", 0), F.regexp_extract(sample, "[A-Za-z]{2}", 0)
    return F.regexp_replace(F.regexp_replace(text, F.lit("[0-9]{4}"), digits), F.lit("[A-Za-z]{2}"), letters)


def season_offsets(day: Column) -> Column:
    """Days since the first day of the season and to its last one; seasons start on 21-3, 21-6, 23-9 and 21-12."""
    year = F.year(day)
    marks = [F.make_date(year - 1, F.lit(12), F.lit(21)), *(F.make_date(year, F.lit(m), F.lit(d)) for m, d in ((3, 21), (6, 21), (9, 23), (12, 21))), F.make_date(year + 1, F.lit(3), F.lit(21))]
    start = F.array_max(F.filter(F.array(*marks), lambda m: m <= day))
    end = F.array_min(F.filter(F.array(*marks), lambda m: m > day))
    return F.struct(F.datediff(day, start).alias("past"), (F.datediff(end, day) - 1).alias("left"))


def shift_date(day: Column, years: Column, days: Column) -> Column:
    """Years first (29 February becomes the 28th), then days."""
    return F.date_add(F.add_months(day, (years * 12).cast("int")), days.cast("int"))


def within_span(day: Column, recent: Column, most: int = 89) -> Column:
    """A date more than `most` whole years before the recent one moves forward by the excess."""
    span = F.floor(F.months_between(recent, day) / 12)
    return F.when(span > most, F.add_months(day, ((span - most) * 12).cast("int"))).otherwise(day)


def shift_draws(doc: Column, seed: int, past: Column, left: Column, base: int = 65, fuzz: int = 20) -> tuple[Column, Column]:
    """Years (base, more or less fuzz) and days (within the wider offset, backwards if that is the past one) for a document."""
    years = F.lit(base - fuzz) + draw(key(seed, doc, F.lit("years")), 2 * fuzz + 1)
    widest = F.greatest(past, left, F.lit(1))
    days = F.lit(1) + draw(key(seed, doc, F.lit("days")), widest)
    return years, F.when(past >= left, -days).otherwise(days)


def corpus_shuffle(spans: DataFrame, seed: int) -> DataFrame:
    """(doc, tag, text, surrogate): texts are replaced by texts of the same tag that the document itself doesn't hold.

    The choices of a tag are ranked by hash once; a document's own texts walk that ranking from a drawn place, with replacement only where
    choices are fewer than texts. Without choices the text stays.
    """
    own = spans.select("doc", "tag", "text").distinct()
    ranked = own.select("tag", "text").distinct().withColumn("rank", F.row_number().over(Window.partitionBy("tag").orderBy(F.md5(key(seed, F.col("text"))), "text")) - 1)
    sizes = ranked.groupBy("tag").agg(F.count(F.lit(1)).alias("n"))
    mine = own.join(ranked, ["tag", "text"]).groupBy("doc", "tag").agg(F.array_sort(F.collect_list(F.struct("rank", "text"))).alias("mine")).join(sizes, "tag")
    free = F.col("n") - F.size("mine")
    rows = mine.select("doc", "tag", "mine", free.alias("free"), F.posexplode("mine").alias("i", "x"))
    # the k-th rank that is not among the document's own: own ranks at or below it are stepped over
    turn = F.pmod(draw(key(seed, F.col("doc"), F.col("tag")), F.greatest(F.col("free"), F.lit(1))) + F.col("i"), F.greatest(F.col("free"), F.lit(1)))
    step = F.aggregate("mine", turn.cast("long"), lambda acc, m: F.when(m["rank"] <= acc, acc + 1).otherwise(acc))
    rows = rows.select("doc", "tag", F.col("x.text").alias("text"), "free", step.alias("rank"))
    out = rows.join(ranked.withColumnRenamed("text", "other"), ["tag", "rank"], "left")
    return out.select("doc", "tag", "text", F.when(F.col("free") > 0, F.col("other")).otherwise(F.col("text")).alias("surrogate"))


def by_tag(span: Column, doc: Column, seed: int) -> Column:
    """The surrogate of a span; null where none can be made."""
    k = key(seed, doc, span["tag"], span["text"])
    return (
        F.when(span["tag"].isin("ID", "SSN"), identifier(span["text"], k))
        .when(span["tag"] == "Email", email(span["text"], k))
        .when(span["tag"] == "URL_IP", url(span["text"], k))
        .when(span["tag"] == "Phone_fax", phone(span["text"], k))
        .when(span["tag"] == "Age", age(span["text"]))
        .when(span["tag"] == "Initials", initials(span["text"], key(seed, doc, F.lit("letters"))))
        .when(span["tag"] == "Other", span["text"])
    )


def with_surrogates(docs: DataFrame, id_col: str, seed: int = 42, spans_col: str = "spans") -> DataFrame:
    """docs whose spans carry a surrogate."""
    return docs.withColumn(spans_col, F.transform(spans_col, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["tag"].alias("tag"), s["text"].alias("text"), by_tag(s, F.col(id_col), seed).alias("surrogate"))))
