"""Dates in texts: layouts are recognised in three languages, dates move by a draw of their document, and keep their layout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilquery.operators.surrogates import season_offsets, shift_date, shift_draws, within_span

#: Names of months and weekdays (from Monday) by language, long and short; languages are tried in this order.
NAMES = {
    "nl": {
        "B": "januari februari maart april mei juni juli augustus september oktober november december",
        "b": "jan feb mrt apr mei jun jul aug sep okt nov dec",
        "A": "maandag dinsdag woensdag donderdag vrijdag zaterdag zondag",
        "a": "ma di wo do vr za zo",
    },
    "en": {
        "B": "January February March April May June July August September October November December",
        "b": "Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec",
        "A": "Monday Tuesday Wednesday Thursday Friday Saturday Sunday",
        "a": "Mon Tue Wed Thu Fri Sat Sun",
    },
    "de": {
        "B": "Januar Februar März April Mai Juni Juli August September Oktober November Dezember",
        "b": "Jan Feb Mär Apr Mai Jun Jul Aug Sep Okt Nov Dez",
        "A": "Montag Dienstag Mittwoch Donnerstag Freitag Samstag Sonntag",
        "a": "Mo Di Mi Do Fr Sa So",
    },
}
#: Kinds of tokens (W weekday, M month, digits by length) and the directives they stand for, the likelier first.
CORES = {
    "": [""], "224": ["dmY", "mdY"], "422": ["Ymd", "Ydm"], "222": ["dmy", "mdy", "ymd"], "22": ["dm", "md"], "24": ["mY"], "42": ["Ym"], "4": ["Y"],
    "2M4": ["dMY"], "2M2": ["dMy"], "2M": ["dM"], "M24": ["MdY"], "M2": ["Md"], "M4": ["MY"], "M": ["M"], "4M2": ["YMd"],
}
CLOCKS = {"": "", "2:2": "HI", "2:2:2": "HIS"}
LAYOUTS = {w + c + t: [w + d + CLOCKS[t] for d in ds] for w in ("", "W") for c, ds in CORES.items() for t in CLOCKS if w or c}
WORD = r"[\p{L}]+"


def _words(lang: str, kind: str) -> Column:
    return F.array(*map(F.lit, NAMES[lang][kind].split()))


def _place(lang: str, kind: str, word: Column) -> Column:
    """1, 2, .. for a name of this kind, whatever its case; else 0."""
    return F.array_position(F.array(*(F.lit(n.lower()) for n in NAMES[lang][kind].split())), F.lower(word)).cast("int")


def _kind(token: Column, lang: str) -> Column:
    """The directive letter of a name, the length class of a number, a colon, or nothing for separators; ? for what no date holds. T parts date and time.

    A name that is long and short alike counts as short.
    """
    named = F.lit("?")
    for k in ("A", "a", "B", "b"):
        named = F.when(_place(lang, k, token) > 0, k).otherwise(named)
    size = F.length(token)
    number = F.when(size <= 2, "2").when(size == 4, "4").otherwise("?")
    return F.when(token.rlike("^[0-9]+$"), number).when(token == "T", "").when(token.rlike(rf"^{WORD}$"), named).when(token == ":", ":").when(token.rlike(r"^[-.,/#!$^&*;{}=_`~() ]$"), "").otherwise("?")


def _value(tokens: Column, kinds: Column, letters: Column, wanted: str, lang: Column) -> Column:
    """The number behind the first directive of `wanted` letters; null without one."""
    at = F.array_position(F.transform(letters, lambda x: F.lit(wanted).contains(x) & (x != "")), F.lit(True)).cast("int")
    token, kind = F.get(tokens, at - 1), F.get(kinds, at - 1)
    out = token.try_cast("int")
    for name in NAMES:
        for k in ("B", "b"):
            out = F.when((lang == name) & (kind == k), _place(name, k, token)).otherwise(out)
    return F.when(at > 0, out)


def parsed(rows: DataFrame, text_col: str = "text") -> DataFrame:
    """rows with `date` (null where the text is no date), `lang`, `layout`, `has_year`, and the columns _tokens and _letters that `written` needs.

    Without a year it is 1900, without a day the 15th, without a month January. Two-digit years from 69 on are of the 20th century. Day before month is
    tried first; of the languages that read a text, the one with most names in their usual case. Null and empty texts are no dates.
    """
    tokens = F.regexp_extract_all(F.col(text_col), F.lit(rf"(?s)[0-9]+|{WORD}|."), F.lit(0))
    rows = rows.withColumn("_tokens", tokens)
    exact = lambda lang: F.size(F.array_intersect("_tokens", F.array(*(F.lit(n) for k in "BbAa" for n in NAMES[lang][k].split()))))
    reading = lambda turn, lang: F.struct((-exact(lang)).alias("rank"), F.lit(turn).alias("turn"), F.lit(lang).alias("lang"), F.transform("_tokens", lambda t: _kind(t, lang)).alias("kinds"))
    sane = F.filter(F.array(*(reading(i, lang) for i, lang in enumerate(NAMES))), lambda r: ~F.array_contains(r["kinds"], "?"))
    rows = rows.withColumn("_r", F.array_min(sane))
    shape = F.translate(F.translate(F.array_join("_r.kinds", ""), "Bb", "MM"), "Aa", "WW")
    layouts = F.create_map(*(F.lit(x) if isinstance(x, str) else F.array(*map(F.lit, x)) for kv in LAYOUTS.items() for x in kv))
    rows = rows.withColumn("_options", F.try_element_at(layouts, shape))

    def letters(option: Column) -> Column:
        """Directives aligned with the tokens, empty for separators."""
        marks = F.transform(F.col("_r.kinds"), lambda k: (k != "") & (k != ":"))
        return F.transform(marks, lambda m, i: F.when(m, F.substring(option, F.size(F.filter(F.slice(marks, F.lit(1), i), lambda x: x)) + 1, F.lit(1))).otherwise(""))

    def day(aligned: Column) -> Column:
        part = lambda w: _value(F.col("_tokens"), F.col("_r.kinds"), aligned, w, F.col("_r.lang"))
        short = part("y")
        year = F.coalesce(part("Y"), short + F.when(short >= 69, 1900).otherwise(2000), F.lit(1900))
        hour, minute, second = (F.coalesce(part(w), F.lit(0)) for w in "HIS")
        stamp = F.try_to_timestamp(F.format_string("%04d-%02d-%02d", year, F.coalesce(part("mM"), F.lit(1)), F.coalesce(part("d"), F.lit(15))), F.lit("yyyy-MM-dd"))
        return F.when((year > 0) & (hour < 24) & (minute < 60) & (second < 60), stamp.cast("date"))

    tried = F.transform("_options", lambda o: F.struct(o.alias("layout"), letters(o).alias("letters")))
    rows = rows.withColumn("_tried", F.transform(tried, lambda t: F.struct(t["layout"].alias("layout"), t["letters"].alias("letters"), day(t["letters"]).alias("date"))))
    rows = rows.withColumn("_best", F.get(F.filter("_tried", lambda t: t["date"].isNotNull()), F.lit(0)))
    rows = rows.withColumns({"date": F.col("_best.date"), "lang": F.when(F.col("_best").isNotNull(), F.col("_r.lang")), "layout": F.col("_best.layout"), "_letters": F.transform(F.arrays_zip(F.col("_best.letters").alias("l"), F.col("_r.kinds").alias("k")), lambda z: F.when(z["l"].isin("M", "W"), z["k"]).otherwise(z["l"]))})
    return rows.withColumn("has_year", F.coalesce(F.lower("layout").contains("y"), F.lit(False))).drop("_r", "_options", "_tried", "_best")


def written(day: Column) -> Column:
    """The day in the layout of a parsed row; the time of day and a capital at the start of a name stay."""
    names = F.lit(None).cast("string")

    def one(z: Column) -> Column:
        out = z["t"]
        for letter, value in (("d", F.dayofmonth(day)), ("m", F.month(day)), ("y", F.pmod(F.year(day), F.lit(100)))):
            out = F.when(z["l"] == letter, F.format_string("%02d", value)).otherwise(out)
        out = F.when(z["l"] == "Y", F.format_string("%04d", F.year(day))).when(z["l"].isin("H", "I", "S"), F.lpad(z["t"], 2, "0")).otherwise(out)
        named = names
        for lang in NAMES:
            for k in ("A", "a", "B", "b"):
                at = F.month(day) if k in "Bb" else F.weekday(day) + 1
                named = F.when((F.col("lang") == lang) & (z["l"] == k), F.get(_words(lang, k), at - 1)).otherwise(named)
        return F.coalesce(F.when(z["t"].rlike(r"^\p{Lu}"), F.concat(F.upper(F.left(named, F.lit(1))), F.substring(named, 2, 100))).otherwise(named), out)

    return F.array_join(F.transform(F.arrays_zip(F.col("_tokens").alias("t"), F.col("_letters").alias("l")), one), "")


def least_offsets(days: Column) -> Column:
    """Least days past and days left of the season over dates in order; a date that lowers the former isn't asked for the latter. 300 where none does."""
    start = F.struct(F.lit(300).alias("past"), F.lit(300).alias("left"))
    offsets = F.transform(days, season_offsets)
    lower = lambda acc, o: o["past"] < acc["past"]
    return F.aggregate(offsets, start, lambda acc, o: F.struct(F.when(lower(acc, o), o["past"]).otherwise(acc["past"]).alias("past"), F.when(~lower(acc, o), F.least(acc["left"], o["left"])).otherwise(acc["left"]).alias("left")))


def surrogates(spans: DataFrame, seed: int = 42, base: int = 65, fuzz: int = 20, shift: tuple[Column, Column] | None = None) -> DataFrame:
    """spans (doc, start, text, ..) with `surrogate`: dates of a document move by the same years and days, after dates over 89 years
    before its latest one have moved up to 89. Null where the text is no date. shift: years and days in place of drawn ones.

    The latest date is among those with a year, else the first date. One shuffle, by document.
    """
    own = Window.partitionBy("doc")
    rows = parsed(spans)
    dated = F.when(F.col("has_year"), F.col("date"))
    first = F.min(F.when(F.col("date").isNotNull(), F.struct("start", "date"))).over(own)["date"]
    rows = rows.withColumns({"_recent": F.coalesce(F.max(dated).over(own), first), "_days": F.collect_list(F.when(F.col("date").isNotNull(), F.struct("start", "date"))).over(own)})
    rows = rows.withColumn("_o", least_offsets(F.transform(F.array_sort("_days"), lambda d: d["date"])))
    years, days = shift or shift_draws(F.col("doc"), seed, F.col("_o.past"), F.col("_o.left"), base, fuzz)
    near = within_span(F.col("date"), F.col("_recent"))
    rows = rows.withColumn("_new", shift_date(near, years, days))
    return rows.withColumn("surrogate", F.when(F.col("date").isNotNull(), written(F.col("_new")))).select(*spans.columns, "surrogate")
