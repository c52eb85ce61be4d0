import datetime

import pytest
from pyspark.sql import functions as F

from veilquery.operators import dates, generators, locations, names, rewrite


def column(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "start int, text string").withColumn("doc", F.lit(1))


DATES = {
    "Tuesday 5 March 2019 08:59": (2019, 3, 5),
    "dinsdag 5 maart 2019 08:59": (2019, 3, 5),
    "Dienstag 5 März 2019 08:59": (2019, 3, 5),
    "Friday (10 June)": (1900, 6, 10),
    "August 3, 2009": (2009, 8, 3),
    "23 feb.": (1900, 2, 23),
    "22/05/13": (2013, 5, 22),
    "04-24": (1900, 4, 24),
    "2018-04": (2018, 4, 15),
    "vrijdag": (1900, 1, 15),
    "2018-04-24T10:00:00": (2018, 4, 24),
    "Tuesday 5 Marc 2019": None,
    "20082016": None,
    "31-02-2001": None,
    "25:61": None,
    "": None,
}


def test_dates_are_read(spark):
    found = {r.text: r.date for r in dates.parsed(column(spark, [*DATES, None])).collect()}
    assert found == {t: d and datetime.date(*d) for t, d in DATES.items()} | {None: None}


def test_languages_and_years(spark):
    found = {r.text: (r.lang, r.has_year) for r in dates.parsed(column(spark, ["vrijdag", "Friday", "Freitag 2 Mai 2001", "1 mei", "x"])).collect()}
    assert found == {"vrijdag": ("nl", False), "Friday": ("en", False), "Freitag 2 Mai 2001": ("de", True), "1 mei": ("nl", False), "x": (None, False)}


def moved(spark, texts, years, days):
    return [r.surrogate for r in dates.surrogates(column(spark, texts), shift=(F.lit(years), F.lit(days))).orderBy("start").collect()]


def test_dates_move_and_keep_their_layout(spark):
    assert moved(spark, ["01 januari 1915", "01-02", "marc 2001", "February 2001", "01-02-2010"], 85, 8) == ["09 januari 2006", "09-02", None, "February 2086", "09-02-2095"]
    assert moved(spark, ["01 januari", "01-02", "vrijdag"], 10, 2) == ["03 januari", "03-02", "maandag"]
    assert moved(spark, ["29 February 2016 7:05"], 1, 0) == ["28 February 2017 07:05"]


def test_season_offsets_and_draws(spark):
    texts = ["2018-04-24", "2018-7-7", "2018-11-11", "2018-12-22", "2019-1-7", "2018-12-21"]
    rows = dates.parsed(column(spark, texts)).agg(F.array_sort(F.collect_list(F.struct("start", "date"))).alias("d"))
    least = rows.select(dates.least_offsets(F.transform("d", lambda x: x["date"])).alias("o")).first().o
    assert (least.past, least.left) == (0, 39)
    for seed in range(3):
        new = dates.surrogates(column(spark, texts), seed, 65, 10).orderBy("start").first().surrogate
        days = (datetime.date.fromisoformat(new) - datetime.date(2018, 4, 24)).days
        assert 55 * 365 < days < 76 * 366 + 40


NAMES = {
    "Lucas de Groot": ("", "Lucas", "", "de Groot", ""),
    "Lucas v.d. Veen": ("", "Lucas", "", "v.d. Veen", ""),
    "Dhr. Lucas F.A. de Groot, Ph.D.": ("Dhr. ", "Lucas", "F.A.", "de Groot", ", Ph.D."),
    "Daniel Markus Thomas P.F.J. de Groot": ("", "Daniel", "Markus Thomas P.F.J.", "de Groot", ""),
    "van Janssen, Jan": ("", "Jan", "", "van Janssen", ""),
    "J. F. Janssen": ("", "J.", "F.", "Janssen", ""),
    "Ludo)Enckels": ("", "Ludo)Enckels", "", "", ""),
    "mevr. Bakker": ("mevr. ", "", "", "Bakker", ""),
    "": ("", "", "", "", ""),
}


def test_names_are_parsed(spark):
    rows = column(spark, [*NAMES, None]).select("text", names.parse(F.col("text")).alias("p")).collect()
    found = {r.text: r.p and (r.p.title, r.p.first, r.p.middle, r.p.last, r.p.suffix) for r in rows}
    assert found == NAMES | {None: None}


def test_prepositions_and_initials(spark):
    rows = column(spark, ["v.d. Groot", "van den Groot", "Grooter", "P.F.J.", "Ad"]).select("text", names.without_prepositions(F.col("text")).alias("w"), names.is_initials(F.col("text")).alias("i")).collect()
    assert {r.text: (r.w, r.i) for r in rows} == {"v.d. Groot": ("Groot", False), "van den Groot": ("Groot", False), "Grooter": ("Grooter", False), "P.F.J.": ("P.F.J.", True), "Ad": ("Ad", False)}


def letters(**changed):
    return F.lit("".join(changed.get(c, c) for c in "abcdefghijklmnopqrstuvwxyz"))


def test_names_follow_the_letters(spark):
    first = spark.createDataFrame([("Jurrien", "m"), ("Harm", "m"), ("Damien", "m"), ("Clara", "f"), ("Daniel", "m"), ("Markus", "m"), ("Thomas", "m"), ("Şerife", "f")], "name string, gender string")
    last = spark.createDataFrame([("van der", "Linden"), ("", "Nguyen")], "prefix string, name string")
    given = {
        "Dr. Annemarie van Heijer, Ph.D": "Dr. Clara van der Linden, Ph.D",
        "annemarie": "clara",
        "Daniel de groot": "Jurrien nguyen",
        "D. de Groot": "J. Nguyen",
        "Daniel markus thomas de Groot": "Jurrien harm damien Nguyen",
        "Daniel MT de Groot": "Jurrien HD Nguyen",
        "Heijer, Daniel M.T.": "van der Linden, Jurrien H.D.",
        "Özlem": "Şerife",
        "Xander": None,
        "": None,
        None: None,
    }
    maps = (letters(a="c", d="j", m="h", t="d", o="s"), letters(h="l", g="n"))
    rows = names.surrogates(column(spark, [*given, "annemarie"]), first, last, maps=maps).collect()
    assert len(rows) == len(given) + 1 and {r.text: r.surrogate for r in rows} == given


PLACES = {
    "Parallelweg 2, 7141 DC Groenlo": ("", "7141 DC", "Groenlo", "Parallelweg", "2"),
    "7141 DC te Haarlem Nederland": ("Nederland", "7141 DC", "te Haarlem", "", ""),
    "Parallelweg 2A": ("", "", "", "Parallelweg", "2A"),
    "Parallelweg 122-3 a Groenlo": ("", "", "Groenlo", "Parallelweg", "122-3 a"),
    "De singel te Haarlem Nederland": ("Nederland", "", "te Haarlem", "De singel", ""),
    "De diagonaal te Haarlem Nederland": ("Nederland", "", "De diagonaal te Haarlem", "", ""),
    "CARL MUCKSTRAAT": ("", "", "", "CARL MUCKSTRAAT", ""),
    "Indonesië (Molukken)": ("Indonesië", "", "Molukken", "", ""),
    "De Giezen 15-002, Arnhem-Zuid": ("", "", "Arnhem-Zuid", "De Giezen", "15-002"),
    "": ("", "", "", "", ""),
}


def test_locations_are_parsed(spark):
    rows = column(spark, [*PLACES, None]).select("text", locations.parse(F.col("text"), ["Nederland", "Indonesië"]).alias("p")).collect()
    assert {r.text: r.p and (r.p.country, r.p.zip_code, r.p.place, r.p.street, r.p.house_number) for r in rows} == PLACES | {None: None}


def test_locations_are_replaced_but_for_countries(spark):
    one = spark.createDataFrame([("7141DC", "Groenlo", "Parallelweg")], "postcode string, plaats string, straat string")
    texts = ["Waterkant 28-3, 7521PL Enschede", "Waterkant 28-3", "7521 PL Enschede", "Arnhem-Zuid", "Duitsland", None]
    found = {r.text: r.surrogate for r in locations.surrogates(column(spark, texts), one, ["Duitsland"]).collect()}
    number = found["Waterkant 28-3"].removeprefix("Parallelweg ")
    assert len(number) == 4 and number[2] == "-"
    assert found == {texts[0]: f"Parallelweg {number}, 7141DC Groenlo", texts[1]: f"Parallelweg {number}", texts[2]: "7141 DC Groenlo", texts[3]: "Groenlo", "Duitsland": "Duitsland", None: None}


@pytest.fixture
def gazetteers(spark):
    alphabet = "abcdefghijklmnopqrstuvwxyz"
    first = spark.createDataFrame([(c.upper() + "ilia", "f") for c in alphabet], "name string, gender string")
    last = spark.createDataFrame([("", c.upper() + "erman") for c in alphabet], "prefix string, name string")
    return generators.Gazetteers(first, last, spark.createDataFrame([("7141DC", "Groenlo", "Parallelweg")], "postcode string, plaats string, straat string"), ["Duitsland"])


def test_every_tag_has_a_generator(spark, gazetteers):
    text = "Anna Bos, 3-4-2001, te Haarlem, smid, 101"
    rows = [(1, 0, 8, "Name", "Anna Bos"), (1, 10, 18, "Date", "3-4-2001"), (1, 20, 30, "Address", "te Haarlem"), (1, 32, 36, "Profession", "smid"), (1, 38, 41, "Age", "101"), (2, 0, 6, "Profession", "bakker")]
    spans = spark.createDataFrame(rows, "doc long, start int, end int, tag string, text string")
    found = {(r.doc, r.tag): r.surrogate for r in generators.surrogate_spans(spans, gazetteers).collect()}
    assert len(found) == len(rows) and found[1, "Name"].endswith("erman") and found[1, "Address"] == "Groenlo" and found[1, "Age"] == "89"
    assert found[1, "Profession"] == "bakker" and found[2, "Profession"] == "smid" and len(found[1, "Date"]) == 10
    docs = spark.createDataFrame([(1, text), (2, "bakker"), (3, "leeg"), (4, None)], "doc_id long, text string")
    done = generators.attach(docs, generators.surrogate_spans(spans, gazetteers), "doc_id")
    out = {r.doc_id: r.rewritten for r in rewrite.apply_surrogates(done).collect()}
    assert out[2] == "smid" and out[3] == "leeg" and out[4] is None and out[1].endswith("Groenlo, bakker, 89")


def test_no_spans_no_surrogates(spark, gazetteers):
    none = spark.createDataFrame([], "doc long, start int, end int, tag string, text string")
    assert generators.surrogate_spans(none, gazetteers).count() == 0
