"""Rule tagger for Dutch notes: patterns, words that announce a name or an institution, and dictionaries that the caller gives as tables."""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The tags of the rule tagger, and the tags of the corpus that they stand for.
TAG_MAP = {
    "PATIENT": "Name",
    "PERSOON": "Name",
    "LOCATIE": "Address",
    "INSTELLING": "Named_Location",
    "DATUM": "Date",
    "LEEFTIJD": "Age",
    "PATIENTNUMMER": "ID",
    "TELEFOONNUMMER": "Phone_fax",
    "URL": "URL_IP",
}

#: Words before a name that belong to it.
PREFIXES = ["patiente", "patient", "dhr", "mevr", "mevrouw", "meneer", "mw", "dr", "drs", "prof", "ir", "ing", "mr", "zuster", "broeder", "bewoner", "bewoonster", "clienta", "client"]
#: Words before a name that don't.
ROLES = ["arts", "huisarts", "verpleegkundige", "psychiater", "chirurg", "begeleider", "fysiotherapeut", "collega", "naam", "heet", "echtgenoot", "echtgenote", "zoon", "dochter", "broer", "zus"]
PARTICLES = ["van der", "van den", "van de", "van het", "van 't", "in 't", "op den", "op de", "van", "de", "den", "der", "het", "ten", "ter", "te", "el", "'t"]
FIRST_NAMES = ["Jan", "Piet", "Peter", "Kees", "Henk", "Willem", "Hans", "Anna", "Maria", "Johanna", "Sanne", "Emma", "Sophie", "Daan", "Lotte", "Bram", "Thijs", "Fatima", "Mohammed", "Ingrid", "Marieke", "Joost", "Pieter", "Klaas", "Truus", "Greet"]
PLACES = ["Amsterdam", "Rotterdam", "Den Haag", "Utrecht", "Eindhoven", "Groningen", "Tilburg", "Almere", "Breda", "Nijmegen", "Enschede", "Apeldoorn", "Haarlem", "Arnhem", "Amersfoort", "Zwolle", "Zoetermeer", "Leiden", "Maastricht", "Dordrecht", "Ede", "Delft", "Deventer", "Leeuwarden"]
INSTITUTIONS = ["UMCU", "UMC", "AMC", "VUmc", "LUMC", "Erasmus MC", "Radboudumc", "UMCG", "MUMC"]
KINDS = ["ziekenhuis", "verpleeghuis", "verzorgingshuis", "zorgcentrum", "woonzorgcentrum", "huisartsenpraktijk", "apotheek", "revalidatiecentrum"]
STREETS = ["straat", "laan", "weg", "plein", "gracht", "kade", "dreef", "singel", "hof", "pad", "steeg"]
MONTHS = ["januari", "februari", "maart", "april", "mei", "juni", "juli", "augustus", "september", "oktober", "november", "december", "jan", "feb", "mrt", "apr", "jun", "jul", "aug", "sept", "sep", "okt", "nov", "dec"]


def _any(words: Iterable[str]) -> str:
    """An alternation, longer words first."""
    return "(?:" + "|".join(sorted((w.replace(".", r"\.") for w in words), key=len, reverse=True)) + ")"


#: National trunk prefix, area code and subscriber number of ten digits in all, or the international form; other plans can be given.
DUTCH_PHONES = r"(?<![0-9])(?:(?:\+|00)31[ -]?(?:\(0\))?|0)(?:6[ -]?(?:[0-9][ -]?){7}[0-9]|[1-57-9][0-9][ -]?(?:[0-9][ -]?){6}[0-9]|[1-57-9][0-9]{2}[ -]?(?:[0-9][ -]?){5}[0-9])(?![0-9])"


def rules(
    first_names: Iterable[str] = FIRST_NAMES, places: Iterable[str] = PLACES, institutions: Iterable[str] = INSTITUTIONS, phones: str = DUTCH_PHONES
) -> list[tuple[str, str]]:
    """(tag, pattern) in order of priority. The lists are meant to be short; large ones go to dictionary() as tables."""
    begin, end = r"(?<![\p{L}\p{N}])", r"(?![\p{L}\p{N}])"
    particle = rf"(?:{_any(PARTICLES)} )"
    capital = r"\p{Lu}[\p{L}'’]*\p{Ll}(?:-\p{Lu}\p{L}+)?"
    initials = r"(?:\p{Lu}\.[ ]?)+"
    last = rf"{particle}{{0,2}}{capital}"
    prefix = rf"(?i:{_any(PREFIXES)})\.?\s+"
    number = r"[0-9]{1,2}"
    return [
        ("URL", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"),
        ("URL", r"(?:https?://|www\.)[^\s<>()]*[^\s<>().,;:!?]"),
        ("URL", r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9.])"),
        ("TELEFOONNUMMER", phones),
        ("DATUM", rf"(?<![0-9]){number}([-/.]){number}\1(?:[0-9]{{4}}|[0-9]{{2}})(?![0-9])"),
        ("DATUM", r"(?<![0-9])[0-9]{4}-[0-9]{2}-[0-9]{2}(?![0-9])"),
        ("DATUM", rf"(?<![0-9]){number}(?:e|ste|de)? (?i:{_any(MONTHS)}){end}\.?(?: (?:19|20)[0-9]{{2}}(?![0-9]))?"),
        ("DATUM", rf"{begin}(?i:{_any(MONTHS[:12])}) (?:19|20)[0-9]{{2}}(?![0-9])"),
        ("LEEFTIJD", r"(?<![0-9])[0-9]{1,3}(?=(?:[ -]?jaar|[ -]?jarige?|[ ]?jr)(?![\p{L}]))"),
        ("INSTELLING", rf"{begin}(?i:{_any(institutions)}){end}"),
        ("INSTELLING", rf"{begin}(?i:{_any(KINDS)})(?: (?:De|Het|{capital}))?(?: {capital})"),
        ("PERSOON", rf"{begin}{prefix}(?:{initials}{last}|{capital}(?: {last})?|{last})"),
        ("PERSOON", rf"{begin}{initials}{last}"),
        ("PERSOON", rf"{begin}{_any(first_names)}{end}(?: {initials})?(?: {last})?"),
        ("PERSOON", rf"(?<=(?i:{'|'.join(w + ' ' for w in ROLES)})){capital}(?: {last})?"),
        ("LOCATIE", rf"{begin}\p{{Lu}}[\p{{L}} ]{{0,30}}?{_any(STREETS)} [0-9]{{1,5}}(?:[ -]?[a-zA-Z0-9])?{end}"),
        ("LOCATIE", r"(?<![0-9])[1-9][0-9]{3} ?[A-Z]{2}(?![\p{L}0-9])"),
        ("LOCATIE", rf"{begin}{_any(places)}{end}"),
        ("PATIENTNUMMER", r"(?<![0-9])[0-9]{7}(?![0-9])"),
    ]


def spans_of(text: str, compiled: list[tuple[str, regex.Pattern]]) -> list[tuple[int, int, str]]:
    """Spans in text order; where two overlap the earlier rule's counts, then the earlier span."""
    kept: list[tuple[int, int, str]] = []
    for tag, pattern in compiled:
        for m in pattern.finditer(text):
            a, b = m.span()
            i = bisect.bisect_left(kept, (a, b, ""))
            if a < b and (i == 0 or kept[i - 1][1] <= a) and (i == len(kept) or kept[i][0] >= b):
                kept.insert(i, (a, b, tag))
    return kept


def annotate(docs: DataFrame, text_col: str = "text", output: str = "spans", **lists) -> DataFrame:
    """docs with the spans of rules(**lists). Null texts have none; stateless and without a shuffle, so it runs on streams as well.

    Rules look behind and around, and their spans exclude each other, which arrays in Spark resolve only in quadratic time: so Arrow batches here.
    """
    kinds = {c: t for c, t in docs.dtypes if c != output}
    patterns = rules(**lists)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = [(tag, regex.compile(p)) for tag, p in patterns]
        span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("tag", pa.string()), ("text", pa.string())]))
        for b in batches:
            out = []
            for text in b.column(len(kinds)):
                text = text.as_py() or ""
                out.append([{"start": x, "end": y, "tag": tag, "text": text[x:y]} for x, y, tag in spans_of(text, compiled)])
            yield pa.RecordBatch.from_arrays([*b.columns[: len(kinds)], pa.array(out, span)], [*kinds, output])

    schema = ", ".join([*(f"`{c}` {t}" for c, t in kinds.items()), f"`{output}` array<struct<start:int,end:int,tag:string,text:string>>"])
    return docs.select(*kinds, F.col(text_col).alias("__text")).mapInArrow(run, schema)


def tags() -> list[str]:
    return list(TAG_MAP)


def mapped(spans: Column, names: dict[str, str] = TAG_MAP) -> Column:
    """spans with the corpus' tags; a tag that isn't in names raises an error."""
    table = F.create_map(*(F.lit(x) for kv in names.items() for x in kv))
    wrong = lambda s: F.raise_error(F.concat(F.lit("No tag for "), s["tag"])).cast("string")
    return F.transform(spans, lambda s: s.withField("tag", F.coalesce(table[s["tag"]], wrong(s))))


def without_metadata_ids(spans: Column, text: Column, tag: str = "ID") -> Column:
    """spans without numbers that a metadata line `=== Report: N ===` holds."""
    return F.filter(spans, lambda s: ~((s["tag"] == tag) & (F.substring(text, s["end"] + 1, F.lit(4)) == " ===")))


def without_prefixes(spans: Column, tag: str = "Name", prefixes: Iterable[str] = tuple(PREFIXES)) -> Column:
    """spans whose names begin behind their prefixes; names of prefixes only go. The text stays what stands at the span."""
    lead = rf"^(?:(?i:{_any(prefixes)})(?:\.\s*|\s+|$))+"
    cut = lambda s: F.when(s["tag"] == tag, F.regexp_replace(s["text"], lead, "")).otherwise(s["text"])
    short = F.transform(spans, lambda s: s.withField("start", (s["end"] - F.length(cut(s))).cast("int")).withField("text", cut(s)))
    return F.filter(short, lambda s: (s["tag"] != tag) | (F.trim(s["text"]) != ""))


def rewritten(spans: Column, text: Column) -> Column:
    """The rule tagger's spans as the corpus has them: its tags, no metadata numbers, names without prefixes."""
    return without_prefixes(without_metadata_ids(mapped(spans), text))


_LETTERS = re.compile(r"[\w'’-]+")


def _lowered(text: str) -> list[str]:
    """The words (letters, digits, apostrophes, hyphens) in lower case, each by itself."""
    text = text.replace("_", " ")
    low = text.lower()
    if len(low) == len(text) and "Σ" not in text:  # else words could be cut or end otherwise
        return _LETTERS.findall(low)
    return [w.lower() for w in _LETTERS.findall(text)]


def _runs(text: str, longest: int, firsts: frozenset | None, known: frozenset | None) -> Iterator[tuple[int, int, str]]:
    """(start, end, words in lower case) of the runs of up to `longest` words that are known, or of all."""
    low = _lowered(text)
    at = range(len(low)) if firsts is None else [i for i, w in enumerate(low) if w in firsts]
    hits = [(i, k) for i in at for k in range(i + 1, min(i + longest, len(low)) + 1) if known is None or " ".join(low[i:k]) in known]
    if hits:
        places = [m.span() for m in _LETTERS.finditer(text.replace("_", " "))]
        for i, k in hits:
            yield places[i][0], places[k - 1][1], " ".join(low[i:k])


def dictionary(docs: DataFrame, phrases: DataFrame, id_col: str, text_col: str = "text", longest: int = 6, held: int = 200_000) -> DataFrame:
    """(doc, start, end, tag, text): the places where phrases (tag, phrase) of up to `longest` words stand, whatever their case; the longest from a place counts.

    For institution lists and gazetteers of any size: runs of words are joined with the table by their lower-cased words; workers drop other
    runs beforehand if there are `held` phrases at most. Phrases with more words raise an error. Of ties between tags the least wins.
    """

    def plain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = [_lowered(p or "") for p in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([" ".join(w) for w in words], pa.string()), b.column(1)], ["phrase", "tag"])

    known = phrases.select(F.col("phrase").cast("string"), F.col("tag").cast("string")).mapInArrow(plain, "phrase string, tag string").where("phrase <> ''")
    n = F.size(F.split("phrase", " "))
    known = known.groupBy("phrase").agg(F.min("tag").alias("tag")).withColumn("phrase", F.when(n <= longest, F.col("phrase")).otherwise(F.raise_error(F.concat(F.lit("Too long: "), "phrase")).cast("string")))
    some = known.select("phrase").limit(held + 1).toArrow().column(0).to_pylist()
    few = len(some) <= held
    shared = docs.sparkSession.sparkContext.broadcast((frozenset(p.split(" ")[0] for p in some), frozenset(some)) if few else (None, None))
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int32(), pa.int32(), pa.string(), pa.string()]
        for b in batches:
            rows, out = [], []

            def packed(rows=rows, out=out, b=b) -> pa.RecordBatch:
                columns = zip(*out, strict=True) if out else [()] * 4
                return pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int64())), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], ["doc", "start", "end", "phrase", "text"])

            for row, text in enumerate(b.column(1)):
                text = text.as_py() or ""
                for start, end, phrase in _runs(text, longest, *shared.value):
                    rows.append(row)
                    out.append((start, end, phrase, text[start:end]))
                    if len(out) == 1 << 16:
                        yield packed()
                        rows.clear()
                        out.clear()
            yield packed()

    at = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("t")).mapInArrow(run, f"doc {kind}, start int, end int, phrase string, text string")
    found = at.join(F.broadcast(known) if few else known, "phrase")
    return found.groupBy("doc", "start").agg(F.max(F.struct("end", "tag", "text")).alias("s")).select("doc", "start", "s.*")
