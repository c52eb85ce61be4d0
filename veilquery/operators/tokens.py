"""Tokens that tile the text, sentences, and the features of tokens in their sentence."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import pairwise

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Dutch abbreviations that are one token, as written here or all in lower case.
ABBREVIATIONS = ["B.Sc.", "Co.", "Dhr.", "Dr.", "M.Sc.", "Mevr.", "Mgr.", "Mr.", "Mw.", "O.K.", "a.u.b.", "ca.", "e.g.", "etc.", "v.d."]
#: More of them, of this package.
OWN_ABBREVIATIONS = ["Drs.", "Ir.", "Prof.", "evt.", "bijv.", "i.v.m.", "m.b.t.", "o.a.", "t.a.v.", "z.n."]
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x5E\x60\x7B-\x7F]+"
PLAIN = WORD + r"|[\x09-\x0D\x20]+|[^\x09-\x0D\x20]"
PLAIN_WORDS = WORD + r"|[^\x09-\x0D\x20]"
_SHORT = sorted({f for a in ABBREVIATIONS + OWN_ABBREVIATIONS for f in (a, a.lower())}, key=lambda a: (-len(a), a))
DUTCH = "|".join([r"=== (?:Report|Answer): [0-9]+ ===\n", r"(?<![^\W_])(?:" + "|".join(re.escape(a) for a in _SHORT) + r")", r"[^\s@]+@[^\s@]+\.[^\s@.]+", r"[0-9]+(?:[/.,:-][0-9]+)+", r"(?<![^\W_])[^\W\d_]\.(?=\s|$)", PLAIN])
PATTERNS = {"plain": PLAIN, "nl": DUTCH}


def tokenize(docs: DataFrame, id_col: str, text_col: str = "text", language: str = "plain") -> DataFrame:
    """(doc, i, start, end, text) for each token; white-space runs are tokens, so the tokens tile the text. No shuffle."""
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = re.compile(PATTERNS[language]).finditer
        for b in batches:
            for k, text in enumerate(b.column(1)):
                found = [(m.start(), m.end(), m[0]) for m in find(text.as_py() or "")]
                if found:
                    start, end, words = zip(*found, strict=True)
                    n = len(found)
                    yield pa.RecordBatch.from_arrays([pa.array([b.column(0)[k].as_py()] * n, b.column(0).type), pa.array(range(n), pa.int32()), pa.array(start, pa.int32()), pa.array(end, pa.int32()), pa.array(words, pa.string())], ["doc", "i", "start", "end", "text"])

    return docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("t")).mapInArrow(run, f"doc {kind}, i int, start int, end int, text string")


def _cut(found: list[tuple[int, int, str]], edges: set[int]) -> list[tuple[int, int, str]]:
    """Tokens (start, end, text) cut at the edges inside of them."""
    inner = sorted(edges - {x for start, end, _ in found for x in (start, end)}) if edges else []
    if not inner:
        return found
    out = []
    for start, end, text in found:
        low, high = bisect_right(inner, start), bisect_left(inner, end)
        places = [start, *inner[low:high], end]
        out += [(a, z, text[a - start : z - start]) for a, z in pairwise(places)]
    return out


def labels_of(found: list, start: dict, end: dict, n: int) -> list[str]:
    """The labels of n tokens, which start and end give by where they start and end, beside the spans found."""
    out: list = [None] * n
    for a, b, tag in sorted({(s["start"], s["end"], s["tag"]) for s in found or ()}):
        if a in start and b in end and a < b:
            for i in range(start[a], end[b] + 1):
                if out[i] is None:
                    out[i] = ("B-" if i == start[a] else "I-") + tag
    return [x or "O" for x in out]


def labelled(docs: DataFrame, id_col: str, spans: dict[str, str], text_col: str = "text", language: str = "plain", cut: bool = False) -> DataFrame:
    """tokenize() with a BIO label in a column of its own for each array of spans: spans maps the label's column to the column of spans.

    A span counts if it starts where a token starts and ends where one ends; of overlapping ones the first by start, end and tag. With `cut`,
    tokens that a span starts or ends inside of are cut there, so that every span counts. Null arrays are empty. Each text is labelled
    beside its own spans, so there is no shuffle.
    """
    kind, names = dict(docs.dtypes)[id_col], list(spans)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = re.compile(PATTERNS[language]).finditer
        for b in batches:
            for k, text in enumerate(b.column(1)):
                found = [(m.start(), m.end(), m[0]) for m in find(text.as_py() or "")]
                if found:
                    spans_of = [b.column(2 + j)[k].as_py() for j in range(len(names))]
                    if cut:
                        found = _cut(found, {x for some in spans_of for s in some or () for x in (s["start"], s["end"])})
                    start, end, words = zip(*found, strict=True)
                    n = len(found)
                    firsts, lasts = {x: i for i, x in enumerate(start)}, {x: i for i, x in enumerate(end)}
                    columns = [pa.array([b.column(0)[k].as_py()] * n, b.column(0).type), pa.array(range(n), pa.int32()), pa.array(start, pa.int32()), pa.array(end, pa.int32()), pa.array(words, pa.string())]
                    columns += [pa.array(labels_of(some, firsts, lasts, n), pa.string()) for some in spans_of]
                    yield pa.RecordBatch.from_arrays(columns, ["doc", "i", "start", "end", "text", *names])

    columns = [F.col(id_col).alias("doc"), F.col(text_col).alias("t"), *(F.transform(c, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["tag"].alias("tag"))).alias(f"s{j}") for j, c in enumerate(spans.values()))]
    return docs.select(*columns).mapInArrow(run, ", ".join([f"doc {kind}, i int, start int, end int, text string", *(f"`{n}` string" for n in names)]))


def in_document(*order: str):
    return Window.partitionBy("doc").orderBy(*order)


def sentences(tokens: DataFrame) -> DataFrame:
    """tokens with sent_id: a sentence starts after . ! ? and white space, after a line break, and at metadata and behind it."""
    last = F.lag("text", 1).over(in_document("i"))
    ahead = F.lag("text", 2).over(in_document("i"))
    meta = lambda c: F.coalesce(c.startswith("==="), F.lit(False))
    starts = (last.rlike(r"^[\x09-\x0D\x20]+$") & (ahead.isin(".", "!", "?") | last.contains("\n"))) | meta(last) | (meta(F.col("text")) & last.isNotNull())
    return tokens.withColumn("sent_id", F.sum(F.coalesce(starts, F.lit(False)).cast("int")).over(in_document("i").rowsBetween(Window.unboundedPreceding, 0)).cast("int"))


def sentence_numbers(words: list[str]) -> list[int]:
    """sentences() for the tokens of one document, in order."""
    out, number, ahead, last = [], 0, "", None
    for text in words:
        if last is not None and ((last[0] in _BLANK and (ahead in _ENDS or "\n" in last)) or last.startswith("===") or text.startswith("===")):
            number += 1
        out.append(number)
        ahead, last = last, text
    return out


_BLANK, _ENDS = frozenset("\t\n\v\f\r "), frozenset(".!?")


def shape(text: Column) -> Column:
    """a for lower, A for upper case, # for digits, - for the rest; accents count as their letters."""
    c = F.regexp_replace(F.regexp_replace(text, r"[^\p{L}0-9]", "-"), r"\p{Lu}", "A")
    return F.regexp_replace(F.regexp_replace(c, r"(?!A)\p{L}", "a"), "[0-9]", "#")


def collapsed(shapes: Column) -> Column:
    return F.regexp_replace(shapes, r"(.)\1+", "$1")


def context(tokens: DataFrame, width: int = 2, pad: str = "<PAD>") -> DataFrame:
    """tokens with w-k .. w+k: the neighbours within the sentence, padded."""
    w = Window.partitionBy("doc", "sent_id").orderBy("i")
    return tokens.withColumns({f"w{k:+d}" if k else "w0": (F.lag("text", -k, pad).over(w) if k < 0 else F.lead("text", k, pad).over(w) if k else F.col("text")) for k in range(-width, width + 1)})


#: Letters with case; a title has an upper-case one after every other character, and lower-case ones only after letters with case.
_CASED = r"[\p{Lu}\p{Lt}\p{Ll}]"
TITLE = r"^[^\p{Lu}\p{Lt}\p{Ll}]*[\p{Lu}\p{Lt}]\p{Ll}*(?:[^\p{Lu}\p{Lt}\p{Ll}]+[\p{Lu}\p{Lt}]\p{Ll}*)*[^\p{Lu}\p{Lt}\p{Ll}]*$"


def flags(tokens: DataFrame, text_col: str = "text") -> DataFrame:
    """tokens with affixes, shapes and flags of case, digits and marks, by Unicode letters."""
    t = F.col(text_col)
    inner = F.expr(f"substring(`{text_col}`, 2)")
    upper = t.rlike(r"[\p{Lu}\p{Lt}]") & ~t.rlike(r"\p{Ll}")
    return tokens.withColumns({
        **{f"prefix{n}": F.left(t, F.lit(n)) for n in range(1, 6)}, **{f"suffix{n}": F.right(t, F.lit(n)) for n in range(1, 6)},
        "is_upper": upper, "is_title": t.rlike(TITLE), "is_digit": t.rlike(r"^\p{Nd}+$"), "has_digit": t.rlike(r"\p{Nd}"), "is_ascii": t.rlike(r"^[\x00-\x7F]*$"),
        "upper_inside": inner.rlike(r"\p{Lu}"), "digit_inside": inner.rlike(r"\p{Nd}"), "mark_inside": inner.rlike(r"[!-/:-@\[-`{-~]"),
        "shape": shape(t), "short_shape": collapsed(shape(t)),
    })


def escaped(text: Column) -> Column:
    """White space in string features, spelled out: line breaks first."""
    return F.regexp_replace(F.regexp_replace(text, r"\n", "#NEWLINE"), r"(?U)\s", "#SPACE")


def space_renamed(text: Column, name: str = "<SPACE>") -> Column:
    """Tokens of white space only, by a name, as taggers want them that can't take blanks."""
    return F.when(text.rlike(r"^(?U)\s*$"), F.lit(name)).otherwise(text)


def space_forced(tokens: DataFrame, label_col: str = "label", text_col: str = "text", name: str = "<SPACE>") -> DataFrame:
    """tokens whose white space, named or not, has the label O."""
    blank = (F.col(text_col) == name) | F.col(text_col).rlike(r"^(?U)\s*$")
    return tokens.withColumn(label_col, F.when(blank, "O").otherwise(F.col(label_col)))


def sentence_features(tokens: DataFrame) -> DataFrame:
    """tokens with the sentence's length, last token and whether its brackets are unmatched."""
    w = Window.partitionBy("doc", "sent_id")
    depth = F.sum(F.when(F.col("text").isin("(", "[", "{"), 1).when(F.col("text").isin(")", "]", "}"), -1).otherwise(0)).over(w)
    return tokens.withColumns({"sent_length": F.count(F.lit(1)).over(w), "sent_end": F.max_by("text", "i").over(w), "unmatched_bracket": depth != 0})
