"""Inline markup: texts in which entities stand as <TAG text>, tags within tags belonging to the outer one."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPANS = "array<struct<start:int,end:int,tag:string,text:string>>"


def parse(marked: str) -> tuple[str, list[dict]]:
    """The plain text and its spans. An opening bracket counts if an upper-case tag and a blank follow; a closing one if a tag is open."""
    plain, spans, open_, at = [], [], [], 0
    length = 0
    while at < len(marked):
        c = marked[at]
        if c == "<":
            end = at + 1
            while end < len(marked) and (marked[end].isupper() or marked[end] in "_-"):
                end += 1
            if end > at + 1 and marked[end : end + 1] == " ":
                open_.append((marked[at + 1 : end], length))
                at = end + 1
                continue
        if c == ">" and open_:
            tag, start = open_.pop()
            if not open_:
                text = "".join(plain)[start:length]
                kept = text.strip()
                lead = len(text) - len(text.lstrip())
                if kept:
                    spans.append({"start": start + lead, "end": start + lead + len(kept), "tag": tag, "text": kept})
            at += 1
            continue
        plain.append(c)
        length += 1
        at += 1
    return "".join(plain), spans


def unmark(docs: DataFrame, marked_col: str = "marked") -> DataFrame:
    """docs with text and spans in place of the marked text; null stays null without spans."""
    kinds = {c: t for c, t in docs.dtypes if c != marked_col}
    kept = list(kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("tag", pa.string()), ("text", pa.string())]))
        for b in batches:
            found = [(None, []) if t is None else parse(t) for t in b.column(len(kept)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(kept)], pa.array([t for t, _ in found], pa.string()), pa.array([s for _, s in found], span)], [*kept, "text", "spans"])

    schema = ", ".join([*(f"`{c}` {t}" for c, t in kinds.items()), f"text string, spans {SPANS}"])
    return docs.select(*kept, F.col(marked_col)).mapInArrow(run, schema)
