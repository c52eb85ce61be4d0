"""Plug point for taggers that live outside this package: any callable from texts to spans, run in batches on the executors."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: From a batch of texts to a list of (start, end, tag) for each; code points, end exclusive.
Tagger = Callable[[Sequence[str]], Sequence[Sequence[tuple[int, int, str]]]]


def annotate(docs: DataFrame, load: Callable[[], Tagger], tags: Sequence[str], text_col: str = "text", output: str = "spans", batch: int = 256) -> DataFrame:
    """docs with the spans of a tagger that load() makes once in each task; a neural model is loaded there and sees `batch` texts at a time.

    Contract, checked here: one list for each text, spans within the text and not empty, tags among `tags`. Null texts count as empty and have no
    spans. Spans come out sorted; no shuffle.
    """
    kinds = {c: t for c, t in docs.dtypes if c != output}
    allowed = frozenset(tags)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = load()
        span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("tag", pa.string()), ("text", pa.string())]))
        for whole in batches:
            for first in range(0, whole.num_rows, batch):
                b = whole.slice(first, batch)
                texts = [t or "" for t in b.column(len(kinds)).to_pylist()]
                found = tagger(texts)
                if len(found) != len(texts):
                    raise ValueError(f"The tagger gave {len(found)} lists for {len(texts)} texts")
                out = []
                for t, spans in zip(texts, found, strict=True):
                    for a, e, tag in spans:
                        if not 0 <= a < e <= len(t) or tag not in allowed:
                            raise ValueError(f"Not a span of the text or its tags: {(a, e, tag)}")
                    out.append([{"start": a, "end": e, "tag": tag, "text": t[a:e]} for a, e, tag in sorted(spans)])
                yield pa.RecordBatch.from_arrays([*b.columns[: len(kinds)], pa.array(out, span)], [*kinds, output])

    schema = ", ".join([*(f"`{c}` {t}" for c, t in kinds.items()), f"`{output}` array<struct<start:int,end:int,tag:string,text:string>>"])
    return docs.select(*kinds, F.col(text_col).alias("__text")).mapInArrow(run, schema)
