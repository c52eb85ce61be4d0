"""Best-fit packing by linear grouping: the driver plans over the histogram of lengths, the cluster deals out the pieces."""

from __future__ import annotations

import base64
import bisect
import functools
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilquery.llm.common import staged

END_ID = 0
PIECES = "id long, piece int, start long, length long, ids_crc32 long, part int, nth long"


def specials(name: str) -> tuple[str, ...]:
    """The special tokens of the vocabulary called name, as text."""
    import public_tokenizers

    with open(public_tokenizers.path(f"{name}.json"), encoding="utf-8") as f:
        return tuple(t["content"] for t in json.load(f)["added_tokens"])


@functools.cache
def full_encoder(name: str):
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(f"{name}.json"))


@functools.cache
def encoder(name: str, special: tuple[str, ...]):
    """A function from text to ids as `tokenizers` gives them for the vocabulary called name.

    The same vocabulary as ranks encodes faster and in less memory; texts with special tokens, which only the JSON file defines, go to
    tokenizers, which is loaded when one comes.
    """
    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(text: str) -> list[int]:
        if not any(s in text for s in special):
            try:
                return fast.encode_ordinary(text)
            except BaseException as gave_up:  # its pattern engine panics on some very long runs of blanks, with an error of its own kind
                if type(gave_up).__name__ != "PanicException":
                    raise
        return full_encoder(name).encode(text, add_special_tokens=False).ids

    return encode


def pieces(docs: DataFrame, id_col: str, text_col: str, size: int, vocabulary: str) -> DataFrame:
    """Token pieces of each document; nth counts the pieces of a length within the partition `part`."""

    special = specials(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, seen, part = encoder(vocabulary, special), np.zeros(size + 1, np.int64), TaskContext.get().partitionId()
        for b in batches:
            out: list[tuple] = []
            for key, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids = np.array([*encode(text.as_py() or ""), END_ID], "<u4")
                first = len(ids) if len(ids) <= size else len(ids) % size or size
                bounds = [0, *range(first, len(ids) + 1, size)]
                for k, (i, j) in enumerate(zip(bounds, bounds[1:], strict=False)):
                    out.append((key, k, i, j - i, zlib.crc32(ids[i:j].tobytes()), part, int(seen[j - i])))
                    seen[j - i] += 1
            columns = list(zip(*out, strict=True)) or [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), *[pa.int64()] * 3, pa.int32(), pa.int64()), strict=True)], ["id", "piece", "start", "length", "ids_crc32", "part", "nth"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t")).mapInArrow(run, PIECES)


def plan(counts: dict[int, int], size: int, groups: int = 256, small: int | None = None) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Slots (length, first rank, first sequence, offset, how many) that place counts[n] pieces of length n; and the sequences used.

    Lengths over `small` are sorted and cut into groups of equal cardinality, each rounded up to its largest. Of these few sizes the
    fullest configuration that holds the largest size left is taken as often as the stock allows, again and again. The true
    lengths are then put in, so runs of equal sequences come out, and small lengths go to the tightest gap, longest first. All
    work is on at most `size` distinct lengths and runs of equal sequences, however many documents stand behind them.
    """
    small = size // 8 if small is None else small
    stock: list[list[int]] = []  # of the large, longest first: [length, count]
    for n in sorted((n for n in counts if n > small), reverse=True):
        stock.append([n, counts[n]])
    total = sum(c for _, c in stock)
    share = max(1, -(-total // groups))
    rounded: list[int] = []
    queue: list[list[list[int]]] = []
    left = 0
    for n, c in stock:
        while c:
            if not left:
                rounded.append(n)
                queue.append([])
                left = share
            take = min(c, left)
            queue[-1].append([n, take])
            c, left = c - take, left - take
    have = [sum(c for _, c in q) for q in queue]
    used, slots, rank = 0, [], dict.fromkeys(counts, 0)
    gaps: list[int] = []  # sorted
    runs: dict[int, list[list[int]]] = {}  # gap: [first sequence, how many]

    def leave(gap: int, first: int, many: int) -> None:
        if gap:
            if gap not in runs:
                bisect.insort(gaps, gap)
                runs[gap] = []
            runs[gap].append([first, many])

    while any(have):
        lead = next(g for g, h in enumerate(have) if h)
        config = _fullest(rounded, have, lead, size)
        times = min(have[g] // k for g, k in config.items())
        row = [g for g, k in sorted(config.items()) for _ in range(k)]
        for g, k in config.items():
            have[g] -= k * times
        draws = [_draw(queue[g], times) for g in row]
        while draws[0]:
            many = min(d[0][1] for d in draws)
            offset = 0
            for d in draws:
                n = d[0][0]
                slots.append((n, rank[n], used, offset, many))
                rank[n] += many
                offset += n
                d[0][1] -= many
                if not d[0][1]:
                    d.pop(0)
            leave(size - offset, used, many)
            used += many
    for n in sorted((n for n in counts if n <= small), reverse=True):
        c = counts[n]
        while c:
            at = bisect.bisect_left(gaps, n)
            if at == len(gaps):
                many = -(-c // (size // n))
                leave(size, used, many)
                used += many
                continue
            gap = gaps[at]
            run = runs[gap][-1]
            many = min(c, run[1])
            slots.append((n, rank[n], run[0], size - gap, many))
            rank[n] += many
            c -= many
            if many == run[1]:
                runs[gap].pop()
                if not runs[gap]:
                    del runs[gap]
                    gaps.pop(at)
            else:
                runs[gap][-1] = [run[0] + many, run[1] - many]
            leave(gap - n, run[0], many)
    return slots, used


def _fullest(sizes: list[int], have: list[int], lead: int, size: int) -> dict[int, int]:
    """The configuration with one `lead` at least whose rounded sizes come closest to size; of equal ones that with longer parts."""
    room = size - sizes[lead]
    reach, steps = 1, []  # bit n: n can be filled
    for g in range(lead, len(sizes)):
        free = have[g] - (g == lead)
        for _ in range(min(free, room // sizes[g])):
            more = reach | reach << sizes[g] & (1 << room + 1) - 1
            if more == reach:
                break
            steps.append((g, reach))
            reach = more
        if reach >> room:
            break
    fill, config = reach.bit_length() - 1, {lead: 1}
    for g, before in reversed(steps):
        if fill and not before >> fill & 1:
            config[g] = config.get(g, 0) + 1
            fill -= sizes[g]
    return config


def _draw(queue: list[list[int]], many: int) -> list[list[int]]:
    out = []
    while many:
        take = min(many, queue[0][1])
        out.append([queue[0][0], take])
        queue[0][1] -= take
        many -= take
        if not queue[0][1]:
            queue.pop(0)
    return out


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 2048, vocabulary: str = "byte_bpe_50k") -> DataFrame:
    """One row per piece: id column, piece, start, length, ids_crc32, sequence_id, offset.

    Each document is its ids and then id 0; null and empty texts are that id alone. Only longer documents are cut, into pieces of
    `size`, the first of which may be shorter. Repeated rows are packed as often as they come. An empty table gives no row.
    """
    cut = staged(pieces(docs, id_col, text_col, size, vocabulary))
    by_part = staged(cut.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n")))
    counts = {r.length: r.n for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # size rows at most
    slots, _ = plan(counts, size)
    slots.sort()
    length, first, sequence, offset = (np.array([s[i] for s in slots], np.int64) for i in range(4))
    start = length << 48 | first
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shift = by_part.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    ranked = cut.join(shift, ["length", "part"]).select("id", "piece", "start", "length", "ids_crc32", (F.col("nth") + F.col("shift")).alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, rank = (np.asarray(b.column(i)) for i in (3, 5))
            at = np.searchsorted(start, n << 48 | rank, "right") - 1
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(sequence[at] + rank - first[at]), pa.array(offset[at])], ["id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    placed = ranked.mapInArrow(place, "id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    return placed.withColumnRenamed("id", id_col)
