"""Suffix-array dedup by a run-length index: long byte strings that also start elsewhere are found and removed.

Anchors bring together what can match: of the hashes of all 32-byte strings in a 400-byte window the least one is the window's
anchor, so equal windows have equal anchors, and the windows of one anchor place lie in one short segment. Segments alike are
counted, not indexed. The different segments of an anchor go to one task, which builds the run-length Burrows-Wheeler transform
over a few megabytes of them at a time, takes the matching statistics at the run heads and streams them through the text.
An anchor with very many different segments is split first: its segments are cut into blocks of neighbouring windows, and those blocks
go to one index whose common bytes are equal, so every group that an index serves is small, however hot the anchor.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilquery.llm.common import record, spread_join, staged

GRAM = 32
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def gram_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all byte strings of length size (a power of two), by doubling."""
    h = (data.astype(np.uint64) + np.uint64(1)) * _MULTIPLIER
    factor, n = _MULTIPLIER, 1
    with np.errstate(over="ignore"):
        while n < size:
            h = h[:-n] * factor + h[n:]
            factor *= factor
            n *= 2
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        return h ^ h >> np.uint64(32)


PLACE_BITS = 24  #: a text is worked off in pieces of 2 ** 24 places; the other 40 bits of a hash are compared


def anchors(data: np.ndarray, window: int, bits: int = PLACE_BITS) -> tuple[np.ndarray, ...]:
    """(hash, place, first window start, last window start) for the runs of windows with one anchor, the last least hash of the window.

    Hashes are compared by the same bits in texts of any length, so equal windows have equal anchors; equal ones are told apart by place.
    """
    starts, found = len(data) - window + 1, []
    step = (1 << bits) - window
    for at in range(0, max(0, starts), step):
        piece = data[at : at + min(step, starts - at) + window - 1]
        h, place, first, last = _anchors(piece, window, bits)
        found.append((h, place + at, first + at, last + at))
    if not found:
        return np.empty(0, np.uint64), *[np.empty(0, np.int64)] * 3
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def _anchors(data: np.ndarray, window: int, bits: int) -> tuple[np.ndarray, ...]:
    h = gram_hashes(data, GRAM)
    n, span = len(h), window - GRAM + 1
    place = np.uint64((1 << bits) - 1)
    least = (h & ~place) | (place - np.arange(n, dtype=np.uint64))
    step = 1
    while step * 2 <= span:
        least = np.minimum(least[:-step], least[step:])
        step *= 2
    starts = len(data) - window + 1
    least = np.minimum(least[:starts], least[span - step : span - step + starts])
    at = ((1 << bits) - 1) - (least & place).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    last = np.concatenate([first[1:] - 1, [starts - 1]])
    return h[at[first]], at[first], first, last


class RunLengthIndex:
    """Run-length Burrows-Wheeler transform of texts that are kept apart, with suffix places sampled at the run heads.

    longest[i]: how many bytes the suffix at i shares, within their texts, with the suffix before it in sorted order. It is compared
    only where a run starts; elsewhere the place before i shares one byte more, so the samples stream through the text, each
    place losing one.
    """

    def __init__(self, texts: list[bytes]):
        data = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8)
        n = len(data)
        sizes = np.array([len(t) + 1 for t in texts])
        ends = np.cumsum(sizes) - 1
        self.starts = ends - sizes + 1
        self.room = np.repeat(ends, sizes) - np.arange(n)  # bytes to the end of the text
        self.symbols = data.astype(np.int64) + 1
        self.symbols[ends] = 0
        ranks, self.order = self._sorted(int(sizes.max()))
        before = self.symbols[self.order - 1]
        closing = self.room[self.order] == 0
        before[closing] = -1 - np.arange(int(closing.sum()))
        is_start = np.zeros(n, bool)
        is_start[self.starts] = True
        heads = np.flatnonzero(np.concatenate([[True], before[1:] != before[:-1]]) | is_start[self.order])
        self.runs = len(heads)
        at, other = self.order[heads], self.order[heads - 1]
        shared = self._common(ranks, at, other)
        shared[heads == 0] = 0
        sample, value = np.zeros(n, np.int64), np.zeros(n, np.int64)
        sample[at], value[at] = at, shared
        last = np.maximum.accumulate(sample)  # the first text's start is sampled
        self.longest = np.maximum(0, value[last] - (np.arange(n) - last))

    def _sorted(self, longest: int) -> tuple[list[tuple[int, np.ndarray]], np.ndarray]:
        """Ranks of all strings of 7, 14, ... bytes within their texts, and the places in suffix order; equal ends sort by text."""
        n = len(self.symbols)
        key, open_ = np.zeros(n, np.uint64), np.ones(n, bool)
        for i in range(7):  # 9 bits a symbol
            s = np.zeros(n, np.uint64)
            s[: max(0, n - i)] = self.symbols[i:]
            key = key << np.uint64(9) | np.where(open_ & (self.room >= i), s, 0).astype(np.uint64)
        length, ranks = 7, []
        while True:
            order = np.argsort(key)
            ordered = key[order]
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(np.concatenate([[0], ordered[1:] != ordered[:-1]]))
            ranks.append((length, rank))
            if length > longest:
                return ranks, np.argsort(rank << 32 | np.arange(n))
            following = np.zeros(n, np.int64)
            following[: max(0, n - length)] = rank[length:] + 1
            key = (rank << 32 | np.where(self.room >= length, following, 0)).astype(np.uint64)
            length *= 2

    def _common(self, ranks: list[tuple[int, np.ndarray]], a: np.ndarray, b: np.ndarray) -> np.ndarray:
        n, shared = len(self.symbols), np.zeros(len(a), np.int64)
        most = np.minimum(self.room[a], self.room[b])
        for length, rank in reversed(ranks):
            i, j = np.minimum(a + shared, n - 1), np.minimum(b + shared, n - 1)
            shared += np.where((rank[i] == rank[j]) & (shared < most), length, 0)
        for _ in range(7):
            i, j = np.minimum(a + shared, n - 1), np.minimum(b + shared, n - 1)
            shared += (self.symbols[i] == self.symbols[j]) & (shared < most)
        return np.minimum(shared, most)

    def repeated(self, length: int) -> np.ndarray:
        """True at each place whose next `length` bytes also start elsewhere in the texts."""
        out = np.zeros(len(self.symbols), bool)
        rows = np.flatnonzero(self.longest[self.order] >= length)
        out[self.order[rows]] = out[self.order[rows - 1]] = True
        return out


def spans_of(starts: np.ndarray, offset: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last of the runs of neighbouring numbers in starts (sorted), moved by offset."""
    if not len(starts):
        return starts, starts
    cut = np.flatnonzero(np.diff(starts) > 1)
    return starts[np.concatenate([[0], cut + 1])] + offset, starts[np.concatenate([cut, [len(starts) - 1]])] + offset


def _indexed(segments: DataFrame, window: int, block: int) -> DataFrame:
    """(id, tk, a, b): runs of window starts that recur among the segments (id, tk, first, data) of their `part`. A task holds `block` bytes and one part more."""

    def solve(held: list[tuple]) -> pa.RecordBatch:
        index = RunLengthIndex([h[3] for h in held])
        marks, out = index.repeated(window), []
        for (key, tk, first, data), start in zip(held, index.starts.tolist(), strict=True):
            a, b = spans_of(np.flatnonzero(marks[start : start + len(data) - window + 1]), first)
            out += [(key, tk, x, y) for x, y in zip(a.tolist(), b.tolist(), strict=True)]
        return record(out, [pa.int64(), pa.int64(), pa.int32(), pa.int32()], ["id", "tk", "a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, was = [], 0, None
        for b in batches:
            for part, key, tk, first, data in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                if part != was and size >= block:
                    yield solve(held)
                    held, size = [], 0
                was = part
                held.append((key, tk, first, data))
                size += len(data)
        if held:
            yield solve(held)

    rows = segments.select("part", "id", "tk", "first", "data").repartition("part").sortWithinPartitions("part")
    return rows.mapInArrow(run, "id long, tk long, a int, b int")


def _split(segments: DataFrame, window: int, most: int, block: int) -> DataFrame:
    """As _indexed, for anchors with any number of segments, which are cut into blocks of 64 neighbouring windows, then 16, 4 and 1.

    All windows of a block share a core, and equal windows of two segments lie in blocks with equal cores, as blocks are laid out from
    the anchor. A core seen once holds no recurring window; a block seen twice recurs as a whole; the different blocks of a core go to
    one index if they are `most` at most, else they are cut finer. A block of one window is its core. Each step makes a few
    rows for each block that is left, and no group larger than `most` meets in one task.
    """
    step = 64
    schema = "anchor long, id long, tk long, lo int, hi int, core long, whole long"
    own = ["anchor", "id", "tk", "first", "last", "place", "data"]
    todo, marks = segments.select(*own, F.array(F.struct(F.col("first").alias("lo"), F.col("last").alias("hi"))).alias("parts")), []
    while True:

        def cut(batches: Iterator[pa.RecordBatch], step: int = step) -> Iterator[pa.RecordBatch]:
            h = xxhash.xxh64_intdigest
            for b in batches:
                out = []
                for anchor, key, tk, first, place, data, parts in zip(*(b.column(i).to_pylist() for i in (0, 1, 2, 3, 5, 6, 7)), strict=True):
                    for part in parts:
                        lo = part["lo"]
                        while lo <= part["hi"]:
                            start = lo - (lo - place) % step  # blocks are laid out from the anchor
                            hi = min(part["hi"], start + step - 1)
                            core = h(b"%d %d " % (start - place, step) + data[start + step - 1 - first : start + window - first])
                            whole = h(b"%d %d " % (lo - start, hi - start) + data[lo - first : hi + window - first], core)
                            out.append((anchor, key, tk, lo, hi, core - (core >> 63 << 64), whole - (whole >> 63 << 64)))
                            lo = hi + 1
                if out:
                    yield record(out, [*[pa.int64()] * 3, *[pa.int32()] * 2, *[pa.int64()] * 2], ["anchor", "id", "tk", "lo", "hi", "core", "whole"])

        blocks = staged(todo.mapInArrow(cut, schema))
        wholes = staged(blocks.groupBy("anchor", "core", "whole").agg(F.count(F.lit(1)).alias("same"), F.min(F.struct("id", "tk", "lo", "hi")).alias("one")))
        again = spread_join(blocks, wholes.where("same > 1").select("anchor", "core", "whole", "same"), ["anchor", "core", "whole"], "same", ["id", "tk", "lo"], "left_semi")
        marks.append(again.select("id", "tk", F.col("lo").alias("a"), F.col("hi").alias("b")))
        # of blocks that share a core but differ, one of each kind goes on
        mixed = wholes.groupBy("anchor", "core").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1")
        rest = staged(spread_join(wholes, mixed, ["anchor", "core"], "kinds", ["whole"]).select("anchor", "core", "kinds", "one.*"))
        if rest.isEmpty():
            break
        parts = rest.groupBy("anchor", "id", "tk").agg(F.collect_list(F.struct("core", "kinds", "lo", "hi")).alias("parts"))  # of one document
        held = segments.select(*own).join(parts, ["anchor", "id", "tk"]).withColumn("parts", F.filter("parts", lambda x: (x["lo"] >= F.col("first")) & (x["hi"] <= F.col("last"))))
        served = held.select("anchor", "id", "tk", "first", "data", F.explode(F.filter("parts", lambda x: x["kinds"] <= most)).alias("x"))
        served = served.select(F.xxhash64("anchor", "x.core").alias("part"), "id", "tk", F.col("x.lo").alias("first"), F.expr(f"substring(data, x.lo - first + 1, x.hi - x.lo + {window})").alias("data"))
        marks.append(_indexed(served, window, block))
        todo = held.withColumn("parts", F.transform(F.filter("parts", lambda x: x["kinds"] > most), lambda x: F.struct(x["lo"].alias("lo"), x["hi"].alias("hi")))).where("size(parts) > 0")
        if step == 1:
            break  # a window is its core, so none is left
        step //= 4
    out = marks[0]
    for m in marks[1:]:
        out = out.union(m)
    return out


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 400, most: int = 512, block: int = 1 << 20) -> DataFrame:
    """One row per document row: id column, n_bytes, n_removed, n_spans, kept_sha256.

    Every byte covered by a `window`-byte string that also starts anywhere else, in the same document or another, is removed;
    overlaps count and all is judged on the input. Matches never cross documents. Null texts are empty. Repeated rows are copies of
    each other, so they lose everything from `window` bytes on. Ids may be of any type, null included: a row is named by 64-bit hashes of
    id and text. An empty table gives no row; other columns are left out. `most` and `block` bound the segments and bytes that an index
    holds, whatever the input: larger groups are split, not cut short.
    """
    key = F.col(id_col)
    rows = docs.select(F.xxhash64(key, key.isNull()).alias("id"), F.xxhash64(text_col).alias("tk"), F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("t"), key.alias("own"))

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_128_digest
        for b in batches:
            for i, text in enumerate(b.column(2)):
                text = text.as_py()
                h, place, first, last = anchors(np.frombuffer(text, np.uint8), window)
                if m := len(h):
                    d = np.frombuffer(b"".join(digest(text[x : y + window]) for x, y in zip(first.tolist(), last.tolist(), strict=True)), "<i8").reshape(-1, 2)
                    same = [pa.array(np.full(m, b.column(k)[i].as_py(), np.int64)) for k in (0, 1)]
                    places = [pa.array(x.astype(np.int32)) for x in (place, first, last)]
                    yield pa.RecordBatch.from_arrays(
                        [*same, pa.array(h.view(np.int64)), *places, pa.array(d[:, 0].copy()), pa.array(d[:, 1].copy())],
                        ["id", "tk", "anchor", "place", "first", "last", "d1", "d2"],
                    )

    found = staged(rows.select("id", "tk", "t").mapInArrow(segments, "id long, tk long, anchor long, place int, first int, last int, d1 long, d2 long"))
    # segments alike are counted; one stands for all
    one = F.min(F.struct("id", "tk", "place", "first", "last")).alias("one")
    alike = staged(found.groupBy("anchor", "d1", "d2").agg(F.count(F.lit(1)).alias("n"), one))
    again = spread_join(found, alike.where("n > 1").select("anchor", "d1", "d2", "n"), ["anchor", "d1", "d2"], "n", ["id", "tk"], "left_semi")
    marks = again.select("id", "tk", F.col("first").alias("a"), F.col("last").alias("b"))
    groups = alike.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1")
    wanted = spread_join(alike.select("anchor", "one"), groups, ["anchor"], "kinds", ["one"]).select("anchor", "kinds", "one.*")
    asked = wanted.groupBy("id", "tk").agg(F.collect_list(F.struct("anchor", "kinds", "place", "first", "last")).alias("asked"))  # of one document
    shown = rows.join(asked, ["id", "tk"]).select("id", "tk", "t", F.explode("asked").alias("x"))
    shown = shown.select("id", "tk", "x.*", F.expr(f"substring(t, x.first + 1, x.last - x.first + {window})").alias("data"))
    shown = staged(shown.dropDuplicates(["anchor", "id", "tk", "first"]))
    marks = marks.union(_indexed(shown.where(F.col("kinds") <= most).withColumnRenamed("anchor", "part"), window, block))
    many = shown.where(F.col("kinds") > most)
    if not many.isEmpty():
        marks = marks.union(_split(many, window, most, block))
    marks = marks.groupBy("id", "tk").agg(F.array_sort(F.collect_set(F.struct("a", "b"))).alias("marks"))  # of one document
    fields = "n_bytes long, n_removed long, n_spans long, kept_sha256 string"

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text, spans in zip(b.column(1), b.column(2), strict=True):
                text, runs = text.as_py(), []
                for m in spans.as_py() or ():
                    if runs and m["a"] <= runs[-1][1]:
                        runs[-1][1] = max(runs[-1][1], m["b"] + window)
                    else:
                        runs.append([m["a"], m["b"] + window])
                digest, at = hashlib.sha256(), 0
                for x, y in runs:
                    digest.update(text[at:x])
                    at = y
                digest.update(text[at:])
                out.append((len(text), sum(y - x for x, y in runs), len(runs), digest.hexdigest()))
            if out:
                made = record(out, [*[pa.int64()] * 3, pa.string()], [c.split()[0] for c in fields.split(", ")])
                yield pa.RecordBatch.from_arrays([b.column(0), *made.columns], ["own", *made.schema.names])

    done = rows.join(marks, ["id", "tk"], "left").select("own", "t", "marks")
    return done.mapInArrow(kept, f"own {dict(rows.dtypes)['own']}, {fields}").withColumnRenamed("own", id_col)
