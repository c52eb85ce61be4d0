"""SimHash near-dedup: segment-popcount embedding, grid range-join under Manhattan distance, exact verification."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilquery.llm.common import components, few, record, row_key, shingles, spread_join, staged

SEGMENTS, WIDTH = 16, 4  #: the 64 bits as 16 segments of 4 bits; a segment's bit count is 0 to 4


def shingle_hashes(words: list[bytes], size: int) -> np.ndarray:
    """XXH64 (seed 42) of every shingle, repeats included; fewer words than size: the whole sequence; none: empty."""
    if not words:
        return np.empty(0, np.uint64)
    n = max(1, len(words) - size + 1)
    h = xxhash.xxh64_intdigest
    return np.fromiter((h(b" ".join(words[i : i + size]), 42) for i in range(n)), np.uint64, n)


def simhash64(hashes: np.ndarray) -> int:
    """A bit is 1 if set in over half of the hashes; none: 0. Counted in blocks, so a long text needs no more memory."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 65536):
        block = np.ascontiguousarray(hashes[i : i + 65536], "<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(block, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0]) if len(hashes) else 0


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(id, fp long) for each row: SimHash over word shingles of the whole text, A-Z lower-cased; a null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [simhash64(shingle_hashes((t or b"").lower().split(), shingle)) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.array(found, np.uint64).view(np.int64))], ["id", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("t"))
    return rows.mapInArrow(run, "id long, fp long")


def links(nodes: DataFrame) -> DataFrame:
    """Links (a, b) that join all distinct fingerprints `fp` of nodes at Hamming distance 2 or less into the right components.

    The bit counts of the segments embed a fingerprint in a grid; the Manhattan distance there never exceeds the Hamming
    distance. Two points at Manhattan distance 2 or less share a cell at distance 1 or less from both, so each point enters
    its own cell and the neighbours (33 at most), and only cells with company can hold links. A cell of two is verified at once.
    The members of fuller cells enter their exact one-bit neighbourhoods instead: two fingerprints that differ in 2 bits or
    less share one of these words, and all in a word do differ so little. A word holds 65 fingerprints at most, so a star from
    the smallest carries the links and no group of any size is paired off.
    """
    fp = F.col("fp")
    counts = [F.bit_count(F.shiftrightunsigned(fp, WIDTH * s).bitwiseAND(F.lit((1 << WIDTH) - 1))) for s in range(SEGMENTS)]
    points = nodes.select("fp", *(c.alias(f"n{s}") for s, c in enumerate(counts)))
    points = points.withColumn("cell", sum((F.shiftleft(F.col(f"n{s}").cast("long"), 3 * s) for s in range(1, SEGMENTS)), F.col("n0").cast("long")))
    near = [F.col("cell")]
    for s in range(SEGMENTS):
        near += [F.when(F.col(f"n{s}") < WIDTH, F.col("cell") + F.lit(1 << 3 * s)), F.when(F.col(f"n{s}") > 0, F.col("cell") - F.lit(1 << 3 * s))]
    entered = points.select("fp", F.explode(F.array_compact(F.array(*near))).alias("cell"))
    cells = staged(entered.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).where("n > 1"))
    pairs = cells.where((F.col("n") == 2) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 2)).select("a", "b")
    full = entered.join(cells.where("n > 2").select("cell"), "cell", "left_semi").select("fp").distinct()
    words = full.select("fp", F.explode(F.array(fp, *(fp.bitwiseXOR(F.lit((1 << i) - (1 << 64) * (i == 63))) for i in range(64)))).alias("word"))
    stars = words.groupBy("word").agg(F.collect_set("fp").alias("all")).where(F.size("all") > 1)
    stars = stars.select(F.array_min("all").alias("a"), F.explode("all").alias("b")).where("a <> b")
    return pairs.union(stars).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """One row per input row: id column, fingerprint (16 hex digits), component_id.

    Fingerprints link at 2 or fewer differing bits; component_id is the smallest id reachable. Null and empty texts have
    fingerprint zero and link like any other. Repeated rows come out as often as they went in. Rows without an id belong to the
    group of their fingerprint but never name it; other columns are left out, so none can clash.
    """
    fps = staged(fingerprints(docs, id_col, text_col, shingle))
    nodes = staged(fps.groupBy("fp").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n")))
    found = components(links(nodes))
    named = found.join(nodes.withColumnRenamed("fp", "node"), "node").select("node", "component", "rep")
    named = named.join(named.groupBy("component").agg(F.min("rep").alias("least")), "component").select(F.col("node").alias("fp"), "least")
    named = staged(nodes.join(named, "fp", "left").select("fp", "n", F.coalesce("least", "rep").alias("component_id")))
    return spread_join(fps, named, ["fp"], "n", ["id"]).select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def units(words: list[bytes], least: int = 8, mask: int = 15) -> np.ndarray:
    """SimHashes of the units of a text: runs of words that end at words chosen by hash, so that an edit changes only its own unit."""
    ends, start = [], 0
    for i in np.flatnonzero((np.fromiter(map(xxhash.xxh32_intdigest, words), np.uint32, len(words)) & mask) == 0).tolist():
        if i + 1 - start >= least:
            ends.append(i + 1)
            start = i + 1
    if start < len(words):
        ends.append(len(words))
    return np.unique(np.array([simhash64(shingles(words[a:b], 3)) for a, b in zip([0, *ends], ends, strict=False)], np.uint64))


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = 0.8, shared: float = 0.25) -> DataFrame:
    """(id, tk, group): near-duplicate groups of two texts or more by the Jaccard similarity of 5-word shingles, checked exactly.

    A fingerprint radius of 2 bits misses many pairs at 0.8, so candidates come from two sources: whole texts whose 5-word SimHashes link, and
    texts that share units, of which `shared` of the smaller text must agree. Texts are compared with the leader of a shared unit
    (the text with most units shared, and the one with the least number), never all with all, and groups follow the links. Copies count as
    one text. group is an arbitrary number.
    """
    key = [*row_key(id_col, text_col), F.xxhash64(text_col, F.lit(7)).alias("c")]
    rows = docs.select(*key, F.col(text_col).cast("binary").alias("t"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for c, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                words = (t.as_py() or b"").lower().split()
                out.append((c, simhash64(shingles(words)) - (1 << 63), units(words).view(np.int64)))
            yield record([(c, f, u.tolist()) for c, f, u in out], [pa.int64(), pa.int64(), pa.list_(pa.int64())], ["c", "fp", "units"])

    texts = staged(rows.select("c", "t").mapInArrow(cut, "c long, fp long, units array<long>").groupBy("c", "fp", "units").agg(F.count(F.lit(1)).alias("n")).drop("n"))
    # whole texts: equal or linked fingerprints
    nodes = staged(texts.groupBy("fp").agg(F.min("c").alias("lead")))
    named = nodes.join(components(links(nodes)).withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    leads = named.groupBy("component").agg(F.min("lead").alias("y"))
    whole = texts.select("c", "fp").join(named.select("fp", "component"), "fp").join(leads, "component").select(F.col("c").alias("x"), "y")
    # shared units
    parts = texts.select("c", F.size("units").alias("all"), F.explode("units").alias("unit"))
    common = parts.groupBy("unit").agg(F.count(F.lit(1)).alias("n"), F.min("c").alias("low")).where("n > 1")
    common = staged(common)
    parts = staged(spread_join(parts, common, ["unit"], "n", ["c"]).select("unit", "c", "all"))
    weight = parts.groupBy("c").agg((F.count(F.lit(1)) / F.max("all")).alias("weight"))
    heads = parts.select("unit", "c").join(weight, "c").groupBy("unit").agg(F.max(F.struct("weight", "c")).alias("top")).select("unit", F.col("top.c").alias("top"))
    heads = staged(heads.join(common, "unit"))
    pairs = spread_join(parts, heads, ["unit"], "n", ["c"]).select("c", "all", F.explode(F.array_distinct(F.array("low", "top"))).alias("y")).where("c <> y")
    pairs = pairs.groupBy("c", "y").agg(F.count(F.lit(1)).alias("agree"), F.max("all").alias("all"))
    other = texts.select(F.col("c").alias("y"), F.size("units").alias("others"))
    pairs = pairs.join(other, "y").where(F.col("agree") >= shared * F.least("all", "others")).select(F.col("c").alias("x"), "y")
    pairs = staged(whole.where("x <> y").union(pairs).select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct())

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield record([(c, np.unique(shingles((t.as_py() or b"").lower().split())).tobytes()) for c, t in zip(b.column(0).to_pylist(), b.column(1), strict=True)], [pa.int64(), pa.binary()], ["c", "s"])

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for p, q in zip(b.column(2), b.column(3), strict=True):
                p, q = (np.frombuffer(z.as_buffer(), np.uint64) for z in (p, q))
                both = len(np.intersect1d(p, q, assume_unique=True))
                keep.append(both >= similarity * (len(p) + len(q) - both))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    asked = pairs.select(F.explode(F.array("x", "y")).alias("c")).distinct()
    first = rows.select("id", "tk", "c").groupBy("c").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "tk")).alias("one"))
    asked = staged(asked.join(first, "c").select("c", F.col("one.id").alias("oid"), F.col("one.tk").alias("otk")))
    chosen = rows.join(few(asked), F.col("id").eqNullSafe(F.col("oid")) & (F.col("tk") == F.col("otk"))).select(rows["c"], "t")
    shown = staged(chosen.mapInArrow(sets, "c long, s binary").dropDuplicates(["c"]))
    compared = pairs.join(shown.select(F.col("c").alias("x"), F.col("s").alias("p")), "x").join(shown.select(F.col("c").alias("y"), F.col("s").alias("q")), "y").select("x", "y", "p", "q")
    linked = components(compared.mapInArrow(check, "a long, b long"))
    copies = rows.groupBy("c").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("c").alias("node"))
    groups = linked.union(copies.join(linked, "node", "left_anti").select("node", F.col("node").alias("component")))
    return rows.select("id", "tk", "c").join(groups.withColumnRenamed("node", "c"), "c").select("id", "tk", F.col("component").alias("group"))


def without_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = 0.8) -> DataFrame:
    """docs with one row of each group of similar_groups: the least id, then text; of repeated rows one. Rows alike in nothing stay."""
    groups = staged(similar_groups(docs, id_col, text_col, similarity))
    order = F.struct(F.col("id").isNull().alias("none"), "id", "tk")
    best = groups.groupBy("group").agg(F.min(order).alias("best"))
    marked = staged(groups.join(best, "group").groupBy("id", "tk").agg(F.count(F.lit(1)).alias("n"), F.max(order == F.col("best")).alias("stays")))
    match = F.col("__id").eqNullSafe(F.col("id")) & (F.col("__tk") == F.col("tk"))
    keyed = docs.select(F.struct(*docs.columns).alias("__row"), F.col(id_col).alias("__id"), F.xxhash64(text_col).alias("__tk"))
    kept = keyed.join(few(marked.where("not stays").select("id", "tk")), match, "left_anti")
    repeated = marked.where("stays and n > 1").select("id", "tk")
    if not repeated.isEmpty():
        again = few(repeated)
        kept = kept.join(again, match, "left_anti").union(kept.join(again, match, "left_semi").dropDuplicates(["__id", "__tk"]))
    return kept.select("__row.*")
