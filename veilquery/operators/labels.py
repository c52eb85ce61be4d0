"""Token labels: from spans to BIO and back, BILUO, repair and checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

def within():
    return Window.partitionBy("doc").orderBy("i")


def encode(tokens: DataFrame, spans: DataFrame) -> DataFrame:
    """tokens with a BIO label. A span counts if it starts where a token starts and ends where one ends; others leave O."""
    t, s = tokens, spans.select(F.col("doc").alias("sdoc"), F.col("start").alias("a"), F.col("end").alias("b"), F.col("tag"))
    inside = t.join(s, (F.col("doc") == F.col("sdoc")) & (F.col("start") >= F.col("a")) & (F.col("end") <= F.col("b")) & (F.col("a") < F.col("b")))
    whole = Window.partitionBy("doc", "a", "b", "tag")
    inside = inside.withColumn("ok", (F.min("start").over(whole) == F.col("a")) & (F.max("end").over(whole) == F.col("b"))).where("ok")
    marks = inside.groupBy("doc", "i").agg(F.min(F.struct("a", "b", "tag", "start")).alias("m"))
    marks = marks.select("doc", "i", F.concat(F.when(F.col("m.start") == F.col("m.a"), "B-").otherwise("I-"), F.col("m.tag")).alias("label"))
    return t.join(marks, ["doc", "i"], "left").withColumn("label", F.coalesce("label", F.lit("O")))


def tag_of(label: Column) -> Column:
    return F.substring(label, 3, 1000)


def _beside(labels: DataFrame, column: str, added, name: str) -> DataFrame:
    """labels with a column: added(label, label before, label behind) for labelled tokens, the label itself for O. Neighbours count if they stand next to each other.

    Only labelled tokens are shuffled, few as they are among all.
    """
    label, i = F.col(column), F.col("i")
    before = F.when(F.lag("i").over(within()) == i - 1, F.lag(column).over(within())).otherwise("O")
    behind = F.when(F.lead("i").over(within()) == i + 1, F.lead(column).over(within())).otherwise("O")
    return labels.where(label != "O").withColumn(name, added(label, before, behind)).unionByName(labels.where(label == "O").withColumn(name, label))


def to_biluo(labels: DataFrame) -> DataFrame:
    """labels with biluo: the last of a chunk is L, a single one U."""

    def ending(label: Column, _: Column, behind: Column) -> Column:
        ends = ~behind.startswith("I")
        single, last = F.concat(F.lit("U-"), tag_of(label)), F.concat(F.lit("L-"), tag_of(label))
        return F.when(label.startswith("B") & ends, single).when(label.startswith("I") & ends, last).otherwise(label)

    return _beside(labels, "label", ending, "biluo")


def from_biluo(label: Column) -> Column:
    return F.when(label == "-", "O").when(label.startswith("L-"), F.concat(F.lit("I-"), tag_of(label))).when(label.startswith("U-"), F.concat(F.lit("B-"), tag_of(label))).otherwise(label)


def repair(labels: DataFrame) -> DataFrame:
    """labels whose I that continue nothing become B: judged by the label before, as it was."""

    def mended(label: Column, before: Column, _: Column) -> Column:
        dangling = label.startswith("I-") & ((before == "O") | (tag_of(before) != tag_of(label)))
        return F.when(dangling, F.concat(F.lit("B-"), tag_of(label))).otherwise(label)

    return _beside(labels, "label", mended, "fixed")


def violations(labels: DataFrame) -> DataFrame:
    """Tokens labelled I at the start of a document or behind O or another tag."""
    return repair(labels).where("label <> fixed").drop("fixed")


def to_spans(labels: DataFrame, column: str = "label") -> DataFrame:
    """(doc, ann_id, start, end, tag): each B opens a span that its I tokens extend; numbered from T0 by start. O tokens go before the shuffle."""
    island = F.sum(F.col(column).startswith("B").cast("int")).over(within().rowsBetween(Window.unboundedPreceding, 0))
    rows = labels.where(F.col(column) != "O").withColumn("island", island)
    out = rows.groupBy("doc", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min_by(tag_of(F.col(column)), "i").alias("tag"))
    number = F.row_number().over(Window.partitionBy("doc").orderBy("start")) - 1
    return out.select("doc", F.concat(F.lit("T"), number).alias("ann_id"), "start", "end", "tag")


def sentences_merged(tokens: DataFrame, column: str = "label") -> DataFrame:
    """tokens (doc, i, sent_id, label) whose sentences that start inside an entity, at an I or L, belong to the one before; numbered anew from 0."""
    first = Window.partitionBy("doc", "sent_id")
    opens = (F.col("i") == F.min("i").over(first)) & ~F.min_by(column, "i").over(first).rlike("^[IL]-")
    number = F.sum(opens.cast("int")).over(within().rowsBetween(Window.unboundedPreceding, 0))
    return tokens.withColumn("sent_id", F.greatest(F.lit(0), number - 1).cast("int"))
