"""Evaluation: entity, token and label-blind scores, agreement of annotators, significance by randomisation."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


ENTITY = ["doc", "start", "end", "tag"]


def ratio(a: Column, b: Column) -> Column:
    """Rounded half to even to 4 places; 0 if b is."""
    return F.coalesce(F.bround(F.try_divide(a.cast("double"), b.cast("double")), 4), F.lit(0.0))


def scores(counts: DataFrame) -> DataFrame:
    """counts (tp, fp, fn, tn) with precision, recall, accuracy and f1, the latter from the rounded two."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    out = counts.withColumns({"precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "accuracy": ratio(tp, tp + fp + fn)})
    p, r = F.col("precision"), F.col("recall")
    return out.withColumn("f1", F.coalesce(F.bround(F.try_divide(2 * p * r, p + r), 4), F.lit(0.0)))


def compared(gold: DataFrame, predicted: DataFrame, keys: list[str] = ENTITY) -> DataFrame:
    """Distinct entities of both sides with the flags in_gold and in_pred."""
    g, p = gold.select(*keys).distinct().withColumn("g", F.lit(True)), predicted.select(*keys).distinct().withColumn("p", F.lit(True))
    return g.join(p, keys, "full_outer").select(*keys, F.coalesce("g", F.lit(False)).alias("in_gold"), F.coalesce("p", F.lit(False)).alias("in_pred"))


def _counts() -> list[Column]:
    return [F.count_if(F.col("in_gold") & F.col("in_pred")).alias("tp"), F.count_if(~F.col("in_gold") & F.col("in_pred")).alias("fp"), F.count_if(F.col("in_gold") & ~F.col("in_pred")).alias("fn"), F.lit(0).cast("long").alias("tn")]


def entity_level(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """One row per class and one, `overall`, from the summed counts: by rollup."""
    both = compared(gold, predicted).rollup("tag").agg(*_counts(), F.grouping("tag").alias("whole"))
    return scores(both.select(F.when(F.col("whole") == 1, "overall").otherwise(F.col("tag")).alias("class_name"), "tp", "fp", "fn", "tn"))


def token_level(labels: DataFrame) -> DataFrame:
    """labels (gold, pred: tags or O per token). Classes are the gold tags; pairs with a tag outside these and O don't count."""
    pairs = labels.groupBy("gold", "pred").agg(F.count(F.lit(1)).alias("n"))
    classes = labels.where("gold <> 'O'").select(F.col("gold").alias("class_name")).distinct()
    known = classes.union(classes.sparkSession.createDataFrame([("O",)], "class_name string"))
    pairs = pairs.join(known.withColumnRenamed("class_name", "pred"), "pred", "left_semi")
    total = pairs.agg(F.sum("n").alias("total"))
    sums = pairs.select(F.explode(F.array(F.struct(F.col("gold").alias("c"), (F.col("gold") == F.col("pred")).cast("long").alias("t"), F.lit(1).alias("g"), F.lit(0).alias("p")), F.struct(F.col("pred").alias("c"), F.lit(0).cast("long").alias("t"), F.lit(0).alias("g"), F.lit(1).alias("p")))).alias("x"), "n")
    sums = sums.groupBy(F.col("x.c").alias("class_name")).agg(F.sum(F.col("x.t") * F.col("n")).alias("tp"), F.sum(F.col("x.g") * F.col("n")).alias("g"), F.sum(F.col("x.p") * F.col("n")).alias("p"))
    rows = sums.where("class_name <> 'O'").join(F.broadcast(total))
    rows = rows.select("class_name", "tp", (F.col("p") - F.col("tp")).alias("fp"), (F.col("g") - F.col("tp")).alias("fn"), (F.col("total") - F.col("p") - F.col("g") + F.col("tp")).alias("tn"))
    overall = rows.agg(F.lit("overall").alias("class_name"), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tp", "fp", "fn", "tn")))
    return scores(rows.union(overall))


def token_blind(labels: DataFrame) -> DataFrame:
    """Entity or not, whatever the tag; zeros if nothing is labelled."""
    g, p = F.col("gold") != "O", F.col("pred") != "O"
    return scores(labels.agg(F.lit("ENT").alias("class_name"), F.count_if(g & p).alias("tp"), F.count_if(~g & p).alias("fp"), F.count_if(g & ~p).alias("fn"), F.count_if(~g & ~p).alias("tn")))


def macro(entity: DataFrame) -> DataFrame:
    """Mean F (unrounded) and mean accuracy (rounded) over classes."""
    return entity.where("class_name <> 'overall'").agg(F.avg("f1").alias("macro_f1"), F.bround(F.avg("accuracy"), 4).alias("macro_accuracy"))


def agreement(a: DataFrame, b: DataFrame, by_tag: bool = True) -> DataFrame:
    """F1 of two annotators over spans with text, unrounded: null-free, NaN where the first has none, 0 without overlap."""
    keys = [*ENTITY, "text"]
    both = compared(a, b, keys)
    out = (both.groupBy("tag") if by_tag else both.groupBy()).agg(F.count_if("in_gold").alias("n_a"), F.count_if("in_pred").alias("n_b"), F.count_if(F.col("in_gold") & F.col("in_pred")).alias("n_both"))
    return out.withColumn("f1", F.when(F.col("n_a") == 0, F.lit(float("nan"))).otherwise(2.0 * F.col("n_both") / (F.col("n_a") + F.col("n_b"))))


def unflatten(predicted: DataFrame, gold: DataFrame, flat: dict[str, str]) -> DataFrame:
    """Predictions with coarse tags take the fine tag of a gold span at the same place whose coarse tag is theirs."""
    coarse = F.coalesce(F.create_map(*(F.lit(x) for kv in flat.items() for x in kv))[F.col("tag")], F.col("tag"))
    fine = gold.select("doc", "start", "end", coarse.alias("coarse"), "tag").groupBy("doc", "start", "end", "coarse").agg(F.max("tag").alias("fine"))
    return predicted.withColumnRenamed("tag", "coarse").join(fine, ["doc", "start", "end", "coarse"], "left").select("doc", "start", "end", F.coalesce("fine", "coarse").alias("tag"))


SUMMARY = ["precision", "recall", "f1"]


def summary(gold: DataFrame, runs: DataFrame, pairs: DataFrame) -> DataFrame:
    """One row for each run and part: twelve scores, as precision, recall, F1 and mean F1 over classes, of entities, tokens and tokens whatever their tag.

    gold: (part, doc, start, end, tag); runs: the same with run_id; pairs: (run_id, part, gold, pred) per token, tags or O. Each level is one
    grouped job over all runs and parts.
    """
    names = runs.select("run_id").union(pairs.select("run_id")).distinct()
    keys = ["run_id", "part", *ENTITY]
    every = gold.select("part", *ENTITY).distinct().join(F.broadcast(names.agg(F.collect_set("run_id").alias("r"))).select(F.explode("r").alias("run_id")))
    both = compared(every, runs, keys).groupBy("run_id", "part", "tag").agg(*_counts())
    counts = pairs.groupBy("run_id", "part", "gold", "pred").agg(F.count(F.lit(1)).alias("n"))
    classes = counts.where("gold <> 'O'").select("run_id", "part", F.col("gold").alias("tag")).distinct()
    known = counts.join(classes.union(classes.select("run_id", "part", F.lit("O"))).distinct().withColumnRenamed("tag", "pred"), ["run_id", "part", "pred"], "left_semi")
    sides = known.select("run_id", "part", "n", F.explode(F.array(F.struct(F.col("gold").alias("tag"), F.lit(1).alias("g"), F.lit(0).alias("p"), (F.col("gold") == F.col("pred")).cast("int").alias("t")), F.struct(F.col("pred").alias("tag"), F.lit(0).alias("g"), F.lit(1).alias("p"), F.lit(0).alias("t")))).alias("x"))
    token = sides.where("x.tag <> 'O'").groupBy("run_id", "part", "x.tag").agg(F.sum(F.col("n") * F.col("x.t")).alias("tp"), F.sum(F.col("n") * F.col("x.p")).alias("p"), F.sum(F.col("n") * F.col("x.g")).alias("g"))
    token = token.select("run_id", "part", "tag", "tp", (F.col("p") - F.col("tp")).alias("fp"), (F.col("g") - F.col("tp")).alias("fn"), F.lit(0).cast("long").alias("tn"))
    entity = lambda c: F.col(c) != "O"
    blind = counts.groupBy("run_id", "part").agg(F.lit("ENT").alias("tag"), *(F.coalesce(F.sum(F.when(w, F.col("n"))), F.lit(0)).alias(c) for c, w in (("tp", entity("gold") & entity("pred")), ("fp", ~entity("gold") & entity("pred")), ("fn", entity("gold") & ~entity("pred")), ("tn", ~entity("gold") & ~entity("pred")))))
    out = None
    for level, rows in (("entity", both), ("token", token), ("token_blind", blind)):
        micro = scores(rows.groupBy("run_id", "part").agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn", "tn"))))
        means = scores(rows).groupBy("run_id", "part").agg(F.avg("f1").alias(f"{level}_macro_f1"))
        one = micro.select("run_id", "part", *(F.col(c).alias(f"{level}_{c}") for c in SUMMARY)).join(means, ["run_id", "part"])
        out = one if out is None else out.join(one, ["run_id", "part"], "full_outer")
    columns = [f"{level}_{c}" for level in ("entity", "token", "token_blind") for c in SUMMARY] + [f"{level}_macro_f1" for level in ("entity", "token", "token_blind")]
    return out.select("run_id", "part", *(F.coalesce(c, F.lit(0.0)).alias(c) for c in columns))


def report_lines(rows: DataFrame) -> DataFrame:
    """(class_name, line): scored classes as lines of text of fixed width."""
    line = F.format_string("%-20s\ttp: %-5d - fp: %-5d - fn: %-5d - tn: %-5d - precision: %.4f - recall: %.4f - accuracy: %.4f - f1-score: %.4f", "class_name", "tp", "fp", "fn", "tn", "precision", "recall", "accuracy", "f1")
    return rows.select("class_name", line.alias("line"))


def bio_report(labels: DataFrame) -> DataFrame:
    """(label, precision, recall, f1, support, nth) for BIO labels gold and pred of tokens, in order of tag, then B before I; O doesn't count."""
    sides = labels.groupBy("gold", "pred").agg(F.count(F.lit(1)).alias("n"))
    sides = sides.select("n", F.explode(F.array(F.struct(F.col("gold").alias("label"), F.lit(1).alias("g"), F.lit(0).alias("p")), F.struct(F.col("pred").alias("label"), F.lit(0).alias("g"), F.lit(1).alias("p")))).alias("x"), (F.col("gold") == F.col("pred")).alias("hit"))
    total = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    rows = sides.where("x.label <> 'O'").groupBy("x.label").agg(total(F.col("hit") & (F.col("x.g") == 1)).alias("tp"), total(F.col("x.g") == 1).alias("support"), total(F.col("x.p") == 1).alias("found"))
    rows = rows.withColumns({"precision": F.coalesce(F.try_divide("tp", "found"), F.lit(0.0)), "recall": F.coalesce(F.try_divide("tp", "support"), F.lit(0.0))})
    f1 = F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0))
    order = Window.orderBy(F.expr("substring(label, 2)"), F.expr("left(label, 1)"))  # as many rows as labels
    return rows.select("label", "precision", "recall", f1.alias("f1"), "support", (F.row_number().over(order) - 1).alias("nth"))


def _trials(docs: DataFrame, names: list[str], trials: int, seed: int) -> DataFrame:
    """(trial, sums of names) with the sides of each document swapped by hash from trial 1 on. Each task adds up all trials of its documents: rows as many as tasks times trials.

    A document's swap in a trial is drawn from the md5 of seed, trial and document, as draw(key(..), 2) does; a null document never swaps.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((trials + 1, len(names)), np.int64)
        half = len(names) // 2
        seen = False
        for b in batches:
            rows = np.stack([np.asarray(b.column(1 + k)) for k in range(len(names))], axis=1) if b.num_rows else np.empty((0, len(names)), np.int64)
            for doc, row in zip(b.column(0).to_pylist(), rows, strict=True):
                seen = True
                sums += row
                if doc is not None:
                    swap = np.fromiter((int(hashlib.md5(f"{seed}|{t}|{doc}".encode()).hexdigest()[:15], 16) & 1 for t in range(1, trials + 1)), bool, trials)
                    sums[1:][swap] += np.concatenate([row[half:], row[:half]]) - row
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(trials + 1, dtype=np.int32)), *(pa.array(sums[:, k]) for k in range(len(names)))], ["trial", *names])

    each = docs.select("doc", *(F.col(n).cast("long") for n in names)).mapInArrow(run, ", ".join(["trial int", *(f"{n} long" for n in names)]))
    return each.groupBy("trial").agg(*(F.sum(n).alias(n) for n in names))


def significance(gold: DataFrame, run_a: DataFrame, run_b: DataFrame, trials: int = 9999, seed: int = 42) -> DataFrame:
    """p-values of the difference in micro precision, recall and F1: documents swap sides by hash; counts add up over documents, so each trial is a sum."""
    per = lambda run, side: compared(gold, run).groupBy("doc").agg(*(c.alias(f"{n}_{side}") for c, n in zip(_counts()[:3], ("tp", "fp", "fn"), strict=True)))
    names = [f"{n}_{s}" for s in "ab" for n in ("tp", "fp", "fn")]
    docs = per(run_a, "a").join(per(run_b, "b"), "doc", "full_outer").na.fill(0, names)
    # documents on which the runs agree swap nothing: one row stands for them all
    same = F.expr("tp_a = tp_b and fp_a = fp_b and fn_a = fn_b")
    rest = docs.where(same).agg(F.lit(None).cast("string").alias("doc"), *(F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names))
    docs = docs.where(~same).withColumn("doc", F.col("doc").cast("string")).union(rest)
    sums = _trials(docs, names, trials, seed)
    side = {}
    for s in "ab":
        p, r = ratio(F.col(f"tp_{s}"), F.col(f"tp_{s}") + F.col(f"fp_{s}")), ratio(F.col(f"tp_{s}"), F.col(f"tp_{s}") + F.col(f"fn_{s}"))
        side[s] = {"precision": p, "recall": r, "f1": F.coalesce(F.bround(F.try_divide(2 * p * r, p + r), 4), F.lit(0.0))}
    gaps = sums.select("trial", F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.bround(F.abs(side["a"][m] - side["b"][m]), 6).alias("gap")) for m in ("precision", "recall", "f1")))).alias("x")).select("trial", "x.*")
    seen = gaps.where("trial = 0").select("metric", F.col("gap").alias("observed"))
    out = gaps.where("trial > 0").join(F.broadcast(seen), "metric").groupBy("metric").agg(F.first("observed").alias("observed"), F.count_if(F.col("gap") >= F.col("observed")).alias("as_large"))
    return out.withColumn("p_value", (F.col("as_large") + 1.0) / (trials + 1.0))


def significance_of_pairs(gold: DataFrame, runs: dict[str, DataFrame], pairs: list[tuple[str, str]], trials: int = 9999, seed: int = 42) -> DataFrame:
    """(run_a, run_b, metric, observed, as_large, p_value) for every pair of runs, by name."""
    out = None
    for a, b in pairs:
        rows = significance(gold, runs[a], runs[b], trials, seed).select(F.lit(a).alias("run_a"), F.lit(b).alias("run_b"), "*")
        out = rows if out is None else out.union(rows)
    return out
