"""Commands over standoff folders: python -m veilquery.cli COMMAND .. Paths may lie on any file system that Spark reads."""

from __future__ import annotations

import argparse
import json
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veilquery.operators import corpus, detect, evaluate, generators, labels, rewrite, sequence, tagger, tokens
from veilquery.sources import standoff

TABLE = "doc_id string, ann_id string, text string, start int, end int, tag string, surrogate string, manual_surrogate string, checked boolean"


def _csv(rows: DataFrame, path: str) -> None:
    """One folder of CSV that is never overwritten."""
    rows.coalesce(1).write.mode("errorifexists").csv(path, header=True, quote='"', escape='"')


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).csv(path, header=True, quote='"', escape='"', multiLine=True)


def _labelled(docs: DataFrame, language: str) -> DataFrame:
    """Tokens with sentences and labels from the annotations of docs (doc, text, annotations)."""
    found = tokens.sentences(tokens.tokenize(docs, "doc", language=language))
    spans = docs.select("doc", F.explode("annotations").alias("s")).select("doc", "s.start", "s.end", "s.tag")
    return labels.encode(found, spans)


def gazetteers(spark: SparkSession, folder: str) -> generators.Gazetteers:
    """first_names, last_names, addresses and countries as CSV with headers."""
    countries = [r.value for r in _read(spark, f"{folder}/countries.csv", "id string, value string").collect()]  # the world's
    return generators.Gazetteers(_read(spark, f"{folder}/first_names.csv", "name string, gender string"), _read(spark, f"{folder}/last_names.csv", "prefix string, name string"), _read(spark, f"{folder}/addresses.csv", "postcode string, plaats string, straat string"), countries)


def detect_corpus(spark: SparkSession, a: argparse.Namespace) -> None:
    """Rule tagger over all parts: parquet by part."""
    docs = standoff.corpus(spark, a.corpus)
    detect.annotate(docs.select("part", "doc", "text")).select("part", "doc", F.explode("spans").alias("s")).select("part", "doc", "s.*").write.partitionBy("part").parquet(a.out)


def train(spark: SparkSession, a: argparse.Namespace) -> None:
    docs = standoff.corpus(spark, a.corpus, ("train",))
    rows = sequence.sentences(_labelled(docs, a.language))
    if a.share < 1:
        rows = sequence.fraction(rows, a.share, a.seed)
    model = sequence.fit(sequence.sampled(rows, a.sample, a.seed), a.features, seed=a.seed)
    save_model(spark, model, a.model)


def save_model(spark: SparkSession, model: sequence.Model, path: str) -> None:
    """A model as plain columns: one row for its labels and pairs, one for each feature with its weights."""
    head = [("", 0, list(map(float, model.pairs.ravel())), [*model.labels, model.features])]
    rows = [(name, k + 1, list(map(float, model.weights[k])), []) for name, k in model.rows.items()]
    spark.createDataFrame(head + rows, "feature string, row int, weights array<double>, names array<string>").write.parquet(path)


def load_model(spark: SparkSession, path: str) -> sequence.Model:
    """The model at path; a folder that holds no model raises an error."""
    rows = spark.read.parquet(path)
    if set(rows.columns) != {"feature", "row", "weights", "names"}:
        raise ValueError(f"No model at {path}")
    head, *features = sorted(rows.collect(), key=lambda r: r.row)
    *names, kind = head.names
    weights = np.array([r.weights for r in features], float).reshape(len(features), len(names))
    return sequence.Model(names, {r.feature: k for k, r in enumerate(features)}, weights, np.array(head.weights).reshape(-1, len(names)), kind)


def tag(spark: SparkSession, a: argparse.Namespace) -> None:
    model = load_model(spark, a.model)
    standoff_docs = standoff.corpus(spark, a.corpus)
    found = sequence.annotate(standoff_docs, "doc", model, a.language)
    found.join(standoff_docs.select("part", "doc", "text"), "doc").select("part", "doc", "ann_id", "tag", "start", "end", F.expr("substring(text, start + 1, end - start)").alias("text")).write.partitionBy("part").parquet(a.out)


def trials(spark: SparkSession, a: argparse.Namespace) -> None:
    """Penalty search or learning curve: trained on train, scored on dev."""
    parts = [sequence.sampled(sequence.sentences(_labelled(standoff.corpus(spark, a.corpus, (p,)), a.language)), a.sample, a.seed) for p in ("train", "dev")]
    rows = sequence.search(spark, *parts, a.candidates, a.features, a.seed) if a.command == "search" else sequence.learning_curve(spark, *parts, features=a.features)
    _csv(rows.orderBy("trial"), a.out)


def _pairs(docs: DataFrame, gold: DataFrame, run: DataFrame, language: str) -> DataFrame:
    """(gold, pred) per token."""
    found = tokens.tokenize(docs, "doc", language=language).where(F.trim("text") != "")
    plain = lambda c: F.when(F.col(c) == "O", "O").otherwise(labels.tag_of(F.col(c)))
    a, b = (labels.encode(found, s).select("doc", "i", plain("label").alias(n)) for n, s in (("gold", gold), ("pred", run)))
    return a.join(b, ["doc", "i"])


def evaluate_run(spark: SparkSession, a: argparse.Namespace) -> None:
    """Entity, token and blind scores; texts and both annotation folders must hold the same documents."""
    docs, gold, run = standoff.texts(spark, a.docs), standoff.annotations(spark, a.gold), standoff.annotations(spark, a.pred)
    for folder in (a.gold, a.pred):
        standoff.check_pairs(docs, standoff.documents(spark, folder))
    pairs = _pairs(docs, gold, run, a.language)
    kinds = {"entity": evaluate.entity_level(gold, run), "token": evaluate.token_level(pairs), "blind": evaluate.token_blind(pairs)}
    out = None
    for kind, rows in kinds.items():
        rows = rows.select(F.lit(kind).alias("level"), "class_name", "tp", "fp", "fn", "tn", "precision", "recall", "accuracy", F.col("f1").alias("f1_score"))
        out = rows if out is None else out.union(rows)
    _csv(out.orderBy("level", F.col("class_name") != "overall", "class_name"), a.out)


def significance(spark: SparkSession, a: argparse.Namespace) -> None:
    gold, one, two = (standoff.annotations(spark, p) for p in (a.gold, a.run_a, a.run_b))
    rows = evaluate.significance(gold, one, two, a.trials, a.seed)
    _csv(rows.select(F.lit(a.run_a).alias("run_a"), F.lit(a.run_b).alias("run_b"), "metric", "p_value").orderBy("metric"), a.out)


def surrogates(spark: SparkSession, a: argparse.Namespace) -> None:
    """The table that a person checks; an existing one stays."""
    spans = standoff.annotations(spark, a.dataset)
    made = generators.surrogate_spans(spans, gazetteers(spark, a.gazetteers), a.seed)
    ids = spans.select("doc", "start", "end", "tag", "ann_id")
    rows = made.join(ids, ["doc", "start", "end", "tag"]).dropDuplicates(["doc", "ann_id"])
    rows = rows.select(F.col("doc").alias("doc_id"), "ann_id", "text", "start", "end", "tag", "surrogate", F.lit(None).cast("string").alias("manual_surrogate"), F.lit(False).alias("checked"))
    _csv(rows.orderBy("doc_id", "start"), a.out)


def rewrite_dataset(spark: SparkSession, a: argparse.Namespace) -> None:
    """Texts with the surrogates of the table, by hand before drawn ones; documents without annotations are passed on."""
    table = rewrite.manual_first(_read(spark, a.table, TABLE)).select(F.col("doc_id").alias("doc"), "start", "end", "tag", "text", "surrogate", "ann_id")
    per = table.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("start", "end", "tag", "text", "surrogate", "ann_id"))).alias("spans"))
    none = F.expr("cast(array() as array<struct<start:int,end:int,tag:string,text:string,surrogate:string,ann_id:string>>)")
    docs = standoff.texts(spark, a.data).join(per, "doc", "left").withColumn("spans", F.coalesce("spans", none))
    done = rewrite.apply_surrogates(docs, a.errors)
    chosen = lambda s: F.when(F.coalesce(s["surrogate"], F.lit("")) != "", s["surrogate"]).otherwise(F.concat(F.lit("["), s["tag"], F.lit("]")) if a.errors == "coerce" else s["text"])
    moved = rewrite.moved(F.col("spans"), chosen)
    spans = F.transform(F.arrays_zip(moved.alias("m"), F.col("spans").alias("s")), lambda z: F.struct(z["m"]["start"].cast("int").alias("start"), z["m"]["end"].cast("int").alias("end"), z["m"]["tag"].alias("tag"), z["m"]["text"].alias("text"), z["s"]["ann_id"].alias("ann_id")))
    standoff.write(done.select("doc", F.col("rewritten").alias("text"), spans.alias("annotations")), a.out)


def split(spark: SparkSession, a: argparse.Namespace) -> None:
    """train, dev and test folders from one folder: 60, 20 and 20 of 100."""
    spans = standoff.annotations(spark, a.path).groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("start", "end", "tag", "text", "ann_id"))).alias("annotations"))
    docs = standoff.texts(spark, a.path).join(spans, "doc", "left")
    parts = corpus.split(docs.select("doc"), "doc", a.seed)
    for part in ("train", "dev", "test"):
        standoff.write(docs.join(parts.where(F.col("part") == part), "doc", "left_semi"), f"{a.out}/{part}")


def convert(spark: SparkSession, a: argparse.Namespace) -> None:
    """XML documents to standoff files."""
    standoff.write(standoff.xml(spark, a.path), a.out)


def statistics(spark: SparkSession, a: argparse.Namespace) -> None:
    docs = standoff.corpus(spark, a.corpus)
    spans = docs.select("part", "doc", F.explode("annotations").alias("s")).select("part", "doc", "s.*")
    _csv(corpus.by_part(spans.drop("part"), docs.select("doc", "part"), "doc").orderBy(F.desc("train"), "tag"), f"{a.out}/phi_distribution")
    found = tokens.tokenize(docs, "doc", language=a.language)
    _csv(corpus.statistics(found).orderBy("measure"), f"{a.out}/statistics")
    terms = corpus.terms(found)
    _csv(terms.orderBy(F.desc("tf"), "term").limit(20), f"{a.out}/most_common")
    _csv(terms.orderBy("tf", "term").limit(10), f"{a.out}/least_common")


def tag_by_rules(spark: SparkSession, a: argparse.Namespace) -> None:
    """Dutch rule tagger over all parts, with the corpus' tags; phrases (tag, phrase as CSV) of institutions or places if given."""
    docs = standoff.corpus(spark, a.corpus).select("part", "doc", "text")
    found = tagger.annotate(docs)
    found = found.select("part", "doc", "text", tagger.rewritten(F.col("spans"), F.col("text")).alias("spans"))
    if a.phrases:
        per = tagger.dictionary(docs, _read(spark, a.phrases, "tag string, phrase string"), "doc").groupBy("doc").agg(F.collect_list(F.struct("start", "end", "tag", "text")).alias("more"))
        free = lambda s: ~F.exists("spans", lambda o: (o["start"] < s["end"]) & (s["start"] < o["end"]))
        found = found.join(per, "doc", "left").withColumn("spans", F.array_sort(F.concat("spans", F.filter(F.coalesce("more", F.expr("cast(array() as array<struct<start:int,end:int,tag:string,text:string>>)")), free))))
    number = lambda s, i: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["tag"].alias("tag"), s["text"].alias("text"), F.concat(F.lit("T"), i).alias("ann_id"))
    found = found.select("part", "doc", "text", F.transform("spans", number).alias("annotations"))
    for part in ("train", "dev", "test"):
        standoff.write(found.where(F.col("part") == part).drop("part"), f"{a.out}/{part}")


def evaluate_corpus(spark: SparkSession, a: argparse.Namespace) -> None:
    """summary_{part}: twelve scores of each run, a folder of predictions with train, dev and test, sorted by run; all runs and parts in one job."""
    docs = standoff.corpus(spark, a.corpus)
    runs = {path.rstrip("/").split("/")[-1]: path for path in a.runs.split(",")}
    found = {name: standoff.corpus(spark, path).select("part", "doc", F.explode("annotations").alias("s")).select("part", "doc", "s.*") for name, path in runs.items()}
    gold = docs.select("part", "doc", F.explode("annotations").alias("s")).select("part", *("doc" if c == "doc" else f"s.{c}" for c in evaluate.ENTITY))
    rows = pairs = None
    for name, spans in found.items():
        per = spans.groupBy("doc").agg(F.collect_list(F.struct("start", "end", "tag")).alias("run"))
        both = tokens.labelled(docs.join(per, "doc", "left"), "doc", {"gold": "annotations", "pred": "run"}, language=a.language).where(F.trim("text") != "")
        plain = lambda c: F.when(F.col(c) == "O", "O").otherwise(labels.tag_of(F.col(c))).alias(c)
        one = both.join(docs.select("doc", "part"), "doc").select(F.lit(name).alias("run_id"), "part", plain("gold"), plain("pred"))
        pairs = one if pairs is None else pairs.union(one)
        mine = spans.select(F.lit(name).alias("run_id"), "part", *evaluate.ENTITY)
        rows = mine if rows is None else rows.union(mine)
    out = evaluate.summary(gold, rows, pairs)
    for part in ("train", "dev", "test"):
        _csv(out.where(F.col("part") == part).drop("part").orderBy("run_id"), f"{a.out}/summary_{part}")


def significance_by_config(spark: SparkSession, a: argparse.Namespace) -> None:
    """All pairs of a config: JSON with gold, a folder, and runs, a list of {run_a, run_b} folders."""
    c = json.loads(spark.read.text(a.config, wholetext=True).first().value)
    pairs = [(r["run_a"], r["run_b"]) for r in c["runs"]]
    runs = {p: standoff.annotations(spark, p) for pair in pairs for p in pair}
    out = evaluate.significance_of_pairs(standoff.annotations(spark, c["gold"]), runs, pairs, a.trials, a.seed)
    _csv(out.select("run_a", "run_b", "metric", "p_value").orderBy("run_a", "run_b", "metric"), a.out)


def convert_notes(spark: SparkSession, a: argparse.Namespace) -> None:
    """Nursing notes and their phrases to standoff files; notes without phrases have no annotations."""
    standoff.write(standoff.with_annotations(standoff.notes(spark, a.notes), standoff.phrases(spark, a.phrases)), a.out)


def hold_out(spark: SparkSession, a: argparse.Namespace) -> None:
    """XML documents to train and dev folders, a share (rounded up) to dev, and those of the test folder to test."""
    docs = standoff.xml(spark, a.train)
    parts = corpus.holdout(docs.select("doc"), "doc", a.share, a.seed)
    for part in ("train", "dev"):
        standoff.write(docs.join(parts.where(F.col("part") == part), "doc", "left_semi"), f"{a.out}/{part}")
    standoff.write(standoff.xml(spark, a.test), f"{a.out}/test")


def _tag_names(spark: SparkSession, path: str) -> dict[str, str]:
    return {r.fine: r.coarse for r in _read(spark, path, "fine string, coarse string").collect()}  # a row for each tag


def flatten(spark: SparkSession, a: argparse.Namespace) -> None:
    """Annotations with coarse tags for fine ones (CSV fine, coarse); other tags stay."""
    names = _tag_names(spark, a.tags)
    table = F.create_map(*(F.lit(x) for kv in names.items() for x in kv))
    docs = standoff.with_annotations(standoff.texts(spark, a.data), standoff.annotations(spark, a.data))
    standoff.write(docs.withColumn("annotations", F.transform("annotations", lambda s: s.withField("tag", F.coalesce(table[s["tag"]], s["tag"])))), a.out)


def unflatten(spark: SparkSession, a: argparse.Namespace) -> None:
    """Coarse predictions with the fine tags of gold annotations at the same place whose coarse tag is theirs."""
    found = evaluate.unflatten(standoff.annotations(spark, a.pred), standoff.annotations(spark, a.gold), _tag_names(spark, a.tags))
    texts = standoff.texts(spark, a.pred)
    spans = found.join(texts, "doc").select("doc", "start", "end", "tag", F.expr("substring(text, start + 1, end - start)").alias("text"))
    number = F.row_number().over(Window.partitionBy("doc").orderBy("start", "end"))
    standoff.write(standoff.with_annotations(texts, spans.withColumn("ann_id", F.concat(F.lit("T"), number))), a.out)


#: Command, function, arguments, and options with their defaults.
COMMANDS: dict[str, tuple[Callable, list[str], dict]] = {
    "detect": (detect_corpus, ["corpus", "out"], {}),
    "train": (train, ["corpus", "model"], {"features": "wide", "language": "plain", "sample": 5000, "share": 1.0, "seed": 42}),
    "tag": (tag, ["corpus", "model", "out"], {"language": "plain"}),
    "search": (trials, ["corpus", "out"], {"features": "wide", "language": "plain", "sample": 5000, "candidates": 250, "seed": 42}),
    "learning-curve": (trials, ["corpus", "out"], {"features": "wide", "language": "plain", "sample": 5000, "seed": 42}),
    "evaluate": (evaluate_run, ["docs", "gold", "pred", "out"], {"language": "plain"}),
    "significance": (significance, ["gold", "run_a", "run_b", "out"], {"trials": 9999, "seed": 42}),
    "surrogates": (surrogates, ["dataset", "gazetteers", "out"], {"seed": 42}),
    "rewrite": (rewrite_dataset, ["table", "data", "out"], {"errors": "raise"}),
    "split": (split, ["path", "out"], {"seed": 42}),
    "tag-rules": (tag_by_rules, ["corpus", "out"], {"phrases": ""}),
    "evaluate-corpus": (evaluate_corpus, ["corpus", "runs", "out"], {"language": "plain"}),
    "significance-config": (significance_by_config, ["config", "out"], {"trials": 9999, "seed": 42}),
    "convert-notes": (convert_notes, ["notes", "phrases", "out"], {}),
    "hold-out": (hold_out, ["train", "test", "out"], {"share": 0.2, "seed": 42}),
    "flatten": (flatten, ["data", "tags", "out"], {}),
    "unflatten": (unflatten, ["pred", "gold", "tags", "out"], {}),
    "convert-xml": (convert, ["path", "out"], {}),
    "statistics": (statistics, ["corpus", "out"], {"language": "plain"}),
}


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    parser = argparse.ArgumentParser(prog="veilquery", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    for name, (run, arguments, options) in COMMANDS.items():
        one = commands.add_parser(name, help=run.__doc__)
        for x in arguments:
            one.add_argument(x)
        for x, default in options.items():
            one.add_argument(f"--{x}", type=type(default), default=default)
    a = parser.parse_args(argv)
    COMMANDS[a.command][0](spark or SparkSession.builder.appName("veilquery").getOrCreate(), a)


if __name__ == "__main__":
    main()
