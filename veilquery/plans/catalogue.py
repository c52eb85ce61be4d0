"""The registered queries: each applies an operator to the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilquery.functions.draws import draw, key
from veilquery.operators import corpus, dates, detect, evaluate, generators, labels, locations, markup, names, plug, rewrite, sequence, surrogates, tagger, tokens

SEED = 42


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text", "lang")


def gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.spans(documents(spark, sf_dir), "doc_id")


def predicted_spans(spans: Column, doc: Column, salt: str = "run") -> Column:
    """predicted() for arrays of spans."""
    kind = lambda s: draw(key(salt, doc, s["start"]), 8)
    changed = lambda s: F.struct(s["start"].alias("start"), F.when(kind(s) == 1, s["end"] + 1).otherwise(s["end"]).alias("end"), F.when(kind(s) == 2, "ID").otherwise(s["tag"]).alias("tag"))
    return F.transform(F.filter(spans, lambda s: kind(s) != 0), changed)


def predicted(spans: DataFrame, salt: str = "run") -> DataFrame:
    """A run to evaluate: of the spans a drawn part is dropped, one is longer, one has another tag."""
    kind = draw(key(salt, F.col("doc"), F.col("start")), 8)
    rows = spans.withColumn("kind", kind).where("kind <> 0")
    return rows.select("doc", "start", F.when(F.col("kind") == 1, F.col("end") + 1).otherwise(F.col("end")).alias("end"), F.when(F.col("kind") == 2, "ID").otherwise(F.col("tag")).alias("tag"), "text")


def detection(tag: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        rules = [r for r in detect.RULES if r[0] == tag]
        return detect.spans(documents(spark, sf_dir), "doc_id", rules=rules).select(F.col("doc").alias("doc_id"), "start", "end", "tag", "text")

    return query


def detect_all(spark, sf_dir):
    return gold(spark, sf_dir).select(F.col("doc").alias("doc_id"), "start", "end", "tag", "text")


def mask_documents(spark, sf_dir):
    return rewrite.mask(detect.annotate(documents(spark, sf_dir))).select("doc_id", "masked_text", F.size("spans").alias("n_spans"))


def mask_conversations(spark, sf_dir):
    rows = detect.annotate(table(spark, sf_dir, "conversations").select("conv_id", "turn", "text"))
    return rewrite.mask(rows).select("conv_id", "turn", "masked_text")


def mask_custom_formatter(spark, sf_dir):
    formatter = lambda s: F.concat(F.lit("<"), s["tag"], F.lit(":"), F.length(s["text"]).cast("string"), F.lit(">"))
    return rewrite.mask(detect.annotate(documents(spark, sf_dir)), formatter=formatter).select("doc_id", "masked_text")


def masked_spans(spark, sf_dir):
    rows = rewrite.mask(detect.annotate(documents(spark, sf_dir)))
    return rows.select("doc_id", "masked_text", F.explode("masked_spans").alias("s")).select("doc_id", F.col("s.start").alias("start"), F.col("s.end").alias("end"), "s.tag", F.expr("substring(masked_text, s.start + 1, s.end - s.start)").alias("text"))


def phi_distribution(spark, sf_dir):
    return corpus.distribution(gold(spark, sf_dir))


def corpus_split(spark, sf_dir):
    return corpus.split(documents(spark, sf_dir), "doc_id", SEED)


def phi_by_part_pivot(spark, sf_dir):
    return corpus.by_part(gold(spark, sf_dir), corpus_split(spark, sf_dir), "doc_id")


def tokenize(spark, sf_dir):
    return tokens.tokenize(documents(spark, sf_dir), "doc_id").select(F.col("doc").alias("doc_id"), "i", "start", "end", "text")


def sentence_segments(spark, sf_dir):
    rows = tokens.sentences(tokens.tokenize(documents(spark, sf_dir), "doc_id"))
    return rows.groupBy(F.col("doc").alias("doc_id"), "sent_id").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count(F.lit(1)).alias("n_tokens"))


def word_shapes(spark, sf_dir):
    words = corpus.counted(tokens.tokenize(documents(spark, sf_dir), "doc_id"))
    return words.select(tokens.shape(F.col("text")).alias("shape")).groupBy("shape").agg(F.count(F.lit(1)).alias("n"))


def token_context(spark, sf_dir):
    rows = tokens.context(tokens.sentences(tokens.tokenize(documents(spark, sf_dir), "doc_id")))
    names = {"w-2": "before2", "w-1": "before", "w0": "token", "w+1": "after", "w+2": "after2"}
    return rows.groupBy(*(F.col(c).alias(n) for c, n in names.items())).agg(F.count(F.lit(1)).alias("n"))


def token_features(spark, sf_dir):
    rows = tokens.sentence_features(tokens.sentences(tokens.tokenize(documents(spark, sf_dir), "doc_id")))
    return rows.groupBy("sent_length", "sent_end", "unmatched_bracket").agg(F.count(F.lit(1)).alias("n"))


def orthographic_flags(spark, sf_dir):
    words = corpus.counted(tokens.tokenize(documents(spark, sf_dir), "doc_id"))
    return tokens.flags(words).groupBy("is_upper", "is_title", "is_digit", "has_digit", "prefix1", "suffix3").agg(F.count(F.lit(1)).alias("n"))


def term_frequency(spark, sf_dir):
    return corpus.terms(tokens.tokenize(documents(spark, sf_dir), "doc_id"))


def vocabulary_size(spark, sf_dir):
    return corpus.vocabulary(tokens.tokenize(documents(spark, sf_dir), "doc_id"))


def corpus_stats(spark, sf_dir):
    return corpus.statistics(tokens.tokenize(documents(spark, sf_dir), "doc_id"))


def encoded(spark, sf_dir, cut=False):
    return tokens.labelled(detect.annotate(documents(spark, sf_dir)), "doc_id", {"label": "spans"}, cut=cut)


def bio_encode(spark, sf_dir):
    return encoded(spark, sf_dir).select(F.col("doc").alias("doc_id"), "i", "start", "end", "label")


def bio_to_biluo(spark, sf_dir):
    return labels.to_biluo(encoded(spark, sf_dir)).select(F.col("doc").alias("doc_id"), "i", "biluo", labels.from_biluo(F.col("biluo")).alias("bio"))


def dangling(spark, sf_dir):
    rows = encoded(spark, sf_dir)
    return rows.withColumn("label", F.when(F.col("label").startswith("B-") & (F.pmod(F.col("start"), F.lit(2)) == 0), F.concat(F.lit("I-"), labels.tag_of(F.col("label")))).otherwise(F.col("label")))


def fix_dangling(spark, sf_dir):
    return labels.repair(dangling(spark, sf_dir)).select(F.col("doc").alias("doc_id"), "i", "label", "fixed")


def label_violations(spark, sf_dir):
    return labels.violations(dangling(spark, sf_dir)).select(F.col("doc").alias("doc_id"), "i", "label")


def bio_to_spans(spark, sf_dir):
    """Spans through labels and back; tokens are cut at their edges, so that none is lost."""
    return labels.to_spans(encoded(spark, sf_dir, cut=True)).select(F.col("doc").alias("doc_id"), "ann_id", "start", "end", "tag")


def entity_metrics(spark, sf_dir):
    g = gold(spark, sf_dir)
    return evaluate.entity_level(g, predicted(g))


def macro_metrics(spark, sf_dir):
    return evaluate.macro(entity_metrics(spark, sf_dir))


def token_labels(spark, sf_dir):
    docs = detect.annotate(documents(spark, sf_dir)).withColumn("run", predicted_spans(F.col("spans"), F.col("doc_id")))
    tag = lambda c: F.when(F.col(c) == "O", "O").otherwise(labels.tag_of(F.col(c))).alias(c)
    return tokens.labelled(docs, "doc_id", {"gold": "spans", "pred": "run"}).select("doc", "i", tag("gold"), tag("pred"))


def token_metrics(spark, sf_dir):
    return evaluate.token_level(token_labels(spark, sf_dir))


def token_blind_metrics(spark, sf_dir):
    return evaluate.token_blind(token_labels(spark, sf_dir))


def annotator_agreement(spark, sf_dir):
    g = gold(spark, sf_dir)
    return evaluate.agreement(predicted(g, "a"), predicted(g, "b"))


FLAT = {"Email": "URL_IP", "Phone_fax": "Contact"}


def unflatten_tags(spark, sf_dir):
    g = gold(spark, sf_dir)
    flat = F.create_map(*(F.lit(x) for kv in FLAT.items() for x in kv))
    return evaluate.unflatten(predicted(g).withColumn("tag", F.coalesce(flat[F.col("tag")], F.col("tag"))).drop("text"), g, FLAT).withColumnRenamed("doc", "doc_id")


def run_summary(spark, sf_dir):
    g = gold(spark, sf_dir)
    parts = corpus_split(spark, sf_dir).withColumnRenamed("doc_id", "doc")
    runs = predicted(g, "a").withColumn("run_id", F.lit("a")).union(predicted(g, "b").withColumn("run_id", F.lit("b")))
    both = g.crossJoin(F.broadcast(spark.createDataFrame([("a",), ("b",)], "run_id string")))
    rows = evaluate.compared(both, runs, ["run_id", *evaluate.ENTITY]).join(parts, "doc").groupBy("part", "run_id").agg(*evaluate._counts())
    return evaluate.scores(rows).drop("tn")


def significance_test(spark, sf_dir):
    g = gold(spark, sf_dir)
    return evaluate.significance(g, predicted(g, "a"), predicted(g, "b"), seed=SEED)


def surrogated(spark, sf_dir):
    return surrogates.with_surrogates(detect.annotate(documents(spark, sf_dir)), "doc_id", SEED)


def span_surrogates(spark, sf_dir):
    return surrogated(spark, sf_dir).select("doc_id", F.explode("spans").alias("s")).select("doc_id", F.col("s.start").alias("start"), "s.tag", "s.text", "s.surrogate")


def surrogate_id(spark, sf_dir):
    k = key(SEED, F.col("c_custkey"), F.lit("ID"), F.col("c_name"))
    return table(spark, sf_dir, "customer").select("c_custkey", surrogates.identifier(F.col("c_name"), k).alias("surrogate"))


def surrogate_email(spark, sf_dir):
    return span_surrogates(spark, sf_dir).where("tag = 'Email'").select("doc_id", "start", "surrogate")


def surrogate_url(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", surrogates.url(F.col("url"), key(SEED, F.col("page_id"), F.lit("URL_IP"), F.col("url"))).alias("surrogate"))


def surrogate_age(spark, sf_dir):
    text = F.concat(F.lit("aged "), F.col("l_partkey").cast("string"), F.lit(" or "), F.col("l_quantity").cast("int").cast("string"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", surrogates.age(text).alias("surrogate"))


def surrogate_initials(spark, sf_dir):
    name = F.concat(F.substring("c_name", 1, 1), F.lit("."), F.upper(F.substring("c_mktsegment", 1, 1)), F.lit("."), F.lower(F.substring("c_mktsegment", 2, 2)))
    return table(spark, sf_dir, "customer").select("c_custkey", surrogates.initials(name, key(SEED, F.col("c_custkey"), F.lit("letters"))).alias("surrogate"))


def surrogate_phone(spark, sf_dir):
    number = F.concat(F.lit("+31 "), F.get(F.array(*map(F.lit, ("6", "20", "113"))), F.pmod("c_custkey", F.lit(3)).cast("int")), F.lit("-"), F.lpad(F.col("c_custkey").cast("string"), 8, "7"))
    return table(spark, sf_dir, "customer").select("c_custkey", number.alias("number"), surrogates.phone(number, key(SEED, F.col("c_custkey"), F.lit("Phone_fax"), number)).alias("surrogate"))


def surrogate_zip(spark, sf_dir):
    code = F.concat(F.lpad(F.pmod("c_custkey", F.lit(10000)).cast("string"), 4, "1"), F.when(F.pmod("c_custkey", F.lit(2)) == 0, " ").otherwise(""), F.lit("AB"))
    return table(spark, sf_dir, "customer").select("c_custkey", surrogates.zip_code(code, F.lit("3512 JE")).alias("surrogate"))


def surrogate_date(spark, sf_dir):
    days = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("d"))
    own = days.groupBy("o_custkey").agg(F.max("d").alias("recent"), F.min(surrogates.season_offsets(F.col("d"))["past"]).alias("past"), F.min(surrogates.season_offsets(F.col("d"))["left"]).alias("left"))
    years, shift = surrogates.shift_draws(F.col("o_custkey"), SEED, F.col("past"), F.col("left"))
    rows = days.join(own, "o_custkey")
    return rows.select("o_orderkey", surrogates.shift_date(surrogates.within_span(F.col("d"), F.col("recent")), years, shift).alias("surrogate"))


def corpus_shuffle(spark, sf_dir):
    return surrogates.corpus_shuffle(gold(spark, sf_dir).select("doc", "tag", "text"), SEED).withColumnRenamed("doc", "doc_id")


def surrogate_documents(spark, sf_dir):
    return rewrite.apply_surrogates(surrogated(spark, sf_dir), "coerce").select("doc_id", "rewritten")


def errors_ignore(spark, sf_dir):
    return rewrite.apply_surrogates(surrogated(spark, sf_dir), "ignore").select("doc_id", "rewritten")


def failed_replacements(spark, sf_dir):
    return rewrite.apply_surrogates(surrogated(spark, sf_dir), "ignore").select("doc_id", F.explode("failed").alias("s")).select("doc_id", F.col("s.start").alias("start"), "s.tag", "s.text")


def rewrite_table(spark, sf_dir):
    return rewrite.rewrite_table(surrogated(spark, sf_dir), "doc_id")


def manual_override(spark, sf_dir):
    rows = rewrite_table(spark, sf_dir).withColumn("manual_surrogate", F.when(F.col("start") % 3 == 0, F.concat(F.lit("manual "), "ann_id")))
    return rewrite.manual_first(rows).select("doc_id", "ann_id", "surrogate")


def documents_without_annotations(spark, sf_dir):
    docs = documents(spark, sf_dir)
    return docs.join(gold(spark, sf_dir).select(F.col("doc").alias("doc_id")).distinct(), "doc_id", "left_anti").select("doc_id", F.length("text").alias("n_chars"))


def documents_by_language(spark, sf_dir):
    rows = documents(spark, sf_dir).join(gold(spark, sf_dir).withColumnRenamed("doc", "doc_id"), "doc_id", "left")
    return rows.groupBy("lang").agg(F.countDistinct("doc_id").alias("n_docs"), F.count("tag").alias("n_spans"))


def date_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order dates spelled in six layouts, by customer."""
    day = F.to_date("o_orderdate")
    month = lambda lang: F.get(F.split(F.lit(dates.NAMES[lang]["B"]), " "), F.month(day) - 1)
    weekday = F.get(F.split(F.lit(dates.NAMES["de"]["A"]), " "), F.weekday(day))
    two = F.date_format(day, "dd")
    year = F.date_format(day, "yyyy")
    spelled = [F.date_format(day, "dd-MM-yyyy"), F.date_format(day, "yyyy-MM-dd"), F.concat_ws(" ", two, month("nl"), year), F.concat(month("en"), F.lit(" "), two, F.lit(", "), year), F.concat_ws(" ", weekday, two, month("de"), year), F.date_format(day, "dd/MM/yy")]
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc"), F.col("o_orderkey").cast("int").alias("start"), F.get(F.array(*spelled), F.pmod("o_orderkey", F.lit(6)).cast("int")).alias("text"))


def parse_dates(spark, sf_dir):
    return dates.parsed(date_texts(spark, sf_dir)).select(F.col("start").alias("o_orderkey"), "text", "date", "has_year")


def surrogate_date_texts(spark, sf_dir):
    rows = dates.surrogates(date_texts(spark, sf_dir), shift=(F.lit(12), F.lit(-5)))
    return rows.select(F.col("start").alias("o_orderkey"), "text", "surrogate")


def surrogate_dates_drawn(spark, sf_dir):
    return dates.surrogates(date_texts(spark, sf_dir), SEED).select(F.col("start").alias("o_orderkey"), "text", "surrogate")


def person_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names made of a customer's number and segment, in four forms."""
    k = F.col("c_custkey")
    of = lambda values, n: F.get(F.array(*map(F.lit, values)), F.pmod(F.floor(k / n), F.lit(len(values))).cast("int"))
    first, middle, last = of(FIRST, 7), of(("F.A.", "Maria", "Jan Piet"), 3), of(LAST, 5)
    forms = [F.concat_ws(" ", first, last), F.concat_ws(" ", F.lit("Dhr."), first, middle, last), F.concat(last, F.lit(", "), first), F.concat(F.lit("Dr. "), first, F.lit(" "), last, F.lit(", Ph.D."))]
    return table(spark, sf_dir, "customer").select(k.alias("doc"), F.get(F.array(*forms), F.pmod(k, F.lit(4)).cast("int")).alias("text"))


FIRST, LAST = ("Lucas", "Annemarie", "Özlem", "J."), ("de Groot", "Janssen", "van der Linden", "'t Hart", "Bakker")
COUNTRIES = ["Nederland", "Oostenrijk", "Duitsland"]


def small_gazetteers(spark: SparkSession) -> generators.Gazetteers:
    """An invented name for each letter, and a few addresses."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    first = spark.createDataFrame([(c.upper() + end, g) for c in letters for g, end in (("m", "aro"), ("f", "ilia"), ("f", "enne"))] + [("Lucas", "m")], "name string, gender string")
    last = spark.createDataFrame([(p, c.upper() + end) for c in letters for p, end in (("", "erman"), ("van", "oost"))], "prefix string, name string")
    places = spark.createDataFrame([(f"{1000 + 7 * i}{'ABCDEFGH'[i]}{'KLMNPRST'[i]}", f"Dorp{'abcdefgh'[i]}", f"{'ABCDEFGH'[i]}laan") for i in range(8)], "postcode string, plaats string, straat string")
    return generators.Gazetteers(first, last, places, COUNTRIES)


def parse_names(spark, sf_dir):
    p = names.parse(F.col("text"))
    return person_names(spark, sf_dir).select(F.col("doc").alias("c_custkey"), "text", p.alias("p")).select("c_custkey", "text", F.trim("p.title").alias("title"), "p.first", "p.middle", "p.last", "p.suffix")


def surrogate_names(spark, sf_dir):
    g = small_gazetteers(spark)
    return names.surrogates(person_names(spark, sf_dir), g.first_names, g.last_names, SEED).withColumnRenamed("doc", "c_custkey")


def addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses made of a supplier's number, in four forms."""
    k = F.col("s_suppkey")
    number, code = k.cast("string"), F.concat(F.lpad(F.pmod(k, F.lit(9000)).cast("string"), 4, "1"), F.lit(" AB"))
    forms = [F.concat(F.lit("Parallelweg "), number, F.lit(", "), code, F.lit(" Groenlo")), F.concat(F.lit("Waterkant "), number, F.lit("-2, Arnhem-Zuid")), F.lit("De singel te Haarlem Nederland"), F.lit("Groenlo (Duitsland)")]
    return table(spark, sf_dir, "supplier").select(k.alias("doc"), F.get(F.array(*forms), F.pmod(k, F.lit(4)).cast("int")).alias("text"))


def parse_locations(spark, sf_dir):
    return addresses(spark, sf_dir).select(F.col("doc").alias("s_suppkey"), "text", locations.parse(F.col("text"), COUNTRIES).alias("p")).select("s_suppkey", "text", "p.*")


def surrogate_locations(spark, sf_dir):
    return locations.surrogates(addresses(spark, sf_dir), small_gazetteers(spark).addresses, COUNTRIES, SEED).withColumnRenamed("doc", "s_suppkey")


def surrogate_corpus(spark, sf_dir):
    return generators.surrogate_spans(gold(spark, sf_dir), small_gazetteers(spark), SEED).withColumnRenamed("doc", "doc_id")


def crf_predictions(spark, sf_dir):
    """A CRF learnt from the train part tags the test part."""
    parts = corpus_split(spark, sf_dir)
    learnt = documents(spark, sf_dir).join(parts.where("part = 'train'"), "doc_id", "left_semi")
    model = sequence.fit(sequence.drawn(detect.annotate(learnt), "doc_id", "spans", 2000, SEED), seed=SEED)
    held = documents(spark, sf_dir).join(parts.where("part = 'test'"), "doc_id", "left_semi")
    return sequence.annotate(held, "doc_id", model).withColumnRenamed("doc", "doc_id")


def training_fraction(spark, sf_dir):
    rows = tokens.sentences(encoded(spark, sf_dir))
    return sequence.fraction(sequence.sentences(rows), 0.25, SEED).agg(F.count(F.lit(1)).alias("n_sentences"))


def rule_tags(spark, sf_dir):
    """Spans of the Dutch rule tagger in all documents."""
    return tagger.annotate(documents(spark, sf_dir)).select("doc_id", F.explode("spans").alias("s")).select("doc_id", "s.*")


def rule_tags_rewritten(spark, sf_dir):
    """Spans as a rule tagger gives them, made of a customer's number, with the corpus' tags, without metadata numbers and prefixes."""
    k = F.col("c_custkey").cast("string")
    number = F.lpad(k, 7, "1")
    text = F.concat(F.lit("=== Report: "), number, F.lit(" === Dhr. Jansen"), k, F.lit(", mevr., nr "), number)
    at = lambda start, end, tag: F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"), F.lit(tag).alias("tag"), F.substring(text, start + 1, end - start).alias("text"))
    name_end = F.lit(35) + F.length(k)
    rows = table(spark, sf_dir, "customer").select("c_custkey", text.alias("text"), F.array(at(F.lit(12), F.lit(19), "PATIENTNUMMER"), at(F.lit(24), name_end, "PERSOON"), at(name_end + 2, name_end + 7, "PERSOON"), at(name_end + 12, name_end + 19, "PATIENTNUMMER")).alias("spans"))
    return rows.select("c_custkey", F.explode(tagger.rewritten(F.col("spans"), F.col("text"))).alias("s")).select("c_custkey", "s.*")


PHRASES = [("A", "the of"), ("A", "of the"), ("B", "of the in"), ("C", "de la"), ("D", "der die"), ("B", "Of The")]


def dictionary_spans(spark, sf_dir):
    phrases = spark.createDataFrame(PHRASES, "tag string, phrase string")
    return tagger.dictionary(documents(spark, sf_dir), phrases, "doc_id", longest=3).withColumnRenamed("doc", "doc_id")


def inline_markup(spark, sf_dir):
    marked = F.concat(F.lit("Naam <PERSOON "), F.col("c_name"), F.lit(" <LOCATIE "), F.col("c_mktsegment"), F.lit(">> is < 9, nr <ID "), F.col("c_custkey").cast("string"), F.lit(">."))
    rows = markup.unmark(table(spark, sf_dir, "customer").select("c_custkey", marked.alias("marked")))
    return rows.select("c_custkey", F.col("text").alias("plain"), F.explode("spans").alias("s")).select("c_custkey", "plain", "s.*")


def load_email_tagger():
    import re

    find = re.compile(detect.RULES[0][1]).finditer
    return lambda texts: [[(m.start(), m.end(), "Email") for m in find(t)] for t in texts]


def plugged_tagger(spark, sf_dir):
    """A tagger from outside, here a pattern, run through the plug point."""
    rows = plug.annotate(documents(spark, sf_dir), load_email_tagger, ["Email"])
    return rows.select("doc_id", F.explode("spans").alias("s")).select("doc_id", "s.*")


def merged_sentences(spark, sf_dir):
    """Sentences with dangling labels, merged where one starts inside an entity."""
    rows = labels.sentences_merged(tokens.sentences(dangling(spark, sf_dir)))
    return rows.groupBy(F.col("doc").alias("doc_id"), "sent_id").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count(F.lit(1)).alias("n_tokens"))


def space_tokens(spark, sf_dir):
    rows = tokens.tokenize(documents(spark, sf_dir), "doc_id").withColumn("label", F.concat(F.lit("B-"), F.length("text").cast("string")))
    rows = tokens.space_forced(rows.withColumn("text", tokens.space_renamed(F.col("text"))))
    return rows.where("text = '<SPACE>'").groupBy(F.col("doc").alias("doc_id"), "text", "label").agg(F.count(F.lit(1)).alias("n"))


def escaped_blanks(spark, sf_dir):
    rows = tokens.tokenize(documents(spark, sf_dir), "doc_id")
    return rows.select(tokens.escaped(F.col("text")).alias("escaped")).groupBy("escaped").agg(F.count(F.lit(1)).alias("n"))


def development_holdout(spark, sf_dir):
    return corpus.holdout(documents(spark, sf_dir), "doc_id", seed=SEED)


def predefined_folds(spark, sf_dir):
    parts = corpus_split(spark, sf_dir)
    return corpus.predefined_fold(parts.where("part = 'train'"), parts.where("part = 'dev'"))


def bio_report(spark, sf_dir):
    docs = detect.annotate(documents(spark, sf_dir)).withColumn("run", predicted_spans(F.col("spans"), F.col("doc_id")))
    return evaluate.bio_report(tokens.labelled(docs, "doc_id", {"gold": "spans", "pred": "run"}))


def metric_lines(spark, sf_dir):
    return evaluate.report_lines(entity_metrics(spark, sf_dir))


def corpus_summary(spark, sf_dir):
    """Twelve scores of two runs by part."""
    parts = corpus_split(spark, sf_dir).withColumnRenamed("doc_id", "doc")
    docs = detect.annotate(documents(spark, sf_dir))
    for name in "ab":
        docs = docs.withColumn(name, predicted_spans(F.col("spans"), F.col("doc_id"), name))
    tag = lambda c: F.when(F.col(c) == "O", "O").otherwise(labels.tag_of(F.col(c)))
    found = tokens.labelled(docs, "doc_id", {"gold": "spans", "a": "a", "b": "b"}).join(parts, "doc")
    pairs = found.select("part", tag("gold").alias("gold"), F.explode(F.array(*(F.struct(F.lit(n).alias("run_id"), tag(n).alias("pred")) for n in "ab"))).alias("x")).select("x.run_id", "part", "gold", "x.pred")
    g = gold(spark, sf_dir).join(parts, "doc").select("part", *evaluate.ENTITY)
    both = docs.select(F.col("doc_id").alias("doc"), F.explode(F.array(*(F.struct(F.lit(n).alias("run_id"), F.col(n).alias("spans")) for n in "ab"))).alias("x")).select("doc", "x.run_id", F.explode("x.spans").alias("s")).select("doc", "run_id", "s.*")
    return evaluate.summary(g, both.join(parts, "doc").select("run_id", "part", *evaluate.ENTITY), pairs)


def wide_feature_counts(spark, sf_dir):
    """How often each named feature takes each value, for features of the word alone and of its sentence."""
    kept = ["word.isupper()", "word.istitle()", "word.contains_digit", "word.is_ascii", "shape.short", "sent.end_mark"]
    return sequence.feature_counts(documents(spark, sf_dir), kept)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "mask_documents": mask_documents,
    "detect_email": detection("Email"),
    "detect_ip": detection("URL_IP"),
    "detect_phone": detection("Phone_fax"),
    "detect_card": detection("ID"),
} | {
    f.__name__: f
    for f in (
        detect_all, mask_conversations, mask_custom_formatter, masked_spans, phi_distribution, corpus_split, phi_by_part_pivot, tokenize, sentence_segments, word_shapes, token_context, token_features, orthographic_flags, term_frequency, vocabulary_size,
        corpus_stats, bio_encode, bio_to_biluo, fix_dangling, label_violations, bio_to_spans, entity_metrics, macro_metrics, token_metrics, token_blind_metrics, annotator_agreement, unflatten_tags, run_summary, significance_test, span_surrogates,
        surrogate_id, surrogate_email, surrogate_url, surrogate_age, surrogate_initials, surrogate_phone, surrogate_zip, surrogate_date, corpus_shuffle, surrogate_documents, errors_ignore, failed_replacements, rewrite_table, manual_override,
        documents_without_annotations, documents_by_language, parse_dates, surrogate_date_texts, surrogate_dates_drawn, parse_names, surrogate_names, parse_locations, surrogate_locations, surrogate_corpus, crf_predictions, training_fraction,
        rule_tags, rule_tags_rewritten, dictionary_spans, inline_markup, plugged_tagger, merged_sentences, space_tokens, escaped_blanks, development_holdout, predefined_folds, bio_report, metric_lines, corpus_summary, wide_feature_counts,
    )
}
