"""Standoff corpora: raw text files beside annotation files, read and written as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

NAME = r"([^/]+?)(\.[^./]*)?$"


def _names(spark: SparkSession, path: str, ending: str) -> DataFrame:
    """(doc) for each file, empty files included: a listing, as a file source gives no row for these."""
    jvm = spark._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    found = folder.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(folder)
    names = sorted(f.getPath().getName() for f in found)
    return spark.createDataFrame([(n[: -len(ending)],) for n in names if n.endswith(ending)], "doc string")


def annotations(spark: SparkSession, path: str, mode: str = "permissive") -> DataFrame:
    """(doc, ann_id, tag, start, end, text) of *.ann: lines that start with T, fields parted by tabs or blanks.

    Lines whose offsets are no numbers (fragments) are left out; mode failfast raises an error on lines with too few fields.
    """
    lines = spark.read.text(path, pathGlobFilter="*.ann").select(F.regexp_extract("_metadata.file_path", NAME, 1).alias("doc"), "value").where("startswith(value, 'T')")
    shape = r"^(T\S*)\s+(\S+)\s+(\S+)\s+(\S+)\s(.*)$"
    if mode == "failfast":
        lines = lines.withColumn("value", F.when(F.col("value").rlike(r"^T\S*\s+\S+\s+\S+\s+\S+\s"), F.col("value")).otherwise(F.raise_error(F.concat(F.lit("Not an annotation: "), "value"))))
    part = lambda k: F.regexp_extract("value", shape, k)
    rows = lines.select("doc", part(1).alias("ann_id"), part(2).alias("tag"), part(3).try_cast("int").alias("start"), part(4).try_cast("int").alias("end"), part(5).alias("text"))
    return rows.where("start is not null and end is not null")


def documents(spark: SparkSession, path: str) -> DataFrame:
    """(doc) for each *.ann, empty ones included."""
    return _names(spark, path, ".ann")


def texts(spark: SparkSession, path: str) -> DataFrame:
    """(doc, text) of *.txt with line ends as they are; empty files have empty texts."""
    rows = spark.read.text(path, wholetext=True, pathGlobFilter="*.txt").select(F.regexp_extract("_metadata.file_path", NAME, 1).alias("doc"), F.col("value").alias("text"))
    return _names(spark, path, ".txt").join(rows, "doc", "left").select("doc", F.coalesce("text", F.lit("")).alias("text"))


def corpus(spark: SparkSession, path: str, parts: tuple[str, ...] = ("train", "dev", "test")) -> DataFrame:
    """(part, doc, text, annotations) of a corpus folder; the *.ann files lead, so a text without one isn't seen."""
    out = None
    for part in parts:
        folder = f"{path}/{part}"
        spans = annotations(spark, folder).groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("start", "end", "tag", "text", "ann_id"))).alias("annotations"))
        rows = _names(spark, folder, ".ann").join(texts(spark, folder), "doc").join(spans, "doc", "left").select(F.lit(part).alias("part"), "doc", "text", "annotations")
        out = rows if out is None else out.union(rows)
    return out


def check_pairs(left: DataFrame, right: DataFrame) -> None:
    """Both sides must hold the same documents, and some."""
    odd = left.select("doc", F.lit(1).alias("l")).join(right.select("doc", F.lit(1).alias("r")), "doc", "full_outer").where("l is null or r is null")
    if left.isEmpty() or not odd.isEmpty():
        raise ValueError("The two sides hold different documents, or none")


def write(docs: DataFrame, path: str) -> None:
    """One .txt and one .ann for each row (doc, text, annotations), through the file system that the path names."""
    spark = docs.sparkSession
    lines = F.array_join(F.transform(F.coalesce("annotations", F.expr("cast(array() as array<struct<start:int,end:int,tag:string,text:string,ann_id:string>>)")), lambda s: F.concat(s["ann_id"], F.lit("\t"), s["tag"], F.lit(" "), s["start"].cast("string"), F.lit(" "), s["end"].cast("string"), F.lit("\t"), s["text"], F.lit("\n"))), "")
    rows = docs.select("doc", "text", lines.alias("ann"))
    fs = spark._jvm.org.apache.hadoop.fs
    folder = fs.Path(path)
    target = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    target.mkdirs(folder)
    for r in rows.toLocalIterator():  # files by name are for small exports; parquet is the sink for corpora
        for ending, data in ((".txt", r.text), (".ann", r.ann)):
            stream = target.create(fs.Path(f"{path}/{r.doc}{ending}"), True)
            stream.write(bytearray((data or "").encode()))
            stream.close()


def config(lines: list[str]) -> dict[str, list[str]]:
    """Sections of an annotation config; blank lines, comments and groups are skipped."""
    out: dict[str, list[str]] = {}
    name = None
    for line in map(str.strip, lines):
        if line.startswith("[") and line.endswith("]"):
            name = line[1:-1]
            out[name] = []
        elif line and line[0] not in "#!" and name is not None:
            out[name].append(line)
    return out


def notes(spark: SparkSession, path: str) -> DataFrame:
    """(doc, text) of nursing notes between START_OF_RECORD and ||||END_OF_RECORD."""
    rows = spark.read.option("lineSep", "||||END_OF_RECORD").text(path).where("value like '%START_OF_RECORD=%'")
    head = r"START_OF_RECORD=([0-9]+)\|\|\|\|([0-9]+)[^\n]*\n"
    return rows.select(F.concat_ws("-", F.lit("note"), F.regexp_extract("value", head, 1), F.regexp_extract("value", head, 2)).alias("doc"), F.regexp_replace(F.regexp_replace("value", r"^\s*" + head, ""), r"\s+$", "").alias("text"))


def xml(spark: SparkSession, path: str) -> DataFrame:
    """(doc, text, annotations) of XML documents with a CDATA text and TAGS."""
    rows = spark.read.text(path, wholetext=True, pathGlobFilter="*.xml").select(F.concat(F.lit("doc-"), F.regexp_extract("_metadata.file_path", NAME, 1)).alias("doc"), "value")
    get = lambda a: F.xpath("value", F.lit(f"deIdi2b2/TAGS/*/@{a}"))
    tags = F.regexp_extract_all("value", F.lit(r"<([A-Z]+)\s[^>]*\bid="), F.lit(1))
    zipped = F.arrays_zip(get("id").alias("id"), tags.alias("kind"), get("start").alias("start"), get("end").alias("end"), get("text").alias("text"), get("TYPE").alias("type"))
    spans = F.transform(zipped, lambda z: F.struct(z["start"].cast("int").alias("start"), z["end"].cast("int").alias("end"), F.concat_ws(":", z["kind"], z["type"]).alias("tag"), z["text"].alias("text"), F.regexp_replace(z["id"], "^P", "T").alias("ann_id")))
    return rows.select("doc", F.xpath_string("value", F.lit("deIdi2b2/TEXT")).alias("text"), spans.alias("annotations"))


def phrases(spark: SparkSession, path: str) -> DataFrame:
    """(doc, ann_id, tag, start, end, text) of lines `patient record start end tag text`, parted by blanks; numbered from T1 in the order of their starts for each note.

    Notes are named note-patient-record. Lines with fewer fields raise an error.
    """
    lines = spark.read.text(path).where("trim(value) <> ''").select(F.split(F.trim("value"), r"\s+", 6).alias("f"))
    lines = lines.select(F.when(F.size("f") == 6, F.col("f")).otherwise(F.raise_error(F.concat(F.lit("Not a phrase: "), F.array_join("f", " "))).cast("array<string>")).alias("f"))
    field = lambda k: F.get("f", F.lit(k))
    rows = lines.select(F.concat_ws("-", F.lit("note"), field(0), field(1)).alias("doc"), field(4).alias("tag"), field(2).cast("int").alias("start"), field(3).cast("int").alias("end"), field(5).alias("text"))
    number = F.row_number().over(Window.partitionBy("doc").orderBy("start", "end", "tag"))
    return rows.select("doc", F.concat(F.lit("T"), number).alias("ann_id"), "tag", "start", "end", "text")


def with_annotations(docs: DataFrame, found: DataFrame) -> DataFrame:
    """docs (doc, text) with the annotations of their name; none: an empty array."""
    per = found.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("start", "end", "tag", "text", "ann_id"))).alias("annotations"))
    empty = F.expr("cast(array() as array<struct<start:int,end:int,tag:string,text:string,ann_id:string>>)")
    return docs.join(per, "doc", "left").withColumn("annotations", F.coalesce("annotations", empty))
