"""Readers and writers: items, manifests, recorded answers, answers by system, reports."""

from __future__ import annotations

import json
import uuid
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.items import ITEM

#: One recorded answer. ``think`` is a flag or a word in the files, so it is read as text.
RECORDED = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("model", T.StringType()),
        T.StructField("prompt_sha256", T.StringType()),
        T.StructField("think", T.StringType()),
        T.StructField("num_predict", T.IntegerType()),
        T.StructField("response", T.StringType()),
        T.StructField("done_reason", T.StringType()),
        T.StructField("eval_count", T.IntegerType()),
        T.StructField("thinking_chars", T.IntegerType()),
        T.StructField("truncated", T.BooleanType()),
        T.StructField("error", T.StringType()),
    ]
)
MANIFEST = T.StructType(
    [
        T.StructField("seed", T.LongType()),
        T.StructField("count", T.LongType()),
        T.StructField("families", T.MapType(T.StringType(), T.StructType([T.StructField("n", T.LongType()), T.StructField("targets", T.ArrayType(T.LongType()))]))),
        T.StructField("published_rules", T.MapType(T.StringType(), T.StringType())),
        T.StructField("dialects", T.MapType(T.StringType(), T.ArrayType(T.StringType()))),
        T.StructField("prompts_sha256", T.StringType()),
    ]
)


def read_items(spark: SparkSession, path: str) -> DataFrame:
    """Items from JSON lines."""
    return spark.read.schema(ITEM).json(path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """A manifest: one row."""
    return spark.read.schema(MANIFEST).option("multiLine", True).json(path)


def read_recorded(spark: SparkSession, pattern: str) -> DataFrame:
    """Recorded answers of all recordings of a pattern, with ``system`` (its stem) and ``seq`` (a line's place).

    A recording is a file of JSON lines, or a folder of such. Blank lines are skipped. ``seq`` (file, begin of the split, number in
    it) grows from line to line however a file is split: of several answers to one id the last one counts.
    """
    at = F.struct(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("begin"), F.monotonically_increasing_id().alias("line"))
    rows = spark.read.text(pattern).select("value", at.alias("seq")).where(F.trim("value") != "").withColumn("r", F.from_json("value", RECORDED))
    return rows.select(F.regexp_extract("seq.path", r"([^/]+)\.jsonl(?:/[^/]+)?$", 1).alias("system"), "seq", "r.*")


def read_variants(spark: SparkSession, pattern: str) -> DataFrame:
    """(system, seq, row) of the same lines, each as a VARIANT: values keep the types that they have in the file.

    A line that is no JSON is null.
    """
    at = F.struct(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("begin"), F.monotonically_increasing_id().alias("line"))
    rows = spark.read.text(pattern).select("value", at.alias("seq")).where(F.trim("value") != "")
    return rows.select(F.regexp_extract("seq.path", r"([^/]+)\.jsonl(?:/[^/]+)?$", 1).alias("system"), "seq", F.try_parse_json("value").alias("row"))


def thinking(row: Column) -> Column:
    """What a recording's line (VARIANT) says of thinking, as struct (kind, flag, level): kind is flag (true or false), level (a word), number,
    none (a JSON null), absent, or other; flag and level are null unless the kind is theirs."""
    think = F.variant_get(row, "$.think", "variant")
    of = F.schema_of_variant(think)
    kind = F.when(of.isNull(), "absent").when(of == "BOOLEAN", "flag").when(of == "STRING", "level").when(of == "VOID", "none").when(of.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), "number").otherwise("other")
    flag, level = (F.when(of == t, F.try_variant_get(row, "$.think", t.lower())) for t in ("BOOLEAN", "STRING"))
    return F.struct(kind.alias("kind"), flag.alias("flag"), level.alias("level"))


def available(spark: SparkSession, folder: str) -> DataFrame:
    """(system) for each recording in a folder, sorted; no rows if there is no such folder."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
    return spark.createDataFrame([(n.removesuffix(".jsonl"),) for n in sorted(names) if n.endswith(".jsonl")], "system string")


def read_files(spark: SparkSession, pattern: str) -> DataFrame:
    """(path, content, text) of whole files, whatever they hold."""
    return spark.read.format("binaryFile").load(pattern).select("path", "content", F.decode("content", "UTF-8").alias("text"))


def text_frame(spark: SparkSession, text: str) -> DataFrame:
    """One text, such as one read from standard input."""
    return spark.createDataFrame([(text,)], "text string")


def flatten_reply(reply: Column) -> Column:
    """A model server's reply (JSON text) as struct (response, done_reason, eval_count, thinking_chars, truncated)."""
    r = F.from_json(reply, "message struct<content:string,thinking:string>, done_reason string, eval_count int")
    return F.struct(
        F.coalesce(r["message"]["content"], F.lit("")).alias("response"),
        r["done_reason"].alias("done_reason"),
        r["eval_count"].alias("eval_count"),
        F.length(F.coalesce(r["message"]["thinking"], F.lit(""))).alias("thinking_chars"),
        F.coalesce(r["done_reason"] == "length", F.lit(False)).alias("truncated"),
    )


def put_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file in any store that Spark reaches: whole under another name first, then in its place."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    place, new = hadoop.Path(path), hadoop.Path(f"{path}.{uuid.uuid4().hex}")
    fs = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    stream = fs.create(new, True)
    stream.write(bytearray(text.encode()))
    stream.close()
    fs.delete(place, True)
    if not fs.rename(new, place):
        raise OSError(f"{path} was written by somebody else at the same time")


def _json_lines(df: DataFrame, columns: list[str]) -> str:
    return "".join(json.dumps({c: r[c] for c in columns if r[c] is not None}, ensure_ascii=False) + "\n" for r in df.collect())


def write_items(items: DataFrame, path: str) -> None:
    """Items as one file of JSON lines with sorted keys, in their order; a prompt set is small, so the driver writes it."""
    ordered = items.orderBy("ord") if "ord" in items.columns else items
    put_text(items.sparkSession, path, _json_lines(ordered, sorted(ITEM.names)))


def write_recorded(recorded: DataFrame, folder: str) -> None:
    """Recorded answers as JSON lines in ``<system>.jsonl``, in the order of ``seq`` (of ``id`` without one): a file, or a folder of
    files if several tasks wrote.

    Executors write, in one job, next to what is there; then what a system has takes its place by a rename, so a reader
    sees the old or the new. Answers without a system are not written.
    """
    spark = recorded.sparkSession
    hadoop, staged = spark.sparkContext._jvm.org.apache.hadoop.fs, f"{folder}/_staged_{uuid.uuid4().hex}"
    names = [F.col(f"`{c}`") for c in recorded.columns if c not in ("system", "seq")]
    order = "seq" if "seq" in recorded.columns else "id"
    lines = recorded.where("system is not null").select("system", F.to_json(F.struct(*names)).alias("value"), order)
    sorted_ = lines.repartitionByRange("system", order).sortWithinPartitions("system", order)
    sorted_.select("system", "value").write.partitionBy("system").text(staged)
    fs = hadoop.Path(staged).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for status in fs.listStatus(hadoop.Path(staged)):
        key, _, system = status.getPath().getName().partition("=")
        if key == "system":
            place, parts = hadoop.Path(f"{folder}/{unquote(system)}.jsonl"), fs.listStatus(status.getPath())
            fs.delete(place, True)
            if not fs.rename(parts[0].getPath() if len(parts) == 1 else status.getPath(), place):
                raise OSError(f"{place} was written by somebody else at the same time")
    fs.delete(hadoop.Path(staged), True)


def write_answers(answers: DataFrame, path: str) -> None:
    """Answers as JSON lines, one folder a system."""
    answers.select("system", "id", "response").write.mode("overwrite").partitionBy("system").json(path)


def write_report(spark: SparkSession, report: dict, path: str) -> None:
    """A report as JSON: two spaces, sorted keys."""
    put_text(spark, path, json.dumps(report, indent=2, sort_keys=True) + "\n")


def markdown_table(df: DataFrame) -> str:
    """A small table in Markdown; line feeds and bars of texts are spelled so that rows stay rows."""
    cell = lambda x: "" if x is None else str(x).replace("|", "\\|").replace("\n", " ")
    rows = [df.columns, ["---"] * len(df.columns), *df.collect()]
    return "".join("| " + " | ".join(map(cell, r)) + " |\n" for r in rows)


def evidence(items: DataFrame, recorded: DataFrame, preview: int = 60) -> DataFrame:
    """What was asked, at which budget, why the answer ended, and how much of it was hidden or visible, a row an answer."""
    text = F.coalesce("response", F.lit(""))
    return recorded.join(items.select("id", "dimension", "target"), "id").select(
        "id", "dimension", "target", F.col("num_predict").alias("budget"), F.col("done_reason").alias("stopped"), F.col("eval_count").alias("tokens"),
        F.col("thinking_chars").alias("hidden"), F.length(text).alias("visible"), F.left(text, F.lit(preview)).alias("begins"),
    )


def read_report(spark: SparkSession, path: str) -> DataFrame:
    """A report as one row; a missing one is Spark's own error about the path."""
    return spark.read.option("multiLine", True).json(path)


def compare_files(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """(name) of files, by last part of their path, that differ or that one side lacks."""
    name = lambda df, c: df.select(F.regexp_extract("path", "([^/]+)$", 1).alias("name"), F.col("content").alias(c))
    return name(ours, "a").join(name(theirs, "b"), "name", "full_outer").where(~F.col("a").eqNullSafe(F.col("b"))).select("name")
