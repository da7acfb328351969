"""Items: prompts with a constraint that can be checked, and the manifest of a set of them."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import counters as c
from ..functions import vocabulary as v

ITEM = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("family", T.StringType()),
        T.StructField("dimension", T.StringType()),
        T.StructField("mode", T.StringType()),
        T.StructField("target", T.IntegerType()),
        T.StructField("unique", T.BooleanType()),
        T.StructField("topic", T.StringType()),
        T.StructField("keyword", T.StringType()),
        T.StructField("checks", T.ArrayType(T.StringType())),
        T.StructField("dialect", T.StringType()),
        T.StructField("prompt", T.StringType()),
    ]
)


def _by(value: Column, table: dict[str, str]) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), value)


def constraint_text(dimension: Column, mode: Column, target: Column, unique: Column) -> Column:
    """The constraint as a prompt states it; an unknown mode fails the query."""
    amount = (
        F.when(mode == "exact", v.EXACT)
        .when(mode == "at_most", "no more than")
        .when(mode == "at_least", "at least")
        .otherwise(F.raise_error(F.concat(F.lit("no such mode: "), F.coalesce(mode, F.lit("null")))).cast("string"))
    )
    body = F.concat_ws(" ", amount, target.cast("string"), _by(dimension, v.NOUNS))
    return F.concat(body, F.when(unique, F.lit(", and no two of them may say the same thing")).otherwise(""))


def prompt_text(instruction: Column, keyword: Column, dimension: Column, mode: Column, target: Column, unique: Column) -> Column:
    """A prompt: instruction, keyword, constraint, rule and tail, with blank lines between."""
    rule = F.when(unique, _by(dimension, {d: c.explain(d, True) for d in v.NOUNS})).otherwise(_by(dimension, {d: c.explain(d) for d in v.NOUNS}))
    return F.concat_ws(
        "\n\n",
        instruction,
        F.concat(F.lit('Your answer must contain the word "'), keyword, F.lit('".')),
        F.concat(F.lit("CONSTRAINT: "), constraint_text(dimension, mode, target, unique), F.lit(".")),
        F.concat(_by(dimension, v.HEADINGS), F.lit(". Your answer is checked against this rule and no other:\n"), rule),
        F.lit(v.TAIL),
    )


def build(spark: SparkSession, seed: int = v.SEED) -> DataFrame:
    """The published item set, with its order in ``ord``. A few hundred draws of one generator, made on the driver."""
    draw, rows = random.Random(seed), []
    for family, dimension, mode, unique, n, least, most, form in v.FAMILIES:
        for number in range(1, n + 1):
            topic, keyword = v.TOPICS[draw.randrange(len(v.TOPICS))]
            wording = v.FORMS[form][draw.randrange(len(v.FORMS[form]))]
            rows.append((len(rows), f"{family}-{number:03d}", family, dimension, mode, draw.randint(least, most), unique, topic, keyword, wording.format(topic=topic)))
    df = spark.createDataFrame(
        rows, "ord int, id string, family string, dimension string, mode string, target int, unique boolean, topic string, keyword string, instruction string"
    )
    checks = F.when(F.col("unique"), F.array(F.lit("count"), F.lit("keyword"), F.lit("unique"))).otherwise(F.array(F.lit("count"), F.lit("keyword")))
    return df.withColumns(
        {
            "checks": checks,
            "dialect": _by(F.col("dimension"), c.PUBLISHED),
            "prompt": prompt_text(*[F.col(x) for x in ("instruction", "keyword", "dimension", "mode", "target", "unique")]),
        }
    ).select("ord", *ITEM.names)


def prompt_digest(prompt: Column) -> Column:
    """SHA-256 of a prompt."""
    return F.sha2(prompt, 256)


def families(items: DataFrame) -> DataFrame:
    """Per family: n, the least and the largest target."""
    return items.groupBy("family").agg(F.count("*").alias("n"), F.min("target").alias("min_target"), F.max("target").alias("max_target"))


def ordered_digest(items: DataFrame, order: str = "ord", id_col: str = "id", text_col: str = "prompt") -> DataFrame:
    """One row: how many items, and SHA-256 over id and text of all, in order.

    An order-sensitive digest needs its input in one place; an item set is a prompt set, not a corpus.
    """
    rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.concat(F.col(id_col), F.col(text_col)).alias("t"))))
    return items.agg(F.count("*").alias("items"), F.sha2(F.array_join(F.transform(rows, lambda r: r["t"]), ""), 256).alias("sha256"))
