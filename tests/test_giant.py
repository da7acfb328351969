"""Texts in many rows and tasks against the same texts in one row."""

import random

import pytest
from pyspark.sql import functions as F

from tallymark.functions import counters as c
from tallymark.operators import giant

LINES = [
    "", "", " ", "\t", "One sentence here.", "Another one. And a third!", "it goes on in small letters", "  indented line, no stop", "1. Item one.", "2. ", "He met Dr.", "Smith there.",
    "Wait... what?!", '"Quoted."', '"Quoted." ', "—", "...", "!", "no stop", "A stop. ", "e.g.", "small after.", "Ünï. Çödé", "3.14 is pi.", "(Yes.)", "x\x0by. Z\x0c", " ", "a.b.c. d", "\x1c",
]


def texts(n, seed=1):
    rng = random.Random(seed)
    return ["\n".join(rng.choice(LINES) for _ in range(rng.choice([0, 1, 2, 5, 40]))) for _ in range(n)]


@pytest.mark.parametrize("parts", [None, 6])
def test_counts(spark, parts):
    rows = [(f"t{k}" if k else None, t) for k, t in enumerate(texts(60))]
    want = {r["name.x"]: r for r in c.with_counts(spark.createDataFrame(rows, "`name.x` string, text string")).collect()}
    lines = giant.as_lines(spark.createDataFrame(rows, "`name.x` string, text string").repartition(5), "text", []).withColumn("extra", F.lit(1))
    got = {r["k"]: r for r in giant.counts(lines.select(F.col("`name.x`").alias("k"), "line_no", "line", "extra"), ["k"], ["line_no"], parts).collect()}
    assert set(got) == set(want)
    for k, r in got.items():
        for name in giant.COUNTS:
            assert r[name] == want[k][name], (name, dict(rows)[k])


def test_a_text_in_parts(spark):
    """Documents one after the other are one text; a sentence may go on in the next."""
    docs = spark.createDataFrame([("a", 2, "goes on. Here"), ("a", 1, "Dr. Who\n\nit"), ("a", 3, "ends"), ("b", 1, None), ("c", 1, "")], "s string, d long, text string")
    got = {r.s: r for r in giant.counts(giant.as_lines(docs, "text", ["d"]), ["s"], ["d", "line_no"], 3).collect()}
    one = c.with_counts(spark.createDataFrame([("Dr. Who\n\nit\ngoes on. Here\nends",)], "text string")).first()
    assert set(got) == {"a", "c"} and {k: got["a"][k] for k in giant.COUNTS} == {k: one[k] for k in giant.COUNTS}
    assert all(got["c"][k] == 0 for k in giant.COUNTS)
    assert giant.counts(giant.as_lines(docs.limit(0), "text", ["d"]), ["s"], ["d", "line_no"]).count() == 0
