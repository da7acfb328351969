"""Columns with dots or in another case, repeated labelled rows, lines that repeat, very long texts."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tallymark.llm import decontaminate, jaccard_join, license_scan, line_dedup, mixing, token_counts, toxicity

from .test_others import brute_licenses, toxic_rows

WIDE = "doc_id long, text string, source string, `a.b` string, Score int, `Score.x` int, N_Tokens int, Copies int"


def wide(spark, n=12):
    return spark.createDataFrame([(k, f"some words of text number {k}\nand a second line of it\nshared line of words here", f"s{k % 2}", "x", 1, 2, 3, 4) for k in range(n)], WIDE)


def test_names_with_dots_and_case(spark, tmp_path):
    docs = wide(spark)
    machine = toxicity.train(docs, spark.createDataFrame([(k, k % 2) for k in range(12)], "doc_id long, toxic int"))
    frames = {
        "score": toxicity.score(docs, machine),
        "lines": line_dedup.dedup_lines(docs, min_words=1),
        "mix": mixing.take(docs),
        "tokens": token_counts.subword_counts(docs),
        "keep": jaccard_join.keep_one(docs),
    }
    for name, df in frames.items():
        df.write.parquet(f"{tmp_path}/{name}")  # refuses names that are the same but for their case
        back = spark.read.parquet(f"{tmp_path}/{name}")
        assert {"a.b", "Score.x"} <= set(back.columns) and {r["a.b"] for r in back.collect()} == {"x"}, name
    assert "Score" not in frames["score"].columns and "N_Tokens" not in frames["tokens"].columns and "Copies" not in frames["mix"].columns
    assert frames["lines"].where("text like '%shared%'").count() == 1
    labels = spark.createDataFrame([(1, 1)], "doc_id long, toxic int")
    items = spark.createDataFrame([("i", "nothing of this kind is in any of the documents above")], "item_id string, text string")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    items.write.parquet(f"{tmp_path}/benchmark.parquet")
    for stage in (corpus_pipeline.drop_repeated_lines, corpus_pipeline.drop_benchmark_passages):
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns


def test_repeated_labelled_rows(spark):
    """A labelled document that is there 50,000 times is one row of the fit, and fits as one."""
    rows = toxic_rows(400)
    docs = spark.createDataFrame([(k, t) for k, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(k, y) for k, _, y in rows], "doc_id long, toxic int")
    (copied,) = docs.join(labels, "doc_id").where(~toxicity.held_out(F.col("doc_id"))).where("toxic = 1").orderBy("doc_id").limit(1).select("doc_id", "text").collect()
    many = spark.range(50_000).select(F.lit(copied["doc_id"]).cast("long").alias("doc_id"), F.lit(copied["text"]).alias("text"))
    one, all_ = toxicity.train(docs, labels, 100), toxicity.train(docs.union(many), labels, 100)
    assert one.bias == all_.bias and np.array_equal(one.weights, all_.weights)


def lines_of(kind, n, draw):
    mit = "Released under the MIT License.".split()
    if kind == "alternating":
        return [("the", "of")[k % 2] for k in range(n)]
    if kind == "cyclic":
        return [mit[k % 5] for k in range(n)]
    if kind == "template lines":
        return [draw.choice(["Released under", "the MIT License.", "foo bar", "Licensed under the Apache License,", "Version 2.0.", "foo", ""]) for _ in range(n)]
    return [" ".join(draw.choice(mit + ["x"]) for _ in range(draw.randrange(0, 4))) for _ in range(n)]


@pytest.mark.parametrize("kind", ["alternating", "cyclic", "template lines", "any"])
def test_licenses_in_lines_that_repeat(kind):
    draw = random.Random(3)
    scanner = license_scan.Scanner(license_scan.TEMPLATES, 0.8)
    for n in [1, 2, 3, 7, 20, 20, 20, 30]:
        text = "\n".join(lines_of(kind, n, draw))
        want = brute_licenses(text, license_scan.TEMPLATES, 0.8)
        assert {m[0]: m[1:] for m in scanner.one(text.encode())} == want, text


@pytest.mark.parametrize("kind", ["alternating", "cyclic", "template lines"])
def test_licenses_in_very_many_lines(kind):
    scanner = license_scan.Scanner(license_scan.TEMPLATES, 0.8)
    text = "\n".join([*lines_of(kind, 200_000, random.Random(1)), *license_scan.TEMPLATES.values()]).encode()
    start = time.process_time()
    found = scanner.texts([text])[0]
    assert len(found) == len(license_scan.TEMPLATES) and time.process_time() - start < 90


def test_very_long_texts(spark):
    """A text of 150,000 words through the operators that read whole texts."""
    words = [f"w{k}" for k in range(150_000)]
    rows = [(1, " ".join(words), "s"), (2, " ".join(words[:149_000]), "s"), (3, "short text of some words here", "t")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    items = spark.createDataFrame([("i", " ".join(words[140_000:140_020]))], "item_id string, text string")
    hits = {r["doc_id"]: [tuple(x) for x in r["spans"]] for r in decontaminate.contamination(docs, items).collect()}
    assert hits == {1: [(140_000, 140_020)], 2: [(140_000, 140_020)], 3: []}
    assert {r["doc_id"] for r in jaccard_join.keep_one(docs).collect()} == {1, 3}
    machine = toxicity.train(docs, spark.createDataFrame([(1, 0), (2, 0), (3, 1)], "doc_id long, toxic int"))
    assert all(0 <= r["score"] <= 1 for r in toxicity.score(docs, machine).collect())
    tokens = {r["doc_id"]: r["n_tokens"] for r in token_counts.subword_counts(docs).collect()}
    assert tokens[1] > tokens[2] > 149_000 > tokens[3]
    taken = {r["doc_id"]: r["taken"] for r in mixing.take(docs).collect()}
    assert all(taken[k] <= 2 * n for k, n in ((1, 150_000), (2, 149_000), (3, 6)) if k in taken)


def test_buckets_of_several_tasks(spark, tmp_path, monkeypatch):
    """A batch whose buckets are too large for a task each is written by several, and counts the same."""
    rows = [(k, "s", "en", "v", k % 7, "insert") for k in range(900)]
    changes = spark.createDataFrame(rows, token_counts.CHANGES)
    got = []
    for most in (1_000_000, 5):
        monkeypatch.setattr(token_counts, "TASK_ROWS", most)
        rollup = token_counts.TokenRollup(spark, str(tmp_path / str(most)))
        assert rollup.commit("a", changes) and rollup.commit("b", changes.where("doc_id < 300").replace("insert", "delete", "op")) and rollup.compact()
        files = [len(list(b.glob("*.parquet"))) for b in (tmp_path / str(most) / "ledger").glob("*/bucket=*")]
        assert max(files) == 1 if most > 5 else max(files) > 3
        got.append(([tuple(r) for r in rollup.totals().collect()], sorted(tuple(r) for r in rollup.current().collect())))
    assert got[0] == got[1] and got[0][0] == [("s", "en", "v", 600, sum(k % 7 for k in range(300, 900)))]
