"""Differences of folders, closures, and recordings that are accepted or refused while they are graded."""

import random

import pytest
from pyspark.sql import functions as F

from tallymark.operators import hashtree, recorded


def put(root, files):
    for path, content in files.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_bytes(content)


def test_folders(spark, tmp_path):
    """Equal names in two folders are told apart; pieces say where a file differs; a file may become a folder."""
    rng = random.Random(1)
    same = {f"keep/{k}/x": bytes([k]) * k for k in range(20)} | {"x": b"", "a/x": b"1", "b/x": b"2"}
    big = bytes(rng.randrange(256) for _ in range(1000))
    put(tmp_path / "here", same | {"big": big, "turns": b"file", "gone/deep/er/x": b"3", "swap/1": b"one", "swap/2": b"two"})
    put(tmp_path / "there", same | {"big": big[:150] + b"!" + big[151:999], "turns/x": b"file", "new/x": b"4", "swap/1": b"two", "swap/2": b"one"})
    got = {(r["path"], r["status"]): r["pieces"] for r in hashtree.compare_folders(spark, str(tmp_path / "here"), str(tmp_path / "there"), 100).collect()}
    assert got == {
        ("big", "changed"): [1, 9], ("turns", "lost"): None, ("turns/x", "added"): None, ("gone/deep/er/x", "lost"): None, ("new/x", "added"): None,
        ("swap/1", "changed"): [0], ("swap/2", "changed"): [0],
    }
    assert hashtree.compare_folders(spark, str(tmp_path / "here"), str(tmp_path / "here")).count() == 0


def test_trees_of_nothing(spark):
    none, kind = spark.createDataFrame([], "path string, content binary"), "path string, content binary"
    some = spark.createDataFrame([("/a//b", bytearray(b"x")), ("c", None), (None, bytearray(b"y")), ("c", None)], kind)
    assert hashtree.tree(none).count() == 0
    assert sorted(tuple(r) for r in hashtree.differences(hashtree.tree(none), hashtree.tree(some)).select("path", "status").collect()) == [("a/b", "added"), ("c", "added")]
    assert hashtree.differences(hashtree.tree(some), hashtree.tree(some)).count() == 0


def reach(edges, start):
    seen, todo = set(start), list(start)
    while todo:
        n = todo.pop()
        for a, b in edges:
            if a == n and b not in seen:
                seen.add(b)
                todo.append(b)
    return seen


@pytest.mark.parametrize("hops", [1, 3])
def test_closures(spark, hops):
    rng = random.Random(hops)
    for edges, start in (
        ([(k, k + 1) for k in range(12)] + [(12, 4), (40, 0)], [0]),  # a path into a cycle
        ([(rng.randrange(40), rng.randrange(40)) for _ in range(50)], [1, 2, 2]),
        ([(5, 5), (5, 6), (5, 6)], [5, 99]),
    ):
        rows = recorded.closure(spark.createDataFrame([*edges, (None, 1), (1, None)], "src long, dst long"), spark.createDataFrame([(s,) for s in [*start, None]], "node long"), hops).collect()
        assert sorted(r["node"] for r in rows) == sorted(reach(edges, start))
    assert recorded.closure(spark.createDataFrame([], "src long, dst long"), spark.createDataFrame([], "node long")).count() == 0


def test_a_long_path(spark):
    """A job follows so many edges of a path."""
    n = 60
    edges = spark.range(n).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    assert recorded.closure(edges, spark.range(1).select(F.col("id").alias("node")), 20).count() == n + 1


ITEM = "id string, prompt string, family string, dimension string, mode string, target int, keyword string, `unique` boolean"


def recording(spark, digest, *rows):
    out = [("m", i, digest.get(i, "") if d is None else d, r, c) for i, r, c, d in rows]
    return spark.createDataFrame(out, "system string, id string, prompt_sha256 string, response string, truncated boolean")


def test_one_job_grades_and_accepts(spark):
    asked = spark.createDataFrame([(i, f"P{i}", "f", "words", "exact", 2, "two", False) for i in "abcdefghijkl"], ITEM)
    digest = {r["id"]: r["d"] for r in asked.select("id", F.sha2("prompt", 256).alias("d")).collect()}
    good = [(i, "two words" if i < "g" else "no", i == "a", None) for i in "abcdefghijkl"]
    tracker, context = spark.sparkContext.statusTracker(), spark.sparkContext
    context.setJobGroup("accept", "one job")
    conf = "spark.sql.adaptive.enabled"
    spark.conf.set(conf, "false")  # which runs each shuffle as a job of its own
    try:
        graded = recorded.grade_accepted(recording(spark, digest, *good), asked)
        assert len(tracker.getJobIdsForGroup("accept")) <= 2  # a broadcast side is one of its own
    finally:
        spark.conf.set(conf, "true")
        context.setJobGroup("other", "")
    assert graded.count() == 12 and graded.where("compliant").count() == 6
    for rows, kind, word in (
        ([*good[1:], ("zz", "x", False, None)], recorded.Stale, "first of zz"),
        ([("a", "x", False, "other"), *good[2:]], recorded.Stale, "1 stale"),
        (good[2:], recorded.Partial, "2 item.* first is a"),
        ([(i, r, i in "ab", d) for i, r, _, d in good], recorded.Truncated, "16.7%"),
    ):
        for refuse in (recorded.grade_accepted, recorded.accept):
            with pytest.raises(kind, match=word):
                refuse(recording(spark, digest, *rows), asked)


def test_verdicts_of_several(spark):
    asked = spark.createDataFrame([(i, f"P{i}") for i in "abc"], "id string, prompt string")
    digest = {r["id"]: r["d"] for r in asked.select("id", F.sha2("prompt", 256).alias("d")).collect()}
    whole = recording(spark, digest, *[(i, "x", False, None) for i in "abc"])
    some = recording(spark, digest, ("b", "x", None, None)).withColumn("system", F.lit("n"))
    got = {r["system"]: (r["verdict"], r["first_id"], r["stale"], r["missing"]) for r in recorded.verdicts(whole.union(some), asked).collect()}
    assert got == {"m": ("accepted", None, 0, 0), "n": ("partial", "a", 0, 2)}
    assert recorded.verdicts(whole.limit(0), asked).count() == 0
