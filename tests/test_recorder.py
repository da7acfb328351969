"""Recordings that are cut off, sent twice and taken up again."""

import json
import os
import time

import pytest
from pyspark.sql import functions as F

from tallymark.operators.recorded import last_of_each
from tallymark.sources import files
from tallymark.streaming.recorder import Recorder, _with


def answers(spark, *rows):
    return spark.createDataFrame(list(rows), "system string, id string, response string, num_predict int, truncated boolean, error string, seq long")


def said(record):
    return {(r["system"], r["id"]): r["response"] for r in record.latest().collect()}


def test_batches_count_once(spark, tmp_path):
    record = Recorder(spark, str(tmp_path / "r"))
    assert record.latest().count() == 0 and not record.committed(0)
    first = answers(spark, ("m", "a", "1", 10, True, None, 1), ("m", "b", "1", 10, None, "timeout", 2), ("m", "a", "2", 10, True, None, 3), (None, "a", None, None, None, None, 4))
    assert record.write(first, 0, order=F.col("seq")) and not record.write(first, 0, order=F.col("seq"))
    assert record.answers().count() == 4 and said(record) == {("m", "a"): "2", ("m", "b"): "1", (None, "a"): None}
    # Cut off before its commit: nothing of it is seen, and it can come again.
    left = record.stage(answers(spark, ("m", "c", "half", 10, None, None, 1)))
    assert ("m", "c") not in said(record)
    items = spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    assert {(r["id"], r["reason"]) for r in record.pending(items, "m", 20).collect()} == {("a", "outgrown"), ("b", "error"), ("c", "missing")}
    assert {r["id"] for r in record.pending(items, "m", 10).collect()} == {"b", "c"}
    assert record.write(answers(spark, ("m", "c", "whole", 20, None, None, 1), ("m", "a", "3", 20, None, None, 2), ("m", "b", "3", 20, None, None, 3)), 1)
    assert said(record) == {("m", "a"): "3", ("m", "b"): "3", ("m", "c"): "whole", (None, "a"): None} and record.pending(items, "m", 20).count() == 0
    # A late commit of a batch that counts already does nothing; another source has numbers of its own.
    assert not record.commit(left, 1) and record.write(answers(spark, ("n", "a", "x", 1, None, None, 1)), 1, source="other")
    assert said(record)["n", "a"] == "x" and os.path.isdir(tmp_path / "r/attempts" / left)
    assert record.sweep(3600) == 0 and record.sweep(0) == 1 and not os.path.isdir(tmp_path / "r/attempts" / left)
    assert record.answers().count() == 8


def test_two_writers_of_one_batch(spark, tmp_path):
    one, two = (Recorder(spark, str(tmp_path / "r")) for _ in range(2))
    a, b = one.stage(answers(spark, ("m", "a", "one", 1, None, None, 1))), two.stage(answers(spark, ("m", "a", "two", 1, None, None, 1)))
    assert [two.commit(b, 7), one.commit(a, 7)] == [True, False] and said(one) == {("m", "a"): "two"}
    # A number of the log that another writer took in between is not taken again.
    assert not one._enter(0, {"source": "stream", "batch": 8, "attempt": a})


def test_compaction(spark, tmp_path):
    record = Recorder(spark, str(tmp_path / "r"), longest=3)
    for k in range(8):
        assert record.write(answers(spark, ("m", str(k % 3), f"v{k}", 1, None, None, 1)), k)
    assert len(record._log()) <= 4 and said(record) == {("m", "0"): "v6", ("m", "1"): "v7", ("m", "2"): "v5"}
    assert all(record.committed(k) for k in range(8)) and not record.committed(8) and not record.write(answers(spark, ("m", "0", "again", 1, None, None, 1)), 2)
    assert record._done(record._log())["stream"] == [[0, 7]]
    assert record.compact() and not record.compact() and said(record)["m", "1"] == "v7"
    record.sweep(0)
    assert len(os.listdir(tmp_path / "r/attempts")) == 1 and said(record) == {("m", "0"): "v6", ("m", "1"): "v7", ("m", "2"): "v5"}


def test_ranges():
    got = []
    for n in (5, 3, 4, 9, 0, 4, 1):
        got = _with(got, n)
    assert got == [[0, 1], [3, 5], [9, 9]]


class Cut(Exception):
    pass


@pytest.mark.parametrize("where", ["staged", "committed"])
def test_a_stream_that_is_cut_off(spark, tmp_path, where):
    """The driver dies after a batch was written, or right after it was committed; the stream is started again."""
    source = tmp_path / "in"
    source.mkdir()
    schema = "system string, id string, response string"

    def put(k):
        (source / f"{k}.json").write_text("".join(json.dumps({"system": "m", "id": f"i{j}", "response": f"{k}"}) + "\n" for j in range(k, k + 3)))
        stamp = time.time() - 100 + k
        os.utime(source / f"{k}.json", (stamp, stamp))

    for k in range(3):
        put(k)

    class Dying(Recorder):
        def write(self, df, batch, source="stream", order=None):
            if batch == 1:
                if where == "committed":
                    super().write(df, batch, source, order)
                else:
                    self.stage(df, order)
                raise Cut
            return super().write(df, batch, source, order)

    def run(kind):
        record = kind(spark, str(tmp_path / "r"))
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(source))
        record.sink(stream, str(tmp_path / "checkpoint")).trigger(availableNow=True).start().awaitTermination()
        return record

    with pytest.raises(Exception, match="Cut"):
        run(Dying)
    put(3)
    record = run(Recorder)
    assert record.answers().count() == 12
    assert {k[1]: v for k, v in said(record).items()} == {"i0": "0", "i1": "1", "i2": "2", "i3": "3", "i4": "3", "i5": "3"}
    assert len(os.listdir(tmp_path / "r/attempts")) == (5 if where == "staged" else 4)


def test_recordings_of_many_splits(spark, tmp_path):
    """The last of several answers counts, however the file is cut into splits, and after it was written by many tasks."""
    (tmp_path / "in").mkdir()
    lines = [json.dumps({"id": f"i{k % 50}", "response": f"{k}" + "x" * (k % 97)}) for k in range(4000)]
    (tmp_path / "in/m1.jsonl").write_text("\n".join(lines) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = files.read_recorded(spark, f"{tmp_path}/in/*.jsonl")
        assert rows.rdd.getNumPartitions() > 8
        last = {r["id"]: int(r["response"].rstrip("x")) for r in last_of_each(rows).collect()}
        assert last == {f"i{k}": 3950 + k for k in range(50)}
        files.write_recorded(rows, str(tmp_path / "out"))
        assert len(list((tmp_path / "out/m1.jsonl").glob("part-*"))) > 1 and sorted(x for x in os.listdir(tmp_path / "out") if not x.startswith(".")) == ["m1.jsonl"]
        back = files.read_recorded(spark, f"{tmp_path}/out/*.jsonl")
        assert [r["response"] for r in back.orderBy("seq").collect()] == [json.loads(x)["response"] for x in lines]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
