import json

import pytest
from pyspark.sql import functions as F

from tallymark import __main__ as cli
from tallymark.operators import compose, items
from tallymark.operators.grading import grade
from tallymark.sources import files
from tallymark.streaming.grading import count_stream, grade_stream, tally_stream


def test_items_round_trip(spark, tmp_path):
    own = items.build(spark)
    files.write_items(own, f"{tmp_path}/items")
    back = files.read_items(spark, f"{tmp_path}/items")
    assert back.count() == 500 and back.exceptAll(own.drop("ord")).isEmpty()
    lines = [json.loads(x) for x in (tmp_path / "items").read_text().splitlines()]
    assert all(list(x) == sorted(x) for x in lines) and [x["id"] for x in lines] == [r.id for r in own.orderBy("ord").collect()]
    files.write_items(own.limit(1), f"{tmp_path}/items")
    assert len((tmp_path / "items").read_text().splitlines()) == 1 and [p.name for p in tmp_path.iterdir() if "crc" not in p.name] == ["items"]


def test_manifest(spark, tmp_path):
    assert cli.main(["build", str(tmp_path)]) == 0
    m = files.read_manifest(spark, f"{tmp_path}/dataset.json").first()
    assert m["count"] == 500 and m["families"]["unique_items"]["n"] == 60 and m["dialects"]["items"] == ["normalized", "exact", "first_word"]


def test_recordings(spark, tmp_path):
    assert files.available(spark, f"{tmp_path}/none").count() == 0
    (tmp_path / "r").mkdir()
    (tmp_path / "r/m1.jsonl").write_text('{"id":"a","response":"x","think":false}\n\n{"id":"a","response":"y","think":"low"}\n')
    assert [r.system for r in files.available(spark, f"{tmp_path}/r").collect()] == ["m1"]
    rows = files.read_recorded(spark, f"{tmp_path}/r/*.jsonl").orderBy("seq").collect()
    assert [(r.system, r.response, r.think) for r in rows] == [("m1", "x", "false"), ("m1", "y", "low")]
    last = files.read_recorded(spark, f"{tmp_path}/r/*.jsonl").where("response = 'y'")
    files.write_recorded(last, f"{tmp_path}/r")
    assert [(r.system, r.id, r.response, r.think) for r in files.read_recorded(spark, f"{tmp_path}/r/*.jsonl").collect()] == [("m1", "a", "y", "low")]
    asked = spark.createDataFrame([("a", "words", 5)], "id string, dimension string, target int")
    table = files.markdown_table(files.evidence(asked, last.withColumn("response", F.lit("one|two\nthree"))))
    assert table.splitlines()[0].startswith("| id | dimension | target") and table.endswith("| 13 | one\\|two three |\n")
    files.write_answers(spark.createDataFrame([("s", "a", "é")], "system string, id string, response string"), f"{tmp_path}/w")
    assert spark.read.json(f"{tmp_path}/w").first().response == "é"


def test_thinking_by_type(spark, tmp_path):
    """A flag, a word, a number, a null and nothing are told apart, which text cannot do."""
    said = ["false", '"false"', "true", '"low"', "null", '"null"', "3", "1.5", "[1]", None]
    lines = ["{" + f'"id":"{k}"' + (f',"think":{x}' if x else "") + "}" for k, x in enumerate(said)]
    (tmp_path / "m.jsonl").write_text("\n".join(lines) + "\n\nno json\n")
    rows = files.read_variants(spark, f"{tmp_path}/*.jsonl").select("system", "seq", files.thinking(F.col("row")).alias("t")).orderBy("seq").select("system", "t.*").collect()
    assert [tuple(r) for r in rows] == [
        ("m", "flag", False, None), ("m", "level", None, "false"), ("m", "flag", True, None), ("m", "level", None, "low"), ("m", "none", None, None), ("m", "level", None, "null"),
        ("m", "number", None, None), ("m", "number", None, None), ("m", "other", None, None), ("m", "absent", None, None), ("m", "absent", None, None),
    ]


def test_replies(spark):
    reply = json.dumps({"message": {"content": "hi", "thinking": "abc"}, "done_reason": "length", "eval_count": 3})
    r = spark.range(1).select(files.flatten_reply(F.lit(reply)).alias("r")).first().r
    assert (r.response, r.thinking_chars, r.truncated, r.eval_count) == ("hi", 3, True, 3)


def test_file_comparison(spark, tmp_path):
    for d, text in (("a", "1"), ("b", "2")):
        (tmp_path / d).mkdir()
        (tmp_path / d / "x").write_text(text)
        (tmp_path / d / "y").write_text("same")
    a, b = (files.read_files(spark, f"{tmp_path}/{d}/*") for d in "ab")
    assert [r.name for r in files.compare_files(a, b).collect()] == ["x"]
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        files.read_report(spark, f"{tmp_path}/none.json")


def test_cli(spark, tmp_path, capsys, monkeypatch):
    import io

    assert cli.main([]) == 2 and cli.main(["odd"]) == 2
    assert cli.main(["rules"]) == 0
    monkeypatch.setattr("sys.stdin", io.StringIO("One two. Three"))
    assert cli.main(["count"]) == 0
    assert "words           3 under plain" in capsys.readouterr().out
    assert cli.main(["report", str(tmp_path)]) == 0 and cli.main(["board", str(tmp_path)]) == 0 and cli.main(["page", str(tmp_path)]) == 0
    assert "reference" in capsys.readouterr().out and "Every rule in detail" in (tmp_path / "index.html").read_text()
    made = json.loads((tmp_path / "report.json").read_text())
    assert made["dataset"]["count"] == 500 and [s["system"] for s in made["systems"]] == list(compose.SYSTEMS)
    first = made["systems"][0]
    assert first["strict"]["overall"]["rate"] == 1.0 and first["strict"]["families"]["words_exact"]["n"] == 80
    assert first["sensitivity"]["words"]["by_dialect"]["plain"] == first["sensitivity"]["words"]["published_rate"] == 1.0
    assert cli.main(["digest"]) == 0 and cli.main(["probes"]) == 0 and cli.main(["finger"]) == 0 and cli.main(["answers", str(tmp_path)]) == 0


def test_stream(spark, tmp_path):
    own = items.build(spark)
    answers = compose.baseline(own, "filler_keyword").select("id", "response", F.timestamp_seconds(F.lit(1_700_000_000)).alias("at"))
    answers.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(answers.schema).parquet(f"{tmp_path}/in")
    tally = tally_stream(grade_stream(stream, own), "at", "1 minute", "1 minute")
    q = tally.writeStream.outputMode("complete").format("memory").queryName("tally").start()
    q.processAllAvailable()
    q.stop()
    got = {r.family: (r.n, r.compliant) for r in spark.table("tally").collect()}
    assert got["words_exact"] == (80, 80) and sum(n for n, _ in got.values()) == 500
    assert grade(own.join(answers, "id")).where("compliant").count() == 500
    q = count_stream(stream.withColumnRenamed("response", "text")).writeStream.format("memory").queryName("counted").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("counted").count() == 500
