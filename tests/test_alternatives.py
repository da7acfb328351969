"""Every rule that a board is not published under is held against the published one, normalisation included."""

import unicodedata

import duckdb
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tallymark.functions import counters as c

TEXTS = [*(unicodedata.normalize("NFD", t) for t in ("caf\u00e9 r\u00e9sum\u00e9", "caf\u00e9. And on", "plain\nlines here. Dr. Who", "\ud55c", "")), None]


def test_every_alternative_is_counted(spark, tmp_path):
    rows = [(i, "web", "en", t) for i, t in enumerate(TEXTS * 7)]
    spark.createDataFrame(rows, "doc_id long, source string, lang string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(tuple(r) for r in entry.queries()["alternatives"](spark, str(tmp_path)).select("dimension", "dialect", "pos", "moved", "by_how_much", "n").collect())
    assert [x[:2] for x in got] == sorted((d, k) for d in c.COUNTED for k in c.alternatives(d))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert got == sorted(con.sql(f"SELECT dimension, dialect, pos, moved, by_how_much, n FROM ({entry.oracle_sql()['alternatives']})").fetchall())
    # By text: three accents, one, none, two joining letters (7 times each); the dress adds none.
    assert [x[3:] for x in got if x[1] == "nfc_codepoints"] == [(21, 42, 42)]


def test_short_ways_count_the_same(spark):
    """Each code point inside a word, at its ends and alone: counts are those of the pieces that the rules give."""
    points = [chr(k) for k in [*range(0xD800), *range(0xE000, 0xFFFE), 0x1F600, 0x1D400, 0x20000]]
    near = [f(x) for x in points for f in (lambda x: f"a{x}b {x}", lambda x: f" {x}漢é-{x}1\n{x}")]
    t = F.col("t")
    df = spark.createDataFrame([(x,) for x in [*near, "", " ", "a" * 300_000, "é" * 300_000, " " * 300_000, "　a" * 100_000, "\n\n", "\na\n\nb\n", None]], "t string").repartition(8)
    pairs = [(c.count("words", t, {"words": k}), F.size(c.words(t, k))) for k in c.DIALECTS["words"]]
    pairs.append((c.chars(t, "no_whitespace"), F.length(F.regexp_replace(t, f"{c.cc.SPACE}+", ""))))
    pairs.append((c.lines(t, "all_lines"), F.when(_bare(t) == "", F.array().cast("array<string>")).otherwise(F.split(_bare(t), "\n", -1))))
    closed = {"sentences": "require_terminator"}
    pairs.append((c.count("sentences", t, closed), F.size(c.sentences(t, "require_terminator"))))
    different = df.select(*[F.count_if(~a.eqNullSafe(b)).alias(str(i)) for i, (a, b) in enumerate(pairs)]).first()
    assert not any(different), different


def _bare(text):
    return F.regexp_replace(text, r"\A\n+|\n+\z", "")
