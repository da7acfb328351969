import random

import pytest
from pyspark.sql import functions as F

from tallymark.functions import counters as c
from tallymark.functions.probes import DECIDED, PROBES

from . import model

PARTS = [
    "word", "Dr.", "e.g.", "etc..", "no.", "Ph.D.", "3.14", "1,000", "state-of-the-art", "a+b", "+", "—", "x—y", "…", "?!", "!", ".", '."', ".)", "\n", "\n\n", "\n \n",
    "\n- ", "\n  - ", "\n\t- ", "\n1. ", "\n(2) ", "\na) ", "\n• ", " ", "  ", "\t", " ", " ", "\x1c", "é", "é", "ß", "😀", "Next", "lower", "12", "\r\n", " ", "---",
]


def check(spark, texts):
    rows = c.with_counts(spark.createDataFrame([(t,) for t in texts], "text string")).collect()
    bad = []
    for r in rows:
        for d in c.COUNTED:
            for k in c.DIALECTS[d]:
                if r[f"{d}_{k}"] != model.COUNT[d](r.text, k):
                    bad.append((d, k, r.text, r[f"{d}_{k}"], model.COUNT[d](r.text, k)))
    return bad


def test_what_probes_decide(spark):
    rows = {r["label"]: r for r in c.with_counts(spark.createDataFrame(list(PROBES), "label string, text string")).collect()}
    assert len(rows) == len(DECIDED)
    assert {k: rows[k][f"{d}_{x}"] for k, _, (d, x, _) in DECIDED} == {k: n for k, _, (_, _, n) in DECIDED}


def test_probes(spark):
    assert not check(spark, [t for _, t in PROBES])


def test_random_texts(spark):
    draw = random.Random(7)
    texts = ["".join(draw.choice(PARTS) + draw.choice(["", " ", ""]) for _ in range(draw.randrange(25))) for _ in range(1500)]
    assert not check(spark, texts)[:5]


def test_a_broken_rule_is_noticed(spark):
    """The comparison can fail: without abbreviations the sentence rule differs from the model's."""
    assert model.sentences("Dr. Smith arrived. He waited.", "plain") == 2
    naive = spark.range(1).select(c.count("sentences", F.lit("Dr. Smith arrived. He waited."), {"sentences": "naive"})).first()[0]
    assert naive == 3


@pytest.mark.parametrize(
    "text, dimension, dialect, n",
    [
        ("state-of-the-art design", "words", "plain", 2),
        ("state-of-the-art design", "words", "hyphen_split", 5),
        ("about 3.14 metres", "words", "alpha_only", 2),
        ("a + b", "words", "whitespace", 3),
        ("Ordered from acme. inc and shipped.", "sentences", "plain", 1),
        ("One sentence here. A fragment with no stop", "sentences", "require_terminator", 1),
        ("First line\nSecond line", "sentences", "newline_breaks", 2),
        ("- one\n  - nested\n- two", "bullets", "all_levels", 3),
        ("1. one\n2. two\n3. three", "bullets", "dash_only", 0),
        ("café", "chars", "nfc_codepoints", 4),
        ("one\n---\ntwo", "lines", "stripped_all", 3),
        ("one\n    indented\n\ntwo", "paragraphs", "indent_or_blank", 3),
        ("", "lines", "all_lines", 0),
    ],
)
def test_cases(spark, text, dimension, dialect, n):
    assert spark.range(1).select(c.count(dimension, F.lit(text), {dimension: dialect})).first()[0] == n


def test_items(spark):
    df = spark.createDataFrame([("- Red apples.\n- red apples\n- red cars",)], "t string")
    t = F.col("t")
    r = df.select(
        c.duplicate_keys(c.item_keys(t)).alias("n"), c.duplicate_keys(c.item_keys(t, "plain", "exact")).alias("e"), c.duplicate_keys(c.item_keys(t, "plain", "first_word")).alias("f")
    ).first()
    assert (r.n, r.e, r.f) == (["red apples"], [], ["red"])
    parts = df.select(c.bullet_parts(F.lit(" 1) one\n- two"))).first()[0]
    assert [(p.width, p.marker, p.body) for p in parts] == [(1, "1)", "one"), (0, "-", "two")]


def test_item_keys_in_one_pass(spark):
    """A key is found without cutting up the item or looking around at each character, and is what that would give."""
    draw = random.Random(9)
    bodies = ["".join(draw.choice(PARTS + ["(", "\u00a0", "—", "Ⅷ", "²", "漢"]) for _ in range(draw.randrange(12))) for _ in range(2000)]
    bodies += ["", " ", "...", "—", "!" * 300_000 + " x", "- " * 100_000 + "(Y)", "a" * 300_000, "x" + " ," * 100_000 + " y"]
    df = spark.createDataFrame([(b,) for b in bodies], "b string")
    t = F.col("b")
    whole = F.coalesce(F.get(c.words(t), F.lit(0)), F.lit(""))
    bare = F.regexp_replace(F.regexp_replace(t, c.cc.NEITHER, " "), f"{c.cc.SPACE}+", " ")
    got = df.select(c.item_key(t, "first_word"), c.fold(whole), c.item_key(t), c.fold(c.strip(bare))).collect()
    assert not [r for r in got if r[0] != r[1] or r[2] != r[3]]
    for dialect in ("first_word", "normalized"):
        plan = df.select(c.item_key(t, dialect))._jdf.queryExecution().optimizedPlan().toString()
        assert "split(" not in plan and "(?!" not in plan


def test_sentence_texts(spark):
    got = spark.range(1).select(c.sentences(F.lit("Dr. Smith came. He left"))).first()[0]
    assert got == ["Dr. Smith came.", "He left"]


def test_folding(spark):
    df = spark.createDataFrame([("Straße",)], "t string")
    assert df.select(c.casefold("t"), c.fold(F.col("t"))).first()[:] == ("strasse", "strasse")


def test_unknown_dialects():
    for call in (lambda: c.ruleset({"words": "odd"}), lambda: c.ruleset({"odd": "plain"}), lambda: c.count("items", F.lit("")), lambda: c.words(F.lit(""), "odd")):
        with pytest.raises(c.UnknownDialect):
            call()
    assert c.alternatives("items") == ["exact", "first_word"]
    assert c.explain("lines").startswith("- A line counts")


def test_null(spark):
    r = c.with_counts(spark.createDataFrame([(None,)], "text string")).first()
    assert all(v is None for k, v in r.asDict().items())


def test_recount(spark):
    """The recount's own expressions against the same model, on probes and random texts."""
    from tallymark.operators import recount

    rng = random.Random(11)
    drawn = [t for _, t in PROBES] + ["".join(rng.choice(PARTS) for _ in range(rng.randrange(0, 14))) for _ in range(400)]
    df = spark.createDataFrame([(k, d, t) for k, t in enumerate(drawn) for d in model.COUNT], "k int, d string, t string")
    trimmed = F.btrim("t", F.lit(recount._SPACES))
    rows = df.select("k", "d", "t", recount.counted(F.col("d"), trimmed).alias("n"), recount.repeats(trimmed).alias("r"), recount.has_keyword(trimmed, F.lit("Word")).alias("w")).collect()
    bad = [(r["d"], r["t"], r["n"]) for r in rows if r["n"] != model.COUNT[r["d"]](r["t"].strip(), c.PUBLISHED[r["d"]])]
    assert not bad, bad[:5]
    assert all(r["r"] == model.repeats(r["t"].strip()) and r["w"] == model.has_keyword(r["t"].strip(), "Word") for r in rows)


def test_recount_of_a_long_text(spark):
    """Each token is looked at once: text of 20,000 words took a pass over all of it for each word."""
    import time

    from tallymark.operators import recount

    text = "One word after another, e.g. this. " * 3_500
    df = spark.createDataFrame([(text,), ("- " * 40_000,)], "t string")
    began = time.time()
    got = [r.n for r in df.select(recount.sentences(F.col("t")).alias("n")).collect()]
    assert got == [3_500, 0] and time.time() - began < 30


def test_composed_texts_need_no_normalisation(spark):
    """No code point of the class changes, moves or joins another; texts of these alone do not reach Python."""
    import re
    import unicodedata

    from tallymark.functions import charclass as cc

    own = [chr(k) for k in range(0x10000) if re.fullmatch(cc.COMPOSED, chr(k))]
    assert len(own) > 30_000 and all(unicodedata.is_normalized("NFC", x) and not unicodedata.combining(x) for x in own)
    pairs = [unicodedata.decomposition(chr(k)).split() for k in range(0x110000)]
    seconds = {chr(int(p[1], 16)) for p in pairs if len(p) == 2 and "<" not in p[0]} | {chr(k) for k in [*range(0x1161, 0x1176), *range(0x11A8, 0x11C3)]}
    assert not seconds & set(own)
    texts = [" café\n", "café", "한", "Å", "日本゙", "Й 한", "", None]
    count = c.count("chars", F.col("t"), {"chars": "nfc_codepoints"})
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", count.alias("n"))
    assert [r.n for r in df.collect()] == [None if t is None else len(unicodedata.normalize("NFC", t.strip())) for t in texts]
    assert "nfc(CASE WHEN" in df._jdf.queryExecution().optimizedPlan().toString()
