"""Line quality and collocations against brute force."""

import collections
import random
import re

import numpy as np
import pytest

from tallymark.llm import collocations as co
from tallymark.llm import line_quality as lq

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_base(text):
    words = WORD.findall(text or "")
    windows = collections.Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    hit = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return [len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), sum(x in lines[:k] for k, x in enumerate(lines)), len(hit)]


CLEAN = "The river ran past the old mill, and the miller's daughter counted boats until the evening came."
MENU = "Home | News | Sport | Weather | About | Contact"
LOUD = "BUY!! NOW!! ONLY!! TODAY!! CHEAP!! CHEAP!!"
NOTICE = "All rights reserved. Privacy Policy"


def some(n, seed=3):
    rng = random.Random(seed)
    pick = lambda: rng.choice([CLEAN, MENU, LOUD, NOTICE, "", "  ", "a b c a b c", "x\x0by\x0cz", "ünï cödé “q” 🙂", "f(x) = {a: [1, 2]} # note", "same\r", " ".join(rng.choices("abcd", k=rng.randint(1, 40)))])
    return ["\n".join(pick() for _ in range(rng.randint(0, 12))) for _ in range(n)]


ODD = [None, "", "\n\n", " \t\x0b", "one", "two words", "a a a a", "w " * 49, "w " * 50, " ".join(map(str, range(50))), " x y", "#" * 100, "|" * 5]


def test_base_against_brute_force(monkeypatch):
    texts = ODD + some(200)
    _, counts = lq.judge(texts)
    assert [c[:5].tolist() for c in counts] == [brute_base(t) for t in texts]


@pytest.mark.parametrize(
    ("line", "rule"),
    [(CLEAN, -1), (MENU, 1), (LOUD, 0), (NOTICE, 2), ("Thnd*** iner*** ther*** that", 0), ("Who goes there?! It is I.", -1), ("Home › Shop › Shoes › Boots", 1),
     ("I read more books than he did, and the privacy policy of the house was never to ask which ones they were.", -1), ("", -1), ("!!", -1), ("if a > b: return a | b", -1)],
)
def test_rules(line, rule):
    assert lq.broken(line, len(line.split())) == rule


def test_lines_first(spark):
    good = "\n".join(" ".join(f"w{k}x{j}" for j in range(15)) + "." for k in range(10))
    rows = [(1, good, "x"), (2, good + "\n" + MENU + "\n" + NOTICE, "x"), (3, good + "".join("\n" + " ".join(f"Q{k}X{j}!!" for j in range(12)) for k in range(25)), "x"), (4, None, "x"), (5, "short.", None), (2, good, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `a.b` string").selectExpr("*", "1 as Quality", "2 as _cleaned", "3 as n_words")
    kept = lq.clean(docs)
    assert kept.columns == docs.columns
    got = sorted((r["doc_id"], r["text"], r["a.b"], r["Quality"], r["_cleaned"], r["n_words"]) for r in kept.collect())
    assert got == sorted([(1, good, "x", 1, 2, 3), (2, good, "x", 1, 2, 3), (2, good, "x", 1, 2, 3)])
    q = {r["doc_id"]: r["quality"] for r in lq.measure(docs.where("doc_id > 2")).collect()}
    assert q[3]["n_punctuation"] == 25 and not q[3]["base_failed"] and not q[3]["kept"]
    assert q[4]["cleaned"] is None and q[4]["base_failed"] and q[5]["base_failed"]
    assert lq.measure(docs.limit(0)).count() == 0


def test_very_long_texts_of_quality():
    long = "\n".join(f"{k} {CLEAN}" for k in range(12_000)) + ("\n" + MENU) * 100
    (cleaned,), ((n_words, *_, lost),) = (x if isinstance(x, list) else x.tolist() for x in lq.judge([long]))
    assert n_words > 200_000 and MENU not in cleaned and lost == 100 * len(MENU.replace(" ", ""))


def brute_phrases(rows, least, ranks):
    f, n = collections.defaultdict(collections.Counter), collections.Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in (1, 2, 3):
                for i in range(len(words) - k + 1):
                    f[lang][tuple(words[i : i + k])] += 1
    out = []
    for lang, counts in f.items():
        found = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        rows = []
        for p, a in found.items():
            if any(len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) and 100 * b >= 50 * a for q, b in found.items()):
                continue
            score, k = min((1_000_000 * a * a // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (s, a, p, left, right) in enumerate(sorted(rows)[:ranks], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -s))
    return sorted(out)


def phrase_rows(n, seed=5):
    rng = random.Random(seed)
    words = ["the", "of", "New", "York", "city", "é", "日本", "a-b", "x" * 40, "São", "Paulo", "to", "(a)", "'s"]
    glue = [" ", " ", " ", "  ", "\t", ", ", ". ", "\n", ": ", "\r\n", "\x0b"]
    text = lambda: "".join(rng.choice(words if rng.random() < 0.5 else words[:4]) + rng.choice(glue) for _ in range(rng.randint(0, 60)))
    return [(rng.choice(["en", "en", "pt", None, "und"]), rng.choice([None, "", "New York " * 30, "New York City."] + [text()] * 6)) for _ in range(n)]


@pytest.mark.parametrize(("least", "ranks", "cells", "chunk"), [(10, 2000, 1 << 12, 4 << 20), (2, 7, 64, 300), (1, 2000, 1 << 12, 1)])
def test_collocations_against_brute_force(spark, monkeypatch, least, ranks, cells, chunk):
    """Also with sketches so small that nearly everything passes, and chunks of one text."""
    monkeypatch.setattr(co, "CHUNK", chunk)
    monkeypatch.setattr(co, "BLOCK", 64)
    rows = phrase_rows(150)
    docs = spark.createDataFrame([(x, y, "clash") for x, y in rows], "lang string, text string, phrase string").repartition(3)
    got = sorted(tuple(r) for r in co.collocations(docs, least=least, ranks=ranks, cells=cells).collect())
    assert got == brute_phrases(rows, least, ranks)
    assert len(got) > 10


def test_no_collocations(spark):
    docs = spark.createDataFrame([], "lang string, text string")
    assert co.collocations(docs, cells=1 << 12).count() == 0
    docs = spark.createDataFrame([("en", None), ("en", "... !"), (None, "one two")], "lang string, text string")
    assert co.collocations(docs, cells=1 << 12).count() == 0


def test_sketches_hold_nothing_back(spark):
    """Bounds are upper bounds: whatever occurs often enough passes, also with few cells."""
    rows = phrase_rows(80, 9)
    docs = co._texts(spark.createDataFrame(rows, "lang string, text string"))
    bounds = co.Bounds(1 << 10, [])
    for _ in range(3):
        bounds = co.next_bounds(docs, bounds, 5)
    passed = {(r["lang"], r["phrase"]) for r in co.count_phrases(docs, bounds).collect()}
    assert {(x[0], x[2]) for x in brute_phrases(rows, 5, 10_000)} <= passed


def test_very_long_text_of_phrases(spark):
    text = "red fox, " * 60_000 + "lazy dog " * 20
    got = {r["phrase"]: r for r in co.collocations(spark.createDataFrame([("en", text)], "lang string, text string"), cells=1 << 12).collect()}
    assert got["red fox"]["a"] == 60_000 and got["red fox"]["score"] == 1_000_000 and got["red fox"]["n"] == 120_040


def test_scores_beyond_64_bits(spark):
    """Counts of a corpus far larger than a test's: the arithmetic alone."""
    from pyspark.sql import functions as F

    a, l, r = 3_037_000_500_000, 9_000_000_000_000, 4_000_000_000_000
    whole = lambda v: F.lit(v).cast("decimal(19,0)")
    got = spark.range(1).select(co.exact_score(whole(a), whole(l), whole(r)).alias("s")).first()["s"]
    assert got == 1_000_000 * a * a // (l * r)


def test_overlapping_matches():
    text = " a a a a \n a a "
    assert co.scan(text, ["a a", "a a a", "b"]).tolist() == [4, 2, 0]
    assert co.scan("", []).tolist() == [] and np.array_equal(co.scan(" a ", ["a"]), [1])


@pytest.mark.parametrize(("held", "words"), [(2_000_000, 400_000), (5, 400_000), (2_000_000, 4)])
def test_a_task_adds_up_its_chunks(spark, monkeypatch, held, words):
    """A phrase of many chunks leaves a task once, unless there are too many to hold."""
    for name, value in (("CHUNK", 1), ("BLOCK", 64), ("HELD", held), ("WORDS", words)):
        monkeypatch.setattr(co, name, value)
    docs = co._texts(spark.createDataFrame([("en", "New York city, a New York")] * 30 + [("pt", f"São Paulo {k}") for k in range(12)], "lang string, text string").coalesce(1))
    bounds = co.Bounds(1 << 10, [])
    for _ in range(3):
        bounds = co.next_bounds(docs, bounds, 10)
    rows = co.count_phrases(docs, bounds).collect()
    sums = collections.Counter()
    for r in rows:
        sums[r.lang, r.n_words, r.phrase] += r.times
    assert (sums["en", 2, "new york"], sums["en", 3, "new york city"], sums["pt", 2, "são paulo"], sums["en", 0, ""], sums["pt", 0, ""]) == (60, 30, 12, 180, 36)
    if held > 5 and words > 4:
        assert len(rows) == len(sums)
