"""The other corpus operators: brute force, round trips, held-out accuracy, and unusual tables."""

import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallymark.llm import attention_lm, decontaminate, license_scan, mixing, token_counts, toxicity, url_filter

DOCS = "doc_id long, text string"


# ---- URL filter


def brute_verdict(url, rules):
    rest = (url or "").split("://", 1)[1] if "://" in (url or "") else ""
    raw = re.match(r"[^/?#]*", rest).group()
    host = "".join(ch.lower() if ch.isascii() else ch for ch in raw)
    path = re.match(r"[^?#]*", rest[len(raw) :]).group()
    fits = [(len(h + p), len(h), v == "block", h + p, v) for h, p, v in rules if host and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None, key=lambda x: x[:3])
    return host, path, best and best[3], best[4] if best else "allow"


def test_urls(spark):
    rules = [*url_filter.RULES, ("b.com", "/x", "block"), ("a.b.com", "", "allow"), ("ü.de", "/é", "block")]
    urls = [f"{s}://{u}{h}{p}{q}" for s in ("http", "FTP") for u in ("", "WWW.", "a.") for h in ("example.com", "b.com", "xb.com", "x.net", "com", "net") for p in ("", "/", "/en/", "/en", "/x", "/xy/z", "/es/1", "/fr/") for q in ("", "?a=/b", "#/en/")]
    urls += ["nothing", "", None, "://", "http://", "http://?x", "http://a.ü.de/éa", "http://..com/", "x://y://example.com/en/", "http://" + "a." * 60 + "com/"]
    df = spark.createDataFrame([(k, u, "host", 1) for k, u in enumerate(urls)], "page_id long, url string, host string, verdict int")
    got = url_filter.url_verdicts(df, spark.createDataFrame(rules, url_filter.RULE_SCHEMA)).collect()
    assert {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in got} == {k: brute_verdict(u, rules) for k, u in enumerate(urls)}


def test_urls_unusual(spark):
    rules = spark.createDataFrame([(None, "/", "block"), ("", "/", "block"), ("a.com", None, "block"), ("a.com", None, "block")], url_filter.RULE_SCHEMA)
    pages = spark.createDataFrame([(None, "http://a.com/x"), (1, "http://a.com"), (1, "http://a.com")], "page_id long, url string")
    assert [(r.rule, r.verdict) for r in url_filter.url_verdicts(pages, rules).collect()] == [("a.com", "block")] * 3
    assert [r.verdict for r in url_filter.url_verdicts(pages, rules.limit(0)).collect()] == ["allow"] * 3
    assert url_filter.url_verdicts(pages.limit(0), rules).count() == 0


# ---- decontamination


def alnum(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(ch.lower() if ch.isascii() else ch for ch in t or ""))


def brute_hits(docs, items, window):
    out = []
    for d, t in docs:
        w, hit, names = alnum(t), set(), set()
        for i, x in items:
            b = alnum(x)
            for k in range(max(1, len(b) - window + 1) if b else 0):
                p = b[k : k + window]
                for j in range(len(w) - len(p) + 1):
                    if w[j : j + len(p)] == p:
                        hit.update(range(j, j + len(p)))
                        names.add(str(i))
        out.append((d, len(w), len(hit), sorted(names)))
    return out


def some_texts(n, seed=1):
    draw = random.Random(seed)
    words = ["the", "of", "Été", "a1", "x", "thon", "ÀB", "ing", "ß"]
    return [draw.choice([" ", "-", ".\n"]).join(draw.choice(words) for _ in range(draw.randrange(40))) for _ in range(n)]


@pytest.mark.parametrize("shard, passes", [(1 << 22, 16 << 20), (50, 16 << 20), (1 << 22, 60)])
def test_contamination_against_brute_force(spark, shard, passes):
    items = list(enumerate(some_texts(25, 3))) + [(99, "x"), (100, "--")]
    docs = list(enumerate(some_texts(200, 4)))
    found = decontaminate.contamination(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, "item_id long, text string"), 6, shard, passes)
    got = sorted((r.doc_id, r.n_words, sum(s.end - s.start for s in r.spans), r["items"]) for r in found.collect())
    assert got == brute_hits(docs, items, 6)


def test_cut(spark):
    item = "one two three four five six seven eight nine ten eleven"
    docs = spark.createDataFrame([(1, f"Before, {item.upper()}! After.", 1), (2, "one two three four five " + item + " six seven eight nine ten", 1), (3, None, 1), (4, "clean text", 1), (4, "clean text", 1)], "doc_id long, text string, spans int")
    bench = spark.createDataFrame([(1, item), (None, "clean text"), (2, None), (1, item)], "item_id long, text string")
    got = sorted((r.doc_id, r.text or "") for r in decontaminate.decontaminate(docs, bench).collect())
    assert got[0] == (1, "Before, ! After.") and got[2:] == [(3, ""), (4, "clean text"), (4, "clean text")]
    again = decontaminate.contamination(decontaminate.decontaminate(docs, bench), bench)
    assert again.where("size(spans) > 0").count() == 0
    assert decontaminate.contamination(docs, bench.limit(0)).where("size(spans) > 0").count() == 0
    assert decontaminate.contamination(docs.limit(0), bench).count() == 0


@pytest.mark.parametrize("pass_bytes", [80, 16 << 20])
def test_cut_in_passes(spark, pass_bytes):
    w = [f"w{k}" for k in range(25)]
    items = [(k, " ".join(x)) for k, x in enumerate([w, ["p", *w[9:18], "q"], ["a", *w[9:18], "b"], w[9:19], "u v x y".split(), ["one"]])]
    texts = [" ".join(["Before,", *w, "after."]), " ".join(["u", "v", *w, "x", "y", "end"]), "u v one x y end", " ".join([*w[:9], "one", *w[9:]]), "clean text", None]
    docs = spark.createDataFrame([(k, t, k, "own", "own") for k, t in enumerate(texts)], f"{DOCS}, n int, _found string, _Open string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: (r.text, r.n) for r in decontaminate.decontaminate(docs, bench, pass_bytes=pass_bytes).collect()}
    assert got == {0: ("Before,  after.", 0), 1: (" end", 1), 2: (" end", 2), 3: (" ".join(w[:9]) + " ", 3), 4: ("clean text", 4), 5: (None, 5)}


def test_fm_index():
    rng = np.random.default_rng(5)
    for n, top in ((0, 2), (1, 2), (50, 2), (400, 3), (3000, 40)):
        text = rng.integers(0, top, n)
        index = decontaminate.FMIndex(text)
        for size in (1, 2, 5):
            phrases = np.unique(rng.integers(1, top + 1, (40, size)), axis=0)
            lo, hi = index.search(phrases)
            for p, a, b in zip(phrases, lo, hi):
                want = [i for i in range(n - size + 1) if (text[i : i + size] == p).all()]
                assert sorted(index.locate(np.arange(a, b))) == want


# ---- mixing


def brute_targets(sizes, weights, share, most):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, left, open_ = {}, share * sum(sizes.values()), set(order)
    while open_:
        total = sum(w[s] for s in open_)
        full = {s for s in open_ if left * w[s] / total >= most * sizes[s] - 1e-9}
        if not full:
            target |= {s: left * w[s] / total for s in open_}
            break
        target |= {s: most * sizes[s] for s in full}
        left -= sum(most * sizes[s] for s in full)
        open_ -= full
    return target


@pytest.mark.parametrize("fan_in", [4, 128])
def test_mix(spark, fan_in):
    draw = random.Random(6)
    docs = [(k, " ".join(["w"] * draw.randrange(60)), draw.choice(["a"] * 6 + ["b", "c", "d", None])) for k in range(1500)] + [(7, "x y", "a"), (7, "x y", "a"), (None, "x", "b"), (3000, None, "e")]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    rows = mixing.mix(df, fan_in=fan_in).collect()
    assert len(rows) == len(docs)
    sizes, taken, largest = {}, {}, {}
    for r in rows:
        sizes[r.source] = sizes.get(r.source, 0) + r["size"]
        taken[r.source] = taken.get(r.source, 0) + r.taken
        largest[r.source] = max(largest.get(r.source, 0), r["size"])
        assert r.taken == r.copies * r["size"] and 0 <= r.copies <= 2
    want = brute_targets(sizes, (3, 1, 2), 1.5, 2)
    for r in rows:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6
    assert all(abs(taken[s] - want[s]) <= largest[s] for s in sizes)
    key = lambda x: sorted((repr(r) for r in x))
    assert key(rows) == key(mixing.mix(df.repartition(7), fan_in=fan_in).collect())
    assert mixing.mix(df.limit(0)).count() == 0
    clash = ["Copies", "_text", "_d", "_s", "_t", "part"]
    out = mixing.take(df.withColumns({c: F.lit("own") for c in clash}), fan_in=fan_in)
    assert out.agg(F.sum("taken")).first()[0] == sum(taken.values())
    assert out.columns == ["doc_id", "text", "source", *clash[1:], "copies", "taken"] and out.first()["_s"] == "own"


def test_rounding_has_the_right_expectation(spark):
    rows = spark.range(4000).selectExpr("cast(id % 20 as long) part", "id", "id % 7 + 1 size", "0.3D f")
    keyed = rows.withColumn("k", F.struct(F.col("id").alias("d"), F.lit(False).alias("none"), "part", "size", F.lit(0).cast("long").alias("text"), F.lit(1).cast("long").alias("i")))
    up = mixing.round_fractions(keyed.select("part", "k", "size", "f"), 16)
    assert up.count() == 4000 and set(r.up for r in up.select("up").distinct().collect()) <= {0, 1}
    by_size = up.groupBy("k.size").agg(F.avg("up").alias("m")).collect()
    assert all(abs(r.m - 0.3) < 0.08 for r in by_size)


# ---- toxicity


def toxic_rows(n, seed=1):
    """Toxic: an insult next to a group; either alone is not."""
    draw = random.Random(seed)
    out = []
    for k in range(n):
        w = [f"w{draw.randrange(60)}" for _ in range(30)]
        insult, group = draw.random() < 0.5, draw.random() < 0.5
        w += ["insult"] * insult + ["group"] * group
        draw.shuffle(w)
        out.append((k, " ".join(w), int(insult and group)))
    return out


def test_machine_learns_interactions():
    memory: dict = {}
    rows = toxic_rows(3000)
    machine = toxicity.fit([toxicity.terms(t, memory) for _, t, _ in rows[:2000]], np.array([y for *_, y in rows[:2000]], float))
    test = [toxicity.terms(t, memory) for _, t, _ in rows[2000:]]
    got = machine.margins(np.concatenate(test), np.array([len(t) for t in test])) >= 0
    assert np.mean(got == np.array([y for *_, y in rows[2000:]])) > 0.95


def test_margins_against_a_loop_over_pairs():
    rng = np.random.default_rng(6)
    known = np.full(1 << toxicity.BITS, -1, np.int64)
    known[:30] = rng.permutation(30)
    machine = toxicity.Machine(0.3, rng.normal(size=30), rng.normal(size=(30, 4)), known)
    rows = [rng.choice(45, n, replace=False) for n in (0, 1, 2, 9, 40)]  # some terms are unknown
    got = machine.margins(np.concatenate(rows).astype(np.int64), np.array([len(r) for r in rows]))
    for r, margin in zip(rows, got):
        at = [int(known[x]) for x in r if known[x] >= 0]
        pairs = sum(float(machine.factors[a] @ machine.factors[b]) for i, a in enumerate(at) for b in at[:i])
        assert abs(margin - (0.3 + sum(machine.weights[a] for a in at) + pairs / max(1, len(at)))) < 1e-9


def test_a_sample_of_one_class_does_not_shift_scores():
    memory: dict = {}
    rows = toxic_rows(3000, 5)
    found, y = [toxicity.terms(t, memory) for _, t, _ in rows], np.array([y for *_, y in rows], float)
    toxic, clean = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    some = np.concatenate([toxic[:400], clean[:400]])
    of = lambda x: x.margins(np.concatenate(found[:500]), np.array([len(t) for t in found[:500]])).mean()
    full = of(toxicity.fit(found, y))
    told = of(toxicity.fit([found[k] for k in some], y[some], (len(clean), len(toxic))))
    untold = of(toxicity.fit([found[k] for k in some], y[some]))
    assert abs(told - full) < abs(untold - full)


def test_scores(spark):
    rows = toxic_rows(1500, 2)
    docs = spark.createDataFrame([(k, t, "own") for k, t, _ in rows] + [(None, None, ""), (9000, "", ""), (9000, "", "")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(k, y) for k, _, y in rows] + [(None, 1), (1, None)], "doc_id long, toxic int")
    machine = toxicity.train(docs, labels)
    got = toxicity.score(docs, machine).select("doc_id", "score").collect()
    assert len(got) == 1503 and all(0 <= r.score <= 1 for r in got)
    held = {k: y for k, _, y in rows if zlib.crc32(str(k).encode()) % 5 == 0}
    assert np.mean([(r.score >= 0.5) == held[r.doc_id] for r in got if r.doc_id in held]) > 0.9
    assert {r.doc_id for r in docs.where(toxicity.held_out(F.col("doc_id"))).collect()} - {9000} == set(held)
    none = toxicity.train(docs, labels.limit(0))
    assert {r.score for r in toxicity.score(docs, none).collect()} == {0.5}
    assert toxicity.score(docs.limit(0), machine).count() == 0


# ---- licences


def brute_licenses(text, templates, t):
    words = lambda x: re.findall(r"[0-9a-z\x80-\U0010ffff]+", "".join(ch.lower() if ch.isascii() else ch for ch in x))
    lines = [words(x) for x in (text or "").split("\n")]
    out = {}
    for name, template in templates.items():
        b = license_scan.bigrams(words(template))
        for i in range(len(lines)):
            for j in range(i, len(lines)):
                if lines[i] and lines[j]:
                    d = license_scan.dice(license_scan.bigrams([w for x in lines[i : j + 1] for w in x]), b)
                    if d >= t and d > out.get(name, (0,))[0]:
                        out[name] = (d, i, j)
    return out


def test_licenses_against_brute_force(spark):
    draw = random.Random(8)
    texts = []
    for _ in range(150):
        lines = []
        for _ in range(draw.randrange(1, 4)):
            w = draw.choice(list(license_scan.TEMPLATES.values())).split()
            for _ in range(draw.choice([0, 1, 2, 4])):
                w[draw.randrange(len(w))] = "the"
            k = draw.randrange(len(w) + 1)
            lines += ["some other words here", " ".join(w[:k]), " ".join(w[k:])] if draw.random() < 0.5 else [" ".join(w)]
        texts.append("\n".join(lines))
    texts += [None, "", "MIT", "word " * 50_000 + "\nReleased under the MIT License."]
    docs = spark.createDataFrame([(k, t, 1) for k, t in enumerate(texts)], "doc_id long, text string, matches int")
    got = {r.doc_id: {m.license: (m.dice, m.first_line, m.last_line) for m in r.matches} for r in license_scan.scan_licenses(docs).collect()}
    want = {k: brute_licenses(t, license_scan.TEMPLATES, 0.8) for k, t in enumerate(texts)}
    assert got == want and sum(map(len, want.values())) > 150
    many = "\n".join(["the"] * 200_000 + ["Released under the MIT License."])
    (m,) = license_scan.scan_licenses(spark.createDataFrame([(1, many)], DOCS)).first().matches
    assert (m.license, m.first_line) == ("mit", 200_000)
    assert license_scan.scan_licenses(docs.limit(0)).count() == 0


# ---- token counts

CHANGES = token_counts.CHANGES


def test_rollup(spark, tmp_path):
    r = token_counts.TokenRollup(spark, str(tmp_path / "r"))
    put = lambda name, *rows: r.commit(name, spark.createDataFrame(list(rows), CHANGES))
    totals = lambda: {(x.source, x.lang, x.tokenizer_version): (x.n_docs, x.n_tokens) for x in r.totals().collect()}
    assert totals() == {} and r.current().count() == 0
    assert put("1", (1, "a", "en", "v", 10, "insert"), (2, "a", None, "v", 5, "insert"), (3, None, "en", "v", None, "insert"), (None, "a", "en", "v", 7, "insert"), (4, "a", "en", "v", 1, "odd"))
    first = {("a", "en", "v"): (1, 10), ("a", None, "v"): (1, 5), (None, "en", "v"): (1, 0)}
    assert totals() == first
    assert not put("1", (9, "a", "en", "v", 99, "insert")) and totals() == first
    assert put("2", (1, "b", "en", "v", 12, "revise"), (2, "a", None, "v", 0, "delete"), (8, "a", "en", "v", 1, "delete"), (5, "a", "en", "w", 2, "revise"), (5, "a", "en", "w", 2, "revise"))
    assert totals() == {("b", "en", "v"): (1, 12), (None, "en", "v"): (1, 0), ("a", "en", "w"): (1, 2)}
    assert r.batches() == ["1", "2"] and r.current().count() == 3
    # What an attempt left that was cut off before its entry is never read.
    spark.createDataFrame([(1,)], "x int").write.parquet(str(tmp_path / "r/ledger/cut off"))
    (tmp_path / "r/log/_half").write_text("{")
    assert put("3", (1, "b", "en", "v", 0, "delete")) and ("b", "en", "v") not in totals()
    assert put("4") and len(totals()) == 2
    # Compacted, all is as before, and names are remembered.
    before, held = totals(), sorted(r.current().collect(), key=repr)
    assert r.compact() and totals() == before and sorted(r.current().collect(), key=repr) == held and r.batches() == ["1", "2", "3", "4"]
    assert not put("2", (1, "b", "en", "v", 12, "insert")) and put("5", (5, "a", "en", "w", 0, "delete")) and ("a", "en", "w") not in totals()
    # A writer that another one overtakes starts again: both batches count, and the same batch counts once.
    late = token_counts.TokenRollup(spark, str(tmp_path / "r"))
    write = late._write

    def overtaken(signed):
        late._write = write
        assert put("6", (70, "z", "en", "v", 4, "insert"))
        return write(signed)

    late._write = overtaken
    assert late.commit("7", spark.createDataFrame([(70, "z", "en", "v", 9, "insert")], CHANGES)) and totals()["z", "en", "v"] == (1, 9)
    late._write = lambda signed: (setattr(late, "_write", write), put("8", (71, "z", "en", "v", 1, "insert")), write(signed))[2]
    assert not late.commit("8", spark.createDataFrame([(71, "z", "en", "v", 1, "insert")], CHANGES)) and totals()["z", "en", "v"] == (2, 10)


def test_token_counts_against_brute_force(spark, tmp_path):
    import base64

    import tiktoken

    draw = random.Random(14)
    texts = [" ".join(draw.choice(["Über", "the", "naïve", "3.14", "\tx", "word\u00a0s"]) for _ in range(draw.randrange(30))) for _ in range(60)] + [None, ""]
    docs = [(k, draw.choice(texts), draw.choice(["en", "de", None]), draw.choice(["a", "b", None])) for k in range(150)] + [(None, "no id", "en", "a")]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(token_counts.TOKENIZER, "rb"))}
    bpe = tiktoken.Encoding("x", pat_str=token_counts.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want: dict = {}
    for d, t, lang, source in docs:
        if d is not None and not any((u or "") == (t or "") and e is not None and e < d for e, u, *_ in docs):
            for version, n in (("words-1", len((t or "").encode().split())), ("subwords-1", len(bpe.encode_ordinary(t or "")))):
                a, b = want.get((source, lang, version), (0, 0))
                want[source, lang, version] = (a + 1, b + n)
    got = {(r.source, r.lang, r.tokenizer_version): (r.n_docs, r.n_tokens) for r in token_counts.op8_token_counts(spark, str(tmp_path)).collect()}
    assert got == want


def test_subwords(spark):
    import base64

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(token_counts.TOKENIZER, "rb"))}
    bpe = tiktoken.Encoding("x", pat_str=token_counts.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = ["Hello, wörld! it's 3.14\n\n  x", "", None, "ünï   tab\tend  ", "a" * 3000]
    got = token_counts.subword_counts(spark.createDataFrame(list(enumerate(texts)), DOCS)).collect()
    assert {r.doc_id: r.n_tokens for r in got} == {k: len(bpe.encode_ordinary(t or "")) for k, t in enumerate(texts)}


# ---- language model


def test_gradients():
    rng = np.random.default_rng(1)
    p = {k: v.astype(np.float64) for k, v in attention_lm.start(12, 5).items()}
    p["out"] *= 20
    pairs, class_of = rng.normal(size=(12, 5)), rng.integers(0, 5, 12)
    row = rng.integers(0, 12, 70)
    begin, scored, context = attention_lm.windows(np.array([50, 1, 19]))
    seg = attention_lm.segments(row, 11)[begin]
    told = np.arange(attention_lm.SCORED)[None, :] < scored[:, None]
    loss = lambda: -attention_lm.log_probabilities(p, seg, context, pairs + p["out_bias"], class_of)[told].mean()
    g = attention_lm.gradients(p, seg, context, scored, pairs, class_of)
    for k in p:
        flat = p[k].reshape(-1)
        for i in rng.choice(len(flat), 4, replace=False):
            old, h = flat[i], 1e-5
            flat[i] = old + h
            up = loss()
            flat[i] = old - h
            down = loss()
            flat[i] = old
            assert abs((up - down) / (2 * h) - g[k].reshape(-1)[i]) < 1e-4, k


def naive_score(model, text):
    """One subword at a time: what it may see is the rest of its window before it."""
    p, total = {k: v.astype(float) for k, v in model.parameters.items()}, 0.0
    symbols = [model.end_group, *model.group_of[text].tolist()]  # before the first, an end
    for i in range(len(text)):
        begin = i - i % attention_lm.SCORED
        see = range(max(0, begin - attention_lm.CONTEXT), i + 1)
        states = [p["embed"][symbols[j]] + p["place"][attention_lm.CONTEXT + j - begin] for j in see]
        own = states[-1]
        weights = np.exp([own @ p["relate"] @ x / np.sqrt(len(own)) for x in states])
        seen = sum(w * x for w, x in zip(weights, states)) / weights.sum()
        r = own + seen @ p["carry"]
        z = r + np.maximum(0, r @ p["up"] + p["up_bias"]) @ p["down"]
        logits = z @ p["out"] + p["out_bias"] + model.pairs[symbols[i]]
        target = symbols[i + 1]
        total += logits[model.class_of[target]] - np.log(np.exp(logits).sum()) + model.within[symbols[i], target] + model.inside[text[i]]
    return total / np.log(10)


def test_scores_against_a_naive_forward_pass():
    model, rng = small_model(), np.random.default_rng(8)
    for v in model.parameters.values():
        v += rng.normal(0, 0.4, v.shape).astype(np.float32)
    texts = [np.append(rng.integers(0, 6, n), 6) for n in (0, 1, 7, 23, 24, 25, 32, 80)]
    got = model.score(np.concatenate(texts), np.array([len(t) for t in texts]), batch=3)
    assert np.allclose(got, [naive_score(model, t) for t in texts], rtol=1e-4, atol=1e-4)


def test_the_network_decides_inside_classes():
    # c or d, which share a class, follow x; which one, only the group before x tells: pair counts say half and half.
    a, b, c, d, x, end = range(6)
    draw = random.Random(5)
    texts = [np.array([k for _ in range(12) for k in draw.choice(([a, x, c], [b, x, d]))] + [end]) for _ in range(200)]
    row, sizes = np.concatenate(texts), np.array([len(t) for t in texts])
    before = np.concatenate([[end], row[:-1]])
    model = attention_lm.Model(np.bincount(row, minlength=6).astype(float), (before, row, np.ones(len(row))), groups=7, classes=3, clusters=2)
    # Both in one class, whatever the frequencies.
    group = model.group_of
    model.class_of = np.full(7, 2, np.int32)
    model.class_of[group[[c, d]]] = 1
    model.class_of[group[[a, b, x, end]]] = 0
    member = np.eye(3)[model.class_of]
    said = np.full((7, 7), 0.1)
    np.add.at(said, (group[before], group[row]), 1)
    said /= said.sum(1, keepdims=True)
    model.pairs = np.log(said @ member).astype(np.float32)
    model.within = (np.log(said) - np.log(said @ member)[:, model.class_of]).astype(np.float32)
    model.members = attention_lm.Members(model.within, model.class_of)
    begin, scored, context = attention_lm.windows(sizes)
    cut = attention_lm.segments(group[row], model.end_group)
    batches = [(cut[begin[k : k + 64]], context[k : k + 64], scored[k : k + 64]) for k in range(0, len(begin), 64)]
    learner = attention_lm.Learner(model, 0.03)
    for k in range(30):
        learner.learn(batches, k)
    model.pick = learner.p.pop("pick")
    model.parameters = learner.p
    right, wrong = (model.score(np.array([a, x, k, end]), np.array([4]))[0] for k in (c, d))
    assert right > wrong + 1
    right, wrong = (model.score(np.array([b, x, k, end]), np.array([4]))[0] for k in (d, c))
    assert right > wrong + 1


def test_gradients_and_scores_inside_classes():
    rng = np.random.default_rng(6)
    model = small_model()
    assert (model.members.size > 1).any()
    p = {k: v.astype(np.float64) + rng.normal(0, 0.3, v.shape) for k, v in model.learned().items()}
    row = rng.integers(0, 5, 70)
    begin, scored, context = attention_lm.windows(np.array([50, 1, 19]))
    seg = attention_lm.segments(row, model.end_group)[begin]
    told = np.arange(attention_lm.SCORED)[None, :] < scored[:, None]
    pairs, members = model.pairs.astype(np.float64), model.members
    loss = lambda: -attention_lm.log_probabilities(p, seg, context, pairs + p["out_bias"], model.class_of, members=members)[told].mean()
    g = attention_lm.gradients(p, seg, context, scored, pairs, model.class_of, members)
    for k in p:
        flat = p[k].reshape(-1)
        for i in rng.choice(len(flat), 4, replace=False):
            old, h = flat[i], 1e-5
            flat[i] = old + h
            up = loss()
            flat[i] = old - h
            down = loss()
            flat[i] = old
            assert abs((up - down) / (2 * h) - g[k].reshape(-1)[i]) < 1e-4, k
    # Over all groups that can come first, the probabilities sum to one; so they do where logits are large.
    model.parameters = {k: p[k].astype(np.float32) for k in model.parameters}
    for scale in (1, 400):
        model.pick = (scale * p["pick"]).astype(np.float32)
        first = []
        for k in range(7):
            seg = attention_lm.segments(model.group_of[np.array([k, 6])], model.end_group)[:1]
            told = model.pairs + model.parameters["out_bias"]
            first.append(attention_lm.log_probabilities(model.learned(), seg, np.array([0]), told, model.class_of, members=model.members)[0, 0] + model.inside[k])
        assert abs(np.exp(first).sum() - 1) < 1e-5
        assert abs(model.score(np.array([6]), np.array([1]))[0] * np.log(10) - first[6]) < 1e-4


def test_gradients_of_any_order_of_classes_and_of_large_scores():
    # Classes of one group stand between those of several; the attention's exponentials are small, then beyond 1e20.
    rng = np.random.default_rng(11)
    model = small_model()
    class_of = np.array([2, 0, 2, 1, 3])
    members = attention_lm.Members(model.within, class_of)
    row = rng.integers(0, 5, 60)
    begin, scored, context = attention_lm.windows(np.array([41, 19]))
    seg = attention_lm.segments(row, model.end_group)[begin]
    told, pairs = np.arange(attention_lm.SCORED)[None, :] < scored[:, None], model.pairs.astype(np.float64)
    for scale in (1, 150):
        p = {k: v.astype(np.float64) + rng.normal(0, 0.3, v.shape) for k, v in model.learned().items()}
        p["embed"] += 1
        p["relate"] = scale * np.eye(len(p["relate"])) / 10 + p["relate"] / 10
        sums = attention_lm._attend(p, seg[:, :-1], context)[1][4]
        assert (sums.max() > 1e20) == (scale > 1)
        loss = lambda: -attention_lm.log_probabilities(p, seg, context, pairs + p["out_bias"], class_of, members=members)[told].mean()  # noqa: E731, B023
        g = attention_lm.gradients(p, seg, context, scored, pairs, class_of, members)
        for k in p:
            flat = p[k].reshape(-1)
            for i in rng.choice(len(flat), 4, replace=False):
                old, h = flat[i], 1e-6
                flat[i] = old + h
                up = loss()
                flat[i] = old - h
                down = loss()
                flat[i] = old
                assert abs((up - down) / (2 * h) - g[k].reshape(-1)[i]) < 1e-4, (k, scale)


def test_the_plain_pattern_cuts_words_alike():
    # Words with white space outside ASCII are left to the whole pattern, as are those beside them.
    with open(token_counts.TOKENIZER, "rb") as f:
        v = attention_lm.Vocabulary(f.read())
    draw = random.Random(12)
    plain = ["".join(draw.choice("aZé'stll1²!-—漢😀\x1c\x1f\u200b\u0301") for _ in range(draw.randrange(1, 12))) for _ in range(2500)]
    spaces = [chr(k) for k in range(0x80, 0x3001) if chr(k).isspace()]
    assert all(attention_lm._SPACES.search(c) for c in spaces) and not attention_lm._SPACES.search("".join(plain))
    for words in (plain, [w + c + draw.choice(spaces) + w for w, c in zip(plain, spaces)], [*plain, spaces[0], *spaces]):
        pieces, lengths = v._pieces([w.encode() for w in words])
        want = [v.encode(" " + w) for w in words]
        assert pieces.tolist() == [p for x in want for p in x] and lengths.tolist() == list(map(len, want))
    assert attention_lm._strings(pa.array(["a", "", "é b", "c"]).slice(1)) == [b"", "é b".encode(), b"c"] and attention_lm._strings(pa.array([], pa.string())) == []


def test_vocabulary_reads_words_as_one_by_one():
    with open(token_counts.TOKENIZER, "rb") as f:
        v = attention_lm.Vocabulary(f.read())
    draw = random.Random(3)
    texts = [" ".join("".join(draw.choice("abcÉ'1!-—ßя漢😀") for _ in range(draw.randrange(1, 9))) for _ in range(400)) for _ in range(6)]
    texts += ["x\u00a0 \u00a0y \u2003 z\u3000 \u00a0", "", "  a  ", None, " \t\n\x0b\x0c\r", "\x1c\x1f\x85 b"]
    got = v.read(pa.array(texts, pa.string()))
    chunk = attention_lm.Chunk(**got)
    pieces, counts = chunk.subwords(v.end)
    words = [(t or "").encode().lower().split() for t in texts]
    want = [[p for w in x for p in v.encode(" " + w.decode())] + [v.end] for x in words]
    assert pieces.tolist() == [p for x in want for p in x] and counts.tolist() == [len(x) for x in want]
    assert got["sizes"].tolist() == list(map(len, words)) and len(got["hashes"]) == len({w for x in words for w in x})
    assert [len(attention_lm.Chunk(**v.read(pa.array(x, pa.string()))).subwords(v.end)[0]) for x in ([], ["", None])] == [0, 2]


def test_windows_score_each_token_once():
    sizes = np.array([1, 31, 32, 33, 100])
    begin, scored, context = attention_lm.windows(sizes)
    places = [p for b, n in zip(begin, scored) for p in range(b, b + n)]
    assert sorted(places) == list(range(sizes.sum())) and context.max() == attention_lm.CONTEXT
    # What stands before a text does not matter for it, and what comes later never does.
    model = small_model()
    a, b = np.array([0, 1, 2, 6]), np.array([3, 3, 6])
    both = model.score(np.concatenate([b, a]), np.array([3, 4]))
    assert np.allclose(both, [model.score(b, np.array([3]))[0], model.score(a, np.array([4]))[0]], atol=1e-5)


def test_probabilities_sum_to_one():
    model = small_model()
    # The texts of one subword and those of none, with whatever follows: all that can come first.
    first = []
    for k in range(7):
        seg = attention_lm.segments(model.group_of[np.array([k, 6])], model.end_group)[:1]
        p = attention_lm.log_probabilities(model.parameters, seg, np.array([0]), model.pairs + model.parameters["out_bias"], model.class_of)[0, 0]
        first.append(p + model.within[model.end_group, model.group_of[k]] + model.inside[k])
    assert abs(np.exp(first).sum() - 1) < 1e-5
    alone = model.score(np.array([6]), np.array([1]))[0]
    assert abs(10**alone - np.exp(first[6])) < 1e-6


def small_model():
    rng = np.random.default_rng(2)
    pairs = rng.integers(0, 7, (2, 60))
    return attention_lm.Model(np.array([5.0, 9, 3, 2, 1, 4, 7]), (*pairs, np.ones(60)), groups=5, classes=4, clusters=2)


def test_scores_against_counts(spark):
    draw = random.Random(4)
    chain = {w: draw.sample("alpha beta gamma delta epsilon zeta eta theta".split(), 2) for w in "alpha beta gamma delta epsilon zeta eta theta".split()}
    docs = []
    for k in range(800):
        w = ["alpha"]
        for _ in range(draw.randrange(60)):
            w.append(draw.choice(chain[w[-1]]))
        docs.append((k, " ".join(w).title() + (" odd" + str(k) if k % 50 == 0 else "")))
    docs += [(5000, None), (5001, ""), (None, "alpha beta"), (7, docs[7][1])]
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, score int")
    got = attention_lm.score_texts(df, common=5).collect()
    assert len(got) == len(docs)
    train = [t or "" for d, t in docs if d is not None and zlib.crc32(str(d).encode()) % 5 != 1]
    counts: dict = {}
    for t in train:
        for w in [*t.lower().split(), None]:
            counts[w] = counts.get(w, 0) + 1
    n, v = sum(counts.values()), len(counts)
    text = dict(docs)
    for r in got:
        w = [*(text[r.doc_id] or "").lower().split(), None]
        assert (r.n_tokens, r.train_tokens, r.n_known) == (len(w), n, sum(x in counts for x in w))
        assert abs(r.base_score - sum(np.log10((counts.get(x, 0) + 0.5) / (n + 0.5 * (v + 1))) for x in w)) < 1e-6
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 1)
    held = [r for r in got if r.held_out and r.n_tokens > 5]
    assert sum(r.score for r in held) > 0.75 * sum(r.base_score for r in held)
    empty = attention_lm.score_texts(df.limit(0))
    assert empty.count() == 0
    alone = attention_lm.score_texts(df.where("doc_id = 5001"), parts=1, part=0).first()
    assert (alone.held_out, alone.n_known, alone.train_tokens, alone.base_score) == (True, 0, 0, 0.0)


def test_every_window_is_learned_from(spark):
    texts = [" ".join(f"word{k % 7}" for k in range(n)) for n in (1, 3, 40, 150, 700, 5000)] + [None, "held out", "without id"]
    parts = [0] * 7 + [1, 2]
    with open(token_counts.TOKENIZER, "rb") as f:
        ranks = spark.sparkContext.broadcast(f.read())
    rows = [(None if p == 2 else k, t, p) for k, (t, p) in enumerate(zip(texts, parts))]
    read = attention_lm.read_texts(spark.createDataFrame(rows, "doc_id long, text string, part byte").coalesce(1), ranks)
    columns = list(attention_lm._CHUNK)
    table = read.where("kind = 2").select(*columns).toArrow().to_batches()
    (chunk,) = attention_lm.chunks_of(table)
    assert chunk.ids[~chunk.nulls].tolist() == list(range(8)) and chunk.parts.tolist() == parts
    vocabulary = attention_lm.Vocabulary(ranks.value)
    pieces, sizes = attention_lm.Chunk(**vocabulary.read(pa.array(texts, pa.string()))).subwords(vocabulary.end)
    got = chunk.subwords(vocabulary.end)
    assert got[0].tolist() == pieces.tolist() and got[1].tolist() == sizes.tolist()
    model = attention_lm.Model(np.ones(vocabulary.size), (np.zeros(1, int), np.zeros(1, int), np.ones(1)))
    begin, scored, _ = attention_lm.windows(sizes[:7])
    cut = attention_lm.segments(model.group_of[pieces], model.end_group)
    # What stands behind a window's text is another one's, and nothing sees it.
    own = lambda seg, n: [x[: attention_lm.CONTEXT + 1 + k] for x, k in zip(seg.tolist(), n.tolist())]
    want = sorted(own(cut[begin], scored))
    rounds = [attention_lm.batches_of(chunk, model, number, 3) for number in range(3)]
    assert sorted(w for r in rounds for seg, _, n in r for w in own(seg, n)) == want and all(rounds)
    assert sum(int(n.sum()) for r in rounds for _, _, n in r) == sizes[:7].sum()
    weights = [next(attention_lm.local_steps(table, model, number, 2)).column("w")[0].as_py() for number in range(2)]
    assert sum(weights) == len(begin)
    counts = {(r.kind, r.key): r.n for r in read.where("kind in (0, 1)").collect()}
    assert counts[0, attention_lm.END_WORD] == 7 and sum(n for (k, _), n in counts.items() if k == 1) == sizes[:7].sum()


# ---- pipeline


def test_pipeline(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    draw = random.Random(12)
    words = [f"w{k}" for k in range(2000)]
    say = lambda n: " ".join(draw.choice(words) for _ in range(n))
    item = say(20)
    docs, labels = [], []
    for k in range(700):
        toxic = k % 4 == 0
        docs.append((k, say(60) + (" insult group" if toxic else ""), "en", f"s{k % 3}", 0))
        labels.append((k, 1, int(toxic)))
    line = say(60)
    docs += [(1001, say(30) + "\n" + line, "en", "s0", 0), (1002, say(30) + "\n" + line, "en", "s1", 0), (1003, say(30) + "\n" + item + "\n" + say(30), "en", "s0", 0)]
    near = say(200).split()
    docs += [(1004, " ".join(near), "en", "s2", 0), (1005, " ".join(["new", "other", *near]), "en", "s2", 0), (1006, None, "en", None, 0), (None, "", None, "s1", None)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = []
    for number, (name, stage) in enumerate(pipeline.STAGES):
        out = stage(spark, now, str(tmp_path))
        out.write.parquet(f"{tmp_path}/stage{number}")
        out = spark.read.parquet(f"{tmp_path}/stage{number}")
        assert name == "mixing" or out.columns == now.columns
        kept.append({r.doc_id: r.text for r in out.collect()})
        now = out
    toxic = {k for k, _, y in labels if y}
    assert len(toxic & set(kept[0])) <= 3 and len(set(range(700)) - toxic - set(kept[0])) <= 3
    assert line in kept[1][1001] and line not in kept[1][1002] and len(kept[1]) == len(kept[0])
    assert 1004 in kept[2] and 1005 not in kept[2] and len(kept[2]) == len(kept[1]) - 1
    assert item not in kept[3][1003] and len(kept[3]) == len(kept[2])
    assert pipeline.run(spark, str(tmp_path)).count() == now.count()
