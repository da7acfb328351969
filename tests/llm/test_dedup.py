"""Line dedup, Jaccard join and embedding dedup against brute force, and on unusual tables."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tallymark.llm import common, embedding_dedup, jaccard_join, line_dedup

DOCS = "doc_id long, text string"


def components(n, links):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return [find(x) for x in range(n)]


# ---- connected components


def test_components(spark):
    draw = random.Random(3)
    edges = [(draw.randrange(300), draw.randrange(300)) for _ in range(170)] + [(k, k + 1) for k in range(1000, 1060)] + [(5, 5), (None, 1), (7, None)]
    got = {r.id: r.component for r in common.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    real = [(a, b) for a, b in edges if a is not None and b is not None]
    want = components(1100, real)
    touched = {x for a, b in real if a != b for x in (a, b)}
    assert got == {x: want[x] for x in touched}
    assert common.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_of_few_edges_are_few_files(spark, monkeypatch):
    files = []
    monkeypatch.setattr(common, "save", lambda df, keep=common.save: (files.append(len((t := keep(df)).inputFiles())), t)[1])
    monkeypatch.setattr(common, "TASKS", 3)
    settings = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    kept = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        edges = spark.createDataFrame([(k, k + 1) for k in range(200) if k % 5], "a long, b long")
        got = {r.id: r.component for r in common.connected_components(edges).collect()}
        few = files[1:]
        monkeypatch.setattr(common, "ROWS", 10)  # many edges get more tasks
        files.clear()
        assert {r.id: r.component for r in common.connected_components(edges).collect()} == got
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    assert got == {k: (k - 1) // 5 * 5 + 1 for k in range(1, 201)}
    assert few and max(few) <= 3
    assert max(files[1:]) > 3


# ---- line dedup


def same_line(a, b, near=10):
    if a == b:
        return True
    if min(len(a), len(b)) < near or abs(len(a) - len(b)) > 1:
        return False
    k = 0
    while k < min(len(a), len(b)) and a[k] == b[k]:
        k += 1
    if len(a) == len(b):
        return a[k + 1 :] == b[k + 1 :]
    a, b = (a, b) if len(a) > len(b) else (b, a)
    return a[k + 1 :] == b[k:]


def brute_lines(docs, least=4):
    places = [((d, i), x.split()) for d, t in docs for i, x in enumerate((t or "").split("\n"))]
    places = sorted([p for p in places if len(p[1]) >= least], key=lambda p: (p[0][0] is not None, p[0]))
    return {at: next(o for o, x in places[:k] if same_line(x, w)) for k, (at, w) in enumerate(places) if any(same_line(x, w) for _, x in places[:k])}


def lines_of(df):
    return {(r.doc_id, r.line_no): (r.first_doc_id, r.first_line_no) for r in df.collect()}


def test_lines_against_brute_force(spark):
    draw = random.Random(5)
    base = [[draw.choice("abcdefghij") * draw.randrange(1, 4) for _ in range(draw.choice([3, 4, 9, 10, 11, 14, 15, 30]))] for _ in range(25)]

    def edit(w):
        w = list(w)
        for _ in range(draw.choice([0, 0, 1, 1, 1, 2])):
            k = draw.randrange(len(w) + 1)
            draw.choice([lambda: w.insert(k, "new"), lambda: w.pop(min(k, len(w) - 1)) if len(w) > 1 else None, lambda: w.__setitem__(min(k, len(w) - 1), "sub")])()
        return draw.choice([" ", " ", "  ", "\t"]).join(w)

    docs = [(d, "\n".join(edit(draw.choice(base)) for _ in range(draw.randrange(6)))) for d in range(120)]
    got = lines_of(line_dedup.repeated_lines(spark.createDataFrame(docs, DOCS)))
    assert got == brute_lines(docs) and len(got) > 100


def test_lines_keep_the_rest(spark):
    a, b = "one two three four five six seven eight nine ten", "one two three four five six seven eight nine changed"
    docs = spark.createDataFrame([(1, f"{a}\nshort\nkept for good here", 9, "x"), (2, f"{b}\nshort\nother words stay here", 9, "y"), (3, None, 9, "z"), (4, "", 9, "z"), (5, a, 9, "z")], "doc_id long, text string, n_removed int, line string")
    got = {r.doc_id: r for r in line_dedup.dedup_lines(docs).collect()}
    assert got[1].text == f"{a}\nshort\nkept for good here" and got[2].text == "short\nother words stay here" and got[3].text is None and got[4].text == "" and got[5].text == ""
    assert (got[2].n_lines, got[2].n_removed, got[3].n_lines, got[5].line) == (3, 1, 0, "z")


def test_lines_of_repeated_and_null_ids(spark):
    draw = random.Random(15)
    base = [" ".join(draw.choice("abcdefghij") for _ in range(12)) for _ in range(14)]

    def text():
        lines = []
        for _ in range(draw.randrange(6)):
            w = draw.choice(base).split()
            if draw.random() < 0.4:
                w[draw.randrange(12)] = "x" + str(draw.randrange(3))
            lines.append(" ".join(w) if draw.random() < 0.9 else "short")
        return "\n".join(lines)

    rows = [(draw.choice([None, None, 1, 2, 2, 3, *range(10, 60)]), text()) for _ in range(110)]
    rows += rows[:25] + [(2, None), (None, None), (None, ""), (70, ""), (70, "")]
    rows = [(*r, k, 5, 6, 7) for k, r in enumerate(rows)]
    df = spark.createDataFrame(rows, f"{DOCS}, _gone int, _mark int, _of int, N_Lines int").repartition(5)
    marks = {(r.doc_id, r.text): r.m for r in line_dedup._marked(df.select("doc_id", "text"), "m").collect()}
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, marks[r[:2]]))
    seen, want, gone = [], [], 0
    for d, t, *_ in order:
        kept = []
        for line in (t or "").split("\n"):
            w = line.split()
            if len(w) >= 4 and any(same_line(x, w) for x in seen):
                gone += 1
            else:
                kept.append(line)
            if len(w) >= 4:
                seen.append(w)
        want.append((d, None if t is None else "\n".join(kept)))
    out = line_dedup.dedup_lines(df).collect()
    key = lambda rs: sorted(rs, key=repr)
    assert key((r.doc_id, r.text) for r in out) == key(want) and gone > 150
    assert sum(r.n_removed for r in out) == gone == sum(r.n_rows for r in line_dedup.repeated_lines(df).collect())
    assert sorted(r._gone for r in out) == list(range(len(rows))) and out[0]._mark == 5 and out[0]._of == 6


def test_lines_far_more_than_a_sum_could_hold(spark):
    w = [f"w{k}" for k in range(150_000)]
    docs = [(1, " ".join(w)), (2, " ".join([*w[:70_000], "new", *w[70_000:]])), (3, "\n".join(f"line {k % 30_000}" for k in range(60_000)))]
    got = lines_of(line_dedup.repeated_lines(spark.createDataFrame(docs, DOCS), min_words=1))
    assert got == {(2, 0): (1, 0), **{(3, k): (3, k - 30_000) for k in range(30_000, 60_000)}}
    out = {r.doc_id: r.text for r in line_dedup.dedup_lines(spark.createDataFrame(docs[2:], DOCS), min_words=1).collect()}
    assert out == {3: "\n".join(f"line {k}" for k in range(30_000))}


def test_lines_unusual(spark):
    long = " ".join(f"w{k}" for k in range(20_000))
    docs = [(None, "a b c d e"), (1, "a b c d e"), (1, "a b c d e"), (2, long), (3, long.replace("w777 ", "")), (4, "\n\n \n")]
    got = lines_of(line_dedup.repeated_lines(spark.createDataFrame(docs, DOCS)))
    assert got == {(1, 0): (None, 0), (3, 0): (2, 0)}
    assert line_dedup.repeated_lines(spark.createDataFrame([], DOCS)).count() == 0


def test_short_lines_in_query_and_pipeline(spark, tmp_path):
    docs = [(1, "All rights reserved.\n}\nheld once"), (2, "All  rights reserved.\n\n}\n }"), (3, "\nreserved.")]
    df = spark.createDataFrame(docs, DOCS)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    assert lines_of(line_dedup.op5_line_dedup(spark, str(tmp_path))) == brute_lines(docs, 1) == {(2, 0): (1, 0), (2, 2): (1, 1), (2, 3): (1, 1)}
    got = {r.doc_id: r.text for r in corpus_pipeline.drop_repeated_lines(spark, df, str(tmp_path)).collect()}
    assert got == {1: docs[0][1], 2: "", 3: docs[2][1]}


# ---- Jaccard join


def sets_of(docs, size):
    out = []
    for _, t in docs:
        w = (t or "").encode().lower().split()
        out.append({tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set())
    return out


def brute_groups(docs, size=4, percent=85):
    sets = sets_of(docs, size)
    links = [(i, j) for i, j in itertools.combinations(range(len(docs)), 2) if sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
    root = components(len(docs), links)
    ids = [d for d, _ in docs]
    least = {}
    for k, r in enumerate(root):
        least[r] = min(least.get(r, math.inf), ids[k])
    return {(d, len(sets[k])): least[root[k]] for k, (d, _) in enumerate(docs)}


def near_copies(seed, groups, size, words=200, edits=(0, 1, 2, 5, 9)):
    draw = random.Random(seed)
    vocabulary = [f"v{k}" for k in range(3000)]
    passage = [draw.choice(vocabulary) for _ in range(40)]
    texts = []
    for _ in range(groups):
        base = [draw.choice(vocabulary) for _ in range(draw.randrange(5, words))]
        if draw.random() < 0.5:
            base[3:3] = passage
        for _ in range(draw.randrange(1, size)):
            w = list(base)
            for _ in range(draw.choice(edits)):
                w[draw.randrange(len(w))] = draw.choice(vocabulary)
            texts.append(" ".join(w))
    draw.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("long_, block", [(48, 2000), (3, 2000), (3, 7), (1000, 5)])
def test_jaccard_against_brute_force(spark, long_, block):
    docs = near_copies(11, 30, 9) + [(1000, "one two"), (1001, "One  two"), (1002, ""), (1003, "a b c d"), (1004, "A B C D")]
    got = jaccard_join.jaccard_groups(spark.createDataFrame(docs, DOCS), long_=long_, block=block).collect()
    want = brute_groups(docs)
    assert {(r.doc_id, r.n_shingles): r.component_id for r in got} == want
    assert len(set(want.values())) < len(want) - 30


def test_jaccard_large_group_of_near_copies(spark):
    docs = near_copies(2, 1, 2) + [(k + 10, t) for k, t in near_copies(4, 2, 250, words=120, edits=(0, 1, 2, 3))]
    got = jaccard_join.jaccard_groups(spark.createDataFrame(docs, DOCS), block=40).collect()
    assert {(r.doc_id, r.n_shingles): r.component_id for r in got} == brute_groups(docs)


def test_jaccard_of_a_common_passage(spark):
    # Most of every text is one passage, far more texts than a list may have; only some are near copies besides.
    draw = random.Random(31)
    passage = " ".join(f"p{draw.randrange(10**6)}" for _ in range(70))
    docs = []
    for k in range(120):
        own = [f"o{draw.randrange(10**6)}" for _ in range(draw.randrange(25, 60))]
        docs += [passage + " " + " ".join(own[:n]) for n in {len(own), max(1, len(own) - draw.randrange(3))}]
    docs += [passage, passage + " end", passage + " other end"]
    docs = list(enumerate(docs))
    df = spark.createDataFrame(docs, DOCS)
    got = jaccard_join.jaccard_groups(df, long_=10, block=25).collect()
    want = brute_groups(docs)
    assert {(r.doc_id, r.n_shingles): r.component_id for r in got} == want and 100 < len(set(want.values())) < len(docs)


def test_link_group_with_what_is_connected():
    docs = near_copies(21, 2, 60, words=80, edits=(0, 1, 2, 3, 6))
    sets = [np.array(sorted(hash(x) & (2**63 - 1) for x in s), np.uint64) for s in sets_of(docs, 4)]
    links = [(i, j) for i, j in itertools.combinations(range(len(sets)), 2) if jaccard_join.linked(len(np.intersect1d(sets[i], sets[j])), len(sets[i]), len(sets[j]), 85)]
    first = next(i for i, _ in links)
    settled = np.array([k == first or (first, k) in links for k in range(len(sets))])
    known = [(first, int(k)) for k in np.flatnonzero(settled)]
    got = jaccard_join.link_group(sets, np.zeros(len(sets)), settled.astype(int), 85, settled) + [
        (a, b) for side in (~settled,) for a, b in links if side[a] and side[b]
    ]
    assert components(len(sets), got + known) == components(len(sets), links)


def test_jaccard_unusual(spark):
    text = "a b c d e f g h"
    rows = [(1, text, 0), (1, text, 0), (None, text, 0), (2, None, 0), (3, " \n", 0), (4, text + " " + " ".join(f"w{k}" for k in range(50_000)), 0)]
    got = jaccard_join.jaccard_groups(spark.createDataFrame(rows, "doc_id long, text string, component_id int")).collect()
    assert sorted((r.doc_id or 0, r.n_shingles, r.component_id) for r in got if r.doc_id) == [(1, 5, 1), (1, 5, 1), (2, 0, 2), (3, 0, 3), (4, 50005, 4)]
    assert [r.component_id for r in got if r.doc_id is None] == [None]
    assert jaccard_join.jaccard_groups(spark.createDataFrame([], DOCS)).count() == 0


def test_keep_one(spark):
    docs = near_copies(8, 12, 6)
    kept = sorted(r.doc_id for r in jaccard_join.keep_one(spark.createDataFrame(docs, DOCS)).collect())
    assert kept == sorted(set(brute_groups(docs, 5, 80).values()))


def test_keep_one_of_repeated_rows(spark):
    draw = random.Random(6)
    x, y, z = (" ".join(draw.choice("abcdefghijklmnopqrstuvwxyz") * draw.randrange(1, 4) for _ in range(60)) for _ in range(3))
    rows = [(1, x, "a")] * 40 + [(2, x, "b"), (3, y, "c"), (3, y, "c"), (3, z, "d"), (4, z + " more", "e"), (None, x, "f"), (None, x, "f"), (6, "", "g"), (6, None, "h"), (7, x + " end", "i"), (7, "apart", "j"), (8, "apart then", "k")]
    df = spark.createDataFrame(rows, f"{DOCS}, note string").withColumns({c: F.lit(1) for c in ("_id", "_mark", "_Row", "_gone", "component_id")})
    got = jaccard_join.keep_one(df.repartition(5)).collect()
    first = min(y, z)
    assert sorted((r.doc_id or 0, r.text or "", r.note) for r in got) == sorted([(0, x, "f"), (0, x, "f"), (1, x, "a"), (3, first, "c" if first == y else "d"), (6, "", "h"), (7, "apart", "j"), (8, "apart then", "k")])


def test_jaccard_one_id_with_two_texts(spark):
    draw = random.Random(7)
    x, y = (" ".join(f"{c}{draw.randrange(500)}" for _ in range(60)) for c in "xy")
    rows = [(5, x), (5, y), (3, x + " end"), (9, y + " end")]
    got = jaccard_join.jaccard_groups(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(3, 3), (5, 3), (5, 5), (9, 5)]


def test_cut_lists():
    draw = np.random.default_rng(4)
    begin = draw.integers(0, 900, 60)
    end = begin + draw.integers(0, 90, 60)
    lists, wanted = draw.integers(0, 50, 1000), draw.random(50) < 0.3
    want = [x.tolist() for x in ([lists[a:b][wanted[lists[a:b]]] for a, b in zip(begin, end)]) if len(x)]
    for most in (1, 70, 1 << 20):
        assert [x.tolist() for x in jaccard_join._cut_lists(lists, begin, end, wanted, most)] == want


def test_divide_skip():
    draw = random.Random(1)
    for _ in range(300):
        lists = [sorted(draw.sample(range(30), draw.randrange(1, 25))) for _ in range(draw.randrange(1, 40))]
        for least in (1, 2, 5, 20):
            want = sorted(y for y in range(30) if sum(y in x for x in lists) >= least)
            assert jaccard_join.divide_skip(lists, least) == want


# ---- embeddings

VECTORS = "vec_id long, embedding array<float>, label int"


def brute_vectors(rows, threshold=0.98):
    ok = [e is not None and len(e) > 0 and None not in e and all(map(math.isfinite, e)) and any(e) and lab is not None for _, e, lab in rows]
    unit = [np.float32(e).astype(float) if good else None for (_, e, _), good in zip(rows, ok)]
    links = []
    for i, j in itertools.combinations(range(len(rows)), 2):
        if ok[i] and ok[j] and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]):
            if unit[i] @ unit[j] / (np.sqrt(unit[i] @ unit[i]) * np.sqrt(unit[j] @ unit[j])) >= threshold:
                links.append((i, j))
    root, count = components(len(rows), links), [0] * len(rows)
    for i, j in links:
        count[i] += 1
        count[j] += 1
    return sorted((rows[k][0], count[k], min(rows[i][0] for i in range(len(rows)) if root[i] == root[k])) for k in range(len(rows)))


def some_vectors(n=400, dim=16, seed=9, spread=0.08):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(40, dim))
    return [(k, [float(x) for x in np.float32(centres[rng.integers(40)] + spread * rng.normal(size=dim))], int(rng.integers(2))) for k in range(n)]


@pytest.mark.parametrize("cell, block", [(16384, 2048), (16384, 37), (20, 64), (20, 9)])
def test_vectors_against_brute_force(spark, cell, block):
    rows = some_vectors()
    rows += [(1000 + k, rows[k][1], rows[k][2]) for k in range(30)] + [(1100, rows[0][1], rows[0][2])]
    got = embedding_dedup.near_duplicates(spark.createDataFrame(rows, VECTORS), cell=cell, block=block).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == brute_vectors(rows)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)


def test_recall_with_a_narrow_margin(spark):
    rows = some_vectors(600)
    got = embedding_dedup.near_duplicates(spark.createDataFrame(rows, VECTORS), cell=30, margin=0.05, epsilon=4.0).collect()
    want = {v: n for v, n, _ in brute_vectors(rows)}
    found = sum(r.n_links for r in got)
    assert all(r.n_links <= want[r.vec_id] for r in got) and found >= 0.9 * sum(want.values()) > 0


def test_vectors_unusual(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [1.0, 0.0], None), (4, None, 1), (5, [], 1), (6, [0.0, -0.0], 1), (7, [nan, 1.0], 1), (8, [inf, 1.0], 1), (9, [1.0], 1), (10, [1.0, None], 1), (None, [1.0, 0.0], 1)]
    extra = "vec_id long, embedding array<float>, label int, component_id string, key string"
    got = embedding_dedup.near_duplicates(spark.createDataFrame([(*r, "x", "y") for r in rows], extra)).collect()
    assert sorted((r.vec_id or 0, r.n_links, r.component_id or 0) for r in got) == sorted([(0, 0, 0), (1, 2, 1), (2, 2, 1), (2, 2, 1)] + [(k, 0, k) for k in range(3, 11)])
    assert embedding_dedup.near_duplicates(spark.createDataFrame([], VECTORS)).count() == 0


@pytest.mark.parametrize("dim", [2, 16, 64, 100, 256])
def test_codes_are_unbiased_and_bounded(dim):
    rng = np.random.default_rng(4)
    unit = lambda x: x / np.sqrt((x * x).sum(1))[:, None]
    u = unit(rng.normal(size=(200, dim)))
    errors = []
    for seed in range(20):
        codes = embedding_dedup.Codes.of(u, embedding_dedup.rotation(dim, seed))
        codes = embedding_dedup.Codes.unpacked(codes.packed(), dim)
        errors.append(codes.estimates(codes) - u @ u.T)
    off = ~np.eye(200, dtype=bool)
    assert dim == 2 or abs(np.mean(errors, axis=0)[off].mean()) < 5e-3
    # Of pairs at the threshold: the certain bound holds for all, the confidence bound too, and with 2 deviations for most.
    v = unit(u + rng.uniform(0.01, 0.2, (200, 1)) / np.sqrt(dim) * rng.normal(size=u.shape))
    turn = embedding_dedup.rotation(dim)
    a, b, exact = embedding_dedup.Codes.of(u, turn), embedding_dedup.Codes.of(v, turn), (u * v).sum(1)
    near = exact >= 0.98
    reach = lambda epsilon: np.diag(a.estimates(b) + a.slack(b, 0.98, epsilon))[near] >= 0.98 - 1e-9
    assert near.sum() > 60 and reach(None).all() and reach(embedding_dedup.EPSILON).all() and reach(2.0).mean() > 0.9
    # Pairs far apart need no recomputation in a space of many dimensions.
    far = (a.estimates(a) + a.slack(a, 0.98, embedding_dedup.EPSILON))[off] >= 0.98
    assert dim < 64 or far.mean() < 0.01


def test_planted_neighbours_in_the_table(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select("vec_id", "embedding", "label").collect()
    rng = np.random.default_rng(12)
    rows = [(r.vec_id, r.embedding, r.label) for r in table]
    for k, (_, e, label) in enumerate(rows[:150]):
        e = np.array(e, float)
        noise = rng.normal(size=len(e))
        near = e + noise * np.sqrt((e * e).sum() / (noise * noise).sum()) * rng.uniform(0.02, 0.25)
        rows.append((10**6 + k, [float(x) for x in np.float32(near)], label))
    df = spark.createDataFrame(rows, table and spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select("vec_id", "embedding", "label").schema)
    got = embedding_dedup.near_duplicates(df).collect()
    want = brute_vectors([(v, list(e) if e is not None else None, label) for v, e, label in rows])
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == want and 60 < sum(n for _, n, _ in want) < 300
