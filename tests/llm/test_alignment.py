"""Alignment of two tokenizers against the tokenizers' own output and a loop over all pairs."""

import collections
import hashlib
import os

import pytest
import sentencepiece
from tokenizers import Tokenizer

from tallymark.llm import token_alignment as ta

pytestmark = pytest.mark.skipif(not os.path.isfile(ta.A_FILE), reason="no vocabularies")
ODD = [
    None, "", " ", "a", "  two  spaces ", "tab\tand\nline \n end\n\n", "x" * 300, "ab " * 200, "naïve café — “quotes” 日本語 テスト 🙂🙂 ok",
    "has ▁ itself", "▁", "<|endoftext|> <s> </s> <unk> <0x41>", "don't I'll we've", "a b  c　d", "nul\0nul \x1c \x1f x", "é ́ ﬁ ①",
    " leading", "trailing ", "1 2  3   4    5", "\r\n\r\n mixed\x0b\x0c\x85 y", "same text", "same text", "   ", "." * 70 + " " + "-" * 33,
]


def brute(texts):
    """Rows as the contract states them, from the tokenizers and a loop over all pairs of tokens."""
    a_tok = Tokenizer.from_file(ta.A_FILE)
    a_tok.encode_special_tokens = True
    b_tok = sentencepiece.SentencePieceProcessor(model_file=ta.B_FILE)
    alphabet = ta._byte_alphabet()
    spelled = {v: bytes(alphabet[c] for c in k) for k, v in a_tok.get_vocab(with_added_tokens=False).items()}

    def piece(i):
        p = b_tok.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if b_tok.is_byte(i) else p.replace("▁", " ").encode()

    rows, linked = [], []
    for t in texts:
        a = a_tok.encode(" " + t, add_special_tokens=False).ids if t else []
        b = b_tok.encode(t) if t else []
        xs, ys = [spelled[i] for i in a], [piece(i) for i in b]
        want = (" " + t).encode() if t else b""
        if b"".join(xs) != want or b"".join(ys) != want:
            a, b, xs, ys = [], [], [], []
        ends = lambda parts: [sum(map(len, parts[: k + 1])) for k in range(len(parts))]
        ea, eb = ends(xs), ends(ys)
        links = [(i, j) for i, e, x in zip(a, ea, xs) for j, f, y in zip(b, eb, ys) if max(e - len(x), f - len(y)) < min(e, f)]
        cuts, groups, low = [e for e in ea if e in set(eb)], [], 0
        for c in cuts:
            groups.append(",".join(str(i) for i, e in zip(a, ea) if low < e <= c) + "|" + ",".join(str(j) for j, f in zip(b, eb) if low < f <= c))
            low = c
        rows.append([len(a), len(b), len(groups), len(links), ";".join(groups)])
        linked.append(links)
    n = collections.Counter(p for links in linked for p in set(links))
    top = collections.defaultdict(int)
    for (a, _), c in n.items():
        top[a] = max(top[a], c)
    for row, links in zip(rows, linked):
        row += [sum(n[p] == top[p[0]] for p in links), sum(n[p] for p in links)]
    return rows


def digest(s):
    return hashlib.sha256(s.encode()).hexdigest() if s else ""


def check(spark, folder, texts):
    rows = [(k, t, "de", "here", 5) for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, `groups` string, `n.a` string, pair int").write.parquet(f"{folder}/documents.parquet")
    got = {r["doc_id"]: r for r in ta.op11_token_alignment(spark, str(folder)).collect()}
    assert len(got) == len(texts)
    for k, (n_a, n_b, n_groups, n_links, groups, n_best, count_sum) in enumerate(brute(texts)):
        r = got[k]
        assert (r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["n_best"], r["count_sum"], r["groups_sha256"]) == (n_a, n_b, n_groups, n_links, n_best, count_sum, digest(groups)), texts[k]


def test_against_brute_force(spark, tmp_path):
    if os.path.isdir("/root/testdata/sf0.001"):
        real = [r["text"][:600] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").limit(60).collect()]
    else:
        real = []
    check(spark, tmp_path, ODD + real)


def test_pairs_beyond_the_broadcast(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ta, "BROADCAST_PAIRS", 3)
    check(spark, tmp_path, ODD)


def test_small_memory_and_chunks(spark):
    a, b = ta.ByteBpe(open(ta.A_FILE, "rb").read()), ta.PieceBpe(open(ta.B_FILE, "rb").read())
    whole = ta.Aligner(a, b).align(ODD)
    aligner, parts = ta.Aligner(a, b), []
    for k in range(0, len(ODD), 5):
        aligner.chars = ta.SEGMENT_CHARS + 1  # forgets before each part
        parts.append(aligner.align(ODD[k : k + 5]))
    for column, pieces in zip(whole, zip(*parts)):
        assert column.to_pylist() == [x for p in pieces for x in p.to_pylist()]


def test_intervals():
    import numpy as np

    first, size, a_closes, b_closes = ta.overlaps(np.array([2, 1, 3]), np.array([1, 2, 1, 2]))
    assert first.tolist() == [0, 1, 2] and size.tolist() == [2, 1, 2]
    assert a_closes.tolist() == [False, True, True] and b_closes.tolist() == [False, True, False, True]


def test_empty_repeated_and_null_rows(spark):
    none = ta.align(spark.createDataFrame([], "doc_id long, text string"))
    assert none.count() == 0 and ta.pair_counts(none).count() == 0
    rows = ta.align(spark.createDataFrame([(1, "one two"), (1, "one two"), (None, "one two"), (2, None)], "doc_id long, text string"))
    assert sorted((r["doc_id"] or 0, r["n_a"]) for r in rows.collect()) == [(0, 2), (1, 2), (1, 2), (2, 0)]
    assert {r["n"] for r in ta.pair_counts(rows).collect()} == {3}


@pytest.mark.parametrize("text", ["lorem ipsum dolor " * 60_000, "x" * 200_000, " " * 50_000, "a\n" * 100_000])
def test_very_long_texts(spark, text):
    """100,000 words and more, and no space at all: group by group, the bytes are those of the text."""
    got = ta.align(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    a, b = ta.ByteBpe(open(ta.A_FILE, "rb").read()), ta.PieceBpe(open(ta.B_FILE, "rb").read())
    halves = [g.split("|") for g in got["groups"].split(";")]
    spelled = [(b"".join(a.bytes[int(i)] for i in x.split(",")), b"".join(b.bytes[int(i)] for i in y.split(","))) for x, y in halves]
    assert all(x == y for x, y in spelled) and b"".join(x for x, _ in spelled) == (" " + text).encode()
    assert got["n_links"] == got["n_a"] + got["n_b"] - got["n_groups"] == sum(x["times"] for x in got["links"])
