"""Alignment of two tokenizers' tokens over the same bytes.

A text is encoded twice, by byte-level BPE (A) and by a piece vocabulary with byte fallback (B). B's tokens are the
intervals of a static index: their begins and ends, sorted. Each A token is a stabbing query, answered by two bisections,
and lists the B tokens that overlap it. An end of an A token that no B token spans is a group boundary.

Both tokenizers cut a text at every space between two characters that are no white space: no token of either reaches
over such a place. So a text is a list of segments, tokens, links and groups of a segment are worked out once while a
task remembers it, and those of a text are put together from its segments'. Nothing is shuffled until the links' id pairs are
counted.
"""

from __future__ import annotations

import json
import os
import re
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop, read, save
from .token_counts import PATTERN

#: Files of the two public vocabularies; the session's settings name other places: any path that Spark reads.
A_FILE, A_CONF = "/opt/tokenizers/byte_bpe_50k.json", "spark.tallymark.tokenizer.a"
B_FILE, B_CONF = "/opt/tokenizers/piece_bpe_32k.model", "spark.tallymark.tokenizer.b"
#: Characters of text that are worked on at once (a longer text is worked on alone).
CHUNK = 1 << 21
#: Segments, and their characters, that a task remembers.
SEGMENTS, SEGMENT_CHARS = 250_000, 1 << 24
#: Id pairs of which the counts are broadcast at most (two longs and a flag each); more are joined by a shuffle.
BROADCAST_PAIRS = 1_000_000

SCHEMA = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, links array<struct<pair: bigint, times: int>>"
_CUT = re.compile(r"(?<=\S) (?=\S)")
_LINK = pa.struct([("pair", pa.int64()), ("times", pa.int32())])


def file_bytes(spark: SparkSession, path: str) -> bytes:
    """A vocabulary file, one or two MB. A path without a scheme is one of the driver's own files, if it is there."""
    if os.path.isfile(path):
        with open(path, "rb") as f:
            return f.read()
    return bytes(spark.read.format("binaryFile").load(path).select("content").first()[0])


def _byte_alphabet() -> dict[str, int]:
    """The characters by which byte-level vocabularies spell bytes: printable ones stand for themselves, the others
    follow from code point 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


def _sizes(spelled: dict[int, bytes]) -> np.ndarray:
    return np.array([len(spelled.get(i, b"")) for i in range(max(spelled) + 1)], np.int64)


class ByteBpe:
    """A: byte-level BPE from a tokenizer's JSON file. Special tokens are not known, so their strings are plain text."""

    def __init__(self, content: bytes):
        import tiktoken

        spec = json.loads(content)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in merges]
        split = spec["pre_tokenizer"]
        # With ids in the order of the merges, the lowest id is the merge that comes first.
        if spec["normalizer"] or split["type"] != "ByteLevel" or split["add_prefix_space"] or any(vocab["".join(p)] != 256 + i for i, p in enumerate(pairs)):
            raise ValueError("A must be a byte-level BPE vocabulary without normalizer, its ids in the order of its merges")
        spelled = _byte_alphabet()
        self.bytes = {i: bytes(map(spelled.__getitem__, s)) for s, i in vocab.items()}
        self._bpe = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks={b: i for i, b in self.bytes.items()}, special_tokens={})

        self.size = _sizes(self.bytes)

    def encode(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of a space and a segment, one segment after the other; how many each has).

        No token reaches over the space between two segments that have no white space at their ends, so such are encoded
        together; bytes tell whose the ids are, as this vocabulary gives back every byte.
        """
        bare = [bool(s) and not s[0].isspace() and not s[-1].isspace() for s in segments]
        n = np.zeros(len(segments), np.int64)
        together = [s for s, ok in zip(segments, bare, strict=True) if ok]
        ids = np.array(self._bpe.encode_ordinary("".join([f" {s}" for s in together])) if together else [], np.int64)
        edges = np.cumsum([len(s.encode()) + 1 for s in together])
        ends = np.searchsorted(np.cumsum(self.size[ids]), edges, side="right")
        n[np.array(bare, bool)] = np.diff(ends, prepend=0)
        if len(together) == len(segments):
            return ids, n
        parts, at = [], 0
        for k, (s, ok) in enumerate(zip(segments, bare, strict=True)):
            parts.append(ids[at : at + n[k]] if ok else np.array(self._bpe.encode_ordinary(" " + s), np.int64))
            at, n[k] = at + n[k], len(parts[-1])
        return np.concatenate(parts), n


class PieceBpe:
    """B: pieces with byte fallback from a model file; it puts a space before a text by itself."""

    def __init__(self, content: bytes):
        import sentencepiece

        self._model = sentencepiece.SentencePieceProcessor(model_proto=content)
        pieces = [self._model.id_to_piece(i) for i in range(self._model.get_piece_size())]
        if any("▁" in p.lstrip("▁") for p in pieces):
            raise ValueError("B must have no piece that reaches over a space")
        self.bytes = {i: bytes([int(p[3:5], 16)]) if self._model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)}

        self.size = _sizes(self.bytes)

    def encode(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of each segment, one after the other; how many each has)."""
        found = self._model.encode(segments, num_threads=1)
        n = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), np.int64, int(n.sum())), n

    def spell(self, ids: np.ndarray) -> bytes:
        """The bytes of some tokens."""
        return b"".join(map(self.bytes.__getitem__, ids.tolist()))


def segments(text: str) -> list[str]:
    """A text cut at each space between characters that are no white space; those spaces are left out."""
    return _CUT.split(text)


def overlaps(a_len: np.ndarray, b_len: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Byte lengths of tokens of A and of B over the same bytes: (first B, number of B tokens) that overlap each A token, and
    whether A's and B's tokens end a group."""
    a_end, b_end = np.cumsum(a_len), np.cumsum(b_len)
    first = np.searchsorted(b_end, a_end - a_len, side="right")
    last = np.searchsorted(b_end - b_len, a_end, side="left") - 1
    a_closes = b_end[last] == a_end if len(a_end) else np.empty(0, bool)
    b_closes = np.zeros(len(b_end), bool)
    b_closes[last[a_closes]] = True
    return first, last - first + 1, a_closes, b_closes


def _slices(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Places start, start + 1, ... of each slice, one slice after the other."""
    ends = np.cumsum(size)
    return np.repeat(start - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)


class Aligner:
    """Aligns texts; remembers segments."""

    def __init__(self, a: ByteBpe, b: PieceBpe):
        self.a, self.b = a, b
        said = lambda size, after: np.array([f"{i}{after}" for i in range(size)], object)
        #: How ids are written within and at the end of a group.
        self.said = [said(len(a.size), ","), said(len(a.size), "|"), said(len(b.size), ","), said(len(b.size), ";")]
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.chars = 0
        self.groups: list[str] = []
        #: n_a, n_b, n_groups, n_links of each segment; 0 for one that a tokenizer does not give back as it was.
        self.sizes = np.empty((0, 4), np.int64)
        self.begin = np.empty(0, np.int64)
        self.pairs = np.empty(0, np.int64)

    def _learn(self, new: list[str]) -> None:
        (flat_a, n_a), (flat_b, n_b) = self.a.encode(new), self.b.encode(new)
        total = lambda values, n: np.diff(np.concatenate([[0], np.cumsum(values)])[np.stack([np.cumsum(n) - n, np.cumsum(n)])], axis=0)[0]
        whole = total(self.a.size[flat_a], n_a) == total(self.b.size[flat_b], n_b)
        if not whole.all() or self.b.spell(flat_b) != "".join([f" {s}" for s in new]).encode():
            ends = np.cumsum(n_b).tolist()
            whole = np.array([self.b.spell(flat_b[e - n : e]) == f" {s}".encode() for s, e, n in zip(new, ends, n_b.tolist(), strict=True)])
            flat_a, flat_b = flat_a[np.repeat(whole, n_a)], flat_b[np.repeat(whole, n_b)]
            n_a, n_b = n_a * whole, n_b * whole
        # One index for all new segments: they lie one after the other.
        first, size, a_closes, b_closes = overlaps(self.a.size[flat_a], self.b.size[flat_b])
        pairs = np.repeat(flat_a, size) * len(self.b.size) + flat_b[_slices(first, size)]
        n_links, n_groups = total(size, n_a), total(a_closes, n_a)
        # A's tokens of a group, then B's, then the next group.
        group_a, group_b = np.cumsum(a_closes) - a_closes, np.cumsum(b_closes) - b_closes
        order = np.argsort(np.concatenate([group_a * 2, group_b * 2 + 1]), kind="stable")
        a_open, a_last, b_open, b_last = self.said
        said = np.concatenate([np.where(a_closes, a_last[flat_a], a_open[flat_a]), np.where(b_closes, b_last[flat_b], b_open[flat_b])])[order].tolist()
        at = 0
        for n in (n_a + n_b).tolist():
            self.groups.append("".join(said[at : at + n])[:-1])
            at += n
        begin = np.cumsum(n_links) - n_links + len(self.pairs)
        self.begin, self.pairs = np.concatenate([self.begin, begin]), np.concatenate([self.pairs, pairs])
        self.sizes = np.concatenate([self.sizes, np.stack([n_a, n_b, n_groups, n_links], 1)])

    def align(self, texts: list[str | None]) -> list[pa.Array]:
        """Columns n_a, n_b, n_groups, n_links, groups and links of some texts."""
        if len(self.known) > SEGMENTS or self.chars > SEGMENT_CHARS:
            self._forget()
        parts = [segments(t) if t else [] for t in texts]
        flat = [s for p in parts for s in p]
        places = list(map(self.known.get, flat))
        if None in places:
            new = list(dict.fromkeys([s for s, k in zip(flat, places, strict=True) if k is None]))
            self.known.update(zip(new, range(len(self.known), len(self.known) + len(new)), strict=True))
            self.chars += sum(map(len, new))
            self._learn(new)
            places = list(map(self.known.__getitem__, flat))
        at = np.array(places, np.int64)
        n_parts = np.array([len(p) for p in parts], np.int64)
        row = np.repeat(np.arange(len(texts)), n_parts)
        spoilt = np.zeros(len(texts), bool)
        spoilt[row[self.sizes[at, 0] == 0]] = True  # any segment has a token of A, if it is given back
        keep = ~spoilt[row]
        at, row = at[keep], row[keep]
        sums = np.zeros((len(texts), 4), np.int64)
        for k in range(4):
            sums[:, k] = np.bincount(row, self.sizes[at, k], len(texts))
        said, start, ends = [], 0, np.cumsum(n_parts).tolist()
        for end, bad in zip(ends, spoilt.tolist(), strict=True):
            said.append("" if bad else ";".join([self.groups[k] for k in places[start:end]]))
            start = end
        # Each text's pairs, with how often it has each.
        size, width = self.sizes[at, 3], len(self.b.size)
        seen = np.sort(np.repeat(row, size) * (len(self.a.size) * width) + self.pairs[_slices(self.begin[at], size)])
        first = np.flatnonzero(np.diff(seen, prepend=-1))
        times = np.diff(np.append(first, len(seen)))
        owner, pair = np.divmod(seen[first], len(self.a.size) * width)
        edges = np.searchsorted(owner, np.arange(len(texts) + 1)).astype(np.int32)
        codes = (pair // width << 32) | pair % width
        links = pa.StructArray.from_arrays([pa.array(codes, pa.int64()), pa.array(times, pa.int32())], fields=list(_LINK))
        return [*[pa.array(sums[:, k]) for k in range(4)], pa.array(said, pa.string()), pa.ListArray.from_arrays(pa.array(edges), links)]


def align(docs: DataFrame, a_file: str | None = None, b_file: str | None = None) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, groups, links) for each row of ``docs`` (doc_id, text).

    ``groups`` is the alignment, ``a1,a2|b1;a3|b2,b3``: ids of A and of B, a group after the other. ``links`` are the id
    pairs that overlap, ``a * 2**32 + b`` each, with the number of times. Null and empty texts, and those that a tokenizer
    does not give back byte for byte (as B does with U+2581), have no tokens: zeros, an empty string, no links. Repeated rows
    are rows of their own, an empty table gives no rows, other columns are ignored. Texts are encoded whole.
    """
    spark = docs.sparkSession
    a_sent = spark.sparkContext.broadcast(file_bytes(spark, a_file or spark.conf.get(A_CONF, A_FILE)))
    b_sent = spark.sparkContext.broadcast(file_bytes(spark, b_file or spark.conf.get(B_CONF, B_FILE)))

    def run(batches):
        aligner = None
        for batch in batches:
            aligner = aligner or Aligner(ByteBpe(a_sent.value), PieceBpe(b_sent.value))
            begin, chars, sizes = 0, 0, pc.utf8_length(batch.column(1)).fill_null(0).to_pylist()
            for k, n in enumerate([*sizes, CHUNK]):
                if k > begin and (chars + n > CHUNK or k == len(sizes)):
                    part = batch.slice(begin, k - begin)
                    yield pa.RecordBatch.from_arrays([part.column(0), *aligner.align(part.column(1).to_pylist())], ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "links"])
                    begin, chars = k, 0
                chars += n

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair, n, best): how many rows link each id pair, and whether no other pair of its A id has more; ``aligned`` has links."""
    counts = save(aligned.select(F.explode("links.pair").alias("pair")).groupBy("pair").agg(F.count("*").alias("n")))
    a = F.shiftright("pair", 32)
    top = counts.groupBy(a.alias("_a")).agg(F.max("n").alias("_top"))
    found = save(counts.join(top, a == F.col("_a")).select("pair", "n", (F.col("n") == F.col("_top")).alias("best")))
    drop(counts)
    return found


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The alignment of every text of ``documents``: its size, a digest of its groups, and how common its links are."""
    aligned = align(read(spark, sf_dir, "documents"))
    digest = F.when(F.col("n_a") > 0, F.sha2(F.col("groups").cast("binary"), 256)).otherwise("")
    rows = save(aligned.select(F.monotonically_increasing_id().alias("row"), "doc_id", "n_a", "n_b", "n_groups", "n_links", digest.alias("groups_sha256"), "links"))
    known = pair_counts(rows)
    # The vocabularies bound the pairs; a text's links are next to each other, so they are summed before any shuffle.
    known = F.broadcast(known) if known.count() <= BROADCAST_PAIRS else known
    linked = rows.select("row", F.inline("links")).join(known, "pair")
    sums = linked.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("times")).alias("count_sum"))
    some = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return rows.drop("links").join(sums, "row", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", some("n_best"), some("count_sum"), "groups_sha256")
