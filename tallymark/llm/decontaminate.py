"""Benchmark decontamination with an FM-index per training shard.

The words of a shard are numbered by the vocabulary of the benchmark phrases; a word outside it is a separator,
and a run of known words too short for the shortest phrase is left out, since no phrase can lie across or in
them. Over the rest a suffix array is sorted, its Burrows-Wheeler transform goes into a wavelet matrix, and all
phrases are searched backward at once, one word a step, by rank queries. Occurrences are located by walking to
the next sampled suffix position; their spans are merged per document.

A shard is a bounded number of words, built and searched inside one task, so nothing is shuffled and a lost
executor costs its own shards.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop, read, save, unused

WINDOW = 10
#: Words in a shard (whole documents: a longer document is a shard of its own).
SHARD_WORDS = 1 << 21
#: Every so many-th text position has its suffix position stored.
SAMPLE = 8
#: Bytes of benchmark text that are broadcast at once; a larger benchmark is searched in several passes.
PASS_BYTES = 16 << 20

#: Bytes of a word: 0-9, a-z and all of non-ASCII; A-Z become a-z; the rest separates.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_SPANS = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def words_of(data: bytes) -> list[bytes]:
    """The words of a UTF-8 text."""
    return data.translate(_TABLE).split()


class BitRank:
    """A bit vector that counts its ones before any place."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        self.words = np.zeros(len(bits) // 64 + 1, np.uint64)
        self.words.view(np.uint8)[: len(packed)] = packed
        self.before = np.zeros(len(self.words), np.int64)
        np.cumsum(np.bitwise_count(self.words[:-1]), out=self.before[1:])

    def ones(self, i: np.ndarray) -> np.ndarray:
        at = i >> 6
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[at] + np.bitwise_count(self.words[at] & mask)


class FMIndex:
    """Backward search over a sequence of symbols 1, 2, ...; 0 separates and is never searched."""

    def __init__(self, symbols: np.ndarray, sample: int = SAMPLE):
        text = np.append(symbols.astype(np.int64) + 1, 0)  # 0 ends the text, 1 separates
        order = self._suffixes(text)
        bwt = text[order - 1]
        self.n, self.bits = len(text), max(1, int(text.max()).bit_length())
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=int(text.max()) + 2))])
        self.bwt, self.levels, self.top = bwt, [], int(text.max())
        for k in reversed(range(self.bits)):
            one = (bwt >> k & 1).astype(bool)
            self.levels.append((BitRank(one), int((~one).sum())))
            bwt = np.concatenate([bwt[~one], bwt[one]])
        kept = order % sample == 0
        self.kept, self.positions = BitRank(kept), order[kept]
        self.is_kept = kept

    @staticmethod
    def _suffixes(text: np.ndarray) -> np.ndarray:
        """Suffix array by doubling the sorted prefix until all differ."""
        rank, k, n = text, 1, len(text)
        while True:
            behind = np.zeros(n, np.int64)
            behind[: max(0, n - k)] = rank[k:] + 1
            key = rank * (int(rank.max()) + 2) + behind
            order = np.argsort(key, kind="stable")
            new = np.empty(n, np.int64)
            new[order] = np.concatenate([[0], np.cumsum(np.diff(key[order]) != 0)])
            rank, k = new, 2 * k
            if rank.max() == n - 1:
                return order

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each symbol stands before place i of the transform."""
        lo, hi = np.zeros_like(i), i
        for k, (ones, zeros) in zip(reversed(range(self.bits)), self.levels, strict=True):
            bit = (symbol >> k & 1).astype(bool)
            a, b = ones.ones(lo), ones.ones(hi)
            lo, hi = np.where(bit, zeros + a, lo - a), np.where(bit, zeros + b, hi - b)
        return hi - lo

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each row of ``phrases``, all of one length: its range of suffixes, empty if it never occurs."""
        lo, hi = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        live = np.arange(len(phrases))
        for j in reversed(range(phrases.shape[1])):
            c = phrases[live, j].astype(np.int64) + 1
            known = c <= self.top  # beyond it, a symbol is not in this text
            lo[live[~known]] = hi[live[~known]] = 0
            live, c = live[known], c[known]
            lo[live] = self.first[c] + self.rank(c, lo[live])
            hi[live] = self.first[c] + self.rank(c, hi[live])
            live = live[lo[live] < hi[live]]
        return lo, np.maximum(lo, hi)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffixes, by walking back to sampled ones."""
        out, steps, todo, rows = np.empty(len(rows), np.int64), 0, np.arange(len(rows)), rows.copy()
        while len(todo):
            hit = self.is_kept[rows]
            out[todo[hit]] = self.positions[self.kept.ones(rows[hit])] + steps
            todo, rows, steps = todo[~hit], rows[~hit], steps + 1
            c = self.bwt[rows]
            rows = self.first[c] + self.rank(c, rows)
        return out


class Phrases:
    """Windows of benchmark items as word numbers; picklable, to be broadcast."""

    def __init__(self, items: list[tuple[str, bytes]], window: int = WINDOW):
        self.vocabulary: dict[bytes, int] = {}
        of: dict[tuple, set] = {}
        for item, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(text)]
            for i in range(max(1, len(ids) - window + 1) if ids else 0):
                of.setdefault(tuple(ids[i : i + window]), set()).add(item)
        self.by_length = {}
        for n in sorted({len(p) for p in of}):
            found = [p for p in of if len(p) == n]
            self.by_length[n] = (np.array(found, np.int32), [sorted(of[p]) for p in found])
        self.shortest = min(self.by_length, default=0)

    def find(self, flat: np.ndarray):
        """(starts, lengths, item lists) of all occurrences in a shard; 0 in ``flat`` separates."""
        none = np.empty(0, np.int64), np.empty(0, np.int64), []
        if not self.by_length:
            return none
        edge = np.diff(np.concatenate([[0], (flat > 0).astype(np.int8), [0]]))
        begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        fits = end - begin >= self.shortest
        begin, size = begin[fits], (end - begin)[fits]
        if not len(begin):
            return none
        # Each run that fits, and a separator after it.
        offset = np.concatenate([[0], np.cumsum(size + 1)])
        places = np.repeat(begin - offset[:-1], size + 1) + np.arange(offset[-1])
        symbols = flat[np.minimum(places, len(flat) - 1)].copy()
        symbols[offset[1:] - 1] = 0
        index = FMIndex(symbols)
        starts, lengths, items = [], [], []
        for n, (phrases, of) in self.by_length.items():
            lo, hi = index.search(phrases)
            count = hi - lo
            which = np.repeat(np.arange(len(phrases)), count)
            rows = np.repeat(lo - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
            starts.append(places[index.locate(rows)])
            lengths.append(np.full(len(rows), n))
            items += [of[k] for k in which]
        return np.concatenate(starts), np.concatenate(lengths), items


def _number(texts: list[bytes], vocabulary: dict) -> tuple[np.ndarray, np.ndarray]:
    """All words of the texts as numbers, a 0 after each text; where each text starts, and the end."""
    flat: list[int] = []
    starts, get = [0], vocabulary.get
    for text in texts:
        flat += [get(w, 0) for w in words_of(text)]
        flat.append(0)
        starts.append(len(flat))
    return np.array(flat, np.int32), np.array(starts, np.int64)


def _hits(texts: list[bytes], phrases: Phrases) -> tuple[np.ndarray, dict[int, tuple[list, set]]]:
    """Words of each text; for each text with occurrences its merged word spans and its items."""
    flat, starts = _number(texts, phrases.vocabulary)
    at, lengths, items = phrases.find(flat)
    found: dict[int, tuple[list, set]] = {}
    order = np.argsort(at, kind="stable")
    doc = np.searchsorted(starts, at, side="right") - 1
    for k in order:
        d = int(doc[k])
        a = int(at[k] - starts[d])
        b = a + int(lengths[k])
        spans, names = found.setdefault(d, ([], set()))
        names.update(items[k])
        if spans and a <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], b)
        else:
            spans.append([a, b])
    return np.diff(starts) - 1, found


def _merge(spans: list) -> list:
    out: list = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def _cut(text: bytes, spans: list) -> bytes:
    """The text without the words of the spans and what stands between those."""
    places = [m.span() for m in _SPANS.finditer(text)]
    out, last = [], 0
    for a, b in spans:
        out.append(text[last : places[a][0]])
        last = places[b - 1][1]
    return b"".join([*out, text[last:]])


def _shards(batches, column: str, most: int):
    """Record batches in lists of bounded size, each with its texts (null: empty)."""
    held, texts, size = [], [], 0
    for batch in batches:
        for k in range(0, batch.num_rows, 512):  # 512 texts of any length: a batch may have thousands
            part = batch.slice(k, 512)
            own = [b"" if x is None else x.encode() for x in part.column(column).to_pylist()]
            held.append(part)
            texts += own
            size += sum(len(x) for x in own) // 6 + len(own)
            if size >= most:
                yield held, texts
                held, texts, size = [], [], 0
    if held:
        yield held, texts


def _divided(benchmark: DataFrame, most_bytes: int) -> list[DataFrame]:
    """Items of the benchmark, in passes of a bounded size."""
    items = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("string").alias("i"), "text")
    total = items.agg(F.sum(F.octet_length("text") + F.octet_length("i"))).first()[0] or 0
    n = max(1, -(-total // most_bytes))
    return [items.where(F.pmod(F.xxhash64("i", "text"), F.lit(n)) == k) for k in range(n)]


def _phrases(items: DataFrame, window: int) -> Phrases:
    return Phrases([(r["i"], r["text"].encode()) for r in items.collect()], window)


def contamination(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shard_words: int = SHARD_WORDS, pass_bytes: int = PASS_BYTES
) -> DataFrame:
    """(doc_id, n_words, spans, items) for every row of ``docs`` (doc_id, text).

    spans: array of (start, end) word positions, end excluded, merged and in order; items: the ids, as sorted
    strings, of the ``benchmark`` (item_id, text) rows with a window of ``window`` words (all words of a shorter
    item) in the text. Null and empty texts have no words. Items with a null id or text are ignored, repeated
    items count once. Repeated rows of ``docs`` come back as often. Empty tables on either side give no rows or
    no hits. Other columns are ignored. A benchmark of more than ``pass_bytes`` is searched in several passes.
    """
    schema = "doc_id long, text string, n_words long, spans array<struct<start:int,end:int>>, items array<string>"
    now = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        "text",
        F.lit(0).cast("long").alias("n_words"),
        F.array().cast("array<struct<start:int,end:int>>").alias("spans"),
        F.array().cast("array<string>").alias("items"),
    )
    for items in _divided(benchmark, pass_bytes):
        sent = docs.sparkSession.sparkContext.broadcast(_phrases(items, window))

        def scan(batches, sent=sent):
            for held, texts in _shards(batches, "text", shard_words):
                counts, found = _hits(texts, sent.value)
                table = pa.Table.from_batches(held)
                spans, items = table.column("spans").to_pylist(), table.column("items").to_pylist()
                for d, (more, names) in found.items():
                    merged = _merge([[x["start"], x["end"]] for x in spans[d]] + more)
                    spans[d] = [{"start": a, "end": b} for a, b in merged]
                    items[d] = sorted(names.union(items[d]))
                yield from pa.table(
                    {
                        "doc_id": table.column("doc_id"),
                        "text": table.column("text"),
                        "n_words": pa.array(counts, pa.int64()),
                        "spans": pa.array(spans, table.schema.field("spans").type),
                        "items": pa.array(items, pa.list_(pa.string())),
                    }
                ).to_batches()

        now = now.mapInArrow(scan, schema)
    return now.drop("text")


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shard_words: int = SHARD_WORDS, pass_bytes: int = PASS_BYTES
) -> DataFrame:
    """``docs`` with the words of all occurrences taken out of ``text``; every row and column stays.

    A cut brings words together that stood apart; texts that were cut are searched again, by all phrases, until
    nothing is found. What all passes find in a text is merged before it is cut, so a text comes out the same
    however many passes a benchmark takes. Unusual input: see ``contamination``; a null text stays null.
    """
    passes, names = _divided(benchmark, pass_bytes), docs.columns
    # By numbers, as Spark hands no names with dots to Python.
    docs = docs.toDF(*["text" if c == "text" else f"c{k}" for k, c in enumerate(names)])
    if len(passes) > 1:
        return _decontaminate_in_passes(docs, passes, window, shard_words).toDF(*names)
    sent = docs.sparkSession.sparkContext.broadcast(_phrases(passes[0], window))

    def scan(batches):
        for held, texts in _shards(batches, "text", shard_words):
            changed = list(range(len(texts)))
            cut: dict[int, bytes] = {}
            while changed:
                _, found = _hits([cut.get(d, texts[d]) for d in changed], sent.value)
                again = []
                for k, (spans, _) in found.items():
                    d = changed[k]
                    cut[d] = _cut(cut.get(d, texts[d]), spans)
                    again.append(d)
                changed = again
            yield from _with_texts(pa.Table.from_batches(held), cut).to_batches()

    return docs.mapInArrow(scan, docs.schema).toDF(*names)


def _with_texts(table: pa.Table, cut: dict[int, bytes]) -> pa.Table:
    """The table with other texts in some rows."""
    if not cut:
        return table
    column, field = table.column("text").to_pylist(), table.schema.field("text")
    for d, text in cut.items():
        column[d] = text.decode()
    return table.set_column(table.schema.get_field_index("text"), field, pa.array(column, field.type))


_FOUND = "array<struct<start:int,end:int>>"


def _decontaminate_in_passes(docs: DataFrame, passes: list[DataFrame], window: int, shard_words: int) -> DataFrame:
    """``decontaminate`` for a benchmark of several passes.

    A round searches the texts that the last one cut, in all passes, each written to the shared folder so that one
    pass of phrases is held at a time; then it cuts. The last round finds nothing.
    """
    open_, found_ = unused(docs, "_open", "_found")
    now, scratch = docs.withColumns({open_: F.lit(True), found_: F.array().cast(_FOUND)}), None
    while True:
        for items in passes:
            sent = docs.sparkSession.sparkContext.broadcast(_phrases(items, window))

            def scan(batches, sent=sent):
                for held, texts in _shards(batches, "text", shard_words):
                    table = pa.Table.from_batches(held)
                    places = [d for d, is_open in enumerate(table.column(open_).to_pylist()) if is_open]
                    _, found = _hits([texts[d] for d in places], sent.value)
                    if found:
                        spans, field = table.column(found_).to_pylist(), table.schema.field(found_)
                        for k, (more, _) in found.items():
                            d = places[k]
                            spans[d] = [{"start": a, "end": b} for a, b in _merge([[x["start"], x["end"]] for x in spans[d]] + more)]
                        table = table.set_column(table.schema.get_field_index(found_), field, pa.array(spans, field.type))
                    yield from table.to_batches()

            found = save(now.mapInArrow(scan, now.schema))
            sent.unpersist()
            if scratch is not None:
                drop(scratch)
            now = scratch = found
        if now.where(F.size(found_) > 0).isEmpty():
            return now.drop(open_, found_)

        def cut(batches):
            for batch in (b.slice(k, 512) for b in batches for k in range(0, b.num_rows, 512)):
                table = pa.Table.from_batches([batch])
                texts, spans = table.column("text"), table.column(found_).to_pylist()
                own = {d: _cut(texts[d].as_py().encode(), [(x["start"], x["end"]) for x in found]) for d, found in enumerate(spans) if found}
                for name, values in ((open_, [bool(x) for x in spans]), (found_, [[] for _ in spans])):
                    field = table.schema.field(name)
                    table = table.set_column(table.schema.get_field_index(name), field, pa.array(values, field.type))
                yield from _with_texts(table, own).to_batches()

        now = now.mapInArrow(cut, now.schema)


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``documents`` held against all of ``benchmark``."""
    found = contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"]).alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


OP9_SQL = r"""
WITH lowered AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') t FROM documents),
d AS (SELECT doc_id, list_filter(regexp_split_to_array(t, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') w FROM lowered),
b AS (SELECT item_id, list_filter(regexp_split_to_array(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(10, len(w)) n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') k
       FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) i FROM b WHERE len(w) > 0)),
ns AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') k
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) i FROM d, ns WHERE len(w) >= n)),
hits AS (SELECT doc_id, i, bw.n n, item_id FROM dw JOIN bw USING (k)),
hitw AS (SELECT doc_id, count(DISTINCT p) n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) p FROM hits) GROUP BY 1),
its AS (SELECT doc_id, count(*) n_items, string_agg(s, ',' ORDER BY s) l
        FROM (SELECT DISTINCT doc_id, cast(item_id AS VARCHAR) s FROM hits) GROUP BY 1)
SELECT d.doc_id, len(w) n_words, coalesce(n_hit, 0) n_hit, coalesce(n_items, 0) n_items,
       sha256(coalesce(l, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
FROM d LEFT JOIN hitw USING (doc_id) LEFT JOIN its USING (doc_id)
"""
