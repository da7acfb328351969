"""Phrase collocations: phrases of two or three words that occur more often than their parts let expect.

Candidates come from count-min sketches, one for each length of phrase, whose cells are upper bounds: what the sketch lets
pass may be frequent, what it holds back is not. A phrase enters its sketch only if all shorter phrases in it have passed
theirs, so the many that occur once or twice do not fill it. Cells count up to a byte's worth; a task sends those that it has
touched, and the tasks that add them up return one bit a cell. That is what is broadcast: a fixed size, whatever the corpus.

Then each chunk of text compiles the candidates that it holds into an Aho-Corasick automaton, spelled with three characters a
word, and scans itself with it; matches may overlap. Counts are exact; a task adds them up over its chunks while they are few
enough, and they are summed over all tasks. Thresholds, cuts into parts and ranks follow as joins and aggregations. An automaton
is as large as its chunk, however many candidates the corpus has.
"""

from __future__ import annotations

import zlib
from operator import itemgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  pa.compute
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read, save

LEAST, MOST_WORDS = 10, 3
#: A phrase goes if a longer one that holds it has at least this percentage of its occurrences.
INSIDE = 50
RANKS = 2000
#: The language of texts without one.
UNKNOWN = "und"
#: Cells of a row of a sketch, and rows. More cells let fewer rare phrases pass; results do not depend on it.
CELLS, ROWS = 1 << 24, 2
#: Cells that one row of the exchanged sketch covers: 65,536 at most, as gaps between touched cells take two bytes.
BLOCK = 1 << 16
#: Bytes of text that are worked on at once (a longer text is worked on alone).
CHUNK = 3 << 20
#: Words that a task remembers.
WORDS = 400_000
#: Different phrases that a task adds up before it sends them.
HELD = 2_000_000
#: Parts in which the first phrases of a language are looked for before they meet.
PARTS = 64

# The byte that ends a piece: none that UTF-8 has.
_END = b"\xff"
# A-Z in lower case, tabs as spaces; what ends a piece is _END.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else 32 if b == 9 else _END[0] if b in b".,;:!?" or 10 <= b <= 13 else b for b in range(256))
_ODD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


class _Words(dict):
    """Numbers words as they come, from 1 on; 0 ends a piece. Hashes of words by number."""

    def __init__(self):
        super().__init__({_END: 0})
        #: Words by number.
        self.spelled = [_END]
        self._hashes = np.zeros(1, np.uint64)

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self.spelled)
        self.spelled.append(word)
        return n

    def hashes(self) -> np.ndarray:
        import xxhash

        known = len(self._hashes)
        if known < len(self.spelled):
            self._hashes = np.concatenate([self._hashes, np.array([xxhash.xxh64_intdigest(w) for w in self.spelled[known:]], np.uint64)])
        return self._hashes


def tokens(texts: list[str]) -> pa.DictionaryArray:
    """Words of some texts in lower case (A-Z), with _END behind each piece; between white space there may be empty ones."""
    marked = _END.join(t.encode().translate(_TABLE) for t in texts) + _END
    split = pa.compute.split_pattern(pa.array([marked.replace(_END, b" " + _END + b" ")], pa.large_binary()), b" ")
    return split.flatten().dictionary_encode()


def _ids(words: _Words, texts: list[str]) -> np.ndarray:
    """The words of some texts by number."""
    found = tokens(texts)
    different = found.dictionary.to_pylist()
    numbers = np.fromiter((words[w] if w else -1 for w in different), np.int64, len(different))
    ids = numbers[found.indices.to_numpy()]
    return ids[ids >= 0]


def _cells(hashes: np.ndarray, cells: int) -> list[np.ndarray]:
    """The place of each hash in each row of a sketch."""
    out = []
    for odd in _ODD[:ROWS]:
        x = hashes * odd
        x ^= x >> np.uint64(29)
        out.append((x * odd >> np.uint64(20)).astype(np.int64) % cells)
    return out


class Bounds:
    """Which cells of the sketches reached the least count, by length of phrase: one bit a cell."""

    def __init__(self, cells: int, bits: list[np.ndarray]):
        self.cells, self.bits = cells, bits

    def passed(self, n: int, hashes: np.ndarray) -> np.ndarray:
        """Whether phrases of ``n`` words may reach the least count."""
        ok = np.ones(len(hashes), bool)
        for r, at in enumerate(_cells(hashes, self.cells)):
            at += r * self.cells
            ok &= (self.bits[n - 1][at >> 3] >> (7 - (at & 7)) & 1).astype(bool)
        return ok

    def candidates(self, ids: np.ndarray, word_hash: np.ndarray, lang: np.uint64, most: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each length up to ``most``: (where phrases begin of which all shorter parts passed, their hashes).

        All but the last are held against their own sketch too, if it is there.
        """
        out, at, own = [], np.flatnonzero(ids > 0), word_hash[ids]
        for n in range(1, most + 1):
            if n > 1:
                ok = np.zeros(len(ids), bool)
                ok[at] = True
                at = at[ok[at + 1]]  # the last number ends a piece
            h = np.full(len(at), lang, np.uint64)
            for k in range(n):
                h = (h ^ own[at + k]) * _ODD[0]
                h ^= h >> np.uint64(32)
            if n <= len(self.bits):
                ok = self.passed(n, h)
                at, h = at[ok], h[ok]
            out.append((at, h))
        return out


def _chunks(batches, most: int):
    """(language, texts) of about ``most`` characters, from batches of (lang, text)."""
    held: dict[str, list[str]] = {}
    sizes: dict[str, int] = {}
    total = 0
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            held.setdefault(lang, []).append(text)
            sizes[lang] = sizes.get(lang, 0) + len(text)
            total += len(text)
            if sizes[lang] > most:
                total -= sizes.pop(lang)
                yield lang, held.pop(lang)
            elif total > 4 * most:
                for one in list(held):
                    yield one, held.pop(one)
                sizes, total = {}, 0
    yield from held.items()


def _lang_hash(lang: str) -> np.uint64:
    import xxhash

    return np.uint64(xxhash.xxh64_intdigest(lang.encode()))


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce("lang", F.lit(UNKNOWN)).alias("lang"), "text").where("text <> ''")


def _packed(at: np.ndarray, n: np.ndarray) -> bytes:
    """Places in rising order, below 65,536, and a byte for each: gaps and bytes are small, so they pack well."""
    gaps = np.diff(at, prepend=0).astype("<u2").view(np.uint8).reshape(-1, 2).T
    return zlib.compress(gaps.tobytes() + n.tobytes(), 1)


def _unpacked(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    data = np.frombuffer(zlib.decompress(packed), np.uint8).reshape(3, -1)
    return np.cumsum(data[0].astype(np.int64) | data[1].astype(np.int64) << 8), data[2]


def next_bounds(docs: DataFrame, bounds: Bounds, least: int = LEAST) -> Bounds:
    """``bounds`` with the sketch of phrases that are a word longer; ``docs`` has (lang, text) without nulls."""
    if not 1 <= least <= 255:
        raise ValueError("cells count up to 255")
    spark, cells = docs.sparkSession, bounds.cells
    sent, n = spark.sparkContext.broadcast(bounds), len(bounds.bits) + 1

    def tally(batches):
        sketch, words = np.zeros(ROWS * cells, np.uint8), _Words()
        for lang, texts in _chunks(batches, CHUNK):
            words = words if len(words) < WORDS else _Words()
            ids = _ids(words, texts)
            _, h = sent.value.candidates(ids, words.hashes(), _lang_hash(lang), n)[-1]
            h, times = np.unique(h, return_counts=True)
            for r, at in enumerate(_cells(h, cells)):
                order = np.argsort(at)
                at, first = np.unique(at[order], return_index=True)
                if len(at):
                    more = np.add.reduceat(times[order], first)
                    sketch[at + r * cells] = np.minimum(sketch[at + r * cells] + more, 255)
        touched = np.flatnonzero(sketch)
        edges = np.searchsorted(touched, np.arange(0, ROWS * cells + BLOCK, BLOCK))
        for b in np.flatnonzero(np.diff(edges)).tolist():
            at = touched[edges[b] : edges[b + 1]]
            yield pa.RecordBatch.from_pylist([{"block": b, "cells": _packed(at - b * BLOCK, sketch[at])}], schema=_SENT)

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for b, packed in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                own = sums.setdefault(b, np.zeros(min(BLOCK, ROWS * cells - b * BLOCK), np.uint8))
                at, more = _unpacked(packed)
                own[at] = np.minimum(own[at] + more.astype(np.int64), 255)
        for b, own in sums.items():
            yield pa.RecordBatch.from_pylist([{"block": b, "bits": np.packbits(own >= least).tobytes()}], schema=_BITS)

    # A block is added up as its rows come in; no group is held whole.
    parts = docs.mapInArrow(tally, "block int, cells binary")
    reached = parts.repartition("block").mapInArrow(add, "block int, bits binary")
    bits = np.zeros(-(-ROWS * cells // 8), np.uint8)
    for row in reached.collect():  # a bit a cell, whatever the corpus
        got = np.frombuffer(row["bits"], np.uint8)
        bits[row["block"] * BLOCK // 8 :][: len(got)] = got
    return Bounds(cells, [*bounds.bits, bits])


_SENT = pa.schema([("block", pa.int32()), ("cells", pa.binary())])
_BITS = pa.schema([("block", pa.int32()), ("bits", pa.binary())])
_COUNTED = pa.schema([("lang", pa.string()), ("n_words", pa.int32()), ("phrase", pa.string()), ("times", pa.int64())])


def _times(text: str, keys: list[str]) -> np.ndarray:
    """How often each of some strings stands in a text, overlaps included."""
    import ahocorasick

    if not keys:
        return np.zeros(0, np.int64)
    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    for k, key in enumerate(keys):
        automaton.add_word(key, k)
    automaton.make_automaton()
    return np.bincount(np.fromiter(map(itemgetter(1), automaton.iter(text)), np.int64), minlength=len(keys))


def scan(text: str, phrases: list[str]) -> np.ndarray:
    """How often each of some phrases stands in a text, overlaps included: words of both are parted by single spaces, a
    text has one at either end as well, and line feeds between its pieces."""
    return _times(text, [f" {phrase} " for phrase in phrases])


def scan_ids(row: np.ndarray, phrases: list[tuple[np.ndarray, ...]]) -> list[np.ndarray]:
    """``scan`` of a row of word numbers, for several lists of phrases, each given by its first, second, ... words' numbers.

    A word is spelled with three characters out of three alphabets, so what matches begins where a word begins, and a state of
    the automaton has few ways on, however many words there are.
    """
    local, back = np.unique(row, return_inverse=True)
    k, base = np.arange(len(local)), 1
    while base**3 < len(local):
        base += 1
    spelling = (np.stack([k // base**2, base + k // base % base, 2 * base + k % base], 1) + 1).astype("<u2")
    spelled = lambda at: spelling[at].tobytes().decode("utf-16-le")
    keys = []
    for columns in phrases:
        size = 3 * len(columns)
        whole = spelled(np.stack([np.searchsorted(local, c) for c in columns], 1))
        keys += [whole[i : i + size] for i in range(0, len(whole), size)]
    return np.split(_times(spelled(back), keys), np.cumsum([len(columns[0]) for columns in phrases])[:-1])


def _codes(columns: tuple[np.ndarray, ...], width: int) -> np.ndarray:
    """A number for each row of word numbers below ``width``; equal rows have equal ones."""
    code, most = columns[0].astype(np.int64), width
    for more in columns[1:]:
        if most * width >= 1 << 62:
            different, code = np.unique(code, return_inverse=True)
            most = len(different)
        code, most = code * width + more, most * width
    return code


class _Tally:
    """Counts of phrases of several chunks, by the numbers of their words."""

    def __init__(self):
        self.words: dict[str, int] = {}
        self._held: dict[tuple[str, int], list] = {}
        self.size = 0

    def add(self, lang: str, columns: tuple[np.ndarray, ...], times: np.ndarray) -> None:
        self._held.setdefault((lang, len(columns)), []).append((*[c.astype(np.int32) for c in columns], times))
        self.size += len(times)

    def merge(self, width: int) -> None:
        """Each phrase once."""
        self.size = 0
        for key, parts in self._held.items():
            *columns, times = (np.concatenate(x) for x in zip(*parts, strict=True))
            _, first, back = np.unique(_codes(columns, width), return_index=True, return_inverse=True)
            sums = np.zeros(len(first), np.int64)
            np.add.at(sums, back, times)
            self._held[key] = [(*[c[first] for c in columns], sums)]
            self.size += len(first)

    def rows(self, spelled: list[bytes]):
        """All counts in record batches; none are held any more."""
        self.merge(len(spelled))
        words = pa.array(spelled, pa.large_binary())
        for lang, n in self.words.items():
            yield _batch(lang, 0, pa.array([""]), pa.array([n], pa.int64()))
        for (lang, n), ((*columns, times),) in self._held.items():
            for k in range(0, len(times), 50_000):
                own = [words.take(pa.array(c[k : k + 50_000])) for c in columns]
                phrase = own[0] if n == 1 else pa.compute.binary_join_element_wise(*own, pa.scalar(b" ", pa.large_binary()))
                yield _batch(lang, n, phrase.cast(pa.large_string()).cast(pa.string()), pa.array(times[k : k + 50_000]))
        self.__init__()


def _batch(lang: str, n: int, phrase: pa.Array, times: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([lang] * len(phrase), pa.string()), pa.array(np.full(len(phrase), n, np.int32)), phrase, times], schema=_COUNTED)


def count_phrases(docs: DataFrame, bounds: Bounds) -> DataFrame:
    """(lang, n_words, phrase, times) of each phrase that passes the sketches, one row or more for each task that holds it, and of
    n_words 0 for all words of a task."""
    sent = docs.sparkSession.sparkContext.broadcast(bounds)

    def run(batches):
        words, tally = _Words(), _Tally()
        for lang, texts in _chunks(batches, CHUNK):
            if len(words) >= WORDS:
                yield from tally.rows(words.spelled)
                words = _Words()
            ids = _ids(words, texts)
            (one, _), *longer = sent.value.candidates(ids, words.hashes(), _lang_hash(lang), len(sent.value.bits))
            width = len(words.spelled)
            tally.words[lang] = tally.words.get(lang, 0) + int((ids > 0).sum())
            single, times = np.unique(ids[one], return_counts=True)
            tally.add(lang, (single,), times)
            phrases = []
            for n, (at, _) in enumerate(longer, 2):
                columns = tuple(ids[at + k] for k in range(n))
                _, first = np.unique(_codes(columns, width), return_index=True)
                phrases.append(tuple(c[first] for c in columns))
            for columns, times in zip(phrases, scan_ids(ids, phrases), strict=True):
                tally.add(lang, columns, times)
            if tally.size > HELD:
                tally.merge(width)
                if tally.size > HELD // 2:
                    yield from tally.rows(words.spelled)
        yield from tally.rows(words.spelled)

    return docs.mapInArrow(run, "lang string, n_words int, phrase string, times long")


def _part(first: bool, k: int) -> Column:
    """The first ``k`` words of a phrase, or what follows them."""
    words = F.split("phrase", " ")
    return F.array_join(F.slice(words, 1, k) if first else F.slice(words, k + 1, MOST_WORDS), " ")


def exact_score(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 a a / (l r)) of decimals without places: products of up to 38 digits, so counts up to 10 ** 16."""
    return F.call_function("div", F.lit(1_000_000).cast("decimal(7,0)") * (a * a), left * right)


def collocations(docs: DataFrame, least: int = LEAST, inside: int = INSIDE, ranks: int = RANKS, cells: int = CELLS) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first phrases of two or three words.

    ``docs`` has (lang, text); other columns are ignored. A-Z count as a-z. Pieces end at ``. , ; : ! ?``, line feeds, vertical tabs, form
    feeds and carriage returns; words are parted by spaces and tabs; phrases lie within pieces. n: all words of the language; a: the
    phrase's occurrences, ``least`` or more; l and r: those of its parts, cut where floor(1000000 a a / (l r)), its score, is lowest
    (then after the fewest words). A phrase goes if a longer one holds it and has ``inside`` percent of its occurrences or more.
    Ranks: by falling score, falling a, then phrase by its bytes, so they have no ties. Texts without a language are ``und``; null and
    empty texts have no words, repeated rows count each, an empty table gives no rows. Numbers are exact at any size.
    """
    texts = _texts(docs)
    bounds = Bounds(cells, [])
    for _ in range(MOST_WORDS):
        bounds = next_bounds(texts, bounds, least)
    counts = save(count_phrases(texts, bounds).groupBy("lang", "n_words", "phrase").agg(F.sum("times").alias("a")).where(f"a >= {least} or n_words = 0"))
    totals = counts.where("n_words = 0").select("lang", F.col("a").alias("n"))
    parts = counts.where("n_words between 1 and 2").select("lang", "phrase", "a")
    found = counts.where("n_words >= 2")

    # A phrase inside a longer one: each of three words holds two of two.
    longer = found.where("n_words = 3").select("lang", F.explode(F.array(_part(True, 2), _part(False, 1))).alias("phrase"), "a")
    covers = longer.groupBy("lang", "phrase").agg(F.max("a").alias("most"))
    kept = found.join(covers, ["lang", "phrase"], "left").where(F.col("most").isNull() | (F.col("most").cast("decimal(20,0)") * 100 < F.col("a").cast("decimal(20,0)") * inside))

    cuts = [F.struct(F.lit(k).alias("k"), _part(True, k).alias("first"), _part(False, k).alias("rest")) for k in range(1, MOST_WORDS)]
    cut = kept.select("lang", "phrase", "a", F.explode(F.filter(F.array(*cuts), lambda c: c["k"] < F.col("n_words"))).alias("c")).select("lang", "phrase", "a", "c.*")
    for name, size in (("first", "l"), ("rest", "r")):
        cut = cut.join(parts.select("lang", F.col("phrase").alias(name), F.col("a").alias(size)), ["lang", name])
    score = exact_score(*[F.col(c).cast("decimal(19,0)") for c in ("a", "l", "r")])
    lowest = cut.groupBy("lang", "phrase").agg(F.max("a").alias("a"), F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("c"))
    scored = lowest.select("lang", "phrase", "a", "c.l", "c.r", "c.score")

    # First in parts, then what each part has left: no task sees more than its part of a language.
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salted = scored.withColumn("_part", F.pmod(F.xxhash64("phrase"), F.lit(PARTS)))
    first = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "_part").orderBy(*order))).where(F.col("rank") <= ranks)
    last = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= ranks)
    return last.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first collocations of each language of ``documents``."""
    return collocations(read(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH p AS (SELECT coalesce(lang, 'und') lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) p FROM documents),
w AS (SELECT lang, list_filter(regexp_split_to_array(p, '[\x20\x09]+'), lambda x: x <> '') w FROM p),
i AS (SELECT lang, w, unnest(range(1, len(w) + 1)) i FROM w WHERE len(w) > 0),
f AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') phrase, count(*) a FROM i, (SELECT unnest([1, 2, 3]) k) WHERE i + k - 1 <= len(w) GROUP BY ALL),
n AS (SELECT lang, sum(a)::BIGINT n FROM f WHERE k = 1 GROUP BY 1),
c AS (SELECT *, string_split(phrase, ' ') s FROM f WHERE k >= 2 AND a >= 10),
x AS (SELECT lang, phrase, max(a) most FROM (SELECT lang, a, unnest([array_to_string(s[1:2], ' '), array_to_string(s[2:3], ' ')]) phrase FROM c WHERE k = 3) GROUP BY ALL),
d AS (SELECT c.* FROM c LEFT JOIN x USING (lang, phrase) WHERE most IS NULL OR 100 * most < 50 * a),
q AS (SELECT lang, phrase, a, u, array_to_string(s[1:u], ' ') f1, array_to_string(s[u + 1:k], ' ') f2 FROM (SELECT *, unnest(range(1, k)) u FROM d)),
e AS (SELECT q.*, b.a l, g.a r, ((1000000::HUGEINT * q.a * q.a) // (b.a::HUGEINT * g.a))::BIGINT score FROM q JOIN f b ON b.lang = q.lang AND b.phrase = f1 JOIN f g ON g.lang = q.lang AND g.phrase = f2),
m AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, u) = 1),
r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) rank FROM m)
SELECT lang, rank, phrase, a, l, r, n, score FROM r JOIN n USING (lang) WHERE rank <= 2000
"""
