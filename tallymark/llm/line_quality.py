"""Quality rules, lines first: each line is judged by itself, lines that fail are taken out, and a document that loses too
much of its text with them is rejected.

A line fails by the first of these rules that it breaks (a line without a word breaks none):

* punctuation: at least two words, and at least one in ``LOUD`` of its words is followed by a run of marks (``!!``, ``??``) or carries symbols (``***``);
* navigation: at least three separators (bars, arrows, bullets), and at least one for each ``ITEM`` words: a menu or a trail;
* boilerplate: at most ``NOTICE`` words, one of the ``PHRASES`` among them: notices and buttons that pages repeat.

One pass without a shuffle; texts are worked on in chunks of bounded size, each text whole.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import read, unused

#: Characters of text that are worked on at once (a longer text is worked on alone).
CHUNK = 1 << 21
LOUD, ITEM, NOTICE = 4, 6, 15
#: A document that loses more than this percentage of its words' characters is rejected.
MAX_LOSS = 50
#: Fewer words, or a larger percentage of words in repeated windows, fail a document before its lines are looked at.
MIN_WORDS, MAX_REPEATED = 50, 50

MARKS = r"[!?]{2,}|[#*$%&]+"
SEPARATORS = r"[|<>»›·•→]"
PHRASES = (
    "all rights reserved", "terms of service", "terms of use", "privacy policy", "cookie policy", "uses cookies", "accept cookies",
    "click here", "read more", "sign in", "sign up", "log in", "subscribe to", "share on", "back to top", "skip to content",
    "enable javascript", "powered by", "page not found", "lorem ipsum",
)
NOTICES = "(?i)" + "|".join(PHRASES)

_SPACE, _SYMBOLS = b" \t\n\x0b\x0c\r", b"#*$%&|<>"
_MARKS, _SEPARATORS, _NOTICES = re.compile(MARKS), re.compile(SEPARATORS), re.compile(NOTICES, re.ASCII)
RULES = ("punctuation", "navigation", "boilerplate")
_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", *[f"n_{r}" for r in RULES], "lost_chars")


def broken(line: str, n_words: int) -> int:
    """The rule that a line of some words breaks, as its place in RULES; -1 for none."""
    if n_words >= 2:
        n = len(_MARKS.findall(line))
        if n and n * LOUD >= n_words:
            return 0
    n = len(_SEPARATORS.findall(line))
    if n >= 3 and n * ITEM >= n_words:
        return 1
    if n_words <= NOTICE and _NOTICES.search(line):
        return 2
    return -1


def _chars(text: str, data: bytes) -> int:
    """Code points of a text's words."""
    return len(text) - len(data) + len(data.translate(None, _SPACE))


def repeated_words(ids: np.ndarray, row: np.ndarray, n_rows: int) -> np.ndarray:
    """For each row, how many of its words lie in a window of three words that it has twice or more; ``row`` is sorted."""
    mark = np.zeros(len(ids), bool)
    if len(ids) >= 3:
        at = np.flatnonzero(row[:-2] == row[2:])
        width = int(ids.max()) + 1
        _, two = np.unique(ids[at] * width + ids[at + 1], return_inverse=True)
        _, three = np.unique(two * width + ids[at + 2], return_inverse=True)
        window = row[at] * (len(at) + 1) + three
        order = np.argsort(window)
        same = np.flatnonzero(window[order][1:] == window[order][:-1])
        twice = at[np.unique(np.concatenate([order[same], order[same + 1]]))] if len(same) else same
        for k in range(3):
            mark[twice + k] = True
    return np.bincount(row[mark], minlength=n_rows)


class _Numbers(dict):
    """Numbers words in the order in which they come."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


def judge(texts: list[str | None]) -> tuple[list[str | None], np.ndarray]:
    """The texts without the lines that fail, and the counts of _COUNTS for each; null has no words and stays null."""
    cleaned, counts = [], np.zeros((len(texts), len(_COUNTS)), np.int64)
    numbers, ids, sizes = _Numbers(), [], []
    for text, out in zip(texts, counts, strict=True):
        data = (text or "").encode()
        words = data.split()
        ids.append(np.fromiter(map(numbers.__getitem__, words), np.int64, len(words)))
        sizes.append(len(words))
        if not text:
            cleaned.append(text)
            continue
        out[0], out[1], out[2] = len(words), _chars(text, data), len(data) - len(data.translate(None, _SYMBOLS))
        kept, seen, n_lines = [], set(), 0
        for line in text.split("\n"):
            raw = line.encode()
            n = len(raw.split())
            if not n:
                kept.append(line)
                continue
            n_lines += 1
            seen.add(line)
            rule = broken(line, n)
            if rule < 0:
                kept.append(line)
            else:
                out[6 + rule] += 1
                out[9] += _chars(line, raw)
        out[3], out[5] = n_lines - len(seen), n_lines
        cleaned.append("\n".join(kept))
    row = np.repeat(np.arange(len(texts)), np.array(sizes, np.int64))
    counts[:, 4] = repeated_words(np.concatenate([*ids, np.empty(0, np.int64)]), row, len(texts))
    return cleaned, counts


def measure(docs: DataFrame, max_loss: int = MAX_LOSS) -> DataFrame:
    """``docs`` with ``quality``, a struct of what was found and decided; an own column of that name, in any case, is replaced.

    ``quality`` has the counts n_words, word_chars (code points in words), n_symbols (characters of ``#*$%&|<>``), n_dup_lines
    (lines with a word that equal an earlier one), n_repeat_words (words in windows of three that the text has twice), n_lines
    (lines with a word), n_punctuation, n_navigation and n_boilerplate (lines that go by each rule), lost_chars (code points in words
    of these lines), then base_failed (fewer than MIN_WORDS words, or more than MAX_REPEATED percent in repeated windows), kept (not
    base_failed, and not more than ``max_loss`` percent of word_chars lost) and cleaned (the text without those lines).
    Words are runs of anything but ASCII white space. A null text has no words and stays null; it and an empty one are
    base_failed. Repeated rows are judged alike; an empty table gives no rows. Texts are read whole.
    """
    names = [c for c in docs.columns if c.lower() != "quality"]
    # By numbers, as Spark hands no names with dots to Python.
    given, at = docs.select(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(names)]), [c.lower() for c in names].index("text")
    added = ("cleaned", *_COUNTS)
    kinds = [T.StringType(), *[T.LongType()] * len(_COUNTS)]
    schema = T.StructType([*given.schema.fields, *map(T.StructField, added, kinds)])

    def run(batches):
        for batch in batches:
            begin, chars, sizes = 0, 0, pc.utf8_length(batch.column(at)).fill_null(0).to_pylist()
            for k, n in enumerate([*sizes, CHUNK]):
                if k > begin and (chars + n > CHUNK or k == len(sizes)):
                    part = batch.slice(begin, k - begin)
                    cleaned, counts = judge(part.column(at).to_pylist())
                    found = [pa.array(cleaned, pa.string()), *[pa.array(c) for c in counts.T.copy()]]
                    yield pa.RecordBatch.from_arrays([*part.columns, *found], schema.names)
                    begin, chars = k, 0
                chars += n

    found = given.mapInArrow(run, schema)
    c = {n: F.col(n) for n in added}
    failed = (c["n_words"] < MIN_WORDS) | (c["n_repeat_words"] * 100 > c["n_words"] * MAX_REPEATED)
    kept = ~failed & (c["lost_chars"] * 100 <= c["word_chars"] * max_loss)
    quality = F.struct(*[c[n].alias(n) for n in _COUNTS], failed.alias("base_failed"), kept.alias("kept"), c["cleaned"].alias("cleaned"))
    return found.select(*[F.col(f"c{k}").alias(n) for k, n in enumerate(names)], quality.alias("quality"))


def clean(docs: DataFrame, max_loss: int = MAX_LOSS) -> DataFrame:
    """The documents that stay, without the lines that fail; all other columns as they were. See ``measure``."""
    (name,) = unused(docs, "_own_quality")
    own = docs.select(*[F.col(f"`{c}`").alias(name if c.lower() == "quality" else c) for c in docs.columns])
    kept = measure(own, max_loss).where("quality.kept")
    return kept.select(*[F.col("quality.cleaned").alias(c) if c == "text" else F.col(name if c.lower() == "quality" else f"`{c}`").alias(c) for c in docs.columns])


def op12_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text of ``documents`` measured and judged, lines first."""
    q = measure(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return q.select("doc_id", *[f"quality.{c}" for c in (*_COUNTS, "base_failed", "kept")])


OP12_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') t, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') w FROM documents),
l AS (SELECT doc_id, unnest(string_split(t, chr(10))) s FROM d),
lw AS (SELECT doc_id, s, list_filter(regexp_split_to_array(s, '[\x20\x09-\x0D]+'), lambda x: x <> '') w FROM l WHERE regexp_matches(s, '[^\x20\x09-\x0D]')),
lm AS (SELECT doc_id, s, len(w) n, length(array_to_string(w, '')) c, len(regexp_extract_all(s, '{MARKS}')) m, len(regexp_extract_all(s, '{SEPARATORS}')) p,
              regexp_matches(s, '{NOTICES}') b FROM lw),
lr AS (SELECT doc_id, s, c, CASE WHEN n >= 2 AND m > 0 AND m * {LOUD} >= n THEN 1 WHEN p >= 3 AND p * {ITEM} >= n THEN 2 WHEN n <= {NOTICE} AND b THEN 3 ELSE 0 END r FROM lm),
ls AS (SELECT doc_id, count(*) n_lines, count(*) - count(DISTINCT s) n_dup_lines, count(*) FILTER (r = 1) n_punctuation, count(*) FILTER (r = 2) n_navigation,
              count(*) FILTER (r = 3) n_boilerplate, coalesce(sum(c) FILTER (r > 0), 0) lost_chars FROM lr GROUP BY 1),
g AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) i FROM d WHERE len(w) >= 3)),
rep AS (SELECT doc_id, count(DISTINCT p) n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) p FROM
        (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) c FROM g) WHERE c >= 2) GROUP BY 1),
b AS (SELECT d.doc_id, len(w) n_words, length(array_to_string(w, '')) word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) n_symbols,
             coalesce(n_dup_lines, 0) n_dup_lines, coalesce(rep.n, 0) n_repeat_words, coalesce(n_lines, 0) n_lines, coalesce(n_punctuation, 0) n_punctuation,
             coalesce(n_navigation, 0) n_navigation, coalesce(n_boilerplate, 0) n_boilerplate, coalesce(lost_chars, 0) lost_chars
      FROM d LEFT JOIN ls USING (doc_id) LEFT JOIN rep USING (doc_id)),
f AS (SELECT *, n_words < {MIN_WORDS} OR n_repeat_words * 100 > n_words * {MAX_REPEATED} base_failed FROM b)
SELECT * REPLACE (lost_chars::BIGINT AS lost_chars), NOT base_failed AND lost_chars * 100 <= word_chars * {MAX_LOSS} kept FROM f
"""
