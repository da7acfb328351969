"""The counting rules in plain Python, a text at a time: what tests hold the Column expressions against."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter

from tallymark.functions.charclass import ABBREVIATIONS

STOPS, CLOSERS, DASHES = ".!?…", "\"'’”)]}»", "—–―−…"


def has_word(s):
    return any(ch.isalnum() for ch in s)


def words(t, dialect):
    if dialect == "whitespace":
        return len(t.split())
    for ch in DASHES + ("-" if dialect == "hyphen_split" else ""):
        t = t.replace(ch, " ")
    ok = (lambda w: any(ch.isalpha() for ch in w)) if dialect == "alpha_only" else has_word
    return sum(map(ok, t.split()))


def cuts(t):
    """Pieces of a text, and whether a stop closes each; a scan from left to right, unlike the masks."""
    out, begin, i = [], 0, 0
    while i < len(t):
        if t[i] not in STOPS:
            i += 1
            continue
        end = i
        while end < len(t) and t[end] in STOPS:
            end += 1
        lone = t[i:end] == "."
        if lone and re.search(r"(?:^|\n)[ \t]*\d+$", t[:i]):
            i = end
            continue
        run = re.search(r"[^\W\d_.]*(?:[^\W\d_]|\.)*$", t[:i]).group().strip(".").lower()
        if lone and run in ABBREVIATIONS:
            i = end
            continue
        after = end
        while after < len(t) and t[after] in CLOSERS:
            after += 1
        rest = t[after:].lstrip()
        if (after == len(t) or t[after].isspace()) and not rest[:1].islower():
            out.append((t[begin:after], True))
            begin = after
        i = max(end, after)
    return [*out, (t[begin:], False)]


def sentences(t, dialect):
    if dialect == "naive":
        return sum(map(has_word, re.split("[.!?…]+", t)))
    if dialect == "newline_breaks":
        return sum(sentences(x, "plain") for x in t.split("\n"))
    return sum(has_word(s) for s, closed in cuts(t) if closed or dialect == "plain")


def bullets(t, dialect):
    n = 0
    for line in t.split("\n"):
        marks = r"[-*+•‣●·]" if dialect == "dash_only" else r"(?:[-*+•‣●·]|\d{1,3}[.)]|\(\d{1,3}\)|[a-zA-Z][.)])"
        m = re.match(rf"([ \t]*){marks}[ \t]+(?=\S)", line)
        n += bool(m) and (dialect == "all_levels" or len(m.group(1).replace("\t", "    ")) < 2)
    return n


def chars(t, dialect):
    if dialect == "no_whitespace":
        return len("".join(t.split()))
    t = t.strip()
    return len(t.encode()) if dialect == "utf8_bytes" else len(unicodedata.normalize("NFC", t) if dialect == "nfc_codepoints" else t)


def lines(t, dialect):
    if dialect == "all_lines":
        t = t.strip("\n")
        return len(t.split("\n")) if t else 0
    return sum(bool(x.strip()) if dialect == "stripped_all" else has_word(x) for x in t.split("\n"))


def paragraphs(t, dialect):
    if dialect == "single_newline":
        return lines(t, "nonblank")
    closed, word = 0, False  # paragraphs so far; whether the open one has a word
    for line in t.split("\n"):
        if not line.strip() or dialect == "indent_or_blank" and line[0] in " \t":
            closed, word = closed + word, False
        word = word or has_word(line)
    return closed + word


COUNT = {"words": words, "sentences": sentences, "bullets": bullets, "chars": chars, "lines": lines, "paragraphs": paragraphs}

_ITEM = re.compile(r"([ \t]*)(?:[-*+•‣●·]|\d{1,3}[.)]|\(\d{1,3}\)|[a-zA-Z][.)])[ \t]+(\S.*)")
FIELDS = ("compliant", "count_ok", "keyword_ok", "unique_ok")


def bodies(t):
    found = [_ITEM.match(line) for line in t.split("\n")]
    return [m.group(2) for m in found if m and len(m.group(1).replace("\t", "    ")) < 2]


def repeats(t):
    said = Counter(tuple(w.casefold() for w in re.findall(r"[^\W_]+", b)) for b in bodies(t))
    return any(n > 1 for n in said.values())


def has_keyword(t, keyword):
    for ch in DASHES + "-":
        t = t.replace(ch, " ")
    return any("".join(ch for ch in w if ch.isalnum()).casefold() == keyword.casefold() for w in t.split())


def verdict(row, rules):
    """FIELDS of one answer; ``row`` has dimension, mode, target, unique, keyword and response."""
    t = ("" if row.response is None else row.response).strip()
    n = COUNT[row.dimension](t, rules[row.dimension])
    count = {"exact": n == row.target, "at_most": n <= row.target, "at_least": n >= row.target}[row.mode]
    keyword, unique = has_keyword(t, row.keyword), not (row.unique and repeats(t))
    return t != "" and count and keyword and unique, count, keyword, unique
