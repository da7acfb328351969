"""Counters: words, sentences, bullets, items, characters, lines and paragraphs, each under several rules.

All are Column expressions, so Catalyst plans them like any other; only Unicode normalisation and exact case
folding, which Spark lacks, are Arrow-batched pandas UDFs. A null text gives null.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from . import charclass as cc

# The dialects of each dimension, and the one that scores are published under.
DIALECTS = {
    "words": ("plain", "hyphen_split", "whitespace", "alpha_only"),
    "sentences": ("plain", "naive", "newline_breaks", "require_terminator"),
    "bullets": ("plain", "all_levels", "dash_only"),
    "items": ("normalized", "exact", "first_word"),
    "chars": ("codepoints", "no_whitespace", "utf8_bytes", "nfc_codepoints"),
    "lines": ("nonblank", "all_lines", "stripped_all"),
    "paragraphs": ("blank_line", "single_newline", "indent_or_blank"),
}
PUBLISHED = {
    "words": "plain",
    "sentences": "plain",
    "bullets": "plain",
    "items": "normalized",
    "chars": "codepoints",
    "lines": "nonblank",
    "paragraphs": "blank_line",
}
COUNTED = tuple(d for d in DIALECTS if d != "items")


class UnknownDialect(ValueError):
    """A dimension or dialect that does not exist; nothing is ever counted by a rule that was not asked for."""


def check(dimension: str, dialect: str) -> str:
    """``dialect``, if ``dimension`` has it."""
    if dimension not in DIALECTS:
        raise UnknownDialect(f"no dimension {dimension!r}; there are {', '.join(DIALECTS)}")
    if dialect not in DIALECTS[dimension]:
        raise UnknownDialect(f"{dimension} has no dialect {dialect!r}; it has {', '.join(DIALECTS[dimension])}")
    return dialect


def ruleset(overrides: dict[str, str] | None = None) -> dict[str, str]:
    """The published rules with some dialects replaced."""
    return PUBLISHED | {k: check(k, v) for k, v in (overrides or {}).items()}


def alternatives(dimension: str) -> list[str]:
    """The dialects of a dimension other than the published one."""
    return [d for d in DIALECTS[dimension] if d != PUBLISHED[dimension]]


def _holding(pieces: Column, what: str) -> Column:
    return F.filter(pieces, lambda x: x.rlike(what))


def strip(text: Column) -> Column:
    """Without white space at both ends; Spark's trim knows the space alone."""
    return F.btrim(text, F.lit(cc.SPACES))


def split_lines(text: Column) -> Column:
    """Lines end at line feeds only."""
    return F.split(text, "\n")


def words(text: Column, dialect: str = "plain") -> Column:
    """The words of a text, as an array."""
    check("words", dialect)
    if dialect == "whitespace":
        return F.filter(F.split(text, f"{cc.SPACE}+"), lambda x: x != "")
    apart = F.regexp_replace(text, cc.DASH_OR_HYPHEN if dialect == "hyphen_split" else cc.DASH, " ")
    return _holding(F.split(apart, f"{cc.SPACE}+"), cc.LETTER if dialect == "alpha_only" else cc.LETTER_OR_DIGIT)


def _count_words(text: Column, dialect: str) -> Column:
    """As the size of ``words``: one match a word, from what makes it one to where the next may begin.

    A match takes what lies between words with it, so the search never tries a place in vain.
    """
    if dialect == "whitespace":
        return F.regexp_count(text, F.lit(rf"(?:[!-~]|{cc.NOT_SPACE})[!-~]*+(?: |[!-~{cc.SOLID}]*+{cc.NOT_SPACE}*+)"))
    holding = cc.LETTER if dialect == "alpha_only" else cc.LETTER_OR_DIGIT
    hyphen, printed = ("-", "!-,.-~") if dialect == "hyphen_split" else ("", "!-~")
    # Most of a word is printed ASCII, for which a small class is faster, and a space mostly ends it.
    rest = rf"(?: |[{printed}{cc.SOLID}]*+[^{cc.SPACE[1:-1]}{cc.DASH[1:-1]}{hyphen}]*+)"
    return F.regexp_count(text, F.lit(rf"{holding}[{printed}]*+{rest}[^\p{{L}}{'' if dialect == 'alpha_only' else r'\p{N}'}]*+"))


def _segments(text: Column) -> Column:
    """Pieces between cuts; the last one is what no stop closes.

    Stops after abbreviations and list numbers are masked first, so that one linear pass finds the cuts.
    """
    lone = rf"\.(?!{cc.STOP})"
    masked = F.regexp_replace(text, rf"(?i)\.(?<=(?<![\p{{L}}.])\.{{0,16}}{cc.ABBREVIATION}\.)(?!{cc.STOP})", cc.MASK)
    masked = F.regexp_replace(masked, rf"(?md)^([ \t]*\p{{Nd}}+){lone}", f"$1{cc.MASK}")
    end = rf"{cc.STOP}++{cc.CLOSER}*+(?:\z|(?={cc.SPACE})(?!{cc.SPACE}*+\p{{javaLowerCase}}))"
    return F.split(F.regexp_replace(masked, end, f"$0{cc.CUT}"), cc.CUT, -1)


def sentences(text: Column, dialect: str = "plain") -> Column:
    """The sentences of a text, as an array."""
    check("sentences", dialect)
    if dialect == "naive":
        return _holding(F.split(text, f"{cc.STOP}+"), cc.LETTER_OR_DIGIT)
    if dialect == "newline_breaks":
        found = F.flatten(F.transform(split_lines(text), _segments))
    elif dialect == "require_terminator":
        found = _segments(text)
        found = F.slice(found, F.lit(1), F.size(found) - 1)
    else:
        found = _segments(text)
    return F.transform(_holding(found, cc.LETTER_OR_DIGIT), lambda s: strip(F.translate(s, cc.MASK, ".")))


def _marker(dialect: str) -> str:
    indent = r"[ \t]*" if dialect == "all_levels" else " ?"  # less than two columns: no tab, one space at most
    return rf"\A{indent}{cc.SYMBOL if dialect == 'dash_only' else cc.MARKER}[ \t]+"


def bullets(text: Column, dialect: str = "plain") -> Column:
    """The lines of a text that are bullets."""
    check("bullets", dialect)
    return _holding(split_lines(text), rf"{_marker(dialect)}(?={cc.NOT_SPACE})")


def bullet_bodies(text: Column, dialect: str = "plain") -> Column:
    """What follows the markers."""
    return F.transform(bullets(text, dialect), lambda x: F.regexp_replace(x, _marker(dialect), ""))


def bullet_parts(text: Column, dialect: str = "plain") -> Column:
    """Each bullet as (width, marker, body); a tab is four columns wide."""
    part = lambda x, g: F.regexp_extract(x, rf"(?s)\A([ \t]*)({cc.MARKER})[ \t]+(.*)\z", g)
    return F.transform(
        bullets(text, dialect),
        lambda x: F.struct(F.length(F.replace(part(x, 1), F.lit("\t"), F.lit("    "))).alias("width"), part(x, 2).alias("marker"), part(x, 3).alias("body")),
    )


@F.pandas_udf(StringType())
def casefold(s: pd.Series) -> pd.Series:
    """Unicode case folding."""
    return s.map(lambda x: x if x is None else x.casefold())


@F.pandas_udf(StringType())
def nfc(s: pd.Series) -> pd.Series:
    """Unicode normalisation form C."""
    return s.map(lambda x: x if x is None else unicodedata.normalize("NFC", x))


def fold(text: Column) -> Column:
    """Case folding with built-in functions: like ``casefold`` but for some rare code points.

    Upper case first, since that is what turns ß into two letters; the optimizer would drop it if lower() stood
    right around it.
    """
    return F.lower(F.concat(F.upper(text), F.lit("")))


def item_key(body: Column, dialect: str = "normalized", folded: Callable[[Column], Column] = fold) -> Column:
    """What two items must have in common to be the same."""
    check("items", dialect)
    if dialect == "exact":
        return strip(body)
    if dialect == "first_word":
        # As the first of words(), without cutting up the rest: pieces that hold none are passed over once.
        apart = f"{cc.SPACE[1:-1]}{cc.DASH[1:-1]}"
        mark = rf"[^\p{{L}}\p{{N}}{apart}]"
        return folded(F.regexp_extract(body, rf"\A(?:{mark}*+[{apart}]++)*+({mark}*+{cc.LETTER_OR_DIGIT}[^{apart}]*+)", 1))
    # One space for all that stands between two letters or digits, where it is not one already.
    bare = F.regexp_replace(body, rf" ?[^\p{{L}}\p{{N}} ]{cc.NEITHER}*+| {{2}}{cc.NEITHER}*+", " ")
    return folded(F.btrim(bare))


def item_keys(text: Column, bullet_dialect: str = "plain", item_dialect: str = "normalized") -> Column:
    """The keys of a text's bullets, in order."""
    return F.transform(bullet_bodies(text, bullet_dialect), lambda b: item_key(b, item_dialect))


def duplicate_keys(keys: Column) -> Column:
    """Keys in the order in which they are met a second time."""
    second = F.filter(keys, lambda k, i: F.size(F.filter(F.slice(keys, F.lit(1), i), lambda x: x == k)) == 1)
    return second


def has_duplicates(keys: Column) -> Column:
    """Whether any key is there twice; the test that needs no search."""
    return F.size(keys) > F.size(F.array_distinct(keys))


def chars(text: Column, dialect: str = "codepoints") -> Column:
    """The number of characters."""
    check("chars", dialect)
    if dialect == "no_whitespace":
        return F.length(F.translate(text, cc.SPACES, ""))
    if dialect == "utf8_bytes":
        return F.octet_length(strip(text))
    bare = strip(text)
    if dialect == "nfc_codepoints":
        # Only texts that normalisation may change go to Python.
        odd = ~bare.rlike(rf"\A{cc.COMPOSED_OFTEN}{cc.COMPOSED}*+\z")
        return F.length(F.coalesce(nfc(F.when(odd, bare)), bare))
    return F.length(bare)


def lines(text: Column, dialect: str = "nonblank") -> Column:
    """The lines of a text that count."""
    check("lines", dialect)
    if dialect == "all_lines":
        bare = F.btrim(text, F.lit("\n"))
        return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, "\n", -1))
    return _holding(split_lines(text), cc.NOT_SPACE if dialect == "stripped_all" else cc.LETTER_OR_DIGIT)


def paragraphs(text: Column, dialect: str = "blank_line") -> Column:
    """The paragraphs of a text."""
    check("paragraphs", dialect)
    if dialect == "single_newline":
        return lines(text)
    blank = rf"\n(?:{cc.SPACE_IN_LINE}*\n)+"
    indent = rf"|\n(?=[ \t][^\n]*{cc.NOT_SPACE})" if dialect == "indent_or_blank" else ""
    return _holding(F.split(text, blank + indent), cc.LETTER_OR_DIGIT)


_BUILDERS = {"words": words, "sentences": sentences, "bullets": bullets, "lines": lines, "paragraphs": paragraphs}


def count(dimension: str, text: Column, rules: dict[str, str] | None = None) -> Column:
    """How many of ``dimension`` a text has."""
    if dimension not in COUNTED:
        raise UnknownDialect(f"nothing counts {dimension!r}")
    dialect = check(dimension, (rules or PUBLISHED).get(dimension, PUBLISHED[dimension]))
    if dimension == "chars":
        return chars(text, dialect).cast("int")
    if dimension == "words":
        return _count_words(text, dialect)
    if dimension == "sentences" and dialect != "naive":
        # As sentences(), without building the pieces' text.
        if dialect == "newline_breaks":
            found = F.flatten(F.transform(split_lines(text), _segments))
        elif dialect == "require_terminator":
            # By a lambda, so that pieces are found once and not again for their number.
            found = F.get(F.transform(F.array(_segments(text)), lambda s: F.slice(s, F.lit(1), F.size(s) - 1)), F.lit(0))
        else:
            found = _segments(text)
        return F.size(_holding(found, cc.LETTER_OR_DIGIT))
    return F.size(_BUILDERS[dimension](text, dialect))


def with_counts(df: DataFrame, text: str = "text", dimensions=COUNTED, prefix: str = "") -> DataFrame:
    """``df`` with a column <dimension>_<dialect> for each dialect of the dimensions."""
    return df.withColumns({f"{prefix}{d}_{k}": count(d, F.col(text), {d: k}) for d in dimensions for k in DIALECTS[d]})


# The rules, in the words that a prompt shows.
EXPLANATIONS = {
    "words": (
        "Split the answer on whitespace. A token counts as one word if it contains at least one letter or digit.",
        "A hyphenated compound such as state-of-the-art is ONE word.",
        "A contraction such as don't is ONE word.",
        "A number such as 3.14 or 1,000 is ONE word, and so is a URL.",
        "A token with no letter or digit in it, such as a lone dash or an emoji, is NOT a word.",
        "An em dash or an en dash separates the tokens on either side of it. A hyphen does not.",
    ),
    "sentences": (
        "A sentence ends at a full stop, an exclamation mark, a question mark or an ellipsis,"
        " together with any closing quote or bracket that follows it.",
        "A full stop inside a number such as 3.14 does not end a sentence.",
        "A full stop after a common abbreviation such as Dr. or e.g. does not end a sentence.",
        "A full stop closing a list marker such as 1. at the start of a line does not end a sentence.",
        "A full stop followed by a lowercase letter does not end a sentence.",
        "Text after the last terminator counts as a sentence if it contains a word, so a"
        " trailing fragment with no full stop still counts.",
    ),
    "bullets": (
        "A bullet is a line beginning with -, *, +, a bullet character, or a marker such as 1.,"
        " 1) or a), followed by a space and some text.",
        "The line must be indented by fewer than 2 columns, so a nested sub-bullet does NOT count as a bullet of the list.",
        "A numbered list DOES count as bullets.",
    ),
    "items": (
        "Two items are the same item if they match after casefolding, dropping punctuation and"
        " collapsing whitespace, so Red apples. and red apples are ONE item repeated.",
    ),
    "chars": (
        "Characters are Unicode code points, counted after removing whitespace from the start and the end of the answer.",
        "Spaces between words DO count. Punctuation counts.",
    ),
    "lines": ("A line counts if it contains at least one word. Blank lines do not count.",),
    "paragraphs": (
        "Paragraphs are separated by one or more blank lines.",
        "A block counts as a paragraph if it contains at least one word.",
    ),
}


def explain(dimension: str, unique: bool = False) -> str:
    """The published rule of a dimension, a line for each part."""
    return "\n".join(f"- {x}" for x in EXPLANATIONS[dimension] + (EXPLANATIONS["items"] if unique else ()))
