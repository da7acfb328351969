"""A recount: the published rules a second time, from the raw answers, by other expressions.

Nothing is shared with ``counters`` but the fixed character classes, abbreviations and how ends are trimmed: words are split off
rather than counted as matches, lines and bullets are counted as matches rather than split off, paragraphs are a fold over lines,
sentences are decided token by token rather than by masking, keywords are looked for as parts of a text that is reduced to its words. What two
formulations agree on is hardly wrong in both. All are Column expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import charclass as cc

FIELDS = ("compliant", "count_ok", "keyword_ok", "unique_ok")
_SPACES = cc.SPACES
_DASHES = "—–―−…"
_IN_LINE = rf"(?md)^ ?{cc.MARKER}[ \t]+"


def words(t: Column, dialect: str = "plain") -> Column:
    """Words, by any dialect."""
    if dialect == "whitespace":
        return F.regexp_count(t, F.lit(f"{cc.NOT_SPACE}++"))
    apart = _SPACES + _DASHES + ("-" if dialect == "hyphen_split" else "")
    holding = cc.LETTER if dialect == "alpha_only" else cc.LETTER_OR_DIGIT
    return F.size(F.filter(F.split(F.translate(t, apart, " " * len(apart)), " "), lambda x: x.rlike(holding)))


def sentences(t: Column) -> Column:
    """Sentences: a token that ends in a stop closes one, unless it is an abbreviation, a list's number or the next begins small."""
    numbered = F.regexp_replace(t, rf"(?md)^([ \t]*\p{{Nd}}+)\.(?!{cc.STOP})", "$1" + cc.MASK)
    tokens = F.split(F.translate(numbered, _SPACES, " " * len(_SPACES)), " +")
    short = rf"(?i)(?:\A|[^\p{{L}}.])\.*{cc.ABBREVIATION}\.{cc.CLOSER}*\z"
    small = lambda x: F.coalesce(x.rlike(r"\A\p{javaLowerCase}"), F.lit(False))
    ends = lambda x, after: x.rlike(rf"{cc.STOP}{cc.CLOSER}*\z") & ~x.rlike(short) & ~small(after)
    mark = lambda x, after: F.concat(x, F.when(ends(x, after), F.lit(cc.CUT)).otherwise(F.lit(" ")))
    # Named once: an expression that a function of elements names itself is worked out again for each element.
    marked = F.transform(F.array(tokens), lambda all_: F.array_join(F.zip_with(all_, F.slice(all_, F.lit(2), F.size(all_)), mark), ""))
    return F.regexp_count(F.get(marked, F.lit(0)), F.lit(rf"{cc.LETTER_OR_DIGIT}[^{cc.CUT}]*+"))


def paragraphs(t: Column) -> Column:
    """Paragraphs: a fold over lines of (how many are complete, whether the open one has a word)."""
    state = lambda n, word: F.struct(n.cast("int").alias("n"), word.alias("word"))

    def step(s: Column, line: Column) -> Column:
        return F.when(line.rlike(cc.NOT_SPACE), state(s["n"], s["word"] | line.rlike(cc.LETTER_OR_DIGIT))).otherwise(state(s["n"] + s["word"].cast("int"), F.lit(False)))

    return F.aggregate(F.split(t, "\n"), state(F.lit(0), F.lit(False)), step, lambda s: s["n"] + s["word"].cast("int"))


def counted(dimension: Column, t: Column) -> Column:
    """The published count of a dimension of a trimmed text."""
    made = {
        "words": words(t),
        "sentences": sentences(t),
        "bullets": F.regexp_count(t, F.lit(rf"{_IN_LINE}(?={cc.NOT_SPACE})")),
        "chars": F.length(t),
        "lines": F.regexp_count(t, F.lit(rf"{cc.LETTER_OR_DIGIT}[^\n]*+")),
        "paragraphs": paragraphs(t),
    }
    out = F.lit(None).cast("int")
    for d, n in made.items():
        out = F.when(dimension == d, n).otherwise(out)
    return out


def _folded(t: Column) -> Column:
    return F.lower(F.concat(F.upper(t), F.lit("")))


def has_keyword(t: Column, keyword: Column) -> Column:
    """Whether a keyword stands among the words of a text, both without anything but letters and digits."""
    apart = _SPACES + _DASHES + "-"
    bare = _folded(F.regexp_replace(F.translate(t, apart, " " * len(apart)), r"([\p{L}\p{N} ]*+)(?:[^\p{L}\p{N} ]++|\z)", "$1"))
    return F.contains(F.concat(F.lit(" "), bare, F.lit(" ")), F.concat(F.lit(" "), _folded(keyword), F.lit(" ")))


def repeats(t: Column) -> Column:
    """Whether two bullets say the same."""
    bodies = F.regexp_extract_all(t, F.lit(rf"{_IN_LINE}({cc.NOT_SPACE}[^\n]*)"), F.lit(1))
    keys = F.transform(bodies, lambda b: _folded(F.array_join(F.regexp_extract_all(b, F.lit(r"([\p{L}\p{N}]+)"), F.lit(1)), " ")))
    return F.size(F.array_distinct(keys)) < F.size(keys)


def _trimmed() -> Column:
    return F.btrim(F.coalesce("response", F.lit("")), F.lit(_SPACES))


def _meets(n: Column) -> Column:
    return F.when(F.col("mode") == "exact", n == F.col("target")).when(F.col("mode") == "at_most", n <= F.col("target")).otherwise(n >= F.col("target"))


def tallies(rows: DataFrame) -> DataFrame:
    """(system, n, compliant, count_ok, keyword_ok, unique_ok) of raw answers: items with ``system`` and ``response``."""
    t = F.col("_t")
    own = rows.select("system", "dimension", "mode", "target", "unique", "keyword", _trimmed().alias("_t"))
    made = own.select("system", t, _meets(counted(F.col("dimension"), t)).alias("count_ok"), has_keyword(t, F.col("keyword")).alias("keyword_ok"), (~(F.col("unique") & repeats(t))).alias("unique_ok"))
    whole = made.withColumn("compliant", (t != "") & F.col("count_ok") & F.col("keyword_ok") & F.col("unique_ok"))
    return whole.groupBy("system").agg(F.count("*").alias("n"), *[F.count_if(f).alias(f) for f in FIELDS])


def words_spread(rows: DataFrame) -> DataFrame:
    """(system, spread_points): how far the rules for words move the rate of raw answers to items about words."""
    dialects = ("plain", "hyphen_split", "whitespace", "alpha_only")
    own = rows.where("dimension = 'words'").withColumn("_t", _trimmed())
    rates = own.groupBy("system").agg(*[F.bround(F.count_if(_meets(words(F.col("_t"), d))) / F.count("*"), 4).alias(d) for d in dialects])
    return rates.select("system", F.bround((F.greatest(*dialects) - F.least(*dialects)) * 100, 2).alias("spread_points"))
