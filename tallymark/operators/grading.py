"""Grading answers against items: a count constraint, a required keyword, and no repeated items."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import charclass as cc
from ..functions import counters as c
from ..functions.vocabulary import EXACT

MODES = ("exact", "at_most", "at_least")
# Bounds of the histogram of errors.
BUCKETS = ("<=-10", "-9..-5", "-4..-2", "-1", "0", "+1", "+2..+4", "+5..+9", ">=+10")
_FENCE = rf"(?s)\A{cc.SPACE}*```[a-zA-Z0-9_+-]*{cc.SPACE}*\n(.*?)\n{cc.SPACE}*```{cc.SPACE}*\z"
_PREAMBLE = r"\A[^\n]{0,120}:[ \t]*\n"
_SELF_COUNT = (
    rf"(?i)(?:\n{cc.SPACE_IN_LINE}*\(?{cc.SPACE_IN_LINE}*(?:that is |this is |{EXACT} )?\p{{Nd}}+{cc.SPACE_IN_LINE}+"
    rf"(?:words?|characters?|chars?|sentences?|bullets?|lines?|paragraphs?|items?)(?![\p{{L}}\p{{N}}_])[^\n]*)+\z"
)


def satisfies(mode: Column, observed: Column, target: Column) -> Column:
    """Whether a count meets its constraint; another mode fails the query."""
    return (
        F.when(mode == "exact", observed == target)
        .when(mode == "at_most", observed <= target)
        .when(mode == "at_least", observed >= target)
        .otherwise(F.raise_error(F.concat(F.lit("no such mode: "), F.coalesce(mode, F.lit("null")))).cast("boolean"))
    )


def keyword_present(text: Column, keyword: Column) -> Column:
    """Whether a whole word is the keyword, whatever its case; hyphens and dashes separate, punctuation is dropped."""
    apart = cc.SPACES + cc.DASH_OR_HYPHEN[1:-1]
    parted = F.translate(text, apart, " " * len(apart))
    # Each match begins where the one before ends, so no place is tried in vain.
    bare = F.regexp_replace(parted, r"([A-Za-z0-9 ]*+[\p{L}\p{N} ]*+)(?:[^\p{L}\p{N} ]++|\z)", "$1")
    return F.array_contains(F.split(c.fold(bare), " "), c.fold(keyword)) & (keyword != "")


def _once(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that it names several times, worked out once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def unwrap(text: Column) -> Column:
    """Struct (text, notes): a text without the packaging it was asked not to have.

    In turn: a code fence around all, a short first line that ends in a colon, lines at the end that state a count.
    """
    def fence(body: Column) -> Column:
        fenced = body.rlike(_FENCE)
        inner = F.when(fenced, F.regexp_extract(body, _FENCE, 1)).otherwise(body)
        return _once(F.struct(inner.alias("body"), fenced.alias("fenced")), lambda x: preamble(x["body"], x["fenced"]))

    def preamble(body: Column, fenced: Column) -> Column:
        led = body.rlike(_PREAMBLE) & (F.size(c.words(F.substring_index(body, "\n", 1))) <= 14)
        rest = F.rtrim(F.when(led, F.regexp_replace(body, _PREAMBLE, "")).otherwise(body), F.lit(cc.SPACES))
        return _once(F.struct(rest.alias("body"), led.alias("led")), lambda x: tail(x["body"], fenced, x["led"]))

    def tail(body: Column, fenced: Column, led: Column) -> Column:
        said = F.regexp_extract(body, _SELF_COUNT, 0)
        n = F.length(said) - F.length(F.replace(said, F.lit("\n"), F.lit("")))
        notes = F.concat(
            F.filter(
                F.array(F.when(fenced, F.lit("code fence")), F.when(led, F.lit("preamble line"))), lambda x: x.isNotNull()
            ),
            F.array_repeat(F.lit("self reported count"), n.cast("int")),
        )
        return F.struct(c.strip(F.regexp_replace(body, _SELF_COUNT, "")).alias("text"), notes.alias("notes"))

    return _once(c.strip(text), fence)


def bucket(error: Column) -> Column:
    """The histogram's bucket of a signed error."""
    chain = F.when(error <= -10, BUCKETS[0])
    for most, name in zip((-5, -2, -1, 0, 1, 4, 9), BUCKETS[1:8], strict=True):
        chain = chain.when(error <= most, name)
    return chain.when(error > 9, BUCKETS[8])


def observed(dimension: Column, text: Column, rules: dict[str, str] | None = None) -> Column:
    """The count that an item's dimension asks for."""
    chain = reduce(lambda w, d: w.when(dimension == d, c.count(d, text, rules)), c.COUNTED[1:], F.when(dimension == c.COUNTED[0], c.count(c.COUNTED[0], text, rules)))
    return chain.otherwise(F.raise_error(F.concat(F.lit("nothing counts "), F.coalesce(dimension, F.lit("null")))).cast("int"))


def answers_of(items: DataFrame, responses: DataFrame, system: bool = True) -> DataFrame:
    """Every item of every system with its response; an item without one has null, and is graded as empty.

    ``responses`` has (id, response), with ``system`` also (system).
    """
    if not system:
        return items.join(responses.select("id", "response"), "id", "left")
    systems = responses.select("system").distinct()
    return items.crossJoin(systems).join(responses.select("system", "id", "response"), ["system", "id"], "left")


def grade(rows: DataFrame, rules: dict[str, str] | None = None, lenient: bool = False) -> DataFrame:
    """``rows`` (items with a ``response``) with the verdict on each.

    Adds observed, error, count_ok, keyword_ok, unique_ok, empty, compliant, unwrapped and reasons. A null
    response is an empty one: it can meet an upper bound and is still never compliant.
    """
    rules = c.ruleset(rules)
    raw = F.coalesce("response", F.lit(""))
    if lenient:
        out = rows.withColumn("_u", unwrap(raw)).withColumns({"_text": F.col("_u.text"), "unwrapped": F.col("_u.notes")}).drop("_u")
    else:
        out = rows.withColumns({"_text": c.strip(raw), "unwrapped": F.array().cast("array<string>")})
    text = F.col("_text")
    keys = c.item_keys(text, rules["bullets"], rules["items"])
    out = out.withColumns({"observed": observed(F.col("dimension"), text, rules), "_keys": F.when(F.col("unique"), keys)})
    out = out.withColumns(
        {
            "error": F.col("observed") - F.col("target"),
            "count_ok": satisfies(F.col("mode"), F.col("observed"), F.col("target")),
            "keyword_ok": keyword_present(text, F.col("keyword")),
            "unique_ok": ~F.coalesce(c.has_duplicates(F.col("_keys")), F.lit(False)),
            "empty": text == "",
        }
    )
    reasons = F.array(
        F.when(F.col("empty"), F.lit("the response is empty")),
        F.when(~F.col("count_ok"), F.format_string("%d %s against a target of %d", "observed", "dimension", "target")),
        F.when(~F.col("keyword_ok"), F.format_string("the required word '%s' is missing", "keyword")),
        F.when(~F.col("unique_ok"), F.format_string("%d repeated item(s)", F.size(c.duplicate_keys(F.col("_keys"))))),
    )
    return out.withColumns(
        {
            "compliant": ~F.col("empty") & F.col("count_ok") & F.col("keyword_ok") & F.col("unique_ok"),
            "reasons": F.filter(reasons, lambda x: x.isNotNull()),
        }
    ).drop("_text", "_keys")
