"""Answers made to measure: composed ones that hit a target, and the baselines that do or do not."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vocabulary as v

SYSTEMS = ("reference", "blank", "ignore", "filler", "filler_keyword", "approximate", "off_by_one")
IGNORED = (
    "Much could be said here, and little of it fits. What matters depends on the reader, and readers differ. "
    "Those who have looked closely tend to agree on that much."
)


def capital(text: Column) -> Column:
    """The first character in upper case, the rest as it is."""
    return F.concat(F.upper(F.substring(text, 1, 1)), F.substring(text, F.lit(2), F.length(text)))


def _pick(table: list[str], *seed: Column) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in table]), (F.pmod(F.xxhash64(*seed), F.lit(len(table))) + 1).cast("int"))


def _units(n: Column, make) -> Column:
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), make)).otherwise(F.array().cast("array<string>"))


def _stem(table: tuple[str, ...], i: Column, keyword: Column, item: Column, salt: int) -> Column:
    """The stem of unit i: a rotation of the table by the item's hash, so neighbours differ."""
    shift = F.pmod(F.xxhash64(F.lit(salt), item), F.lit(len(table)))
    stem = F.element_at(F.array(*[F.lit(x) for x in table]), (F.pmod(i + shift, F.lit(len(table))) + 1).cast("int"))
    return F.replace(stem, F.lit("{k}"), keyword)


def words_answer(n: Column, keyword: Column, item: Column) -> Column:
    """n words; the keyword is the third, or the first of three or fewer; a full stop after every eleventh."""
    everyday = [w for k in range(2, 9) for w in v.filler(k, 8)]
    word = lambda i: F.when(i == F.when(n > 3, 3).otherwise(1), keyword).otherwise(_pick(everyday, F.lit(1), item, i))
    body = F.array_join(_units(n, lambda i: F.concat(word(i), F.when(((i - 1) % 11 == 0) & (i > 1), ".").otherwise(""))), " ")
    return F.concat(F.rtrim(capital(body), F.lit(".")), F.lit("."))


def sentences_answer(n: Column, keyword: Column, item: Column) -> Column:
    """n sentences."""
    return F.array_join(_units(n, lambda i: F.concat(capital(_stem(v.SENTENCES, i, keyword, item, 2)), F.lit("."))), " ")


def bullets_answer(n: Column, keyword: Column, item: Column, numbered: Column) -> Column:
    """n bullets, the first with one nested below it that is not of the list; numbered ones on demand."""

    def line(i: Column) -> Column:
        mark = F.when(numbered, F.concat(i.cast("string"), F.lit("."))).otherwise("-")
        nested = F.when((i == 1) & (n > 1), F.concat(F.lit("\n  - "), _pick(v.filler(8), F.lit(4), item), F.lit("."))).otherwise("")
        return F.concat(mark, F.lit(" "), _stem(v.ITEMS, i, keyword, item, 3), F.lit("."), nested)

    return F.array_join(_units(n, line), "\n")


def unique_answer(n: Column, keyword: Column, item: Column) -> Column:
    """n bullets of which no two say the same."""
    tag = lambda i: F.when(i > len(v.ITEMS), F.concat(F.lit(" case "), i.cast("string"))).otherwise("")
    return F.array_join(_units(n, lambda i: F.concat(F.lit("- "), _stem(v.ITEMS, i, keyword, item, 5), tag(i), F.lit("."))), "\n")


def lines_answer(n: Column, keyword: Column, item: Column) -> Column:
    """n lines, a blank one after the first of three or more."""
    gap = lambda i: F.when((i == 1) & (n > 2), "\n").otherwise("")
    return F.array_join(_units(n, lambda i: F.concat(_stem(v.ITEMS, i, keyword, item, 6), F.lit("."), gap(i))), "\n")


def paragraphs_answer(n: Column, keyword: Column, item: Column) -> Column:
    """n paragraphs of two lines."""
    half = lambda i: F.concat(_stem(v.SENTENCES, i, keyword, item, 7), F.lit("."))
    return F.array_join(_units(n, lambda i: F.concat(half(i * 2), F.lit("\n"), half(i * 2 + 1))), "\n\n")


def fill(n: int, keyword: str, item: str) -> str | None:
    """A text of n code points that holds the keyword; null when n is too small for it."""
    text = keyword[:1].upper() + keyword[1:]
    left = n - len(text) - 1
    if left < 0:
        return None
    k = sum(map(ord, item))
    while left > 0:
        # A space and a word; never leave one place, which no word with its space fits.
        size = left - 1 if left <= 9 else min(8, left - 3)
        text += " " + (v.filler(size)[k % 20] if size else "")
        left, k = left - 1 - size, k + 1
    return text + "."


def fill_sizes(left: Column) -> Column:
    """The sizes of the words that fill ``left`` places, each behind a space, as ``fill`` chooses them.

    All but the last are of 8 letters, 9 places each, while more than 10 places are left; 10 take one of 7 and one of 1, fewer one word.
    """
    eights = F.greatest(F.lit(0), F.floor((left - 2) / 9)).cast("int")
    rest = (left - eights * 9).cast("int")
    none = F.array().cast("array<int>")
    last = F.when(rest == 10, F.array(F.lit(7), F.lit(1))).when(rest > 0, F.array(rest - 1)).otherwise(none)
    return F.concat(F.array_repeat(F.lit(8), eights), last)


def chars_answer(n: Column, keyword: Column, item: Column) -> Column:
    """As ``fill``, in closed form: a text of n code points that holds the keyword; null when n is too small for it."""
    opener = F.concat(F.upper(F.substring(keyword, 1, 1)), F.substring(keyword, F.lit(2), F.length(keyword)))
    left = n - F.length(opener) - 1
    first = F.aggregate(F.filter(F.split(item, ""), lambda x: x != ""), F.lit(0), lambda s, x: s + F.ascii(x))
    words = F.array(*[F.array(*([F.lit(w) for w in v.filler(size)] if size else [F.lit("")] * 20)) for size in range(9)])
    said = F.transform(fill_sizes(left), lambda size, i: F.concat(F.lit(" "), F.get(F.get(words, size), (first + i) % 20)))
    return F.when(left >= 0, F.concat(opener, F.array_join(said, ""), F.lit(".")))


def composed(target: Column) -> Column:
    """An answer that meets ``target`` in the item's dimension (columns id, dimension, unique, keyword)."""
    k, i, d = F.col("keyword"), F.col("id"), F.col("dimension")
    numbered = F.pmod(F.regexp_extract("id", r"(\d+)\z", 1).try_cast("long"), F.lit(3)) == 0
    return (
        F.when(d == "words", words_answer(target, k, i))
        .when(d == "sentences", sentences_answer(target, k, i))
        .when((d == "bullets") & F.col("unique"), unique_answer(target, k, i))
        .when(d == "bullets", bullets_answer(target, k, i, F.coalesce(numbered, F.lit(False))))
        .when(d == "lines", lines_answer(target, k, i))
        .when(d == "paragraphs", paragraphs_answer(target, k, i))
    )


def filler_answer(target: Column, keyword: Column | None) -> Column:
    """The asked-for number of some unit, with the keyword in the first if there is one."""
    d = F.col("dimension")
    plain = lambda i, x: x if keyword is None else F.when(i == 1, keyword).otherwise(x)
    big = lambda i: F.lit("Item") if keyword is None else F.when(i == 1, F.concat(F.upper(F.substring(keyword, 1, 1)), F.lower(F.substring(keyword, F.lit(2), F.length(keyword))))).otherwise("Item")
    unit = lambda i: F.concat(plain(i, F.lit("item")), F.lit(" "), i.cast("string"))
    a = lambda n: F.repeat(F.lit("a"), n)
    head = None if keyword is None else F.concat(F.upper(F.substring(keyword, 1, 1)), F.lower(F.substring(keyword, F.lit(2), F.length(keyword))))
    chars = a(target) if head is None else F.when(target < F.length(head) + 2, a(target)).otherwise(F.concat(head, F.lit(" "), a(target - F.length(head) - 1)))
    return (
        F.when(d == "words", F.array_join(_units(target, lambda i: plain(i, F.lit("item"))), " "))
        .when(d == "sentences", F.array_join(_units(target, lambda i: F.concat(big(i), F.lit(" "), i.cast("string"), F.lit("."))), " "))
        .when(d == "bullets", F.array_join(_units(target, lambda i: F.concat(F.lit("- "), unit(i))), "\n"))
        .when(d == "lines", F.array_join(_units(target, unit), "\n"))
        .when(d == "paragraphs", F.array_join(_units(target, unit), "\n\n"))
        .when(d == "chars", chars)
    )


def wrong_target() -> Column:
    """The nearest target that does not meet the item's own (columns mode, target)."""
    return F.when(F.col("mode") == "at_least", F.greatest(F.lit(1), F.col("target") - 1)).otherwise(F.col("target") + 1)


def jitter(item: Column, target: Column) -> Column:
    """A displacement of up to 15% of the target, never 0, that depends on the item alone."""
    digest = F.sha2(item, 256)
    byte = lambda k: F.conv(F.substring(digest, k, 2), 16, 10).cast("int")
    span = F.greatest(F.lit(1), F.bround(target * F.lit(0.15)).cast("int"))
    step = F.pmod(byte(1), 2 * span) - span
    return F.when(step != 0, step).when(F.pmod(byte(3), F.lit(2)) == 1, 1).otherwise(-1)


def baseline(items: DataFrame, system: str) -> DataFrame:
    """(system, id, response) of one baseline for every item."""
    target = F.col("target")
    if system == "off_by_one":
        target = wrong_target()
    elif system == "approximate":
        near = F.greatest(F.lit(1), F.col("target") + jitter(F.col("id"), F.col("target")))
        target = F.when(F.col("dimension") == "chars", F.greatest(near, F.length("keyword") + 2)).otherwise(near)
    if system in ("reference", "off_by_one", "approximate"):
        aimed = items.withColumn("_n", target)
        text = F.when(F.col("dimension") == "chars", chars_answer(F.col("_n"), F.col("keyword"), F.col("id"))).otherwise(composed(F.col("_n")))
        return aimed.select(F.lit(system).alias("system"), "id", text.alias("response"))
    made = {
        "blank": F.lit(""),
        "ignore": F.lit(IGNORED),
        "filler": filler_answer(target, None),
        "filler_keyword": filler_answer(target, F.col("keyword")),
    }
    if system not in made:
        raise ValueError(f"no baseline {system!r}; there are {', '.join(SYSTEMS)}")
    return items.select(F.lit(system).alias("system"), "id", made[system].alias("response"))


def baselines(items: DataFrame, systems=SYSTEMS) -> DataFrame:
    """The answers of several baselines."""
    out = None
    for s in systems:
        own = baseline(items, s)
        out = own if out is None else out.unionByName(own)
    return out
