"""Counts of texts that are too large for a row: a text is a stream of lines in any number of rows and tasks.

Words lie within lines. Paragraphs are islands of lines between blank ones, numbered by a running sum of their first lines.
Sentences are cut within each line; whether the stop at a line's end closes one depends on the next line that is not blank, and what
stays open goes on in the next line, so pieces are numbered by a running sum of cuts. Both are carried over the borders
of tasks by ``ordered``; no task holds a text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import charclass as cc
from ..functions import counters as c
from ..sources.scratch import dropped, written
from .ordered import in_ranges, neighbours, running_sums

#: What is counted: all rules that need no Unicode normalisation.
COUNTS = [f"{d}_{k}" for d in ("words", "lines", "paragraphs", "sentences") for k in c.DIALECTS[d]]


def as_lines(texts: DataFrame, text: str, order: list[str]) -> DataFrame:
    """The lines of texts, with ``line_no``; texts that follow each other by ``order`` are parts of a larger one.

    A null text has no lines, an empty one has one.
    """
    keep = [F.col(f"`{x}`") for x in texts.columns if x != text]
    return texts.select(*keep, F.posexplode(F.split(F.col(f"`{text}`"), "\n")).alias("line_no", "line"))


def _cuts(line: Column, naive: bool) -> Column:
    """Pieces of a line between cuts, as if nothing followed it."""
    return F.split(line, f"{cc.STOP}+", -1) if naive else c._segments(line)


def _pieces(lines: DataFrame, by: list[str], naive: bool) -> tuple[DataFrame, list[DataFrame]]:
    """(by..., all, closed): pieces of a text with a word, and those that a stop closes; and the tables behind it."""
    word = lambda x: x.rlike(cc.LETTER_OR_DIGIT)
    cut = lines.withColumn("_s", _cuts(F.col("line"), naive))
    last = F.element_at("_s", -1)
    # A stop at the end of a line closes nothing if the text goes on with a small letter.
    doubtful = F.lit(False) if naive else (F.size("_s") > 1) & ~last.rlike(cc.NOT_SPACE) & F.coalesce(F.col("_small"), F.lit(False))
    n = F.size("_s") - 1 - doubtful.cast("int")
    held = F.transform("_s", word)
    inner = F.size(F.filter(F.slice(held, 2, F.greatest(F.col("_n") - 1, F.lit(0))), lambda x: x))
    # Pieces that begin and end in the line are counted at once; only its first and last are known to other lines.
    sized = cut.withColumn("_n", n).select(*[x for x in lines.columns if x != "line"], "_n", inner.alias("_inner"), F.get(held, F.lit(0)).alias("_head"), F.exists(F.slice(held, F.col("_n") + 1, F.size(held)), lambda x: x).alias("_tail"))
    placed = written(running_sums(sized, by, {"_base": F.col("_n")}))
    edge = lambda offset, w: F.struct((F.col("_base") + offset).alias("p"), w.alias("w"))
    edges = placed.select(*by, F.explode(F.array(edge(F.lit(0), F.when(F.col("_n") > 0, F.col("_head")).otherwise(F.col("_tail"))), edge(F.col("_n"), F.col("_tail")))).alias("e"))
    shared = edges.where("e.w").select(*by, F.col("e.p").alias("p")).distinct()
    totals = placed.groupBy(*by).agg(F.sum("_inner").alias("inner"), F.sum("_n").alias("cuts"))
    keys = {f"_k{i}": x for i, x in enumerate(by)}
    named = totals.select(*[F.col(f"`{x}`").alias(k) for k, x in keys.items()], "inner", "cuts")
    same = [F.col(f"`{x}`").eqNullSafe(F.col(k)) for k, x in keys.items()]
    found = named.join(shared, same, "left").groupBy(*keys, "inner", "cuts").agg(F.count("p").alias("n"), F.count_if(F.col("p") < F.col("cuts")).alias("m"))
    return found.select(*[F.col(k).alias(x) for k, x in keys.items()], (F.col("inner") + F.col("n")).alias("all"), (F.col("inner") + F.col("m")).alias("closed")), [placed]


def counts(lines: DataFrame, by: list[str], order: list[str], parts: int | None = None) -> DataFrame:
    """(by..., COUNTS): what each text has, by every rule; a row for each text that has a line.

    ``lines`` has ``by`` (which text; at least one column), ``order`` (columns that no two lines of a text share) and ``line``, without line
    feeds. Every count is that of ``counters`` for the text in one piece, lines joined by line feeds. A null line is an empty one.
    Nulls in ``by`` are a text; other columns are ignored. An empty table gives no rows. ``parts``: so many ranges, or as many as Spark sees fit.
    """
    own = lines.select(*[F.col(f"`{x}`") for x in dict.fromkeys([*by, *order])], F.coalesce("line", F.lit("")).alias("line"))
    ranges = in_ranges(own, [*by, *[x for x in order if x not in by]], parts)
    line = F.col("line")
    held, blank = line.rlike(cc.LETTER_OR_DIGIT), ~line.rlike(cc.NOT_SPACE)
    slim = ranges.select(*by, "_part", "_row", "line")

    simple = {f"words_{k}": F.sum(F.size(c.words(line, k))) for k in c.DIALECTS["words"]} | {
        "lines_nonblank": F.count_if(held),
        "lines_stripped_all": F.count_if(~blank),
        "paragraphs_single_newline": F.count_if(held),
        "sentences_newline_breaks": F.sum(c.count("sentences", line)),
    }
    summed = slim.groupBy(*by).agg(*[v.cast("long").alias(k) for k, v in simple.items()])

    # All lines but empty ones before the first and after the last that is not.
    numbered = running_sums(slim.select(*by, "_part", "_row", (line != "").alias("some")), by, {"i": F.lit(1)}).groupBy(*by)
    span = numbered.agg(F.coalesce(F.max(F.when(F.col("some"), F.col("i"))) - F.min(F.when(F.col("some"), F.col("i"))) + 1, F.lit(0)).alias("lines_all_lines"))

    facts = slim.select(*by, "_part", "_row", blank.alias("blank"), held.alias("held"), line.rlike(r"\A[ \t]").alias("indented"))
    near = neighbours(facts, by, "blank", "before", "after")
    opens = ~F.col("blank") & F.coalesce(F.col("before"), F.lit(True))
    blocks = []
    for k, first in (("blank_line", opens), ("indent_or_blank", opens | ~F.col("blank") & F.col("indented"))):
        marked = near.select(*by, "_part", "_row", "held", "blank", first.cast("int").alias("first"))
        islands = running_sums(marked, by, {"n": F.col("first")}).where("not blank").withColumn("n", F.col("n") + F.col("first"))
        kept = islands.where("held").select(*by, "n").distinct()
        blocks.append(kept.groupBy(*by).agg(F.count("*").alias(f"paragraphs_{k}")))

    full = slim.where(~blank).withColumn("_lower", line.rlike(rf"\A{cc.SPACE}*+\p{{javaLowerCase}}"))
    careful = neighbours(full, by, "_lower", "_before", "_small").drop("_lower", "_before")
    plain, a = _pieces(careful, by, False)
    naive, b = _pieces(slim, by, True)
    plain = plain.withColumnsRenamed({"all": "sentences_plain", "closed": "sentences_require_terminator"})
    naive = naive.select(*by, F.col("all").alias("sentences_naive"))

    tables = [summed, span, *blocks, plain, naive]
    all_ = tables[0].select(*[F.col(f"`{x}`").alias(f"_t{i}") for i, x in enumerate(by)], *simple)
    for t in tables[1:]:
        same = [F.col(f"`{x}`").eqNullSafe(F.col(f"_t{i}")) for i, x in enumerate(by)]
        all_ = all_.join(t, same, "left").drop(*by)
    out = written(all_.select(*[F.col(f"_t{i}").alias(x) for i, x in enumerate(by)], *[F.coalesce(k, F.lit(0)).cast("long").alias(k) for k in COUNTS]))
    for table in (ranges, *a, *b):
        dropped(table)
    return out
