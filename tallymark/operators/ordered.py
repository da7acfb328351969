"""Running values over rows in a global order, without a window that gathers all rows in one task.

Rows are sorted into ranges, one a task. Each range hands on only its sums (and its last row); the sums of the ranges before it,
a row a range and group, are what each range starts from.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import dropped, written

_PART, _ROW = "_part", "_row"


def in_ranges(df: DataFrame, order: list[str], parts: int | None = None) -> DataFrame:
    """``df`` in the order of some columns, with ``_part`` (its range) and ``_row`` (its place in it): a table of its own.

    Rows that agree in ``order`` lie in one range, in any order. A range is about a shuffle partition; ``order`` must tell
    rows apart well enough for that. ``parts`` asks for so many ranges.
    """
    names = [F.col(f"`{c}`") for c in order]
    sorted_ = (df.repartitionByRange(parts, *names) if parts else df.repartitionByRange(*names)).sortWithinPartitions(*names)
    number = F.monotonically_increasing_id()
    # The table keeps what the tasks numbered: reading it again cannot number otherwise.
    return written(sorted_.withColumn(_PART, F.spark_partition_id()).withColumn(_ROW, number))


def _renamed(sums: DataFrame, by: list[str]) -> DataFrame:
    for k, c in enumerate([_PART, *by]):
        sums = sums.withColumnRenamed(c, f"_key{k}")
    return sums


def _same(by: list[str]) -> list[Column]:
    return [F.col(f"`{c}`").eqNullSafe(F.col(f"_key{k}")) for k, c in enumerate([_PART, *by])]


def running_sums(ranges: DataFrame, by: list[str], values: dict[str, Column]) -> DataFrame:
    """``ranges``, as ``in_ranges`` returns them, with the sum of each value over the rows of a group before this one.

    A group may lie in any number of ranges. Windows see the rows of one range and group; a second one sees a row a range.
    """
    within = Window.partitionBy(_PART, *by).orderBy(_ROW).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy(*by).orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    sums = ranges.groupBy(_PART, *by).agg(*[F.sum(v).alias(f"_s_{k}") for k, v in values.items()])
    carried = _renamed(sums.select(_PART, *by, *[F.coalesce(F.sum(f"_s_{k}").over(before), F.lit(0)).alias(f"_c_{k}") for k in values]), by)
    own = ranges.withColumns({f"_o_{k}": F.coalesce(F.sum(v).over(within), F.lit(0)) for k, v in values.items()})
    joined = own.join(carried, _same(by))
    return joined.select(*ranges.columns, *[(F.col(f"_o_{k}") + F.col(f"_c_{k}")).alias(k) for k in values])


def neighbours(ranges: DataFrame, by: list[str], column: str, before: str, after: str) -> DataFrame:
    """``ranges`` with a column's value in the row before and the row after, of the same group; null at its ends.

    At the border of two ranges the values come from the nearest range that has rows of the group.
    """
    within, whole = Window.partitionBy(_PART, *by).orderBy(_ROW), Window.partitionBy(*by).orderBy(_PART)
    ends = ranges.groupBy(_PART, *by).agg(F.min_by(F.struct(column), _ROW).alias("_first"), F.max_by(F.struct(column), _ROW).alias("_last"))
    carried = _renamed(ends.select(_PART, *by, F.lag("_last").over(whole).alias("_p"), F.lead("_first").over(whole).alias("_n")), by)
    own = ranges.withColumns({"_op": F.lag(F.struct(column)).over(within), "_on": F.lead(F.struct(column)).over(within)})
    joined = own.join(carried, _same(by))
    return joined.select(*ranges.columns, F.coalesce("_op", "_p")[column].alias(before), F.coalesce("_on", "_n")[column].alias(after))


#: Pieces into which an interval is cut in one round, and rounds.
PIECES, ROUNDS = 4096, 3


def medians(df: DataFrame, by: list[str], value: str, pieces: int = PIECES, rounds: int = ROUNDS) -> DataFrame:
    """(by..., n, median): the exact median of each group's values that are not null; doubles.

    Distributed selection. A round counts how many values of a group fall in each of ``pieces`` equal pieces of an
    interval, and keeps the pieces that hold the two middle ranks; the smallest and largest values in them are the next
    interval. What is left after some rounds (a few values, unless they are spread over many magnitudes or are not finite) is
    sorted in ranges and counted up. No task holds a group: memory is the pieces, and a range. Of an even number of values it
    is the middle of the middle two. A group of nulls only has n 0 and a null median; nulls in ``by`` are a group. NaN is the
    largest value.
    """
    keys = {f"_k{i}": F.col(f"`{c}`") for i, c in enumerate(by)} or {"_k": F.lit(0)}
    rows = written(df.select(*[v.alias(k) for k, v in keys.items()], F.col(f"`{value}`").cast("double").alias("v")))
    groups = list(keys)
    same = lambda a, b: [a[k].eqNullSafe(b[k]) for k in groups]
    some = rows.groupBy(*groups).agg(F.count("v").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    # Ranks count from 0, among the values within lo and hi.
    state = written(some.select(*groups, "n", F.floor((F.col("n") - 1) / 2).alias("r0"), F.floor(F.col("n") / 2).alias("r1"), "lo", "hi"))
    for _ in range(rounds):
        wide = F.col("hi") - F.col("lo")
        finite = ~F.isnan(wide) & (wide < float("inf")) & (wide > 0)
        piece = F.when(finite, F.least(F.floor((F.col("v") - F.col("lo")) / F.when(finite, wide) * pieces), F.lit(pieces - 1))).otherwise(0)
        held = rows.join(state.select(*groups, "lo", "hi"), same(rows, state)).where("v between lo and hi").select(*[rows[k] for k in groups], "v", piece.alias("p"))
        counted = held.groupBy(*groups, "p").agg(F.count("*").alias("c"), F.min("v").alias("a"), F.max("v").alias("z"))
        # At most ``pieces`` rows a group.
        upto = Window.partitionBy(*groups).orderBy("p")
        counted = counted.withColumn("below", F.sum("c").over(upto) - F.col("c"))
        both = counted.join(state, same(counted, state)).where("below <= r1 and below + c > r0")
        nxt = both.groupBy(*[counted[k] for k in groups]).agg(
            F.max("n").alias("n"), (F.max("r0") - F.min("below")).alias("r0"), (F.max("r1") - F.min("below")).alias("r1"), F.min("a").alias("lo"), F.max("z").alias("hi")
        )
        old, state = state, written(nxt)
        dropped(old)
    empty = some.where("n = 0").select(*groups, "n", F.lit(None).cast("double").alias("median"))
    # A group whose interval is one value is done.
    open_ = state.where("lo < hi")
    left = rows.join(open_.select(*groups, "lo", "hi"), same(rows, open_)).where("v between lo and hi")
    values = left.groupBy(*[rows[k] for k in groups], "v").agg(F.count("*").alias("c"))
    ranges = in_ranges(values, [*groups, "v"])
    placed = running_sums(ranges, groups, {"below": F.col("c")})
    ranked = placed.join(state, same(placed, state)).select(*[placed[k] for k in groups], "n", "v", (F.expr("below <= r0 and below + c > r0")).alias("x"), (F.expr("below <= r1 and below + c > r1")).alias("y"))
    found = ranked.where("x or y").groupBy(*groups).agg(F.max("n").alias("n"), F.max(F.when(F.col("x"), F.col("v"))).alias("a"), F.max(F.when(F.col("y"), F.col("v"))).alias("b"))
    middle = F.when(F.col("a") == F.col("b"), F.col("a")).otherwise(F.col("a") * 0.5 + F.col("b") * 0.5)
    done = state.where("lo = hi").select(*groups, "n", F.col("lo").alias("median")).union(found.select(*groups, "n", middle.alias("median"))).union(empty)
    out = written(done)
    for table in (rows, state, ranges):
        dropped(table)
    return out.select(*[F.col(k).alias(c) for k, c in zip(groups, by)], "n", "median")
