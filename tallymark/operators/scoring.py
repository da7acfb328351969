"""Scores: overall and by family, error profiles, sensitivity to the counting rules, headlines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import counters as c
from .grading import BUCKETS, bucket, grade
from .ordered import medians


def rate(flag: Column) -> Column:
    """The share of true rows, to 4 places; 0 without rows."""
    return F.coalesce(F.bround(F.count_if(flag) / F.count("*"), 4), F.lit(0.0))


def _of(value: Column, where: Column) -> Column:
    return F.when(where, value)


def profile(where: Column | None = None, prefix: str = "") -> dict[str, Column]:
    """Aggregates of the signed errors of rows where ``where`` holds: as ``error_profile`` documents them."""
    w = F.lit(True) if where is None else where
    e, miss = F.col("error"), w & ~F.col("count_ok")
    n = F.count_if(w)
    violations = F.count_if(miss)
    made = {
        "n": n,
        "count_violations": violations,
        "off_by_one": F.count_if(miss & (F.abs(e) == 1)),
        "off_by_one_share": F.bround(F.count_if(miss & (F.abs(e) == 1)) / F.nullif(violations, F.lit(0)), 4),
        "over": F.count_if(w & (e > 0)),
        "under": F.count_if(w & (e < 0)),
        "mean_error": F.bround(F.avg(_of(e, w)), 3),
        "median_error": F.median(_of(e, w)),
        "mean_abs_error": F.bround(F.avg(_of(F.abs(e), w)), 3),
        "median_abs_error_of_misses": F.median(_of(F.abs(e), miss)),
        "median_abs_relative_error": F.bround(F.median(_of(F.abs(e) / F.nullif(F.col("target"), F.lit(0)), w)), 4),
    }
    return {prefix + k: v for k, v in made.items()}


def error_profile(graded: DataFrame, by: list[str], where: Column | None = None) -> DataFrame:
    """Per group: n, count_violations, off_by_one and its share of them (null without any), over, under, mean_error,
    median_error, mean_abs_error, median_abs_error_of_misses, median_abs_relative_error (targets other than 0)."""
    return graded.groupBy(*by).agg(*[v.alias(k) for k, v in profile(where).items()])


def error_medians(graded: DataFrame, by: list[str]) -> DataFrame:
    """(by..., median_error, median_abs_error_of_misses, median_abs_relative_error) as ``error_profile`` has them, for groups of any size.

    ``error_profile`` holds all different values of a group in one task's memory; here no task holds a group. See ``ordered.medians``.
    """
    e, some = F.col("error").cast("double"), F.nullif(F.col("target"), F.lit(0))
    measures = {"median_error": e, "median_abs_error_of_misses": F.when(~F.col("count_ok"), F.abs(e)), "median_abs_relative_error": F.abs(e) / some}
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("m"), v.alias("v")) for k, v in measures.items()]))
    found = medians(graded.select(*by, pairs.alias("x")).select(*by, "x.m", "x.v"), [*by, "m"], "v")
    value = lambda k: F.max(F.when(F.col("m") == k, F.col("median")))
    return found.groupBy(*by).agg(*[(F.bround(value(k), 4) if "relative" in k else value(k)).alias(k) for k in measures])


def histogram(graded: DataFrame, by: list[str]) -> DataFrame:
    """Per group and bucket, in the buckets' order, how many errors fall in it; empty buckets are there."""
    counts = graded.groupBy(*by).agg(
        F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(b).alias("bucket"), F.count_if(bucket(F.col("error")) == b).alias("n")) for i, b in enumerate(BUCKETS)]).alias("h")
    )
    return counts.select(*by, F.explode("h").alias("h")).select(*by, "h.ord", "h.bucket", "h.n")


def score(graded: DataFrame) -> DataFrame:
    """Per system, overall (family null) and by family: n, compliant, rate, count_ok, keyword_ok, unique_ok, empty.

    One pass: both levels are grouping sets of one aggregation.
    """
    flags = ["compliant", "count_ok", "keyword_ok", "unique_ok", "empty"]
    grouped = graded.groupingSets([["system"], ["system", "family"]], "system", "family")
    return grouped.agg(
        F.count("*").alias("n"), *[F.count_if(F.col(f)).alias(f) for f in flags], rate(F.col("compliant")).alias("rate")
    )


_UNITS = [(d, k, i) for d in sorted(c.DIALECTS) for i, k in enumerate(c.DIALECTS[d])]


def sensitivity(rows: DataFrame) -> DataFrame:
    """(system, dimension, dialect, pos, published, n, rate): the rate of the verdict under each dialect.

    Only items that a dimension's rule can move count: those that ask for it, for ``items`` those that must not
    repeat. Each row is projected once with its verdict under every dialect that concerns it, then one aggregation
    follows; no row is graded in a join with the dialects.
    """
    from .grading import satisfies

    text = c.strip(F.coalesce("response", F.lit("")))
    base = rows.select("system", "dimension", "mode", "target", "unique", text.alias("_t"))
    t = F.col("_t")
    verdicts = []
    for d, k, i in _UNITS:
        if d == "items":
            ok = F.when(F.col("unique"), ~c.has_duplicates(c.item_keys(t, c.PUBLISHED["bullets"], k)))
        else:
            ok = F.when(F.col("dimension") == d, satisfies(F.col("mode"), c.count(d, t, {d: k}), F.col("target")))
        verdicts.append(F.struct(F.lit(d).alias("d"), F.lit(k).alias("k"), F.lit(i).alias("i"), ok.alias("ok")))
    seen = base.select("system", F.explode(F.filter(F.array(*verdicts), lambda v: v["ok"].isNotNull())).alias("v"))
    return seen.groupBy("system", F.col("v.d").alias("dimension"), F.col("v.k").alias("dialect"), F.col("v.i").alias("pos")).agg(
        F.count("*").alias("n"), rate(F.col("v.ok")).alias("rate")
    )


def sensitivity_summary(long: DataFrame) -> DataFrame:
    """Per system and dimension: n, published_rate, spread_points, lowest and highest dialect.

    Rates are rounded before they are subtracted. Of equal rates the first declared is lowest, the last highest.
    """
    published = F.lit(False)
    for d, k in c.PUBLISHED.items():
        published = published | ((F.col("dimension") == d) & (F.col("dialect") == k))
    key = F.struct("rate", "pos")
    return long.groupBy("system", "dimension").agg(
        F.max("n").alias("n"),
        F.max(F.when(published, F.col("rate"))).alias("published_rate"),
        F.bround((F.max("rate") - F.min("rate")) * 100, 2).alias("spread_points"),
        F.min_by("dialect", key).alias("lowest"),
        F.max_by("dialect", key).alias("highest"),
    )


def sensitivity_worst(summary: DataFrame) -> DataFrame:
    """Per system the dimension with the largest spread (the first by name; none if nothing moves) and the median."""
    best = F.min_by(F.struct("dimension", "lowest", "highest"), F.struct((-F.col("spread_points")).alias("s"), "dimension"))
    grouped = summary.groupBy("system").agg(
        F.max("spread_points").alias("spread_points"), best.alias("b"), F.bround(F.median("spread_points"), 2).alias("median_spread_points")
    )
    some = F.col("spread_points") > 0
    return grouped.select(
        "system",
        F.when(some, F.col("b.dimension")).alias("dimension"),
        "spread_points",
        F.when(some, F.col("b.lowest")).alias("from_dialect"),
        F.when(some, F.col("b.highest")).alias("to_dialect"),
        "median_spread_points",
    )


def packaging(rows: DataFrame) -> DataFrame:
    """Per system: strict_rate, lenient_rate, packaging_gap_points, responses_unwrapped. Both verdicts on a row at once."""
    strict = grade(rows).select(*rows.columns, F.col("compliant").alias("strict"))
    both = grade(strict, lenient=True)
    grouped = both.groupBy("system").agg(
        rate(F.col("strict")).alias("strict_rate"), rate(F.col("compliant")).alias("lenient_rate"), F.count_if(F.size("unwrapped") > 0).alias("responses_unwrapped")
    )
    return grouped.withColumn("packaging_gap_points", F.bround((F.col("lenient_rate") - F.col("strict_rate")) * 100, 2))


def leaderboard(scores: DataFrame, order: DataFrame | None = None) -> DataFrame:
    """Overall rows with their place: by falling rate, equal ones in the board's order (by name without one)."""
    overall = scores.where("family is null").drop("family")
    ranked = overall.withColumn("_ord", F.col("system")) if order is None else overall.join(order.withColumnRenamed("ord", "_ord"), "system")
    # One row a system: the window sees the board, not the answers.
    return ranked.withColumn("place", F.row_number().over(Window.orderBy(F.desc("rate"), "_ord"))).drop("_ord")


#: Baselines whose rates are quoted, by the name of the figure.
QUOTED = {"filler_keyword_rate": "filler_keyword", "ignore_rate": "ignore", "reference_rate": "reference"}


def headline(board: DataFrame, worst: DataFrame, kinds: DataFrame, quoted: dict[str, str] | None = None) -> DataFrame:
    """One row: systems, models, best_model and its rate, rates of the baselines that are ``quoted`` (null without one),
    the largest sensitivity, whose it is and between which rules, medians by system."""
    quoted = QUOTED if quoted is None else quoted
    rows = board.join(kinds, "system").join(worst.select("system", F.col("spread_points").alias("spread"), F.col("dimension").alias("moved"), "from_dialect", "to_dialect", "median_spread_points"), "system")
    model = F.col("kind") == "model"
    first = F.struct((-F.col("rate")).alias("r"), "system")
    widest = F.struct((-F.col("spread")).alias("s"), "system")
    return rows.agg(
        F.count("*").alias("systems"),
        F.count_if(model).alias("models"),
        F.min_by(F.when(model, F.col("system")), F.when(model, first)).alias("best_model"),
        F.max(F.when(model, F.col("rate"))).alias("best_model_rate"),
        *[F.max(F.when(F.col("system") == s, F.col("rate"))).alias(k) for k, s in quoted.items()],
        F.min_by("system", widest).alias("largest_system"),
        F.min_by("moved", widest).alias("largest_dimension"),
        F.min_by("from_dialect", widest).alias("largest_from"),
        F.min_by("to_dialect", widest).alias("largest_to"),
        F.max("spread").alias("largest_spread_points"),
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("system", "median_spread_points")))).alias("medians"),
    )


def undetermined(graded: DataFrame, truncated: DataFrame, by: list[str]) -> DataFrame:
    """Per group, how many answers that were cut off could still have met their count."""
    open_ = (
        F.when(F.col("mode") == "exact", F.col("observed") < F.col("target"))
        .when(F.col("mode") == "at_most", F.col("observed") <= F.col("target"))
        .otherwise(F.col("observed") < F.col("target"))
    )
    return graded.join(truncated, by + ["id"], "left_semi").groupBy(*by).agg(F.count_if(open_).alias("undetermined"), F.count("*").alias("truncated"))


def detailed(board: DataFrame, kinds: DataFrame, shown: tuple[str, ...] = ("reference", "filler_keyword", "approximate")) -> DataFrame:
    """The board's rows that detail tables show, all models and some baselines, with ``line``: models first, by falling rate."""
    rows = board.join(kinds.select("system", "kind"), "system").where((F.col("kind") == "model") | F.col("system").isin(*shown))
    # One row a system.
    order = Window.orderBy(F.col("kind") != "model", F.desc("rate"), "place")
    return rows.withColumn("line", F.row_number().over(order))


def caveats(notes: DataFrame, open_: DataFrame) -> DataFrame:
    """(system, caveat) for recordings with answers that were cut off: how many, at which budget, and how many are in doubt.

    ``notes`` as ``recorded.notes`` has them, ``open_`` as ``undetermined``.
    """
    rows = notes.where("truncated > 0").join(open_.select("system", "undetermined"), "system", "left")
    text = F.format_string(
        "%d of %d answers (%.1f%%) were cut off at a budget of %d tokens, after at most %d characters of reasoning; %d of them could still have met their count",
        "truncated", "rows", F.col("truncated_share") * 100, F.coalesce(F.array_max("num_predict"), F.lit(0)), "max_thinking_chars", F.coalesce("undetermined", F.lit(0)),
    )
    return rows.select("system", text.alias("caveat"))
