"""Recorded answers: what may be graded, what must be asked again, and what must be refused."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..sources.scratch import dropped, scratch_folder, written
from .grading import grade
from .items import prompt_digest
from .ordered import in_ranges, running_sums

#: Share of cut-off answers above which a recording is refused.
TRUNCATION_LIMIT = 0.10


class Refused(ValueError):
    """A recording that would give a number that means something else."""


class Stale(Refused):
    """Answers to other prompts."""


class Partial(Refused):
    """Items without an answer."""


class Truncated(Refused):
    """Too many answers that were cut off."""


def last_of_each(rows: DataFrame, seq: str = "seq", by: tuple[str, ...] = ("system", "id")) -> DataFrame:
    """One row an id: that with the highest sequence number."""
    return rows.groupBy(*by).agg(F.max_by(F.struct(*[c for c in rows.columns if c not in by]), seq).alias("r")).select(*by, "r.*")


def unknown_rows(recorded: DataFrame, items: DataFrame) -> DataFrame:
    """Answers whose id is not an item's."""
    return recorded.join(items.select("id"), "id", "left_anti")


def stale_rows(recorded: DataFrame, items: DataFrame) -> DataFrame:
    """Answers whose prompt digest is not that of the item's prompt; none at all is stale too."""
    now = items.select("id", prompt_digest(F.col("prompt")).alias("_now"))
    return recorded.join(now, "id").where(~F.col("prompt_sha256").eqNullSafe(F.col("_now"))).drop("_now")


def missing_items(recorded: DataFrame, items: DataFrame) -> DataFrame:
    """Items without any answer."""
    return items.join(recorded.select("id"), "id", "left_anti")


def pending_rows(items: DataFrame, recorded: DataFrame, budget: int, limit: int | None = None, order: str = "id") -> DataFrame:
    """(id, reason) of items to ask (again): no answer, an error, or cut off at a smaller budget than ``budget``.

    With ``limit`` only the first so many items are considered, by ``order``.
    """
    items = items if limit is None else items.orderBy(order).limit(limit)
    r = recorded.select("id", F.lit(True).alias("_there"), "error", "truncated", "num_predict")
    reason = (
        F.when(F.col("_there").isNull(), "missing")
        .when(F.coalesce("error", F.lit("")) != "", "error")
        .when(F.coalesce("truncated", F.lit(False)) & (F.coalesce("num_predict", F.lit(0)) < budget), "outgrown")
    )
    return items.select("id").join(r, "id", "left").select("id", reason.alias("reason")).where("reason is not null")


def notes(recorded: DataFrame, by: str = "system") -> DataFrame:
    """Per system: rows, transport_errors, truncated and its share, max_thinking_chars, budgets. See ``cut_off`` for the ids."""
    cut = F.coalesce("truncated", F.lit(False))
    return recorded.groupBy(by).agg(
        F.count("*").alias("rows"),
        F.count_if(F.coalesce("error", F.lit("")) != "").alias("transport_errors"),
        F.count_if(cut).alias("truncated"),
        F.bround(F.count_if(cut) / F.count("*"), 4).alias("truncated_share"),
        F.max(F.coalesce("thinking_chars", F.lit(0))).alias("max_thinking_chars"),
        F.sort_array(F.collect_set(F.coalesce("num_predict", F.lit(0)))).alias("num_predict"),
    )


def cut_off(recorded: DataFrame) -> DataFrame:
    """(system, id) of answers that were cut off."""
    return recorded.where(F.coalesce("truncated", F.lit(False))).select("system", "id")


def repeated_ids(rows: DataFrame, key: str = "id") -> DataFrame:
    """(key, n) of keys that more than one row has: none, where they should be distinct."""
    return rows.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


VERDICTS = ("accepted", "stale", "partial", "truncated")


def verdicts(recorded: DataFrame, items: DataFrame) -> DataFrame:
    """(system, verdict, first_id, stale, missing, truncated_share) for each recording of ``items`` (id, prompt).

    ``recorded`` has one row for each system and id (``last_of_each``). Verdicts are tried in this order: stale (an answer to another prompt,
    or to no item; how many), partial (items without an answer; how many), truncated (a share of cut-off answers above
    TRUNCATION_LIMIT, to 4 places), accepted. ``first_id`` is the first one, by id, that the verdict is about; null if accepted. No items or
    answers are multiplied: the first item that a recording lacks is the first gap in the running numbers of those it has.
    """
    ranges = in_ranges(items.select("id", prompt_digest(F.col("prompt")).alias("_now")).dropDuplicates(["id"]), ["id"])
    numbered = written(running_sums(ranges, [], {"_n": F.lit(1)}).select(F.col("id").alias("_item"), "_now", "_n"))
    total = numbered.count()
    cut = F.coalesce("truncated", F.lit(False))
    rows = recorded.join(numbered, F.col("id") == F.col("_item"), "left").select("system", "id", cut.alias("cut"), "_n", (F.col("_n").isNull() | ~F.col("prompt_sha256").eqNullSafe(F.col("_now"))).alias("bad"))
    rows = written(rows)
    base = rows.groupBy("system").agg(
        F.count("*").alias("rows"), F.count_if("bad").alias("stale"), F.min(F.when(F.col("bad"), F.col("id"))).alias("first_stale"),
        F.count_if("cut").alias("cut"), F.min(F.when(F.col("cut"), F.col("id"))).alias("first_cut"), F.count("_n").alias("known"),
    )
    known = in_ranges(rows.where("_n is not null").select("system", "_n"), ["system", "_n"])
    gaps = running_sums(known, ["system"], {"_i": F.lit(1)}).where("_n > _i").groupBy(F.col("system").alias("_s")).agg(F.min("_i").alias("gap"))
    lacking = base.join(gaps, F.col("system").eqNullSafe(F.col("_s")), "left").withColumn("gap", F.coalesce("gap", "known"))
    named = lacking.join(numbered.select(F.col("_n").alias("_g"), "_item"), F.col("gap") == F.col("_g"), "left")
    missing, share = F.lit(total) - F.col("known"), F.bround(F.col("cut") / F.col("rows"), 4)
    verdict = F.when(F.col("stale") > 0, "stale").when(missing > 0, "partial").when(share > TRUNCATION_LIMIT, "truncated").otherwise("accepted")
    first = F.when(F.col("verdict") == "stale", F.col("first_stale")).when(F.col("verdict") == "partial", F.col("_item")).when(F.col("verdict") == "truncated", F.col("first_cut"))
    out = written(named.select("system", verdict.alias("verdict"), "first_stale", "_item", "first_cut", "stale", missing.alias("missing"), share.alias("truncated_share")).select("system", "verdict", first.alias("first_id"), "stale", "missing", "truncated_share"))
    for table in (ranges, numbered, rows, known):
        dropped(table)
    return out


def _refusal(verdict: str, system: str, n: int, first: str, share: float) -> Refused:
    if verdict == "stale":
        return Stale(f"{system}: {n} stale answer(s), the first of {first}")
    if verdict == "partial":
        return Partial(f"{system}: {n} item(s) without an answer, the first is {first}")
    return Truncated(f"{system}: {share:.1%} of the answers were cut off")


def accept(recorded: DataFrame, items: DataFrame) -> DataFrame:
    """(system, id, response) of recordings that may be graded; else the first reason to refuse, as ``verdicts`` orders them,
    then by system. One row reaches the driver."""
    found = verdicts(recorded, items)
    order = F.array_position(F.array(*map(F.lit, VERDICTS)), F.col("verdict"))
    worst = found.where("verdict <> 'accepted'").orderBy(order, "system").first()
    dropped(found)
    if worst:
        raise _refusal(worst["verdict"], worst["system"], worst["stale" if worst["verdict"] == "stale" else "missing"], worst["first_id"], worst["truncated_share"])
    return recorded.select("system", "id", F.coalesce("response", F.lit("")).alias("response"))


def grade_accepted(recorded: DataFrame, items: DataFrame, lenient: bool = False) -> DataFrame:
    """The graded answers of one recording, or its refusal: one job grades and gathers what acceptance asks for.

    ``recorded`` has one row for each id. The counts are observed on the rows on their way to the grader, which writes them to
    a table of their own; that is dropped if the recording is refused.
    """
    (now,) = [prompt_digest(F.col("prompt")).alias("_now")]
    asked = items.select(F.struct(*items.columns).alias("_item"), F.col("id").alias("_id"), now)
    both = asked.join(recorded.select(F.struct(*recorded.columns).alias("_answer"), F.col("id").alias("_answered"), "prompt_sha256"), F.col("_id") == F.col("_answered"), "full_outer")
    there, item = F.col("_answered").isNotNull(), F.col("_id").isNotNull()
    bad, cut = there & (~item | ~F.col("prompt_sha256").eqNullSafe(F.col("_now"))), there & F.coalesce(F.col("_answer.truncated"), F.lit(False))
    seen = Observation()
    watched = both.observe(
        seen, F.count_if(bad).alias("stale"), F.min(F.when(bad, F.col("_answered"))).alias("first_stale"), F.count_if(~there).alias("missing"), F.min(F.when(~there, F.col("_id"))).alias("first_missing"),
        F.count_if(there).alias("rows"), F.count_if(cut).alias("cut"), F.min("_answer.system").alias("system"),
    )
    rows = watched.where(there & item).select("_item.*", F.col("_answer.system").alias("system"), F.coalesce("_answer.response", F.lit("")).alias("response"))
    graded = written(grade(rows, lenient=lenient))
    m = seen.get
    share = round(m["cut"] / m["rows"], 4) if m["rows"] else 0.0
    verdict = "stale" if m["stale"] else "partial" if m["missing"] else "truncated" if share > TRUNCATION_LIMIT else None
    if verdict:
        dropped(graded)
        raise _refusal(verdict, m["system"], m["stale"] or m["missing"], m["first_stale"] if m["stale"] else m["first_missing"], share)
    return graded


def append_answers(old: DataFrame, new: DataFrame, seq: str = "seq") -> DataFrame:
    """The record after new answers came in: a new answer of an id replaces the old one."""
    both = old.withColumn("_at", F.struct(F.lit(0), F.col(seq))).unionByName(new.withColumn("_at", F.struct(F.lit(1), F.col(seq))))
    return last_of_each(both, "_at").drop("_at")


def compare_tallies(claimed: DataFrame, found: DataFrame, by: list[str], fields: list[str]) -> DataFrame:
    """Groups whose tallies differ or that only one side has, with both values of each field."""
    a = claimed.select(*by, *[F.col(f).alias(f"claimed_{f}") for f in fields])
    b = found.select(*by, *[F.col(f).alias(f"found_{f}") for f in fields])
    same = F.lit(True)
    for f in fields:
        same = same & F.col(f"claimed_{f}").eqNullSafe(F.col(f"found_{f}"))
    return a.join(b, by, "full_outer").where(~same)


#: Levels that one job follows while few nodes are new, and how many are few.
HOPS, FEW = 8, 10_000


def closure(edges: DataFrame, start: DataFrame, hops: int = HOPS) -> DataFrame:
    """(node) reachable from ``start`` (node) over ``edges`` (src, dst), the start included; nulls are no nodes.

    Semi-naive: only nodes that the last job found are followed, and only new ones are written, behind those found before.
    While they are few, a job follows ``hops`` levels at once, so a long path costs a job for that many edges. Cycles end.
    """
    spark = start.sparkSession
    graph = written(edges.where("src is not null and dst is not null").select("src", "dst").distinct().repartitionByRange("src").sortWithinPartitions("src"))
    path, last, n = f"{scratch_folder(spark)}/{uuid.uuid4().hex}.parquet", 0, None
    found = start.where("node is not null").select("node").distinct().withColumn("open", F.lit(True))
    while n != 0:
        counted = Observation()
        found.observe(counted, F.count("*").alias("n")).write.parquet(f"{path}/level={last}")
        n = counted.get["n"]
        table = spark.read.schema("node " + start.schema["node"].dataType.simpleString() + ", open boolean, level int").parquet(path)
        near = table.where((F.col("level") == last) & F.col("open")).select("node", F.lit(0).alias("far"))
        deep = hops if n <= FEW else 1
        for k in range(1, deep + 1):
            # Those that the level before has reached hand on themselves and what follows them.
            on = near.join(graph, (F.col("node") == F.col("src")) & (F.col("far") == k - 1), "left")
            both = F.explode(F.array(F.struct("node", "far"), F.struct(F.col("dst").alias("node"), F.lit(k).alias("far"))))
            near = on.select(both.alias("x")).select("x.*").where("node is not null").groupBy("node").agg(F.min("far").alias("far"))
        # What the last level has is still to be followed.
        new = near.select("node", (F.col("far") == deep).alias("open"))
        found, last = new.join(table.select("node"), "node", "left_anti"), last + 1
    dropped(graph)
    return table.select("node")
