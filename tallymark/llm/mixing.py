"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source gets the same expected number of copies, its source's target over its size. The
whole part is taken as it is. The fractions are rounded against each other: two documents meet, mass moves
at random from one to the other, words for words, until one has no fraction left, and the other goes on. A
reduction tree does this: groups of a bounded number of documents are worked through in parallel, each hands
one document with a fraction up, and those meet in groups again, until one a source is left. So the words
taken differ from the target by less than one document a source, and each copy has the right expectation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, read, save, unused

#: Documents that meet in one group of the reduction tree.
FAN_IN = 128
SHARE = 1.5
WEIGHTS = (3, 1, 2)
MOST = 2.0
SEED = 20260829
#: A row's key, and a row that still has a fraction.
KEY = "struct<d:bigint,none:boolean,part:bigint,size:bigint,text:bigint,i:bigint>"
ITEM = f"struct<k:{KEY},size:bigint,f:double>"


def n_words(text: Column) -> Column:
    """Words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, target) from (source, source_size), one row a source, null included.

    Sources by code point, null last, take the weights in turn. Together they get ``share`` of all words; a
    target stops at ``most`` times its source, and what that leaves is shared again by weight. Water filling in
    closed form: in the order of (limit / weight) a source is full when what all before it leave, shared by
    weight, would exceed its limit. The window runs over one row a source, not over documents.
    """
    position = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (position % len(weights) + 1).cast("int"))
    rows = sizes.withColumn("_w", w).withColumn("_limit", F.col("source_size") * F.lit(float(most)))
    order = Window.orderBy((F.col("_limit") / F.col("_w")).asc(), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(0, Window.unboundedFollowing)
    total = F.sum("source_size").over(Window.partitionBy()) * F.lit(float(share))
    rows = rows.withColumn("_level", (total - F.coalesce(F.sum("_limit").over(before), F.lit(0.0))) / F.sum("_w").over(after))
    rows = rows.withColumn("_full", F.col("_limit") <= F.col("_w") * F.col("_level"))
    # The first source that is not full sets the level for the rest.
    level = F.max(F.when(~F.col("_full"), F.col("_level"))).over(Window.partitionBy())
    rows = rows.withColumn("_at", level)
    return rows.select(
        "source",
        "source_size",
        F.when(F.col("_full") | F.col("_at").isNull(), F.col("_limit")).otherwise(F.least("_limit", F.col("_w") * F.col("_at"))).alias("target"),
    )


def _draw(*columns) -> Column:
    """A number in (0, 1) that depends on the columns alone."""
    return (F.pmod(F.xxhash64(F.lit(SEED), *columns), F.lit(1 << 53)) + F.lit(0.5)) / F.lit(float(1 << 53))


def _step(level: int):
    """One meeting: the document carried so far and the next one."""

    def meet(state, x):
        a, b = state["left"], x
        wa, wb = a["f"] * a["size"], b["f"] * b["size"]  # words held as a fraction
        total = wa + wb
        # What a and b hold after mass moved to b as far as it goes, or to a as far as it goes.
        to_b = F.least(b["size"].cast("double"), total)
        to_a = F.least(a["size"].cast("double"), total)
        move_b, move_a = to_b - wb, to_a - wa
        u = _draw(F.lit(level), a["k"], b["k"])
        goes_b = u * (move_a + move_b) < move_a
        held_a = F.when(goes_b, total - to_b).otherwise(to_a)
        held_b = F.when(goes_b, to_b).otherwise(total - to_a)
        # One of the two is whole now: 0 or 1. Comparing with the bound itself keeps this exact.
        whole_a = F.when(goes_b, to_b == total).otherwise(to_a == a["size"].cast("double"))
        up_a = F.when(goes_b, F.lit(0)).otherwise(F.lit(1))
        whole_b = F.when(goes_b, to_b == b["size"].cast("double")).otherwise(to_a == total)
        up_b = F.when(goes_b, F.lit(1)).otherwise(F.lit(0))
        none = a.isNull()
        item = lambda r, f: F.struct(r["k"].alias("k"), r["size"].alias("size"), f.alias("f"))
        left_a = item(a, held_a / a["size"])
        left_b = item(b, held_b / b["size"])
        done_a = F.struct(a["k"].alias("k"), up_a.alias("up"))
        done_b = F.struct(b["k"].alias("k"), up_b.alias("up"))
        nobody = F.lit(None).cast(ITEM)
        left = F.when(none, item(b, b["f"])).when(whole_a & whole_b, nobody).when(whole_a, left_b).otherwise(left_a)
        done = (
            F.when(none, F.array().cast(f"array<struct<k:{KEY},up:int>>"))
            .when(whole_a & whole_b, F.array(done_a, done_b))
            .when(whole_a, F.array(done_a))
            .otherwise(F.array(done_b))
        )
        return F.struct(left.alias("left"), F.concat(state["done"], done).alias("done"))

    return meet


def round_fractions(rows: DataFrame, fan_in: int = FAN_IN) -> DataFrame:
    """(k, up) for every row of (k KEY unique, part, size long > 0, f double in (0, 1)): up is 0 or 1.

    Within each ``part`` the sum of size * up differs from the sum of size * f by less than one size, and
    the expectation of up is f. Groups have ``fan_in`` rows on average however large a part is, so a hot part
    makes more groups, not larger ones; levels grow with the logarithm of the largest part.
    """
    done, level, olds = [], 0, []
    now = rows.select("part", "k", "size", "f")
    while True:
        counts = save(now.groupBy("part").agg(F.count("*").alias("n")))
        most = counts.agg(F.max("n")).first()[0] or 0
        if most == 0:
            break
        # Group numbers from a hash of the key; counts are one row a part, joined rather than collected.
        grouped = now.join(counts, "part").withColumn(
            "g", F.pmod(F.xxhash64(F.lit(SEED), F.lit(level), "k"), F.ceil(F.col("n") / fan_in).cast("long"))
        )
        start = F.struct(
            F.lit(None).cast(ITEM).alias("left"),
            F.array().cast(f"array<struct<k:{KEY},up:int>>").alias("done"),
        )
        met = save(
            grouped.groupBy("part", "g")
            .agg(F.sort_array(F.collect_list(F.struct("k", "size", "f"))).alias("rows"))
            .select("part", F.aggregate("rows", start, _step(level)).alias("s"))
        )
        done.append(met.select(F.explode("s.done").alias("d")).select("d.k", "d.up"))
        left = met.where("s.left is not null").select("part", "s.left.k", "s.left.size", "s.left.f")
        if most <= fan_in:
            # One group a part: what is left now has nobody to meet and is rounded alone.
            done.append(left.select("k", (_draw(F.lit("last"), "k") < F.col("f")).cast("int").alias("up")))
            break
        now, level = left, level + 1
    out = rows.select("k", F.lit(0).alias("up")).limit(0)
    for frame in done:
        out = out.union(frame)
    return out


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST, fan_in: int = FAN_IN) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken) for every row of ``docs`` (doc_id, text, source).

    A repeated row is one more document. A null text has size 0; documents of size 0 and sources of size 0 take nothing. A
    null source is a source of its own, a null doc_id a document like others. An empty table gives no rows.
    Other columns are ignored. Reruns agree: all draws are hashes.
    """
    sized = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), text_hash().alias("_text"))
    # Equal rows are interchangeable; a count keeps them without a window over rows.
    sized = save(
        sized.groupBy("doc_id", "source", "size", "_text")
        .agg(F.count("*").alias("_n"))
        .withColumn("_i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n"))))
        .drop("_n")
    )
    per_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    goal = save(targets(per_source, weights, share, most).withColumn("part", F.xxhash64("source", F.col("source").isNull())))
    keyed = sized.withColumn("part", F.xxhash64("source", F.col("source").isNull()))
    # One row a source: the size of this side is bounded by the number of sources; AQE broadcasts it when small.
    rated = keyed.join(goal.drop("source"), "part").withColumn(
        "rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    )
    rated = rated.withColumn("whole", F.floor("rate")).withColumn("f", F.col("rate") - F.floor("rate"))
    rated = rated.withColumn("k", F.struct(
            F.coalesce("doc_id", F.lit(0)).cast("long").alias("d"),
            F.col("doc_id").isNull().alias("none"),
            "part",
            "size",
            F.col("_text").alias("text"),
            F.col("_i").alias("i"),
        ),
    )
    rounded = round_fractions(rated.where("size > 0 and f > 0").select("part", "k", "size", "f"), fan_in)
    return rated.join(rounded, "k", "left").select(
        "doc_id",
        "source",
        "size",
        "source_size",
        "target",
        F.when(F.col("size") == 0, 0).otherwise(F.col("whole") + F.coalesce("up", F.lit(0))).cast("long").alias("copies"),
        "_text",
    ).withColumn("taken", F.col("copies") * F.col("size"))


def text_hash() -> Column:
    """Tells rows of one doc_id apart."""
    return F.xxhash64(F.coalesce("text", F.lit("")), F.col("text").isNull())


def take(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST, fan_in: int = FAN_IN) -> DataFrame:
    """The rows of ``docs`` that the mix takes, with all their columns, ``copies`` and ``taken`` (own ones are replaced).

    Rows that agree in doc_id, source and text come back as one, with the copies of all.
    """
    names = [c for c in docs.columns if c.lower() not in ("copies", "taken")]
    own = docs.select(*[F.col(f"`{c}`") for c in names])
    text, d, s, t = unused(own, "_text", "_d", "_s", "_t")
    counted = mix(docs.select("doc_id", "source", "text"), weights, share, most, fan_in)
    counted = counted.groupBy(F.col("doc_id").alias(d), F.col("source").alias(s), F.col("_text").alias(t)).agg(F.sum("copies").alias("copies"), F.sum("taken").alias("taken"))
    rows = own.withColumn(text, text_hash()).dropDuplicates(["doc_id", "source", text])
    same = F.col("doc_id").eqNullSafe(F.col(d)) & F.col("source").eqNullSafe(F.col(s)) & (F.col(text) == F.col(t))
    return rows.join(counted.where("copies > 0"), same).select(*[F.col(f"`{c}`") for c in names], "copies", "taken")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``documents`` mixed to the weights above."""
    return mix(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")
