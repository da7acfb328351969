"""Line dedup: a deletion-neighbourhood join over words.

Two lines are the same line when their words differ by at most one word inserted, deleted or replaced; lines of
fewer than ``near_words`` words only when their words are equal. Of the same lines the earliest stays, by
(doc_id, line number).

The join: a line and all its variants with one word left out are emitted as hashed keys. A line that equals a
variant of another one differs from it by that one word; two lines that share the variant with the same word
left out differ in that word alone. Each key keeps only the earliest line in each role, never pairs, so a key
that a third of all lines share makes as many rows as it has lines. The words themselves are compared last.

The key of a line is the exclusive or of hashes of (word, position), so running values give the keys of all its
variants in linear time, and without overflow, however long the line is. Before that, equal lines are one row, and
lines that share no half with another line are set aside: one edit leaves the first or the second half of a line as
it was, so this loses nothing.

A line's place is (doc_id, mark, line number). The mark is 0, but where rows share a doc_id, or have none, it is a
hash of the text: texts of one id are documents of their own. Rows that agree in doc_id and text are copies of one
document, of which the first is any.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import drop, read, save, unused

#: Unless asked for otherwise, lines of fewer words stay wherever they are: headings, list marks, closing brackets.
MIN_WORDS = 4
#: For the query and the pipeline: every line with a word takes part.
ANY_WORDS = 1
#: Lines of fewer words are the same only when their words are equal.
NEAR_WORDS = 10


def plain(line: Column) -> Column:
    """A line's words with one space between them."""
    odd = reduce(lambda a, b: a | b, [F.contains(line, F.lit(x)) for x in ("  ", "\t", "\r", "\x0b", "\x0c")])
    return F.trim(F.when(odd, F.regexp_replace(line, r"[\x20\x09-\x0D]+", " ")).otherwise(line))


def _n_words(line: Column) -> Column:
    """Words of a plain line; 0 for an empty one."""
    return F.when(line == "", 0).otherwise(F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit(""))) + 1)


def within_one(a: Column, b: Column) -> Column:
    """Whether two word lists differ by at most one word inserted, deleted or replaced."""
    n, m = F.size(a), F.size(b)
    least = F.least(n, m)
    same = F.aggregate(
        F.sequence(F.lit(0), least), F.lit(0), lambda s, i: F.when((s == i) & (i < least) & (F.get(a, i) == F.get(b, i)), s + 1).otherwise(s)
    )
    tail = lambda x, size: F.slice(x, F.least(same + 2, size + 1), F.greatest(size - same - 1, F.lit(0)))
    rest = lambda x, size: F.slice(x, F.least(same + 1, size + 1), F.greatest(size - same, F.lit(0)))
    return (
        F.when(n == m, tail(a, n) == tail(b, m))
        .when(n == m + 1, tail(a, n) == rest(b, m))
        .when(m == n + 1, tail(b, m) == rest(a, n))
        .otherwise(False)
    )


def _half_keys(line: Column, n: Column) -> Column:
    """Keys of halves: any two lines within one edit share one.

    For a pair whose shorter line has m words these are its first m // 2 words, or its last m - m // 2; a line takes
    part with m its own length, and one less.
    """

    def half(first: bool, m: Column) -> Column:
        size = F.floor(m / 2).cast("int")
        part = F.call_function("substring_index", line, F.lit(" "), size if first else size - m)
        return F.xxhash64(F.lit(first), m, part)

    return F.array(*[half(first, m) for m in (n, n - 1) for first in (True, False)])


def _marked(docs: DataFrame, mark: str) -> DataFrame:
    """``docs`` with the column ``mark``, which tells texts of one doc_id, or of none, apart."""
    shared = docs.groupBy(F.col("doc_id").alias("_shared")).agg(F.count("*").alias("_n")).where("_n > 1 or _shared is null").select("_shared", F.lit(True).alias("_is"))
    told = F.xxhash64(F.col("text").isNull(), "text").bitwiseOR(F.lit(1))  # never 0
    one, is_ = unused(docs, "_shared", "_is")
    shared = save(shared.toDF(one, is_))
    return docs.join(shared, F.col("doc_id").eqNullSafe(F.col(one)), "left").select(*[F.col(f"`{c}`") for c in docs.columns], F.when(F.col(is_), told).otherwise(F.lit(0)).alias(mark))


def _at(no: Column) -> Column:
    """A line's place; places are in the order in which lines count as earlier."""
    return F.struct(F.col("doc_id").alias("d"), F.col("mark").alias("t"), no.alias("l"))


def _found(docs: DataFrame, min_words: int, near_words: int) -> DataFrame:
    """(at, first, rows) for the lines to remove: ``rows`` of those with the place ``at``; ``docs`` has doc_id, text and mark."""
    split = docs.select("doc_id", "mark", F.posexplode(F.split("text", "\n")).alias("no", "raw"))
    # The filter on n comes after the table is written: before, it would have every line worked out twice.
    sized = split.select(_at(F.col("no")).alias("at"), plain(F.col("raw")).alias("line")).withColumn("n", _n_words(F.col("line")))
    # 128 bits of two independent hashes name a line.
    name = F.struct(F.xxhash64(F.lit(1), "line").alias("x"), F.xxhash64(F.lit(2), "line").alias("y"))
    halves = F.when(F.col("n") >= near_words, _half_keys(F.col("line"), F.col("n")))
    written = save(sized.select("at", name.alias("h"), "n", halves.alias("halves")))
    places = written.where(F.col("n") >= min_words)
    lines = save(places.groupBy("h").agg(F.min("at").alias("at"), F.count("*").alias("times"), F.first("halves").alias("halves")))
    keys = lines.where("halves is not null").select("at", F.col("h.x").alias("x"), F.explode("halves").alias("key"))
    # Lines have names of their own; longs, unlike structs, are compared in a hash aggregation.
    shared = keys.groupBy("key").agg(F.min("x").alias("lo"), F.max("x").alias("hi")).where("lo <> hi").select("key")
    near = keys.join(shared, "key", "left_semi").select("at").distinct()

    # The words of those lines, from the texts that hold them; copies of a document hold the same.
    wanted = near.groupBy(F.col("at.d").alias("_d"), F.col("at.t").alias("_t")).agg(F.collect_set("at.l").alias("numbers"))
    holding = docs.join(wanted, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("mark") == F.col("_t")))
    # A function of the list of lines, so that a text is split once, not once for each line.
    picked = F.transform(F.array(F.split("text", "\n")), lambda all_: F.transform("numbers", lambda no: F.struct(no.alias("no"), F.get(all_, no).alias("raw"))))
    texts = holding.select("doc_id", "mark", F.explode(F.flatten(picked)).alias("x"))
    near_lines = save(texts.select(_at(F.col("x.no")).alias("at"), F.split(plain(F.col("x.raw")), " ").alias("words")).dropDuplicates(["at"]))

    each = near_lines.select("at", F.posexplode("words").alias("i", "w"))
    left_out = each.select("at", "i", F.xxhash64("w", "i").alias("f"), F.xxhash64("w", F.col("i") - 1).alias("g"))
    # Without word i, those before it keep their places and those behind it move up by one.
    total = Window.partitionBy("at")
    running = Window.partitionBy("at").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    before, behind = F.bit_xor("f").over(running).bitwiseXOR(F.col("f")), F.bit_xor("g").over(total).bitwiseXOR(F.bit_xor("g").over(running))
    variants = left_out.select("at", "i", before.bitwiseXOR(behind).alias("key"))
    # As the variant that leaves out nothing, a line has its own key; -1 is no place.
    whole = left_out.groupBy("at").agg(F.bit_xor("f").alias("key")).select("at", F.lit(-1).alias("i"), "key")
    keyed = save(variants.union(whole))

    # The earliest line in each role: whole, with any word left out, with word i left out.
    by_place = keyed.where("i >= 0").groupBy("key", "i").agg(F.min("at").alias("first"), F.max("at").alias("last")).where("first < last").drop("last")
    roles = keyed.groupBy("key").agg(F.min(F.when(F.col("i") < 0, F.col("at"))).alias("whole"), F.min(F.when(F.col("i") >= 0, F.col("at"))).alias("variant"))
    roles = roles.where("whole is not null and variant is not null")
    earlier = (
        keyed.join(by_place, ["key", "i"]).select("at", "first")
        .union(keyed.join(roles, "key").select("at", F.when(F.col("i") < 0, F.col("variant")).otherwise(F.col("whole")).alias("first")))
        .where("first < at")
        .distinct()
    )
    # The words decide; a line's partners are few: two a key at most.
    checked = (
        earlier.join(near_lines, "at")
        .join(near_lines.select(F.col("at").alias("first"), F.col("words").alias("w2")), "first")
        .where(within_one(F.col("words"), F.col("w2")))
        .groupBy("at")
        .agg(F.min("first").alias("first"))
    )
    earliest = lines.join(checked, "at", "left").where("times > 1 or first is not null").select("h", F.least("at", F.coalesce("first", "at")).alias("first"))
    # Of copies of a document, one keeps its lines.
    at_place = places.join(earliest, "h").groupBy("at", "first").agg(F.count("*").alias("n"))
    found = save(at_place.select("at", "first", F.when(F.col("first") < F.col("at"), F.col("n")).otherwise(F.col("n") - 1).alias("rows")).where("rows > 0"))
    for table in (written, lines, near_lines, keyed):
        drop(table)
    return found


def repeated_lines(docs: DataFrame, min_words: int = MIN_WORDS, near_words: int = NEAR_WORDS) -> DataFrame:
    """(doc_id, doc_mark, line_no, first_doc_id, first_doc_mark, first_line_no, n_rows) for every line to remove.

    ``docs`` has (doc_id, text). Lines end at line feeds; ``line_no`` counts from 0. Words are runs of anything but
    ASCII white space. A line goes when an earlier line is the same line; the first is the earliest such line, by
    (doc_id, mark, line number), null doc_ids before others. Marks are 0 but for texts of one doc_id or of none,
    see above. ``n_rows``: of how many rows with this doc_id and text the line goes; of copies of a document one
    keeps lines that no other has before it, and then the line's first is itself. Lines of fewer than
    ``min_words`` words stay. Null and empty texts have no lines. An empty table gives no rows; other columns are
    ignored.
    """
    return _found(_marked(docs.select("doc_id", "text"), "mark"), min_words, near_words).select(
        F.col("at.d").alias("doc_id"), F.col("at.t").alias("doc_mark"), F.col("at.l").alias("line_no"),
        F.col("first.d").alias("first_doc_id"), F.col("first.t").alias("first_doc_mark"), F.col("first.l").alias("first_line_no"),
        F.col("rows").alias("n_rows"),
    )


def _without(lines: Column, gone: Column) -> Column:
    """Lines but those with the sorted numbers ``gone``: what stands between these, in linear time."""
    edges = F.concat(F.array(F.lit(-1)), gone, F.array(F.size(lines)))
    between = lambda all_, at: F.transform(
        F.sequence(F.lit(1), F.size(at) - 1), lambda k: F.slice(all_, F.get(at, k - 1) + 2, F.get(at, k) - F.get(at, k - 1) - 1)
    )
    return F.flatten(F.flatten(F.transform(F.array(F.struct(lines.alias("all"), edges.alias("at"))), lambda x: between(x["all"], x["at"]))))


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS, near_words: int = NEAR_WORDS) -> DataFrame:
    """``docs`` with (text, n_lines, n_removed): repeated lines are taken out of the texts.

    Every row stays, also one that has lost all its lines: its text is then empty. Other columns are kept, whatever
    their names; own columns n_lines and n_removed are replaced. Of rows that agree in doc_id and text, one keeps its
    lines: any, if they differ in other columns. See ``repeated_lines`` for which lines go and for unusual input. A
    null text stays null, with no lines.
    """
    names = [c for c in docs.columns if c.lower() not in ("n_lines", "n_removed")]
    quoted = [F.col(f"`{c}`") for c in names]
    own = docs.select(*quoted)
    mark, d, t, gone, number, times, least = unused(own, "_mark", "_d", "_t", "_gone", "_number", "_times", "_least")
    marked = _marked(own, mark)
    found = _found(marked.select("doc_id", "text", F.col(mark).alias("mark")), min_words, near_words).where("first < at")
    lists = found.groupBy(F.col("at.d").alias(d), F.col("at.t").alias(t)).agg(F.sort_array(F.collect_set("at.l")).alias(gone))
    same = F.col("doc_id").eqNullSafe(F.col(d)) & (F.col(mark) == F.col(t))

    # Copies of a document: the rows are numbered once they are written, and all but the least number lose their lines.
    copied = marked.where(F.col(mark) != 0).groupBy(F.col("doc_id").alias(d), F.col(mark).alias(t)).agg(F.count("*").alias(times))
    copied = save(copied.where(F.col(times) > 1).select(d, t))
    first = F.lit(True)
    if not copied.isEmpty():
        written = save(marked.join(copied, same, "left_semi").withColumn(number, F.monotonically_increasing_id()))
        leasts = save(written.groupBy(F.col("doc_id").alias(d), F.col(mark).alias(t)).agg(F.min(number).alias(least)))
        again = written.join(leasts, same).withColumn(least, F.col(number) == F.col(least)).select(*quoted, mark, least)
        marked = marked.join(copied, same, "left_anti").select(*quoted, mark, F.lit(True).alias(least)).union(again)
        first = F.col(least)
    lines = F.split("text", "\n")
    short = F.filter(lines, lambda x: _n_words(plain(x)) < min_words)
    kept = F.when(~first, short).when(F.col(gone).isNotNull(), _without(lines, F.col(gone)))
    text = F.coalesce(F.array_join(kept, "\n"), F.col("text"))
    return marked.join(lists, same, "left").select(
        *[text.alias(c) if c == "text" else F.col(f"`{c}`") for c in names],
        F.when(F.col("text").isNull(), 0).otherwise(F.size(lines)).cast("long").alias("n_lines"),
        F.when(F.col("text").isNull(), 0).when(~first, F.size(lines) - F.size(short)).otherwise(F.coalesce(F.size(gone), F.lit(0))).cast("long").alias("n_removed"),
    )


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every repeated line of ``documents``, with the line that it repeats."""
    return repeated_lines(read(spark, sf_dir, "documents"), min_words=ANY_WORDS)
