"""N-gram Jaccard join by T-occurrence search.

A document is its set of word shingles. Two documents that reach the Jaccard bound share at least T shingles, so
among any n - T + k of one document's n shingles, taken in an order common to all, at least k are shared. The
search has these levels:

* Over all documents: of each set the n - T + k shingles with the smallest hashes go into inverted lists. Short
  lists are expanded, equal lists once, and the occurrences of each pair are counted; pairs that reach k, less
  what long lists may hide, are candidates. Long lists are never expanded.
* Documents whose shared shingles may all be in long lists (a passage that many have is enough for that) are taken
  again, by their rarest shingles instead of those with the smallest hashes: what is their own comes first, the
  passage last. Only those that hardly have anything of their own still have long lists; they are tied to the first
  such document of the list.
* Within each connected group of candidates: T-occurrence search over the whole sets. The short inverted lists of a
  document are merged by sorting, documents that occur often enough are looked up in its long lists by binary
  search (DivideSkip), and those that reach the required overlap are linked.

A large group is mostly one document edited many times. Its members are compared with a few leaders first; those
linked to the same one need not meet. The others meet all, in blocks: the work grows with their number times the
group's size, not with the square of the group's size.

Equal sets are one class from the start, so exact copies never meet.
"""

from __future__ import annotations

from functools import reduce
from hashlib import blake2b
from math import log2

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import connected_components, drop, read, save, unused

SHINGLE = 4
PERCENT = 85
#: Lists of more documents than this are long.
LONG = 48
#: Documents of a block of a candidate group, and of a large group at least; a task holds two blocks.
BLOCK = 500
#: Leaders that members of a large group are compared with, one after the other.
LEADERS = 3
#: Weight of a long list's length in DivideSkip's choice of how many lists to set aside.
MU = 0.0085

_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)


class _Words(dict):
    """64-bit hashes of words, kept for those seen before."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        h = self[word] = int.from_bytes(blake2b(word, digest_size=8).digest(), "little")
        return h


def shingles(text: str | None, size: int, words: _Words) -> np.ndarray:
    """The sorted distinct hashes of a text's word shingles; of fewer words, the whole sequence as one."""
    found = (text or "").encode().lower().split()
    if not found:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(words.__getitem__, found), np.uint64, len(found))
    n = min(size, len(w))
    h = np.full(len(w) - n + 1, n, np.uint64)
    for i in range(n):  # position by position, mixing after each, so any size of shingle works
        h = (h ^ w[i : len(w) - n + 1 + i]) * _ODD[i % len(_ODD)]
        h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return np.unique(h ^ (h >> np.uint64(32)))


def least_overlap(n: int, percent: int) -> int:
    """Shingles that a set of n shares at least with any set it is linked to."""
    return -(-percent * n // 100)


def extra(n: int, percent: int) -> int:
    """k: how many shared shingles the lists must show. Grows with n, so that a shared passage alone shows too few."""
    return 1 + (n - least_overlap(n, percent)) // 3


def linked(overlap: int, n: int, m: int, percent: int) -> bool:
    """Whether two sets of n and m with this intersection reach the bound."""
    return 100 * overlap >= percent * (n + m - overlap)


def divide_skip(query: list, least: int) -> list[int]:
    """The numbers that occur in at least ``least`` of the sorted lists, which repeat none."""
    lists = sorted((x for x in query if len(x)), key=len)
    if len(lists) < least:
        return []
    apart = min(least - 1, int(least / (MU * log2(len(lists[-1]) + 1) + 1)))
    short, long_ = lists[: len(lists) - apart], lists[len(lists) - apart :]
    found, count = np.unique(np.concatenate(short), return_counts=True)
    for rest, x in zip(range(len(long_), 0, -1), long_, strict=True):
        enough = count + rest >= least
        if not enough.all():
            found, count = found[enough], count[enough]
            if not len(found):
                return []
        at = np.searchsorted(x, found)
        count += np.take(x, at, mode="clip") == found
    return found[count >= least].tolist()


def _cut_lists(lists: np.ndarray, begin: np.ndarray, end: np.ndarray, wanted: np.ndarray, most: int = 1 << 20) -> list[np.ndarray]:
    """Of the parts ``begin`` to ``end`` of a flat row of lists what is ``wanted``, without empty ones."""
    out, sums, i = [], np.concatenate([[0], np.cumsum(end - begin)]), 0
    while i < len(begin):  # so many numbers at once
        j = max(i + 1, int(np.searchsorted(sums, sums[i] + most, "right")) - 1)
        n = end[i:j] - begin[i:j]
        x = lists[np.repeat(begin[i:j] - sums[i:j] + sums[i], n) + np.arange(sums[j] - sums[i])]
        stays = wanted[x]
        bounds = np.concatenate([[0], np.cumsum(stays)])[sums[i : j + 1] - sums[i]]
        x = x[stays]
        out += [x[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()) if a < b]
        i = j
    return out


def link_group(sets: list[np.ndarray], groups: np.ndarray, sides: np.ndarray, percent: int, connected: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links (places in ``sets``) that connect what is connected; sides: only different ones meet, unless all are equal.

    A document that links with the first of its group's largest connected parts needs to be searched for against
    the rest only: a link inside a part changes nothing. ``connected``: those known to be connected already.
    """
    n = len(sets)
    sizes = np.array([len(s) for s in sets])
    order = np.argsort(sizes, kind="stable")
    ids, token = np.unique(np.concatenate(sets), return_inverse=True)
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    tokens = [token[bounds[k] : bounds[k + 1]] for k in range(n)]
    one_side = len(np.unique(sides)) == 1
    # Inverted lists hold ranks in the order of size; those of a single document are empty of partners.
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    owner = np.repeat(rank, sizes)
    by_token = np.lexsort((owner, token))
    lists = owner[by_token].astype(np.int32)
    start = np.concatenate([[0], np.cumsum(np.bincount(token, minlength=len(ids)))])
    filled = start[:-1].copy()  # of each list, where it ends for those before the rank that has its turn
    by_size, side_of = sizes[order], np.asarray(sides)[order]
    part = np.arange(n)  # of each rank
    members: dict[int, list[int]] = {k: [k] for k in range(n)}
    if connected is not None and connected.any():
        ranks = np.flatnonzero(connected[order])
        part[ranks] = ranks[0]
        members = {k: [k] for k in range(n) if part[k] == k} | {int(ranks[0]): ranks.tolist()}
    met = dict.fromkeys(members, 0)  # of a part: members that have had their turn
    leaders: dict[int, list[int]] = {}  # of a group: the parts that began in it
    seen: dict[int, int] = {}
    mark = np.zeros(len(ids), bool)
    links = []

    def join(a: int, b: int) -> None:
        links.append((int(order[a]), int(order[b])))
        x, y = sorted((int(part[a]), int(part[b])), key=lambda p: len(members[p]))
        part[members[x]] = y
        members[y] += members.pop(x)
        met[y] += met.pop(x)

    for r in range(n):
        k = int(order[r])
        group, own = int(groups[k]), tokens[k]
        least = least_overlap(int(sizes[k]), percent)
        parts = leaders.setdefault(group, [])
        earlier = seen.get(group, 0)
        seen[group] = earlier + 1
        if met[int(part[r])] < earlier:  # someone of the group is not connected yet
            mark[own] = True

            def reaches(y: int, own_size=int(sizes[k])) -> bool:
                j = int(order[y])
                return linked(int(mark[tokens[j]].sum()), own_size, int(sizes[j]), percent)

            live = sorted({int(part[p]) for p in parts}, key=lambda p: -len(members[p]))
            parts[:] = live
            for p in live[:3]:
                y = next((y for y in members[p][-4:] if one_side or sides[order[y]] != sides[k]), None)
                if y is not None and part[y] != part[r] and reaches(y):
                    join(y, r)
            if met[int(part[r])] < earlier:
                # Smaller sets than ``least`` can't be linked with this one.
                wanted = part != part[r]
                wanted[: np.searchsorted(by_size, least)] = False
                if not one_side:
                    wanted &= side_of != sides[k]
                for y in divide_skip(_cut_lists(lists, start[own], filled[own], wanted), least):
                    if part[y] != part[r] and reaches(y):
                        join(y, r)
            mark[own] = False
        filled[own] += 1
        met[int(part[r])] += 1
        if int(part[r]) not in parts:
            parts.append(int(part[r]))
    return links


def jaccard_groups(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, long_: int = LONG, block: int = BLOCK) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``docs`` (doc_id, text).

    A-Z are lower-cased, words are runs of anything but ASCII white space. Two documents are linked when their
    sets' intersection is at least ``percent`` hundredths of the union; component_id is the smallest doc_id
    reachable by links, the own one included. Null, empty and blank texts have no set and stay alone. A row with a
    null doc_id stays alone, with a null component. Repeated rows come back as often and are linked; rows of one
    doc_id with different texts are documents of their own. An empty table gives no rows. Other columns are ignored.
    Texts are read whole.
    """
    return _grouped(docs, shingle, percent, long_, block).drop("mark")


def _mark(text: Column) -> Column:
    """Tells the texts of one doc_id apart."""
    return F.xxhash64(text.isNull(), text)


def _grouped(docs: DataFrame, shingle: int, percent: int, long_: int = LONG, block: int = BLOCK) -> DataFrame:
    """``jaccard_groups`` with the mark of each row's text."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", _mark(F.col("text")).alias("mark"))

    def sketch(batches):
        words = _Words()
        for batch in (b.slice(k, 1000) for b in batches for k in range(0, b.num_rows, 1000)):
            keys, sizes, firsts = [], [], []
            for text in batch.column("text"):
                s = shingles(text.as_py(), shingle, words)
                n = len(s)
                sizes.append(n)
                keys.append(blake2b(s.tobytes(), digest_size=16).digest() if n else None)
                firsts.append(s[: n - least_overlap(n, percent) + extra(n, percent)].tobytes() if n else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("mark"), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(firsts, pa.binary())],
                ["doc_id", "mark", "n", "key", "firsts"],
            )

    def postings(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 2000):
                part = batch.slice(k, 2000)
                firsts = part.column("firsts").to_pylist()
                counts = np.array([len(x) // 8 for x in firsts], np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.frombuffer(b"".join(firsts), np.int64)),
                        pa.array(np.repeat(part.column("cls").to_numpy(), counts)),
                        pa.array(np.repeat(part.column("n").to_numpy(), counts)),
                    ],
                    ["h", "cls", "n"],
                )

    sketched = save(own.mapInArrow(sketch, "doc_id long, mark long, n long, key binary, firsts binary"))
    keyed = sketched.where("key is not null and doc_id is not null")
    # A class of equal sets has a number of its own: a doc_id can have several sets.
    cls = F.xxhash64("key").alias("cls")
    classes = keyed.groupBy("key").agg(F.first("n").alias("n"), F.first("firsts").alias("firsts")).withColumn("cls", cls)
    earliest = save(keyed.groupBy("key").agg(F.min("doc_id").alias("least")).select("key", cls, "least"))

    def whole(batches):
        words = _Words()
        for batch in (b.slice(k, 1000) for b in batches for k in range(0, b.num_rows, 1000)):
            found = [shingles(x.as_py(), shingle, words).tobytes() for x in batch.column("text")]
            keys = [blake2b(x, digest_size=16).digest() for x in found]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(found, pa.binary())], ["key", "set"])

    def sets_of(wanted: DataFrame) -> DataFrame:
        """(id, set) of the classes ``wanted`` (id)."""
        # One document of each class tells its set; what other texts it has are sets of other classes. The holders are
        # a share of all documents: a merge join at every size, no broadcast.
        holders = earliest.join(wanted.select(F.col("id").alias("cls")), "cls", "left_semi").select(F.col("least").alias("doc_id")).distinct()
        texts = own.select("doc_id", "text").where("doc_id is not null").join(holders.hint("merge"), "doc_id", "left_semi")
        sets = texts.mapInArrow(whole, "key binary, set binary").groupBy(F.xxhash64("key").alias("id")).agg(F.max("set").alias("set"))
        return sets.join(wanted, "id", "left_semi")

    # By the smallest hashes.
    posted = save(classes.select("cls", "n", "firsts").mapInArrow(postings, "h long, cls long, n long"))
    held = _lists(posted)
    drop(posted)
    deep = save(_deep(held, percent, long_).select(F.col("cls").alias("id")))
    candidates = save(_pairs(held, percent, long_))
    drop(held)
    # Whoever is in a group is one of these.
    ends = candidates.select(F.explode(F.array("a", "b")).alias("id"))
    sets = save(sets_of(save(ends.union(deep).distinct())))

    # By the rarest shingles, those that long lists could hide.
    if not deep.isEmpty():
        spread = save(sets.join(deep, "id", "left_semi").select(F.col("id").alias("cls"), (F.octet_length("set") / 8).cast("long").alias("n"), F.col("set").alias("firsts")).mapInArrow(postings, "h long, cls long, n long"))
        often = save(spread.groupBy("h").agg(F.count("*").alias("often")))
        place = F.row_number().over(Window.partitionBy("cls").orderBy("often", "h"))
        shown = F.col("n") - F.ceil(F.col("n") * percent / 100) + _least_shown(F.col("n"), percent)
        rare = save(spread.join(often, "h").withColumn("place", place).where(F.col("place") <= shown).select("h", "cls", "n"))
        held = _lists(rare)
        ties = save(held.where(F.col("df") > long_).join(_deep(held, percent, long_), "cls", "left_semi").select("h", "cls"))
        heads = save(ties.groupBy("h").agg(F.min("cls").alias("a")))
        tied = ties.join(heads, "h").where("a <> cls").select("a", F.col("cls").alias("b"))
        more = save(candidates.union(_pairs(held, percent, long_)).union(tied))
        for table in (candidates, spread, often, rare, held, ties, heads):
            drop(table)
        candidates = more
    groups = save(connected_components(candidates))
    drop(candidates)
    drop(deep)

    # Search within groups: small ones share a task.
    counts = save(groups.groupBy("component").agg(F.count("*").alias("size")))
    members = save(groups.join(sets, "id").join(counts, "component"))
    drop(sets)
    total = members.where(F.col("size") <= block).count()
    shard = F.pmod(F.xxhash64("component"), F.lit(max(1, -(-total // block))))
    small = members.where(F.col("size") <= block).select("id", "component", "set", shard.alias("shard"), *[F.lit(-1).alias(k) for k in ("own", "lo", "hi")], F.lit(False).alias("settled"))
    parts, links = small, []
    many = members.where(F.col("size") > block).drop("size")
    if not many.isEmpty():
        large, led = _split_large(many, percent, block)
        parts, links = small.union(large), [led]

    def search(table: pa.Table) -> pa.Table:
        ids = table.column("id").to_numpy()
        found = [np.frombuffer(x, np.uint64) for x in table.column("set").to_pylist()]
        lo, hi = table.column("lo")[0].as_py(), table.column("hi")[0].as_py()
        sides = table.column("own").to_numpy() if lo != hi else np.zeros(len(ids), np.int64)
        links = link_group(found, table.column("component").to_numpy(), sides, percent, table.column("settled").to_numpy())
        a = np.array([x for x, _ in links], np.int64)
        b = np.array([y for _, y in links], np.int64)
        return pa.table({"a": pa.array(ids[a]), "b": pa.array(ids[b])})

    links.append(parts.groupBy("shard", "lo", "hi").applyInArrow(search, "a long, b long"))
    found = save(connected_components(reduce(DataFrame.union, links)))
    drop(members)
    least = found.join(earliest, F.col("cls") == F.col("id")).groupBy("component").agg(F.min("least").alias("linked_id"))
    component = save(earliest.join(found.join(save(least), "component"), F.col("cls") == F.col("id")).select("key", F.col("linked_id").alias("component_id")))
    alone = F.coalesce("component_id", "least")
    of_key = save(earliest.join(component, "key", "left").select("key", alone.alias("component_id")))
    return sketched.select("doc_id", "mark", "n", "key").join(of_key, "key", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"), "mark"
    )


def _least_shown(n: Column, percent: int) -> Column:
    """k, as ``extra``."""
    return F.lit(1) + F.floor((n - F.ceil(n * percent / 100)) / 3)


def _lists(posted: DataFrame) -> DataFrame:
    """(h, cls, n, df) for the lists of several documents; df is the length."""
    # A table of its own: the join with it is a plain one, and Spark divides a list that many documents are in.
    shared = save(posted.groupBy("h").agg(F.count("*").alias("df")).where("df > 1"))
    held = save(posted.join(shared, "h"))
    drop(shared)
    return held


def _hidden(held: DataFrame, long_: int) -> DataFrame:
    """(cls, hot, n): how many of a document's shingles long lists hold."""
    return held.where(F.col("df") > long_).groupBy("cls").agg(F.count("*").alias("hot"), F.first("n").alias("n"))


def _deep(held: DataFrame, percent: int, long_: int) -> DataFrame:
    """(cls) of documents that long lists could hide entirely from a partner."""
    # Partners can be as small as percent hundredths of n.
    return _hidden(held, long_).where(F.col("hot") >= _least_shown(F.ceil(F.col("n") * percent / 100), percent)).select("cls")


def _pairs(held: DataFrame, percent: int, long_: int) -> DataFrame:
    """(a, b) of documents that share enough in short lists, or may with what long lists hide of both."""
    # Equal lists once, with their number.
    short = (
        held.where(F.col("df") <= long_)
        .groupBy("h")
        .agg(F.sort_array(F.collect_list(F.struct("n", "cls"))).alias("who"))  # long_ entries at most
        .groupBy("who")
        .agg(F.count("*").alias("times"))
    )
    later = F.explode(F.filter(F.slice("who", F.col("i") + 2, long_), lambda y: y["n"] * percent <= F.get("who", F.col("i"))["n"] * 100))
    pairs = (
        short.select("who", "times", F.explode(F.sequence(F.lit(0), F.size("who") - 2)).alias("i"))
        .select("times", F.get("who", F.col("i")).alias("x"), later.alias("y"))
        .groupBy(F.col("x.cls").alias("a"), F.col("y.cls").alias("b"))
        .agg(F.sum("times").alias("times"), F.first("x.n").alias("n"))
    )
    hot = _hidden(held, long_)
    k = _least_shown(F.col("n"), percent)
    # Some of what these share may be in long lists.
    less = pairs.where(F.col("times") < k).join(hot.select(F.col("cls").alias("a"), F.col("hot").alias("ha")), "a").join(hot.select(F.col("cls").alias("b"), F.col("hot").alias("hb")), "b")
    return pairs.where(F.col("times") >= k).select("a", "b").union(less.where(F.col("times") + F.least("ha", "hb") >= k).select("a", "b"))


def _split_large(members: DataFrame, percent: int, block: int) -> tuple[DataFrame, DataFrame]:
    """Of large groups' ``members`` (id, component, set): pairs of blocks to search, and links (a, b) to leaders.

    Members linked to the leader that most are linked to are settled: they meet only the others. A row of the first
    frame is a member in a pair of blocks (shard, lo, hi), of which its own is one.
    """

    def compare(batches):
        for batch in batches:
            sets, leads = batch.column("set"), batch.column("lead")
            good = []
            for i in range(batch.num_rows):
                x, y = (np.frombuffer(c[i].as_buffer(), np.uint64) for c in (sets, leads))
                good.append(linked(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y), percent))
            yield pa.RecordBatch.from_arrays([batch.column(k) for k in ("id", "component", "leader")] + [pa.array(good, pa.bool_())], ["id", "component", "leader", "good"])

    now, rounds = members.select("id", "component"), []
    for _ in range(LEADERS):
        # Numbers of classes are hashes: the least is any.
        leaders = save(now.groupBy("component").agg(F.min("id").alias("leader")))
        leads = save(leaders.join(members.select(F.col("id").alias("leader"), F.col("set").alias("lead")), "leader").select("component", "leader", "lead"))
        open_ = members.join(now.select("id"), "id", "left_semi").join(leads, "component")
        tested = save(open_.select("id", "component", "leader", "set", "lead").mapInArrow(compare, "id long, component long, leader long, good boolean"))
        for table in (leaders, leads):
            drop(table)
        rounds.append(tested.where("good").select("id", "component", "leader"))
        now = tested.where("not good").select("id", "component")
    led = save(reduce(DataFrame.union, rounds))
    sizes = led.groupBy("component", "leader").agg(F.count("*").alias("size"))
    main = save(sizes.groupBy("component").agg(F.max_by("leader", F.struct("size", "leader")).alias("leader"), F.max("size").alias("settled_n")))
    settled = led.join(main, ["component", "leader"]).select("id", F.lit(True).alias("settled"))
    counts = save(members.groupBy("component").agg(F.count("*").alias("n")).join(main, "component").select("component", "settled_n", (F.col("n") - F.col("settled_n")).alias("rest_n")))
    blocks = lambda n: F.ceil(F.col(n) / block).cast("int")
    placed = (
        members.join(settled, "id", "left").join(counts, "component")
        .select("id", "component", "set", F.coalesce("settled", F.lit(False)).alias("settled"), blocks("rest_n").alias("r"), blocks("settled_n").alias("s"))
        .where("r > 0")
    )
    # The others' blocks come first; each meets all, one of the settled only those.
    own = F.pmod(F.xxhash64("id"), F.when(F.col("settled"), F.col("s")).otherwise(F.col("r"))).cast("int") + F.when(F.col("settled"), F.col("r")).otherwise(0)
    placed = placed.withColumn("own", own).withColumn("meets", F.explode(F.sequence(F.lit(0), F.when(F.col("settled"), F.col("r")).otherwise(F.col("r") + F.col("s")) - 1)))
    large = placed.select("id", "component", "set", F.col("component").alias("shard"), "own", F.least("own", "meets").alias("lo"), F.greatest("own", "meets").alias("hi"), "settled")
    return large, led.select(F.col("id").alias("a"), F.col("leader").alias("b"))


def keep_one(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that stay when one document of each group does: that with the smallest doc_id.

    All columns stay. Of rows that repeat a kept doc_id one stays, by text and then any; a row of it whose text is in
    the group of a smaller doc_id is not among them. Rows with a null doc_id are in no group and all stay; documents
    without words are in no group, and one row of each stays.
    """
    groups = save(_grouped(docs.select("doc_id", "text"), shingle, percent))
    id_, mark, row = unused(docs, "_id", "_mark", "_row")
    gone = groups.where("n_shingles > 0 and doc_id <> component_id").select(F.col("doc_id").alias(id_), F.col("mark").alias(mark)).distinct()
    kept = docs.join(gone, (F.col("doc_id") == F.col(id_)) & (_mark(F.col("text")) == F.col(mark)), "left_anti")
    stay = groups.where("doc_id is not null and not (n_shingles > 0 and doc_id <> component_id)")
    repeated = save(stay.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc_id").alias(id_)))
    if repeated.isEmpty():
        return kept
    same = F.col("doc_id") == F.col(id_)
    # Partial minima come before the shuffle: a row that a third of the table repeats is one row of each task.
    whole = F.struct(*[F.col(c).alias(f"_{k}") for k, c in enumerate(docs.columns)])
    one = kept.join(repeated, same, "left_semi").groupBy("doc_id").agg(F.min_by(whole, F.struct("text")).alias(row))
    return kept.join(repeated, same, "left_anti").union(one.select(*[F.col(f"{row}._{k}").alias(c) for k, c in enumerate(docs.columns)]))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``documents``: distinct 4-word shingles, Jaccard 0.85."""
    return jaccard_groups(read(spark, sf_dir, "documents"))


OP3_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') w
      FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + least(4, len(w)) - 1], ' ') k
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 0) + 2)) i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) n FROM s GROUP BY 1),
o AS (SELECT x.doc_id a, y.doc_id b, count(*) c FROM s x JOIN s y ON x.k = y.k AND x.doc_id < y.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM o JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 85 * (p.n + q.n - c)),
both_ways AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (SELECT doc_id id, doc_id reach FROM n UNION SELECT r.id, both_ways.b FROM r JOIN both_ways ON both_ways.a = r.reach)
SELECT w.doc_id, coalesce(n, 0) n_shingles, coalesce(m, w.doc_id) component_id
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT id doc_id, min(reach) m FROM r GROUP BY 1) USING (doc_id)
"""
