"""Embedding near-dedup by randomised-rotation binary codes.

Every unit vector o is turned by one random rotation; the signs of its coordinates are its code ō, and with the
code goes one correction factor f = <ō, o>. For another unit vector q, <ō, q> / f is an unbiased estimate of
<o, q>, and its error is sqrt(1 - f²) / f times the part of q that is orthogonal to o times the cosine of an angle
that the rotation makes random. The turned q stands in few bits a coordinate: the estimate of a pair is a count of
common bits, plane by plane, and what rounding leaves of q adds to the error in the same way. A bound on those
cosines says which pairs can reach the threshold; only these are recomputed, in double precision from the vectors
as given. The bound is a confidence bound of ``epsilon`` deviations; with ``epsilon`` None it is the certain one (a
cosine is 1 at most).

Codes, factors and planes are worked out once for each different vector and stored with it.

Vectors meet by label. Large labels are divided into cells around sampled pivots, each vector goes to its own cell
and to those whose border is closer than the margin; cells are divided into blocks, and pairs of blocks are tasks.
Equal vectors are one class from the start.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  pa.compute
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import connected_components, read, save

THRESHOLD = 0.98
#: Deviations of the confidence bound: a pair at the threshold is missed once in some hundred million times.
EPSILON = 6.0
#: Bits of a coordinate of the vector that a code is compared with.
PLANES = 6
SEED = 71
#: Vectors of a block; a task holds two.
BLOCK = 2048
#: Vectors for which a label gets one pivot.
CELL = 16384
#: Pivots of all labels together at most; they are sampled and broadcast.
PIVOTS = 8192


def rotation(dim: int, seed: int = SEED) -> np.ndarray:
    """A random orthogonal matrix, the same everywhere."""
    q, r = np.linalg.qr(np.random.default_rng(seed + dim).normal(size=(dim, dim)))
    return q * np.sign(np.diag(r))


def _packed(bits: np.ndarray) -> np.ndarray:
    """Rows of bits as rows of 64-bit words."""
    out = np.zeros((len(bits), -(-bits.shape[1] // 64) * 8), np.uint8)
    out[:, : -(-bits.shape[1] // 8)] = np.packbits(bits, axis=1)
    return out.view(np.uint64)


class Codes:
    """What is stored of unit vectors: ``codes`` (packed signs) and ``factors``; for those on the other side of an
    estimate ``planes`` (packed bits of rounded coordinates, lowest first), and of each vector (least coordinate,
    step, sum of the rounded coordinates in steps, length of what rounding leaves) in ``scales``."""

    def __init__(self, codes: np.ndarray, factors: np.ndarray, planes: np.ndarray, scales: np.ndarray, dim: int):
        self.codes, self.factors, self.planes, self.scales, self.dim = codes, factors, planes, scales, dim

    @classmethod
    def of(cls, units: np.ndarray, turn: np.ndarray) -> Codes:
        turned = units @ turn
        factors = np.abs(turned).sum(1) / np.sqrt(units.shape[1])  # <ō, o> with ō = sign / sqrt(dim)
        least = turned.min(1)
        step = np.maximum((turned.max(1) - least) / ((1 << PLANES) - 1), 1e-300)
        level = np.rint((turned - least[:, None]) / step[:, None]).astype(np.int64)
        rest = np.sqrt(((turned - least[:, None] - level * step[:, None]) ** 2).sum(1))
        planes = np.stack([_packed((level >> j & 1).astype(bool)) for j in range(PLANES)], 1)
        return cls(_packed(turned >= 0), factors, planes, np.stack([least, step, level.sum(1), rest], 1), units.shape[1])

    def packed(self) -> list[bytes]:
        """One value for each vector."""
        return [b"".join(x.tobytes() for x in row) for row in zip(self.codes, self.factors, self.planes, self.scales, strict=True)]

    @classmethod
    def unpacked(cls, rows: list[bytes], dim: int) -> Codes:
        words = -(-dim // 64)
        kind = np.dtype([("codes", np.uint64, words), ("factors", np.float64), ("planes", np.uint64, (PLANES, words)), ("scales", np.float64, 4)])
        x = np.frombuffer(b"".join(rows), kind)
        return cls(x["codes"].reshape(len(x), words), x["factors"], x["planes"], x["scales"], dim)

    def estimates(self, other: Codes, rows: slice = slice(None)) -> np.ndarray:
        """Unbiased estimates of the inner products of own vectors (by code) with the others' (by planes)."""
        codes, root = self.codes[rows], np.sqrt(self.dim)
        shared = np.zeros((len(codes), len(other.codes)), np.int32)
        for w in range(codes.shape[1]):
            own = np.ascontiguousarray(codes[:, w])[:, None]
            for j in range(PLANES):
                shared += np.bitwise_count(own & np.ascontiguousarray(other.planes[:, j, w])).astype(np.int32) << j
        ones = np.bitwise_count(codes).sum(1).astype(np.float64)
        least, step, total, _ = other.scales.T
        found = (2 * ones - self.dim)[:, None] * least + step * (2.0 * shared - total)
        return found / (root * self.factors[rows, None])

    def slack(self, other: Codes, threshold: float, epsilon: float | None, rows: slice = slice(None)) -> np.ndarray:
        """How far below the truth an estimate can be for a pair at the threshold or above."""
        share = 1.0 if epsilon is None else min(1.0, epsilon / np.sqrt(max(1, self.dim - 1)))
        f = self.factors[rows, None]
        return (np.sqrt(np.maximum(0, 1 - f**2)) * np.sqrt(1 - threshold**2) + other.scales[:, 3]) * share / f


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, in double precision."""
    return (a * b).sum(1) / (np.sqrt((a * a).sum(1)) * np.sqrt((b * b).sum(1)))


def block_links(left: dict, right: dict | None, cell: int, threshold: float, epsilon: float | None, step: int = 256):
    """(links of left rows, links of right rows, edges) between two blocks, or within one if ``right`` is None.

    A pair that meets in several cells counts in the first that both are in. Links count a partner's copies.
    """
    other = right or left
    n, m = len(left["vectors"]), len(other["vectors"])
    count_l, count_r = np.zeros(n, np.int64), np.zeros(m, np.int64)
    total = n + (m if right else 0)
    part, shift = np.arange(total), n if right else 0
    for k in range(0, n, step):
        rows, mine, theirs = slice(k, k + step), left["codes"], other["codes"]
        a, b = np.nonzero(mine.estimates(theirs, rows) + mine.slack(theirs, threshold, epsilon, rows) >= threshold - 1e-9)
        a = a + k
        if right is None:
            a, b = a[a < b], b[a < b]
        for s in range(0, len(a), 1 << 15):
            x, y = a[s : s + (1 << 15)], b[s : s + (1 << 15)]
            good = cosines(left["vectors"][x], other["vectors"][y]) >= threshold
            x, y = x[good], y[good]
            if left["cells"] is not None and len(x):
                first = np.array([min(set(left["cells"][i]).intersection(other["cells"][j])) == cell for i, j in zip(x, y, strict=True)], bool)
                x, y = x[first], y[first]
            if not len(x):
                continue
            count_l += np.bincount(x, other["copies"][y], n).astype(np.int64)
            count_r += np.bincount(y, left["copies"][x], m).astype(np.int64)
            u, v = x, y + shift
            while True:  # smallest number of each connected part, by rounds over all pairs at once
                low = np.minimum(part[u], part[v])
                new = part.copy()
                np.minimum.at(new, part[u], low)
                np.minimum.at(new, part[v], low)
                while not np.array_equal(new, new[new]):
                    new = new[new]
                if np.array_equal(new, part):
                    break
                part = new
    own = np.flatnonzero(part != np.arange(total))
    ids = np.concatenate([left["ids"], other["ids"]]) if right else left["ids"]
    return count_l, count_r, ids[own], ids[part[own]]


def near_duplicates(
    vectors: DataFrame, threshold: float = THRESHOLD, epsilon: float | None = EPSILON, cell: int = CELL, block: int = BLOCK, margin: float | None = None
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``vectors`` (vec_id, embedding, label).

    Rows of equal labels that are not null are linked when their cosine is ``threshold`` or more; n_links counts
    the other rows linked directly, component_id is the smallest vec_id reachable, kept says that it is the own
    one. Vectors that are null, empty, zero or hold null or non-finite components, and vectors of different
    lengths, link with nothing. Repeated rows are linked with each other; a null vec_id stays alone, with a null
    component, and kept. An empty table gives no rows. Other columns are ignored.

    ``epsilon``: deviations of the confidence bound that spares pairs their recomputation; None spares only those that
    cannot reach the threshold. ``margin``: how close to a cell's border (in distance between unit vectors) a vector is sent to the other side.
    None is the largest distance of a linked pair, with which no pair is lost; labels of up to ``cell`` vectors
    have one cell and lose none with any margin.
    """
    margin = float(np.sqrt(2 - 2 * threshold)) if margin is None else margin
    own = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), F.col("label").cast("string").alias("label"))

    def clean(batches):
        for batch in batches:
            keys, data, dims = [], [], []
            for x, label in zip(batch.column("embedding").to_pylist(), batch.column("label").to_pylist(), strict=True):
                good = bool(x) and label is not None and None not in x
                v = np.array(x, np.float64) + 0.0 if good else None  # -0.0 becomes 0.0
                with np.errstate(over="ignore"):
                    good = good and bool(np.isfinite(v).all()) and 0 < float((v * v).sum()) < np.inf
                data.append(v.tobytes() if good else None)
                keys.append(blake2b(v.tobytes(), digest_size=16).digest() if good else None)
                dims.append(len(v) if good else 0)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("label"), pa.array(dims, pa.int32()), pa.array(keys, pa.binary()), pa.array(data, pa.binary())],
                ["vec_id", "label", "dim", "key", "data"],
            )

    cleaned = save(own.mapInArrow(clean, "vec_id long, label string, dim int, key binary, data binary"))
    usable = cleaned.where("key is not null and vec_id is not null")
    grouped = usable.groupBy("label", "dim", "key").agg(F.min("vec_id").alias("cls"), F.count("*").alias("copies"), F.first("data").alias("data"))

    def code(batches):
        turns: dict[int, np.ndarray] = {}
        for batch in (b.slice(k, 2000) for b in batches for k in range(0, b.num_rows, 2000)):
            dims, data = batch.column("dim").to_numpy(), batch.column("data").to_pylist()
            codes: list = [None] * len(dims)
            for dim in set(dims.tolist()):
                rows = np.flatnonzero(dims == dim).tolist()
                turn = turns[dim] = turns[dim] if dim in turns else rotation(dim)
                v = np.frombuffer(b"".join(data[i] for i in rows)).reshape(-1, dim)
                for i, x in zip(rows, Codes.of(v / np.sqrt((v * v).sum(1))[:, None], turn).packed(), strict=True):
                    codes[i] = x
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(codes, pa.binary())], [*batch.schema.names, "code"])

    coded = T.StructType([*grouped.schema.fields, T.StructField("code", T.BinaryType())])
    classes = save(grouped.mapInArrow(code, coded))

    # Pivots: of each label one in ``cell`` classes, by hash; labels of fewer have a single cell and need none.
    sizes = classes.groupBy("label", "dim").agg(F.count("*").alias("n")).where(F.col("n") > cell)
    share = F.least(F.lit(1.0), F.lit(PIVOTS / 2.0) / F.sum(F.ceil(F.col("n") / cell)).over(Window.partitionBy()))
    wanted = sizes.withColumn("pivots", F.greatest(F.lit(1), F.ceil(F.ceil(F.col("n") / cell) * share)))
    sample = (
        classes.join(wanted, ["label", "dim"])
        .withColumn("u", F.pmod(F.xxhash64(F.lit(SEED), "key"), F.lit(1 << 40)) / F.lit(float(1 << 40)))
        .where(F.col("u") < F.col("pivots") / F.col("n"))
        .orderBy("u", "cls")
        .limit(PIVOTS)
        .select("label", "dim", "data")
    )
    pivots: dict = {}
    for r in sample.collect():
        v = np.frombuffer(r["data"])
        pivots.setdefault((r["label"], r["dim"]), []).append(v / np.sqrt((v * v).sum()))
    sent = vectors.sparkSession.sparkContext.broadcast({k: np.array(v) for k, v in pivots.items()})

    def place(batches):
        for batch in batches:
            table = pa.Table.from_batches([batch])
            labels, dims = table.column("label").to_pylist(), table.column("dim").to_pylist()
            cells = [[0]] * len(labels)
            for key in set(zip(labels, dims, strict=True)).intersection(sent.value):
                p = sent.value[key]
                rows = [i for i, x in enumerate(zip(labels, dims, strict=True)) if x == key]
                v = np.stack([np.frombuffer(table.column("data")[i].as_py()) for i in rows])
                cos = v / np.sqrt((v * v).sum(1))[:, None] @ p.T
                home = cos.argmax(1)
                # Distance to the plane between two pivots: (cos to home - cos to other) / distance of the pivots.
                apart = np.sqrt(np.maximum(2 - 2 * p @ p.T, 0))[home]
                near = cos[np.arange(len(rows)), home][:, None] - cos <= margin * apart + 1e-9
                for i, x in zip(rows, near, strict=True):
                    cells[i] = np.flatnonzero(x).tolist()
            yield from table.append_column("cells", pa.array(cells, pa.list_(pa.int32()))).to_batches()

    placed = classes.mapInArrow(place, T.StructType([*classes.schema.fields, T.StructField("cells", T.ArrayType(T.IntegerType()))])).withColumn("cell", F.explode("cells"))
    counts = placed.groupBy("label", "dim", "cell").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    met = placed.join(counts, ["label", "dim", "cell"]).withColumn("own", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    met = met.withColumn("meets", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.withColumn("lo", F.least("own", "meets")).withColumn("hi", F.greatest("own", "meets")).drop("meets", "blocks")

    def search(table: pa.Table) -> pa.Table:
        dim, cell_, lo, hi = (table.column(c)[0].as_py() for c in ("dim", "cell", "lo", "hi"))

        def side(number: int) -> dict:
            t = table.filter(pa.compute.equal(table.column("own"), number))
            v = np.frombuffer(b"".join(t.column("data").to_pylist())).reshape(-1, dim)
            codes = Codes.unpacked(t.column("code").to_pylist(), dim)
            cells = t.column("cells").to_pylist()
            alone = all(len(c) == 1 for c in cells)
            return {"ids": t.column("cls").to_numpy(), "copies": t.column("copies").to_numpy(), "vectors": v, "codes": codes, "cells": cells, "alone": alone}

        left = side(lo)
        right = side(hi) if lo != hi else None
        if left["alone"] or (right or left)["alone"]:  # then they share this cell alone
            left["cells"] = None
        n_left, n_right, a, b = block_links(left, right, cell_, threshold, epsilon)
        ids = np.concatenate([left["ids"], (right or left)["ids"], a])
        links = np.concatenate([n_left, n_right, np.zeros(len(a), np.int64)])
        to = np.concatenate([left["ids"], (right or left)["ids"], b])
        use = (links > 0) | (ids != to)
        return pa.table({"cls": ids[use], "links": links[use], "other": to[use]})

    found = save(met.groupBy("label", "dim", "cell", "lo", "hi").applyInArrow(search, "cls long, links long, other long"))
    links = found.groupBy("cls").agg(F.sum("links").alias("links"))
    component = connected_components(found.select(F.col("cls").alias("a"), F.col("other").alias("b")))
    of_class = (
        classes.select("label", "dim", "key", "cls", "copies")
        .join(links, "cls", "left")
        .join(component.withColumnRenamed("id", "cls"), "cls", "left")
        .select("label", "dim", "key", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("_links"), F.coalesce("component", "cls").alias("_component"))
    )
    joined = cleaned.select("vec_id", "label", "dim", "key").join(of_class, ["label", "dim", "key"], "left")
    usable_id = F.col("vec_id").isNotNull()
    component_id = F.when(usable_id, F.coalesce("_component", "vec_id"))
    return joined.select(
        "vec_id",
        F.when(usable_id, F.coalesce("_links", F.lit(0))).otherwise(0).cast("long").alias("n_links"),
        component_id.alias("component_id"),
        F.coalesce(F.col("vec_id") == component_id, F.lit(True)).alias("kept"),
    )


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``embeddings``: cosine 0.98 within a label."""
    return near_duplicates(read(spark, sf_dir, "embeddings"))


OP1_SQL = r"""
WITH RECURSIVE v AS (SELECT vec_id, label, cast(embedding AS DOUBLE[]) e FROM embeddings),
u AS (SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(e) > 0
      AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_dot_product(e, e) > 0),
e AS (SELECT x.vec_id a, y.vec_id b FROM u x JOIN u y ON x.label = y.label AND x.vec_id < y.vec_id AND len(x.e) = len(y.e)
      WHERE list_dot_product(x.e, y.e) / (sqrt(list_dot_product(x.e, x.e)) * sqrt(list_dot_product(y.e, y.e))) >= 0.98),
both_ways AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (SELECT vec_id id, vec_id reach FROM v UNION SELECT r.id, both_ways.b FROM r JOIN both_ways ON both_ways.a = r.reach),
c AS (SELECT id, min(reach) component_id FROM r GROUP BY 1),
k AS (SELECT a id, count(*) n FROM both_ways GROUP BY 1)
SELECT v.vec_id, coalesce(n, 0) n_links, component_id, v.vec_id = component_id kept
FROM v JOIN c ON c.id = v.vec_id LEFT JOIN k ON k.id = v.vec_id
"""
