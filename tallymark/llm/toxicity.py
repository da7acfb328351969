"""Toxicity: a factorization machine over hashed terms.

Score = sigmoid(bias + sum of term weights + sum over pairs of terms of the product of their factors / number of
terms). The division keeps the pair part of long texts in bounds: pairs grow with the square of the length. It learns
what a sum of term weights cannot: an insult next to a mention of a group counts for more than both alone, and a word
that only quotes counts for less.
"""

from __future__ import annotations

import pickle
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import read

BITS = 18
#: Lengths of word beginnings that are terms as well.
STEMS = (4, 5)
FACTORS = 4
EPOCHS = 12
#: Steps at least: few rows are gone through more often, up to LAPS times.
STEPS, LAPS = 600, 100
#: At most so many labelled rows of either class are fitted; the model's size does not depend on it.
FIT_ROWS = 6000
#: Terms in a smaller share of the fitted rows, or in fewer than MIN_ROWS, are unknown to the model.
MIN_SHARE, MIN_ROWS = 0.006, 3
SEED = 20260829
RATE = 0.05
#: Weight decay of weights and factors.
DECAY = (2e-3, 2e-2)

_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms(text: str | None, memory: dict) -> np.ndarray:
    """The different hashed terms of a text: its words, and the first 4 and 5 bytes of longer ones.

    The beginnings stand for a stem whose endings vary. ``memory`` keeps the terms of words seen before.
    """
    found: set[int] = set()
    for w in set((text or "").encode().translate(_TABLE).split()):
        own = memory.get(w)
        if own is None:
            if len(memory) > 120_000:
                memory.clear()
            own = memory[w] = [crc32(x) & ((1 << BITS) - 1) for x in (w, *(w[:n] + b"*" for n in STEMS if len(w) > n))]
        found.update(own)
    return np.fromiter(found, np.int64, len(found))


class Machine:
    """A second-order factorization machine over presence of hashed terms."""

    def __init__(self, bias, weights, factors, known):
        self.bias, self.weights, self.factors, self.known = bias, weights, factors, known

    def margins(self, flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The score before the sigmoid of each row, given as runs of terms."""
        row = np.repeat(np.arange(len(sizes)), sizes)
        keep = self.known[flat] >= 0
        row, at = row[keep], self.known[flat[keep]]
        n = len(sizes)
        out = self.bias + np.bincount(row, self.weights[at], n)
        half = 0.5 / np.maximum(1, np.bincount(row, minlength=n))
        for f in range(self.factors.shape[1]):
            v = self.factors[at, f]
            out += half * (np.bincount(row, v, n) ** 2 - np.bincount(row, v * v, n))
        return out


def fit(rows: list[np.ndarray], labels: np.ndarray, totals: tuple[int, int] | None = None, factors: int = FACTORS, epochs: int = EPOCHS, seed: int = SEED, min_share: float = MIN_SHARE, rate: float = RATE, decay: tuple[float, float] = DECAY) -> Machine:
    """Logistic loss, Adam over small batches, decay on weights and factors.

    ``totals``: rows of class 0 and 1 that ``rows`` were drawn from, if they are a sample. Rows of the rarer class
    weigh more, by the root of how much rarer it is, and a sampled row stands for as many as there are of its class, so
    what is called toxic does not shift with the size of a table.
    """
    known = np.full(1 << BITS, -1, np.int64)
    if rows:
        seen = np.bincount(np.concatenate([*rows, np.empty(0, np.int64)]), minlength=1 << BITS)
        chosen = np.flatnonzero(seen >= max(MIN_ROWS, min_share * len(rows)))
        known[chosen] = np.arange(len(chosen))
    rng = np.random.default_rng(seed)
    m = int((known >= 0).sum())
    w, v = np.zeros(m), rng.normal(0, 0.01, (m, factors))
    taken = np.array([(labels <= 0).sum(), (labels > 0).sum()], float)
    there = np.array(totals or taken, float) + 1
    share = there[1] / there.sum()
    bias = float(np.log(share / (1 - share)))
    each = np.sqrt(there * there.max()) / (taken + 1)
    weight = (each / each[there.argmax()])[(labels > 0).astype(int)]
    packed = [known[r][known[r] >= 0] for r in rows]
    moment = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(v), np.zeros_like(v)]
    t = 0
    laps = max(epochs, min(LAPS, STEPS // max(1, -(-len(packed) // 128)))) if m else 0
    for epoch in range(laps):
        order, step = rng.permutation(len(packed)), rate / (1 + 0.3 * epoch * epochs / laps)
        for start in range(0, len(order), 128):
            own = order[start : start + 128]
            sizes = np.array([len(packed[k]) for k in own])
            at = np.concatenate([packed[k] for k in own])
            row = np.repeat(np.arange(len(own)), sizes)
            va = v[at]
            sums = np.stack([np.bincount(row, va[:, f], len(own)) for f in range(factors)], 1)
            squares = np.bincount(row, (va * va).sum(1), len(own))
            terms_n = np.maximum(1, sizes)
            margin = bias + np.bincount(row, w[at], len(own)) + 0.5 * ((sums**2).sum(1) - squares) / terms_n
            err = 1 / (1 + np.exp(-np.clip(margin, -30, 30))) - labels[own]
            err = err * weight[own]
            bias -= step * float(err.mean())
            touched, back = np.unique(at, return_inverse=True)
            g = err[row] / len(own)
            gw = np.bincount(back, g) + decay[0] * w[touched]
            pull = (g / terms_n[row])[:, None] * (sums[row] - va)
            gv = np.stack([np.bincount(back, pull[:, f]) for f in range(factors)], 1) + decay[1] * v[touched]
            t += 1
            for x, grad, a, b in ((w, gw, moment[0], moment[1]), (v, gv, moment[2], moment[3])):
                a[touched] = 0.9 * a[touched] + 0.1 * grad
                b[touched] = 0.999 * b[touched] + 0.001 * grad * grad
                x[touched] -= step * (a[touched] / (1 - 0.9**t)) / (np.sqrt(b[touched] / (1 - 0.999**t)) + 1e-8)
    return Machine(bias, w, v, known)


def held_out(doc_id: Column, parts: int = 5, part: int = 0) -> Column:
    """Whether crc32 of the id as text leaves ``part`` when divided by ``parts``; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts == part, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Machine:
    """A machine fitted on labelled rows that are not held out: of each class ``fit_rows`` at most, by hash of the id."""
    usable = (
        labels.where("doc_id is not null and toxic is not null")
        .where(~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    )
    counted = {r["toxic"]: r["n"] for r in usable.groupBy("toxic").agg(F.count("*").alias("n")).collect()}  # two rows
    totals = counted.get(0, 0), counted.get(1, 0)
    order = F.xxhash64(F.lit(SEED), "doc_id")
    chosen = usable.where("toxic = 1").orderBy(order, "doc_id").limit(fit_rows).union(usable.where("toxic = 0").orderBy(order, "doc_id").limit(fit_rows))

    def extract(batches):
        memory: dict = {}
        for batch in batches:
            found = [terms(x.as_py(), memory).astype(np.int32).tobytes() for x in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), pa.array(found, pa.binary())], ["doc_id", "toxic", "terms"])

    joined = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")  # 2 * fit_rows rows
    taken = joined.select("doc_id", "toxic", "text").mapInArrow(extract, "doc_id long, toxic int, terms binary")
    # A row of each id, however many rows of the documents have it: the least terms, combined before the shuffle.
    taken = taken.groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.min("terms").alias("terms"))

    def learn(batches):
        # The bounded sample, in one task: the driver gets the finished machine alone.
        got = []
        for b in batches:
            got += [(d, t, y) for d, y, t in zip(*[b.column(k).to_pylist() for k in range(3)], strict=True)]
            if len(got) > 2 * fit_rows:
                raise ValueError(f"more than {2 * fit_rows} rows to fit")
        got.sort()
        machine = fit([np.frombuffer(t, np.int32).astype(np.int64) for _, t, _ in got], np.array([y for *_, y in got], float), totals)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(machine)], pa.binary())], ["machine"])

    return pickle.loads(taken.repartition(1).mapInArrow(learn, "machine binary").first()[0])


def score(docs: DataFrame, machine: Machine, name: str = "score") -> DataFrame:
    """``docs`` with a score between 0 and 1: all columns stay, an own one of that ``name``, in any case, is replaced.

    Null and empty texts have no terms and get the bias alone. Long texts are read whole. Repeated rows are
    scored alike, an empty table gives no rows.
    """
    sent = docs.sparkSession.sparkContext.broadcast(machine)  # 2 ** BITS places and as many known terms at most
    names = [c for c in docs.columns if c.lower() != name.lower()]
    # By numbers, as Spark hands no names with dots to Python.
    given, at = docs.select(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(names)]), [c.lower() for c in names].index("text")
    schema = T.StructType([*given.schema.fields, T.StructField("score", T.DoubleType())])

    def run(batches):
        memory: dict = {}
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                rows = [terms(x, memory) for x in part.column(at).to_pylist()]
                flat = np.concatenate([*rows, np.empty(0, np.int64)])
                margin = sent.value.margins(flat, np.array([len(r) for r in rows], np.int64))
                scores = 1 / (1 + np.exp(-np.clip(margin, -500, 500)))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(scores)], schema.names)

    return given.mapInArrow(run, schema).toDF(*names, name)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text of ``documents`` scored."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    machine = train(docs, read(spark, sf_dir, "labels"))
    # Only text goes into a score; the id rides along.
    return score(docs, machine).select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
