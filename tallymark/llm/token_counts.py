"""Token counts: delta-maintained rollups by source, language and tokenizer version.

A batch of changes becomes signed rows: an insert adds a document and its tokens, a delete takes away what the
ledger holds for it, a revised count takes the old one away and adds the new. Totals are the sum of the batches'
totals.

The ledger lies in buckets by document, and a batch looks up only the documents that it changes, in their buckets
alone: a small batch reads a small part of the ledger, one of half the corpus half or more of it. ``compact`` replaces
batches by what they come to, so that the ledger does not grow with its history.

Each attempt at a batch writes to a folder of its own. It becomes visible with one small entry in a log, under the
next number, which one writer alone can create; whoever comes second starts again from what the ledger then holds. A
batch that is in the log is not applied again, and what an attempt without an entry wrote is never read.
"""

from __future__ import annotations

import base64
import json
import os
import uuid
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WORD, drop, read, save, scratch_dir

#: Ranks of a public byte-level vocabulary. The session's setting TOKENIZER_CONF names another place: any path that Spark reads.
TOKENIZER, TOKENIZER_CONF = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken", "spark.tallymark.tokenizer"
# Fixed value: the pattern that splits a text into pieces before the merges of byte-level BPE.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

CHANGES = "doc_id long, source string, lang string, tokenizer_version string, n_tokens long, op string"
GROUP = ["source", "lang", "tokenizer_version"]
#: Buckets of the ledger, and rows of a bucket that one task writes: a larger share of a batch is written by several.
BUCKETS, TASK_ROWS = 32, 1_000_000


def read_ranks(spark: SparkSession, tokenizer: str | None = None) -> bytes:
    """The file of ranks ``tokenizer``, or the one that the session names, or TOKENIZER; about a MB.

    A path without a scheme is one of the driver's own files, as far as it is there.
    """
    path = tokenizer or spark.conf.get(TOKENIZER_CONF, TOKENIZER)
    if os.path.isfile(path):
        with open(path, "rb") as f:
            return f.read()
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        raise FileNotFoundError(f"no file of tokenizer ranks at {path}: set {TOKENIZER_CONF} to one")
    return bytes(spark.read.format("binaryFile").load(path).select("content").first()[0])


class Encoder:
    """Byte-level BPE from a file of ranks; remembers the pieces it has met."""

    def __init__(self, ranks: bytes):
        import tiktoken
        import regex

        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        self.bpe = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})
        self.pieces = regex.compile(PATTERN).findall
        self.seen: dict[str, int] = {}

    def count(self, text: str) -> int:
        """Tokens of a text."""
        seen, total = self.seen, 0
        for p in self.pieces(text):
            n = seen.get(p)
            if n is None:
                if len(seen) > 500_000:
                    seen.clear()
                n = seen[p] = len(self.bpe.encode_ordinary(p))
            total += n
        return total


def subword_counts(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """``docs`` with n_tokens, the subword tokens of ``text``; null and empty texts have none."""
    sent = docs.sparkSession.sparkContext.broadcast(read_ranks(docs.sparkSession, tokenizer))
    names = [c for c in docs.columns if c.lower() != "n_tokens"]
    # By numbers, as Spark hands no names with dots to Python.
    given, at = docs.select(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(names)]), [c.lower() for c in names].index("text")
    schema = T.StructType([*given.schema.fields, T.StructField("n_tokens", T.LongType())])

    def count(batches):
        encoder = None
        for batch in batches:
            encoder = encoder or Encoder(sent.value)
            texts = batch.column(at).to_pylist()
            n = np.array([encoder.count(x) if x else 0 for x in texts], np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n)], schema.names)

    return given.mapInArrow(count, schema).toDF(*names, "n_tokens")


class TokenRollup:
    """A ledger of signed token counts and its rollup, in a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.rows = spark, path.rstrip("/"), 0
        self._hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        self._fs = self._hadoop.Path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _entries(self) -> list[dict]:
        """The log in order: {batches: names, folder, base}; a base replaces all before it."""
        folder, out = self._hadoop.Path(f"{self.path}/log"), []
        if not self._fs.exists(folder):
            return out
        names = sorted(n for n in (s.getPath().getName() for s in self._fs.listStatus(folder)) if n.isdigit())
        for name in names:
            stream = self._fs.open(self._hadoop.Path(f"{self.path}/log/{name}"))
            out.append(json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")))
            stream.close()
        return out

    def _enter(self, number: int, entry: dict) -> bool:
        """Create entry ``number``, whole or not at all; False if somebody else did."""
        own, place = (self._hadoop.Path(f"{self.path}/log/{x}") for x in (f"_{uuid.uuid4().hex}", f"{number:012d}"))
        stream = self._fs.create(own, False)
        stream.write(bytearray(json.dumps(entry).encode()))
        stream.close()
        try:
            # A rename to a name that is there fails; local files are renamed over, so these are checked first.
            return not self._fs.exists(place) and self._fs.rename(own, place)
        finally:
            self._fs.delete(own, False)

    def batches(self) -> list[str]:
        """Names of committed batches, in order."""
        return [b for e in self._entries() for b in e["batches"]]

    def _read(self, table: str, entries: list[dict], buckets: list[int] | None = None) -> DataFrame:
        last = max((k for k, e in enumerate(entries) if e["base"]), default=0)
        folders = [e["folder"] for e in entries[last:]]
        key = "doc_id long, " if table == "ledger" else ""
        schema = f"{key}source string, lang string, tokenizer_version string, d_docs long, d_tokens long"
        out = [self.spark.createDataFrame([], schema)]
        for folder in folders:  # each has its own buckets
            rows = self.spark.read.schema(schema + (", bucket int" if key else "")).parquet(f"{self.path}/{table}/{folder}")
            if key:
                rows = (rows if buckets is None else rows.where(F.col("bucket").isin(buckets))).drop("bucket")
            out.append(rows)
        return reduce(DataFrame.union, out)

    @staticmethod
    def _held(ledger: DataFrame) -> DataFrame:
        return (
            ledger.groupBy("doc_id", *GROUP)
            .agg(F.sum("d_docs").alias("_docs"), F.sum("d_tokens").alias("n_tokens"))
            .where("_docs > 0")
            .drop("_docs")
        )

    def current(self) -> DataFrame:
        """(doc_id, source, lang, tokenizer_version, n_tokens) of the documents held now."""
        return self._held(self._read("ledger", self._entries()))

    def totals(self) -> DataFrame:
        """(source, lang, tokenizer_version, n_docs, n_tokens); groups that hold no document are left out."""
        return (
            self._read("totals", self._entries())
            .groupBy(*GROUP)
            .agg(F.sum("d_docs").alias("n_docs"), F.sum("d_tokens").alias("n_tokens"))
            .where("n_docs <> 0 or n_tokens <> 0")
        )

    def _write(self, signed: DataFrame) -> str:
        """Signed rows, ``self.rows`` at most, and their totals, in a new folder; its name."""
        folder = uuid.uuid4().hex
        ledger = f"{self.path}/ledger/{folder}"
        slices = -(-self.rows // (BUCKETS * TASK_ROWS))
        dealt = signed.withColumn("bucket", _bucket())
        dealt = dealt.repartition("bucket") if slices <= 1 else dealt.repartition(BUCKETS * slices, "bucket", F.pmod(F.xxhash64(F.lit(1), "doc_id"), F.lit(slices)))
        dealt.write.partitionBy("bucket").parquet(ledger)
        written = self.spark.read.schema(signed.schema).parquet(ledger)
        written.groupBy(*GROUP).agg(F.sum("d_docs").alias("d_docs"), F.sum("d_tokens").alias("d_tokens")).write.parquet(f"{self.path}/totals/{folder}")
        return folder

    def _remove(self, folder: str) -> None:
        for table in ("ledger", "totals"):
            self._fs.delete(self._hadoop.Path(f"{self.path}/{table}/{folder}"), True)

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Apply a batch of CHANGES once; False if it is committed already.

        op is insert, delete or revise. A document is (doc_id, tokenizer_version). Changes with a null doc_id,
        version or op, and other ops, are ignored. Of several changes of one document in a batch one counts: a
        delete before a revise before an insert, then the largest count, source and language. An insert of a
        document that is held is a revise, a revise of one that is not held an insert, a delete of one that is
        not held nothing. A null count is 0; null sources and languages are groups of their own.
        """
        if batch in self.batches():
            return False
        rank = F.when(F.col("op") == "delete", 0).when(F.col("op") == "revise", 1).otherwise(2)
        key = ["doc_id", "tokenizer_version"]
        # Kept, so that whatever made the changes (a tokenizer, say) runs once.
        wanted = save(
            changes.where("doc_id is not null and tokenizer_version is not null and op in ('insert', 'delete', 'revise')")
            .groupBy(*key)
            .agg(F.max(F.struct((-rank).alias("r"), F.coalesce("n_tokens", F.lit(0)).alias("n"), "source", "lang", "op")).alias("c"))
            .select(*key, "c.source", "c.lang", "c.n", "c.op")
        )
        self.rows = 2 * wanted.count()  # a revision takes away and adds
        touched = [r[0] for r in wanted.select(_bucket().alias("b")).distinct().collect()]  # BUCKETS numbers at most
        row = lambda s, l, d, n: F.struct(s.alias("source"), l.alias("lang"), d.alias("d_docs"), n.alias("d_tokens"))  # noqa: E731, E741
        while True:
            entries = self._entries()
            if any(batch in e["batches"] for e in entries):
                drop(wanted)
                return False
            held = self._held(self._read("ledger", entries, touched).join(wanted.select(*key), key, "left_semi"))
            held = held.select(*key, F.col("source").alias("s0"), F.col("lang").alias("l0"), F.col("n_tokens").alias("n0"))
            both = wanted.join(held, key, "left")
            minus = F.when(F.col("n0").isNotNull(), row(F.col("s0"), F.col("l0"), F.lit(-1).cast("long"), -F.col("n0")))
            plus = F.when(F.col("op") != "delete", row(F.col("source"), F.col("lang"), F.lit(1).cast("long"), F.col("n").cast("long")))
            signed = both.select(*key, F.explode(F.filter(F.array(minus, plus), lambda x: x.isNotNull())).alias("d")).select(
                "doc_id", "d.source", "d.lang", "tokenizer_version", "d.d_docs", "d.d_tokens"
            )
            folder = self._write(signed)
            if self._enter(len(entries), {"batches": [batch], "folder": folder, "base": False}):
                drop(wanted)
                return True
            self._remove(folder)  # somebody else was first: look again at what the ledger holds

    def compact(self) -> bool:
        """Replace all batches by what they come to; False if another writer came first. Totals and names stay.

        What is replaced stays on disk for readers that began before.
        """
        entries = self._entries()
        net = self._held(self._read("ledger", entries)).select("doc_id", *GROUP, F.lit(1).cast("long").alias("d_docs"), F.col("n_tokens").alias("d_tokens"))
        self.rows = self._read("ledger", entries).count()
        folder = self._write(net)
        if self._enter(len(entries), {"batches": [], "folder": folder, "base": True}):
            return True
        self._remove(folder)
        return False


def _bucket() -> Column:
    return F.pmod(F.xxhash64("doc_id"), F.lit(BUCKETS)).cast("int")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rollup of ``documents`` after three batches, one of them sent twice.

    Words are counted for every document, and subwords estimated as a third of its code points; then subword
    counts are revised to what the tokenizer says; then documents whose text repeats that of a smaller doc_id
    are deleted from both versions.
    """
    docs = read(spark, sf_dir, "documents")
    rollup = TokenRollup(spark, f"{scratch_dir(spark)}/tokens-{uuid.uuid4().hex}")
    base = docs.select(
        "doc_id",
        "source",
        "lang",
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("words"),
        F.ceil(F.coalesce(F.length("text"), F.lit(0)) / 3).cast("long").alias("guess"),
    )
    change = lambda frame, version, n, op: frame.select(
        "doc_id", "source", "lang", F.lit(version).alias("tokenizer_version"), n.alias("n_tokens"), F.lit(op).alias("op")
    )
    both = F.explode(F.array(F.struct(F.lit("words-1").alias("v"), F.col("words").alias("n")), F.struct(F.lit("subwords-1").alias("v"), F.col("guess").alias("n"))))
    inserts = base.select("doc_id", "source", "lang", both.alias("x")).select(
        "doc_id", "source", "lang", F.col("x.v").alias("tokenizer_version"), F.col("x.n").alias("n_tokens"), F.lit("insert").alias("op")
    )
    rollup.commit("1-insert", inserts)
    counted = subword_counts(docs.select("doc_id", "source", "lang", "text")).drop("text")
    rollup.commit("2-revise", change(counted, "subwords-1", F.col("n_tokens"), "revise"))
    rollup.commit("2-revise", change(counted, "subwords-1", F.col("n_tokens"), "revise"))  # sent again: nothing happens
    named = docs.select("doc_id", "source", "lang", F.sha2(F.coalesce("text", F.lit("")), 256).alias("t"))
    # Of texts that occur more than once; a table of its own, so that copies of one text can be divided among tasks.
    first = save(named.groupBy("t").agg(F.min("doc_id").alias("first"), F.count("*").alias("times")).where("times > 1").select("t", "first"))
    copies = named.join(first, "t").where("doc_id > first")
    gone = copies.withColumn("tokenizer_version", F.explode(F.array(F.lit("words-1"), F.lit("subwords-1"))))
    rollup.commit("3-delete", gone.select("doc_id", "source", "lang", "tokenizer_version", F.lit(0).cast("long").alias("n_tokens"), F.lit("delete").alias("op")))
    return rollup.totals()
