"""A recording that can be cut off and taken up again: a sink for batches of answers, from a stream or by hand.

Executors write a batch to a folder of its own; the batch counts once a small entry of a numbered log names that folder. A
number is given once, by a rename, so of two writers of a batch one wins, and an attempt that was cut off has no
entry and is never read. A batch that the log holds is not written again. Of several answers to an id the last one
counts: in a later batch, or later within one.

``compact`` puts the last answers in place of all batches before, and ranges of batch numbers in place of their
names, so neither the log nor what is read grows with the number of batches ever written.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter

from ..operators.recorded import last_of_each, pending_rows
from ..sources.files import RECORDED

#: What is kept of an answer unless a recorder is given other columns.
ANSWER = T.StructType([T.StructField("system", T.StringType()), *RECORDED.fields])
#: Entries of the log since the last compaction, above which ``write`` compacts.
LONGEST_LOG = 200


def _with(ranges: list[list[int]], n: int) -> list[list[int]]:
    """Sorted ranges of whole numbers, first and last, with one more number."""
    out: list[list[int]] = []
    for lo, hi in sorted([*ranges, [n, n]]):
        if out and lo <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return out


class Recorder:
    """Answers in a folder that driver and executors share; any number of writers and readers."""

    def __init__(self, spark: SparkSession, folder: str, schema: T.StructType = ANSWER, by: tuple[str, ...] = ("system", "id"), longest: int = LONGEST_LOG):
        self.spark, self.folder, self.schema, self.by, self.longest = spark, folder.rstrip("/"), schema, by, longest
        self._hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        self._fs = self._hadoop.Path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._stored = T.StructType([*schema.fields, T.StructField("_seq", T.LongType()), T.StructField("_attempt", T.StringType())])

    # ---- the log: {source, batch, attempt}, or {base, done: ranges by source, attempt} ---------------------------

    def _path(self, *parts: str):
        return self._hadoop.Path("/".join([self.folder, *parts]))

    def _names(self, *folder: str) -> list[str]:
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(*folder))) if self._fs.exists(self._path(*folder)) else []

    def _log(self) -> list[tuple[int, dict]]:
        """(number, entry) from the last base on."""
        out: list[tuple[int, dict]] = []
        for name in reversed([n for n in self._names("log") if n.isdigit()]):
            stream = self._fs.open(self._path("log", name))
            entry = json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
            stream.close()
            out.insert(0, (int(name), entry))
            if entry.get("base"):
                break
        return out

    def _enter(self, number: int, entry: dict) -> bool:
        """Create entry ``number`` whole; False if another writer was first."""
        own, place = self._path("log", f"_{uuid.uuid4().hex}"), self._path("log", f"{number:012d}")
        stream = self._fs.create(own, False)
        stream.write(bytearray(json.dumps(entry).encode()))
        stream.close()
        try:
            # A rename to a name that is there fails; local files are renamed over, so these are checked first.
            return not self._fs.exists(place) and self._fs.rename(own, place)
        finally:
            self._fs.delete(own, False)

    @staticmethod
    def _done(log: list[tuple[int, dict]]) -> dict[str, list[list[int]]]:
        done: dict[str, list[list[int]]] = {}
        for _, e in log:
            if e.get("base"):
                done = {k: [list(r) for r in v] for k, v in e["done"].items()}
            else:
                done[e["source"]] = _with(done.get(e["source"], []), e["batch"])
        return done

    def committed(self, batch: int, source: str = "stream") -> bool:
        """Whether a batch counts already."""
        return any(lo <= batch <= hi for lo, hi in self._done(self._log()).get(source, []))

    # ---- writing -------------------------------------------------------------------------------------------------

    def stage(self, answers: DataFrame, order: Column | None = None) -> str:
        """Write answers where nobody reads them yet; the name of the attempt. ``order``: which of a batch's answers is later."""
        attempt = uuid.uuid4().hex
        seq = F.monotonically_increasing_id() if order is None else order.cast("long")
        have = {c.lower(): c for c in answers.columns}
        columns = [(F.col(f"`{have[f.name.lower()]}`") if f.name.lower() in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in self.schema.fields]
        answers.select(*columns, seq.alias("_seq"), F.lit(attempt).alias("_attempt")).write.parquet(f"{self.folder}/attempts/{attempt}")
        return attempt

    def commit(self, attempt: str, batch: int, source: str = "stream") -> bool:
        """Make an attempt count; False if the batch did already (and then this attempt never does)."""
        while True:
            log = self._log()
            if any(lo <= batch <= hi for lo, hi in self._done(log).get(source, [])):
                return False
            if self._enter(log[-1][0] + 1 if log else 0, {"source": source, "batch": batch, "attempt": attempt}):
                return True

    def write(self, answers: DataFrame, batch: int, source: str = "stream", order: Column | None = None) -> bool:
        """Record a batch, unless it is recorded: True if this call did. Fit for ``foreachBatch``."""
        if self.committed(batch, source):
            return False
        written = self.commit(self.stage(answers, order), batch, source)
        if len(self._log()) > self.longest:
            self.compact()
        return written

    def sink(self, answers: DataFrame, checkpoint: str, source: str = "stream", order: Column | None = None) -> DataStreamWriter:
        """A writer of a stream of answers, to be started. After a crash the stream sends its last batch again; it counts once."""
        return answers.writeStream.foreachBatch(lambda df, n: self.write(df, n, source, order)).option("checkpointLocation", checkpoint)

    def compact(self) -> bool:
        """Put the last answers in place of all batches so far; False if a writer came in between."""
        log = self._log()
        if len(log) < 2:
            return False
        attempt = self.stage(self._last(log).drop("_at"), F.lit(0))  # one answer an id
        return self._enter(log[-1][0] + 1, {"base": True, "done": self._done(log), "attempt": attempt})

    def sweep(self, older_than_s: float = 86_400) -> int:
        """Delete attempts that the log no longer names, or never did, and that are old enough to have been given up; how many."""
        log = self._log()
        named, gone = {e["attempt"] for _, e in log}, 0
        for name in self._names("attempts"):
            place = self._path("attempts", name)
            if name not in named and time.time() - self._fs.getFileStatus(place).getModificationTime() / 1000 >= older_than_s:
                gone += bool(self._fs.delete(place, True))
        for name in self._names("log"):
            if name.isdigit() and log and int(name) < log[0][0]:
                self._fs.delete(self._path("log", name), False)
        return gone

    # ---- reading -------------------------------------------------------------------------------------------------

    def _rows(self, log: list[tuple[int, dict]]) -> DataFrame:
        if not log:
            return self.spark.createDataFrame([], T.StructType([*self.schema.fields, T.StructField("_at", T.StructType([T.StructField("n", T.LongType()), T.StructField("s", T.LongType())]))]))
        rows = self.spark.read.schema(self._stored).parquet(*[f"{self.folder}/attempts/{e['attempt']}" for _, e in log])
        numbers = F.create_map(*[F.lit(x) for n, e in log for x in (e["attempt"], n)])  # one entry a batch since the last compaction
        at = F.struct(F.element_at(numbers, F.col("_attempt")).cast("long").alias("n"), F.col("_seq").alias("s"))
        return rows.select(*self.schema.names, at.alias("_at"))

    def _last(self, log: list[tuple[int, dict]]) -> DataFrame:
        return last_of_each(self._rows(log), "_at", self.by)

    def answers(self) -> DataFrame:
        """All answers that count, with ``_at``, by which later ones are larger."""
        return self._rows(self._log())

    def latest(self) -> DataFrame:
        """The last answer of each id."""
        return self._last(self._log()).drop("_at")

    def pending(self, items: DataFrame, system: str, budget: int, limit: int | None = None) -> DataFrame:
        """What a recording that is taken up again has to ask: (id, reason), see ``pending_rows``."""
        return pending_rows(items, self.latest().where(F.col("system") == system), budget, limit)
