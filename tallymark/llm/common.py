"""Shared pieces: scratch tables in the shared folder, connected components, tokenisation."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Java / RE2 / Python form of one word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Edges that a task of ``connected_components`` writes, and tasks at least.
ROWS, TASKS = 200_000, 12


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One table of a data directory; the path may be in any store that Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where the session names none (tests on one machine) is a folder of this machine used.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if spark.sparkContext.master.startswith("local"):
            named = f"{tempfile.gettempdir()}/tallymark-scratch"
        else:
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return named.rstrip("/")


def save(df: DataFrame) -> DataFrame:
    """Write ``df`` to a table in the shared folder and read it back: lineage ends here.

    Unlike a local checkpoint, the rows outlive any executor.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{uuid.uuid4().hex}.parquet"
    df.write.parquet(path)
    kept = spark.read.schema(df.schema).parquet(path)
    kept._scratch = path
    return kept


def drop(df: DataFrame) -> None:
    """Delete the table behind a frame that ``save`` returned."""
    spark = df.sparkSession
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df._scratch)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def unused(df: DataFrame, *wanted: str) -> list[str]:
    """Names like the wanted ones that no column of ``df`` has, in any case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, component) for every end of ``edges`` (a, b): component is the smallest reachable id.

    Large-star / small-star rounds. A round shuffles each edge a fixed number of times; the number of
    rounds grows with the logarithm of the longest path. Each round is written to the shared folder, so
    that lineage stays short and a lost executor costs one round. The minima are tables of their own: a join
    with them is a plain one, whose large keys (the centre of a star) Spark divides among tasks. Tables are written
    by as many tasks as there are edges for (``ROWS``), ``TASKS`` at least, so that few edges are not spread over a file for each
    partition of the shuffle. Nothing is gathered on the driver but one count and checksum per round. Edges with
    a null end and loops are ignored; repeated edges count once; no edges give no rows.
    """
    now = save(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    n, seen = now.count(), None

    def put(df: DataFrame) -> DataFrame:
        return save(df.coalesce(max(TASKS, -(-2 * n // ROWS))))  # a table has an edge in two directions at most

    while n:
        both = now.select("u", "v").union(now.select(F.col("v"), F.col("u")))
        low = put(both.groupBy("u").agg(F.min("v").alias("m")))
        # A node without a smaller neighbour is the least of its star and hands itself on.
        large = put(both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct())
        small = put(large.groupBy("u").agg(F.min("v").alias("m")))
        stars = large.join(small, "u")
        nxt = put(stars.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small).where("u <> v").distinct())
        mark = nxt.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        for table in (now, low, large, small):
            drop(table)
        now = nxt
        if tuple(mark) == seen:
            break
        seen, n = tuple(mark), mark[0]
    # Converged: each node other than a root has one edge, to its root.
    roots = now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).union(roots)


def union_all(frames: list[DataFrame]) -> DataFrame:
    """Union by name of one or more frames."""
    return reduce(lambda a, b: a.unionByName(b), frames)
