"""What differs between two trees of files: hash trees over paths and pieces of content, compared from the root down.

A file's digest is that of its pieces' digests, so a change is known by piece. A folder's digest is a sum of hashes of all files
below it, in three lanes of 64 bits: it needs no order and no list, so a folder of any number of files is added up
in parts, before anything is shuffled. Trees are tables in folders by depth; the comparison reads a level at a time, and of
that the children of folders that differ.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import dropped, written

#: Bytes of a piece.
PIECE = 1 << 20
LANES = 3


def tree(files: DataFrame, piece: int = PIECE) -> DataFrame:
    """(path, parent, depth, folder, digest, pieces): a table of all files and folders of ``files`` (path, content).

    ``content`` is binary. Paths are relative, their parts are parted by ``/``; empty parts (``//``, a leading or trailing ``/``) are left out, and
    what is left must tell files apart: rows of one path count as one file with the largest digest. The root is the folder with the empty path.
    A null content is an empty one; null paths are left out. No files give no rows, not even a root.
    """
    parts = F.filter(F.split("path", "/"), lambda x: x != "")
    size = F.ceil(F.coalesce(F.octet_length("content"), F.lit(0)) / piece).cast("int")
    cut = F.transform(F.sequence(F.lit(0), size - 1), lambda i: F.sha2(F.substring("content", i * piece + 1, F.lit(piece)), 256))
    rows = files.select(parts.alias("parts"), F.when(size > 0, cut).otherwise(F.array().cast("array<string>")).alias("pieces")).where("size(parts) > 0")
    path = F.array_join("parts", "/")
    leaves = rows.select(path.alias("path"), "parts", F.sha2(F.array_join("pieces", ","), 256).alias("digest"), "pieces")
    leaves = leaves.groupBy("path").agg(F.max_by(F.struct("parts", "digest", "pieces"), "digest").alias("x")).select("path", "x.*")
    up = lambda n: F.array_join(F.slice("parts", 1, n), "/")
    depth = F.size("parts")
    kept = written(leaves.select("path", up(depth - 1).alias("parent"), depth.alias("depth"), F.lit(False).alias("folder"), "digest", "pieces"))
    parts = F.split("path", "/")
    above = kept.select(F.explode(F.transform(F.sequence(F.lit(0), F.col("depth") - 1), lambda n: F.struct(n.alias("depth"), F.array_join(F.slice(parts, 1, n), "/").alias("path"), F.when(n > 0, F.array_join(F.slice(parts, 1, n - 1), "/")).alias("parent")))).alias("f"), *[F.xxhash64(F.lit(k), "path", "digest").cast("decimal(38,0)").alias(f"h{k}") for k in range(LANES)])
    sums = above.groupBy("f.path", "f.parent", "f.depth").agg(F.count("*").alias("n"), *[F.sum(f"h{k}").alias(f"h{k}") for k in range(LANES)])
    folders = sums.select("path", "parent", "depth", F.lit(True).alias("folder"), F.concat_ws(" ", "n", *[f"h{k}" for k in range(LANES)]).alias("digest"), F.lit(None).cast("array<string>").alias("pieces"))
    out = written(kept.unionByName(folders), "depth")
    dropped(kept)
    return out


def differences(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """(path, status, pieces) of files that differ: ``added`` (theirs alone), ``lost`` (ours alone) or ``changed``, with the numbers of the pieces that are
    not the same in both (null unless changed).

    Trees are those of ``tree``. Folders with equal digests are not looked into. A path that is a file here and a folder there is a
    file lost and files added.
    """
    levels, depth, open_ = [], 0, None
    while True:
        own = [t.where(F.col("depth") == depth).select(F.col("path").alias(f"{s}_path"), F.col("parent").alias(f"{s}_parent"), F.col("folder").alias(f"{s}_folder"), F.col("digest").alias(s), F.col("pieces").alias(f"{s}_pieces")) for s, t in (("a", ours), ("b", theirs))]
        if open_ is not None:
            own = [t.join(open_.select(F.col("path").alias("_p")), F.col(f"{s}_parent") == F.col("_p"), "left_semi") for s, t in zip("ab", own, strict=True)]
        both = own[0].join(own[1], (F.col("a_path") == F.col("b_path")) & (F.col("a_folder") == F.col("b_folder")), "full_outer").where(~F.col("a").eqNullSafe(F.col("b")))
        level = written(both.select(F.coalesce("a_path", "b_path").alias("path"), F.coalesce("a_folder", "b_folder").alias("folder"), "a", "b", "a_pieces", "b_pieces"))
        levels.append(level)
        open_ = level.where("folder")
        if open_.isEmpty():
            break
        depth += 1
    found = reduce(DataFrame.union, [t.where("not folder") for t in levels])
    status = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "lost").otherwise("changed")
    numbers = F.sequence(F.lit(0), F.greatest(F.size("a_pieces"), F.size("b_pieces")) - 1)
    other = F.filter(numbers, lambda i: ~F.get("a_pieces", i).eqNullSafe(F.get("b_pieces", i)))
    out = written(found.select("path", status.alias("status"), F.when(status == "changed", other).alias("pieces")))
    for level in levels:
        dropped(level)
    return out


def compare_folders(spark: SparkSession, here: str, there: str, piece: int = PIECE) -> DataFrame:
    """``differences`` of all files below two folders, in any stores that Spark reads. A missing folder is Spark's own error."""

    def read(folder: str) -> DataFrame:
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        root = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(hadoop).toString().rstrip("/")
        rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
        # file:/x and file:///x are the same place.
        bare = lambda c: F.regexp_replace(c, "^([a-zA-Z][a-zA-Z0-9+.-]*):/+", "$1:/")
        return rows.select(F.substring(bare(F.col("path")), F.length(bare(F.lit(root))) + 2, F.length("path")).alias("path"), "content")

    a, b = tree(read(here), piece), tree(read(there), piece)
    out = differences(a, b)
    dropped(a)
    dropped(b)
    return out
