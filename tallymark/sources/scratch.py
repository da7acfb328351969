"""Tables that cut the lineage of iterative operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names, which driver and executors share.

    Where a session on one machine names no folder, one of that machine is used.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = f"{tempfile.gettempdir()}/tallymark-tables"
    return folder.rstrip("/")


def written(df: DataFrame, *by: str) -> DataFrame:
    """``df`` as a table in the scratch folder, in folders ``by`` some columns; its rows outlive any executor."""
    spark = df.sparkSession
    path = f"{scratch_folder(spark)}/{uuid.uuid4().hex}.parquet"
    (df.write.partitionBy(*by) if by else df.write).parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._scratch = path
    return table


def dropped(table: DataFrame) -> None:
    """Delete a table that ``written`` returned, once nothing reads it any more."""
    spark = table.sparkSession
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(table._scratch)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
