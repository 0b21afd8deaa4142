"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or in local mode (tests) a temporary one."""
    sc = spark.sparkContext
    found = sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir")
    if found is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        own = tempfile.mkdtemp(prefix="sparkveil-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        found = f"file://{own}"
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(found)
    return found


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder that is no longer read."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame) -> DataFrame:
    """Compute df once into the shared folder, so that neither a lost executor nor a second use computes it again."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def crc32_text(column):
    """Unsigned CRC-32 of a value's text in UTF-8."""
    return F.crc32(column.cast("string").cast("binary"))


def number_rows(df: DataFrame, order: list[str], name: str) -> tuple[DataFrame, int]:
    """Add `name`: the gapless global row number from 0 in the given order; and the number of rows.

    Rows are dealt by range of `order` and then of their place in the input, so that one value that holds a
    third of the rows is still cut into many ranges. Only one count per range leaves its task. Give narrow rows.
    """
    spark = df.sparkSession
    placed = cut(df.withColumn("_place", F.monotonically_increasing_id()))
    dealt = placed.repartitionByRange(*[F.col(c).asc_nulls_first() for c in order], F.col("_place"))
    dealt = dealt.sortWithinPartitions(*[F.col(c).asc_nulls_first() for c in order], F.col("_place"))
    out, total = start_rows(cut(dealt.withColumn("_at", F.monotonically_increasing_id())), name)
    return out.drop("_place"), total


def start_rows(numbered: DataFrame, name: str) -> tuple[DataFrame, int]:
    """Turn `_at`, a monotonically increasing id in a table that was cut, into the gapless number `name`; and the number of rows."""
    part, within = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    counts = sorted((r["p"], r["n"]) for r in numbered.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect())
    rows, total = [], 0
    for p, n in counts:  # one row per partition
        rows.append((p, total))
        total += n
    starts = numbered.sparkSession.createDataFrame(rows, "_part long, _start long")
    out = numbered.withColumn("_part", part).join(F.broadcast(starts), "_part")
    return out.withColumn(name, F.col("_start") + within).drop("_part", "_start", "_at"), total
