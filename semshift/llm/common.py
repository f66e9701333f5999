"""What the operators share: shared-folder tables, gapless global ranks, words."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of anything but ASCII white space. bytes.split() splits at just these.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    # batches of whole texts to Python workers stay small, whatever the texts' lengths
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as spark.checkpoint.dir names it; where it is unset, a folder of our own on a local master, an error on a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        found = "file://" + (own := tempfile.mkdtemp(prefix="semshift-"))
        atexit.register(shutil.rmtree, own, True)
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes df as a table in the shared folder and reads it back: lineage ends here, and a lost executor loses nothing."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_path = path
    return out


def forget(*tables: DataFrame) -> None:
    """Deletes stored tables that nothing will read any more."""
    for t in tables:
        sc = t.sparkSession.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(t.stored_path)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def one(df: DataFrame) -> tuple:
    return tuple(df.collect()[0])


def ranked(df: DataFrame, order: list[Column | str], name: str, within: list[str] | None = None, rank: str = "rank") -> DataFrame:
    """df as a stored table with a gapless rank from 0 in the given total order, within groups that lead that order.

    A range-partitioned sort, then each row's place in its partition plus what stands before the partition. Only one
    count for each partition and group that begins or ends in it goes to a small join; no group meets in one task.
    """
    within = within or []
    at, pid = f"__at_{rank}", f"__pid_{rank}"
    s = df.repartitionByRange(*order).sortWithinPartitions(*order)
    s = s.withColumns({pid: F.spark_partition_id(), at: F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))})
    s = stored(s, name)
    keys = s.groupBy(pid, *within).agg(F.min(at).alias("__first"), F.count(F.lit(1)).alias("__n"))
    # a table of a row for each partition (and group in it); sums over what came before, by group
    by = {"__n": F.col("__n")}
    from pyspark.sql import Window

    w = Window.partitionBy(*within) if within else Window.partitionBy(F.lit(0))
    keys = keys.select(pid, *within, "__first", *by).withColumn("__base", F.coalesce(F.sum("__n").over(w.orderBy(pid).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) - F.col("__first"))
    cond = [F.col(f"s.{pid}") == F.col(f"k.{pid}")] + [F.col(f"s.{c}").eqNullSafe(F.col(f"k.{c}")) for c in within]
    j = s.alias("s").join(keys.drop("__first", "__n").alias("k"), cond)
    return j.select(*[F.col(f"s.{c}") for c in df.columns], (F.col(f"s.{at}") + F.col("k.__base")).alias(rank))


def columns_free(df: DataFrame, *names: str) -> DataFrame:
    """df with any column that clashes (whatever its case) with a name an operator adds moved aside to name_in."""
    taken = {c.lower() for c in df.columns}
    for n in names:
        for c in [c for c in df.columns if c.lower() == n.lower()]:
            new = f"{c}_in"
            while new.lower() in taken:
                new += "_in"
            taken.add(new.lower())
            df = df.withColumnRenamed(c, new)
    return df
