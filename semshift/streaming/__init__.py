"""A folder of Turtle files as a stream into a stored graph.

The reference loads its files once and has no streams; this keeps a graph up to date as files arrive. Each file is parsed whole, as the
batch reader does; a file that doesn't parse becomes a row of `errors` and stops nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.graph import by_predicate
from ..sources.turtle import RAW, TRIPLE, _parsed

#: Folders below the graph's own.
TRIPLES, ERRORS = "triples", "errors"


def stream_turtle(spark: SparkSession, folder: str, pattern: str = "*.ttl", files_per_batch: int = 1000) -> DataFrame:
    """Rows as the batch reader has them, of every file that is there or comes. Files are taken whole and once, oldest first."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary")
    files = files.option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_per_batch).load(folder)
    return files.select("path", "content").mapInArrow(_parsed, RAW)


def add_triples(batch: DataFrame, batch_id: int, path: str, run: str = "0") -> None:
    """Adds a batch's triples to the stored graph as a set: those that it holds already are left out.

    Each batch writes a folder of its own, named by its stream (`run`) and number, so a batch that runs again after a failure overwrites
    what it left behind, and a stream with a new checkpoint leaves alone what others have stored. Only the predicates that the batch names are read for comparison.
    """
    spark = batch.sparkSession
    label = f"{run}-{batch_id}"
    batch = batch.persist()
    try:
        new = by_predicate(batch.where("s is not null").select(*TRIPLE).dropDuplicates())
        names = [r[0] for r in new.select("name").distinct().collect()]  # a vocabulary's predicates
        try:
            old = read_graph(spark, path).where(F.col("batch") != label)
        except Exception as e:  # no batch has been written yet
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
        else:
            old = old.where(F.col("name").isin(names)).alias("old")
            same = [F.col(f"new.{c}").eqNullSafe(F.col(f"old.{c}")) for c in (*TRIPLE, "name")]
            new = new.alias("new").join(old, same, "left_anti")
        new.write.mode("overwrite").partitionBy("name").parquet(f"{path}/{TRIPLES}/batch={label}")
        batch.where("error is not null").select("file", "error").write.mode("overwrite").json(f"{path}/{ERRORS}/batch={label}")
    finally:
        batch.unpersist()


def read_graph(spark: SparkSession, path: str) -> DataFrame:
    """The triples stored so far, with their predicates' local names and the batches they came in."""
    return spark.read.option("basePath", f"{path}/{TRIPLES}").parquet(f"{path}/{TRIPLES}")


def run_of(spark: SparkSession, checkpoint: str) -> str:
    """What a checkpoint folder calls its stream, from its first start on."""
    return spark.read.json(f"{checkpoint}/metadata").first()["id"]


def keep_graph(spark: SparkSession, folder: str, path: str, checkpoint: str, once: bool = False, **kw) -> StreamingQuery:
    """Starts the stream from a folder of Turtle into the graph stored at `path`; with `once` it takes what is there and ends."""
    w = stream_turtle(spark, folder, **kw).writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda batch, i: add_triples(batch, i, path, run_of(batch.sparkSession, checkpoint)))
    return (w.trigger(availableNow=True) if once else w).start()
