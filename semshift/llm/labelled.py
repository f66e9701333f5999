"""A bounded sample of labelled documents, for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    """Whether crc32 of the id as text leaves that remainder; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(folds)) == fold


#: Most bytes of text of each class in a sample; a text counts by its first SHARE-th of them.
MOST_BYTES, SHARE = 16 << 20, 64


def sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, fold: int, per_class: int, text: str = "text", doc_id: str = "doc_id", most_bytes: int = MOST_BYTES) -> DataFrame:
    """label (0 or 1), u (0 to 999, by hash of the id), t (binary text) of at most per_class documents and most_bytes bytes of each class.

    Documents are taken in order of a hash of the id while they fit. Of a text longer than most_bytes / SHARE bytes only so many
    are taken, so that no text, however long, keeps the others of its class out; SHARE documents fit whatever their lengths.

    Only rows outside the held-out fold are read. The ids with the least hashes are taken, so reruns agree. The joined
    side has at most 2 x per_class rows, which bounds the broadcast. Several labels of one id: the largest holds.
    """
    own = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), folds, fold))
    own = own.groupBy("doc_id").agg(F.max(label).alias("label"))
    h = F.xxhash64("doc_id", F.lit(5))
    picks = [own.where(F.col("label") == c).orderBy(h, "doc_id").limit(per_class) for c in (0, 1)]
    ids = picks[0].unionByName(picks[1]).select(F.col("doc_id").alias("__id"), F.col("label").cast("int").alias("label"), F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(1000)).cast("int").alias("u"))
    t = F.substring(F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary"), 1, max(1, most_bytes // SHARE))
    found = docs.select(F.col(doc_id).alias("__doc"), t.alias("t")).join(F.broadcast(ids), F.col("__doc") == F.col("__id"))
    found = found.groupBy("__id", "label", "u").agg(F.min("t").alias("t"))  # of rows that repeat an id, one
    upto = Window.partitionBy("label").orderBy(F.xxhash64("__id", F.lit(5)), "__id", F.xxhash64("t")).rowsBetween(Window.unboundedPreceding, 0)
    return found.withColumn("__all", F.sum(F.octet_length("t")).over(upto)).where(F.col("__all") <= most_bytes).select("label", "u", "t")
