"""From raw documents to tokens: five stages, each calling one operator of semshift.llm.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. Stages
are stored as Parquet in the shared folder and read again, so a lost executor never sets the pipeline back by more than
the stage it is in. Hashes and fitted models are beyond SQL, so there is no oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from semshift.llm import mixing, pieces, simhash, substring, toxicity
from semshift.llm.common import stored, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the class-conditional models score 0.7 or more go.

    A null text is scored as an empty one and stays as it is; rows with null or repeated doc_ids are scored like any other,
    each by its own text, and equal rows fare alike. Without labels every score is 0.5 and all stay. No rows give none.
    """
    ratios, curve = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, ratios, curve, keep=COLUMNS, text="text").where(F.col("__score") < 0.7).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity 0.8) one row stays, with the smallest doc_id.

    Null, empty and blank texts are copies of each other. Rows with null or repeated doc_ids are rows of their own: an id comes
    before null, and of rows that tie the first one stays. No rows give none.
    """
    return simhash.near_copies(docs, 5, 0.8, keep=("text", "lang", "source", "n_chars")).where("stays").select(*COLUMNS)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in windows of 50 that a document with a smaller doc_id has too go; every row stays, with what is left of its text.

    A null text becomes an empty one. Rows without a doc_id lose nothing; rows that repeat a doc_id count as one document, each
    by its own text. A text that loses nothing keeps its white space. No rows give none.
    """
    out = substring.remove_repeats(docs.select("doc_id", "text", "lang", "source"), 50)
    return out.select("doc_id", F.col("__kept").cast("string").alias("text"), "lang", "source").withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated, or left out, so that sources take their target shares of words.

    A null source is a source of its own, the last. Rows are copied with all their columns, so null and repeated doc_ids stay
    what they are; equal rows share their copies in sum. Rows without words count nothing and get about one copy. No rows give none.
    """
    taken = mixing.mix(docs, keep=("text", "lang", "n_chars")).where(F.col("copies") > 0)
    return taken.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*COLUMNS)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, with the proof that they decode to it. A null text has none. A row for each row, whatever its doc_id."""
    import public_tokenizers

    return pieces.encode(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near-duplicates", drop_near_copies),
    ("substring-dedup", cut_repeats),
    ("mixing", mix_sources),
    ("tokens", tokenize),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
