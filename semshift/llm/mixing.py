"""Mixing sources to target weights by entropy balancing, in DataFrame operations only.

The dual has one multiplier for each source. A document of size x gets the rate 2 * sigmoid(lambda * x / mean size): the
odds rate / (2 - rate) are an exponential tilt, which is what the Fermi entropy (base rate 1, no rate above 2) makes of
entropy balancing. Newton steps on the convex dual, kept inside a bracket, run on the histogram of (source, size); each
is one aggregation. Rates are rounded into copies within the histogram, then dealt to documents by hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, one, ranked, stored, table

#: Weights of the sources in code point order, repeating; their share of all sizes; the most copies of a document.
WEIGHTS, SHARE, MOST = (5, 2, 1), 1.5, 2
#: Places at which the rounding of rates may begin.
STARTS = 64
#: Rows of one (source, size) that are dealt together; more are dealt by hash into several such lots.
LOT = 8192


def word_count(text: Column) -> Column:
    """Number of words; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(hist: DataFrame, weights: tuple[int, ...], share: float) -> DataFrame:
    """source, source_size, target: weights by code point order of the source (null last), no target above MOST times its source."""
    sizes = hist.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    order = ranked(sizes, [F.col("source").isNull(), F.col("source")], "mix-sources")
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    s = stored(order.select("source", "source_size", w.alias("w"), (F.col("source_size") * float(MOST)).alias("cap")), "mix-weights")
    total = one(s.agg(F.coalesce(F.sum("source_size"), F.lit(0))))[0] * share
    level = 0.0
    while total:  # what stops at its cap gives the rest more; each round stops at least one more source
        over = F.col("w") * level > F.col("cap") if level else F.lit(False)
        capped, open_w = one(s.agg(F.sum(F.when(over, F.col("cap")).otherwise(0.0)), F.sum(F.when(over, 0.0).otherwise(F.col("w")))))
        new = (total - capped) / open_w if open_w else level
        if new <= level * (1 + 1e-15):
            break
        level = new
    return s.select("source", "source_size", F.least(F.col("w") * level, F.col("cap")).alias("target"))


def _rate(lam: str = "lam") -> Column:
    return F.lit(float(MOST)) / (1 + F.exp(-F.col(lam) * F.col("x")))


def solve(hist: DataFrame, goal: DataFrame, steps: int = 40, tolerance: float = 1e-9) -> DataFrame:
    """goal with lam, by safeguarded Newton steps; sources whose target is all they can give keep no multiplier but the rate MOST."""
    g = goal.withColumns({"lam": F.lit(0.0), "lo": F.lit(-60.0), "hi": F.lit(60.0)})
    g = stored(g.join(hist.groupBy("source").agg((F.sum(F.col("size") * F.col("n")) / F.sum("n")).alias("mean")).withColumnRenamed("source", "s2"), F.col("source").eqNullSafe(F.col("s2"))).drop("s2"), "mix-dual")
    for _ in range(steps):
        r = _tilted(hist, g)
        sums = r.groupBy(F.col("source").alias("s2")).agg(F.sum(F.col("n") * F.col("size") * F.col("rate")).alias("got"), F.sum(F.col("n") * F.col("size") * F.col("x") * F.col("rate") * (1 - F.col("rate") / MOST)).alias("slope"))
        j = g.join(sums, F.col("source").eqNullSafe(F.col("s2"))).drop("s2")
        off = F.col("got") - F.col("target")
        lo, hi = F.when(off < 0, F.col("lam")).otherwise(F.col("lo")), F.when(off > 0, F.col("lam")).otherwise(F.col("hi"))
        step = F.col("lam") - off / F.col("slope")
        inside = (F.col("slope") > 0) & (step > lo) & (step < hi)
        g = stored(j.select("source", "source_size", "target", "mean", lo.alias("lo"), hi.alias("hi"), F.when(F.abs(off) <= tolerance * F.col("target"), F.col("lam")).when(inside, step).otherwise((lo + hi) / 2).alias("lam"), (F.abs(off) / F.greatest(F.col("target"), F.lit(1.0))).alias("off")), "mix-dual")
        if (one(g.where("target < source_size * 1.9999999 and target > 0").agg(F.max("off")))[0] or 0) <= tolerance:
            break
    return g


def _tilted(hist: DataFrame, dual: DataFrame) -> DataFrame:
    d = dual.select(F.col("source").alias("s2"), "target", "mean", "lam", F.col("source_size").alias("all"))
    x = F.col("size") / F.greatest(F.col("mean"), F.lit(1e-9))
    j = hist.join(d, F.col("source").eqNullSafe(F.col("s2"))).withColumn("x", x)
    full = F.col("target") >= F.col("all") * (MOST - 1e-7)
    return j.withColumn("rate", F.when(full, float(MOST)).when(F.col("target") <= 0, 0.0).otherwise(_rate())).drop("s2")


def copies(hist: DataFrame, dual: DataFrame) -> DataFrame:
    """source, size, n, k: whole copies of each (source, size).

    Systematic rounding of the rates in order of size, so that any run of sizes gets its sum of rates to within one copy.
    Of STARTS places to begin each source takes the one whose words come nearest its target.
    """
    upto = Window.partitionBy("source").orderBy("size").rowsBetween(Window.unboundedPreceding, 0)
    t = _tilted(hist, dual).withColumn("sum", F.round(F.sum(F.col("n") * F.col("rate")).over(upto), 6))
    t = stored(t.withColumn("before", F.coalesce(F.lag("sum").over(Window.partitionBy("source").orderBy("size")), F.lit(0.0))).select("source", "size", "n", "sum", "before", "target"), "mix-sums")
    taken = lambda u: F.floor(F.col("sum") + u) - F.floor(F.col("before") + u)
    starts = [(j + 0.5) / STARTS for j in range(STARTS)]
    off = t.groupBy("source").agg(*[F.abs(F.sum(taken(F.lit(u)) * F.col("size")) - F.first("target")).alias(f"u{j}") for j, u in enumerate(starts)])
    best = off.select(F.col("source").alias("s2"), F.array_min(F.array(*[F.struct(F.col(f"u{j}").alias("off"), F.lit(u).alias("u")) for j, u in enumerate(starts)]))["u"].alias("u"))
    j = t.join(best, F.col("source").eqNullSafe(F.col("s2")))
    return j.select("source", "size", "n", F.least(F.greatest(taken(F.col("u")), F.lit(0)), F.col("n") * MOST).cast("long").alias("k"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, text: str = "text", source: str = "source", doc_id: str = "doc_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken and the columns `keep` for every row.

    A null text has size 0 and is never repeated; a null source is a source of its own, the last. Equal rows are told
    apart by nothing, so copies among them are dealt arbitrarily but in sum alike. Empty tables give no rows.
    """
    rows = stored(docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"), F.xxhash64(F.col(doc_id), F.col(text), F.lit(17)).alias("h"), *[F.col(c).alias(f"k_{c}") for c in keep]), "mix-rows")
    hist = stored(rows.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), "mix-hist")
    goal = stored(targets(hist, weights, share), "mix-targets")
    kept = stored(copies(hist, solve(hist, goal)), "mix-copies")
    k = kept.select(F.col("source").alias("s2"), F.col("size").alias("z2"), "n", "k")
    r = rows.join(k, F.col("source").eqNullSafe(F.col("s2")) & (F.col("size") == F.col("z2"))).drop("s2", "z2")
    r = r.withColumn("lots", F.ceil(F.col("n") / LOT)).withColumn("lot", F.pmod(F.shiftright(F.col("h"), 20), F.col("lots")))
    r = r.repartition("source", "size", "lot")
    lot = Window.partitionBy("source", "size", "lot")
    extra = F.col("k") % F.col("n")
    u = F.pmod(F.xxhash64("source", "size", "lot"), F.lit(1 << 20)) / float(1 << 20)
    share_ = F.when(F.col("lots") <= 1, extra).otherwise(F.floor(F.count(F.lit(1)).over(lot) * extra / F.col("n") + u))
    r = r.withColumn("copies", (F.floor(F.col("k") / F.col("n")) + (F.row_number().over(lot.orderBy("h", "doc_id")) <= share_).cast("long")).cast("long"))
    g = goal.select(F.col("source").alias("s2"), "source_size", "target")
    out = r.join(g, F.col("source").eqNullSafe(F.col("s2")))
    return out.select("doc_id", "source", "size", "source_size", "target", F.least(F.col("copies"), F.lit(MOST)).alias("copies"), (F.col("size") * F.least(F.col("copies"), F.lit(MOST))).alias("taken"), *[F.col(f"k_{c}").alias(c) for c in keep])


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", F.col("source_size").cast("long").alias("source_size"), "target", F.col("taken").cast("long").alias("taken"))
