"""Joins that filters make: equality filters as keys, ranges as a join of points with intervals by level and block.

An interval lies in one or two blocks of the least power of two that is at least twice its width; its level is that power. A point lies
in one block of each level that some interval has. Points and intervals meet on level and block, every pair once.
Numbers are doubles here and bounds are widened by rounding's reach, so what meets is a superset: the filter itself decides.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Sides that a comparison may be turned round on: sign -> the sign with sides swapped.
SWAPPED = {"=": "=", "<": ">", ">": "<", "<=": ">=", ">=": "<="}
#: Levels below this share it: blocks of 2^-10.
LEAST = -10


def variables(x) -> set[str]:
    """Names that a pattern, a path, an expression or a list of them mentions; of a subquery those that it projects."""
    if isinstance(x, (tuple, list)):
        if len(x) == 2 and x[0] == "var":
            return {x[1]}
        if len(x) == 2 and x[0] == "select":
            return {n for n, _ in x[1].items} or variables(x[1].where)
        names = {x[2]} if len(x) == 3 and x[0] == "bind" else set(x[1]) if len(x) == 3 and x[0] == "values" else set()
        return names.union(*[variables(y) for y in x]) if x else names
    return set()


def conjuncts(e: tuple) -> list[tuple]:
    return [*conjuncts(e[2][0]), *conjuncts(e[2][1])] if e[0] == "op" and e[1] == "&&" else [e]


def has_exists(x) -> bool:
    return isinstance(x, (tuple, list)) and (bool(x) and x[0] == "exists" or any(has_exists(y) for y in x))


def linked(e: tuple, left: set[str], right: set[str]) -> tuple[str, tuple, tuple] | None:
    """(sign, expression over left, expression over right) of a comparison whose sides take their variables from one side each."""
    if e[0] != "op" or e[1] not in SWAPPED:
        return None
    x, y = e[2]
    vx, vy = variables(x), variables(y)
    if vx and vy and vx <= left and vy <= right:
        return e[1], x, y
    if vx and vy and vx <= right and vy <= left:
        return SWAPPED[e[1]], y, x
    return None


@dataclass(frozen=True)
class Bound:
    """of <= value (upper) or of >= value: `of` over one side, `value` over the other one (or constant)."""

    of: tuple
    upper: bool
    value: tuple


def bounds(e: tuple, points: set[str], others: set[str]) -> list[Bound]:
    """What a comparison says about an expression over `points`: the other side may be a sum or difference with it, or |p - q| <= d."""
    if e[0] != "op" or e[1] not in ("<", ">", "<=", ">="):
        return []
    low, high = e[2] if e[1] in ("<", "<=") else reversed(e[2])  # low <= high
    inside = lambda x: bool(variables(x)) and variables(x) <= points
    beyond = lambda x: variables(x) <= others
    out = []
    if inside(low) and beyond(high):
        out.append(Bound(low, True, high))
    if inside(high) and beyond(low):
        out.append(Bound(high, False, low))
    op = lambda sign, x, y: ("op", sign, [x, y])
    for side, other, upper in ((low, high, True), (high, low, False)):
        if not beyond(other):
            continue
        if side[0] == "op" and side[1] in "+-" and len(side[2]) == 2:
            p, q = side[2]
            if inside(p) and beyond(q):
                out.append(Bound(p, upper, op("-" if side[1] == "+" else "+", other, q)))
            elif inside(q) and beyond(p):
                out.append(Bound(q, upper, op("-", other, p)) if side[1] == "+" else Bound(q, not upper, op("-", p, other)))
        if upper and side[0] == "call" and side[1] == "ABS" and side[2][0][:2] == ("op", "-") and len(side[2][0][2]) == 2:
            p, q = side[2][0][2]
            if inside(q) and beyond(p):
                p, q = q, p
            if inside(p) and beyond(q):
                out += [Bound(p, True, op("+", q, other)), Bound(p, False, op("-", q, other))]
    return out


def band_join(points: DataFrame, at: Column, intervals: DataFrame, low: Column, high: Column) -> DataFrame:
    """Rows of both whose point lies in the interval, and some more. Nulls, NaN and empty intervals meet nothing."""
    top = F.lit(1e300)
    finite = lambda c: F.when(~F.isnan(c), F.greatest(F.least(c, top), -top))
    reach = F.lit(1e-9) * (F.abs(finite(low)) + F.abs(finite(high)) + 1)
    i = intervals.withColumns({"__low": finite(low) - reach, "__high": finite(high) + reach}).where("__low <= __high")
    level = F.greatest(F.lit(LEAST), F.ceil(F.log2(F.col("__high") - F.col("__low"))).cast("int") + 1)
    i = i.withColumn("__level", level)
    block = lambda x, k: F.floor(x / F.pow(F.lit(2.0), k))
    used = i.select("__level").distinct().agg(F.sort_array(F.collect_set("__level")).alias("l"))  # one row of some hundred levels at most
    i = i.withColumn("__block", F.explode(F.array_distinct(F.array(block(F.col("__low"), F.col("__level")), block(F.col("__high"), F.col("__level"))))))
    p = points.withColumn("__at", finite(at)).where("__at is not null").withColumn("__plevel", F.explode(used.scalar()))
    p = p.withColumn("__pblock", block(F.col("__at"), F.col("__plevel")))
    j = p.join(i, (F.col("__plevel") == F.col("__level")) & (F.col("__pblock") == F.col("__block")))
    return j.where("__at between __low and __high").drop("__at", "__plevel", "__pblock", "__low", "__high", "__level", "__block")
