"""SPARQL trees to DataFrames over a table of triples.

A solution is a row with a column for each variable: a struct of kind ('iri', 'blank', 'literal'), value, lang, datatype,
null where the variable is unbound. Patterns become selections, joins on shared variables, outer and anti joins, so Catalyst plans them;
errors in expressions are nulls, and a null filter drops its row, as SPARQL has it. No Python runs on the data.

EXISTS is evaluated for each distinct set of outer bindings at once: what it mentions of them goes into its group as a table of
bindings, which every nested group joins as well, so their filters see outer variables; what comes out is joined back. Patterns that
share no variable are joined by filters between them: equality gives keys, ranges give intervals; one-sided comparisons within
EXISTS need no more than the extremes.

Literals are compared by value and language whatever their data types (numbers as numbers); with strict=True, literals of
data types that SPARQL has no equality for make `=` and `!=` errors unless they are the same term.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .linking import band_join, bounds, conjuncts, has_exists, linked, variables
from .parser import RDF, XSD, Query, SparqlError, parse

#: The data types of numbers, of whole numbers.
WHOLE = tuple(XSD + t for t in ("integer", "int", "long", "short", "byte", "nonNegativeInteger", "positiveInteger", "unsignedInt"))
NUMERIC = (XSD + "decimal", XSD + "double", XSD + "float", *WHOLE)
#: How many times as many pairs as edges are worth squaring.
FANNED = 4
TERM = "struct<kind:string,value:string,lang:string,datatype:string>"


def term(kind, value, lang="", datatype="") -> Column:
    as_column = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(as_column(kind).alias("kind"), as_column(value).alias("value"), as_column(lang).alias("lang"), as_column(datatype).alias("datatype"))


@dataclass(frozen=True)
class Value:
    """A compiled expression. kind: 'term', 'int', 'num', 'bool' or 'str'."""

    kind: str
    col: Column

    def term(self) -> Column:
        if self.kind == "term":
            return self.col
        text = _shown(self.col) if self.kind == "num" else self.col.cast("string")
        named = {"int": XSD + "integer", "num": XSD + "decimal", "bool": XSD + "boolean", "str": XSD + "string"}[self.kind]
        return F.when(self.col.isNotNull(), term("literal", text, "", named))

    def text(self) -> Column:
        return self.col["value"] if self.kind == "term" else _shown(self.col) if self.kind == "num" else self.col.cast("string")

    def num(self) -> Column:
        if self.kind == "term":
            return F.when(self.col["datatype"].isin(*NUMERIC), self.col["value"].try_cast("double"))
        return self.col if self.kind in ("int", "num") else F.lit(None).cast("double")

    def truth(self) -> Column:
        if self.kind == "bool":
            return self.col
        if self.kind in ("int", "num"):
            return self.col != 0
        if self.kind == "str":
            return F.length(self.col) > 0
        d = self.col["datatype"]
        plain = (self.col["kind"] == "literal") & d.isin(XSD + "string", RDF + "langString")
        return F.when(d == XSD + "boolean", self.col["value"].isin("true", "1")).when(d.isin(*NUMERIC), F.coalesce(self.num() != 0, F.lit(False))).when(plain, F.length(self.col["value"]) > 0)


def _shown(number: Column) -> Column:
    """A number's text: without a fraction where there is none."""
    return F.when((number == F.floor(number)) & (F.abs(number) < 1e15), number.cast("long").cast("string")).otherwise(number.cast("string"))


def _part(text: Column, start: Column, length: Column | None = None) -> Column:
    """Characters from start on (the first one is 1) and before start + length, those of them that there are."""
    first = F.greatest(start, F.lit(1))
    rest = F.substr(text, first)
    return rest if length is None else F.when(start + length > first, F.substr(text, first, start + length - first)).when(text.isNotNull() & start.isNotNull() & length.isNotNull(), "")


def _order(t: Column) -> Column:
    """A key that sorts terms: unbound (null), blank nodes, IRIs, literals; numbers by value."""
    rank = F.when(t["kind"] == "blank", 0).when(t["kind"] == "iri", 1).otherwise(2)
    return F.when(t.isNotNull(), F.struct(rank, F.when(t["datatype"].isin(*NUMERIC), t["value"].try_cast("double")), t["value"], t["lang"]))


@dataclass(frozen=True)
class Rows:
    """Solutions: a DataFrame with a column for each name; those in `sure` are bound in every row."""

    df: DataFrame
    names: tuple[str, ...]
    sure: frozenset[str]


class Compiler:
    def __init__(self, triples: DataFrame, strict: bool = False, products: bool = False) -> None:
        """triples: s, p, o, kind, lang, datatype, and name (p's local name) if the table is partitioned by it.

        Patterns that share no variable are refused, as they make a product, unless `products` allows them.
        """
        self.triples, self.strict, self.products = triples, strict, products
        self.spark = triples.sparkSession
        self.made = 0

    def fresh(self, what: str) -> str:
        self.made += 1
        return f"__{what}{self.made}"

    # triple patterns and paths

    def scan(self, p: str | None) -> DataFrame:
        t = self.triples
        if p is not None:
            t = t.where(F.col("p") == p)
            if "name" in t.columns:  # prunes the partitions of a stored graph
                t = t.where(F.col("name") == p.rsplit("/", 1)[-1].rsplit("#", 1)[-1])
        return t

    @staticmethod
    def subject() -> Column:
        return term(F.when(F.col("s").startswith("_:"), "blank").otherwise("iri"), F.col("s"))

    @staticmethod
    def object(of: str = "") -> Column:
        o, kind, lang, datatype = (F.col(f"__{c}{of}" if of else c) for c in ("o", "kind", "lang", "datatype"))
        return term(kind, o, F.coalesce(lang, F.lit("")), F.coalesce(datatype, F.when(kind == "literal", XSD + "string"), F.lit("")))

    @staticmethod
    def is_term(t: tuple) -> Column:
        """Whether the triple's object is that term."""
        c = (F.col("o") == t[2]) & (F.col("kind") == t[1])
        if t[1] == "literal":
            c &= F.coalesce("lang", F.lit("")) == t[3]
            c &= F.coalesce("datatype", F.lit(XSD + "string")) == t[4]
        return c

    def triple(self, s: tuple, p: tuple, o: tuple) -> Rows:
        if p[0] not in ("iri", "var"):
            return self.along(s, p, o)
        t = self.scan(p[1] if p[0] == "iri" else None)
        if s[0] == "term":
            t = t.where(F.col("s") == s[2])
        if o[0] == "term":
            t = t.where(self.is_term(o))
        cols: dict[str, Column] = {}
        for x, c in ((s, self.subject()), (p, term("iri", F.col("p"))), (o, self.object())):
            if x[0] == "var":
                if x[1] in cols:
                    t = t.where(cols[x[1]] == c)
                else:
                    cols[x[1]] = c
        return Rows(t.select(*[c.alias(n) for n, c in cols.items()] or [F.lit(1).alias("__one")]), tuple(cols), frozenset(cols))

    def stars(self, patterns: list) -> list:
        """The patterns, those with one variable as subject gathered where they have a predicate each and objects of their own."""
        by: dict[str, list] = {}
        patterns = [x for t in patterns for x in (t[2:] if t[0] == "star" else (t,))]
        for t in patterns:
            _, s, p, o = t
            if s[0] == "var" and p[0] == "iri" and (o[0] == "term" or o[1] != s[1] and all(o != x[3] for x in by.get(s[1], ()))):
                by.setdefault(s[1], []).append(t)
        gathered = {id(t) for ts in by.values() if len(ts) > 1 for t in ts}
        return [t for t in patterns if id(t) not in gathered] + [("star", ("var", s), *ts) for s, ts in by.items() if len(ts) > 1]

    def star(self, s: str, patterns: list) -> Rows:
        """Patterns of one subject joined by its text, which says all of a subject: a graph in buckets by subject needs no exchange."""
        whole, cols = None, {}
        weight = lambda t: t[3][0] == "term"
        for i, (_, _, p, o) in enumerate(sorted(patterns, key=weight, reverse=True)):
            t = self.scan(p[1])
            if o[0] == "term":
                t = t.where(self.is_term(o)).select("s")
            else:
                t = t.select("s", *[F.col(c).alias(f"__{c}{i}") for c in ("o", "kind", "lang", "datatype")])
                cols[o[1]] = self.object(str(i))
            whole = t if whole is None else whole.join(t, "s")
        return Rows(whole.select(self.subject().alias(s), *[c.alias(n) for n, c in cols.items()]), (s, *cols), frozenset((s, *cols)))

    def steps(self, p: tuple, start: tuple | None = None) -> DataFrame:
        """s, o (terms): pairs that a path leads from and to; from `start` only, if given."""
        kind = p[0]
        if kind == "iri":
            t = self.scan(p[1])
            if start is not None:
                t = t.where(F.col("s") == start[2])
            return t.select(self.subject().alias("s"), self.object().alias("o"))
        if kind == "inverse":
            d = self.steps(p[1]).select(F.col("o").alias("s"), F.col("s").alias("o"))
        elif kind == "seq":
            a, b = self.steps(p[1], start), self.steps(p[2])
            return a.select("s", F.col("o").alias("m")).join(b.select(F.col("s").alias("m"), "o"), "m").select("s", "o")
        elif kind == "alt":
            return self.steps(p[1], start).unionByName(self.steps(p[2], start))
        elif kind == "not":
            forth = self.triples.where(~F.col("p").isin(*p[1])) if p[1] or not p[2] else None
            d = None if forth is None else forth.select(self.subject().alias("s"), self.object().alias("o"))
            if p[2]:
                back = self.triples.where(~F.col("p").isin(*p[2])).select(self.object().alias("s"), self.subject().alias("o"))
                d = back if d is None else d.unionByName(back)
        else:
            return self.closure(p, start)
        return d if start is None else d.where(F.col("s") == term(*[F.lit(x) for x in start[1:]]))

    def closure(self, p: tuple, start: tuple | None) -> DataFrame:
        """`?`, `*` and `+`: distinct pairs. Nodes are numbers on the way.

        From one node: what is reached in less than 2^k steps, and pairs 2^k steps apart, give what is reached in less than
        2^(k+1), so that a chain of n nodes takes log2(n) rounds. Where pairs so far apart outgrow the edges (FANNED times), the rest goes
        edge by edge, from what is new. Without a start all pairs are squared. Cycles end, as nothing is new.
        """
        _, inner, least, many = p
        edges = self.steps(inner).distinct()
        same_as = lambda t: F.col("s") == term(*[F.lit(x) for x in t[1:]])
        if many:
            edges = settled(edges)
            ids = settled(edges.select("s").unionByName(edges.select(F.col("o").alias("s"))).distinct().withColumn("id", F.monotonically_increasing_id()))
            e = edges.join(ids.withColumnRenamed("id", "a"), "s").select("a", F.col("o").alias("s")).join(ids.withColumnRenamed("id", "b"), "s").select("a", "b")
            e = settled(e)
            if start is None:
                found = self.squared(e)
                found = found.join(ids.select(F.col("id").alias("a"), "s"), "a").join(ids.select(F.col("id").alias("b"), F.col("s").alias("o")), "b").select("s", "o")
            else:
                first = e.join(ids.where(same_as(start)).select(F.col("id").alias("a")), "a", "left_semi").select("b").distinct()
                found = self.reached(e, settled(first)).join(ids.select(F.col("id").alias("b"), F.col("s").alias("o")), "b").select(term(*[F.lit(x) for x in start[1:]]).alias("s"), "o")
        else:
            found = edges if start is None else edges.where(same_as(start))
        if least == 0:
            if start is not None:
                same = self.spark.createDataFrame([(start[1:], start[1:])], f"s {TERM}, o {TERM}")
            else:
                nodes = self.triples.select(self.subject().alias("s")).unionByName(self.triples.select(self.object().alias("s"))).distinct()
                same = nodes.select("s", F.col("s").alias("o"))
            found = found.unionByName(same).distinct()
        return found

    @staticmethod
    def squared(pairs: DataFrame) -> DataFrame:
        """a, b: pairs that any number of steps lead from and to, in as many rounds as the longest way has binary digits."""
        n = pairs.count()
        while True:
            far = pairs.select("a", F.col("b").alias("m")).join(pairs.select(F.col("a").alias("m"), "b"), "m").select("a", "b")
            pairs = settled(pairs.unionByName(far).distinct())
            before, n = n, pairs.count()
            if n == before:
                return pairs

    @staticmethod
    def reached(edges: DataFrame, first: DataFrame) -> DataFrame:
        """b: nodes in `first` or any number of steps from there."""
        found, n, power, most = first, first.count(), edges, FANNED * edges.count()
        while power is not None:
            found = settled(found.unionByName(found.select(F.col("b").alias("a")).join(power, "a").select("b")).distinct())
            before, n = n, found.count()
            if n == before:
                return found
            power = settled(power.select("a", F.col("b").alias("m")).join(power.select(F.col("a").alias("m"), "b"), "m").select("a", "b").distinct())
            if power.count() > most:
                power = None
        new = found
        while True:
            far = new.select(F.col("b").alias("a")).join(edges, "a").select("b").distinct()
            new = settled(far.join(found, "b", "left_anti"))
            if new.isEmpty():
                return found
            found = settled(found.unionByName(new))

    def along(self, s: tuple, p: tuple, o: tuple) -> Rows:
        if s[0] == "var" and o[0] == "term":  # a known end is where to begin
            return self.along(o, ("inverse", p), s) if p[0] != "closure" else self.along(o, ("closure", ("inverse", p[1]), *p[2:]), s)
        d = self.steps(p, s if s[0] == "term" else None)
        if o[0] == "term":
            d = d.where(F.col("o") == term(*[F.lit(x) for x in o[1:]]))
        if s[0] == o[0] == "var" and s[1] == o[1]:
            return Rows(d.where(F.col("s") == F.col("o")).select(F.col("s").alias(s[1])), (s[1],), frozenset([s[1]]))
        names = {x[1]: c for x, c in ((s, "s"), (o, "o")) if x[0] == "var"}
        return Rows(d.select(*[F.col(c).alias(n) for n, c in names.items()] or [F.lit(1).alias("__one")]), tuple(names), frozenset(names))

    # joins

    def join(self, a: Rows, b: Rows, how: str = "inner", tests: list | tuple = (), fixed: frozenset[str] = frozenset()) -> Rows:
        """On what both bind. A variable that may be unbound agrees with anything where it is. Where no variable is sure on both
        sides, filters between them (tests) make keys or intervals. Tests are conditions of a left, semi or anti join; of an inner
        one they are filters that come later. MINUS doesn't look at `fixed` variables, which stand for constants."""
        shared = [n for n in b.names if n in a.names]
        keys = [n for n in shared if n in a.sure and n in b.sure]
        right = b.df.select(*[F.col(f"`{n}`").alias(f"__r_{n}") for n in b.names], *([] if b.names else [F.lit(1).alias("__r_one")]))
        r = {n: F.col(f"`__r_{n}`") for n in b.names}
        l = {n: F.col(f"`{n}`") for n in a.names}
        on = [l[n] == r[n] if n in keys else l[n].isNull() | r[n].isNull() | (l[n] == r[n]) for n in shared]
        j = None
        if not keys and how != "minus" and a.names and b.names:
            ties = self.ties(a, b, tests, l, r)
            on += ties
            if not ties and how == "inner":
                j = self.banded(a, b, tests, l, r, right)
            if not ties and j is None and not self.products:
                raise SparqlError(f"a product of patterns: {sorted(a.names)} and {sorted(b.names)} share no variable that is always bound, and no filter says that numbers of one side equal or lie between those of the other")
        if how == "minus":  # what shares no bound variable takes nothing away
            free = [n for n in shared if n not in fixed]
            if not free:
                return a
            if not any(n in keys for n in free):
                on.append(reduce(lambda x, y: x | y, [l[n].isNotNull() & r[n].isNotNull() for n in free]))
        if how in ("left", "left_semi", "left_anti") and tests:
            on.append(F.coalesce(self.all(tests, {**r, **l}), F.lit(False)))
        test = reduce(lambda x, y: x & y, on) if on else F.lit(True)
        if how in ("minus", "left_anti", "left_semi"):
            return Rows(a.df.join(right, test, "left_semi" if how == "left_semi" else "left_anti"), a.names, a.sure)
        j = a.df.join(right, test, "left" if how == "left" else "inner") if j is None else j.where(test)
        cols = [(l[n] if n not in shared or n in a.sure else F.coalesce(l[n], r[n])).alias(n) for n in a.names]
        cols += [r[n].alias(n) for n in b.names if n not in shared]
        names = (*a.names, *[n for n in b.names if n not in shared])
        return Rows(j.select(*cols or [F.lit(1).alias("__one")]), names, a.sure if how == "left" else a.sure | b.sure)

    def ties(self, a: Rows, b: Rows, tests, l: dict, r: dict) -> list[Column]:
        """Keys from equality filters between the two: terms that are equal have equal keys."""

        def key(v: Value) -> Column:
            number = v.col.cast("double") if v.kind in ("int", "num") else v.text().try_cast("double")
            return F.coalesce((number + 0.0).cast("string"), v.text())

        out = []
        for e in [c for t in tests for c in conjuncts(t)]:
            found = linked(e, set(a.sure), set(b.sure))
            if found and found[0] == "=":
                x, y = self.value(found[1], l), self.value(found[2], r)
                if "bool" not in (x.kind, y.kind):
                    out.append(key(x) == key(y))
        return out

    def banded(self, a: Rows, b: Rows, tests, l: dict, r: dict, right: DataFrame) -> DataFrame | None:
        """A join by filters that hold numbers of one side between two of the other one, if there are such."""
        parts = [c for t in tests for c in conjuncts(t)]
        for points, others, pc, oc in ((a, b, l, r), (b, a, r, l)):
            found: dict = {}
            for e in parts:
                both = {**l, **r}
                if not any(self.value(x, both).kind in ("int", "num") for x in (e[2] if e[0] == "op" and len(e[2]) == 2 and variables(e) <= set(both) else ())):
                    continue  # only a comparison that is of numbers whatever the terms are
                for x in bounds(e, set(points.sure), set(others.sure)):
                    found.setdefault(_frozen(x.of), {}).setdefault(x.upper, x)
            for pair in found.values():
                if len(pair) == 2 and any(variables(x.value) for x in pair.values()):
                    number = lambda e, cols: self.value(e, cols).num().cast("double")
                    at, low, high = number(pair[True].of, pc), number(pair[False].value, oc), number(pair[True].value, oc)
                    return band_join(a.df, at, right, low, high) if points is a else band_join(right, at, a.df, low, high)
        return None

    def bgp(self, patterns: list, seed: Rows | None, tests: list | tuple = ()) -> Rows | None:
        """Patterns in an order that keeps them connected, those with most constants first; parts without a common variable are joined by filters."""
        left, rows = self.stars(patterns), seed

        def weight(t: tuple) -> int:
            return max(map(weight, t[2:])) if t[0] == "star" else sum(x[0] == "term" for x in (t[1], t[3])) * 2 + (t[2][0] == "iri")

        def uses(t: tuple) -> set[str]:
            return set().union(*map(uses, t[2:])) if t[0] == "star" else {x[1] for x in t[1:4] if x[0] == "var"}

        while left:
            known, sure = (set(rows.names), rows.sure) if rows else (set(), frozenset())
            open_ = [t for t in left if not known or uses(t) & sure or not uses(t)]
            if open_:
                t = max(open_, key=weight)
                left.remove(t)
                one = self.star(t[1][1], t[2:]) if t[0] == "star" else self.triple(*t[1:])
                rows = one if rows is None else self.join(rows, one) if one.names else Rows(rows.df.join(one.df.limit(1), how="left_semi"), rows.names, rows.sure)
                continue
            failed, rest = None, list(left)
            while rest:
                part, names = [rest[0]], uses(rest[0])
                while grown := [t for t in rest if t not in part and uses(t) & names]:
                    part += grown
                    names = names.union(*map(uses, grown))
                rest = [t for t in rest if t not in part]
                try:
                    rows = self.join(rows, self.bgp(part, None, tests), "inner", tests)
                except SparqlError as e:
                    failed = e
                    continue
                left = [t for t in left if t not in part]
                break
            else:
                raise failed
        return rows

    # groups

    def empty(self) -> Rows:
        return Rows(self.spark.range(1).select(F.lit(1).alias("__one")), (), frozenset())

    def group(self, patterns: list, given: Rows | None = None, final: bool = False) -> Rows:
        """A group's solutions; with `given`, outer bindings, those that agree with one of them, joined to it. If `final`, only which
        of the given bindings have a solution matters."""
        rows: Rows | None = None
        open_ = given is not None
        outer = set(given.names) if open_ else set()
        later = [x[1] for x in patterns if x[0] == "filter"]
        tests = [c for e in later for c in conjuncts(e) if not has_exists(c)]
        triples: list = []
        alone = len(patterns) == 1

        def flush() -> None:
            nonlocal rows
            if triples:
                rows = self.bgp(triples, rows, tests)
                triples.clear()

        def attach(last: bool = False) -> None:
            nonlocal rows, open_
            if open_:
                (rows, done), open_ = self.attached(given, rows, tests, last), False
                if done:
                    later[:] = [e for e in later if has_exists(e)]

        def add(other: Rows) -> None:
            nonlocal rows
            rows = other if rows is None or not rows.names else self.join(rows, other, "inner", tests)

        def inside(body, last: bool = False) -> Rows:
            """A nested group: it takes the bindings in if it mentions them."""
            nonlocal open_
            if not outer & variables(body):
                return self.group(body)
            if not (rows is None and last):
                attach()
            return self.group(body, given, last)

        for x in patterns:
            if x[0] == "triple":
                triples.append(x)
                continue
            if x[0] == "filter":
                continue
            flush()
            if x[0] == "optional":
                body, own = self.split(x[1])
                if outer & variables(x[1]):
                    attach()
                inner = inside(body)
                if rows is None:
                    rows = self.empty()
                if rows.names or inner.names:
                    rows = self.join(rows, inner, "left", own)
            elif x[0] == "minus":
                if rows is not None:
                    inner = inside(x[1])
                    rows = self.join(rows, inner, "minus", fixed=frozenset(outer))
            elif x[0] == "bind":
                if outer & variables(x[1]):
                    attach()
                rows = rows or self.empty()
                if x[2] in rows.names:
                    raise SparqlError(f"?{x[2]} is bound already")
                v = self.value(x[1], self.columns(rows)).term()
                rows = Rows(rows.df.withColumn(x[2], v), (*rows.names, x[2]), rows.sure)
            elif x[0] == "values":
                add(self.inline(x[1], x[2]))
            elif x[0] in ("union", "group"):
                branches = x[1] if x[0] == "union" else [x[1]]
                if outer & variables(branches):
                    if not alone:
                        attach()
                    parts = [self.group(g, given, final and alone) for g in branches]
                    open_ = False
                else:
                    parts = [self.group(g) for g in branches]
                add(self.union(parts) if len(parts) > 1 else parts[0])
            elif x[0] == "select":
                add(self.select(x[1]))
        flush()
        attach(final and not any(has_exists(e) for e in later))
        rows = rows or self.empty()
        for e in later:
            rows = self.filtered(rows, e)
        return rows

    def attached(self, given: Rows, rows: Rows | None, tests: list, last: bool) -> tuple[Rows, bool]:
        """Outer bindings joined with a group's solutions, on shared variables or else by filters between them; and whether all filters are settled."""
        if rows is None:
            return given, False
        free = [n for n in rows.names if n in given.names]
        if free and not any(n in given.sure and n in rows.sure for n in free) and (open_ := next((n for n in free if n in rows.sure), None)):
            # bindings that have the variable join on it; for those that haven't, it is free
            c = F.col(f"`{open_}`")
            names = tuple(n for n in given.names if n != open_)
            both = [Rows(given.df.where(c.isNotNull()), given.names, given.sure | {open_}), Rows(given.df.where(c.isNull()).drop(open_), names, given.sure)]
            parts = []
            for x in both:
                found, done = self.attached(x, rows, tests, last)
                for e in () if done else tests:
                    found = self.filtered(found, e)
                parts.append(found)
            return self.union(parts), True
        outer = set(given.names) - set(rows.names)
        parts = [c for c in tests if variables(c) & outer and variables(c) & set(rows.names)]
        if last and not free and len(parts) <= 1:
            one = linked(parts[0], set(given.names), set(rows.names)) if parts else None
            if not parts or one and one[0] != "=":
                for c in tests:
                    if not variables(c) & outer:
                        rows = self.filtered(rows, c)
                    elif c not in parts:
                        given = self.filtered(given, c)
                if one:
                    return self.beyond_extremes(given, rows, parts[0], *one), True
                # nothing links them: the group has a solution or it hasn't
                return Rows(given.df.join(rows.df.select(F.lit(1).alias("__any")).limit(1), how="left_semi"), given.names, given.sure), True
        return self.join(given, rows, "inner", tests), False

    def beyond_extremes(self, given: Rows, rows: Rows, test: tuple, sign: str, own: tuple, e: tuple) -> Rows:
        """The given bindings for which some solution passes a one-sided comparison: if any does, one with the largest (or least)
        number or text does, or the largest text of its data type."""
        v = self.value(e, self.columns(rows))
        most = F.max_by if sign in ("<", "<=") else F.min_by
        kept = F.struct(*[F.col(f"`{n}`").alias(f"{n}") for n in rows.names if n in variables(e)])
        d = rows.df.select(kept.alias("__w"), v.num().cast("double").alias("__n"), v.text().alias("__t"), v.term()["datatype"].alias("__d"))
        one = d.agg(most("__w", F.when(F.col("__n").isNotNull(), F.col("__n"))).alias("__a"), most("__w", "__t").alias("__b"))  # one row
        by = d.where("__t is not null").groupBy("__d").agg(most("__w", "__t").alias("__c"))
        cols = self.columns(given)
        passes = lambda w: F.coalesce(F.col(w).isNotNull() & self.value(test, {**{n: F.col(w)[n] for n in rows.names if n in variables(e)}, **cols}).truth(), F.lit(False))
        kind = self.value(own, cols).term()["datatype"]
        j = given.df.crossJoin(F.broadcast(one)).join(by, kind == F.col("__d"), "left")
        return Rows(j.where(passes("__a") | passes("__b") | passes("__c")).select(*[f"`{n}`" for n in given.names]), given.names, given.sure)

    @staticmethod
    def split(patterns: list) -> tuple[list, list]:
        """A group's patterns and its own filters, which may name variables from outside."""
        plain = [x for x in patterns if x[0] != "filter" or has_exists(x[1])]
        return plain, [x[1] for x in patterns if x[0] == "filter" and not has_exists(x[1])]

    def all(self, tests: list, cols: dict) -> Column:
        return reduce(lambda x, y: x & y, [self.value(e, cols).truth() for e in tests])

    def inline(self, names: list, rows: list) -> Rows:
        data = [tuple(None if t is None else tuple(t[1:]) for t in r) for r in rows]
        df = self.spark.createDataFrame(data, ", ".join(f"`{n}` {TERM}" for n in names))
        return Rows(df, tuple(names), frozenset(n for i, n in enumerate(names) if all(r[i] is not None for r in rows)))

    def union(self, parts: list[Rows]) -> Rows:
        df = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), [p.df.drop("__one") if p.names else p.df for p in parts])
        names = tuple(dict.fromkeys(n for p in parts for n in p.names))
        return Rows(df.select(*[f"`{n}`" for n in names]) if names else df, names, frozenset.intersection(*[p.sure for p in parts]))

    @staticmethod
    def needed(patterns: list) -> list:
        """A group of which only the existence matters, without the optional parts that nothing behind them can tell."""
        if not any(x[0] == "filter" for x in patterns):
            while patterns and patterns[-1][0] == "optional":
                patterns = patterns[:-1]
        return patterns

    def filtered(self, rows: Rows, e: tuple) -> Rows:
        if e[0] == "op" and e[1] == "&&":
            return self.filtered(self.filtered(rows, e[2][0]), e[2][1])
        if e[0] == "op" and e[1] == "!" and e[2][0][0] == "exists":
            return self.filtered(rows, ("exists", e[2][0][1], not e[2][0][2]))
        if e[0] == "exists":
            how, patterns = "left_semi" if e[2] else "left_anti", self.needed(e[1])
            nested = [x for x in patterns if x[0] not in ("triple", "filter", "values") or x[0] == "filter" and has_exists(x)]
            if not variables(nested) & set(rows.names):  # a join on shared variables says the same
                body, tests = self.split(patterns)
                inner = self.group(body)
                if any(n in rows.sure and n in inner.sure for n in inner.names):
                    return self.join(rows, inner, how, tests)
            wide, found, extra = self.matching(rows, patterns)
            j = wide.df.join(found.df, how=how) if not found.names else self.join(wide, found, how).df
            return Rows(j.drop(*extra), rows.names, rows.sure)
        rows, e, extra = self.flagged(rows, e)
        df = rows.df.where(self.value(e, self.columns(rows)).truth())
        return Rows(df.drop(*extra) if extra else df, tuple(n for n in rows.names if n not in extra), rows.sure - set(extra))

    def matching(self, rows: Rows, patterns: list) -> tuple[Rows, Rows, list[str]]:
        """rows, with a key if need be; the distinct keys for which the group has a solution (a row without columns if it has one whatever they are); what to drop afterwards."""
        used = tuple(n for n in rows.names if n in variables(patterns))
        if not used:
            return rows, Rows(self.group(patterns).df.select(F.lit(1).alias("__any")).limit(1), (), frozenset()), []
        extra = []
        if not set(used) <= rows.sure:  # a variable that may be unbound: what is bound tells the bindings apart
            extra = [self.fresh("given")]
            rows = Rows(rows.df.withColumn(extra[0], F.struct(*[F.col(f"`{n}`").alias(f"v{i}") for i, n in enumerate(used)])), (*rows.names, *extra), rows.sure | set(extra))
        names = (*used, *extra)
        given = Rows(rows.df.select(*[f"`{n}`" for n in names]).distinct(), names, rows.sure & set(names))
        keys = tuple(extra) or used
        found = self.group(patterns, given, True)
        return rows, Rows(found.df.select(*[f"`{n}`" for n in keys]).distinct(), keys, frozenset(keys)), extra

    def flagged(self, rows: Rows, e: tuple) -> tuple[Rows, tuple, list[str]]:
        """EXISTS within a larger expression: each becomes a column, bound where the group has a solution."""
        extra: list[str] = []

        def walk(x):
            nonlocal rows
            if not isinstance(x, tuple):
                return [walk(y) for y in x] if isinstance(x, list) else x
            if x[0] != "exists":
                return tuple(walk(y) for y in x)
            flag = self.fresh("exists")
            rows, found, key = self.matching(rows, self.needed(x[1]))
            true = term("literal", "true", "", XSD + "boolean")
            if found.names:
                marked = Rows(found.df.withColumn(flag, true), (*found.names, flag), frozenset((*found.names, flag)))
                rows = self.join(rows, marked, "left")
            else:  # one row
                any_ = found.df.agg((F.count(F.lit(1)) > 0).alias("__any"))
                rows = Rows(rows.df.crossJoin(F.broadcast(any_)).withColumn(flag, F.when(F.col("__any"), true)).drop("__any"), (*rows.names, flag), rows.sure)
            extra.extend([flag, *key])
            bound = ("call", "BOUND", [("var", flag)])
            return bound if x[2] else ("op", "!", [bound])

        plain = walk(e)  # joins as it goes
        return rows, plain, extra

    # expressions

    @staticmethod
    def columns(rows: Rows) -> dict[str, Column]:
        return {n: F.col(f"`{n}`") for n in rows.names}

    def value(self, e: tuple, cols: dict[str, Column]) -> Value:
        kind = e[0]
        if kind == "var":
            return Value("term", cols[e[1]]) if e[1] in cols else Value("term", F.lit(None).cast(TERM))
        if kind == "term":
            if e[1] == "literal" and e[4] in WHOLE and not e[3]:
                return Value("int", F.lit(int(e[2])).cast("long"))
            if e[1] == "literal" and e[4] == XSD + "string":
                return Value("str", F.lit(e[2]))
            if e[1] == "literal" and e[4] == XSD + "boolean":
                return Value("bool", F.lit(e[2] == "true"))
            if e[1] == "literal" and e[4] in NUMERIC:
                return Value("num", F.lit(float(e[2])))
            return Value("term", term(*e[1:]))
        if kind == "cast":
            return self.cast(e[1], self.value(e[2][0], cols))
        if kind == "op":
            return self.operation(e[1], e[2], cols)
        if kind == "call":
            return self.call(e[1], e[2], cols)
        if kind == "agg":
            raise SparqlError(f"{e[1]} stands outside of SELECT, HAVING and ORDER BY")
        raise SparqlError("EXISTS stands where it can't be joined")

    def cast(self, iri: str, v: Value) -> Value:
        text = F.trim(v.text())
        if iri in WHOLE:
            whole = v.num().cast("double").try_cast("long") if v.kind in ("term", "num") else v.num().cast("long") if v.kind == "int" else None
            return Value("int", text.try_cast("long") if whole is None else F.coalesce(whole, text.try_cast("long")))
        if iri in NUMERIC:
            return Value("num", text.try_cast("double"))
        if iri == XSD + "string":
            return Value("str", v.text())
        if iri == XSD + "boolean":
            return Value("bool", F.when(text.isin("true", "1"), True).when(text.isin("false", "0"), False))
        return Value("term", F.when(v.text().isNotNull(), term("literal", v.text(), "", iri)))

    def equal(self, a: Value, b: Value) -> Column:
        if a.kind in ("int", "num") or b.kind in ("int", "num"):
            return a.num() == b.num()
        if a.kind == "bool" or b.kind == "bool":
            return a.truth() == b.truth()
        if a.kind == b.kind == "str":
            return a.col == b.col
        x, y = a.term(), b.term()
        same = (x["kind"] == y["kind"]) & (x["value"] == y["value"]) & (x["lang"] == y["lang"])
        if self.strict:
            same &= x["datatype"] == y["datatype"]
            known = lambda t: (t["kind"] != "literal") | t["datatype"].isin(XSD + "string", RDF + "langString", XSD + "boolean", *NUMERIC)
            same = F.when(same | (known(x) & known(y)), same)
        p, q = Value("term", x).num(), Value("term", y).num()
        return F.when(p.isNotNull() & q.isNotNull(), p == q).otherwise(same)

    def operation(self, sign: str, args: list, cols: dict) -> Value:
        v = [self.value(x, cols) for x in args]
        if sign in ("&&", "||", "!"):
            t = [x.truth() for x in v]
            return Value("bool", ~t[0] if sign == "!" else t[0] & t[1] if sign == "&&" else t[0] | t[1])
        if sign in ("=", "!="):
            same = self.equal(v[0], v[1])
            return Value("bool", same if sign == "=" else ~same)
        if sign == "in":
            return Value("bool", reduce(lambda x, y: x | y, [self.equal(v[0], x) for x in v[1:]], F.lit(False)))
        if sign in ("<", ">", "<=", ">="):
            compare = {"<": lambda x, y: x < y, ">": lambda x, y: x > y, "<=": lambda x, y: x <= y, ">=": lambda x, y: x >= y}[sign]
            numbers = compare(v[0].num(), v[1].num())
            if "num" in (v[0].kind, v[1].kind) or "int" in (v[0].kind, v[1].kind):
                return Value("bool", numbers)
            texts = compare(v[0].text(), v[1].text())
            if "str" in (v[0].kind, v[1].kind):
                return Value("bool", texts)
            x, y = v[0].term(), v[1].term()
            return Value("bool", F.coalesce(numbers, F.when((x["kind"] == "literal") & (y["kind"] == "literal") & (x["datatype"] == y["datatype"]), texts)))
        n = [x.num() for x in v]
        whole = all(x.kind == "int" for x in v) and sign != "/"
        if sign == "neg":
            return Value(v[0].kind if whole else "num", -n[0])
        f = {"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply, "/": F.try_divide}[sign]
        return Value("int" if whole else "num", f(*n) if whole else f(*[x.cast("double") for x in n]))

    def call(self, name: str, args: list, cols: dict) -> Value:
        if name == "BOUND":
            return Value("bool", self.value(args[0], cols).col.isNotNull())
        v = [self.value(x, cols) for x in args]
        t = [x.text() for x in v]
        is_kind = lambda k: Value("bool", v[0].term()["kind"] == k)
        if name in ("IF", "COALESCE"):
            some = v[1:] if name == "IF" else v
            kinds = {x.kind for x in some}
            kind = kinds.pop() if len(kinds) == 1 else "num" if kinds == {"int", "num"} else "term"
            c = [x.term() if kind == "term" else x.col.cast("double") if kind == "num" else x.col for x in some]
            if name == "COALESCE":
                return Value(kind, F.coalesce(*c))
            test = v[0].truth()
            return Value(kind, F.when(test, c[0]).when(~test, c[1]))
        number = lambda c: Value("int" if v[0].kind == "int" else "num", c if v[0].kind == "int" else c.cast("double"))
        simple = {
            "STR": lambda: Value("str", t[0]),
            "LANG": lambda: Value("str", F.when(v[0].term()["kind"] == "literal", v[0].term()["lang"])),
            "DATATYPE": lambda: Value("term", F.when(v[0].term()["kind"] == "literal", term("iri", v[0].term()["datatype"]))),
            "IRI": lambda: Value("term", F.when(t[0].isNotNull(), term("iri", t[0]))),
            "STRLEN": lambda: Value("int", F.length(t[0]).cast("long")),
            "UCASE": lambda: Value("str", F.upper(t[0])),
            "LCASE": lambda: Value("str", F.lower(t[0])),
            "CONCAT": lambda: Value("str", F.concat(*t)),
            "CONTAINS": lambda: Value("bool", F.contains(t[0], t[1])),
            "STRSTARTS": lambda: Value("bool", F.startswith(t[0], t[1])),
            "STRENDS": lambda: Value("bool", F.endswith(t[0], t[1])),
            "STRBEFORE": lambda: Value("str", F.when(F.contains(t[0], t[1]), F.substr(t[0], F.lit(1), F.instr(t[0], t[1]) - 1)).otherwise("")),
            "STRAFTER": lambda: Value("str", F.when(F.contains(t[0], t[1]), F.substr(t[0], F.instr(t[0], t[1]) + F.length(t[1]))).otherwise("")),
            "SUBSTR": lambda: Value("str", _part(t[0], *[F.floor(x.num() + 0.5).cast("int") for x in v[1:]])),
            "REPLACE": lambda: Value("str", F.regexp_replace(t[0], t[1], t[2])),
            "REGEX": lambda: Value("bool", F.rlike(t[0], F.concat(F.lit("(?i)"), t[1]) if len(args) > 2 and args[2][2:3] == ("i",) else t[1])),
            "ABS": lambda: number(F.abs(v[0].num())),
            "CEIL": lambda: number(F.ceil(v[0].num())),
            "FLOOR": lambda: number(F.floor(v[0].num())),
            "ROUND": lambda: number(F.floor(v[0].num() + 0.5)),
            "SAMETERM": lambda: Value("bool", v[0].term() == v[1].term()),
            "LANGMATCHES": lambda: Value("bool", F.when(t[1] == "*", t[0] != "").otherwise((F.lower(t[0]) == F.lower(t[1])) | F.startswith(F.lower(t[0]), F.concat(F.lower(t[1]), F.lit("-"))))),
            "STRLANG": lambda: Value("term", term("literal", t[0], t[1], RDF + "langString")),
            "STRDT": lambda: Value("term", term("literal", t[0], "", t[1])),
            "ENCODE_FOR_URI": lambda: Value("str", F.replace(F.url_encode(t[0]), F.lit("+"), F.lit("%20"))),
            "MD5": lambda: Value("str", F.md5(t[0])),
            "SHA1": lambda: Value("str", F.sha1(t[0])),
            "SHA256": lambda: Value("str", F.sha2(t[0], 256)),
            "YEAR": lambda: Value("int", F.regexp_extract(t[0], r"^-?\d+", 0).try_cast("long")),
            "ISIRI": lambda: is_kind("iri"),
            "ISBLANK": lambda: is_kind("blank"),
            "ISLITERAL": lambda: is_kind("literal"),
            "ISNUMERIC": lambda: Value("bool", F.when(v[0].term().isNotNull(), v[0].num().isNotNull())),
        }
        name = {"URI": "IRI", "ISURI": "ISIRI"}.get(name, name)
        if name not in simple:
            raise SparqlError(f"the function {name} is not supported")
        return simple[name]()

    # queries

    def aggregate(self, e: tuple, cols: dict) -> Column:
        _, name, distinct, arg, sep = e
        if arg is None:
            return F.count_distinct(F.struct(*cols.values())) if distinct and cols else F.count(F.lit(1))
        v = self.value(arg, cols)
        if name == "COUNT":
            return F.count_distinct(v.term()) if distinct else F.count(v.col)
        if name in ("SUM", "AVG"):
            return self.total(v, name, distinct)
        if name == "GROUP_CONCAT":  # sorted, so that reruns agree
            t = v.text()
            return F.array_join(F.array_sort(F.collect_set(t) if distinct else F.collect_list(t)), sep)
        t = v.term()
        return (F.max_by if name == "MAX" else F.min_by)(t, _order(t))

    @staticmethod
    def total(v: Value, name: str, distinct: bool) -> Column:
        """SUM or AVG as a term of the widest type among the numbers: integer, decimal, float, double. An average of integers is a decimal; of no rows both are 0."""
        n = v.num()
        kind = v.term()["datatype"]
        rank = F.max(F.when(n.isNull(), None).when(kind.isin(*WHOLE), 0).when(kind == XSD + "decimal", 1).when(kind == XSD + "float", 2).otherwise(3))
        whole = v.col if v.kind == "int" else v.text().try_cast("decimal(38,0)")
        sums = F.sum_distinct(n) if distinct else F.sum(n)
        exact = F.when(rank == 0, (F.sum_distinct(whole) if distinct else F.sum(whole)).cast("string"))
        text = F.coalesce(exact, _shown(sums.cast("double"))) if name == "SUM" else _shown((sums / (F.count_distinct(n) if distinct else F.count(n))).cast("double"))
        named = F.element_at(F.array(*[F.lit(XSD + t) for t in ("integer", "decimal", "float", "double")]), (rank if name == "SUM" else F.greatest(rank, F.lit(1))) + 1)
        return F.when(F.count(F.lit(1)) == 0, term("literal", "0", "", XSD + "integer")).when(rank.isNotNull(), term("literal", text, "", named))

    def grouped(self, q: Query, rows: Rows) -> tuple[Rows, dict]:
        """Groups and their aggregates, one column for each; and what each aggregate of the query is called."""
        cols = self.columns(rows)
        keys = {name or self.fresh("key"): self.value(e, cols).term() for name, e in q.group}
        calls: dict = {}

        def walk(x) -> None:
            if isinstance(x, tuple) and x and x[0] == "agg":
                if _frozen(x) not in calls:
                    calls[_frozen(x)] = (self.fresh("agg"), x)
            elif isinstance(x, (tuple, list)):
                for y in x:
                    walk(y)

        for e in [e for _, e in q.items if e is not None] + q.having + [e for e, _ in q.order]:
            walk(e)
        kinds = {"COUNT": "int", "GROUP_CONCAT": "str"}
        outs = [Value(kinds.get(x[1], "term"), self.aggregate(x, cols)).col.alias(n) for n, x in calls.values()]
        df = rows.df.select(*[f"`{n}`" for n in rows.names], *[c.alias(f"__k_{n}") for n, c in keys.items()]) if keys else rows.df
        g = df.groupBy(*[F.col(f"`__k_{n}`").alias(n) for n in keys]) if keys else df.groupBy()
        df = g.agg(*outs) if outs else df.select(*[F.col(f"`__k_{n}`").alias(n) for n in keys]).distinct()
        typed = {n: Value(kinds.get(x[1], "term"), F.col(f"`{n}`")).term() for n, x in calls.values()}
        df = df.select(*[f"`{n}`" for n in keys], *[c.alias(n) for n, c in typed.items()])
        sure = frozenset(n for name, e in q.group for n in [name] if n and e[0] == "var" and e[1] in rows.sure)
        return Rows(df, (*keys, *typed), sure), {k: n for k, (n, _) in calls.items()}

    def select(self, q: Query) -> Rows:
        """The query's solutions, with its variables in order."""
        rows = self.group(q.where)
        named: dict = {}
        items = [(n, e) for n, e in q.items] or [(n, None) for n in rows.names if not n.startswith("__")]
        if q.group or _has_agg([e for _, e in items]) or _has_agg(q.having):
            rows, named = self.grouped(q, rows)

        def plain(x):
            if isinstance(x, tuple) and x and x[0] == "agg":
                return ("var", named[_frozen(x)])
            return tuple(map(plain, x)) if isinstance(x, tuple) else [plain(y) for y in x] if isinstance(x, list) else x

        for e in q.having:
            rows = self.filtered(rows, plain(e))
        for n, e in items:
            if e is not None:
                v = self.value(plain(e), self.columns(rows)).term()
                rows = Rows(rows.df.withColumn(n, v), tuple(dict.fromkeys((*rows.names, n))), rows.sure | ({n} if e[0] == "agg" and e[1] == "COUNT" else frozenset()))
        df = rows.df
        keys = [(plain(e), falling) for e, falling in q.order]
        out = [n for n, _ in items]
        cols = self.columns(rows)
        final = [(cols[n] if n in cols else F.lit(None).cast(TERM)).alias(n) for n in out]
        orders = [_order(self.value(e, cols).term()) for e, _ in keys]
        if q.distinct:
            df = df.select(*final, *[o.alias(f"__o{i}") for i, o in enumerate(orders)]).dropDuplicates(out)
        else:
            df = df.select(*final, *[o.alias(f"__o{i}") for i, o in enumerate(orders)])
        if keys:
            df = df.orderBy(*[F.col(f"__o{i}").desc() if falling else F.col(f"__o{i}").asc() for i, (_, falling) in enumerate(keys)])
        if q.offset:
            df = df.offset(q.offset)
        if q.limit is not None:
            df = df.limit(q.limit)
        return Rows(df.select(*[f"`{n}`" for n in out]), tuple(out), rows.sure & set(out))

    def construct(self, q: Query) -> DataFrame:
        """s, p, o, kind, lang, datatype: the template's triples for each solution, as a set. Unbound ones and literal subjects give none."""
        rows = self.group(q.where)
        cols = self.columns(rows)
        made = {x[1] for t in q.template for x in (t[1], t[3]) if x[0] == "var" and x[1] not in cols}
        df = rows.df
        if made:  # template blank nodes: new ones for each solution
            df = df.withColumn("__row", F.xxhash64(*[cols[n] for n in rows.names]).cast("string"))
            cols |= {n: term("blank", F.concat(F.lit(f"_:{n.strip('_')}x"), F.regexp_replace("__row", "-", "m"))) for n in made}
        if q.limit is not None or q.offset:
            df = df.offset(q.offset).limit(q.limit if q.limit is not None else 2**31 - 1)
        side = lambda x: term("iri", x[1]) if x[0] == "iri" else self.value(x, cols).term()
        all_ = F.array(*[F.struct(side(s).alias("a"), side(p).alias("b"), side(o).alias("c")) for _, s, p, o in q.template])
        t = df.select(F.explode(all_).alias("t")).where("t.a is not null and t.b is not null and t.c is not null and t.a.kind <> 'literal' and t.b.kind = 'iri'")
        none = lambda c: F.when(F.col(c) != "", F.col(c))
        return t.select(F.col("t.a.value").alias("s"), F.col("t.b.value").alias("p"), F.col("t.c.value").alias("o"), F.col("t.c.kind").alias("kind"), none("t.c.lang").alias("lang"), none("t.c.datatype").alias("datatype")).dropDuplicates()

    def describe(self, q: Query) -> DataFrame:
        """All triples of the named subjects."""
        fixed = [t[2] for t in q.template if t[0] == "term"]
        t = self.triples.select("s", "p", "o", "kind", "lang", "datatype")
        parts = [t.where(F.col("s").isin(*fixed))] if fixed else []
        names = [t[1] for t in q.template if t[0] == "var"]
        if names:
            rows = self.group(q.where)
            for n in names:
                found = rows.df.select(F.col(f"`{n}`")["value"].alias("s")).distinct()
                parts.append(t.join(found, "s", "left_semi"))
        return reduce(lambda x, y: x.unionByName(y), parts).dropDuplicates()


def _frozen(x):
    return tuple(map(_frozen, x)) if isinstance(x, (tuple, list)) else x


def _has(x, what: str) -> bool:
    return isinstance(x, (tuple, list)) and (bool(x) and x[0] == what or any(_has(y, what) for y in x))


def _has_agg(x) -> bool:
    return _has(x, "agg")


def settled(df: DataFrame) -> DataFrame:
    """Lineage cut in the folder that spark.checkpoint.dir names; where it is unset, in a folder of our own on a local master, an error on a cluster."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        where = spark.conf.get("spark.checkpoint.dir", None)
        if not where:
            if not sc.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
            where = "file://" + (own := tempfile.mkdtemp(prefix="semshift-paths-"))
            atexit.register(shutil.rmtree, own, True)
        sc.setCheckpointDir(where)
    return df.checkpoint()


def query(triples: DataFrame, text: str, prefixes: dict[str, str] | None = None, strict: bool = False, terms: bool = False, products: bool = False) -> DataFrame:
    """The result of a SPARQL query: for SELECT a column of plain text for each variable (terms=True: whole terms), for ASK one
    row `answer`, for CONSTRUCT and DESCRIBE triples. SparqlError for what can't be read or isn't supported."""
    q = parse(text, prefixes)
    c = Compiler(triples, strict, products)
    if q.form == "CONSTRUCT":
        return c.construct(q)
    if q.form == "DESCRIBE":
        return c.describe(q)
    if q.form == "ASK":
        return c.group(q.where).df.limit(1).agg((F.count(F.lit(1)) > 0).alias("answer"))
    rows = c.select(q)
    return rows.df if terms else rows.df.select(*[F.col(f"`{n}`")["value"].alias(n) for n in rows.names])
