"""Constraints on a graph of triples, and their violations by focus node: shape, focus, path, constraint, value, message.

Rules are data. Whatever their number, one aggregation by node takes what they ask of it: its classes as bits, how many values it
has of each path, what its evidence is; all rules on these are conditions on that row. Values out of bounds are looked for
among the values themselves, and one join of values with their classes finds those of the wrong class. Predicates and classes are
known by local names; a class has the members of the classes below it, as the graph's subClassOf triples say.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import local_name

@dataclass(frozen=True)
class Rule:
    shape: str
    target: str
    path: str
    least: int | None = None
    most: int | None = None
    of: str | None = None
    low: float | None = None
    high: float | None = None
    length: int | None = None
    message: str = ""


def _rules(shape: str, target: str, *rows: tuple) -> list[Rule]:
    return [Rule(shape, target, path, message=message, **kw) for path, message, kw in rows]


#: The shapes of the graph's files: what words, senses, events, triggers and hypotheses must have.
SHAPES = [
    *_rules("WordShape", "Word", ("writtenForm", "a word has a written form", {"least": 1}), ("language", "a word has a language", {"least": 1}), ("sense", "a word has a sense", {"least": 1})),
    *_rules("SenseShape", "Sense", ("gloss", "a sense has a gloss", {"least": 1}), ("connotation", "a sense has a connotation, which is a concept", {"least": 1, "of": "Concept"})),
    *_rules(
        "DriftEventShape", "DriftEvent", ("affectsWord", "an event names a word", {"least": 1, "of": "Word"}), ("senseTo", "an event names the sense it leads to", {"least": 1, "of": "Sense"}),
        ("driftType", "an event has a type, which is a concept", {"least": 1, "of": "Concept"}), ("hasSource", "an event cites a source", {"least": 1}),
    ),
    *_rules("TriggerEventShape", "TriggerEvent", ("eventDate", "a trigger has a date", {"least": 1}), ("triggerCategory", "a trigger has a category, which is a concept", {"least": 1, "of": "Concept"})),
    *_rules(
        "CausalHypothesisShape", "CausalHypothesis", ("aboutDrift", "a hypothesis is about an event", {"least": 1, "of": "DriftEvent"}), ("proposedTrigger", "a hypothesis proposes a trigger", {"least": 1, "of": "TriggerEvent"}),
        ("evidenceType", "a hypothesis has evidence of a kind that is a concept", {"least": 1, "of": "Concept"}), ("confidence", "a hypothesis has one confidence between 0 and 1", {"least": 1, "most": 1, "low": 0.0, "high": 1.0}), ("hasSource", "a hypothesis cites a source", {"least": 1}),
    ),
]

_YEAR, _SHARE = {"low": 1000.0, "high": 2100.0}, {"low": 0.0, "high": 1.0}
#: The bounds of the node types: required and single values, lengths, ranges.
MODELS = [
    *_rules("WordModel", "Word", ("writtenForm", "one written form that isn't empty", {"least": 1, "most": 1, "length": 1}), ("language", "one language at most", {"most": 1})),
    *_rules("SenseModel", "Sense", ("gloss", "one gloss at most", {"most": 1}), ("connotation", "one connotation at most", {"most": 1}), ("firstAttested", "one year from 1000 to 2100 at most", {"most": 1, **_YEAR})),
    *_rules("DriftEventModel", "DriftEvent", ("affectsWord", "one word", {"least": 1, "most": 1}), ("driftYear", "one year from 1000 to 2100 at most", {"most": 1, **_YEAR}), ("confidence", "one confidence from 0 to 1 at most", {"most": 1, **_SHARE})),
    *_rules("TriggerEventModel", "TriggerEvent", ("label", "one label that isn't empty", {"least": 1, "most": 1, "length": 1}), ("eventDate", "one year from 1000 to 2100 at most", {"most": 1, **_YEAR}), ("triggerCategory", "one category at most", {"most": 1})),
    *_rules("CausalHypothesisModel", "CausalHypothesis", ("aboutDrift", "one event", {"least": 1, "most": 1}), ("proposedTrigger", "one trigger", {"least": 1, "most": 1}), ("confidence", "one confidence from 0 to 1 at most", {"most": 1, **_SHARE})),
    *_rules("FrequencyObservationModel", "FrequencyObservation", ("ofWord", "one word", {"least": 1, "most": 1}), ("observedYear", "one year from 1000 to 2100", {"least": 1, "most": 1, **_YEAR}), ("relativeFrequency", "one frequency that isn't negative", {"least": 1, "most": 1, "low": 0.0})),
]

_OUT = ["shape", "focus", "path", "constraint", "value", "message"]


#: Most classes below those that rules name (the driver holds a hierarchy of them); most rows of what is broadcast.
FEW = 10_000


def subclasses(triples: DataFrame, classes: list[str]) -> dict[str, set[str]]:
    """Each class that is or lies below one of the given ones, over any number of subClassOf steps, with those it lies below; cycles end."""
    steps = triples.where(local_name(F.col("p")) == "subClassOf").select(local_name(F.col("s")).alias("class"), local_name(F.col("o")).alias("next")).distinct()
    found = new = {(c, c) for c in classes}
    while new:
        last = F.broadcast(triples.sparkSession.createDataFrame(sorted(new), "next string, above string"))  # FEW rows at most
        rows = {tuple(r) for r in steps.join(last, "next").select("class", "above").distinct().limit(FEW + 1).collect()}
        new = rows - found
        found = found | new
        if len(found) > FEW:
            raise ValueError(f"more than {FEW} classes below others")
    out: dict[str, set[str]] = {}
    for c, above in found:
        out.setdefault(c, set()).add(above)
    return out


def few(df: DataFrame) -> DataFrame:
    """df, as a table to broadcast if it has FEW rows at most."""
    rows = df.limit(FEW + 1).collect()
    return df if len(rows) > FEW else F.broadcast(df.sparkSession.createDataFrame(rows, df.schema))


def report(triples: DataFrame, rules: list[Rule] | None = None, honest: float | None = 0.66, anchored: bool = True) -> DataFrame:
    """Every violation of the rules (by default of SHAPES); of "a year or an interval" if `anchored`; and, if `honest` is given, of
    "a hypothesis that rests on speculation alone has a confidence below it".

    A value that isn't a number lies outside of both bounds that a rule gives, as such a value compares with none. A table has at
    most FEW classes below those that rules name. A node repeated, or of several classes, is reported once for each rule it breaks.
    """
    rules = SHAPES if rules is None else rules
    t = triples.select("s", local_name(F.col("p")).alias("name"), "o", "kind")
    classes = sorted({r.target for r in rules} | {r.of for r in rules if r.of} | {"DriftEvent", "CausalHypothesis"})
    bit = {c: 1 << i for i, c in enumerate(classes)}
    bits = {c: sum(bit[a] for a in above) for c, above in sorted(subclasses(triples, classes).items())}
    q = lambda x: "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"
    local = "substring_index(substring_index(o, '/', -1), '#', -1)"
    mask = lambda of: f"CASE {local} " + " ".join(f"WHEN {q(c)} THEN {b}L" for c, b in of.items()) + " ELSE 0L END"
    own, is_a = mask(bit), mask(bits)  # a focus node is a member of the very class; a value may be of one below it
    among = lambda names: f"name IN ({', '.join(map(q, sorted(set(names))))})"
    number = "try_cast(ltrim('+', o) AS DOUBLE)"
    facts = lambda rows: F.expr("element_at(array(" + ", ".join("named_struct(" + ", ".join(f"'{n}', CAST({'NULL' if x is None else q(x)} AS STRING)" for n, x in zip(("shape", "path", "constraint", "message"), row, strict=True)) + ")" for row in rows) + "), i)")
    those = lambda tests: F.expr("explode(array_compact(array(" + ", ".join(f"IF({c}, {i + 1}, NULL)" for i, c in enumerate(tests)) + ")))").alias("i")

    # a bit for each path that a node has a value of; numbers only where a rule asks for more than that
    asked = {r.path for r in rules if r.least is not None or r.most is not None} | ({"driftYear", "driftInterval"} if anchored else set()) | ({"evidenceType", "confidence"} if honest is not None else set())
    place = {p: 1 << i for i, p in enumerate(sorted(asked))}
    counted = sorted({r.path for r in rules if r.most is not None or (r.least or 0) > 1})
    has = "CASE name WHEN 'type' THEN 0L " + " ".join(f"WHEN {q(p)} THEN {b}L" for p, b in place.items()) + " ELSE 0L END"
    aggs = [f"bit_or(IF(name = 'type', {own}, 0L)) AS own", f"bit_or({has}) AS has", *[f"count_if(name = {q(p)}) AS `n_{p}`" for p in counted]]
    if honest is not None:  # no text in it: the aggregation stays a hash one
        aggs += [f"min(IF(name = 'evidenceType', CAST({local} = 'Speculative' AS INT), NULL)) AS only", f"max(IF(name = 'confidence', {number}, NULL)) AS most"]
    nodes = t.where(among(asked | {"type"})).groupBy(F.col("s").alias("focus")).agg(*map(F.expr, aggs)).where("own <> 0")
    lacks = lambda *names: f"has & {sum(place[n] for n in names)}L = 0"
    broken: list[tuple[str, tuple]] = []
    for r in rules:
        if r.least is not None:
            broken.append((f"own & {bit[r.target]}L <> 0 AND " + (lacks(r.path) if r.least == 1 else f"`n_{r.path}` < {r.least}"), (r.shape, r.path, "minCount", r.message)))
        if r.most is not None:
            broken.append((f"own & {bit[r.target]}L <> 0 AND `n_{r.path}` > {r.most}", (r.shape, r.path, "maxCount", r.message)))
    if anchored:
        broken.append((f"own & {bit['DriftEvent']}L <> 0 AND {lacks('driftYear', 'driftInterval')}", ("DriftEventShape", None, "or", "an event has a year or an interval")))
    if honest is not None:
        broken.append((f"own & {bit['CausalHypothesis']}L <> 0 AND only = 1 AND most >= {honest}", ("CausalHypothesisShape", "confidence", "sparql", f"speculation alone has a confidence below {honest}")))
    most = "CAST(most AS STRING)" if honest is not None else "CAST(NULL AS STRING)"
    if not broken:
        broken.append(("false", ("", "", "", "")))
    out = nodes.select("focus", those([c for c, _ in broken]), F.expr(most).alias("most")).select("focus", "most", facts([row for _, row in broken]).alias("r"))
    out = out.selectExpr("r.shape", "focus", "r.path", "r.constraint", "IF(r.constraint = 'sparql', most, NULL) AS value", "r.message")

    def looked_up(values: DataFrame, rows: list[tuple]) -> DataFrame:
        """focus, i, value -> violations of those that are members of the class that rule i is for."""
        named = ", ".join(map(q, sorted({r[0] for r in rows})))
        kinds = t.where(f"name = 'type' AND {local} IN ({named})").select(F.col("s").alias("focus"), F.expr(own).alias("own"))
        target = "element_at(array(" + ", ".join(f"{bit[r[0]]}L" for r in rows) + "), i)"
        j = kinds.join(values, "focus").where(f"own & {target} <> 0").select("focus", "i", "value").distinct()
        return j.select("focus", "value", facts([r[1:] for r in rows]).alias("r")).selectExpr("r.shape", "focus", "r.path", "r.constraint", "value", "r.message")

    limits = []
    for r in rules:
        for sign, edge, constraint in ((">=", r.low, "minInclusive"), ("<=", r.high, "maxInclusive")):
            if edge is not None:
                limits.append((f"name = {q(r.path)} AND NOT coalesce({number} {sign} {edge}, false)", (r.target, r.shape, r.path, constraint, r.message)))
        if r.length is not None:
            limits.append((f"name = {q(r.path)} AND length(o) < {r.length}", (r.target, r.shape, r.path, "minLength", r.message)))
    if limits:
        off = t.where(among(row[2] for _, row in limits)).select(F.col("s").alias("focus"), those([c for c, _ in limits]), F.col("o").alias("value"))
        out = out.unionByName(looked_up(few(off), [row for _, row in limits]))
    wanted = [r for r in rules if r.of]
    if wanted:
        # a value that many nodes share is looked up once; only values of a wrong class go back to their nodes
        named = ", ".join(q(c) for c, b in bits.items() if any(b & bit[r.of] for r in wanted))
        members = t.where(f"name = 'type' AND {local} IN ({named})").groupBy(F.col("s").alias("member")).agg(F.expr(f"bit_or({is_a})").alias("kinds"))
        values = t.where(among(r.path for r in wanted)).select("name", "o", F.col("s").alias("focus"))
        wrong = values.select("name", "o").distinct().join(members, F.col("o") == F.col("member"), "left")
        wrong = wrong.select("name", "o", those([f"name = {q(r.path)} AND coalesce(kinds, 0L) & {bit[r.of]}L = 0" for r in wanted]))
        off = values.join(few(wrong), ["name", "o"]).select("focus", "i", F.col("o").alias("value"))
        out = out.unionByName(looked_up(off, [(r.target, r.shape, r.path, "class", r.message) for r in wanted]))
    return out.select(*_OUT)


def summary(found: DataFrame) -> DataFrame:
    """shape, path, constraint, n."""
    return found.groupBy("shape", "path", "constraint").agg(F.count(F.lit(1)).alias("n"))
