"""Personal data: labelers vote on candidate spans, expectation-maximisation weighs them, a classifier trained on its verdicts decides.

1. Candidates of a text are the strict matches of four kinds (e-mail and IP addresses, card and telephone numbers) and looser ones: addresses
   written with "at" and "dot" or brackets, IP addresses with such dots, card numbers with other separators or among other
   digits, telephone numbers without "+", and strict shapes whose check fails.
2. Seven labelers vote for, against or not at all: the strict expression, a check, a gazetteer, words before the span, grouping,
   what stands right beside it, how varied it is.
3. Votes of all candidates of all documents are counted by pattern (at most 3^7 a kind), and expectation-maximisation over
   these counts gives each labeler's reliability in both classes and each pattern's probability of being personal data.
4. A logistic model of hashed features (votes, shapes, words around) learns these probabilities from at most SAMPLE candidates of a kind, those
   with the least hashes.
5. It scores every loose candidate of every document; those at THRESHOLD or more are added. Strict ones stay whatever it says.

Every expression consumes what it has read, or looks a bounded way around a mark, so a text takes time in proportion to its length. Texts are read twice and never shuffled.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import columns_free, stored, table

KINDS = ("email", "ip", "card", "phone")
LABELERS = 7
#: Most candidates of a kind that the classifier is trained on; probability from which a span is added; hashed features.
SAMPLE, THRESHOLD, WIDTH = 5000, 0.5, 1 << 14

#: Endings of host names, beginnings and lengths of card numbers, calling codes, telling words.
ENDINGS = frozenset("com org net edu gov mil int info biz io ai dev app co me tv eu uk de fr es it nl be ch at se no dk fi pl cz pt ie ru ua cn jp kr in au nz br mx ar za ca us example test local".split())
CARDS = ((r"4", (13, 16, 19)), (r"5[1-5]|2[2-7]", (16,)), (r"3[47]", (15,)), (r"6011|65|64[4-9]", (16, 19)), (r"35", (16,)), (r"3[0689]", (14,)), (r"62", (16, 17, 18, 19)))
CALLING = frozenset("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())
WORDS_FOR = {
    "email": frozenset("mail email e-mail contact write reach address kontakt correo courriel".split()),
    "ip": frozenset("ip ipv4 host server address addr client login from dns gateway".split()),
    "card": frozenset("card visa mastercard amex credit debit payment cc karte tarjeta carte".split()),
    "phone": frozenset("tel phone telephone call mobile cell fax whatsapp sms telefon teléfono téléphone".split()),
}
WORDS_AGAINST = frozenset("version release section chapter isbn issn doi order invoice id serial part page pages figure table number score years lines build v".split())

_CARD_START = [(re.compile(p), n) for p, n in CARDS]
_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+(\.[0-9]+\.[0-9]+\.[0-9]+)?")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DOT = r"(?:\s?[\[({<]\s?(?:dot|DOT|\.)\s?[\])}>]\s?|\s(?:dot|DOT)\s)"
_AT = re.compile(r"[\[({<\s]\s?(?:at|AT|@)\s?[\])}>\s]\s?")
_HOST = re.compile(rf"[A-Za-z0-9-]{{1,63}}(?:(?:{_DOT}|\.)[A-Za-z0-9-]{{1,63}}){{1,6}}")
_LOOSE_IP = re.compile(rf"[0-9]{{1,3}}(?:{_DOT}[0-9]{{1,3}}){{3}}")
_LOOSE_CARD = re.compile(r"[0-9]{4}(?:[._/ ][0-9]{4}){3}")
_LOOSE_PHONE = re.compile(r"[0-9]{2,5}\)?[ ./-]?[0-9]{2,4}[ ./-][0-9]{2,4}(?:[ ./-][0-9]{2,4}){0,2}")
_WORD = re.compile(r"[^\W\d_][\w-]*")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _small(part: str) -> bool:
    """A number of at most 255, whatever zeros it begins with."""
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def strict(t: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(kind, start, end) of the four expressions' leftmost matches: those that pass their checks, those that fail."""
    good, bad = [], []
    done, at = 0, t.find("@")
    while at >= 0:  # local parts hold no "@", so each one ends a match or none
        if m := _DOMAIN.match(t, at):
            start = at
            while start > done and t[start - 1] in _LOCAL:
                start -= 1
            if start < at:
                good.append((0, start, m.end()))
                done = m.end()
        at = t.find("@", max(done, at + 1))
    for m in _IP.finditer(t):
        if m[1]:
            (good if all(map(_small, m[0].split("."))) else bad).append((1, m.start(), m.end()))
    for m in _CARD.finditer(t):
        d = _digits(m[0])
        if len(d) >= 13:
            (good if len(d) <= 19 and luhn(d) else bad).append((2, m.start(), m.end()))
    at = t.find("+")
    while at >= 0:
        end = at + 1
        if m := _PHONE.match(t, at):
            end = m.end()
            (good if 9 <= len(_digits(m[0])) <= 15 else bad).append((3, at, end))
        at = t.find("+", end)
    return good, bad


def loose(t: str, good: list[tuple[int, int, int]], bad: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Further candidates, none of which meets a strict match of any kind."""
    found = list(bad)
    for m in _AT.finditer(t):
        start = end = m.start() - (m[0][0] in "[({<" and t[m.start() - 1 : m.start()].isspace())
        while start > 0 and end - start < 64 and t[start - 1] in _LOCAL:
            start -= 1
        if start < end and (h := _HOST.match(t, m.end())):
            found.append((0, start, h.end()))
    for k, pattern in ((1, _LOOSE_IP), (2, _LOOSE_CARD)):
        found += [(k, m.start(), m.end()) for m in pattern.finditer(t)]
    for _, a, z in [b for b in bad if b[0] == 2]:  # a card among other digits: whole groups that make one up
        groups = [(a + m.start(), a + m.end()) for m in re.finditer("[0-9]+", t[a:z])]
        for i in range(len(groups)):
            for j in range(i, min(i + 5, len(groups))):
                d = _digits(t[groups[i][0] : groups[j][1]])
                if (j - i) < len(groups) - 1 and 13 <= len(d) <= 19 and luhn(d) and network(d):
                    found.append((2, groups[i][0], groups[j][1]))
    for m in _LOOSE_PHONE.finditer(t):
        a, z = m.start() - (t[m.start() - 1 : m.start()] == "("), m.end()
        beside = t[max(0, a - 2) : a] + "|" + t[z : z + 2]
        if 7 <= len(_digits(m[0])) <= 15 and not re.search(r"[0-9][ ./-]?\||\w\||\+\||\|\w|\|[ ./-][0-9]", beside):
            found.append((3, a, z))
    taken = sorted((a, z) for _, a, z in good)
    starts = [a for a, _ in taken]

    def free(a: int, z: int) -> bool:
        from bisect import bisect_left

        i = bisect_left(starts, z)
        return all(e <= a for _, e in taken[max(0, i - 4) : i])

    return sorted({c for c in found if free(c[1], c[2])})


def network(digits: str) -> bool:
    return any(len(digits) in n and p.match(digits) for p, n in _CARD_START)


def votes(t: str, kind: int, a: int, z: int, base: bool, failed: bool) -> list[int]:
    """-1, 0 or 1 of each labeler. What decoys have as well (a bounded, varied run of digits) speaks against a span where it lacks, not for it."""
    s, name = t[a:z], KINDS[kind]
    d = _digits(s)
    groups = [len(g) for g in re.findall("[0-9]+", s)]
    if name == "email":
        labels = re.split(rf"{_DOT}|\.", s)
        last = labels[-1]
        check = 1 if 2 <= len(last) <= 24 and last.isalpha() else -1
        known = 1 if last.lower() in ENDINGS else -1
        odd = bool(re.search(r"[\[({<]", s)) or bool(re.search(r"\s(?:dot|DOT)\s", s))
        grouping = 1 if odd else -1 if re.search(r"\s(?:at|AT)\s", s) else 0
        varied = 0 if len(s) >= 8 else -1
    elif name == "ip":
        numbers = [int(g[:9]) for g in re.findall("[0-9]+", s)]
        check = 1 if all(n <= 255 for n in numbers) else -1
        known = -1 if max(numbers) <= 20 or numbers[0] == 0 else 1
        grouping = -1 if any(g > 1 and x.startswith("0") for g, x in zip(groups, re.findall("[0-9]+", s), strict=True)) else 0
        varied = 0 if len(set(numbers)) > 1 else -1
    elif name == "card":
        check = 1 if 13 <= len(d) <= 19 and luhn(d) else -1
        known = 1 if network(d) else -1
        grouping = 0 if len(groups) == 1 else 1 if groups in ([4, 4, 4, 4], [4, 6, 5], [4, 4, 4, 1], [4, 4, 4, 4, 3]) else -1
        varied = 0 if len(set(d)) >= 4 else -1
    else:
        check = 1 if 9 <= len(d) <= 15 else 0 if len(d) >= 7 else -1
        known = 1 if s.startswith("+") and any(d.startswith(c) for c in CALLING) else -1 if s.startswith("+") else 1 if s[0] in "0(" else 0
        grouping = 1 if "(" in s or s.startswith("+") else 1 if len(set(re.findall(r"[ ./-]", s))) == 1 and groups[-1] >= 3 else -1
        varied = 0 if len(set(d)) >= 3 else -1
    said = [w.lower() for w in _WORD.findall(t[max(0, a - 32) : a])]
    context = 1 if WORDS_FOR[name].intersection(said) else -1 if WORDS_AGAINST.intersection(said[-2:]) else 0
    beside = t[a - 1 : a] + " " + t[z : z + 1] if a else " " + t[z : z + 1]
    bounded = -1 if re.search(r"\w", beside) or re.search(r"[=#/\\]", t[max(0, a - 1) : a]) else 0
    return [1 if base else -1 if failed else 0, check, known, context, grouping, bounded, varied]


def _hash(*x) -> int:
    return int.from_bytes(blake2b("\x1f".join(map(str, x)).encode("utf-8", "surrogatepass"), digest_size=4).digest(), "little") % WIDTH


def features(t: str, kind: int, a: int, z: int, v: list[int]) -> list[int]:
    """Hashed features: votes, the span's shape and its pieces, words on either side."""
    s = t[a : min(z, a + 200)]
    shape = re.sub(r"[0-9]", "9", re.sub(r"[^\W\d_]+", "a", s))
    left, right = _WORD.findall(t[max(0, a - 24) : a])[-2:], _WORD.findall(t[z : z + 24])[:1]
    out = [_hash(kind), _hash(kind, "shape", shape), _hash(kind, "n", min(z - a, 64) // 4)]
    out += [_hash(kind, "v", i, x) for i, x in enumerate(v)]
    out += [_hash(kind, "g", g) for g in {shape[i : i + 3] for i in range(max(1, len(shape) - 2))}]
    return out + [_hash(kind, "w", w.lower()) for w in left + right]


@dataclass(frozen=True)
class Candidate:
    kind: int
    start: int
    end: int
    base: bool
    votes: list[int]


def candidates(t: str) -> list[Candidate]:
    good, bad = strict(t)
    failed = set(bad)
    found = [Candidate(k, a, z, True, votes(t, k, a, z, True, False)) for k, a, z in good]
    return found + [Candidate(k, a, z, False, votes(t, k, a, z, False, (k, a, z) in failed)) for k, a, z in loose(t, good, bad)]


def pattern(v: list[int]) -> int:
    return sum((x + 1) * 3**i for i, x in enumerate(v))


def reliabilities(counts: dict[tuple[int, int], int], rounds: int = 200) -> tuple[dict[tuple[int, int], float], dict[int, np.ndarray]]:
    """Probability of each (kind, pattern) and each kind's (class, labeler, vote) table, by expectation-maximisation over all counts.

    Votes are independent within a class. Prior counts, 100 for each class and labeler, say that votes are right rather than wrong.
    """
    prob, tables = {}, {}
    prior = 100 * np.array([[0.55, 0.3, 0.15], [0.15, 0.3, 0.55]])  # by class, by vote -1, 0, 1
    for kind in sorted({k for k, _ in counts}):
        pats = sorted(p for k, p in counts if k == kind)
        n = np.array([counts[kind, p] for p in pats], float)
        v = np.array([[p // 3**i % 3 for i in range(LABELERS)] for p in pats])
        y = 1 / (1 + np.exp(-1.5 * (v - 1).sum(1)))
        for _ in range(rounds):
            w = np.stack([n * (1 - y), n * y])
            table_ = prior[:, None, :] + np.stack([[[w[c][v[:, l] == x].sum() for x in range(3)] for l in range(LABELERS)] for c in range(2)])
            table_ /= table_.sum(2, keepdims=True)
            share = (w[1].sum() + 1) / (n.sum() + 2)
            logs = np.log(table_)[:, np.arange(LABELERS)[None, :], v].sum(2)
            new = 1 / (1 + np.exp(np.clip(logs[0] - logs[1] + math.log((1 - share) / share), -500, 500)))
            done = np.abs(new - y).max() < 1e-9
            y = new
            if done:
                break
        prob |= {(kind, p): float(q) for p, q in zip(pats, y, strict=True)}
        tables[kind] = table_
    return prob, tables


def train(rows: list[list[int]], target: np.ndarray, rounds: int = 300) -> np.ndarray:
    """Weights of a logistic model with soft targets, by full-batch Adam; the last one is the constant."""
    w = np.zeros(WIDTH + 1)
    if not len(rows):
        return w
    at = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    flat = np.fromiter((x for r in rows for x in r), np.int64)
    m, s = np.zeros_like(w), np.zeros_like(w)
    for i in range(1, rounds + 1):
        score = np.bincount(at, w[flat], minlength=len(rows)) + w[-1]
        gap = (1 / (1 + np.exp(-np.clip(score, -30, 30))) - target) / len(rows)
        g = np.append(np.bincount(flat, gap[at], minlength=WIDTH), gap.sum()) + 1e-6 * w
        m, s = 0.9 * m + 0.1 * g, 0.999 * s + 0.001 * g * g
        w = w - 0.05 * (m / (1 - 0.9**i)) / (np.sqrt(s / (1 - 0.999**i)) + 1e-8)
    return w


_SEEN = "array<struct<kind:int,at:int,base:boolean,pattern:int,features:array<int>>>"
_SPANS = "array<struct<kind:string,start:int,end:int,base:boolean,score:double>>"


def _lists(counts: list[int], fields: list[pa.Array], names: list[str]) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)), pa.int32()), pa.StructArray.from_arrays(fields, names))


def _texts(column: pa.Array) -> Iterator[str]:
    return (x.as_py() or "" for x in column)


def _seen(text: pa.Array) -> pa.Array:
    """Every candidate's votes and features."""
    n, cols = [], ([], [], [], [], [])
    for t in _texts(text):
        found = candidates(t)
        n.append(len(found))
        for c in found:
            for col, x in zip(cols, (c.kind, c.start, c.base, pattern(c.votes), features(t, c.kind, c.start, c.end, c.votes)), strict=True):
                col.append(x)
    types = [pa.int32(), pa.int32(), pa.bool_(), pa.int32(), pa.list_(pa.int32())]
    return _lists(n, [pa.array(c, k) for c, k in zip(cols, types, strict=True)], ["kind", "at", "base", "pattern", "features"])


def _finder(weights: np.ndarray, threshold: float):
    def run(text: pa.Array) -> pa.Array:
        n, cols = [], ([], [], [], [], [])
        for t in _texts(text):
            kept: list[tuple] = []
            for c in candidates(t):
                score = weights[features(t, c.kind, c.start, c.end, c.votes)].sum() + weights[-1]
                p = float(1 / (1 + np.exp(-np.clip(score, -30, 30))))
                if c.base or p >= threshold:
                    kept.append((c.kind, c.start, c.end, c.base, p))
            # of added spans that meet, the likeliest stays, then the longest, then the first
            own: list[tuple] = [k for k in kept if k[3]]
            for k in sorted((k for k in kept if not k[3]), key=lambda k: (-k[4], k[1] - k[2], k[1], k[0])):
                if all(k[2] <= o[1] or o[2] <= k[1] for o in own):
                    own.append(k)
            own.sort()
            n.append(len(own))
            for k in own:
                for col, x in zip(cols, (KINDS[k[0]], *k[1:]), strict=True):
                    col.append(x)
        types = [pa.string(), pa.int32(), pa.int32(), pa.bool_(), pa.float64()]
        return _lists(n, [pa.array(c, k) for c, k in zip(cols, types, strict=True)], ["kind", "start", "end", "base", "score"])

    return run


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    probability: dict[tuple[int, int], float]
    tables: dict[int, np.ndarray]


def fit(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", sample: int = SAMPLE) -> Model:
    """Labelers' reliabilities from the votes on all candidates of all texts, and the classifier from at most `sample` of each kind.

    Null and empty texts have no candidates; a corpus without any gives a model that adds nothing.
    """
    seen = docs.select(F.col(doc_id).alias("doc_id"), F.explode(F.arrow_udf(_seen, _SEEN)(F.col(text).cast("string"))).alias("c")).select("doc_id", "c.*")
    seen = stored(seen, "private-candidates")
    counts = {(r["kind"], r["pattern"]): r["count"] for r in seen.groupBy("kind", "pattern").count().collect()}  # at most 3^7 patterns a kind
    prob, tables = reliabilities(counts)
    rows, target = [], []
    for kind in range(len(KINDS)):
        own = seen.where(F.col("kind") == kind).withColumn("h", F.xxhash64("doc_id", "kind", "at", "pattern", "features"))
        for r in own.orderBy("h", "doc_id", "at").limit(sample).select("pattern", "features").collect():  # `sample` rows at most
            rows.append(r["features"])
            target.append(prob[kind, r["pattern"]])
    w = train(rows, np.array(target))
    if not rows:
        w[-1] = -30.0
    return Model(w, prob, tables)


def find(docs: DataFrame, model: Model, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs and `spans`: of each text all strict matches and what the classifier adds, as (kind, start, end, base, score), by kind and then
    start; code points, end exclusive. Added spans meet no other span. Null and empty texts have none; a column `spans` moves aside to spans_in."""
    docs = columns_free(docs, "spans")
    return docs.withColumn("spans", F.arrow_udf(_finder(model.weights, threshold), _SPANS)(F.col(text).cast("string")))


def redacted(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind in brackets. Of spans that meet the first in place counts."""
    order = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    begin = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    go = lambda acc, s: F.when(s["start"] < acc["at"], acc).otherwise(F.struct(F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit("["), s["kind"], F.lit("]")).alias("out"), s["end"].alias("at")))
    return F.aggregate(order, begin, go, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))


def op11_private(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = stored(find(docs, fit(docs)).drop("text"), "private-spans")
    shown = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["base"])
    own = lambda k: F.size(F.filter(base, lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    counts = [own(k) for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(shown(base).cast("binary"), 256).alias("base_sha256"), shown(F.col("spans")).alias("spans"))
