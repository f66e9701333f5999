"""Scalar functions of the knowledge graph, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The order of the evidence ladder, best first, and of the source and quality facets.
EVIDENCE = ("ScholarlyAttestation", "LexicographicNote", "ChangeSignalAlignment", "FrequencyCorrelation", "Speculative")
SOURCES = ("Curated", "GfdS", "OWID", "DWUG", "SemEval", "Frequency")
QUALITIES = ("high", "benchmark", "detected")
#: Parts of a word's local name that name its source, tried in this order.
SOURCE_MARKS = (("-gfds-", "GfdS"), ("-freq-", "Frequency"), ("-owid-", "OWID"), ("-dwug-", "DWUG"), ("-semeval-", "SemEval"))


def ladder(evidence: Column) -> Column:
    """Rank 5 (scholarly) to 1 (speculative), 0 for anything else."""
    return F.coalesce(*[F.when(evidence == e, F.lit(5 - i)) for i, e in enumerate(EVIDENCE)], F.lit(0))


def local_name(iri: Column) -> Column:
    """What follows the last slash, and of that what follows the last hash."""
    return F.substring_index(F.substring_index(iri, "/", -1), "#", -1)


def source_of(iri: Column, marks: tuple[tuple[str, str], ...] = SOURCE_MARKS) -> Column:
    name = local_name(iri)
    return F.coalesce(*[F.when(name.contains(m), F.lit(s)) for m, s in marks], F.lit("Curated"))


def quality_of(source: Column) -> Column:
    return F.when(source.isin("GfdS", "OWID", "Curated"), "high").when(source.isin("DWUG", "SemEval"), "benchmark").otherwise("detected")


def rank_in(value: Column, order: tuple[str, ...]) -> Column:
    return F.coalesce(*[F.when(value == v, F.lit(i)) for i, v in enumerate(order)], F.lit(99))


def parse_year(text: Column) -> Column:
    """An integer after any leading plus signs; null for anything else. Texts that aren't digits never reach the cast, whose failures are slow."""
    bare = F.ltrim(text, F.lit("+"))
    return F.when(bare.rlike(r"^\s*[+-]?[0-9]+\s*$"), bare.try_cast("int"))


def decade(year: Column) -> Column:
    return (F.floor(year / 10) * 10).cast("int")


def bucket(year: Column) -> Column:
    """Century before 1800, decade from there on."""
    return F.when(year < 1800, F.floor(year / 100) * 100).otherwise(F.floor(year / 10) * 10).cast("int")


def show_year(year: Column) -> Column:
    return F.when(year.isNull(), "?").when(year < 0, F.concat((-year).cast("string"), F.lit(" BC"))).otherwise(year.cast("string"))


def gyear(year: Column) -> Column:
    """At least four digits, with a sign before Christ."""
    digits = F.abs(year).cast("string")
    padded = F.when(F.length(digits) < 4, F.lpad(digits, 4, "0")).otherwise(digits)
    return F.when(year < 0, F.concat(F.lit("-"), padded)).otherwise(padded)


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def local_after(text: Column, mark: str) -> Column:
    """What follows the mark's first place; nothing where it is absent."""
    return F.when(F.contains(text, F.lit(mark)), F.substr(text, F.instr(text, mark) + len(mark))).otherwise("")


#: Parts of evidence labels by rung, weakest first, with the names shown; languages that have a name.
RUNGS = (("speculative", "Speculative"), ("frequency", "FrequencyCorrelation"), ("change-signal", "ChangeSignalAlignment"), ("lexicographic", "LexicographicNote"), ("scholarly", "ScholarlyAttestation"))
LANGUAGES = (("en", "English"), ("de", "German"))


def evidence_rung(text: Column) -> Column:
    """Rung 0 to 4 of the first ladder word that the text holds, whatever its case; -1 for none."""
    t = F.lower(text)
    return F.coalesce(*[F.when(t.contains(k), F.lit(i)) for i, (k, _) in enumerate(RUNGS)], F.lit(-1))


def rung_name(rung: Column) -> Column:
    return F.coalesce(*[F.when(rung == i, F.lit(n)) for i, (_, n) in enumerate(RUNGS)])


def qid(text: Column, anchored: bool = False) -> Column:
    """The first entity number Q..., or the one that ends the text; null for none."""
    found = F.regexp_extract(F.trim(text), r"(Q\d+)\s*$" if anchored else r"(Q\d+)", 1)
    return F.when(found != "", found)


def ordinal(n: Column) -> Column:
    """1st, 2nd, 3rd, 4th, 11th, 21st."""
    end = F.when((F.pmod(n, F.lit(100)) >= 11) & (F.pmod(n, F.lit(100)) <= 13), "th").when(F.pmod(n, F.lit(10)) == 1, "st").when(F.pmod(n, F.lit(10)) == 2, "nd").when(F.pmod(n, F.lit(10)) == 3, "rd").otherwise("th")
    return F.concat(n.cast("string"), end)


def bucket_label(year: Column) -> Column:
    """4th c. BC, 1st c., 18th c., 1990s."""
    b = bucket(year)
    century = F.when(year < 0, F.concat(ordinal((F.abs(b) / 100).cast("int")), F.lit(" c. BC"))).otherwise(F.concat(ordinal((b / 100).cast("int") + 1), F.lit(" c.")))
    return F.when(year < 1800, century).otherwise(F.concat(b.cast("string"), F.lit("s")))


def read_year(text: Column) -> Column:
    """A year as text, whatever zeros lead it, for display: 0387 is 387, -0044 is 44 BC; text that isn't a year stays."""
    y = F.regexp_replace(text, r"^(-?)0+(\d)", "$1$2")
    number = F.regexp_extract(y, r"^\s*([+-]?\d+)", 1).try_cast("int")
    return F.when(text.isNull() | (text == ""), "?").when(number.isNull(), text).otherwise(show_year(number))


def lang_label(code: Column) -> Column:
    return F.coalesce(*[F.when(code == c, F.lit(n)) for c, n in LANGUAGES], code, F.lit("?"))


def pretty_category(category: Column) -> Column:
    """Each word's first letter large."""
    return F.initcap(F.coalesce(F.when(category != "", category), F.lit("uncategorised")))


def percent(share: Column) -> Column:
    return F.concat(F.round(share * 100).cast("int").cast("string"), F.lit("%"))


def csv_field(text: Column) -> Column:
    """Quoted if it holds a quote, a comma or a line end; null is empty."""
    t = F.coalesce(text.cast("string"), F.lit(""))
    return F.when(t.rlike('[",\\r\\n]'), F.concat(F.lit('"'), F.replace(t, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(t)


def turtle_literal(text: Column) -> Column:
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return F.concat(F.lit('"'), text, F.lit('"'))


def fuzzy_score(query: str, label: Column) -> Column:
    """Subsequence score: equal 1000; prefix 800 less the length; else runs earn 10 + 4 x run, less the first place and a fifth of the difference in length; -1 without a match."""
    q, t = query.lower(), F.lower(label)
    if not q:
        return F.lit(0.0)
    state = F.struct(F.lit(0).alias("qi"), F.lit(0).alias("run"), F.lit(0).alias("score"), F.lit(-1).alias("first"))
    chars = F.transform(F.sequence(F.lit(1), F.greatest(F.length(t), F.lit(1))), lambda i: F.struct(i.alias("i"), F.substring(t, i, F.lit(1)).alias("c")))

    def step(a: Column, x: Column) -> Column:
        hit = (a.qi < len(q)) & (x.c == F.substring(F.lit(q), a.qi + 1, F.lit(1)))
        return F.when(hit, F.struct((a.qi + 1).alias("qi"), (a.run + 1).alias("run"), (a.score + 10 + a.run * 4).alias("score"), F.when(a["first"] < 0, x.i - 1).otherwise(a["first"]).alias("first"))).otherwise(F.struct(a.qi.alias("qi"), F.lit(0).alias("run"), a.score.alias("score"), a["first"].alias("first")))

    found = F.aggregate(chars, state, step)
    loose = F.when(found.qi == len(q), found.score - found["first"] - 0.2 * (F.length(t) - len(q))).otherwise(-1.0)
    return F.when(t == q, 1000.0).when(t.startswith(q), 800.0 - F.length(t)).otherwise(loose).cast("double")
