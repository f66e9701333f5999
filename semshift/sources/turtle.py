"""Turtle and N-Triples as sources of triples, and N-Triples and Turtle as sinks.

Files are spread over the executors and parsed there in Arrow batches; the driver sees no triple. A Turtle file up to BIG bytes is
one unit of work; a bigger one is read in blocks that are cut where statements end (splits.py). N-Triples are read line by line with
JVM expressions alone.

A triple is s, p, o, kind ('iri', 'blank', 'literal'), lang, datatype. A file that doesn't parse gives no triple but one
row with its error (a big one a row for each block that doesn't parse); the other files load. Blank nodes are named by file and place, so that reruns agree.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
XSD = "http://www.w3.org/2001/XMLSchema#"
RAW = "file string, s string, p string, o string, kind string, lang string, datatype string, error string"
TRIPLE = ["s", "p", "o", "kind", "lang", "datatype"]

#: Terminals of the W3C grammar of Turtle.
_TOKEN = re.compile(
    r"""(?P<skip>[ \t\r\n]+|\#[^\r\n]*)
    |(?P<iri><(?:[^\x00-\x20<>"{}|^`\\]|\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8})*>)
    |(?P<long>\"\"\"(?:\"{0,2}(?:[^"\\]|\\.))*\"\"\"|'''(?:'{0,2}(?:[^'\\]|\\.))*''')
    |(?P<short>"(?:[^"\\\r\n]|\\.)*"|'(?:[^'\\\r\n]|\\.)*')
    |(?P<at>@[A-Za-z]+(?:-[A-Za-z0-9]+)*)
    |(?P<caret>\^\^)
    |(?P<blank>_:\w(?:[\w\-]|\.+(?=[\w\-]))*)
    |(?P<double>[+-]?(?:\d+\.\d*|\.?\d+)[eE][+-]?\d+)
    |(?P<decimal>[+-]?\d*\.\d+)
    |(?P<integer>[+-]?\d+)
    |(?P<pname>(?:[^\W\d_](?:[\w\-]|\.+(?=[\w\-]))*)?:(?:[\w:\-]|%[0-9A-Fa-f]{2}|\\.|\.+(?=[\w:\-%\\]))*)
    |(?P<word>[A-Za-z]+)
    |(?P<punct>[.;,\[\]()])""",
    re.X | re.S,
)
_ESCAPE = re.compile(r"\\(?:u([0-9A-Fa-f]{4})|U([0-9A-Fa-f]{8})|(.))", re.S)
_CONTROL = {"t": "\t", "b": "\b", "n": "\n", "r": "\r", "f": "\f"}

Term = tuple[str, str, str | None, str | None]  # kind, value, lang, datatype


class TurtleError(ValueError):
    """What is wrong, and in which line."""


def _unescaped(s: str) -> str:
    return s if "\\" not in s else _ESCAPE.sub(lambda m: chr(int(m[1] or m[2], 16)) if m[1] or m[2] else _CONTROL.get(m[3], m[3]), s)


class _Parser:
    """One document. Recursion is as deep as brackets nest."""

    def __init__(self, text: str, name: str, mark: str = ""):
        self.text, self.at, self.prefixes, self.base, self.out = text, 0, {}, "", []
        self.scope, self.mark, self.made = blake2b(name.encode(), digest_size=6).hexdigest(), mark, 0
        self.kind, self.token = "", ""
        self.next()

    def fail(self, what: str):
        raise TurtleError(f"line {self.text.count(chr(10), 0, self.at) + 1}: {what}")

    def next(self) -> None:
        while True:
            if self.at >= len(self.text):
                self.kind, self.token = "end", ""
                return
            m = _TOKEN.match(self.text, self.at)
            if m is None:
                self.fail(f"no token at {self.text[self.at : self.at + 20]!r}")
            self.at = m.end()
            if m.lastgroup != "skip":
                self.kind, self.token = m.lastgroup, m.group()
                return

    def take(self, punct: str) -> bool:
        if self.kind == "punct" and self.token == punct:
            self.next()
            return True
        return False

    def need(self, punct: str) -> None:
        if not self.take(punct):
            self.fail(f"{punct!r} expected, found {self.token!r}")

    def iri(self) -> str:
        token, kind = self.token, self.kind
        if kind == "iri":
            value = _unescaped(token[1:-1])
            if not re.match(r"[A-Za-z][A-Za-z0-9+.\-]*:", value):
                from urllib.parse import urljoin

                value = urljoin(self.base, value)
        elif kind == "pname":
            prefix, _, name = token.partition(":")
            if prefix not in self.prefixes:
                self.fail(f"prefix {prefix!r} is not declared")
            value = self.prefixes[prefix] + re.sub(r"\\(.)", r"\1", name)
        else:
            self.fail(f"IRI expected, found {token!r}")
        self.next()
        return value

    def blank(self) -> Term:
        self.made += 1
        return ("blank", f"_:{self.scope}{self.mark}n{self.made}", None, None)

    def term(self) -> Term:
        kind, token = self.kind, self.token
        if kind in ("iri", "pname"):
            return ("iri", self.iri(), None, None)
        if kind == "blank":
            self.next()
            return ("blank", f"_:{self.scope}x{token[2:]}", None, None)
        if kind in ("long", "short"):
            n = 3 if kind == "long" else 1
            value = _unescaped(token[n:-n])
            self.next()
            if self.kind == "at":
                lang = self.token[1:].lower()
                self.next()
                return ("literal", value, lang, RDF + "langString")
            if self.kind == "caret":
                self.next()
                return ("literal", value, None, self.iri())
            return ("literal", value, None, XSD + "string")
        if kind in ("integer", "decimal", "double"):
            self.next()
            return ("literal", token, None, XSD + kind)
        if kind == "word" and token in ("true", "false"):
            self.next()
            return ("literal", token, None, XSD + "boolean")
        if self.take("["):
            node = self.blank()
            if not self.take("]"):
                self.properties(node)
                self.need("]")
            return node
        if self.take("("):
            items = []
            while not self.take(")"):
                if self.kind == "end":
                    self.fail("collection is not closed")
                items.append(self.term())
            rest: Term = ("iri", RDF + "nil", None, None)
            for item in reversed(items):
                node = self.blank()
                self.out += [(node, RDF + "first", item), (node, RDF + "rest", rest)]
                rest = node
            return rest
        self.fail(f"term expected, found {token!r}")

    def properties(self, subject: Term) -> None:
        while True:
            if self.kind == "word" and self.token == "a":
                self.next()
                p = RDF + "type"
            else:
                p = self.iri()
            while True:
                self.out.append((subject, p, self.term()))
                if not self.take(","):
                    break
            if not self.take(";"):
                return
            while self.take(";"):
                pass
            if self.kind == "end" or self.kind == "punct" and self.token in ".]":
                return

    def directive(self) -> bool:
        word = self.token.lstrip("@").lower() if self.kind in ("at", "word") else ""
        if word not in ("prefix", "base"):
            return False
        dotted = self.kind == "at"
        self.next()
        if word == "base":
            self.base = self.iri()
        else:
            if self.kind != "pname" or not self.token.endswith(":"):
                self.fail(f"prefix expected, found {self.token!r}")
            prefix = self.token[:-1]
            self.next()
            self.prefixes[prefix] = self.iri()
        if dotted:
            self.need(".")
        return True

    def run(self) -> list:
        while self.kind != "end":
            if self.directive():
                continue
            nested = self.kind == "punct" and self.token == "["
            subject = self.term()
            if subject[0] == "literal":
                self.fail("a literal cannot be a subject")
            if not (nested and self.kind == "punct" and self.token == "."):
                self.properties(subject)
            self.need(".")
        return self.out


def parse(text: str, name: str = "", mark: str = "") -> list[tuple[Term, str, Term]]:
    """The triples of one Turtle document, in order; TurtleError where it doesn't follow the grammar. Blank nodes without a label are told apart by `mark` as well."""
    return _Parser(text.removeprefix("\ufeff"), name, mark).run()


#: Bytes from which a file is read in blocks.
BIG = 64 << 20


def rows_of(text: str | bytes, file: str, mark: str = "") -> list[tuple]:
    """Rows as RAW says: a document's triples, or one row with its error."""
    try:
        return [(file, s[1], p, o[1], o[0], o[2], o[3], None) for s, p, o in parse(text.decode("utf-8") if isinstance(text, bytes) else text, file, mark)]
    except (TurtleError, UnicodeDecodeError, RecursionError) as e:
        return [(file, *[None] * 6, str(e) or type(e).__name__)]


def _batches(found: list[tuple]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([(c.split()[0], pa.string()) for c in RAW.split(", ")])
    for i in range(0, len(found), 10_000):
        cols = zip(*found[i : i + 10_000], strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in cols], schema=schema)


def _parsed(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in parts:
        for path, content in zip(b.column(0), b.column(1), strict=True):
            yield from _batches(rows_of(content.as_py(), path.as_py()))


def _block(text: str, file: str, block: int) -> Iterator[pa.RecordBatch]:
    yield from _batches(rows_of(text, file, f"b{block}".replace("-", "r")))


def read_turtle(spark: SparkSession, *paths: str, pattern: str = "*.ttl", big: int = BIG) -> DataFrame:
    """All files of the folders, below them too. Rows as RAW says; those with an error stand for a whole file, or a block of a big one."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(list(paths))
    small = files.where(F.col("length") <= big).select("path", "content").mapInArrow(_parsed, RAW)
    large = [r["path"] for r in files.where(F.col("length") > big).select("path").collect()]  # names of big files, as the listing has them
    if not large:
        return small
    from .splits import read_blocks

    return small.unionByName(read_blocks(spark, large, _block, RAW))


def failed(raw: DataFrame) -> DataFrame:
    return raw.where("error is not null").select("file", "error")


def distinct_triples(raw: DataFrame) -> DataFrame:
    """A set of triples: repeated ones, within a file or between files, count once."""
    return raw.where("s is not null").select(*TRIPLE).dropDuplicates()


#: Where an escape begins: behind no backslash, or behind pairs of them.
_OPEN = r"(?<=(?<!\\)(?:\\\\){0,40})"


def _plain(c: Column) -> Column:
    """N-Triples escapes undone: those of eight digits by decoding them, the rest as JSON has them."""
    short = F.regexp_replace(c, _OPEN + r"\\U0000([0-9A-Fa-f]{4})", r"\\u$1")
    wide = F.split(F.regexp_replace(short, _OPEN + r"\\'", "'"), _OPEN + r"(?=\\U[0-9A-Fa-f]{8})")
    one = lambda x: F.when(x.startswith("\\U"), F.concat(F.decode(F.unhex(F.substring(x, 3, 8)), "UTF-32"), F.substring(x, 11, 1 << 30))).otherwise(x)
    json = F.concat(F.lit('{"v":"'), F.array_join(F.transform(wide, one), ""), F.lit('"}'))
    return F.when(c.contains("\\"), F.from_json(json, "v string")["v"]).otherwise(c)


#: subject, predicate, object: IRI, blank node or literal with language or data type.
_LINE = r'^\s*(<[^>]*>|_:\S+)\s*<([^>]*)>\s*(?:<([^>]*)>|(_:\S+)|"((?:[^"\\]|\\.)*)"(?:@([A-Za-z0-9-]+)|\^\^<([^>]*)>)?)\s*\.\s*(?:#.*)?$'


def read_ntriples(spark: SparkSession, *paths: str) -> DataFrame:
    """Splittable and JVM-side. Rows as RAW says; a line that is neither a triple, a comment nor blank is an error row."""
    lines = spark.read.text(list(paths)).select(F.col("_metadata.file_path").alias("file"), "value").where(~F.trim("value").startswith("#") & (F.trim("value") != ""))
    g = lambda i: F.regexp_extract("value", _LINE, i)
    ok = F.col("value").rlike(_LINE)
    kind = F.when(g(3) != "", "iri").when(g(4) != "", "blank").otherwise("literal")
    iri = F.when(g(1).startswith("<"), F.substring(g(1), F.lit(2), F.length(g(1)) - 2)).otherwise(g(1))
    lang = F.when(g(6) != "", F.lower(g(6)))
    named = F.when(g(7) != "", g(7)).when(lang.isNotNull(), RDF + "langString").otherwise(XSD + "string")
    cols = {
        "s": iri, "p": g(2), "o": F.when(g(3) != "", g(3)).when(g(4) != "", g(4)).otherwise(_plain(g(5))), "kind": kind,
        "lang": lang, "datatype": F.when(kind == "literal", named),
    }
    return lines.select("file", *[F.when(ok, c).alias(n) for n, c in cols.items()], F.when(~ok, F.concat(F.lit("not a triple: "), "value")).alias("error"))


def escaped(c: Column) -> Column:
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def _object() -> Column:
    text = F.concat(F.lit('"'), escaped(F.col("o")), F.lit('"'))
    typed = F.when(F.col("lang").isNotNull(), F.concat(text, F.lit("@"), "lang")).when(F.coalesce("datatype", F.lit(XSD + "string")) == XSD + "string", text)
    return F.when(F.col("kind") == "iri", F.concat(F.lit("<"), "o", F.lit(">"))).when(F.col("kind") == "blank", F.col("o")).otherwise(F.coalesce(typed, F.concat(text, F.lit("^^<"), "datatype", F.lit(">"))))


def _subject() -> Column:
    return F.when(F.col("s").startswith("_:"), F.col("s")).otherwise(F.concat(F.lit("<"), "s", F.lit(">")))


def ntriples(triples: DataFrame) -> DataFrame:
    """line: one for each triple."""
    return triples.select(F.concat(_subject(), F.lit(" <"), "p", F.lit("> "), _object(), F.lit(" .")).alias("line"))


def write_ntriples(triples: DataFrame, path: str) -> None:
    ntriples(triples).write.text(path)


def turtle_blocks(triples: DataFrame) -> DataFrame:
    """s, block: one Turtle statement for each subject, predicates and objects in order. A subject's triples meet in one row."""
    po = F.struct(F.concat(F.lit("<"), "p", F.lit(">")).alias("p"), _object().alias("o"))
    g = triples.groupBy(_subject().alias("s")).agg(F.array_sort(F.collect_set(po)).alias("po"))
    body = F.array_join(F.transform("po", lambda x: F.concat_ws(" ", x["p"], x["o"])), " ;\n    ")
    return g.select("s", F.concat_ws(" ", "s", F.concat(body, F.lit(" ."))).alias("block"))


def write_turtle(triples: DataFrame, path: str) -> None:
    turtle_blocks(triples).select("block").write.text(path)
