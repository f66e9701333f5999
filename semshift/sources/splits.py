"""Big Turtle files in parallel: blocks of lines, cut at statement ends.

Spark's text reader deals a file in blocks of bytes and hands out whole lines, so any file system will do. At the start of a line only
two things may be open, a long string of either quote; so a block is scanned for each of the three states it may be entered in, and the
scans' results compose, in order of the blocks, to each block's entry state and the prefixes declared before it. A block then parses the
statements between its first and its last cut (a line at whose end a statement ends); what is before and behind them goes to a second,
small job that joins it with its neighbours'.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: States at the start of a line: nothing is open, a long string of double or of single quotes is.
PLAIN, DOUBLE, SINGLE = 0, 1, 2
#: What a line is made of, as far as it matters: strings and IRIs are skipped whole.
_PIECE = re.compile(r"""<[^\x00-\x20<>"{}|^`]*>|(?P<double>\"\"\")|(?P<single>''')|"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*'|(?P<comment>\#.*)|(?P<end>\.(?=\s|$|\#))|\\.|[^\s<"'#.\\]+|\S""", re.S)
_CLOSE = {DOUBLE: re.compile(r'(?:[^"\\]|\\.|"{1,2}(?!"))*?"""', re.S), SINGLE: re.compile(r"(?:[^'\\]|\\.|'{1,2}(?!'))*?'''", re.S)}
_DIRECTIVE = re.compile(r"\s*(?:@prefix|@base|prefix|base)\b", re.I)
#: A table of blocks up to this many rows is broadcast; beyond it lines are joined with theirs by shuffling.
FEW = 50_000


def line_end(line: str, state: int) -> tuple[int, bool]:
    """The state after a line entered in that state, and whether a statement ends with the line."""
    at, ended = 0, False
    while True:
        if state != PLAIN:
            m = _CLOSE[state].match(line, at)
            if m is None:
                return state, False
            at, state, ended = m.end(), PLAIN, False
        m = _PIECE.search(line, at)
        if m is None:
            return PLAIN, ended
        at = m.end()
        if m.lastgroup in ("double", "single"):
            state = DOUBLE if m.lastgroup == "double" else SINGLE
        elif m.lastgroup != "comment":
            ended = m.lastgroup == "end"


def scan(lines: list[str], state: int) -> tuple[int, list[tuple[int, str]], int, int]:
    """Exit state, directives (the line each ends with, its text), first and last cut (numbers of lines; 0 and 0 if there is none).

    A directive counts if it begins a statement on a line of its own, as it does behind a cut, another directive or a comment.
    """
    said: list[tuple[int, str]] = []
    first = last = 0
    fresh = state == PLAIN
    held: list[str] | None = None
    for i, line in enumerate(lines):
        begins = fresh and state == PLAIN
        state, ended = line_end(line, state)
        if held is None and begins and _DIRECTIVE.match(line):
            held = []
        if held is not None:
            held.append(line)
            sparql = not held[0].lstrip().startswith("@")
            if ended or sparql and "<" in line and state == PLAIN:
                said.append((i + 1, "\n".join(held)))
                held, ended = None, True
        if ended and state == PLAIN:
            first, last = first or i + 1, i + 1
        bare = line.strip()
        fresh = ended or fresh and (not bare or bare.startswith("#"))
    return state, said, first, last


def _blocks(parts: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, list[str], int | None, str | None]]:
    """(file, block, lines, entry, header) of consecutive rows (file, block, value[, entry, header])."""
    at, lines, extra = None, [], (None, None)
    for b in parts:
        cols = [b.column(i).to_pylist() for i in range(b.num_columns)]
        for i in range(b.num_rows):
            key = (cols[0][i], cols[1][i])
            if key != at:
                if at is not None:
                    yield (*at, lines, *extra)
                at, lines = key, []
                extra = (cols[3][i], cols[4][i]) if len(cols) > 3 else (None, None)
            lines.append(cols[2][i])
    if at is not None:
        yield (*at, lines, *extra)


def _scanned(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for file, block, lines, _, _ in _blocks(parts):
        found = []
        for state in (PLAIN, DOUBLE, SINGLE):
            mark = '"""' if state == DOUBLE else "'''"
            found.append(scan(lines, state) if state == PLAIN or any(mark in x for x in lines) else (state, [], 0, 0))
        yield pa.RecordBatch.from_arrays(
            [pa.array([file]), pa.array([block], pa.int64()), pa.array([[f[0] for f in found]], pa.list_(pa.int32())), pa.array([["\n".join(d for _, d in f[1]) for f in found]], pa.list_(pa.string()))], ["file", "block", "to", "said"]
        )


def _composed(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of a file in order: entry state and the directives before each. Of a prefix declared again the last one counts."""
    at, state, said = None, PLAIN, {}
    for b in parts:
        for file, block, to, own in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
            if file != at:
                at, state, said = file, PLAIN, {}
            yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([block], pa.int64()), pa.array([state], pa.int32()), pa.array(["\n".join(said.values())])], ["file", "block", "entry", "header"])
            for d in _statements(own[state]):
                name = re.sub(r"\s+", " ", d.lstrip("@ \t\r\n")).split("<")[0].strip().lower() if not d.lstrip("@").lower().startswith("base") else "base"
                said.pop(name, None)
                said[name] = d
            state = to[state]


def _statements(text: str) -> list[str]:
    return [d for d in re.split(r"\n(?=\s*(?:@prefix|@base|prefix|base)\b)", text, flags=re.I) if d.strip()]


def _lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """file, block, value, in order within a block: the lines of files, cut at line feeds alone."""
    t = spark.read.option("lineSep", "\n").text(paths)
    return t.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value", F.monotonically_increasing_id().alias("at"))


def _parser(parsed, kind: str):
    """Of each block either the triples of its statements between the cuts, or the lines outside of them."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for file, block, lines, entry, header in _blocks(parts):
            _, said, first, last = scan(lines, entry)
            start = 0 if block == 0 else first  # a file's first block begins with a statement
            if kind == "triples":
                if last > start:
                    before = "\n".join([header, *[d for i, d in said if i <= start]])
                    yield from parsed(before + "\n" + "\n".join(lines[start:last]), file, block)
                continue
            rows = []
            if last:
                if block and start:
                    rows.append((1, "\n".join(lines[:start])))  # ends what came before
                rows.append((0, "\n".join(lines[last:])))  # begins what comes after
            else:
                rows.append((2 if block else 0, "\n".join(lines)))  # goes on with it
            for ends, text in rows:
                known = "\n".join([header, *[d for _, d in said]]) if ends == 0 else header
                yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([block], pa.int64()), pa.array([ends], pa.int32()), pa.array([known]), pa.array([text])], ["file", "block", "ends", "header", "text"])

    return run


def _joined(parsed):
    """Rests of blocks, in order: what a block leaves open, whole blocks without a cut, and the next block's lines up to its first cut."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, header, first = None, [], "", 0

        def flush() -> Iterator[pa.RecordBatch]:
            if any(h.strip() for h in held):
                yield from parsed(header + "\n" + "\n".join(held), at, -1 - first)

        for b in parts:
            for file, block, ends, head, text in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                if file != at or ends == 0 or not held:
                    if at is not None:
                        yield from flush()
                    at, held, header, first = file, [], head, block
                held.append(text)
                if ends == 1:
                    yield from flush()
                    held = []
        if at is not None:
            yield from flush()

    return run


def read_blocks(spark: SparkSession, paths: list[str], parsed, schema: str) -> DataFrame:
    """Rows that parsed(text, file, block) makes of the statements of big files. `parsed` takes prefixes and whole statements; the block number keeps
    what it names apart: its own for statements within a block, a negative one for those that reach over a block's end.

    A statement that runs over several blocks is held by one task. A prefix holds from where it is declared; directives have lines of their own.
    """
    lines = _lines(spark, paths)
    found = lines.select("file", "block", "value").mapInArrow(_scanned, "file string, block long, to array<int>, said array<string>")
    known = found.repartition("file").sortWithinPartitions("file", "block").mapInArrow(_composed, "file string, block long, entry int, header string").persist()
    j = lines.join(F.broadcast(known) if known.count() <= FEW else known, ["file", "block"])
    j = j.sortWithinPartitions("file", "block", "at").select("file", "block", "value", "entry", "header")
    within = j.mapInArrow(_parser(parsed, "triples"), schema)
    rests = j.mapInArrow(_parser(parsed, "rests"), "file string, block long, ends int, header string, text string")
    # a block's rest behind its last cut comes after the one before its first
    rests = rests.withColumn("turn", F.when(F.col("ends") == 0, 1).otherwise(0)).repartition("file").sortWithinPartitions("file", "block", "turn")
    return within.unionByName(rests.select("file", "block", "ends", "header", "text").mapInArrow(_joined(parsed), schema))
