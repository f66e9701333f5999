"""`turtle` and `ntriples` as formats: spark.read.format("turtle"), readStream, and write.format("ntriples").

    register(spark)
    spark.read.format("turtle").load(folder).where("p = 'http://...'")

Files are opened in Python, so paths have to be local or mounted on every executor; `read_turtle` and `read_ntriples` read from any file
system and split big files. A filter on p (= or IN) is taken over by the reader where spark.sql.python.filterPushdown.enabled is set.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path
from urllib.parse import unquote, urlparse

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, EqualTo, Filter, In, InputPartition, WriterCommitMessage

from .turtle import RAW, TRIPLE, _batches, rows_of


def local_path(path: str) -> Path:
    """The path of a file URL or a plain path; ValueError for other file systems."""
    u = urlparse(path)
    if u.scheme not in ("", "file"):
        raise ValueError(f"{path}: this format reads local or mounted paths; read_turtle and read_ntriples read others")
    return Path(unquote(u.path) if u.scheme else path)


def files_of(options: dict, ending: str) -> list[str]:
    """The files below a folder that fit `pathGlobFilter`, by name; or the one that the path names. Hidden ones don't count."""
    top = local_path(options["path"])
    if top.is_file():
        return [str(top)]
    pattern = options.get("pathGlobFilter", f"*.{ending}")
    return sorted(str(f) for f in top.rglob(pattern) if f.is_file() and not f.name.startswith(("_", ".")))


@dataclass
class Files(InputPartition):
    paths: tuple[str, ...]


class Reader(DataSourceReader):
    """Files dealt by size; each is parsed whole. A file that doesn't parse gives one row with its error."""

    def __init__(self, options: dict, ending: str, most: int = 64 << 20) -> None:
        self.options, self.ending, self.most, self.wanted = options, ending, most, None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("p",):
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.wanted = values if self.wanted is None else self.wanted & values
            else:
                yield f

    def partitions(self) -> list[Files]:
        out: list[list[str]] = []
        size = self.most
        for f in files_of(self.options, self.ending):
            n = os.path.getsize(f)
            if size + n > self.most:
                out.append([])
                size = 0
            out[-1].append(f)
            size += n
        return [Files(tuple(p)) for p in out]

    def read(self, partition: Files | None) -> Iterator[pa.RecordBatch]:
        for path in partition.paths if partition else ():
            rows = rows_of(Path(path).read_bytes(), f"file:{path}")
            yield from _batches(rows if self.wanted is None else [r for r in rows if r[2] in self.wanted])


class Stream(DataSourceStreamReader):
    """Files as they arrive, in order of time and name: an offset is the last one read, so a restart goes on behind it. Tasks open the files."""

    def __init__(self, options: dict, ending: str) -> None:
        self.options, self.ending = options, ending

    def _known(self) -> list[tuple[int, str]]:
        return sorted((os.stat(f).st_mtime_ns, f) for f in files_of(self.options, self.ending))

    def initialOffset(self) -> dict:  # noqa: N802
        return {"time": -1, "path": ""}

    def latestOffset(self, *_) -> dict:  # noqa: N802
        known = self._known()
        return {"time": known[-1][0], "path": known[-1][1]} if known else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[Files]:
        low, high = (start["time"], start["path"]), (end["time"], end["path"])
        return [Files((f,)) for at, f in self._known() if low < (at, f) <= high]

    def read(self, partition: Files) -> Iterator[tuple]:
        for path in partition.paths:
            yield from rows_of(Path(path).read_bytes(), f"file:{path}")


@dataclass
class Written(WriterCommitMessage):
    name: str | None


def line_of(row) -> str:
    """A triple as a line of N-Triples."""
    node = lambda x: x if x.startswith("_:") else f"<{x}>"
    if row["kind"] == "literal":
        text = row["o"]
        for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
            text = text.replace(a, b)
        plain = row["datatype"] in (None, "http://www.w3.org/2001/XMLSchema#string")
        o = f'"{text}"' + (f"@{row['lang']}" if row["lang"] else "" if plain else f"^^<{row['datatype']}>")
    else:
        o = row["o"] if row["kind"] == "blank" else f"<{row['o']}>"
    return f"{node(row['s'])} <{row['p']}> {o} .\n"


class Writer(DataSourceWriter):
    """Each task writes a hidden file; the commit shows them all, and with mode overwrite removes what was there before; an abort deletes them."""

    def __init__(self, options: dict, overwrite: bool) -> None:
        self.folder, self.overwrite = local_path(options["path"]), overwrite

    def write(self, iterator: Iterator) -> Written:
        name, f = f"part-{uuid.uuid4().hex}.nt", None
        try:
            for row in iterator:
                if f is None:
                    self.folder.mkdir(parents=True, exist_ok=True)
                    f = open(self.folder / f".{name}", "w", encoding="utf-8", newline="")  # noqa: SIM115
                f.write(line_of(row))
        finally:
            if f is not None:
                f.close()
        return Written(name if f is not None else None)

    def commit(self, messages: list[Written | None]) -> None:
        self.folder.mkdir(parents=True, exist_ok=True)
        if self.overwrite:
            for old in self.folder.glob("part-*.nt"):
                old.unlink()
        for m in messages:
            if m and m.name:
                (self.folder / f".{m.name}").rename(self.folder / m.name)

    def abort(self, messages: list[Written | None]) -> None:
        for m in messages:
            if m and m.name:
                (self.folder / f".{m.name}").unlink(missing_ok=True)


class TurtleSource(DataSource):
    """Rows as `sources.turtle.RAW` says."""

    ending = "ttl"

    @classmethod
    def name(cls) -> str:
        return "turtle"

    def schema(self) -> str:
        return RAW

    def reader(self, schema) -> Reader:
        return Reader(dict(self.options), self.ending)

    def streamReader(self, schema) -> Stream:  # noqa: N802
        return Stream(dict(self.options), self.ending)


class NTriplesSource(TurtleSource):
    """The same for N-Triples, which Turtle includes; and a sink for columns s, p, o, kind, lang, datatype."""

    ending = "nt"

    @classmethod
    def name(cls) -> str:
        return "ntriples"

    def writer(self, schema, overwrite: bool) -> Writer:
        if missing := set(TRIPLE) - set(schema.names):
            raise ValueError(f"columns are missing: {', '.join(sorted(missing))}")
        return Writer(dict(self.options), overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(TurtleSource)
    spark.dataSource.register(NTriplesSource)
