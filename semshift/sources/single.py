"""One file out of many parts: rows are written where they are, in order; a commit step joins the parts' bytes and renames the result.

The driver copies streams of bytes and sees no row. Any file system of Spark's will do.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame


def write_single(spark, path: str, pieces: list[str | DataFrame], between: str = ",\n") -> None:
    """A file of the pieces in order: text as it is; a DataFrame (one column of text, in order) as its rows with `between` between them.

    An existing file is replaced when the new one is whole. A failed write leaves no file, and its parts are deleted.
    """
    sc = spark.sparkContext
    jvm = sc._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path
    work = f"{path}.parts-{uuid.uuid4().hex}"
    fs = hadoop(path).getFileSystem(sc._jsc.hadoopConfiguration())
    try:
        for i, p in enumerate(pieces):
            if isinstance(p, DataFrame):
                p.write.option("lineSep", between).text(f"{work}/{i}")
        whole = hadoop(f"{work}/whole")
        out = fs.create(whole, True)
        try:
            for i, p in enumerate(pieces):
                if isinstance(p, str):
                    out.write(p.encode())
                    continue
                files = sorted((str(f.getPath().getName()), f.getPath(), f.getLen()) for f in fs.listStatus(hadoop(f"{work}/{i}")) if str(f.getPath().getName()).startswith("part-"))
                left = sum(n for _, _, n in files) - len(between.encode())  # the last row's `between` stays out
                for _, file, n in files:
                    if (take := min(n, left)) > 0:
                        stream = fs.open(file)
                        try:
                            jvm.org.apache.commons.io.IOUtils.copyLarge(stream, out, 0, take)
                        finally:
                            stream.close()
                    left -= max(0, take)
        finally:
            out.close()
        fs.delete(hadoop(path), True)
        if not fs.rename(whole, hadoop(path)):
            raise OSError(f"{path} can't be written")
    finally:
        fs.delete(hadoop(work), True)
