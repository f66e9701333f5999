"""Turtle files that arrive over time end up as one set of triples."""

from semshift import streaming
from semshift.sources import turtle

HEAD = "@prefix e: <http://e/> . "


def test_files_arrive(spark, tmp_path):
    folder, path, checkpoint = (str(tmp_path / n) for n in ("in", "graph", "checkpoint"))
    (tmp_path / "in").mkdir()
    texts = {"a.ttl": HEAD + 'e:x a e:Word ; e:form "x"@en .', "b.ttl": HEAD + 'e:x a e:Word . e:y e:form "y"@de .', "c.ttl": HEAD + 'e:y e:form "y"@en, "y"@de . e:z e:n 1 .', "bad.ttl": '<http://e/a> <http://e/b> "open'}
    for names in (("a.ttl",), ("b.ttl", "bad.ttl"), ("c.ttl",)):
        for n in names:
            (tmp_path / "in" / n).write_text(texts[n])
        streaming.keep_graph(spark, folder, path, checkpoint, once=True).awaitTermination()
    got = streaming.read_graph(spark, path)
    want = turtle.distinct_triples(turtle.read_turtle(spark, folder))
    key = lambda df: sorted(map(repr, df.select(*turtle.TRIPLE).collect()))
    assert key(got) == key(want) and got.count() == 5
    errors = spark.read.json(f"{path}/{streaming.ERRORS}").collect()
    assert [r.file.rsplit("/", 1)[-1] for r in errors] == ["bad.ttl"]


def test_a_batch_that_runs_again(spark, tmp_path):
    raw = spark.createDataFrame([("f", "http://e/x", "http://e/p", "1", "literal", None, "d", None)], turtle.RAW)
    for _ in range(2):
        streaming.add_triples(raw, 0, str(tmp_path))
    streaming.add_triples(raw, 1, str(tmp_path))
    assert streaming.read_graph(spark, str(tmp_path)).count() == 1


def test_a_new_checkpoint_keeps_what_is_stored(spark, tmp_path):
    """Also after the first file and the first checkpoint are gone."""
    folder, path = tmp_path / "in", str(tmp_path / "graph")
    folder.mkdir()
    for name, checkpoint in (("a", "c1"), ("b", "c2")):
        for old in folder.iterdir():
            old.unlink()
        (folder / f"{name}.ttl").write_text(HEAD + f"e:{name} e:p e:o .")
        streaming.keep_graph(spark, str(folder), path, str(tmp_path / checkpoint), once=True).awaitTermination()
    assert sorted(r.s for r in streaming.read_graph(spark, path).collect()) == ["http://e/a", "http://e/b"]
