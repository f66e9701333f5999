"""Whole documents and tables as single files; Turtle and N-Triples as formats."""

import json

import pytest

from semshift.operators import document as d
from semshift.sources import datasource, exports, single, turtle
from semshift.sources.lens import Entities


@pytest.fixture(scope="module")
def e(spark):
    return Entities(spark, "/root/testdata/sf0.001")


@pytest.mark.parametrize("which", ["core", "detail"])
def test_a_document_is_one_file(e, tmp_path, which):
    path = tmp_path / f"{which}.json"
    path.write_text("old")
    d.write_document(e, str(path), which)
    got = json.loads(path.read_text())
    want = json.loads(json.dumps(d.single_document(e, which), default=str))
    assert list(tmp_path.iterdir()) == [p for p in tmp_path.iterdir() if p.name in (path.name, f".{path.name}.crc")]
    assert set(got) == set(want)
    for k in want:
        assert got[k] == want[k], k


def test_words_are_one_file(e, spark, tmp_path):
    exports.write_csv_words_file(e, str(tmp_path / "words.csv"))
    exports.write_csv_words(e, str(tmp_path / "folder"))
    raw = (tmp_path / "words.csv").read_bytes()
    lines = raw.decode("utf-8-sig").split("\r\n")
    assert raw.startswith(b"\xef\xbb\xbf") and lines[0] == ",".join(exports.WORD_COLUMNS) and lines[-1] == ""
    parts = [x for p in sorted((tmp_path / "folder").glob("part-*")) for x in p.read_bytes().decode("utf-8-sig").split("\r\n") if x and x != lines[0]]
    assert lines[1:-1] == parts
    single.write_single(spark, str(tmp_path / "empty"), ["[", spark.createDataFrame([], "line string"), "]"])
    assert (tmp_path / "empty").read_text() == "[]"


def test_formats(spark, tmp_path):
    datasource.register(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    (tmp_path / "in/sub").mkdir(parents=True)
    (tmp_path / "in/a.ttl").write_text('@prefix e: <http://e/> . e:a e:p "x\\n\\"y\\""@en , 1.5 ; e:q [ e:p e:b ] .')
    (tmp_path / "in/sub/b.ttl").write_text("@prefix e: <http://e/> . e:c e:p e:d .")
    (tmp_path / "in/bad.ttl").write_text("e:a e:p")
    df = spark.read.format("turtle").load(str(tmp_path / "in"))
    plain = turtle.read_turtle(spark, str(tmp_path / "in"))
    show = lambda x: sorted((r.p, r.o if r.kind != "blank" else "_", r.kind, r.lang, r.datatype) for r in x.collect() if r.s)
    assert show(df) == show(plain) and len(show(df)) == 5
    assert [(r.file.rsplit("/", 1)[-1], r.s) for r in df.where("error is not null").collect()] == [("bad.ttl", None)]
    some = df.where("p = 'http://e/q'")
    assert some.count() == 1 and df.where("p in ('http://e/q', 'http://e/none')").count() == 1
    triples = turtle.distinct_triples(df)
    triples.repartition(3).write.format("ntriples").mode("overwrite").save(str(tmp_path / "out"))
    back = spark.read.format("ntriples").load(str(tmp_path / "out"))
    assert back.where("error is not null").count() == 0 and show(back) == show(df)
    assert show(turtle.read_ntriples(spark, str(tmp_path / "out"))) == show(df)
    triples.where("p = 'http://e/q'").write.format("ntriples").mode("append").save(str(tmp_path / "out"))
    assert back.sparkSession.read.format("ntriples").load(str(tmp_path / "out")).count() == 6
    triples.limit(1).write.format("ntriples").mode("overwrite").save(str(tmp_path / "out"))
    assert spark.read.format("ntriples").load(str(tmp_path / "out")).count() == 1
    with pytest.raises(Exception, match="columns are missing"):
        triples.select("s", "p").write.format("ntriples").mode("append").save(str(tmp_path / "out"))


def test_format_as_a_stream(spark, tmp_path):
    datasource.register(spark)
    (tmp_path / "in").mkdir()

    def run():
        q = spark.readStream.format("turtle").load(str(tmp_path / "in")).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start(str(tmp_path / "out"))
        q.awaitTermination(120)
        return sorted(r.s for r in spark.read.schema(turtle.RAW).parquet(str(tmp_path / "out")).collect())

    (tmp_path / "in/a.ttl").write_text("@prefix e: <http://e/> . e:a e:p e:b .")
    assert run() == ["http://e/a"]
    (tmp_path / "in/b.ttl").write_text("@prefix e: <http://e/> . e:c e:p e:d .")
    assert run() == ["http://e/a", "http://e/c"] and run() == ["http://e/a", "http://e/c"]
