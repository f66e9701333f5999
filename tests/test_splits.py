"""Turtle files in many blocks give the triples that they give in one piece."""

import random

import pytest

from semshift.sources import splits, turtle


def document(n, seed=1):
    r = random.Random(seed)
    out = ["@prefix e: <http://e/> .", "@prefix x: <http://x/a#> . # a comment. ", ""]
    for i in range(n):
        k = r.randrange(9)
        if k == 0:
            out.append(f'e:s{i} e:p "a. b" ;\n   e:q "it\'s. #1" , 1.5 , 2 .')
        elif k == 1:
            out.append(f'e:s{i} e:text """long. \nlines .\n  e:no e:no e:no .\n @prefix e: <http://wrong/> .\n "quoted" \\" .""" .')
        elif k == 2:
            out.append(f"x:s{i} a e:K ; e:r '''other\n.\n\"\"\" .\n'''@en .")
        elif k == 3:
            out.append(f"e:s{i} e:b [ e:p {i} ; e:q ( 1 2 e:l ) ] .")
        elif k == 4:
            out.append(f"# e:s e:p e:o .\n_:n{i % 5} e:p e:a.b , <http://e/x.y#z> .")
        elif k == 5 and i % 3 == 0:
            out.append(f"@prefix y{i % 4}: <http://y/{i}/> .\ny{i % 4}:s{i} e:p y{i % 4}:o .")
        elif k == 6 and i % 4 == 0:
            out.append(f"PREFIX z: <http://z/{i}/>\nz:s{i} e:p z:o . z:t e:p z:u .")
        else:
            out.append(f"e:s{i} e:p\n    e:o{i}\n    ;\n    e:q e:v , e:w\n .\n")
    return "\n".join(out) + "\n"


def shape(rows):
    """Triples with blank nodes named by what they are said to be, as deep as this test's go."""
    blanks = {r.o for r in rows if r.kind == "blank"} | {r.s for r in rows if r.s.startswith("_:")}
    names = dict.fromkeys(blanks, "_")
    for _ in range(4):
        names = {b: "_" + "|".join(sorted(f"{r.p} {names.get(r.o, r.o)}" for r in rows if r.s == b)) for b in blanks}
    return sorted((names.get(r.s, r.s), r.p, names.get(r.o, r.o), r.kind, r.lang or "", r.datatype or "") for r in rows)


@pytest.mark.parametrize("size", [150, 700, 20_000])
def test_blocks(spark, tmp_path, size):
    for i in range(2):
        (tmp_path / f"f{i}.ttl").write_text(document(120, i), encoding="utf-8")
    (tmp_path / "g.ttl").write_text("@prefix e: <http://e/> .\r\ne:a e:p '''x\r\ny''' .\r\n", encoding="utf-8", newline="")
    whole = turtle.read_turtle(spark, str(tmp_path)).collect()
    assert not [r for r in whole if r.error] and len(whole) > 500
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, str(size))
    try:
        df = turtle.read_turtle(spark, str(tmp_path), big=0)
        got = df.collect()
        blocks = splits._lines(spark, [str(tmp_path / "f0.ttl")]).select("block").distinct().count()
    finally:
        spark.conf.set(key, before)
    assert (blocks > 5) == (size < 20_000)
    assert not [r.error for r in got if r.error] and shape(got) == shape(whole)


def test_errors_stay_in_their_block(spark, tmp_path):
    lines = [f"e:s{i} e:p e:o{i} ." if i != 400 else "e:s400 e:p ." for i in range(800)]
    (tmp_path / "f.ttl").write_text("@prefix e: <http://e/> .\n" + "\n".join(lines) + "\n")
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, "2000")
    try:
        got = turtle.read_turtle(spark, str(tmp_path), big=0).collect()
    finally:
        spark.conf.set(key, before)
    assert len([r for r in got if r.error]) == 1 and 650 < len([r for r in got if r.s]) < 800


def test_line_ends():
    for line, want in {"e:a e:p 1.5 .": (0, True), "e:a e:p 1.5": (0, False), '"x ." .': (0, True), '"""x': (1, False), "'''x": (2, False), '"""a""" . # . x': (0, True), "<http://a.b/> .": (0, True), "# .": (0, False), 'e:a e:p "\\"" ; .': (0, True), "e:a . e:b": (0, False)}.items():
        assert splits.line_end(line, 0) == want, line
    assert splits.line_end('x""" .', 1) == (0, True) and splits.line_end('x" \\"""" .', 1) == (0, True) and splits.line_end("x' .", 2) == (2, False) and splits.line_end("", 2) == (2, False)
