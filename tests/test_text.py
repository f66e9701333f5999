from pyspark.sql import functions as F

from semshift.functions import text as t


def value(spark, column):
    return spark.range(1).select(column.alias("x")).head()[0]


def test_years(spark):
    for raw, want in (("+1999", 1999), ("0387", 387), ("-0044", -44), ("x", None), ("", None)):
        assert value(spark, t.parse_year(F.lit(raw))) == want
    assert value(spark, t.decade(F.lit(-5))) == -10
    assert value(spark, t.bucket(F.lit(-350))) == -400
    assert value(spark, t.gyear(F.lit(-44))) == "-0044"
    assert value(spark, t.show_year(F.lit(None).cast("int"))) == "?"


def test_names(spark):
    iri = F.lit("http://x.org/resource/word-dwug-en-attack")
    assert value(spark, t.local_name(iri)) == "word-dwug-en-attack"
    assert value(spark, t.source_of(iri)) == "DWUG"
    assert value(spark, t.source_of(F.lit("http://x.org/resource/word-dwugen-x"))) == "Curated"
    assert value(spark, t.quality_of(F.lit("Frequency"))) == "detected"
    assert value(spark, t.ladder(F.lit("Speculative"))) == 1


def test_csv_and_turtle(spark):
    assert value(spark, t.csv_field(F.lit('a "b", c'))) == '"a ""b"", c"'
    assert value(spark, t.turtle_literal(F.lit('a "b"\n'))) == '"a \\"b\\"\\n"'


def test_fuzzy(spark):
    assert value(spark, t.fuzzy_score("abc", F.lit("ABC"))) == 1000
    assert value(spark, t.fuzzy_score("abc", F.lit("abcde"))) == 795
    assert value(spark, t.fuzzy_score("ac", F.lit("xabc"))) == 10 + 10 - 1 - 0.4
    assert value(spark, t.fuzzy_score("zz", F.lit("abc"))) == -1
