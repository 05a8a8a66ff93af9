"""Scalar helpers."""

from pyspark.sql import functions as F

from kiln.functions import text


def test_scalar_helpers(spark):
    df = spark.createDataFrame([(1234567.4, 12.345, {"type": "t", "b": "2", "a": "1"}, [1.0, 3.0, 3.0])],
                               "x double, p double, m map<string,string>, v array<double>")
    r = df.select(text.rupiah(F.col("x")).alias("r"), text.percent_text(F.col("p")).alias("p"),
                  text.metadata_text(F.col("m")).alias("m"), text.argmax(F.col("v")).alias("a"),
                  text.softmax(F.col("v")).alias("s"),
                  text.py_strip(F.lit(" \t x y \n　")).alias("st"),
                  text.tokenize(F.lit("Ab c_d é1 x, ÉTÉ!")).alias("tk"),
                  text.split_list(F.lit("NPWP;  NDA ")).alias("sl"), text.split_list(F.lit("-")).alias("none")).first()
    assert r.r == "Rp 1,234,567" and r.p == "12.3%" and r.m == "a=1, b=2" and r.a == 1
    assert abs(sum(r.s) - 1) < 1e-12 and r.s[1] == r.s[2]
    assert r.st == "x y" and r.tk == ["ab", "c_d", "é1", "été"]
    assert r.sl == ["NPWP", "NDA"] and r.none == []
