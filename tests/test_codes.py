from pyspark.sql import functions as F

from yieldnorm.functions import codes


def one(spark, expr, value, schema="v string"):
    return spark.createDataFrame([(value,)], schema).select(expr.alias("o")).first()["o"]


def test_pad_fips_truncates_like_lpad(spark):
    assert one(spark, codes.pad_fips("v", 3), "7") == "007"
    assert one(spark, codes.pad_fips("v", 3), "12345") == "123"  # T3
    assert one(spark, codes.pad_fips("v", 2), 5, "v int") == "05"


def test_zfill_never_truncates_and_keeps_sign(spark):
    assert one(spark, codes.zfill("v", 3), "12345") == "12345"
    assert one(spark, codes.zfill("v", 3), "7") == "007"
    assert one(spark, codes.zfill("v", 3), "-1") == "-01"
    assert one(spark, codes.zfill("v", 3), "+1") == "+01"
    assert one(spark, codes.zfill("v", 2), "") == "00"
    for s in ["1", "12", "123", "-12", "abc"]:
        assert one(spark, codes.zfill("v", 4), s) == s.zfill(4)


def test_first_key_falls_through_null(spark):
    df = spark.createDataFrame([({"STATE": "1"},), ({"STATEFP": "2", "STATE": "9"},), ({"STATEFP": None, "STATE": "3"},),
                                ({},)], "m map<string,string>")
    out = [r[0] for r in df.select(codes.first_key("m", ["STATEFP", "STATE"], "")).collect()]
    assert out == ["1", "2", "3", ""]  # D4: a present-but-null key falls through


def test_norm_county_and_abbr(spark):
    rows = [(" St. Clair County ",), ("\tlafourche parish.\n",), ("Dona Ana",), (None,)]
    df = spark.createDataFrame(rows, "v string")
    full = [r[0] for r in df.select(codes.norm_county("v", True)).collect()]
    data = [r[0] for r in df.select(codes.norm_county("v", False)).collect()]
    assert full == ["ST CLAIR", "LAFOURCHE", "DONA ANA", None]
    assert data == ["ST CLAIR COUNTY", "LAFOURCHE PARISH", "DONA ANA", None]
    expected = [(s.upper().replace(".", "").strip() if s else None) for (s,) in rows]
    assert data == expected  # same as pandas .str.upper().str.replace(".", "").str.strip()
    assert one(spark, codes.norm_abbr("v"), "\t al ") == "AL"  # T4: tabs stripped too


def test_fips5(spark):
    df = spark.createDataFrame([(1001,), (None,), (56045,), (123456,)], "v long")
    assert [r[0] for r in df.select(codes.fips5("v")).collect()] == ["01001", "00000", "56045", "123456"]


def test_trim_is_blank_only(spark):
    # P6 keeps Spark's trim: blanks only
    assert one(spark, F.trim(F.col("v")), " a\t") == "a\t"
