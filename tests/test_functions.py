import datetime

import pytest
from pyspark.sql import functions as F

from framelake import functions as fn

ISO = {
    "2021-01-11": (2021, 1, 11, 0, 0, 0), "2021-01-11T12:05": (2021, 1, 11, 12, 5, 0), "2021-01-11 12:05:09": (2021, 1, 11, 12, 5, 9),
    "2021-01-11T12:05:09.999Z": (2021, 1, 11, 12, 5, 9), "2021-01-11 12:00+0100": (2021, 1, 11, 12, 0, 0), "2021:01:11": (2021, 1, 11, 0, 0, 0),
    "tomorrow": None, "2021": None, "2021-13-41": None, "": None, "11/01/2021": None, None: None,
}


def one(spark, c, **values):
    df = spark.range(1)
    for k, v in values.items():
        df = df.withColumn(k, v if not isinstance(v, (str, int, float, bool, list, type(None))) else F.lit(v))
    return df.select(c.alias("v")).first()[0]


@pytest.mark.parametrize("text,want", ISO.items())
def test_iso(spark, text, want):
    got = one(spark, fn.ts("x"), x=F.lit(text).cast("string"))
    assert got == (want and datetime.datetime(*want))


def test_dates(spark):
    x = "2021-01-02T23:04:05"
    assert [one(spark, f("x"), x=x) for f in (fn.year, fn.month, fn.day, fn.quarter, fn.hour, fn.minute, fn.second, fn.week, fn.time)] == [2021, 1, 2, 1, 23, 4, 5, 53, "23:04:05"]
    assert one(spark, fn.add_days("x", 3), x=x) == datetime.datetime(2021, 1, 5, 23, 4, 5)
    assert one(spark, fn.days_diff("x", F.lit("2000-06-07")), x=x) == -7515
    assert one(spark, fn.year("x"), x=F.lit(datetime.date(1999, 5, 1))) == 1999 and one(spark, fn.year("x"), x=86400) == 1970
    assert one(spark, fn.year("x"), x="nonsense") is None


def test_strings(spark):
    s = "abcdef"
    cases = [(fn.left("x", 2), "ab"), (fn.left("x", -2), "abcd"), (fn.left("x", 9), s), (fn.right("x", 2), "ef"), (fn.right("x", 0), s), (fn.right("x", -2), "cdef"), (fn.mid("x", 1, 3), "bcd"), (fn.upper("x"), "ABCDEF"), (fn.length("x"), 6), (fn.concat("x", F.lit("!")), s + "!")]
    for c, want in cases:
        assert one(spark, c, x=s) == want
    assert one(spark, fn.trim("x"), x="\t a \n") == "a"
    arr = F.array(F.lit(3), F.lit(1))
    kind = spark.range(1).select(arr.alias("x")).schema["x"].dataType
    assert one(spark, fn.string("x", kind), x=arr) == "3, 1" and one(spark, fn.length("x", kind), x=arr) == 2 and one(spark, fn.sort("x"), x=arr) == [1, 3]


def test_numbers(spark):
    assert one(spark, fn.round_("x"), x=2.5) == 2.0 and one(spark, fn.round_("x"), x=3.5) == 4.0
    assert one(spark, fn.trunc("x"), x=-2.9) == -2 and one(spark, fn.integer("x"), x="7.9") == 7 and one(spark, fn.integer("x"), x="seven") is None
    assert one(spark, fn.double("x"), x="1.5") == 1.5 and one(spark, fn.double("x"), x="q") is None
    assert [one(spark, fn.boolean("x"), x=v) for v in ("false", "no", True)] == [False, True, True]
    assert one(spark, fn.boolean("x"), x=F.lit(None).cast("string")) is True and one(spark, fn.is_none("x"), x=1) is False
    assert [one(spark, fn.between("x", 1, 3), x=v) for v in (1, 2, 3)] == [False, True, False]
    assert 0 <= one(spark, fn.random(1)) < 1 and len(one(spark, fn.hash_("x"), x="a")) >= 15 and one(spark, fn.md5("x"), x="a").startswith("0cc1")
    assert len(fn.REGISTRY) == 35
