import pytest
from pyspark.sql import functions as F

from tessera.functions import semver as S


def test_order(spark):
    order = ["1.0.0-1", "1.0.0-2", "1.0.0-10", "1.0.0-a", "1.0.0-a.1", "1.0.0-b", "1.0.0", "1.0.1", "1.10.0", "2.0.0"]
    df = spark.createDataFrame([(v,) for v in reversed(order)], "v string").orderBy(S.version(F.col("v")))
    assert [r.v for r in df.collect()] == order


@pytest.mark.parametrize("text", ["1.2", "01.2.3", "v1.2.3", "1.2.3.4", ""])
def test_no_version(spark, text):
    assert spark.range(1).select(S.version(F.lit(text)).alias("v")).first().v is None


@pytest.mark.parametrize("req, yes, no", [
    ("1.2.3", ["1.2.3", "1.9.0"], ["1.2.2", "2.0.0", "1.3.0-a"]), ("^0.2.3", ["0.2.3", "0.2.9"], ["0.3.0"]), ("^0.0.3", ["0.0.3"], ["0.0.4"]), ("~1.2", ["1.2.0", "1.2.9"], ["1.3.0"]), ("~1", ["1.9.9"], ["2.0.0"]),
    ("1.*", ["1.0.0", "1.8.0"], ["2.0.0"]), ("*", ["0.0.1", "9.9.9"], ["1.0.0-a"]), (">=1.0.0, <2.0.0", ["1.5.0"], ["2.0.0", "0.9.0"]), (">1.2", ["1.3.0"], ["1.2.9"]), ("=1.2", ["1.2.7"], ["1.3.0"]), ("<=1.2", ["1.2.9", "0.1.0"], ["1.3.0"]),
    (">=1.0.0-b", ["1.0.0-b", "1.0.0", "1.0.0-c"], ["1.0.0-a", "1.1.0-c"]), ("^1.0.0-b", ["1.0.0-c", "1.4.0"], ["1.0.0-a", "2.0.0"]),
])
def test_match(spark, req, yes, no):
    rows = spark.createDataFrame([(v, v in yes, req) for v in yes + no], "v string, want boolean, req string")
    assert all(r.got == r.want for r in rows.select("want", S.matches(S.version(F.col("v")), S.requirement(F.col("req"))).alias("got")).collect())


@pytest.mark.parametrize("req, bottom, top", [
    ("=1.2.3", (1, 2, 3), (1, 2, 4)), ("=1.2", (1, 2, 0), (1, 3, 0)), ("=1", (1, 0, 0), (2, 0, 0)), ("<1.2", None, (1, 2, 0)), ("<=1", None, (2, 0, 0)), (">=1.2", (1, 2, 0), None), (">1.2.3", (1, 3, 4), None), (">1.2", (1, 2, 0), None), (">1", (2, 0, 0), None),
    ("~1.2.3", (1, 2, 3), (1, 3, 0)), ("~1", (1, 0, 0), (2, 0, 0)), ("^1.2", (1, 2, 0), (2, 0, 0)), ("^0.2", (0, 2, 0), (0, 3, 0)), ("^0.0.3", (0, 0, 3), (0, 0, 4)), (">=1.0.0, <1.5, <2", (1, 0, 0), (1, 5, 0)), (">=0.0.0", None, None),
])
def test_bounds(spark, req, bottom, top):
    r = spark.createDataFrame([(req,)], "req string").select(S.bottom_bound(F.col("req")).alias("bottom"), S.top_bound(F.col("req")).alias("top")).first()
    assert (r.bottom and tuple(r.bottom)) == bottom and (r.top and tuple(r.top)) == top


def test_caret_on_zero_has_no_bound(spark):
    with pytest.raises(Exception, match="no upper bound"):
        spark.createDataFrame([("^0",)], "req string").select(S.top_bound(F.col("req"))).collect()


def test_is_requirement(spark):
    want = {"main": False, "abc123": False, "1": True, "^1.2, <3": True, "": False, "*": True, " x ": True, "1.*": True, ">1.*": False, "*.1": False, None: False}
    df = spark.createDataFrame([(t,) for t in want], "t string")
    assert {r.t: r.ok for r in df.select("t", S.is_requirement(F.col("t")).alias("ok")).collect()} == want


def test_many_different_requirements(spark):
    """No limit on how many distinct ones a table has."""
    df = spark.range(20_000).select(F.concat(F.lit("^1."), F.col("id").cast("string")).alias("req"), F.concat(F.lit("1."), (F.col("id") + 1 - F.col("id") % 2 * 2).cast("string"), F.lit(".0")).alias("v"), "id")
    got = df.select((S.matches(S.version(F.col("v")), S.requirement(F.col("req"))) == (F.col("id") % 2 == 0)).alias("ok")).where("ok").count()
    assert got == 20_000
