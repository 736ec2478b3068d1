import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import targets as T


@pytest.mark.parametrize("text, canonical", [
    ("A", "a"), ("all(b, a)", "all(a, b)"), ("any(x, x)", "any(x)"), ("not( Sim )", "not(sim)"), ("((a))", "a"), ("all(any(b), a, not(c))", "all(a, any(b), not(c))"),
    ("a b c", "a"), ("foo(bar)", "foo"), ("a.b-c_d", "a.b-c_d"),
])
def test_parse_and_show(text, canonical):
    assert str(T.parse(text)) == canonical


@pytest.mark.parametrize("text", ["", "*", "all()", "all(a", "any(a,)", "not a", ")", "p:t", "-t", "all(a b)", "a&b"])
def test_parse_errors(text):
    with pytest.raises(T.TargetError):
        T.parse(text)


def test_reduce_and_names():
    e = T.group("all", [T.ANYTHING, T.group("any", [T.ANYTHING, T.name("a")])])
    assert str(T.reduce(e)) == "a" and str(T.reduce(T.group("all", [T.ANYTHING]))) == "*"
    assert str(T.reduce(T.parse("not(not(a))"))) == "not(not(a))"
    assert T.available(T.parse("all(b, any(a, b))")) == ["b", "a"]
    assert T.fileset_name(T.ANYTHING) == "files_rtl" and T.fileset_name(T.parse("all(a, not(b))")) == "a_notb"


names = st.sampled_from(["a", "b", "c", "d"])
expressions = st.recursive(names.map(T.name), lambda e: st.one_of(st.lists(e, min_size=1, max_size=3).map(lambda m: T.group("all", m)), st.lists(e, min_size=1, max_size=3).map(lambda m: T.group("any", m)), e.map(lambda x: T.Expr("not", members=(x,)))), max_leaves=8)


def holds(e, active):
    if e.kind == "name":
        return e.name in active
    if e.kind == "not":
        return not holds(e.members[0], active)
    return (all if e.kind == "all" else any)(holds(m, active) for m in e.members)


@given(expressions, st.sets(names))
def test_clauses_agree_with_evaluation(e, active):
    assert T.parse(str(e)) == e
    assert any(all((n in active) != neg for n, neg in c) for c in T.clauses(e)) == holds(e, active)


def test_compiled_predicates(spark):
    texts = ["all(a, not(b))", "any(c, all(a, b))", "not(any(a, c))"]
    sets = [[], ["a"], ["a", "b"], ["c"], ["b"]]
    df = spark.createDataFrame([(t, s) for t in [*texts, None] for s in sets], "t string, s array<string>")
    for r in df.withColumn("hit", T.matches(F.col("t"), F.col("s"), texts)).collect():
        assert r.hit == (r.t is None or holds(T.parse(r.t), r.s))


def test_programs(spark, monkeypatch):
    monkeypatch.setattr(T, "MOST_CASES", 2)
    texts = ["all(a, not(b))", "any(c, all(a, b))", "not(any(a, c))", "not(not(all(any(a, b), any(b, c), d)))", "d"]
    sets = [[], ["a"], ["a", "b"], ["c"], ["b"], ["a", "b", "c", "d"], ["b", "d"]]
    df = spark.createDataFrame([(t, s) for t in [*texts, None] for s in sets], "t string, s array<string>")
    rows = T.evaluated(df, "t", F.col("s"), "hit").collect()
    assert len(rows) == df.count() and all(r.hit == (r.t is None or holds(T.parse(r.t), r.s)) for r in rows)


def test_many_expressions(spark):
    df = spark.range(3000).select(F.concat(F.lit("all(a, t"), F.col("id").cast("string"), F.lit(")")).alias("t"), F.array(F.lit("a"), F.concat(F.lit("t"), (F.col("id") + F.col("id") % 2).cast("string"))).alias("s"), "id")
    assert T.evaluated(df, "t", F.col("s"), "hit").where(F.col("hit") != (F.col("id") % 2 == 0)).count() == 0


def test_for_package(spark):
    df = spark.createDataFrame([(["a", "p:b", "q:c", "*:d", "-a", "p:-d", "e"],)], "raw array<string>")
    assert df.select(T.for_package(F.col("raw"), F.lit("p")).alias("x")).first().x == ["b", "e"]
