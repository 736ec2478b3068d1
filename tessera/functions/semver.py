"""Semantic versions and requirements as structs and column predicates.

Requirements are rows' data: they are parsed by expressions, once for each row that has one, into a range of releases and
the few comparators that name a pre-release. No requirement text ever comes to the driver.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Strict three-number versions with an optional pre-release and build part.
STRICT = r"^(0|[1-9][0-9]*)\.(0|[1-9][0-9]*)\.(0|[1-9][0-9]*)(?:-([0-9A-Za-z.-]+))?(?:\+([0-9A-Za-z.-]+))?$"
COMPARATOR = r"^(=|>=|<=|>|<|~|\^)?\s*([0-9]+|[*xX])(?:\.([0-9]+|[*xX]))?(?:\.([0-9]+|[*xX]))?(?:-([0-9A-Za-z.-]+))?(?:\+[0-9A-Za-z.-]+)?$"
OPS = {"=": "exact", ">": "greater", ">=": "greater_eq", "<": "less", "<=": "less_eq", "~": "tilde", "^": "caret", "": "caret"}


def version(text: Column) -> Column:
    """A struct that orders as versions do: releases above pre-releases, numeric identifiers below others. Null where
    the text is no strict version."""
    part = lambda i: F.regexp_extract(text, STRICT, i)
    words = F.filter(F.split(part(4), r"\."), lambda w: w != "")
    pre = F.transform(words, lambda w: F.struct((~w.rlike("^[0-9]+$")).cast("int").alias("is_alnum"), F.when(w.rlike("^[0-9]+$"), w.cast("decimal(20,0)")).alias("num"), w.alias("s")))
    made = F.struct(part(1).cast("long").alias("major"), part(2).cast("long").alias("minor"), part(3).cast("long").alias("patch"), (part(4) == "").alias("is_release"), pre.alias("pre"), part(5).alias("build"))
    return F.when(text.rlike(STRICT), made)


def from_tag(tag: Column) -> Column:
    """Only ``v<version>`` tags are versions."""
    return F.when(F.startswith(tag, F.lit("v")), version(F.substr(tag, F.lit(2))))


def comparators(text: Column) -> Column:
    """(op, a, b, c, pre) of every comma-separated comparator, missing numbers being null; null for what is no
    requirement. A text of one wildcard is one comparator without numbers."""
    whole = F.trim(text)
    star = lambda x: x.isin("*", "x", "X")
    part = lambda p, i: F.regexp_extract(p, COMPARATOR, i)
    starred = lambda p: star(part(p, 2)) | star(part(p, 3)) | star(part(p, 4))
    number = lambda x: F.when(x.rlike("^[0-9]+$"), x.try_cast("long"))
    made = lambda op, p: F.struct(op.alias("op"), *[number(part(p, i)).alias(n) for i, n in ((2, "a"), (3, "b"), (4, "c"))], part(p, 5).alias("pre"))
    op = lambda p: F.when(starred(p), "wildcard").otherwise(F.create_map(*[F.lit(x) for kv in OPS.items() for x in kv])[part(p, 1)])
    sound = lambda p: p.rlike(COMPARATOR) & ~(starred(p) & (star(part(p, 2)) | ~part(p, 1).isin("", "=")))
    pieces = F.transform(F.split(text, ","), lambda p: F.trim(p))
    listed = F.when(F.forall(pieces, sound), F.transform(pieces, lambda p: made(op(p), p)))
    return F.when(star(whole), F.array(made(F.lit("wildcard"), F.lit("*")))).otherwise(listed)


def is_requirement(text: Column) -> Column:
    return F.coalesce(comparators(text).isNotNull(), F.lit(False))


def _three(a: Column, b: Column, c: Column) -> Column:
    return F.struct(a.alias("a"), b.alias("b"), c.alias("c"))


def _full(c: Column) -> Column:
    return _three(c["a"], F.coalesce(c["b"], F.lit(0).cast("long")), F.coalesce(c["c"], F.lit(0).cast("long")))


def _after(c: Column) -> Column:
    """The first release after all that the numbers of a comparator stand for."""
    zero = F.lit(0).cast("long")
    return F.when(c["b"].isNull(), _three(c["a"] + 1, zero, zero)).when(c["c"].isNull(), _three(c["a"], c["b"] + 1, zero)).otherwise(_three(c["a"], c["b"], c["c"] + 1))


def low(c: Column) -> Column:
    """The first release that a comparator admits; null if it has none to name."""
    return F.when(c["a"].isNull() | c["op"].isin("less", "less_eq"), None).when(c["op"] == "greater", _after(c)).otherwise(_full(c))


def high(c: Column) -> Column:
    """The first release above those that a comparator admits; null if there is none."""
    zero, op = F.lit(0).cast("long"), c["op"]
    tilde = F.when(c["b"].isNull(), _three(c["a"] + 1, zero, zero)).otherwise(_three(c["a"], c["b"] + 1, zero))
    caret = F.when((c["a"] > 0) | c["b"].isNull(), _three(c["a"] + 1, zero, zero)).when((c["b"] > 0) | c["c"].isNull(), _three(c["a"], c["b"] + 1, zero)).otherwise(_three(c["a"], c["b"], c["c"] + 1))
    return F.when(c["a"].isNull() | op.isin("greater", "greater_eq"), None).when(op == "less", _full(c)).when(op.isin("exact", "less_eq", "wildcard"), _after(c)).when(op == "tilde", tilde).otherwise(caret)


def requirement(text: Column) -> Column:
    """(low, high, pres): releases from ``low`` up to but without ``high``, and comparators that name a pre-release;
    null for what is no requirement."""
    found = comparators(text)
    plain = F.filter(found, lambda c: c["pre"] == "")
    made = F.struct(F.array_max(F.transform(plain, low)).alias("low"), F.array_min(F.transform(plain, high)).alias("high"), F.filter(found, lambda c: c["pre"] != "").alias("pres"))
    return F.when(found.isNotNull(), made)


def matches(v: Column, req: Column) -> Column:
    """Whether a version struct meets a parsed requirement. Pre-releases meet it only where a comparator names one of the
    same three numbers. Null where either is null."""
    triple = _three(v["major"], v["minor"], v["patch"])

    def meets(c: Column) -> Column:
        full = version(F.concat(F.concat_ws(".", c["a"], F.coalesce(c["b"], F.lit(0)), F.coalesce(c["c"], F.lit(0))), F.lit("-"), c["pre"]))
        op = c["op"]
        test = F.when(op == "exact", v == full).when(op == "greater", v > full).when(op == "less", v < full).when(op == "less_eq", v <= full).otherwise(v >= full)
        return test & F.coalesce(~op.isin("tilde", "caret") | (triple < high(c)), F.lit(True))

    inside = (req["low"].isNull() | (triple >= req["low"])) & (req["high"].isNull() | (triple < req["high"]))
    named = F.exists(req["pres"], lambda c: triple == _full(c))
    return F.when(req.isNotNull() & v.isNotNull(), inside & (F.size(req["pres"]) == 0) & v["is_release"] | inside & (F.size(req["pres"]) > 0) & F.forall(req["pres"], meets) & (v["is_release"] | named))


def top_bound(text: Column) -> Column:
    """Exclusive upper bound (a, b, c) over all comparators; null if there is none. A caret on 0 alone has none to give
    and is an error."""
    bare = lambda c: (c["op"] == "caret") & (c["a"] == 0) & (F.coalesce(c["b"], F.lit(0)) == 0) & c["c"].isNull()
    found = comparators(text)
    tilde = lambda c: F.when(c["op"] == "wildcard", high(F.struct(F.lit("tilde").alias("op"), c["a"].alias("a"), c["b"].alias("b"), c["c"].alias("c")))).otherwise(high(c))
    return F.when(F.exists(found, bare), F.raise_error(F.concat(F.lit("no upper bound for "), text)).cast("struct<a:bigint,b:bigint,c:bigint>")).otherwise(F.array_min(F.transform(found, tilde)))


def bottom_bound(text: Column) -> Column:
    """Inclusive lower bound; a bound of 0.0.0 is none. For ``>a.b.c`` minor and patch both go up, and for ``>a.b``
    neither: bounds order conflict messages, they never decide a match."""
    zero = F.lit(0).cast("long")
    above = lambda c: F.when(c["b"].isNull(), _three(c["a"] + 1, zero, zero)).when(c["c"].isNull(), _three(c["a"], c["b"], zero)).otherwise(_three(c["a"], c["b"] + 1, c["c"] + 1))
    own = F.transform(comparators(text), lambda c: F.when(c["a"].isNull() | c["op"].isin("less", "less_eq"), None).when(c["op"] == "greater", above(c)).otherwise(_full(c)))
    best = F.array_max(own)
    return F.when(best > _three(zero, zero, zero), best)


def dotted(bound: Column) -> Column:
    return F.when(bound.isNotNull(), F.concat_ws(".", bound["a"], bound["b"], bound["c"]))
