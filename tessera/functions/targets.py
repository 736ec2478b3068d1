"""Target expressions: ``name``, ``all(..)``, ``any(..)``, ``not(x)``, ``(x)``, evaluated against a set of active targets.

A few distinct expressions are parsed on the driver and compiled to ``array_contains`` predicates that Catalyst folds,
reorders and generates code for, one CASE over the texts; tables with more are parsed on the executors into postfix
programs, which an array expression runs.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class TargetError(ValueError):
    """A text that is no target expression."""


@dataclass(frozen=True)
class Expr:
    """kind: wildcard, name, all, any or not. Members of all and any are a sorted set."""

    kind: str
    name: str = ""
    members: tuple[Expr, ...] = ()

    #: Members sort by kind in this order, then by content.
    ORDER = ("wildcard", "name", "all", "any", "not")

    def key(self) -> tuple:
        return self.ORDER.index(self.kind), self.name, tuple(m.key() for m in self.members)

    def __str__(self) -> str:
        if self.kind == "wildcard":
            return "*"
        return self.name if self.kind == "name" else f"{self.kind}({', '.join(map(str, self.members))})"


ANYTHING = Expr("wildcard")


def name(text: str) -> Expr:
    return Expr("name", text.lower())


def group(kind: str, members) -> Expr:
    return Expr(kind, members=tuple(sorted(set(members), key=Expr.key)))


def tokens(text: str) -> list[str]:
    out, word = [], ""
    for c in text + " ":
        if c.isalnum() or c in "._-:":
            word += c.lower()
            continue
        if word:
            out.append(word)
            word = ""
        if c in "(),":
            out.append(c)
        elif not c.isspace():
            raise TargetError(f"{c!r} has no place in a target expression")
    return out


def parse(text: str) -> Expr:
    """The expression at the start of ``text``; what follows a complete one is ignored, as is usual for this grammar."""
    left = tokens(text)[::-1]

    def take(wanted: str | None = None) -> str:
        if not left:
            raise TargetError("the expression ends too early")
        got = left.pop()
        if wanted is not None and got != wanted:
            raise TargetError(f"expected {wanted!r}, found {got!r}")
        return got

    def expression() -> Expr:
        word = take()
        if word == "(":
            inner = expression()
            take(")")
            return inner
        if word == "not":
            take("(")
            inner = expression()
            take(")")
            return Expr("not", members=(inner,))
        if word in ("all", "any"):
            take("(")
            members = [expression()]
            while (mark := take()) == ",":
                members.append(expression())
            if mark != ")":
                raise TargetError(f"expected ',' or ')', found {mark!r}")
            return group(word, members)
        if word in "),":
            raise TargetError(f"expected an expression, found {word!r}")
        if ":" in word or word.startswith("-"):
            raise TargetError(f"{word!r} is no target name")
        return name(word)

    return expression()


def reduce(expr: Expr) -> Expr:
    """For display: without wildcards in groups, groups of one unwrapped. Drops them from ``any`` too, although such a
    group matches everything; matching never uses this form."""
    if expr.kind in ("all", "any"):
        members = [m for m in map(reduce, expr.members) if m.kind != "wildcard"]
        return ANYTHING if not members else members[0] if len(set(members)) == 1 else group(expr.kind, members)
    return Expr("not", members=(reduce(expr.members[0]),)) if expr.kind == "not" else expr


def available(expr: Expr) -> list[str]:
    """Names in the expression, ordered, distinct."""
    if expr.kind == "name":
        return [expr.name]
    return list(dict.fromkeys(n for m in expr.members for n in available(m)))


def fileset_name(expr: Expr, top: bool = True) -> str:
    """The expression as an identifier; nothing at the top is ``files_rtl``."""
    if expr.kind == "wildcard":
        text = ""
    elif expr.kind == "name":
        text = expr.name
    elif expr.kind == "not":
        text = "not" + fileset_name(expr.members[0], False)
    else:
        text = ("_or_" if expr.kind == "any" else "_").join(filter(None, (fileset_name(m, False) for m in expr.members)))
    return text or ("files_rtl" if top else "")


def compile(expr: Expr, active: Column) -> Column:
    """A predicate over the array of active targets."""
    if expr.kind == "wildcard":
        return F.lit(True)
    if expr.kind == "name":
        return F.array_contains(active, expr.name)
    parts = [compile(m, active) for m in expr.members]
    out = parts[0]
    for p in parts[1:]:
        out = out & p if expr.kind == "all" else out | p
    return ~out if expr.kind == "not" else out


def holds(expr: Expr, active: set[str]) -> bool:
    """The expression for one known set."""
    if expr.kind in ("wildcard", "name"):
        return expr.kind == "wildcard" or expr.name in active
    found = [holds(m, active) for m in expr.members]
    return all(found) if expr.kind == "all" else any(found) if expr.kind == "any" else not found[0]


def matches(text: Column, active: Column, texts: list[str | None]) -> Column:
    """Whether the row's expression holds, ``texts`` being all distinct ones; null is the wildcard."""
    out = F.when(text.isNull(), F.lit(True))
    for t in texts:
        if t is not None:
            out = out.when(text == t, compile(parse(t), active))
    return out.otherwise(F.raise_error(F.concat(F.lit("unknown target expression "), text)).cast("boolean"))


#: Distinct expressions up to which they become one CASE; more are run as programs.
MOST_CASES = 500
PROGRAM = "array<struct<kind:string,name:string,n:int>>"


def program(expr: Expr) -> list[tuple[str, str, int]]:
    """The expression in postfix order: (kind, name, members taken from the stack)."""
    return [x for m in expr.members for x in program(m)] + [(expr.kind, expr.name, len(expr.members))]


def run(program: Column, active: Column) -> Column:
    """The value of a program for the active targets; any number of different expressions, no clauses."""

    def step(stack: Column, x: Column) -> Column:
        rest = F.slice(stack, F.lit(1), F.size(stack) - x["n"])
        taken = F.slice(stack, F.size(stack) - x["n"] + 1, x["n"])
        value = F.when(x["kind"] == "wildcard", F.lit(True)).when(x["kind"] == "name", F.array_contains(active, x["name"])).when(x["kind"] == "all", F.forall(taken, lambda v: v)).when(x["kind"] == "any", F.exists(taken, lambda v: v)).otherwise(~taken[0])
        return F.array_append(rest, value)

    return F.aggregate(program, F.expr("cast(array() as array<boolean>)"), step)[0]


def programs(df: DataFrame, column: str, into: str) -> DataFrame:
    """``df`` with the programs of its expressions; null is the wildcard. Each batch parses a text once, where it is."""
    from ..shipping import ship_package

    ship_package(df.sparkSession)
    known: dict[str | None, list] = {}

    @F.pandas_udf(PROGRAM)
    def parsed(texts):
        import pandas as pd

        for t in texts.unique():
            if t not in known:
                known[t] = [{"kind": k, "name": n, "n": m} for k, n, m in program(ANYTHING if t is None else parse(t))]
        out = pd.Series([known[t] for t in texts])
        if len(known) > MOST_CASES * 20:
            known.clear()
        return out

    return df.withColumn(into, parsed(F.col(column)))


def evaluated(df: DataFrame, column: str, active: Column, into: str) -> DataFrame:
    """``df`` with whether the expression in ``column`` holds for ``active``, whatever the number of different expressions:
    a few become one CASE, which Catalyst compiles; more are parsed where they are and run as programs."""
    texts = [r[0] for r in df.select(column).where(F.col(column).isNotNull()).distinct().limit(MOST_CASES + 1).collect()]
    if len(texts) <= MOST_CASES:
        return df.withColumn(into, matches(F.col(column), active, texts))
    return programs(df, column, "_program").withColumn(into, run(F.col("_program"), active)).drop("_program")


def clauses(expr: Expr, most: int = 4096) -> list[frozenset[tuple[str, bool]]]:
    """Disjunctive form: clauses of (name, negated). The empty clause is the wildcard."""

    def form(e: Expr, negated: bool) -> list[frozenset]:
        if e.kind == "wildcard":
            return [] if negated else [frozenset()]
        if e.kind == "name":
            return [frozenset([(e.name, negated)])]
        if e.kind == "not":
            return form(e.members[0], not negated)
        parts = [form(m, negated) for m in e.members]
        if (e.kind == "any") != negated:
            out = [c for p in parts for c in p]
        else:
            out = [frozenset().union(*cs) for cs in product(*parts)]
        if len(out) > most:
            raise TargetError(f"more than {most} clauses")
        return out

    return list(dict.fromkeys(form(expr, False)))


def target_set(names: Column) -> Column:
    return F.array_distinct(F.transform(names, F.lower))


def for_package(raw: Column, package: Column) -> Column:
    """The targets that count for a package: plain ones, and those passed to it or to all (``pkg:t``, ``*:t``), minus
    the ones that a ``-t`` among them takes away."""
    prefix = lambda t: F.substring_index(t, ":", 1)
    local = F.filter(raw, lambda t: ~F.contains(t, F.lit(":")) | (prefix(t) == package) | (prefix(t) == "*"))
    local = F.transform(local, lambda t: F.when(F.contains(t, F.lit(":")), F.substr(t, F.instr(t, ":") + 1)).otherwise(t))
    gone = F.transform(F.filter(local, lambda t: F.startswith(t, F.lit("-"))), lambda t: F.substr(t, F.lit(2)))
    return F.array_except(F.filter(local, lambda t: ~F.startswith(t, F.lit("-"))), gone)


def target_defines(active: Column) -> Column:
    """Names of the defines that a packaged group gets for its active targets, sorted."""
    return F.array_sort(F.transform(active, lambda t: F.concat(F.lit("TARGET_"), F.upper(t))))
