"""Version selection: constraints of the root and of the manifests of picked versions, until nothing changes.

Which candidates each constraint admits is one join for the whole table. The fixpoint over it runs in one task where
declarations and fits are few, counted (SMALL_ROWS), as those of any one project are; larger ones run as a loop of joins
whose rounds are written to the shared folder. Both follow the same rules:

* A candidate is alive if every constraint since its package was last opened admits it, whatever source the constraint
  names. A pick stays while it is alive; one that is not opens its package again, which starts from all candidates.
* The manifest that counts is that of the picked version, also while its package is open again; packages once needed
  stay in the table.
* The first source in order of arrival that has a candidate is taken, and of its candidates the first in the order of
  the constraint imposed last: highest version first, or revisions in order.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..frames import cut, in_order
from ..functions import semver
from ..operators import graph
from ..shipping import ship_package

#: Declarations, candidates and fits up to which one task settles them: some 300 MB.
SMALL_ROWS = 2_000_000
ROUNDS = 200
DECLARED = "parent string, parent_rev string, dep string, pos long, source string, constraint string"


def interned(df: DataFrame, key: list[str], pos: str | None = None) -> DataFrame:
    """``df``'s distinct tuples with dense numbers, in order of arrival (the least ``pos``) or, without one, of the key.
    Ranks are counted inside ranges, so no task sees all rows."""
    rows = df.select(*key).distinct() if pos is None else df.groupBy(*key).agg(F.min(pos).alias("pos_"))
    order = [*([] if pos is None else ["pos_"]), *key]
    rows = cut(rows, "tuples")
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut(rows.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()), "ranged")
    sizes = ranged.groupBy("part").agg(F.count("*").alias("n"))
    before = sizes.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return ranged.join(F.broadcast(before), "part").select(*key, (F.col("before") + F.row_number().over(Window.partitionBy("part").orderBy(*order)) - 1).alias("ref"))


def constraint_kind(source: Column, constraint: Column) -> Column:
    """path (no constraint), version or revision."""
    return F.when(constraint.isNull(), "path").when(semver.is_requirement(constraint), "version").otherwise("revision")


def source_of(path: Column, git: Column) -> Column:
    """What a declaration's source is called: its path, else its address, else the registry."""
    return F.coalesce(path, git, F.lit("registry"))


def constraint_of(path: Column, version: Column, revision: Column) -> Column:
    """A declaration's constraint: none for a path, else the version requirement, else the revision."""
    return F.when(path.isNull(), F.coalesce(version, revision))


def overlaid(declared: DataFrame, kept: DataFrame | None = None, overrides: DataFrame | None = None, checked_out: DataFrame | None = None) -> DataFrame:
    """``declared`` with the source and constraint that count for each dependency: of a kept lock row, else of an override,
    else of a changed working copy, else as declared. The three tables have dep, source, constraint."""
    out = declared
    layers = [(n, df) for n, df in (("kept", kept), ("override", overrides), ("checked_out", checked_out)) if df is not None]
    for n, df in layers:
        out = out.join(df.select("dep", F.struct("source", "constraint").alias(n)), "dep", "left")
    said = F.coalesce(*[F.col(n) for n, _ in layers], F.struct("source", "constraint"))
    origin = F.coalesce(*[F.when(F.col(n).isNotNull(), n) for n, _ in layers], F.lit("declared"))
    rest = [c for c in declared.columns if c not in ("source", "constraint")]
    return out.select(*rest, said["source"].alias("source"), said["constraint"].alias("constraint"), origin.alias("origin"))


def name_clashes(declared: DataFrame, root: str) -> DataFrame:
    """(parent, dep, clash) of declarations whose dependency is called like the root or like the package itself."""
    clash = F.when(F.col("dep") == root, "root").when(F.col("dep") == F.col("parent"), "self")
    return declared.select("parent", "dep", clash.alias("clash")).where("clash IS NOT NULL").distinct()


def lock_constraints(lock: DataFrame) -> DataFrame:
    """(dep, source, constraint, revision) of lock rows (name, revision, version, source_kind, source_uri): a version is
    asked for exactly, else the revision, and a path has no constraint. Rows of a repository without either are left
    out (they deserve a warning)."""
    path = F.col("source_kind") == "Path"
    asked = F.when(~path, F.coalesce(F.concat(F.lit("="), "version"), "revision"))
    rows = lock.select(F.col("name").alias("dep"), F.col("source_uri").alias("source"), asked.alias("constraint"), F.when(~path, F.col("revision")).alias("revision"), path.alias("path"))
    return rows.where("path OR constraint IS NOT NULL").drop("path")


def kept_locks(locked: DataFrame, candidates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, lost): kept lock rows (dep, source, constraint, revision) whose revision is still there, and W23 rows
    (subject, code, severity, message) for those whose is not."""
    there = candidates.select("dep", "source", F.col("rev").alias("revision")).distinct()
    path = F.col("constraint").isNull()
    git = locked.where(~path)
    kept = locked.where(path).unionByName(git.join(there, ["dep", "source", "revision"], "left_semi"))
    lost = git.join(there, ["dep", "source", "revision"], "left_anti")
    return kept, lost.select(F.col("dep").alias("subject"), F.lit("W23").alias("code"), F.lit("warning").alias("severity"), F.concat(F.lit("the locked revision "), "revision", F.lit(" is gone")).alias("message"))


def available(declared: DataFrame, tags: DataFrame) -> DataFrame:
    """Candidates by kind of source: one without revision for each path, and the versions ``tags`` (source, version, text,
    rev) of each address. A source in the registry is an error."""
    wanted = declared.select("dep", "source", constraint_kind(F.col("source"), F.col("constraint")).alias("kind")).distinct()
    barred = F.when(F.col("source") == "registry", F.raise_error(F.concat(F.lit("registry dependencies are not supported: "), "dep")).cast("string")).otherwise(F.col("source"))
    wanted = wanted.withColumn("source", barred)
    paths = wanted.where("kind = 'path'").select("dep", "source").distinct()
    git = wanted.where("kind <> 'path'").select("dep", "source").distinct().join(tags, "source").select("dep", "source", "version", "text", "rev")
    return paths.select("dep", "source", F.lit(None).cast(tags.schema["version"].dataType).alias("version"), F.lit(None).cast("string").alias("text"), F.lit("").alias("rev")).unionByName(git)


def indexed(revs: DataFrame) -> DataFrame:
    """(source, rev, index) of revisions (source, value) as listed, one a line, newest first."""
    return revs.select("source", F.posexplode(F.split("value", "\n")).alias("index", "rev")).where("rev <> ''")


def candidates_for(constraints: DataFrame, candidates: DataFrame, refs: DataFrame | None = None, order: DataFrame | None = None) -> DataFrame:
    """(dep, constraint, source, version, text, rev, place): candidates of all of a package's sources that a constraint
    admits, best first.

    ``candidates`` (dep, source, version, text, rev): a row for each version; revisions without one have none. A version
    constraint takes versions highest first. Another text names a ref (``refs``: dep, name, rev, a tag before a branch) or
    else the beginning of a revision; those are in the order of ``order`` (source, rev, index), or of their text. No
    constraint takes the one candidate of a path. Other pairs of constraint and source have no row.
    """
    distinct = constraints.select("dep", F.coalesce("constraint", F.lit("")).alias("constraint"), F.col("constraint").isNull().alias("path")).distinct()
    asked = distinct.withColumn("req", semver.requirement(F.col("constraint")))
    w = Window.partitionBy("dep", "constraint", "source")
    is_path = F.col("rev") == ""
    columns = ["dep", "constraint", "source", "version", "text", "rev", "place"]
    by_path = asked.where("path").join(candidates.where(is_path), "dep").withColumn("place", F.lit(1))
    git = candidates.where(~is_path)
    by_range = asked.where("NOT path AND req IS NOT NULL").join(git, "dep").where(semver.matches(F.col("version"), F.col("req"))).withColumn("place", F.row_number().over(w.orderBy(F.desc("version"), "rev")))
    other = asked.where("NOT path AND req IS NULL")
    revs = git.groupBy("dep", "source", "rev").agg(F.max("version").alias("version"), F.max_by("text", "version").alias("text"))
    revs = revs.withColumn("index", F.lit(0)) if order is None else revs.join(order.groupBy("source", "rev").agg(F.min("index").alias("index")), ["source", "rev"], "left")
    named = other.join(refs.select("dep", F.col("name").alias("constraint"), F.col("rev").alias("wanted")), ["dep", "constraint"]) if refs is not None else other.withColumn("wanted", F.lit(None).cast("string")).limit(0)
    by_name = named.join(revs, "dep").where(F.col("rev") == F.col("wanted"))
    loose = other.join(named.select("dep", "constraint").distinct(), ["dep", "constraint"], "left_anti")
    by_prefix = loose.join(revs, "dep").where(F.startswith("rev", F.col("constraint")))
    picked = ["dep", "constraint", "source", "version", "text", "rev", "index"]
    by_rev = by_name.select(*picked).unionByName(by_prefix.select(*picked)).withColumn("place", F.row_number().over(w.orderBy("index", "rev")))
    return by_range.select(*columns).unionByName(by_rev.select(*columns)).unionByName(by_path.select(*columns))


class Settled:
    """The fixpoint over plain rows, for one task."""

    def __init__(self, root: str, declared: dict[str, list], candidates: dict, fits: dict, locked: dict, decisions: dict):
        self.root, self.declared, self.candidates, self.fits, self.locked, self.decisions = root, declared, candidates, fits, locked, decisions
        self.sources: dict[str, list[str]] = {}
        self.alive: dict[str, dict[str, list[str]]] = {}
        self.pick: dict[str, tuple[str, str]] = {}
        self.manifest: dict[str, str] = {}
        self.failed: dict[str, str] = {}

    def needs(self, parent: str, rev: str | None) -> list[tuple]:
        return [(d, s, c) for revs, d, s, c in self.declared.get(parent, []) if revs is None or rev in revs]

    def register(self, rows: list[tuple]) -> None:
        for dep, source, _ in rows:
            known = self.sources.setdefault(dep, [])
            if source not in known:
                known.append(source)

    def run(self) -> None:
        self.register(self.needs(self.root, None))
        for _ in range(ROUNDS):
            if not self.round():
                return
        raise RuntimeError(f"the selection did not settle in {ROUNDS} rounds")

    def round(self) -> bool:
        asked: dict[str, list[tuple]] = {}
        for rows in [self.needs(self.root, None), *(self.needs(d, self.manifest[d]) for d in self.sources if d in self.manifest)]:
            for dep, source, constraint in rows:
                asked.setdefault(dep, []).append((source, constraint))
        changed = False
        for dep, sources in self.sources.items():
            if dep in self.locked:
                if dep not in self.pick:
                    self.pick[dep], changed = self.locked[dep], True
                continue
            if dep in self.failed:
                continue
            alive = self.alive.setdefault(dep, {})
            for s in sources:
                alive.setdefault(s, self.candidates.get((dep, s), []))
            for source, constraint in asked.get(dep, []):
                fits = self.fits.get((dep, constraint), {})
                if not fits.get(source):
                    self.failed[dep] = "unsatisfiable"
                alive = {s: [r for r in fits.get(s, []) if r in set(alive[s])] for s in sources}
                if not any(alive.values()):
                    if dep in self.decisions and dep not in self.failed:
                        s, r = self.decisions[dep]
                        alive = {s: [r]} | {t: [] for t in sources if t != s}
                    else:
                        self.failed.setdefault(dep, "conflict")
                        break
            self.alive[dep] = alive
            if dep in self.failed:
                self.pick.pop(dep, None)
                changed = True
            elif dep not in self.pick:
                s = next((s for s in sources if alive.get(s)), None)
                if s is None:
                    self.failed[dep] = "conflict"
                else:
                    self.pick[dep] = s, alive[s][0]
                changed = True
            elif self.pick[dep][1] not in alive.get(self.pick[dep][0], []):
                del self.pick[dep], self.alive[dep]
                changed = True
        for dep in list(self.sources):
            if dep in self.pick:
                rev = self.pick[dep][1]
                n = sum(map(len, self.sources.values()))
                self.register(self.needs(dep, rev))
                changed = changed or self.manifest.get(dep) != rev or n != sum(map(len, self.sources.values()))
                self.manifest[dep] = rev
        return changed


def _settled_in_one_task(declared: DataFrame, candidates: DataFrame, fits: DataFrame, root: str, locked: DataFrame | None, decisions: DataFrame | None) -> DataFrame:
    """(dep, source, rev, reason): picks, and packages without one with the reason."""
    ship_package(declared.sparkSession)
    # a row for each list: the revisions that ask for one thing, a source's candidates, what a constraint admits in order
    asked = declared.groupBy("parent", "dep", "pos", "source", "constraint").agg(F.when(F.count_if(F.col("parent_rev").isNull()) == 0, F.collect_set("parent_rev")).alias("revs"))
    offered = candidates.select("dep", "source", "rev").distinct().groupBy("dep", "source").agg(F.array_sort(F.collect_list("rev")).alias("revs"))
    admitted = fits.groupBy("dep", "constraint", "source").agg(in_order("rev", "place", "rev").alias("revs"))
    row = lambda kind, a, b, c, d, n, revs: [F.lit(kind).alias("kind"), *[(F.col(x) if x else F.lit(None)).cast("string").alias(k) for k, x in zip("abcd", (a, b, c, d), strict=True)], n.cast("long").alias("n"), revs.alias("revs")]
    zero = F.lit(0)
    parts = [
        asked.withColumn("constraint", F.coalesce("constraint", F.lit(""))).select(*row("d", "parent", "dep", "source", "constraint", F.col("pos"), F.col("revs"))),
        offered.select(*row("c", "dep", "source", "", "", zero, F.col("revs"))),
        admitted.select(*row("f", "dep", "constraint", "source", "", zero, F.col("revs"))),
    ]
    for kind, df in (("l", locked), ("x", decisions)):
        if df is not None:
            parts.append(df.select(*row(kind, "dep", "source", "rev", "", zero, F.expr("cast(array() as array<string>)"))))
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)

    def run(frames) -> Iterator:
        import pandas as pd

        got = [r for pdf in frames for r in pdf.astype(object).where(pdf.notna(), None).itertuples(index=False, name=None)]
        if not got:
            return
        got.sort(key=lambda r: (r[0], r[5], str(r[1]), str(r[2]), str(r[3]), str(r[4])))
        said, offered, admitted, kept, chosen = {}, {}, {}, {}, {}
        for kind, a, b, c, d, _, revs in got:
            if kind == "d":
                said.setdefault(a, []).append((None if revs is None else frozenset(revs), b, c, d))
            elif kind == "c":
                offered[a, b] = list(revs)
            elif kind == "f":
                admitted.setdefault((a, b), {})[c] = list(revs)
            else:
                (kept if kind == "l" else chosen)[a] = b, c
        fix = Settled(root, said, offered, admitted, kept, chosen)
        fix.run()
        out = [(d, *fix.pick[d], None) for d in fix.sources if d in fix.pick] + [(d, None, None, why) for d, why in fix.failed.items()]
        yield pd.DataFrame(out, columns=["dep", "source", "rev", "reason"])

    return rows.coalesce(1).mapInPandas(run, "dep string, source string, rev string, reason string")


def _settled_by_joins(declared: DataFrame, candidates: DataFrame, fits: DataFrame, root: str, locked: DataFrame | None, decisions: DataFrame | None) -> DataFrame:
    """The same as a loop of joins. ``state`` has a row for each registered source: dep, source, arrival; ``alive`` one for
    each candidate that is left; ``picks`` dep, source, rev, and the manifest that counts."""
    spark = declared.sparkSession
    declared = declared.withColumn("constraint", F.coalesce("constraint", F.lit("")))
    offered = candidates.select("dep", "source", "rev").distinct()
    empty = lambda schema: spark.createDataFrame([], schema)
    held = locked.select("dep", "source", "rev") if locked is not None else empty("dep string, source string, rev string")
    chosen = decisions.select("dep", "source", F.col("rev").alias("decided")) if decisions is not None else empty("dep string, source string, decided string")

    def registered(rows: DataFrame) -> DataFrame:
        return rows.groupBy("dep", "source").agg(F.min("arrival").alias("arrival"))

    parents = spark.createDataFrame([(root, None, [])], "parent string, manifest string, arrival array<long>")

    def asked_by(who: DataFrame, number: int) -> DataFrame:
        """What the manifests of ``who`` ask for, with the order in which it arrives."""
        hit = F.col("parent_rev").isNull() | (F.col("parent_rev") == F.col("manifest"))
        at = F.concat(F.array(F.lit(number).cast("long")), "arrival", F.array("pos"))
        return declared.join(who, "parent").where(hit).select("dep", "source", "constraint", at.alias("arrival"))

    state = cut(registered(asked_by(parents, 0)), "state")
    alive, open_ = empty("dep string, source string, rev string"), None
    picks, failed = empty("dep string, source string, rev string, manifest string"), empty("dep string, reason string")
    for number in range(1, ROUNDS + 1):
        order = state.groupBy("dep").agg(F.min("arrival").alias("arrival"))
        who = parents.unionByName(picks.where("manifest IS NOT NULL").join(order, "dep").select(F.col("dep").alias("parent"), "manifest", "arrival"))
        ranked = asked_by(who, 0).join(held.select("dep"), "dep", "left_anti").join(failed.select("dep"), "dep", "left_anti")
        cons = ranked.groupBy("dep", "constraint", "source").agg(F.max("arrival").alias("last"))
        asked = cons.groupBy("dep", "constraint").agg(F.max("last").alias("last"))
        counted = asked.groupBy("dep").agg(F.count("*").alias("n"))
        known = state.join(held.select("dep"), "dep", "left_anti").join(failed.select("dep"), "dep", "left_anti")
        fresh = known.join(alive.select("dep", "source").distinct(), ["dep", "source"], "left_anti")
        if open_ is not None:
            fresh = fresh.unionByName(known.join(open_, "dep", "left_semi")).distinct()
        base = alive.unionByName(fresh.join(offered, ["dep", "source"]).select("dep", "source", "rev")).distinct()
        hits = asked.join(fits.select("dep", "constraint", "source", "rev", "place"), ["dep", "constraint"]).join(base, ["dep", "source", "rev"])
        left = hits.groupBy("dep", "source", "rev").agg(F.count("*").alias("k"), F.max_by("place", "last").alias("place")).join(counted, "dep").where("k = n")
        idle = base.join(counted, "dep", "left_anti").withColumn("place", F.lit(0))
        left = left.select("dep", "source", "rev", "place").unionByName(idle.select("dep", "source", "rev", "place"))
        barren = cons.join(fits.select("dep", "constraint", "source").distinct(), ["dep", "constraint", "source"], "left_anti").select("dep", F.lit("unsatisfiable").alias("reason")).distinct()
        torn = counted.select("dep").join(left.select("dep").distinct(), "dep", "left_anti").join(barren, "dep", "left_anti")
        settled = torn.join(chosen, "dep").select("dep", "source", F.col("decided").alias("rev"), F.lit(0).alias("place"))
        left = cut(left.join(barren, "dep", "left_anti").unionByName(settled), "alive")
        bad = barren.unionByName(torn.join(chosen.select("dep"), "dep", "left_anti").select("dep", F.lit("conflict").alias("reason")))
        failed = cut(failed.unionByName(bad).distinct(), "failed")
        best = Window.partitionBy("dep").orderBy("arrival", "source", "place", "rev")
        first = left.join(state, ["dep", "source"]).withColumn("i", F.row_number().over(best)).where("i = 1").select("dep", "source", "rev")
        old = picks.join(failed.select("dep"), "dep", "left_anti")
        valid = old.where("rev IS NOT NULL").join(left.select("dep", "source", "rev").unionByName(held), ["dep", "source", "rev"], "left_semi").select("dep", "source", "rev", F.col("rev").alias("manifest"))
        # a pick that is not alive any more opens its package; its manifest counts until the next pick
        invalid = old.where("rev IS NOT NULL").join(valid.select("dep"), "dep", "left_anti").select("dep", F.lit(None).cast("string").alias("source"), F.lit(None).cast("string").alias("rev"), "manifest")
        taken = first.unionByName(held.join(state.select("dep").distinct(), "dep", "left_semi")).join(old.where("rev IS NOT NULL").select("dep"), "dep", "left_anti").select("dep", "source", "rev", F.col("rev").alias("manifest"))
        new = cut(valid.unionByName(invalid).unionByName(taken), "picks")
        open_ = new.where("rev IS NULL").select("dep")
        alive = left.select("dep", "source", "rev").join(open_, "dep", "left_anti")
        begun = new.where("rev IS NOT NULL").join(order, "dep").select(F.col("dep").alias("parent"), "manifest", "arrival")
        found = registered(asked_by(begun, number)).join(state.select("dep", "source"), ["dep", "source"], "left_anti")
        grown = cut(state.unionByName(found), "state")
        same = ["dep", "source", "rev", "manifest"]
        changed = new.select(*same).exceptAll(picks.select(*same)).count() + grown.count() - state.count() + bad.count()
        picks, state = new, grown
        if not changed:
            done = picks.where("rev IS NOT NULL").select("dep", "source", "rev", F.lit(None).cast("string").alias("reason"))
            return done.unionByName(failed.select("dep", F.lit(None).cast("string").alias("source"), F.lit(None).cast("string").alias("rev"), "reason"))
    raise RuntimeError(f"the selection did not settle in {ROUNDS} rounds")


def resolve(declared: DataFrame, candidates: DataFrame, root: str, refs: DataFrame | None = None, locked: DataFrame | None = None, decisions: DataFrame | None = None, order: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(picked, failed): dep, source, version, text, rev of what is picked, and dep, reason (unsatisfiable: a constraint that
    no candidate of its own source meets; conflict) of what cannot be.

    ``declared`` (DECLARED) has what each version of each package asks for; without ``parent_rev``, or where it is null, a
    row holds for all versions. ``locked`` (dep, source, rev) is not chosen anew; ``decisions`` (dep, source, rev) settles
    conflicts that would else be reported. A dependency called like the root or its own package is an error."""
    if "parent_rev" not in declared.columns:
        declared = declared.withColumn("parent_rev", F.lit(None).cast("string"))
    # what no version of anything leads to from the root is left out first
    named = declared.select(F.col("parent").alias("src"), F.col("dep").alias("dst"))
    reached = cut(graph.closure(named, declared.sparkSession.createDataFrame([(root,)], "node string")), "reached")
    declared = declared.join(reached, F.col("parent") == F.col("node"), "left_semi")
    candidates = candidates.join(reached, F.col("dep") == F.col("node"), "left_semi")
    declared = cut(declared.select(*[c.split(" ")[0] for c in DECLARED.split(", ")]), "declared")
    clash = name_clashes(declared, root).orderBy("parent", "dep").first()
    if clash:
        raise ValueError(f"{clash['dep']}, asked for by {clash['parent']}, is called like {'the root' if clash['clash'] == 'root' else 'the package that asks for it'}")
    candidates = cut(candidates, "candidates")
    fits = cut(candidates_for(declared, candidates, refs, order), "fits")
    settle = _settled_in_one_task if declared.count() + fits.count() + candidates.count() <= SMALL_ROWS else _settled_by_joins
    rows = cut(settle(declared, candidates, fits, root, locked, decisions), "settled")
    told = candidates.groupBy("dep", "source", "rev").agg(F.max("version").alias("version"), F.max_by("text", "version").alias("text"))
    picked = rows.where("reason IS NULL").join(told, ["dep", "source", "rev"], "left").select("dep", "source", "version", "text", "rev")
    return picked, rows.where("reason IS NOT NULL").select("dep", "reason")


def lock_rows(picked: DataFrame, declared: DataFrame) -> DataFrame:
    """A lock (name, revision, version, source_kind, source_uri, dependencies) of picks: the version of a revision is the
    highest tag on it; dependencies are those of the picked version's manifest."""
    if "parent_rev" not in declared.columns:
        declared = declared.withColumn("parent_rev", F.lit(None).cast("string"))
    needs = picked.select(F.col("dep").alias("parent"), "rev").join(declared, "parent").where(F.col("parent_rev").isNull() | (F.col("parent_rev") == F.col("rev")))
    needs = needs.groupBy(F.col("parent").alias("dep")).agg(F.array_sort(F.collect_set(needs["dep"])).alias("dependencies"))
    path = F.col("rev") == ""
    rows = picked.join(needs, "dep", "left")
    return rows.select(F.col("dep").alias("name"), F.when(~path, F.col("rev")).alias("revision"), F.when(~path, F.col("text")).alias("version"), F.when(path, "Path").otherwise("Git").alias("source_kind"), F.col("source").alias("source_uri"), F.coalesce("dependencies", F.expr("cast(array() as array<string>)")).alias("dependencies"))


def update(lock: DataFrame, declared: DataFrame, tags: DataFrame, root: str, requested: list[str] | None = None, *, new_only: bool = False, recursive: bool = False, frozen: bool = False, overrides: DataFrame | None = None, checked_out: DataFrame | None = None, decisions: DataFrame | None = None, order: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(new lock, difference, told) of an update run: which rows of ``lock`` stay (``workspace.kept_locked``), their
    constraints in the place of declared ones, versions of the rest by ``tags`` (source, version, text, rev), and the rows
    that changed. ``told`` has W23 rows for kept revisions that are gone; those are chosen anew. A package that cannot be
    chosen is an error, with its constraints."""
    from .audit import lock_diff
    from .workspace import kept_locked

    names_ = kept_locked(lock, requested, new_only=new_only, recursive=recursive, frozen=frozen).select(F.col("name").alias("dep"))
    asked = cut(lock_constraints(lock).join(names_, "dep", "left_semi"), "kept")
    said = declared if "parent_rev" in declared.columns else declared.withColumn("parent_rev", F.lit(None).cast("string"))
    first = available(said.select("dep", "source", "constraint").unionByName(asked.select("dep", "source", "constraint")), tags)
    kept, told = kept_locks(asked, first)
    kept = cut(kept, "kept")
    rows = cut(overlaid(said, kept, overrides, checked_out).drop("origin"), "said")
    held = kept.select("dep", "source", F.coalesce("revision", F.lit("")).alias("rev"))
    picked, failed = resolve(rows, available(rows, tags), root, locked=held, decisions=decisions, order=order)
    bad = failed.orderBy("dep").first()
    if bad:
        listed = conflict_order(rows.where(F.col("dep") == bad["dep"])).orderBy("place").limit(20).collect()
        raise LookupError(f"{bad['dep']} is {bad['reason']}: " + "; ".join(f"{r['constraint'] or 'a path'} at {r['source']}" for r in listed))
    new = cut(lock_rows(picked, rows), "lock")
    return new, lock_diff(lock, new), told


def grouped_constraints(asked: DataFrame) -> DataFrame:
    """(dep, asked): who asks for a package, with constraint and source, in order of arrival. ``asked`` (dep, parent,
    constraint, source, pos)."""
    return asked.groupBy("dep").agg(in_order(F.struct("parent", "constraint", "source"), "pos").alias("asked"))


def conflict_order(asked: DataFrame) -> DataFrame:
    """Distinct constraints (dep, source, constraint, bottom, top, source_no, place) as a conflict lists them: by source;
    inside one, revisions by their text, then versions from the highest upper bound down, those without one first, then
    from the highest lower bound, then paths."""
    rows = asked.select("dep", "source", "constraint").distinct()
    ranges = semver.is_requirement(F.col("constraint"))
    rows = rows.withColumns({"kind": F.when(F.col("constraint").isNull(), 2).when(ranges, 1).otherwise(0), "top": F.when(ranges, semver.top_bound(F.col("constraint"))), "bottom": F.when(ranges, semver.bottom_bound(F.col("constraint")))})
    text = F.when(F.col("kind") == 0, F.col("constraint"))
    w = Window.partitionBy("dep")
    order = w.orderBy("source", "kind", text, F.col("top").desc_nulls_first(), F.col("bottom").desc_nulls_last(), "constraint")
    return rows.select("dep", "source", "constraint", semver.dotted(F.col("bottom")).alias("bottom"), semver.dotted(F.col("top")).alias("top"), F.dense_rank().over(w.orderBy("source")).cast("long").alias("source_no"), F.row_number().over(order).cast("long").alias("place"))
