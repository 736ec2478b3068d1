"""From manifests to source groups: the tree of all packages, cut to what targets and selection leave, and flattened.

Tables are those of ``sources.documents.SCHEMAS`` (packages, dep_decl, source_node, source_file, export_incdir), over
all packages of a lock. A package's tree hangs below its rank, ranks from the deepest up, the root package last; packages
of a rank by name. Nothing of a tree is gathered but one group's own lists.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..frames import cut, in_order
from ..functions import paths, targets
from ..operators import graph, tree

DEFINES = "array<struct<name:string,value:string>>"
TEXTS = "array<string>"
#: The wildcard that groups above packages and groups without a target carry.
ANY = "*"


def _none(kind: str) -> Column:
    return F.expr(f"cast(array() as {kind})")


def names(given: list[str] | None) -> list[str]:
    """Names of packages as given by hand: lower case, each once, in order."""
    return list(dict.fromkeys(x.lower() for x in given or []))


def find(packages: DataFrame, name: str) -> DataFrame:
    """The row of a package (pkg) by name; an unknown name is an error."""
    found = packages.where(F.col("pkg") == name.lower())
    if found.isEmpty():
        raise LookupError(f"there is no package called {name}")
    return found


def edges(declared: DataFrame) -> DataFrame:
    return declared.select(F.col("parent").alias("src"), F.col("dep").alias("dst"))


def locked_edges(lock: DataFrame) -> DataFrame:
    """(src, dst) of lock rows (name, dependencies); a dependency that no row is called is an error."""
    wanted = lock.select(F.col("name").alias("src"), F.explode("dependencies").alias("dst"))
    lost = wanted.join(lock.select(F.col("name").alias("dst")), "dst", "left_anti").orderBy("dst").first()
    if lost:
        raise LookupError(f"the lock has no {lost['dst']}, which {lost['src']} needs")
    return wanted


def ranked(declared: DataFrame, packages: DataFrame, root: str) -> DataFrame:
    """(pkg, rank) of every package but the root: 0 for its direct dependencies, and for those that it does not reach."""
    direct = declared.where(F.col("parent") == root).select(F.col("dep").alias("node")).distinct()
    inner = edges(declared).where(F.col("src") != root)
    found = graph.ranks(inner, direct, packages.where(F.col("pkg") != root).select(F.col("pkg").alias("node")))
    return found.where(F.col("node") != root).select(F.col("node").alias("pkg"), "rank")


def place(ranks: DataFrame, packages: DataFrame, root: str) -> DataFrame:
    """(pkg, at): where a package stands among all."""
    last = F.col("pkg") == root
    rows = packages.select("pkg").distinct().join(ranks, "pkg", "left")
    return rows.select("pkg", F.struct(last.cast("int").alias("last"), (-F.coalesce("rank", F.lit(0))).alias("depth"), F.col("pkg").alias("name")).alias("at"))


def selected(declared: DataFrame, root: str, packages: list[str] | None = None, exclude: list[str] | None = None, no_deps: bool = False) -> DataFrame:
    """(pkg): the named packages, or the root, and what they need, without the excluded ones, which are not crossed."""
    spark = declared.sparkSession
    start = spark.createDataFrame([(x,) for x in names(packages) or [root]], "node string")
    out = spark.createDataFrame([(x,) for x in names(exclude)], "node string")
    if no_deps:
        return start.join(out, "node", "left_anti").select(F.col("node").alias("pkg"))
    return graph.closure(edges(declared), start, out).select(F.col("node").alias("pkg"))


def _own(raw: list[str], package: str) -> list[str]:
    """The targets of a list that count for a package."""
    local = [t if ":" not in t else t.split(":", 1)[1] for t in raw if ":" not in t or t.split(":", 1)[0] in (package, "*")]
    gone = {t[1:] for t in local if t.startswith("-")}
    return list(dict.fromkeys(t for t in local if not t.startswith("-") and t not in gone))


def passed_targets(declared: DataFrame, ranks: DataFrame, root: str, given: list[str], used: DataFrame, required: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """((pkg, target) of passed targets, (pkg) of the packages that remain).

    The root's dependencies come first, in order, each judged by the targets of the dependency; one's passed targets are
    seen by those after it. Then rank by rank, lowest first, each required package's dependencies, judged by its own
    targets. What remains are the packages that are used and required."""
    spark = declared.sparkSession
    raw, need, passes = [t.lower() for t in given], set(names(required)), []
    own = declared.where(F.col("parent") == root).orderBy("pos").select("dep", "target", "pass_targets").collect()  # one manifest
    if not used.where(F.col("pkg") == root).isEmpty():
        need.add(root)
        for dep, target, pass_targets in own:
            holds = lambda text, dep=dep: targets.holds(targets.ANYTHING if text is None else targets.parse(text), set(_own(raw, dep)))
            for p in pass_targets or []:
                if holds(target) and holds(p["target"]):
                    raw.append(f"{dep}:{p['pass']}")
                    passes.append((dep, p["pass"]))
            if holds(target):
                need.add(dep)
    base = F.array(*map(F.lit, [t.lower() for t in given])) if given else _none(TEXTS)
    passed = spark.createDataFrame(passes, "pkg string, target string")
    needed = spark.createDataFrame([(x,) for x in sorted(need)], "pkg string")
    inner = declared.where(F.col("parent") != root).select("parent", "dep", "target", F.explode_outer("pass_targets").alias("p")).select("parent", "dep", "target", F.col("p.target").alias("when"), F.col("p.pass").alias("pass"))
    inner = cut(targets.programs(targets.programs(inner, "target", "needs"), "when", "passes").select("parent", "dep", "needs", "passes", "pass"), "declared")
    depth = ranks.agg(F.max("rank")).first()[0]
    for rank in range(0, (depth if depth is not None else -1) + 1):
        now = ranks.where(F.col("rank") == rank).join(used, "pkg", "left_semi").join(needed.distinct(), "pkg", "left_semi").select("pkg")
        said = passed.groupBy("pkg").agg(F.collect_set("target").alias("said"))
        mine = now.join(said, "pkg", "left").select(F.col("pkg").alias("parent"), targets.for_package(F.concat(base, F.coalesce(F.transform("said", lambda t: F.concat("pkg", F.lit(":"), t)), _none(TEXTS))), F.col("pkg")).alias("active"))
        rows = cut(inner.join(mine, "parent").select("dep", "pass", targets.run(F.col("needs"), F.col("active")).alias("needs"), targets.run(F.col("passes"), F.col("active")).alias("passes")), "passing")
        new = rows.where("needs AND passes AND pass IS NOT NULL").select(F.col("dep").alias("pkg"), F.col("pass").alias("target"))
        passed = cut(passed.unionByName(new).distinct(), "passed")
        needed = cut(needed.unionByName(rows.where("needs").select(F.col("dep").alias("pkg"))).distinct(), "needed")
    return passed, used.join(needed.distinct(), "pkg", "left_semi")


def effective(packages: DataFrame, given: list[str], passed: DataFrame | None = None) -> DataFrame:
    """(pkg, active): the targets that count for each package."""
    base = F.array(*map(F.lit, [t.lower() for t in given])) if given else _none(TEXTS)
    rows = packages.select("pkg").distinct()
    said = _none(TEXTS)
    if passed is not None:
        rows = rows.join(passed.groupBy("pkg").agg(F.collect_set("target").alias("said")), "pkg", "left")
        said = F.coalesce(F.transform("said", lambda t: F.concat("pkg", F.lit(":"), t)), said)
    return rows.select("pkg", F.array_distinct(targets.for_package(F.concat(base, said), F.col("pkg"))).alias("active"))


def _kept(df: DataFrame, keys: list[str], entries: str, value: str) -> DataFrame:
    """``df`` (keys, active, entries: structs with a target) with those entries whose target holds, as ``value`` of each."""
    rows = df.select(*keys, "active", F.posexplode(entries).alias("at", "x")).select(*keys, "active", "at", F.col("x.target").alias("target"), "x")
    held = targets.programs(rows, "target", "program").where(targets.run(F.col("program"), F.col("active")))
    return held.groupBy(*keys).agg(in_order(F.expr(value), "at").alias("kept"))


def _laid(below: Column, above: Column) -> Column:
    """Ordered maps: a name at its first place, with its last value."""
    every = F.concat(below, above)
    keys = F.array_distinct(F.transform(every, lambda d: d["name"]))
    return F.transform(keys, lambda k: F.element_at(F.filter(every, lambda d: d["name"] == k), -1))


def _lineage(nodes: DataFrame) -> DataFrame:
    """Nodes below their package, with path (positions from the top) and what they inherit."""
    keyed = nodes.withColumns({"key": F.struct("pkg", "node"), "up_key_": F.when(F.col("parent").isNotNull(), F.struct("pkg", F.col("parent").alias("node")))})
    own = {"path": F.array(F.col("pos").cast("long")), "chain": F.array(F.coalesce("target", F.lit(ANY))), "dirs": F.col("own_dirs"), "defines": F.col("own_defines"), "line": F.array("key")}
    below = {
        "path": F.array_append("up.path", F.col("pos").cast("long")), "chain": F.array_append("up.chain", F.coalesce("target", F.lit(ANY))), "dirs": F.concat("up.dirs", "own_dirs"),
        "defines": _laid(F.col("up.defines"), F.col("own_defines")), "line": F.array_append("up.line", F.col("key")),
    }
    return tree.by_level(keyed, own, below, key="key", parent="up_key_")


def _nodes(tables: dict[str, DataFrame], active: DataFrame | None) -> DataFrame:
    """Group nodes with their own directories and defines; with ``active``, those whose target holds, and the entries whose
    targets do, with a define for each target."""
    nodes = tables["source_node"]
    plain_dirs = F.coalesce(F.transform("include_dirs", lambda d: d["dir"]), _none(TEXTS))
    plain_defines = F.coalesce(F.transform("defines", lambda d: F.struct(d["name"].alias("name"), d["value"].alias("value"))), _none(DEFINES))
    columns = ["pkg", "node", "parent", "pos", "target", "override_files"]
    if active is None:
        return nodes.select(*columns, plain_dirs.alias("own_dirs"), plain_defines.alias("own_defines"))
    rows = cut(nodes.join(active, "pkg"), "nodes")
    held = targets.programs(rows, "target", "program").where(targets.run(F.col("program"), F.col("active"))).drop("program")
    dirs = _kept(rows, ["pkg", "node"], "include_dirs", "x.dir").withColumnRenamed("kept", "own_dirs")
    defines = _kept(rows, ["pkg", "node"], "defines", "struct(x.name AS name, x.value AS value)").withColumnRenamed("kept", "kept_defines")
    told = F.transform(targets.target_defines(F.col("active")), lambda n: F.struct(n.alias("name"), F.lit(None).cast("string").alias("value")))
    joined = held.join(dirs, ["pkg", "node"], "left").join(defines, ["pkg", "node"], "left")
    return joined.select(*columns, F.coalesce("own_dirs", _none(TEXTS)).alias("own_dirs"), _laid(F.coalesce("kept_defines", _none(DEFINES)), told).alias("own_defines"))


def exported_dirs(tables: dict[str, DataFrame], active: DataFrame | None, kept: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """((pkg, exported) in order, diagnostics): each package's own exported directories, then those of its direct
    dependencies in order of declaration, one level only. Directories whose target does not hold for the exporting
    package, and of packages that are not ``kept``, are left out. A dependency that is no package is told as W13."""
    own = tables["export_incdir"]
    if active is not None:
        rows = targets.programs(own.join(active, "pkg"), "target", "program")
        own = rows.where(targets.run(F.col("program"), F.col("active")))
    if kept is not None:
        own = own.join(kept, "pkg", "left_semi")
    known = tables["packages"].select("pkg").distinct()
    said = tables["dep_decl"].groupBy("parent", "dep").agg(F.min("pos").alias("order"))
    sides = known.select("pkg", F.col("pkg").alias("of"), F.lit(-1).cast("long").alias("order")).unionByName(said.select(F.col("parent").alias("pkg"), F.col("dep").alias("of"), "order"))
    dirs = sides.join(own.select(F.col("pkg").alias("of"), "pos", "path"), "of").groupBy("pkg").agg(in_order("path", "order", "pos").alias("exported"))
    lost = said.select(F.col("dep").alias("pkg")).distinct().join(known, "pkg", "left_anti")
    told = lost.select(F.col("pkg").alias("subject"), F.lit("W13").alias("code"), F.lit("warning").alias("severity"), F.concat(F.lit("no exported directories are known of "), "pkg").alias("message"))
    return dirs, told


def flattened(tables: dict[str, DataFrame], order: DataFrame, active: DataFrame | None = None, kept: DataFrame | None = None, keep_excluded_dirs: bool = False) -> DataFrame:
    """The groups of all packages as one list: pkg, at (its place), chain (targets from the package's top down), dirs,
    exported, defines, files (path, file_type), override_files, dependencies.

    A group inherits directories (its parent's first) and defines (its own value at its parent's place). Loose files are
    one group for each stretch between subgroups that still have files. ``active`` (pkg, active) filters by target,
    ``kept`` (pkg) by package; without them the list is raw."""
    nodes = _nodes(tables, active)
    if kept is not None:
        nodes = nodes.join(kept, "pkg", "left_semi")
    groups = cut(_lineage(nodes).select("pkg", "node", "parent", "pos", "path", "chain", "dirs", "defines", "line", "override_files"), "groups")
    files = tables["source_file"].join(groups.select("pkg", "node"), ["pkg", "node"])
    files = cut(files.select("pkg", "node", "pos", F.col("path").alias("file"), paths.file_type(F.col("path"), F.col("declared")).alias("file_type")), "files")
    full = files.select("pkg", "node").distinct().join(groups, ["pkg", "node"]).select(F.explode("line").alias("k")).select("k.pkg", "k.node").distinct()
    inner = groups.where("parent IS NOT NULL").join(full, ["pkg", "node"], "left_semi").select("pkg", F.col("parent").alias("node"), "pos")
    items = files.select(F.struct("pkg", "node").alias("node"), "pos", F.lit(False).alias("is_group"), F.lit(False).alias("independent"), "file", "file_type")
    marks = inner.select(F.struct("pkg", "node").alias("node"), "pos", F.lit(True).alias("is_group"), F.lit(False).alias("independent"), F.lit(None).cast("string").alias("file"), F.lit(None).cast("string").alias("file_type"))
    loose = tree.flatten(items.unionByName(marks)).groupBy("node", "run").agg(F.min("pos").alias("first"), in_order(F.struct(F.col("file").alias("path"), "file_type"), "pos").alias("files"))
    loose = loose.select("node.pkg", "node.node", "first", "files")
    exported, _ = exported_dirs(tables, active, None if keep_excluded_dirs else kept)
    needs = tables["dep_decl"].groupBy(F.col("parent").alias("pkg")).agg(F.array_distinct(in_order("dep", "pos")).alias("dependencies"))
    out = loose.join(groups, ["pkg", "node"]).join(exported, "pkg", "left").join(needs, "pkg", "left").join(order, "pkg")
    at = F.struct("at", F.array_append("path", F.col("first").cast("long")).alias("path"))
    return out.select("pkg", at.alias("at"), "chain", "dirs", F.coalesce("exported", _none(TEXTS)).alias("exported"), "defines", "files", "override_files", F.coalesce("dependencies", _none(TEXTS)).alias("dependencies"))


def include_dirs(dirs: Column, exported: Column) -> Column:
    """Own directories, then exported ones, each once."""
    return F.array_distinct(F.concat(dirs, exported))


def filter_packages(files: DataFrame, selection: DataFrame, pkg: str = "pkg", path: str = "path") -> DataFrame:
    """``files`` with the path of those outside the selection (pkg) taken away: their groups stay, empty."""
    inside = selection.select(F.col("pkg").alias("inside_")).distinct()
    return files.join(inside, F.col(pkg) == F.col("inside_"), "left").withColumn(path, F.when(F.col("inside_").isNotNull(), F.col(path))).drop("inside_")


def assume_target(target: Column, name: str) -> Column:
    """A target for groups that declare none."""
    return F.coalesce(target, F.lit(name))


def non_empty(nodes: DataFrame, holders: DataFrame) -> DataFrame:
    """(node): groups (node, parent) that have a file somewhere below, ``holders`` (node) being those that have one."""
    up = nodes.where("parent IS NOT NULL").select(F.col("node").alias("src"), F.col("parent").alias("dst"))
    return graph.closure(up, holders.select("node"))


def used_dirs(dirs: DataFrame, headers: DataFrame) -> DataFrame:
    """Directories (dir) that are, or hold, some header (header). Each header is spread over its own ancestors, so the join
    is by equality."""
    parts = F.split("header", "/")
    above = headers.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))).alias("dir"))
    return dirs.join(above, "dir", "left_semi")


def shown_target(chain: Column) -> Column:
    """The target of a group as its package and groups give it together, reduced for display."""

    @F.pandas_udf("string")
    def shown(chains):
        known: dict[tuple, str] = {}

        def text(chain) -> str:
            key = tuple(chain)
            if key not in known:
                now = targets.group("all", [targets.ANYTHING])  # the ranks above
                for t in key:
                    own = targets.ANYTHING if t == ANY else targets.parse(t)
                    now = targets.group("all", [now, targets.group("all", [own])])
                known[key] = str(targets.reduce(now))
            return known[key]

        return chains.map(text)

    return shown(chain)


def assembled(tables: dict[str, DataFrame], root: str, given: list[str], *, packages: list[str] | None = None, exclude: list[str] | None = None, no_deps: bool = False, ignore_passed: bool = False, keep_excluded_dirs: bool = False) -> DataFrame:
    """The whole run up to the flattened list: ranks, selection, passed targets, filters."""
    from ..shipping import ship_package

    ship_package(tables["packages"].sparkSession)
    declared = tables["dep_decl"]
    ranks = cut(ranked(declared, tables["packages"], root), "ranks")
    used = cut(selected(declared, root, packages, exclude, no_deps), "used")
    passed = None
    if not ignore_passed:
        passed, used = passed_targets(declared, ranks, root, given, used, packages)
        used = cut(used, "used")
    active = cut(effective(tables["packages"], given, passed), "active")
    return flattened(tables, place(ranks, tables["packages"], root), active, used, keep_excluded_dirs)


def raw(tables: dict[str, DataFrame], root: str) -> DataFrame:
    """The flattened list of everything, nothing filtered."""
    ranks = ranked(tables["dep_decl"], tables["packages"], root)
    return flattened(tables, place(ranks, tables["packages"], root))


def add_defines(defines: Column, given: list[str]) -> Column:
    """Defines with those from the command line (``name=value`` or ``name``), cut at the first = and trimmed, last."""
    parts = [(x.split("=", 1)[0].strip(), x.split("=", 1)[1].strip() if "=" in x else None) for x in given]
    extra = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(v).cast("string").alias("value")) for n, v in parts]) if parts else _none(DEFINES)
    return _laid(defines, extra)


def render_groups(groups: DataFrame, define: list[str] | None = None) -> DataFrame:
    """Rows for the renderers, of flattened groups: override groups give replacements by name, the others are cut into runs
    of one file type; (no, metadata, file_type, defines, incdirs, files)."""
    from .manifest import override
    from .resolve import interned

    given = groups.where("override_files").select("pkg", "at", F.posexplode("files").alias("i", "f")).select("pkg", F.struct("at", "i").alias("order"), "f.path")
    plain = groups.where("NOT override_files")
    rows = plain.select("at", "pkg", F.posexplode("files").alias("pos", "f")).select("at", "pkg", "pos", "f.path", "f.file_type")
    told = override(rows, given, "order")
    run = tree.runs(told, F.col("file_type"), ["pos"], ["at"])
    lists = run.groupBy("at", "run").agg(F.first("file_type").alias("file_type"), in_order(F.struct(F.col("path").alias("file"), "comment"), "pos").alias("files"))
    lists = cut(lists.join(plain.select("at", "pkg", "chain", "dirs", "exported", "defines"), "at"), "runs")
    numbers = interned(lists, ["at", "run"])
    metadata = F.concat(F.lit("Package("), "pkg", F.lit(") Target("), shown_target(F.col("chain")), F.lit(")"))
    return lists.join(numbers, ["at", "run"]).select(F.col("ref").cast("long").alias("no"), metadata.alias("metadata"), "file_type", add_defines(F.col("defines"), define or []).alias("defines"), F.array_sort(include_dirs(F.col("dirs"), F.col("exported"))).alias("incdirs"), "files")


_PLAIN = {"ignoreNullFields": "false"}


def as_json(groups: DataFrame, *, with_targets: bool = False) -> DataFrame:
    """(at, json) of flattened groups; order by ``at``. ``with_targets`` shows the raw form. Files of override groups are
    told like any others."""
    defines = F.map_from_entries(F.transform("defines", lambda d: F.struct(d["name"], d["value"])))
    fields = [F.col("pkg").alias("package"), F.lit(False).alias("independent"), F.concat("dirs", "exported").alias("include_dirs"), defines.alias("defines"), F.transform("files", lambda f: f["path"]).alias("files"), "dependencies"]
    if with_targets:
        fields.insert(2, shown_target(F.col("chain")).alias("target"))
    return groups.select("at", F.to_json(F.struct(*fields), _PLAIN).alias("json"))


def _listed(entries: DataFrame, keys: list[str], at: str) -> DataFrame:
    return entries.groupBy(*keys).agg(F.array_join(in_order("json", at), ",").alias("inner"))


def _group(package: Column, independent: bool, dirs: Column, defines: Column, inner: Column, dependencies: Column) -> Column:
    """The JSON of a group around the JSON of what it holds."""
    shown = F.to_json(F.struct(package.alias("package"), F.lit(independent).alias("independent"), dirs.alias("include_dirs"), F.map_from_entries(F.transform(defines, lambda d: F.struct(d["name"], d["value"]))).alias("defines")), _PLAIN)
    return F.concat(F.substr(shown, F.lit(1), F.length(shown) - 1), F.lit(',"files":['), inner, F.lit('],"dependencies":'), F.to_json(dependencies), F.lit("}"))


def nested_json(tables: dict[str, DataFrame], ranks: DataFrame, root: str, active: DataFrame | None = None, kept: DataFrame | None = None, keep_excluded_dirs: bool = False) -> str:
    """The tree of all packages as one JSON text: ranks, packages, groups, files. Built from the deepest groups up; groups
    without files are left out. The text is that of one project, and the driver holds it."""
    nodes = _nodes(tables, active)
    if kept is not None:
        nodes = nodes.join(kept, "pkg", "left_semi")
    groups = _lineage(nodes).select("pkg", "node", "parent", "pos", F.size("path").alias("depth"), "own_dirs", "own_defines")
    exported, _ = exported_dirs(tables, active, None if keep_excluded_dirs else kept)
    needs = tables["dep_decl"].groupBy(F.col("parent").alias("pkg")).agg(F.array_distinct(in_order("dep", "pos")).alias("needs"))
    groups = cut(groups.join(exported, "pkg", "left").join(needs, "pkg", "left"), "groups")
    quoted = F.substr(F.to_json(F.array("path")), F.lit(2), F.length(F.to_json(F.array("path"))) - 2)
    entries = tables["source_file"].select("pkg", "node", "pos", quoted.alias("json"))
    none = _none(TEXTS)
    depth = groups.agg(F.max("depth")).first()[0] or 0
    for level in range(depth, 0, -1):
        now = groups.where(F.col("depth") == level).join(_listed(entries, ["pkg", "node"], "pos"), ["pkg", "node"])
        made = now.select("pkg", F.col("parent").alias("node"), "pos", _group(F.col("pkg"), False, F.concat("own_dirs", F.coalesce("exported", none)), F.col("own_defines"), F.col("inner"), F.coalesce("needs", none)).alias("json"))
        entries = cut(entries.unionByName(made), "entries")
    tops = entries.where("node IS NULL").join(ranks, "pkg", "left").select("json", "pkg", F.when(F.col("pkg") == root, -1).otherwise(F.coalesce("rank", F.lit(0))).alias("rank"))
    bare = lambda independent, inner: _group(F.lit(None).cast("string"), independent, none, _none(DEFINES), inner, none)
    levels = _listed(tops, ["rank"], "pkg").select(bare(True, F.col("inner")).alias("json"), (-F.col("rank")).alias("order"), F.lit(0).alias("one"))
    levels = levels.withColumn("order", F.when(F.col("order") == 1, 1 << 30).otherwise(F.col("order")))
    found = _listed(levels, ["one"], "order").select(bare(False, F.col("inner")).alias("json")).first()
    return found["json"] if found else ""


def override_warnings(groups: DataFrame) -> DataFrame:
    """W35 rows (subject, code, severity, message) for packages whose override groups a source list takes as they are."""
    return groups.where("override_files").select("pkg").distinct().select(F.col("pkg").alias("subject"), F.lit("W35").alias("code"), F.lit("warning").alias("severity"), F.concat(F.lit("overrides are ignored here: "), "pkg").alias("message"))


def missing_dirs(groups: DataFrame, folders: DataFrame) -> DataFrame:
    """W24 rows (subject, code, severity, message) for include directories that a listing of folders (path) lacks."""
    dirs = groups.select("pkg", F.explode(include_dirs(F.col("dirs"), F.col("exported"))).alias("path")).distinct()
    gone = dirs.join(folders.select("path").distinct(), "path", "left_anti")
    return gone.select(F.col("pkg").alias("subject"), F.lit("W24").alias("code"), F.lit("warning").alias("severity"), F.concat(F.lit("no such directory: "), "path").alias("message"))
