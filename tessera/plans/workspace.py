"""What a workspace needs done: plans as tables. Nothing on disk is changed here; an action is a row.

Inputs are what ingestion recorded about working copies, links, databases and patch folders.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..frames import cut
from ..functions import paths

#: Parents that are looked at from a folder upwards.
STEPS = 100


def roots(starts: DataFrame, manifests: DataFrame, steps: int = STEPS) -> DataFrame:
    """(start, root) of starts (start, device): the nearest folder of manifests (dir, device) at or above ``start``, at
    most ``steps`` folders up and on the same device; null if there is none."""
    parts = F.split(F.regexp_replace("start", "/+$", ""), "/")
    up = starts.select("start", "device", F.posexplode(F.transform(F.sequence(F.lit(0), F.least(F.size(parts), F.lit(steps)) - 1), lambda k: F.array_join(F.slice(parts, F.lit(1), F.size(parts) - k), "/"))).alias("depth", "dir"))
    up = up.withColumn("dir", F.when(F.col("dir") == "", "/").otherwise(F.col("dir")))
    found = up.join(manifests.select("dir", "device").distinct(), ["dir", "device"]).groupBy("start").agg(F.min_by("dir", "depth").alias("root"))
    return starts.select("start").join(found, "start", "left").select("start", "root")


def link_action(exists: Column, is_link: Column, leads_to: Column, wanted: Column) -> Column:
    """skip (a real file is in the way, W01), keep, replace or create."""
    return F.when(~exists, "create").when(~is_link, "skip").when(leads_to.eqNullSafe(wanted), "keep").otherwise("replace")


def checkout_state(exists: Column, current: Column, wanted: Column, same_url: Column, status_ok: Column, *, chosen_dir: Column, force: Column, listed: Column) -> Column:
    """(state, code): clean, checkout or clone, and a warning's code. In a folder that the user chose, a copy that is
    neither forced nor listed for update is never scrapped: it stays, with W19, unless it can be checked out."""
    raw = F.when(~exists | current.isNull(), "clone").when(current == wanted, "clean").when(F.coalesce(same_url, F.lit(False)), "checkout").otherwise("clone")
    guarded = exists & chosen_dir & ~force & ~listed & (raw != "clean") & ~((raw == "checkout") & F.coalesce(status_ok, F.lit(False)))
    return F.struct(F.when(guarded, "clean").otherwise(raw).alias("state"), F.when(guarded, "W19").alias("code"))


def database_action(exists: Column, manifest_time: Column, fetch_time: Column, *, force: Column | None = None, local_only: bool = False) -> Column:
    """init, fetch or skip. A database fetched after the manifest changed is fresh; ``force`` (true, false or null)
    decides before that; without network there is no fetch, and a missing database is an error."""
    fresh = F.coalesce(manifest_time < fetch_time, F.lit(False))
    skip = F.lit(True) if local_only else fresh if force is None else F.when(force.isNull(), fresh).otherwise(~force)
    missing = F.raise_error(F.lit("a database is missing and there is no network")).cast("string") if local_only else F.lit("init")
    return F.when(~exists, missing).when(skip, "skip").otherwise("fetch")


def first_line(output: Column) -> Column:
    """The current revision or a remote's address, from recorded output; null if there was none."""
    line = F.split(output, "\n")[0]
    return F.when(line != "", line)


def present_overrides(folders: DataFrame, *, ignore: bool = False) -> DataFrame:
    """(name, path, reason, code) of folders (name, path, is_git, status) in the checkout folder that stand for their
    package: those that are no repositories and those with changes."""
    reason = F.when(~F.col("is_git"), "not a repository").when(F.col("status") != "", "changed")
    rows = folders.select("name", "path", reason.alias("reason")).where("reason IS NOT NULL").withColumn("code", F.lit("W06"))
    return rows.where(F.lit(not ignore))


def relocated(declared: DataFrame, packages: DataFrame) -> DataFrame:
    """(pkg, dep, path, code): path dependencies inside a version-controlled dependency, counted from its checkout.

    ``declared`` (pkg, dep, path) has the relative path dependencies of each manifest found in the repository;
    ``packages`` (pkg, root) the packages to start from. Rows are followed until nothing new is found."""
    inner = cut(declared.where("path IS NOT NULL AND NOT startswith(path, '/')").select(F.col("pkg").alias("owner"), "dep", "path").distinct(), "inner")
    seen = front = cut(packages.select("pkg", F.col("pkg").alias("dep"), F.col("root").alias("path")), "relocated")
    while True:
        step = front.join(inner.withColumnRenamed("dep", "sub").withColumnRenamed("path", "rel"), F.col("dep") == F.col("owner"))
        found = step.select("pkg", F.col("sub").alias("dep"), paths.normal(paths.joined(F.col("path"), F.col("rel"))).alias("path")).distinct()
        # each package is followed once below a start, so cycles end
        once = found.join(seen, ["pkg", "dep"], "left_anti").groupBy("pkg", "dep").agg(F.min("path").alias("path"))
        front = cut(once, "relocated")
        if front.isEmpty():
            return seen.where("pkg <> dep").withColumn("code", F.lit("W09"))
        seen = cut(seen.unionByName(front), "relocated")


def moved_with(pkg: str, declared: DataFrame, roots_: DataFrame, target: str) -> DataFrame:
    """(dep, path): path dependencies that lie under ``pkg``'s folder, and theirs under their own, after ``pkg`` moves
    to ``target``. ``declared`` (pkg, dep, path) with absolute paths; ``roots_`` (pkg, root)."""
    home = declared.join(roots_, "pkg")
    below = home.where(paths.under(F.col("path"), F.col("root")) & (F.col("path") != F.col("root")))
    inside = cut(below.select("pkg", "dep", F.expr("substring(path, length(regexp_replace(root, '/+$', '')) + 2)").alias("rest")), "inside")
    seen = front = cut(inside.where(F.col("pkg") == pkg).groupBy("dep").agg(F.min("rest").alias("rest")), "moved")
    while not front.isEmpty():
        found = front.select(F.col("dep").alias("owner")).join(inside, F.col("owner") == F.col("pkg")).groupBy("dep").agg(F.min("rest").alias("rest"))
        front = cut(found.join(seen, "dep", "left_anti").where(F.col("dep") != pkg), "moved")
        seen = cut(seen.unionByName(front), "moved")
    return seen.select("dep", paths.joined(F.lit(target), F.col("rest")).alias("path"))


def override_text(text: Column, names: Column, entries: Column, *, create: bool) -> Column:
    """An override file with ``entries`` (an array of lines) added under its heading, and every line that names one of
    ``names`` commented out once for each. Without a heading one is put first if ``create``, else nothing changes."""
    added = F.concat(F.array_join(entries, "\n"), F.lit("\n"))
    heading = "overrides:"

    def line(x: Column) -> Column:
        marks = F.array_join(F.transform(F.filter(names, lambda n: F.contains(x, n)), lambda n: F.lit("#")), "")
        return F.concat(marks, x, F.lit("\n"), F.when(F.contains(x, F.lit(heading)), added).otherwise(""))

    rows = F.array_join(F.transform(F.split(text, "\n"), line), "")
    kept = F.when(F.endswith(text, F.lit("\n")), F.substr(rows, F.lit(1), F.length(rows) - 1)).otherwise(rows)
    other = F.concat(F.lit(f"{heading}\n"), added, F.coalesce(text, F.lit(""))) if create else text
    return F.when(F.size(entries) == 0, text).when(F.contains(text, F.lit(heading)), kept).otherwise(other)


def patch_order(listing: DataFrame) -> DataFrame:
    """(dir, name, place) of the patches among the files (dir, name) of patch folders, in the order in which they apply: by
    their names in lower case."""
    from pyspark.sql import Window

    rows = listing.where(F.endswith("name", F.lit(".patch")))
    return rows.select("dir", "name", F.row_number().over(Window.partitionBy("dir").orderBy(F.lower("name"), "name")).alias("place"))


def link_excludes(links: DataFrame) -> DataFrame:
    """``links`` (vendor, id, path, is_file) with place, their order of priority (files first, then deeper paths, then as
    given by ``id``), and exclude: the paths of links before that a link's own path holds."""
    from pyspark.sql import Window

    w = Window.partitionBy("vendor").orderBy(F.desc("is_file"), F.desc(F.size(F.split("path", "/"))), "id")
    placed = links.withColumn("place", F.row_number().over(w))
    parts = F.split("path", "/")
    # each link is spread over its own ancestors, so the join is by equality
    above = placed.select("vendor", F.col("path").alias("inner"), F.col("place").alias("before"), F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/")))).alias("path"))
    inside = placed.select("vendor", "id", "path", "place").join(above, ["vendor", "path"]).where("before < place")
    found = inside.groupBy("vendor", "id").agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("before", "inner"))), lambda x: x["inner"])).alias("exclude"))
    return placed.join(found, ["vendor", "id"], "left").withColumn("exclude", F.coalesce("exclude", F.expr("cast(array() as array<string>)")))


def next_patch(patches: DataFrame) -> DataFrame:
    """(dir, number) of patches (dir, name): one above the largest of the four leading digits of ``*.patch`` names, 1 in
    a folder without patches; a patch without such digits is an error."""
    patch = paths.extension(F.col("name")) == "patch"
    lead = F.left("name", F.lit(4))
    number = F.when(patch & lead.rlike("^[0-9]{4}$"), lead.cast("int")).when(patch, F.raise_error(F.concat(F.lit("patches must start with four digits in "), F.col("dir"))).cast("int"))
    return patches.groupBy("dir").agg((F.coalesce(F.max(number), F.lit(0)) + 1).alias("number"))


def _prefixes(parts: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))


def patches(files: DataFrame, names: DataFrame, *, fresh: bool = False) -> DataFrame:
    """(dir, number, text) of a patch for each folder whose files (dir, path, old, new) differ: their plain differences by
    path, under the next number of the folder's patches (dir, name), or under 1 with ``fresh``. A side that is null is a file
    that came or went."""
    from ..frames import in_order
    from ..shipping import ship_package

    ship_package(files.sparkSession)

    def run(batches):
        import difflib

        def text(path, old, new) -> str:
            a, b = (x.splitlines(keepends=True) if x is not None else [] for x in (old, new))
            lines = difflib.unified_diff(a, b, f"a/{path}" if old is not None else "/dev/null", f"b/{path}" if new is not None else "/dev/null")
            return "".join(x if x.endswith("\n") else f"{x}\n\\ No newline at end of file\n" for x in lines)

        for pdf in batches:
            pdf = pdf.astype(object).where(pdf.notna(), None)
            yield pdf.assign(text=[text(*r) for r in zip(pdf["path"], pdf["old"], pdf["new"], strict=True)])[["dir", "path", "text"]]

    changed = files.where(~F.col("old").eqNullSafe(F.col("new"))).select("dir", "path", "old", "new").mapInPandas(run, "dir string, path string, text string")
    whole = changed.groupBy("dir").agg(F.array_join(in_order("text", "path"), "").alias("text"))
    number = next_patch(names) if not fresh else names.select("dir").limit(0).withColumn("number", F.lit(1))
    return whole.join(number, "dir", "left").select("dir", F.coalesce("number", F.lit(1)).alias("number"), "text")


def copied(path: Column, include: Column, exclude: Column) -> Column:
    """Whether a file is copied: it and every folder above it match an include pattern or a folder of one, and no
    exclude pattern. A pattern without wildcards may name a folder and stands for all in it; "" is everything."""
    plain = lambda p: ~p.rlike(r"[*?\[]")
    tree = lambda ps: F.array_distinct(F.flatten(F.transform(ps, lambda p: F.when(p.isin("", "."), F.array(F.lit("**"))).when(plain(p), F.array(p, F.concat(p, F.lit("/**")))).otherwise(F.array(p)))))
    wide = F.flatten(F.transform(tree(include), lambda p: _prefixes(F.split(p, "/"))))
    hit = lambda x, ps: F.exists(ps, lambda p: F.rlike(x, paths.loose_glob_regex(p)))
    return F.forall(_prefixes(F.split(path, "/")), lambda x: hit(x, wide) & ~hit(x, tree(exclude)))


def copy_plan(listing: DataFrame, vendors: DataFrame) -> DataFrame:
    """(name, source, target) of the files to copy. ``listing`` (name, path) counts paths from the upstream's root;
    ``vendors`` (name, target_dir, include, exclude, mapping); a mapping's ``from`` is a file or folder, and a file in
    several goes to each. Vendors without a mapping take the whole tree."""
    whole = F.array(F.struct(F.lit("").alias("from"), F.lit("").alias("to")))
    pairs = F.transform("mapping", lambda m: F.struct(F.regexp_replace(m["from"], "/+$", "").alias("from"), F.regexp_replace(m["to"], "/+$", "").alias("to")))
    links = vendors.select("name", "target_dir", "include", "exclude", F.explode(F.when(F.coalesce(F.size("mapping"), F.lit(0)) > 0, pairs).otherwise(whole)).alias("m"))
    rows = listing.join(links, "name").where(copied(F.col("path"), F.col("include"), F.col("exclude")))
    inside = (F.col("m.from") == "") | paths.under(F.col("path"), F.col("m.from"))
    rest = F.when(F.col("m.from") == "", F.col("path")).otherwise(F.regexp_replace(F.expr("substring(path, length(m.from) + 1)"), "^/", ""))
    steps = F.filter(F.array("target_dir", F.col("m.to"), rest), lambda x: F.coalesce(x, F.lit("")) != "")
    return rows.where(inside).select("name", F.col("path").alias("source"), F.array_join(steps, "/").alias("target"))


def kept_locked(lock: DataFrame, requested: list[str] | None = None, *, new_only: bool = False, recursive: bool = False, frozen: bool = False) -> DataFrame:
    """Names (name) of a lock (name, dependencies) that an update keeps as they are.

    Without ``requested`` everything is open, or nothing with ``new_only``; ``recursive`` opens what the requested ones
    need too. A requested name that is not locked, and any update of a frozen package, is an error."""
    if frozen:
        raise ValueError("the package is frozen: its dependencies are not updated")
    if not requested:
        return lock.select("name").where(F.lit(new_only))
    spark = lock.sparkSession
    start = spark.createDataFrame([(x,) for x in requested], "node string").distinct()
    absent = start.join(lock.select(F.col("name").alias("node")), "node", "left_anti").collect()  # bounded by the request
    if absent:
        raise ValueError(f"not locked, so it cannot be updated: {', '.join(sorted(r.node for r in absent))}")
    if recursive:
        from ..operators.graph import closure

        start = closure(lock.select(F.col("name").alias("src"), F.explode("dependencies").alias("dst")), start)
    return lock.select("name").join(start.select(F.col("node").alias("name")), "name", "left_anti")


def moved_locks(lock: DataFrame, chosen: DataFrame) -> DataFrame:
    """A lock with the rows of ``chosen`` (name, path) led to a path: they have neither version nor revision."""
    both = lock.join(chosen.select("name", F.col("path").alias("to")), "name", "left")
    here = F.col("to").isNotNull()
    new = {"revision": F.when(~here, F.col("revision")), "version": F.when(~here, F.col("version")), "source_kind": F.when(here, "Path").otherwise(F.col("source_kind")), "source_uri": F.coalesce("to", "source_uri")}
    return both.select(*[new[c].alias(c) if c in new else F.col(c) for c in lock.columns])


def refetches(constraints: DataFrame, fits: DataFrame, fetched: DataFrame) -> DataFrame:
    """(dep, source, ref): fetches that may still give a constraint a candidate. A constraint (dep, source, constraint,
    is_revision) without a row in ``fits`` asks for a plain fetch (null ref) first; if that is among ``fetched`` (dep,
    source, ref), for its revision; if that is too, for nothing: it has failed."""
    open_ = constraints.join(fits, ["dep", "source", "constraint"], "left_anti")
    done = fetched.select("dep", "source", F.coalesce("ref", F.lit("")).alias("ref"), F.lit(True).alias("done")).distinct()
    plain = open_.join(done.where("ref = ''").select("dep", "source", "done"), ["dep", "source"], "left")
    named = plain.where("done AND is_revision").select("dep", "source", F.col("constraint").alias("ref")).join(done.select("dep", "source", "ref"), ["dep", "source", "ref"], "left_anti")
    return plain.where("done IS NULL").select("dep", "source", F.lit(None).cast("string").alias("ref")).distinct().unionByName(named.distinct())
