"""Queries over manifests, listings and locks: whole runs of the library's functions, each with SQL in other words."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..frames import in_order
from ..sources import git
from . import resolve, sources
from .catalog import _LOCKS, _edges, _locks, _tag_text, _tags, query
from .views import view

# Whole runs


_TREE = """n AS (SELECT DISTINCT pkg, CAST(substr(pkg, 4) AS BIGINT) AS k FROM file),
need AS (SELECT k FROM n WHERE k = 0 UNION SELECT n.k FROM n JOIN need ON n.k > 0 AND floor((n.k - 1) / 2) = need.k WHERE n.k % 5 <> 4),
on_ AS (SELECT n.pkg, n.k, n.k > 0 AND n.k % 3 = 0 AS click FROM n JOIN need USING (k)),
g AS (SELECT f.pkg, f.id % 5 AS g, min(f.id) AS pos FROM file f JOIN on_ o USING (pkg) WHERE f.id % 7 <> 0 AND (f.id % 5 IN (0, 3) OR f.id % 5 = 1 AND o.click OR f.id % 5 = 2 AND NOT o.click) GROUP BY 1, 2),
loose AS (SELECT f.pkg, f.id, f.path, (SELECT count(*) FROM g WHERE g.pkg = f.pkg AND g.pos < f.id) AS run FROM file f JOIN on_ USING (pkg) WHERE f.id % 7 = 0),
l AS (SELECT pkg, run, min(id) AS first_pos FROM loose GROUP BY pkg, run)"""


def manifest_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Manifests of a tree of packages, one for each source of documents; every package has loose files and five groups."""
    files = view(spark, sf_dir, "file").withColumn("g", F.when(F.col("id") % 7 == 0, 0).otherwise(F.col("id") % 5 + 1))
    number = F.substring("pkg", 4, 20).cast("long")
    packages = files.select("pkg").distinct()
    targets = F.array(*[F.lit(x).cast("string") for x in (None, None, "click", "not(click)", "all(view, not(error))", "any(error, signup)")])
    none = lambda kind: F.expr(f"cast(array() as array<{kind}>)")
    nodes = files.groupBy("pkg", "g").agg(F.min("id").alias("pos")).where("g > 0").unionByName(packages.select("pkg", F.lit(0).cast("long").alias("g"), F.lit(0).cast("long").alias("pos")))
    declared = packages.where(number > 0).select(F.concat(F.lit("src"), F.floor((number - 1) / 2).cast("string")).alias("parent"), F.col("pkg").alias("dep"), number.alias("pos"), F.when(number % 5 == 4, "not(view)").alias("target"), F.when(number % 3 == 0, F.array(F.struct(F.lit(None).cast("string").alias("target"), F.lit("click").alias("pass")))).alias("pass_targets"))
    return {
        "packages": packages.select("pkg", F.lit("/").alias("root")),
        "dep_decl": declared,
        "source_node": nodes.select("pkg", F.col("g").alias("node"), F.when(F.col("g") > 0, F.lit(0).cast("long")).alias("parent"), "pos", targets[F.col("g").cast("int")].alias("target"), F.lit(False).alias("override_files"), none("struct<target:string,dir:string>").alias("include_dirs"), none("struct<name:string,target:string,value:string>").alias("defines")),
        "source_file": files.select("pkg", F.col("g").alias("node"), F.col("id").alias("pos"), "path", F.lit(None).cast("string").alias("declared")),
        "export_incdir": spark.createDataFrame([], "pkg string, pos long, target string, path string"),
    }


@query(f"""WITH {_TREE}, e AS (SELECT pkg, l.first_pos, loose.id, path, CAST(NULL AS VARCHAR) AS g FROM loose JOIN l USING (pkg, run)
UNION ALL SELECT f.pkg, g.pos, f.id, f.path, CAST(g.g AS VARCHAR) FROM file f JOIN g ON g.pkg = f.pkg AND g.g = f.id % 5 WHERE f.id % 7 <> 0)
SELECT e.pkg, e.first_pos, e.id, e.path, CASE coalesce(g, '0') WHEN '0' THEN '*' WHEN '1' THEN 'click' WHEN '2' THEN 'not(click)' ELSE 'all(view, not(error))' END AS target, CASE WHEN o.click THEN 'TARGET_CLICK,TARGET_VIEW' ELSE 'TARGET_VIEW' END AS defines
FROM e JOIN on_ o USING (pkg)""", "file", recursive=True)
def script_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From manifests to the flattened groups of what targets and selection leave."""
    groups = sources.assembled(manifest_tables(spark, sf_dir), "src0", ["view"])
    told = groups.select("pkg", F.element_at("at.path", -1).alias("first_pos"), sources.shown_target(F.col("chain")).alias("target"), F.array_join(F.transform("defines", lambda d: d["name"]), ",").alias("defines"), F.posexplode("files").alias("i", "f"))
    return told.select("pkg", "first_pos", F.regexp_extract("f.path", r"/([0-9]+)\.", 1).cast("long").alias("id"), F.col("f.path").alias("path"), "target", "defines")


@query(f"""WITH {_TREE}, e AS (SELECT pkg, l.first_pos, loose.id, path FROM loose JOIN l USING (pkg, run) UNION ALL SELECT f.pkg, g.pos, f.id, f.path FROM file f JOIN g ON g.pkg = f.pkg AND g.g = f.id % 5 WHERE f.id % 7 <> 0),
t AS (SELECT *, CASE WHEN path LIKE '%.sv' OR path LIKE '%.v' THEN 1 WHEN path LIKE '%.vhd' THEN 2 ELSE 3 END AS ty FROM e),
c AS (SELECT *, CASE WHEN lag(ty) OVER w IS DISTINCT FROM ty THEN 1 ELSE 0 END AS ch FROM t WINDOW w AS (PARTITION BY pkg, first_pos ORDER BY id)), r AS (SELECT *, sum(ch) OVER (PARTITION BY pkg, first_pos ORDER BY id) AS run FROM c),
d AS (SELECT n.k, CAST(floor(log2(k + 1)) AS BIGINT) AS depth, n.pkg FROM n), u AS (SELECT r.pkg, first_pos, run, min(ty) AS ty, count(*) AS n, CASE WHEN r.pkg = 'src0' THEN 1 ELSE 0 END AS last, d.depth FROM r JOIN d USING (pkg) GROUP BY ALL)
SELECT CAST(row_number() OVER (ORDER BY last, depth DESC, pkg, first_pos, run) - 1 AS BIGINT) AS no, pkg, CASE ty WHEN 1 THEN 'verilog' WHEN 2 THEN 'vhdl' END AS file_type, n FROM u""", "file", recursive=True)
def script_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The run's groups as renderers take them, in order of their packages' ranks."""
    rows = sources.render_groups(sources.assembled(manifest_tables(spark, sf_dir), "src0", ["view"]))
    return rows.select("no", F.regexp_extract("metadata", r"Package\(([^)]*)\)", 1).alias("pkg"), "file_type", F.size("files").cast("long").alias("n"))


# Recorded listings


_REVS = "r AS (SELECT pkg, rev, CAST(row_number() OVER (PARTITION BY pkg ORDER BY max(part) DESC) - 1 AS INTEGER) AS i FROM tag GROUP BY pkg, rev)"


def _listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each repository's revisions as recorded: one a line, newest first."""
    revs = view(spark, sf_dir, "tag").groupBy("pkg", "rev").agg(F.max("part").alias("part"))
    return revs.groupBy(F.col("pkg").alias("repo")).agg(F.concat(F.array_join(in_order("rev", -F.col("part")), "\n"), F.lit("\n")).alias("value"))


@query(f'WITH {_REVS} SELECT pkg AS repo, i AS "index", rev FROM r', "tag")
def list_revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revisions with their places."""
    return git.revisions(_listings(spark, sf_dir))


@query(f"WITH {_REVS} SELECT t.pkg AS repo, t.major, t.minor, t.patch, min(r.i) AS first_index FROM tag t JOIN r USING (pkg, rev) GROUP BY ALL", "tag")
def version_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index of the revision that each version stands for."""
    tags = view(spark, sf_dir, "tag").select(F.col("pkg").alias("repo"), F.col("rev").alias("hash"), "major", "minor", "patch")
    return git.index_of(tags, git.revisions(_listings(spark, sf_dir))).groupBy("repo", "major", "minor", "patch").agg(F.min("index").alias("first_index"))


@query("""SELECT pkg AS repo, CASE part % 4 WHEN 0 THEN 'v' || CAST(part % 20 AS VARCHAR) ELSE 'b' || CAST(part % 15 AS VARCHAR) END AS name, min(rev) AS hash FROM tag WHERE part % 4 < 2 AND part % 5 <> 0 GROUP BY 1, 2""", "tag")
def git_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags and branches of known revisions, by repository."""
    tags = view(spark, sf_dir, "tag")
    ref = F.when(F.col("part") % 4 == 0, F.concat(F.lit("refs/tags/v"), (F.col("part") % 20).cast("string"))).when(F.col("part") % 4 == 1, F.concat(F.lit("refs/remotes/origin/b"), (F.col("part") % 15).cast("string"))).otherwise("refs/stash")
    refs = git.tags_and_branches(tags.select(F.col("pkg").alias("repo"), ref.alias("ref"), F.col("rev").alias("hash")))
    return git.names_of(refs, tags.where("part % 5 <> 0").select(F.col("pkg").alias("repo"), F.col("rev").alias("hash")), ["repo"])


@query("""SELECT 'p' || CAST(pkg AS VARCHAR) AS parent, rev AS parent_rev, 'p' || CAST(pkg + 1 AS VARCHAR) AS dep, CASE WHEN minor % 2 = 0 THEN 'u' ELSE '/p' || CAST(pkg AS VARCHAR) || '/../x' END AS source, CASE WHEN minor % 2 = 0 THEN '^' || CAST(major AS VARCHAR) END AS con FROM (SELECT DISTINCT pkg, rev, major, minor FROM tag WHERE part % 10 <> 0) t""", "tag")
def manifest_at_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the manifest of every recorded revision asks for."""
    tags = view(spark, sf_dir, "tag").select("pkg", "rev", "major", "minor", "part").distinct()
    said = F.when(F.col("minor") % 2 == 0, F.format_string('{"git": "u", "version": "^%s"}', F.col("major"))).otherwise('{"path": "../x"}')
    text = F.concat(F.lit('{"package": {"name": "p'), F.col("pkg"), F.lit('"}, "dependencies": {"p'), F.col("pkg") + 1, F.lit('": '), said, F.lit("}}"))
    trees = tags.select(F.concat(F.lit("p"), "pkg").alias("repo"), "rev", F.concat(F.lit("100644 blob "), F.md5(text), F.when(F.col("part") % 10 == 0, "\tother.yml").otherwise("\tpackage.yml")).alias("value"))
    contents = tags.select(F.md5(text).alias("hash"), text.alias("content")).distinct()
    found, _ = git.manifests_at(trees, contents, "package.yml")
    return git.needs_at(found).select("parent", "parent_rev", "dep", "source", F.col("constraint").alias("con"))


@query("""SELECT 'p' || CAST(pkg AS VARCHAR) AS subject, 'W12' AS code, count(*) AS n FROM (SELECT DISTINCT pkg, rev FROM tag WHERE part % 10 = 0) t GROUP BY 1""", "tag")
def manifest_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revisions without a manifest are told."""
    trees = view(spark, sf_dir, "tag").select(F.concat(F.lit("p"), "pkg").alias("repo"), "rev", F.when(F.col("part") % 10 == 0, "100644 blob aa\tother.yml").otherwise("100644 blob ab\tpackage.yml").alias("value"))
    _, lost = git.manifests_at(trees, spark.createDataFrame([("ab", "x")], "hash string, content string"), "package.yml")
    return lost.groupBy("subject", "code").agg(F.count("*").alias("n"))


@query("""SELECT CAST(p_size AS BIGINT) AS dir, p_brand || CAST(p_partkey AS VARCHAR) || '.patch' AS name, row_number() OVER (PARTITION BY p_size ORDER BY lower(p_brand || CAST(p_partkey AS VARCHAR) || '.patch')) AS place FROM part WHERE p_partkey % 4 <> 0""")
def patch_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patches of each folder in the order in which they apply."""
    from .workspace import patch_order

    name = F.concat("p_brand", F.col("p_partkey").cast("string"), F.when(F.col("p_partkey") % 4 == 0, ".md").otherwise(".patch"))
    return patch_order(spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_size").cast("long").alias("dir"), name.alias("name"))).select("dir", "name", F.col("place").cast("long").alias("place"))


@query("""SELECT s_nationkey AS repo, bool_or(s_suppkey % 6 = 0) AND bool_or(s_suppkey % 4 = 0) AS uses_lfs FROM supplier GROUP BY s_nationkey""")
def lfs_repos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repositories whose attributes ask for large files and that have some."""
    rows = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    lines = rows.select(F.col("s_nationkey").alias("repo"), F.when(F.col("s_suppkey") % 6 == 0, "*.bin filter=lfs diff=lfs").otherwise("*.txt text").alias("value"))
    return git.uses_lfs(lines, tracked=rows.where("s_suppkey % 4 = 0").select(F.col("s_nationkey").alias("repo"), F.lit("a.bin").alias("path")))


# Paths and configuration


_GLOBS = "p(id, pat) AS (VALUES (1, 'src1/*.sv'), (2, 'src?/1*.v'), (3, '*/*7.vhd'), (4, 'src1/none?'), (5, 'plain.sv'))"


def _globbed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    from ..functions.paths import expanded_globs

    given = spark.createDataFrame([(1, "src1/*.sv"), (2, "src?/1*.v"), (3, "*/*7.vhd"), (4, "src1/none?"), (5, "plain.sv")], "id int, path string")
    return expanded_globs(given, view(spark, sf_dir, "file").select("path"))


@query(f"WITH {_GLOBS} SELECT p.id, coalesce(f.path, p.pat) AS path FROM p LEFT JOIN file f ON f.path GLOB p.pat WHERE f.path IS NOT NULL OR p.id = 5", "file")
def glob_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patterns as the files that they match."""
    return _globbed(spark, sf_dir)[0]


@query(f"WITH {_GLOBS} SELECT pat AS subject, 'W05' AS code FROM p WHERE id <> 5 AND NOT EXISTS (SELECT 1 FROM file f WHERE f.path GLOB p.pat)", "file")
def glob_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patterns that match nothing are told."""
    return _globbed(spark, sf_dir)[1].select("subject", "code")


@query("""WITH s AS (SELECT c_custkey AS k, '/w/' || CAST(c_nationkey AS VARCHAR) || '/p' || CAST(c_custkey AS VARCHAR) AS start FROM customer),
f(path, value) AS (SELECT '/w/' || CAST(n_nationkey AS VARCHAR) || '/local.yml', 'l' || CAST(n_nationkey AS VARCHAR) FROM nation WHERE n_nationkey % 2 = 0 UNION ALL SELECT '/w/.dot.yml', 'w' UNION ALL SELECT '/h/.dot.yml', 'h'),
x AS (SELECT s.start, f.value, CASE WHEN starts_with(f.value, 'l') THEN 0 WHEN f.value = 'w' THEN 1 ELSE 2 END AS far FROM s JOIN f ON f.value IN ('w', 'h') OR starts_with(s.start, replace(f.path, 'local.yml', '')))
SELECT start, arg_min(value, far) AS git, count(*) AS layers FROM x GROUP BY start""")
def config_discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Configuration files at and above each folder, nearest first; missing ones have nothing to say."""
    from ..sources.documents import config_layers, merged_config

    customer, nation = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("customer", "nation"))
    starts = customer.select(F.concat(F.lit("/w/"), F.col("c_nationkey").cast("string"), F.lit("/p"), F.col("c_custkey").cast("string")).alias("start"))
    entries = nation.where("n_nationkey % 2 = 0").select(F.concat(F.lit("/w/"), "n_nationkey", F.lit("/local.yml")).alias("path"), F.concat(F.lit("l"), "n_nationkey").alias("value"))
    entries = entries.unionByName(spark.createDataFrame([("/w/.dot.yml", "w"), ("/h/.dot.yml", "h")], "path string, value string"))
    layers = config_layers(starts, entries.select("path", F.lit("git").alias("key"), "value", F.lit("scalar").alias("kind")), "local.yml", ".dot.yml", "/h/.dot.yml", "/etc/dot.yml")
    merged = merged_config(layers.select(F.concat_ws("|", "start", "key").alias("key"), "layer", "value", "kind"))
    counted = layers.groupBy("start").agg(F.count("*").alias("layers"))
    return merged.select(F.substring_index("key", "|", 1).alias("start"), F.col("value").alias("git")).join(counted, "start")


@query("""WITH k AS (SELECT k, arg_min(v, layer) AS v FROM layer GROUP BY k), m AS (SELECT CAST(layer AS VARCHAR) AS e, max(v) AS v FROM layer GROUP BY layer)
SELECT '{' || (SELECT string_agg('"' || k || '":"' || v || '"', ',' ORDER BY k) FROM k) || ',"overrides":{' || (SELECT string_agg('"' || e || '":"' || v || '"', ',' ORDER BY e) FROM m) || '}}' AS json""", "layer")
def config_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The effective configuration as JSON."""
    from ..sources.documents import config_json

    rows = view(spark, sf_dir, "layer")
    plain = rows.groupBy(F.col("k").alias("key")).agg(F.min_by("v", "layer").alias("value"))
    maps = rows.groupBy(F.concat(F.lit("overrides."), F.col("layer").cast("string")).alias("key")).agg(F.max("v").alias("value"))
    return config_json(plain.unionByName(maps))


@query("""WITH d AS (SELECT grp, pos, name, value FROM defn), m AS (SELECT grp, name, min(pos) AS pos, arg_max(coalesce(value, '-'), pos) AS value FROM d GROUP BY grp, name),
a AS (SELECT grp, name, pos, CASE name WHEN 'K1' THEN 'x=y' ELSE value END AS value FROM m UNION ALL SELECT DISTINCT grp, 'K1', 9223372036854775806, 'x=y' FROM d x WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.grp = x.grp AND d.name = 'K1') UNION ALL SELECT DISTINCT grp, 'NEW', 9223372036854775807, '-' FROM d)
SELECT grp, string_agg(name || '=' || value, ',' ORDER BY pos) AS defines FROM a GROUP BY grp""", "defn")
def define_args(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Defines of the command line after a group's own, over their values."""
    rows = view(spark, sf_dir, "defn").groupBy("grp").agg(in_order(F.struct("name", "value"), "pos").alias("own"))
    laid = sources.add_defines(F.col("own"), ["K1 = x=y ", " NEW"])
    return rows.select("grp", F.array_join(F.transform(laid, lambda d: F.concat(d["name"], F.lit("="), F.coalesce(d["value"], F.lit("-")))), ",").alias("defines"))


@query("""WITH l AS (SELECT n_regionkey AS vendor, CAST(n_nationkey AS BIGINT) AS id, CASE n_nationkey % 3 WHEN 0 THEN 'd' WHEN 1 THEN 'd/n' || CAST(n_nationkey % 4 AS VARCHAR) ELSE 'd/n' || CAST(n_nationkey % 4 AS VARCHAR) || '/f' END AS path, n_nationkey % 3 = 2 AS is_file FROM nation),
o AS (SELECT *, row_number() OVER (PARTITION BY vendor ORDER BY is_file DESC, length(path) - length(replace(path, '/', '')) DESC, id) AS place FROM l)
SELECT a.vendor, a.id, a.place, coalesce((SELECT string_agg(p, ',' ORDER BY s) FROM (SELECT b.path AS p, min(b.place) AS s FROM o b WHERE b.vendor = a.vendor AND b.place < a.place AND (b.path = a.path OR starts_with(b.path, a.path || '/')) GROUP BY b.path) x), '') AS exclude FROM o a""")
def vendor_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of a vendor by priority, each without what those before it take."""
    from .workspace import link_excludes

    k = F.col("n_nationkey")
    inner = F.concat(F.lit("d/n"), (k % 4).cast("string"))
    links = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_regionkey").alias("vendor"), k.cast("long").alias("id"), F.when(k % 3 == 0, "d").when(k % 3 == 1, inner).otherwise(F.concat(inner, F.lit("/f"))).alias("path"), (k % 3 == 2).alias("is_file"))
    return link_excludes(links).select("vendor", "id", F.col("place").cast("long").alias("place"), F.array_join("exclude", ",").alias("exclude"))


# Locks and constraints


@query("""SELECT CAST(src AS VARCHAR) AS parent, CAST(CASE WHEN src % 9 = 0 THEN src WHEN src % 7 = 0 THEN 1 ELSE dst END AS VARCHAR) AS dep, CASE WHEN src % 9 = 0 AND src <> 1 OR src % 9 = 0 THEN 'self' ELSE 'root' END AS clash FROM edge WHERE src % 9 = 0 OR src % 7 = 0 OR dst = 1 GROUP BY ALL""", "edge")
def dependency_clashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R2: dependencies called like the root or like the package that asks for them."""
    called = F.when(F.col("src") % 9 == 0, F.col("src")).when(F.col("src") % 7 == 0, 1).otherwise(F.col("dst"))
    rows = _edges(spark, sf_dir).select(F.col("src").cast("string").alias("parent"), called.cast("string").alias("dep"))
    return resolve.name_clashes(rows, "1")


@query(f"""WITH {_LOCKS}, c AS (SELECT pkg, rev, CASE WHEN pkg % 4 = 0 THEN 'path' WHEN pkg % 4 = 1 THEN 'rev' ELSE 'version' END AS kind, v FROM old WHERE pkg % 4 <> 3)
SELECT pkg, CASE kind WHEN 'version' THEN '=' || v WHEN 'rev' THEN rev END AS con, kind <> 'path' AND NOT EXISTS (SELECT 1 FROM tag t WHERE t.pkg = c.pkg AND t.rev = c.rev AND t.part % 7 <> 0) AS lost FROM c""", "tag")
def locked_constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lock rows as constraints, and those whose revision is gone."""
    old, _ = _locks(spark, sf_dir)
    k = F.col("pkg") % 4
    lock = old.select(F.col("pkg").alias("name"), F.when(k.isin(1, 2), F.col("rev")).alias("revision"), F.when(k == 2, F.col("text")).alias("version"), F.when(k == 0, "Path").otherwise("Git").alias("source_kind"), F.lit("u").alias("source_uri"))
    asked = resolve.lock_constraints(lock)
    offered = _tags(spark, sf_dir).where("part % 7 <> 0").select(F.col("pkg").alias("dep"), F.lit("u").alias("source"), "rev")
    kept, lost = resolve.kept_locks(asked, offered)
    rows = kept.select("dep", F.lit(False).alias("lost")).unionByName(lost.select(F.col("subject").alias("dep"), F.lit(True).alias("lost")))
    return asked.join(rows, "dep").select(F.col("dep").alias("pkg"), F.col("constraint").alias("con"), "lost")


@query(f"""SELECT CAST(dst AS VARCHAR) AS dep, CASE WHEN src % 3 = 0 THEN '/x' ELSE 'u' || CAST(dst AS VARCHAR) END AS source, CASE WHEN src % 3 <> 0 THEN t.v END AS text, CASE WHEN src % 3 = 0 THEN '' ELSE t.rev END AS rev
FROM edge LEFT JOIN (SELECT pkg, rev, {_tag_text()} AS v FROM tag) t ON t.pkg = dst AND src % 3 <> 0 WHERE src % 3 = 0 OR t.rev IS NOT NULL GROUP BY ALL""", "edge", "tag")
def candidate_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions by kind of source; a path has one."""
    path = F.col("src") % 3 == 0
    said = _edges(spark, sf_dir).select(F.col("dst").cast("string").alias("dep"), F.when(path, "/x").otherwise(F.concat(F.lit("u"), F.col("dst").cast("string"))).alias("source"), F.when(~path, "*").alias("constraint"))
    tags = _tags(spark, sf_dir).select(F.concat(F.lit("u"), F.col("pkg").cast("string")).alias("source"), "version", "text", "rev")
    return resolve.available(said, tags).select("dep", "source", "text", "rev").distinct()


@query("SELECT dst AS dep, string_agg(CAST(src AS VARCHAR) || ' ' || req, ',' ORDER BY src) AS asked, count(*) AS n FROM req GROUP BY dst", "req")
def constraints_grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who asks for a package, in order of arrival."""
    rows = view(spark, sf_dir, "req").select(F.col("dst").alias("dep"), F.col("src").alias("parent"), F.col("req").alias("constraint"), F.lit("u").alias("source"), F.col("src").alias("pos"))
    told = resolve.grouped_constraints(rows)
    return told.select("dep", F.array_join(F.transform("asked", lambda a: F.concat(a["parent"].cast("string"), F.lit(" "), a["constraint"])), ",").alias("asked"), F.size("asked").cast("long").alias("n"))


@query("""SELECT dst AS dep, src AS parent, req AS con, src % 6 <> 0 AS told FROM req""", "req")
def parent_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parents in the lock with what their manifests say; those whose manifest does not name the package are stale."""
    from .audit import parents_of

    rows = view(spark, sf_dir, "req")
    said = rows.where("src % 6 <> 0").select(F.col("src").alias("parent"), F.col("dst").alias("dep"), F.col("req").alias("constraint"), F.lit("u").alias("source"))
    found, stale = parents_of(rows.select("src", "dst"), said)
    lost = stale.join(rows, (F.col("subject") == F.col("src"))).select(F.col("dst").alias("dep"), F.col("src").alias("parent"), F.col("req").alias("con"), F.lit(False).alias("told"))
    return found.select("dep", "parent", F.col("constraint").alias("con"), F.lit(True).alias("told")).unionByName(lost)


@query("""WITH m AS (SELECT DISTINCT name FROM decl WHERE name NOT IN ('the', 'de')) SELECT (SELECT count(*) FROM decl JOIN m USING (name)) AS declarations, (SELECT count(*) FROM ref JOIN m USING (name)) AS uses""", "decl", "ref")
def rename_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many declarations and references a renaming reaches."""
    from ..operators.syntax import rename_map, renamed_counts

    declared = view(spark, sf_dir, "decl")
    return renamed_counts(declared, view(spark, sf_dir, "ref"), rename_map(declared, "a_", "", ["the", "de"]))


@query("""SELECT count(*) AS packages, CAST(max(length(name)) AS INTEGER) AS width, (SELECT count(*) FROM edge) AS needs FROM pkg""", "pkg", "edge")
def package_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and the width of names for display."""
    from .audit import counts

    return counts(view(spark, sf_dir, "pkg"), _edges(spark, sf_dir))


@query("""SELECT 'src' || CAST(id % 5 AS VARCHAR) AS pkg, id AS pos, '::d' || CAST(id % 3 AS VARCHAR) || ':1' AS vlnv FROM file""", "file")
def depend_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dependencies by the full names of their cores."""
    from ..sources.cores import depend_names

    needs = view(spark, sf_dir, "file").select(F.concat(F.lit("src"), (F.col("id") % 5).cast("string")).alias("pkg"), F.lit("files_rtl").alias("fileset"), F.col("id").alias("pos"), F.concat(F.lit("d"), (F.col("id") % 3).cast("string")).alias("dep"))
    cores = spark.createDataFrame([(f"d{i}", f"::d{i}:1") for i in range(3)], "dep string, vlnv string")
    return depend_names(needs, cores).select("pkg", "pos", "vlnv")


_LINE_STATE = """c AS (SELECT id % 50 AS op, id AS seq, CASE WHEN line LIKE 'Cloning into%' OR line LIKE '%registered for path%' THEN 'open' WHEN line LIKE '%checked out%' THEN 'end' WHEN line LIKE 'fatal:%' THEN 'err' WHEN line LIKE 'Rec%' OR line LIKE 'Res%' THEN 'pc' ELSE 'other' END AS k,
CASE WHEN line LIKE 'Cloning into%' THEN regexp_extract(line, '''([^'']*)''', 1) WHEN line LIKE '%registered for path%' THEN regexp_extract(line, 'libs/([^'']*)''', 1) END AS name, CASE WHEN line LIKE 'Rec%' OR line LIKE 'Res%' THEN CAST(regexp_extract(line, '([0-9]+)%', 1) AS INTEGER) END AS pc FROM line),
e AS (SELECT *, lag(name) OVER (PARTITION BY op ORDER BY seq) AS before FROM c WHERE k IN ('open', 'end')),
d AS (SELECT op, CAST(count(*) FILTER (WHERE k = 'end' OR before <> name) AS INTEGER) AS finished, arg_max(coalesce(name, ''), seq) AS active FROM e GROUP BY op),
p AS (SELECT op, arg_max(CASE k WHEN 'open' THEN 0 WHEN 'end' THEN 100 ELSE pc END, seq) AS percent FROM c WHERE k IN ('open', 'end', 'pc') GROUP BY op),
t AS (SELECT op, CAST(count(*) FILTER (WHERE k = 'err') AS INTEGER) AS errors, max(seq) AS last_seq FROM c GROUP BY op),
s AS (SELECT t.op AS operation, CASE WHEN d.active <> '' THEN d.active END AS active, coalesce(percent, 0) AS percent, coalesce(finished, 0) AS finished, errors, last_seq FROM t LEFT JOIN d USING (op) LEFT JOIN p USING (op))"""


def _operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "line").select((F.col("id") % 50).alias("operation"), F.col("id").alias("seq"), "line")


@query(f"WITH {_LINE_STATE} SELECT * FROM s", "line")
def progress_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state of each operation after its last recorded line."""
    from ..streaming.progress import latest

    return latest(_operations(spark, sf_dir))


@query(f"WITH {_LINE_STATE} SELECT operation, CAST(finished + CASE WHEN active IS NULL THEN 0 ELSE 1 END AS INTEGER) AS finished, errors, CASE WHEN operation = 0 THEN '0ms' WHEN operation < 12 THEN CAST(operation * 5 AS VARCHAR) || '.0s' ELSE 'min' END AS elapsed FROM s", "line")
def progress_finish(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The terminal event of each operation, with the time it took."""
    from ..streaming.progress import finished, latest

    ends = spark.range(50).select(F.col("id").alias("operation"), F.lit("x").alias("name"), F.lit(0.0).alias("started"), (F.col("id") * 5.0).alias("ended"))
    told = finished(latest(_operations(spark, sf_dir)), ends)
    return told.select("operation", "finished", "errors", F.when(F.endswith("elapsed", F.lit("min")), "min").otherwise(F.col("elapsed")).alias("elapsed"))
