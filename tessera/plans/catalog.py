"""Queries over the derived package graphs and source trees, each with the SQL that says the same in other words."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..frames import in_order, last_wins
from ..functions import paths, semver, targets
from ..operators import graph, tree
from . import views
from .views import oracle, view

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None, *needs: str, recursive: bool = False):
    def register(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLE_SQL[fn.__name__] = oracle(sql, *needs, recursive=recursive)
        return fn

    return register


#: The expressions of the tree by hand: (number, clause, name, negated). Twelve has one empty clause: it always holds.
DNF = """dnf(e, clause, lit, neg) AS (VALUES (0,0,'view',false),(1,0,'view',true),(2,0,'view',false),(2,0,'click',false),(3,0,'view',false),(3,1,'click',false),
(4,0,'view',false),(4,0,'error',true),(5,0,'signup',false),(5,1,'click',false),(5,1,'purchase',false),(6,0,'error',true),(6,0,'signup',true),(7,0,'purchase',false),
(8,0,'view',false),(8,0,'purchase',true),(8,1,'error',false),(8,1,'purchase',true),(9,0,'click',true),(9,1,'signup',true),(10,0,'view',true),(10,1,'click',true),(11,0,NULL,false))"""
#: Which expressions hold for the active set {view, click, purchase}.
HOLDS = DNF + """, holds AS (SELECT e, bool_or(ok) AS ok FROM (SELECT e, clause, bool_and(lit IS NULL OR (lit IN ('view', 'click', 'purchase')) <> neg) AS ok FROM dnf GROUP BY e, clause) c GROUP BY e)"""
ACTIVE = ["view", "click", "purchase"]


def _active_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "active").groupBy("user_id").agg(in_order("t", "pos").alias("targets"))


def _fixed_active():
    return F.array(*map(F.lit, ACTIVE))


# Target expressions


@query(f"""WITH {DNF}, u AS (SELECT DISTINCT user_id FROM active),
k AS (SELECT u.user_id, e, clause, bool_and(lit IS NULL OR (EXISTS (SELECT 1 FROM active a WHERE a.user_id = u.user_id AND a.t = lit)) <> neg) AS ok FROM u CROSS JOIN dnf GROUP BY 1, 2, 3)
SELECT user_id, CAST(e AS BIGINT) AS expr, bool_or(ok) AS hit FROM k GROUP BY user_id, e""", "active")
def target_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every expression against every active set, compiled to predicates."""
    hits = F.array(*[F.struct(F.lit(i).cast("long").alias("expr"), targets.compile(targets.parse(e) if e else targets.ANYTHING, F.col("targets")).alias("hit")) for i, e in enumerate([*views.EXPRESSIONS, None])])
    return _active_set(spark, sf_dir).select("user_id", F.inline(hits))


@query("""SELECT node, CASE node % 12 WHEN 0 THEN 'view' WHEN 1 THEN 'view' WHEN 2 THEN 'click,view' WHEN 3 THEN 'click,view' WHEN 4 THEN 'error,view' WHEN 5 THEN 'click,purchase,signup'
WHEN 6 THEN 'error,signup' WHEN 7 THEN 'purchase' WHEN 8 THEN 'error,purchase,view' WHEN 9 THEN 'click,signup' WHEN 10 THEN 'click,view' ELSE '' END AS names FROM tree""", "tree")
def target_avail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names in each group's expression, sorted."""
    names = F.lit("")
    for e in views.EXPRESSIONS:
        names = F.when(F.col("target") == e, ",".join(sorted(targets.available(targets.parse(e))))).otherwise(names)
    return view(spark, sf_dir, "tree").select("node", names.alias("names"))


_RAW = "raw AS (SELECT user_id, pos, CASE pos % 4 WHEN 0 THEN t WHEN 1 THEN 'pkg_' || CAST(user_id % 3 AS STRING) || ':' || t WHEN 2 THEN '*:' || t ELSE '-' || t END AS r FROM active)"


@query(f"""WITH {_RAW}, loc AS (SELECT user_id, pos, CASE WHEN r LIKE '%:%' THEN substr(r, instr(r, ':') + 1) ELSE r END AS l FROM raw WHERE r NOT LIKE '%:%' OR r LIKE '*:%' OR r LIKE 'pkg_1:%'),
keep AS (SELECT user_id, l, min(pos) AS pos FROM loc a WHERE l NOT LIKE '-%' AND NOT EXISTS (SELECT 1 FROM loc b WHERE b.user_id = a.user_id AND b.l = '-' || a.l) GROUP BY user_id, l)
SELECT u.user_id, coalesce(string_agg(l, ',' ORDER BY pos), '') AS targets FROM (SELECT DISTINCT user_id FROM active) u LEFT JOIN keep USING (user_id) GROUP BY u.user_id""", "active")
def target_reduce_for_pkg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raw set reduced for package pkg_1."""
    raw = F.when(F.col("pos") % 4 == 0, F.col("t")).when(F.col("pos") % 4 == 1, F.concat(F.lit("pkg_"), (F.col("user_id") % 3).cast("string"), F.lit(":"), F.col("t"))).when(F.col("pos") % 4 == 2, F.concat(F.lit("*:"), F.col("t"))).otherwise(F.concat(F.lit("-"), F.col("t")))
    sets = view(spark, sf_dir, "active").groupBy("user_id").agg(targets.target_set(in_order(raw, "pos")).alias("raw"))
    return sets.select("user_id", F.array_join(targets.for_package(F.col("raw"), F.lit("pkg_1")), ",").alias("targets"))


@query("SELECT user_id, string_agg('TARGET_' || upper(t), ',' ORDER BY t) AS defines FROM active GROUP BY user_id", "active")
def target_defines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Defines for the active targets, sorted."""
    return _active_set(spark, sf_dir).select("user_id", F.array_join(targets.target_defines(F.col("targets")), ",").alias("defines"))


# Trees


def _tree_alive(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = view(spark, sf_dir, "tree")
    return tree.surviving(nodes, targets.matches(F.col("target"), _fixed_active(), views.EXPRESSIONS))


_ALIVE = f"""{HOLDS}, alive AS (SELECT node, parent, pkg FROM tree WHERE parent IS NULL AND (SELECT ok FROM holds WHERE e = node % 12)
UNION ALL SELECT t.node, t.parent, t.pkg FROM tree t JOIN alive a ON t.parent = a.node JOIN holds h ON h.e = t.node % 12 WHERE h.ok)"""


@query(f"WITH {_ALIVE} SELECT node, pkg FROM alive", "tree", recursive=True)
def filter_targets_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups that survive the target filter, with all their ancestors."""
    return _tree_alive(spark, sf_dir).select("node", "pkg")


@query("SELECT id, CASE WHEN pkg IN ('src1', 'src2', 'src3') THEN path ELSE '' END AS kept_path FROM file", "file")
def filter_packages_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P10: groups outside the selection stay, without their files."""
    from .sources import filter_packages

    selection = spark.createDataFrame([("src1",), ("src2",), ("src3",)], "pkg string")
    return filter_packages(view(spark, sf_dir, "file"), selection).select("id", F.coalesce("path", F.lit("")).alias("kept_path"))


@query("SELECT node, coalesce(target, 'rtl') AS assumed, target IS NULL AS documented FROM tree", "tree")
def assume_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A target for groups that have the wildcard."""
    from .sources import assume_target as assumed

    return view(spark, sf_dir, "tree").select("node", assumed(F.col("target"), "rtl").alias("assumed"), F.col("target").isNull().alias("documented"))


@query("""WITH has AS (SELECT DISTINCT node FROM tree WHERE pkg = 'src7' UNION SELECT t.parent FROM has h JOIN tree t ON t.node = h.node WHERE t.parent IS NOT NULL) SELECT node FROM has""", "tree", recursive=True)
def drop_empty_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups with a file of package src7 somewhere below; the rest is dropped."""
    from .sources import non_empty

    nodes = view(spark, sf_dir, "tree")
    return non_empty(nodes, nodes.where("pkg = 'src7'"))


@query("""WITH f AS (SELECT grp AS node, pos, id % 3 = 0 AS is_group, grp % 5 = 0 AS independent, id FROM file),
r AS (SELECT *, CASE WHEN independent THEN 0 ELSE sum(CASE WHEN is_group THEN 1 ELSE 0 END) OVER (PARTITION BY node ORDER BY pos) END AS run FROM f)
SELECT node, CAST(run AS BIGINT) AS run, string_agg(CAST(id AS STRING), ',' ORDER BY pos) AS ids FROM r WHERE NOT is_group GROUP BY node, run""", "file")
def flatten_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loose files between subgroups as emitted groups."""
    items = view(spark, sf_dir, "file").select(F.col("grp").alias("node"), "pos", (F.col("id") % 3 == 0).alias("is_group"), (F.col("grp") % 5 == 0).alias("independent"), "id")
    return tree.flatten(items).groupBy("node", F.col("run").cast("long").alias("run")).agg(F.array_join(in_order(F.col("id").cast("string"), "pos"), ",").alias("ids"))


@query("""WITH chain AS (SELECT node, node AS anc, parent, 0 AS up FROM tree UNION ALL SELECT c.node, t.node, t.parent, c.up + 1 FROM chain c JOIN tree t ON t.node = c.parent),
d AS (SELECT c.node, c.up, 'D' || CAST(c.anc % 3 AS STRING) AS k, CAST(c.anc AS STRING) AS v FROM chain c),
m AS (SELECT node, k, max(up) AS firstup, arg_min(v, up) AS v FROM d GROUP BY node, k)
SELECT node, string_agg(k || '=' || v, ',' ORDER BY firstup DESC) AS defines FROM m GROUP BY node""", "tree", recursive=True)
def inherit_defines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parent defines first, a child's value over its parent's, at the parent's place."""
    nodes = view(spark, sf_dir, "tree").withColumn("k", F.concat(F.lit("D"), (F.col("node") % 3).cast("string"))).withColumn("v", F.col("node").cast("string"))
    own = F.struct("k", "v")
    known = F.exists("up.defines", lambda d: d["k"] == F.col("k"))
    laid = F.when(known, F.transform("up.defines", lambda d: F.when(d["k"] == F.col("k"), own).otherwise(d))).otherwise(F.array_append("up.defines", own))
    done = tree.by_level(nodes, {"defines": F.array(own)}, {"defines": laid})
    return done.select("node", F.array_join(F.transform("defines", lambda d: paths.define(d["k"], d["v"])), ",").alias("defines"))


@query("""WITH i AS (SELECT grp, 'inc/' || CAST(id % 6 AS STRING) AS dir FROM file UNION ALL SELECT grp, 'exp/' || CAST(id % 2 AS STRING) FROM file)
SELECT grp, string_agg(DISTINCT dir, ',' ORDER BY dir) AS dirs FROM i GROUP BY grp""", "file")
def incdirs_ordered_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Own then exported include directories, distinct, sorted for output."""
    files = view(spark, sf_dir, "file").groupBy("grp").agg(in_order(F.concat(F.lit("inc/"), (F.col("id") % 6).cast("string")), "pos").alias("own"), in_order(F.concat(F.lit("exp/"), (F.col("id") % 2).cast("string")), "pos").alias("exported"))
    from .sources import include_dirs

    return files.select("grp", F.array_join(F.array_sort(include_dirs(F.col("own"), F.col("exported"))), ",").alias("dirs"))


@query("SELECT id, CASE WHEN path LIKE '%.sv' OR path LIKE '%.v' THEN 'verilog' WHEN path LIKE '%.vhd' THEN 'vhdl' END AS file_type, CASE WHEN id % 10 = 0 THEN 'vhdl' WHEN path LIKE '%.sv' OR path LIKE '%.v' THEN 'verilog' WHEN path LIKE '%.vhd' THEN 'vhdl' END AS declared_type FROM file", "file")
def file_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Type by extension, and with every tenth file declared vhd."""
    return view(spark, sf_dir, "file").select("id", paths.file_type(F.col("path")).alias("file_type"), paths.file_type(F.col("path"), F.when(F.col("id") % 10 == 0, "vhd")).alias("declared_type"))


# Graphs


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "edge")


def _roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packages that no other depends on."""
    edges = _edges(spark, sf_dir)
    return edges.select(F.col("src").alias("node")).join(edges.select(F.col("dst").alias("node")), "node", "left_anti").distinct()


_RANKS = "walk AS (SELECT src AS node, 0 AS level FROM edge WHERE src NOT IN (SELECT dst FROM edge) UNION SELECT e.dst, w.level + 1 FROM walk w JOIN edge e ON e.src = w.node), ranked AS (SELECT node, max(level) AS rank FROM walk GROUP BY node)"


@query(f"WITH {_RANKS} SELECT node, CAST(rank AS BIGINT) AS rank FROM ranked", "edge", recursive=True)
def topo_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G1: longest path from a root."""
    return graph.ranks(_edges(spark, sf_dir), _roots(spark, sf_dir))


@query(f"WITH {_RANKS} SELECT CAST(rank AS BIGINT) AS rank, string_agg(CAST(node AS STRING), ',' ORDER BY node) AS names FROM ranked GROUP BY rank", "edge", recursive=True)
def rank_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of each rank."""
    ranked = graph.ranks(_edges(spark, sf_dir), _roots(spark, sf_dir))
    return ranked.groupBy("rank").agg(F.array_join(in_order(F.col("node").cast("string"), "node"), ",").alias("names"))


@query("""WITH back AS (SELECT src, dst FROM edge UNION SELECT 3, 50 UNION SELECT 1, 12), reach AS (SELECT src AS a, dst AS b FROM back UNION SELECT r.a, e.dst FROM reach r JOIN back e ON e.src = r.b)
SELECT DISTINCT r.a AS node FROM reach r WHERE EXISTS (SELECT 1 FROM reach x WHERE x.a = r.a AND x.b = r.a)
OR (EXISTS (SELECT 1 FROM reach x JOIN reach y ON y.a = x.b AND y.b = x.b WHERE x.a = r.a) AND EXISTS (SELECT 1 FROM reach x JOIN reach y ON y.a = x.a AND y.b = x.a WHERE x.b = r.a))""", "edge", recursive=True)
def cycle_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes on a cycle or between cycles, after two edges back are added."""
    edges = _edges(spark, sf_dir).select("src", "dst").unionByName(spark.createDataFrame([(3, 50), (1, 12)], "src long, dst long"))
    return graph.on_cycles(edges)


@query("""WITH ex(n) AS (VALUES (CAST(10 AS BIGINT)), (CAST(7 AS BIGINT))), c AS (SELECT id AS node FROM pkg WHERE id IN (40, 61, 97) AND id NOT IN (SELECT n FROM ex)
UNION SELECT e.dst FROM c JOIN edge e ON e.src = c.node WHERE e.dst NOT IN (SELECT n FROM ex)) SELECT node FROM c""", "edge", "pkg", recursive=True)
def package_closure_excl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the selected packages need, excluded ones neither kept nor crossed."""
    start = view(spark, sf_dir, "pkg").where("id IN (40, 61, 97)").select(F.col("id").alias("node"))
    return graph.closure(_edges(spark, sf_dir), start, spark.createDataFrame([(10,), (7,)], "node long"))


@query("WITH c AS (SELECT id AS node FROM pkg WHERE id IN (33, 90) UNION SELECT e.dst FROM c JOIN edge e ON e.src = c.node) SELECT id, id NOT IN (SELECT node FROM c) AS keeps_lock FROM pkg", "edge", "pkg", recursive=True)
def recursive_unlock(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that stay locked when two packages and all they need are updated."""
    from .workspace import kept_locked

    packages, text = view(spark, sf_dir, "pkg").select("id"), F.col("id").cast("string")
    needs = _edges(spark, sf_dir).groupBy(F.col("src").alias("id")).agg(F.collect_set(F.col("dst").cast("string")).alias("dependencies"))
    lock = packages.join(needs, "id", "left").select(text.alias("name"), F.coalesce("dependencies", F.expr("cast(array() as array<string>)")).alias("dependencies"))
    asked = [str(r.id) for r in packages.where("id IN (33, 90)").collect()]
    kept = kept_locked(lock, asked, recursive=True).select(F.col("name").cast("long").alias("id"), F.lit(True).alias("kept")) if asked else packages.withColumn("kept", F.lit(True))
    return packages.join(kept, "id", "left").select("id", F.col("kept").isNotNull().alias("keeps_lock"))


@query("""WITH p AS (SELECT dst AS pkg, src AS parent, req, row_number() OVER (PARTITION BY dst ORDER BY src) AS n, first_value(req) OVER (PARTITION BY dst ORDER BY src) AS req1 FROM req)
SELECT pkg, parent, req, CAST(n AS BIGINT) AS parent_pos, req <> req1 AS differs FROM p""", "req")
def parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reverse edges with requirement; the first parent is the standard."""
    w = Window.partitionBy("dst").orderBy("src")
    return view(spark, sf_dir, "req").select(F.col("dst").alias("pkg"), F.col("src").alias("parent"), "req", F.row_number().over(w).cast("long").alias("parent_pos"), (F.col("req") != F.first("req").over(w)).alias("differs"))


@query("SELECT dst AS pkg, count(DISTINCT src % 4) = 1 AS same_source, count(*) AS n_parents FROM edge GROUP BY dst", "edge")
def parents_same_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A10: whether all parents name one source."""
    return _edges(spark, sf_dir).groupBy(F.col("dst").alias("pkg")).agg((F.count_distinct(F.col("src") % 4) == 1).alias("same_source"), F.count("*").alias("n_parents"))


@query("SELECT p.name, string_agg(q.name, ',' ORDER BY e.pos, q.id) AS deps FROM edge e JOIN pkg p ON p.id = e.src JOIN pkg q ON q.id = e.dst GROUP BY p.name", "edge", "pkg")
def packages_graph_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lock names joined to ids; dependencies of each package in order."""
    names = view(spark, sf_dir, "pkg")
    named = _edges(spark, sf_dir).join(names.select(F.col("id").alias("src"), "name"), "src").join(names.select(F.col("id").alias("dst"), F.col("name").alias("dep")), "dst")
    return named.groupBy("name").agg(F.array_join(in_order("dep", "pos", "dst"), ",").alias("deps"))


@query("SELECT DISTINCT dst AS missing FROM edge WHERE dst NOT IN (SELECT id FROM pkg WHERE id % 3 <> 0)", "edge", "pkg")
def missing_in_lock(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dependencies that a lock (here without every third package) lacks."""
    lock = view(spark, sf_dir, "pkg").where("id % 3 <> 0").select(F.col("id").alias("dst"))
    return _edges(spark, sf_dir).select("dst").distinct().join(lock, "dst", "left_anti").select(F.col("dst").alias("missing"))


@query("""WITH own AS (SELECT id, 0 AS rank, 0 AS pos, 'inc_' || CAST(id % 7 AS STRING) AS dir FROM pkg), dep AS (SELECT e.src AS id, 1 AS rank, e.dst AS pos, 'inc_' || CAST(e.dst % 7 AS STRING) AS dir FROM edge e WHERE e.dst % 4 <> 0)
SELECT id, string_agg(dir, ',' ORDER BY rank, pos) AS dirs FROM (SELECT * FROM own UNION ALL SELECT * FROM dep) x GROUP BY id""", "edge", "pkg")
def export_incdirs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A package's own exported directories, then its direct dependencies'; one level only."""
    exported = view(spark, sf_dir, "pkg").select("id", F.concat(F.lit("inc_"), (F.col("id") % 7).cast("string")).alias("dir"))
    deps = _edges(spark, sf_dir).join(exported.where("id % 4 <> 0"), F.col("dst") == F.col("id")).select(F.col("src").alias("id"), F.lit(1).alias("rank"), F.col("dst").alias("at"), "dir")
    rows = exported.select("id", F.lit(0).alias("rank"), F.lit(0).cast("long").alias("at"), "dir").unionByName(deps)
    return rows.groupBy("id").agg(F.array_join(in_order("dir", "rank", "at"), ",").alias("dirs"))


_PASS = "passes AS (SELECT src, dst, 't' || CAST(src % 5 AS STRING) AS cond, 't' || CAST(dst % 5 AS STRING) AS pass FROM edge)"


@query(f"""WITH {_PASS}, got AS (SELECT CAST(99 AS BIGINT) AS node, 't4' AS t UNION SELECT p.dst, p.pass FROM got g JOIN passes p ON p.src = g.node WHERE p.cond = g.t)
SELECT node, t FROM got""", "edge", recursive=True)
def pass_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets passed down the graph, each under its own condition, from one root."""
    passes = _edges(spark, sf_dir).select("src", "dst", F.concat(F.lit("t"), (F.col("src") % 5).cast("string")).alias("cond"), F.concat(F.lit("t"), (F.col("dst") % 5).cast("string")).alias("pass"))
    pairs = passes.select(F.struct(F.col("src").alias("node"), F.col("cond").alias("t")).alias("src"), F.struct(F.col("dst").alias("node"), F.col("pass").alias("t")).alias("dst"))
    start = spark.range(1).select(F.struct(F.lit(99).cast("long").alias("node"), F.lit("t4").alias("t")).alias("node"))
    return graph.closure(pairs, start).select("node.node", "node.t")


# Versions


def _tag_text() -> str:
    return "CAST(major AS STRING) || '.' || CAST(minor AS STRING) || '.' || CAST(patch AS STRING)"


def _tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "tag").withColumn("text", F.concat_ws(".", "major", "minor", "patch")).withColumn("version", semver.version(F.col("text")))


@query(f"SELECT pkg, rev, {_tag_text()} AS version, rank() OVER (PARTITION BY pkg ORDER BY major DESC, minor DESC, patch DESC) AS place FROM tag", "tag")
def semver_parse_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags parsed, newest first."""
    parsed = _tags(spark, sf_dir).withColumn("version", semver.from_tag(F.concat(F.lit("v"), "text")))
    return parsed.select("pkg", "rev", F.col("text").alias("version"), F.rank().over(Window.partitionBy("pkg").orderBy(F.desc("version"))).cast("long").alias("place"))


_FITS = """(CASE req WHEN '1' THEN major = 1 WHEN '^1.10.0' THEN major = 1 AND minor >= 10 WHEN '~1.22' THEN major = 1 AND minor = 22 WHEN '>=1.0.0, <2.0.0' THEN major = 1 WHEN '2' THEN major = 2
WHEN '<1.20' THEN major < 1 OR (major = 1 AND minor < 20) WHEN '>0.9.1' THEN major > 0 OR minor > 9 OR (minor = 9 AND patch > 1) ELSE true END)"""


@query(f"""WITH m AS (SELECT r.src, r.dst, r.req, {_tag_text()} AS v, row_number() OVER (PARTITION BY r.src, r.dst ORDER BY major DESC, minor DESC, patch DESC) AS n FROM req r JOIN tag t ON t.pkg = r.dst WHERE {_FITS})
SELECT src, dst, req, v AS newest FROM m WHERE n = 1""", "req", "tag")
def req_match_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest version that meets each requirement; the package is the join's key, versions are its theta."""
    reqs = view(spark, sf_dir, "req").withColumn("parsed", semver.requirement(F.col("req")))
    fits = reqs.join(_tags(spark, sf_dir), F.col("dst") == F.col("pkg")).where(semver.matches(F.col("version"), F.col("parsed")))
    return fits.groupBy("src", "dst", "req").agg(F.max_by("text", "version").alias("newest"))


@query("""WITH c AS (SELECT DISTINCT pkg, substr(rev, 1, 2) AS p FROM tag WHERE NOT regexp_full_match(substr(rev, 1, 2), '[0-9]+'))
SELECT c.pkg, c.p AS prefix, count(DISTINCT t.rev) AS n, min(t.rev) AS first_rev FROM c JOIN tag t ON t.pkg = c.pkg AND t.rev LIKE c.p || '%' GROUP BY c.pkg, c.p""", "tag")
def rev_prefix_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revisions that begin with a given prefix that is no version, inside one repository."""
    from .resolve import candidates_for

    tags = _tags(spark, sf_dir).select(F.col("pkg").alias("dep"), F.lit("git").alias("source"), "version", "text", "rev")
    wanted = tags.select("dep", F.concat(F.substring("rev", 1, 2), F.lit("")).alias("constraint")).where(~semver.is_requirement(F.col("constraint"))).distinct()
    return candidates_for(wanted, tags).groupBy(F.col("dep").alias("pkg"), F.col("constraint").alias("prefix")).agg(F.count("*").alias("n"), F.min_by("rev", "place").alias("first_rev"))


_BOUNDS = """b(req, bottom, top) AS (VALUES ('1','1.0.0','2.0.0'), ('^1.10.0','1.10.0','2.0.0'), ('~1.22','1.22.0','1.23.0'), ('>=1.0.0, <2.0.0','1.0.0','2.0.0'), ('2','2.0.0','3.0.0'), ('<1.20',NULL,'1.20.0'), ('>0.9.1','0.10.2',NULL), ('*',NULL,NULL))"""


def _bounded(reqs: DataFrame) -> DataFrame:
    """``reqs`` with the bounds of ``req``, as structs that order."""
    return reqs.withColumns({"bottom": semver.bottom_bound(F.col("req")), "top": semver.top_bound(F.col("req"))})


@query(f"WITH {_BOUNDS} SELECT src, dst, req, bottom, top FROM req JOIN b USING (req)", "req")
def version_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bounds of every requirement."""
    return _bounded(view(spark, sf_dir, "req")).select("src", "dst", "req", semver.dotted(F.col("bottom")).alias("bottom"), semver.dotted(F.col("top")).alias("top"))


@query(f"""WITH {_BOUNDS}, k(req, lo, hi) AS (VALUES ('1', 10000, 20000), ('^1.10.0', 11000, 20000), ('~1.22', 12200, 12300), ('>=1.0.0, <2.0.0', 10000, 20000), ('2', 20000, 30000), ('<1.20', -1, 12000), ('>0.9.1', 1002, 99999999), ('*', -1, 99999999)),
x AS (SELECT DISTINCT dst, src % 4 AS source, CASE WHEN src % 10 = 0 THEN NULL WHEN src % 9 = 0 THEN 'main' ELSE req END AS con FROM req)
SELECT dst, source, con, bottom, top, CAST(dense_rank() OVER (PARTITION BY dst ORDER BY source) AS BIGINT) AS source_no,
CAST(row_number() OVER (PARTITION BY dst ORDER BY source, CASE WHEN con IS NULL THEN 2 WHEN con = 'main' THEN 0 ELSE 1 END, hi DESC, lo DESC, con) AS BIGINT) AS place FROM x LEFT JOIN b ON b.req = con LEFT JOIN k ON k.req = con""", "req")
def conflict_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Constraints of a package by source, then kind, then highest upper and lower bound."""
    from . import resolve

    said = F.when(F.col("src") % 10 == 0, None).when(F.col("src") % 9 == 0, "main").otherwise(F.col("req"))
    asked = view(spark, sf_dir, "req").select(F.col("dst").alias("dep"), (F.col("src") % 4).alias("source"), said.alias("constraint"))
    return resolve.conflict_order(asked).select(F.col("dep").alias("dst"), "source", F.col("constraint").alias("con"), "bottom", "top", "source_no", "place")


@query(f"""WITH n AS (SELECT dst, count(*) AS n FROM req GROUP BY dst), ok AS (SELECT r.dst, t.major, t.minor, t.patch, count(DISTINCT r.src) AS k FROM req r JOIN (SELECT DISTINCT pkg, major, minor, patch FROM tag) t ON t.pkg = r.dst WHERE {_FITS} GROUP BY 1, 2, 3, 4)
SELECT ok.dst, {_tag_text()} AS version FROM ok JOIN n ON n.dst = ok.dst AND n.n = ok.k""", "req", "tag")
def constraint_division(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions that meet every constraint on their package."""
    reqs = view(spark, sf_dir, "req")
    counted = reqs.groupBy("dst").agg(F.count("*").alias("n"))
    tags = _tags(spark, sf_dir).select("pkg", "text", "version").distinct()
    fits = reqs.withColumn("parsed", semver.requirement(F.col("req"))).join(tags, F.col("dst") == F.col("pkg")).where(semver.matches(F.col("version"), F.col("parsed")))
    return fits.groupBy("dst", F.col("text").alias("version")).agg(F.count_distinct("src").alias("k")).join(counted, "dst").where("k = n").select("dst", "version")


@query("SELECT id, CASE WHEN id % 7 = 0 THEN 'locked' WHEN id % 5 = 0 THEN 'override' WHEN id % 3 = 0 THEN 'checked_out' ELSE 'declared' END AS origin FROM pkg", "pkg")
def overlay_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Locked, then override, then dirty checkout, then declaration."""
    from .resolve import overlaid

    declared = view(spark, sf_dir, "pkg").select(F.col("id").alias("dep"), F.lit("s").alias("source"), F.lit("1").alias("constraint"))
    layer = lambda n: declared.where(F.col("dep") % n == 0)
    return overlaid(declared, layer(7), layer(5), layer(3)).select(F.col("dep").alias("id"), F.when(F.col("origin") == "kept", "locked").otherwise(F.col("origin")).alias("origin"))


_LOCKS = f"""best AS (SELECT pkg, part, rev, {_tag_text()} AS v, row_number() OVER (PARTITION BY pkg ORDER BY major DESC, minor DESC, patch DESC, part DESC) AS a FROM tag),
best2 AS (SELECT pkg, rev, {_tag_text()} AS v, row_number() OVER (PARTITION BY pkg ORDER BY major DESC, minor DESC, patch DESC, part DESC) AS a FROM tag WHERE part % 7 <> 0 AND pkg % 9 <> 0),
old AS (SELECT * FROM best WHERE a = 1 AND pkg % 11 <> 0), new AS (SELECT * FROM best2 WHERE a = 1)"""


def _locks(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    tags = _tags(spark, sf_dir)
    best = lambda df: df.groupBy("pkg").agg(F.max_by(F.struct("rev", "text"), F.struct("version", "part")).alias("x")).select("pkg", "x.*")
    return best(tags).where("pkg % 11 <> 0"), best(tags.where("part % 7 <> 0 AND pkg % 9 <> 0"))


@query(f"WITH {_LOCKS} SELECT coalesce(o.pkg, n.pkg) AS pkg, coalesce(o.v, '') AS old_version, coalesce(n.v, '') AS new_version FROM old o FULL JOIN new n ON n.pkg = o.pkg WHERE o.rev IS DISTINCT FROM n.rev", "tag")
def lock_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packages whose revision changed, came or went; what is absent is blank."""
    from . import audit

    old, new = (x.select(F.col("pkg").alias("name"), F.col("rev").alias("revision"), F.col("text").alias("version")) for x in _locks(spark, sf_dir))
    return audit.lock_diff(old, new).select(F.col("name").alias("pkg"), F.col("old").alias("old_version"), F.col("new").alias("new_version"))


@query(f"WITH {_LOCKS} SELECT pkg, CASE WHEN pkg % 4 = 0 THEN NULL ELSE v END AS version, CASE WHEN pkg % 4 = 0 THEN 'path' ELSE 'git' END AS source_kind FROM old", "tag")
def lock_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Selected packages get a path for a source, and lose version and revision."""
    from .workspace import moved_locks

    old, _ = _locks(spark, sf_dir)
    lock = old.select(F.col("pkg").alias("name"), F.col("rev").alias("revision"), F.col("text").alias("version"), F.lit("Git").alias("source_kind"), F.lit("u").alias("source_uri"))
    chosen = old.where("pkg % 4 = 0").select(F.col("pkg").alias("name"), F.lit("/here").alias("path"))
    return moved_locks(lock, chosen).select(F.col("name").alias("pkg"), "version", F.lower("source_kind").alias("source_kind"))


@query(f"""WITH {_LOCKS}, hi AS (SELECT pkg, major, minor, patch, {_tag_text()} AS v FROM (SELECT *, row_number() OVER (PARTITION BY pkg ORDER BY major DESC, minor DESC, patch DESC) AS n FROM tag) x WHERE n = 1),
con AS (SELECT r.dst AS pkg, count(*) AS n FROM req r GROUP BY r.dst), ok AS (SELECT r.dst AS pkg, t.major, t.minor, t.patch, count(DISTINCT r.src) AS k FROM req r JOIN (SELECT DISTINCT pkg, major, minor, patch FROM tag) t ON t.pkg = r.dst WHERE {_FITS} GROUP BY 1, 2, 3, 4),
mc AS (SELECT pkg, major, minor, patch FROM (SELECT ok.*, row_number() OVER (PARTITION BY ok.pkg ORDER BY major DESC, minor DESC, patch DESC) AS n FROM ok JOIN con ON con.pkg = ok.pkg AND con.n = ok.k) x WHERE n = 1),
cur AS (SELECT pkg, major, minor, patch FROM (SELECT *, row_number() OVER (PARTITION BY pkg ORDER BY major DESC, minor DESC, patch DESC, part DESC) AS n FROM tag WHERE part % 7 <> 0 AND pkg % 9 <> 0) x WHERE n = 1),
j AS (SELECT c.pkg, (h.major, h.minor, h.patch) AS hi, (c.major, c.minor, c.patch) AS cur, CASE WHEN m.pkg IS NULL THEN NULL ELSE (m.major, m.minor, m.patch) END AS mc FROM cur c JOIN hi h ON h.pkg = c.pkg JOIN con ON con.pkg = c.pkg LEFT JOIN mc m ON m.pkg = c.pkg)
SELECT pkg, 'up-to-date' AS state FROM j WHERE hi = cur UNION ALL SELECT pkg, 'auto-update' FROM j WHERE mc > cur UNION ALL SELECT pkg, 'update' FROM j WHERE hi > cur AND (mc IS NULL OR mc < hi)""", "tag", "req")
def audit_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """States of each locked package with requirements; a package can have several."""
    from .audit import states

    tags, reqs = _tags(spark, sf_dir), view(spark, sf_dir, "req")
    _, lock = _locks(spark, sf_dir)
    locked = lock.select("pkg", "rev", semver.version(F.col("text")).alias("version"))
    said = reqs.select(F.col("dst").alias("pkg"), F.col("src").alias("parent"), F.col("src").alias("parent_pos"), F.col("req").alias("constraint"), F.lit("git").alias("source"))
    return states(locked.join(said.select("pkg").distinct(), "pkg", "left_semi"), tags.select("pkg", "version"), said).select("pkg", "state")


@query("""WITH l AS (SELECT layer, k || '/near' AS key, v AS value FROM layer UNION ALL SELECT layer, k || '/far', v FROM layer UNION ALL SELECT layer, k || '/flag', CASE WHEN layer % 9 = 1 THEN 'true' ELSE 'false' END FROM layer)
SELECT key, CASE WHEN key LIKE '%/near' THEN arg_min(value, layer) WHEN key LIKE '%/far' THEN arg_max(value, layer) ELSE CASE WHEN bool_or(value = 'true') THEN 'true' ELSE 'false' END END AS value FROM l GROUP BY key""", "layer")
def config_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest layer for scalars, farthest for overrides, any for flags."""
    from ..sources.documents import merged_config

    rows = view(spark, sf_dir, "layer")
    of = lambda kind, name, value: rows.select("layer", F.concat("k", F.lit(f"/{name}")).alias("key"), value.alias("value"), F.lit(kind).alias("kind"))
    flag = F.when(F.col("layer") % 9 == 1, "true").otherwise("false")
    return merged_config(of("scalar", "near", F.col("v")).unionByName(of("map", "far", F.col("v"))).unionByName(of("flag", "flag", flag)))


# Manifests and lists


@query("""WITH f AS (SELECT pkg, id, CASE WHEN path LIKE '%.sv' OR path LIKE '%.v' THEN 'verilog' WHEN path LIKE '%.vhd' THEN 'vhdl' END AS ft FROM file),
c AS (SELECT *, CASE WHEN row_number() OVER w = 1 OR ft IS DISTINCT FROM lag(ft) OVER w THEN 1 ELSE 0 END AS ch FROM f WINDOW w AS (PARTITION BY pkg ORDER BY id)),
r AS (SELECT *, sum(ch) OVER (PARTITION BY pkg ORDER BY id) AS run FROM c) SELECT pkg, CAST(run AS BIGINT) AS run, min(ft) AS file_type, count(*) AS n, min(id) AS first_id FROM r GROUP BY pkg, run""", "file")
def run_length_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of files of one type; no type is a type of its own."""
    files = view(spark, sf_dir, "file").withColumn("file_type", paths.file_type(F.col("path")))
    return tree.runs(files, F.col("file_type"), ["id"], ["pkg"], F.floor(F.col("id") / 4096)).groupBy("pkg", "run").agg(F.min("file_type").alias("file_type"), F.count("*").alias("n"), F.min("id").alias("first_id"))


@query("""WITH o AS (SELECT regexp_extract(path, '[^/]*$', 0) AS b, arg_max(path, id) AS p, arg_max(pkg, id) AS op FROM (SELECT 'x/' || CAST(id % 500 AS STRING) || '.sv' AS path, pkg, id FROM file WHERE id % 6 = 0) y GROUP BY 1)
SELECT f.id, coalesce(o.p, f.path) AS path, CASE WHEN o.p IS NOT NULL THEN 'OVERRIDDEN from ' || o.op || ': ' || f.path END AS comment FROM file f LEFT JOIN o ON o.b = regexp_extract(f.path, '[^/]*$', 0)""", "file")
def override_basename(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files replaced by the last override of their name."""
    from .manifest import override

    files = view(spark, sf_dir, "file")
    given = files.where("id % 6 = 0").select("id", "pkg", F.concat(F.lit("x/"), (F.col("id") % 500).cast("string"), F.lit(".sv")).alias("path"))
    return override(files.select("id", "path"), given, "id").select("id", "path", "comment")


@query("SELECT name, arg_max(CASE WHEN value IS NULL THEN 'none' ELSE value END, pos) AS value, min(pos) AS pos FROM defn GROUP BY name", "defn")
def global_defines_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A2: first position, last value; no value is a value."""
    return last_wins(view(spark, sf_dir, "defn").select("name", "value", "pos"), ["name"], "value", "pos").select("name", F.coalesce("value", F.lit("none")).alias("value"), "pos")


@query("""SELECT pkg, id, path, CASE WHEN path LIKE '%.sv' OR path LIKE '%.v' THEN 'verilog' WHEN path LIKE '%.vhd' THEN 'vhdl' ELSE 'other' END AS list FROM file""", "file")
def split_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A3: three lists by type, a row for each file in its list; ``id`` orders them."""
    return view(spark, sf_dir, "file").select("pkg", "id", "path", F.coalesce(paths.file_type(F.col("path")), F.lit("other")).alias("list"))


@query("SELECT pkg, id, CASE WHEN id % 2 = 0 THEN replace(path, pkg, '$ROOT') ELSE substr(path, length(pkg) + 2) END AS line FROM file", "file")
def flist_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """List lines with the root replaced, or relative to it; text only."""
    from .render import rooted

    files = view(spark, sf_dir, "file")
    return files.select("pkg", "id", F.when(F.col("id") % 2 == 0, rooted(F.col("path"), F.col("pkg"))).otherwise(paths.relative(F.col("path"), F.col("pkg"))).alias("line"))


@query("""WITH i AS (SELECT DISTINCT pkg, 0 AS section, '+incdir+' || pkg || '/inc' || CAST(id % 3 AS STRING) AS line, pkg || '/inc' || CAST(id % 3 AS STRING) AS k FROM file),
d AS (SELECT DISTINCT pkg, 1 AS section, '+define+' || CASE WHEN id % 2 = 0 THEN 'A=1' ELSE 'B' END AS line, CASE WHEN id % 2 = 0 THEN 'A' ELSE 'B' END AS k FROM file), f AS (SELECT pkg, 2 AS section, path AS line, lpad(CAST(id AS STRING), 20, '0') AS k FROM file)
SELECT pkg, section, k AS key, line FROM (SELECT * FROM i UNION ALL SELECT * FROM d UNION ALL SELECT * FROM f) x""", "file")
def flist_plus_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Include directories, defines and files in three sections, ordered by section and key."""
    from .render import flist_plus

    files = view(spark, sf_dir, "file")
    dirs = files.select("pkg", F.concat("pkg", F.lit("/inc"), (F.col("id") % 3).cast("string")).alias("dir"))
    defines = files.select("pkg", F.when(F.col("id") % 2 == 0, "A").otherwise("B").alias("name"), F.when(F.col("id") % 2 == 0, "1").alias("value"))
    return flist_plus(files.select("pkg", "id", "path"), dirs, defines, ["pkg"], "id").select("pkg", "section", "key", "line")


_FORMATS = """fmt(format, targets) AS (VALUES ('flist', 'flist'), ('flist-plus', 'flist'), ('vsim', 'vsim,simulation'), ('vcs', 'vcs,simulation'), ('verilator', 'verilator,synthesis'), ('synopsys', 'synopsys,synthesis'), ('formality', 'synopsys,synthesis,formality'),
('riviera', 'riviera,simulation'), ('genus', 'genus,synthesis'), ('vivado', 'vivado,fpga,xilinx,synthesis'), ('vivado-sim', 'vivado,fpga,xilinx,simulation'), ('precision', 'precision,fpga,synthesis'), ('template', ''), ('template_json', ''))"""


@query(f"WITH {_FORMATS} SELECT format, targets, k AS fileset FROM fmt CROSS JOIN (SELECT '' AS k UNION ALL SELECT ' -simset') s WHERE k = '' OR format IN ('vivado', 'vivado-sim')")
def format_default_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Default targets of each format, and the filesets of the two that have them."""
    from .render import FILESETS, FORMAT_TARGETS

    rows = [(f, ",".join(t), s) for f, t in FORMAT_TARGETS.items() for s in FILESETS.get(f, [""])]
    return spark.createDataFrame(rows, "format string, targets string, fileset string")


@query("""WITH f AS (SELECT pkg, id, path, CASE id % 12 WHEN 0 THEN 'view' WHEN 1 THEN 'notview' WHEN 2 THEN 'click_view' WHEN 3 THEN 'click_or_view' WHEN 4 THEN 'view_noterror' WHEN 5 THEN 'signup_or_click_purchase' WHEN 6 THEN 'noterror_or_signup'
WHEN 7 THEN 'purchase' WHEN 8 THEN 'error_or_view_notpurchase' WHEN 9 THEN 'notclick_signup' WHEN 10 THEN 'notclick_or_notview' ELSE 'files_rtl' END AS fs FROM file),
d AS (SELECT pkg, fs, '::d' || CAST(id % 3 AS STRING) AS v, min(id) AS id FROM f GROUP BY ALL), e AS (SELECT pkg, fs, string_agg(v, ',' ORDER BY id) AS depend FROM d GROUP BY pkg, fs)
SELECT pkg, fs AS fileset, string_agg(path, ' ' ORDER BY id) AS files, any_value(depend) AS depend, count(*) AS n, ':' || ':' || pkg || ':' || '0.1.0' AS vlnv FROM f JOIN e USING (pkg, fs) GROUP BY pkg, fs""", "file")
def fileset_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files grouped by the name of their target expression, each dependency once."""
    from ..sources.cores import fileset_of, merged_filesets

    files = view(spark, sf_dir, "file").join(view(spark, sf_dir, "tree").select(F.col("node").alias("id"), "target"), "id").withColumn("fileset", fileset_of(F.col("target"), views.EXPRESSIONS))
    depends = files.select("pkg", "fileset", F.col("id").alias("pos"), F.concat(F.lit("::d"), (F.col("id") % 3).cast("string")).alias("vlnv"))
    merged = merged_filesets(files.select("pkg", "fileset", F.col("id").alias("pos"), "path", F.lit(None).cast("string").alias("include_path")), depends)
    listed = F.array_join(F.transform("files", lambda f: f["path"]), " ")
    return merged.select("pkg", "fileset", listed.alias("files"), F.array_join("depend", ",").alias("depend"), F.size("files").cast("long").alias("n"), paths.vlnv(F.lit(""), F.col("pkg"), F.lit("0.1.0")).alias("vlnv"))


@query("""WITH l AS (SELECT doc_id, trim(x.line) AS line, x.n FROM documents, LATERAL (SELECT unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n) x),
t AS (SELECT doc_id, n, unnest(string_split(line, ' ')) AS w FROM l WHERE line <> '' AND line NOT LIKE '#%' AND line NOT LIKE '//%')
SELECT doc_id, count(*) FILTER (WHERE w LIKE '+%') AS n_plus, count(*) FILTER (WHERE w NOT LIKE '+%' AND w <> '') AS n_files FROM t GROUP BY doc_id""")
def flist_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """List text to lines to words, comments and blanks left out."""
    from ..sources.documents import flist_words

    words = flist_words(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), "text")
    return words.groupBy("doc_id").agg(F.count_if(F.startswith("word", F.lit("+"))).alias("n_plus"), F.count_if(~F.startswith("word", F.lit("+")) & (F.col("word") != "")).alias("n_files"))


@query("SELECT id, path FROM file WHERE (path GLOB 'src1*/*' OR path GLOB 'src2/*.sv') AND NOT path GLOB '*/1*'", "file")
def include_exclude_glob(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kept where an include pattern matches and no exclude pattern does."""
    files = view(spark, sf_dir, "file")
    include = spark.createDataFrame([("src1*/*",), ("src2/*.sv",)], "pat string")
    exclude = spark.createDataFrame([("*/1*",)], "pat string")
    hit = F.rlike(F.col("path"), paths.glob_regex(F.col("pat")))
    return files.join(F.broadcast(include), hit, "left_semi").join(F.broadcast(exclude), hit, "left_anti").select("id", "path")


# Symbols


_SYM = "last AS (SELECT name, max(idx) AS idx FROM decl GROUP BY name), dep AS (SELECT DISTINCT r.idx AS src, l.idx AS dst FROM ref r JOIN last l USING (name))"


@query(f"WITH {_SYM} SELECT src, dst FROM dep", "decl", "ref")
def symbol_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References to the last declaration of a name; unknown names lead nowhere."""
    from ..operators.syntax import symbol_edges

    return symbol_edges(view(spark, sf_dir, "decl"), view(spark, sf_dir, "ref"))


@query(f"WITH {_SYM}, seen AS (SELECT idx AS node FROM last WHERE name IN (SELECT min(name) FROM decl UNION ALL SELECT max(name) FROM decl) UNION SELECT d.dst FROM seen s JOIN dep d ON d.src = s.node) SELECT node FROM seen", "decl", "ref", recursive=True)
def reachable_from_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trees reached from the given tops."""
    from ..operators.syntax import reachable

    declared = view(spark, sf_dir, "decl")
    tops = declared.agg(F.min("name"), F.max("name")).first()
    return reachable(declared, view(spark, sf_dir, "ref"), list(tops))


@query("""SELECT page_id AS idx, CASE WHEN page_id % 4 = 3 THEN 'other' WHEN page_id % 13 = 0 THEN 'broken' WHEN page_id % 11 = 0 THEN 'encrypted' ELSE 'ok' END AS cls,
CASE WHEN page_id % 4 = 3 THEN true WHEN page_id % 13 = 0 THEN false WHEN page_id % 11 = 0 THEN true ELSE page_id % 3 = 0 END AS kept FROM pages""")
def retention_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Broken dropped, encrypted kept, the rest if reachable; other languages always."""
    from ..operators.syntax import parse_class, retained

    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.col("page_id").alias("idx"))
    bad, sealed = F.col("idx") % 13 == 0, F.col("idx") % 11 == 0
    kind = parse_class(F.when(F.col("idx") % 4 != 3, "verilog"), ~(bad | sealed), sealed & ~bad)
    return pages.select("idx", kind.alias("cls"), retained(kind, F.col("idx") % 3 == 0, broken="drop", encrypted="keep").alias("kept"))


@query("""WITH d AS (SELECT DISTINCT pkg || '/' || CAST(id % 10 AS STRING) AS dir FROM file), h AS (SELECT DISTINCT pkg || '/' || CAST(id % 7 AS STRING) || '/x.svh' AS header FROM file WHERE id % 3 = 0)
SELECT dir FROM d WHERE EXISTS (SELECT 1 FROM h WHERE header = dir OR starts_with(header, dir || '/'))""", "file")
def trim_incdirs_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directories that some header lies under."""
    files = view(spark, sf_dir, "file")
    from .sources import used_dirs

    dirs = files.select(F.concat_ws("/", "pkg", (F.col("id") % 10).cast("string")).alias("dir")).distinct()
    headers = files.where("id % 3 = 0").select(F.concat_ws("/", "pkg", (F.col("id") % 7).cast("string"), F.lit("x.svh")).alias("header")).distinct()
    return used_dirs(dirs, headers)


@query("""WITH m AS (SELECT DISTINCT name, CASE WHEN name IN ('the', 'de') THEN name ELSE 'pre_' || name || '_suf' END AS new FROM decl) SELECT r.idx, r.name, coalesce(m.new, r.name) AS new_name, coalesce(m.new <> r.name, false) AS renamed FROM ref r LEFT JOIN m USING (name)""", "decl", "ref")
def rename_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declared names get a prefix and suffix, but for excluded ones; unknown names stay."""
    from ..operators.syntax import rename_map

    names = rename_map(view(spark, sf_dir, "decl").select("name"), "pre_", "_suf", ["the", "de"])
    return view(spark, sf_dir, "ref").join(names, "name", "left").select("idx", "name", F.coalesce("new_name", "name").alias("new_name"), F.coalesce(F.col("new_name") != F.col("name"), F.lit(False)).alias("renamed"))


# Sources, diagnostics, small functions


@query("""WITH r AS (SELECT 'refs/tags/v' || CAST(part % 100 AS STRING) AS ref, rev, part % 2 = 0 AS peeled, part FROM tag)
SELECT ref, coalesce(min(rev) FILTER (WHERE peeled), min(rev)) AS hash FROM r GROUP BY ref""", "tag")
def parse_refs_peeled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listing lines; the peeled hash of an annotated tag replaces the tag's own."""
    from ..sources.git import parse_refs

    tags = view(spark, sf_dir, "tag")
    lines = tags.select(F.concat("rev", F.lit(" refs/tags/v"), (F.col("part") % 100).cast("string"), F.when(F.col("part") % 2 == 0, "^{}").otherwise("")).alias("value"))
    return parse_refs(lines).select("ref", "hash")


@query("""WITH h AS (SELECT 'n' || CAST(part % 50 AS STRING) AS name, rev, part % 2 AS prec FROM tag WHERE part % 3 <> 0), k AS (SELECT DISTINCT rev FROM tag WHERE part % 5 <> 0), x AS (SELECT name, min(rev) AS rev, prec FROM h WHERE rev IN (SELECT rev FROM k) GROUP BY name, prec)
SELECT name, arg_max(rev, prec) AS rev FROM x GROUP BY name""", "tag")
def refs_known_revs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of known revisions; a tag wins over a branch of its name."""
    from ..sources.git import names_of

    tags = view(spark, sf_dir, "tag")
    refs = tags.where("part % 3 <> 0").select(F.concat(F.lit("n"), (F.col("part") % 50).cast("string")).alias("name"), F.col("rev").alias("hash"), (F.col("part") % 2 == 1).alias("is_tag"))
    return names_of(refs, tags.where("part % 5 <> 0").select(F.col("rev").alias("hash"))).select("name", F.col("hash").alias("rev"))


@query("SELECT id, CASE WHEN id % 2 = 0 THEN 'https://h' || CAST(id % 3 AS STRING) || '/' || name || '.git' ELSE 'ssh://g/' || name || '/repo' END AS url FROM pkg", "pkg")
def remote_url_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P25: a place for the name in the template, or none."""
    packages = view(spark, sf_dir, "pkg")
    template = F.when(F.col("id") % 2 == 0, F.concat(F.lit("https://h"), (F.col("id") % 3).cast("string"), F.lit("//"))).otherwise("ssh://g/{}/repo")
    return packages.select("id", paths.remote_url(template, F.col("name")).alias("url"))


@query("""SELECT id, CASE WHEN id % 2 = 0 AND id % 3 = 0 THEN 'error' WHEN id % 5 = 0 AND id % 7 = 0 THEN 'error' WHEN id % 2 = 0 THEN CASE WHEN id % 5 = 0 OR id % 7 = 0 THEN 'error' ELSE 'path' END
WHEN id % 3 = 0 THEN CASE WHEN id % 5 = 0 THEN 'git_version' WHEN id % 7 = 0 THEN 'git_revision' ELSE 'error' END WHEN id % 5 = 0 THEN 'version' ELSE 'error' END AS kind FROM pkg""", "pkg")
def dep_kind_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The legal combinations of path, git, version and revision."""
    from ..sources.documents import dependency_kind

    has = lambda n, v: F.when(F.col("id") % n == 0, v)
    return view(spark, sf_dir, "pkg").select("id", dependency_kind(has(2, "p"), has(3, "g"), has(5, "1"), has(7, "r")).alias("kind"))


@query("SELECT id AS subject, CASE WHEN id % 3 = 0 THEN 'warning' ELSE 'error' END AS severity, 'E31' AS code FROM file WHERE path LIKE '%.vhd' AND id % 4 <> 0", "file")
def missing_files_diag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that a listing lacks; suppressed codes are warnings, repeated messages are one."""
    from .diagnostics import Suppressed, missing_files

    files = view(spark, sf_dir, "file")
    listing = files.where("NOT (path LIKE '%.vhd' AND id % 4 <> 0)").select("path")
    found = missing_files(files.select(F.col("id").alias("subject"), "path").unionByName(files.select(F.col("id").alias("subject"), "path")), listing)
    return Suppressed(["E31"]).downgrade(found, F.col("subject") % 3 == 0).select("subject", "severity", "code").distinct()


@query("SELECT 'plug' || CAST(id % 60 AS STRING) AS plugin, count(DISTINCT name) AS n FROM pkg GROUP BY 1 HAVING count(DISTINCT name) > 1", "pkg")
def plugin_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plugins that two packages offer."""
    offered = view(spark, sf_dir, "pkg").select(F.concat(F.lit("plug"), (F.col("id") % 60).cast("string")).alias("plugin"), "name")
    return offered.groupBy("plugin").agg(F.count_distinct("name").alias("n")).where("n > 1")


@query("""SELECT id, CASE WHEN line LIKE 'Receiving objects:%' THEN 'receiving' WHEN line LIKE 'Resolving deltas:%' THEN 'resolving' WHEN line LIKE 'Cloning into%' THEN 'cloning' WHEN line LIKE '%registered for path%' THEN 'registered' WHEN line LIKE '%checked out%' THEN 'checkout' WHEN line LIKE 'fatal:%' THEN 'error' ELSE 'other' END AS class,
CASE WHEN line LIKE 'Receiving%' OR line LIKE 'Resolving%' THEN CAST(regexp_extract(line, '([0-9]+)%', 1) AS INT) END AS percent FROM line""", "line")
def progress_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """progress lines by class, with their captures."""
    from ..streaming.progress import classified

    return classified(view(spark, sf_dir, "line"), "line").select("id", "class", "percent")


@query(None)
def checkout_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """names of checkouts and databases, by a hash of url and root."""
    from ..sources.git import checkout_names

    return checkout_names(view(spark, sf_dir, "pkg").select("name", F.concat(F.lit("https://x/"), "name").alias("url")), "root")


@query("""SELECT id, CASE id % 4 WHEN 0 THEN 'a/b' || CAST(id AS STRING) WHEN 1 THEN '/c' || CAST(id AS STRING) WHEN 2 THEN '../d' ELSE '/e/' || CAST(id AS STRING) END AS path FROM pkg""", "pkg")
def path_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """paths without empty, dot and double-dot components."""
    n = F.col("id").cast("string")
    raw = F.when(F.col("id") % 4 == 0, F.concat(F.lit("a/./x/../b"), n)).when(F.col("id") % 4 == 1, F.concat(F.lit("/../c"), n, F.lit("/"))).when(F.col("id") % 4 == 2, F.lit("x/../../d")).otherwise(F.concat(F.lit("/e//"), n))
    return view(spark, sf_dir, "pkg").select("id", paths.normal(raw).alias("path"))


@query("""SELECT event_id, CASE WHEN value < 1 THEN CAST(CAST(floor(value * 1000) AS BIGINT) AS STRING) || 'ms' WHEN value < 60 THEN printf('%.1f', value) || 's' ELSE printf('%.1f', value / 60) || 'min' END AS shown FROM events""")
def duration_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """durations for display."""
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", paths.duration(F.col("value")).alias("shown"))


@query("""WITH l AS (SELECT user_id, list(t ORDER BY t) AS a FROM active GROUP BY user_id)
SELECT user_id, CASE len(a) WHEN 1 THEN a[1] WHEN 2 THEN a[1] || ' and ' || a[2] ELSE array_to_string(a[1:len(a) - 1], ', ') || ', and ' || a[len(a)] END AS said FROM l""", "active")
def human_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """a list in words."""
    return _active_set(spark, sf_dir).select("user_id", paths.human_list(F.array_sort("targets")).alias("said"))


@query("""WITH t AS (SELECT pkg, CASE WHEN part % 2 = 0 THEN 'git' ELSE 'path' END AS kind, rev, min(part * 100000 - pkg) AS pos FROM tag GROUP BY 1, 2, 3) SELECT pkg, kind, rev, row_number() OVER (ORDER BY pos, pkg) - 1 AS ref FROM t""", "tag")
def intern_dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense ids of distinct (package, kind, revision) tuples, in order of arrival."""
    from .resolve import interned

    tags = view(spark, sf_dir, "tag").select("pkg", F.when(F.col("part") % 2 == 0, "git").otherwise("path").alias("kind"), "rev", (F.col("part") * 100000 - F.col("pkg")).alias("pos"))
    return interned(tags, ["pkg", "kind", "rev"], "pos")


@query(None)
def resolve_fixpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions picked for everything that the roots need."""
    from .resolve import resolve

    reqs = view(spark, sf_dir, "req")
    candidates = _tags(spark, sf_dir).select(F.col("pkg").cast("string").alias("dep"), F.lit("git").alias("source"), "version", F.col("text"), "rev")
    # an odd minor version asks for less than an even one
    revs = candidates.select(F.col("dep").alias("parent"), F.col("rev").alias("parent_rev"), (F.col("version.minor") % 2 == 1).alias("odd")).distinct()
    rows = reqs.select(F.col("src").cast("string").alias("parent"), F.col("dst").cast("string").alias("dep"), "pos", F.lit("git").alias("source"), "req")
    declared = rows.join(revs, "parent").select("parent", "parent_rev", "dep", "pos", "source", F.when(F.col("odd"), "*").otherwise(F.col("req")).alias("constraint"))
    root = rows.groupBy().agg(F.max(F.col("parent").cast("long"))).first()[0]
    asked = rows.where(F.col("parent") == str(root)).select(F.lit("top").alias("parent"), F.lit(None).cast("string").alias("parent_rev"), "dep", "pos", "source", F.col("req").alias("constraint"))
    picked, failed = resolve(declared.unionByName(asked), candidates, "top")
    none = F.lit(None).cast("string")
    return picked.select("dep", "text", "rev", F.lit("picked").alias("state")).unionByName(failed.select("dep", none.alias("text"), none.alias("rev"), F.col("reason").alias("state")))


# Plans of what a workspace needs done


@query("""WITH w AS (SELECT l_orderkey AS ord, l_linenumber AS ln, l_linenumber % 7 <> 0 AS e, CASE WHEN l_partkey % 9 = 0 THEN NULL ELSE l_partkey % 4 END AS cur, l_suppkey % 4 AS want, l_quantity % 2 = 0 AS url, l_orderkey % 3 > 0 AS ok, l_orderkey % 2 = 0 AS own, l_suppkey % 11 = 0 AS forced, l_partkey % 13 = 0 AS listed FROM lineitem),
d AS (SELECT *, CASE WHEN NOT e OR cur IS NULL THEN 'clone' WHEN cur = want THEN 'clean' WHEN url THEN 'checkout' ELSE 'clone' END AS raw FROM w),
g AS (SELECT *, e AND own AND NOT (forced OR listed) AND (raw = 'clone' OR raw = 'checkout' AND NOT ok) AS held FROM d)
SELECT CASE WHEN held THEN 'clean' ELSE raw END AS state, CASE WHEN held THEN 'W19' END AS code, count(*) AS n, min(ord) AS first_order FROM g GROUP BY 1, 2""")
def checkout_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What to do with each working copy."""
    from .workspace import checkout_state

    c, line = F.col, spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    current = F.when(c("l_partkey") % 9 != 0, c("l_partkey") % 4)
    state = checkout_state(c("l_linenumber") % 7 != 0, current, c("l_suppkey") % 4, c("l_quantity") % 2 == 0, c("l_orderkey") % 3 > 0, chosen_dir=c("l_orderkey") % 2 == 0, force=c("l_suppkey") % 11 == 0, listed=c("l_partkey") % 13 == 0)
    return line.select("l_orderkey", state.alias("s")).groupBy(c("s.state").alias("state"), c("s.code").alias("code")).agg(F.count("*").alias("n"), F.min("l_orderkey").alias("first_order"))


@query("""SELECT CASE WHEN c_custkey % 5 = 0 THEN 'init' WHEN c_custkey % 7 = 0 THEN 'fetch' WHEN c_nationkey < c_custkey % 25 THEN 'skip' ELSE 'fetch' END AS action, count(*) AS n FROM customer GROUP BY 1""")
def database_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which databases are made, fetched or fresh."""
    from .workspace import database_action

    c, made = F.col, spark.read.parquet(f"{sf_dir}/customer.parquet")
    action = database_action(c("c_custkey") % 5 != 0, c("c_nationkey"), c("c_custkey") % 25, force=F.when(c("c_custkey") % 7 == 0, F.lit(True)))
    return made.groupBy(action.alias("action")).agg(F.count("*").alias("n"))


@query("""SELECT CASE WHEN id % 4 = 0 THEN 'create' WHEN id % 4 = 1 THEN 'skip' WHEN id % 3 = kind % 3 THEN 'keep' ELSE 'replace' END AS action, count(*) AS n FROM pkg GROUP BY 1""", "pkg")
def link_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links to create, replace, keep or leave to a real file."""
    from .workspace import link_action

    action = link_action(F.col("id") % 4 != 0, F.col("id") % 4 != 1, F.col("id") % 3, F.col("kind") % 3)
    return view(spark, sf_dir, "pkg").groupBy(action.alias("action")).agg(F.count("*").alias("n"))


@query("""SELECT CAST(p_size AS BIGINT) AS dir, CAST(coalesce(max(CASE WHEN p_partkey % 3 = 0 THEN p_partkey % 10000 END), 0) + 1 AS BIGINT) AS number FROM part GROUP BY p_size""")
def patch_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The number of the next patch of each folder."""
    from .workspace import next_patch

    name = F.concat(F.lpad((F.col("p_partkey") % 10000).cast("string"), 4, "0"), F.when(F.col("p_partkey") % 3 == 0, "-x.patch").otherwise("-x.md"))
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_size").alias("dir"), name.alias("name"))
    return next_patch(parts).select(F.col("dir").cast("long").alias("dir"), F.col("number").cast("long").alias("number"))


@query("""WITH m AS (SELECT c_nationkey AS n, max(c_custkey % 3) AS depth FROM customer GROUP BY 1)
SELECT CAST(c_custkey AS BIGINT) AS id, CASE WHEN depth = 0 THEN '/w/' || CAST(n AS STRING) WHEN depth = 1 THEN '/w/' || CAST(n AS STRING) || '/a' ELSE '/w/' || CAST(n AS STRING) || '/a/b' END AS root FROM customer JOIN m ON c_nationkey = n""".replace("CAST(n AS STRING)", "CAST(n AS VARCHAR)"))
def manifest_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest folder with a manifest at or above each start."""
    from .workspace import roots

    customer = spark.read.parquet(f"{sf_dir}/customer.parquet")
    top = F.concat(F.lit("/w/"), F.col("c_nationkey").cast("string"))
    starts = customer.select("c_custkey", F.concat(top, F.lit("/a/b/"), F.col("c_custkey").cast("string")).alias("start"), F.lit(1).alias("device"))
    deep = F.when(F.col("c_custkey") % 3 == 0, top).when(F.col("c_custkey") % 3 == 1, F.concat(top, F.lit("/a"))).otherwise(F.concat(top, F.lit("/a/b")))
    found = roots(starts, customer.select(deep.alias("dir"), F.lit(1).alias("device")))
    return found.select(F.element_at(F.split("start", "/"), -1).cast("long").alias("id"), "root")


@query("""SELECT id, path FROM file WHERE (path LIKE 'src1/%.sv' OR path LIKE 'src2/%' OR path LIKE 'src3%') AND NOT path LIKE '%7.v'""", "file")
def vendor_copy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that vendoring copies. Wildcards cross folders, and the folder part of a pattern counts as a pattern, so
    ``src3*/*.v`` takes all of those folders."""
    from .workspace import copied

    include, exclude = F.array(F.lit("src1/*.sv"), F.lit("src2"), F.lit("src3*/*.v")), F.array(F.lit("*7.v"), F.lit(".git"))
    return view(spark, sf_dir, "file").where(copied(F.col("path"), include, exclude)).select("id", "path")
