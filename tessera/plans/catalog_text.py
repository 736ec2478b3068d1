"""Queries over texts: scripts line by line, sources, manifests and recorded output, each with SQL in other words."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..frames import in_order
from ..functions import paths, targets
from ..operators import syntax
from . import render, workspace
from .catalog import query
from .views import view

# Scripts: four files a group, cut by type

_G = """f AS (SELECT grp * 4 + CASE WHEN path LIKE '%.sv' OR path LIKE '%.v' THEN 0 WHEN path LIKE '%.vhd' THEN 1 ELSE 2 END AS no, pos, path FROM file),
g AS (SELECT no, no % 4 AS ty, count(*) AS n, (no - no % 4) // 4 % 3 AS k FROM f GROUP BY no)"""


def _groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups by four documents and type, with a define and two directories each."""
    files = view(spark, sf_dir, "file").withColumn("file_type", paths.file_type(F.col("path")))
    kind = F.when(F.col("file_type") == "verilog", 0).when(F.col("file_type") == "vhdl", 1).otherwise(2)
    rows = files.withColumn("no", F.col("grp") * 4 + kind).groupBy("no").agg(F.first("file_type").alias("file_type"), in_order(F.struct(F.concat(F.lit("/r/"), "path").alias("file"), F.lit(None).cast("string").alias("comment")), "pos").alias("files"))
    defines = F.array(F.struct(F.lit("K").alias("name"), (F.floor(F.col("no") / 4) % 3).cast("string").alias("value")), F.struct(F.lit("V").alias("name"), F.lit(None).cast("string").alias("value")))
    return rows.select("no", F.concat(F.lit("G"), F.col("no").cast("string")).alias("metadata"), "file_type", defines.alias("defines"), F.array(F.lit("/r/inc"), F.lit("/x")).alias("incdirs"), "files")


def _body(spark: SparkSession, sf_dir: str, format: str) -> DataFrame:
    lines = render.script(_groups(spark, sf_dir), format, root="/r", stop=True, annotate=True)
    return lines.where("section = 1").select("no", F.col("pos").cast("long").alias("pos"), "line")


def _sql(*parts: str) -> str:
    """SQL for (no, pos, line): parts in order, each a query of (no, o, line) over f and g; places are counted a group."""
    every = " UNION ALL ".join(f"SELECT no, {i} AS s, o, line FROM ({p}) p{i}" for i, p in enumerate(parts))
    return f"WITH {_G}, l AS ({every}) SELECT no, CAST(row_number() OVER (PARTITION BY no ORDER BY s, o) - 1 AS BIGINT) AS pos, line FROM l"


def _const(line: str, where: str = "true") -> str:
    return f"SELECT no, 0 AS o, {line} AS line FROM g WHERE {where}"


_BACK = "chr(92)"
_META, _KNOWN, _V, _H = "'# G' || CAST(no AS VARCHAR)", "ty < 2", "ty = 0", "ty = 1"
_SKIP = (_const("'# Skipping ' || CAST(n AS VARCHAR) || ' file(s) of unknown type (prefix with sv:/v:/vhd: to set one):'", "ty = 2"), "SELECT no, pos AS o, '#   $ROOT/' || path AS line FROM f WHERE no % 4 = 2")
_QUOTED = "'\"$ROOT/' || path || '\"'"
_LAST = "pos = max(pos) OVER (PARTITION BY no)"


def _flags(verilog: str, vhdl: str, end: str, *, catch: bool = True) -> str:
    """SQL of a tool that takes everything on the command; ``end`` is what follows the last file."""
    head = "'if {[catch { " if catch else "'"
    parts = [
        _const(_META), _const(f"{head}{verilog} ' || {_BACK}", _V), _const(f"{head}{vhdl} ' || {_BACK}", _H), _const(f"'\"+define+K=' || CAST(k AS VARCHAR) || '\" ' || {_BACK}", _V), _const(f"'\"+define+V\" ' || {_BACK}", _V),
        _const(f"'\"+incdir+$ROOT/inc\" ' || {_BACK}", _V), _const(f"'\"+incdir+/x\" ' || {_BACK}", _V), f"SELECT no, pos AS o, {_QUOTED} || CASE WHEN {_LAST} THEN {end} ELSE ' ' || {_BACK} END AS line FROM f WHERE no % 4 < 2",
    ]
    return _sql(*parts, *([_const("'}]} {return 1}'", _KNOWN)] if catch else []), *_SKIP)


def _listed(verilog: str, vhdl: str, second: str, after: str = "", *, head: str = "", foot: str = "") -> str:
    """SQL of a tool that sets a search path and takes a list."""
    parts = [
        _const(_META), _const("'set search_path $search_path_initial'", _KNOWN), _const("'lappend search_path \"$ROOT/inc\"'", _KNOWN), _const(f"'lappend search_path \"{second}\"'", _KNOWN), *([_const(f"'{after}'", _KNOWN)] if after else []),
        _const(f"'{head}{verilog} ' || {_BACK}", _V), _const(f"'{head}{vhdl} ' || {_BACK}", _H), _const(f"'-define {{ ' || {_BACK}", _KNOWN), _const(f"'K=' || CAST(k AS VARCHAR) || ' ' || {_BACK}", _KNOWN), _const(f"'V ' || {_BACK}", _KNOWN), _const(f"'}} ' || {_BACK}", _KNOWN),
        _const(f"'[list ' || {_BACK}", _KNOWN), f"SELECT no, pos AS o, {_QUOTED} || ' ' || {_BACK} AS line FROM f WHERE no % 4 < 2", _const("']'", _KNOWN),
    ]
    return _sql(*parts, *([_const(f"'{foot}'", _KNOWN)] if foot else []), *_SKIP)


@query(_flags("vlog -incr -sv", "vcom -2008", f"' ' || {_BACK}"), "file")
def script_vsim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K8: lines of every group."""
    return _body(spark, sf_dir, "vsim")


@query(_flags("vlogan -sverilog -full64", "vhdlan", "''", catch=False), "file")
def script_vcs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K9: lines of every group."""
    return _body(spark, sf_dir, "vcs")


@query(_flags("vlog -sv", "vcom -2008", f"' ' || {_BACK}"), "file")
def script_riviera(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every group."""
    return _body(spark, sf_dir, "riviera")


@query(_listed("analyze -format sv", "analyze -format vhdl", "/x", head="if {0 == [", foot="]} {return 1}"), "file")
def script_synopsys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every group."""
    return _body(spark, sf_dir, "synopsys")


@query(_listed("read_sverilog -r", "read_vhdl -r", "$ROOT/x", head="if {[catch { ", foot="}]} {return 1}"), "file")
def script_formality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every group."""
    return _body(spark, sf_dir, "formality")


@query(_listed("read_hdl -language sv", "read_hdl -language vhdl", "/x", "set_db init_hdl_search_path $search_path"), "file")
def script_genus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every group; separate commands do not stop."""
    return _body(spark, sf_dir, "genus")


@query(_sql(_const(_META), _const(f"'add_files -norecurse -fileset [current_fileset] [list ' || {_BACK}"), f"SELECT no, pos AS o, '$ROOT/' || path || ' ' || {_BACK} AS line FROM f", _const("']'")), "file")
def script_vivado(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every group, of unknown type too."""
    return _body(spark, sf_dir, "vivado")


@query(_sql(
    _const(_META), _const(f"'if {{[catch {{ add_input_file -format SystemVerilog2012 ' || {_BACK}", _V), _const(f"'if {{[catch {{ add_input_file -format vhdl_2008 ' || {_BACK}", _H), _const(f"'-search_path {{ ' || {_BACK}", _V), _const(f"'/r/inc ' || {_BACK}", _V), _const(f"'/x ' || {_BACK}", _V), _const(f"'}} ' || {_BACK}", _V),
    _const(f"'{{ ' || {_BACK}", _KNOWN), f"SELECT no, pos AS o, '/r/' || path || ' ' || {_BACK} AS line FROM f WHERE no % 4 < 2", _const(f"'}} ' || {_BACK}", _KNOWN), _const("'}]} {return 1}'", _KNOWN), _SKIP[0], _SKIP[1].replace("$ROOT/", "/r/"),
), "file")
def script_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every group; paths as they are."""
    return _body(spark, sf_dir, "precision")


@query(_sql(_const("'-Wall'", _V), _const("'+define+K=' || CAST(k AS VARCHAR)", _V), _const("'+define+V'", _V), _const("'+incdir+/r/inc'", _V), _const("'+incdir+/x'", _V), "SELECT no, pos AS o, '/r/' || path AS line FROM f WHERE no % 4 = 0"), "file")
def script_verilator(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of Verilog groups; others are left out."""
    return render.verilator(_groups(spark, sf_dir), ["-Wall"]).select("no", F.col("pos").cast("long").alias("pos"), "line")


@query(_sql(_const("'// G' || CAST(no AS VARCHAR)"), "SELECT no, pos AS o, path AS line FROM f"), "file")
def script_flist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One path a line, from the root, with notes on groups."""
    return render.flist(_groups(spark, sf_dir), root="/r", annotate=True).select("no", F.col("pos").cast("long").alias("pos"), "line")


@query(f"WITH {_G} SELECT no, 'G' || CAST(no AS VARCHAR) || ' ' || CAST(n AS VARCHAR) AS text FROM g", "file")
def script_custom(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A caller's own renderer."""
    return render.custom(_groups(spark, sf_dir), lambda g: f"{g['metadata']} {len(g['files'])}")


# Target expressions and file types


_SHOWN = ["view", "not(view)", "all(click, view)", "any(click, view)", "all(view, not(error))", "any(signup, all(click, purchase))", "not(any(error, signup))", "purchase", "all(any(error, view), not(purchase))", "not(all(click, signup))", "any(not(click), not(view))"]


@query("SELECT node, CASE node % 12 " + " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(_SHOWN)) + " ELSE '*' END AS shown, CASE node % 12 " + " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(_SHOWN)) + " ELSE '*' END || CASE WHEN node % 2 = 0 THEN '' ELSE ' & view' END AS both_ FROM tree", "tree")
def target_shown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expressions in their one form, reduced."""
    from .sources import ANY, shown_target

    nodes = view(spark, sf_dir, "tree").withColumn("chain", F.array(F.coalesce("target", F.lit(ANY))))
    return nodes.select("node", shown_target(F.col("chain")).alias("shown"), F.concat(shown_target(F.col("chain")), F.when(F.col("node") % 2 == 0, "").otherwise(F.concat(F.lit(" & "), shown_target(F.array(F.lit("view"), F.lit("view")))))).alias("both_"))


@query("SELECT id, CASE WHEN path LIKE '%.vhd' THEN 'vhdlSource' WHEN path LIKE '%.v' THEN 'verilogSource' ELSE 'systemVerilogSource' END AS kind FROM file", "file")
def fileset_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The file types of core files."""
    return view(spark, sf_dir, "file").select("id", paths.fileset_type(F.col("path"), F.lit("systemVerilogSource")).alias("kind"))


@query("SELECT node, node % 12 IN (1, 6, 9, 10, 11) AS by_default, node % 12 IN (1, 5, 9, 10, 11) AS with_signup FROM tree", "tree")
def fileset_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filesets that hold for nothing, and for a given set."""
    nodes = view(spark, sf_dir, "tree")
    none, some = F.expr("cast(array() as array<string>)"), F.array(F.lit("signup"), F.lit("test"))
    return targets.evaluated(targets.evaluated(nodes, "target", none, "by_default"), "target", some, "with_signup").select("node", "by_default", "with_signup")


@query("SELECT user_id, string_agg(DISTINCT lower(t), ',' ORDER BY lower(t)) AS names FROM active GROUP BY user_id", "active")
def selection_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names in lower case, each once."""
    rows = view(spark, sf_dir, "active").groupBy("user_id").agg(F.collect_list(F.upper("t")).alias("a"), F.collect_list("t").alias("b"))
    return rows.select("user_id", F.array_join(F.array_sort(targets.target_set(F.concat("a", "b"))), ",").alias("names"))


# Documents


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A manifest for each part, in every shape that a field may have."""
    k = F.col("p_partkey")
    n = k.cast("string")
    dep = F.when(k % 3 == 0, F.concat(F.lit('"1.'), n, F.lit('"'))).when(k % 3 == 1, F.concat(F.lit('{"git": "g'), n, F.lit('", "rev": '), n, F.lit(', "target": "sim", "pass_targets": ["Fast", {"target": "x", "pass": "Slow"}]}'))).otherwise('{"path": "../q"}')
    define = F.when(k % 2 == 0, F.lit("null")).otherwise(F.concat(F.lit('{"target": "t", "value": '), n, F.lit("}")))
    text = F.concat(
        F.lit('{"package": {"name": "P'), n, F.lit('"}, "remotes": {"r": "u/{}"}, "dependencies": {"D": '), dep, F.lit('}, "sources": {"include_dirs": ["inc", {"target": "s", "dir": "/abs"}], "defines": {"A": 1, "B": '), define,
        F.lit('}, "files": ["a.sv", {"vhd": "b.txt"}, {"target": "t", "files": ["$V/c.sv"]}]}, "plugins": {"run": "run.sh"}, "odd": 1, "vendor_package": [{"name": "v", "target_dir": "vt", "upstream": {"git": "x"}, "mapping": [{"from": "a", "to": "b"}]}]}'),
    )
    return spark.read.parquet(f"{sf_dir}/part.parquet").select(F.concat(F.lit("/w/"), n, F.lit("/m.yml")).alias("path"), text.alias("text"))


def _manifest(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    from ..sources.documents import parsed

    return parsed(_documents(spark, sf_dir), table, {"V": "sub"})


@query("""SELECT 'p' || CAST(p_partkey AS VARCHAR) AS parent, 'd' AS dep, CASE WHEN p_partkey % 3 = 0 THEN '1.' || CAST(p_partkey AS VARCHAR) END AS version_req, CASE p_partkey % 3 WHEN 0 THEN 'u/D' WHEN 1 THEN 'g' || CAST(p_partkey AS VARCHAR) END AS url,
CASE WHEN p_partkey % 3 = 1 THEN CAST(p_partkey AS VARCHAR) END AS rev, CASE WHEN p_partkey % 3 = 2 THEN '/w/' || CAST(p_partkey AS VARCHAR) || '/../q' END AS path, CASE WHEN p_partkey % 3 = 1 THEN 'sim' END AS target, CASE WHEN p_partkey % 3 = 1 THEN '*>fast,x>slow' ELSE '' END AS passes FROM part""")
def manifest_dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declarations in all their shapes."""
    rows = _manifest(spark, sf_dir, "dep_decl")
    return rows.select("parent", "dep", "version_req", "url", "rev", "path", "target", F.array_join(F.transform("pass_targets", lambda p: F.concat(F.coalesce(p["target"], F.lit("*")), F.lit(">"), p["pass"])), ",").alias("passes"))


@query("""WITH p AS (SELECT 'p' || CAST(p_partkey AS VARCHAR) AS pkg, CAST(p_partkey AS VARCHAR) AS n, p_partkey % 2 = 0 AS even FROM part)
SELECT pkg, 0 AS node, CAST(NULL AS BIGINT) AS parent, CAST(NULL AS VARCHAR) AS target, '*:/w/' || n || '/inc,s:/abs' AS dirs, 'A:*:1,B:' || CASE WHEN even THEN '*:-' ELSE 't:' || n END AS defines FROM p UNION ALL SELECT pkg, 1, 0, 't', '', '' FROM p""")
def manifest_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source groups with their directories and defines."""
    any_ = lambda t: F.coalesce(t, F.lit("*"))
    dirs = F.array_join(F.transform("include_dirs", lambda d: F.concat(any_(d["target"]), F.lit(":"), d["dir"])), ",")
    defines = F.array_join(F.transform("defines", lambda d: F.concat(d["name"], F.lit(":"), any_(d["target"]), F.lit(":"), F.coalesce(d["value"], F.lit("-")))), ",")
    return _manifest(spark, sf_dir, "source_node").select("pkg", F.col("node").cast("int").alias("node"), "parent", "target", dirs.alias("dirs"), defines.alias("defines"))


@query("""WITH p AS (SELECT 'p' || CAST(p_partkey AS VARCHAR) AS pkg, '/w/' || CAST(p_partkey AS VARCHAR) AS root FROM part)
SELECT pkg, 0 AS node, root || '/a.sv' AS path, CAST(NULL AS VARCHAR) AS declared FROM p UNION ALL SELECT pkg, 0, root || '/b.txt', 'vhd' FROM p UNION ALL SELECT pkg, 1, root || '/sub/c.sv', NULL FROM p""")
def manifest_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files with variables put in and paths from the manifest's folder."""
    return _manifest(spark, sf_dir, "source_file").select("pkg", F.col("node").cast("int").alias("node"), "path", "declared")


@query("""SELECT 'p' || CAST(p_partkey AS VARCHAR) AS pkg, '/w/' || CAST(p_partkey AS VARCHAR) || '/vt' AS target_dir, 'x' AS upstream, '**' AS include, '.git' AS exclude, 'a>b' AS mapping FROM part""")
def manifest_vendors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vendored packages with their defaults."""
    rows = _manifest(spark, sf_dir, "vendor_pkg")
    return rows.select("pkg", "target_dir", "upstream", F.array_join("include", ",").alias("include"), F.array_join("exclude", ",").alias("exclude"), F.array_join(F.transform("mapping", lambda m: F.concat(m["from"], F.lit(">"), m["to"])), ",").alias("mapping"))


@query("""SELECT 'p' || CAST(p_partkey AS VARCHAR) AS subject, 'W03' AS code, 'unknown field odd' AS message FROM part""")
def manifest_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields that no rule knows."""
    return _manifest(spark, sf_dir, "diagnostic").select("subject", "code", "message")


@query("""SELECT 's' || CAST(s_suppkey AS VARCHAR) AS name, CASE WHEN s_suppkey % 3 > 0 THEN 'r' || CAST(s_suppkey AS VARCHAR) END AS revision, CASE WHEN s_suppkey % 3 = 1 THEN '1.0.0' END AS version, CASE WHEN s_suppkey % 3 = 0 THEN 'Path' ELSE 'Git' END AS source_kind,
CASE WHEN s_suppkey % 3 = 0 THEN '/top/' || CAST(s_suppkey AS VARCHAR) || '/sub' ELSE 'u' END AS source_uri, 'a,z' AS deps FROM supplier""")
def lock_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Locks as tables; paths count from each lock's root, dependencies are in order."""
    from ..sources.documents import locks

    k = F.col("s_suppkey")
    n = k.cast("string")
    row = F.when(k % 3 == 0, F.lit('{"source": {"Path": "sub"}, "dependencies": ["z", "a"]}')).when(k % 3 == 1, F.concat(F.lit('{"revision": "r'), n, F.lit('", "version": "1.0.0", "source": {"Git": "u"}, "dependencies": ["z", "a"]}'))).otherwise(F.concat(F.lit('{"revision": "r'), n, F.lit('", "source": {"Git": "u"}, "dependencies": ["a", "z"]}')))
    texts = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.concat(F.lit("/top/"), n).alias("root"), F.concat(F.lit('{"packages": {"S'), n, F.lit('": '), row, F.lit("}}")).alias("text"))
    return locks(texts).select("name", "revision", "version", "source_kind", "source_uri", F.array_join("dependencies", ",").alias("deps"))


@query("""SELECT 'c' || CAST(s_suppkey AS VARCHAR) AS name, 'rtl' AS fileset, i AS pos, CASE i WHEN 0 THEN 'a.sv' ELSE 'b' || CAST(s_suppkey AS VARCHAR) || '.v' END AS file, '::d:1' AS depend FROM supplier CROSS JOIN (VALUES (0), (1)) t(i)""")
def core_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Core files as tables, merge keys applied."""
    from ..sources.cores import cores

    n = F.col("s_suppkey").cast("string")
    text = F.concat(F.lit("CAPI=2:\nname: c"), n, F.lit("\nbase: &b\n  depend: ['::d:1']\nfilesets:\n  rtl:\n    <<: *b\n    files:\n      - a.sv: {is_include_file: true}\n      - b"), n, F.lit(".v\n"))
    rows = cores(spark.read.parquet(f"{sf_dir}/supplier.parquet").select(n.alias("path"), text.alias("text")))
    return rows.select("name", "fileset", F.col("pos").cast("int").alias("pos"), "file", F.array_join("depend", ",").alias("depend"))


@query("""WITH f AS (SELECT DISTINCT source AS pkg FROM documents) SELECT d.source AS pkg, d.source || '/inc/h' || CAST(doc_id AS VARCHAR) || CASE WHEN doc_id % 2 = 0 THEN '.svh' ELSE '.vh' END AS path FROM documents d JOIN f ON f.pkg = d.source WHERE doc_id % 5 < 2 AND doc_id % 3 <> 0""")
def header_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers below folders, hidden ones left out."""
    from ..sources.cores import include_files

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("source").alias("pkg"), "doc_id")
    n = F.col("doc_id").cast("string")
    ending = F.when(F.col("doc_id") % 5 > 1, ".sv").when(F.col("doc_id") % 2 == 0, ".svh").otherwise(".vh")
    listing = docs.select("pkg", F.concat("pkg", F.lit("/inc/"), F.when(F.col("doc_id") % 3 == 0, ".").otherwise(""), F.lit("h"), n, ending).alias("path"))
    return include_files(listing, docs.select("pkg", F.concat("pkg", F.lit("/inc")).alias("dir")).distinct()).select("pkg", "path")


# Workspaces


@query("""SELECT 'n' || CAST(c_custkey AS VARCHAR) AS name, CASE WHEN c_custkey % 3 = 0 THEN 'not a repository' ELSE 'changed' END AS reason FROM customer WHERE c_custkey % 3 = 0 OR c_custkey % 4 = 0""")
def checkout_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folders of the checkout folder that stand for their packages."""
    k = F.col("c_custkey")
    folders = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.concat(F.lit("n"), k.cast("string")).alias("name"), F.lit("/p").alias("path"), (k % 3 != 0).alias("is_git"), F.when(k % 4 == 0, " M a").otherwise("").alias("status"))
    return workspace.present_overrides(folders).select("name", "reason")


@query("""SELECT c_custkey AS id, CASE WHEN c_custkey % 3 > 0 THEN 'h' || CAST(c_custkey AS VARCHAR) END AS line FROM customer""")
def first_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a command printed first."""
    n = F.col("c_custkey").cast("string")
    said = F.when(F.col("c_custkey") % 3 == 0, "").when(F.col("c_custkey") % 3 == 1, F.concat(F.lit("h"), n)).otherwise(F.concat(F.lit("h"), n, F.lit("\nmore\n")))
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("id"), workspace.first_line(said).alias("line"))


@query("""SELECT n_nationkey AS repo, 'lib/m' || CAST(n_nationkey AS VARCHAR) AS path FROM nation WHERE n_nationkey % 2 = 0""")
def submodules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths of submodules."""
    from ..sources.git import submodule_paths

    n = F.col("n_nationkey").cast("string")
    rows = spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", F.explode(F.split(F.concat(F.lit('[submodule "x"]\n\t'), F.when(F.col("n_nationkey") % 2 == 0, "path").otherwise("url"), F.lit(" = lib/m"), n), "\n")).alias("value"))
    return submodule_paths(rows).select(F.regexp_extract("path", "([0-9]+)$", 1).cast("int").alias("repo"), "path")


@query("""WITH RECURSIVE w(pkg, dep, path) AS (SELECT 't', 't', '/co' UNION ALL SELECT 't', 'd' || CAST(CAST(replace(replace(dep, 't', '0'), 'd', '') AS INTEGER) + 1 AS VARCHAR), path || '/s' FROM w WHERE CAST(replace(replace(dep, 't', '0'), 'd', '') AS INTEGER) < 6) SELECT dep, path, 'W09' AS code FROM w WHERE dep <> 't'""")
def nested_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Path dependencies inside a dependency, counted from its checkout."""
    chain = spark.range(6).select(F.when(F.col("id") == 0, "t").otherwise(F.concat(F.lit("d"), F.col("id").cast("string"))).alias("pkg"), F.concat(F.lit("d"), (F.col("id") + 1).cast("string")).alias("dep"), F.lit("./x/../s").alias("path"))
    return workspace.relocated(chain, spark.createDataFrame([("t", "/co")], "pkg string, root string")).select("dep", "path", "code")


@query("""SELECT c_custkey AS id, CASE c_custkey % 3 WHEN 0 THEN 'overrides:' || chr(10) || '  new: 1' || chr(10) || '#  a: 2' || chr(10) || '  b: 3' || chr(10) WHEN 1 THEN 'overrides:' || chr(10) || '  new: 1' || chr(10) || 'x: 1' || chr(10) ELSE 'overrides:' || chr(10) || '  new: 1' || chr(10) END AS text FROM customer""")
def override_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines added to an override file, and others commented out."""
    k = F.col("c_custkey")
    text = F.when(k % 3 == 0, "overrides:\n  a: 2\n  b: 3\n").when(k % 3 == 1, "x: 1\n")
    new = workspace.override_text(text, F.array(F.lit("a:")), F.array(F.lit("  new: 1")), create=True)
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select(k.alias("id"), new.alias("text"))


@query("""SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN 'error[E' || CAST(c_custkey % 9 AS VARCHAR) || ']: m' ELSE 'warning: m' END || chr(10) || CASE WHEN c_custkey % 3 = 0 THEN ' ├─› caused by: c' || chr(10) || ' ├─› help: h' || chr(10) || ' ╰─› help: i' ELSE ' ╰─› caused by: c' END AS text FROM customer""")
def diagnostic_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Diagnostics with causes and help as trees."""
    from .diagnostics import rendered

    k = F.col("c_custkey")
    text = rendered(F.when(k % 2 == 0, "error").otherwise("warning"), F.when(k % 2 == 0, F.concat(F.lit("E"), (k % 9).cast("string"))), F.lit("m"), F.array(F.lit("c")), F.when(k % 3 == 0, "h\ni\n").otherwise(""))
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select(k.alias("id"), text.alias("text"))


@query("""SELECT c_custkey AS id, 'warning' AS severity FROM customer WHERE c_custkey % 4 = 2 UNION ALL SELECT c_custkey, CASE WHEN c_custkey % 4 = 1 THEN 'warning' ELSE 'error' END FROM customer WHERE c_custkey % 2 = 1""")
def suppressed_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppressed warnings go, suppressed errors become warnings."""
    from .diagnostics import Suppressed

    k = F.col("c_custkey")
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").select(k.alias("id"), F.when(k % 2 == 0, "warning").otherwise("error").alias("severity"), F.concat(F.when(k % 2 == 0, "W0").otherwise("E0"), (k % 4).cast("string")).alias("code"))
    return Suppressed("E01").downgrade(Suppressed("w00, E77").warnings(rows)).select("id", "severity")


# Sources


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A module for each page, that uses its half and, if it is odd, a package; conditions hide a third name."""
    k = F.col("page_id")
    n, half = k.cast("string"), F.floor(k / 2).cast("long").cast("string")
    uses = F.when(k % 2 == 1, F.concat(F.lit(" import p"), (k % 5).cast("string"), F.lit("::*;"))).otherwise("")
    text = F.concat(F.lit("// m0 in a comment\nmodule m"), n, F.lit(";"), uses, F.lit("\n`ifdef HIDDEN\nzz z0();\n`endif\nm"), half, F.lit(" u (.a(1));\nendmodule : m"), n, F.lit("\n"))
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select(k.alias("idx"), F.concat(F.lit("m"), n, F.lit(".sv")).alias("path"), text.alias("text"))


@query("""SELECT page_id AS idx, 'm' || CAST(page_id AS VARCHAR) AS declared, 'm' || CAST(CAST(floor(page_id / 2) AS BIGINT) AS VARCHAR) || CASE WHEN page_id % 2 = 1 THEN ',p' || CAST(page_id % 5 AS VARCHAR) ELSE '' END AS referenced FROM pages""")
def source_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each source declares and uses."""
    rows = syntax.parse(_texts(spark, sf_dir)).where("parsed_ok AND NOT encrypted")
    return rows.select("idx", F.array_join("declared", ",").alias("declared"), F.array_join("referenced", ",").alias("referenced"))


@query("""SELECT page_id AS idx, '// m0 in a comment' || chr(10) || 'module a_m' || CAST(page_id AS VARCHAR) || '_z;' || CASE WHEN page_id % 2 = 1 THEN ' import p' || CAST(page_id % 5 AS VARCHAR) || '::*;' ELSE '' END || chr(10) || '`ifdef HIDDEN' || chr(10) || 'zz z0();' || chr(10) || '`endif' || chr(10) ||
'a_m' || CAST(CAST(floor(page_id / 2) AS BIGINT) AS VARCHAR) || '_z u (.a(1));' || chr(10) || 'endmodule : a_m' || CAST(page_id AS VARCHAR) || '_z' || chr(10) AS text FROM pages""")
def renamed_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declarations, end labels and uses renamed; unknown names, comments and the rest stay."""
    from .pickle import pickled

    return pickled(_texts(spark, sf_dir), prefix="a_", suffix="_z").select("idx", "text")


@query("""WITH RECURSIVE t(k) AS (SELECT max(page_id) FROM pages UNION SELECT CAST(floor(k / 2) AS BIGINT) FROM t)
SELECT p.page_id AS idx FROM pages p JOIN t ON t.k = p.page_id""")
def pickled_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a top needs, its text as it was."""
    from .pickle import pickled

    texts = _texts(spark, sf_dir)
    top = texts.agg(F.max("idx")).first()[0]
    kept = pickled(texts, tops=[f"m{top}"])
    return kept.join(texts.withColumnRenamed("text", "was"), "idx").where("text = was").select("idx")


@query("""SELECT page_id AS idx, 'module m' || CAST(page_id AS VARCHAR) || ';' || CASE WHEN page_id % 2 = 1 THEN ' import p' || CAST(page_id % 5 AS VARCHAR) || '::*;' ELSE '' END AS second FROM pages""")
def stripped_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources without comments and empty lines."""
    from .pickle import printed

    rows = printed(_texts(spark, sf_dir), squash=True, comments=False)
    return rows.select("idx", F.split(F.regexp_replace("text", "^\n", ""), "\n")[0].alias("second"))


@query("""SELECT page_id % 7 AS dir, '/inc' || CAST(page_id % 7 AS VARCHAR) || '/h' || CAST(page_id % 3 AS VARCHAR) || '.svh' AS path FROM pages GROUP BY ALL""")
def included_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers that sources include, by the first of their directories that has them."""
    k = F.col("page_id")
    trees = spark.read.parquet(f"{sf_dir}/pages.parquet").select(k.alias("idx"), F.array(F.concat(F.lit("h"), (k % 3).cast("string"), F.lit(".svh"))).alias("included"), F.array(F.lit("/none"), F.concat(F.lit("/inc"), (k % 7).cast("string")), F.lit("/late")).alias("dirs"))
    listing = trees.select(F.concat(F.element_at("dirs", 2), F.lit("/"), F.col("included")[0]).alias("path")).unionByName(trees.select(F.concat(F.lit("/late/"), F.col("included")[0]).alias("path")))
    return syntax.headers_of(trees, listing).select((F.col("idx") % 7).alias("dir"), "path").distinct()


# Recorded output


@query("""SELECT c_custkey AS id, i AS seq, 'l' || CAST(i AS VARCHAR) AS line FROM customer CROSS JOIN (VALUES (0), (1), (2)) t(i)""")
def output_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Complete lines of recorded output; an open last line is none yet."""
    from ..streaming.progress import lines_of

    chunks = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("id"), F.lit("l0\rl1\nl2\nrest").alias("value"))
    return lines_of(chunks).select("id", F.col("seq").cast("int").alias("seq"), "line")


@query("""SELECT id % 50 AS operation, string_agg(line, chr(10) ORDER BY id) AS log FROM line GROUP BY 1""", "line")
def output_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Everything that an operation printed."""
    from ..streaming.progress import raw_log

    return raw_log(view(spark, sf_dir, "line").select((F.col("id") % 50).alias("operation"), F.col("id").alias("seq"), "line"))


@query("""SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN '/h/' || CAST(c_custkey AS VARCHAR) ELSE '/h/s/x' END AS path FROM customer""")
def substituted_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """variables in paths."""
    k = F.col("c_custkey")
    path = F.when(k % 2 == 0, F.concat(F.lit("$HOME/"), k.cast("string"))).otherwise("${HOME}/$SUB/x")
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select(k.alias("id"), paths.substitute(path, {"HOME": "/h", "SUB": "s"}).alias("path"))

