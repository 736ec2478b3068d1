"""Whole runs over small manifests: from documents to groups, lists and scripts."""

import json

import pytest
from pyspark.sql import functions as F

from tessera.plans import render, sources
from tessera.plans.catalog_sources import manifest_tables  # noqa: F401 (its tables have the shape of SCHEMAS)
from tessera.sources import documents as D
from tessera.sources import git

TOP = """
package: {name: top}
dependencies:
  a: {path: ../a, pass_targets: [{target: sim, pass: Fast}, {target: asic, pass: slow}]}
  b: {path: ../b, target: sim}
  d: {path: ../d, target: not(sim)}
sources:
  include_dirs: [inc, {target: asic, dir: inc_asic}]
  defines: {ROOT: 1, X: {target: sim, value: s}, Y: {target: asic}}
  files:
    - one.sv
    - target: sim
      defines: {X: inner}
      include_dirs: [sub]
      files: [tb.sv, tb.vhd]
    - target: asic
      files: [pads.v]
    - two.sv
    - notes.txt
    - override_files: true
      files: [new/c.sv]
"""
OTHERS = {
    "a": "package: {name: a}\ndependencies: {c: {path: ../c}}\nsources:\n  - a.sv\n  - {target: fast, files: [a_fast.sv]}\nexport_include_dirs: [inc, {target: slow, dir: inc_slow}]\n",
    "b": "package: {name: b}\nsources: [b.sv]\n", "c": "package: {name: c}\nsources: [c.sv]\nexport_include_dirs: [{target: sim, dir: inc}]\n", "d": "package: {name: d}\nsources: [d.sv]\n",
}


@pytest.fixture(scope="module")
def tables(spark):
    docs = spark.createDataFrame([("/w/top/package.yml", TOP), *((f"/w/{k}/package.yml", v) for k, v in OTHERS.items())], "path string, text string")
    return {t: D.parsed(docs, t).cache() for t in ("packages", "dep_decl", "source_node", "source_file", "export_incdir")}


@pytest.fixture(scope="module")
def groups(tables):
    return sources.assembled(tables, "top", ["Sim"]).cache()


def files_of(groups):
    return [[f["path"].removeprefix("/w/") for f in r.files] for r in groups.orderBy("at").collect()]


def test_ranks_and_selection(tables):
    assert {r.pkg: r["rank"] for r in sources.ranked(tables["dep_decl"], tables["packages"], "top").collect()} == {"a": 0, "b": 0, "c": 1, "d": 0}
    chosen = lambda **k: sorted(r.pkg for r in sources.selected(tables["dep_decl"], "top", **k).collect())
    assert chosen() == ["a", "b", "c", "d", "top"] and chosen(packages=["A"]) == ["a", "c"] and chosen(exclude=["a"]) == ["b", "d", "top"] and chosen(packages=["top", "b"], no_deps=True) == ["b", "top"]
    with pytest.raises(LookupError):
        sources.find(tables["packages"], "zz")


def test_passed_targets(tables):
    ranks = sources.ranked(tables["dep_decl"], tables["packages"], "top")
    used = sources.selected(tables["dep_decl"], "top")
    passed, left = sources.passed_targets(tables["dep_decl"], ranks, "top", ["sim"], used)
    assert [tuple(r) for r in passed.collect()] == [("a", "fast")] and sorted(r.pkg for r in left.collect()) == ["a", "b", "c", "top"]
    passed, left = sources.passed_targets(tables["dep_decl"], ranks, "top", ["asic"], used)
    assert [tuple(r) for r in passed.collect()] == [("a", "slow")] and sorted(r.pkg for r in left.collect()) == ["a", "c", "d", "top"]


def test_flattened_groups(groups):
    assert files_of(groups) == [["c/c.sv"], ["a/a.sv"], ["a/a_fast.sv"], ["b/b.sv"], ["top/one.sv"], ["top/tb.sv", "top/tb.vhd"], ["top/two.sv", "top/notes.txt"], ["top/new/c.sv"]]
    rows = {tuple(f["path"] for f in r.files): r for r in groups.collect()}
    bench = rows["/w/top/tb.sv", "/w/top/tb.vhd"]
    assert [tuple(d) for d in bench.defines] == [("ROOT", "1"), ("X", "inner"), ("TARGET_SIM", None)]
    assert bench.dirs == ["/w/top/inc", "/w/top/sub"] and bench.exported == ["/w/a/inc"] and bench.dependencies == ["a", "b", "d"]
    fast = rows["/w/a/a_fast.sv",]
    assert [tuple(d) for d in fast.defines] == [("TARGET_FAST", None), ("TARGET_SIM", None)] and fast.exported == ["/w/a/inc", "/w/c/inc"]


def test_selection_prunes_exported_dirs(tables):
    for keep, dirs in ((False, ["/w/a/inc"]), (True, ["/w/a/inc", "/w/c/inc"])):
        rows = sources.assembled(tables, "top", ["sim"], exclude=["c"], keep_excluded_dirs=keep, ignore_passed=True).where("pkg = 'a'").collect()
        assert [r.exported for r in rows] == [dirs]


def test_raw_and_json(tables, groups):
    assert sum(map(len, files_of(sources.raw(tables, "top")))) == 12
    flat = [json.loads(r.json) for r in sources.as_json(groups).orderBy("at").collect()]
    assert flat[5] == {"package": "top", "independent": False, "include_dirs": ["/w/top/inc", "/w/top/sub", "/w/a/inc"], "defines": {"ROOT": "1", "X": "inner", "TARGET_SIM": None}, "files": ["/w/top/tb.sv", "/w/top/tb.vhd"], "dependencies": ["a", "b", "d"]}
    assert json.loads(sources.as_json(sources.raw(tables, "top"), with_targets=True).orderBy("at").collect()[2].json)["target"] == "fast"
    assert [r.subject for r in sources.override_warnings(groups).collect()] == ["top"]
    there = [d for r in groups.collect() for d in [*r.dirs, *r.exported] if not d.endswith("sub")]
    gone = sources.missing_dirs(groups, groups.sparkSession.createDataFrame([(d,) for d in there], "path string"))
    assert [(r.code, r.message[-3:]) for r in gone.collect()] == [("W24", "sub")]


def test_nested_json(tables):
    ranks = sources.ranked(tables["dep_decl"], tables["packages"], "top")
    tree = json.loads(sources.nested_json(tables, ranks, "top"))
    assert tree["package"] is None and [r["independent"] for r in tree["files"]] == [True] * 3
    names = [[p["package"] for p in r["files"]] for r in tree["files"]]
    assert names == [["c"], ["a", "b", "d"], ["top"]]
    top = tree["files"][2]["files"][0]
    assert [f if isinstance(f, str) else f["files"] for f in top["files"]] == ["/w/top/one.sv", ["/w/top/tb.sv", "/w/top/tb.vhd"], ["/w/top/pads.v"], "/w/top/two.sv", "/w/top/notes.txt", ["/w/top/new/c.sv"]]


def test_missing_exporter_is_told(tables, spark):
    more = {**tables, "dep_decl": tables["dep_decl"].unionByName(tables["dep_decl"].limit(1).withColumn("dep", F.lit("gone")))}
    _, told = sources.exported_dirs(more, None)
    assert [(r.subject, r.code) for r in told.collect()] == [("gone", "W13")]


LIST = """// Package(c) Target(*)
// OVERRIDDEN from top: c/c.sv
top/new/c.sv
// Package(a) Target(*)
a/a.sv
// Package(a) Target(fast)
a/a_fast.sv
// Package(b) Target(*)
b/b.sv
// Package(top) Target(*)
top/one.sv
// Package(top) Target(sim)
top/tb.sv
// Package(top) Target(sim)
top/tb.vhd
// Package(top) Target(*)
top/two.sv
// Package(top) Target(*)
top/notes.txt"""


def test_list_from_manifests(groups):
    rows = sources.render_groups(groups)
    lines = [r.line for r in render.flist(rows, root="/w", annotate=True).orderBy("no", "pos").collect()]
    assert "\n".join(x.replace("top: /w/", "top: ") for x in lines) == LIST


def test_command_line_defines(groups):
    rows = sources.render_groups(groups, ["X = over", "NEW"]).where("file_type = 'vhdl'").collect()
    assert [tuple(d) for d in rows[0].defines] == [("ROOT", "1"), ("X", "over"), ("TARGET_SIM", None), ("NEW", None)]


@pytest.mark.parametrize("format, first, unknown", [
    ("vsim", 'vlog -incr -sv \\', "#   $ROOT/top/notes.txt"), ("vcs", "vlogan -sverilog -full64 \\", "#   $ROOT/top/notes.txt"), ("synopsys", "analyze -format sv \\", "#   $ROOT/top/notes.txt"),
    ("vivado", "add_files -norecurse -fileset [current_fileset] [list \\", "$ROOT/top/notes.txt"), ("genus", "read_hdl -language sv \\", "#   $ROOT/top/notes.txt"),
])
def test_scripts_from_manifests(groups, format, first, unknown):
    rows = sources.render_groups(groups)
    lines = [r.line for r in render.script(rows, format, root="/w").orderBy("section", "no", "pos").collect()]
    assert first in lines and any(unknown in x for x in lines)
    seen = [i for i, x in enumerate(lines) if any(n in x for n in ("new/c.sv", "a/a.sv", "a_fast.sv", "b/b.sv", "one.sv", "tb.sv", "tb.vhd", "two.sv"))]
    order = [n for i in seen for n in ("new/c.sv", "a/a.sv", "a_fast.sv", "b/b.sv", "one.sv", "tb.sv", "tb.vhd", "two.sv") if n in lines[i]]
    assert order[:8] == ["new/c.sv", "a/a.sv", "a_fast.sv", "b/b.sv", "one.sv", "tb.sv", "tb.vhd", "two.sv"]


@pytest.mark.parametrize("deps, text", [
    ("{a: {path: x, git: y}}", "path and git"), ("{a: {git: y}}", "without a revision"), ("{a: {git: y, rev: r, version: 1}}", "both a version"), ("{a: 1.0.0}", "no default remote"), ("{a: {version: 1, remote: zz}}", "names no remote"),
    ("{a: {target: x}}", "needs a path"), ("{a: {git: y, version: nonsense}}", "no version requirement"), ("{a: {git: y, version: 1, remote: r}}", "both git and a remote"),
])
def test_dependency_rules(deps, text):
    with pytest.raises(D.ManifestError, match=text):
        D.manifest_rows("/p/m.yml", f"package: {{name: p}}\ndependencies: {deps}\n")


@pytest.mark.parametrize("entry, text", [("{sv: a, files: [b]}", "beside the fields"), ("{sv: a, v: b}", "more than one type")])
def test_source_rules(entry, text):
    with pytest.raises(D.ManifestError, match=text):
        D.manifest_rows("/p/m.yml", f"package: {{name: p}}\nsources: [{entry}]\n")


def test_remotes_and_variables():
    with pytest.raises(D.ManifestError, match="2 places"):
        D.manifest_rows("/p/m.yml", 'package: {name: p}\nremotes: {r: "u/{}/{}"}\n')
    rows = D.manifest_rows("/p/m.yml", 'package: {name: p}\nremotes: {r: "u", s: {url: "s/{}/x", default: true}}\ndependencies: {A: 1, b: {version: 2, remote: r, upstream_name: q}}\nsources: ["$HOME/a.sv", "${SUB}/b.sv"]\n', {"HOME": "/h", "SUB": "s"})
    assert [(r[1], r[4]) for r in rows["dep_decl"]] == [("a", "s/A/x"), ("b", "u/q.git")] and [r[3] for r in rows["source_file"]] == ["/h/a.sv", "/p/s/b.sv"]
    with pytest.raises(D.ManifestError, match="no value"):
        D.manifest_rows("/p/m.yml", 'package: {name: p}\nsources: ["$GONE/a.sv"]\n', {})


def test_manifests_of_revisions(spark):
    trees = spark.createDataFrame([("r", "1", "100644 blob aa\tpackage.yml"), ("r", "1", "100644 blob ab\tsub/package.yml"), ("r", "2", "100644 blob ac\tother")], "repo string, rev string, value string")
    contents = spark.createDataFrame([("aa", "package: {name: R}\ndependencies: {x: {git: u, rev: main}, y: {path: ../y}}")], "hash string, content string")
    found, lost = git.manifests_at(trees, contents, "package.yml")
    assert [(r.rev, r.code) for r in lost.select(F.substring_index("message", " ", -1).alias("rev"), "code").collect()] == [("2", "W12")]
    assert sorted((r.parent, r.parent_rev, r.dep, r.source, r.constraint) for r in git.needs_at(found).collect()) == [("r", "1", "x", "u", "main"), ("r", "1", "y", "/r/../y", None)]
    assert [r.name for r in git.parse_tree(trees, under="sub").collect()] == ["sub/package.yml"]


def test_progress_as_a_stream(spark, tmp_path):
    from tessera.streaming import progress

    lines = ["Cloning into 'top'...", "Receiving objects: 34% (1/3)", "Submodule 'libs/m' (u) registered for path 'libs/m'", "fatal: no", "Receiving objects: 50% (1/2)", "Submodule path 'libs/m': checked out 'a'", "Cloning into 'x'..."]
    rows = [(op, i, x) for op in (1, 2) for i, x in enumerate(lines[: 7 if op == 1 else 5])]
    (tmp_path / "in").mkdir()
    spark.createDataFrame(rows, "operation long, seq long, line string").coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema("operation long, seq long, line string").parquet(f"file://{tmp_path}/in")
    q = progress.track(stream).writeStream.outputMode("update").format("memory").queryName("states").option("checkpointLocation", f"file://{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {r.operation: (r.active, r.percent, r.finished, r.errors, r.last_seq) for r in spark.table("states").collect()}
    batch = progress.latest(spark.createDataFrame(rows, "operation long, seq long, line string"))
    assert got == {1: ("x", 0, 2, 1, 6), 2: ("m", 50, 1, 1, 4)} == {r.operation: (r.active, r.percent, r.finished, r.errors, r.last_seq) for r in batch.collect()}
    ends = spark.createDataFrame([(1, "top", 0.0, 75.0), (2, "m", 0.0, 0.25), (3, "none", 0.0, 5.0)], "operation long, name string, started double, ended double")
    told = {r.operation: (r.finished, r.errors, r.elapsed) for r in progress.finished(batch, ends).collect()}
    assert told == {1: (3, 1, "1.2min"), 2: (2, 1, "250ms"), 3: (0, 0, "5.0s")}
    assert progress.raw_log(spark.createDataFrame(rows, "operation long, seq long, line string")).where("operation = 2").first().log == "\n".join(lines[:5])


def test_stretches_join(spark, monkeypatch):
    from tessera.streaming import progress

    lines = ["Cloning into 'a'...", "noise", "Cloning into 'b'...", "Cloning into 'b'...", "noise", "Submodule path 'b': checked out 'x'", "Cloning into 'c'...", "Receiving objects: 7% (1/9)"]
    df = spark.createDataFrame([(1, i, x) for i, x in enumerate(lines)], "operation long, seq long, line string")
    want = progress.latest(df).first()
    for n in (1, 2, 3):
        monkeypatch.setattr(progress, "STRETCH", n)
        assert progress.latest(df).first() == want
    assert (want.active, want.finished, want.percent) == ("c", 2, 7)


FIXTURE = [
    (0, "M0", "verilog", [("A", "1"), ("B", None)], ["/r/inc", "/x"], [("/r/a.sv", None), ("/r/b.sv", "note")]), (1, "M1", "vhdl", [("A", "1")], ["/r/inc"], [("/r/c.vhd", None)]), (2, "M2", None, [], [], [("/r/d.txt", None)]),
]
#: Lines that each format gives for the fixture, worked out by hand: head, separate and common bodies (stopping, with
#: notes), foot. White space at the ends of lines aside.
SKIPPED = "# M2|# Skipping 1 file(s) of unknown type (prefix with sv:/v:/vhd: to set one):|#   $ROOT/d.txt"
FLAGS = '"+define+A=1" \\|"+define+B" \\|"+incdir+$ROOT/inc" \\|"+incdir+/x" \\|"$ROOT/a.sv" \\|# note|"$ROOT/b.sv"'
LISTED = '-define { \\|A=1 \\|B \\|} \\|[list \\|"$ROOT/a.sv" \\|# note|"$ROOT/b.sv" \\|]'
PATHS = 'set search_path $search_path_initial|lappend search_path "$ROOT/inc"'
CATCH = "}]} {return 1}"
EXPECTED = {
    "vsim": (
        'set ROOT "/r"', f"# M0|if {{[catch {{ vlog -incr -sv \\|{FLAGS} \\|{CATCH}|# M1|if {{[catch {{ vcom -2008 \\|\"$ROOT/c.vhd\" \\|{CATCH}|{SKIPPED}",
        f'if {{[catch {{ vlog -incr -sv \\|{FLAGS} \\|{CATCH}|if {{[catch {{ vcom -2008 \\|"$ROOT/c.vhd" \\|{CATCH}', "",
    ),
    "riviera": (
        'set ROOT "/r"|vlib work', f"# M0|if {{[catch {{ vlog -sv \\|{FLAGS} \\|{CATCH}|# M1|if {{[catch {{ vcom -2008 \\|\"$ROOT/c.vhd\" \\|{CATCH}|{SKIPPED}",
        f'if {{[catch {{ vlog -sv \\|{FLAGS} \\|{CATCH}|if {{[catch {{ vcom -2008 \\|"$ROOT/c.vhd" \\|{CATCH}', "",
    ),
    "vcs": (
        'ROOT="/r"|set -e', f"# M0|vlogan -sverilog -full64 \\|{FLAGS.replace('# note|', '')}|# M1|vhdlan \\|\"$ROOT/c.vhd\"|{SKIPPED}", f'vlogan -sverilog -full64 \\|{FLAGS.replace("# note|", "")}|vhdlan \\|"$ROOT/c.vhd"', "",
    ),
    "synopsys": (
        'set ROOT "/r"|set search_path_initial $search_path',
        f'# M0|{PATHS}|lappend search_path "/x"|if {{0 == [analyze -format sv \\|{LISTED}|]}} {{return 1}}|# M1|{PATHS}|if {{0 == [analyze -format vhdl \\|-define {{ \\|A=1 \\|}} \\|[list \\|"$ROOT/c.vhd" \\|]|]}} {{return 1}}|{SKIPPED}',
        f'{PATHS}|lappend search_path "/x"|if {{0 == [analyze -format sv \\|{LISTED}|]}} {{return 1}}|if {{0 == [analyze -format vhdl \\|[list \\|"$ROOT/c.vhd" \\|]|]}} {{return 1}}', "set search_path $search_path_initial",
    ),
    "formality": (
        'set ROOT "/r"|set search_path_initial $search_path',
        f'# M0|{PATHS}|lappend search_path "$ROOT/x"|if {{[catch {{ read_sverilog -r \\|{LISTED}|{CATCH}|# M1|{PATHS}|if {{[catch {{ read_vhdl -r \\|-define {{ \\|A=1 \\|}} \\|[list \\|"$ROOT/c.vhd" \\|]|{CATCH}|{SKIPPED}',
        f'{PATHS}|lappend search_path "$ROOT/x"|if {{[catch {{ read_sverilog -r \\|{LISTED}|{CATCH}|if {{[catch {{ read_vhdl -r \\|[list \\|"$ROOT/c.vhd" \\|]|{CATCH}', "set search_path $search_path_initial",
    ),
    "genus": (
        'if [ info exists search_path ] {|set search_path_initial $search_path|} else {|set search_path_initial {}|}|set ROOT "/r"',
        f'# M0|{PATHS}|lappend search_path "/x"|set_db init_hdl_search_path $search_path|read_hdl -language sv \\|{LISTED}|# M1|{PATHS}|set_db init_hdl_search_path $search_path|read_hdl -language vhdl \\|-define {{ \\|A=1 \\|}} \\|[list \\|"$ROOT/c.vhd" \\|]|{SKIPPED}',
        f'{PATHS}|lappend search_path "$ROOT/x"|set_db init_hdl_search_path $search_path|if {{[catch {{ read_hdl -language sv \\|{LISTED}|{CATCH}|if {{[catch {{ read_hdl -language vhdl \\|[list \\|"$ROOT/c.vhd" \\|]|{CATCH}', "set search_path $search_path_initial",
    ),
    "vivado": (
        'set ROOT "/r"', "# M0|add_files -norecurse -fileset [current_fileset] [list \\|$ROOT/a.sv \\|# note|$ROOT/b.sv \\|]|# M1|add_files -norecurse -fileset [current_fileset] [list \\|$ROOT/c.vhd \\|]|# M2|add_files -norecurse -fileset [current_fileset] [list \\|$ROOT/d.txt \\|]",
        "add_files -norecurse -fileset [current_fileset] [list \\|$ROOT/a.sv \\|# note|$ROOT/b.sv \\|$ROOT/c.vhd \\|$ROOT/d.txt \\|]",
        "|".join(f"set_property include_dirs [list \\|$ROOT/inc \\|/x \\|] [current_fileset{x}]" for x in ("", " -simset")) + "|" + "|".join(f"set_property verilog_define [list \\|A=1 \\|B \\|] [current_fileset{x}]" for x in ("", " -simset")),
    ),
    "precision": (
        "set ROOT /r|set_input_dir $ROOT|setup_design -search_path $ROOT|setup_design -defines { \\|+define+A=1 \\|+define+B",
        f"# M0|if {{[catch {{ add_input_file -format SystemVerilog2012 \\|-search_path {{ \\|/r/inc \\|/x \\|}} \\|{{ \\|/r/a.sv \\|# note|/r/b.sv \\|}} \\|{CATCH}|# M1|if {{[catch {{ add_input_file -format vhdl_2008 \\|{{ \\|/r/c.vhd \\|}} \\|{CATCH}|{SKIPPED.replace('$ROOT', '/r')}",
        f"if {{[catch {{ add_input_file -format SystemVerilog2012 \\|-search_path {{ \\|/r/inc \\|/x \\|}} \\|{{ \\|/r/a.sv \\|# note|/r/b.sv \\|}} \\|{CATCH}|if {{[catch {{ add_input_file -format vhdl_2008 \\|{{ \\|/r/c.vhd \\|}} \\|{CATCH}", "",
    ),
}


@pytest.fixture(scope="module")
def fixture_groups(spark):
    return spark.createDataFrame(FIXTURE, "no long, metadata string, file_type string, defines array<struct<name:string,value:string>>, incdirs array<string>, files array<struct<file:string,comment:string>>").coalesce(1).cache()


@pytest.mark.parametrize("format", sorted(EXPECTED))
def test_script_text(fixture_groups, format):
    head, separate, common, foot = EXPECTED[format]
    for mode, body in ((False, separate), (True, common)):
        lines = [r.line.strip() for r in render.script(fixture_groups, format, root="/r", common=mode, stop=True, annotate=True).orderBy("section", "no", "pos").collect()]
        assert lines == [x for part in (head, body, foot) if part for x in part.split("|")]


def test_script_without_stops(fixture_groups):
    text = lambda **k: [r.line for r in render.script(fixture_groups, "vsim", root="/r", **k).orderBy("section", "no", "pos").collect()]
    assert text() == ['set ROOT "/r"', *("vlog -incr -sv \\|" + FLAGS.replace("# note|", "")).split("|"), "vcom -2008 \\", '"$ROOT/c.vhd"', *SKIPPED.split("|")[1:]]
    assert text(args={"verilog": ["-x"]})[1:3] == ["vlog -incr -sv \\", "-x \\"]
    lines = [r.line for r in render.script(fixture_groups, "vcs", root="/r", binaries={"verilog": "/opt/vlogan", "vhdl": "vh"}).orderBy("section", "no", "pos").collect()]
    assert "/opt/vlogan -sverilog -full64 \\" in lines and "vh \\" in lines and "set -e" not in lines


def test_other_formats(fixture_groups):
    lines = [r.line for r in render.verilator(fixture_groups, ["-Wall"]).orderBy("no", "pos").collect()]
    assert lines == ["-Wall", "+define+A=1", "+define+B", "+incdir+/r/inc", "+incdir+/x", "/r/a.sv", "/r/b.sv"]
    told = json.loads(render.context(fixture_groups, root="/r", define=["A=2", "C"]).first().json)
    assert told["all_incdirs"] == ["/r/inc", "/x"] and [d["name"] for d in told["global_defines"]] == ["A", "C"] and [f["file"] for f in told["all_files"]] == ["/r/a.sv", "/r/b.sv", "/r/c.vhd", "/r/d.txt"]
    assert [f["file"] for f in told["all_vhdl"]] == ["/r/c.vhd"] and len(told["srcs"]) == 3 and told["all_verilog"][1]["comment"] == "note"


CONDITIONS = """`define OWN
module a; `ifdef SIM b b1(); `else c c1(); `endif endmodule
`ifndef OWN
module gone; endmodule
`elsif SIM
module sim_only; endmodule
`else
module neither; endmodule
`endif
// `ifdef in a comment
"""


def test_conditions(spark):
    from tessera.operators import syntax

    plain, sim = syntax.scan(CONDITIONS), syntax.scan(CONDITIONS, frozenset(["SIM"]))
    assert (plain["declared"], plain["referenced"], plain["ok"]) == (["a", "neither"], ["c"], True) and (sim["declared"], sim["referenced"]) == (["a", "sim_only"], ["b"])
    assert not syntax.scan("`ifdef A\nmodule m; endmodule")["ok"] and not syntax.scan("`endif")["ok"]
    assert syntax.renamed(CONDITIONS, {"a": "z", "b": "y", "c": "x"}) == CONDITIONS.replace("module a", "module z").replace("c c1", "x c1") and syntax.renamed(CONDITIONS, {}) == CONDITIONS


def test_groups_are_parsed_under_their_defines(groups, spark):
    from tessera.operators import syntax

    texts = spark.createDataFrame([(f["path"], '`include "x.svh"\nmodule m; `ifdef TARGET_FAST f f1(); `endif endmodule') for r in groups.collect() for f in r.files if f["file_type"] == "verilog"], "path string, text string")
    trees = syntax.parse_groups(groups, texts)
    found = {r.path: r for r in trees.collect()}
    assert [p for p, r in found.items() if r.referenced == ["f"]] and {p for p, r in found.items() if r.referenced} == {"/w/a/a.sv", "/w/a/a_fast.sv"}
    assert found["/w/top/tb.sv"].dirs == ["/w/top/inc", "/w/top/sub", "/w/a/inc"] and [r.path for r in trees.orderBy("idx").limit(2).collect()] == ["/w/c/c.sv", "/w/a/a.sv"]
    listing = spark.createDataFrame([("/w/top/sub/x.svh",), ("/w/a/inc/x.svh",)], "path string")
    heads = {r.idx: r.path for r in syntax.headers_of(trees, listing).collect()}
    by_path = {p: heads.get(r.idx) for p, r in found.items()}
    assert by_path["/w/top/tb.sv"] == "/w/top/sub/x.svh" and by_path["/w/top/one.sv"] == "/w/a/inc/x.svh" and by_path["/w/b/b.sv"] is None
    with pytest.raises(Exception, match="no text of"):
        syntax.parse_groups(groups, texts.where("path NOT LIKE '%b.sv'")).collect()


def test_patches(spark):
    from tessera.plans import workspace

    files = spark.createDataFrame([("d", "b.v", "x\ny\n", "x\nz\n"), ("d", "a.v", None, "new\n"), ("d", "same", "q", "q"), ("e", "c.v", "1", "2")], "dir string, path string, old string, new string")
    names = spark.createDataFrame([("d", "0003-x.patch")], "dir string, name string")
    got = {r.dir: (r.number, r.text) for r in workspace.patches(files, names).collect()}
    assert got["d"] == (4, "--- /dev/null\n+++ b/a.v\n@@ -0,0 +1 @@\n+new\n--- a/b.v\n+++ b/b.v\n@@ -1,2 +1,2 @@\n x\n-y\n+z\n")
    assert got["e"] == (1, "--- a/c.v\n+++ b/c.v\n@@ -1 +1 @@\n-1\n\\ No newline at end of file\n+2\n\\ No newline at end of file\n")


def test_runs_in_stretches(spark):
    import random

    from tessera.operators import tree

    rng = random.Random(4)
    df = spark.createDataFrame([(rng.choice("pq") if i % 9 else None, i, rng.choice(["a", "a", "b", None])) for i in range(300)], "k string, i long, c string")
    want = sorted((str(r.k), r.i, r.run) for r in tree.runs(df, F.col("c"), ["i"], ["k"]).collect())
    for n in (1, 7, 50, 1000):
        assert sorted((str(r.k), r.i, r.run) for r in tree.runs(df, F.col("c"), ["i"], ["k"], F.floor(F.col("i") / n)).collect()) == want


def test_clean(spark):
    from tessera import frames

    df = frames.cut(spark.range(3).toDF("x"))
    assert df.count() == 3
    path = frames.shared_path(spark, "x").rsplit("/", 1)[0]
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    assert where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def test_core_files_from_manifests(groups, spark):
    from tessera.sources import cores, documents

    shown = groups.withColumn("target", sources.shown_target(F.col("chain")))
    vlnvs = spark.createDataFrame([(x, f"::{x}:0") for x in ("top", "a", "b", "c", "d")], "dep string, vlnv string")
    heads = shown.where("pkg = 'a'").select("pkg", "at", F.lit("inc/h.svh").alias("path"), F.lit("inc").alias("include_path")).limit(1)
    texts = {r.pkg: r.text for r in cores.core_documents(shown, heads, vlnvs, note="made", license_lines=("free",)).collect()}
    doc = documents.load(texts["top"].split("\n", 1)[1])
    assert texts["top"].startswith("CAPI=2:\n# made\n\n# free\n") and doc["name"] == "::top:0"
    assert [x if isinstance(x, str) else next(iter(x)) for x in doc["filesets"]["files_rtl"]["files"]] == ["/w/top/one.sv", "/w/top/two.sv", "/w/top/notes.txt", "/w/top/new/c.sv"]
    assert doc["filesets"]["sim"]["depend"] == ["::a:0", "::b:0", "::d:0"] and doc["targets"]["default"]["filesets"] == ["files_rtl"]
    own = documents.load(texts["a"].split("\n", 1)[1])["filesets"]
    assert set(own) == {"files_rtl", "fast"} and {"inc/h.svh": {"is_include_file": True, "include_path": "inc"}} in own["files_rtl"]["files"]


@pytest.fixture(scope="module")
def project(spark):
    from tessera.functions import semver
    from tessera.plans import resolve

    tags = spark.createDataFrame([("u/a", "1.0.0", "a0"), ("u/a", "1.1.0", "a1"), ("u/b", "1.0.0", "b0"), ("u/b", "1.1.0", "b1"), ("u/c", "1.0.0", "c0")], "source string, text string, rev string")
    tags = tags.select("source", semver.version(F.col("text")).alias("version"), "text", "rev").cache()
    said = spark.createDataFrame([("top", None, "a", 0, "u/a", "1"), ("top", None, "p", 1, "/p", None), ("a", "a1", "c", 0, "u/c", "1"), ("a", None, "b", 1, "u/b", "1")], resolve.DECLARED).cache()
    lock = spark.createDataFrame([("a", "a0", "1.0.0", "Git", "u/a", ["b"]), ("b", "b0", "1.0.0", "Git", "u/b", []), ("p", None, None, "Path", "/p", [])], D.LOCK).cache()
    return lock, said, tags


@pytest.mark.parametrize("options, versions, changed", [
    ({}, {"a": "1.1.0", "b": "1.1.0", "c": "1.0.0", "p": None}, {("a", "1.0.0", "1.1.0"), ("b", "1.0.0", "1.1.0"), ("c", "", "1.0.0")}), ({"new_only": True}, {"a": "1.0.0", "b": "1.0.0", "p": None}, set()),
    ({"requested": ["b"]}, {"a": "1.0.0", "b": "1.1.0", "p": None}, {("b", "1.0.0", "1.1.0")}), ({"requested": ["a"]}, {"a": "1.1.0", "b": "1.0.0", "c": "1.0.0", "p": None}, {("a", "1.0.0", "1.1.0"), ("c", "", "1.0.0")}),
    ({"requested": ["a"], "recursive": True}, {"a": "1.1.0", "b": "1.1.0", "c": "1.0.0", "p": None}, {("a", "1.0.0", "1.1.0"), ("b", "1.0.0", "1.1.0"), ("c", "", "1.0.0")}),
])
def test_update_run(project, options, versions, changed):
    from tessera.plans import resolve

    new, diff, told = resolve.update(*project, "top", **options)
    assert {r.name: r.version for r in new.collect()} == versions and {tuple(r) for r in diff.collect()} == changed and told.count() == 0


def test_update_errors(project, spark):
    from tessera.plans import resolve

    lock, said, tags = project
    for options in ({"frozen": True}, {"requested": ["zz"]}):
        with pytest.raises(ValueError):
            resolve.update(lock, said, tags, "top", **options)
    with pytest.raises(LookupError, match="a is unsatisfiable: \\^9 at u/a"):
        resolve.update(lock, said.where("dep <> 'a'").unionByName(spark.createDataFrame([("top", None, "a", 0, "u/a", "^9")], resolve.DECLARED)), tags, "top")
    gone = lock.withColumn("revision", F.when(F.col("name") == "b", "zz").otherwise(F.col("revision"))).withColumn("version", F.when(F.col("name") != "b", F.col("version")))
    new, _, told = resolve.update(gone, said, tags, "top", new_only=True)
    assert [(r.subject, r.code) for r in told.collect()] == [("b", "W23")] and {r.name: r.version for r in new.collect()} == {"a": "1.0.0", "b": "1.1.0", "p": None}


def test_list_sections(spark):
    files = spark.createDataFrame([(1, "a.sv"), (2, "b.sv")], "id long, path string").withColumn("pkg", F.lit("p"))
    dirs, defines = spark.createDataFrame([("p", "inc")], "pkg string, dir string"), spark.createDataFrame([("p", "A", "1"), ("p", "B", ""), ("p", "C", None)], "pkg string, name string, value string")
    lines = lambda only: [r.line for r in render.flist_plus(files, dirs, defines, ["pkg"], "id", only).orderBy("section", "key").collect()]
    assert lines(None) == ["+incdir+inc", "+define+A=1", "+define+B", "+define+C", "a.sv", "b.sv"]
    assert lines("defines") == ["+define+A=1", "+define+B", "+define+C"] and lines("incdirs") == ["+incdir+inc"] and lines("files") == ["a.sv", "b.sv"]


def test_lock_edges_and_names(spark):
    lock = spark.createDataFrame([("a", ["b"]), ("b", [])], "name string, dependencies array<string>")
    assert [tuple(r) for r in sources.locked_edges(lock).collect()] == [("a", "b")] and sources.names(["B", "a", "b"]) == ["b", "a"]
    with pytest.raises(LookupError, match="the lock has no b"):
        sources.locked_edges(lock.where("name = 'a'"))


def test_two_ways_to_one_folder_are_no_conflict(spark):
    from tessera.functions import semver
    from tessera.plans import audit

    locked = spark.createDataFrame([("common", None, None)], "pkg string, rev string, text string").withColumn("version", semver.version(F.col("text")))
    offered = locked.select("pkg", "version").limit(0)
    said = spark.createDataFrame([("common", "top", 0, None, "/w/ip/common"), ("common", "foo", 1, None, "/w/ip/foo/../common"), ("common", "bar", 2, None, "/w/ip/bar/./../common/")], "pkg string, parent string, parent_pos long, constraint string, source string")
    assert [r.state for r in audit.states(locked, offered, said).collect()] == ["path"]
    assert {r.state for r in audit.states(locked, offered, said.unionByName(said.limit(1).withColumn("source", F.lit("/w/other")))).collect()} == {"path", "conflict"}
    ranks = spark.createDataFrame([("a", 0), ("b", 1), ("c", 1)], "pkg string, rank long")
    rows = audit.listed(ranks, spark.createDataFrame([("a", "1.0.0"), ("b", None), ("c", "2.0.0")], "name string, version string"), "top").orderBy("place").collect()
    assert [(r.name, r["rank"], r.version) for r in rows] == [("b", 1, None), ("c", 1, "2.0.0"), ("a", 0, "1.0.0"), ("top", -1, None)]
