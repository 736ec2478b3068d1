import pytest
from pyspark.sql import functions as F

from tessera.functions import paths
from tessera.operators import graph, syntax, tree
from tessera.plans import audit, manifest, render, resolve
from tessera.plans.diagnostics import Suppressed, missing_files
from tessera.functions import semver


def edges(spark, *pairs):
    return spark.createDataFrame(list(pairs), "src long, dst long")


def nodes(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "node long")


def found(df):
    return sorted(r.node for r in df.collect())


def test_ranks(spark):
    e = edges(spark, (1, 2), (2, 3), (1, 3), (3, 4), (8, 9))
    assert {r.node: r["rank"] for r in graph.ranks(e, nodes(spark, 1), nodes(spark, 7)).collect()} == {1: 0, 2: 1, 3: 2, 4: 3, 7: 0, 8: 0, 9: 0}


@pytest.mark.parametrize("pairs", [[(1, 1)], [(1, 2), (2, 1)], [(1, 2), (2, 3), (3, 2)]])
def test_cycles(spark, pairs):
    with pytest.raises(graph.CycleError):
        graph.ranks(edges(spark, *pairs), nodes(spark, 1))
    assert found(graph.on_cycles(edges(spark, *pairs, (9, 1)))) == sorted({x for a, b in pairs for x in (a, b)} & ({1} if pairs == [(1, 1)] else {1, 2} if len(pairs) == 2 else {2, 3}))


def test_closure(spark):
    e = edges(spark, (1, 2), (2, 3), (1, 4), (4, 5), (5, 1))
    assert found(graph.closure(e, nodes(spark, 1))) == [1, 2, 3, 4, 5]
    assert found(graph.closure(e, nodes(spark, 1), nodes(spark, 2))) == [1, 4, 5]
    assert found(graph.closure(e.limit(0), nodes(spark, 7))) == [7]


@pytest.mark.parametrize("small", [True, False])
def test_walks_in_one_task_and_by_joins(spark, monkeypatch, small):
    import random

    if not small:
        monkeypatch.setattr(graph, "SMALL_EDGES", -1)
    rng = random.Random(7)
    pairs = {(a, b) for a, b in ((rng.randrange(12), rng.randrange(12)) for _ in range(18)) if a < b}
    e = edges(spark, *pairs)
    longest = {0: 0}
    for n in range(12):
        for a, b in sorted(pairs):
            if a == n and a in longest:
                longest[b] = max(longest.get(b, 0), longest[a] + 1)
    every = {x for p in pairs for x in p} | {0}
    assert {r.node: r["rank"] for r in graph.ranks(e, nodes(spark, 0)).collect()} == {n: longest.get(n, 0) for n in every}
    assert found(graph.closure(e, nodes(spark, 0))) == sorted(longest)
    assert found(graph.on_cycles(edges(spark, *pairs, (11, 11), (20, 21), (21, 20), (21, 22), (22, 23), (23, 22)))) == [11, 20, 21, 22, 23]
    with pytest.raises(graph.CycleError):
        graph.ranks(edges(spark, (0, 1), (1, 2), (2, 1)), nodes(spark, 0))


def test_deep_graph(spark):
    e = spark.range(1000).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    assert graph.ranks(e, nodes(spark, 0)).agg(F.max("rank")).first()[0] == 1000 and graph.on_cycles(e).count() == 0


def test_runs(spark):
    df = spark.createDataFrame([(0, i, t) for i, t in enumerate(["a", "a", None, None, "b", "a"])], "g long, i long, t string")
    assert [r.run for r in tree.runs(df, F.col("t"), ["i"], ["g"]).orderBy("i").collect()] == [1, 1, 2, 2, 3, 4]


def test_flatten(spark):
    rows = [(1, 0, False, False), (1, 1, True, False), (1, 2, False, False), (1, 3, False, False), (2, 0, True, True), (2, 1, False, True), (2, 2, True, True), (2, 3, False, True)]
    got = tree.flatten(spark.createDataFrame(rows, "node long, pos long, is_group boolean, independent boolean"))
    assert sorted((r.node, r.run, r.pos) for r in got.collect()) == [(1, 0, 0), (1, 1, 2), (1, 1, 3), (2, 0, 1), (2, 0, 3)]


def test_preorder(spark):
    df = spark.createDataFrame([(1, None, 0), (2, 1, 0), (3, 1, 1), (4, 2, 0)], "node long, parent long, pos long")
    assert [r.node for r in tree.preorder(df).orderBy("path").collect()] == [1, 2, 4, 3]


def test_paths(spark):
    cases = [("a/b.tar.sv", "sv"), ("Makefile", ""), ("a/.sv", ""), ("x.VHD", "VHD")]
    df = spark.createDataFrame(cases, "p string, e string")
    assert all(r.e == r.got for r in df.select("e", paths.extension(F.col("p")).alias("got")).collect())
    value = lambda c: spark.range(1).select(c.alias("v")).first().v
    assert value(paths.under(F.lit("a/bc"), F.lit("a/b"))) is False and value(paths.under(F.lit("a/b/c"), F.lit("a/b/"))) is True
    assert value(paths.normal(F.lit("/a/../../b/./c/"))) == "/b/c" and value(paths.normal(F.lit("../a"))) == "../a" and value(paths.normal(F.lit("a/.."))) == ""
    assert value(paths.substitute(F.lit("$A/${BC}/$BC"), {"A": "x", "BC": "y"})) == "x/y/y"
    assert [value(paths.duration(F.lit(x))) for x in (0.25, 2.34, 90.0)] == ["250ms", "2.3s", "1.5min"]
    assert [value(paths.remote_url(F.lit(t), F.lit("n"))) for t in ("h//", "h/{}/x")] == ["h/n.git", "h/n/x"]
    with pytest.raises(Exception, match="unset"):
        value(paths.substitute(F.lit("$NO"), {"A": "x"}))


SV = {
    "pkg.sv": "package common_pkg; localparam int W = 4; endpackage : common_pkg",
    "leaf.sv": "module leaf(input logic a); endmodule",
    "core.sv": "module core import common_pkg::*; (input logic [common_pkg::W-1:0] x);\n  leaf u_leaf (.a(x[0])); // not other u (x);\nendmodule",
    "top.sv": '`include "macros.svh"\nmodule top; core #(.N(2)) i_core (.x(1)); virtual bus_intf v; missing_mod m (); endmodule : top',
    "broken.sv": "module broken (; endmodule",
    "sealed.sv": "`pragma protect begin_protected\nxx(yy\n`pragma protect end_protected",
}


def test_syntax(spark):
    scans = {k: syntax.scan(v) for k, v in SV.items()}
    assert scans["core.sv"]["declared"] == ["core"] and scans["core.sv"]["referenced"] == ["common_pkg", "leaf"]
    assert scans["top.sv"]["included"] == ["macros.svh"] and {"core", "bus_intf", "missing_mod"} <= set(scans["top.sv"]["referenced"])
    assert [k for k, v in scans.items() if not v["ok"]] == ["broken.sv", "sealed.sv"] and scans["sealed.sv"]["encrypted"]
    text = syntax.renamed(SV["core.sv"], {"core": "p_core", "leaf": "p_leaf", "common_pkg": "p_common_pkg"})
    assert "module p_core import p_common_pkg::*" in text and "p_leaf u_leaf" in text and "[p_common_pkg::W" in text and "other" in text
    assert syntax.renamed(SV["pkg.sv"], {"common_pkg": "q"}).endswith("endpackage : q")
    assert syntax.without_comments('a // b\n"//c" /* d */ e') == 'a \n"//c"  e'
    files = spark.createDataFrame([(i, k, v) for i, (k, v) in enumerate(SV.items())], "idx long, path string, text string")
    parsed = syntax.parse(files).cache()
    declared, referenced = parsed.select("idx", F.explode("declared").alias("name")), parsed.select("idx", F.explode("referenced").alias("name"))
    assert found(syntax.reachable(declared, referenced, ["top"])) == [0, 1, 2, 3]
    with pytest.raises(ValueError, match="no such top"):
        syntax.reachable(declared, referenced, ["nope"])
    names = syntax.rename_map(declared.select("name"), "p_", "", ["top"])
    assert "module p_leaf" in {r.idx: r.text for r in syntax.rename_files(files, names).collect()}[1]


def test_last_declaration_wins(spark):
    d = spark.createDataFrame([(1, "m"), (2, "m"), (3, "t")], "idx long, name string")
    r = spark.createDataFrame([(3, "m"), (3, "zz")], "idx long, name string")
    assert [(x.src, x.dst) for x in syntax.symbol_edges(d, r).collect()] == [(3, 2)]
    assert [x.name for x in syntax.redeclared(d).collect()] == ["m"]


def candidates(spark, rows):
    df = spark.createDataFrame(rows, "dep string, text string, rev string")
    return df.select("dep", F.lit("git").alias("source"), semver.version(F.col("text")).alias("version"), "text", "rev")


def test_resolve(spark):
    c = candidates(spark, [("a", "1.0.0", "a0"), ("a", "1.2.0", "a1"), ("a", "2.0.0", "a2"), ("b", "1.0.0", "b0"), ("b", "1.1.0", "b1")])
    say = lambda rows: spark.createDataFrame(rows, "parent string, dep string, pos long, source string, constraint string")
    picked, bad = resolve.resolve(say([("root", "a", 0, "git", "^1.0.0"), ("a", "b", 0, "git", "<1.1.0"), ("z", "b", 0, "git", "1.1.0")]), c, "root")
    assert {r.dep: r.text for r in picked.collect()} == {"a": "1.2.0", "b": "1.0.0"} and bad.count() == 0
    picked, bad = resolve.resolve(say([("root", "a", 0, "git", "^1.0.0"), ("root", "b", 1, "git", "1"), ("b", "a", 0, "git", "2")]), c, "root")
    assert [r.dep for r in bad.collect()] == ["a"]
    refs = spark.createDataFrame([("a", "main", "a0")], "dep string, name string, rev string")
    assert {r.dep: r.rev for r in resolve.resolve(say([("root", "a", 0, "git", "main"), ("root", "b", 1, "git", "b1")]), c, "root", refs)[0].collect()} == {"a": "a0", "b": "b1"}
    assert [r.dep for r in resolve.resolve(say([("root", "a", 0, "git", "nobranch")]), c, "root", refs)[1].collect()] == ["a"]
    kept = spark.createDataFrame([("a", "git", "a0")], "dep string, source string, rev string")
    assert resolve.resolve(say([("root", "a", 0, "git", "1")]), c, "root", locked=kept)[0].first().rev == "a0"
    decided = resolve.resolve(say([("root", "a", 0, "git", "^1.0.0"), ("root", "b", 1, "git", "1"), ("b", "a", 0, "git", "2")]), c, "root", decisions=kept)
    assert {r.dep: r.rev for r in decided[0].collect()} == {"a": "a0", "b": "b1"} and decided[1].count() == 0
    for rows in ([("root", "root", 0, "git", "1")], [("root", "a", 0, "git", "1"), ("a", "a", 0, "git", "1")]):
        with pytest.raises(ValueError, match="called like"):
            resolve.resolve(say(rows), c, "root")


def test_manifest_of_the_picked_version(spark, monkeypatch):
    c = candidates(spark, [("a", "1.0.0", "a1"), ("a", "2.0.0", "a2"), ("b", "1.0.0", "b1"), ("b", "2.0.0", "b2"), ("c", "1.0.0", "c1"), ("z", "1.0.0", "z1")])
    say = spark.createDataFrame([("root", None, "a", 0, "git", "*"), ("root", None, "z", 1, "git", "1"), ("z", "z1", "a", 0, "git", "1"), ("a", "a2", "c", 0, "git", "1"), ("a", "a1", "b", 0, "git", "1")], resolve.DECLARED)
    for few in (resolve.SMALL_ROWS, -1):
        monkeypatch.setattr(resolve, "SMALL_ROWS", few)
        picked, bad = resolve.resolve(say, c, "root")
        # a starts at 2, whose need of c stays in the table; z's need takes it to 1, which needs b
        assert {r.dep: r.rev for r in picked.collect()} == {"a": "a1", "z": "z1", "c": "c1", "b": "b1"} and bad.count() == 0
    lock = {r.name: r for r in resolve.lock_rows(picked, say).collect()}
    assert (lock["a"].version, lock["a"].dependencies, lock["z"].dependencies, lock["c"].source_kind) == ("1.0.0", ["b"], ["a"], "Git")


@pytest.mark.parametrize("seed", range(2))
def test_both_ways_of_settling(spark, monkeypatch, seed):
    import random

    rng = random.Random(seed)
    rows = [(f"p{i}", f"{v}.{m}.0", f"r{i}{v}{m}") for i in range(5) for v in (1, 2) for m in range(2)]
    c = candidates(spark, rows)
    asks = ["*", "1", "2", ">=1.1.0", "<2.0.0", "=1.0.0", "~2.1"]
    say = [("root", None, f"p{i}", i, "git", rng.choice(asks[:2])) for i in range(2)]
    say += [(p, r, f"p{j}", k, "git", rng.choice(asks)) for p, _, r in rows for k, j in enumerate(rng.sample(range(5), 2)) if f"p{j}" != p and rng.random() < 0.6]
    df = spark.createDataFrame(say, resolve.DECLARED)
    got = []
    for few in (resolve.SMALL_ROWS, -1):
        monkeypatch.setattr(resolve, "SMALL_ROWS", few)
        picked, bad = resolve.resolve(df, c, "root")
        got.append((sorted((r.dep, r.rev) for r in picked.collect()), sorted(map(tuple, bad.collect()))))
    assert got[0] == got[1] and got[0][0]


def test_sources_and_paths(spark):
    c = candidates(spark, [("a", "1.0.0", "a1"), ("b", "1.0.0", "b1")]).select(F.concat(F.lit("u/"), "dep").alias("source"), "version", "text", "rev")
    say = spark.createDataFrame([("root", None, "a", 0, "u/a", "1"), ("root", None, "p", 1, "/here", None), ("p", None, "a", 0, "u/a", None if False else "^1"), ("root", None, "b", 2, "u/b", "1")], resolve.DECLARED)
    over = spark.createDataFrame([("b", "/mine", None)], "dep string, source string, constraint string")
    said = resolve.overlaid(say, overrides=over).drop("origin")
    picked, bad = resolve.resolve(said, resolve.available(said, c), "root")
    assert {r.dep: (r.source, r.rev) for r in picked.collect()} == {"a": ("u/a", "a1"), "p": ("/here", ""), "b": ("/mine", "")} and bad.count() == 0
    assert {r.name: r.source_kind for r in resolve.lock_rows(picked, said).collect()} == {"a": "Git", "p": "Path", "b": "Path"}
    lock = spark.createDataFrame([("a", "a1", "1.0.0", "Git", "u/a"), ("g", "gone", None, "Git", "u/g"), ("p", None, None, "Path", "/here"), ("n", None, None, "Git", "u/n")], "name string, revision string, version string, source_kind string, source_uri string")
    asked = resolve.lock_constraints(lock)
    assert {(r.dep, r.constraint) for r in asked.collect()} == {("a", "=1.0.0"), ("g", "gone"), ("p", None)}
    kept, lost = resolve.kept_locks(asked, resolve.available(said, c))
    assert {r.dep for r in kept.collect()} == {"a", "p"} and [(r.subject, r.code) for r in lost.collect()] == [("g", "W23")]


def test_revisions_in_order(spark):
    c = candidates(spark, [("a", "1.0.0", "abc1")]).unionByName(candidates(spark, [("a", None, "abd2"), ("a", None, "abe3")]))
    order = resolve.indexed(spark.createDataFrame([("git", "abe3\nabd2\nabc1\n")], "source string, value string"))
    say = spark.createDataFrame([("root", None, "a", 0, "git", "ab")], resolve.DECLARED)
    assert resolve.resolve(say, c, "root", order=order)[0].first().rev == "abe3"


def test_conflict_listing(spark):
    rows = [("d", 1, "^1"), ("d", 1, "main"), ("d", 1, ">=1.5, <2"), ("d", 1, "*"), ("d", 1, None), ("d", 0, "2"), ("d", 1, "^1")]
    got = resolve.conflict_order(spark.createDataFrame(rows, "dep string, source int, constraint string")).orderBy("place").collect()
    assert [r.constraint for r in got] == ["2", "main", "*", ">=1.5, <2", "^1", None]


def test_audit(spark):
    v = lambda df, c="text": df.withColumn("version", semver.version(F.col(c)))
    locked = v(spark.createDataFrame([("a", "r", "1.0.0"), ("b", "r", None), ("c", None, None), ("d", "r", "2.0.0")], "pkg string, rev string, text string"))
    offered = v(spark.createDataFrame([("a", "1.0.0"), ("a", "1.3.0"), ("a", "2.0.0"), ("b", "1.0.0"), ("d", "2.0.0")], "pkg string, text string"))
    said = spark.createDataFrame([("a", "p", 0, "^1.0.0", "g"), ("a", "q", 1, "1", "g"), ("b", "p", 0, "main", "g"), ("b", "q", 1, "dev", "g"), ("c", "p", 0, "path", "p1"), ("c", "q", 1, "path", "p1"), ("d", "p", 0, "2", "g")], "pkg string, parent string, parent_pos long, constraint string, source string")
    got = {(r.pkg, r.state) for r in audit.states(locked, offered, said).collect()}
    assert got == {("a", "auto-update"), ("a", "update"), ("b", "conflict"), ("b", "hash"), ("c", "path"), ("d", "up-to-date")}
    lock = lambda rows: spark.createDataFrame(rows, "name string, revision string, version string")
    diff = audit.lock_diff(lock([("a", "1", "1.0.0"), ("b", "2", None), ("p", None, None)]), lock([("a", "9", "1.1.0"), ("p", None, None), ("n", "3", None)]))
    assert sorted(map(tuple, diff.collect())) == [("a", "1.0.0", "1.1.0"), ("b", "2", ""), ("n", "", "3")]


def test_render(spark):
    files = spark.createDataFrame([(1, 0, "p", "sim", "/r/a.sv", None), (1, 1, "p", "sim", "/r/b.txt", None), (1, 2, "p", "sim", "/r/c.v", "note")], "grp long, pos long, pkg string, target string, path string, comment string")
    defines = spark.createDataFrame([(1, 0, "A", "1"), (1, 1, "B", None), (1, 2, "A", "2")], "grp long, pos long, name string, value string")
    dirs = spark.createDataFrame([(1, "/r/inc"), (1, "/r/inc")], "grp long, dir string")
    g = manifest.render_groups(files, defines, dirs).cache()
    assert g.count() == 3
    text = lambda df: [r.line for r in df.orderBy(*[c for c in ("section", "no", "pos") if c in df.columns]).collect()]
    assert text(render.flist(g, root="/r")) == ["a.sv", "b.txt", "c.v"]
    for f in render.FORMAT_TARGETS:
        if f in ("flist", "flist-plus", "template", "template_json"):
            continue
        for common in (False, True):
            lines = text(render.verilator(g)) if f == "verilator" else text(render.script(g, f, root="/r", common=common))
            assert any("a.sv" in x for x in lines) and any("A=2" in x for x in lines), f
            unknown = [x for x in lines if "b.txt" in x]
            assert (not unknown) if f == "verilator" or common and not f.startswith("vivado") else unknown and (f.startswith("vivado") or unknown[0].startswith("#   ")), (f, common)


def test_diagnostics(spark):
    files = spark.createDataFrame([("x", "a"), ("y", "b"), ("y", "b")], "subject string, path string")
    missing = missing_files(files, spark.createDataFrame([("a",)], "path string"))
    rows = Suppressed("w01, e31").warnings(Suppressed("w01, e31").downgrade(missing))
    assert missing.count() == 2 and rows.count() == 0 and Suppressed([]).warnings(missing).count() == 1
