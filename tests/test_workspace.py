import fnmatch

import pytest
from pyspark.sql import functions as F

from tessera.functions.plugins import Plugins
from tessera.plans import pickle, workspace
from tessera.sources import cores


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def test_roots(spark):
    starts = spark.createDataFrame([("/a/b/c", 1), ("/a/x", 1), ("/d/e", 1), ("/q", 1), ("/a/b", 2)], "start string, device long")
    manifests = spark.createDataFrame([("/a", 1), ("/a/b", 1), ("/d/e", 2), ("/a", 1)], "dir string, device long")
    assert rows(workspace.roots(starts, manifests), "start", "root") == rows(spark.createDataFrame([("/a/b/c", "/a/b"), ("/a/x", "/a"), ("/d/e", None), ("/q", None), ("/a/b", None)], "start string, root string"), "start", "root")
    top = spark.createDataFrame([("/", 1)], "dir string, device long")
    assert workspace.roots(starts.where("start = '/q'"), top).first().root == "/"
    assert workspace.roots(starts.where("start = '/a/b/c'"), manifests.where("dir = '/a'"), steps=2).first().root is None


def test_links_and_databases(spark):
    df = spark.createDataFrame([(1, False, False, None), (2, True, False, None), (3, True, True, "w"), (4, True, True, "x")], "id long, e boolean, l boolean, t string")
    assert rows(df.select("id", workspace.link_action(F.col("e"), F.col("l"), F.col("t"), F.lit("w")).alias("a")), "id", "a") == [(1, "create"), (2, "skip"), (3, "keep"), (4, "replace")]
    df = spark.createDataFrame([(1, False, 5, None, None), (2, True, 5, 9, None), (3, True, 9, 5, None), (4, True, 5, 9, True), (5, True, 9, 5, False), (6, True, 5, None, None)], "id long, e boolean, m long, f long, force boolean")
    action = workspace.database_action(F.col("e"), F.col("m"), F.col("f"), force=F.col("force"))
    assert rows(df.select("id", action.alias("a")), "id", "a") == [(1, "init"), (2, "skip"), (3, "fetch"), (4, "fetch"), (5, "skip"), (6, "fetch")]
    with pytest.raises(Exception, match="no network"):
        df.select(workspace.database_action(F.col("e"), F.col("m"), F.col("f"), local_only=True)).collect()
    assert spark.createDataFrame([("abc\nd",)], "o string").select(workspace.first_line(F.col("o")).alias("l")).first().l == "abc"


def test_checkout_state(spark):
    given = [
        (False, None, None, None, False, False, False, "clone", None),
        (True, None, True, True, False, False, False, "clone", None),
        (True, "r", False, True, True, False, False, "clean", None),
        (True, "q", True, True, False, False, False, "checkout", None),
        (True, "q", False, True, False, False, False, "clone", None),
        (True, "q", True, True, True, False, False, "checkout", None),
        (True, "q", True, False, True, False, False, "clean", "W19"),
        (True, "q", False, True, True, False, False, "clean", "W19"),
        (True, "q", False, True, True, True, False, "clone", None),
        (True, "q", False, True, True, False, True, "clone", None),
    ]
    df = spark.createDataFrame(given, "e boolean, cur string, url boolean, ok boolean, dir boolean, force boolean, listed boolean, state string, code string")
    c = F.col
    out = df.select("*", workspace.checkout_state(c("e"), c("cur"), F.lit("r"), c("url"), c("ok"), chosen_dir=c("dir"), force=c("force"), listed=c("listed")).alias("got"))
    assert [(r.got.state, r.got.code) for r in out.collect()] == [(x[7], x[8]) for x in given]


def test_path_dependencies(spark):
    declared = spark.createDataFrame([("top", "a", "sub/a"), ("a", "b", "../b"), ("b", "a", "../a"), ("a", "far", "/abs"), ("other", "z", "z")], "pkg string, dep string, path string")
    start = spark.createDataFrame([("top", "/co/top")], "pkg string, root string")
    assert rows(workspace.relocated(declared, start), "pkg", "dep", "path", "code") == [("top", "a", "/co/top/sub/a", "W09"), ("top", "b", "/co/top/sub/b", "W09")]
    declared = spark.createDataFrame([("p", "a", "/co/p/a"), ("a", "b", "/co/p/a/b"), ("p", "out", "/co/px"), ("b", "p", "/co/p/a/b/p")], "pkg string, dep string, path string")
    roots = spark.createDataFrame([("p", "/co/p"), ("a", "/co/p/a"), ("b", "/co/p/a/b"), ("out", "/co/px")], "pkg string, root string")
    assert rows(workspace.moved_with("p", declared, roots, "/new/p"), "dep", "path") == [("a", "/new/p/a"), ("b", "/new/p/b")]


def test_override_text(spark):
    cases = [("overrides:\n  dep: x\n  other: y\n", "overrides:\n  dep: { path: \"w/dep\" }\n#  dep: x\n  other: y\n"), ("overrides:\n  dep: x", "overrides:\n  dep: { path: \"w/dep\" }\n#  dep: x\n"), ("a: b\n", "overrides:\n  dep: { path: \"w/dep\" }\na: b\n"), (None, "overrides:\n  dep: { path: \"w/dep\" }\n")]
    df = spark.createDataFrame(cases, "text string, want string")
    names, entries = F.array(F.lit("dep")), F.array(F.lit('  dep: { path: "w/dep" }'))
    out = df.select("text", "want", workspace.override_text(F.col("text"), names, entries, create=True).alias("got"), workspace.override_text(F.col("text"), names, entries, create=False).alias("as_is"))
    for r in out.collect():
        assert r.got == r.want and (r.as_is == r.text or "overrides:" in (r.text or ""))


def test_next_patch(spark):
    df = spark.createDataFrame([("p", "0001-a.patch"), ("p", "0012-B.patch"), ("p", "9999-c.txt"), ("q", "readme")], "dir string, name string")
    assert rows(workspace.next_patch(df), "dir", "number") == [("p", 13), ("q", 1)]
    with pytest.raises(Exception, match="four digits"):
        workspace.next_patch(df.unionByName(spark.createDataFrame([("q", "abc.patch")], df.schema))).collect()


def brute_copied(path, include, exclude):
    def tree(ps):
        return [y for p in ps for y in (["**"] if p in ("", ".") else [p] if any(c in p for c in "*?[") else [p, p + "/**"])]

    wide = ["/".join(p.split("/")[: k + 1]) for p in tree(include) for k in range(p.count("/") + 1)]
    hit = lambda x, ps: any(fnmatch.fnmatchcase(x, p.replace("**/", "*/").replace("**", "*")) or p.startswith("**/") and fnmatch.fnmatchcase(x, p[3:]) for p in ps)
    parts = path.split("/")
    return all(hit(x, wide) and not hit(x, tree(exclude)) for x in ("/".join(parts[: k + 1]) for k in range(len(parts))))


def test_copying(spark):
    paths = ["a.sv", "src/a.sv", "src/b.v", "src/deep/c.sv", "doc/x.md", ".git/config", "doc/.git/y", "src/skip/d.sv"]
    for include, exclude in ((["**"], [".git"]), (["src"], [".git", "src/skip"]), (["src/*.sv"], [".git"]), (["doc/x.md", "a.?v"], [".git"]), ([""], ["doc", "**/*.v"]), (["src/deep/c.sv"], [])):
        df = spark.createDataFrame([(p,) for p in paths], "path string").withColumn("i", F.array(*map(F.lit, include))).withColumn("e", F.array(*map(F.lit, exclude)) if exclude else F.expr("cast(array() as array<string>)"))
        got = {r.path for r in df.where(workspace.copied(F.col("path"), F.col("i"), F.col("e"))).collect()}
        assert got == {p for p in paths if brute_copied(p, include, exclude)}, (include, exclude)
    listing = spark.createDataFrame([("v", p) for p in paths], "name string, path string")
    schema = "name string, target_dir string, include array<string>, exclude array<string>, mapping array<struct<from:string,to:string>>"
    plan = workspace.copy_plan(listing, spark.createDataFrame([("v", "/t", ["**"], [".git"], [("src/deep", "d"), ("a.sv", "top/b.sv")])], schema))
    assert rows(plan, "source", "target") == [("a.sv", "/t/top/b.sv"), ("src/deep/c.sv", "/t/d/c.sv")]
    assert ("v", "src/b.v", "/t/src/b.v") in rows(workspace.copy_plan(listing, spark.createDataFrame([("v", "/t", [""], [".git"], None)], schema)), "name", "source", "target")


def test_kept_locked(spark):
    lock = spark.createDataFrame([("a", ["b"]), ("b", ["c"]), ("c", []), ("d", [])], "name string, dependencies array<string>")
    assert rows(workspace.kept_locked(lock), "name") == []
    assert rows(workspace.kept_locked(lock, new_only=True), "name") == [("a",), ("b",), ("c",), ("d",)]
    assert rows(workspace.kept_locked(lock, ["a"]), "name") == [("b",), ("c",), ("d",)]
    assert rows(workspace.kept_locked(lock, ["a"], recursive=True), "name") == [("d",)]
    with pytest.raises(ValueError, match="not locked"):
        workspace.kept_locked(lock, ["x"])
    with pytest.raises(ValueError, match="frozen"):
        workspace.kept_locked(lock, frozen=True)


def test_refetches_and_overrides(spark):
    asked = spark.createDataFrame([("a", "s", "^1", False), ("b", "s", "abc", True), ("c", "s", "^2", False), ("d", "s", "def", True)], "dep string, source string, constraint string, is_revision boolean")
    fits = asked.where("dep = 'a'").select("dep", "source", "constraint")
    done = spark.createDataFrame([("b", "s", None), ("d", "s", None), ("d", "s", "def")], "dep string, source string, ref string")
    assert rows(workspace.refetches(asked, fits, done), "dep", "source", "ref") == [("b", "s", "abc"), ("c", "s", None)]
    folders = spark.createDataFrame([("x", "/x", False, None), ("y", "/y", True, ""), ("z", "/z", True, " M f")], "name string, path string, is_git boolean, status string")
    assert rows(workspace.present_overrides(folders), "name", "code") == [("x", "W06"), ("z", "W06")]
    assert workspace.present_overrides(folders, ignore=True).isEmpty()


def test_cores(spark):
    listing = spark.createDataFrame([("p", f"/p/{x}") for x in ("inc/a.svh", "inc/.h/b.svh", "inc/.c.vh", "inc/s/d.vh", "inc/e.sv", "incl/f.svh")], "pkg string, path string")
    folders = spark.createDataFrame([("p", "/p/inc")], "pkg string, dir string")
    assert rows(cores.include_files(listing, folders), "path") == [("/p/inc/a.svh",), ("/p/inc/s/d.vh",)]
    files = spark.createDataFrame([("p", "files_rtl", 0, "a.sv", None), ("p", "files_rtl", 1, "b.vhd", None), ("p", "files_rtl", 2, "inc/a.svh", "inc"), ("p", "test", 0, "t.v", None)], "pkg string, fileset string, pos long, path string, include_path string")
    depends = spark.createDataFrame([("p", "files_rtl", 0, "::q:1"), ("p", "files_rtl", 1, "::r:1"), ("p", "files_rtl", 2, "::q:1")], "pkg string, fileset string, pos long, vlnv string")
    sets = cores.merged_filesets(files, depends).orderBy("fileset").collect()
    text = cores.core_text("::p:1", sets, cores.chosen(["*", "test"], set()), cores.chosen(["*", "test"], {"simulation", "test"}), note="made", license_lines=["free"])
    assert text.startswith("CAPI=2:\n# made\n\n# free\n")
    back = cores.read_core(text)
    assert back["filesets"]["files_rtl"]["depend"] == ["::q:1", "::r:1"] and back["filesets"]["files_rtl"]["files"][1] == {"b.vhd": {"file_type": "vhdlSource"}}
    assert back["targets"]["default"]["filesets"] == ["*"] and back["targets"]["simulation"]["filesets"] == ["*", "test"]
    assert ("files_rtl", 2, "inc/a.svh", ["::q:1", "::r:1"]) in rows(cores.cores(spark.createDataFrame([("x", text)], "path string, text string")), "fileset", "pos", "file", "depend")


def test_pickle(spark):
    texts = ["module top; leaf u(.a(b)); endmodule : top // end\n\n\n", "module leaf; endmodule\n", "module alone; endmodule\n"]
    files = spark.createDataFrame([(i, f"{i}.sv", t) for i, t in enumerate(texts)] + [(9, "x.vhd", "entity")], "idx long, path string, text string")
    assert rows(pickle.skipped(files), "subject", "code") == [("x.vhd", "W34")]
    out = {r.idx: r.text for r in pickle.pickled(files, tops=["top"], prefix="p_", exclude=["leaf"], strip_comments=True, squash=True).collect()}
    assert out == {0: "module p_top; leaf u(.a(b)); endmodule : p_top\n", 1: "module leaf; endmodule\n"}
    assert {r.idx: r.text for r in pickle.pickled(files).collect()} == dict(enumerate(texts))
    assert '"kind": "decl", "name": "leaf"' in rows(pickle.trees_json(files.where("idx = 1")), "json")[0][0]
    with pytest.raises(ValueError, match="1 files did not parse: bad.sv"):
        pickle.pickled(files.unionByName(spark.createDataFrame([(4, "bad.sv", "module x; (")], files.schema)))


def test_plugins(spark):
    seen = []
    declared = spark.createDataFrame([("p", "gen", "/p/gen"), ("q", "lint", "/q/lint")], "pkg string, name string, path string")
    plugins = Plugins(declared, {"/p/gen": lambda env, args: seen.append((env, args)) or 3}, root="/r")
    assert plugins.run("gen", ["-x"], call_dir="/c") == 3 and seen == [({"CALL_DIR": "/c", "MANIFEST_DIR": "/r"}, ["-x"])]
    for name in ("lint", "none"):
        with pytest.raises(KeyError):
            plugins.run(name, [], call_dir="/c")
    with pytest.raises(ValueError, match="declared by"):
        Plugins(declared.unionByName(spark.createDataFrame([("z", "gen", "/z")], declared.schema)), {}, root="/r")


def test_rendered(spark):
    from tessera.plans.diagnostics import rendered

    df = spark.createDataFrame([("error", "E31", "bad", ["x", "y"], "do\nthis\n"), ("warning", None, "odd", None, None), ("advice", "A1", "m", [], "h")], "s string, c string, m string, causes array<string>, h string")
    out = [r.t for r in df.select(rendered(*(F.col(k) for k in ("s", "c", "m", "causes", "h"))).alias("t")).collect()]
    assert out == ["error[E31]: bad\n ├─› caused by: x\n ├─› caused by: y\n ├─› help: do\n ╰─› help: this", "warning: odd", "advice[A1]: m\n ╰─› help: h"]
