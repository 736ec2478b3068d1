from pyspark.sql import functions as F

from tessera.sources import documents as D
from tessera.sources import git
from tessera.streaming import progress

MANIFEST = """
package: {name: My_IP, authors: [x]}
remotes: {hub: "https://hub/{}.git"}
dependencies:
  A: 1.2.0
  b: {path: ../b, target: sim, pass_targets: [Fast, {target: x, pass: Slow}]}
  c: {git: g, rev: abc}
sources:
  - a.sv
  - target: all(sim, not(fpga))
    include_dirs: [inc, {target: sim, dir: /abs}]
    defines: {K: null, L: 3, M: {target: t, value: v}}
    files: [b.vhd, {sv: c.txt}]
  - files: []
export_include_dirs: [inc]
plugins: {run: run.sh}
extra: 1
"""


def test_manifest(spark, tmp_path):
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "Manifest.yml").write_text(MANIFEST)
    table = lambda t: D.manifests(spark, str(tmp_path), t).collect()
    root = f"{tmp_path}/x"
    deps = {r.dep: r for r in table("dep_decl")}
    assert deps["a"].url == "https://hub/A.git" and deps["a"].version_req == "1.2.0" and deps["b"].path == f"{root}/../b" and [tuple(p) for p in deps["b"].pass_targets] == [(None, "fast"), ("x", "slow")]
    nodes = table("source_node")
    assert [n.parent for n in nodes] == [None, 0, 0] or sorted((n.node, n.parent) for n in nodes) == [(0, None), (1, 0), (2, 0)]
    group = next(n for n in nodes if n.target)
    assert [tuple(d) for d in group.defines] == [("K", None, None), ("L", None, "3"), ("M", "t", "v")] and [tuple(d) for d in group.include_dirs] == [(None, f"{root}/inc"), ("sim", "/abs")]
    assert {(r.path, r.declared) for r in table("source_file")} == {(f"{root}/a.sv", None), (f"{root}/b.vhd", None), (f"{root}/c.txt", "sv")}
    assert {r.code for r in table("diagnostic")} == {"W03", "W04"} and table("packages")[0].pkg == "my_ip"


def test_lock_round_trip(spark, tmp_path):
    text = "packages:\n  B: {revision: r, version: 1.0.0, source: {Git: u}, dependencies: [z, a]}\n  a: {source: {Path: sub}}\n"
    (tmp_path / "lock").write_text(text)
    lock = D.read_lock(spark, str(tmp_path / "lock"), "/root/p")
    assert {r.name: (r.source_kind, r.source_uri, r.dependencies) for r in lock.collect()} == {"b": ("Git", "u", ["a", "z"]), "a": ("Path", "/root/p/sub", [])}
    assert "Path: sub" in D.lock_text(lock, "/root/p") and D.read_lock(spark, str(tmp_path / "none"), "/").count() == 0


def test_flist(spark):
    df = spark.createDataFrame([(1, "# c\n\n a.sv b.sv\n+incdir+i+j\n// x\n+define+K=1+L\n+libext+.v\n/abs.v")], "id long, text string")
    got = D.flist_entries(D.flist_words(df, "text"), F.lit("/r")).orderBy("line", "pos").collect()
    assert [(r.kind, r.value) for r in got] == [("file", "/r/a.sv"), ("file", "/r/b.sv"), ("incdir", "/r/i"), ("incdir", "/r/j"), ("define", "K=1"), ("define", "L"), ("file", "/abs.v")]


def test_config(spark):
    rows = [(0, "git", "near", "scalar"), (1, "git", "far", "scalar"), (0, "o.x", "near", "map"), (1, "o.x", "far", "map"), (0, "lfs", "false", "flag"), (1, "lfs", "true", "flag")]
    assert {r.key: r.value for r in D.merged_config(spark.createDataFrame(rows, "layer long, key string, value string, kind string")).collect()} == {"git": "near", "o.x": "far", "lfs": "true"}


def test_git_listings(spark):
    lines = spark.createDataFrame([("aa refs/tags/v1.0.0",), ("bb refs/tags/v1.0.0^{}",), ("cc refs/heads/main",)], "value string")
    assert {r.ref: r.hash for r in git.parse_refs(lines).collect()} == {"refs/tags/v1.0.0": "bb", "refs/heads/main": "cc"}
    assert [tuple(r) for r in git.parse_tree(spark.createDataFrame([("100644 blob ab\tx y",), ("junk",)], "value string")).collect()] == [("100644", "blob", "ab", "x y")]
    refs = spark.createDataFrame([("r", "refs/tags/v1.0.0", "a"), ("r", "refs/tags/v1.10.0", "b"), ("r", "refs/tags/x", "b"), ("r", "refs/tags/v9.0.0", "gone")], "repo string, ref string, hash string")
    revs = spark.createDataFrame([("r", "a"), ("r", "b")], "repo string, hash string")
    assert [r.hash for r in git.versions(refs, revs).orderBy("place").collect()] == ["b", "a"]


LINES = [
    ("Receiving objects: 34% (123/456)", "receiving", 34, None), ("Resolving deltas: 100% (1122/1122), done.", "resolving", 100, None), ("Cloning into 'x/myrepo/'...", "cloning", None, "myrepo"),
    ("Submodule 'libs/mylib' (u) registered for path 'libs/mylib'", "registered", None, "mylib"), ("Submodule path 'libs/mylib': checked out 'abc'", "checkout", None, "mylib"), ("fatal: no host", "error", None, None), ("hello", "other", None, None),
]


def test_progress(spark):
    got = progress.classified(spark.createDataFrame([(i, x[0]) for i, x in enumerate(LINES)], "i long, line string")).orderBy("i").collect()
    assert [(r["class"], r.percent, r.name) for r in got] == [x[1:] for x in LINES]
    chunk = spark.createDataFrame([("a\rb\nc",)], "value string")
    assert [r.line for r in progress.lines_of(chunk).collect()] == ["a", "b"]


def test_progress_stream_equals_batch(spark, tmp_path):
    rows = [(i % 2, i, LINES[(i * 3 + i // 2) % len(LINES)][0]) for i in range(40)]
    df = spark.createDataFrame(rows, "operation long, seq long, line string")
    for k in range(2):
        df.where(f"floor(seq / 20) = {k}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = progress.track(spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 8).parquet(str(tmp_path / "in")))
    q = stream.writeStream.outputMode("update").format("memory").queryName("progress_states").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    last = {}
    for r in spark.table("progress_states").collect():
        if r.operation not in last or r.last_seq >= last[r.operation].last_seq:
            last[r.operation] = r
    batch = {r.operation: tuple(r) for r in progress.latest(df).select("operation", "active", "percent", "finished", "errors", "last_seq").collect()}
    assert {k: tuple(v) for k, v in last.items()} == batch
