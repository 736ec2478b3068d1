"""Manifests, locks, configuration layers and file lists as tables."""

from __future__ import annotations

import json
import re
from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.semver import COMPARATOR
from ..shipping import ship_package

try:
    import yaml
except ImportError:  # JSON documents can still be read: they are YAML too
    yaml = None


def load(text: str):
    return yaml.safe_load(text) if yaml else json.loads(text)


def dump(value) -> str:
    return yaml.safe_dump(value, sort_keys=False) if yaml else json.dumps(value, indent=2)


def _text(value) -> str | None:
    """Scalars of any kind count as their text."""
    return None if value is None else str(value).lower() if isinstance(value, bool) else str(value)


def dependency_kind(path: Column, git: Column, version: Column, revision: Column) -> Column:
    """path, git_version, git_revision, version, or error: what a declaration's fields amount to."""
    p, g, v, r = (c.isNotNull() for c in (path, git, version, revision))
    return F.when(p & g | v & r, "error").when(p, F.when(v | r, "error").otherwise("path")).when(g, F.when(v, "git_version").when(r, "git_revision").otherwise("error")).otherwise(F.when(v & ~r, "version").otherwise("error"))


class ManifestError(ValueError):
    """A manifest that breaks a rule."""


VARIABLE = re.compile(r"\$(?:\{(\w+)\}|(\w+))")
KINDS, GROUP_FIELDS = {"sv", "v", "vhd"}, {"target", "include_dirs", "defines", "files", "external_flists", "override_files"}


def expanded(text: str, env: dict[str, str] | None) -> str:
    """$NAME and ${NAME} replaced; a name without a value is an error. Without ``env`` the text stays."""
    if env is None or "$" not in text:
        return text

    def value(m: re.Match) -> str:
        name = m[1] or m[2]
        if name not in env:
            raise ManifestError(f"{name} in {text} has no value")
        return env[name]

    return VARIABLE.sub(value, text)


def remote_place(name: str, template: str) -> str:
    """A remote's address with one place for the package's name; without one, it is put at the end."""
    if (n := template.count("{}")) > 1:
        raise ManifestError(f"the remote {name} has {n} places for a name")
    return template if n else f"{template.rstrip('/')}/{{}}.git"


def _address(name: str, d: dict, remotes: dict[str, str], chosen: str | None) -> str | None:
    """The address that a dependency's fields amount to; combinations that mean nothing are errors."""
    git, path, rev, version, remote = (d.get(k) for k in ("git", "path", "rev", "version", "remote"))
    if version is not None and str(version).strip() not in ("*", "x", "X") and not all(re.match(COMPARATOR, x.strip()) for x in str(version).split(",")):
        raise ManifestError(f"{version} is no version requirement, in {name}")
    if rev is not None and version is not None:
        raise ManifestError(f"{name} has both a version and a revision")
    if path is not None:
        if git is not None or rev is not None or version is not None:
            raise ManifestError(f"{name} has a path and git, a revision or a version")
        return None
    if git is not None:
        if remote is not None:
            raise ManifestError(f"{name} has both git and a remote")
        if rev is None and version is None:
            raise ManifestError(f"{name} has git without a revision or a version")
        return git
    if version is None:
        raise ManifestError(f"{name} needs a path, git, a revision or a version" if rev is None else f"{name} has a revision without git")
    if (remote or chosen) not in remotes:
        raise ManifestError(f"{name} names no remote that there is" if remote else f"{name} has only a version, and there is no default remote")
    return remotes[remote or chosen].replace("{}", d.get("upstream_name") or name)


def manifest_rows(path: str, text: str, env: dict[str, str] | None = None) -> dict[str, list[tuple]]:
    """The tables of one manifest. Names are lower-cased; string shorthands stand for maps; relative paths are joined to
    the manifest's folder, after variables of ``env`` are put in; what no rule knows is a warning, and what breaks one an
    error."""
    doc, root = load(text) or {}, str(PurePosixPath(path).parent)
    at = lambda p: q if (q := expanded(p, env)).startswith("/") else f"{root}/{q}"
    pkg = _text(doc["package"]["name"]).lower()
    out: dict[str, list[tuple]] = {k: [] for k in SCHEMAS}
    out["packages"].append((pkg, root, _text(doc["package"].get("description")), [str(a) for a in doc["package"].get("authors") or []]))
    given = {k: ({"url": v} if isinstance(v, str) else v) for k, v in (doc.get("remotes") or {}).items()}
    remotes = {k: remote_place(k, v["url"]) for k, v in given.items()}
    marked = [k for k, v in given.items() if v.get("default")]
    if len(marked) > 1:
        raise ManifestError(f"several default remotes: {', '.join(marked)}")
    chosen = marked[0] if marked else next(iter(remotes)) if len(remotes) == 1 else None
    for pos, (name, d) in enumerate((doc.get("dependencies") or {}).items()):
        d = d if isinstance(d, dict) else {"version": d}
        git = _address(str(name), d, remotes, chosen)
        passed = [(p, None) if isinstance(p, str) else (_text(p["pass"]), p.get("target")) for p in d.get("pass_targets") or []]
        out["dep_decl"].append((pkg, str(name).lower(), pos, _text(d.get("version")), git, _text(d.get("rev")), at(d["path"]) if d.get("path") else None, d.get("target"), [(t, p.lower()) for p, t in passed]))
    counter = iter(range(1 << 30))

    def group(node: dict, parent: int | None, pos: int) -> None:
        me = next(counter)
        dirs = [(None, at(i)) if isinstance(i, str) else (i.get("target"), at(i["dir"])) for i in node.get("include_dirs") or []]
        defines = [(k, v.get("target"), _text(v.get("value"))) if isinstance(v, dict) else (k, None, _text(v)) for k, v in (node.get("defines") or {}).items()]
        out["source_node"].append((pkg, me, parent, pos, node.get("target"), bool(node.get("override_files")), dirs, defines))
        entries = list(node.get("files") or [])
        for i, entry in enumerate(entries):
            if isinstance(entry, str):
                out["source_file"].append((pkg, me, i, at(entry), None))
                continue
            kinds = KINDS & set(entry)
            if kinds and GROUP_FIELDS & set(entry):
                raise ManifestError(f"{', '.join(sorted(kinds))} beside the fields of a group, in {pkg}")
            if len(kinds) > 1:
                raise ManifestError(f"a source of more than one type, in {pkg}")
            if kinds:
                kind, = kinds
                out["source_file"].append((pkg, me, i, at(entry[kind]), kind))
            else:
                group(entry, me, i)
        if "files" in node:  # lists are only read beside files
            out["flist"] += [(pkg, me, at(f)) for f in node.get("external_flists") or []]
        if not entries:
            out["diagnostic"].append((pkg, "W04", "warning", "an empty group"))
        out["diagnostic"] += [(pkg, "W03", "warning", f"unknown field {k}") for k in node if k not in GROUP_FIELDS]

    sources = doc.get("sources")
    if sources is not None:
        group(sources if isinstance(sources, dict) else {"files": sources}, None, 0)
    for i, d in enumerate(doc.get("export_include_dirs") or []):
        target, path_ = (None, d) if isinstance(d, str) else (d.get("target"), d["dir"])
        out["export_incdir"].append((pkg, i, target, at(path_)))
    out["plugin"] += [(pkg, k, at(v)) for k, v in (doc.get("plugins") or {}).items()]
    for v in doc.get("vendor_package") or []:
        links = [(m.get("from"), m.get("to"), m.get("patch_dir")) for m in v.get("mapping") or []]
        out["vendor_pkg"].append((pkg, _text(v["name"]), at(v["target_dir"]), str(v["upstream"].get("git") if isinstance(v["upstream"], dict) else v["upstream"]), [str(x) for x in v.get("include_from_upstream") or ["**"]], [str(x) for x in [*(v.get("exclude_from_upstream") or []), ".git"]], links))
    known = {"package", "remotes", "dependencies", "sources", "export_include_dirs", "plugins", "frozen", "workspace", "vendor_package"}
    out["diagnostic"] += [(pkg, "W03", "warning", f"unknown field {k}") for k in doc if k not in known]
    return out


SCHEMAS = {
    "packages": "pkg string, root string, description string, authors array<string>",
    "dep_decl": "parent string, dep string, pos long, version_req string, url string, rev string, path string, target string, pass_targets array<struct<target:string,pass:string>>",
    "source_node": "pkg string, node long, parent long, pos long, target string, override_files boolean, include_dirs array<struct<target:string,dir:string>>, defines array<struct<name:string,target:string,value:string>>",
    "source_file": "pkg string, node long, pos long, path string, declared string",
    "flist": "pkg string, node long, path string",
    "export_incdir": "pkg string, pos long, target string, path string",
    "plugin": "pkg string, name string, path string",
    "vendor_pkg": "pkg string, name string, target_dir string, upstream string, include array<string>, exclude array<string>, mapping array<struct<from:string,to:string,patch_dir:string>>",
    "diagnostic": "subject string, code string, severity string, message string",
}


def manifests(spark: SparkSession, path: str, table: str, env: dict[str, str] | None = None) -> DataFrame:
    """One of the tables of SCHEMAS, over all manifests that ``path`` (folders and globs too) leads to. Documents are
    parsed where they are read; unused tables are not made."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.y*ml").load(path)
    return parsed(raw.select(F.regexp_replace("path", "^file:", "").alias("path"), F.col("content").cast("string").alias("text")), table, env)


def parsed(documents: DataFrame, table: str, env: dict[str, str] | None = None) -> DataFrame:
    """One of the tables of SCHEMAS, of manifests (path, text, and what other columns each row is to carry)."""
    ship_package(documents.sparkSession)
    carried = [f for f in documents.schema.fields if f.name not in ("path", "text")]
    names = [f.name for f in carried] + [x.split(" ")[0] for x in _columns(SCHEMAS[table])]

    def run(batches):
        import pandas as pd

        for pdf in batches:
            rows = [(*own, *r) for p, t, *own in pdf[["path", "text", *[f.name for f in carried]]].itertuples(index=False, name=None) for r in manifest_rows(p, t, env)[table]]
            yield pd.DataFrame(rows, columns=names)

    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in carried), SCHEMAS[table]])
    return documents.select("path", "text", *[f.name for f in carried]).mapInPandas(run, schema)


def config_paths(starts: DataFrame, local: str, dotfile: str, home: str, everywhere: str) -> DataFrame:
    """(start, layer, path) of the configuration files that count for each folder (start), nearest first: in it and every
    folder above, ``local`` before ``dotfile``; then the home folder's, then the machine's."""
    parts = F.split(F.regexp_replace("start", "/+$", ""), "/")
    above = starts.select("start", F.posexplode(F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, F.lit(1), F.size(parts) - k), "/"))).alias("up", "dir"))
    both = F.posexplode(F.array(*[F.concat("dir", F.lit("/"), F.lit(n)) for n in (local, dotfile)]))
    near = above.select("start", "up", both.alias("k", "path")).select("start", (F.col("up") * 2 + F.col("k")).alias("layer"), "path")
    far = starts.select("start", F.size(parts).alias("n"), F.posexplode(F.array(F.lit(home), F.lit(everywhere))).alias("k", "path"))
    return near.unionByName(far.select("start", (F.col("n") * 2 + F.col("k")).alias("layer"), "path"))


def config_layers(starts: DataFrame, entries: DataFrame, local: str, dotfile: str, home: str, everywhere: str) -> DataFrame:
    """(start, layer, key, value, kind): entries (path, key, value, kind) of the files that there are, by layer; files that
    are missing have none."""
    return config_paths(starts, local, dotfile, home, everywhere).join(entries, "path").select("start", "layer", "key", "value", "kind")


def config_json(merged: DataFrame) -> DataFrame:
    """(json) of a merged configuration (key, value): keys in order, maps' entries (``map.entry``) inside their map."""
    parts = F.split("key", r"\.", 2)
    rows = merged.select(parts[0].alias("top"), F.try_element_at(parts, F.lit(2)).alias("entry"), "value")
    inner = rows.where("entry IS NOT NULL").groupBy("top").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("entry", "value"))))).alias("json"))
    plain = rows.where("entry IS NULL").select("top", F.expr("substring(to_json(array(value)), 2, length(to_json(array(value))) - 2)").alias("json"))
    every = plain.unionByName(inner).withColumn("named", F.concat(F.expr("substring(to_json(array(top)), 2, length(to_json(array(top))) - 2)"), F.lit(":"), "json"))
    return every.agg(F.concat(F.lit("{"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("top", "named"))), lambda x: x["named"]), ","), F.lit("}")).alias("json"))


def _columns(schema: str) -> list[str]:
    out, depth, word = [], 0, ""
    for c in schema + ",":
        depth += (c in "<(") - (c in ">)")
        if c == "," and not depth:
            out.append(word.strip())
            word = ""
        else:
            word += c
    return out


LOCK = "name string, revision string, version string, source_kind string, source_uri string, dependencies array<string>"


def lock_rows(text: str, root: str) -> list[tuple]:
    """Packages of a lock, by name; paths inside it count from ``root``."""
    rows = []
    for name, p in sorted((load(text) or {}).get("packages", {}).items()):
        (kind, uri), = p["source"].items()
        if kind == "Path" and not uri.startswith("/"):
            uri = f"{root.rstrip('/')}/{uri}"
        rows.append((str(name).lower(), _text(p.get("revision")), _text(p.get("version")), kind, uri, sorted(map(str, p.get("dependencies") or []))))
    return rows


def locks(documents: DataFrame) -> DataFrame:
    """Rows of LOCK of many locks (root, text), parsed where they are, with each one's root."""
    ship_package(documents.sparkSession)

    def run(batches):
        import pandas as pd

        for pdf in batches:
            rows = [(root, *r) for root, text in zip(pdf["root"], pdf["text"], strict=True) for r in lock_rows(text or "", root)]
            yield pd.DataFrame(rows, columns=["root", *(x.split(" ")[0] for x in LOCK.split(", "))])

    return documents.select("root", "text").mapInPandas(run, f"root string, {LOCK}")


def read_lock(spark: SparkSession, path: str, root: str) -> DataFrame:
    """A lock file as a table; a missing one is an empty table. A lock is one small document: the driver reads it."""
    found = spark.read.format("binaryFile").load(path).select("content").collect() if _exists(spark, path) else []
    return spark.createDataFrame([r for f in found for r in lock_rows(bytes(f.content).decode(), root)], LOCK)


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def lock_text(lock: DataFrame, root: str) -> str:
    """The text of a lock, names and dependencies sorted, paths inside ``root`` relative to it."""
    packages = {}
    for r in lock.orderBy("name").collect():  # one row for each package of one project
        uri = r.source_uri
        if r.source_kind == "Path" and uri.startswith(root.rstrip("/") + "/"):
            uri = uri[len(root.rstrip("/")) + 1 :]
        packages[r.name] = {"revision": r.revision, "version": r.version, "source": {r.source_kind: uri}, "dependencies": sorted(r.dependencies)}
    return dump({"packages": packages})


def merged_config(layers: DataFrame) -> DataFrame:
    """(key, value) of layers (layer, key, value, kind), layer 0 being nearest: scalars from the nearest layer, entries
    of maps from the farthest, flags true if any is."""
    kind = F.first("kind")
    return layers.groupBy("key").agg(F.when(kind == "map", F.max_by("value", "layer")).when(kind == "flag", F.bool_or(F.col("value") == "true").cast("string")).otherwise(F.min_by("value", "layer")).alias("value"))


def flist_words(lists: DataFrame, text: str, *keep: str) -> DataFrame:
    """Words of file lists, comments and blank lines left out: other columns, line, pos, word."""
    rest = [c for c in lists.columns if c != text]
    lines = lists.select(*rest, F.posexplode(F.split(text, "\n")).alias("line", "value")).withColumn("value", F.btrim("value", F.lit(" \t\r")))
    kept = lines.where((F.col("value") != "") & ~F.startswith("value", F.lit("#")) & ~F.startswith("value", F.lit("//")))
    return kept.select(*rest, "line", F.posexplode(F.split("value", r"\s")).alias("pos", "word"))


def flist_entries(words: DataFrame, root: Column) -> DataFrame:
    """Words as entries: kind (incdir, define, file) and value; other ``+`` words are ignored, paths count from root."""
    from ..functions.paths import joined

    word = F.col("word")
    parts = F.split(word, r"\+")
    kind = F.when(F.startswith(word, F.lit("+incdir+")), "incdir").when(F.startswith(word, F.lit("+define+")), "define").when(~F.startswith(word, F.lit("+")) & (word != ""), "file")
    values = F.when(F.startswith(word, F.lit("+")), F.filter(F.slice(parts, F.lit(3), F.size(parts)), lambda x: x != "")).otherwise(F.array(word))
    rows = words.withColumn("kind", kind).where("kind IS NOT NULL").select("*", F.explode(values).alias("value"))
    return rows.withColumn("value", F.when(F.col("kind") == "define", F.col("value")).otherwise(joined(root, F.col("value"))))
