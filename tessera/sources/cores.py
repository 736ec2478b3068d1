"""Core files: their documents, the headers they list, and the text of a generated one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..frames import in_order
from ..functions import paths, targets
from .documents import dump, load

HEADERS = ("svh", "vh")
SCHEMA = "path string, name string, fileset string, pos long, file string, depend array<string>"


def include_files(listing: DataFrame, folders: DataFrame) -> DataFrame:
    """(pkg, dir, path) of folders (pkg, dir): headers of the listing (pkg, path) in or below them. Files in hidden
    folders and hidden files are left out; a folder that is hidden itself is not."""
    below = listing.join(folders, "pkg").where(paths.under(F.col("path"), F.col("dir")) & (F.col("path") != F.col("dir")))
    rest = F.expr("substring(path, length(dir) + 2)")
    return below.where(~rest.rlike(r"(^|/)\.") & paths.extension(F.col("path")).isin(*HEADERS)).select("pkg", "dir", "path")


def read_core(text: str) -> dict:
    """A core document, merge keys applied; the heading line is a comment's equal and is left out."""
    lines = text.split("\n")
    return load("\n".join(lines[1:]) if lines[0].startswith("CAPI=") else text) or {}


def core_rows(path: str, text: str) -> list[tuple]:
    doc, out = read_core(text), []
    for fileset, f in (doc.get("filesets") or {}).items():
        names = [next(iter(x)) if isinstance(x, dict) else x for x in f.get("files") or []]
        depend = [str(d) for d in f.get("depend") or []]
        out += [(path, doc.get("name"), fileset, i, str(n), depend) for i, n in enumerate(names)] or [(path, doc.get("name"), fileset, None, None, depend)]
    return out


def cores(files: DataFrame) -> DataFrame:
    """Rows of SCHEMA of core files (path, text), parsed where they are; a fileset without files has one row."""
    from ..shipping import ship_package

    ship_package(files.sparkSession)

    def run(batches):
        import pandas as pd

        columns = [x.split(" ")[0] for x in SCHEMA.split(", ")]
        for pdf in batches:
            rows = [r for p, t in zip(pdf["path"], pdf["text"], strict=True) for r in core_rows(p, t or "")]
            yield pd.DataFrame(rows, columns=columns).astype({"pos": "Int64"})

    return files.select("path", "text").mapInPandas(run, SCHEMA)


def fileset_of(target: Column, expressions: list[str]) -> Column:
    """The fileset's name for each target text; null is everything."""
    out = F.when(target.isNull() | (target == "*"), targets.fileset_name(targets.ANYTHING))
    for e in expressions:
        out = out.when(target == e, targets.fileset_name(targets.parse(e)))
    return out


def chosen(expressions: list[str], active: set[str]) -> list[str]:
    """Expressions that hold for ``active``, in order."""
    return [e for e in expressions if targets.holds(targets.parse(e) if e != "*" else targets.ANYTHING, active)]


def merged_filesets(files: DataFrame, depends: DataFrame) -> DataFrame:
    """(pkg, fileset, files, depend): filesets of one name merged. ``files`` (pkg, fileset, pos, path, include_path),
    ``depends`` (pkg, fileset, pos, vlnv), where each dependency stays once, at its first place."""
    listed = files.groupBy("pkg", "fileset").agg(in_order(F.struct("path", "include_path"), "pos").alias("files"))
    once = depends.groupBy("pkg", "fileset", "vlnv").agg(F.min("pos").alias("pos")).groupBy("pkg", "fileset").agg(in_order("vlnv", "pos").alias("depend"))
    return listed.join(once, ["pkg", "fileset"], "full_outer")


def depend_names(needs: DataFrame, cores: DataFrame) -> DataFrame:
    """``needs`` (pkg, fileset, pos, dep) with the full name of each dependency, of cores (dep, vlnv); a dependency without a
    core is an error."""
    both = needs.join(cores.dropDuplicates(["dep"]), "dep", "left")
    return both.withColumn("vlnv", F.when(F.col("vlnv").isNull(), F.raise_error(F.concat(F.lit("no core is known of "), "dep")).cast("string")).otherwise(F.col("vlnv")))


def core_files(groups: DataFrame, headers: DataFrame, cores: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(files, depends, targets) of flattened groups (pkg, at, chain, target, files, dependencies) as ``merged_filesets`` and
    ``core_text`` take them: a fileset for each target, its headers (pkg, at, path, include_path) after its files."""
    names = groups.select("pkg", "at", "target").withColumn("fileset", fileset_of(F.col("target"), [r[0] for r in groups.select("target").distinct().limit(targets.MOST_CASES).collect() if r[0] not in (None, "*")]))
    listed = groups.select("pkg", "at", F.posexplode("files").alias("i", "f")).select("pkg", "at", F.struct("at", F.lit(0).alias("k"), "i").alias("pos"), F.col("f.path").alias("path"), F.lit(None).cast("string").alias("include_path"))
    own = headers.join(groups.select("pkg", "at"), ["pkg", "at"]).select("pkg", "at", F.struct("at", F.lit(1).alias("k"), F.lit(0).alias("i")).alias("pos"), "path", "include_path")
    files = listed.unionByName(own).join(names, ["pkg", "at"]).select("pkg", "fileset", "pos", "path", "include_path")
    needs = groups.select("pkg", "at", F.posexplode("dependencies").alias("i", "dep")).join(names, ["pkg", "at"]).select("pkg", "fileset", F.struct("at", "i").alias("pos"), "dep")
    return files, depend_names(needs, cores).select("pkg", "fileset", "pos", "vlnv"), names.select("pkg", "fileset", "target").distinct()


def core_text(name: str, filesets: list, defaults: list[str], simulation: list[str], *, note: str = "", license_lines: list[str] = ()) -> str:
    """The document of one package; ``filesets`` are its rows of ``merged_filesets``, a few for each target expression."""
    kinds = {"vhd": "vhdlSource", "vhdl": "vhdlSource", "v": "verilogSource"}

    def entry(f):
        if f["include_path"] is not None:
            return {f["path"]: {"is_include_file": True, "include_path": f["include_path"]}}
        kind = kinds.get(f["path"].rsplit(".", 1)[-1]) if "." in f["path"] else None
        return {f["path"]: {"file_type": kind}} if kind else f["path"]

    sets = {r["fileset"]: {"file_type": "systemVerilogSource", "files": [entry(f) for f in r["files"] or []], "depend": list(r["depend"] or [])} for r in filesets}
    doc = {"name": name, "filesets": sets, "targets": {"default": {"filesets": list(defaults)}, "simulation": {"filesets": list(simulation)}}}
    head = "".join(["CAPI=2:\n", f"# {note}\n\n", *(f"# {line}\n" for line in license_lines)])
    return f"{head}\n{dump(doc)}"


#: Fixed value: the targets that the simulation of a core has besides.
SIMULATION = {"simulation", "test"}


def core_documents(groups: DataFrame, headers: DataFrame, cores: DataFrame, *, note: str = "", license_lines: tuple[str, ...] = ()) -> DataFrame:
    """(pkg, text): the core file of every package of flattened groups; ``target`` is each group's own, shown. Filesets whose
    target holds for nothing are the default's, those that hold for SIMULATION the simulation's. A task writes one package's
    file, as long as that is."""
    from ..shipping import ship_package

    ship_package(groups.sparkSession)
    files, depends, named = core_files(groups, headers, cores)
    merged = merged_filesets(files, depends)
    per = merged.groupBy("pkg").agg(F.collect_list(F.struct("fileset", "files", "depend")).alias("sets"))
    told = named.groupBy("pkg").agg(F.collect_set(F.struct("fileset", "target")).alias("named"))
    rows = per.join(told, "pkg").join(cores.select(F.col("dep").alias("pkg"), "vlnv"), "pkg").select("pkg", "vlnv", "sets", "named")

    def run(batches):
        for pdf in batches:
            texts = []
            for name, sets, names in zip(pdf["vlnv"], pdf["sets"], pdf["named"], strict=True):
                names = sorted((n["target"] or "*", n["fileset"]) for n in names)
                sets = [{k: list(v) if k != "fileset" and v is not None else v for k, v in r.items()} for r in sets]
                of = lambda active, names=names: list(dict.fromkeys(f for t, f in names if t in chosen([t], active)))
                texts.append(core_text(name, sorted(sets, key=lambda r: r["fileset"]), of(set()), of(SIMULATION), note=note, license_lines=list(license_lines)))
            yield pdf[["pkg"]].assign(text=texts)

    return rows.mapInPandas(run, "pkg string, text string")
