"""Ordered text lines for compile scripts and file lists.

Groups are rows: (no, metadata, file_type, defines ARRAY<STRUCT<name, value>>, incdirs ARRAY<STRING>,
files ARRAY<STRUCT<file, comment>>). A tool is a description of its commands; lines come from array expressions over
the rows, so a script of any length is rendered by executors, group by group.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..frames import in_order, last_wins

_FPGA = ["vivado", "fpga", "xilinx"]
#: Targets that a format sets by itself, and the filesets of those that have several.
FORMAT_TARGETS = {
    "flist": ["flist"], "flist-plus": ["flist"], "vsim": ["vsim", "simulation"], "vcs": ["vcs", "simulation"], "verilator": ["verilator", "synthesis"],
    "synopsys": ["synopsys", "synthesis"], "formality": ["synopsys", "synthesis", "formality"], "riviera": ["riviera", "simulation"], "genus": ["genus", "synthesis"],
    "vivado": [*_FPGA, "synthesis"], "vivado-sim": [*_FPGA, "simulation"], "precision": ["precision", "fpga", "synthesis"], "template": [], "template_json": [],
}
FILESETS = {"vivado": ["", " -simset"], "vivado-sim": ["", " -simset"]}


@dataclass(frozen=True)
class Tool:
    """How a tool's script is written. ``body`` is "flags" (everything on the command), "list" (search path before, a
    Tcl list of files), "files" (files only, properties at the end) or "sections" (braced sections)."""

    body: str
    verilog: str
    vhdl: str
    head: tuple[str, ...] = ()
    foot: tuple[str, ...] = ()
    catch: tuple[str, str] | None = ("if {[catch { ", "}]} {return 1}")
    after_path: tuple[str, ...] = ()
    #: Whether the separate mode stops at errors too, and what the head has besides if the script stops.
    catch_separate: bool = True
    head_stop: tuple[str, ...] = ()
    #: Whether notes on files are told, and whether a command's last line goes on (it does wherever a catch follows a list
    #: of flags).
    notes: bool = True
    open_end: bool = False
    #: Modes in which include directories are written behind the root even if they lie elsewhere.
    behind_root: tuple[str, ...] = ()


_PATH = "set search_path $search_path_initial"
#: The commands of each tool.
TOOLS = {
    "vsim": Tool("flags", "vlog -incr -sv", "vcom -2008", ('set ROOT "{root}"',)),
    "vcs": Tool("flags", "vlogan -sverilog -full64", "vhdlan", ('ROOT="{root}"',), catch=None, head_stop=("set -e",), notes=False),
    "riviera": Tool("flags", "vlog -sv", "vcom -2008", ('set ROOT "{root}"', "vlib work"), open_end=True),
    "synopsys": Tool("list", "analyze -format sv", "analyze -format vhdl", ('set ROOT "{root}"', "set search_path_initial $search_path"), (_PATH,), ("if {0 == [", "]} {return 1}")),
    "formality": Tool("list", "read_sverilog -r", "read_vhdl -r", ('set ROOT "{root}"', "set search_path_initial $search_path"), (_PATH,), behind_root=("separate", "common")),
    "genus": Tool("list", "read_hdl -language sv", "read_hdl -language vhdl", ("if [ info exists search_path ] {", "    set search_path_initial $search_path", "} else {", "    set search_path_initial {}", "}", 'set ROOT "{root}"'), (_PATH,), after_path=("set_db init_hdl_search_path $search_path",), catch_separate=False, behind_root=("common",)),
    "vivado": Tool("files", "add_files -norecurse -fileset [current_fileset]", "add_files -norecurse -fileset [current_fileset]", ('set ROOT "{root}"',), catch=None),
    "precision": Tool("sections", "add_input_file -format SystemVerilog2012", "add_input_file -format vhdl_2008", ("set ROOT {root}", "set_input_dir $ROOT", "setup_design -search_path $ROOT"), open_end=True),
}


def _texts(*values: str) -> Column:
    return F.array(*map(F.lit, values)) if values else F.expr("cast(array() as array<string>)")


def rooted(path: Column, root: Column) -> Column:
    """The root's text replaced wherever it stands."""
    return F.replace(path, root, F.lit("$ROOT"))


def _rooted(path: Column, root: str) -> Column:
    return rooted(path, F.lit(root)) if root else path


def define_text(d: Column) -> Column:
    """``name=value``; an empty value is written as none."""
    return F.concat_ws("=", d["name"], F.when(d["value"] != "", d["value"]))


def _some(items: Column, lines: Column) -> Column:
    return F.when(F.size(items) > 0, lines).otherwise(_texts())


def _continued(lines: Column) -> Column:
    """All but the last line of a command, and notes, end in a backslash."""
    return F.transform(lines, lambda x, i: F.when((i < F.size(lines) - 1) & ~F.startswith(x, F.lit("# ")), F.concat(x, F.lit(" \\"))).otherwise(x))


def command(tool: Tool, kind: str, root: str, args: list[str], stop: bool, annotate: bool, common: bool = False, binary: str | None = None) -> Column:
    """Lines of a group's command; ``kind`` is verilog or vhdl. ``binary`` stands for the command's first word."""
    is_verilog = kind == "verilog"
    dirs, defines = F.col("incdirs"), F.col("defines")
    quote = (lambda x: F.concat(F.lit('"'), x, F.lit('"'))) if tool.body in ("flags", "list") else (lambda x: x)
    shown = (lambda x: x) if tool.body == "sections" else (lambda x: _rooted(x, root))
    behind = ("common" if common else "separate") in tool.behind_root
    folder = (lambda x: F.concat(F.lit("$ROOT"), F.replace(x, F.lit(root), F.lit("")) if root else x)) if behind else shown
    noted = lambda f: F.when(f["comment"].isNotNull(), F.array(F.concat(F.lit("# "), f["comment"]), quote(shown(f["file"])))).otherwise(F.array(quote(shown(f["file"]))))
    files = F.flatten(F.transform("files", noted)) if annotate and tool.notes else F.transform("files", lambda f: quote(shown(f["file"])))
    word = tool.verilog if is_verilog else tool.vhdl
    if binary:
        word = " ".join([binary, *word.split(" ")[1:]])
    first, before = [word, *args], _texts()
    if tool.body == "flags":
        parts = [_texts(*first)]
        if is_verilog:
            parts += [F.transform(defines, lambda d: F.concat(F.lit('"+define+'), define_text(d), F.lit('"'))), F.transform(dirs, lambda d: F.concat(F.lit('"+incdir+'), shown(d), F.lit('"')))]
        lines = _continued(F.concat(*parts, files))
    elif tool.body == "list":
        path = F.concat(_texts(_PATH), F.transform(dirs, lambda d: F.concat(F.lit('lappend search_path "'), folder(d), F.lit('"'))), _texts(*tool.after_path))
        before = path if is_verilog or not common else _texts()
        given = _some(defines, F.concat(_texts("-define {"), F.transform(defines, define_text), _texts("}"))) if is_verilog or not common else _texts()
        lines = _continued(F.concat(_texts(*first), given, _texts("[list"), files, _texts("]")))
    elif tool.body == "files":
        lines = _continued(F.concat(_texts(first[0] + " [list"), files, _texts("]")))
    else:
        path = _some(dirs, F.concat(_texts("-search_path {"), dirs, _texts("}"))) if is_verilog else _texts()
        lines = _continued(F.concat(_texts(*first), path, _texts("{"), files, _texts("}")))
    catch = stop and tool.catch is not None
    if tool.open_end or catch and tool.body == "flags":
        lines = F.concat(F.slice(lines, F.lit(1), F.size(lines) - 1), F.array(F.concat(F.element_at(lines, -1), F.lit(" \\"))))
    if catch:
        lines = F.concat(F.array(F.concat(F.lit(tool.catch[0]), F.element_at(lines, 1))), F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0))), _texts(tool.catch[1]))
    return F.concat(before, lines)


def script(groups: DataFrame, format: str, *, root: str = "", common: bool = False, stop: bool = False, annotate: bool = False, args: dict[str, list[str]] | None = None, filesets: list[str] | None = None, binaries: dict[str, str] | None = None) -> DataFrame:
    """(section, no, pos, line) of a script; order by the first three for the text. ``args`` and ``binaries`` by kind
    (verilog, vhdl). The list of all defines has no closing brace in the format of sections, as that format has it."""
    tool, args, binaries = TOOLS["vivado" if format == "vivado-sim" else format], args or {}, binaries or {}
    rows = commons(groups, all_in_one=tool.body == "files") if common else groups
    head = tool.head + (tool.head_stop if stop else ())
    stop = stop and (common or tool.catch_separate)
    kind = F.col("file_type")
    known = F.when(kind == "vhdl", command(tool, "vhdl", root, args.get("vhdl", []), stop, annotate, common, binaries.get("vhdl"))).otherwise(command(tool, "verilog", root, args.get("verilog", []), stop, annotate, common, binaries.get("verilog")))
    if tool.body != "files":
        n = F.size("files").cast("string")
        skipped = F.concat(F.array(F.concat(F.lit("# Skipping "), n, F.lit(" file(s) of unknown type (prefix with sv:/v:/vhd: to set one):"))), F.transform("files", lambda f: F.concat(F.lit("#   "), _rooted(f["file"], "" if tool.body == "sections" else root))))
        known = F.when(kind.isNull(), _texts() if common else skipped).otherwise(known)
    if annotate and not common:
        known = F.concat(F.array(F.concat(F.lit("# "), F.col("metadata"))), known)
    body = rows.select(F.lit(1).alias("section"), "no", F.posexplode(known).alias("pos", "line"))
    spark = groups.sparkSession
    edge = lambda section, lines: spark.createDataFrame([(section, 0, i, x.replace("{root}", root)) for i, x in enumerate(lines)], "section int, no long, pos int, line string")
    out = edge(0, head).unionByName(body).unionByName(edge(3, tool.foot))
    if tool.body == "files":
        out = out.unionByName(_properties(groups, root, filesets if filesets is not None else FILESETS["vivado"]))
    if tool.body == "sections":
        every = commons(groups, all_in_one=True).where(F.size("defines") > 0)
        lines = _continued(F.concat(_texts("setup_design -defines {"), F.transform("defines", lambda d: F.concat(F.lit("+define+"), define_text(d)))))
        out = out.unionByName(every.select(F.lit(0).alias("section"), F.lit(1).cast("long").alias("no"), F.posexplode(lines).alias("pos", "line")))
    return out


def _properties(groups: DataFrame, root: str, filesets: list[str]) -> DataFrame:
    every = commons(groups, all_in_one=True)
    sets = [(i, s) for i, s in enumerate(filesets)]
    named = F.explode(F.array(*[F.struct(F.lit(i).cast("long").alias("i"), F.lit(s).alias("s")) for i, s in sets]))
    ended = F.concat(F.lit("] [current_fileset"), F.col("s.s"), F.lit("]"))
    dirs = _some(F.col("incdirs"), _continued(F.concat(_texts("set_property include_dirs [list"), F.transform("incdirs", lambda d: _rooted(d, root)), F.array(ended))))
    defines = _some(F.col("defines"), _continued(F.concat(_texts("set_property verilog_define [list"), F.transform("defines", define_text), F.array(ended))))
    spread = every.select("*", named.alias("s"))
    part = lambda lines, at: spread.select(F.lit(2).alias("section"), (F.col("s.i") + at * len(sets)).alias("no"), F.posexplode(lines).alias("pos", "line"))
    return part(dirs, 0).unionByName(part(defines, 1))


def commons(groups: DataFrame, all_in_one: bool = False) -> DataFrame:
    """One group for each type (or one for all) with the union of files, directories and defines: files and defines at
    their first place, a define's last value, directories sorted. Defines and directories are those of all groups."""
    placed = groups.select("no", F.posexplode("files").alias("pos", "f"), "file_type").groupBy("f", "file_type").agg(F.min(F.struct("no", "pos")).alias("at"))
    kind = F.lit("verilog") if all_in_one else F.col("file_type")
    files = placed.groupBy(kind.alias("file_type")).agg(in_order("f", "at").alias("files"))
    defines = groups.select("no", F.posexplode("defines").alias("pos", "d")).select(F.struct("no", "pos").alias("at"), "d.name", "d.value")
    merged = last_wins(defines, ["name"], "value", "at").agg(in_order(F.struct("name", "value"), "at").alias("defines"))
    dirs = groups.select(F.explode("incdirs").alias("d")).agg(F.array_sort(F.collect_set("d")).alias("incdirs"))
    no = F.when(F.col("file_type") == "verilog", 0).when(F.col("file_type") == "vhdl", 1).otherwise(2).cast("long")
    return files.crossJoin(F.broadcast(merged)).crossJoin(F.broadcast(dirs)).select(no.alias("no"), F.lit("").alias("metadata"), "file_type", "defines", "incdirs", "files")  # one row each


def context(groups: DataFrame, *, root: str, define: list[str] | None = None) -> DataFrame:
    """(json): everything a template may ask for, as one text: each group, and over all groups the defines, directories and
    files, files by type, and the defines of the command line. It is the text of one project."""
    from .sources import add_defines

    every = commons(groups, all_in_one=True).select("defines", "incdirs", F.col("files").alias("all_files"))
    kinds = commons(groups)
    of = lambda kind, name: kinds.where(F.col("file_type") == kind).select(F.col("files").alias(name)) if kind else None
    own = groups.agg(in_order(F.struct("metadata", "file_type", "defines", "incdirs", "files"), "no").alias("srcs"))
    empty = F.expr("cast(array() as array<struct<file:string,comment:string>>)")
    sides = own.join(every, F.lit(True), "left").join(of("verilog", "all_verilog"), F.lit(True), "left").join(of("vhdl", "all_vhdl"), F.lit(True), "left")  # one row each
    given = add_defines(F.expr("cast(array() as array<struct<name:string,value:string>>)"), define or [])
    shown = F.struct(F.lit(root).alias("root"), given.alias("global_defines"), F.col("defines").alias("all_defines"), F.col("incdirs").alias("all_incdirs"), "all_files", "srcs", F.coalesce("all_verilog", empty).alias("all_verilog"), F.coalesce("all_vhdl", empty).alias("all_vhdl"))
    return sides.select(F.to_json(shown, {"ignoreNullFields": "false"}).alias("json"))


def flist(groups: DataFrame, *, root: str | None = None, annotate: bool = False) -> DataFrame:
    """(no, pos, line): one path a line, relative to ``root`` where it is given."""
    from ..functions.paths import relative

    path = lambda f: relative(f["file"], F.lit(root)) if root else f["file"]
    lines = F.flatten(F.transform("files", lambda f: F.when(f["comment"].isNotNull() & F.lit(annotate), F.array(F.concat(F.lit("// "), f["comment"]), path(f))).otherwise(F.array(path(f)))))
    head = F.array(F.concat(F.lit("// "), F.col("metadata"))) if annotate else _texts()
    return groups.select("no", F.posexplode(F.concat(head, lines)).alias("pos", "line"))


def flist_plus(files: DataFrame, dirs: DataFrame, defines: DataFrame, within: list[str], order: str, only: str | None = None) -> DataFrame:
    """(within.., section, key, line): include directories, then defines, then files; ``only`` one of incdirs,
    defines, files."""
    keyed = lambda df, section, key, line: df.select(*within, F.lit(section).alias("section"), key.alias("key"), line.alias("line"))
    parts = {
        "incdirs": keyed(dirs.select(*within, "dir").distinct(), 0, F.col("dir"), F.concat(F.lit("+incdir+"), F.col("dir"))),
        "defines": keyed(defines.groupBy(*within, "name").agg(F.max("value").alias("value")), 1, F.col("name"), F.concat(F.lit("+define+"), F.concat_ws("=", "name", F.when(F.col("value") != "", F.col("value"))))),
        "files": keyed(files, 2, F.lpad(F.col(order).cast("string"), 20, "0"), F.col("path")),
    }
    chosen = [v for k, v in parts.items() if only in (None, k)]
    out = chosen[0]
    for p in chosen[1:]:
        out = out.unionByName(p)
    return out


def verilator(groups: DataFrame, args: list[str] | None = None) -> DataFrame:
    """(no, pos, line): Verilog groups only."""
    lines = F.concat(_texts(*(args or [])), F.transform("defines", lambda d: F.concat(F.lit("+define+"), define_text(d))), F.transform("incdirs", lambda d: F.concat(F.lit("+incdir+"), d)), F.transform("files", lambda f: f["file"]))
    return groups.where("file_type = 'verilog'").select("no", F.posexplode(lines).alias("pos", "line"))


def as_json(groups: DataFrame) -> DataFrame:
    """(no, json): each group of the render context."""
    return groups.select("no", F.to_json(F.struct("metadata", "file_type", "defines", "incdirs", "files")).alias("json"))


def custom(groups: DataFrame, render: Callable[[dict], str]) -> DataFrame:
    """(no, text): a caller's own renderer over each group."""
    from ..shipping import ship_package

    ship_package(groups.sparkSession)

    def run(batches):
        import json

        for pdf in batches:
            yield pdf.assign(text=[render(json.loads(x)) for x in pdf["json"]])[["no", "text"]]

    return as_json(groups).mapInPandas(run, "no long, text string")
