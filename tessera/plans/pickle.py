"""One text of many sources: parse, refuse what did not parse, trim to what the tops need, rename, print."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..frames import cut
from ..functions import paths
from ..operators import syntax
from ..shipping import ship_package

#: Paths that an error names; the count is always of all.
NAMED = 20


def skipped(files: DataFrame) -> DataFrame:
    """(subject, code): files (path) that are no Verilog and so are left out."""
    kind = paths.file_type(F.col("path"))
    return files.where(kind.isNull() | (kind != "verilog")).select(F.col("path").alias("subject"), F.lit("W34").alias("code"))


def pickled(files: DataFrame, *, tops: list[str] | None = None, prefix: str = "", suffix: str = "", exclude: list[str] | None = None, strip_comments: bool = False, squash: bool = False) -> DataFrame:
    """(idx, path, text) of files (idx, path, text), in the order of idx when sorted.

    A file that did not parse is an error, as its text would come out broken. With ``tops`` only files that they reach
    stay. Names declared in what stays get ``prefix`` and ``suffix``, but those in ``exclude``; with neither, and with
    nothing to strip, texts are as they were.
    """
    verilog = files.where(paths.file_type(F.col("path")) == "verilog").select("idx", "path", "text")
    parsed = cut(syntax.parse(verilog), "parsed")
    bad = parsed.where("NOT parsed_ok")
    if n := bad.count():
        named = [r.path for r in bad.select("path").orderBy("path").limit(NAMED).collect()]
        raise ValueError(f"{n} files did not parse: {', '.join(named)}{', ...' if n > NAMED else ''}")
    declared = parsed.select("idx", F.explode("declared").alias("name"))
    kept = verilog
    if tops:
        referenced = parsed.select("idx", F.explode("referenced").alias("name"))
        reached = cut(syntax.reachable(declared, referenced, tops).select(F.col("node").alias("idx")), "reached")
        kept, declared = kept.join(reached, "idx", "left_semi"), declared.join(reached, "idx", "left_semi")
    out = kept
    if prefix or suffix:
        names = syntax.rename_map(declared, prefix, suffix, exclude or [])
        out = syntax.rename_files(kept, names).join(kept.select("idx", "path"), "idx").select("idx", "path", "text")
    return printed(out, squash=squash, comments=not strip_comments) if strip_comments or squash else out


def printed(files: DataFrame, *, squash: bool, comments: bool) -> DataFrame:
    """Files (idx, path, text) without comments, without empty lines, or both."""
    ship_package(files.sparkSession)

    def run(batches):
        for pdf in batches:
            yield pdf.assign(text=[syntax.shown(t or "", squash=squash, comments=comments) for t in pdf["text"]])

    return files.select("idx", "path", "text").mapInPandas(run, "idx long, path string, text string")


def trees_json(files: DataFrame) -> DataFrame:
    """(idx, json): each file's places as an array of objects (kind, name, offset): the tree in its reduced form."""
    ship_package(files.sparkSession)

    def run(batches):
        import json

        for pdf in batches:
            rows = [json.dumps([{"kind": kind, "name": name, "offset": at} for name, at, kind in sorted(syntax.scan(t or "")["places"], key=lambda x: x[1])]) for t in pdf["text"]]
            yield pdf[["idx"]].assign(json=rows)

    return files.select("idx", "text").mapInPandas(run, "idx long, json string")
