"""Paths, globs and small text functions as columns."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: File types by extension, for lists and for core files.
VERILOG, VHDL = ("sv", "v", "vp"), ("vhd", "vhdl")


def extension(path: Column) -> Column:
    return F.regexp_extract(path, r"[^/]\.([^./]+)$", 1)


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def file_type(path: Column, declared: Column | None = None) -> Column:
    """verilog, vhdl or null; a declared sv, v or vhd decides over the extension."""
    kind = lambda x: F.when(x.isin(*VERILOG), "verilog").when(x.isin(*VHDL), "vhdl")
    return kind(extension(path)) if declared is None else F.coalesce(kind(declared), kind(extension(path)))


def fileset_type(path: Column, default: Column) -> Column:
    ext = extension(path)
    return F.when(ext.isin(*VHDL), "vhdlSource").when(ext == "v", "verilogSource").otherwise(default)


def under(path: Column, folder: Column) -> Column:
    """Whether ``path`` is ``folder`` or lies in it, by components."""
    return (path == folder) | F.startswith(path, F.concat(F.regexp_replace(folder, "/+$", ""), F.lit("/")))


def joined(root: Column, path: Column) -> Column:
    """``path`` from ``root`` unless it is absolute."""
    return F.when(F.startswith(path, F.lit("/")), path).otherwise(F.concat_ws("/", F.regexp_replace(root, "/+$", ""), path))


def normal(path: Column) -> Column:
    """Without empty, ``.`` and ``..`` components, as far as the text tells."""
    step = lambda out, x: F.when(x.isin("", "."), out).when((x == "..") & (F.size(out) > 0) & (F.element_at(out, -1) != ".."), F.slice(out, F.lit(1), F.size(out) - 1)).when((x == "..") & F.startswith(path, F.lit("/")), out).otherwise(F.array_append(out, x))
    # element_at of an empty array is guarded by the size before it
    parts = F.aggregate(F.split(path, "/"), F.expr("cast(array() as array<string>)"), lambda out, x: F.when(F.size(out) == 0, F.when(x.isin("", ".") | ((x == "..") & F.startswith(path, F.lit("/"))), out).otherwise(F.array_append(out, x))).otherwise(step(out, x)))
    return F.concat(F.when(F.startswith(path, F.lit("/")), "/").otherwise(""), F.array_join(parts, "/"))


def source_form(source: Column) -> Column:
    """One form for a dependency's source: an address (with ``://`` or ``user@host:``) as it is, a path made normal."""
    return F.when(source.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://|^[^/]+@[^/]+:"), source).otherwise(normal(source))


def relative(path: Column, root: Column) -> Column:
    """``path`` below ``root``, else unchanged; text only, as list formats do it."""
    return F.when(F.startswith(path, root), F.regexp_replace(F.substr(path, F.length(root) + 1), "^/+", "")).otherwise(path)


def glob_regex(pattern: Column) -> Column:
    """``*`` and ``?`` inside a component, ``**`` across components."""
    safe = F.regexp_replace(pattern, r"([.+^${}()|\[\]\\])", r"\\$1")
    safe = F.regexp_replace(F.regexp_replace(F.regexp_replace(safe, r"\*\*/?", "\u0001"), r"\*", "[^/]*"), r"\?", "[^/]")
    return F.concat(F.lit("^"), F.regexp_replace(safe, "\u0001", ".*"), F.lit("$"))


def is_glob(pattern: Column) -> Column:
    """Whether a path is a pattern; brackets alone make none."""
    return pattern.rlike(r"[*?]")


def expanded_globs(files: DataFrame, listing: DataFrame, path: str = "path") -> tuple[DataFrame, DataFrame]:
    """(files, warnings): ``files`` with a row for each path of the listing (path) that a pattern matches, and W05 rows
    (subject, code, severity, message) for patterns without one. Plain paths stay. Patterns are joined to files by
    their first folder where it is plain, so that only neighbours are compared."""
    rest = [c for c in files.columns if c != path]
    plain = files.where(~is_glob(F.col(path)))
    top = lambda p: F.regexp_extract(p, r"^(/?[^/]*)/", 1)
    patterns = files.where(is_glob(F.col(path))).withColumn("top_", F.when(~is_glob(top(F.col(path))), top(F.col(path))))
    there = listing.select(F.col("path").alias("found_")).distinct().withColumn("own_", top(F.col("found_")))
    fits = F.rlike(F.col("found_"), glob_regex(F.col(path)))
    near = patterns.where("top_ IS NOT NULL").join(there, F.col("top_") == F.col("own_")).where(fits)
    wide = patterns.where("top_ IS NULL").join(there, fits)
    hits = near.unionByName(wide)
    lost = patterns.join(hits.select(F.col(path).alias("hit_")).distinct(), F.col(path) == F.col("hit_"), "left_anti")
    told = lost.select(F.col(path).alias("subject"), F.lit("W05").alias("code"), F.lit("warning").alias("severity"), F.concat(F.lit("no file matches "), F.col(path)).alias("message")).distinct()
    return plain.select(*rest, path).unionByName(hits.select(*rest, F.col("found_").alias(path))), told


def loose_glob_regex(pattern: Column) -> Column:
    """As ``glob_regex``, but every wildcard crosses components: the rule of copying."""
    safe = F.regexp_replace(pattern, r"([.+^${}()|\[\]\\])", r"\\$1")
    safe = F.regexp_replace(F.regexp_replace(F.regexp_replace(safe, r"\*\*/", "\u0001"), r"\*+", ".*"), r"\?", ".")
    return F.concat(F.lit("^"), F.regexp_replace(safe, "\u0001", "(?:.*/)?"), F.lit("$"))


def substitute(path: Column, env: dict[str, str]) -> Column:
    """$NAME and ${NAME} replaced; a name that is not in ``env`` is an error."""
    out = path
    for name, value in sorted(env.items(), key=lambda x: -len(x[0])):
        out = F.regexp_replace(out, rf"\$\{{{re.escape(name)}\}}|\${re.escape(name)}(?![A-Za-z0-9_])", value.replace("\\", "\\\\").replace("$", "\\$"))
    return F.when(out.contains("$"), F.raise_error(F.concat(F.lit("unset variable in "), path)).cast("string")).otherwise(out)


def human_list(items: Column, separator: str = ",", last: str = "and") -> Column:
    """``a``, ``a and b``, ``a, b, and c``."""
    n = F.size(items)
    head = F.array_join(F.slice(items, F.lit(1), F.greatest(n - 1, F.lit(0))), f"{separator} ")
    tail = F.element_at(items, -1)
    return F.when(n == 0, "").when(n == 1, tail).when(n == 2, F.concat(head, F.lit(f" {last} "), tail)).otherwise(F.concat(head, F.lit(f"{separator} {last} "), tail))


def duration(seconds: Column) -> Column:
    """ms below a second, one decimal of seconds below a minute, else minutes; halves go to the even digit."""
    tenth = lambda x: F.replace(F.format_number(x, 1), F.lit(","), F.lit(""))
    return F.when(seconds < 1, F.concat(F.floor(seconds * 1000).cast("string"), F.lit("ms"))).when(seconds < 60, F.concat(tenth(seconds), F.lit("s"))).otherwise(F.concat(tenth(seconds / 60), F.lit("min")))


def remote_url(template: Column, name: Column) -> Column:
    """A remote's template with the package name in its place; without a place it is ``/<name>.git`` at the end."""
    n = F.regexp_count(template, F.lit(r"\{\}"))
    return F.when(n == 0, F.concat(F.regexp_replace(template, "/+$", ""), F.lit("/"), name, F.lit(".git"))).when(n == 1, F.replace(template, F.lit("{}"), name)).otherwise(F.raise_error(F.concat(F.lit("more than one place in "), template)).cast("string"))


def define(name: Column, value: Column) -> Column:
    """``k=v``, or ``k`` where there is no value."""
    return F.concat_ws("=", name, value)


def vlnv(vendor: Column, name: Column, version: Column) -> Column:
    return F.concat(F.coalesce(vendor, F.lit("")), F.lit("::"), name, F.lit(":"), F.coalesce(version, F.lit("")))
