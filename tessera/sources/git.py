"""Version-control listings, as text that was recorded at ingestion, to tables."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import semver

PEELED = "^{}"


def parse_refs(lines: DataFrame, column: str = "value") -> DataFrame:
    """(ref, hash) of ``hash ref`` lines; where a tag has a peeled line, its hash is that."""
    parts = F.split(F.trim(column), r"\s+", 2)
    rows = lines.select(parts[0].alias("hash"), parts[1].alias("full")).where("full IS NOT NULL")
    peeled = F.endswith("full", F.lit(PEELED))
    rows = rows.select("hash", peeled.alias("peeled"), F.when(peeled, F.expr(f"left(full, length(full) - {len(PEELED)})")).otherwise(F.col("full")).alias("ref"))
    return rows.groupBy("ref").agg(F.coalesce(F.min(F.when(F.col("peeled"), F.col("hash"))), F.min("hash")).alias("hash"))


def parse_tree(lines: DataFrame, column: str = "value", under: str | None = None) -> DataFrame:
    """(mode, kind, hash, name and other columns) of ``mode kind hash<TAB>name`` lines; with ``under``, only of that path
    and what lies below it, which is seen before a line is taken apart."""
    pattern = r"^(\d+) (\w+) ([0-9a-f]+)\t(.*)$"
    rest = [c for c in lines.columns if c != column]
    rows = lines.where(F.col(column).rlike(pattern))
    if under is not None:
        name = F.substring_index(column, "\t", -1)
        top = under.rstrip("/")
        rows = rows.where((name == top) | F.startswith(name, F.lit(top + "/")))
    return rows.select(*rest, *[F.regexp_extract(column, pattern, i).alias(n) for i, n in enumerate(("mode", "kind", "hash", "name"), 1)])


def revisions(listings: DataFrame, column: str = "value") -> DataFrame:
    """(repo, index, rev) of recorded listings (repo, value) of one revision a line, newest first."""
    return listings.select("repo", F.posexplode(F.split(column, "\n")).alias("index", "line")).select("repo", "index", F.trim("line").alias("rev")).where("rev <> ''")


def index_of(hashes: DataFrame, revs: DataFrame) -> DataFrame:
    """``hashes`` (repo, hash) with the index of each among its repository's revisions (repo, rev, index); unknown ones go."""
    return hashes.join(revs.select("repo", F.col("rev").alias("hash"), "index"), ["repo", "hash"])


def blob(contents: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` (hash) with the content of recorded objects (hash, content), each once."""
    return wanted.join(contents.dropDuplicates(["hash"]), "hash")


def manifests_at(trees: DataFrame, contents: DataFrame, file: str) -> tuple[DataFrame, DataFrame]:
    """((repo, rev, text), warnings): the manifest ``file`` of every revision of recorded listings (repo, rev, value), and a
    W12 row (subject, code, severity, message) for each revision without one."""
    entries = parse_tree(trees, under=file).where(F.col("name") == file)
    found = blob(contents, entries.select("repo", "rev", "hash")).select("repo", "rev", F.col("content").alias("text"))
    lost = trees.select("repo", "rev").distinct().join(found, ["repo", "rev"], "left_anti")
    return found, lost.select(F.col("repo").alias("subject"), F.lit("W12").alias("code"), F.lit("warning").alias("severity"), F.concat(F.lit("no manifest at "), "rev").alias("message"))


def needs_at(found: DataFrame, env: dict[str, str] | None = None) -> DataFrame:
    """What each revision's manifest asks for, as rows that version selection takes: parent, parent_rev, dep, pos, source,
    constraint, with the repository as ``repo``. Sources of such manifests are not looked at."""
    from ..plans.resolve import constraint_of, source_of
    from .documents import parsed

    documents = found.select(F.concat(F.lit("/"), "repo", F.lit("/manifest")).alias("path"), "text", "repo", F.col("rev").alias("at"))
    rows = parsed(documents, "dep_decl", env)
    return rows.select("repo", "parent", F.col("at").alias("parent_rev"), "dep", "pos", source_of(F.col("path"), F.col("url")).alias("source"), constraint_of(F.col("path"), F.col("version_req"), F.col("rev")).alias("constraint"))


#: Where a listing has tags and branches.
TAGS, BRANCHES = "refs/tags/", "refs/remotes/origin/"


def tags_and_branches(refs: DataFrame) -> DataFrame:
    """(repo, name, hash, is_tag) of refs (repo, ref, hash); others are left out."""
    tag, branch = F.startswith("ref", F.lit(TAGS)), F.startswith("ref", F.lit(BRANCHES))
    name = F.when(tag, F.expr(f"substring(ref, {len(TAGS) + 1})")).otherwise(F.expr(f"substring(ref, {len(BRANCHES) + 1})"))
    return refs.where(tag | branch).select("repo", name.alias("name"), "hash", tag.alias("is_tag"))


def names_of(refs: DataFrame, revs: DataFrame, within: list[str] = ()) -> DataFrame:
    """(within.., name, hash) of refs (name, hash, is_tag) whose revision is known; a tag wins over a branch of its name."""
    known = refs.join(revs.select(*within, "hash").distinct(), [*within, "hash"], "left_semi")
    best = known.groupBy(*within, "name", "is_tag").agg(F.min("hash").alias("hash"))
    return best.groupBy(*within, "name").agg(F.max_by("hash", "is_tag").alias("hash"))


def versions(refs: DataFrame, revs: DataFrame) -> DataFrame:
    """(repo, version, hash, place): tags ``v<version>`` on known revisions, highest first; refs (repo, ref, hash)."""
    tag = F.regexp_extract("ref", "^refs/tags/(.*)$", 1)
    rows = refs.join(revs.select("repo", "hash").distinct(), ["repo", "hash"], "left_semi").withColumn("version", semver.from_tag(tag)).where("version IS NOT NULL")
    return rows.select("repo", "version", "hash", F.row_number().over(Window.partitionBy("repo").orderBy(F.desc("version"), "hash")).alias("place"))


def submodule_paths(lines: DataFrame, column: str = "value") -> DataFrame:
    pattern = r"^\s*path\s*=\s*(.*?)\s*$"
    return lines.where(F.col(column).rlike(pattern)).select(F.regexp_extract(column, pattern, 1).alias("path"))


def uses_lfs(attributes: DataFrame, column: str = "value", tracked: DataFrame | None = None) -> DataFrame:
    """(repo, uses_lfs) of attribute lines (repo, value): whether one asks for large files and, where their listing
    (``tracked``: repo, path) is given, whether there is one."""
    asked = attributes.groupBy("repo").agg(F.bool_or(F.contains(F.col(column), F.lit("filter=lfs"))).alias("uses_lfs"))
    if tracked is None:
        return asked
    some = tracked.where("trim(path) <> ''").select("repo").distinct().withColumn("some", F.lit(True))
    return asked.join(some, "repo", "left").select("repo", (F.col("uses_lfs") & F.col("some").isNotNull()).alias("uses_lfs"))


def short_hash(text: str) -> str:
    return hashlib.blake2b(text.encode()).hexdigest()[:16]


def checkout_names(packages: DataFrame, root: str) -> DataFrame:
    """(name, database, checkout) of packages (name, url): names with a hash of the url, and for checkouts also of the
    root package's name, in double quotes. There is no such hash among the built-in functions."""
    from ..shipping import ship_package

    ship_package(packages.sparkSession)

    @F.pandas_udf("string")
    def hashed(texts: pd.Series) -> pd.Series:
        return texts.map(short_hash)

    return packages.select("name", F.concat_ws("-", "name", hashed("url")).alias("database"), F.concat_ws("-", "name", hashed(F.concat("url", F.lit(f'"{root}"')))).alias("checkout"))
